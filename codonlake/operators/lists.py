"""Sites of a few sequences as sorted lists, and the searches by which they are joined inside a task.

The sequences lie one behind the other on an axis: the one of number g begins at ``base[g]``, a multiple of three, and between two of
them is a gap that no join reaches over. So frames stay, and one search serves all sequences. What is found comes out in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from codonlake.operators.signals import PIECE, places, row_groups

#: Left sites that are joined at once.
STEP = 1 << 16


class Sites(NamedTuple):
    """Sites of one kind in order of their places on the axis; ``cls`` is the splice class."""

    at: np.ndarray
    score: np.ndarray
    cls: np.ndarray

    def take(self, index: np.ndarray | slice) -> Sites:
        return Sites(*(c[index] for c in self))


NONE = Sites(np.zeros(0, np.int64), np.zeros(0, np.float64), np.zeros(0, np.int32))


def group_of(base: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(base, at, "right") - 1


def motif_lists(batches: Iterator[pa.RecordBatch], motifs: dict[str, tuple[str, ...]], gap: int) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """(ids, base, places by kind) of (id, seq) for a few sequences at a time: where a word of each kind begins."""
    for batch in batches:
        for first, end in row_groups(batch, PIECE):
            seqs = batch.column(1).slice(first, end - first).cast(pa.binary()).to_pylist()
            size = np.array([len(x) for x in seqs], np.int64)
            # a line feed is no base, so no word goes from one sequence into the next
            b = np.frombuffer(b"\n".join(seqs) + b"\n", np.uint8)
            begin = np.concatenate([[0], np.cumsum(size + 1)])
            base = np.concatenate([[0], np.cumsum((size + gap + 2) // 3 * 3)])
            found = {kind: places(b, words) for kind, words in motifs.items()}
            yield batch.column(0).slice(first, end - first).to_numpy(zero_copy_only=False), base, {kind: p + (base - begin)[group_of(begin, p)] for kind, p in found.items()}


def table_lists(table: pa.Table) -> dict[str, Sites]:
    """The sites (kind, pos, score, cls) of one sequence by kind; its base is 0."""
    pos, score = (table.column(c).to_numpy() for c in ("pos", "score"))
    cls = table.column("cls").to_numpy() if "cls" in table.column_names else np.zeros(len(pos), np.int32)
    order = np.lexsort((score, cls, pos))
    kinds = table.column("kind").combine_chunks().dictionary_encode()
    code, every = kinds.indices.to_numpy()[order], Sites(pos.astype(np.int64)[order], score[order], cls[order])
    return {kind: every.take(code == i) for i, kind in enumerate(kinds.dictionary.to_pylist())}


def pieces(n: int, size: int = STEP) -> Iterator[slice]:
    for i in range(0, n, size):
        yield slice(i, min(i + size, n))


def runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of runs [lo, hi): (number of the run, member)."""
    n = hi - lo
    run = np.repeat(np.arange(len(n)), n)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(n) - n - lo, n)


class Best:
    """The ``k`` first members, in a total order, of any run of a list.

    ``order`` has the members, first ones first. A run is searched by the least rank in it (two lookups in a table of runs of
    powers of two), then by what lies before and behind that member, so the work doesn't grow with the length of runs.
    """

    def __init__(self, order: np.ndarray):
        self.order, self.n = order, len(order)
        rank = np.empty(self.n, np.int32)
        rank[order] = np.arange(self.n, dtype=np.int32)
        self.least = [rank]

    def _rank(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.full(len(lo), self.n, np.int64)
        level = np.frexp(np.maximum(hi - lo, 0))[1] - 1
        while len(self.least) <= level.max(initial=0):  # as long as runs are
            step = 1 << len(self.least) - 1
            self.least.append(np.minimum(self.least[-1][:-step], self.least[-1][step:]))
        for k in range(len(self.least)):
            at = np.flatnonzero(level == k)
            if len(at):
                out[at] = np.minimum(self.least[k][lo[at]], self.least[k][hi[at] - (1 << k)])
        return out

    def first(self, lo: np.ndarray, hi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the run, member) of the ``k`` first members of each run [lo, hi), or all where there are no more."""
        whole = np.where(hi - lo <= k, np.maximum(hi, lo), lo)
        out = [runs(lo, whole)]
        run = np.flatnonzero(hi - lo > k)
        if len(run) and k > 0:
            all_of = np.arange(len(run))
            low, high, rank = (np.zeros((k, len(run)), np.int64) for _ in range(3))
            low[0], high[0] = lo[run], hi[run]
            rank[0] = self._rank(low[0], high[0])
            for i in range(k):
                m = rank[: i + 1].argmin(0)
                one = self.order[rank[m, all_of]]
                out.append((run, one))
                if i + 1 < k:
                    low[i + 1], high[i + 1] = one + 1, high[m, all_of]
                    high[m, all_of] = one
                    rank[i + 1], rank[m, all_of] = self._rank(low[i + 1], high[i + 1]), self._rank(low[m, all_of], one)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))
