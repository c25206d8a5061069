"""Chaining of ordered elements under rules: the best predecessor by type, distance, frame, splice class and group.

One kernel serves exons and any other ordered elements. Elements come in order of their left ends, and
what a chain has to remember of those that have passed is a ``ChainState``:

* an element that has a chain waits in a heap of each rule it may lead until its right end is far enough behind;
* then it enters the running maximum of its cell (what it leaves of a codon, its splice class), a queue
  of falling scores whose front is the best one; those that a rule's largest distance has left
  behind go from the front.

So each element is looked at once for each rule, and a state holds no more than what lies within the largest
distance (a rule without one keeps a single element for each cell). A state can be written out after any element and
go on elsewhere: ``linked`` streams each key's sorted elements through one, batch by batch, and ``chain_stream``
keeps it between micro-batches of a Structured Streaming query.

What an element takes is decided by its best predecessor alone: if that fails a test there is no second choice.
"""

from __future__ import annotations

import heapq
import pickle
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Types that connect others and have no bases of a codon of their own, and types that no splice site begins: fixed names.
INTRONS = ("Intron", "UTR_Intron", "UTR_5prime_Intron", "UTR_3prime_Intron")
UNSPLICED = ("Begin", "End", "Single")
#: What is left of a codon before a junction and taken after it, where both make a stop codon (codes of functions.dna): fixed values.
FORBIDDEN = {(1, 1), (2, 2), (3, 2), (3, 3)}
#: Least sum of splice scores and of exon scores over an intron of the minor kind, unless given: fixed values.
MINOR = (-1000.0, -1000.0)


@dataclass(frozen=True)
class Rule:
    """``down`` may follow ``up`` when left(down) - right(up) is from ``least`` to ``most``; a blocking rule needs equal groups."""

    up: frozenset[str]
    down: frozenset[str]
    least: int
    most: int | None = None
    block: bool = False


#: Columns of an element and their values where a table lacks them. ``left`` and ``right`` are its ends, ``kind`` its type
#: and strand, ``need`` and ``give`` the bases of a codon it takes from its neighbours, ``evidence`` is 1 for given elements
#: (a bound moves by one between a given and a found one), ``lclass`` and ``rclass`` are the splice classes of its ends (0: the
#: usual one), ``lscore`` and ``rscore`` their scores, ``lvalue`` and ``rvalue`` the codes of split codons.
COLUMNS: dict[str, object] = {"left": None, "right": None, "kind": None, "score": None, "need": 0, "give": 0, "grp": None, "evidence": 0, "lclass": 0, "rclass": 0, "lscore": 0.0, "rscore": 0.0, "lvalue": 0, "rvalue": 0}


class ChainState:
    """The open end of the chains over the elements that have passed."""

    def __init__(self, rules: list[Rule], minor: tuple[float, float] = MINOR):
        self.rules, self.minor = rules, minor
        self.passed, self.place = 0, None
        self.waiting: list[list[tuple]] = [[] for _ in rules]
        self.cells: list[dict[tuple[int, int], deque]] = [{} for _ in rules]
        self.best: tuple[float, int] | None = None  # score and number of the best chain's last element
        self.leads, self.follows = {}, {}
        for c, rule in enumerate(rules):
            for kinds, into in ((rule.up, self.leads), (rule.down, self.follows)):
                for kind in kinds:
                    into.setdefault(kind, []).append(c)

    def __getstate__(self) -> tuple:
        return self.passed, self.place, self.waiting, self.cells, self.best

    def pack(self) -> bytes:
        return pickle.dumps(self.__getstate__())

    @classmethod
    def unpack(cls, packed: bytes, rules: list[Rule], minor: tuple[float, float] = MINOR) -> ChainState:
        out = cls(rules, minor)
        out.passed, out.place, out.waiting, out.cells, out.best = pickle.loads(packed)
        return out

    def held(self) -> int:
        """Entries of the state."""
        return sum(map(len, self.waiting)) + sum(len(q) for cells in self.cells for q in cells.values())

    def _admit(self, c: int, upto: int) -> None:
        """Let the elements of rule ``c`` that end at ``upto`` or before into their cells."""
        heap, cells, bounded = self.waiting[c], self.cells[c], self.rules[c].most is not None
        while heap and heap[0][0] <= upto:
            _, _, p = heapq.heappop(heap)
            queue = cells.setdefault((p[3], p[4]), deque())
            if not bounded:
                if not queue or p[2] > queue[0][2]:
                    queue.clear()
                    queue.append(p)
                continue
            while queue and queue[-1][2] < p[2]:
                queue.pop()
            queue.append(p)

    def evict(self) -> None:
        """Drop what no later element can reach."""
        if self.place is None:
            return
        for c, rule in enumerate(self.rules):
            self._admit(c, self.place - rule.least)
            if rule.most is not None:
                for cell, queue in list(self.cells[c].items()):
                    while queue and queue[0][0] < self.place - rule.most:
                        queue.popleft()
                    if not queue:
                        del self.cells[c][cell]

    def feed(self, cols: dict[str, list]) -> tuple[list[float | None], list[int | None]]:
        """Chain score and number of the predecessor (None: none) of elements in order of ``left`` + ``evidence``; a kind that no rule names has neither."""
        totals, befores = [], []
        rules, cells, waiting, forbidden = self.rules, self.cells, self.waiting, FORBIDDEN
        for left, right, kind, score, need, give, group, given, lclass, rclass, lscore, rscore, lvalue, rvalue in zip(*(cols[c] for c in COLUMNS), strict=True):
            number, here = self.passed, left + given
            self.passed += 1
            if self.place is not None and here < self.place:
                raise ValueError(f"an element at {here} comes after one at {self.place}")
            self.place = here
            into, out = self.follows.get(kind), self.leads.get(kind)
            if into is None and out is None:
                totals.append(None)
                befores.append(None)
                continue
            total, before, forward = float(score), None, kind[-1:] != "-"
            name = kind[:-1]
            joins, empty, taken = name in INTRONS, right == left - 1, need
            minor = lclass != 0 and name not in UNSPLICED
            for c in into or ():
                rule = rules[c]
                if waiting[c] and waiting[c][0][0] <= here - rule.least:
                    self._admit(c, here - rule.least)
                queue = cells[c].get((need, lclass))
                if rule.most is not None:
                    while queue and queue[0][0] < here - rule.most:
                        queue.popleft()
                if not queue:
                    continue
                _, other, p_total, p_give, _, p_group, p_given, p_score, p_rscore, p_lvalue, p_rvalue, p_need = queue[0]
                if p_total + score <= total or (rule.block and p_group != group):
                    continue
                if minor and not (given or p_given or (p_rscore + lscore > self.minor[0] and p_score + score > self.minor[1])):
                    continue
                if joins or empty:
                    lvalue, rvalue = p_lvalue, p_rvalue
                    if empty and not joins:
                        taken, give = p_need, p_give
                elif ((p_rvalue, lvalue) if forward else (rvalue, p_lvalue)) in forbidden:
                    continue
                total, before = p_total + score, other
            totals.append(total)
            befores.append(before)
            if total > 0 and (self.best is None or total > self.best[0]) and not (joins and before is None):
                self.best = (total, number)
            if out and total > 0:
                p = (right + given, number, total, give, rclass, group, given, score, rscore, lvalue, rvalue, taken)
                for c in out:
                    heapq.heappush(waiting[c], (p[0], number, p))
        return totals, befores


def _columns(t: pa.RecordBatch | pa.Table) -> dict[str, list]:
    names = set(t.schema.names)
    return {c: t.column(c).to_pylist() if c in names else [default] * t.num_rows for c, default in COLUMNS.items()}


def best_chain(left: np.ndarray, right: np.ndarray, kind: list[str], score: np.ndarray, group: list[str | None], rules: list[Rule]) -> tuple[np.ndarray, np.ndarray]:
    """Chain score and predecessor (-1: none) of elements in order of their left ends."""
    rows = pa.table({"left": pa.array(left), "right": pa.array(right), "kind": kind, "score": pa.array(score), "grp": pa.array(group, pa.string())})
    total, before = ChainState(rules).feed(_columns(rows))
    own = np.asarray(score, float)
    return np.array([s if t is None else t for t, s in zip(total, own, strict=True)], float), np.array([-1 if b is None else b for b in before], np.int64)


def linked(elements: DataFrame, by: str, order: list[str], rules: list[Rule], minor: tuple[float, float] = MINOR) -> DataFrame:
    """``elements`` (by, left, right, kind, score and what else there is of COLUMNS) with nth, their number in the order of
    left + evidence and then ``order``, chain_score and before, the number of the predecessor.

    One shuffle by key; a task streams the sorted elements of a key through one state, so its memory doesn't grow with a key.
    """
    here = F.col("left") + (F.col("evidence") if "evidence" in elements.columns else F.lit(0))
    dealt = elements.repartition(by).withColumn("__here", here).sortWithinPartitions(by, "__here", *order).drop("__here")
    kinds = ", ".join(f"`{c}` {k}" for c, k in elements.dtypes)
    at = elements.columns.index(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, ChainState(rules, minor)
        for batch in batches:
            keys = batch.column(at).to_pylist()
            start = 0
            while start < len(keys):
                end = start
                while end < len(keys) and keys[end] == keys[start]:
                    end += 1
                if keys[start] != key:
                    key, state = keys[start], ChainState(rules, minor)
                part, first = batch.slice(start, end - start), state.passed
                total, before = state.feed(_columns(part))
                state.evict()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(range(first, state.passed), pa.int64()), pa.array(total, pa.float64()), pa.array(before, pa.int64())], [*part.schema.names, "nth", "chain_score", "before"])
                start = end

    return dealt.mapInArrow(run, f"{kinds}, nth long, chain_score double, before long")


def traced(rows: DataFrame, by: str) -> DataFrame:
    """The rows of ``linked`` that are on the best chain of their key: of equal chains the one that ends first, and none that is
    an intron alone. Rows stream backwards; what is remembered is the number of the next one."""
    end = ~((F.expr("substring(kind, 1, length(kind) - 1)").isin(*INTRONS)) & F.col("before").isNull()) & (F.col("chain_score") > 0)
    best = rows.where(end).groupBy(by).agg(F.max(F.struct("chain_score", (-F.col("nth")).alias("neg"))).alias("x")).select(by, (-F.col("x.neg")).alias("__last"))
    dealt = rows.join(best, by).where("nth <= __last").repartition(by).sortWithinPartitions(by, F.desc("nth"))
    names = rows.columns
    out = dealt.select(*names, "__last")
    at, nth, before = names.index(by), names.index("nth"), names.index("before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, wanted = None, None
        for batch in batches:
            keep = []
            for i, (k, n, b, last) in enumerate(zip(*(batch.column(c).to_pylist() for c in (at, nth, before, len(names))), strict=True)):
                if k != key:
                    key, wanted = k, last
                if n == wanted:
                    keep.append(i)
                    wanted = b
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names).take(pa.array(keep, pa.int64()))

    return out.mapInArrow(run, rows.schema)


def chained(elements: DataFrame, by: str, rules: list[Rule]) -> DataFrame:
    """Rows (by, ord, chain_score, before): ``elements`` (by, ord, left_end, right_end, kind, score, block_group) with the ``ord`` of each predecessor."""
    rows = elements.select(by, "ord", F.col("left_end").alias("left"), F.col("right_end").alias("right"), "kind", F.col("score").cast("double").alias("score"), F.col("block_group").alias("grp"))
    out = linked(rows, by, ["ord"], rules)
    prev = out.select(F.col(by).alias("__by"), F.col("nth").alias("__nth"), F.col("ord").alias("__ord"))
    got = out.join(prev, (F.col(by) == F.col("__by")) & (F.col("before") == F.col("__nth")), "left")
    return got.select(by, "ord", F.coalesce("chain_score", "score").alias("chain_score"), F.col("__ord").alias("before"))


def chain_stream(elements: DataFrame, by: str, rules: list[Rule], minor: tuple[float, float] = MINOR) -> DataFrame:
    """``linked`` over a stream: rows (by, ord, nth, chain_score, before) of elements (by, ord and COLUMNS) that arrive in micro-batches, each
    with the elements of the next fragments of some keys. The state of a key is its ChainState; one that arrives
    late, before what its key has already chained, is an error."""
    kinds = dict(elements.dtypes)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        chain = ChainState.unpack(state.get[0], rules, minor) if state.exists else ChainState(rules, minor)
        rows = pd.concat(list(frames))
        rows = rows.assign(__here=rows["left"] + (rows["evidence"] if "evidence" in rows else 0)).sort_values(["__here", "ord"], kind="stable")
        first = chain.passed
        total, before = chain.feed(_columns(pa.Table.from_pandas(rows.drop(columns="__here"), preserve_index=False)))
        chain.evict()
        state.update((chain.pack(),))
        yield pd.DataFrame({by: rows[by], "ord": rows["ord"], "nth": range(first, chain.passed), "chain_score": total, "before": pd.array(before, "Int64")})

    out = f"{by} {kinds[by]}, ord {kinds['ord']}, nth long, chain_score double, before long"
    return elements.groupBy(by).applyInPandasWithState(run, out, "chain binary", "append", "NoTimeout")
