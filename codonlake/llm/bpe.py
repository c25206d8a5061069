"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary resolves every pre-token that is one token.
Tier 2: the rest is merged by a heap of ranked pairs over a linked list of bytes.

Pre-tokens are found for a whole block of texts at once from the Unicode classes of its bytes, and
each distinct pre-token of a block is resolved once. The vocabulary is a file of fixed size whose
path is a parameter; the tables made from it are broadcast.

Edge cases: a null text counts as the empty one and gives no ids and the digests of no bytes.
Repeated rows give repeated results; an empty table gives an empty result; extra columns of the
input are carried only if asked for.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codonlake.llm.kernels import blocks, mix, span_hashes
from codonlake.llm.session import table, tune, whole_texts

_U = np.uint64
#: Merged pre-tokens that a Python worker remembers during a task, in each of two generations, and the longest of them in bytes.
REMEMBERED, LONGEST = 600_000, 64
LETTER, NUMBER, SPACE, OTHER = range(4)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ids; fails if ids aren't 0 to n-1."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    seen = set()
    for word, rank in pairs:
        tokens[int(rank)] = base64.b64decode(word)
        seen.add(int(rank))
    if seen != set(range(len(pairs))):
        raise ValueError(f"{path}: ids have gaps")
    return tokens


class PerfectHash:
    """Minimal perfect hash of 64-bit keys: hash and displace, single-key buckets store their slot."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        if len(np.unique(keys)) != n:
            raise ValueError("keys collide")
        self.n, self.buckets = n, max(1, n // 3)
        bucket = (keys % _U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(cuts)
        self.shift = np.zeros(self.buckets, np.int64)
        taken = np.zeros(n, bool)
        self.slot_key = np.zeros(n, np.int64)
        tries = np.arange(1, 257, dtype=_U)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[cuts[b] : cuts[b + 1]]
            if len(own) < 2:
                break
            base = _U(0)
            while True:
                slots = self._place(keys[own][None, :], (tries + base)[:, None])
                s = np.sort(slots, axis=1)
                ok = ~taken[slots].any(1) & (s[:, 1:] != s[:, :-1]).all(1)
                if ok.any():
                    k = int(np.argmax(ok))
                    self.shift[b] = int(base) + k + 1
                    taken[slots[k]] = True
                    self.slot_key[slots[k]] = own
                    break
                base += _U(256)
        free = iter(np.flatnonzero(~taken))
        for b in np.flatnonzero(sizes == 1):
            slot = next(free)
            self.shift[b] = -int(slot) - 1
            self.slot_key[slot] = order[cuts[b]]
        self.keys = keys[self.slot_key]

    def _place(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(keys ^ (shift * _U(0x9E3779B97F4A7C15))) % _U(self.n)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key among those it was made from, or -1."""
        d = self.shift[(keys % _U(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -d - 1, self._place(keys, np.maximum(d, 0).astype(_U)))
        return np.where(self.keys[slot] == keys, self.slot_key[slot], -1)


def _classes() -> np.ndarray:
    """Class of each code point, by the same Unicode tables as the pattern's own library."""
    import regex

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[points[m.start()] : points[m.end() - 1] + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def pretokens(buf: np.ndarray, offs: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte offsets at which pre-tokens start, by the rules of the GPT-2 pattern:
    contractions after an apostrophe, runs of letters, numbers or others with at most one blank
    before them, and white space, whose last character goes to what follows."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[buf]  # right for ASCII
    lead = np.flatnonzero(buf >= 0xC0)
    width = np.ones(len(lead), np.int64)
    if len(lead):
        b0 = buf[lead].astype(np.int64)
        width = np.minimum(1 + (b0 >= 0xC0) + (b0 >= 0xE0) + (b0 >= 0xF0), n - lead)
        point = np.where(b0 >= 0xF0, b0 & 7, np.where(b0 >= 0xE0, b0 & 15, b0 & 31))
        for t in (1, 2, 3):
            more = width > t
            point[more] = (point[more] << 6) | (buf[lead[more] + t] & 63)
        own = classes[np.minimum(point, 0x10FFFF)]
        for t in range(4):
            more = width > t
            kind[lead[more] + t] = own[more]
    head = (buf & 0xC0) != 0x80  # first bytes of characters
    text = np.zeros(n, bool)
    text[offs[:-1][offs[:-1] < offs[1:]]] = True
    turn = text.copy()
    turn[1:] |= kind[1:] != kind[:-1]
    start = turn.copy()
    blank = kind == SPACE
    ends = np.zeros(n, bool)  # last byte of a run
    ends[:-1] = turn[1:]
    ends[-1] = True
    final = np.zeros(n, bool)  # last byte of a text
    final[offs[1:][offs[:-1] < offs[1:]] - 1] = True
    stop = np.flatnonzero(blank & ends & ~final)  # runs of white space before something else
    at = stop.copy()
    while True:
        inner = ~head[at]
        if not inner.any():
            break
        at[inner] -= 1
    start[at] = True
    joined = at[buf[at] == 32]
    start[joined + 1] = False
    # contractions: an apostrophe that starts a pre-token
    quote = np.flatnonzero((buf == 39) & start)
    if len(quote):
        room = np.zeros((3, len(quote)), np.uint8)
        for t in (1, 2):
            ok = quote + t < n
            ok[ok] &= ~text[quote[ok] + t]
            if t == 2:
                ok &= room[1] > 0
            room[t, ok] = buf[quote[ok] + t]
        one = np.isin(room[1], np.frombuffer(b"stmd", np.uint8))
        a, b = room[1], room[2]
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, size in ((one, 2), (two & ~one, 3)):
            q = quote[hit]
            start[q + 1] = False
            after = q + size
            start[after[after < n]] = True
    return np.flatnonzero(start)


@dataclass
class Coder:
    """The tables of one vocabulary; small enough to be broadcast."""

    tokens: list[bytes]
    classes: np.ndarray = field(default_factory=_classes)

    def __post_init__(self) -> None:
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.perfect = PerfectHash(span_hashes(self.blob, self.at, self.at + self.size))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("ranks", "memory", "older")}

    def ready(self) -> Coder:
        if not hasattr(self, "ranks"):
            self.ranks = {t: i for i, t in enumerate(self.tokens)}
            self.memory: dict[bytes, bytes] = {}
            self.older: dict[bytes, bytes] = {}
        return self

    def texts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Ids, bytes and offsets of each block of texts. After the last one the worker gives back what it remembers:
        Spark keeps idle workers, several for a core, whose memory counts in the stages that follow."""
        try:
            for batch in batches:
                for a, b, buf, offs in blocks(batch):
                    yield batch.column(0).slice(a, b - a), buf, offs
        finally:
            self.memory, self.older = {}, {}
            pa.default_memory_pool().release_unused()

    def merge(self, piece: bytes) -> bytes:
        """Merge the pair of lowest rank, the leftmost first, until no neighbours form a token; the ids as 32-bit numbers."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # a part is known by its first byte; 0: merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, stop = pop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # a part of this pair is gone or has grown
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    push(heap, (r, i, end[stop]))
            k = before[i]
            if k >= 0 and (r := ranks.get(piece[k:stop])) is not None:
                push(heap, (r, k, stop))
        out, i = array("I"), 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out.tobytes()

    def recall(self, piece: bytes) -> bytes:
        """merge(), remembered for short pieces that came up lately."""
        got = self.memory.get(piece)
        if got is None:
            got = self.older.get(piece) or self.merge(piece)
            if len(piece) <= LONGEST:
                if len(self.memory) >= REMEMBERED:
                    self.memory, self.older = {}, self.memory
                self.memory[piece] = got
        return got

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, and the number of ids before each text (one more at the end)."""
        start = pretokens(buf, offs, self.classes)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        stop = np.append(start[1:], len(buf))
        _, first, place = np.unique(span_hashes(buf, start, stop), return_index=True, return_inverse=True)
        odd = np.flatnonzero(~equal_spans(buf, start, stop, buf, start[first][place], stop[first][place]))
        if len(odd):  # another pre-token of the same hash: each stands for itself
            place[odd] = len(first) + np.arange(len(odd))
            first = np.concatenate([first, odd])
        known = self.perfect.find(span_hashes(buf, start[first], stop[first]))
        raw = buf.tobytes()
        lo, hi = start[first].tolist(), stop[first].tolist()
        whole = known >= 0
        # the perfect hash knows 64 bits of a token; its bytes decide
        of = known[whole]
        whole[whole] = equal_spans(buf, start[first][whole], stop[first][whole], self.blob, self.at[of], self.at[of] + self.size[of])
        rest = np.flatnonzero(~whole)
        merged = [self.recall(raw[lo[x] : hi[x]]) for x in rest.tolist()]
        count = np.ones(len(known), np.int64)
        count[rest] = np.fromiter(map(len, merged), np.int64, len(merged)) // 4
        flat = np.empty(int(count.sum()), np.uint32)
        single = np.repeat(whole, count)
        flat[single] = known[whole]
        flat[~single] = np.frombuffer(b"".join(merged), np.uint32)
        ids = ragged(flat, np.concatenate([[0], np.cumsum(count)])[:-1][place], count[place])
        upto = np.concatenate([[0], np.cumsum(count[place])])
        return ids, upto[np.searchsorted(start, offs)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens."""
        return ragged(self.blob, self.at[ids], self.size[ids])


def equal_spans(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, b: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Which spans of ``a`` hold the same bytes as those of ``b``."""
    size = hi - lo
    same = size == to - from_
    look = np.flatnonzero(same & ((lo != from_) | (a is not b)) & (size > 0))
    off = ragged(a, lo[look], size[look]) != ragged(b, from_[look], size[look])
    if off.any():
        same[look] = ~np.logical_or.reduceat(off, np.cumsum(size[look]) - size[look])
    return same


def ragged(data: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Pieces of ``data`` one after another."""
    total = int(size.sum())
    if not total:
        return data[:0]
    ends = np.cumsum(size)
    return data[np.arange(total) + np.repeat(lo - (ends - size), size)]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean"


def coder(path: str) -> Coder:
    return Coder(read_ranks(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, ids array<int>) of every text of ``docs`` by the ranks in ``path``."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(coder(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.ready()
        for doc_ids, buf, offs in own.texts(batches):
            ids, upto = own.encode(buf, offs)
            lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.record_batch([doc_ids, lists], ["doc_id", "ids"])

    return whole_texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, decoded binary) of rows (doc_id, ids); a null list gives null."""
    tune(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(coder(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = [None if x is None else own.decode(np.array(x, np.int64)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text and return counts and digests; ids never leave their task."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(coder(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.ready()
        for doc_ids, buf, offs in own.texts(batches):
            ids, upto = own.encode(buf, offs)
            decoded = own.decode(ids)
            after = np.concatenate([[0], np.cumsum(own.size[ids])])[upto]
            little, raw, back = ids.astype("<u4"), memoryview(buf), memoryview(decoded)
            rows = range(len(doc_ids))
            digests = [hashlib.sha256(little[upto[k] : upto[k + 1]]).hexdigest() for k in rows]
            texts = [hashlib.sha256(back[after[k] : after[k + 1]]).hexdigest() for k in rows]
            same = [bool(back[after[k] : after[k + 1]] == raw[offs[k] : offs[k + 1]]) for k in rows]
            yield pa.record_batch(
                [doc_ids, pa.array(np.diff(upto), pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(same, pa.bool_())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"],
            )

    return whole_texts(docs).mapInArrow(run, SCHEMA)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary())
