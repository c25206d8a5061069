"""Substring dedup with compact windows.

A text is the sequence of its five-word shingles. For each of FUNCTIONS hash functions, the
subsequences of at least LEAST shingles (50 words) that share their min-hash position form compact
windows (l, c, r): the node c of the Cartesian tree over the hashes and the span of its subtree.
Only positions that are the minimum of some LEAST neighbours have one, and those suffice to build
the tree, so a text gives about 2 n / LEAST windows for each function. A passage that two texts
share has the same min-hash in both, so its windows meet in one group for every function; groups of
one document go. What stays is searched in three steps:

1. Any LEAST shingles around c hold the 23 that begin, or the 24 that end, at c. Windows that agree
   in one of these contexts, too, join the first of them (smallest doc_id, then place).
2. Windows that no passage found explains, though others share their context, are taken apart into
   their subsequences of LEAST shingles; equal ones join the first. Word for word, no passage of 50
   words that an earlier document holds is left after that, whatever stands around its parts elsewhere.
3. Of the windows that are still unexplained, two of a document under different functions whose
   spans, laid over one another, hold LEAST shingles and both minima form a couple: an interval join
   of windows that agree in enough hashes. Equal couples join the first, and so do documents whose
   single windows have a first occurrence in common under AGREE keys, wherever these lie. So passages
   with changed words meet that have no context in common.

Texts that are equal as a whole (but for A-Z and a-z) point to the first of them and take no part in
the steps. Documents and first occurrences that met are verified on their words: the maximal segments in which
eight of nine shingles match are taken, and a segment counts when it has LEAST shingles and its
Jaccard similarity with the matching part of the first document is at least SIMILAR. The first
occurrence stays; repeats within one document are not looked at.

Every text that a group joins is its first one, so work grows with the windows, not with pairs. Keys
that a part of the documents (1 in SAMPLED) shows to be common are dealt out by document; that only
places rows.

Edge cases: null and empty texts and those under 50 words have no windows; rows of one doc_id are
one document (windows of all its texts count, passages are verified on one of them); rows with a null
id are left out; equal texts all point to the one of the smallest id; empty tables give empty
results; extra columns are kept by without_repeats() and ignored otherwise.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codonlake.llm.kernels import LOWER, SPACED, blocks, mix, ngrams, sliding_min, span_hashes, words
from codonlake.llm.segments import maximal_segments
from codonlake.llm.session import discard, sieve, stash, table, tune, whole_texts

_U = np.uint64
SHINGLE, LEAST, FUNCTIONS, AGREE, SIMILAR = 5, 46, 4, 2, 0.8
#: Spans of first occurrences are widened to multiples of this, so that many documents ask for the same ones.
STEP = 64
#: Gaps of this many shingles can lie within a passage whose parts are too short to count alone.
BRIDGE = 2 * LEAST // 8
#: One in so many documents is looked at for common keys; windows that a key that isn't one may have; keys dealt out, at most.
SAMPLED, GROUP, COMMON = 64, 2000, 10_000
#: In larger tables a key may have one in so many windows, but not more than a task holds with ease.
SHARE, HELD = 2500, 200_000
#: Rows of windows, at least, that are looked at together (a key isn't cut); bit of windows whose key is dealt out.
CHUNK, DEALT = 1 << 16, 1 << 62
_SALTS = [_U(0x9E3779B97F4A7C15 * (2 * f + 1) & (2**64 - 1)) for f in range(16)]
_ODD = _U(0xD1342543DE82EF95)
SPANS = "__repeated_spans"


def smaller_neighbours(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the nearest one before it that is no larger (-1: none) and the next one that is smaller (len: none).

    Those are the edges of its subtree in the Cartesian tree. All pointers jump at once along what is
    known so far, so chains shorten by half in each round.
    """
    n = len(x)
    left, right, todo = np.arange(-1, n - 1), np.arange(1, n + 1), np.arange(n)
    while len(todo):
        todo = todo[left[todo] >= 0]
        todo = todo[x[left[todo]] > x[todo]]
        left[todo] = left[left[todo]]
    todo = np.arange(n)
    while len(todo):
        todo = todo[right[todo] < n]
        todo = todo[x[right[todo]] >= x[todo]]
        right[todo] = right[right[todo]]
    return left, right


def compact_windows(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows of at least ``least`` positions; of equal values the first is the minimum.

    They are the nodes of the Cartesian tree whose subtree is that wide. Only positions that are the
    minimum of some window can be such a node, and what is next smaller to one of them is one itself.
    """
    n = len(x)
    if n < least:
        z = np.zeros(0, np.int64)
        return z, z, z
    low = sliding_min(x, least)
    # a position is the minimum of a window that holds it if the largest of the minima around it is its own value
    pad = np.concatenate([np.zeros(least - 1, x.dtype), low, np.zeros(least - 1, x.dtype)])
    at = np.flatnonzero(~sliding_min(~pad, least) == x)
    left, right = smaller_neighbours(x[at])
    lo = np.where(left >= 0, at[left] + 1, 0)
    hi = np.where(right < len(at), at[np.minimum(right, len(at) - 1)] - 1, n - 1)
    wide = hi - lo + 1 >= least
    return lo[wide], at[wide], hi[wide]


def _shingles(buf: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """The shingle hashes of each text in order."""
    starts, ends, first = words(LOWER[buf], offs, SPACED)
    g = ngrams(span_hashes(LOWER[buf], starts, ends), SHINGLE)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield g[a : max(a, b - SHINGLE + 1)]


def block_shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, whether they belong to one text, index of each text's first) of all runs of SHINGLE words of a block."""
    starts, ends, first = words(LOWER[buf], offs, SPACED)
    g = ngrams(span_hashes(LOWER[buf], starts, ends), SHINGLE)
    own = np.ones(len(g), bool)
    for t in range(1, SHINGLE):  # runs that begin in a text's last words go on in the next text
        end = first[1:] - t
        own[end[(end >= first[:-1]) & (end < len(g))]] = False
    return g, own, first


def doubled(g: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` neighbours, k a power of two, by doubling."""
    have = 1
    while have < k:
        g = mix(g[: max(0, len(g) - have)] * _ODD + g[have:])
        have *= 2
    return g


def _picked(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    return h[np.clip(at, 0, len(h) - 1)]


def contexts(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit hashes of the 23 shingles from c on and the 24 up to c, of doubled(shingles, 16); of no meaning where the text is too short."""
    ahead = mix(_picked(h, c) * _ODD + _picked(h, c + 7))
    back = mix(_picked(h, c - 23) * _ODD + _picked(h, c - 15))
    return (ahead >> _U(48)).astype(np.int64), (back >> _U(48)).astype(np.int64)


def windows(docs: DataFrame, common: np.ndarray | None = None) -> DataFrame:
    """Rows (key, doc, at, near): the key stands for hash function and value, ``at`` packs c with c - l and r - c (45 at most,
    more than that never matters to LEAST shingles around c), ``near`` the two contexts. Keys of ``common`` carry the bit
    DEALT in ``at``."""
    shared = docs.sparkSession.sparkContext.broadcast(common) if common is not None and len(common) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value if shared is not None else None
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, buf, offs in blocks(batch):
                g, own, first = block_shingles(buf, offs)
                if len(g) < LEAST:
                    continue
                h, out = doubled(g, 16), []
                for salt in _SALTS[:FUNCTIONS]:
                    # what isn't a shingle is smaller than all of them, so no window reaches over it
                    x = np.where(own, np.maximum(mix(g ^ salt), _U(1)), _U(0))
                    lo, c, hi = compact_windows(x, LEAST)
                    real = own[c]
                    lo, c, hi = lo[real], c[real], hi[real]
                    text = np.searchsorted(first, c, "right") - 1
                    ahead, back = contexts(h, c)
                    at = ((c - first[text]) << 12) | (np.minimum(c - lo, LEAST - 1) << 6) | np.minimum(hi - c, LEAST - 1)
                    out.append((x[c].view(np.int64), ids[a + text], at, (ahead << 16) | back))
                if any(len(o[0]) for o in out):
                    key, doc, at, near = (np.concatenate(v) for v in zip(*out, strict=True))
                    if keys is not None:
                        at[keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key] |= DEALT
                    yield pa.record_batch([pa.array(key), pa.array(doc, pa.int64()), pa.array(at), pa.array(near)], ["key", "doc", "at", "near"])

    return docs.mapInArrow(run, "key long, doc long, at long, near long")


def _joined(group: np.ndarray, bits: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a context (group, bits): whether it is of several documents, and doc and at of the first of them."""
    if not len(group):
        return np.zeros(0, bool), doc, at
    same = (group << 16) | bits
    order = np.argsort(same, kind="stable")
    same, d, a = same[order], doc[order], at[order]
    lead = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    each = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(same))))
    head = np.minimum.reduceat(d, lead)
    several = head != np.maximum.reduceat(d, lead)
    place = np.minimum.reduceat(np.where(d == head[each], a, np.iinfo(np.int64).max), lead)
    back = np.empty(len(order), np.int64)
    back[order] = each
    return several[back], head[back], place[back]


def _overlap(at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Shingles that the spans of two windows have in common when laid over one another."""
    return np.minimum((at >> 6) & 63, (of >> 6) & 63) + np.minimum(at & 63, of & 63) + 1


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What several documents share, from the rows of windows() in the order of their keys; see grouped()."""

    def whole(key: np.ndarray, doc: np.ndarray, at: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
        lead = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        each = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(key))))
        several = np.minimum.reduceat(doc, lead) != np.maximum.reduceat(doc, lead)
        keep = several[each] | (at >= DEALT)
        each, key, doc, at, near = each[keep], key[keep], doc[keep], at[keep], near[keep]
        dealt, at = at >= DEALT, at & (DEALT - 1)
        shared, met = np.where(dealt, 4, 0), []
        for side, fits, bits in ((1, (at & 63) >= 22, near >> 16), (2, ((at >> 6) & 63) >= 23, near & 0xFFFF)):
            shared[fits & dealt] |= side
            rows = np.flatnonzero(fits & ~dealt)
            more, head, place = _joined(each[rows], bits[rows], doc[rows], at[rows])
            shared[rows[more]] |= side
            has, of_doc, of_at = np.zeros(len(key), bool), np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            has[rows] = more & (doc[rows] != head) & (_overlap(at[rows], place) >= LEAST)
            of_doc[rows], of_at[rows] = head, place
            met.append((has, of_doc, of_at))
        (has, of_doc, of_at), (too, too_doc, too_at) = met
        too = too & ~(has & (of_doc == too_doc) & (of_at == too_at))
        heads = [pa.array(v, mask=~h) for h, *both in ((has, of_doc, of_at), (too, too_doc, too_at)) for v in both]
        return pa.record_batch([pa.array(v) for v in (key, doc, at, near, shared.astype(np.int32))] + heads, ["key", "doc", "at", "near", "shared", "of_doc", "of_at", "too_doc", "too_at"])

    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
        if n < CHUNK:
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        end = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on
        if end:
            yield whole(*(c[:end] for c in cols))
        held, n = [[c[end:] for c in cols]], 0
    if held:
        yield whole(*(np.concatenate(c) for c in zip(*held, strict=True)))


def grouped(rows: DataFrame) -> DataFrame:
    """Rows (key, doc, at, near, shared, of_doc, of_at, too_doc, too_at): the windows whose key several documents have.

    Rows of a key lie together but for those of common keys, which are dealt by document. ``shared``: 1 if several
    documents have the context ahead, 2 the one behind, 4 if the key is a common one; then all its rows stay, and its
    contexts count as shared and have no heads here. ``of`` and ``too`` are the first
    occurrences that it joins by a context in another document (null: none, or the same one).
    """
    out = "key long, doc long, at long, near long, shared int, of_doc long, of_at long, too_doc long, too_at long"
    dealt = rows.repartition(F.when(F.col("at") >= DEALT, F.col("doc")).otherwise(F.col("key")))
    return dealt.sortWithinPartitions("key").mapInArrow(_grouped, out)


def copies(docs: DataFrame) -> DataFrame:
    """(doc, head, n): documents of n words, as many as a passage has at least, whose only text an earlier one has letter for
    letter, and the first of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in blocks(batch):
                low = LOWER[buf]
                _, _, first = words(low, offs, SPACED)
                raw = memoryview(low)
                texts = [hashlib.blake2b(raw[offs[i] : offs[i + 1]], digest_size=16).digest() for i in range(b - a)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(np.diff(first), pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "n", "print"])

    prints = stash(docs.mapInArrow(run, "doc_id long, n long, print binary"), "prints", scan=True)
    one = prints.groupBy(F.col("doc_id").alias("doc")).agg(F.min("print").alias("print"), F.max("print").alias("other"), F.min("n").alias("n")).where((F.col("print") == F.col("other")) & (F.col("n") >= LEAST + SHINGLE - 1))
    first = one.groupBy("print").agg(F.min("doc").alias("head"), F.count("*").alias("times")).where("times > 1").select("print", "head")
    out = stash(one.join(first, "print").where("doc != head").select("doc", "head", "n"), "copies")
    discard(prints)
    return out


def common_keys(docs: DataFrame, known: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys that many documents have but for the ``known`` (doc_id), sorted, and about how many windows have each; COMMON keys
    at most."""
    some = docs.where(F.pmod(F.xxhash64(F.lit("common"), "doc_id"), F.lit(SAMPLED)) == 0)
    if known is not None:
        some = some.join(known, "doc_id", "left_anti")
    counts = stash(windows(some).groupBy("key").agg(F.count("*").alias("n")), "counts")
    least = max(GROUP, min(HELD, (counts.agg(F.sum("n")).first()[0] or 0) * SAMPLED // SHARE))
    n = counts.where(F.col("n") * SAMPLED >= least).orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    discard(counts)
    keys, n = n.column(0).to_numpy(), n.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], (n * SAMPLED)[order]


def slices(docs: DataFrame) -> DataFrame:
    """(doc_id, lo, hi, body) for each span (lo, hi) of the column ``spans``: the words of shingles lo to hi - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            for a, b, buf, offs in blocks(batch):
                ids, lo, hi, out = [], [], [], []
                starts, ends, first = words(buf, offs, SPACED)
                for i in range(b - a):
                    p, q = int(first[i]), int(first[i + 1])
                    for s in spans[a + i].as_py():
                        u, v = p + max(0, s["lo"]), min(q, p + s["hi"] + SHINGLE - 1)
                        ids.append(batch.column(0)[a + i].as_py())
                        lo.append(s["lo"])
                        hi.append(s["hi"])
                        out.append(buf[starts[u] : ends[v - 1]].tobytes().decode() if u < v else "")
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(out, pa.string())], ["doc_id", "lo", "hi", "body"])

    return docs.mapInArrow(run, "doc_id long, lo long, hi long, body string")


def runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of runs of hits."""
    pad = np.zeros(len(hit) + 2, bool)
    pad[1:-1] = hit
    edge = (pad[1:] != pad[:-1]).nonzero()[0]
    return edge[::2], edge[1::2] - 1


def dense(hit: np.ndarray) -> list[tuple[int, int, float]]:
    """Segments (first, last, score) in which at least eight of nine positions are hits: sequences of one length that
    share 8/9 of their shingles have a Jaccard similarity of 0.8. Those that are so dense from either end, and over
    gaps of up to BRIDGE positions those of LEAST positions that are so as a whole (one changed word in 50)."""
    lo, hi = runs(hit)
    out = maximal_segments(lo.tolist(), hi.tolist(), (hi - lo + 1).tolist(), 8.0)
    wide = []
    for chain in np.split(np.arange(len(lo)), np.flatnonzero(lo[1:] - hi[:-1] - 1 > BRIDGE) + 1):
        if len(chain) < 2 or hi[chain[-1]] - lo[chain[0]] + 1 < LEAST:
            continue
        u, v = lo[chain], hi[chain]
        hits = np.cumsum(v - u + 1)
        score = hits - 8 * (v - u[0] + 1 - hits)
        before = score - (v - u + 1)
        # the last run that ends no lower than this one begins
        most = np.maximum.accumulate(score[::-1])  # the largest score of the last 1, 2, ... runs
        far = len(chain) - 1 - np.searchsorted(most, before)
        end = -1
        for i, j in enumerate(far.tolist()):
            if j > max(i, end) and v[j] - u[i] + 1 >= LEAST:
                wide.append((int(u[i]), int(v[j]), float(score[j] - before[i])))
                end = j
    return sorted([z for z in out if not any(p <= z[0] and z[1] <= q for p, q, _ in wide)] + wide) if wide else out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in ``ordered``, of one at least."""
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _placed(part: np.ndarray, first: np.ndarray, at: int) -> tuple[int, float] | None:
    """Start of the part of ``first`` near ``at`` that is most like ``part``, and their Jaccard similarity."""
    u, v = max(0, at - LEAST), min(len(first), at + len(part) + LEAST)
    mine, best = _distinct(part), None
    for lo, hi, _ in dense(_among(first[u:v], mine)):
        if hi - lo + 1 < SIMILAR * len(mine):
            continue
        theirs = _distinct(first[u + lo : u + hi + 1])
        both = int(np.count_nonzero(_among(theirs, mine)))
        like = both / (len(mine) + len(theirs) - both)
        if best is None or like > best[1]:
            best = u + lo, like
    return best


def repeated(own: np.ndarray, first: np.ndarray, frames: np.ndarray, ordered: np.ndarray | None = None) -> list[tuple[int, int, int, float]]:
    """(first shingle, last shingle, first shingle in the other text, similarity) of what ``own`` repeats of ``first``,
    near the frames (rows of starts, ends and shifts); ``ordered`` are the shingles of ``first`` in order."""
    ordered = np.sort(first) if ordered is None else ordered
    begin, end, shifts = frames
    # what is the same word for word along a frame's shift
    same, more = [], np.ones(len(own), bool)
    for shift in np.unique(shifts).tolist():
        i, j = max(0, shift), min(len(own), len(first) + shift)
        if i >= j:
            continue
        lo, hi = runs(own[i:j] == first[i - shift : j - shift])
        for k in (hi - lo >= LEAST - 1).nonzero()[0].tolist():
            p, q = int(lo[k]) + i, int(hi[k]) + i
            same.append((p, q, p - shift, 1.0))
            more[p : q + 1] = False
    order = np.argsort(begin, kind="stable")
    start = np.maximum(0, begin[order] - LEAST)
    stop = np.maximum.accumulate(np.minimum(len(own) - 1, end[order] + LEAST))
    new = np.flatnonzero(start[1:] > stop[:-1] + 1) + 1
    out = []
    for a, b in zip(start[[0, *new]].tolist(), stop[[*(new - 1), -1]].tolist(), strict=True):
        x = own[a : b + 1]
        hit = _among(x, ordered)
        if not (hit & more[a : b + 1]).any():
            continue  # nothing is shared but what is the same word for word
        for p, q, _ in dense(hit):
            if q - p + 1 < LEAST:
                continue
            # where it lies in the first text: by the shift of the frames on it
            on = np.sort(shifts[(begin <= a + q) & (end >= a + p)])
            shift = int(on[len(on) // 2]) if len(on) else 0
            got = _placed(x[p : q + 1], first, a + p - shift)
            if got is not None and got[1] >= SIMILAR:
                out.append((a + p, a + q, *got))
    return out + [(p, q, c, s) for p, q, c, s in same if not any(u <= p and q <= v for u, v, _, _ in out)]


def _each(bodies: pa.Array) -> list[np.ndarray]:
    batch = pa.record_batch([bodies.cast(pa.large_string())], ["text"])
    return [x for _, _, buf, offs in blocks(batch) for x in _shingles(buf, offs)]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "first_word", "last_word", "of_doc_id", "of_first_word", "similarity"]
    for t in batches:
        rows = []
        doc, head, lo, first_lo = (t.column(i).to_numpy() for i in range(4))
        # rows of one first occurrence follow one another: its shingles are made once
        lead = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (first_lo[1:] != first_lo[:-1])])) if len(head) else np.zeros(0, np.int64)
        theirs = _each(t.column(6).take(pa.array(lead)))
        ordered = [np.sort(x) for x in theirs]
        of = np.searchsorted(lead, np.arange(len(head)), "right") - 1
        edges, inner = t.column(4).offsets.to_numpy().tolist(), t.column(4).values
        laid = np.stack([inner.field(k).to_numpy() for k in range(3)])
        for i, own in enumerate(_each(t.column(5))):
            u, v = max(0, int(lo[i])), max(0, int(first_lo[i]))
            frames = laid[:, edges[i] : edges[i + 1]] - np.array([[u], [u], [u - v]])
            if len(own) and len(theirs[of[i]]):
                rows += [(int(doc[i]), a + u, b + u + SHINGLE - 1, int(head[i]), c + v, s) for a, b, c, s in repeated(own, theirs[of[i]], frames, ordered[of[i]])]
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        yield pa.record_batch([pa.array(v, k) for v, k in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64()], strict=True)], names)


def _place(x: Column) -> Column:
    return F.shiftright(x, 12)


def _before(x: Column) -> Column:
    return F.shiftright(x, 6).bitwiseAND(63)


def _after(x: Column) -> Column:
    return x.bitwiseAND(63)


def _frame(at: Column, of: Column) -> Column:
    """Struct (a, b, shift): the spans of two windows laid over one another, by the first one's places."""
    left, right = F.least(_before(at), _before(of)), F.least(_after(at), _after(of))
    return F.struct((_place(at) - left).alias("a"), (_place(at) + right).alias("b"), (_place(at) - _place(of)).alias("shift"))


def _framed(at: Column, head: Column, of: Column) -> Column:
    """_frame() with the document of the other window."""
    frame = _frame(at, of)
    return F.struct(head.alias("head"), *(frame.getField(k).alias(k) for k in ("a", "b", "shift")))


def _wide(frame: str) -> Column:
    return F.col(frame + ".b") - F.col(frame + ".a") + 1 >= LEAST


def _heads(rows: DataFrame, *places: str) -> DataFrame:
    """(key, head: struct of doc and ``places`` of the first row, times) of the keys of more than one document."""
    return rows.groupBy("key").agg(F.min(F.struct("doc", *places)).alias("head"), F.max("doc").alias("end"), F.count("*").alias("times")).where("head.doc != end").drop("end")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (key, doc, at) of windows by key and context; a window has the contexts that lie within its span and are shared."""
    near = lambda side, bits: F.struct(F.lit(side).alias("side"), bits.alias("bits"))
    sides = F.array(
        F.when(F.col("shared").bitwiseAND(1) > 0, near(0, F.shiftright("near", 16))),
        F.when(F.col("shared").bitwiseAND(2) > 0, near(1, F.col("near").bitwiseAND(0xFFFF))),
    )
    each = rows.select("key", "doc", "at", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("x"))
    return each.select(F.xxhash64("key", "x.side", "x.bits").alias("key"), "doc", "at")


def _beside(rows: DataFrame, *places: str) -> DataFrame:
    """The rows whose key several documents have, with its first occurrence (head).

    The first occurrences of common keys (COMMON of them at most) are broadcast, so the rows of such a key stay where they are.
    """
    heads = stash(_heads(rows, *places), "heads")
    most = max(GROUP, (heads.agg(F.sum("times")).first()[0] or 0) // COMMON)
    hot = heads.where(F.col("times") > most)
    if hot.isEmpty():
        return rows.join(heads, "key")
    hot, cold = F.broadcast(hot), heads.where(F.col("times") <= most)
    return rows.join(hot, "key").unionByName(rows.join(hot.select("key"), "key", "left_anti").join(cold, "key"))


def _met(both: DataFrame, frames: list[Column]) -> DataFrame:
    """Rows (key, doc, head, frame): windows of a key and its first occurrence in another document, from _beside()."""
    both = both.where("doc != head.doc")
    return both.select("key", "doc", F.col("head.doc").alias("first"), F.explode(F.array(*frames)).alias("frame")).withColumnRenamed("first", "head")


def _positions(docs: DataFrame, rest: DataFrame) -> DataFrame:
    """Rows (key, doc, at): the subsequences of LEAST shingles around the windows ``rest`` (doc, at) within their spans."""
    need = stash(rest.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("at").alias("ats")), "need")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, buf, offs in blocks(batch):
                for i, g in enumerate(_shingles(buf, offs)):
                    at = np.array(batch.column(2)[a + i].as_py(), np.int64)
                    c = at >> 12
                    lo, hi = np.maximum(c - ((at >> 6) & 63), c - LEAST + 1), np.minimum(c, c + (at & 63) - LEAST + 1)
                    mark = np.zeros(len(g) + 1, np.int64)
                    ok = (lo <= hi) & (lo >= 0) & (hi + LEAST <= len(g))
                    np.add.at(mark, lo[ok], 1)
                    np.add.at(mark, hi[ok] + 1, -1)
                    start = np.flatnonzero(np.cumsum(mark) > 0)
                    h = doubled(g, 32)
                    key = mix(h[start] * _ODD + h[start + LEAST - 32]).view(np.int64) if len(start) else start
                    yield pa.record_batch([pa.array(key, pa.int64()), pa.array(np.full(len(start), batch.column(0)[a + i].as_py()), pa.int64()), pa.array(start, pa.int64())], ["key", "doc", "at"])

    texts = sieve(docs, need, "doc_id").join(need, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "ats")
    return texts.mapInArrow(run, "key long, doc long, at long")


def couples(rest: DataFrame) -> DataFrame:
    """Rows (key, doc, at, by) for two windows of a document under different functions whose spans, laid over one another,
    hold LEAST shingles and both minima: a passage of which both are the minimum makes the same couple in every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends, inner = lists.offsets.to_numpy().tolist(), lists.values
            keys, ats, docs = inner.field(0).to_numpy(), inner.field(1).to_numpy(), batch.column(0).to_numpy()
            # each document has places of its own, so all are looked at together
            of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            key, at = keys[ends[0] : ends[-1]], ats[ends[0] : ends[-1]]
            order = np.lexsort((at, of))
            key, at, of = key[order], at[order], of[order]
            c = (of << 40) + (at >> 12)
            lo, hi = c - ((at >> 6) & 63), c + (at & 63)
            u, v = np.searchsorted(c, lo), np.searchsorted(c, hi, "right")
            for p in range(0, len(c), 4096):
                n = (v - u)[p : p + 4096]
                x = np.repeat(np.arange(p, p + len(n)), n)
                y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(u[p : p + 4096], n)
                keep = (key[x] < key[y]) & (lo[y] <= c[x]) & (c[x] <= hi[y]) & (np.minimum(hi[x], hi[y]) - np.maximum(lo[x], lo[y]) + 1 >= LEAST)
                x, y = x[keep], y[keep]
                both = mix(mix(key[x].view(_U)) ^ key[y].view(_U)).view(np.int64)
                yield pa.record_batch([pa.array(k, pa.int64()) for k in (both, docs[of[x]], at[x], at[y])], ["key", "doc", "at", "by"])

    return rest.groupBy("doc").agg(F.collect_set(F.struct("key", "at")).alias("all")).mapInArrow(run, "key long, doc long, at long, by long")


def _verify(docs: DataFrame, met: DataFrame, name: str) -> DataFrame:
    """What documents repeat of first occurrences; rows (doc, head, frame)."""
    grouped = met.groupBy("doc", "head").agg(F.collect_set("frame").alias("frames"))
    spread = F.col("frames")
    lo, hi = F.array_min(spread.getField("a")), F.array_max(spread.getField("b"))
    back = F.transform(spread, lambda f: f["a"] - f["shift"]), F.transform(spread, lambda f: f["b"] - f["shift"])
    pairs = stash(
        grouped.select(
            "doc",
            "head",
            "frames",
            (lo - LEAST).alias("lo"),
            (hi + LEAST + 1).alias("hi"),
            (F.floor((F.array_min(back[0]) - 2 * LEAST) / STEP) * STEP).alias("first_lo"),
            (F.ceil((F.array_max(back[1]) + 2 * LEAST) / STEP) * STEP).alias("first_hi"),
        ),
        "pairs",
    )
    # the spans of one document: those of its own frames, and of first occurrences as many as their length allows
    asked = pairs.select(F.explode(F.array(F.struct(F.col("doc").alias("doc_id"), "lo", "hi"), F.struct(F.col("head").alias("doc_id"), F.col("first_lo").alias("lo"), F.col("first_hi").alias("hi")))).alias("x")).select("x.*").distinct()
    need = stash(asked.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "need")
    texts = sieve(docs, need, "doc_id").join(need, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "spans")
    cut = stash(slices(texts), "slices")
    discard(need)
    own, first = ([F.col("doc_id").alias(k), F.col("lo").alias(a), F.col("hi").alias(b), F.col("body").alias(s)] for k, a, b, s in (("doc", "lo", "hi", "own"), ("head", "first_lo", "first_hi", "first")))
    full = (
        pairs.join(cut.select(*own), ["doc", "lo", "hi"])
        .join(cut.select(*first), ["head", "first_lo", "first_hi"])
        .select("doc", "head", "lo", "first_lo", "frames", "own", "first")
    )
    out = stash(full.mapInArrow(_verified, "doc_id long, first_word int, last_word int, of_doc_id long, of_first_word int, similarity double"), name)
    for done in (pairs, cut):
        discard(done)
    return out


def _unsettled(rest: DataFrame, found: DataFrame, *ats: str) -> DataFrame:
    """The rows of ``rest`` none of whose shingles ``ats`` is in a passage of ``found``."""
    # passages of a document overlap (one for each first text): laid together they are few
    own = found.select(F.col("doc_id").alias("doc"), F.col("first_word").alias("p"), (F.col("last_word") - (SHINGLE - 1)).alias("q")).distinct()
    order = W.partitionBy("doc").orderBy("p", "q")
    starts = F.coalesce(F.col("p") > F.max("q").over(order.rowsBetween(W.unboundedPreceding, -1)) + 1, F.lit(True))
    islands = own.withColumn("new", starts.cast("int")).withColumn("part", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    laid = islands.groupBy("doc", "part").agg(F.min("p").alias("p"), F.max("q").alias("q"))
    spans = laid.groupBy("doc").agg(F.collect_list(F.struct("p", "q")).alias("spans"))
    inside = F.exists("spans", lambda s: functools.reduce(Column.__or__, [(s["p"] <= _place(F.col(c))) & (_place(F.col(c)) <= s["q"]) for c in ats]))
    return rest.join(spans, "doc", "left").where(~F.coalesce(inside, F.lit(False))).drop("spans")


def repeats(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, first_word, last_word, of_doc_id, of_first_word, similarity): passages that a document of a smaller id has, too."""
    tune(docs.sparkSession)
    docs = whole_texts(docs).where(F.col("doc_id").isNotNull())
    # texts that are the same as a whole are known by their hash; only the first of them is searched
    same = copies(docs)
    known = same.select(F.col("doc").alias("doc_id"))
    common, _ = common_keys(docs, known)
    once = sieve(docs, same, "doc", rest=True).unionByName(sieve(docs, same, "doc").join(known, "doc_id", "left_anti"))
    rows = stash(grouped(windows(once, common)), "rows")
    at, of = F.col("at"), F.col("head.at")
    one, two = (_framed(at, F.col(k + "_doc"), F.col(k + "_at")) for k in ("of", "too"))
    ones = F.when(F.col("too_doc").isNull(), F.array(one)).when(F.col("of_doc").isNull(), F.array(two)).otherwise(F.array(one, two))
    met = rows.where("of_doc is not null or too_doc is not null").select("doc", ones.alias("met"))
    dealt = None
    if len(common):
        # a document's windows of a common context meet its head at once
        dealt = stash(_shared(rows.where("shared >= 4")).groupBy("key", "doc").agg(F.min("at").alias("at"), F.collect_list("at").alias("ats")), "dealt")
        many = F.transform("ats", lambda x: _framed(x, F.col("head.doc"), of))
        met = met.unionByName(_beside(dealt, "at").where("doc != head.doc").select("doc", F.filter(many, lambda x: x["b"] - x["a"] + 1 >= LEAST).alias("met")))
    met = met.select("doc", F.explode("met").alias("x")).select("doc", "x.head", F.struct("x.a", "x.b", "x.shift").alias("frame"))
    # ids of copies are in no row, so the texts need no sieve for them from here on
    found = [_verify(docs, met, "found")]
    discard(dealt)
    left = stash(_unsettled(rows.select("key", "doc", "at", "near", "shared"), found[0], "at"), "left")
    discard(rows)
    # contexts that several unexplained documents share, word for word
    rest = _shared(left.where("(shared & 3) > 0"))
    several = rest.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first != last").select("key")
    rest = stash(rest.join(several, "key", "left_semi").select("doc", "at").distinct(), "rest")
    exact = stash(_positions(docs, rest), "exact")
    discard(rest)
    frame = F.struct(at.alias("a"), (at + LEAST - 1).alias("b"), (at - of).alias("shift"))
    found.append(_verify(docs, _met(_beside(exact, "at"), [frame]), "found"))
    discard(exact)
    # what is left: couples, and documents whose windows have a first occurrence in common under AGREE keys
    rest = stash(_unsettled(left.select("key", "doc", "at"), found[1], "at"), "rest")
    discard(left)
    several = stash(_beside(rest, "at"), "several")  # a couple that documents share is made of keys that they share
    discard(rest)
    pairs = stash(couples(several), "couples")
    both = _met(_beside(pairs, "at", "by"), [_frame(at, of), _frame(F.col("by"), F.col("head.by"))]).where(_wide("frame"))
    single = _met(several, [_frame(at, of)]).where(_wide("frame")).groupBy("doc", "head").agg(F.collect_set(F.struct("key", "frame")).alias("all"))
    single = single.where(F.size(F.array_distinct("all.key")) >= AGREE).select("doc", "head", F.explode("all.frame").alias("frame"))
    found.append(_verify(docs, both.drop("key").unionByName(single), "found"))
    discard(several)
    discard(pairs)
    # later frames may cover a passage of the same two documents again
    whole = same.select("doc", F.lit(0), (F.col("n") - 1).cast("int"), "head", F.lit(0), F.lit(1.0))
    every = stash(functools.reduce(DataFrame.union, found).distinct().union(whole), "repeats")
    for done in (*found, same):
        discard(done)
    return every


def without_repeats(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the words of ``found`` (doc_id, first_word, last_word) cut out; documents left without a word go."""
    tune(docs.sparkSession)
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("first_word", "last_word")).alias(SPANS))
    whole = docs.join(spans, "doc_id", "left").select(*docs.columns, SPANS)
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            gone = []
            for i, (t, s) in enumerate(zip(texts, spans, strict=True)):
                if not s or t is None:
                    continue
                buf = np.frombuffer(t.encode(), np.uint8)
                starts, ends, _ = words(buf, np.array([0, len(buf)]), SPACED)
                drop = np.zeros(len(starts), bool)
                for x in s:
                    drop[x["first_word"] : x["last_word"] + 1] = True
                if drop.all():
                    gone.append(i)
                # what stands before the next kept word goes with a dropped one
                edge = np.flatnonzero(np.diff(np.concatenate([[0], drop.view(np.int8), [0]])))
                out, pos = [], 0
                for p, q in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    out.append(buf[pos : starts[p]])
                    pos = int(starts[q]) if q < len(starts) else len(buf)
                out.append(buf[pos:])
                texts[i] = np.concatenate(out).tobytes().decode()
            cols = batch.columns[:-1]
            cols[at] = pa.array(texts, pa.string())
            kept = np.ones(batch.num_rows, bool)
            kept[gone] = False
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(kept))

    return whole.mapInArrow(run, docs.schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


def brute_windows(x: list[int], least: int) -> set[tuple[int, int, int]]:
    """compact_windows() by looking at every position; for tests."""
    out = set()
    for c, v in enumerate(x):
        a = c
        while a > 0 and x[a - 1] > v:
            a -= 1
        b = c
        while b + 1 < len(x) and x[b + 1] >= v:
            b += 1
        if b - a + 1 >= least:
            out.add((a, c, b))
    return out
