"""Signal scans and coding scores of sequences, cut into overlapping fragments.

A fragment and a strand are a unit of work; a long locus becomes many. Scores are single precision,
summed in order, since that is part of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.functions.dna import reverse_complement
from codonlake.sources.params import Isochore, Profile

FRAGMENT, OVERLAP = 500_000, 10_000
_DIGIT = np.full(256, 4, np.int64)
for _i, _b in enumerate("ACGT"):
    _DIGIT[ord(_b)] = _DIGIT[ord(_b.lower())] = _i
_DIGIT[ord("U")] = _DIGIT[ord("u")] = 3


def fragments(sequences: DataFrame, fragment: int = FRAGMENT, overlap: int = OVERLAP, strands: str = "+-") -> DataFrame:
    """Rows (locus, length, frag, strand, l1, l2, seq) of (locus, length, seq): 0-based, inclusive; on "-" coordinates
    and bases are those of the reverse complement. An empty sequence has no fragment."""
    hop = fragment - overlap
    last = F.greatest(F.lit(0), F.floor((F.col("length") - 1 - overlap) / hop))
    cut = sequences.where("length > 0").select("locus", "length", "seq", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("frag"))
    cut = cut.select("locus", "length", "frag", (F.col("frag") * hop).alias("l1"), F.least(F.col("frag") * hop + fragment, "length").alias("end"), "seq")
    cut = cut.withColumn("seq", F.substring("seq", (F.col("l1") + 1).cast("int"), (F.col("end") - F.col("l1")).cast("int")))
    both = cut.withColumn("strand", F.explode(F.array(*[F.lit(s) for s in strands])))
    back = F.col("strand") == "-"
    return both.select(
        "locus", "length", "frag", "strand",
        F.when(back, F.col("length") - F.col("end")).otherwise(F.col("l1")).alias("l1"),
        (F.when(back, F.col("length") - F.col("l1")).otherwise(F.col("end")) - 1).alias("l2"),
        F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"),
    )


#: Bases at the start of a fragment whose windows may begin before it: the widest profile.
EDGE = 100


def owned(sites: DataFrame, frags: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """``sites`` with each start and acceptor in one fragment only: of two that share it the later one on the strand, but for
    its first EDGE bases. So every exon of up to ``overlap`` - EDGE bases is built once, from whole lists of donors and stops."""
    by = ["locus", "frag", "strand"]
    lo = F.when(F.col("l1") == 0, F.lit(0).cast("long")).otherwise(F.col("l1") + EDGE)
    hi = F.when(F.col("l2") >= F.col("length") - 1, F.col("l2")).otherwise(F.col("l2") - overlap + EDGE)
    ends = frags.select(*by, lo.alias("__lo"), hi.alias("__hi"))
    left = F.lower("kind").startswith("start") | F.lower("kind").startswith("acceptor")
    return sites.join(ends, by).where(~left | F.col("pos").between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


#: Bases that are worked on at once.
PIECE = 1 << 20


def row_groups(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, behind the last) of (id, seq), each of ``size`` bytes at most or a single sequence."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield at, end
        at = end


def digits(seq: bytes) -> np.ndarray:
    return _DIGIT[np.frombuffer(seq, np.uint8)]


def words(d: np.ndarray, k: int, cardinal: int) -> np.ndarray:
    """The number of the word of ``k`` bases that starts at each base."""
    out = np.zeros(max(0, len(d) - k + 1), np.int64)
    for i in range(k):
        out = out * cardinal + d[i : i + len(out)]
    return out


def places(b: np.ndarray, words: tuple[str, ...]) -> np.ndarray:
    """Where one of a few words of one length begins."""
    size = len(words[0])
    n = max(0, len(b) - size + 1)
    hit = np.zeros(n, bool)
    for word in words:
        one = b[:n] == ord(word[0])
        for j in range(1, size):
            one &= b[j : n + j] == ord(word[j])
        hit |= one
    return np.flatnonzero(hit)


def motif_sites(seqs: DataFrame, motifs: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows (doc_id, pos, kind) of (doc_id, seq): where a word of each kind begins. Only sites become rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(motifs)
        for batch in batches:
            ids, seqs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            found: list[tuple[int, int, np.ndarray]] = []
            for i, seq in enumerate(seqs):
                b = np.frombuffer(seq.encode(), np.uint8)
                found += [(i, k, places(b, motifs[name])) for k, name in enumerate(names)]
            size = [len(x) for *_, x in found]
            doc, kind = (np.repeat([f[c] for f in found], size).astype(np.int64) if found else np.zeros(0, np.int64) for c in (0, 1))
            pos = np.concatenate([x for *_, x in found]) if found else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(ids[doc], pa.int64()), pa.array(pos, pa.int64()), pa.array(names, pa.string()).take(pa.array(kind))], ["doc_id", "pos", "kind"])

    return seqs.select("doc_id", "seq").mapInArrow(run, "doc_id long, pos long, kind string")


def running_tracks(seqs: DataFrame, tables: dict[str, list[int]], step: int = 1) -> DataFrame:
    """Rows (doc_id, and for each table an array) of (doc_id, seq): whole-number running sums over a sequence.

    A table has a value for each word of A, C, G, T and N, as a number in base 5; with a ``step`` sums run
    over every step-th word, for each start by itself.
    """
    sizes = {name: round(np.log(len(t)) / np.log(5)) for name, t in tables.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {name: np.array(t, np.int64) for name, t in tables.items()}
        for batch in batches:
            for at, end in row_groups(batch, PIECE):
                out: dict[str, list[np.ndarray]] = {name: [] for name in own}
                for i in range(at, end):
                    d = digits(batch.column(1)[i].as_buffer())
                    for name, table in own.items():
                        v = table[words(d, sizes[name], 5)]
                        for f in range(step):
                            v[f::step] = np.cumsum(v[f::step])
                        out[name].append(v)
                cols = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in v])]), pa.int32()), pa.array(np.concatenate(v))) for v in out.values()]
                yield pa.record_batch([batch.column(0).slice(at, end - at), *cols], ["doc_id", *own])

    return seqs.select("doc_id", "seq").mapInArrow(run, "doc_id long, " + ", ".join(f"{name} array<long>" for name in tables))


def listed(v: np.ndarray) -> bytes:
    """Whole numbers from 0 as text, with a comma behind each."""
    width = len(str(int(v.max(initial=0))))
    rest = v.astype(np.uint32 if width < 10 else np.uint64)
    out = np.full((len(v), width + 1), ord(","), np.uint8)
    shown = np.ones(out.shape, bool)
    for k in range(width - 1, -1, -1):
        shown[:, k] = (rest > 0) | (k == width - 1)
        less = rest // 10
        out[:, k] = rest - less * 10 + ord("0")
        rest = less
    return out[shown].tobytes()


def running_digests(seqs: DataFrame, table: list[int]) -> DataFrame:
    """Rows (doc_id, n, total, digest) of (doc_id, seq): how many bases, the sum of their values, and the MD5 of the running sums as text with
    commas between. A table has a value from 0 for each of A, C, G, T and N. Sums are made and digested piece by piece, so a sequence takes
    no more memory than its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array(table, np.int64)[_DIGIT]
        for batch in batches:
            size, total, digest = [], [], []
            for seq in batch.column(1):
                b, upto, track = np.frombuffer(seq.as_buffer(), np.uint8), 0, hashlib.md5(usedforsecurity=False)
                for at in range(0, len(b), PIECE):
                    v = np.cumsum(own[b[at : at + PIECE]]) + upto
                    upto, text = int(v[-1]), memoryview(listed(v))
                    track.update(text if at + PIECE < len(b) else text[:-1])
                size.append(len(b))
                total.append(upto)
                digest.append(track.hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n", "total", "digest"])

    return seqs.select("doc_id", "seq").mapInArrow(run, "doc_id long, n long, total long, digest string")


def profile_scores(d: np.ndarray, p: Profile, rescale: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(position, score) of every whole window; a position is the window's start plus the profile's offset."""
    w = words(d, p.order + 1, 5)
    n = len(w) - p.dimension + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    raw = np.zeros(n, np.float32)
    for i in range(p.dimension):
        raw += p.weights[i][w[i : i + n]]
    return np.arange(n) + p.order + p.offset, (np.float32(p.a) + np.float32(p.b) * raw if rescale else raw)


def gc_percent(d: np.ndarray) -> float:
    """G+C of the known bases in percent (0 without any)."""
    known = int((d < 4).sum())
    return 100.0 * int(((d == 1) | (d == 2)).sum()) / known if known else 0.0


def isochore_of(gc: float, ranges: list[tuple[int, int]]) -> int:
    """The first range that holds a percentage, both ends included; the last one if none does."""
    return next((i for i, (low, high) in enumerate(ranges) if low <= gc <= high), len(ranges) - 1)


def scan(frags: DataFrame, profiles: dict[str, Profile] | list[tuple[int, int, dict[str, Profile]]], once: int | None = None) -> DataFrame:
    """Rows (locus, frag, strand, kind, pos, score) of the sites that reach their profile's cutoff. Stops need a stop codon
    behind the last coding base and aren't rescaled; windows that begin before the fragment are left out. Of a list of
    (low, high, profiles) those whose G+C range holds the fragment's percentage are used. With ``once``, the overlap of fragments, a
    window that the next fragment has whole is left to it, so each site comes up once and nothing is shuffled."""
    profiles = [(0, 100, profiles)] if isinstance(profiles, dict) else profiles
    shared = frags.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for i in range(batch.num_rows):
                locus, frag, strand, l1, seq, length = (batch.column(k)[i].as_py() for k in range(6))
                d = digits(seq.encode())
                codon = words(d, 3, 5)
                sets = shared.value
                which = isochore_of(gc_percent(d), [(low, high) for low, high, _ in sets]) if len(sets) > 1 else 0
                for kind, p in sets[which][2].items():
                    stop = kind.lower().startswith("stop")
                    pos, score = profile_scores(d, p, not stop)
                    ok = score >= np.float32(p.cutoff)
                    if stop:
                        near = np.minimum(pos + 1, max(0, len(codon) - 1))
                        ok &= (pos + 1 < len(codon)) & np.isin(codon[near], [75, 77, 85])  # TAA, TAG and TGA in base 5 with T = 3: 75+0, 75+2, 75+10
                    if once is not None and l1 + len(seq) < length:
                        ok &= pos - p.offset < len(seq) - once
                    m = int(ok.sum())
                    parts.append(pa.record_batch([pa.array([locus] * m, pa.string()), pa.array([frag] * m, pa.int64()), pa.array([strand] * m, pa.string()), pa.array([kind] * m, pa.string()), pa.array(pos[ok] + l1, pa.int64()), pa.array(score[ok], pa.float32())], ["locus", "frag", "strand", "kind", "pos", "score"]))
            if parts:  # one batch for all fragments and kinds
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    return frags.select("locus", "frag", "strand", "l1", "seq", "length").mapInArrow(run, "locus string, frag long, strand string, kind string, pos long, score float")


class CodingTrack:
    """Running log-odds sums of a fragment for the three codon positions."""

    def __init__(self, d: np.ndarray, iso: Isochore, unknown: float = -4.0):
        k = iso.word
        self.k, self.unknown = k, np.float32(unknown)
        at = lambda table, frame, w: np.where(w < table.shape[1], table[frame, np.minimum(w, table.shape[1] - 1)], self.unknown)
        first, step = words(d, k, 4), words(d, k + 1, 4)
        self.initial = [at(iso.initial, f, first).astype(np.float32) for f in range(3)]
        t = np.arange(len(step)) % 3
        self.total = [np.add.accumulate(at(iso.transition, (3 - j + t) % 3, step).astype(np.float32), dtype=np.float32) for j in range(3)]

    def potentials(self, begin: np.ndarray, end: np.ndarray, frame: np.ndarray) -> np.ndarray:
        """Coding potentials of the bases ``begin`` to ``end`` (from the fragment's start, stop codon left out)."""
        cp = (3 - frame) % 3
        j = (begin + 3 - cp) % 3
        last = len(self.total[0]) - 1
        if last < 0:
            return np.zeros(len(begin), np.float32)
        total, initial = np.stack(self.total), np.stack(self.initial)
        upper = np.minimum(np.where(end <= self.k + 1, end, end - self.k), last)
        lower = np.clip(begin - 1, 0, last)
        out = initial[cp, np.minimum(begin, initial.shape[1] - 1)] + (total[j, upper] - total[j, lower])
        return np.where(end - begin + 1 < 6, np.float32(0), out)


#: Bases on either side of an exon whose G+C chooses its isochore.
CONTEXT = 1000


def coding_potentials(exons: DataFrame, frags: DataFrame, iso: Isochore | list[Isochore]) -> DataFrame:
    """``exons`` (locus, frag, strand, left_pos, right_pos, frame and what else there is) with potential, isochore (its number) and
    head and tail (two bases at either end). Each fragment's exons meet its sequence in one task; of several
    isochores an exon has the first whose range holds the G+C of its bases and CONTEXT more on either side."""
    isos = iso if isinstance(iso, list) else [iso]
    shared = exons.sparkSession.sparkContext.broadcast(isos)
    made = [("potential", pa.float64()), ("isochore", pa.int32()), ("head", pa.string()), ("tail", pa.string())]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            left = left.slice(0, 0)
        n = left.num_rows
        potential, which, head, tail = np.zeros(n, np.float64), np.zeros(n, np.int32), [], []
        if n:
            seq, l1 = right.column("seq")[0].as_py(), right.column("l1")[0].as_py()
            d, own = digits(seq.encode()), shared.value
            a, b, f = (left.column(c).to_numpy().astype(np.int64) for c in ("left_pos", "right_pos", "frame"))
            a, b = a - l1, b - l1
            if len(own) > 1:
                gc, known = (np.concatenate([[0], np.cumsum(x)]) for x in ((d == 1) | (d == 2), d < 4))
                u, v = np.maximum(0, a - CONTEXT), np.minimum(len(d), b + 1 + CONTEXT)
                percent = 100.0 * (gc[v] - gc[u]) / np.maximum(known[v] - known[u], 1)
                which = np.array([isochore_of(x, [(i.low, i.high) for i in own]) for x in percent.tolist()], np.int32)
            for k in np.unique(which).tolist():
                at = which == k
                potential[at] = CodingTrack(d, own[k]).potentials(a[at], b[at], f[at])
            head = [seq[x : x + 2] for x in a.tolist()]
            tail = [seq[max(0, x - 1) : x + 1] for x in b.tolist()]
        for (name, kind), col in zip(made, (potential, which, head, tail), strict=True):
            left = left.append_column(name, pa.array(col, kind))
        return left

    by = ["locus", "frag", "strand"]
    kinds = ", ".join(f"{c} {k}" for c, k in exons.dtypes)
    return exons.groupBy(*by).cogroup(frags.select(*by, "l1", "seq").groupBy(*by)).applyInArrow(run, f"{kinds}, potential double, isochore int, head string, tail string")
