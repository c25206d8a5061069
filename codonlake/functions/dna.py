"""Column expressions over sequence strings: complement, digits, words of bases, codons, frames."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: The base that stands for each letter when any text is read as a sequence.
AS_BASES = "".join("ACGT"[(7 * i + i // 5) % 4] if i % 17 else "N" for i in range(52))
#: The standard genetic code in the order TCAG, a fixed table; * is a stop.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(c): a for c, a in zip(itertools.product("TCAG", repeat=3), CODE, strict=True)}
STOPS = ("TAA", "TAG", "TGA")


def pseudo_dna(text: Column) -> Column:
    """A whole text as a sequence: letters become bases, the rest goes; null becomes empty."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""), LETTERS, AS_BASES)


def reverse_complement(seq: Column) -> Column:
    """What isn't ACGT becomes N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA"))


def digit(base: Column) -> Column:
    """A 0, C 1, G 2, T and U 3, other 4; upper or lower case."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in zip("ACGTUN", (0, 1, 2, 3, 3, 4), strict=True) for x in kv]), F.upper(base)), F.lit(4))


def words_of_bases(seq: Column | str, k: int) -> Column:
    """All runs of ``k`` bases in order, in linear time."""
    s = seq if isinstance(seq, str) else "seq"
    parts = ", ".join(f"x.c[i + {j}]" for j in range(k))
    return F.expr(f"flatten(transform(array(struct(split({s}, '') as c)), x -> if(length({s}) < {k}, cast(array() as array<string>), transform(sequence(0, length({s}) - {k}), i -> concat({parts})))))")


def split_words(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Rows (other columns, pos from 0, word) of all runs of ``k`` bases."""
    return seqs.withColumn("__words", words_of_bases(seq, k)).select(*[c for c in seqs.columns if c != seq], F.posexplode("__words").alias("pos", "word"))


def amino_acids(seq: str, codons: Column) -> Column:
    """Amino acids of an array of codons; unknown ones are X."""
    table = F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv])
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")


def oligo_index(word: Column, k: int, cardinal: int = 5) -> Column:
    """A word of bases as a number with digits ACGTN."""
    out = F.lit(0).cast("long")
    for i in range(k):
        out = out * cardinal + digit(F.substring(word, i + 1, 1))
    return out


def remainder(acceptor: Column, donor: Column, frame: Column) -> Column:
    """Bases of an exon's last, incomplete codon that the next exon has to give."""
    return F.pmod(3 - F.pmod(donor - (acceptor + frame) + 1, F.lit(3)), F.lit(3))


def split_codon_left(frame: Column, bases: Column) -> Column:
    """What the first bases of an exon could complete to a stop codon (0: nothing)."""
    one, two = F.substring(bases, 1, 1), F.substring(bases, 1, 2)
    return F.when((frame == 1) & (one == "A"), 2).when((frame == 1) & (one == "G"), 3).when((frame == 2) & two.isin("AG", "AA", "GA"), 1).otherwise(0)


def split_codon_right(rest: Column, bases: Column) -> Column:
    """What the last bases of an exon could begin of a stop codon (0: nothing)."""
    one, two = F.substring(bases, -1, 1), F.substring(bases, -2, 2)
    return F.when((rest == 2) & (one == "T"), 1).when((rest == 1) & (two == "TG"), 2).when((rest == 1) & (two == "TA"), 3).otherwise(0)
