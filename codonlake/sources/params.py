"""Parameter files of gene models: profiles, Markov tables and chaining rules as small tables.

A file has a fixed size whatever the data, so it is parsed on the driver and broadcast.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from codonlake.operators.chains import Rule

CLASSES = ("Initial", "Internal", "Terminal", "Single", "utr")
#: Distance that a rule gives as "Infinity".
UNBOUNDED = None


@dataclass
class Profile:
    dimension: int
    offset: int
    cutoff: float
    order: int
    a: float = 0.0
    b: float = 1.0
    extra: tuple[float, ...] = ()
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # position x word over ACGTN


@dataclass
class Isochore:
    low: int
    high: int
    values: dict[str, list[float]]
    profiles: dict[str, Profile]
    word: int = 0
    initial: np.ndarray = field(default_factory=lambda: np.zeros((3, 0), np.float32))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((3, 0), np.float32))
    donors: int = 5


@dataclass
class Parameters:
    no_score: float
    isochores: list[Isochore]
    rules: list[Rule]


def with_unknown(table: np.ndarray, k: int) -> np.ndarray:
    """A table over words of ACGT (last axis, 4^k) to one over ACGTN: N is the mean of the four bases."""
    t = table.astype(np.float64).reshape(*table.shape[:-1], *[4] * k)
    for axis in range(t.ndim - k, t.ndim):
        t = np.concatenate([t, t.mean(axis=axis, keepdims=True)], axis=axis)
    return t.reshape(*table.shape[:-1], 5**k).astype(np.float32)


def _number(word: str) -> int:
    out = 0
    for c in word:
        out = out * 4 + "ACGT".index(c.upper().replace("U", "T"))
    return out


def _profile(head: list[str], lines: Iterator[list[str]]) -> Profile:
    n, k = int(head[0]), int(head[3]) + 1
    more = [float(x) for x in head[4:]]
    a, b = (more[0], more[1]) if len(more) >= 2 else (0.0, 1.0)
    t = np.zeros((n, 4**k), np.float32)
    for position, word, weight in itertools.islice(lines, n * 4**k):
        t[int(position) - 1, _number(word)] = float(weight)
    return Profile(n, int(head[1]), float(head[2]), k - 1, a, b, tuple(more[2:]), with_unknown(t, k))


def _markov(k: int, lines: Iterator[list[str]]) -> np.ndarray:
    t = np.zeros((3, 4**k), np.float32)
    for word, _, frame, value in itertools.islice(lines, 3 * 4**k):
        t[int(frame), _number(word)] = float(value)
    return t


def rules_of(lines: list[str], blanks_block: bool = True) -> list[Rule]:
    """Rules "up:up down:down least:most [block]" in their order. A blank at the end of a line counts
    as the fourth word (and so as block) where ``blanks_block``, which is how such files have been read."""
    out = []
    for line in lines:
        w = line.split()
        least, most = w[2].split(":")
        block = len(w) > 3 or (blanks_block and line.rstrip("\n").endswith(" "))
        out.append(Rule(frozenset(w[0].split(":")), frozenset(w[1].split(":")), int(float(least)), UNBOUNDED if most == "Infinity" else int(float(most)), block))
    return out


def parse(text: str, blanks_block: bool = True) -> Parameters:
    """The whole file. Heads are matched by name where the format leaves a choice, otherwise by place."""
    raw = [x for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")]
    at = next(i for i, x in enumerate(raw) if x.strip() == "General_Gene_Model")
    rules = rules_of(raw[at + 1 :], blanks_block)
    lines = iter([x.split() for x in raw[:at]])
    next(lines)
    no_score = float(next(lines)[0])
    head = next(lines)[0]
    while not head.lower().startswith("number_of_isochores"):
        next(lines)
        head = next(lines)[0]
    isochores = []
    for _ in range(int(next(lines)[0])):
        next(lines)
        low, high = next(lines)[:2]
        values: dict[str, list[float]] = {}
        head = next(lines)[0]
        while not head.lower().endswith("_profile"):
            values[head.replace("weigths", "weights")] = [float(x) for x in next(lines)]
            head = next(lines)[0]
        iso = Isochore(int(low), int(high), values, {})
        while head.lower().endswith("_profile"):
            iso.profiles[head] = _profile(next(lines), lines)
            head = next(lines)[0]
        iso.word = int(next(lines)[0])
        next(lines)
        iso.initial = _markov(iso.word, lines)
        next(lines)
        iso.transition = _markov(iso.word + 1, lines)
        next(lines)
        iso.donors = int(next(lines)[0])
        isochores.append(iso)
    return Parameters(no_score, isochores, rules)


def read(path: str, blanks_block: bool = True) -> Parameters:
    with open(path, encoding="latin-1") as f:
        return parse(f.read(), blanks_block)


def _word(number: int, k: int) -> str:
    out = ""
    for _ in range(k):
        out, number = "ACGT"[number % 4] + out, number // 4
    return out


def _four(table: np.ndarray, k: int) -> np.ndarray:
    """The part of a table over words of ACGTN (last axis) that is over words of ACGT."""
    t = table.reshape(*table.shape[:-1], *[5] * k)
    return t[(..., *[slice(0, 4)] * k)].reshape(*table.shape[:-1], 4**k)


def _short(x: float) -> str:
    return repr(float(np.float32(x))) if x != int(x) else str(int(x))


def rule_line(r: Rule) -> str:
    return f"{':'.join(sorted(r.up))} {':'.join(sorted(r.down))} {r.least}:{'Infinity' if r.most is None else r.most}{' block' if r.block else ''}"


def text(p: Parameters) -> str:
    """A parameter file that ``parse`` reads back as ``p``."""
    out = ["NO_SCORE", _short(p.no_score), "number_of_isochores", str(len(p.isochores))]
    for iso in p.isochores:
        out += ["boundaries_of_isochore", f"{iso.low} {iso.high}"]
        for name, values in iso.values.items():
            out += [name, " ".join(map(_short, values))]
        for name, f in iso.profiles.items():
            k = f.order + 1
            out += [name, " ".join([str(f.dimension), str(f.offset), _short(f.cutoff), str(f.order), _short(f.a), _short(f.b), *map(_short, f.extra)])]
            out += [f"{i + 1} {_word(w, k)} {_short(x)}" for i, row in enumerate(_four(f.weights, k)) for w, x in enumerate(row.tolist())]
        out += ["Markov_order", str(iso.word)]
        for name, table, k in (("Initial", iso.initial, iso.word), ("Transition", iso.transition, iso.word + 1)):
            out += [name, *[f"{_word(w, k)} {w} {f} {_short(x)}" for w in range(4**k) for f, x in enumerate(table[:, w].tolist())]]
        out += ["Donors_per_acceptor", str(iso.donors)]
    return "\n".join([*out, "General_Gene_Model", *map(rule_line, p.rules)]) + "\n"


def grafted(p: Parameters, other: Parameters) -> Parameters:
    """``p`` with the profiles and values of the minor splice classes of ``other``, isochore by isochore (the last one for further ones); its own stay."""
    out = []
    for i, iso in enumerate(p.isochores):
        of = other.isochores[min(i, len(other.isochores) - 1)]
        mine = {k: v for k, v in iso.profiles.items() if not k.startswith("U12")}
        theirs = {k: v for k, v in of.profiles.items() if k.startswith("U12")}
        # acceptors and branch points stand before the acceptor profile, donors before the donor profile
        profiles: dict[str, Profile] = {}
        for name, f in mine.items():
            kind = "Acceptor" if name == "Acceptor_profile" else "Donor" if name == "Donor_profile" else None
            if kind:
                profiles |= {k: v for k, v in theirs.items() if (k.endswith("Donor_profile")) == (kind == "Donor")}
            profiles[name] = f
        values = iso.values | {k: v for k, v in of.values.items() if k.startswith("U12")}
        out.append(Isochore(iso.low, iso.high, values, profiles, iso.word, iso.initial, iso.transition, iso.donors))
    return Parameters(p.no_score, out, p.rules)
