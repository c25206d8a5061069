"""License scans by ordered signature rules; DataFrame functions only.

Base phrases are found word by word. The method's own signatures are regular expressions, in order of
priority, made by rule from a table of licenses (names, versions) and of forms in which they are named.
A license's signatures are tried only where its keyword occurs: one expression finds the places of each
name with all that belongs to it, and the first signature that is the whole hit names it. Every hit is
an interval of the lower-cased text; an interval inside another one is suppressed by the longer, and of
equal intervals the signature of higher priority stays. So "cc by-nc 4.0" is that license, though
"cc by" stands in it.

The method's labels are those of the table; its identifiers have the version that the text names, too
(gpl-3.0, with "or later" gpl-3.0-or-later, without a version gpl).

Edge cases: a null or empty text has no words and no labels (empty strings) and score 0; repeated
rows give repeated results; an empty table gives an empty result; extra columns are ignored. Work
in one text is in proportion to its length and hits: lists grow in chunks, never one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.llm.session import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The contract's phrases and labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: What stands for a blank and for a hyphen within a name.
BLANK, HYPHEN = r"\s{1,4}", r"[\s-]{1,4}"
LICENSE = "licen[sc]e"

#: Keyword of the prefilter, label, names (a blank and a hyphen as above, L the word license in either spelling), versions.
LICENSES = [
    ("affero", "agpl", ["gnu affero general public L", "affero general public L", "affero gpl", "gnu agpl"], ["1.0", "3.0"]),
    ("lesser", "lgpl", ["gnu lesser general public L", "lesser general public L", "lesser gpl"], ["2.1", "3.0"]),
    ("library general", "lgpl", ["gnu library general public L", "library general public L"], ["2.0"]),
    ("lgpl", "lgpl", ["gnu lgpl", "lgpl"], ["2.0", "2.1", "3.0"]),
    ("gnu", "gpl", ["gnu general public L", "gnu gpl", "the gnu L"], ["1.0", "2.0", "3.0"]),
    ("gpl", "gpl", ["gpl"], ["1.0", "2.0", "3.0"]),
    ("documentation", "gfdl", ["gnu free documentation L", "free documentation L", "gnu fdl"], ["1.1", "1.2", "1.3"]),
    ("apache", "apache", ["apache L", "apache software L", "apache public L"], ["1.0", "1.1", "2.0"]),
    ("mit", "mit", ["mit L", "the mit L", "mit-style L"], []),
    ("x11", "x11", ["x11 L", "mit/x11 L", "x11/mit L"], []),
    ("expat", "mit", ["expat L", "mit (expat) L"], []),
    ("bsd", "bsd", ["bsd L", "bsd-style L", "berkeley software distribution L"], []),
    ("bsd", "bsd-4-clause", ["bsd-4-clause L", "bsd-4-clause", "4-clause bsd L", "four-clause bsd L", "original bsd L", "old bsd L"], []),
    ("bsd", "bsd-3-clause", ["bsd-3-clause L", "bsd-3-clause", "3-clause bsd L", "three-clause bsd L", "new bsd L", "revised bsd L", "modified bsd L"], []),
    ("bsd", "bsd-2-clause", ["bsd-2-clause L", "bsd-2-clause", "2-clause bsd L", "two-clause bsd L", "simplified bsd L", "freebsd L"], []),
    ("0bsd", "0bsd", ["0bsd", "zero-clause bsd L"], []),
    ("mozilla", "mpl", ["mozilla public L"], ["1.0", "1.1", "2.0"]),
    ("netscape", "npl", ["netscape public L"], ["1.0", "1.1"]),
    ("eclipse", "epl", ["eclipse public L"], ["1.0", "2.0"]),
    ("eclipse", "edl", ["eclipse distribution L"], ["1.0"]),
    ("cc", "cc-by", ["cc-by"], ["2.0", "2.5", "3.0", "4.0"]),
    ("cc", "cc-by-sa", ["cc-by-sa"], ["2.0", "2.5", "3.0", "4.0"]),
    ("cc", "cc-by-nc", ["cc-by-nc"], ["2.0", "2.5", "3.0", "4.0"]),
    ("cc", "cc-by-nd", ["cc-by-nd"], ["2.0", "2.5", "3.0", "4.0"]),
    ("cc", "cc-by-nc-sa", ["cc-by-nc-sa"], ["2.0", "2.5", "3.0", "4.0"]),
    ("cc", "cc-by-nc-nd", ["cc-by-nc-nd"], ["2.0", "2.5", "3.0", "4.0"]),
    ("cc0", "cc0", ["cc0"], ["1.0"]),
    ("creative commons", "cc0", ["creative commons zero"], ["1.0"]),
    ("creative commons", "cc-by", ["creative commons attribution L", "creative commons attribution"], ["2.0", "2.5", "3.0", "4.0"]),
    ("creative commons", "cc-by-sa", ["creative commons attribution-sharealike", "creative commons attribution-share-alike"], ["2.0", "2.5", "3.0", "4.0"]),
    ("creative commons", "cc-by-nc", ["creative commons attribution-noncommercial", "creative commons attribution-non-commercial"], ["2.0", "2.5", "3.0", "4.0"]),
    ("creative commons", "cc-by-nd", ["creative commons attribution-noderivatives", "creative commons attribution-noderivs"], ["2.0", "2.5", "3.0", "4.0"]),
    ("creative commons", "cc-by-nc-sa", ["creative commons attribution-noncommercial-sharealike"], ["2.0", "2.5", "3.0", "4.0"]),
    ("creative commons", "cc-by-nc-nd", ["creative commons attribution-noncommercial-noderivatives", "creative commons attribution-noncommercial-noderivs"], ["2.0", "2.5", "3.0", "4.0"]),
    ("creative commons", "cc", ["creative commons L", "creative commons public L"], []),
    ("boost", "bsl", ["boost software L"], ["1.0"]),
    ("business source", "busl", ["business source L"], ["1.1"]),
    ("server side", "sspl", ["server side public L"], ["1.0"]),
    ("elastic", "elastic", ["elastic L"], ["2.0"]),
    ("zlib", "zlib", ["zlib L", "zlib/libpng L"], []),
    ("libpng", "libpng", ["libpng L"], ["2.0"]),
    ("isc", "isc", ["isc L", "internet systems consortium L"], []),
    ("unlicense", "unlicense", ["the unlicense", "unlicense"], []),
    ("artistic", "artistic", ["artistic L", "perl artistic L", "clarified artistic L"], ["1.0", "2.0"]),
    ("python", "psf", ["python software foundation L", "psf L"], ["2.0"]),
    ("european union", "eupl", ["european union public L"], ["1.0", "1.1", "1.2"]),
    ("development and distribution", "cddl", ["common development and distribution L"], ["1.0", "1.1"]),
    ("common public", "cpl", ["common public L"], ["1.0"]),
    ("ibm", "ipl", ["ibm public L"], ["1.0"]),
    ("academic free", "afl", ["academic free L"], ["1.2", "2.0", "2.1", "3.0"]),
    ("open software", "osl", ["open software L"], ["1.0", "2.0", "2.1", "3.0"]),
    ("open database", "odbl", ["open database L"], ["1.0"]),
    ("open data commons", "odc-by", ["open data commons attribution L"], ["1.0"]),
    ("public domain dedication", "pddl", ["public domain dedication and L"], ["1.0"]),
    ("microsoft", "ms-pl", ["microsoft public L"], []),
    ("microsoft", "ms-rl", ["microsoft reciprocal L"], []),
    ("open font", "ofl", ["sil open font L", "open font L"], ["1.0", "1.1"]),
    ("ncsa", "ncsa", ["university of illinois/ncsa open source L", "ncsa open source L"], []),
    ("postgresql", "postgresql", ["postgresql L"], []),
    ("openssl", "openssl", ["openssl L"], []),
    ("php", "php", ["php L"], ["3.0", "3.01"]),
    ("ruby", "ruby", ["ruby L"], []),
    ("vim", "vim", ["vim L"], []),
    ("w3c", "w3c", ["w3c software L", "w3c software notice and L"], []),
    ("beerware", "beerware", ["beerware L"], []),
    ("mulan", "mulanpsl", ["mulan permissive software L"], ["1.0", "2.0"]),
    ("educational community", "ecl", ["educational community L"], ["1.0", "2.0"]),
    ("apple", "apsl", ["apple public source L"], ["1.0", "1.1", "1.2", "2.0"]),
    ("q public", "qpl", ["q public L"], ["1.0"]),
    ("sleepycat", "sleepycat", ["sleepycat L"], []),
    ("zope", "zpl", ["zope public L"], ["1.1", "2.0", "2.1"]),
    ("cecill", "cecill", ["cecill free software L", "cecill L", "cecill"], ["1.0", "1.1", "2.0", "2.1"]),
    ("universal permissive", "upl", ["universal permissive L"], ["1.0"]),
    ("unicode", "unicode", ["unicode L agreement", "unicode L"], []),
    ("curl", "curl", ["curl L"], []),
    ("do what the fuck", "wtfpl", ["do what the fuck you want to public L"], ["2.0"]),
    ("wtfpl", "wtfpl", ["wtfpl"], ["2.0"]),
    ("public domain", "public-domain", ["dedicated to the public domain", "released into the public domain", "in the public domain"], []),
    ("all rights reserved", "proprietary", ["all rights reserved"], []),
]
#: What may stand before and after a name, and how sure the forms are: name, with version, and so on.
UNDER = rf"(?:licensed|released|distributed|available|published){BLANK}under{BLANK}(?:the{BLANK})?(?:terms{BLANK}of{BLANK}(?:the{BLANK})?)?"
LATER = rf"(?:,?{BLANK}or{BLANK}(?:\(at{BLANK}your{BLANK}option\)\s{{1,4}})?(?:any{BLANK})?later(?:{BLANK}version)?|\+|-or-later)"
SURE = {"spdx": 1.0, "under": 0.8, "name": 0.6, "version": 0.85, "under version": 0.9, "later": 0.95, "under later": 0.97}
_SPDX = "spdx-license-identifier"


#: The keyword of identifiers in files.
SPDX = "spdx-license-identifier"


def _name(name: str) -> str:
    """The expression of a name of the table."""
    out = "".join({" ": BLANK, "-": HYPHEN, "(": r"\(", ")": r"\)", "/": r"\/"}.get(c, c) for c in name)
    return out.replace("L", LICENSE)


def _version(version: str) -> str:
    """3.0 may be written 3."""
    whole, _, rest = version.partition(".")
    number = rf"{whole}(?:\.0)?" if rest == "0" else rf"{whole}\.{rest}"
    return rf"(?:,?{BLANK}|{HYPHEN})(?:\(?v(?:ersion|\.)?\s{{0,4}})?{number}(?![0-9]|\.[0-9])"


def identifiers() -> list[str]:
    """What may follow SPDX: labels with each of their versions, longer ones first."""
    known = {f"{label}-{v}" if v else label for _, label, _, versions in LICENSES for v in (versions or [""])}
    return sorted(known, key=lambda x: (-len(x), x))


def rules() -> list[tuple[str, str, str, list[str]]]:
    """(keyword, expression of the name, label, versions) of the table: of one keyword longer names first."""
    each = [(k, name, label, versions) for k, label, names, versions in LICENSES for name in names]
    return [(k, _name(name), label, versions) for k, name, label, versions in sorted(each, key=lambda r: -len(r[1]))]


def signatures() -> list[tuple[str, str, float, str]]:
    """(keyword, identifier, confidence, expression) of all signatures, those of higher priority first."""
    out = []
    for i in identifiers():
        for tail, more in (("(?:-or-later|\\+)", "-or-later"), ("(?:-only)?(?![a-z0-9.+-]*[a-z0-9+])", "")):
            out.append((SPDX, i + more, SURE["spdx"], rf"{SPDX}:\s{{0,4}}{i.replace('.', chr(92) + '.')}{tail}"))
    for keyword, name, label, versions in rules():
        for v in versions:
            at = rf"\b{name}{_version(v)}"
            for form, pattern in (("under later", rf"\b{UNDER}" + at + LATER), ("later", at + LATER), ("under version", rf"\b{UNDER}" + at), ("version", at)):
                out.append((keyword, f"{label}-{v}" + "-or-later" * ("later" in form), SURE[form], pattern))
        out.append((keyword, label, SURE["under"], rf"\b{UNDER}\b{name}\b"))
        out.append((keyword, label, SURE["name"], rf"\b{name}\b"))
    return out


def finders() -> dict[str, str]:
    """Keyword: one expression that takes the longest of the keyword's signatures at a place.

    Where a longer name fits, no shorter one with a version does, so names are tried longest first,
    each with all that may belong to it.
    """
    out: dict[str, str] = {SPDX: rf"{SPDX}:\s{{0,4}}[a-z0-9][a-z0-9.+-]*[a-z0-9+]"}
    by_keyword: dict[str, list[str]] = {}
    for keyword, name, _, versions in rules():
        more = "|".join(map(_version, versions))
        by_keyword.setdefault(keyword, []).append(rf"{name}\b(?:(?:{more}){LATER}?)?" if versions else rf"{name}\b")
    return out | {k: rf"\b(?:{UNDER})?\b(?:{'|'.join(names)})" for k, names in by_keyword.items()}


CHUNK = 256


def _append(cur: Column, done: Column, x: Column) -> tuple[Column, Column]:
    """A list that grows in chunks: (open chunk, full chunks) with one more element."""
    full = F.size(cur) >= CHUNK
    return F.when(full, F.array(x)).otherwise(F.concat(cur, F.array(x))), F.when(full, F.concat(done, F.array(cur))).otherwise(done)


def _places(text: str, pattern: str) -> Column:
    """Intervals (first character, end, hit) of the matches of ``pattern`` in the column ``text``.

    What is between matches and the matches themselves alternate; running sums of their lengths are the places.
    """
    kind = "struct<a:int,e:int,hit:string>"
    gaps = F.transform(F.split(F.col(text), pattern, -1), F.length)
    hits = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("cur"), F.array().cast(f"array<array<{kind}>>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + x["gap"]
        e = a + F.length(x["hit"])
        cur, done = _append(s["cur"], s["done"], F.struct(a.alias("a"), e.alias("e"), x["hit"].alias("hit")))
        return F.when(x["hit"].isNull(), s).otherwise(F.struct(e.alias("at"), cur.alias("cur"), done.alias("done")))

    return F.aggregate(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), start, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["cur"]))))


def _ranked(places: Column, rank: int, keyword: str) -> Column:
    """Places in the form that sorts by start, the longest and then the keyword of higher priority first."""
    return F.transform(places, lambda h: F.struct(h["a"].alias("a"), (-h["e"]).alias("neg"), F.lit(rank).alias("rank"), F.lit(keyword).alias("keyword"), h["hit"].alias("hit")))


def _read(hit: Column) -> Column:
    """Struct (a, e, spdx, base, under, later) of a hit: its name with the version after it, and what stands around both."""
    text = hit["hit"]
    cases = F
    for keyword, name, label, versions in rules():
        made = F.lit(label)
        if versions:
            number = F.regexp_extract(text, rf"{name}(?:{'|'.join(map(_version, versions))})", 0)
            written = F.regexp_extract(number, r"([0-9]+(?:\.[0-9]+)?)$", 1)
            made = F.when(written == "", F.lit(label)).otherwise(F.concat(F.lit(label + "-"), written, F.when(F.contains(written, F.lit(".")), F.lit("")).otherwise(F.lit(".0"))))
        cases = cases.when((hit["keyword"] == keyword) & text.rlike(rf"^(?:{UNDER})?{name}\b"), made)
    spdx = hit["keyword"] == SPDX
    plain = F.regexp_extract(text, r":\s*(.*)$", 1)
    bare = F.regexp_replace(plain, r"(?:-only|-or-later|\+)$", "")
    base = F.when(spdx, F.when(F.array_contains(F.array(*[F.lit(i) for i in identifiers()]), bare), bare)).otherwise(cases)
    return F.struct(hit["a"].alias("a"), hit["e"].alias("e"), spdx.alias("spdx"), base.alias("base"), text.rlike("^" + UNDER).alias("under"), text.rlike(LATER + "$").alias("later"))


def _named(x: Column) -> Column:
    """Struct (a, e, label, identifier, sure) of what _read() has found; the identifier is null if it isn't known."""
    version = x["base"].rlike("-[0-9]+[.][0-9]+$")
    identifier = F.when(x["later"] & (version | x["spdx"]), F.concat(x["base"], F.lit("-or-later"))).otherwise(x["base"])
    label = F.regexp_replace(x["base"], "-[0-9]+[.][0-9]+$", "")
    sure = F.when(x["spdx"], SURE["spdx"])
    for form, ok in (("under later", x["under"] & x["later"] & version), ("later", x["later"] & version), ("under version", x["under"] & version), ("version", version), ("under", x["under"])):
        sure = sure.when(ok, SURE[form])
    return F.struct(x["a"].alias("a"), x["e"].alias("e"), label.alias("label"), identifier.alias("identifier"), sure.otherwise(SURE["name"]).alias("sure"))


def _kept(found: str) -> Column:
    """Of hits in order of start, longest and of highest priority first, those that lie in no other one."""
    kind = "struct<a:int,e:int,keyword:string,hit:string>"
    start = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{kind}>").alias("cur"), F.array().cast(f"array<array<{kind}>>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        e = -x["neg"]
        cur, done = _append(s["cur"], s["done"], F.struct(x["a"].alias("a"), e.alias("e"), x["keyword"].alias("keyword"), x["hit"].alias("hit")))
        return F.when(e <= s["end"], s).otherwise(F.struct(e.alias("end"), cur.alias("cur"), done.alias("done")))

    return F.aggregate(found, start, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["cur"]))))


def scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, identifiers, score, detections) of every row of ``docs``."""
    one = docs.select("doc_id", F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER).alias("low"))
    cols: dict[str, Column] = {"words": F.array_remove(F.split("low", GAP), "")}
    none = F.array().cast("array<struct<a:int,neg:int,rank:int,keyword:string,hit:string>>")
    known = finders()
    for i, (keyword, pattern) in enumerate(known.items()):
        hits = _ranked(_places("low", pattern), i, keyword)
        cols[f"f{i}"] = F.when(F.contains("low", F.lit(keyword)), hits).otherwise(none)
    two = one.withColumns(cols)

    firsts = [p.split() for p in BASE]
    case = "case " + " ".join("when " + " and ".join(f"get(words, i + {j}) = '{w}'" if j else f"words[i] = '{w}'" for j, w in enumerate(p)) + f" then '{BASE[' '.join(p)]}'" for p in firsts) + " end"
    gate = " or ".join(f"contains(low, '{p[-1]}')" for p in firsts)
    base = f"if(size(words) > 1 and ({gate}), filter(transform(sequence(0, size(words) - 1), i -> struct(i as at, {case} as label)), x -> x.label is not null), cast(array() as array<struct<at:int,label:string>>))"
    three = two.select("doc_id", F.size("words").cast("long").alias("n_words"), F.expr(base).alias("base"), F.array_sort(F.concat(*[F.col(f"f{i}") for i in range(len(known))])).alias("found"))
    some = F.when(F.size("found") > 0, F.filter(F.transform(F.transform(_kept("found"), _read), _named), lambda x: x["identifier"].isNotNull()))
    four = three.withColumn("detections", F.coalesce(some, F.array().cast("array<struct<a:int,e:int,label:string,identifier:string,sure:double>>")))
    return four.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.at").cast("long").alias("first_word"),
        F.array_max("base.at").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base.label", "detections.label"))), ",").alias("labels"),
        F.array_join(F.array_sort(F.array_distinct("detections.identifier")), ",").alias("identifiers"),
        F.coalesce(F.greatest(F.array_max("detections.sure"), F.when(F.size("base") > 0, 0.6)), F.lit(0.0)).alias("score"),
        "detections",
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("detections")
