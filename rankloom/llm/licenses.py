"""License scans: ordered signature rules, as built-in expressions over the words of a text.

A text is lower-cased (A-Z only) and read as words of digits, letters a-z and bytes from 0x80 on.  A first pattern over
the raw text, made of the rules' keywords, tells whether any rule can apply at all.  Texts that pass are rewritten as words with single spaces; then
each rule whose keyword the text contains runs its regular expression, which yields intervals of words.  An interval
inside a longer one is suppressed, as is one that equals another of higher priority.  What survives gives the labels.
The places of the base phrases always count, and their labels always stay.

Rules for odd rows: a null text is empty: no words, no places, score 0; repeated rows each get the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_GAP = r"[^0-9a-z\x{80}-\x{10FFFF}]+"

_LICENSE = "(?:licen[sc]e|licence)"
_VERSION = "(?:version |v )?"

#: (label, keyword, name of the license as a pattern, versions).
_VERSIONED = (
    ("gpl", "general public", rf"(?:gnu )?general public {_LICENSE}", "1 2 3"),
    ("gpl", "gpl", "(?:gnu )?gpl", "1 2 3"),
    ("lgpl", "general public", rf"(?:gnu )?(?:lesser|library) general public {_LICENSE}", "2 2.1 3"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", "2 2.1 3"),
    ("agpl", "general public", rf"(?:gnu )?affero general public {_LICENSE}", "1 3"),
    ("agpl", "agpl", "(?:gnu )?agpl", "1 3"),
    ("gfdl", "free documentation", rf"(?:gnu )?free documentation {_LICENSE}", "1.1 1.2 1.3"),
    ("apache", "apache", rf"apache (?:software )?{_LICENSE}", "1.0 1.1 2.0"),
    ("apache", "apache", "apache", "1.0 1.1 2.0"),
    ("mpl", "mozilla public", rf"mozilla public {_LICENSE}", "1.0 1.1 2.0"),
    ("mpl", "mpl", "mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse public", rf"eclipse public {_LICENSE}", "1.0 2.0"),
    ("cddl", "common development", rf"common development and distribution {_LICENSE}", "1.0 1.1"),
    ("cpl", "common public", rf"common public {_LICENSE}", "1.0"),
    ("eupl", "european union public", rf"european union public {_LICENSE}", "1.0 1.1 1.2"),
    ("artistic", "artistic", rf"artistic {_LICENSE}", "1.0 2.0"),
    ("afl", "academic free", rf"academic free {_LICENSE}", "1.1 1.2 2.0 2.1 3.0"),
    ("osl", "open software", rf"open software {_LICENSE}", "1.0 2.0 2.1 3.0"),
    ("lppl", "latex project public", rf"latex project public {_LICENSE}", "1.0 1.1 1.2 1.3"),
    ("bsl", "boost software", rf"boost software {_LICENSE}", "1.0"),
    ("upl", "universal permissive", rf"universal permissive {_LICENSE}", "1.0"),
    ("ofl", "open font", rf"(?:sil )?open font {_LICENSE}", "1.0 1.1"),
    ("odbl", "open database", rf"open database {_LICENSE}", "1.0"),
    ("zpl", "zope public", rf"zope public {_LICENSE}", "1.1 2.0 2.1"),
    ("psf", "python software foundation", rf"python software foundation {_LICENSE}", "2"),
    ("ms-pl", "microsoft public", rf"microsoft public {_LICENSE}", "1.0"),
)

#: (label, words of the short form, words of the long form).
_CREATIVE = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
)

#: (label, keyword, pattern, confidence): names and sentences without versions.
_PLAIN = (
    ("mit", "mit", rf"(?:the )?mit {_LICENSE}", 0.9),
    ("mit", "mit", rf"(?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?mit(?: {_LICENSE})?", 1.0),
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("mit-0", "mit no attribution", rf"mit no attribution(?: {_LICENSE})?", 0.9),
    ("isc", "isc", rf"isc {_LICENSE}", 0.9),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose", 1.0),
    ("bsd", "bsd", rf"(?:the )?(?:new |modified |simplified |revised |original )?bsd(?: style)? {_LICENSE}", 0.8),
    ("bsd-0-clause", "bsd", rf"(?:0|zero) clause bsd(?: {_LICENSE})?", 0.9),
    ("bsd-1-clause", "bsd", rf"(?:1|one) clause bsd(?: {_LICENSE})?", 0.9),
    ("bsd-2-clause", "bsd", rf"(?:2|two) clause bsd(?: {_LICENSE})?", 0.9),
    ("bsd-3-clause", "bsd", rf"(?:3|three) clause bsd(?: {_LICENSE})?", 0.9),
    ("bsd-4-clause", "bsd", rf"(?:4|four) clause bsd(?: {_LICENSE})?", 0.9),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("unlicense", "unlicense", "(?:the )?unlicense", 0.9),
    ("public-domain", "public domain", "(?:released|dedicated|placed) (?:in|to|into) the public domain", 0.9),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", 0.9),
    ("cc0-1.0", "creative commons zero", "creative commons zero(?: v?1 0)?", 0.9),
    ("wtfpl", "wtfpl", "wtfpl", 0.9),
    ("zlib", "zlib", rf"zlib(?: libpng)? {_LICENSE}", 0.9),
    ("all-rights-reserved", "all rights reserved", "all rights reserved", 0.6),
    ("proprietary", "proprietary", f"proprietary (?:software )?{_LICENSE}", 0.6),
    ("unspecified-gnu", "gnu", rf"gnu public {_LICENSE}", 0.6),
    ("unspecified", "licensed under", "(?:dual )?licensed under", 0.3),
)

#: Identifiers for machine-read lines, beyond those of versioned licenses.
_SPDX = "mit isc zlib unlicense wtfpl bsd-2-clause bsd-3-clause bsd-4-clause 0bsd cc0-1.0 ncsa postgresql curl openssl php-3.01 ruby vim w3c x11 beerware bzip2-1.0.6 libpng mulanpsl-2.0 naist-2003 ntp ofl-1.1 blueoak-1.0.0".split()


def _dotted(version: str) -> str:
    """1.0 as words: a final 0 may be left out."""
    head, _, tail = version.partition(".")
    return f"{head}(?: 0)?" if tail in ("", "0") else f"{head} {tail}"


def _short(version: str) -> str:
    return version.removesuffix(".0")


def rules() -> list[tuple[str, str, str, float]]:
    """(label, keyword, pattern over words with single spaces, confidence), in order of falling priority."""
    out = []
    for name, _, _, versions in _VERSIONED:
        out += [(f"{name}-{_short(v)}", "spdx", f"spdx {_LICENSE} identifier {name.replace('-', ' ')} {_dotted(v)}(?: (?:only|or later))?", 1.0) for v in versions.split()]
    out += [(x, "spdx", f"spdx {_LICENSE} identifier {x.replace('-', ' ').replace('.', ' ')}", 1.0) for x in _SPDX]
    for v in "4.0 3.0 2.5 2.0 1.0".split():
        for label, short, long in reversed(_CREATIVE):
            out.append((f"{label}-{v}", f"cc {short}", f"cc {short} {_dotted(v)}", 1.0))
            out.append((f"{label}-{v}", "creative commons", f"creative commons {long}(?: \\S+)? {_dotted(v)}(?: international| unported| generic)?", 1.0))
    for label, short, long in reversed(_CREATIVE):
        out.append((label, f"cc {short}", f"cc {short}", 0.9))
        out.append((label, "creative commons", f"creative commons {long}", 0.9))
    for name, key, pattern, versions in _VERSIONED:
        for v in versions.split():
            out.append((f"{name}-{_short(v)}-or-later", key, f"{pattern} {_VERSION}{_dotted(v)} or (?:at your option )?(?:any )?later(?: version)?", 1.0))
            out.append((f"{name}-{_short(v)}-only", key, f"{pattern} {_VERSION}{_dotted(v)} only", 1.0))
            out.append((f"{name}-{_short(v)}", key, f"(?:(?:released|licensed|distributed) under (?:the )?(?:terms of the )?)?{pattern} {_VERSION}{_dotted(v)}", 1.0))
    out += _PLAIN
    seen = set()
    for name, key, pattern, _ in _VERSIONED:
        if name not in ("apache",) or _LICENSE in pattern:
            if (name, pattern) not in seen:
                seen.add((name, pattern))
                out.append((name, key, pattern, 0.7))
    return out


def _places(norm: Column, pattern: Column) -> Column:
    """The (start, end) in words of each match: the words before a match are counted in the pieces between matches."""
    whole = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    spaces = lambda s: F.regexp_count(s, F.lit(" "))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, gap):
        start = acc["at"] + gap["b"]
        end = start + gap["f"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct((start - 1).alias("start"), end.alias("end")))).alias("out"))

    found, between = F.regexp_extract_all(norm, whole, F.lit(0)), F.split(norm, whole)
    gaps = F.zip_with(F.slice(between, F.lit(1), F.size(between) - 1), found, lambda b, f: F.struct(spaces(b).alias("b"), spaces(f).alias("f")))
    return F.aggregate(gaps, empty, step, lambda acc: acc["out"])


def _table() -> Column:
    base = [(label, phrase.split()[-1] if "license" in phrase else phrase, phrase, 0.9, True) for phrase, label in BASE]
    rows = base + [(*r, False) for r in rules()]
    return F.array(*(F.struct(F.lit(a).alias("label"), F.lit(k).alias("keyword"), F.lit(p).alias("pattern"), F.lit(c).alias("sure"), F.lit(b).alias("base"), F.lit(i).alias("priority")) for i, (a, k, p, c, b) in enumerate(rows)))


def gate() -> str:
    """A pattern over raw text that finds the words of any rule's keyword, or of a base phrase: no rule matches without."""
    words = sorted({phrase for phrase, _ in BASE} | {keyword for _, keyword, _, _ in rules()})
    some = "|".join(w.replace(" ", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+") for w in words)
    return rf"(?i)(?<![0-9A-Za-z\x{{80}}-\x{{10FFFF}}])(?:{some})(?![0-9A-Za-z\x{{80}}-\x{{10FFFF}}])"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    raw = F.coalesce(F.col(text), F.lit(""))
    norm = F.concat(F.lit(" "), F.regexp_replace(F.translate(raw, _UPPER, _LOWER), _GAP, " "), F.lit(" "))
    read = docs.select(F.col(doc_id).alias("doc_id"), F.regexp_count(raw, F.lit(_WORD)).cast("long").alias("n_words"), F.when(raw.rlike(gate()), F.regexp_replace(norm, " +", " ")).alias("_norm"))

    def hits(norm: Column) -> Column:
        gated = F.filter(_table(), lambda r: F.contains(norm, r["keyword"]))
        of = lambda r: F.transform(_places(norm, r["pattern"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), r["priority"].alias("priority"), r["label"].alias("label"), r["sure"].alias("sure"), r["base"].alias("base")))
        return F.flatten(F.transform(gated, of))

    none = F.array().cast("array<struct<start:int,end:int,priority:int,label:string,sure:double,base:boolean>>")
    found = read.select("doc_id", "n_words", F.when(F.col("_norm").isNull(), none).otherwise(hits(F.col("_norm"))).alias("_hits"))
    inside = lambda h, g: (g["start"] <= h["start"]) & (g["end"] >= h["end"]) & ((g["end"] - g["start"] > h["end"] - h["start"]) | (g["priority"] < h["priority"]))
    split = found.select(
        "doc_id", "n_words",
        F.filter("_hits", lambda h: h["base"]).alias("_base"),
        F.filter("_hits", lambda h: ~h["base"] & ~F.exists("_hits", lambda g: ~g["base"] & inside(h, g))).alias("_left"),
    )
    names = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(c, lambda h: h["label"]) for c in cols)))), ",")
    starts = F.transform("_base", lambda h: h["start"])
    return split.select(
        "doc_id", "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        names("_base").alias("base_labels"),
        names("_base", "_left").alias("labels"),
        F.coalesce(F.array_max(F.transform(F.concat("_base", "_left"), lambda h: h["sure"])), F.lit(0.0)).alias("score"),
    )
