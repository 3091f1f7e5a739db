"""Scripts of a text, and transliteration of nine Indic scripts to ITRANS.

The nine blocks share one layout (offset from the block's start names the letter), so one
table with a few exceptions serves all of them.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First code point of each script's block.
BLOCKS = {"DEVANAGARI": 0x900, "BENGALI": 0x980, "GURMUKHI": 0xA00, "GUJARATI": 0xA80, "ORIYA": 0xB00, "TAMIL": 0xB80, "TELUGU": 0xC00, "KANNADA": 0xC80, "MALAYALAM": 0xD00}
# Further ranges of the same scripts.
EXTRA = {"DEVANAGARI": "\\x{A8E0}-\\x{A8FF}\\x{11B00}-\\x{11B09}", "TAMIL": "\\x{11FC0}-\\x{11FFF}"}
# ITRANS by offset from the block's start.
VOWELS = dict(zip(range(0x05, 0x15), "a A i I u U RRi LLi e è e ai o ò o au".split()))
CONSONANTS = dict(zip(range(0x15, 0x3A), "k kh g gh ~N ch Ch j jh ~n T Th D Dh N t th d dh n n p ph b bh m y r R l L zh v sh Sh s h".split())) | dict(zip(range(0x58, 0x60), "q K G z .D .Dh f Y".split()))
SIGNS = dict(zip(range(0x3E, 0x4D), "A i I u U RRi RRI e è e ai o ò o au".split()))
MARKS = {0x01: ".N", 0x02: "M", 0x03: "H", 0x3D: ".a", 0x50: "OM", 0x60: "RRI", 0x61: "LLI", 0x64: "|", 0x65: "||"} | {0x66 + d: str(d) for d in range(10)}
VIRAMA = 0x4D
# Letters that differ in one script.
EXCEPTIONS = {("TAMIL", 0x15): "gh"}
# Scripts that the dataset report names.
KNOWN = ("LATIN", *BLOCKS)
INDIC = "[\\x{900}-\\x{D7F}" + "".join(EXTRA.values()) + "]"


def script_range(name: str) -> str:
    start = BLOCKS[name]
    return f"\\x{{{start:X}}}-\\x{{{start + 0x7F:X}}}" + EXTRA.get(name, "")


def detect_indic_scripts(text: Column) -> Column:
    """Distinct Indic scripts in order of first appearance."""
    t = F.coalesce(text, F.lit(""))
    spots = [F.struct(F.length(F.regexp_extract(t, f"(?s)^([^{script_range(s)}]*)", 1)).alias("at"), F.lit(s).alias("name")) for s in BLOCKS]
    return F.transform(F.filter(F.array_sort(F.array(*spots)), lambda x: x["at"] < F.length(t)), lambda x: x["name"])


def detect_primary_script(text: Column) -> Column:
    """The Indic script with most characters, ties to the first seen; null if none."""
    t = F.coalesce(text, F.lit(""))
    rows = [
        F.struct(F.length(F.regexp_replace(t, f"[^{script_range(s)}]", "")).alias("n"), (-F.length(F.regexp_extract(t, f"(?s)^([^{script_range(s)}]*)", 1))).alias("first"), F.lit(s).alias("name"))
        for s in BLOCKS
    ]
    best = F.array_max(F.array(*rows))
    return F.when(best["n"] > 0, best["name"])


def to_itrans(text: str | None) -> str:
    """One pass; characters outside the nine blocks stay."""
    if not text:
        return ""
    out: list[str] = []
    for i, c in enumerate(text):
        point = ord(c)
        if not 0x900 <= point < 0xD80:
            out.append(c)
            continue
        name = next(s for s, b in BLOCKS.items() if b <= point < b + 0x80)
        k = point - BLOCKS[name]
        if k in CONSONANTS:
            follow = ord(text[i + 1]) - BLOCKS[name] if i + 1 < len(text) else -1
            out.append(EXCEPTIONS.get((name, k), CONSONANTS[k]) + ("" if follow in SIGNS or follow == VIRAMA else "a"))
        elif k != VIRAMA:
            out.append(VOWELS.get(k) or SIGNS.get(k) or MARKS.get(k) or c)
    return "".join(out)


def transliterate(text: Column) -> Column:
    """Null to ``''``; texts without Indic characters unchanged, and skipped by the UDF."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t.isascii() else to_itrans(t))

    return run(F.coalesce(text, F.lit("")))


def transliterate_records(df: DataFrame) -> DataFrame:
    """Name and address; country stays."""
    return df.withColumns({c: transliterate(F.col(c)) for c in ("business_name", "business_address")})


def unicode_scripts(text: Column, default: str | None = None) -> Column:
    """Sorted first words of the Unicode names of a text's letters; without letters ``[default]`` or empty."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        def of(t: str) -> list[str]:
            found = {"LATIN"} if t.isascii() and any(map(str.isalpha, t)) else {unicodedata.name(c, "UNKNOWN").split(" ")[0] for c in set(t) if c.isalpha()}
            return sorted(found) or ([default] if default else [])

        return s.map(of)

    return run(F.coalesce(text, F.lit("")))


def main_script(scripts: Column) -> Column:
    """Alphabetically first script that is not Latin, else Latin."""
    return F.coalesce(F.array_min(F.filter(scripts, lambda s: s != "LATIN")), F.lit("LATIN"))


def script_pair(a: Column, b: Column) -> Column:
    x, y = main_script(a), main_script(b)
    return F.concat(F.least(x, y), F.lit("-"), F.greatest(x, y))


def detect_languages(text: Column, least: float = 0.6) -> Column:
    """Languages with probability above ``least``; needs the optional ``langdetect`` package."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        import langdetect

        langdetect.DetectorFactory.seed = 0

        def of(t: str) -> list[str]:
            try:
                return [x.lang for x in langdetect.detect_langs(t) if x.prob > least]
            except langdetect.LangDetectException:
                return []

        return s.map(of)

    return run(F.coalesce(text, F.lit("")))
