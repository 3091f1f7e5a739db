"""Normalization, word and gram sets, digit runs: all native but the NFKC step."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}_]+)"
DIGITS = r"(\p{Nd}+)"
WHITE = r"(?U)[\s\x{1C}-\x{1F}]+"


def unicode_form(text: Column, form: str = "NFKC") -> Column:
    """Unicode normal form.  ASCII rows come back as they are; the UDF skips them."""

    @F.pandas_udf("string")
    def convert(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return convert(text)


def normalize(text: Column, form: str | None = "NFKC", lowercase: bool = True) -> Column:
    """Null and empty to ``''``, normal form, lower case, white-space runs to one space, trimmed."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    t = unicode_form(t, form) if form else t
    t = F.lower(t) if lowercase else t
    return F.trim(F.regexp_replace(t, WHITE, " "))


def normalize_records(df: DataFrame, form: str | None = "NFKC", lowercase: bool = True) -> DataFrame:
    """Name, address and country; id and source stay."""
    return df.withColumns({c: normalize(F.col(c), form, lowercase) for c in ("business_name", "business_address", "country")})


def normalize_business_record(name: Column, address: Column, form: str = "NFKC") -> tuple[Column, Column]:
    return normalize(name, form), normalize(address, form)


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def token_list(text: Column) -> Column:
    """Lower-cased word runs, repeats kept."""
    return F.regexp_extract_all(F.lower(text_of(text)), F.lit(WORD), 1)


def token_set(text: Column) -> Column:
    return F.array_distinct(token_list(text))


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(token_list(text)), " ")


def sorted_token_set(text: Column) -> Column:
    return F.array_join(F.array_sort(token_set(text)), " ")


def padded(text: Column) -> Column:
    return F.concat(F.lit(" #"), F.lower(text_of(text)), F.lit("# "))


def windows(padded_text: Column, last: Column, n: int) -> Column:
    """The distinct first ``last`` windows.  Code points are split once and bound to a name; a
    substring or an unbound expression would start over for every window."""
    points = F.regexp_extract_all(padded_text, F.lit("(?s)."), 0)
    of = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.concat_ws("", *[F.get(c, i + k) for k in range(n)])))
    return F.transform(F.array(points), of)[0]


def gram_set(text: Column, n: int = 3) -> Column:
    """Character n-grams of `` #text# ``; of an empty text too."""
    p = padded(text)
    return F.when(F.length(p) < n, F.array(p)).otherwise(windows(p, F.greatest(F.length(p) - (n - 1), F.lit(1)), n))


def feature_gram_set(text: Column) -> Column:
    """The pair features' 3-grams: only the first ``max(1, length - 2)`` windows, none for an empty text."""
    t = text_of(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(windows(padded(t), F.greatest(F.lit(1), F.length(t) - 2), 3))


def digit_runs(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text_of(text), F.lit(DIGITS), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets without repeats; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def digits_shared(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def digit_overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """Jaccard and set equality of digit runs; both 0 if either side has none."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    j = jaccard(a, b)
    return j, F.when(some & (j == 1.0), 1.0).otherwise(0.0)


def length_difference(a: Column, b: Column) -> Column:
    x, y = F.length(text_of(a)), F.length(text_of(b))
    return F.abs(x - y) / F.greatest(F.lit(1), x, y)


def concat_text(name: Column, address: Column) -> Column:
    return F.concat_ws(" ", text_of(name), text_of(address))


def id_list(text: Column, trimmed: bool = True) -> Column:
    """A comma list; blanks drop out and entries are trimmed, or (validator form) neither."""
    parts = F.split(text_of(text), ",")
    if trimmed:
        return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.trim(text_of(text)) == "", F.array().cast("array<string>")).otherwise(parts)


def joined_ids(ids: Column) -> Column:
    """Distinct, sorted, comma-joined; empty for none."""
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(ids)), ","), F.lit(""))


def examples(items: Column, n: int = 5) -> Column:
    """First ``n`` in order, and how many there are when more."""
    ordered = F.array_sort(items)
    shown = F.array_join(F.slice(ordered, 1, n), ", ")
    return F.when(F.size(ordered) > n, F.concat(shown, F.lit(" ... ("), F.size(ordered).cast("string"), F.lit(" total)"))).otherwise(shown)
