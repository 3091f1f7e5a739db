"""Benchmark decontamination by winnowing.

Words are runs of digits, letters and all non-ASCII characters, with A-Z lower-cased.  Both
sides are cut into k-grams; in every ``span - k + 1`` consecutive k-grams the smallest hash
is kept.  Two texts that share ``span`` words share that many k-grams in a row, hence a kept
hash, so no such span is missed.  Documents that share a kept hash are extended around the
places of the shared hashes: there, every window of ``span`` words is compared with the
items' windows, word by word.  Items shorter than ``span`` words count as one window; they
are found by hashes of all document windows of their own lengths.

Null texts have no words and no hits.  Texts and items without words match nothing.
Repeated documents are judged alike (rows are kept apart by ``key``), items with equal
texts all count.  Empty tables give no rows or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything below U+0080 that is neither digit nor lower-case letter (upper case is folded before).
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; null gives an empty array."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() is many times faster and the same where every character is ASCII.
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(folded, GAP), "")


def grams(w: Column, k: int) -> Column:
    """Hashes of all k-grams; an empty array for fewer than ``k`` words."""
    starts = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def winnowed(h: Column, window: int) -> Column:
    """The distinct hashes that are smallest in some ``window`` consecutive ones; ``h`` must be a stored column, as every window reads it."""
    starts = F.when(F.size(h) >= window, F.sequence(F.lit(1), F.size(h) - window + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(h, i, window))))


def marked(hashes: Column, gram: int) -> Column:
    return F.transform(hashes, lambda h: F.struct(F.lit(gram).alias("gram"), h.alias("h")))


def hashes_of(marks: str, gram: int) -> Column:
    return F.transform(F.filter(marks, lambda s: s["gram"] == gram), lambda s: s["h"])


def spots(hashes: Column, wanted: Column) -> Column:
    """Places of ``hashes`` (a stored column) that are in ``wanted``."""
    return F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(wanted, h), i)), lambda i: i.isNotNull())


def placed(starts: Column, size: int) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.array_join(F.slice("w", i + 1, size), " ").alias("window")))


def find_overlaps(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text_column: str = "text", item_key: str = "item_id", item_text: str = "text", span: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Where documents hold benchmark windows.

    Returns the hits (key, at, size, window: the words joined by spaces), one row per place,
    and the windows of the items (window, item_key).
    """
    if not 1 <= k <= span:
        raise ValueError("k must be between 1 and span")
    d = docs.select(F.col(key).alias("key"), F.col(text_column).alias("text"))
    item_words = staged(items.select(F.col(item_key).cast("string").alias("item"), words(F.col(item_text)).alias("w")).where(F.size("w") > 0), "bench-words")
    long_items, short_items = item_words.where(F.size("w") >= span), item_words.where(F.size("w") < span)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - span + 1, F.lit(1)))
    windows = item_words.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, span), " "))).alias("window"), F.least(F.size("w"), F.lit(span)).alias("size")).distinct()
    windows = staged(windows, "bench-windows")
    lengths = sorted(r[0] for r in short_items.select(F.size("w").alias("n")).distinct().collect())  # fewer than ``span`` values

    # 1. Documents that share a kept hash, and the hashes they share.
    window = span - k + 1
    long_grams = staged(long_items.select(grams(F.col("w"), k).alias("g")), "bench-grams")
    marks = [long_grams.select(F.lit(k).alias("gram"), F.explode(winnowed(F.col("g"), window)).alias("h"))]
    marks += [short_items.where(F.size("w") == n).select(F.lit(n).alias("gram"), F.explode(grams(F.col("w"), n)).alias("h")) for n in lengths]
    marks_all = marks[0]
    for m in marks[1:]:
        marks_all = marks_all.unionByName(m)
    # A shared span has the same k-grams on both sides, so both keep the hash that is smallest in it.
    bench = staged(marks_all.distinct(), "bench-marks")
    n_marks = bench.count()
    w = words(F.col("text"))
    base = d.select("key", w.alias("w")).withColumn("g", grams(F.col("w"), k))
    kept = marked(winnowed(F.col("g"), window), k)
    for n in lengths:
        kept = F.concat(kept, marked(F.array_distinct(grams(F.col("w"), n)), n))
    prints = base.select("key", F.explode(kept).alias("p")).select("key", "p.gram", "p.h")
    shared = prints.join(broadcast_if_small(bench, n_marks, 16), ["gram", "h"], "left_semi").groupBy("key").agg(F.collect_set(F.struct("gram", "h")).alias("shared"))
    shared = staged(shared, "bench-shared")

    # 2. Extend: windows that start up to ``span - k`` words before a shared hash, checked by their words.
    n_shared = shared.agg(F.coalesce(F.sum(F.size("shared") + 4), F.lit(0))).first()[0]
    again = d.join(broadcast_if_small(shared, n_shared, 24), "key").select("key", words(F.col("text")).alias("w"), "shared")
    spread = again.select("key", "w", hashes_of("shared", k).alias("long"), "shared")
    hashes = spread.select("key", "w", "shared", "long", grams(F.col("w"), k).alias("g"))
    near = F.flatten(F.transform(spots(F.col("g"), F.col("long")), lambda i: F.sequence(F.greatest(i - (span - k), F.lit(0)), i)))
    places = placed(F.filter(F.array_distinct(near), lambda i: i + span <= F.size("w")), span)
    for n in lengths:
        hashes = hashes.withColumns({f"g{n}": grams(F.col("w"), n), f"own{n}": hashes_of("shared", n)})
        places = F.concat(places, placed(spots(F.col(f"g{n}"), F.col(f"own{n}")), n))
    tried = hashes.select("key", F.explode(places).alias("p")).select("key", "p.at", "p.size", "p.window")
    known = windows.select("window", "size").distinct()
    n_bytes = windows.agg(F.coalesce(F.sum(F.octet_length("window") + 32), F.lit(0))).first()[0]
    return tried.join(broadcast_if_small(known, n_bytes, 1), ["window", "size"], "left_semi"), windows


def decontaminate(docs: DataFrame, items: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_key: str = "item_id", item_text: str = "text", span: int = 10, k: int = 5, keep_text_hash: bool = False) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated and, if asked for, text_hash.

    Documents with the same id are told apart by their text; equal rows share one result.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_column).alias("_id"), text.alias("text"), F.xxhash64(F.col(text_column).cast("string")).alias("text_hash"), F.concat_ws(":", F.col(id_column).cast("string"), F.xxhash64(text).cast("string")).alias("key"))
    hits, windows = find_overlaps(slim, items, key="key", text_column="text", item_key=item_key, item_text=item_text, span=span, k=k)
    hits = staged(hits.distinct(), "bench-hits")
    covered = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("at", "size"))).alias("at"))
    # Count the union of the windows: what each adds past the farthest end so far.
    union = F.aggregate("at", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda s, x: F.struct(F.greatest(s["end"], x["at"] + x["size"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(s["end"], x["at"]))).alias("n")), lambda s: s["n"])
    found = hits.select("key", "window", "size").distinct().join(windows, ["window", "size"]).select("key", "item").distinct()
    listed = found.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    result = staged(covered.select("key", union.alias("n_hit")).join(listed, "key").select("key", "n_hit", F.size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "bench-result")
    rows = slim.select("_id", "text_hash", "key", F.size(words(F.col("text"))).alias("n_words"))
    joined = rows.join(broadcast_if_small(result, result.count(), 200), "key", "left")
    return joined.select(
        F.col("_id").alias(id_column), F.col("n_words").cast("long").alias("n_words"), F.coalesce(F.col("n_hit"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.col("n_items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), *(["text_hash"] if keep_text_hash else []),
    )
