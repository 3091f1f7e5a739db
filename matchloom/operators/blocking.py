"""Candidate pairs: country blocking, blocking score, per-source top-k.

The country test reads two country strings only, so it is made once for each pair of
distinct countries; records then meet by country rather than in a nested loop.  Token, gram
and digit sets are made once per record, as 64-bit hashes.  The records of two countries are
dealt into blocks, and two blocks are scored in one task: the sizes of all intersections are
products of 0/1 matrices over the elements that both blocks hold.  So a country with a third
of all records is many tasks, and of a block's pairs only the ``k`` best of each record leave.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

DIGIT_BONUS = 0.15
PROFILE = ("name_tokens", "addr_tokens", "name_grams", "addr_grams", "digits")
#: Records of the two sides in a block, and elements of a matrix product at once.
LEFT_BLOCK, RIGHT_BLOCK, WIDTH = 1024, 2048, 2048
#: Entries of posting lists that are added up at once.
POSTINGS = 4_000_000
UNIT = ("grp", "c1", "c2", "lb", "rb")


def country_key(country: Column) -> Column:
    return F.lower(F.trim(X.text_of(country)))


def country_compatible(a: Column, b: Column) -> Column:
    """Of trimmed, lower-cased countries: either open, equal, or one inside the other."""
    is_open = lambda c: (c == "") | (c == "unknown")
    return is_open(a) | is_open(b) | (a == b) | F.contains(a, b) | F.contains(b, a)


def profiled(df: DataFrame) -> DataFrame:
    name, addr = F.col("business_name"), F.col("business_address")
    sets = {"name_tokens": X.token_set(name), "addr_tokens": X.token_set(addr), "name_grams": X.gram_set(name), "addr_grams": X.gram_set(addr), "digits": X.digit_runs(addr)}
    return df.withColumns(sets | {"ckey": country_key(F.col("country"))})


def blocking_score(left: str, right: str) -> Column:
    """Best of four set similarities, and a bonus for a shared digit run."""
    both = [X.jaccard(F.col(f"{left}.{c}"), F.col(f"{right}.{c}")) for c in PROFILE[:4]]
    return F.greatest(*both) + F.when(X.digits_shared(F.col(f"{left}.digits"), F.col(f"{right}.digits")), F.lit(DIGIT_BONUS)).otherwise(F.lit(0.0))


def all_targets(*targets: DataFrame) -> DataFrame:
    """Bag of target sources with their group: S2 and S3 where any id has such a prefix (others drop out), else all in one group."""
    out = targets[0]
    for t in targets[1:]:
        out = out.unionByName(t)
    group = F.when(F.col("entity_id").startswith("S2-"), "S2").when(F.col("entity_id").startswith("S3-"), "S3")
    known = out.withColumn("grp", group)
    has_prefix = not known.where(F.col("grp").isNotNull()).isEmpty()
    return known.where(F.col("grp").isNotNull()) if has_prefix else known.withColumn("grp", F.lit("all"))


def routes_of(s1: DataFrame, targets: DataFrame, block_by_country: bool = True) -> DataFrame:
    """Pairs of countries whose records meet (c1, c2, grp), with the fallback: a country that fits no target country of
    a group meets the whole group."""
    groups = targets.select(F.col("ckey").alias("c2"), "grp").distinct()
    countries = s1.select(F.col("ckey").alias("c1")).distinct()
    if not block_by_country:
        return countries.join(groups, F.lit(True))  # distinct countries, not records
    fit = countries.join(groups, country_compatible(F.col("c1"), F.col("c2")))
    alone = countries.join(groups.select("grp").distinct(), F.lit(True)).join(fit.select("c1", "grp").distinct(), ["c1", "grp"], "left_anti")
    return fit.select("c1", "c2", "grp").unionByName(alone.join(groups, "grp").select("c1", "c2", "grp"))


def blocked_pairs(s1: DataFrame, targets: DataFrame, block_by_country: bool = True) -> DataFrame:
    """Pairs (l, r, grp) of profiled records that blocking lets through, whole records side by side."""
    l = s1.select("ckey", F.struct(*[c for c in s1.columns if c != "ckey"]).alias("l"))
    r = targets.select(F.col("ckey").alias("c2"), "grp", F.struct(*[c for c in targets.columns if c not in ("ckey", "grp")]).alias("r"))
    return l.join(routes_of(s1, targets, block_by_country), F.col("ckey") == F.col("c1")).join(r, ["c2", "grp"]).select("l", "r", "grp")


def pair_counts(s1: DataFrame, targets: DataFrame, block_by_country: bool = True) -> DataFrame:
    """(s1_id, grp, n_pairs): how many pairs of :func:`blocked_pairs` each S1 id has in a group.  Targets are counted by
    country and the counts meet the records, so no pair is made."""
    sizes = targets.groupBy(F.col("ckey").alias("c2"), "grp").agg(F.count("*").alias("n"))
    met = routes_of(s1, targets, block_by_country).join(sizes, ["c2", "grp"]).groupBy("c1", "grp").agg(F.sum("n").alias("n"))
    return s1.select(F.col("entity_id").alias("s1_id"), F.col("ckey").alias("c1")).join(met, "c1").groupBy("s1_id", "grp").agg(F.sum("n").alias("n_pairs"))


def text_key(name: str = "business_name", address: str = "business_address", country: Column | None = None) -> Column:
    """Equal for records whose texts are equal (null as empty); by default of countries their key counts."""
    n, a = X.text_of(F.col(name)), X.text_of(F.col(address))
    return F.md5(F.concat(F.length(n).cast("string"), F.lit(":"), F.length(a).cast("string"), F.lit(":"), n, a, country_key(F.col("country")) if country is None else country))


def distinct_texts(df: DataFrame, *by: str) -> DataFrame:
    """One row for the records of equal texts (and ``by``): the first of them by order, its id followed by the texts' key, and their number ``n``."""
    keyed = df.withColumn("key", text_key())
    first = F.min(F.struct("ord", "entity_id")).alias("first")
    one = keyed.groupBy("key", *by).agg(first, F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("business_name", "business_address", "country")])
    ident = F.concat(F.coalesce("first.entity_id", F.lit("")), F.lit("\0"), F.col("key"))
    return one.select(ident.alias("entity_id"), F.col("first.ord").alias("ord"), "business_name", "business_address", "country", "n", *by)


SCORED = "s1_id string, target_id string, grp string, score double, l_ord long, r_ord long"
SUMMED = "grp string, n_pairs long, sum_score double, max_score double"


def blocks(s1: DataFrame, targets: DataFrame, block_by_country: bool = True) -> DataFrame:
    """The records of both sides once for each block pair they are in; a block pair's rows follow each other in one task, sides apart, in order."""
    routes = routes_of(s1, targets, block_by_country)
    left_blocks = s1.groupBy(F.col("ckey").alias("c1")).agg(F.ceil(F.count("*") / LEFT_BLOCK).cast("int").alias("nl"))
    right_blocks = targets.groupBy(F.col("ckey").alias("c2"), "grp").agg(F.ceil(F.count("*") / RIGHT_BLOCK).cast("int").alias("nr"))
    routes = routes.join(left_blocks, "c1").join(right_blocks, ["c2", "grp"])
    sets = [F.transform(c, lambda t: F.xxhash64(t)).alias(f"s{i}") for i, c in enumerate(PROFILE)]
    own = lambda n: F.pmod("h", F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    number = lambda df: (F.col("n") if "n" in df.columns else F.lit(1)).cast("long").alias("n")
    record = [F.col("entity_id").alias("id"), F.col("ord").cast("long").alias("ord"), F.xxhash64("entity_id", "ord").alias("h")]
    l = s1.select(F.col("ckey").alias("c1"), *record, number(s1), *sets).join(routes, "c1").withColumn("lb", own("nl")).withColumn("rb", every("nr")).withColumn("side", F.lit(0))
    r = targets.select(F.col("ckey").alias("c2"), "grp", *record, number(targets), *sets).join(routes, ["c2", "grp"]).withColumn("rb", own("nr")).withColumn("lb", every("nl")).withColumn("side", F.lit(1))
    columns = [*UNIT, "side", "id", "ord", "n", *(f"s{i}" for i in range(len(PROFILE)))]
    return l.select(columns).unionByName(r.select(columns)).repartition(*UNIT).sortWithinPartitions(*UNIT, "side", F.col("ord").asc_nulls_first(), "id")


def by_block(rows: DataFrame, score: Callable[[str, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``score`` makes of each block pair's group and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(UNIT)))))
            at = 0
            while at < len(keys):
                stop = at + 1
                while stop < len(keys) and keys[stop] == keys[at]:
                    stop += 1
                if keys[at] != now:
                    if held:
                        yield from score(now[0], pa.Table.from_batches(held))
                    held, now = [], keys[at]
                held.append(batch.slice(at, stop - at))
                at = stop
        if held:
            yield from score(now[0], pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)


def scored_pairs(s1: DataFrame, targets: DataFrame, k: int | None = None, block_by_country: bool = True, mode: str = "exact") -> DataFrame:
    """Blocking scores of all pairs that blocking lets through; with ``k`` at least the best ``k`` of each S1 record and group.
    ``indexed``: of the pairs that meet in an inverted index."""
    return by_block(blocks(s1, targets, block_by_country), lambda group, rows: block_scores(group, rows, k, mode), SCORED)


def score_summary(s1: DataFrame, targets: DataFrame, block_by_country: bool = True) -> DataFrame:
    """(grp, n_pairs, sum_score, max_score) over the scores of all pairs that blocking lets through.  Records of equal
    texts score alike: each pair of texts is scored once and counts for all its pairs of records."""
    parts = by_block(blocks(profiled(distinct_texts(s1)), profiled(distinct_texts(targets, "grp")), block_by_country), block_summary, SUMMED)
    return parts.groupBy("grp").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("sum_score").alias("sum_score"), F.max("max_score").alias("max_score"))


def block_summary(group: str, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """One row: how many pairs of records a block pair stands for, their scores' sum and maximum."""
    rows = rows.combine_chunks()
    n = int((rows.column("side").to_numpy() == 0).sum())
    if not n or n == len(rows):
        return
    score, _ = scores_of(rows, n)
    number = rows.column("n").to_numpy()
    left, right = number[:n], number[n:]
    total = math.fsum((score @ right.astype(np.float64)) * left)
    yield pa.RecordBatch.from_arrays([pa.array([group], pa.string()), pa.array([int(left.sum()) * int(right.sum())]), pa.array([total]), pa.array([float(score.max())])], ["grp", "n_pairs", "sum_score", "max_score"])


def scores_of(rows: pa.Table, n: int, mode: str = "exact") -> tuple[np.ndarray, np.ndarray | None]:
    """Scores between the first ``n`` rows and the others, and (``indexed``) which of the pairs meet in the index."""
    m = len(rows) - n
    score, met = np.zeros((n, m)), np.zeros((n, m), bool) if mode == "indexed" else None
    for i, _ in enumerate(PROFILE):
        lists = rows.column(f"s{i}").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(lists.offsets.to_numpy())
        owner, value = np.repeat(np.arange(n + m), sizes), lists.flatten().to_numpy(zero_copy_only=False)
        common = shared(owner, value, n, m) if met is None else posted(owner, value, n, m)
        if met is not None:
            met |= common > 0
        if i < 4:
            union = sizes[:n, None] + sizes[None, n:] - common
            np.maximum(score, common / np.maximum(union, 1), out=score)
        else:
            score += np.where(common > 0, DIGIT_BONUS, 0.0)
    return score, met


def posted(owner: np.ndarray, value: np.ndarray, n: int, m: int) -> np.ndarray:
    """As :func:`shared`, by an inverted index: the elements of the ``m`` sets have lists of their owners, and each
    element of the first ``n`` sets adds one for every owner on its list."""
    first = owner < n
    order = np.argsort(value[~first], kind="stable")
    keys, holders = value[~first][order], owner[~first][order] - n
    low, high = np.searchsorted(keys, value[first], "left"), np.searchsorted(keys, value[first], "right")
    asks, length = owner[first].astype(np.int64), high - low
    out = np.zeros(n * m, np.int64)
    ends = np.cumsum(length)
    at = 0
    while at < len(asks):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POSTINGS, "right")))
        some = length[at:stop]
        begin = np.repeat(low[at:stop] - (np.cumsum(some) - some), some)
        hit = holders[begin + np.arange(int(some.sum()))]
        a, b = int(asks[at]), int(asks[stop - 1]) + 1
        out[a * m : b * m] += np.bincount((np.repeat(asks[at:stop], some) - a) * m + hit, minlength=(b - a) * m)
        at = stop
    return out.reshape(n, m)


def block_scores(group: str, rows: pa.Table, k: int | None, mode: str = "exact") -> Iterator[pa.RecordBatch]:
    """Scores between the two sides of ``rows``; targets stand in the order that breaks ties."""
    rows = rows.combine_chunks()
    n = int((rows.column("side").to_numpy() == 0).sum())
    m = len(rows) - n
    if not n or not m:
        return
    score, met = scores_of(rows, n, mode)
    ids, ords = rows.column("id").combine_chunks(), rows.column("ord").combine_chunks()
    step = max(1, 200_000 // min(m, k or m))
    for at in range(0, n, step):
        part = score[at : at + step]
        p = np.repeat(np.arange(len(part)), min(m, k or m))
        q = np.argsort(-part, axis=1, kind="stable")[:, :k].ravel() if k and k < m else np.tile(np.arange(m), len(part))
        if met is not None:  # a pair that does not meet scores 0 and stands after all that do
            p, q = p[met[at + p, q]], q[met[at + p, q]]
        left, right = pa.array(p + at), pa.array(q + n)
        yield pa.RecordBatch.from_arrays([ids.take(left), ids.take(right), pa.array([group] * len(p), pa.string()), pa.array(part[p, q]), ords.take(left), ords.take(right)], ["s1_id", "target_id", "grp", "score", "l_ord", "r_ord"])


def shared(owner: np.ndarray, value: np.ndarray, n: int, m: int) -> np.ndarray:
    """Sizes of the intersections of the first ``n`` sets with the ``m`` others."""
    first = owner < n
    both = np.intersect1d(value[first], value[~first])
    out = np.zeros((n, m), np.float32)
    for low in range(0, len(both), WIDTH):
        some = both[low : low + WIDTH]
        at = np.minimum(np.searchsorted(some, value), len(some) - 1)
        hit = some[at] == value
        matrix = np.zeros((n + m, len(some)), np.float32)
        matrix[owner[hit], at[hit]] = 1.0
        out += matrix[:n] @ matrix[n:].T
    return out.astype(np.int64)


def ranked(scored: DataFrame, k: int, key: str = "s1_id") -> DataFrame:
    """The ``k`` best of each S1 record (or other ``key``) and group; ties in target order.  The rank limit prunes before the shuffle."""
    order = Window.partitionBy(key, "grp").orderBy(F.desc("score"), "r_ord", "target_id")
    return scored.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def generate_candidates(s1: DataFrame, *targets: DataFrame, k: int = 50, block_by_country: bool = True, mode: str = "exact") -> DataFrame:
    """Candidate pairs (s1_id, target_id, grp, score, rn, l_ord, r_ord).

    ``exact`` scores every pair that blocking lets through.  ``indexed`` meets records through
    an inverted index of tokens, grams and digit runs and finds all pairs with a score above 0;
    filler pairs of score 0 that ``exact`` adds to reach ``k`` are left out.  Records of equal
    texts are scored once, and the lists of the texts are dealt to their records.
    """
    k = k or 50
    targets = all_targets(*targets)
    left, right = profiled(distinct_texts(s1)), profiled(distinct_texts(targets, "grp"))
    best = ranked(scored_pairs(left, right, k, block_by_country, mode), k).select(F.right("s1_id", F.lit(32)).alias("l_key"), F.right("target_id", F.lit(32)).alias("r_key"), "grp", "score")
    # The k best records of a text are among the first k of each of its k best texts.
    order = Window.partitionBy("r_key", "grp").orderBy("r_ord", "target_id")
    firsts = targets.select(text_key().alias("r_key"), "grp", F.col("entity_id").alias("target_id"), F.col("ord").cast("long").alias("r_ord"))
    firsts = firsts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")
    lists = ranked(best.join(firsts, ["r_key", "grp"]), k, "l_key")
    own = s1.select(F.col("entity_id").alias("s1_id"), F.col("ord").cast("long").alias("l_ord"), text_key().alias("l_key"))
    out = own.join(lists, "l_key").select("s1_id", "target_id", "grp", "score", "rn", "l_ord", "r_ord")
    repeated = not s1.groupBy("entity_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return ranked(out.drop("rn"), k).select(*out.columns) if repeated else out
