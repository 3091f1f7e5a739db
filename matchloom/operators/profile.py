"""Language and script reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scripts as S
from ..functions import text as X


def sampled(df: DataFrame, per_file: int | None = 3000, seed: int = 42) -> DataFrame:
    """At most ``per_file`` rows of each ``file``, by hash rank; the rank limit prunes before the shuffle.  None keeps all rows."""
    if per_file is None:
        return df
    order = Window.partitionBy("file").orderBy(F.xxhash64(F.col("entity_id"), F.lit(seed)), "entity_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_file).drop("rank")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of non-null values, most frequent first."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def script_counts(df: DataFrame) -> DataFrame:
    """Records by script of name and address, once each; texts shorter than 3 are not scanned."""
    t = F.trim(X.concat_text(F.col("business_name"), F.col("business_address")))
    rows = df.select(t.alias("t")).where(F.length("t") >= 3).select(F.explode(S.unicode_scripts(F.col("t"))).alias("script"))
    return value_counts(rows, "script")


def language_counts(df: DataFrame, least: float = 0.6) -> DataFrame:
    t = F.trim(X.concat_text(F.col("business_name"), F.col("business_address")))
    rows = df.select(t.alias("t")).where(F.length("t") >= 3).select(F.explode(S.detect_languages(F.col("t"), least)).alias("lang"))
    return value_counts(rows, "lang")


def dataset_report(df: DataFrame, per_file: int | None = 3000, seed: int = 42) -> DataFrame:
    """Counts (kind, value, n) over the rows of a tree scan: all rows and files, then countries of all rows, and known
    scripts of at most ``per_file`` sampled rows of each file (None: of all rows)."""
    total = df.agg(F.count("*").alias("n")).select(F.lit("records").alias("kind"), F.lit("").alias("value"), "n")
    files = df.groupBy("file").agg(F.count("*").alias("n")).select(F.lit("file").alias("kind"), F.col("file").alias("value"), "n")
    countries = value_counts(df.where(F.trim("country") != ""), "country").select(F.lit("country").alias("kind"), "value", "n")
    some = script_counts(sampled(df, per_file, seed)).where(F.col("value").isin(*S.KNOWN)).select(F.lit("script").alias("kind"), "value", "n")
    return total.unionByName(files).unionByName(countries).unionByName(some)


def matched_scripts(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """True pairs whose two records exist, with their script sets and main scripts.  Only records in pairs are scanned."""
    wanted = pairs.select(F.col("s1_id").alias("entity_id")).unionByName(pairs.select(F.col("target_id").alias("entity_id"))).distinct()
    own = records.join(wanted, "entity_id", "left_semi")
    sets = own.select("entity_id", S.unicode_scripts(X.concat_text(F.col("business_name"), F.col("business_address")), "LATIN").alias("scripts"))
    both = pairs.join(sets.withColumnsRenamed({"entity_id": "s1_id", "scripts": "a"}), "s1_id").join(sets.withColumnsRenamed({"entity_id": "target_id", "scripts": "b"}), "target_id")
    return both.select("s1_id", "target_id", "a", "b", S.main_script(F.col("a")).alias("main_a"), S.main_script(F.col("b")).alias("main_b"))


def script_statistics(matched: DataFrame) -> DataFrame:
    """One row: pairs, any difference, different main script, same main script, and shares (null without pairs)."""
    any_ = (F.col("a") != F.col("b")).cast("int")
    main = ((F.col("a") != F.col("b")) & (F.col("main_a") != F.col("main_b"))).cast("int")
    sums = matched.agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum(any_), F.lit(0)).alias("any_difference"), F.coalesce(F.sum(main), F.lit(0)).alias("main_difference"))
    share = lambda c: F.try_divide(F.col(c) * 100.0, F.col("n_pairs")).alias(f"{c}_percent")
    return sums.withColumn("same_main", F.col("n_pairs") - F.col("main_difference")).select("*", share("any_difference"), share("main_difference"), share("same_main"))


def script_mismatches(matched: DataFrame) -> DataFrame:
    rows = matched.where("a <> b and main_a <> main_b").select(F.concat(F.least("main_a", "main_b"), F.lit("-"), F.greatest("main_a", "main_b")).alias("pair"))
    return rows.groupBy("pair").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair")
