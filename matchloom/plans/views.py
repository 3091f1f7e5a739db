"""A record view over the ``part`` table: three sources, countries that contain one another, dense ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocking, features


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, lonely: bool = False) -> DataFrame:
    """``lonely`` gives one brand a country of its own in every source, so that nothing fits it."""
    n = (F.col("p_partkey") % 3 + 1).cast("string")
    country = F.when(F.col("p_brand") == "Brand#13", F.concat(F.lit("only-"), n)).otherwise(F.col("p_brand")) if lonely else F.col("p_brand")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("S"), n, F.lit("-"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_name").alias("business_name"),
        F.concat_ws(" ", F.col("p_size").cast("string"), "p_type", "p_brand").alias("business_address"), country.alias("country"), F.concat(F.lit("source"), n).alias("source"), F.col("p_partkey").alias("ord"),
    )


def sides(spark: SparkSession, sf_dir: str, lonely: bool = False) -> tuple[DataFrame, DataFrame]:
    r = records(spark, sf_dir, lonely)
    return r.where("source = 'source1'"), r.where("source <> 'source1'")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same name and brand across sources."""
    s1, t = sides(spark, sf_dir)
    left = s1.select(F.col("entity_id").alias("s1_id"), "business_name", "country")
    return left.join(t.select(F.col("entity_id").alias("target_id"), "business_name", "country"), ["business_name", "country"]).select("s1_id", "target_id")


def truth_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """:func:`truth` as classes: (s1_id, class) and (target_id, class), null without a name or brand."""
    same = F.when(F.col("business_name").isNotNull() & F.col("country").isNotNull(), F.struct("business_name", "country")).alias("class")
    s1, t = sides(spark, sf_dir)
    return s1.select(F.col("entity_id").alias("s1_id"), same), t.select(F.col("entity_id").alias("target_id"), same)


def candidates(spark: SparkSession, sf_dir: str, k: int = 10, mode: str = "exact", lonely: bool = False) -> DataFrame:
    s1, t = sides(spark, sf_dir, lonely)
    return blocking.generate_candidates(s1, t, k=k, mode=mode)


def pair_features(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    s1, t = sides(spark, sf_dir)
    return features.extract_features(blocking.generate_candidates(s1, t, k=k), s1, t)
