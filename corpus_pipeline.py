"""The corpus pipeline: quality, language, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the
last return the columns of ``documents``.  :func:`run` writes each stage as Parquet in the
shared folder and reads it back for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import bpe, decontaminate, jaccard_join, language, packing, quality
from matchloom.llm.common import broadcast_if_small, staged, table, unstage
from matchloom.llm.queries import tokenizer_path

#: Documents below this quality score go.
QUALITY_FROM = 0.7
#: Documents whose language is unknown or hardly likelier than the next one go; short clean texts stay.
LANGUAGE_FROM = 0.55


def judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], keep: Column, added: tuple[str, ...]) -> DataFrame:
    """Rows of ``docs`` for which ``keep`` holds after ``judge`` added its columns; columns of ``docs`` with those names stay as they are."""
    own = docs.columns
    for c in added:
        if c in own:
            docs = docs.withColumnRenamed(c, f"__documents_{c}")
    return judge(docs).where(keep).select(*[F.col(f"__documents_{c}").alias(c) if c in added else F.col(c) for c in own])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches ``QUALITY_FROM``; null and empty texts are scored like any. Repeated rows are judged alike."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return judged(docs, lambda d: quality.score(d, model), F.col("quality_score") >= QUALITY_FROM, ("quality_score",))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that is clear; null texts, texts without a letter and, without any language in ``docs``, all go."""
    model = language.fit(docs, F.lit(True))
    sure = (F.col("lang_pred") != "und") & (F.col("lang_score") >= LANGUAGE_FROM)
    return judged(docs, lambda d: language.identify(d, model), sure, ("lang_pred", "lang_score"))


def without(docs: DataFrame, keys: DataFrame, how: str = "left_anti") -> DataFrame:
    """``docs`` without (or with only) the documents of a staged table (id, text_hash); texts move only if that table is large."""
    d, k = docs.alias("d"), broadcast_if_small(keys, keys.count(), 24).alias("k")
    return d.join(k, F.col("d.doc_id").eqNullSafe(F.col("k.id")) & (F.xxhash64(F.col("d.text")) == F.col("k.text_hash")), how)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the smallest id, of equal ids the smallest text hash, null ids last; of equal rows one.

    Documents without words are in no group and all stay, as do different texts of one id that are not near copies.
    """
    found = jaccard_join.jaccard_components(docs, words=5, num=80, den=100).where("component_key is not null")
    groups = staged(found.select(F.col("doc_id").alias("id"), "text_hash", "component_key"), "near-groups")
    order = F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("text_hash").alias("text_hash"))
    firsts = staged(groups.groupBy("component_key").agg(F.min(order).alias("first")).select("component_key", "first.id", "first.text_hash"), "near-firsts").alias("f")
    same = F.col("g.id").eqNullSafe(F.col("f.id")) & (F.col("g.text_hash") == F.col("f.text_hash"))
    members = groups.alias("g").join(broadcast_if_small(firsts, firsts.count(), 32), "component_key").select("g.id", "g.text_hash", same.alias("first"))
    named = staged(members.groupBy("id", "text_hash", "first").agg(F.count("*").alias("n")), "near-named")
    kept = without(docs, named.where("not first").select("id", "text_hash"))
    repeated = staged(named.where("first and n > 1").select("id", "text_hash"), "near-repeated")
    if repeated.isEmpty():
        return kept
    once = without(kept, repeated, "left_semi").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    once = once.groupBy("id", "h").agg(F.first("row").alias("row")).select("row.*")
    return without(kept, repeated).unionByName(once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window; null texts stay.  Documents of one id are judged by their own texts."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_text_hash=True)
    return without(docs, staged(found.where("contaminated").select(F.col("doc_id").alias("id"), "text_hash").distinct(), "dirty"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in sequences of 2,048 tokens; see :func:`matchloom.llm.packing.pack`."""
    return packing.pack(docs, tokenizer_path(), length=2048, room=bpe.SHARED)


STAGES = [
    ("quality classifier", quality_stage),
    ("language identification", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No SQL: trees and context trees are trained; see tests/llm for the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage-{k}")
        if before is not None:
            unstage(before)
        before = docs
    return docs
