"""The three entry points: train, infer, evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scripts, text
from ..operators import blocking, features, matching, metrics
from ..sources import sinks, tsv


def prepare(df: DataFrame, form: str = "NFKC") -> DataFrame:
    """Normalize, then transliterate, so that ITRANS capitals survive."""
    return scripts.transliterate_records(text.normalize_records(df, form))


def setting(config: dict, *path: str, default=None):
    for key in path:
        config = config.get(key) if isinstance(config, dict) else None
        if config is None:
            return default
    return config


def as_config(config: dict | str | None) -> dict:
    return tsv.load_config(config) if isinstance(config, str) else config or {}


def candidates_with_features(s1: DataFrame, s2: DataFrame, s3: DataFrame, k: int, mode: str = "exact") -> DataFrame:
    targets = s2.unionByName(s3)
    pairs = blocking.generate_candidates(s1, targets, k=k, mode=mode)
    return features.extract_features(pairs, s1, targets)


def truth_keys(truth: DataFrame) -> DataFrame:
    return truth.select("s1_id").distinct()


def run_training_pipeline(spark: SparkSession, config: dict | str | None = None, matcher: matching.EntityMatcher | None = None) -> dict:
    """Load, block, label, fit, tune and measure on the training split; saves the matcher if a path is set.

    Training and tuning use the same pairs unless ``model.holdout`` gives a share to tune on.
    """
    cfg = as_config(config)
    loader = tsv.DatasetLoader(spark, setting(cfg, "paths", "train_dir", default=setting(cfg, "data", "train_dir", default="data/train")))
    s1, s2, s3 = loader.load_sources()
    gt = loader.load_ground_truth()
    form = setting(cfg, "preprocessing", "unicode_form", default="NFKC")
    s1, s2, s3 = (prepare(x, form).cache() for x in (s1, s2, s3))
    k = int(setting(cfg, "blocking", "max_candidates_per_s1", default=100))
    pairs = candidates_with_features(s1, s2, s3, k, setting(cfg, "blocking", "mode", default="exact"))
    truth = tsv.truth_pairs(gt).cache()
    labelled = matching.label_pairs(pairs, truth).cache()
    matcher = matcher or matching.EntityMatcher(float(setting(cfg, "model", "threshold", default=0.5)))
    share = float(setting(cfg, "model", "holdout", default=0.0))
    fold = F.pmod(F.xxhash64("s1_id"), F.lit(1000)) < int(share * 1000)
    matcher.fit(labelled.where(~fold) if share else labelled)
    scored = matcher.predict_pairs(labelled).cache()
    tuned = scored.where(fold) if share else scored
    matcher.optimize_threshold(tuned, truth, gt.where(F.pmod(F.xxhash64("s1_id"), F.lit(1000)) < int(share * 1000)) if share else gt)
    clusters = matching.predict_clusters(s1, scored, matcher.threshold).cache()
    found = matching.pairs_of_clusters(clusters)
    out = metrics.macro_f05(found, truth, clusters, gt).first().asDict()
    out["blocking_recall"] = metrics.blocking_recall(scored, truth).first().blocking_recall
    out["best_threshold"] = matcher.threshold
    out |= {"num_candidates": scored.count(), "num_predictions": clusters.count()}
    path = setting(cfg, "paths", "checkpoint", default=None)
    if path:
        matcher.save(path)
    for x in (s1, s2, s3, truth, labelled, scored, clusters):
        x.unpersist()
    return out


train = run_training_pipeline


def run_inference_pipeline(spark: SparkSession, config: dict | str | None = None) -> DataFrame:
    """Score the test split with the saved matcher (or an unfitted one), export both files, return the clusters."""
    cfg = as_config(config)
    loader = tsv.DatasetLoader(spark, setting(cfg, "paths", "test_dir", default="data/test"))
    raw, s2, s3 = loader.load_sources()
    form = setting(cfg, "preprocessing", "unicode_form", default="NFKC")
    s1, s2, s3 = (prepare(x, form) for x in (raw, s2, s3))
    k = int(setting(cfg, "blocking", "max_candidates_per_s1", default=100))
    pairs = candidates_with_features(s1, s2, s3, k, setting(cfg, "blocking", "mode", default="exact"))
    path = setting(cfg, "paths", "checkpoint", default=None)
    saved = matching.EntityMatcher.load(spark, path) if path else None
    matcher = saved or matching.EntityMatcher(float(setting(cfg, "model", "threshold", default=0.5)))
    scored = matcher.predict_pairs(pairs).cache()
    clusters = matching.predict_clusters(s1, scored, matcher.threshold)
    out_dir = setting(cfg, "paths", "output_dir", default="output")
    sinks.export_submission(raw, matching.pairs_of_clusters(clusters), scored.select("s1_id", "target_id"), setting(cfg, "paths", "matching_file", default=f"{out_dir}/matching_results.tsv"), setting(cfg, "paths", "candidate_file", default=f"{out_dir}/candidate_pairs.tsv"))
    return clusters


run_inference = run_inference_pipeline


def evaluate_predictions(predictions: DataFrame, truth: DataFrame, predicted_keys: DataFrame, keys: DataFrame, candidates: DataFrame | None = None) -> dict:
    out = metrics.macro_f05(predictions, truth, predicted_keys, keys).first().asDict()
    if candidates is not None:
        out["blocking_recall"] = metrics.blocking_recall(candidates, truth).first().blocking_recall
    return out


def evaluate_pipeline(spark: SparkSession, config: dict | str | None = None) -> dict:
    return run_training_pipeline(spark, config)
