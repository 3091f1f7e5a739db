"""Matching records that arrive as a stream against a fixed S1 table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking, features, matching


def match_stream(arrivals: DataFrame, s1: DataFrame, matcher: matching.EntityMatcher, out: str, checkpoint: str, k: int = 50) -> StreamingQuery:
    """Score each micro-batch of target records and append its matches as Parquet under ``out/batch=N``.

    A batch that is replayed overwrites its own folder, so results are written once.
    """

    def handle(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        pairs = blocking.generate_candidates(s1, batch, k=k)
        scored = matcher.predict_pairs(features.extract_features(pairs, s1, batch))
        matching.matched(scored, matcher.threshold).select("s1_id", "target_id", "score").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
