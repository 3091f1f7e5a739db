"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts.  The trees are fitted on a bounded sample of labelled
rows and scored by vectorised numpy traversal of flat arrays.

Null and empty texts have all statistics zero and are scored like any text.  A document
with several labels counts once for each; labels that are null are ignored, as are labels
without a document.  Without any labelled rows every score is the base rate of one half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_of, smallest_hashes, staged, text_batches, tidy, unstage
from .gbt import Trees, train

#: Labelled rows that training takes at most, those with the smallest hash of their id.
MAX_LABELLED = 20_000
FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "space", "other_ascii", "high", "newline", "comma", "period", "pipe", "exclaim", "symbol",
    "byte_entropy", "distinct_words", "same_as_previous", "top_word", "title_words", "short_line", "distinct_lines", "longest_run", "words_with_mark",
)
CLASS_OF_BYTE = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b",", b".", b"|", b"!", b"#$%&*@^~<>{}[]\\/=+_"), 1):
    CLASS_OF_BYTE[list(_chars)] = _k
CLASS_OF_BYTE[128:] = 10
CLASS_OF_BYTE[[b for b in range(33, 127) if not chr(b).isalnum() and CLASS_OF_BYTE[b] == 0]] = 11


def statistics(text: str) -> list[float]:
    """The features of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(CLASS_OF_BYTE, counts, 12) / n
    p = counts[counts > 0] / n
    words = text.split()
    w = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    seen: dict[str, int] = {}
    same = run = longest = titled = marked = 0
    before = None
    for x in words:
        seen[x] = seen.get(x, 0) + 1
        if x == before:
            same += 1
            run += 1
            longest = max(longest, run)
        else:
            run = 0
        before = x
        titled += x[0].isupper()
        marked += not x[-1].isalnum()
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), sum(map(len, words)) / w, kinds[1], kinds[2], kinds[3], kinds[11], kinds[10], kinds[4], kinds[5], kinds[6], kinds[7], kinds[8], kinds[9],
        float(-(p * np.log2(p)).sum()), len(seen) / w, same / w, max(seen.values(), default=0) / w, titled / w, sum(len(x) < 40 for x in lines) / k, len(set(lines)) / k, longest / w, marked / w,
    ]


def with_statistics(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per input row: id and its feature array (float64, packed)."""
    slim = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t or "") for _, t in rows_of(batch)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "x"])

    return text_batches(slim).mapInArrow(tidy(run), f"id {kind}, x binary")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", most: int = MAX_LABELLED) -> Trees:
    """Train on at most ``most`` labelled rows whose id satisfies ``usable`` (an expression over the id)."""
    chosen = labels.where(usable & F.col(label_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("y"))
    chosen = smallest_hashes(chosen.select(F.xxhash64("id", "y").alias("h"), "id", "y"), ["h", "id", "y"], most)
    chosen = staged(chosen.select("id", "y"), "quality-labels")
    # At most ``most`` ids, a documented bound, so the broadcast is safe.
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(chosen.select("id").distinct()), "id")
    # Of documents with one id the one counts whose packed statistics come first.
    known = staged(with_statistics(rows, "id", "text").groupBy("id").agg(F.min("x").alias("x")), "quality-samples")
    got = known.join(F.broadcast(chosen), "id").collect()  # at most ``most``
    unstage(chosen, known)
    got.sort(key=lambda r: (r.id, r.y, r.x))
    x = np.array([np.frombuffer(r.x) for r in got]).reshape(len(got), len(FEATURES))
    return train(x, np.array([r.y for r in got], np.float64))


def score(docs: DataFrame, model: Trees, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Add ``quality_score`` (0 to 1) to whole rows of ``docs``; an input column of that name is replaced."""
    keep = [c for c in docs.columns if c != "quality_score"]
    slim = docs.select(*keep)
    at = keep.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t or "") for (t,) in rows_of(batch.select([at]))], np.float64).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], [*keep, "quality_score"])

    return text_batches(slim).mapInArrow(tidy(run), T.StructType([*slim.schema.fields, T.StructField("quality_score", T.DoubleType())]))
