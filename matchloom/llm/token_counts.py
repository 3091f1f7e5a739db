"""Token counts by dynamic programming over prefixes.

``prefix_counts`` holds, for every code-point prefix of a text, the exact number of tokens
the tokenizer gives that prefix on its own.  Length, truncation and budget questions are
then lookups in it; nothing is encoded again.

Null and empty texts have no prefixes, 0 tokens and fit any budget.  Ties, repeated rows and
clashing extra columns do not matter: rows are independent and only the two named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import tidy


def count_tokens(df: DataFrame, tokenizer: str, *, id_column: str = "doc_id", text_column: str = "text", budgets: Sequence[int] = (2048,), keep_prefixes: bool = False) -> DataFrame:
    """One row per input row: id, ``n_bytes`` (UTF-8), ``n_tokens`` and, for each budget ``b``,
    ``fit_chars_b``: the code points of the longest prefix that has at most ``b`` tokens.

    With ``keep_prefixes`` the row also carries ``prefix_counts``, little-endian uint32
    counts, one for each code point, for :func:`tokens_before` and :func:`cut_at`.
    """
    slim = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    fields = [T.StructField(id_column, slim.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField(f"fit_chars_{b}", T.LongType()) for b in budgets]
    fields += [T.StructField("prefix_counts", T.BinaryType())] * keep_prefixes
    limits = list(budgets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe.model(tokenizer)
        for batch in batches:
            for part, texts in bpe.steps(batch, "text"):
                counts, chars = table.prefix_counts(texts)
                stops = np.cumsum(chars)
                total = np.where(chars > 0, np.append(counts, 0)[stops - 1], 0).astype(np.int64)
                columns = [part.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(total)]
                for b in limits:
                    # Counts may fall by one when a letter completes a longer token, so take the last fit.
                    end = chars.astype(np.int64)
                    for i in np.flatnonzero(total > b):
                        fit = np.flatnonzero(counts[stops[i] - chars[i] : stops[i]] <= b)
                        end[i] = fit[-1] + 1 if len(fit) else 0
                    columns.append(pa.array(end))
                if keep_prefixes:
                    columns.append(pa.array([c.tobytes() for c in np.split(counts.astype("<u4"), stops[:-1])], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return slim.mapInArrow(tidy(run, tokenizes=True), T.StructType(fields))


def tokens_before(prefix_counts: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` code points, from a stored table."""
    return 0 if chars <= 0 else int(np.frombuffer(prefix_counts, "<u4")[chars - 1])


def cut_at(prefix_counts: bytes, budget: int) -> int:
    """Code points of the longest prefix with at most ``budget`` tokens, from a stored table."""
    fit = np.flatnonzero(np.frombuffer(prefix_counts, "<u4") <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0
