"""Language identification by prediction by partial matching (PPM).

Each language gets a variable-order byte context tree from its training texts: nodes for
contexts of up to ``order`` bytes hold symbol counts, and a symbol not seen in a context
escapes to the next shorter one (method C: the escape's share is the number of distinct
symbols), down to all 256 bytes alike.  Statistics are frozen after training, so the exact
code length of a symbol in a context is a constant.  Only the contexts and symbols seen are
stored, so the order is the same for any number of languages and bytes, and a text's code
length under every language is a sum of lookups over all its bytes.

Null texts and texts without a letter are ``und`` with score 0.  Equal code lengths go to
the first language in code-point order.  Without training rows everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, text_batches, tidy

#: Training documents of each language at most, and the bytes at which no more are taken; for all languages together.
MAX_DOCS, MAX_BYTES, ALL_DOCS, ALL_BYTES = 4_000, 2 << 20, 400_000, 64 << 20
#: Bytes of context.
ORDER = 4
#: Keys up to which a step's distinct ones are found by marking rather than sorting.
MARKED = 1 << 25
STEP_BYTES = 1 << 20


@dataclass
class Languages:
    names: list[str]
    order: int
    symbol: np.ndarray  # byte -> symbol; bytes never seen in training share symbol 0
    width: int
    seen: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]  # [language][context length]: keys, bits, contexts, bits of their escapes

    def bits(self, language: int, keys: np.ndarray) -> np.ndarray:
        """Code lengths in bits of keys (context and symbol) of the full order."""
        out = np.full(len(keys), 8.0)
        for k, (known, cost, contexts, escape) in enumerate(self.seen[language]):
            part = keys % self.width ** (k + 1)
            for table, value, sought, add in ((contexts, escape, part // self.width, True), (known, cost, part, False)):
                at = np.minimum(np.searchsorted(table, sought), len(table) - 1)
                hit = table[at] == sought
                out = np.where(hit, value[at] + out if add else value[at], out)
        return out

    def lengths(self, raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Code lengths in bits, [text, language], of the texts that end at ``cuts`` in ``raw``."""
        starts = np.append(0, cuts[:-1])
        code, begun = self.symbol[raw], self.symbol[10]
        key = code.astype(np.int64)
        for k in range(1, self.order + 1):
            past = np.full(len(raw), begun, np.int64)
            past[k:] = code[:-k] if k < len(raw) else code[:0]
            for j in range(min(k, len(raw))):  # before a text stand line ends
                at = starts + j
                past[at[at < cuts]] = begun
            past *= self.width**k
            key += past
        del past, code
        size = self.width ** (self.order + 1)
        if size <= MARKED:
            mark = np.zeros(size, bool)
            mark[key] = True
            kinds = np.flatnonzero(mark)
            number = np.empty(size, np.int32)
            number[kinds] = np.arange(len(kinds), dtype=np.int32)
            key = number[key]
        else:
            order = np.argsort(key)
            kinds = key[order]
            fresh = np.append(True, kinds[1:] != kinds[:-1])
            key[order] = np.cumsum(fresh) - 1
            kinds = kinds[fresh]
            del order, fresh
        total = np.zeros((len(cuts), len(self.names)))
        for j in range(len(self.names)):
            run = np.append(0.0, np.cumsum(self.bits(j, kinds)[key]))
            total[:, j] = run[cuts] - run[starts]
        return total


def train(samples: list[tuple[str, str]], order: int = ORDER) -> Languages:
    """Build and freeze the context trees from (language, text) samples."""
    names = sorted({x for x, _ in samples})
    raw = {x: [] for x in names}
    for x, text in samples:
        raw[x].append(b"\n" * order + text.encode("utf-8", "surrogatepass"))
    seen = np.zeros(256, bool)
    seen[10] = True
    for texts in raw.values():
        for t in texts:
            seen[np.unique(np.frombuffer(t, np.uint8))] = True
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, seen.sum() + 1)
    width = int(seen.sum()) + 1
    model = Languages(names, order, symbol, width, [[] for _ in names])
    for j, x in enumerate(names):
        codes = [symbol[np.frombuffer(t, np.uint8)].astype(np.int64) for t in raw[x]]
        for k in range(order + 1):
            known, n = np.unique(np.concatenate([sum(c[order - i : len(c) - i] * width**i for i in range(k + 1)) for c in codes]), return_counts=True)
            if not len(known):
                break
            contexts, at, kinds = np.unique(known // width, return_inverse=True, return_counts=True)
            total = np.bincount(at, n) + kinds
            # A seen symbol has its share, and every symbol what the escape leaves it; order -1 has all 256 bytes alike.
            lower = np.exp2(-model.bits(j, known % width**k)) if k else 1.0 / 256
            escape = kinds / total
            model.seen[j].append((known, -np.log2(n / total[at] + escape[at] * lower), contexts, -np.log2(escape)))
    return model


def fit(docs: DataFrame, usable: Column, *, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang", order: int = ORDER, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Languages:
    """Train on usable documents of each language, whole and of any length, in the order of their hashes: at most ``max_docs``,
    and none after ``max_bytes`` bytes are reached.  With many languages each has an equal share of ``ALL_DOCS`` and ``ALL_BYTES``.
    """
    size = F.octet_length(F.col(text_column).cast("string"))
    rows = docs.where(usable & F.col(language_column).isNotNull() & (size > 0))
    rows = rows.select(F.col(language_column).cast("string").alias("lang"), size.alias("size"), F.xxhash64(F.col(id_column).cast("string"), F.col(text_column).cast("string")).alias("h"), F.col(text_column).cast("string").alias("text"))
    sums = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()  # languages
    if not sums:
        return train([], order)
    max_docs, max_bytes = max(1, min(max_docs, ALL_DOCS // len(sums))), min(max_bytes, ALL_BYTES // len(sums))
    slack = 4  # so many times as much as is wanted is put in order
    while True:
        share = {r.lang: min(1.0, slack * max(max_docs / r.n if r.n > max_docs and r.size < max_bytes * r.n / max_docs else max_bytes / r.size, 16 / r.n)) for r in sums}
        bounds = docs.sparkSession.createDataFrame([(x, min(2**63 - 1, -(2**63) + int(2.0**64 * f))) for x, f in share.items()], "lang string, bound long")
        few = rows.join(broadcast_if_small(bounds, len(sums), 64), "lang").where(F.col("h") <= F.col("bound"))
        got = {r.lang: (r.n, r.size) for r in few.groupBy("lang").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
        if all(got.get(r.lang, (0, 0))[0] in (r.n, *range(max_docs, r.n)) or got.get(r.lang, (0, 0))[1] >= max_bytes for r in sums):
            break
        slack *= 16
    order_by = Window.partitionBy("lang").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = few.select("lang", "h", "size").withColumns({"before": F.coalesce(F.sum("size").over(order_by), F.lit(0)), "rank": F.count("*").over(order_by)})
    chosen = ranked.where((F.col("before") < max_bytes) & (F.col("rank") < max_docs)).select("lang", "h", "size").distinct()  # at most ALL_DOCS
    texts = rows.join(F.broadcast(chosen), ["lang", "h", "size"]).groupBy("lang", "h", "size").agg(F.first("text").alias("text")).collect()
    return train(sorted((r.lang, r.text) for r in texts), order)


def identify(docs: DataFrame, model: Languages, *, text_column: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``lang_score`` to whole rows of ``docs``, replacing columns of those names.

    The score is the language's posterior against the next one with equal priors, from code lengths per square root of the
    byte count, so that long texts do not all reach exactly 1; it does not depend on how many languages there are.
    Without a second language it is 1.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    mark = "_letters" + "_" * max(map(len, keep))  # no column of that name
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text_column).cast("string").rlike(r"\p{L}"), F.lit(False)).alias(mark))
    at = keep.index(text_column)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = shared.value
        names = pa.array([*languages.names, "und"])
        for batch in batches:
            texts = batch.column(at)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            stops = np.cumsum(sizes)
            best, score = np.full(len(sizes), len(languages.names)), np.zeros(len(sizes))
            first = 0
            while first < len(sizes) and languages.names:
                last = first + max(1, int(np.searchsorted(stops[first:], stops[first] - sizes[first] + STEP_BYTES, "right")))
                part = slice(first, last)
                n = sizes[part]
                raw = b"".join(x for x in texts.slice(first, last - first).cast(pa.binary()).to_pylist() if x)
                bits = languages.lengths(np.frombuffer(raw, np.uint8), np.cumsum(n))
                best[part] = bits.argmin(1)
                first_two = np.partition(bits, min(1, bits.shape[1] - 1), axis=1)[:, :2]
                gap = (first_two[:, 1] - first_two[:, 0]) / np.sqrt(np.maximum(n, 1)) if bits.shape[1] > 1 else np.full(len(n), np.inf)
                score[part] = 1.0 / (1.0 + np.exp2(-gap))
                first = last
            letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.where(letters, best, len(languages.names)), np.where(letters, score, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], names.take(pa.array(best)), pa.array(score)], [*keep, "lang_pred", "lang_score"])

    fields = [*slim.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
    return text_batches(slim).mapInArrow(tidy(run), T.StructType(fields))
