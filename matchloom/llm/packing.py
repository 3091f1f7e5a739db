"""Mixture-controlled packing by deficit round-robin over source queues.

Round ``r`` of ``R`` entitles queue ``i`` (with ``T_i`` of all ``T`` tokens) to
``T_i * r / R`` tokens in total; it sends ``floor`` of that and its phase, less what it has sent,
and the fraction left is the deficit it carries into the next round.  Phases are spread evenly
over queues of the same size, which together are then within a token of their due.  Every source
is a queue.  Queues send in fixed order within a round, those with fewer tokens first, and the
stream is cut every ``length`` tokens.  So every window but the last is full, each queue is
within about a round's tokens of its due in all windows so far, and all queues run dry together.
The target is always the corpus's own mix.

The state before any round follows from ``T_i``, ``R`` and ``r`` alone.  That lets every
partition compute where its tokens go without seeing the others: deficits cross windows and
partitions exactly, and a lost task is simply run again.

Null texts pack as empty documents (just the end token).  Null sources form one queue.
Repeated rows are separate documents.  An empty table gives no pieces.  Only the named
columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import broadcast_if_small, staged, text_batches, tidy

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def tokenize(df: DataFrame, tokenizer: str, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", end_id: int = 1, room: bpe.Room = bpe.ALONE) -> DataFrame:
    """One row per document: ids (packed little-endian, 2 or 4 bytes each) with ``end_id`` appended,
    and the place of its first token among its task's tokens of the same source."""

    slim = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe.model(tokenizer)
        table.most = room.chunks
        kind = "<u2" if max(table.vocab.values()) < 65536 else "<u4"
        task, sent = TaskContext.get().partitionId(), {}
        for batch in batches:
            for part, texts in bpe.steps(batch, "text", room.step_bytes):
                ids, counts = table.encode(texts)
                stops = np.cumsum(counts)
                full = np.insert(ids.astype(kind), stops, end_id)
                stops = stops + np.arange(1, len(stops) + 1)
                cuts = np.append(0, stops)
                raw, width = full.tobytes(), full.itemsize
                first = np.empty(len(counts), np.int64)
                for k, (source, n) in enumerate(zip(part.column(1).to_pylist(), (counts + 1).tolist())):
                    first[k] = sent.get(source, 0)
                    sent[source] = first[k] + n
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.full(len(counts), task, np.int32)), pa.array(first), pa.array(counts + 1), pa.array([raw[a * width : b * width] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
                    ["doc_id", "source", "task", "first", "n", "ids"],
                )

    return text_batches(slim, room.rows).mapInArrow(tidy(run, tokenizes=True), "doc_id long, source string, task int, first long, n long, ids binary")


def pack(df: DataFrame, tokenizer: str, *, length: int = 2048, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", mixture: Mapping[str | None, float] | None = None, room: bpe.Room = bpe.ALONE) -> DataFrame:
    """Pack whole documents into sequences of ``length`` tokens; one row per piece.

    ``start`` is the piece's first id in its document, ``sequence_id`` and ``offset`` its
    place.  Sequence ids run from 0 without gaps.  ``mixture`` gives sources (None: the null
    source) their weights, of which at least one is above 0; sources of the table that it does
    not name, or names with 0, follow when all others are dry.  ``room`` bounds a worker's memory.
    """
    spark = df.sparkSession
    weights = [] if mixture is None else sorted(set(mixture.values()))
    if mixture is not None and not (weights and weights[0] >= 0 and 0 < weights[-1] < math.inf):
        raise ValueError("a mixture needs finite weights, none below 0 and one above")
    tokens = staged(tokenize(df, tokenizer, id_column=id_column, text_column=text_column, source_column=source_column, end_id=end_id, room=room), "pack-tokens")
    runs = staged(tokens.groupBy("source", "task").agg(F.sum("n").alias("n")), "pack-runs")  # one row for each task and source
    queues = staged(runs.groupBy("source").agg(F.sum("n").alias("total")), "pack-queues")
    # A queue's place is told by its total and its number among the queues of that total, so tasks hold one row for each total.
    queues = queues.withColumn("weight_no", weight_numbers(F.col("source"), mixture or {}, weights))
    totals = sorted((r.total, r.weight_no, r["count"]) for r in queues.groupBy("total", "weight_no").count().collect())  # k different totals take k * k / 2 tokens
    sizes, counts = [n for n, _, _ in totals], [c for _, _, c in totals]
    shares = None if mixture is None else [weights[w] if w >= 0 else 0 for _, w, _ in totals]
    listed = spark.createDataFrame([(n, w, k) for k, (n, w, _) in enumerate(totals)], "total long, weight_no int, queue_no long")
    number = F.row_number().over(Window.partitionBy("total", "weight_no").orderBy("source")) - 1
    queues = queues.withColumn("rank", number.cast("long")).join(broadcast_if_small(listed, len(sizes), 20), ["total", "weight_no"])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = runs.withColumn("base", before).alias("r").join(queues.alias("q"), F.col("r.source").eqNullSafe(F.col("q.source")))
    bases = staged(bases.select("r.source", "r.task", "q.queue_no", "q.rank", "r.base"), "pack-bases")
    placed = tokens.alias("t").join(bases.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")) & (F.col("t.task") == F.col("b.task")))
    placed = placed.select("t.doc_id", "t.source", "b.queue_no", (F.col("b.base") + F.col("t.first")).alias("at"), "t.n", "t.ids", "b.rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Epochs(sizes, length, counts, shares)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                yield pieces(plan, batch.slice(k, 256), length)

    return placed.mapInArrow(tidy(run, tokenizes=True), PIECES)


def weight_numbers(source: Column, mixture: Mapping[str | None, float], weights: list[float]) -> Column:
    """The place of a source's weight in ``weights``; -1 where the mixture does not name the source."""
    number = F.lit(-1)
    for name, weight in mixture.items():
        number = F.when(source.eqNullSafe(F.lit(name)), weights.index(weight)).otherwise(number)
    return number.cast("int")


class Epochs:
    """The rounds up to where a queue runs dry, then those of the queues left, and so on; ``weights`` as ``sizes``, None for the queues' own mix."""

    def __init__(self, sizes: list[int], length: int, counts: list[int], weights: list[float] | None = None):
        shares = [Fraction(w) for w in (sizes if weights is None else weights)]
        dry = sorted({Fraction(n) / w for n, w in zip(sizes, shares) if w and n})
        sent = [0] * len(sizes)
        self.plans = []  # queues' numbers in the epoch, what they sent before, what they send in it, tokens before it, its rounds
        before = 0
        for level in [*dry, None]:  # last the queues without a weight
            upto = [n if level is None or w and n <= w * level else math.floor(w * level) for n, w in zip(sizes, shares)]
            live = [j for j in range(len(sizes)) if upto[j] > sent[j]]
            if not live:
                continue
            number = np.full(len(sizes), -1)
            number[live] = np.arange(len(live))
            part = [b - a for a, b in zip(sent, upto)]
            self.plans.append((number, np.array(sent, np.int64), np.array(part, np.int64), before, Rounds([part[j] for j in live], length, [counts[j] for j in live])))
            before += sum(n * c for n, c in zip(part, counts))
            sent = upto

    def segments(self, queue: np.ndarray, at: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cut runs of tokens by epoch and round: owner, first token in the run, tokens, and position in the stream."""
        found = []
        for number, sent, part, before, plan in self.plans:
            low, high = np.maximum(at, sent[queue]), np.minimum(at + n, (sent + part)[queue])
            rows = np.flatnonzero(high > low)
            if len(rows):
                owner, start, size, place = plan.segments(number[queue[rows]], (low - sent[queue])[rows], (high - low)[rows], rank[rows])
                found.append((rows[owner], start + (low - at)[rows][owner], size, place + before))
        return tuple(np.concatenate(c) for c in zip(*found))


class Rounds:
    """Where the round-robin puts each token of each queue; ``counts`` tells how many queues share a size."""

    def __init__(self, sizes: list[int], length: int, counts: list[int] | None = None):
        self.counts = counts or [1] * len(sizes)
        total = sum(n * c for n, c in zip(sizes, self.counts))
        self.rounds = max(1, -(-total // length))
        # Products reach sizes * rounds; beyond 64 bits Python's integers take over.
        self.kind = np.int64 if 64 * total * self.rounds < 2**62 else object
        self.sizes = np.array(sizes, self.kind)

    def sent(self, j: int, m: np.ndarray | int, rnd: np.ndarray) -> np.ndarray:
        """What the first ``m`` queues of size ``j`` have sent by the end of a round."""
        R, c, u = self.rounds, self.counts[j], j * 40 % 64
        due = self.sizes[j] * rnd
        late = -(-(64 * c * (R - due % R) - u * R) // (64 * R))  # queues from here on are one token ahead of the others
        return m * (due // R) + np.maximum(m - late, 0)

    def segments(self, queue: np.ndarray, at: np.ndarray, n: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cut runs of tokens by round: owner, first token in the run, tokens, and position in the stream."""
        R, size = self.rounds, self.sizes[queue]
        at, n = at.astype(self.kind), n.astype(self.kind)
        many = np.array(self.counts, self.kind)[queue]
        ahead = np.zeros(len(queue), self.kind) if rank is None else rank.astype(self.kind)
        phase = 64 * ahead + queue.astype(self.kind) * 40 % 64  # in 64ths of a queue's step
        of_round = lambda x: -(-R * (64 * many * (x + 1) - phase) // (64 * many * size))  # noqa: E731  the round, from 1, that sends token x
        first, last = of_round(at), of_round(at + n - 1)
        number = (last - first + 1).astype(np.int64)
        owner = np.repeat(np.arange(len(queue)), number)
        rnd = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + first[owner]
        q, m, c, f, k = queue[owner], size[owner], many[owner], phase[owner], ahead[owner]
        sent = lambda r: (64 * c * m * r + f * R) // (64 * c * R)  # noqa: E731  by the queue itself
        begun = sent(rnd - 1)
        low = np.maximum(begun, at[owner])
        high = np.minimum(sent(rnd), (at + n)[owner])
        place = low - begun
        for j, (t, c) in enumerate(zip(self.sizes, self.counts)):  # queues before mine have sent this round, the others not
            before = np.where(q == j, k, np.where(q < j, 0, c))
            place = place + self.sent(j, before, rnd) + self.sent(j, c, rnd - 1) - self.sent(j, before, rnd - 1)
        keep = high > low
        return owner[keep], (low - at[owner])[keep].astype(np.int64), (high - low)[keep].astype(np.int64), place[keep].astype(np.int64)


def pieces(plan: Rounds, batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    queue, at, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
    owner, start, size, place = plan.segments(queue, at, n, batch.column(6).to_numpy(zero_copy_only=False))
    head = np.minimum(size, length - place % length)  # what still goes into the sequence that is open
    tail = size - head
    more = tail > 0  # a round sends at most ``length`` tokens of a queue, so one cut is enough
    owner, start, size, place = (np.append(a, b) for a, b in ((owner, owner[more]), (start, (start + head)[more]), (head, tail[more]), (place, (place + head)[more])))
    order = np.lexsort((start, owner))
    owner, start, size, place = owner[order], start[order], size[order], place[order]
    sums, stop = np.empty(len(owner), np.int64), start + size
    bounds = np.searchsorted(owner, np.arange(len(n) + 1))
    for k, raw in enumerate(batch.column(5).to_pylist()):
        data = memoryview(np.frombuffer(raw, "<u2" if len(raw) == 2 * n[k] else "<u4").astype("<u4").tobytes())
        for p in range(bounds[k], bounds[k + 1]):
            sums[p] = zlib.crc32(data[4 * start[p] : 4 * stop[p]])
    pick = pa.array(owner)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pick), pa.array(start), pa.array(size), pa.array(sums), pa.array(n[owner].astype(np.int64)), pa.array(place // length), pa.array(place % length), batch.column(1).take(pick)],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
    )
