"""Near-duplicate vectors by NN-descent.

A neighbour graph starts from random-hyperplane orders (vectors sorted by their signs,
neighbouring ones compared in blocks) and is refined by joining each vector's neighbours with
one another (neighbours of neighbours), forward and reverse.  Lists keep the ``k`` best at or
above ``floor``; a list that is full of links doubles its ``k``.  Pairs at or above the threshold
are links.  Recall by vector is audited against brute force for a random set of vectors; below the
goal, more orders are added and the refinement goes on, and if that does not reach it all vectors
are compared with all.  Components with lists full of links, whose limit
may hide links between them, are compared with each other exactly.  Last, lists of linked groups are completed:
inside each component blocks of vectors are compared with each other, so that counts do not
depend on list lengths.

Cosines are taken in double precision.  Vectors that are null, zero, or hold null or
non-finite components link with nothing and are their own component.  Equal vectors form one
class and link with each other, whatever their ids; different vectors of one id stay apart.
Vectors of different lengths do not link.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, smallest_hashes, staged, unstage
from .components import components

#: Vectors compared at once; orders at first; neighbours kept at first and at most; refinements at most.
BLOCK, ORDERS, FIRST_K, MOST_K, REFINEMENTS = 256, 6, 12, 48, 6
#: Vectors that the audit compares with all others at first and at most, those with links outside large
#: components that it wants, and the recall it asks for.
AUDITED, MOST_AUDITED, LINKED, RECALL = 512, 8192, 200, 0.98
#: Bytes of vectors that are broadcast at once to look for links between components.
CHUNK_BYTES = 16 << 20
LIST = "a long, b long, s double"


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed(df: DataFrame, vector_column: str) -> DataFrame:
    """Replace the vector by packed doubles ``v``, null where it cannot link."""
    slim = df.select("id", F.col(vector_column).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.array(v if v is not None and None not in v else [], np.float64)
                with np.errstate(all="ignore"):
                    ok = len(x) and np.isfinite(x).all() and 0 < np.linalg.norm(x) < np.inf
                out.append((x + 0.0).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "v"])

    return slim.mapInArrow(run, "id long, v binary")


def orders(reps: DataFrame, seeds: list[int]) -> DataFrame:
    """One row per vector and seed: its code of 64 hyperplane signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            ids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for width in {len(r) for r in raw}:
                rows = [i for i, r in enumerate(raw) if len(r) == width]
                x = unit([raw[i] for i in rows])
                for seed in seeds:
                    p = planes.setdefault((seed, width), np.random.default_rng([seed, width]).standard_normal((width // 8, 64)))
                    code = np.packbits(x @ p > 0, axis=1).view(">u8").ravel() >> np.uint64(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), seed, np.int32)), pa.array(np.full(len(rows), width, np.int32)), pa.array(code.astype(np.int64)), pa.array([ids[i] for i in rows], pa.int64()), pa.array([raw[i] for i in rows], pa.binary())], ["seed", "width", "code", "id", "v"])

    return reps.select("id", "v").mapInArrow(run, "seed int, width int, code long, id long, v binary")


def best_pairs(ids: np.ndarray, x: np.ndarray, k: int, floor: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row its ``k`` most similar rows at or above ``floor``; pairs point from the row to the other."""
    s = x @ x.T
    np.fill_diagonal(s, -1.0)
    if k < len(ids) - 1:
        cut = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k, None]
        p, q = np.nonzero((s >= np.maximum(cut, floor)))
    else:
        p, q = np.nonzero(s >= floor)
    return [(ids[p], ids[q], s[p, q])]


def listed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "s"])


def seeded(reps: DataFrame, seeds: list[int], k: int, floor: float, partitions: int) -> DataFrame:
    """First lists: neighbours in the sorted orders, compared block by block.  Blocks overlap by half."""
    rows = orders(reps, seeds).repartitionByRange(partitions, "seed", "width", "code", "id").sortWithinPartitions("seed", "width", "code", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, raw = None, [], []
        for batch in batches:
            out = []
            for seed, width, _, i, v in zip(*(c.to_pylist() for c in batch.columns)):
                if (seed, width) != now or len(ids) == BLOCK:
                    if len(ids) > 1:
                        out += best_pairs(np.array(ids), unit(raw), k, floor)
                    half = BLOCK // 2 if (seed, width) == now else len(ids)
                    now, ids, raw = (seed, width), ids[half:], raw[half:]
                ids.append(i)
                raw.append(v)
            yield listed(out)
        if len(ids) > 1:
            yield listed(best_pairs(np.array(ids), unit(raw), k, floor))

    return rows.mapInArrow(run, LIST)


def trimmed(pairs: DataFrame, limits: DataFrame | None) -> DataFrame:
    """The best ``k`` of each list, with the list's limit doubled where it was full of links; rows (a, b, s, k)."""
    rows = pairs.groupBy("a", "b").agg(F.max("s").alias("s"))
    rows = rows.withColumn("k", F.lit(FIRST_K)) if limits is None else rows.join(limits, "a", "left").withColumn("k", F.coalesce("k", F.lit(FIRST_K)))
    order = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= MOST_K).where("r <= k").select("a", "b", "s", "k")


def refined(lists: DataFrame, vectors: DataFrame, floor: float) -> DataFrame:
    """Neighbours of neighbours: compare the members of each list, and those whose list it is, with one another."""
    worst = lists.groupBy("a").agg(F.min("s").alias("worst"), F.count("*").alias("n"), F.first("k").alias("k"))
    worst = worst.select("a", F.when(F.col("n") < F.col("k"), F.lit(floor)).otherwise(F.col("worst")).alias("worst"))
    back = Window.partitionBy("b").orderBy(F.desc("s"), "a")
    reverse = lists.withColumn("r", F.row_number().over(back)).where(F.col("r") <= FIRST_K).select(F.col("b").alias("c"), F.col("a").alias("m"))
    own = lists.select("a").distinct().select(F.col("a").alias("c"), F.col("a").alias("m"))
    seats = lists.select(F.col("a").alias("c"), F.col("b").alias("m")).unionByName(reverse).unionByName(own).distinct()
    seats = seats.join(vectors.select(F.col("id").alias("m"), "v"), "m").join(worst.select(F.col("a").alias("m"), "worst"), "m", "left")
    seats = seats.select("c", "m", "v", F.coalesce("worst", F.lit(floor)).alias("worst")).repartition("c").sortWithinPartitions("c", "m")

    def local(rows: list[tuple]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids, low = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
        x = unit([r[1] for r in rows])
        s = x @ x.T
        np.fill_diagonal(s, -1.0)
        p, q = np.nonzero(s > np.maximum(low, floor)[:, None])  # what would enter the row's list
        return [(ids[p], ids[q], s[p, q])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            out = []
            for c, *row in zip(*(x.to_pylist() for x in batch.columns)):
                if c != now:
                    if len(rows) > 2:
                        out += local(rows)
                    now, rows = c, []
                rows.append(row)
            yield listed(out)
        if len(rows) > 2:
            yield listed(local(rows))

    return seats.mapInArrow(run, LIST)


def audit(rows: DataFrame, threshold: float, sample: int = AUDITED) -> float:
    """Recall of ``rows`` (id, label, v) by vector, from brute force for vectors drawn by the hashes of their ids alone.

    A vector's recall is the share of its links whose other end has its label, averaged over the drawn vectors that
    have links.  Vectors of components with more than a hundredth of all vectors are averaged apart, and the lesser
    average counts, so that a large group cannot cover for small ones.  More are drawn until LINKED of those outside
    large components have links, or MOST_AUDITED are drawn.
    """
    spark = rows.sparkSession
    total = rows.count()
    large = {r.label for r in rows.groupBy("label").count().where(F.col("count") > max(1, total // 100)).select("label").collect()}  # at most 100 rows
    while True:
        chosen = smallest_hashes(rows.select(F.xxhash64("id").alias("h"), "id", "label", "v"), ["h", "id"], sample).collect()  # at most MOST_AUDITED vectors
        ids, label = np.array([r.id for r in chosen], np.int64), np.array([r.label for r in chosen], np.int64)
        raw = spark.sparkContext.broadcast([bytes(r.v) for r in chosen])

        def run(batches: Iterator[pa.RecordBatch], ids=ids, label=label, raw=raw) -> Iterator[pa.RecordBatch]:
            n, same = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            drawn = {w: [i for i, r in enumerate(raw.value) if len(r) == w] for w in {len(r) for r in raw.value}}
            x = {w: unit([raw.value[i] for i in q]) for w, q in drawn.items()}
            for batch in batches:
                own, of = (batch.column(k).to_numpy() for k in (0, 1))
                data = batch.column(2).to_pylist()
                for w, q in drawn.items():
                    mine = [i for i, r in enumerate(data) if len(r) == w]
                    step = max(1, 4_000_000 // len(q))
                    for at in range(0, len(mine), step):
                        part = mine[at : at + step]
                        i, j = np.nonzero(x[w] @ unit([data[k] for k in part]).T >= threshold)
                        i, j = np.array(q)[i], np.array(part)[j]
                        i, j = i[ids[i] != own[j]], j[ids[i] != own[j]]
                        n += np.bincount(i, minlength=len(ids))
                        same += np.bincount(i[label[i] == of[j]], minlength=len(ids))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(same[at])], ["at", "n", "same"])

        sums = rows.select("id", "label", "v").mapInArrow(run, "at long, n long, same long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("same").alias("same")).collect()
        inside, outside = ([r.same / r.n for r in sums if (int(label[r.at]) in large) == big] for big in (True, False))
        if len(outside) >= LINKED or sample >= min(total, MOST_AUDITED):
            return min((float(np.mean(part)) for part in (inside, outside) if part), default=1.0)
        sample = min(4 * sample, MOST_AUDITED)


def linked_pieces(rows: list[tuple[int, int, bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(id, label, vector) rows as pieces of one label each, by width: labels, centres, radii (angles), members."""
    out = []
    for width in sorted({len(r[2]) for r in rows}):
        own = sorted((r for r in rows if len(r[2]) == width), key=lambda r: (r[1], r[0]))
        x, label = unit([r[2] for r in own]), np.array([r[1] for r in own])
        members = np.split(x, np.flatnonzero(label[1:] != label[:-1]) + 1)
        centres = np.array([m[0] if len(m) == 1 else unit([(m.sum(0) if np.linalg.norm(m.sum(0)) > 1e-9 else m[0]).tobytes()])[0] for m in members])
        radii = np.array([0.0 if len(m) == 1 else np.arccos(np.clip(m @ c, -1, 1)).max() for m, c in zip(members, centres)])
        out.append((np.unique(label), centres, radii, members))
    return out


def merged(rows: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``labels`` after joining any two components of ``rows`` (id, label, v) that have a link between them.

    Exact: all rows meet all pieces of components, CHUNK_BYTES of vectors at a time.  A piece is left out for a row
    only where the angle to its centre exceeds the link's angle and the piece's radius together.
    """
    spark = rows.sparkSession
    size = rows.agg(F.coalesce(F.sum(F.octet_length("v") + 16), F.lit(0))).first()[0]
    chunks = max(1, -(-size // CHUNK_BYTES))
    cut = staged(rows.repartitionByRange(chunks, "label", "id").withColumn("chunk", F.spark_partition_id()), "vector-chunks")
    reach = np.arccos(threshold) + 1e-6
    found = None
    for k in range(chunks):
        pieces = spark.sparkContext.broadcast(linked_pieces([(r.id, r.label, bytes(r.v)) for r in cut.where(F.col("chunk") == k).collect()]))  # about CHUNK_BYTES

        def run(batches: Iterator[pa.RecordBatch], pieces=pieces) -> Iterator[pa.RecordBatch]:
            seen: set[tuple[int, int]] = set()
            for batch in batches:
                own, data, fresh = batch.column(0).to_numpy(), batch.column(1).to_pylist(), set()
                for names, centres, radii, members in pieces.value:
                    mine = [i for i, r in enumerate(data) if len(r) == 8 * centres.shape[1]]
                    step = max(1, 4_000_000 // len(names))
                    for at in range(0, len(mine), step):
                        x, label = unit([data[i] for i in mine[at : at + step]]), own[mine[at : at + step]]
                        s = x @ centres.T
                        single = np.array([len(m) == 1 for m in members])
                        near = np.where(single, s >= threshold, np.arccos(np.clip(s, -1, 1)) <= reach + radii) & (label[:, None] > names)
                        for g in np.flatnonzero(near.any(0)):
                            hit = np.flatnonzero(near[:, g])
                            if not single[g]:
                                hit = hit[[(label[i], names[g]) not in seen for i in hit]]
                                tile = max(1, 4_000_000 // len(members[g]))
                                hit = np.concatenate([hit[:0], *(hit[j : j + tile][(x[hit[j : j + tile]] @ members[g].T >= threshold).any(1)] for j in range(0, len(hit), tile))])
                            fresh |= {(int(label[i]), int(names[g])) for i in hit}
                fresh -= seen
                seen |= fresh
                a, b = (np.array([p[i] for p in sorted(fresh)], np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        part = cut.select("label", "v").mapInArrow(run, "a long, b long").distinct()
        part = staged(part, "vector-merges")
        found = part if found is None else found.unionByName(part)
    if found.isEmpty():
        return labels
    return staged(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(found), "vector-cc"), "vector-labels")


def labelled(reps: DataFrame, labels: DataFrame) -> DataFrame:
    named = reps.join(broadcast_if_small(labels.select(F.col("node").alias("id"), "label"), labels.count(), 16), "id", "left")
    return named.select("id", F.coalesce("label", "id").alias("label"), "v")


def saturated(lists: DataFrame, labels: DataFrame, reps: DataFrame, threshold: float) -> DataFrame | None:
    """The vectors (id, label, v) of components that hold a list full of links, or None if fewer than two do.

    Only between such components can the lists' limit hide a link: a pair stays in the list of an end that has room.
    """
    full = lists.groupBy("a").agg(F.first("k").alias("k"), F.count("*").alias("n"), F.min("s").alias("low")).where((F.col("n") >= F.col("k")) & (F.col("low") >= threshold))
    names = staged(full.join(labels, F.col("a") == F.col("node")).select("label").distinct(), "vector-full")
    n = names.count()
    return labelled(reps, labels).join(broadcast_if_small(names, n, 8), "label", "left_semi").select("id", "label", "v") if n > 1 else None


def complete(groups: DataFrame, threshold: float) -> DataFrame:
    """Links of each vector within its component: rows (id, n), from blocks of vectors compared with each other."""

    def tally(rows: list[tuple], out: list) -> None:
        ids = np.array([r[0] for r in rows])
        weight = np.array([r[2] for r in rows], np.int64)
        first, second = (np.flatnonzero(np.array([r[3] for r in rows]) == k) for k in (0, 1))
        x = unit([r[1] for r in rows])
        for a, b in ((first, second), (second, first)) if len(second) else ((first, first),):
            for at in range(0, len(a), 512):
                part = a[at : at + 512]
                hit = x[part] @ x[b].T >= threshold
                hit &= ids[part][:, None] != ids[b]
                out.append((ids[part], hit @ weight[b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            out = []
            for c, l, r, *row in zip(*(x.to_pylist() for x in batch.columns)):
                if (c, l, r) != now:
                    if rows:
                        tally(rows, out)
                    now, rows = (c, l, r), []
                rows.append(row)
            yield counts(out)
        out = []
        if rows:
            tally(rows, out)
        yield counts(out)

    def counts(out: list) -> pa.RecordBatch:
        a, b = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["id", "n"])

    size = groups.groupBy("c").agg(F.count("*").alias("size"))
    rows = groups.join(size, "c").withColumn("blocks", F.ceil(F.col("size") / 2048).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("c", F.least("mine", "other").alias("l"), F.greatest("mine", "other").alias("r"), "id", "v", "weight", F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"))
    return rows.repartition("c", "l", "r").sortWithinPartitions("c", "l", "r").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def neighbour_components(df: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = 0.9, margin: float = 0.1) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` (smallest id it reaches) and ``kept``."""
    spark = df.sparkSession
    floor = threshold - margin
    rows = staged(packed(df.select(F.col(id_column).cast("long").alias("id"), vector_column), vector_column), "vectors")
    classes = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
    # Classes go by numbers of their own, as several may begin with one id.
    reps = staged(classes.select(F.monotonically_increasing_id().alias("id"), "first", "v", "weight"), "vector-classes")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    lists = limits = None
    seeds = list(range(ORDERS))
    while True:
        fresh = seeded(reps, seeds, FIRST_K, floor, partitions)
        if lists is not None:
            fresh = fresh.unionByName(lists.select("a", "b", "s"))
        lists = staged(trimmed(fresh, limits), "lists")
        before = lists.agg(F.count("*"), F.sum("s")).first()
        for _ in range(REFINEMENTS if before[0] else 0):
            full = lists.groupBy("a").agg(F.first("k").alias("k"), F.count("*").alias("n"), F.min("s").alias("low"))
            limits = staged(full.select("a", F.when((F.col("n") >= F.col("k")) & (F.col("low") >= threshold), F.least(F.col("k") * 2, F.lit(MOST_K))).otherwise(F.col("k")).alias("k")), "limits")
            both = refined(lists, reps, floor).unionByName(lists.select("a", "b", "s")).unionByName(lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
            nxt = staged(trimmed(both, limits), "lists")
            unstage(lists)
            lists, now = nxt, nxt.agg(F.count("*"), F.sum("s")).first()
            if now[0] <= before[0] * 1.001 and now[1] <= before[1] * 1.001:
                break
            before = now
        edges = lists.where(F.col("s") >= threshold).select("a", "b")
        labels = staged(components(edges, "vector-cc"), "vector-labels")
        crowded = saturated(lists, labels, reps, threshold)
        if crowded is not None:
            labels = merged(crowded, labels, threshold)
        # Components are completed exactly, so a true link counts as found if its ends are in one component.
        if audit(labelled(reps, labels), threshold) >= RECALL:
            break
        if len(seeds) >= 4 * ORDERS:  # the descent does not get there: all vectors meet all
            labels = merged(labelled(reps, labels), labels, threshold)
            break
        seeds = list(range(max(seeds) + 1, max(seeds) + 1 + 2 * len(seeds)))
    grouped = labels.join(reps, F.col("node") == F.col("id")).select(F.col("label").alias("c"), "id", "v", "weight")
    links = staged(complete(grouped, threshold), "vector-links")
    named = reps.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").join(links, "id", "left").withColumn("label", F.coalesce("label", "id"))
    smallest = staged(named.groupBy("label").agg(F.min("first").alias("component_id")), "vector-smallest")
    named = named.join(broadcast_if_small(smallest, smallest.count(), 16), "label")
    named = staged(named.select("v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "vector-named")
    size = named.agg(F.coalesce(F.sum(F.octet_length("v") + 32), F.lit(0))).first()[0]
    unstage(lists, links, limits, labels, smallest, reps)
    none = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))  # by themselves, so that they meet in no task
    out = rows.join(broadcast_if_small(named, size, 1), "v").select("id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(none)
    return out.select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
