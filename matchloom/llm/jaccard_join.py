"""N-gram Jaccard self-join with signature trees, exact at the threshold.

1. Each text becomes its set of distinct word n-grams (64-bit hashes).  Equal sets (128-bit
   digest) form a class; exact copies cost nothing further.
2. Two sets that reach the threshold share one of their first ``n - ceil(t * n) + 1`` n-grams
   in any order common to all sets.  The order is that of the hashes, with n-grams that repeat
   within tasks put last (a mask of fixed size), so that common passages make no groups.
   Only n-grams that sets of compatible sizes share go on: the seats of a set.
3. Sets that meet at an n-gram are compared by signature trees: nodes hold the OR of bitmaps,
   the range of sizes and the labels.  A dual traversal drops node pairs whose largest possible
   overlap cannot reach the threshold, and those of one component.  Bitmaps grow with the sets.
4. First in rounds: every set takes the seat where most sets meet, and there the likeliest
   partner of another component; pairs are verified on full sets and components merged, until a
   round links little.  A group of near copies is thus joined with a pair a set and round.
   Then, exactly: at each n-gram where components still meet, sets are compared by signatures of
   a fourth of their elements.  Those that may be linked form families, in which they meet once
   more, with signatures of all elements; what is left is verified.  The sets of the largest
   component at a meeting are not compared with one another, so they are sent once.

Null texts and texts without words have empty sets and link with nothing.  Rows with equal ids
count as separate texts of one id; null ids take part and never name a component.  Empty tables
give empty results.  Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, rows_of, staged, text_batches, tidy, unstage
from .components import components

#: Sets compared in one tree; larger meetings are cut into blocks of this size.
BLOCK = 2048
#: Rounds of likeliest partners at most; what is left is compared exactly.
ROUNDS = 8
#: Bits of a signature for each element in it at least, and the share of elements in a sketch; sets in a leaf, children of an inner node.
BITS_EACH, SKETCHED, LEAF, FANOUT = 4, 4, 16, 8
#: Buckets of the mask of repeated n-grams, and those it may hold; repeats within a task and in all that count.
MASK, MOST_MASKED, IN_TASK, IN_ALL = 1 << 25, 1 << 21, 2, 8
#: Elements counted at once when repeats are sought; pairs verified with one copy of a set.
COUNTED, SLICE = 2_000_000, 512
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter text is one n-gram."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out * ODD + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def prefix(s: np.ndarray, mask: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first n-grams of a set in the common order; the bits of ``mask`` tell which buckets come last."""
    p = len(s) - -(-num * len(s) // den) + 1
    bucket = (s % np.uint64(MASK)).astype(np.int64)
    last = (mask[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1).astype(bool)
    first = s[~last][:p]
    return first if len(first) == p else np.append(first, s[last][: p - len(first)])


def repeated(docs: DataFrame, n: int) -> np.ndarray:
    """The mask of buckets of n-grams that many different sets share, from repeats within tasks.

    Counts cover all documents.  If more than ``MOST_MASKED`` buckets qualify, the most repeated ones are taken; the
    mask only changes the order in which n-grams are looked at, never which pairs are found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = [], set()

        def flush() -> pa.RecordBatch:
            values = np.concatenate([np.zeros(0, np.uint64), *held])
            held.clear()
            known.clear()
            values.sort()
            at = np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values)) if len(values) else np.zeros(1, np.int64)
            counts = np.diff(at)
            many = counts >= IN_TASK
            return pa.RecordBatch.from_arrays([pa.array((values[at[:-1][many]] % np.uint64(MASK)).astype(np.int64)), pa.array(counts[many].astype(np.int64))], ["bucket", "n"])

        size = 0
        for batch in batches:
            for (text,) in rows_of(batch):
                s = shingles(text, n)
                key = xxhash.xxh3_128_digest(s.tobytes())
                if key in known:
                    continue
                known.add(key)
                held.append(s)
                size += len(s)
                if size >= COUNTED:
                    yield flush()
                    size = 0
        yield flush()

    counts = docs.select("text").mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= IN_ALL)
    counts = staged(counts, "repeated")
    levels = {r.level: r.n for r in counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("n")).collect()}  # at most 64 rows
    least, total = 64, 0
    while least > 0 and total + levels.get(least - 1, 0) <= MOST_MASKED:
        least -= 1
        total += levels.get(least, 0)
    mask = np.zeros(MASK, bool)
    mask[[r.bucket for r in counts.where(F.col("n") >= 2.0**least).select("bucket").collect()]] = True  # at most MOST_MASKED
    unstage(counts)
    return np.packbits(mask, bitorder="little")


def sets_table(docs: DataFrame, mask: np.ndarray, num: int, den: int, n: int) -> DataFrame:
    """One row per document: size, 128-bit digest, short key and (once in a task for equal sets) the prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(mask)  # MASK bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set()
        for batch in batches:
            size, digest, short, parts = [], [], [], []
            for _, _, text in rows_of(batch):
                s = shingles(text, n)
                raw = s.tobytes()
                d = xxhash.xxh3_128_digest(raw)
                size.append(len(s))
                digest.append(d if len(s) else None)
                short.append(int.from_bytes(d[:8], "little", signed=True))
                fresh = len(s) > 0 and d not in known
                known.add(d)
                parts.append(prefix(s, shared.value, num, den).view(np.int64) if fresh else np.zeros(0, np.int64))
            offsets = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(short, pa.int64()), listed], ["id", "text_hash", "n", "digest", "short", "prefix"])

    return docs.mapInArrow(tidy(run), "id long, text_hash long, n long, digest binary, short long, prefix array<long>")


def bitmap(s: np.ndarray, share: int = 1, each: int = BITS_EACH) -> bytes:
    """A signature of at least ``each`` bits an element, a power of two from 64 on; of one element in ``share``, the same ones in all sets."""
    h = mix(s ^ ODD)
    size = max(64, 1 << (each * len(s) // share).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(h[(h >> np.uint64(40)) % np.uint64(share) == 0] % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def of_documents(docs: DataFrame, chosen: DataFrame, size: int, n: int, made: dict[str, Callable[[np.ndarray], bytes]]) -> DataFrame:
    """(k, *made) of the ``size`` classes (k, id, text_hash, digest) in ``chosen``: what each of ``made`` makes of their sets."""
    rows = docs.alias("d").join(broadcast_if_small(chosen, size, 64).alias("c"), (F.col("d.text_hash") == F.col("c.text_hash")) & F.col("d.id").eqNullSafe(F.col("c.id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], {x: [] for x in made}
            for k, digest, text in rows_of(batch):
                s = shingles(text, n)
                if xxhash.xxh3_128_digest(s.tobytes()) == digest:
                    keys.append(k)
                    for x, make in made.items():
                        out[x].append(make(s))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(v, pa.binary()) for v in out.values())], ["k", *out])

    found = rows.select("c.k", "c.digest", "d.text").mapInArrow(tidy(run), "k long, " + ", ".join(f"{x} binary" for x in made))
    return found.dropDuplicates(["k"])  # equal rows make it twice


def verified(pairs: DataFrame, n: int, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the ``n`` pairs (a, b) whose full sets reach the threshold; a set meets its partners in slices, so that none is alone with all."""
    slices = F.ceil(F.count("*").over(Window.partitionBy("b")) / SLICE)
    cut = pairs.select("a", "b", F.pmod(F.xxhash64("a"), slices).alias("slice"))
    small = lambda df: broadcast_if_small(df, n, 24)
    hubs = sets.join(small(cut.select("b", "slice").distinct()), F.col("k") == F.col("b")).select("b", "slice", F.lit(0).alias("part"), F.lit(None).cast("long").alias("a"), "data")
    rows = hubs.unionByName(sets.join(small(cut), F.col("k") == F.col("a")).select("b", "slice", F.lit(1).alias("part"), "a", "data"))
    rows = rows.repartition("b", "slice").sortWithinPartitions("b", "slice", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for batch in batches:
            a, b = [], []
            for y, _, part, x, data in rows_of(batch):
                own = np.frombuffer(data, np.uint64)
                if part == 0:
                    hub = own
                    continue
                both = np.concatenate([hub, own])
                both.sort(kind="stable")  # two sorted runs: a merge
                common = int((both[1:] == both[:-1]).sum())
                if den * common >= num * (len(both) - common):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(tidy(run), "a long, b long")


class Tree:
    """A signature tree over sets; level 0 holds the leaves.  A level: bitmaps, least and most size, hidden elements, least and most label."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, label: np.ndarray):
        self.n, self.bits, self.label = n, bits, label
        level = (bits, n, n, n - np.bitwise_count(bits).sum(1, dtype=np.int64), label, label)  # elements without a bit of their own
        self.levels, step = [], LEAF
        while not self.levels or len(level[1]) > 1:
            starts = np.arange(0, len(level[1]), step)
            level = tuple(f.reduceat(c, starts) for f, c in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum), level))
            self.levels.append(level)
            step = FANOUT


def chunks(i: np.ndarray, j: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, (16 << 20) // (8 * width))
    for at in range(0, len(i), step):
        yield i[at : at + step], j[at : at + step]


def possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether node pairs may hold a linked pair of two labels, by the largest overlap their bitmaps and sizes allow."""
    out = [np.zeros(0, bool)]
    for p, q in chunks(i, j, a[0].shape[1]):
        common = np.bitwise_count(a[0][p] & b[0][q]).sum(1, dtype=np.int64) + np.minimum(a[3][p], b[3][q])
        most = np.minimum(np.minimum(a[2][p], b[2][q]), common)
        same = (a[4][p] == a[5][p]) & (b[4][q] == b[5][q]) & (a[4][p] == b[4][q])
        out.append((most * (num + den) >= num * (a[1][p] + b[1][q])) & ~same)
    return np.concatenate(out)


def traverse(x: Tree, y: Tree, same: bool, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Dual traversal: chunks of candidate pairs of positions (x, y) of different labels and their largest possible similarity; each once if ``same`` tree."""
    lx, ly = len(x.levels) - 1, len(y.levels) - 1
    i = j = np.zeros(1, np.int64)
    while True:
        keep = possible(x.levels[lx], i, y.levels[ly], j, num, den)
        i, j = i[keep], j[keep]
        if lx == ly == 0:
            break
        if lx >= ly:
            kids = i[:, None] * FANOUT + np.arange(FANOUT)
            i, j = kids.ravel(), np.repeat(j, FANOUT)
            lx -= 1
            keep = i < len(x.levels[lx][1])
        else:
            kids = j[:, None] * FANOUT + np.arange(FANOUT)
            i, j = np.repeat(i, FANOUT), kids.ravel()
            ly -= 1
            keep = j < len(y.levels[ly][1])
        if same and lx == ly:
            keep &= i <= j
        i, j = i[keep], j[keep]
    cell = np.arange(LEAF)
    for leaf, other in chunks(i, j, LEAF * LEAF * x.bits.shape[1]):
        p = (leaf[:, None, None] * LEAF + cell[:, None] + 0 * cell).ravel()
        q = (other[:, None, None] * LEAF + 0 * cell[:, None] + cell).ravel()
        keep = (p < len(x.n)) & (q < len(y.n))
        if same:
            keep &= p < q
        p, q = p[keep], q[keep]
        keep = x.label[p] != y.label[q]
        nx, ny = x.n[p], y.n[q]
        keep &= np.minimum(nx, ny) * (num + den) >= num * (nx + ny)
        p, q, nx, ny = p[keep], q[keep], nx[keep], ny[keep]
        bx, by = x.bits[p], y.bits[q]
        most = np.minimum(nx - np.bitwise_count(bx & ~by).sum(1, dtype=np.int64), ny - np.bitwise_count(by & ~bx).sum(1, dtype=np.int64))
        keep = most * (num + den) >= num * (nx + ny)
        yield p[keep], q[keep], (most / np.maximum(nx + ny - most, 1))[keep]


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Signatures of a larger size as those of a smaller one."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1)


def meetings(ids: np.ndarray, n: np.ndarray, label: np.ndarray, raw: list[bytes], side: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidate pairs (positions) among sets that meet, between the sides if there are two, by trees over signatures of one size."""
    two = bool(side.any()) and not side.all()
    width = np.array([len(r) for r in raw])
    trees = []
    for s, w in sorted({*zip(side.tolist(), width.tolist())}):
        at = np.flatnonzero((side == s) & (width == w))
        at = at[np.lexsort((ids[at], n[at], label[at], (np.log(n[at]) / np.log(den / num + 1e-9)).astype(int)))]
        bits = np.frombuffer(b"".join(raw[i] for i in at), np.uint64).reshape(len(at), -1)
        trees.append((s, w // 8, at, bits))
    for u, (s, w, at, bits) in enumerate(trees):
        for s2, w2, at2, bits2 in trees[u:]:
            if (two and s == s2) or n[at].max() * den < num * n[at2].min() or n[at2].max() * den < num * n[at].min():
                continue
            words = min(w, w2)
            x = Tree(n[at], folded(bits, words), label[at])
            same = at is at2
            y = x if same else Tree(n[at2], folded(bits2, words), label[at2])
            for p, q, most in traverse(x, y, same, num, den):
                yield at[p], at2[q], most


def tree_pairs(rows: DataFrame, keys: list[str], num: int, den: int, nearest: bool) -> DataFrame:
    """Candidate pairs from rows (keys, side, k, n, label, data) that meet in ``keys``: all, or each set's likeliest one."""
    return met(rows, keys, num, den, "nearest" if nearest else "all")


def families(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) that join sets which are candidates for one another, from seats (e, kind, l, r, side, k, n, label, data): at most one a set and seat."""
    return met(rows, ["e", "kind", "l", "r"], num, den, "families")


def met(rows: DataFrame, keys: list[str], num: int, den: int, mode: str) -> DataFrame:

    def results(group: list[tuple]) -> tuple[np.ndarray, ...]:
        side, ids, n, label = (np.array([r[c] for r in group], np.int64) for c in range(4))
        raw = [r[4] for r in group]
        none = ids[:0]
        if label.min() == label.max():
            return none, none
        if mode == "families":
            root = np.arange(len(ids))
            for p, q, _ in meetings(ids, n, label, raw, side, num, den):
                while (root[p] != root[q]).any():
                    least = np.minimum(root[p], root[q])
                    np.minimum.at(root, root[p], least)
                    np.minimum.at(root, root[q], least)
                    while (root[root] != root).any():
                        root = root[root]
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, root, ids)
            at = np.flatnonzero(least[root] != ids)
            return ids[at], least[root[at]]
        if mode == "all":
            found = [(none, none), *((np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q])) for p, q, _ in meetings(ids, n, label, raw, side, num, den))]
            return tuple(np.concatenate(c) for c in zip(*found))
        best, other = np.full(len(ids), -1.0), np.zeros(len(ids), np.int64)
        for p, q, most in meetings(ids, n, label, raw, side, num, den):
            p, q, most = np.append(p, q), np.append(q, p), np.append(most, most)
            order = np.lexsort((-ids[q], most))  # the last to be written stays: the likeliest, of these the smallest id
            p, q, most = p[order], q[order], most[order]
            better = most > best[p]
            best[p[better]], other[p[better]] = most[better], q[better]
        at = np.flatnonzero(best >= 0)
        return np.minimum(ids[at], ids[other[at]]), np.maximum(ids[at], ids[other[at]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out, seen = None, [], [], set()

        def close() -> None:
            if len(group) > 1:
                for pair in zip(*(c.tolist() for c in results(group))):
                    if pair not in seen:
                        seen.add(pair)
                        out.append(pair)

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([p[c] for p in out], pa.int64()) for c in (0, 1)], ["a", "b"])
            out.clear()
            if len(seen) > 1_000_000:
                seen.clear()
            return got

        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            for key, row in zip(zip(*lists[: len(keys)]), zip(*lists[len(keys) :])):
                if key != now:
                    close()
                    now, group = key, []
                group.append(row)
            yield flush()
        close()
        yield flush()

    ordered = rows.select(*keys, "side", "k", "n", "label", "data").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(tidy(run), "a long, b long")


class Links:
    """Verified links so far, and the components they make; full sets are fetched for the classes that need them."""

    def __init__(self, docs: DataFrame, classes: DataFrame, words: int, num: int, den: int):
        self.docs, self.classes, self.words, self.num, self.den = docs, classes, words, num, den
        self.sets: list[DataFrame] = []
        self.labels: DataFrame | None = None

    def labelled(self, rows: DataFrame) -> DataFrame:
        if self.labels is None:
            return rows.withColumn("label", F.col("k"))
        labels = broadcast_if_small(self.labels.select(F.col("node").alias("k"), "label"), self.labels.count(), 16)
        return rows.join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))

    def add(self, pairs: DataFrame) -> bool:
        """Verify staged ``pairs`` and merge; whether links were a notable share of them."""
        tried = pairs.count()
        if not tried:
            unstage(pairs)
            return False
        ends = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
        for known in self.sets:
            ends = ends.join(known.select("k"), "k", "left_anti")
        ends = staged(ends, "ends")
        more = ends.count()
        if more:
            chosen = self.classes.join(broadcast_if_small(ends, more, 8), "k", "left_semi").select("k", "id", "text_hash", "digest")
            self.sets.append(staged(of_documents(self.docs, chosen, more, self.words, {"data": np.ndarray.tobytes}), "full"))
        links = staged(verified(pairs, tried, functools.reduce(DataFrame.unionByName, self.sets), self.num, self.den), "links")
        found = links.count()
        unstage(ends, pairs)
        if found:
            edges = links if self.labels is None else links.unionByName(self.labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
            before, self.labels = self.labels, staged(components(edges, "jaccard-cc"), "labels")
            if before is not None:
                unstage(before)
        unstage(links)
        return 8 * found > tried


def live(rows: DataFrame) -> DataFrame:
    """Of labelled seats those at n-grams where at least two components meet, with the number of sets there."""
    over = Window.partitionBy("e")
    return rows.withColumns({"lo": F.min("label").over(over), "hi": F.max("label").over(over), "size": F.count("*").over(over)}).where("lo <> hi").drop("lo", "hi")


def home_seats(seats: DataFrame) -> DataFrame:
    """For each set the seat where most sets meet."""
    rows = seats.withColumn("size", F.count("*").over(Window.partitionBy("e")))
    best = rows.groupBy("k").agg(F.max(F.struct("size", "e")).alias("s"), F.first("n").alias("n"))
    return best.select(F.col("s.e").alias("e"), "k", "n")


def in_blocks(rows: DataFrame, round_: int) -> DataFrame:
    """Crowded seats are cut into blocks, otherwise in each round."""
    block = F.pmod(F.xxhash64("k", F.lit(round_)), F.ceil(F.col("size") / BLOCK))
    return rows.select("e", block.alias("block"), F.lit(0).alias("side"), "k", "n", "label")


def all_seats(rows: DataFrame) -> DataFrame:
    """Blocks in which all sets of different labels at an n-gram meet: those outside its largest component with one another and with that component's."""
    seats = rows.repartition("e").withColumn("own", F.count("*").over(Window.partitionBy("e", "label")))
    seats = seats.withColumn("top", F.max(F.struct("own", "label")).over(Window.partitionBy("e")))
    ns, nb = F.ceil((F.col("size") - F.col("top.own")) / BLOCK).cast("int"), F.ceil(F.col("top.own") / BLOCK).cast("int")
    few = F.col("size") <= BLOCK
    seats = seats.withColumns({"ns": ns, "nb": nb, "big": F.col("label") == F.col("top.label"), "h": F.xxhash64("k")})
    mine = F.pmod("h", "ns").cast("int")
    unit = lambda kind, left, right, side: F.struct(F.lit(kind).alias("kind"), left.cast("int").alias("l"), right.cast("int").alias("r"), side.cast("int").alias("side"))
    zero = F.lit(0)
    of_big = F.transform(F.sequence(zero, F.col("ns") - 1), lambda j: unit(1, F.pmod("h", "nb"), j, zero))
    across = F.transform(F.sequence(zero, F.col("nb") - 1), lambda b: unit(1, b, mine, F.lit(1)))
    inner = F.transform(F.sequence(zero, F.col("ns") - 1), lambda j: unit(0, F.least(mine, j), F.greatest(mine, j), F.when(mine > j, 1).otherwise(0)))
    units = F.when(few, F.array(unit(0, zero, zero, zero))).when(F.col("big"), of_big).otherwise(F.concat(across, inner))
    return seats.withColumn("unit", F.explode(units)).select("e", "unit.kind", "unit.l", "unit.r", "unit.side", "k", "n", "label")


def jaccard_components(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (the smallest id it reaches by links of Jaccard similarity
    at least ``num / den`` over word n-grams of ``words`` words), ``text_hash`` and ``component_key`` (null where a document stands alone)."""
    docs = text_batches(df).select(F.col(id_column).cast("long").alias("id"), F.xxhash64(F.col(text_column).cast("string")).alias("text_hash"), F.col(text_column).cast("string").alias("text"))
    base = staged(sets_table(docs, repeated(docs, words), num, den, words), "sets")
    slim = staged(base.select("id", "text_hash", "n", "digest"), "set-ids")
    first = F.min(F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("text_hash").alias("text_hash")))
    classes = base.where("n > 0").groupBy("digest", "short", "n").agg(F.min("id").alias("rep"), first.alias("first"), F.count("*").alias("copies"))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("k"), "digest", "short", "n", "rep", "copies", "first.id", "first.text_hash"), "classes")
    # Sets that share a prefix n-gram with one of a compatible size; equal sets of different tasks count once.
    rows = base.select("short", "n", F.explode("prefix").alias("e")).repartition("e").dropDuplicates(["e", "n", "short"])
    over = Window.partitionBy("e").orderBy("n", "short")
    rows = rows.withColumns({"low": F.lag("n").over(over), "high": F.lead("n").over(over)})
    members = staged(rows.where((F.col("low") * den >= F.col("n") * num) | (F.col("n") * den >= F.col("high") * num)).select("e", "short", "n"), "members")
    unstage(base)
    by_short = broadcast_if_small(classes.select("short", "n", "k"), classes.count(), 24)
    seats = staged(members.join(by_short, ["short", "n"]).select("e", "k", "n"), "seats")
    unstage(members)
    homes = staged(home_seats(seats), "homes")
    wanted = homes.count()
    chosen = classes.join(broadcast_if_small(homes.select("k"), wanted, 8), "k", "left_semi").select("k", "id", "text_hash", "digest")
    sketch = functools.partial(bitmap, share=SKETCHED, each=2)
    maps = staged(of_documents(docs, chosen, wanted, words, {"data": bitmap, "sketch": sketch}), "signatures")
    signatures, sketches = maps.select("k", "data"), maps.select("k", F.col("sketch").alias("data"))
    links = Links(docs, classes, words, num, den)
    for round_ in range(ROUNDS):
        own = broadcast_if_small(in_blocks(live(links.labelled(homes)), round_), wanted, 48)
        if not links.add(staged(tree_pairs(signatures.join(own, "k"), ["e", "block"], num, den, nearest=True), "near-pairs")):
            break
    alike = staged(families(all_seats(live(links.labelled(seats))).join(sketches, "k"), num, den), "alike")
    unstage(seats)
    # Candidates of one family meet once, however many n-grams they share.
    family = staged(components(alike, "family-cc").join(homes.select(F.col("k").alias("node"), "n"), "node"), "families")
    meets = all_seats(live(links.labelled(family.select(F.col("label").alias("e"), F.col("node").alias("k"), "n"))))
    links.add(staged(tree_pairs(meets.join(signatures, "k"), ["e", "kind", "l", "r"], num, den, nearest=False), "tree-pairs"))
    unstage(alike, family, homes)
    named = links.labelled(classes.select("k", "rep", "digest", "copies"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("members")).where("members > 1")
    n_groups = staged(smallest, "components")
    of_class = staged(named.join(broadcast_if_small(n_groups, n_groups.count(), 32), "label").select("digest", "component_id", F.col("label").alias("component_key")), "of-class")
    out = slim.join(broadcast_if_small(of_class, of_class.count(), 48), "digest", "left")
    unstage(maps, classes, n_groups, *links.sets)
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "text_hash", "component_key")
