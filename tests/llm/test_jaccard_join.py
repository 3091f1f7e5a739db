"""Jaccard components against all pairs."""

import random

import numpy as np
import pytest

from matchloom.llm import jaccard_join as J


def sets_of(text, n):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(docs, n, num, den):
    rows = [(k, sets_of(t, n)) for k, t in docs]
    label = {k: k for k, _ in rows}

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return {k: (len(s), find(k)) for k, s in rows}


def corpus(seed, groups=12, copies=14):
    rng = random.Random(seed)
    docs = []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 5, 12, 14, 40, 120, 300]))]
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                at = rng.randrange(len(w))
                kind = rng.random()
                if kind < 0.5:
                    w[at] = f"v{rng.randrange(99)}"
                elif kind < 0.8 and len(w) > 1:
                    del w[at]
                else:
                    w.insert(at, "new")
            docs.append((len(docs) * 3 + 1, rng.choice([" ", "\n", "\t "]).join(w)))
    return docs + [(5000, None), (5001, ""), (5002, "  \n"), (5003, "One"), (5004, "one"), (5005, "ONE two")]


@pytest.mark.parametrize(("words", "num", "den", "block", "rounds"), [(3, 90, 100, 2048, 8), (5, 80, 100, 2048, 8), (3, 90, 100, 4, 0), (3, 80, 100, 4, 1), (5, 50, 100, 6, 2)])
def test_components(spark, monkeypatch, words, num, den, block, rounds):
    for name, value in (("BLOCK", block), ("ROUNDS", rounds), ("IN_TASK", 2), ("IN_ALL", 3), ("SLICE", 3)):
        monkeypatch.setattr(J, name, value)
    docs = corpus(words)
    got = J.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), words=words, num=num, den=den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, words, num, den)
    assert len(got) == len(docs)


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_rows_ids_and_columns(spark):
    """Equal rows count each; different texts of one id stay apart; null ids take part; other columns don't matter."""
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(7, one), (7, one), (7, two), (9, two + " more"), (None, one), (3, one + " end"), (None, None), (8, None), (8, "")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, id int, label int, n int")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.component_key is None) for r in J.jaccard_components(df).collect())
    assert got == sorted([("7", 36, "3", False)] * 2 + [("7", 36, "7", False), ("9", 37, "7", False), ("None", 36, "3", False), ("3", 37, "3", False), ("None", 0, "None", True), ("8", 0, "8", True), ("8", 0, "8", True)])
    keys = {(r.doc_id, r.text_hash): r.component_key for r in J.jaccard_components(df).collect() if r.component_key is not None}
    assert len(keys) == 5 and len(set(keys.values())) == 2


def test_prefixes_of_linked_sets_meet():
    """Sets at the threshold share a prefix element whatever their sizes and the mask."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        masked = rng.integers(0, 256, J.MASK // 8, dtype=np.uint8) * rng.choice([0, 1]).astype(np.uint8)
        n = int(rng.integers(1, 400))
        common = rng.integers(0, 2**63, n, dtype=np.uint64)
        extra = int((n * 100 // 90 - n))
        split = int(rng.integers(0, extra + 1))
        own = rng.integers(0, 2**63, extra, dtype=np.uint64)
        x, y = np.unique(np.append(common, own[:split])), np.unique(np.append(common, own[split:]))
        assert set(J.prefix(x, masked, 90, 100).tolist()) & set(J.prefix(y, masked, 90, 100).tolist())


@pytest.mark.parametrize(("two", "share"), [(False, 1), (True, 1), (True, 4)])
def test_trees_find_what_scanning_finds(two, share):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.append(base[: int(rng.integers(60, 300))], rng.integers(0, 2**63, int(rng.integers(0, 25)), dtype=np.uint64))) for _ in range(150)]
    n = np.array([len(s) for s in sets])
    label, side = rng.integers(0, 30, 150), rng.integers(0, 2, 150) * two
    found = {(min(i, j), max(i, j)) for p, q, _ in J.meetings(np.arange(150), n, label, [J.bitmap(s, share) for s in sets], side, 80, 100) for i, j in zip(p.tolist(), q.tolist())}
    wanted = {(i, j) for j in range(150) for i in range(j) if label[i] != label[j] and (not two or side[i] != side[j])}
    linked = {(i, j) for i, j in wanted if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert linked and linked <= found <= wanted and len(found) < len(wanted)
