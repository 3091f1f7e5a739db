"""Decontamination against a brute-force version."""

import hashlib
import random
import re

from matchloom.llm.decontaminate import decontaminate

GAP = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return GAP.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, span=10):
    out = {}
    for key, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            b = words(t)
            n = min(span, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        out[key] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate(d, b).collect()
    assert len(rows) == len(docs)
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}


def test_random_texts_with_planted_spans(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "Dé", "e9", "ß", "the"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([30, 12, 10, 9, 3, 1, 0, 25])] + [(8, None), (9, "The, the; THE")]
    docs = [(k, text(rng.randrange(0, 60))) for k in range(40)]
    docs += [(100, None), (101, ""), (102, items[0][1].upper()), (103, "x " * 50 + items[1][1] + " y" * 20), (104, "...!!!"), (105, text(4000))]
    assert run(spark, docs, items) == brute(docs, items)


def test_long_distinct_words(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    items = [(k, text(40)) for k in range(5)]
    docs = []
    for k in range(30):
        n = rng.randrange(5, 20)  # spans shorter than ten words are no hits
        cut = items[k % 5][1].split()[k % 20 : k % 20 + n]
        docs.append((k, " ".join([text(15), *cut, text(15)])))
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    assert {True, False} == {v[-1] for v in want.values()}


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == {}
    assert run(spark, [(1, "a b c")], [])[1][:3] == (3, 0, 0)


def test_repeated_rows_ids_and_clashing_columns(spark):
    """Texts of one id are judged apart, equal rows alike; further columns named as the result's do no harm."""
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"x {item} y", 7, "a"), (1, "clean words here", 8, "b"), (2, item, 9, "c"), (2, item, 9, "c"), (None, item, 1, None)], "doc_id long, text string, n_hit int, key string")
    rows = decontaminate(docs, spark.createDataFrame([("q1", item, 5), ("q1", item, 5), ("q2", item, 6)], "item_id string, text string, w int")).collect()
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in rows)
    assert got == [(0, 11, 11, 2), (1, 3, 0, 0), (1, 13, 11, 2), (2, 11, 11, 2), (2, 11, 11, 2)]
