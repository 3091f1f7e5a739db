"""The corpus pipeline on a small table: what goes, what stays, and packing of the rest."""

import random

import corpus_pipeline as P
from matchloom.llm import decontaminate


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["the", "of", "and"]) + rng.choice("abcdefghij") + str(rng.randrange(200)) for _ in range(n))
    items = [(1, text(30))]
    base, dirty = text(200), text(40) + " " + items[0][1]
    docs = [(k, text(rng.randrange(30, 120)), "en", f"s{k % 3}") for k in range(60)]
    docs += [(100, base, "en", "s0"), (101, base, "en", "s1"), (102, base + " more", "en", "s0"), (103, dirty, "en", "s2"), (104, None, "en", "s0"), (105, "", None, None), (100, base, "en", "s0")]
    docs = [(*r, len(r[1] or "")) for r in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(k, 1, 0) for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    kept = df
    seen = []
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == df.columns, name
        seen.append(sorted(r.doc_id for r in kept.collect()))
    every = sorted(r[0] for r in docs)
    assert seen[0] == every  # one class of labels: all have its score
    assert seen[1] == [k for k in every if k not in (104, 105)]
    assert seen[2] == [*range(60), 100, 103]
    assert seen[3] == [*range(60), 100]
    assert not any(r.contaminated for r in decontaminate.decontaminate(kept, spark.createDataFrame(items, "item_id long, text string")).collect())
    pieces = P.run(spark, sf).collect()
    assert {p.doc_id for p in pieces} == set(seen[3])
    lengths = {}
    for p in pieces:
        lengths[p.doc_id] = lengths.get(p.doc_id, 0) + p.length
    assert all(lengths[p.doc_id] == p.doc_tokens for p in pieces)
