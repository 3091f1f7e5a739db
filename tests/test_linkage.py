"""Blocking, features, metrics, sweep, files, validator, end to end."""

import random

import pytest

from pyspark.sql import functions as F

from matchloom.operators import blocking, features, matching, metrics, validate
from matchloom.plans import pipeline
from matchloom.sources import sinks, tsv

RECORD = "entity_id string, business_name string, business_address string, country string, ord long"
# Pairs with their blocking score and some features.
PAIRS = {
    "F1": (("amazon india pvt ltd", "outer ring road bangalore"), ("amazon india private limited", "outer ring rd bengaluru"), 0.405405, {"name_lev_ratio": 0.833333, "name_jaro_winkler": 0.942857, "name_token_set": 0.891892, "address_token_sort": 0.708333, "high_name_sim": 1, "name_len_diff": 0.285714}, 0.521511),
    "F2": (("flipkart logistics", "electronic city bangalore"), ("flipkart internet pvt ltd", "electronic city bengaluru"), 0.542857, {"name_lev_ratio": 0.511628, "address_token_set": 0.926829, "address_trigram_jaccard": 0.703704, "high_addr_sim": 1}, 0.491451),
    "F3": (("acme corp", "123 main st"), ("acme corp llc", "123 main st"), 1.15, {"name_token_set": 1.0, "address_digit_exact": 1, "name_trigram_jaccard": 0.636364}, 0.922078),
    "F4": (("acme corp", "123 main st"), ("acme", "main street"), 0.5, {"address_jaro_winkler": 0.662338, "address_token_set": 0.75, "name_len_diff": 0.555556}, 0.391066),
    "F5": (("acme", ""), ("zenith", ""), 1.0, {"address_lev_ratio": 0.0, "name_lev_ratio": 0.2}, 0.028571),
    "F6": (("किराना दुकान", "12 mg road 560001"), ("kirana dukan", "12 m g road 560001"), 0.922727, {"name_lev_ratio": 0.083333, "address_digit_jaccard": 1, "addr_len_diff": 0.055556}, 0.539569),
}


def frames(spark, s1, targets):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(s1)], RECORD), spark.createDataFrame([(*r, k) for k, r in enumerate(targets)], RECORD)


def test_pair_goldens(spark):
    s1, t = frames(spark, [(f"S1-{k}", *a, k) for k, (a, _, _, _, _) in PAIRS.items()], [(f"S2-{k}", *b, k) for k, (_, b, _, _, _) in PAIRS.items()])
    pairs = blocking.generate_candidates(s1, t)
    rows = {r.s1_id[3:]: r for r in features.extract_features(pairs, s1, t).withColumn("h", matching.heuristic_score()).collect()}
    for k, (_, _, score, want, heuristic) in PAIRS.items():
        assert rows[k].score == pytest.approx(score, abs=1e-6)
        assert rows[k].h == pytest.approx(heuristic, abs=1e-6), k
        for c, v in want.items():
            assert rows[k][c] == pytest.approx(v, abs=1e-6), (k, c)
        assert rows[k].is_target_s2 == 1 and rows[k].country_exact_match == 1


def random_records(seed, n, prefix):
    rng = random.Random(seed)
    words = ["ab", "acme", "1", "22", "x", "road", "st", "é"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(4)))
    return [(f"{prefix}{k}", text(), text(), rng.choice(["US", "usa", "", "India", "in", "Unknown", "zz" + prefix])) for k in range(n)]


def test_indexed_finds_every_positive_pair(spark):
    s1, t = frames(spark, random_records(1, 25, "S1-"), random_records(2, 40, "S2-") + random_records(3, 30, "S3-"))
    exact = {(r.s1_id, r.target_id): r.score for r in blocking.generate_candidates(s1, t, k=1000).collect()}
    indexed = {(r.s1_id, r.target_id): r.score for r in blocking.generate_candidates(s1, t, k=1000, mode="indexed").collect()}
    assert indexed == {k: v for k, v in exact.items() if v > 0}


def test_groups_and_ties(spark):
    s1, t = frames(spark, [("S1-1", "acme", "", "us")], [("S2-b", "acme", "", "us"), ("S2-a", "acme", "", "us"), ("X-1", "acme", "", "us"), ("S3-1", "zz", "q", "fr")])
    rows = blocking.generate_candidates(s1, t, k=1).collect()
    assert {(r.grp, r.target_id) for r in rows} == {("S2", "S2-b"), ("S3", "S3-1")}  # first of equals; fallback without a country
    s1, t = frames(spark, [("S1-1", "acme", "", "us")], [("b", "acme", "", "us"), ("a", "acme corp", "", "us")])
    assert [r.target_id for r in blocking.generate_candidates(s1, t).orderBy("rn").collect()] == ["b", "a"]


def test_metrics(spark):
    truth = [("a", "1"), ("a", "3"), ("b", "1"), ("d", "x")]
    found = [("a", "1"), ("a", "2"), ("a", "3"), ("c", "9"), ("d", "x")]
    p, t = (spark.createDataFrame(x, "s1_id string, target_id string") for x in (found, truth))
    keys = spark.createDataFrame([("a",), ("b",), ("d",), ("e",)], "s1_id string")
    rows = {r.s1_id: r for r in metrics.entity_f05(p, t, keys).collect()}
    assert rows["a"].f0_5 == pytest.approx(0.714286, abs=1e-6)
    assert (rows["b"].f0_5, rows["d"].f0_5, rows["e"].f0_5) == (0.0, 1.0, 1.0)
    assert metrics.macro_f05(p, t, p, keys).first().macro_f0_5 == pytest.approx((0.714286 + 0 + 1 + 1 + 0) / 5, abs=1e-6)
    assert metrics.macro_f05_of_truth(p, t, keys).first().macro_f0_5 == pytest.approx(2.714286 / 4, abs=1e-6)
    assert metrics.blocking_recall(p, t).first().blocking_recall == 0.75
    assert metrics.blocking_recall(p, t.where("false")).first().blocking_recall == 1.0
    assert metrics.macro_f05(p.where("false"), t, p.where("false"), p.where("false")).first().macro_f0_5 == 0.0


def test_sweep_against_direct(spark):
    rng = random.Random(4)
    truth = [(f"k{rng.randrange(12)}", f"t{rng.randrange(9)}") for _ in range(30)]
    scored = [(f"k{rng.randrange(15)}", f"t{rng.randrange(9)}", rng.choice([*matching.GRID, rng.random(), 0.05])) for _ in range(150)]
    best = {}
    for a, b, s in scored:
        best[a, b] = max(s, best.get((a, b), 0))
    keys = {a for a, _ in truth} | {"alone"}
    df, t, k = spark.createDataFrame(scored, "s1_id string, target_id string, score double"), spark.createDataFrame(truth, "s1_id string, target_id string"), spark.createDataFrame([(x,) for x in keys], "s1_id string")
    got = {r.threshold: r.macro_f0_5 for r in matching.threshold_sweep(df, t, k).collect()}

    def f(key, thr):
        y, x = {b for a, b in truth if a == key}, {b for (a, b), s in best.items() if a == key and s >= thr}
        if not x or not y:
            return float(not x and not y)
        tp = len(x & y)
        return 1.25 * (tp / len(x)) * (tp / len(y)) / (0.25 * tp / len(x) + tp / len(y)) if tp else 0.0

    assert len(got) == 35
    for thr, v in got.items():
        assert v == pytest.approx(sum(f(x, thr) for x in keys) / len(keys), abs=1e-9)
    assert matching.EntityMatcher().optimize_threshold(df, t, k) == min((x for x in got if got[x] == max(got.values())))


def test_matcher_guards(spark):
    from pyspark.ml.classification import GBTClassifier

    rows = [(f"s{k}", f"t{k}", k % 2, *[float(k % 2) + 0.01 * k] * 20) for k in range(40)]
    schema = "s1_id string, target_id string, label int, " + ", ".join(f"{c} double" for c in features.FEATURES)
    df = spark.createDataFrame(rows, schema)
    m = matching.EntityMatcher(classifier=GBTClassifier(featuresCol="features", labelCol="label", maxIter=3, seed=42)).fit(df)
    out = m.predict_pairs(df).collect()
    assert min(r.score for r in out if r.label) > max(r.score for r in out if not r.label)
    assert {r.score for r in matching.EntityMatcher().fit(df.where("label = 0")).predict_pairs(df).collect()} == {0.0}
    assert len({r.score for r in matching.EntityMatcher().fit(df.where("false")).predict_pairs(df).collect()}) > 1
    assert matching.HEURISTIC == ("name_lev_ratio", "name_trigram_jaccard", "address_lev_ratio", "address_trigram_jaccard", "address_digit_jaccard", "high_addr_sim", "high_name_sim")


def test_tsv_edge_cases(spark, tmp_path):
    path = tmp_path / "x_source1.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\n1\t2\n1\t2\t3\t4\t5\nNA\t\t"x\ty"\t q \n', encoding="utf-8")
    rows = [tuple(r) for r in tsv.load_tsv(spark, str(path)).collect()]
    assert rows == [("1", "2", "", ""), ("NA", "", "x\ty", " q ")]
    assert tsv.DatasetLoader(spark, str(tmp_path)).find_file("source1").endswith("x_source1.tsv")
    with pytest.raises(FileNotFoundError):
        tsv.load_tsv(spark, str(tmp_path / "none.tsv"))
    with pytest.raises(FileNotFoundError):
        tsv.DatasetLoader(spark, str(tmp_path)).find_file("source2")
    (tmp_path / "y.tsv").write_text("entity_id\tbusiness_name\n1\t2\n")
    with pytest.raises(ValueError):
        tsv.load_source(spark, str(tmp_path / "y.tsv"))


def test_export_lines(spark, tmp_path):
    s1 = spark.createDataFrame([("src1_1", 0), ("src1_2", 1), ("src1_3", 2)], "entity_id string, ord long")
    found = spark.createDataFrame([("src1_1", "src2_11"), ("src1_1", "src3_20"), ("src1_1", "src2_10"), ("src1_3", "src2_30"), ("other", "x")], "s1_id string, target_id string")
    cand = spark.createDataFrame([("src1_1", "src2_10"), ("src1_1", "src3_20"), ("src1_3", "src2_30")], "s1_id string, target_id string")
    a, b = tmp_path / "out" / "m.tsv", tmp_path / "out" / "c.tsv"
    sinks.export_submission(s1, found, cand, str(a), str(b))
    assert a.read_text().splitlines() == ["source1_entity_id\tmatched_entity_ids", "src1_1\tsrc2_10,src2_11,src3_20", "src1_2\t", "src1_3\tsrc2_30"]
    assert b.read_text().splitlines() == ["source1_entity_id\tcandidate_entity_ids", "src1_1\tsrc2_10,src3_20", "src1_2\t", "src1_3\tsrc2_30"]


def source_file(path, rows):
    path.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join("\t".join(r) + "\n" for r in rows), encoding="utf-8")


def test_validator(spark, tmp_path):
    for k in (1, 2, 3):
        source_file(tmp_path / f"test_source{k}.tsv", [(f"S{k}-{i}", "n", "a", "c") for i in range(3)])
    m, c = tmp_path / "m.tsv", tmp_path / "c.tsv"
    m.write_text("source1_entity_id\tmatched_entity_ids\nS1-0\tS2-0,S2-0\nS1-0\tS1-1,X\nno tab\n\nS1-9\tS2-8\n")
    c.write_text("source1_entity_id\tcandidate_entity_ids\nS1-0\tS2-0\nS1-1\t\nS1-2\tS3-1\n")
    got = {r.rule: r.n for r in validate.validate(spark, str(m), str(c), str(tmp_path), True).collect() if r.severity == "error"}
    assert got == {"V6": 1, "V7": 1, "V8": 1, "V9": 1, "V10": 1, "V11": 1, "V12": 2, "V13": 1}
    everything = {r.rule for r in validate.validate(spark, str(m), str(c), str(tmp_path)).collect()}
    assert {"V15", "V16"} <= everything and "V11" not in everything
    m.write_text("source1_entity_id\tmatched_entity_ids\nS1-0\tS2-0\nS1-1\t\nS1-2\tS3-1\n")
    assert validate.report(validate.validate(spark, str(m), str(c), str(tmp_path), True)) == (["PASS"], 0)
    for text, rule in (("", "V3"), ("a,b\n", "V4"), ("a\tb\n", "V5")):
        m.write_text(text)
        assert rule in {r.rule for r in validate.validate(spark, str(m), None, str(tmp_path)).collect()}
    assert {r.rule for r in validate.validate(spark, str(tmp_path / "no"), str(c), str(tmp_path)).collect()} >= {"V2"}
    assert {r.rule for r in validate.validate(spark, str(m), str(c), str(tmp_path / "none")).collect()} == {"V1"}


def test_train_and_infer(spark, tmp_path):
    from pyspark.ml.classification import GBTClassifier

    train, test = tmp_path / "train", tmp_path / "test"
    train.mkdir()
    test.mkdir()
    source_file(train / "train_source1.tsv", [("S1-101", "Amazon India Pvt Ltd", "Outer Ring Road Bangalore", "IN"), ("S1-102", "Flipkart Logistics", "Electronic City Bangalore", "IN")])
    source_file(train / "train_source2.tsv", [("S2-201", "Amazon India Private Limited", "Outer Ring Rd Bengaluru", "IN"), ("S2-202", "Flipkart Internet Pvt Ltd", "Electronic City Bengaluru", "IN")])
    source_file(train / "train_source3.tsv", [("S3-301", "Amazon Retail India", "Outer Ring Road Bangalore", "IN"), ("S3-302", "Flipkart India", "Electronic City Bangalore", "IN")])
    (train / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-101\tS2-201,S3-301\nS1-102\tS2-202,S3-302\n")
    for k in (1, 2, 3):
        source_file(test / f"test_source{k}.tsv", [(f"S{k}-901", "Amazon India", "Outer Ring Road Bangalore", "IN")])
    cfg = {"paths": {"train_dir": str(train), "test_dir": str(test), "output_dir": str(tmp_path / "out"), "checkpoint": str(tmp_path / "ckpt")}, "blocking": {"max_candidates_per_s1": 10}, "model": {"threshold": 0.3}}
    small = matching.EntityMatcher(0.3, GBTClassifier(featuresCol="features", labelCol="label", maxIter=3, seed=42))
    out = pipeline.run_training_pipeline(spark, cfg, small)
    assert out["blocking_recall"] == 1.0 and out["num_candidates"] == 8 and out["num_predictions"] == 2
    assert out["macro_f0_5"] == 1.0
    pipeline.run_inference_pipeline(spark, cfg)
    lines = (tmp_path / "out" / "candidate_pairs.tsv").read_text().splitlines()
    assert lines == ["source1_entity_id\tcandidate_entity_ids", "S1-901\tS2-901,S3-901"]
    assert (tmp_path / "out" / "matching_results.tsv").read_text().splitlines()[0] == "source1_entity_id\tmatched_entity_ids"
    assert validate.report(validate.validate(spark, str(tmp_path / "out" / "matching_results.tsv"), str(tmp_path / "out" / "candidate_pairs.tsv"), str(test), True))[1] == 0


def test_match_stream(spark, tmp_path):
    from matchloom.streaming.incremental import match_stream

    s1, t = frames(spark, [("S1-1", "acme corp", "1 main st", "us"), ("S1-2", "zeta", "9 side rd", "us")], [("S2-1", "acme corp", "1 main st", "us"), ("S3-1", "other", "x", "us")])
    for k in (1, 3):
        t.where(F.col("entity_id") == f"S{5 - k if k == 3 else 3}-1").write.mode("append").parquet(str(tmp_path / "in"))
    arrivals = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    match_stream(arrivals, s1, matching.EntityMatcher(0.5), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = {(r.s1_id, r.target_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {("S1-1", "S2-1")}


def test_tree_by_header_and_open_quotes(spark, tmp_path):
    """Files with other column orders, missing columns and quoted line ends; ground truth anywhere in the path is left out."""
    from matchloom.sources import tsv

    (tmp_path / "a").mkdir()
    (tmp_path / "ground_truth").mkdir()
    (tmp_path / "a" / "x.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tname1\taddr1\tUS\n")
    (tmp_path / "a" / "y.tsv").write_text("country\tbusiness_name\tentity_id\nIN\t\"two\nlines\"\tS2-1\n")
    (tmp_path / "ground_truth" / "z.tsv").write_text("entity_id\nS9-9\n")
    rows = sorted((r.entity_id, r.business_name, r.business_address, r.country) for r in tsv.scan_tree(spark, str(tmp_path)).collect())
    assert rows == [("S1-1", "name1", "addr1", "US"), ("S2-1", "two\nlines", "", "IN")]


def test_validator_bytes_and_lines(spark, tmp_path):
    """A replacement character is valid UTF-8, a Latin-1 byte is not; line numbers go on over splits; a broken checkpoint is passed over."""
    import warnings

    from pyspark.sql import functions as F

    from matchloom.operators import matching, validate
    from matchloom.sources import tsv

    required = spark.createDataFrame([("S1-1",)], "entity_id string")
    (tmp_path / "good.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-\ufffd\n", encoding="utf-8")
    (tmp_path / "bad.tsv").write_bytes(b"source1_entity_id\tmatched_entity_ids\nS1-1\tS2-\xe9\n")
    rules = lambda name: [r.rule for f in validate.file_findings(spark, str(tmp_path / name), validate.MATCH_HEADER, required, None)[0] for r in f.collect()]
    assert rules("good.tsv") == [] and rules("bad.tsv") == ["V17"]
    text = tmp_path / "many.txt"
    text.write_text("".join(f"row {k} {'x' * 50}\n" for k in range(1, 20_001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        lines = validate.with_line_numbers(tsv.numbered(spark.read.text(str(text))))
        assert lines.rdd.getNumPartitions() > 1 or lines.count() == 20_000
        assert lines.where(F.split("value", " ")[1].cast("long") != F.col("line")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "model" / "matcher").mkdir(parents=True)
    (tmp_path / "model" / "matcher" / "part-0").write_text("not json")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert matching.EntityMatcher.load(spark, str(tmp_path / "model")) is None and said
