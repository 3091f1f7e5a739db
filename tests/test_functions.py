"""Column functions: goldens, and random pairs against plain Python."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from matchloom.functions import scripts, similarity
from matchloom.functions import text as X


def test_normalize(spark):
    rows = [("Ａｃｍｅ  Ｃｏｒｐ  Café", "acme corp café"), ("  अमज़ॉन   株式会社  ", None), (None, ""), ("", ""), ("a\x1cb c", "a b c"), ("  TEST Corp  ", "test corp")]
    got = [r.n for r in spark.createDataFrame([(k, a) for k, (a, _) in enumerate(rows)], "k int, t string").orderBy("k").select(X.normalize(F.col("t")).alias("n")).collect()]
    for (_, want), have in zip(rows, got):
        assert want is None or have == want


GOLDENS = [
    ("किराना दुकान", "kirAnA"), ("মুদি দোকান", "mudi"), ("மளிகை கடை", "maLighai"), ("కిరాణా కొట్టు", "kirANA"), ("ಕಿರಣ ಅಂಗಡಿ", "kiraNa"), ("മളികക്കട", "maLikakkaTa"), ("કરિયાણાની દુકાન", "kariyANAnI"), ("ਕਰਿਆਨਾ ਦੁਕਾਨ", "kariAnA"), ("ମୁଦି ଦୋକାନ", "mudi"),
    ("ABC किराना Store", "ABC kirAnA Store"), ("Unit 4-B/12, #99 (किराना Store) - Pin: 560001!", "Unit 4-B/12, #99 (kirAnA Store) - Pin: 560001!"), ("तक", "taka"), ("తెలుగు", "tèlugu"), ("Amazon Retail LLC", "Amazon Retail LLC"),
]


@pytest.mark.parametrize(("text", "want"), GOLDENS)
def test_itrans(text, want):
    assert want in scripts.to_itrans(text)
    assert scripts.to_itrans(text) == scripts.to_itrans(text)


def test_nukta_stays():
    out = scripts.to_itrans("ଓଡ଼ିଆ")
    assert "Da" in out and out.endswith("iA") and "଼" in out


def test_script_detection(spark):
    rows = [("কখ किराना", "DEVANAGARI", ["BENGALI", "DEVANAGARI"]), ("कক", "DEVANAGARI", ["DEVANAGARI", "BENGALI"]), ("abc", None, []), (None, None, []), ("", None, [])]
    got = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(rows)], "k int, t string").orderBy("k").select(scripts.detect_primary_script(F.col("t")).alias("p"), scripts.detect_indic_scripts(F.col("t")).alias("s")).collect()
    assert [(r.p, r.s) for r in got] == [(p, s) for _, p, s in rows]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_lcs_random_pairs():
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcé किरा") for _ in range(rng.randrange(30)))
    for _ in range(2000):
        a, b = word(), word()
        assert similarity.common_subsequence(a, b) == slow_lcs(a, b)
    assert similarity.indel("", "") == 1.0


@pytest.mark.parametrize(("a", "b", "want"), [("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("acme corp", "acme corp llc", 0.938462), ("acme", "zenith", 0.472222), ("", "", 1.0), ("a", "", 0.0), ("café", "cafe", 0.883333)])
def test_jaro_winkler(a, b, want):
    assert similarity.jaro_winkler(a, b) == pytest.approx(want, abs=1e-6)


def test_gram_sets_against_python(spark):
    rng = random.Random(1)
    texts = ["", "a", "ab", "abc", "Ab É", "किराना", "a😀b😀"] + ["".join(rng.choice("aB 1é#") for _ in range(rng.randrange(20))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k")
    got = df.select(X.gram_set(F.col("t")).alias("g"), X.feature_gram_set(F.col("t")).alias("f"), X.token_list(F.col("t")).alias("w"), X.digit_runs(F.col("t")).alias("d")).collect()
    for t, r in zip(texts, got):
        p = f" #{t.lower()}# "
        assert set(r.g) == {p[i : i + 3] for i in range(len(p) - 2)} and len(r.g) == len(set(r.g))
        assert set(r.f) == ({p[i : i + 3] for i in range(max(1, len(t) - 2))} if t else set())
        assert r.w == re.findall(r"\w+", t.lower()) and set(r.d) == set(re.findall(r"\d+", t))


def test_id_lists(spark):
    rows = [("a, b,,c ", ["a", "b", "c"], ["a", " b", "", "c "]), ("", [], []), (" ", [], []), (None, [], [])]
    got = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(rows)], "k int, t string").orderBy("k").select(X.id_list(F.col("t")).alias("a"), X.id_list(F.col("t"), False).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(a, b) for _, a, b in rows]


def test_examples(spark):
    rows = [(["b", "a"],), ([str(k) for k in range(7)],)]
    got = [r[0] for r in spark.createDataFrame(rows, "x array<string>").select(X.examples(F.col("x"))).collect()]
    assert got == ["a, b", "0, 1, 2, 3, 4 ... (7 total)"]


def test_set_ratio_is_symmetric():
    words = [["acme"], ["acme", "corp"], ["zeta"], []]
    for a, b in itertools.product(words, words):
        assert similarity.best_of_sets(a, b) == pytest.approx(similarity.best_of_sets(b, a))
