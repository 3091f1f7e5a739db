"""Token counts and packing against the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from matchloom.llm import bpe, packing, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "  \n ", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|> x", "it's É ß 12 a_b … \x1c x y\x85z", "'r're they'll !!'s", "日本語 テスト", "İstanbul é", "x" * 3000, "½ª²", "a b c", "ǅ ﬁ", "%%% a--b"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n=60):
    rng = random.Random(1)
    parts = ["th", "er", "in", "que", "ché", "ung", "ñ", "A", "Z9", ".", ",", " ", " ", "\n", "'s", "ß", "-"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 300))) for _ in range(n)] + ODD


def test_counts_at_every_prefix(spark, library):
    rows = list(enumerate(texts()))
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH, budgets=(5, 50), keep_prefixes=True).collect()
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rng = random.Random(2)
    for r in got:
        text = rows[r.doc_id][1] or ""
        table = np.frombuffer(r.prefix_counts, "<u4")
        assert (r.n_bytes, r.n_tokens, len(table)) == (len(text.encode()), count(text), len(text))
        for at in rng.sample(range(len(text) + 1), min(15, len(text) + 1)):
            assert token_counts.tokens_before(r.prefix_counts, at) == count(text[:at]), (text[:at],)
        for b, fit in ((5, r.fit_chars_5), (50, r.fit_chars_50)):
            assert fit == token_counts.cut_at(r.prefix_counts, b) and (fit == 0 or count(text[:fit]) <= b)
            assert fit == len(text) or (table[fit:] > b).all()


def test_long_odd_chunks_take_one_pass(library):
    """100,000 characters without white space, with special strings or decomposed letters: exact at sampled prefixes, in linear time."""
    import time

    rng = random.Random(6)
    model = bpe.WordBPE(PATH)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    control = "".join(rng.choice(["the", "<|endoftext|>", "<|endof", "a1", "!!", "'re", "<|startoftext|>", "<|", "|>"]) for _ in range(25_000))
    letters = "".join(rng.choice(["e\u0301", "a\u0300", "o\u0308\u0301", "x\u0302", "the", "'", "s", "7", "İ", "ΑΣ", "\u1100\u1161\u11a8", "Å"]) for _ in range(50_000))
    for text in (control[:100_000], letters[:100_000]):
        began = time.perf_counter()
        counts = model.odd_prefixes(text)
        assert time.perf_counter() - began < 60 and len(counts) == len(text)
        for at in [*range(1, 60), *rng.sample(range(60, 3000), 60), len(text)]:
            assert counts[at - 1] == count(text[:at]), text[max(0, at - 20) : at]


def test_word_table_survives_forgetting(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_CHUNKS", 20)
    import pyarrow as pa

    model = bpe.WordBPE(PATH)
    for t in [x or "" for x in texts(30)] * 2:
        assert model.encode(pa.array([t]))[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_shared_beginnings_are_walked_once(library):
    """A word of 1,500 letters and all its beginnings: the counts of walking each alone, in a fraction of its time."""
    import time

    rng = random.Random(3)
    word = "".join(rng.choice(["the", "ing", "é", "que", "s", "er", "x", "ß"]) for _ in range(1500))[:1500]
    words = [word[:k] for k in range(1, len(word) + 1)]
    rng.shuffle(words)
    model = bpe.WordBPE(PATH)
    alone = {}
    began = time.process_time()
    for w in words:
        alone[w] = model.solve(w)[1]
    apart, began = time.process_time() - began, time.process_time()
    model.start(True)
    rows = model.rows_of(words)
    assert time.process_time() - began < apart / 4
    for w, r in zip(words, rows):
        assert model.data[model.at[r] : model.at[r + 1]].tolist() == alone[w]
    for k in rng.sample(range(1, len(word)), 40):
        assert alone[word[:k]][-1] == len(library.encode(word[:k], add_special_tokens=False).ids)


def test_prefix_table_survives_forgetting(library, monkeypatch):
    """Few rows kept, words met before as chunks or within them, letters of two bytes at the fork of two words, repeated and odd texts."""
    import pyarrow as pa

    monkeypatch.setattr(bpe, "MAX_CHUNKS", 15)
    model = bpe.WordBPE(PATH)
    own = ["thé thè thés, thé! the then then. Then's 'S 's", "", "é è ê", "a<|endoftext|>the the<|", "naïve naïf naîf\u0301 naive\u0301", "ÀÈ àè ÷× a÷b", "aaa aaaa aaaaa aaaaaaaaaaa !!!! !!!!!!"]
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for t in [x or "" for x in [*own, *texts(10), *own]]:
        t = t[:300]
        counts, chars = model.prefix_counts(pa.array([t, t]))
        want = [count(t[:k]) for k in range(1, len(t) + 1)]
        assert chars.tolist() == [len(t)] * 2 and counts.tolist() == want * 2, t


def test_pairs_by_merges_in_reverse():
    """Whether two tokens stand side by side, against merging their characters; equal letters and split tokens too."""
    model, rng = bpe.WordBPE(PATH), random.Random(4)
    tokens = sorted(model.vocab)
    opens = [t for t in tokens if not t.endswith(model.end)]
    one = [t for t in tokens if len(set(t.removesuffix(model.end))) == 1]
    pairs = [(a, b) for a in one for b in one if a[0] == b[0] and not a.endswith(model.end)]
    pairs += [(rng.choice(opens), rng.choice(tokens)) for _ in range(5000)]
    for t in rng.sample(tokens, 5000):
        k = rng.randrange(1, max(2, len(t.removesuffix(model.end))))
        pairs += [(t[:k], t[k:])] * (t[:k] in model.vocab and t[k:] in model.vocab and t[k:] != model.end)
    expected = [model.merged(model.atoms(a) + model.atoms(b)) == [a, b] for a, b in pairs]
    assert [model.stands(a, b) for a, b in pairs] == expected and 0 < sum(expected) < len(pairs)
    model.made = None  # as for a vocabulary whose merges have another order
    model.follow = {"": ({}, {})}
    assert [model.stands(a, b) for a, b in pairs] == expected


@pytest.mark.parametrize("sources", [1, 3, 40])
def test_packing(spark, library, sources):
    rows = [(k, t, None if k % 11 == 0 else f"s{min(k % sources, k % 7 % sources)}") for k, t in enumerate(texts(120))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    pieces = packing.pack(df, PATH, length=256).collect()
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t, _ in rows}
    fill, at = {}, dict.fromkeys(ids, 0)
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at[p.doc_id] and p.doc_tokens == len(ids[p.doc_id])
        at[p.doc_id] += p.length
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        fill.setdefault(p.sequence_id, []).append((p.offset, p.length, p.source))
    assert at == {k: len(v) for k, v in ids.items()}
    total = sum(map(len, ids.values()))
    assert sorted(fill) == list(range(-(-total // 256)))
    share = {s: sum(len(ids[k]) for k, _, x in rows if x == s) / total for s in {x for _, _, x in rows}}
    for s, spans in fill.items():
        end = 0
        for offset, length, _ in sorted(spans):
            assert offset == end
            end += length
        assert end == 256 or s == max(fill)
        if end == 256:  # every window holds the target mix
            for name, part in share.items():
                assert abs(sum(n for _, n, x in spans if x == name) - 256 * part) <= len(share) + 2


def test_packing_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string"), PATH).collect() == []


def test_packing_by_mixture(spark):
    """Windows hold the weights' proportions until a queue is dry, then those of the others; sources without a weight come last."""
    rows = [(k, "th er in " * (5 + k % 40), [None, "a", "b", "c", "d"][k % 5]) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mixture = {"a": 6.0, "b": 3.0, None: 1.0, "c": 0.0, "absent": 5.0}
    pieces = packing.pack(df, PATH, length=512, mixture=mixture).collect()
    size, source = {p.doc_id: p.doc_tokens for p in pieces}, {k: s for k, _, s in rows}
    at, fill, left = dict.fromkeys(size, 0), {}, {}
    for k, n in size.items():
        left[source[k]] = left.get(source[k], 0) + n
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at[p.doc_id]
        at[p.doc_id] += p.length
        fill.setdefault(p.sequence_id, []).append(p)
    assert at == size and len(size) == len(rows) and sorted(fill) == list(range(-(-sum(size.values()) // 512)))
    weights, mixed = {s: mixture.get(s, 0) for s in left}, 0
    for s in range(len(fill)):
        held, end = {}, 0
        for p in sorted(fill[s], key=lambda p: p.offset):
            assert p.offset == end
            end += p.length
            held[source[p.doc_id]] = held.get(source[p.doc_id], 0) + p.length
        assert end == 512 or s == len(fill) - 1
        live = {x: w for x, w in weights.items() if w and left[x]}
        if live and all(left[x] >= 512 for x in live) and end == 512:
            mixed += 1
            for x, w in live.items():
                # a window is longer than a round by up to a window over the epoch's rounds, ten at least here; one queue may send all of that
                assert abs(held.get(x, 0) - 512 * w / sum(live.values())) <= 512 / 10 + 2 * len(live)
            assert not held.keys() - live.keys()
        for x, n in held.items():
            left[x] -= n
    assert mixed > 10 and set(left.values()) == {0}


def test_packing_refuses_empty_mixtures(spark):
    df = spark.createDataFrame([(1, "th", "a")], "doc_id long, text string, source string")
    for mixture in ({}, {"a": 0.0}, {"a": -1.0, "b": 1.0}, {"a": float("inf")}):
        with pytest.raises(ValueError):
            packing.pack(df, PATH, mixture=mixture)


def test_rounds_beyond_64_bits():
    small, large = packing.Rounds([700, 300], 100), packing.Rounds([700, 300], 100)
    large.kind, large.sizes = object, large.sizes.astype(object)
    args = np.array([0, 1]), np.array([0, 0]), np.array([700, 300])
    for a, b in zip(small.segments(*args), large.segments(*args)):
        assert a.tolist() == b.tolist()


def test_packing_many_sources(spark):
    """Beside a hot source each of 1,500 small ones keeps its own pace over the windows."""
    rows = [(k, "th er in " * 40, f"s{k}") for k in range(1500)] + [(2000 + k, "th er in " * 400, "hot") for k in range(75)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    pieces = packing.pack(df, PATH, length=8192).collect()
    size = {p.doc_id: p.doc_tokens for p in pieces}
    total = sum(size.values())
    windows = -(-total // 8192)
    assert sum(p.length for p in pieces) == total and len({p.sequence_id for p in pieces}) == windows
    sent, hot = {}, {}
    for p in pieces:
        sent[p.source, p.sequence_id] = sent.get((p.source, p.sequence_id), 0) + p.length
    share = sum(n for k, n in size.items() if k >= 2000) / total
    for w in range(windows - 1):
        assert abs(sent["hot", w] - 8192 * share) <= 4 + 8192 / windows  # two different totals; a round is shorter than a window by up to this much
        for k in range(1500):  # in all windows so far, but for the tokens of one round
            due = 8192 * size[k] / total
            assert abs(sum(sent.get((f"s{k}", v), 0) for v in range(w + 1)) - due * (w + 1)) <= due + 2


def test_new_words_are_proposed_in_one_call(library):
    """Ids of new chunks against the library's, with odd chunks and unproved proposals among them; a pair of neighbours is looked up once, however many words have it."""
    rng = random.Random(8)
    model = bpe.WordBPE(PATH)
    parts = ["th", "er", "in", "que", "ché", "ung", "ñ", "A", "Z9", ".", ",", "'s", "ß", "-", "%%%"]
    make = lambda n: list({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))): None for _ in range(n)})
    looked, compatible = [], model.compatible
    model.compatible = lambda *pair: looked.append(pair) or compatible(*pair)
    model.start(False)

    def check(chunks):
        rows = model.rows_of(chunks)
        for c, r in zip(chunks, rows):
            assert model.data[model.at[r] : model.at[r + 1]].tolist() == library.encode(c, add_special_tokens=False).ids, c

    words = make(3000)
    check(words)
    assert len(looked) == len(set(looked)) > 100
    odd = dict.fromkeys(["", "\x7fab", "\x01\x02", *(c for t in ODD if t for c in bpe.SPACE.split(t))])
    check([*words[:50], *odd, "thinque", "then'sther"])
    for t in ("th", "que", "er" + model.end):
        model.id_of_rank[model.id_of_rank == model.vocab[t]] = -1  # as if never proposed
    more = make(3000)
    check([*more[:900], "<|endoftext|>the", *more[900:], "日本", "ther"])
    check(["the" + w for w in words[:5]])
