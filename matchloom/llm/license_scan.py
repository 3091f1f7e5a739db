"""Licence scan: a trained paragraph classifier, confirmed by templates.

A paragraph is what stands between blank lines; line ends and comment marks inside it do not
count, so hard-wrapped notices read like others.  Long paragraphs are judged in windows that
overlap by half and hold any notice whole.  A multinomial logistic regression over sparse word
n-grams (one and two words) gives each window a licence family or ``unknown``.  It is trained on
variants of notice templates against ordinary paragraphs (a bounded sample of the documents' own
and a fixed list), notices with their names taken away and loose template words; its temperature
is calibrated on held-out paragraphs, and below ``least`` the answer is unknown.  A family is
confirmed if its odds against unknown reach ``least`` and the window holds at least 0.8 of the
five-word shingles of one of its templates (a shorter template: all its words in a row).

On the rows everything is a DataFrame expression over the word array: n-grams find their numbers
in a hashed table, scores are sums over them.  No text is shuffled.  Paragraphs are taken apart
unless the model's weights rule out every family by the words that they lack (:func:`evidence`).

Null and empty texts have no paragraphs and no licences.  Documents are told apart by id and
text; equal rows share a result.  An empty table trains on the templates and fixed lists alone.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, constant, found, hashed, smallest_hashes, staged

#: Ordinary paragraphs drawn from the documents at most, those with the smallest hashes.
MAX_ORDINARY = 1_000
UNKNOWN = "unknown"
#: Buckets of a table of n-grams.
BUCKETS = 2048
# Public notices of licence families.
TEMPLATES = {
    "AGPL": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "licensed under the gnu affero general public license version 3",
    ],
    "Apache-2.0": [
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "BSD": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "use of this source code is governed by a bsd-style license",
        "licensed under the bsd license",
    ],
    "CC-BY": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "CC-BY-NC": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "CC-BY-SA": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "CC0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "released under the cc0 1.0 universal public domain dedication license"],
    "EPL": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0", "licensed under the eclipse public license version 2.0"],
    "GPL": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "licensed under the gnu general public license",
    ],
    "ISC": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "licensed under the isc license"],
    "LGPL": [
        "licensed under the gnu lesser general public license version 3",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "under the terms of the gnu lesser general public license",
    ],
    "MIT": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "licensed under the mit license",
    ],
    "MPL": [
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "licensed under the mozilla public license version 2.0",
        "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org license",
    ],
    "Proprietary": ["all rights reserved no part of this work may be reproduced distributed or transmitted without the prior written permission of the copyright holder", "this software is proprietary and confidential unauthorized copying of this file via any medium is strictly prohibited"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary under the unlicense"],
}
#: What a window must hold to be judged: nothing, every window is (see :func:`evidence` for what is decided without scores).
ANCHOR = ""
# Sentences that use the same words without giving a licence.
ORDINARY = [
    "the driver showed a license to the officer and drove on", "the general public is invited to the meeting", "apache helicopters flew over the city", "a free copy of the software was sent to every person",
    "students of mit released a new version of the game", "the terms of the contract were published by the foundation", "the work of the commission is under way", "the following conditions are met by every candidate",
    "this program is on the air at nine", "the license of the restaurant was not renewed this year", "gnu herds crossed the river under the bridge", "creative people share a common source of ideas", "source and target forms are listed with or without notes",
    "permission to enter the building is granted by the office", "the copyright of the song was sold for a large sum", "fishing licenses are valid for one year", "she gave her permission and the public was let in", "the domain of the king was open to the public",
    "the eclipse was visible to the general public", "he asked for written permission to copy the letter", "a copyright notice appears on the first page of the book", "the library may lend its software to any person without a fee",
]


def tokens(text: str) -> list[str]:
    return [w for w in (x.strip(".") for x in re.split(r"[^a-z0-9.+\-]+", text.lower())) if w.strip("-")]


def token_column(text: Column) -> Column:
    pieces = F.transform(F.split(F.lower(text), r"[^a-z0-9.+\-]+"), lambda w: F.regexp_replace(w, r"^\.+|\.+$|^-+$", ""))
    return F.array_remove(pieces, "")


SHAPES = {f: [tokens(t) for t in ts] for f, ts in TEMPLATES.items()}
#: Words of the longest template; windows hold twice as many.
LONGEST = max(len(t) for ts in SHAPES.values() for t in ts)


def ngrams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def shingles(words: list[str]) -> list[str]:
    """The five-word shingles of a template; a shorter one is one shingle."""
    return [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]


@dataclass
class Classifier:
    families: list[str]  # the last is unknown
    names: list[str]  # the n-grams
    weights: list[list[float]]  # [family][n-gram]
    bias: list[float]
    frequent: tuple[str, ...] = ()  # words of the ordinary lines, most frequent first

    def margins(self, words: list[str]) -> np.ndarray:
        at = {g: i for i, g in enumerate(self.names)}
        return np.array(self.bias) + np.array(self.weights)[:, [at[g] for g in ngrams(words) if g in at]].sum(1)


def fit(docs: DataFrame, *, text_column: str = "text", most: int = MAX_ORDINARY) -> Classifier:
    """Train on template variants and at most ``most`` ordinary lines of whole texts."""
    line = docs.select(F.explode(F.split(F.col(text_column).cast("string"), "\n")).alias("p")).where(F.length("p") > 20)
    own = [tokens(r.p) for r in smallest_hashes(line.withColumn("h", F.xxhash64("p")), ["h", "p"], most).collect()]
    solid = {s for ts in SHAPES.values() for t in ts for s in shingles(t)}
    rng = np.random.default_rng(7)
    samples: list[tuple[set[str], str]] = []
    filler = [w for p in ORDINARY for w in tokens(p)] + [w for p in own[:200] for w in p[:20]]
    some = lambda most: [filler[i] for i in rng.integers(0, len(filler), int(rng.integers(0, most)))]
    common = {w for w in {w for ts in SHAPES.values() for t in ts for w in t} if sum(any(w in t for t in ts) for ts in SHAPES.values()) >= 3}
    for (family, ts), k in itertools.product(SHAPES.items(), range(24)):
        for t in ts:
            words = [w if rng.random() > 0.04 else "x" for w in t] if k % 3 else list(t)
            samples.append((ngrams(some(7 if k % 2 else LONGEST) + words + some(7 if k % 4 else LONGEST)), family))
            if k < 6:  # a notice of a licence without its name
                samples.append((ngrams(some(9) + [w if w in common else f"q{rng.integers(99)}" for w in t] + some(9)), UNKNOWN))
    for words in [*own, *([tokens(p) for p in ORDINARY] * 6)]:
        if not any(s in solid for s in shingles(words)):
            samples.append((ngrams(words), UNKNOWN))
    pool = filler + [w for s in sorted(solid) for w in s.split()]
    for _ in range(400):  # loose words of templates and fillers, in no order
        samples.append(({pool[i] for i in rng.integers(0, len(pool), int(rng.integers(3, 20)))}, UNKNOWN))
        samples.append((ngrams(some(2 * LONGEST)), UNKNOWN))
    families = [*SHAPES, UNKNOWN]
    names = sorted({g for ts in SHAPES.values() for t in ts for g in ngrams(t)})
    at = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(samples), len(names)))
    for i, (grams, _) in enumerate(samples):
        x[i, [at[g] for g in grams if g in at]] = 1.0
    y = np.array([families.index(f) for _, f in samples])
    held = np.arange(len(samples)) % 4 == 0
    w, b = np.zeros((len(names), len(families))), np.zeros(len(families))
    target = np.eye(len(families))[y][~held]
    seen = x[~held]
    for _ in range(300):
        z = seen @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - target) / len(seen)
        w -= 4.0 * (seen.T @ g + 1e-4 * w)
        b -= 4.0 * g.sum(0)

    def loss(t: float) -> float:
        z = (x[held] @ w + b) / t
        return float(np.mean(np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(z)), y[held]]))

    heat = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    seen_words = Counter(w for words in own for w in set(words))
    frequent = tuple(sorted(seen_words, key=lambda w: (-seen_words[w], w)))
    return Classifier(families, names, [[round(v, 6) for v in row] for row in (w.T / heat).tolist()], (b / heat).tolist(), frequent)


def numbered(grams: Column, table: dict[str, list[int]]) -> Column:
    """The numbers that ``table`` has for each of ``grams``."""
    known, none = hashed(table, "array<int>", BUCKETS), F.array().cast("array<int>")
    return F.flatten(F.transform(grams, lambda g: F.coalesce(found(known, g, BUCKETS), none)))


def runs(w: str, n: int) -> Column:
    """All runs of ``n`` words of the array column ``w``."""
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later lambdas read without computing it again (a generator is not merged with what reads it)."""
    return df.withColumn(name, F.explode(F.array(value)))


def evidence(model: Classifier) -> str | None:
    """A pattern for lower-cased text that every window matches for which the model prefers some family to unknown, or None.

    A family must make up the bias of unknown.  Frequent, then short words are set aside while all n-grams of such words together can
    do that for no family; then one of the other words is needed, so windows without any are unknown by the model itself.
    """
    weights, bias = np.array(model.weights), np.array(model.bias)
    gain, slack = np.maximum(weights[:-1] - weights[-1], 0.0), bias[-1] - bias[:-1] - 1e-6
    if not len(slack) or (slack <= 0).any():
        return None
    parts = [set(g.split(" ")) for g in model.names]
    rank = {w: k for k, w in enumerate(model.frequent)}
    needed = sorted(set().union(*parts), key=lambda w: (rank.get(w, len(rank)), len(w), w))
    aside: set[str] = set()
    for w in list(needed):
        if all(gain[:, [i for i, p in enumerate(parts) if p <= aside | {w}]].sum(1) < slack):
            aside.add(w)
            needed.remove(w)
    by_letter: dict[str, list[str]] = {}
    for w in needed:
        by_letter.setdefault(w[0], []).append(w[1:])
    words = "|".join(f"{re.escape(a)}(?:{'|'.join(map(re.escape, rest))})" for a, rest in sorted(by_letter.items()))
    return rf"(?<![a-z0-9+\-])(?:{words or '(?!)'})(?![a-z0-9+\-])"


def scan(docs: DataFrame, model: Classifier, *, id_column: str = "doc_id", text_column: str = "text", least: float = 0.5) -> DataFrame:
    """One row per window and licence family: key, id, place (the paragraph's number), family, score, confirmed."""
    text, needed = F.col(text_column).cast("string"), evidence(model)
    may_hold = lambda c: F.lower(c).rlike(needed) if needed else F.lit(True)
    slim = docs.select(F.col(id_column).alias("id"), text.alias("text")).where(may_hold(F.col("text")))
    key = F.concat_ws(":", F.col("id").cast("string"), F.xxhash64("text").cast("string")).alias("key")
    rows = slim.select("id", key, F.posexplode(F.split("text", r"\r?\n[ \t\r\f]*\n")).alias("place", "p")).where(may_hold(F.col("p")))
    rows = once(rows, "w", token_column(F.col("p"))).select("id", "key", "place", "w")
    starts = F.when(F.size("w") > 2 * LONGEST, F.sequence(F.lit(1), F.size("w") - LONGEST, F.lit(LONGEST))).otherwise(F.array(F.lit(1)))
    rows = rows.select("id", "key", "place", F.explode(F.transform(starts, lambda i: F.slice("w", i, 2 * LONGEST))).alias("w")).where(may_hold(F.array_join("w", " ")))
    rows = once(rows, "ids", F.array_distinct(numbered(F.array_distinct(F.concat("w", runs("w", 2))), {g: [i] for i, g in enumerate(model.names)})))
    weights, bias = constant(model.weights, "array<array<double>>"), constant(model.bias, "array<double>")
    last = len(model.families) - 1
    rows = once(rows, "z", F.transform(F.sequence(F.lit(0), F.lit(last)), lambda j: F.aggregate("ids", F.get(bias, j), lambda a, i: a + F.get(F.get(weights, j), i))))
    templates = [(f, t) for f in model.families[:-1] for t in SHAPES[f]]
    needed, table, lengths = [], {}, set()
    for k, (_, t) in enumerate(templates):
        parts = sorted({*shingles(t)})
        needed.append(math.ceil(0.8 * len(parts)))
        lengths.add(min(5, len(t)))
        for s in parts:
            table.setdefault(s, []).append(k)
    rows = once(rows, "held", numbered(F.array_distinct(F.concat(*[runs("w", n) for n in sorted(lengths)])), table))
    enough = F.filter(F.transform(constant(needed, "array<int>"), lambda n, k: F.when(F.size(F.filter("held", lambda x: x == k)) >= n, k)), lambda k: k.isNotNull())
    family_of = constant([model.families.index(f) for f, _ in templates], "array<int>")
    rows = once(rows, "full", F.array_distinct(F.transform(enough, lambda k: F.get(family_of, k))))
    odds = lambda j: 1.0 / (1.0 + F.exp(F.get("z", F.lit(last)) - F.get("z", j)))
    names = constant(model.families, "array<string>")
    made = lambda j, score, sure: F.struct(F.get(names, j).alias("family"), score.alias("score"), F.lit(sure).alias("confirmed"))
    sure = F.transform(F.filter("full", lambda j: odds(j) >= least), lambda j: made(j, odds(j), True))
    top = F.array_position("z", F.array_max("z")).cast("int") - 1
    rows = once(once(rows, "sure", sure), "top", top)
    share = 1.0 / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max("z")))
    rows = once(rows, "share", share)
    guess = F.when((F.size("sure") == 0) & (F.col("top") < last) & (F.col("share") >= least), F.array(made(F.col("top"), F.col("share"), False))).otherwise(F.col("sure"))
    return rows.select("key", "id", "place", F.explode(guess).alias("f")).select("key", "id", "place", "f.family", "f.score", "f.confirmed")


def document_licences(docs: DataFrame, model: Classifier, *, id_column: str = "doc_id", text_column: str = "text", least: float = 0.5) -> DataFrame:
    """One row per document: id, n_paragraphs (with a licence), families (confirmed, sorted, comma-joined), unconfirmed
    (likewise, of families not confirmed in the document), best_score."""
    hits = scan(docs, model, id_column=id_column, text_column=text_column, least=least)
    names = lambda ok: F.collect_set(F.when(F.col("confirmed") == ok, F.col("family")))  # noqa: E731  a few families
    per = hits.groupBy("key").agg(F.count_distinct("place").alias("n_paragraphs"), names(True).alias("sure"), names(False).alias("maybe"), F.max("score").alias("best_score"))
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    per = staged(per.select("key", "n_paragraphs", joined(F.col("sure")).alias("families"), joined(F.array_except("maybe", "sure")).alias("unconfirmed"), "best_score"), "licences")
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column), F.concat_ws(":", F.col(id_column).cast("string"), F.xxhash64(text).cast("string")).alias("key"))
    out = rows.join(broadcast_if_small(per, per.count(), 200), "key", "left")
    return out.select(id_column, F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("unconfirmed", F.lit("")).alias("unconfirmed"), F.round(F.coalesce("best_score", F.lit(0.0)), 6).alias("best_score"))
