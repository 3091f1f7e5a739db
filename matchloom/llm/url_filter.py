"""URL filter: longest matching rule, else gradient-boosted trees on lexical features.

Rules are (host, path, verdict); a rule fits its host and all subdomains when the url's path
begins with the rule's.  The longest host wins, then the longest path.  Urls that a rule
decides are the labelled ones from which the trees learn; the others get the trees' verdict.
Features: lengths, depth, digit ratio, entropy of the characters, parameter counts, and for the
last host label its length, its count and its smoothed share of blocked urls.  Everything on the rows is a DataFrame expression; the trees become nested CASEs.

Null urls and urls without ``://`` have an empty host and path, match no rule unless its host
is empty, and are scored by their features like any other.  Ties between rules of the same
host and path go to the one listed first.  Repeated rows are judged alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import found, hashed, smallest_hashes
from .gbt import Trees, train

#: Labelled urls that training takes at most, those with the smallest hash.
MAX_LABELLED = 20_000
#: Buckets of the table of suffixes.
SUFFIX_BUCKETS = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "longest_label", "digits", "host_digits", "hyphens", "parameters", "query_length", "fragment", "entropy", "tail_length", "suffix_length", "suffix_rate", "suffix_count", "https")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> dict[str, Column]:
    """Host and path of a url by the plain rules of this module."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    after = F.when(F.instr(text, "://") > 0, F.substring(text, F.instr(text, "://") + 3, F.length(text))).otherwise(F.lit(""))
    front = F.regexp_extract(after, r"(?s)^[^?#]*", 0)
    host = F.translate(F.substring_index(front, "/", 1), UPPER, LOWER)
    path = F.when(F.instr(front, "/") > 0, F.substring(front, F.instr(front, "/"), F.length(front))).otherwise(F.lit(""))
    return {"url": text, "host": host, "path": path}


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Number of the longest rule that fits, as an expression; null if none does.

    A rule list is configuration: it is tested in order of length, longest host first.
    """
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k].host), -len(rules[k].path), k))
    chosen = F
    for k in order:  # one flat CASE, in which the first that fits wins
        r = rules[k]
        chosen = chosen.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(k))
    return chosen if order else F.lit(None).cast("int")


def lexical(df: DataFrame, suffixes: dict[str, list[float]]) -> DataFrame:
    """Add the features to rows with ``_url, _host, _path``; ``suffixes`` has the share of blocked urls and the log count for each last host label."""
    url, host, path = F.col("_url"), F.col("_host"), F.col("_path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    suffix = F.element_at(labels, -1)
    n = F.greatest(F.length(url), F.lit(1))
    count = lambda text, chars: F.length(text) - F.length(F.translate(text, chars, ""))
    # Shannon entropy of the characters: each distinct one is counted by taking it out.
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    letters = F.filter(F.array_distinct(F.split(url, "")), lambda c: c != "")
    # The sum's last bits depend on the order of the characters; rounded, urls of the same counts have the same entropy.
    entropy = F.round(F.aggregate(F.transform(letters, share), F.lit(0.0), lambda a, p: a - p * F.log2(p)), 9)
    known = found(hashed(suffixes, "array<double>", SUFFIX_BUCKETS), suffix, SUFFIX_BUCKETS) if suffixes else F.lit(None).cast("array<double>")
    values = {
        "length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "depth": count(path, "/"), "labels": F.size(labels),
        "longest_label": F.array_max(F.transform(labels, F.length)), "digits": count(url, "0123456789") / n, "host_digits": count(host, "0123456789"), "hyphens": count(host, "-"),
        "parameters": F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(0), "query_length": F.length(query), "fragment": F.instr(url, "#") > 0,
        "entropy": entropy, "tail_length": F.length(F.substring_index(path, "/", -1)), "suffix_length": F.length(suffix),
        "suffix_rate": F.coalesce(F.get(known, F.lit(0)), F.lit(0.5)), "suffix_count": F.coalesce(F.get(known, F.lit(1)), F.lit(0.0)), "https": url.startswith("https"),
    }
    return df.withColumns({f"_f_{k}": F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in values.items()})


@dataclass
class UrlModel:
    trees: Trees
    suffixes: dict[str, list[float]]


def fit(judged: DataFrame, rules: list[Rule], most: int = MAX_LABELLED) -> UrlModel:
    """Train on at most ``most`` distinct urls that rules decide; the label is 1 for block.

    A url's own label is left out of its suffix's share, so that the share does not give it away.
    """
    verdict = F.element_at(F.array(*[F.lit(float(r.verdict == "block")) for r in rules]), F.col("_rule") + 1)
    rows = judged.where(F.col("_rule").isNotNull()).select(F.xxhash64("_url").alias("_h"), "_url", "_host", "_path", verdict.alias("_y")).dropDuplicates(["_h", "_url"])
    plain = [k for k in FEATURES if k not in ("suffix_rate", "suffix_count")]
    got = lexical(smallest_hashes(rows, ["_h", "_url"], most), {}).select("_host", "_y", *[f"_f_{k}" for k in plain]).collect()
    sums: dict[str, list[float]] = {}
    for r in got:
        own = sums.setdefault(r._host.rpartition(".")[2], [0.0, 0.0])
        own[0] += r._y
        own[1] += 1
    x = np.zeros((len(got), len(FEATURES)))
    for i, r in enumerate(got):
        blocked, n = sums[r._host.rpartition(".")[2]]
        values = {**{k: float(r[f"_f_{k}"]) for k in plain}, "suffix_rate": smoothed(blocked - r._y, n - 1), "suffix_count": math.log1p(n - 1)}
        x[i] = [values[k] for k in FEATURES]
    return UrlModel(train(x, np.array([r._y for r in got]), rounds=24, depth=3, rate=0.3).midway(x), {s: [smoothed(b, n), math.log1p(n)] for s, (b, n) in sums.items()})


def smoothed(blocked: float, n: float) -> float:
    return (blocked + 1.0) / (n + 2.0)


def filter_urls(df: DataFrame, rules: list[Rule], *, url_column: str = "url", keep: tuple[str, ...] = ("page_id",), most: int = MAX_LABELLED, block_from: float = 0.5) -> DataFrame:
    """Judge every url: the ``keep`` columns, host, path, rule, verdict, score (of the trees) and decided_by."""
    p = parts(F.col(url_column))
    slim = df.select(*[F.col(c) for c in keep], p["url"].alias("_url"), p["host"].alias("_host"), p["path"].alias("_path"))
    slim = slim.withColumn("_rule", matching_rule(F.col("_host"), F.col("_path"), rules) if rules else F.lit(None).cast("int"))
    model = fit(slim, rules, most) if rules else UrlModel(train(np.zeros((0, len(FEATURES))), np.zeros(0)), {})
    scored = lexical(slim, model.suffixes).withColumn("score", model.trees.column([F.col(f"_f_{k}") for k in FEATURES]))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_rule") + 1) if rules else F.lit(None).cast("string")
    by_rule = F.col("_rule").isNotNull()
    return scored.select(
        *keep, F.col("_host").alias("host"), F.col("_path").alias("path"), F.when(by_rule, pick([r.name for r in rules])).alias("rule"),
        F.when(by_rule, pick([r.verdict for r in rules])).otherwise(F.when(F.col("score") >= block_from, "block").otherwise("allow")).alias("verdict"),
        "score", F.when(by_rule, "rule").otherwise("trees").alias("decided_by"),
    )
