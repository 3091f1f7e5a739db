"""Components against union-find."""

import random

import pytest

from matchloom.llm.components import components


def brute(pairs):
    label = {}

    def find(k):
        label.setdefault(k, k)
        while label[k] != k:
            k = label[k]
        return k

    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        label[q] = p
    return {k: find(k) for k in label}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(7)
    if shape == "random":
        pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    elif shape == "chain":
        nodes = rng.sample(range(1000), 40)
        pairs = list(zip(nodes, nodes[1:])) * 2
    elif shape == "star":
        pairs = [(500, k) for k in range(0, 300, 3)] + [(k, k + 1) for k in range(0, 90, 9)]
    else:
        pairs = []
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    want = {k: v for k, v in brute([p for p in pairs if p[0] != p[1]]).items()}
    assert {r.node: r.label for r in got} == want and len(got) == len(want)
