"""NN-descent components and link counts against brute force."""

import numpy as np

from matchloom.llm import vector_dedup
from matchloom.llm.vector_dedup import neighbour_components


def brute(rows, t=0.9):
    ok = {k: np.array(v, float) for k, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    links = {k: set() for k, _ in rows}
    keys = list(ok)
    for a in keys:
        for b in keys:
            if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= t:
                links[a].add(b)
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out[k] = (len(links[k]), min(seen), k == min(seen))
    return out


def test_components_and_links(spark):
    rng = np.random.default_rng(0)
    rows, dim = [], 32
    for size in [1] * 150 + [2] * 10 + [5, 20, 90]:
        base = rng.standard_normal(dim)
        rows += [(base + 0.12 * rng.standard_normal(dim)).tolist() for _ in range(size)]
    rows += [rows[200], rows[200], (np.array(rows[201]) * 7).tolist(), None, [0.0] * dim, [float("nan")] * dim, [1.0, None] * (dim // 2), [1.0] * 8, [2.0] * 8]
    order = rng.permutation(len(rows))
    table = [(int(k), rows[i]) for k, i in enumerate(order)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbour_components(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()}
    want = brute(table)
    assert got.keys() == want.keys()
    found, true = sum(min(got[k][0], want[k][0]) for k in want), sum(want[k][0] for k in want)
    assert found >= 0.98 * true
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k][1] == want[k][1] for k in want) >= 0.98 * len(want)
    assert all(got[k] == want[k] for k in want if want[k][0] == 0)


def test_empty_table(spark):
    assert neighbour_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_tight_groups_with_links_between_them(spark):
    """Lists full of inner links hide all links between two groups; these must be joined all the same."""
    rng = np.random.default_rng(1)
    base = rng.standard_normal(32)
    base /= np.linalg.norm(base)
    side = rng.standard_normal(32)
    side -= side @ base * base
    other = 0.94 * base + (1 - 0.94**2) ** 0.5 * side / np.linalg.norm(side)
    rows = [(k, ((base, other)[k % 2] + 0.0177 * rng.standard_normal(32)).tolist()) for k in range(600)]
    rows += [(600 + k, rng.standard_normal(32).tolist()) for k in range(50)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbour_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute(rows)


def test_audit_sees_small_groups_beside_a_large_one(spark, monkeypatch):
    """Blocks of two find the large group and miss most pairs; the audit must not pass before they are found."""
    monkeypatch.setattr(vector_dedup, "BLOCK", 2)
    monkeypatch.setattr(vector_dedup, "ORDERS", 1)
    monkeypatch.setattr(vector_dedup, "REFINEMENTS", 1)
    rng = np.random.default_rng(2)
    bases = rng.standard_normal((161, 32))
    rows = [(bases[0] + 0.02 * rng.standard_normal(32)).tolist() for _ in range(160)]
    rows += [(b + 0.2 * rng.standard_normal(32)).tolist() for b in bases[1:] for _ in range(2)]
    table = list(enumerate(rows))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbour_components(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()}
    want = brute(table)
    assert np.mean([got[k] == want[k] for k in want if k >= 160]) >= 0.98


def test_repeated_ids(spark):
    """Equal rows link with each other; different vectors of one id stay apart; null ids take part."""
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.02]), (None, [0.0, -1.0]), (3, None), (4, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, id int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in neighbour_components(df).collect())
    assert got == sorted([("1", 2, "1", True)] * 2 + [("2", 0, "2", True), ("2", 2, "1", False), ("None", 0, "None", False), ("3", 0, "3", True), ("4", 0, "4", True)])
    assert neighbour_components(df.where("false")).collect() == []
