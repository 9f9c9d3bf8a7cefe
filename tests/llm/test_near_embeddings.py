import numpy as np
import pytest

from tests.llm.test_near_simhash import slow_components
from tessera.llm import near_embeddings as m
from tessera.llm.queries import queries


def slow(rows, threshold=0.93):
    ids = [r[0] for r in rows]
    links, pairs = dict.fromkeys(ids, 0), []
    ok = [(i, lab, np.array(v, float)) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    by = {}
    for i, lab, v in ok:
        by.setdefault((lab, len(v)), []).append((i, v / np.linalg.norm(v)))
    for group in by.values():
        x = np.array([v for _, v in group])
        for p, q in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)), strict=True):
            a, b = group[p][0], group[q][0]
            links[a] += 1
            links[b] += 1
            pairs.append((a, b))
    comps = slow_components(pairs, ids)
    return {i: (links[i], comps[i], comps[i] == i) for i in ids}


def rows_of(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = rows_of(queries()["op6_embedding_near_dedup"](spark, sf_dir))
    assert got == slow(rows)


def made(n=600, dim=24, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(40, dim))
    out = []
    for i in range(n):
        v = centers[rng.integers(40)] + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.25, 1.0])
        out.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    return out


@pytest.mark.parametrize("block", [8192, 64, 30])
def test_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK", block)
    rows = made()
    got, want = rows_of(m.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))), slow(rows)
    assert got == want


def test_every_size_is_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 50)
    rows = made(1500, seed=5)
    assert rows_of(m.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))) == slow(rows)


def test_count_calibration():
    rng = np.random.default_rng(0)
    d = np.sqrt(2 - 2 * 0.93)
    lines = m._lines(64, m.LINES, 1)
    a = rng.normal(size=(20_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other = rng.normal(size=a.shape)
    other -= (other * a).sum(1, keepdims=True) * a
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * other
    hits = (np.abs(a @ lines - b @ lines) <= m.HALF_WIDTH * d).sum(axis=1)
    assert (hits >= m.least_count()).mean() > 0.999
    assert (m.collisions((a @ lines)[:50], (b @ lines)[:70], 0.7) == (np.abs((a @ lines)[:50, None] - (b @ lines)[None, :70]) <= 0.7).sum(2)).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, -0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1.0, None], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 2), (13, [1e-300, 0.0], 1), (14, [-0.0, 1.0], 1), (15, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as n", "2 as rep", "'k' as key", "3 as v", "4 as t")
    got = rows_of(m.near_vectors(df))
    assert got == slow([r for r in rows if r[0] != 13]) | {13: (3, 1, False), 1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False)}
    assert m.near_vectors(df.where("false")).count() == 0
    assert rows_of(m.near_vectors(spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1)], "vec_id long, embedding array<double>, label int"))) == {None: (0, None, False), 1: (0, 1, True)}
