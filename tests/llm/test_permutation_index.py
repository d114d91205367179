"""The permutation index against brute force."""

import numpy as np
import pytest

from trencher.llm import permutation_index, shared

ROWS = "vec_id long, embedding array<float>, label int, class long"


def nearest(rows, every, k=10):
    """Per query row its true nearest rows as (score, id), by brute force."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    width = max((len(v) for _, v in good), default=0)
    table = np.array([np.concatenate([v, np.zeros(width - len(v))]) for _, v in good])
    for n, (i, _) in enumerate(good):
        if i % every == 0:
            score = np.sqrt(((table - table[n]) ** 2).sum(1))
            yield i, sorted((score[j], good[j][0]) for j in range(len(good)) if j != n)[:k]


def found(spark, rows, every, **parameters):
    given = spark.createDataFrame([(i, v, 1, 0) for i, v in rows], ROWS)
    out = {}
    for r in permutation_index.search(given, every=every, **parameters).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return {q: [x[1:] for x in sorted(own)] for q, own in out.items()}


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(40)] + [(i, [1.0] * 8) for i in range(100, 130)]
    rows += [(None, [1.0] * 8), (7, None), (9, []), (11, [0.0] * 8), (13, [float("nan")] * 8), (15, [float("inf")] * 8), (17, [None, 1.0]), (18, [1.0, 2.0]), (20, [1.0] * 7)]
    got, want = found(spark, rows, 20), {}
    for i, own in nearest(rows, 20):
        want.setdefault(i, []).extend(own)
    assert got.keys() == want.keys()
    for i in want:
        if i != 20:  # two rows have this id
            assert [x for _, x in got[i]] == [x for _, x in want[i]]
            assert np.allclose([s for s, _ in got[i]], [s for s, _ in want[i]], rtol=0, atol=1e-12)
    assert sorted(x for _, x in got[20]) == sorted(x for _, x in want[20])
    assert found(spark, [(0, [1.0])], 1) == {} and found(spark, [], 1) == {}
    assert found(spark, [(0, [1.0]), (1, [3.0])], 1) == {0: [(2.0, 1)], 1: [(2.0, 0)]}


@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_recall(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 32))
    v = centres[rng.integers(0, 10, 3000)] + spread * rng.normal(size=(3000, 32))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got, hits, n = found(spark, rows, 50, tile_rows=700), 0, 0
    for i, own in nearest(rows, 50):
        hits += len({x for _, x in own} & {x for _, x in got[i]})
        n += len(own)
        assert got[i] == sorted(got[i]) and len(got[i]) == 10 and i not in {x for _, x in got[i]}
    assert hits / n >= 0.95


def test_one_class_with_a_third_of_all_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(i, rng.normal(size=3).tolist()) for i in range(300, 900)]
    got = found(spark, rows, 100)
    assert got[0] == [(0.0, i) for i in range(1, 11)] and got[100] == [(0.0, i) for i in range(10)]
    assert len(got) == 9


def test_rough_distances_lose_none():
    rng = np.random.default_rng(6)
    for vectors in (rng.normal(size=(500, 16)), 1e8 + 1e-6 * rng.normal(size=(500, 16)), np.repeat(rng.normal(size=(50, 16)), 10, 0), 1e-160 * rng.normal(size=(500, 16)), 1e160 * rng.normal(size=(500, 16))):
        pivots = permutation_index._spread(vectors, 32)
        prefixes = permutation_index._prefixes(vectors, pivots, 12)
        files = permutation_index._inverted(prefixes, len(pivots))
        with np.errstate(over="ignore", invalid="ignore"):
            for q, p, *rough in zip(vectors[:40], prefixes, *permutation_index._rough(vectors[:40], vectors)):
                place = {pivot: x for x, pivot in enumerate(p)}
                common = np.array([sum(12 - max(x, place[pivot]) for x, pivot in enumerate(own) if pivot in place) for own in prefixes])
                near = np.nonzero(common >= np.sort(common)[-125])[0]
                distance = ((vectors[near] - q) ** 2).sum(1)
                best = distance <= np.sort(distance)[9]
                rows, own = permutation_index._found(q, p, files, vectors, *rough, 0.25, 64, 10)
                assert rows.tolist() == near[best].tolist() and own.tolist() == distance[best].tolist()


def test_queries_are_not_copied_for_each_tile_nor_vectors_compared_as_keys(spark, monkeypatch):
    plans, plain = {}, shared.stored

    def written(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(permutation_index, "stored", written)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    got = found(spark, rows, 50, tile_rows=64)
    assert {i: [x for _, x in own] for i, own in got.items()} == {i: [x for _, x in own] for i, own in nearest(rows, 50)}
    assert "Generate" not in plans["near_classes"]
    assert "normalizenanandzero" not in plans["of_class"] + plans["classes"]
