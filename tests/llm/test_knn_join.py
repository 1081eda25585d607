import numpy as np
import pytest

from lakeweave.llm import knn_join as K


def rows(seed, n=900, dim=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) / 3
    x[: n // 3] = x[0]
    out = [(i, [float(np.float32(v)) for v in x[i]]) for i in range(n)]
    return [*out, (n, None), (n + 1, [float("nan")] * dim), (n + 2, [1.0, None] * (dim // 2)), (n + 3, [float("inf")] * dim), (n + 4, [9.0]), (n + 5, []), (None, [1.0] * dim), out[50], out[51], (1000000, [-2.0] * dim)]


def brute(data, k):
    dim = max(len(v) for _, v in data if v)
    keep = [(i, v) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ids = np.array([i for i, _ in keep])
    x = np.array([[*np.floor(256 * np.array(v, float)), *[0.0] * (dim - len(v))] for _, v in keep])
    out = []
    for q in (np.flatnonzero(ids == i) for i in np.unique(ids[ids % 50 == 0])):
        q = min(q.tolist(), key=lambda j: keep[j][1])
        other = np.flatnonzero(ids != ids[q])
        score = x[other] @ x[q]
        best = other[np.lexsort((ids[other], -score))[:k]]
        out += [(int(ids[q]), int(ids[j]), int(x[j] @ x[q])) for j in best]
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(K, "BLOCK", 64)
    monkeypatch.setattr(K, "QUERY_BLOCK", 7)
    monkeypatch.setattr(K, "PART", 2)
    data = rows(seed)
    spark.createDataFrame([(*d, 1) for d in data], "vec_id long, embedding array<float>, score int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = K.op1_knn_join(spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == sorted(brute(data, 5))
    assert {r["rank"] for r in got} == {1, 2, 3, 4, 5}


def test_repeated_queries_and_rows(spark):
    schema = "vec_id long, vector array<float>"
    some = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [1.0, 9.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.25, 0.0])], schema)
    got = K.knn_join(some, some.where("vec_id = 0"), k=3).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 32768), (0, 2, 1, 32768), (0, 3, 2, 16384)]


def test_few_candidates_and_empty_tables(spark, tmp_path):
    schema = "vec_id long, vector array<float>"
    some = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], schema)
    got = K.knn_join(some, some.where("vec_id = 0")).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 256 * 128)]
    none = spark.createDataFrame([], schema)
    assert K.knn_join(none, none).collect() == []
    assert K.knn_join(some, none).collect() == []


def test_groups_follow_the_vectors_not_the_blocks(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(3000)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(24).write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a task for each file
    asked = []
    monkeypatch.setattr(spark.sparkContext.__class__, "broadcast", lambda self, v, f=spark.sparkContext.__class__.broadcast: asked.append(v) or f(self, v))
    try:
        got = K.op1_knn_join(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == sorted(brute(data, 5))
    # 24 files give some 24 blocks for each of 14 cells; a query is sent at most twice.
    members = asked[1][4]
    assert sum(parts for _, parts in members) <= 2


def test_large_cells_get_groups_of_their_own_and_small_ones_share():
    got = K._groups({0: 10, 1: 95, 2: 250, 3: 60, 4: 40, 5: 1}, 100)
    assert got[2][1] == 3 and [got[i][1] for i in (0, 1, 3, 4, 5)] == [1] * 5
    taken = [g for first, parts in {got[i] for i in got} for g in range(first, first + parts)]
    assert sorted(taken) == list(range(len(taken)))
    load = {}
    for i, n in {0: 10, 1: 95, 3: 60, 4: 40, 5: 1}.items():
        load[got[i][0]] = load.get(got[i][0], 0) + n
    assert max(load.values()) <= 100


def test_values_beyond_two_bytes_and_single_precision(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(np.float32(v)) for v in rng.normal(size=5) * 10 ** float(rng.integers(-1, 5))]) for i in range(400)]
    some = spark.createDataFrame(data, "vec_id long, vector array<float>")
    got = K.knn_join(some, some.where("vec_id % 50 = 0")).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == sorted(brute(data, 5))
