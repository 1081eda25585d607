import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeweave.functions import pruning as P
from lakeweave.functions import vectors as V
from lakeweave.functions.grid import GridSettings, cell_center, cell_id, cell_name, children, covered_cells, prefix
from lakeweave.operators import evaluate, index, overlap, pairs, pivots, run, search, stats
from lakeweave.sources import lake as L
from lakeweave.sources import sinks
from lakeweave.streaming.search import search_stream

SCHEMA = "table_id int, set_id int, pos long, values array<float>"


def random_lake(spark, seed=0, n=160, dim=4, tables=2, sets=4, scale=1.0):
    rng = np.random.default_rng(seed)
    rows = [(int(i % tables), int(i % (tables * sets) // tables), i, [float(x) for x in rng.normal(size=dim).astype(np.float32) * scale]) for i in range(n)]
    rows += [(0, 0, n + i, rows[i][3]) for i in range(10)]  # repeated vectors
    return rows, spark.createDataFrame(rows, SCHEMA)


def brute(rows, tau):
    out = {}
    for q, s in itertools.product(rows, rows):
        d = math.dist(q[3], s[3])
        if d <= tau:
            out[(*q[:3], *s[:2])] = out.get((*q[:3], *s[:2]), 0) + 1
    return out


def random_grid(rows, p=3, levels=3):
    return GridSettings(tuple(tuple(r[3]) for r in rows[:p]), levels)


@pytest.mark.parametrize("tau", [0.0, 0.3, 1.1])
def test_both_plans_equal_brute_force(spark, tau, monkeypatch):
    rows, lake = random_lake(spark)
    want = brute(rows, tau)
    g = random_grid(rows)
    monkeypatch.setattr(search, "QUERY_BYTES", 3000)
    for plan in ("blocks", "cells"):
        got = {tuple(r)[:5]: r["pairs"] for r in search.similarity_counts(lake, lake, tau, g, plan).collect()}
        assert got == want
    found = search.candidate_pairs(lake, lake, g, tau).join(index.with_cells(lake, g).select("cell_id", "table_id", "set_id").distinct(), "cell_id")
    possible = {tuple(r) for r in found.select("q_table", "q_set", "q_pos", "table_id", "set_id").collect()}
    assert set(want) <= possible


def test_search_options(spark):
    rows, lake = random_lake(spark, 1)
    want = brute(rows, 0.9)
    full = {(r.q_table, r.q_set, r.s_table, r.s_set): r for r in search.search(lake, lake, "0.6", tau=0.9).collect()}
    size = {}
    for t, s, *_ in rows:
        size[t, s] = size.get((t, s), 0) + 1
    for key, r in full.items():
        hits = {k: v for k, v in want.items() if (k[0], k[1], k[3], k[4]) == key}
        assert r.matched == len(hits) and r.pairs == sum(hits.values()) and r.nooverlap == size[key[:2]] - r.matched
        assert r.need == -(-6 * size[key[:2]] // 10) and r.joinable == (r.matched >= r.need)
        assert r.mismatched == size[key[:2]] * size[key[2:]] - r.pairs
    assert all(full[(t, s, t, s)].matched == n for (t, s), n in size.items())
    others = search.search(lake, lake, "0.6", tau_pct=0.45, exclude_self=True)
    assert others.where((F.col("q_table") == F.col("s_table")) & (F.col("q_set") == F.col("s_set"))).isEmpty()
    wide = search.similarity_counts(lake, lake, 0.4, verify_radius="sqrt2tau")
    assert {tuple(r)[:5]: r["pairs"] for r in wide.collect()} == brute(rows, math.sqrt(0.8))
    by_pairs = search.joinable(search.match_map(search.similarity_counts(lake, lake, 0.9), lake, lake), "0.6", "pairs")
    assert by_pairs.where("joinable <> (pairs >= need)").isEmpty()
    for bad in ({"tau": -1.0}, {}, {"tau": 1.0, "tau_pct": 0.5}):
        with pytest.raises(ValueError):
            search.search(lake, lake, "0.6", **bad)
    with pytest.raises(ValueError):
        search.search(lake, lake, "1.5", tau=1.0)


def test_metamorphic(spark):
    rows, lake = random_lake(spark, 2)
    counts = [search.match_map(search.similarity_counts(lake, lake, t), lake, lake).agg(F.sum("matched")).first()[0] for t in (0.0, 0.5, 1.0)]
    assert counts == sorted(counts)
    m = search.match_map(search.similarity_counts(lake, lake, 0.8), lake, lake)
    ok = [search.joinable(m, t).where("joinable").count() for t in ("0", "0.3", "1")]
    assert ok == sorted(ok, reverse=True)
    a, b = (search.similarity_counts(lake, lake, 0.5, random_grid(rows[i:]), "cells").orderBy(*search.KEYS).collect() for i in (0, 20))
    assert a == b
    assert search.search(lake, lake.where("false"), "0.5", tau=1.0).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 3), st.integers(1, 4), st.integers(0, 10**6))
def test_geometry(p, m, seed):
    rng = np.random.default_rng(seed)
    g = GridSettings(tuple(tuple(x) for x in rng.normal(size=(p, 3))), m, 2.0)
    cell = int(rng.integers(g.leaf_cells))
    center = np.array(cell_center(cell, g))
    # The nearest center, level by level, is the way to the cell.
    at = 0
    for level in range(1, m + 1):
        at = min(children(at, g), key=lambda c: ((np.array(cell_center(c, g, level)) - center) ** 2).sum())
    assert at == cell and cell_name(cell, g).startswith(f"{m:02d}_{g.edge():g}_(")
    assert g.volume == 2.0**p


def test_cells_of_points_and_squares(spark):
    g = GridSettings(((0.0,), (1.0,), (0.5,)), 4, 1.0)
    rng = np.random.default_rng(0)
    points = [[float(x) for x in rng.random(3) * 1.3] for _ in range(200)]
    df = spark.createDataFrame([(p,) for p in points], "ps array<double>")
    for r in df.select("ps", cell_id(F.col("ps"), g).alias("c"), prefix(cell_id(F.col("ps"), g), g, 2).alias("c2"), covered_cells(F.col("ps"), g, 0.1, 2).alias("near")).collect():
        want = [min(15, int(x * 16)) for x in r["ps"]]
        assert [round((x - 0.5 / 16) * 16) for x in cell_center(r["c"], g)] == want
        axes = [sorted({max(0, min(3, math.floor(v * 4))) for v in (x - 0.1, x, x + 0.1)}) for x in r["ps"]]
        assert r["c2"] in r["near"] and len(set(r["near"])) == math.prod(len(range(a[0], a[-1] + 1)) for a in axes)


def test_pruning_is_sound(spark):
    rows, lake = random_lake(spark, 3, n=80)
    g, tau = random_grid(rows), 0.7
    q, s = search._sides(index.with_cells(lake, g), index.with_cells(lake, g), ("ps", "cell_id"))
    zones = index.zone_map(index.with_cells(lake, g), g).withColumnRenamed("cell_id", "z")
    j = q.join(s).join(zones, F.col("s_cell_id") == F.col("z")).withColumn("d", V.distance(F.col("q_values"), F.col("s_values")))
    a, b, hi = F.col("q_ps"), F.col("s_ps"), F.col("hi")
    near = F.col("d") <= tau
    bad = j.where(
        (near & ~P.point_filter(a, b, tau)) | (near & ~P.point_filter_weak(a, b, tau)) | (near & ~P.cell_filter(a, F.col("lo"), hi, tau)) | (~near & P.point_match(a, b, tau - 1e-9)) | (~near & P.cell_match(a, hi, tau - 1e-9))
    )
    assert bad.isEmpty()
    t = stats.pruning_stats(lake, lake, g, tau).first()
    assert t.matching_pairs == sum(brute(rows, tau).values()) <= t.band_pairs <= t.all_pairs == len(rows) ** 2
    assert spark.range(1).select(P.least_reach(F.array(F.lit(0.2), F.lit(2.0)), 1.0)).first()[0] == pytest.approx(0.8)
    bound = search.upper_bound(lake, lake, g, tau, "0.5").alias("b")
    found = search.search(lake, lake, "0.5", tau=tau).where("joinable")
    assert found.join(bound.where("keep"), ["q_table", "q_set", "s_table", "s_set"], "left_anti").isEmpty()


def test_index_round_trip(spark, tmp_path):
    rows, lake = random_lake(spark, 4)
    g = random_grid(rows)
    index.write_index(index.with_cells(lake, g), g, str(tmp_path / "i"))
    stored, back = index.read_index(spark, str(tmp_path / "i"))
    assert back == g
    a, b = (search.similarity_counts(lake, x, 0.6, g, "cells").orderBy(*search.KEYS).collect() for x in (lake, stored.drop("ps", "cell_id", "cell_l1")))
    assert a == b
    h = index.level_histogram(stored, g).groupBy("level").agg(F.sum("vectors").alias("n")).collect()
    assert {r["n"] for r in h} == {len(rows)} and len(h) == g.levels
    e = index.empty_leaves(stored, g).first()
    assert e.empty + e.filled == g.leaf_cells
    with pytest.raises(Exception, match="exist"):
        index.write_index(index.with_cells(lake, g), g, str(tmp_path / "i"))


def test_pivots(spark):
    rows, lake = random_lake(spark, 5)
    x = np.array([r[3] for r in rows])
    far = pivots.farthest_first(x, 8)
    assert len(set(far.tolist())) == 8
    for k in range(1, 8):
        d = np.min([((x - x[i]) ** 2).sum(1) for i in far[:k]], axis=0)
        assert d[far[k]] == pytest.approx(d[[i for i in range(len(x)) if i not in far[:k]]].max())
    assert pivots.select_pivots(x, 3, 5) == pivots.select_pivots(x, 3, 5)
    assert pivots.select_best(x, 2, 4, 2).extremity >= pivots.select_pivots(x, 2, 3).extremity
    values, loadings = pivots.principal_axes(x, 2)
    assert values[0] >= values[1] and values[0] == pytest.approx(np.linalg.eigvalsh(np.cov((x - x.mean(0)).T))[-1], rel=1e-2)
    assert len(set(pivots.by_loading(loadings, 2))) == 2
    chosen = pivots.farthest_first_distributed(lake, 4, rows[0][3])
    first = x[((x - x[0]) ** 2).sum(1).argmax()]
    assert np.allclose(chosen[0], first) and len({tuple(c) for c in chosen}) == 4
    assert pivots.sample(lake).shape == x.shape


def test_binary_lake_and_catalog(spark, tmp_path):
    rng = np.random.default_rng(0)
    a, far = rng.random((3, 4)).astype("<f4"), rng.random((2, 4)).astype("<f4") + 50
    one = rng.random((1, 4)).astype("<f4") + 9
    tables = {1: [a, one], 2: [np.concatenate([a, one + 3])], 3: [far, np.zeros((0, 4), "<f4")]}
    for t, sets in tables.items():
        (tmp_path / L.file_name(sum(map(len, sets)), t, len(sets), 4)).write_bytes(L.encode_table(sets))
    (tmp_path / "ignored.txt").write_text("x")
    lake = L.read_binary(spark, str(tmp_path))
    assert lake.count() == 10 and lake.where("table_id = 3 AND set_id = 1").isEmpty()
    for t, sets in tables.items():
        for s, x in enumerate(sets):
            got = lake.where((F.col("table_id") == t) & (F.col("set_id") == s)).orderBy("pos").collect()
            assert [r.set_size for r in got] == [len(x)] * len(x) and (not len(x) or np.array_equal([r["values"] for r in got], x))
    query = lake.where("table_id = 1 AND set_id = 0")
    found = search.search(query, lake, "1", tau=0.0)
    assert {(r.s_table, r.s_set) for r in found.where("joinable").collect()} == {(1, 0), (2, 0)}
    assert L.lake_info(lake).first()[:5] == (3, 4, 10, 4, 4)
    assert L.lake_info(L.first_tables(lake, 2)).first()["tables"] == 2
    assert {tuple(r) for r in L.select_queries(lake, 2, -1, 2).collect()} == {(1, 0, 3), (2, 0, 4)}
    sinks.write_results(found, str(tmp_path / "out"))
    sinks.write_log(found, str(tmp_path / "log"), 0.0, 1.0, 0.5)
    sinks.write_log(found, str(tmp_path / "log"), 0.0, 1.0, 0.6)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    logged = spark.read.option("header", True).csv(str(tmp_path / "log/query_results"))
    assert logged.count() == 4 and {r.tss for r in logged.collect()} == {"t1c0", "t2c0"}
    with pytest.raises(ValueError):
        list(L.decode_table(b"\x05\0\0\0abc", 4))


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 1.0], [1.0, float("nan")])], "a array<float>, b array<float>")
    got = df.select(V.distance(F.col("a"), F.col("b")), V.mean(F.col("a")), V.magnitude(F.col("a")), V.has_nan(F.col("b")), V.bits(F.lit(5), 4)).collect()
    assert tuple(got[0])[:4] == (5.0, 3.5, 5.0, False) and got[1][3] and got[0][4] == [0, 1, 0, 1]
    assert V.sign_vectors(2) == [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    assert df.select(V.normalize(F.col("a"))).first()[0] == pytest.approx([0.6, 0.8])


def test_evaluation_and_overlap(spark):
    truth = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 5)], "q int, s int")
    result = spark.createDataFrame([(1, 1), (1, 1), (1, 9), (2, 1), (4, 1)], "q int, s int")
    got = {r.q: (r.recall, r.precision) for r in evaluate.recall_precision(result, truth, ["q"], ["s"]).collect()}
    assert got == {1: (0.5, 0.5), 2: (1.0, 1.0), 3: (0.0, None)}
    assert evaluate.macro_average(evaluate.recall_precision(result, truth, ["q"], ["s"])).first()["recall"] == pytest.approx(0.5)
    wide = spark.createDataFrame([(1, 5, 6)], "k int, a long, b long")
    assert {tuple(r) for r in stats.unpivot_stats(wide, ["k"]).collect()} == {(1, "a", 5), (1, "b", 6)}
    t = spark.createDataFrame([("x", "x"), ("y", "z"), (None, "y")], "a string, b string")
    rows = {(r.q_set, r.s_set): (r.overlap, r.q_size) for r in overlap.exact_overlap(L.columns_of(t, 0, ["a", "b"])).collect()}
    assert rows == {(0, 1): (2, 2), (1, 0): (2, 3)}


def test_stream_of_query_columns(spark, tmp_path):
    rows, lake = random_lake(spark, 6, n=60)
    lake.where("table_id = 1").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    got = []
    q = search_stream(stream, lake, lambda df, _: got.extend(df.collect()), str(tmp_path / "c"), ratio="0.5", tau=0.9)
    q.awaitTermination(120)
    want = search.search(lake.where("table_id = 1"), lake, "0.5", tau=0.9).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("tau", [0.0, 0.4, 1.1])
def test_index_plan_equals_brute_force(spark, tau, tmp_path, monkeypatch):
    rows, lake = random_lake(spark, 7)
    g, want = random_grid(rows), brute(rows, tau)
    index.write_index(index.with_cells(lake, g), g, str(tmp_path / "i"))
    monkeypatch.setattr(search, "TILE", 5)
    for i in (index.build_index(lake, g), index.open_index(spark, str(tmp_path / "i"))):
        assert {tuple(r)[:5]: r["pairs"] for r in search.similarity_counts(lake, i, tau).collect()} == want
        full = search.search(lake, i, "0.6", tau=tau, exclude_self=True).where("joinable").collect()
        few = search.search(lake, i, "0.6", tau=tau, exclude_self=True, only_joinable=True).collect()
        assert sorted(map(str, full)) == sorted(map(str, few))


def test_stored_index_names_cells_to_the_scan(spark, tmp_path):
    rows, lake = random_lake(spark, 8)
    g = random_grid(rows)
    index.write_index(index.with_cells(lake, g), g, str(tmp_path / "i"))
    i = index.open_index(spark, str(tmp_path / "i"))
    some = lake.where("pos < 3")
    plan = search.similarity_counts(some, i, 0.05)._jdf.queryExecution().toString()
    assert any("cell_l1#" in x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:])
    cells = [r["cell_id"] for r in i.zones.orderBy("cell_id").limit(3).collect()]
    want = {tuple(r) for r in index.with_cells(lake, g).where(F.col("cell_id").isin(cells)).select("table_id", "set_id", "pos").collect()}
    assert {tuple(r) for r in index.read_cells(i, cells).select("table_id", "set_id", "pos").collect()} == want


def test_many_queries_take_the_index_plan(spark, monkeypatch):
    rows, lake = random_lake(spark, 9)
    monkeypatch.setattr(search, "QUERY_BYTES", 500)
    got = search.similarity_counts(lake, lake, 0.8)
    assert {tuple(r)[:5]: r["pairs"] for r in got.collect()} == brute(rows, 0.8)
    assert search.similarity_counts(lake, lake.where("false"), 0.8, random_grid(rows), "index").collect() == []


@pytest.mark.parametrize(("seed", "tau"), [(1, 0.0), (2, 0.2), (3, 1.0)])
def test_pair_joins_equal_conditions(spark, seed, tau):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.choice([0.0, 0.1, 0.3, 0.55, 0.8], 4) + rng.random() * (i % 2)]) for i in range(30)]
    a, b = (spark.createDataFrame(rows, f"{n} int, {n}_ps array<double>") for n in "ab")
    tests = [
        (pairs.within_all, lambda p, q: all(abs(x - y) <= tau + P.EPS for x, y in zip(p, q, strict=True))),
        (pairs.within_some, lambda p, q: any(abs(x - y) <= tau + P.EPS for x, y in zip(p, q, strict=True))),
        (pairs.sum_some, lambda p, q: any(x + y <= tau for x, y in zip(p, q, strict=True))),
    ]
    for join, test in tests:
        got = [tuple(r) for r in join(a, "a_ps", b, "b_ps", 4, tau).select("a", "b").collect()]
        assert sorted(got) == sorted((i, j) for (i, p), (j, q) in itertools.product(rows, rows) if test(p, q))


def test_overlap_of_common_values(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOLDERS", 3)
    held = spark.createDataFrame([(0, s, "common") for s in range(20)] + [(0, 1, "x"), (0, 2, "x")], "table_id int, set_id int, value string")
    got = {(r.q_set, r.s_set): r.overlap for r in overlap.exact_overlap(held).collect()}
    assert got == {(a, b): 1 + ({a, b} == {1, 2}) for a in range(20) for b in range(20) if a != b}


def test_runs_sinks_and_merge(spark, tmp_path):
    rows, lake = random_lake(spark, 10)
    path, queries = str(tmp_path / "i"), lake.where("table_id = 1")
    run.build_and_search(path, lake, mode=run.BUILD)
    done = run.build_and_search(path, queries=queries, mode=run.SEARCH, ratio="0.5", tau=0.9)
    want = search.search(queries, lake, "0.5", tau=0.9).collect()
    assert sorted(map(str, done.found.collect())) == sorted(map(str, want))
    assert sum(r["joinable_sets"] for r in done.metrics.collect()) == sum(r["joinable"] for r in want)
    for name in "ab":
        sinks.write_log(done.found, str(tmp_path / name), 0.9, 0.5, 1.0)
    sinks.merge_results(spark, [str(tmp_path / n / "query_results") for n in "ab"], str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 2 * sum(r["joinable"] for r in want)
    with pytest.raises(ValueError, match="mode"):
        run.build_and_search(path, lake, queries, mode=3)
    assert pivots.rank_and_determinant(np.array([[2.0, 0.0], [0.0, 3.0]])) == (2, pytest.approx(6.0))
