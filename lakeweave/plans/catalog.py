"""Named queries over the fixture tables, each with SQL that gives the same rows.

The lake is the embeddings table: a column is a label, a vector's place its vec_id. Every column is a query
column too. Distances are in double precision; thresholds lie well away from any distance in the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pruning as P
from ..functions.grid import GridSettings, outside
from ..functions.vectors import magnitude, mean
from ..operators import evaluate, index, overlap, pairs, pivots, search, stats
from ..sources import lake as L

TAU, RATIO = 1.2, "0.45"
PIVOTS, LEVELS = 3, 3
SMALL_TAU = 0.12


def lake(spark: SparkSession, sf: str) -> DataFrame:
    return L.from_table(spark.read.parquet(f"{sf}/embeddings.parquet"), "label", "vec_id", "embedding")


def grid(df: DataFrame) -> GridSettings:
    """The vectors with the smallest ids as pivots: any choice is right, this one SQL can make too."""
    rows = df.orderBy("pos").limit(PIVOTS).select("values").collect()
    return GridSettings(tuple(tuple(map(float, r["values"])) for r in rows), LEVELS)


def _both(spark, sf):
    x = lake(spark, sf)
    return x, grid(x)


def _indexed(spark, sf):
    x, g = _both(spark, sf)
    return index.with_cells(x, g), g


def _rounded(column: str):
    return F.transform(column, lambda v: F.round(v, 6))


def pivot_map(spark, sf):
    x, _ = _indexed(spark, sf)
    return x.select("set_id", "pos", *[F.round(F.get("ps", F.lit(k)), 6).alias(f"p{k}") for k in range(PIVOTS)])


def cell_zone_map(spark, sf):
    x, g = _indexed(spark, sf)
    z = index.zone_map(x, g)
    return z.select("cell_id", "n", *[F.round(F.get(c, F.lit(k)), 6).alias(f"{c}{k}") for c in ("lo", "hi") for k in range(PIVOTS)])


def _pairs(spark, sf):
    """Pivot coordinates of all pairs of vectors of different columns."""
    x, _ = _indexed(spark, sf)
    q, s = search._sides(x, x, ("ps",))
    return q.drop("q_values"), s.drop("s_values")


def _per_pair(spark, sf, join, tau):
    q, s = _pairs(spark, sf)
    return join(q, "q_ps", s, "s_ps", PIVOTS, tau).groupBy("q_set", "s_set").agg(F.count("*").alias("pairs"))


def lemma3(spark, sf):
    x, g = _both(spark, sf)
    return search.candidate_pairs(x, x, g, SMALL_TAU).groupBy("q_set").agg(F.count("*").alias("cells"))


def lemma4(spark, sf):
    x, g = _both(spark, sf)
    return search.candidate_cell_pairs(x, x, g, SMALL_TAU).groupBy("q_set").agg(F.count("*").alias("cell_pairs"))


def lemma5(spark, sf):
    x, g = _indexed(spark, sf)
    q = x.select(F.col("set_id").alias("q_set"), F.col("ps").alias("q_ps"))
    return pairs.sum_some(q, "q_ps", index.zone_map(x, g), "hi", PIVOTS, 1.5).groupBy("q_set").agg(F.count("*").alias("cells"))


def lemma6(spark, sf):
    x, g = _indexed(spark, sf)
    q = index.zone_map(x, g, ("set_id", "cell_id")).select(F.col("set_id").alias("q_set"), F.col("hi").alias("q_hi"))
    return pairs.sum_some(q, "q_hi", index.zone_map(x, g).select("hi"), "hi", PIVOTS, 1.5).groupBy("q_set").agg(F.count("*").alias("cell_pairs"))


def lakes(spark, sf, n=7):
    """A lake of several tables: table pmod(pos, n)."""
    return lake(spark, sf).withColumn("table_id", F.pmod("pos", F.lit(n)).cast("int"))


def match_map_zero_rows(spark, sf):
    x = lake(spark, sf)
    m = search.match_map(search.similarity_counts(x, x, 0.9, exclude_self=True), x, x, zeros=True)
    return m.select("q_set", "s_set", "q_size", "s_size", "matched", "pairs", "nooverlap", "mismatched")


def query_counters(spark, sf):
    x, g = _both(spark, sf)
    return stats.query_counters(x, x, g, SMALL_TAU).drop("q_table")


def cell_read(spark, sf):
    """Vectors of the subtrees of three first-level cells."""
    x, g = _both(spark, sf)
    return index.read_tuples(index.build_index(x, g), [0, 3, 5], 1).select("cell_id", "set_id", "pos")


def joinable_sets_index(spark, sf):
    x, g = _both(spark, sf)
    found = search.search(x, index.build_index(x, g), RATIO, tau=TAU, exclude_self=True)
    return found.select("q_set", "s_set", "q_size", "s_size", "matched", "pairs", "nooverlap", "mismatched", "need", "joinable")


def joinable_only_index(spark, sf):
    x, g = _both(spark, sf)
    return search.search(x, index.build_index(x, g), RATIO, tau=TAU, exclude_self=True, only_joinable=True).select("q_set", "s_set", "matched", "pairs")


def _search(spark, sf, **options):
    x = lake(spark, sf)
    found = search.search(x, x, RATIO, tau=TAU, exclude_self=True, **options)
    return found.select("q_set", "s_set", "q_size", "s_size", "matched", "pairs", "nooverlap", "mismatched", "need", "joinable")


def similarity_pairs(spark, sf):
    x = lake(spark, sf)
    return search.similarity_counts(x, x, TAU, exclude_self=True).select("q_set", "q_pos", "s_set", "pairs")


def pairwise_distance(spark, sf):
    """Distances between the columns' mean vectors."""
    x = lake(spark, sf)
    place = x.select("set_id", F.posexplode("values").alias("i", "v"))
    center = place.groupBy("set_id", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    other = center.select(F.col("set_id").alias("s2"), F.col("i").alias("i2"), F.col("m").alias("m2"))
    j = center.join(other, (F.col("i") == F.col("i2")) & (F.col("set_id") < F.col("s2")))
    return j.groupBy("set_id", "s2").agg(F.round(F.sqrt(F.sum((F.col("m") - F.col("m2")) * (F.col("m") - F.col("m2")))), 6).alias("distance"))


def quick_browse(spark, sf):
    x, g = _both(spark, sf)
    return search.quick_browse(x, x, g).groupBy("q_set", "cell_id").agg(F.count("*").alias("vectors"))


def block_candidates(spark, sf):
    x, g = _both(spark, sf)
    return search.candidate_pairs(x, x, g, SMALL_TAU).groupBy("q_set", "kind").agg(F.count("*").alias("cells"))


def lemma7(spark, sf):
    x, g = _both(spark, sf)
    return search.upper_bound(x, x, g, SMALL_TAU, RATIO).select("q_set", "s_set", "q_size", "bound", "keep")


TAUS = (1.0, 1.1, 1.2, 1.3)
RATIOS = ("0.2", "0.3", "0.4", "0.45", "0.5", "0.6")


def tau_sweep(spark, sf):
    x, out = lake(spark, sf), None
    for t in TAUS:
        m = search.match_map(search.similarity_counts(x, x, t, exclude_self=True), x, x).select(F.lit(t).alias("tau"), "q_set", "s_set", "matched", "pairs")
        out = m if out is None else out.union(m)
    return out


def threshold_sweep(spark, sf):
    x = lake(spark, sf)
    m = search.match_map(search.similarity_counts(x, x, TAU, exclude_self=True), x, x).select("q_set", "q_size", "matched")
    rows = m.select("q_set", F.explode(F.array(*[F.struct(F.lit(float(r)).alias("ratio"), (F.col("matched") >= search.needed(F.col("q_size"), r)).alias("ok")) for r in RATIOS])).alias("r"))
    return rows.groupBy("q_set", "r.ratio").agg(F.count_if("r.ok").alias("joinable_sets"))


def pruning(spark, sf):
    x, g = _both(spark, sf)
    return stats.pruning_stats(x, x, g, SMALL_TAU)


#: (table, its string columns)
STRINGS = [("region", ["r_name"]), ("nation", ["n_name"]), ("customer", ["c_name", "c_mktsegment"]), ("supplier", ["s_name"]), ("part", ["p_name", "p_brand", "p_type"]), ("orders", ["o_orderstatus", "o_orderpriority"]), ("lineitem", ["l_returnflag", "l_linestatus"])]


def exact_overlap_strings(spark, sf):
    values = None
    for i, (name, cols) in enumerate(STRINGS):
        v = L.columns_of(spark.read.parquet(f"{sf}/{name}.parquet").select(*cols), i, cols)
        values = v if values is None else values.union(v)
    return overlap.exact_overlap(values)


def recall_precision(spark, sf):
    """Columns joinable by pairs, scored against those joinable by distinct query vectors."""
    x = lake(spark, sf)
    m = search.match_map(search.similarity_counts(x, x, TAU, exclude_self=True), x, x)
    truth, result = (search.joinable(m, RATIO, mode).where("joinable") for mode in ("distinct", "pairs"))
    s = evaluate.recall_precision(result, truth, ["q_set"], ["s_set"])
    return s.select("q_set", "truth_size", "result_size", "hits", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


#: A small table of run times, (tau in percent, T in percent, seconds).
TIMES = [(t, r, 0.5 * t + 0.25 * r + 0.125 * k) for t in (0, 2, 6, 8) for r in (1, 60) for k in range(4)]


def mean_time_by_config(spark, sf):
    times = spark.createDataFrame(TIMES, "tau int, ratio int, seconds double")
    return evaluate.mean_time(times, ["tau", "ratio"])


def _chosen(spark, sf, choice):
    rows = [(k, i, round(v, 6)) for k, p in enumerate(choice.pivots) for i, v in enumerate(p)]
    return spark.createDataFrame(rows, "pivot int, i int, value double")


QUERIES = {
    "joinable_sets": _search,
    "lake_info": lambda s, d: L.lake_info(lake(s, d)),
    "lake_info_first_n": lambda s, d: L.lake_info(L.first_tables(lakes(s, d), 3)),
    "lake_info_tables": lambda s, d: L.lake_info(lakes(s, d)),
    "set_catalog_tables": lambda s, d: L.set_catalog(lakes(s, d)),
    "match_map_zero_rows": match_map_zero_rows,
    "query_counters": query_counters,
    "cell_read": cell_read,
    "joinable_sets_index": joinable_sets_index,
    "joinable_only_index": joinable_only_index,
    "set_catalog": lambda s, d: L.set_catalog(lake(s, d)),
    "query_set_selection": lambda s, d: L.select_queries(lake(s, d), 20, 60, 5),
    "nan_vectors": lambda s, d: L.nan_vectors(s.read.parquet(f"{d}/embeddings.parquet"), "embedding").agg(F.count("*").alias("rejected")),
    "vector_mean_norm": lambda s, d: lake(s, d).select("pos", F.round(mean(F.col("values")), 6).alias("mean"), F.round(magnitude(F.col("values")), 6).alias("norm")),
    "pairwise_distance": pairwise_distance,
    "pivot_map": pivot_map,
    "pivot_extremity": lambda s, d: s.createDataFrame([(round(_both(s, d)[1].extremity, 6),)], "extremity double"),
    "out_of_pivot_space": lambda s, d: index.out_of_space(*_indexed(s, d)),
    "cell_assignment": lambda s, d: _indexed(s, d)[0].select("set_id", "pos", "cell_id"),
    "level_histogram": lambda s, d: index.level_histogram(*_indexed(s, d)),
    "empty_leaf_cells": lambda s, d: index.empty_leaves(*_indexed(s, d)),
    "inverted_index": lambda s, d: index.inverted_index(_indexed(s, d)[0]).drop("table_id"),
    "cell_zone_map": cell_zone_map,
    "quick_browse": quick_browse,
    "lemma1_filter": lambda s, d: _per_pair(s, d, pairs.within_all, SMALL_TAU),
    "lemma1_weak_filter": lambda s, d: _per_pair(s, d, pairs.within_some, SMALL_TAU),
    "lemma2_match": lambda s, d: _per_pair(s, d, pairs.sum_some, TAU),
    "lemma3_vector_cell_filter": lemma3,
    "lemma4_cell_cell_filter": lemma4,
    "lemma5_vector_cell_match": lemma5,
    "lemma6_cell_cell_match": lemma6,
    "lemma7_upper_bound": lemma7,
    "block_candidates": block_candidates,
    "similarity_pairs": similarity_pairs,
    "match_map": lambda s, d: _search(s, d).drop("need", "joinable"),
    "joinable_sets_pairs_mode": lambda s, d: _search(s, d, count_mode="pairs"),
    "joinable_sets_sqrt2tau": lambda s, d: search.search(lake(s, d), lake(s, d), RATIO, tau=0.6, exclude_self=True, verify_radius="sqrt2tau").select("q_set", "s_set", "matched", "pairs", "joinable"),
    "joinable_all_vs_all": lambda s, d: search.search(lake(s, d), lake(s, d), RATIO, tau=TAU).select("q_set", "s_set", "matched", "pairs", "joinable"),
    "tau_sweep": tau_sweep,
    "threshold_sweep": threshold_sweep,
    "pruning_stats": pruning,
    "stats_unpivot": lambda s, d: stats.unpivot_stats(pruning(s, d), []),
    "exact_overlap_strings": exact_overlap_strings,
    "recall_precision": recall_precision,
    "mean_time_by_config": mean_time_by_config,
    "fft_pivots": lambda s, d: _chosen(s, d, pivots.PivotChoice(tuple(map(tuple, pivots.farthest_first_distributed(lake(s, d), PIVOTS, list(grid(lake(s, d)).pivots[0])))), 0.0, 1)),
    "pca_pivots": lambda s, d: _chosen(s, d, pivots.select_pivots(pivots.sample(lake(s, d)), PIVOTS)),
}

# ---------------------------------------------------------------------- SQL

_R = [f"(7 - CAST(greatest(0, least(7, floor(ps[{k + 1}] / (e / 8)))) AS BIGINT))" for k in range(PIVOTS)]
_CELL = " + ".join(f"((({_R[k]} >> {LEVELS - 1 - b}) & 1) << {PIVOTS * (LEVELS - 1 - b) + PIVOTS - 1 - k})" for b in range(LEVELS) for k in range(PIVOTS))
_LAKE = "lake AS (SELECT 0 AS t, label AS s, vec_id AS p, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)"
_LAKES = f"{_LAKE}, lakes AS (SELECT CAST(p % 7 AS INTEGER) AS t, s, p, v FROM lake)"
_PS = f"""WITH {_LAKE},
piv AS (SELECT row_number() OVER (ORDER BY p) AS k, v FROM (SELECT * FROM lake ORDER BY p LIMIT {PIVOTS})),
ext AS (SELECT max(list_distance(a.v, b.v)) AS e FROM piv a, piv b),
ps AS (SELECT l.t, l.s, l.p, list(list_distance(l.v, piv.v) ORDER BY k) AS ps FROM lake l, piv GROUP BY l.t, l.s, l.p),
cells AS (SELECT t, s, p, ps, {_CELL} AS c FROM ps, ext),
zones AS (SELECT c, count(*) AS n, {", ".join(f"min(ps[{k}]) AS lo{k}, max(ps[{k}]) AS hi{k}" for k in (1, 2, 3))} FROM cells GROUP BY c),
qzones AS (SELECT s, c, {", ".join(f"min(ps[{k}]) AS lo{k}, max(ps[{k}]) AS hi{k}" for k in (1, 2, 3))} FROM cells GROUP BY s, c)
"""
_E = P.EPS
_and = lambda f: "(" + " AND ".join(f(k) for k in (1, 2, 3)) + ")"
_or = lambda f: "(" + " OR ".join(f(k) for k in (1, 2, 3)) + ")"
_BAND = lambda k: f"abs(a.ps[{k}] - b.ps[{k}]) <= {SMALL_TAU} + {_E}"
_BOX = _and(lambda k: f"z.lo{k} <= a.ps[{k}] + {SMALL_TAU} + {_E} AND z.hi{k} >= a.ps[{k}] - {SMALL_TAU} - {_E}")


def _matches(tau, square=None, other="a.s <> b.s"):
    limit = square if square is not None else f"({tau} * {tau})"
    return f"""WITH {_LAKE},
hit AS (SELECT a.s AS q_set, a.p AS q_pos, b.s AS s_set, count(*) AS pairs FROM lake a JOIN lake b ON {other} AND pow(list_distance(a.v, b.v), 2) <= {limit} GROUP BY ALL),
size AS (SELECT s, count(*) AS n FROM lake GROUP BY s),
map AS (SELECT q_set, s_set, count(*) AS matched, CAST(sum(pairs) AS BIGINT) AS pairs FROM hit GROUP BY ALL),
full_map AS (SELECT q_set, s_set, x.n AS q_size, y.n AS s_size, matched, pairs, x.n - matched AS nooverlap, x.n * y.n - pairs AS mismatched FROM map JOIN size x ON x.s = q_set JOIN size y ON y.s = s_set)
"""


_NEED = lambda r: f"CAST(ceil(CAST({r} AS DECIMAL(9,6)) * q_size) AS BIGINT)"
_FULL = f"q_set, s_set, q_size, s_size, matched, pairs, nooverlap, mismatched, {_NEED(RATIO)} AS need"
_STATS = f"""{_PS}, a AS (SELECT count(*) AS n FROM lake),
band AS (SELECT count(CASE WHEN {_and(_BAND)} THEN 1 END) AS band_pairs, count(CASE WHEN {_and(_BAND)} AND {_or(lambda k: f"a.ps[{k}] + b.ps[{k}] <= {SMALL_TAU}")} THEN 1 END) AS accepted_pairs FROM ps a, ps b),
vc AS (SELECT count(CASE WHEN NOT {_or(lambda k: f"a.ps[{k}] + z.hi{k} <= {SMALL_TAU}")} THEN 1 END) AS candidate_cells, count(CASE WHEN {_or(lambda k: f"a.ps[{k}] + z.hi{k} <= {SMALL_TAU}")} THEN 1 END) AS matching_cells FROM ps a JOIN zones z ON {_BOX}),
found AS (SELECT count(*) AS matching_pairs FROM lake a JOIN lake b ON pow(list_distance(a.v, b.v), 2) <= {SMALL_TAU} * {SMALL_TAU})
"""
_ZMATCH = lambda q: _or(lambda k: f"{q}.ps[{k}] + z.hi{k} <= {SMALL_TAU}")
_COUNTERS = f"""{_PS}, base AS (SELECT s, count(*) AS query_vectors FROM lake GROUP BY s),
vc AS (SELECT a.s, count(CASE WHEN NOT {_ZMATCH('a')} THEN 1 END) AS candidate_cells, count(CASE WHEN {_ZMATCH('a')} THEN 1 END) AS matching_cells,
  CAST(sum(CASE WHEN {_ZMATCH('a')} THEN n ELSE 0 END) AS BIGINT) AS whole_cell_pairs, CAST(sum(CASE WHEN {_ZMATCH('a')} THEN 0 ELSE n END) AS BIGINT) AS checked_pairs FROM ps a JOIN zones z ON {_BOX} GROUP BY a.s),
band AS (SELECT a.s, {_ZMATCH('a')} AS whole, {_or(lambda k: f"a.ps[{k}] + b.ps[{k}] <= {SMALL_TAU}")} AS sure FROM ps a JOIN cells b ON {_and(_BAND)} JOIN zones z ON z.c = b.c),
pc AS (SELECT s, count(CASE WHEN NOT whole THEN 1 END) AS lemma1_left, count(CASE WHEN NOT whole AND sure THEN 1 END) AS lemma2_accepted, count(CASE WHEN NOT whole AND NOT sure THEN 1 END) AS distances FROM band GROUP BY s),
near AS (SELECT a.s, count(*) AS matching_pairs FROM lake a JOIN lake b ON pow(list_distance(a.v, b.v), 2) <= {SMALL_TAU} * {SMALL_TAU} GROUP BY a.s)
SELECT base.s AS q_set, query_vectors, coalesce(candidate_cells, 0) AS candidate_cells, coalesce(matching_cells, 0) AS matching_cells, coalesce(whole_cell_pairs, 0) AS whole_cell_pairs, coalesce(checked_pairs, 0) AS checked_pairs, coalesce(lemma1_left, 0) AS lemma1_left, coalesce(lemma2_accepted, 0) AS lemma2_accepted, coalesce(distances, 0) AS distances, coalesce(matching_pairs, 0) AS matching_pairs
FROM base LEFT JOIN vc USING (s) LEFT JOIN pc USING (s) LEFT JOIN near USING (s)"""
_COLUMNS = " UNION ALL ".join(f"SELECT {i} AS t, {j} AS s, {c} AS value FROM {name} WHERE {c} IS NOT NULL" for i, (name, cols) in enumerate(STRINGS) for j, c in enumerate(cols))

ORACLE = {
    "joinable_sets": f"{_matches(TAU)} SELECT {_FULL}, matched >= {_NEED(RATIO)} AS joinable FROM full_map",
    "lake_info": f"WITH {_LAKE} SELECT count(DISTINCT t) AS tables, count(DISTINCT (t, s)) AS sets, count(*) AS vectors, min(len(v)) AS min_dim, max(len(v)) AS max_dim FROM lake",
    "lake_info_first_n": f"WITH {_LAKES} SELECT count(DISTINCT t) AS tables, count(DISTINCT (t, s)) AS sets, count(*) AS vectors, min(len(v)) AS min_dim, max(len(v)) AS max_dim FROM lakes WHERE t IN (SELECT DISTINCT t FROM lakes ORDER BY t LIMIT 3)",
    "lake_info_tables": f"WITH {_LAKES} SELECT count(DISTINCT t) AS tables, count(DISTINCT (t, s)) AS sets, count(*) AS vectors, min(len(v)) AS min_dim, max(len(v)) AS max_dim FROM lakes",
    "set_catalog_tables": f"WITH {_LAKES} SELECT t AS table_id, s AS set_id, count(*) AS set_size FROM lakes GROUP BY ALL",
    "match_map_zero_rows": f"{_matches(0.9)} SELECT x.s AS q_set, y.s AS s_set, x.n AS q_size, y.n AS s_size, coalesce(matched, 0) AS matched, coalesce(pairs, 0) AS pairs, x.n - coalesce(matched, 0) AS nooverlap, x.n * y.n - coalesce(pairs, 0) AS mismatched FROM size x CROSS JOIN size y LEFT JOIN map ON map.q_set = x.s AND map.s_set = y.s",
    "query_counters": _COUNTERS,
    "cell_read": f"{_PS} SELECT c AS cell_id, s AS set_id, p AS pos FROM cells WHERE c >> {PIVOTS * (LEVELS - 1)} IN (0, 3, 5)",
    "joinable_sets_index": f"{_matches(TAU)} SELECT {_FULL}, matched >= {_NEED(RATIO)} AS joinable FROM full_map",
    "joinable_only_index": f"{_matches(TAU)} SELECT q_set, s_set, matched, pairs FROM full_map WHERE matched >= {_NEED(RATIO)}",
    "set_catalog": f"WITH {_LAKE} SELECT t AS table_id, s AS set_id, count(*) AS set_size FROM lake GROUP BY ALL",
    "query_set_selection": f"WITH {_LAKE} SELECT t AS table_id, s AS set_id, count(*) AS set_size FROM lake GROUP BY t, s HAVING count(*) BETWEEN 20 AND 60 ORDER BY t, s LIMIT 5",
    "nan_vectors": "SELECT count(*) AS rejected FROM embeddings WHERE embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0",
    "vector_mean_norm": f"WITH {_LAKE} SELECT p AS pos, round(list_sum(v) / len(v), 6) AS mean, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm FROM lake",
    "pairwise_distance": f"WITH {_LAKE}, place AS (SELECT s, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM lake), m AS (SELECT s, i, avg(x) AS m FROM place GROUP BY ALL) SELECT a.s AS set_id, b.s AS s2, round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 6) AS distance FROM m a JOIN m b ON a.i = b.i AND a.s < b.s GROUP BY ALL",
    "pivot_map": f"{_PS} SELECT s AS set_id, p AS pos, round(ps[1], 6) AS p0, round(ps[2], 6) AS p1, round(ps[3], 6) AS p2 FROM ps",
    "pivot_extremity": f"{_PS} SELECT round(e, 6) AS extremity FROM ext",
    "out_of_pivot_space": f"{_PS} SELECT count(CASE WHEN ps[1] > e OR ps[2] > e OR ps[3] > e THEN 1 END) AS out_of_space, count(*) AS vectors FROM ps, ext",
    "cell_assignment": f"{_PS} SELECT s AS set_id, p AS pos, c AS cell_id FROM cells",
    "level_histogram": f"{_PS} SELECT l AS level, c >> (3 * (3 - l)) AS cell, count(*) AS vectors FROM cells, (SELECT unnest([1, 2, 3]) AS l) GROUP BY ALL",
    "empty_leaf_cells": f"{_PS} SELECT 512 - count(*) AS empty, count(*) AS filled, max(n) AS largest FROM zones",
    "inverted_index": f"{_PS} SELECT c AS cell_id, s AS set_id, count(*) AS vector_count FROM cells GROUP BY ALL",
    "cell_zone_map": f"{_PS} SELECT c AS cell_id, n, {', '.join(f'round({b}{k + 1}, 6) AS {b}{k}' for b in ('lo', 'hi') for k in range(3))} FROM zones",
    "quick_browse": f"{_PS} SELECT s AS q_set, c AS cell_id, count(*) AS vectors FROM cells GROUP BY ALL",
    "lemma1_filter": f"{_PS} SELECT a.s AS q_set, b.s AS s_set, count(*) AS pairs FROM ps a JOIN ps b ON {_and(_BAND)} GROUP BY ALL",
    "lemma1_weak_filter": f"{_PS} SELECT a.s AS q_set, b.s AS s_set, count(*) AS pairs FROM ps a JOIN ps b ON {_or(_BAND)} GROUP BY ALL",
    "lemma2_match": f"{_PS} SELECT a.s AS q_set, b.s AS s_set, count(*) AS pairs FROM ps a JOIN ps b ON {_or(lambda k: f'a.ps[{k}] + b.ps[{k}] <= {TAU}')} GROUP BY ALL",
    "lemma3_vector_cell_filter": f"{_PS} SELECT a.s AS q_set, count(*) AS cells FROM ps a JOIN zones z ON {_BOX} GROUP BY ALL",
    "lemma4_cell_cell_filter": f"{_PS} SELECT a.s AS q_set, count(*) AS cell_pairs FROM qzones a JOIN zones z ON {_and(lambda k: f'z.lo{k} <= a.hi{k} + {SMALL_TAU} + {_E} AND z.hi{k} >= a.lo{k} - {SMALL_TAU} - {_E}')} GROUP BY ALL",
    "lemma5_vector_cell_match": f"{_PS} SELECT a.s AS q_set, count(*) AS cells FROM ps a JOIN zones z ON {_or(lambda k: f'a.ps[{k}] + z.hi{k} <= 1.5')} GROUP BY ALL",
    "lemma6_cell_cell_match": f"{_PS} SELECT a.s AS q_set, count(*) AS cell_pairs FROM qzones a JOIN zones z ON {_or(lambda k: f'a.hi{k} + z.hi{k} <= 1.5')} GROUP BY ALL",
    "lemma7_upper_bound": f"{_PS}, cand AS (SELECT a.s AS q_set, a.p AS q_pos, z.c FROM ps a JOIN zones z ON {_BOX}), inv AS (SELECT DISTINCT c, s FROM cells), size AS (SELECT s, count(*) AS n FROM lake GROUP BY s), b AS (SELECT q_set, inv.s AS s_set, count(DISTINCT q_pos) AS bound FROM cand JOIN inv USING (c) GROUP BY ALL) SELECT q_set, s_set, n AS q_size, bound, bound >= CAST(ceil(CAST({RATIO} AS DECIMAL(9,6)) * n) AS BIGINT) AS keep FROM b JOIN size ON size.s = q_set",
    "block_candidates": f"{_PS} SELECT a.s AS q_set, CASE WHEN {_or(lambda k: f'a.ps[{k}] + z.hi{k} <= {SMALL_TAU}')} THEN 'match' ELSE 'candidate' END AS kind, count(*) AS cells FROM ps a JOIN zones z ON {_BOX} GROUP BY ALL",
    "similarity_pairs": f"{_matches(TAU)} SELECT q_set, q_pos, s_set, pairs FROM hit",
    "match_map": f"{_matches(TAU)} SELECT * FROM full_map",
    "joinable_sets_pairs_mode": f"{_matches(TAU)} SELECT {_FULL}, pairs >= {_NEED(RATIO)} AS joinable FROM full_map",
    "joinable_sets_sqrt2tau": f"{_matches(None, '1.2')} SELECT q_set, s_set, matched, pairs, matched >= {_NEED(RATIO)} AS joinable FROM full_map",
    "joinable_all_vs_all": f"{_matches(TAU, other='TRUE')} SELECT q_set, s_set, matched, pairs, matched >= {_NEED(RATIO)} AS joinable FROM full_map",
    "tau_sweep": f"WITH {_LAKE}, d AS (SELECT a.s AS q_set, a.p AS q_pos, b.s AS s_set, list_distance(a.v, b.v) AS d FROM lake a JOIN lake b ON a.s <> b.s) SELECT CAST(tau AS DOUBLE) AS tau, q_set, s_set, count(DISTINCT q_pos) AS matched, count(*) AS pairs FROM d JOIN (SELECT unnest([{', '.join(map(str, TAUS))}]) AS tau) ON d <= tau GROUP BY ALL",
    "threshold_sweep": f"{_matches(TAU)} SELECT q_set, CAST(r AS DOUBLE) AS ratio, count(CASE WHEN matched >= CAST(ceil(r * q_size) AS BIGINT) THEN 1 END) AS joinable_sets FROM full_map, (SELECT unnest([{', '.join(f'CAST({r} AS DECIMAL(9,6))' for r in RATIOS)}]) AS r) GROUP BY ALL",
    "pruning_stats": f"{_STATS} SELECT a.n * a.n AS all_pairs, band_pairs, accepted_pairs, candidate_cells, matching_cells, matching_pairs FROM a, band, vc, found",
    "stats_unpivot": f"{_STATS}, wide AS (SELECT a.n * a.n AS all_pairs, band_pairs, accepted_pairs, candidate_cells, matching_cells, matching_pairs FROM a, band, vc, found) SELECT counter, value FROM wide UNPIVOT (value FOR counter IN (all_pairs, band_pairs, accepted_pairs, candidate_cells, matching_cells, matching_pairs))",
    "exact_overlap_strings": f"WITH c AS (SELECT DISTINCT t, s, value FROM ({_COLUMNS})), size AS (SELECT t, s, count(*) AS n FROM c GROUP BY ALL) SELECT a.t AS q_table, a.s AS q_set, b.t AS s_table, b.s AS s_set, count(*) AS overlap, any_value(n) AS q_size FROM c a JOIN c b ON a.value = b.value AND (a.t <> b.t OR a.s <> b.s) JOIN size ON size.t = a.t AND size.s = a.s GROUP BY a.t, a.s, b.t, b.s",
    "recall_precision": f"{_matches(TAU)}, truth AS (SELECT q_set, s_set FROM full_map WHERE matched >= {_NEED(RATIO)}), res AS (SELECT q_set, s_set FROM full_map WHERE pairs >= {_NEED(RATIO)}), t AS (SELECT q_set, count(*) AS truth_size FROM truth GROUP BY ALL), r AS (SELECT q_set, count(*) AS result_size FROM res GROUP BY ALL), h AS (SELECT q_set, count(*) AS hits FROM truth JOIN res USING (q_set, s_set) GROUP BY ALL) SELECT t.q_set, truth_size, coalesce(result_size, 0) AS result_size, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / truth_size, 6) AS recall, round(hits / result_size, 6) AS precision FROM t LEFT JOIN r ON r.q_set = t.q_set LEFT JOIN h ON h.q_set = t.q_set",
    "mean_time_by_config": f"SELECT tau, ratio, avg(seconds) AS mean_seconds, min(seconds) AS min_seconds, max(seconds) AS max_seconds, count(*) AS runs FROM (VALUES {', '.join(f'(CAST({t} AS INTEGER), CAST({r} AS INTEGER), CAST({x} AS DOUBLE))' for t, r, x in TIMES)}) v(tau, ratio, seconds) GROUP BY tau, ratio",
}
