"""Exact top-k inner products by a Voronoi kNN join.

Vectors are dealt to the cell of their nearest pivot. A cell's summary holds its radius and the
smallest distances to its pivot. For a query q and a vector x of the cell of pivot p,
|<q, x> - <q, p>| <= |q| |x - p|, so summaries give each query a score that at least k other
vectors reach, and each cell a score that none of its vectors exceeds. A query is replicated to the
cells that may still hold one of its k best, and to no other; each meeting of a block of queries with a
block of vectors is solved locally, and the local lists are merged.

Cells of any size are cut into blocks of at most `BLOCK` vectors. Groups of about `PART` blocks' worth of vectors, one
task each, hold one part of a large cell or several small cells whole; how many there are follows the vectors, not the
blocks, since every file gives blocks of its own. A query goes once to each group with a cell that may matter, and each
task holds its group and reads the queries one block after the other. So what is shuffled is the vectors once, as
integers of two bytes where they fit, and the queries once for each group.

Defined results: a vector that is null or holds null or non-finite components takes no part, nor does a
null id; shorter vectors count as padded with zeros; a query never meets rows with its own id; each row with an
id that occurs several times is a candidate of its own; of several query rows of one id, the one with the smallest
vector asks; fewer than k candidates give fewer rows; an empty table gives an empty result; other columns are ignored.
Scores are exact up to 2^53.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

BLOCK = 4096
QUERY_BLOCK = 1024
#: Blocks' worth of vectors (of up to 64 components) in one group.
PART = 64
#: So many groups at least, once each would hold half a block.
LEAST_GROUPS = 48
#: Vectors that pivots are chosen from, those with the smallest id hash.
SAMPLE = 4096
SLACK = 1e-6
#: Integers below it are exact in single precision.
SINGLE = 1 << 24


def usable(vector: Column) -> Column:
    # array_contains() is null for a vector that holds a null and not the value; NaN is greater than all numbers.
    inf = float("inf")
    whole = F.coalesce(~F.array_contains(vector, F.lit(float("nan"))), F.lit(False))
    return vector.isNotNull() & whole & F.coalesce((F.array_max(vector) < inf) & (F.array_min(vector) > -inf), F.lit(True))


def _bytes(x: np.ndarray) -> bytes:
    """Whole numbers as two bytes each if all fit, else as doubles."""
    return (x.astype(np.int16) if np.abs(x).max(initial=0) < 1 << 15 else x).tobytes()


def _rows(ids, vectors, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix out of two binary values."""
    ids, vectors = (v.as_buffer() for v in (ids, vectors))
    n = ids.size // 8
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.int16 if vectors.size == 2 * n * dim else np.float64).reshape(n, dim)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """floor(256 x) of each component as double, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = np.asarray(column.flatten()).astype(np.float64)
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = np.floor(256 * flat)
    return out


def farthest_first(x: np.ndarray, count: int) -> np.ndarray:
    chosen, nearest = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(x)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T, 0))


def _blocks(vectors: DataFrame, dim: int, shared, k: int, most: int) -> DataFrame:
    """Rows (cell, n, ids, vectors, radius, near) of at most `most` vectors of one cell."""

    def pack(cell, ids, x, pivots):
        d = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
        return [cell, len(ids), ids.tobytes(), _bytes(x), float(d.max()), np.sort(d)[: k + 1].tolist()]

    def run(batches):
        pivots, held, size = shared.value, {}, {}
        schema = pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("radius", pa.float64()), ("near", pa.list_(pa.float64()))])
        emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        total = 0
        for batch in batches:
            ids, x = np.asarray(batch.column("vec_id")).astype(np.int64), _matrix(batch.column("vector"), dim)
            cell = _distances(x, pivots).argmin(1) if len(x) else np.zeros(0, int)
            for c in np.unique(cell).tolist():
                at = np.flatnonzero(cell == c)
                held.setdefault(c, []).append((ids[at], x[at]))
                size[c] = size.get(c, 0) + len(at)
                total += len(at)
                while size[c] >= most:
                    a, b = (np.concatenate([h[i] for h in held[c]]) for i in (0, 1))
                    yield emit([pack(c, a[:most], b[:most], pivots)])
                    held[c], size[c], total = [(a[most:], b[most:])], size[c] - most, total - most
            if total > 16 * most:
                for c in [c for c in held if size[c]]:
                    yield emit([pack(c, *(np.concatenate([h[i] for h in held[c]]) for i in (0, 1)), pivots)])
                held, size, total = {}, {}, 0
        for c in held:
            if size[c]:
                yield emit([pack(c, *(np.concatenate([h[i] for h in held[c]]) for i in (0, 1)), pivots)])

    return vectors.mapInArrow(run, "cell int, n long, ids binary, vectors binary, radius double, near array<double>")


def top(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, ties to the smaller vec."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    first = np.ones(len(q), bool)
    first[1:] = q[1:] != q[:-1]
    start = np.flatnonzero(first)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < k]


def _groups(sizes: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """cell -> (first group, groups): small cells share a group of at most `most` vectors, larger ones have several."""
    out, used, open_, filled = {}, 0, 0, most
    for cell, n in sorted(sizes.items()):
        if n >= most:
            out[cell] = used, -(-n // most)
            used += out[cell][1]
            continue
        if filled + n > most:
            open_, filled, used = used, 0, used + 1
        out[cell], filled = (open_, 1), filled + n
    return out


def _tiles(held: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple]:
    """(cells, ids in order, vectors, greatest length) of at most `BLOCK` vectors of neighbouring cells."""
    cell = np.repeat([c for c, _, _ in held], [len(i) for _, i, _ in held])
    ids, x = (np.concatenate([h[i] for h in held]) for i in (1, 2))
    order, out = np.argsort(cell, kind="stable"), []
    for a in range(0, len(order), BLOCK):
        own = order[a : a + BLOCK]
        own = own[np.argsort(ids[own], kind="stable")]
        v = x[own].astype(np.float32 if x.dtype == np.int16 else np.float64)
        out.append((np.unique(cell[own]), ids[own], v, math.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64).max())))
    return out


def _best(q_ids: np.ndarray, q: np.ndarray, bar: np.ndarray, upper: np.ndarray, tiles: list[tuple], k: int) -> tuple:
    """(query id, vec_id, score) of each query's k best that reach its bar; upper: by query and cell, what no score exceeds."""
    bar, single, longest = bar.copy(), q.astype(np.float32), math.sqrt((q**2).sum(1).max())
    kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for cells, ids, x, length in tiles:
        at = np.flatnonzero(upper[:, cells].max(1) >= bar)
        if not len(at):
            continue
        exact = x.dtype == np.float32 and longest * length < SINGLE
        score = single[at] @ x.T if exact else q[at] @ x.astype(np.float64).T
        least = np.ceil(bar[at]).astype(np.float32) if exact else bar[at]
        # The query's own rows.
        lo, hi = np.searchsorted(ids, q_ids[at], "left"), np.searchsorted(ids, q_ids[at], "right")
        for i in np.flatnonzero(hi > lo).tolist():
            score[i, lo[i] : hi[i]] = -np.inf
        some = np.flatnonzero(score.max(1) >= least)
        if not len(some):
            continue
        score, least, at = score[some], least[some], at[some]
        hit = score >= least[:, None]
        many = np.flatnonzero(hit.sum(1) > 16 * k)
        if len(many):
            # Above the k-th score all, at it the first by id: k of each.
            s, m = score[many], min(k, len(ids))
            kth = -np.partition(-s, m - 1, axis=1)[:, m - 1, None]
            above, equal = s > kth, s == kth
            hit[many] = above | (equal & (np.cumsum(equal, axis=1) <= m - above.sum(1, keepdims=True)))
        place = np.flatnonzero(hit)
        s = score.ravel()[place].astype(np.float64)
        place, s = place[np.isfinite(s)], s[np.isfinite(s)]
        i, j = np.divmod(place, len(ids))
        kept = tuple(np.concatenate(v) for v in zip(kept, (at[i], ids[j], s), strict=True))
        first = top(*kept, k)
        kept = tuple(v[first] for v in kept)
        full, lowest = np.bincount(kept[0], minlength=len(q)) == k, np.full(len(q), np.inf)
        np.minimum.at(lowest, kept[0], kept[2])
        bar[full] = np.maximum(bar[full], lowest[full])
    return q_ids[kept[0]], kept[1], kept[2]


def _sampled(data: DataFrame, n: int) -> pa.Table:
    """The `SAMPLE` rows with the smallest id hash; a bound on the hash spares sorting the rest wherever it leaves enough."""
    first = lambda df: df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    if n > 8 * SAMPLE:
        got = first(data.where(F.xxhash64("vec_id") < -(1 << 63) + (1 << 64) * 4 * SAMPLE // n))
        if got.num_rows == SAMPLE:
            return got
    return first(data)


def knn_join(data: DataFrame, queries: DataFrame, k: int = 5, pivots: int | None = None) -> DataFrame:
    """(vec_id, vector) twice -> query_id, rank, vec_id, score: the k highest inner products of floor(256 x)."""
    spark = data.sparkSession
    ok = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    data, queries = ok(data), ok(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    shape = data.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    dim = max(shape["d"] or 1, queries.agg(F.max(F.size("vector")).alias("d")).first()["d"] or 1)
    schema = "query_id long, rank int, vec_id long, score long"
    if not shape["n"]:
        return spark.createDataFrame([], schema)
    sample = _sampled(data, shape["n"])
    sample_ids, sample_x = np.asarray(sample.column("vec_id")).astype(np.int64), _matrix(sample.column("vector"), dim)
    count = pivots or min(512, max(1, round(math.sqrt(shape["n"]) / 4)))
    centers = farthest_first(sample_x, count)
    shared = spark.sparkContext.broadcast(centers)
    blocks = written(_blocks(data, dim, shared, k, BLOCK))
    # The driver gets a size, a radius and at most k + 1 distances for each pivot.
    cells = blocks.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near")).collect()
    number = np.array([r["cell"] for r in cells])
    radius = np.array([r["radius"] for r in cells])
    near = np.full((len(cells), k + 1), np.inf)
    for i, r in enumerate(cells):
        near[i, : len(r["near"])] = r["near"]
    groups = _groups({r["cell"]: r["n"] for r in cells}, max(1, min(BLOCK * PART * 64 // max(dim, 64), max(BLOCK // 2, -(-shape["n"] // LEAST_GROUPS)))))
    total = max(first + parts for first, parts in groups.values())
    # (first group, groups) -> places of its cells.
    members: dict[tuple[int, int], list[int]] = {}
    for i, c in enumerate(number.tolist()):
        members.setdefault(groups[c], []).append(i)
    summary = spark.sparkContext.broadcast((number, centers[number], radius, near, members, sample_ids, sample_x))

    def bounds(q):
        """(inner product with each pivot, what no score of its cell exceeds)."""
        _, centers, radius, *_ = summary.value
        middle, reach = q @ centers.T, np.sqrt((q**2).sum(1))[:, None] * radius
        return middle, middle + reach + SLACK * (1 + np.abs(middle) + reach)

    def replicate(batches):
        _, _, _, near, members, sample_ids, sample_x = summary.value
        for batch in batches:
            every, vectors = np.asarray(batch.column("vec_id")).astype(np.int64), _matrix(batch.column("vector"), dim)
            for a in range(0, len(every), QUERY_BLOCK):
                ids, q = every[a : a + QUERY_BLOCK], vectors[a : a + QUERY_BLOCK]
                middle, upper = bounds(q)
                length = np.sqrt((q**2).sum(1))[:, None]
                with np.errstate(invalid="ignore"):
                    least = np.where(np.isfinite(near)[None], middle[:, :, None] - length[:, :, None] * near[None], -np.inf).reshape(len(q), -1)
                # The (k + 1)-th: one of those vectors may be the query itself.
                bar = -np.partition(-least, min(k, least.shape[1] - 1), axis=1)[:, min(k, least.shape[1] - 1)] if least.shape[1] > k else np.full(len(q), -np.inf)
                bar = bar - SLACK * (1 + np.abs(bar)) if least.shape[1] > k else bar
                if len(sample_ids) >= k:
                    score = q @ sample_x.T
                    score[ids[:, None] == sample_ids[None, :]] = -np.inf
                    bar = np.maximum(bar, -np.partition(-score, k - 1, axis=1)[:, k - 1])
                need = upper >= bar[:, None]
                for (first, parts), own in members.items():
                    at = np.flatnonzero(need[:, own].any(1))
                    if len(at):
                        row = [[1] * parts, [-1] * parts, [ids[at].tobytes()] * parts, [_bytes(q[at])] * parts, [bar[at].tobytes()] * parts]
                        yield pa.RecordBatch.from_arrays([pa.array(range(first, first + parts), pa.int32()), *[pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)]], ["group", "kind", "cell", "ids", "vectors", "bars"])

    names = "group int, kind int, cell int, ids binary, vectors binary, bars binary"
    sent = queries.mapInArrow(replicate, names)
    known = [groups.get(c, (0, 1)) for c in range(int(number.max()) + 1)]
    first, parts = (F.get(F.array(*[F.lit(g[i]) for g in known]), F.col("cell")) for i in (0, 1))
    group = (first + F.pmod(F.xxhash64("ids"), parts)).cast("int")
    dealt = blocks.select(group.alias("group"), F.lit(0).alias("kind"), "cell", "ids", "vectors", F.lit(None).cast("binary").alias("bars"))

    def solve(batches):
        number = summary.value[0]
        place = {c: i for i, c in enumerate(number.tolist())}
        group, held, tiles = None, [], []
        for batch in batches:
            for g, kind, cell, raw_ids, raw, bars in zip(*(batch.column(c).to_pylist() for c in ("group", "kind", "cell")), *(batch.column(c) for c in ("ids", "vectors", "bars")), strict=True):
                if g != group:
                    group, held, tiles = g, [], []
                ids, x = _rows(raw_ids, raw, dim)
                if not kind:
                    held.append((place[cell], ids.copy(), x.copy()))
                    continue
                if held:
                    tiles, held = _tiles(held), []
                q = x.astype(np.float64)
                yield _scored(_best(ids, q, np.frombuffer(bars.as_buffer()), bounds(q)[1], tiles, k))

    # A group is a task, the vectors before the queries.
    met = dealt.unionByName(sent).repartitionById(total, F.col("group")).sortWithinPartitions("group", "kind")
    local = met.mapInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scored(a) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(a[1]), pa.array(a[2].astype(np.int64))], ["query_id", "vec_id", "score"])


def op1_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return knn_join(vectors, vectors.where(F.col("vec_id") % 50 == 0))
