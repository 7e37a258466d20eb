"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors become integers, floor(scale * x), when they meet. Queries and data are grouped by their nearest pivot.
Each data group is summarized by its size, its radius and the distances of the members nearest
to the pivot, as a histogram; each query group by its size, radius and longest vector. For a query group with centre c,
radius s and longest vector m, and a data group with pivot p and radius r, no inner product exceeds
c.p + s|p| + m r, and a member at distance d from p gives at least c.p - s|p| - m d. The k + 1 best
of the latter bound what every query surely reaches (one may be the query itself), so a data group
whose upper bound is below that is not joined with the query group. Data groups are cut into blocks, and the queries
that need a group into others, both of bounded size, so a hot group is many tasks: queries are
copied to the blocks they need, a data block once for every `block_queries` of them. A pair of
blocks is solved by one exact matrix product, and the blocks' top k merge by query.

Defined results: vectors that are null or hold a null or non-finite component, or have another length than most
(the shorter of two as frequent), take no part; rows with the query's own id are no candidates; a repeated query id is one query
(its smallest vector), repeated data rows each count; ties go to the smaller id; fewer candidates than k give
fewer rows. Scores are exact for vectors of any size: products that doubles cannot hold exactly are made of whole Python
numbers. A score beyond a long's range is the end of that range.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.llm.shared import cut, grouped, partitions

_LEAST, _MOST = -(1 << 63) + 1, (1 << 63) - 1  # scores; one below _LEAST marks the query's own rows


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as whole Python numbers, also where the product leaves the doubles."""
    one = lambda v: math.floor(scale * v) if math.isfinite(scale * v) else int(v) * int(scale)
    return np.array([one(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def products(q: np.ndarray, x: np.ndarray, scale: float) -> np.ndarray:
    """Integer inner products of floor(scale * row) for each row of q with each of x, held to [_LEAST, _MOST]."""
    out = np.zeros((len(q), len(x)), np.int64)
    bound = math.sqrt(2.0**52 / q.shape[1]) / scale - 1  # below it each partial sum is a whole double
    far_q, far_x = (np.abs(v).max(axis=1) > bound for v in (q, x))
    near_q, near_x = np.flatnonzero(~far_q), np.flatnonzero(~far_x)
    out[np.ix_(near_q, near_x)] = np.rint(np.floor(scale * q[near_q]) @ np.floor(scale * x[near_x]).T).astype(np.int64)
    for rows, cols in ((np.flatnonzero(far_q), np.arange(len(x))), (near_q, np.flatnonzero(far_x))):
        if len(rows) and len(cols):
            exact = _whole(q[rows], scale) @ _whole(x[cols], scale).T
            out[np.ix_(rows, cols)] = np.minimum(np.maximum(exact, _LEAST), _MOST).astype(np.int64)
    return out


def _assign(pivots: np.ndarray, scale: float):
    dim, half = pivots.shape[1], (pivots**2).sum(axis=1) / 2

    def run(batches):
        for batch in batches:
            with np.errstate(over="ignore", invalid="ignore"):
                x = scale * _matrix(batch.column(1), dim)
                g = np.argmax(np.nan_to_num(x @ pivots.T - half, nan=0.0), axis=1)
                d = np.sqrt(((x - pivots[g]) ** 2).sum(axis=1)) + dim**0.5  # floor moves a vector by that at most
                size = np.sqrt((x**2).sum(axis=1)) + dim**0.5
            d, size = np.nan_to_num(d, nan=np.inf, posinf=np.inf), np.nan_to_num(size, nan=np.inf, posinf=np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(g.astype(np.int32)), pa.array(d), pa.array(size)], ["vec_id", "v", "g", "d", "len"])

    return run


def top(score: np.ndarray, k: int) -> np.ndarray:
    """Which columns are among each row's k largest; of equal ones the first."""
    if score.shape[1] <= k:
        return np.ones(score.shape, bool)
    least = np.partition(score, score.shape[1] - k, axis=1)[:, -k][:, None]
    above, equal = score > least, score == least
    return above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1)[:, None]))


def _solve(k: int, dim: int, scale: float):
    def run(batches):
        for table in grouped(batches, "key"):
            side = table.column("side").to_numpy()
            ids, v = table.column("vec_id").to_numpy(), _matrix(table.column("v"), dim)
            q, x = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(q) or not len(x):
                continue
            x = x[np.argsort(ids[x], kind="stable")]
            out = [[], [], []]
            for at in range(0, len(q), 256):
                rows = q[at : at + 256]
                score = products(v[rows], v[x], scale)
                score[ids[rows][:, None] == ids[x][None, :]] = _LEAST - 1
                i, j = np.nonzero(top(score, k) & (score >= _LEAST))
                for o, a in zip(out, (ids[rows][i], ids[x][j], score[i, j])):
                    o.append(a)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["query_id", "vec_id", "score"])

    return run


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, pivots: int | None = None, block_rows: int = 4096, block_queries: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k rows of vectors with the highest integer inner product.

    pivots: how many groups; by default they grow with the root of the rows, from 32 to 512, so what the driver plans is bounded."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(vec_col).cast("array<double>")
        fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size(v) > 0) & F.col(id_col).isNotNull()
        return df.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))

    data, asked = whole(vectors), whole(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    lengths = data.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").head(1)
    if not lengths:
        return spark.createDataFrame([], schema)
    dim, n = lengths[0]["dim"], lengths[0]["count"]
    pivots = pivots or min(512, max(32, math.isqrt(n) // 8))
    data, asked = data.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    # pivots: the rows with the smallest hashes, each vector once
    pick = data.select("v", F.xxhash64("v", "vec_id").alias("h")).orderBy("h").limit(2 * pivots).collect()
    tame = [v for v in dict.fromkeys(tuple(r.v) for r in pick) if max(map(abs, v)) < 1e100]
    centre = scale * np.array(tame[:pivots] or [(0.0,) * dim], np.float64)
    kinds = "vec_id long, v array<double>, g int, d double, len double"
    data, asked = cut(data.mapInArrow(_assign(centre, scale), kinds)), cut(asked.mapInArrow(_assign(centre, scale), kinds))
    mine = data.groupBy("g").agg(F.count("*").alias("n"), F.max("d").alias("r"), F.max("len").alias("len"))
    by_bin = data.where("d < 1e15").groupBy("g", F.floor("d").alias("bin")).agg(F.count("*").alias("n"))
    dg = {r.g: r for r in mine.collect()}
    bins: dict[int, list[tuple[float, int]]] = {}
    ranked = by_bin.withColumn("before", F.sum("n").over(W.partitionBy("g").orderBy("bin")) - F.col("n")).where(F.col("before") <= k)
    for r in ranked.collect():
        bins.setdefault(r.g, []).append((r.bin + 1.0, r.n))
    qg = {r.g: r for r in asked.groupBy("g").agg(F.count("*").alias("n"), F.max("d").alias("s"), F.max("len").alias("len")).collect()}
    norm = np.sqrt((centre**2).sum(axis=1))
    pairs = []
    for h, q in sorted(qg.items()):
        sure: list[tuple[float, int]] = []
        slack = lambda g: 1e-9 * (1 + norm[h] * norm[g] + q.s * norm[g] + q.len * (dg[g].r + norm[g]))  # noqa: E731, B023  rounding of the bounds
        for g in dg:
            mid = float(centre[h] @ centre[g]) - q.s * norm[g] - slack(g)
            sure += [(mid - q.len * d, n) for d, n in bins.get(g, []) if math.isfinite(mid - q.len * d)]
        need, floor = k + 1, -math.inf
        for low, n in sorted(sure, reverse=True):
            need -= n
            if need <= 0:
                floor = low
                break
        for g, x in sorted(dg.items()):
            if not float(centre[h] @ centre[g]) + q.s * norm[g] + q.len * x.r + slack(g) < floor:  # a bound that is no number prunes nothing
                pairs.append((h, g))
    if not pairs:
        return spark.createDataFrame([], schema)
    wanted = {g: sum(qg[h].n for h, x in pairs if x == g) for _, g in pairs}
    plan = spark.createDataFrame([(h, g, math.ceil(wanted[g] / block_queries), math.ceil(dg[g].n / block_rows)) for h, g in pairs], "h int, g int, qn int, dn int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pos = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    own = F.pmod(F.xxhash64("vec_id", "nth"), F.col("dn")).cast("int")  # rows of one id lie in many blocks
    data = data.withColumn("nth", F.monotonically_increasing_id())  # of checkpointed rows, so the same again
    # plan has at most pivots^2 rows
    left = asked.withColumnRenamed("g", "h").join(F.broadcast(plan), "h").select("vec_id", "v", "g", pos("qn").alias("qb"), each("dn").alias("db"), F.lit(0).alias("side"))
    right = data.join(F.broadcast(plan.select("g", "qn", "dn").distinct()), "g").select("vec_id", "v", "g", each("qn").alias("qb"), own.alias("db"), F.lit(1).alias("side"))
    count = partitions(spark)
    tasks = left.union(right).withColumn("key", F.xxhash64("g", "qb", "db")).select("key", "side", "vec_id", "v")
    local = tasks.repartition(count, "key").sortWithinPartitions("key").mapInArrow(_solve(k, dim, scale), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
