"""Exact top-k inner products by a Voronoi kNN join.

Vectors become integers floor(256 x).  With M the largest squared norm, the extra coordinate sqrt(M - |s|^2) of a
candidate (0 for a query) makes the squared distance |q|^2 + M - 2 <q, s>, so the highest scores are the
nearest neighbours in that space.

1. Pivots: a bounded hash sample of the distinct candidate vectors.  Each query and each candidate belongs to its nearest pivot.
2. Summaries: per query cell the largest distance to its pivot; per candidate cell the least and largest distance and a
   histogram of distances (``BUCKETS`` counts at most).
3. Bounds, from the summaries alone: for query cell i, theta_i is a distance within which every query of the cell has
   k + 1 candidates (one may be the query itself).  A candidate s of cell j can only matter to cell i if
   |p_i p_j| - U_i - theta_i <= |s p_j| <= |p_i p_j| + U_i + theta_i.
4. Only those candidates are replicated to the cell, once per ``QUERY_BLOCK`` of its queries, cut into blocks of ``ROWS_PER_TASK`` by
   hash; a task solves its queries against one block of candidates exactly, ``QUERY_STEP`` at a time, and the k best per query are
   kept before the last shuffle.

Equal vectors are stored once with their k + 1 smallest ids (more can't be in a top k), so a vector shared
by a third of all rows is one candidate.

Defined cases: null vectors and those with null or non-finite components take no part; shorter vectors count as
padded with zeros; equal rows (id and vector) count once; candidates with the query's own id are left out; an id with
two vectors is two rows; a null vec_id is a candidate, after all ids, and never a query; no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.llm.common import materialize, parallelism, table

K = 5
SCALE = 256
QUERY_EVERY = 50
QUERIES_PER_PIVOT = 128
MAX_PIVOTS = 256
BUCKETS = 64
#: queries of a cell that share one copy of its candidates; a larger cell is split so that a task stays bounded
QUERY_BLOCK = 8192
#: queries scored against a block of candidates at once
QUERY_STEP = 256
ROWS_PER_TASK = 4096
#: distances are compared with this relative slack, far above the error of double arithmetic
SLACK = 1e-9


def integer_vector(embedding: Column) -> Column:
    """floor(256 x) of each component; null for a vector that takes no part."""
    values = F.transform(embedding, lambda x: x.cast("double"))
    usable = embedding.isNotNull() & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(values, lambda x: F.floor(x * SCALE)))


def _matrix(vectors: pd.Series | list, dim: int, dtype=np.float64) -> np.ndarray:
    out = np.zeros((len(vectors), dim), dtype)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T) + (extra[:, None] - pivot_extra[None, :]) ** 2
    return np.sqrt(np.maximum(square, 0))


def _assign(df: DataFrame, dim: int, top: float, pivots: np.ndarray, pivot_extra: np.ndarray, query: bool) -> DataFrame:
    """df (id columns and v) plus its nearest pivot and the distance to it."""
    def run(batches):
        for pdf in batches:
            x = _matrix(pdf["v"], dim)
            extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(top - (x * x).sum(1), 0))
            d = _distances(x, extra, pivots, pivot_extra)
            cell = d.argmin(1) if len(d) else np.empty(0, np.int64)
            yield pdf.assign(cell=cell.astype(np.int32), dist=d[np.arange(len(d)), cell])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", cell int, dist double"
    return df.mapInPandas(run, schema)


def _scores(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Exact integer products; doubles hold them unless the vectors are very long."""
    most = float(np.sqrt((q * q).sum(1).max(initial=0)) * np.sqrt((s * s).sum(1).max(initial=0)))
    if most < 2.0 ** 52:
        return (q @ s.T).astype(np.int64)
    if most >= 2.0 ** 63:
        raise OverflowError("an inner product does not fit in a long")
    return q.astype(np.int64) @ s.astype(np.int64).T


def voronoi_top_k(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, max_pivots: int = MAX_PIVOTS,
                  queries_per_pivot: int = QUERIES_PER_PIVOT, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every vec_id divisible by ``query_every``.

    ``vectors`` has vec_id and v (array of long).
    """
    spark = vectors.sparkSession
    rows = materialize(vectors.where("v IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("vec_id"), "v",
                                                              F.xxhash64("v").alias("vh")).distinct(), "knn-rows")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    is_query = F.col("vec_id") % query_every == 0
    n_queries, dim, top = rows.agg(F.count_if(is_query), F.max(F.size("v")), F.max(square)).first()
    result = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not n_queries:
        return spark.createDataFrame([], result)

    # one candidate per distinct vector; the group limit of this window is applied before its shuffle
    order = Window.partitionBy("vh", "v").orderBy(F.col("vec_id").asc_nulls_last())
    kept = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    distinct = materialize(kept.groupBy("vh", "v").agg(F.collect_list("vec_id").alias("ids"), F.count_if(F.col("vec_id").isNull()).alias("nulls"))
                           .select("v", F.concat(F.sort_array("ids"), F.when(F.col("nulls") > 0, F.array(F.lit(None).cast("bigint")))
                                                 .otherwise(F.array().cast("array<bigint>"))).alias("ids")), "knn-candidates")
    n_pivots = int(min(max_pivots, max(2, math.ceil(n_queries / queries_per_pivot))))
    pivots = _matrix([r.v for r in distinct.orderBy(F.xxhash64("v"), "v").limit(n_pivots).select("v").collect()], dim)
    pivot_extra = np.sqrt(np.maximum(top - (pivots * pivots).sum(1), 0))

    queries = materialize(_assign(rows.where(is_query).select("vec_id", "v"), dim, top, pivots, pivot_extra, True), "knn-queries")
    data = materialize(_assign(distinct.withColumn("n", F.size("ids")), dim, top, pivots, pivot_extra, False), "knn-data")

    # summaries: at most max_pivots rows, and max_pivots * BUCKETS
    radius = {r.cell: (r.u, r.n) for r in queries.groupBy("cell").agg(F.max("dist").alias("u"), F.count(F.lit(1)).alias("n")).collect()}
    unit = max(2.0 * math.sqrt(top), 1.0) * (1 + SLACK) / BUCKETS
    hist = data.groupBy("cell", F.floor(F.col("dist") / unit).alias("b")).agg(F.max("dist").alias("far"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    between = _distances(pivots, pivot_extra, pivots, pivot_extra)
    slack = SLACK * max(math.sqrt(top), 1.0)
    bounds = []
    for i, (u, n) in sorted(radius.items()):
        theta, found = math.inf, 0
        for reach, count in sorted((u + between[i, r.cell] + r.far, r.n) for r in hist):
            found += count
            if found >= k + 1:
                theta = reach + slack
                break
        reach = theta + u + slack
        near = sum(r.rows for r in hist if r.far >= between[i, r.cell] - reach)
        blocks = max(1, math.ceil(near / rows_per_task))
        bounds += [(i, int(j), float(between[i, j] - reach), float(between[i, j] + reach), blocks, math.ceil(n / QUERY_BLOCK)) for j in range(len(pivots))]
    bounds = spark.createDataFrame(bounds, "to_cell int, cell int, low double, high double, blocks int, parts int")
    bounds = F.broadcast(bounds)  # at most max_pivots ** 2 rows

    key = ["to_cell", "part", "block"]
    sent = (data.join(bounds, "cell").where(F.col("dist").between(F.col("low"), F.col("high")))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("to_cell", "part", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block"), "v", "ids"))
    sizes = bounds.select("to_cell", "blocks", "parts").distinct()
    asked = (queries.select(F.col("cell").alias("to_cell"), "vec_id", "v")
             .join(F.broadcast(sizes), "to_cell")
             .withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*key, "vec_id", "v"))

    def solve(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "row": [], "vec_id": [], "score": []}
        if len(q) and len(s):
            a, b = _matrix(q["v"], dim), _matrix(s["v"], dim)
            first = [list(ids) for ids in s["ids"]]
            for i, own in enumerate(q["vec_id"]):
                if i % QUERY_STEP == 0:
                    scores = _scores(a[i:i + QUERY_STEP], b)
                row = scores[i % QUERY_STEP]
                take = min(len(row), k + 1)  # each vector has at least one id; one of them may be the query's own
                cut = np.partition(row, len(row) - take)[len(row) - take]
                best = [(-int(row[j]), math.inf if x is None or x != x else int(x)) for j in np.flatnonzero(row >= cut) for x in first[j] if x != own]
                for score, x in sorted(best)[:k]:
                    out["query_id"].append(own)
                    out["row"].append(i)
                    out["vec_id"].append(None if x == math.inf else x)
                    out["score"].append(-score)
        got = pd.DataFrame(out)
        got["v"] = pd.Series([q["v"].iloc[i] for i in out["row"]], dtype=object)
        got["vec_id"] = pd.array(out["vec_id"], dtype="Int64")
        got = got[["query_id", "v", "vec_id", "score"]]
        return got if len(got) else pd.DataFrame()  # an empty column of vectors has no type to convert

    n_parts = parallelism(spark)
    pairs = (asked.repartition(n_parts, *key).groupBy(*key).cogroup(sent.repartition(n_parts, *key).groupBy(*key))
             .applyInPandas(solve, "query_id bigint, v array<bigint>, vec_id bigint, score bigint"))
    best = Window.partitionBy("query_id", "v").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return voronoi_top_k(rows.select("vec_id", integer_vector(F.col("embedding")).alias("v")))


SQL = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
     q AS (SELECT vec_id AS query_id, v AS qv FROM e WHERE vec_id % 50 = 0),
     s AS (SELECT query_id, vec_id,
                  list_sum(list_transform(list_zip(qv, v), lambda p: p[1] * p[2]))::BIGINT AS score
           FROM q JOIN e ON vec_id <> query_id),
     r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
