"""Nearest neighbours by a block matrix join.

Queries (a stated set) meet all other rows in blocks: candidates are hashed into blocks of about ``tile`` rows, queries
into groups of about ``tile`` rows, and each (group, block) pair is one cogrouped task. There the vectors are quantised
to int8 codes with one scale a row; the product of the code tiles approximates every inner product, and with the norms
of what quantisation dropped, Cauchy-Schwarz bounds the error. A pair survives if its upper bound reaches the k-th
largest lower bound of its query; survivors are recomputed in double precision from the original vectors, so the
answer is exact. Best-k lists are merged by heaps within a task and by a ranked window across tasks.

Rows are brought to a largest component between 0.5 and 1 by a power of two before they are coded, and the powers are kept
apart, so bounds hold for any finite components. A product that may leave the range of doubles always survives, and what
underflow may cost is part of the error bound: the score in double precision decides, infinite or not, and a score that
is no number (of infinite parts with both signs) stands before all others.

Every query group meets every block, so the work and the rows sent grow with queries x candidates: a block is sent once
for each ``tile`` queries.

Vectors that are null, zero or hold null or non-finite components take no part; vectors only meet others of the same
length. Rows that repeat an id are rows of their own, each with its own neighbours, but a query never meets a row with
its own id. Rows that repeat id and vector are searched once and told as often as they occur, so a vector that a third
of the table repeats is no hot block. With fewer than k candidates all are returned. Ties go to the smaller id. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import cut, table

TILE = 4096
#: q tells queries apart, times is how often a query's row occurs, copies how often the found row does (k at most).
FOUND = "g int, q bigint, query_id bigint, times bigint, vec_id bigint, copies bigint, score double"


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, v (doubles), dim of the rows that take part."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    out = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).filter("v is not null and vec_id is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return out.filter(finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    v = t.column("v").combine_chunks()
    values = v.flatten().to_numpy(zero_copy_only=False)
    return t.column("vec_id").to_numpy(), values.reshape(t.num_rows, -1)


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the rows divided by a power of two, their scale, the norm of what they stand for, the norm of what
    they miss, and the power."""
    _, power = np.frexp(np.abs(x).max(axis=1))
    x = np.ldexp(x, -power[:, None])
    scale = np.abs(x).max(axis=1) / 127
    code = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    back = code * scale[:, None]
    return code, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1), power.astype(np.int64)


def tile_top(k: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def top(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        ids, found = pa.schema([("g", pa.int32()), *((c, pa.int64()) for c in ("q", "query_id", "times", "vec_id", "copies")), ("score", pa.float64())]), []
        if not queries.num_rows or not rows.num_rows:
            return ids.empty_table()
        qid, q = _matrix(queries)
        cid, c = _matrix(rows)
        row, times, copies = (t.column(n).to_numpy() for t, n in ((queries, "q"), (queries, "times"), (rows, "copies")))
        code_c, scale_c, norm_c, miss_c, power_c = _codes(c)
        exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # holds every sum of products of codes
        tile_c = code_c.astype(exact).T
        most = power_c.max()
        weight = np.ldexp(1.0, power_c - most)  # of a row against the tile's largest; a query's own power changes no order
        digits = int(np.ceil(np.log2(q.shape[1]))) + 1
        for a in range(0, len(qid), 256):
            code, scale, norm, miss, power = _codes(q[a : a + 256])
            near = (code.astype(exact) @ tile_c).astype(np.float64) * scale[:, None] * scale_c * weight
            slack = (norm[:, None] + miss[:, None]) * miss_c + miss[:, None] * norm_c
            slack = (slack + 1e-9 * (norm[:, None] + miss[:, None]) * (norm_c + miss_c)) * weight  # rounding of the bounds themselves
            with np.errstate(over="ignore"):
                slack += np.ldexp(float(q.shape[1]), -1074 - power - most)[:, None] + np.finfo(np.float64).tiny  # underflow
            slack[power[:, None] + power_c + digits >= 1023] = np.inf  # may overflow
            own = qid[a : a + 256, None] == cid
            low = np.where(own, -np.inf, near - slack)
            least = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] > k else np.full(len(low), -np.inf)
            i, j = np.nonzero((near + slack >= least[:, None]) & ~own)
            score = np.zeros(len(i))
            with np.errstate(over="ignore", invalid="ignore"):
                for d in range(q.shape[1]):
                    score += q[a + i, d] * c[j, d]
            none = np.isnan(score)
            order = np.lexsort((cid[j], np.where(none, 0, -score), ~none, i))
            i, j, score = i[order], j[order], score[order]
            first = np.searchsorted(i, i)
            keep = np.arange(len(i)) - first < k
            at = a + i[keep]
            found.append((row[at], qid[at], times[at], cid[j[keep]], copies[j[keep]], score[keep]))
        cols = [np.concatenate(x) for x in zip(*found)]
        return pa.table([pa.array(np.full(len(cols[0]), key[0].as_py(), np.int32)), *map(pa.array, cols)], schema=ids)

    return top


def heaps(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges the best-k lists that a task has made, keeping one query group in memory at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list[tuple[bool, float, int, int]]] = {}
        group = None

        def flush() -> pa.RecordBatch:
            cols = zip(*((*q, -v, n, float("nan") if none else s) for q, found in best.items() for none, s, v, n in found))
            ids = [pa.array(c, pa.float64() if k == 5 else pa.int64()) for k, c in enumerate(cols)]
            return pa.RecordBatch.from_arrays([pa.array([group] * len(ids[0]), pa.int32()), *ids], names)

        names = ["g", "q", "query_id", "times", "vec_id", "copies", "score"]
        for batch in batches:
            for g, *q, v, n, s in zip(*(batch.column(c).to_pylist() for c in names)):
                if g != group:
                    if best:
                        yield flush()
                        best.clear()
                    group = g
                heap = best.setdefault(tuple(q), [])
                item = (s != s, 0.0 if s != s else s, -v, n)  # the worst stands first: lowest score, then largest id
                if len(heap) < k:
                    heapq.heappush(heap, item)
                else:
                    heapq.heappushpop(heap, item)
        if best:
            yield flush()

    return merge


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, tile: int = TILE) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row whose id ``every`` divides."""
    rows = cut(usable(vectors).groupBy("vec_id", "v", "dim").agg(F.count("*").alias("times")), "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    blocks, groups = max(1, -(-n // tile)), max(1, -(-n_queries // tile))
    spread = rows.withColumn("s", F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(blocks)).cast("int"))
    spread = spread.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("copies", F.least("times", F.lit(k)))
    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("q", F.xxhash64("vec_id", "v"))
    asked = asked.withColumn("g", F.pmod(F.xxhash64("vec_id", "v", F.lit(2)), F.lit(groups)).cast("int"))
    asked = asked.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    by = ["g", "s", "dim"]
    found = asked.groupBy(*by).cogroup(spread.groupBy(*by)).applyInArrow(tile_top(k), FOUND).mapInArrow(heaps(k), FOUND)
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return each.withColumn("time", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
