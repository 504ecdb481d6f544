"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors become integers. Rows are dealt by hash into blocks of about BLOCK_ROWS; each block keeps one list for
each dimension, sorted by component, which is read from one end or the other by the sign of the query's
component. The bounds are those of lists read to the same depth, but they are tested on a full scan: every component of
every row is multiplied by the query's first, and a depth only says which products count as read. What counts as read gives each row a lower
bound (unread components at the list's far end) and an upper bound (unread components at the reading position);
rows whose upper bound lies below the k-th lower bound are out, and so is every row not read at all once the sum of the
reading positions lies below it. The depth grows by DEPTHS until few rows are left or the last depth is reached; the scores of the rows left are
then resolved exactly. The k best of each block are merged by a grouped aggregation that keeps k.

Queries come in blocks too, and each pair of a query block and a row block is a group of bounded size.

Defined results: vectors that are null, or hold null or components that aren't finite, take no part, neither as
rows nor as queries; vectors of different length aren't compared; equal vectors tie and the smaller id wins; a row
isn't a result of its own query; rows and queries that repeat an id or are equal count as often as they occur, as in a
join, and the results of a repeated query id are ranked together; null ids take no part; with
fewer than k rows all are returned; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, QUERY_ROWS = 8192, 4096
SCALE = 256


def _usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


class Block:
    """The rows of a block, and the values of their list for each dimension."""

    #: Parts of the lists that are read before bounds are compared; which comes first is learned from earlier queries.
    DEPTHS = (1 / 8, 1 / 4, 1 / 2, 3 / 4)

    def __init__(self, ids: np.ndarray, rows: np.ndarray, copies: np.ndarray | None = None) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.copies = np.ones(len(ids), np.int64) if copies is None else copies[order]
        self.sorted = np.sort(self.rows, axis=0)
        self.ones = np.ones(rows.shape[1], rows.dtype)
        self.buffer = np.empty_like(self.rows)
        self.start = 2

    def best(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The places and exact scores of the k best rows, ties to the smaller id."""
        n, up = len(self.rows), q > 0
        left = np.arange(n)
        if n > 8 * k and q.any():
            far = np.where(up, self.sorted[0], self.sorted[-1]) * q
            c = np.multiply(self.rows, q, out=self.buffer)
            for step in range(self.start, len(self.DEPTHS)):
                depth = max(1, int(n * self.DEPTHS[step]))
                edge = np.where(up, self.sorted[n - depth], self.sorted[depth - 1]) * q  # contributions at the reading position
                upper = np.maximum(c, edge) @ self.ones  # unread components count as the reading position's
                leaders = np.argpartition(upper, n - 8 * k)[n - 8 * k :] if step == self.start else leaders
                lower = np.where(c[leaders] >= edge, c[leaders], far) @ self.ones
                lower = lower[self.ids[left[leaders]] != own]
                least = np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) >= k else -np.inf
                kept = upper >= least
                kept[leaders] = True
                share = kept.mean()
                if step == self.start:
                    self.start = min(2, self.start + 1) if share > 0.5 else max(0, self.start - 1) if share < 0.01 else self.start
                c, left = c[kept], left[kept]
                leaders, n_left = np.flatnonzero(np.isin(np.flatnonzero(kept), leaders)), len(left)
                if n_left <= max(16 * k, n // 16):
                    break
        left = left[self.ids[left] != own]
        scores = self.rows[left] @ q
        first = np.lexsort((self.ids[left], -scores))[:k]
        return left[first], scores[first]


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.array(flat.flatten()).reshape(n, -1)
    # floating products and sums of whole numbers are exact below 2 ** 53, and faster
    peak = float(np.abs(x).max(initial=0))
    return x.astype(np.float32) if peak * peak * max(1, x.shape[1]) < 1 << 24 else x.astype(np.float64) if peak * peak * max(1, x.shape[1]) < 1 << 53 else x.astype(object)


def search(rows: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest integer inner product for each query."""
    def whole(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
        return df.filter(_usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(vector_col).alias("dims")).groupBy("id", "v", "dims").agg(F.count("*").alias("copies"))

    one, two = whole(rows), whole(queries)
    blocks = max(1, -(-one.count() // BLOCK_ROWS))
    query_blocks = max(1, -(-two.count() // QUERY_ROWS))
    dealt = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    left = one.withColumn("b", dealt(blocks)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = two.withColumn("q", dealt(query_blocks)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not block.num_rows or not asked.num_rows:
            return pa.table({x: pa.array([], pa.int64()) for x in names})
        x, q = _matrix(block["v"], block.num_rows), _matrix(asked["v"], asked.num_rows)
        kind = np.result_type(x, q) if x.dtype != q.dtype else x.dtype
        held = Block(np.array(block["id"]), x.astype(kind), np.array(block["copies"]))
        ids, found, scores = [], [], []
        for own, v, times in zip(np.array(asked["id"]), q.astype(kind), np.array(asked["copies"]), strict=True):
            at, score = held.best(v, own, k)
            copies = np.minimum(held.copies[at] * times, k)
            at, score = np.repeat(at, copies)[:k], np.repeat(score, copies)[:k]
            ids.append(np.full(len(at), own))
            found.append(held.ids[at])
            scores.append(score.astype(np.int64))
        return pa.table(dict(zip(names, map(np.concatenate, (ids, found, scores)), strict=True)))

    keys = ["dims", "b", "q"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, r.v)]) AS BIGINT) AS score
      FROM v AS q JOIN v AS r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
