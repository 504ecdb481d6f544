"""Merkle fixity audit of WARC replicas.

Records lie in shards of SHARD consecutive ids, in id order. A leaf hashes all that a replica holds for one id, and its
size; an inner node hashes the numbers, the ordered ranges of offsets (from its own begin on) and the hashes of the up to
FANOUT children that exist; the last level of a shard is its root, and the shards' roots are hashed on into one root for
each replica. The audit compares the replicas' roots first, then the shards', and descends only where hashes differ, down
to the records, so that what is compared below the roots grows with the damage and not with the archive.

Defined results: null ids form a shard of their own; a null url or body counts as empty; equal records of an id count by
their number, different ones are all part of the id's leaf; empty replicas have no shards; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARD, FANOUT, LEVELS = 4096, 16, 3  # FANOUT ** LEVELS == SHARD


def record(url: Column, body: Column) -> Column:
    """The bytes of a response record, as text."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """shard, node, id, hash, start, stop: one leaf for each id, with its range of offsets in the shard's file."""
    made = pages.select(F.col(id_col).alias("id"), record(F.col(url_col), F.col(body_col)).alias("r"))
    single = made.select("id", F.sha2("r", 256).alias("h"), F.octet_length("r").cast("long").alias("size")).groupBy("id", "h", "size").agg(F.count("*").alias("n"))
    # a sum of digests in four parts stands for any number of records, in any order, and is added up before the shuffle
    _summed = [F.sum(F.conv(F.substr("h", F.lit(1 + 15 * i), F.lit(15)), 16, 10).cast("decimal(20,0)") * F.col("n")).cast("string") for i in range(4)]
    each = single.groupBy("id").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sha2(F.concat_ws(":", F.count("*"), F.sum(F.col("size") * F.col("n")), *_summed), 256).alias("hash"))
    placed = each.select(F.floor(F.col("id") / SHARD).alias("shard"), F.pmod("id", F.lit(SHARD)).cast("int").alias("node"), "id", "hash", "size")
    before = F.sum("size").over(Window.partitionBy("shard").orderBy("node"))
    return placed.select("shard", "node", "id", "hash", (before - F.col("size")).alias("start"), before.alias("stop"))


def parents(level: DataFrame) -> DataFrame:
    """The next level: nodes over up to FANOUT children."""
    children = F.sort_array(F.collect_list(F.struct("node", "start", "stop", "hash")))
    ranged = lambda c: F.concat_ws(":", c["node"], c["start"] - F.min("start"), c["stop"] - F.min("start"), c["hash"])
    return level.groupBy("shard", F.floor(F.col("node") / FANOUT).cast("int").alias("node")).agg(F.sha2(F.array_join(F.transform(children, ranged), ","), 256).alias("hash"), F.min("start").alias("start"), F.max("stop").alias("stop"))


def tree(pages: DataFrame, label: str, **columns) -> list[DataFrame]:
    """The levels from leaves to roots, each written once."""
    levels = [materialize(leaves(pages, **columns), f"warc-{label}")]
    for _ in range(LEVELS):
        levels.append(materialize(parents(levels[-1]), f"warc-{label}"))
    return levels


def replica_root(shards: DataFrame) -> str:
    """One hash of all shard roots, by levels of up to SHARD of them. Null shards come first."""
    rows = shards.select("shard", "hash")
    while rows.limit(SHARD + 1).count() > SHARD:
        children = F.sort_array(F.collect_list(F.struct("shard", "hash")))
        rows = rows.groupBy(F.floor(F.col("shard") / SHARD).alias("up")).agg(F.sha2(F.to_json(children), 256).alias("hash")).select(F.col("up").alias("shard"), "hash")
    children = F.sort_array(F.collect_list(F.struct("shard", "hash")))
    return rows.agg(F.sha2(F.to_json(children), 256)).first()[0]


def audit(one: list[DataFrame], two: list[DataFrame]) -> DataFrame:
    """id, kind (changed, missing or extra in the second replica), offsets of both (-1 where a replica has none): the records that differ."""
    wrong = None
    if replica_root(one[-1]) == replica_root(two[-1]):  # nothing differs, and nothing is read below
        one, two = ([level.limit(0) for level in levels] for levels in (one, two))
    for a, b in zip(reversed(one), reversed(two), strict=True):
        own = a.withColumn("up", F.floor(F.col("node") / FANOUT).cast("int"))
        other = b.withColumn("up", F.floor(F.col("node") / FANOUT).cast("int"))
        if wrong is not None:  # only below nodes that differ
            same = lambda x: x["shard"].eqNullSafe(wrong["w_shard"]) & (x["up"] == wrong["w_node"])
            own, other = own.join(wrong, same(own), "left_semi"), other.join(wrong, same(other), "left_semi")
        own, other = own.alias("a"), other.alias("b")
        joined = own.join(other, F.col("a.shard").eqNullSafe(F.col("b.shard")) & (F.col("a.node") == F.col("b.node")), "full").filter(~F.col("a.hash").eqNullSafe(F.col("b.hash")))
        if a is one[0]:
            kind = F.when(F.col("b.hash").isNull(), "missing").when(F.col("a.hash").isNull(), "extra").otherwise("changed")
            return joined.select(F.coalesce("a.id", "b.id").alias("id"), kind.alias("kind"), *[F.coalesce(f"{r}.{c}", F.lit(-1).cast("long")).alias(f"{c}_{r}") for r in "ab" for c in ("start", "stop")])
        wrong = joined.select(F.when(F.col("a.hash").isNull(), F.col("b.shard")).otherwise(F.col("a.shard")).alias("w_shard"), F.coalesce("a.node", "b.node").alias("w_node"))
    raise AssertionError


def damaged(pages: DataFrame, *, id_col: str = "page_id", body_col: str = "html") -> DataFrame:
    """A replica as a failing disk might leave it, by rule: some bodies changed or cut, some records lost."""
    i, body = F.col(id_col), F.col(body_col)
    broken = F.when(i % 97 == 3, F.concat(F.lit("#"), F.substr(body, F.lit(2)))).when(i % 89 == 5, F.left(body, F.lit(100))).otherwise(body)
    return pages.filter(F.coalesce(i % 101 != 7, F.lit(True))).withColumn(body_col, broken)


_RECORD = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"
ORACLE_SQL = f"""
WITH a AS (SELECT page_id, {_RECORD} AS r FROM pages),
b AS (SELECT page_id, {_RECORD} AS r FROM (SELECT page_id, url, CASE WHEN page_id % 97 = 3 THEN '#' || substr(html, 2) WHEN page_id % 89 = 5 THEN left(html, 100) ELSE html END AS html FROM pages WHERE page_id % 101 <> 7)),
pa AS (SELECT *, CAST(sum(strlen(r)) OVER (PARTITION BY page_id // 4096 ORDER BY page_id) AS BIGINT) AS stop FROM a),
pb AS (SELECT *, CAST(sum(strlen(r)) OVER (PARTITION BY page_id // 4096 ORDER BY page_id) AS BIGINT) AS stop FROM b)
SELECT pa.page_id, CASE WHEN pb.r IS NULL THEN 'missing' ELSE 'changed' END AS kind, pa.stop - strlen(pa.r) AS start_a, pa.stop AS stop_a, coalesce(pb.stop - strlen(pb.r), -1) AS start_b, coalesce(pb.stop, -1) AS stop_b
FROM pa LEFT JOIN pb USING (page_id) WHERE pa.r IS DISTINCT FROM pb.r
"""
