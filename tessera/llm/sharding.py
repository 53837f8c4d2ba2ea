"""Extendible hashing: shards are hash prefixes, and only a bucket over the byte limit is split on another bit.

Sizes are summed by prefix, twelve bits a round. The at most 4,096 sums below one prefix of the round before meet once, and
there the bits are split one after another, halves of a bucket over the limit only. Buckets that are still too large reach
the next round, so a shard is the shortest prefix whose documents fit the limit. The directory (prefix -> shard) is a table.

Defined results: the hash is of doc_id and text, so null or repeated ids don't meet in one bucket. Rows that are
repeated as a whole share a hash, and no bit can part them: where they, or one long document, exceed the limit, they
make a shard of one key with `overflow` set. A null text has 0 bytes. An empty table gives no rows. A table within the
limit is one shard, the empty prefix. Columns besides doc_id and text pass `write_shards` unread, whatever their names:
the folder's column is `shard`, or `shard_`, and so on, if there is one of that name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions

HASH_BITS, ROUND_BITS = 60, 12
LIMIT = 1 << 20


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits that any SQL engine can recompute."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(bits: int) -> Column:
    return F.expr(f"shiftright(hash, {HASH_BITS - bits})")


def settle(cell: np.ndarray, n_bytes: np.ndarray, low: np.ndarray, high: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For cells below one prefix, the bits of its shard that each has beyond the prefix, or -1, and the shard's bytes.
    low, high: the hashes of each cell."""
    width = 1 << ROUND_BITS
    at = cell & (width - 1)
    held, least, most = np.zeros(width, np.int64), np.full(width, 1 << HASH_BITS, np.int64), np.full(width, -1, np.int64)
    held[at], least[at], most[at] = n_bytes, low, high
    depth, size = np.full(width, -1), np.zeros(width, np.int64)
    for bits in range(ROUND_BITS, -1, -1):  # the shortest prefix that fits is written last
        below = width >> bits
        fits = np.repeat((held <= limit) | (least >= most), below)
        depth[fits], size[fits] = bits, np.repeat(held, below)[fits]
        if bits:
            held, least, most = held.reshape(-1, 2).sum(axis=1), least.reshape(-1, 2).min(axis=1), most.reshape(-1, 2).max(axis=1)
    return depth[at], size[at]


def _splitter(base: int, limit: int) -> Callable[[pa.Table], pa.Table]:
    def split(table: pa.Table) -> pa.Table:
        cell, n_bytes, low, high = (table.column(c).to_numpy() for c in ("cell", "n_bytes", "low", "high"))
        depth, size = settle(cell, n_bytes, low, high, limit)
        return pa.table({"cell": cell, "depth": pa.array((base + depth).astype(np.int32)), "shard_bytes": size, "overflow": pa.array(size > limit), "found": pa.array(depth >= 0)})

    return split


def directory(sizes: DataFrame, limit: int = LIMIT) -> list[tuple[int, DataFrame]]:
    """sizes: (hash, n_bytes). For each round its number of bits, and the directory of what it settled: (cell, depth,
    shard_bytes, overflow) for each prefix of so many bits that occurs."""
    rounds: list[tuple[int, DataFrame]] = []
    rest = sizes
    for bits in range(ROUND_BITS, HASH_BITS + 1, ROUND_BITS):
        cells = rest.withColumn("cell", _prefix(bits)).groupBy("cell").agg(F.sum("n_bytes").alias("n_bytes"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        found = cells.groupBy(F.expr(f"shiftright(cell, {ROUND_BITS})").alias("above")).applyInArrow(_splitter(bits - ROUND_BITS, limit), "cell long, depth int, shard_bytes long, overflow boolean, found boolean")
        found = materialize(found, "directory")
        rounds.append((bits, found.filter("found").drop("found")))
        open_cells = found.filter("not found").select("cell")
        if open_cells.isEmpty():
            break
        rest = rest.withColumn("cell", _prefix(bits)).join(open_cells, "cell", "left_semi").drop("cell")
    return rounds


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, hash, shard, depth, shard_bytes, overflow) for each row. shard: the prefix as zeros and ones."""
    rows = materialize(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), row_hash(F.col("doc_id"), F.col("text")).alias("hash")), "hashes")
    parts = [rows.withColumn("cell", _prefix(bits)).join(found, "cell").drop("cell") for bits, found in directory(rows.select("hash", "n_bytes"), limit)]
    named = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin(F.expr(f"shiftright(hash, {HASH_BITS} - depth)")), F.col("depth"), F.lit("0")))
    return reduce(DataFrame.unionByName, parts).select("doc_id", "n_bytes", "hash", named.alias("shard"), "depth", "shard_bytes", "overflow")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> str:
    """Writes `docs` to one folder a shard, shard=<prefix>, all its columns kept. Returns the name of the folder's column."""
    name = "shard"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    places = assign(docs, limit).select(F.col("hash").alias("__hash"), F.concat(F.lit("p"), "shard").alias("__shard")).distinct()
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_hash(F.col("doc_id"), F.col("text")).alias("__hash"))
    held = held.join(places, "__hash").repartition(partitions(docs.sparkSession), "__shard")
    held.select(*(F.col(f"row.`{c}`") for c in docs.columns), F.col("__shard").alias(name)).write.partitionBy(name).parquet(path)
    return name


def op3_extendible_hashing(spark: SparkSession, sf_dir: str, limit: int = LIMIT) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), limit).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "overflow")


ORACLE_SQL = f"""
WITH rows AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS hash
  FROM documents),
nodes AS (
  SELECT level, hash >> ({HASH_BITS} - level) AS node, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes,
         sum(n_bytes) <= {LIMIT} OR min(hash) = max(hash) AS fits
  FROM rows, (SELECT CAST(unnest(range(0, {HASH_BITS + 1})) AS INTEGER) AS level) GROUP BY ALL),
found AS (
  SELECT r.doc_id, r.n_bytes, r.hash, min(n.level) AS depth
  FROM rows r JOIN nodes n ON n.node = r.hash >> ({HASH_BITS} - n.level) WHERE n.fits GROUP BY ALL)
SELECT f.doc_id, f.n_bytes, CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(f.hash >> ({HASH_BITS} - f.depth)), f.depth, '0') END AS shard,
       f.depth, n.shard_bytes, n.shard_bytes > {LIMIT} AS overflow
FROM found f JOIN nodes n ON n.level = f.depth AND n.node = f.hash >> ({HASH_BITS} - f.depth)
"""
