"""Sharding by extendible hashing.

A directory maps prefixes of a hash to shards. It starts with one bucket; a bucket above the
byte limit is split on its next hash bit, and only such buckets are, until every shard fits.
Bytes are summed per prefix of the current oversized buckets only, so each round aggregates
what is still too large, and what the driver sees is one row per bucket: about twice the
bytes divided by the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path

LIMIT_BYTES = 1 << 20
#: Bits of the hash. Rows that agree in all of them can't be separated.
HASH_BITS = 60
#: Bits by which one round looks ahead.
ROUND_BITS = 10


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits as a string of 0 and 1; equal rows agree."""
    digest = F.md5(F.concat_ws("\x00", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.lpad(F.conv(F.substring(digest, 1, 15), 16, 2), HASH_BITS, "0")


def _split(sums: DataFrame, limit: int, depth: int, bits: int) -> DataFrame:
    """Buckets (prefix, bytes, rows) that stand after splitting on up to `bits` more bits. sums: (h, bytes, rows) with h of depth + bits bits."""
    levels = F.explode(F.sequence(F.lit(depth), F.lit(depth + bits))).alias("d")
    nodes = sums.select("h", "bytes", "rows", levels).groupBy(F.substring("h", F.lit(1), F.col("d")).alias("prefix"), "d").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    parent = nodes.select(F.col("prefix").alias("up"), (F.col("d") + 1).alias("d"), F.col("bytes").alias("up_bytes"), F.col("rows").alias("up_rows"))
    # A node stands if its parent had to be split and it fits itself (or bits ran out). Sizes only shrink downwards, so the parent decides for all above it.
    n = nodes.withColumn("up", F.when(F.col("d") > depth, F.substring("prefix", F.lit(1), F.col("d") - 1)))
    n = n.join(parent, ["up", "d"], "left")
    fits = (F.col("bytes") <= limit) | (F.col("d") == depth + bits) | (F.col("rows") == 1)
    stands = (F.col("d") == depth) | ((F.col("up_bytes") > limit) & (F.col("up_rows") > 1))
    return n.where(stands & fits).select("prefix", "bytes", "rows")


def shard_directory(sizes: DataFrame, limit: int = LIMIT_BYTES, max_bits: int = HASH_BITS) -> DataFrame:
    """(prefix, bytes, rows) of the shards of sizes(h, bytes). Prefixes are free of each other and cover all hashes."""
    done, depth = None, 0
    open_rows = sizes
    while True:
        bits = min(ROUND_BITS, max_bits - depth)
        at = depth + bits
        sums = open_rows.groupBy(F.substring("h", F.lit(1), F.lit(at)).alias("h")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        level = materialize(_split(sums, limit, depth, bits), "directory")
        large = (F.col("bytes") > limit) & (F.col("rows") > 1) & (F.length("prefix") == at)
        last = at >= max_bits
        fit = level if last else level.where(~large)
        done = fit if done is None else done.unionByName(fit)
        if last or level.where(large).isEmpty():
            return done
        over = level.where(large).select(F.col("prefix").alias("p"))
        open_rows = materialize(open_rows.join(over, F.substring("h", F.lit(1), F.lit(at)) == F.col("p"), "left_semi"), "open")
        depth = at


def assign_shards(docs: DataFrame, limit: int = LIMIT_BYTES, text: str = "text", doc_id: str = "doc_id", max_bits: int = HASH_BITS) -> DataFrame:
    """doc_id, n_bytes, shard (the hash prefix; empty for the only shard), depth, shard_bytes, shard_docs for every row of docs.

    No shard has more bytes than limit, unless a single row does, or equal rows (same doc_id
    and text) do together: those can't be told apart by a hash and stay in one shard. Null
    texts have 0 bytes, null ids are ids like others, an empty table gives an empty result,
    other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), row_hash(F.col(doc_id), F.col(text)).alias("h"))
    rows = materialize(rows, "sizes")
    shards = materialize(shard_directory(rows.select("h", F.col("n_bytes").alias("bytes")), limit, max_bits), "shards")
    return _located(rows, shards).select("doc_id", "n_bytes", F.col("prefix").alias("shard"), F.length("prefix").alias("depth"), F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_docs"))


def _located(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """rows(h, ...) with their shard. The directory says which depths exist; a row looks up its prefix of each."""
    depths = [r.d for r in shards.select(F.length("prefix").alias("d")).distinct().orderBy("d").collect()]  # at most HASH_BITS + 1
    if not depths:
        return rows.join(shards, F.lit(False))
    looked = rows.withColumn("_p", F.explode(F.array(*[F.substring("h", F.lit(1), F.lit(d)) for d in depths])))
    return looked.join(shards, looked._p == F.col("prefix"))


def sharded_documents(docs: DataFrame, limit: int = LIMIT_BYTES, **options) -> DataFrame:
    """The rows of docs, all columns, with shard, shard_bytes and shard_docs."""
    keyed = docs.withColumn("_h", row_hash(F.col("doc_id"), F.col("text")))
    sizes = materialize(docs.select(row_hash(F.col("doc_id"), F.col("text")).alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")), "sizes")
    shards = materialize(shard_directory(sizes, limit, **options), "shards")
    at = _located(sizes.select("h").distinct(), shards).select(F.col("h").alias("_h"), F.col("prefix").alias("_shard"), F.col("bytes").alias("_bytes"), F.col("rows").alias("_rows"))
    kept = [c for c in docs.columns if c not in ("shard", "shard_bytes", "shard_docs")]
    return keyed.join(at, "_h").select(*[F.col(f"`{c}`") for c in kept], F.col("_shard").alias("shard"), F.col("_bytes").alias("shard_bytes"), F.col("_rows").alias("shard_docs"))


def write_shards(docs: DataFrame, path: str | None = None, limit: int = LIMIT_BYTES) -> str:
    """Writes docs as Parquet, one folder `shard=...` with one file for each shard; returns the path."""
    path = path or new_path(docs.sparkSession, "shards")
    out = sharded_documents(docs, limit).withColumn("shard", F.concat(F.lit("p"), "shard"))
    out.repartition("shard").write.partitionBy("shard").parquet(path)
    return path
