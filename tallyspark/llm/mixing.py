"""Mixing sources to target weights by capped water-filling, on built-in functions only.

Targets are found by water-filling over one row per source. Each document is then taken a
whole number of times, and a seeded fraction of its source once more: documents stand in the
order of a seeded hash, and the last one that still fits in part gives its first words. The
running sums are cut into hash buckets, so a source with a third of all rows is summed in
thousands of tasks' worth of rows and not in one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights in turn, most repetitions of a source, and the seed of the order.
WEIGHTS, MAX_EPOCHS, SEED = (1, 2, 3), 3, "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) of sizes(source, size); one row per source.

    Sources in code point order, null last, weigh weights[0], weights[1], ... in turn. All
    sources share the total size by weight; none gets more than max_epochs times its own, and
    what is cut there is shared by the others by weight. A source without words gets 0.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at % len(weights) + 1).cast("int"))
    rows = total.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(max_epochs))
    rows = rows.withColumn("level", F.col("cap") / F.col("weight"))
    # Sources fill up in the order of cap / weight: before each of them, what is left is shared by the weights that are left.
    order = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("share", (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    rows = rows.withColumn("open", F.col("level") >= F.col("share"))
    first = F.first(F.when(F.col("open"), F.col("share")), ignorenulls=True).over(all_rows)
    return rows.select("source", "source_size", F.when(F.col("open") & first.isNotNull(), first * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, source, size, tkey (of the text), source_size, target and taken of every row of docs.

    size counts the words of the text (null: 0), taken the words the mix takes of the row,
    repeats included: whole repetitions of all documents of the source, then in the order of a
    seeded hash of doc_id one more of each until the target is met; the one on the border gives
    its first words. Rows with the same doc_id stand by size, then by text; those without an id by
    text. Of equal rows some may be taken once more than others. Null sources
    form one source, an empty table gives an empty result, other columns are ignored. No
    document is taken more than max_epochs times. Reruns give the same rows.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    tkey = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    # Rows without an id are dealt out by their texts.
    key = F.when(F.col(doc_id).isNull(), F.md5(F.concat(key, tkey.cast("string")))).otherwise(key)
    sizes = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), tkey.alias("tkey"), key.alias("key")).withColumn("bucket", F.substring("key", 1, 3)), "mix")
    per_bucket = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    to_here = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(to_here), F.lit(0)).alias("start"))
    goals = source_targets(sizes, weights, max_epochs).select(F.col("source").alias("s"), "source_size", "target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    starts = starts.join(goals, starts.s.eqNullSafe(goals.s)).select(starts.s, "b", "start", "source_size", "target", whole.alias("whole"))
    starts = starts.withColumn("extra", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    running = Window.partitionBy("source", "bucket").orderBy("key", "size", "tkey").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
    joined = placed.join(starts, placed.source.eqNullSafe(starts.s) & (placed.bucket == starts.b))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("start") - F.col("before")))
    return joined.select("doc_id", "source", "size", "tkey", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them; the last, partial one of a source is cut after its first words. Rows and columns are those of docs.

    Rows that share doc_id, source and text are taken alike, but for the one group of them on the
    border of a source's target: there as many are taken once more as the mix says. So each
    source's words come to its target, whatever ids repeat or are null.
    """
    same = ["doc_id", "source", "size", "tkey"]
    groups = mix_sources(docs, **options).groupBy(*same).agg(F.max("taken").alias("most"), F.min("taken").alias("least"), F.sum("taken").alias("sum"), F.count("*").alias("n"))
    # In a group on the border the first rows are taken most, the next one in part, the others least: their sum tells how many of each.
    over, step = F.col("sum") - F.col("n") * F.col("least"), F.nullif(F.col("most") - F.col("least"), F.lit(0))
    groups = groups.withColumns({"full": F.floor(over / step), "next": F.col("least") + over % step})
    given = materialize(groups.select(*[F.col(c).alias(f"_g_{c}") for c in same], *[F.col(c).alias(f"_{c}") for c in ("most", "least", "full", "next")]), "given")
    own = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.withColumns({"_n": own, "_t": F.xxhash64(F.coalesce("text", F.lit("")))})
    on = F.col("doc_id").eqNullSafe(F.col("_g_doc_id")) & F.col("source").cast("string").eqNullSafe(F.col("_g_source")) & (F.col("_n") == F.col("_g_size")) & (F.col("_t") == F.col("_g_tkey"))
    alike = rows.join(given.where("_full IS NULL"), on).withColumn("_taken", F.col("_most"))
    place = F.row_number().over(Window.partitionBy(*[f"_g_{c}" for c in same]).orderBy("_t"))
    mixed = rows.join(F.broadcast(given.where("_full IS NOT NULL")), on).withColumn("_at", place)  # a row for each source at most
    mixed = mixed.withColumn("_taken", F.when(F.col("_at") <= F.col("_full"), F.col("_most")).when(F.col("_at") == F.col("_full") + 1, F.col("_next")).otherwise(F.col("_least"))).drop("_at")
    rows = alike.unionByName(mixed)
    times = F.when(F.col("_n") > 0, F.floor(F.col("_taken") / F.col("_n"))).otherwise(F.lit(0)).cast("int")
    rest = F.when(F.col("_n") > 0, F.col("_taken") % F.col("_n")).otherwise(F.lit(0)).cast("int")
    copies = F.concat(F.when(times > 0, F.array_repeat(F.lit(0), times)).otherwise(F.array().cast("array<int>")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    out = rows.withColumn("_cut", F.explode(copies))
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), F.lit(1), F.greatest(F.col("_cut"), F.lit(1))), " ")
    text = F.when(F.col("_cut") == 0, F.col("text")).otherwise(words)
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_cut") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
