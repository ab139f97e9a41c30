"""Benchmark decontamination on built-in functions only.

The benchmark's word windows form a hash set whose size is checked. A small one travels to every
task inside the plan; of a larger one a Bloom filter of bounded size does, as one row. Either is
looked up inside the row a text stands in, so texts are never shuffled and nothing but windows
that may be hits is written; those are verified on the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content_key, materialize, small_side

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Distinct benchmark windows that may travel with the plan as a hash set.
MAX_BROADCAST_WINDOWS = 100_000
#: Bits of the filter for each window, and the most words of 64 bits it has (8 MB): beyond, more windows pass that are then found to be none.
FILTER_BITS, MAX_FILTER_WORDS = 16, 1 << 20
#: Texts with hits, each with the places of its hits, that may be broadcast where spans are removed.
MAX_BROADCAST_TEXTS = 10_000
#: Rows (window, item) that may be broadcast where hits are verified.
MAX_BROADCAST_ROWS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A-Z lower-cased words; null and empty texts have none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(gram, length, item): every window of every item, words joined by a blank; an item with fewer words, but not none, is one window."""
    w = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    return w.select("item", "w", F.explode(starts).alias("i")).select(F.array_join(F.slice("w", F.col("i"), F.lit(window)), " ").alias("gram"), F.least(F.size("w"), F.lit(window)).alias("length"), "item").distinct()


def _bit(x: Column, words: int) -> tuple[Column, Column]:
    """The word of the filter that a hash falls into, and its bit there."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 40).bitwiseAND(F.lit(63)).cast("int"))
    return x.bitwiseAND(F.lit(words - 1)).cast("int"), bit


def _filter_of(hashes: DataFrame, n: int) -> tuple[DataFrame, int]:
    """One row with the bits of n hashes(h) in words of 64, written; and the number of words."""
    words = 1 << min(MAX_FILTER_WORDS.bit_length() - 1, max(4, (FILTER_BITS * n // 64).bit_length()))
    word, bit = _bit(F.col("x"), words)
    some = hashes.select(F.explode(F.array("h", F.xxhash64("h"))).alias("x")).groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b"))
    all_words = hashes.sparkSession.range(words).select(F.col("id").cast("int").alias("w")).join(some, "w", "left")
    bits = F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))))
    return materialize(all_words.agg(F.transform(bits, lambda s: s["b"]).alias("_bits")), "filter"), words


def _may_hold(bits: Column, h: Column, words: int) -> Column:
    found = F.lit(True)
    for x in (h, F.xxhash64(h)):
        word, bit = _bit(x, words)
        found = found & (F.get(bits, word).bitwiseAND(bit) != 0)
    return found


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", max_broadcast: int = MAX_BROADCAST_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(per_text, of_items).

    per_text has key and n_words for every row of docs and, where one of the benchmark's windows
    stands in the text, hit_words: the sorted places (from 1) of its words. of_items has (key,
    item) for every item with a window in a text of that key. Equal texts share a key; null
    texts count as empty.
    """
    grams = materialize(benchmark_windows(benchmark, window, item_id), "grams")
    by_length = {r.length: (r.n, r.rows) for r in grams.groupBy("length").agg(F.count_distinct("gram").alias("n"), F.count("*").alias("rows")).collect()}  # at most `window` rows
    base = docs.select(content_key(F.col(text)).alias("key"), words(F.col(text)).alias("w"))
    hashed = grams.select("length", F.xxhash64(F.split("gram", " ")).alias("h")).distinct()
    n = sum(x for x, _ in by_length.values())
    if n > max_broadcast:
        bits, size = _filter_of(hashed.select("h"), n)
        base = base.crossJoin(F.broadcast(bits))  # one row
        passes = {length: lambda h: _may_hold(F.col("_bits"), h, size) for length in by_length}
    else:
        sets: dict[int, list[int]] = {}
        for r in hashed.collect():  # bounded by max_broadcast
            sets.setdefault(r.length, []).append(r.h)
        passes = {length: lambda h, own=own: h.isin(own) for length, own in sets.items()}

    def found(length: int) -> Column:
        """The windows of that many words that may be hits: (at, length, gram)."""
        places = F.when(F.size("w") >= length, F.sequence(F.lit(1), F.size("w") - (length - 1))).otherwise(F.array().cast("array<int>"))
        hashes = F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("w", i, F.lit(length))).alias("h")))
        gram = lambda x: F.struct(x["at"].alias("at"), F.lit(length).alias("length"), F.array_join(F.slice("w", x["at"], F.lit(length)), " ").alias("gram"))
        return F.transform(F.filter(hashes, lambda x: passes[length](x["h"])), gram)

    none = F.array().cast("array<struct<at:int,length:int,gram:string>>")
    scanned = materialize(base.select("key", F.size("w").cast("long").alias("n_words"), F.concat(none, *map(found, sorted(by_length))).alias("found")), "scan")
    # Copies share a key: one row of each is enough from here on.
    spans = scanned.where(F.size("found") > 0).groupBy("key").agg(F.first("found").alias("found"))
    spans = spans.select("key", F.explode("found").alias("f")).select("key", "f.at", "f.length", "f.gram")
    few = sum(rows for _, rows in by_length.values()) <= MAX_BROADCAST_ROWS
    known = grams.select("gram").distinct()
    verified = materialize(spans.join(F.broadcast(known) if few else known, "gram", "left_semi"), "hits")
    places = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)))))
    per_key = verified.groupBy("key").agg(places.alias("hit_words"))
    listed = grams.select("gram", "item")
    of_items = verified.select("key", "gram").distinct().join(F.broadcast(listed) if few else listed, "gram").select("key", "item").distinct()
    return scanned.select("key", "n_words").distinct().join(per_key, "key", "left"), of_items


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings) and contaminated of every row of docs.

    Null texts have no words. Items without words, or a benchmark without rows, hit nothing;
    items with a null id count, as an empty id. Repeated rows are judged alike, columns other
    than doc_id and text are ignored.
    """
    bench = benchmark.withColumn(item_id, F.coalesce(F.col(item_id).cast("string"), F.lit("")))
    per_text, of_items = hits(docs, bench, window, text, item_id, max_broadcast)
    items = of_items.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per_text = per_text.join(items, "key", "left").select("key", "n_words", F.coalesce(F.size("hit_words"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    per_text = per_text.withColumn("n_hit", F.greatest("n_hit", F.lit(0)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), content_key(F.col(text)).alias("key"))
    return rows.join(per_text, "key").select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """The rows of docs, all columns, whose text has no window of the benchmark; rows with null or empty texts stay."""
    _, of_items = hits(docs, benchmark.withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit(""))), window, text, "item_id", max_broadcast)
    keyed = docs.withColumn("_key", content_key(F.col(text)))
    bad = materialize(of_items.select(F.col("key").alias("_key")).distinct(), "bad")
    return keyed.join(small_side(bad), "_key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """The rows of docs with the hit words taken out of their texts; texts that hit nothing are left as they are."""
    per_text, _ = hits(docs, benchmark.withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit(""))), window, text, "item_id", max_broadcast)
    bad = materialize(per_text.where(F.col("hit_words").isNotNull()).select(F.col("key").alias("_key"), "hit_words"), "bad")
    rows = docs.withColumn("_key", content_key(F.col(text))).join(small_side(bad, MAX_BROADCAST_TEXTS), "_key", "left")
    own = F.regexp_extract_all(F.col(text), F.lit(_ANY_CASE), F.lit(0))
    kept = F.transform(own, lambda w, i: F.when(F.array_contains("hit_words", i + 1), F.lit("")).otherwise(w))
    glue = F.split(F.col(text), _ANY_CASE, -1)
    rebuilt = F.concat(F.element_at(glue, 1), F.array_join(F.transform(kept, lambda w, i: F.concat(w, F.element_at(glue, i + 2))), ""))
    return rows.withColumn(text, F.when(F.col("hit_words").isNull(), F.col(text)).otherwise(rebuilt)).select(*[F.col(f"`{c}`") for c in docs.columns])


#: WORD before lower-casing.
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
