"""Long repeated strings by a logarithmic family of sparse suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Sampling the
suffixes keeps this exact: a window of LENGTH bytes names one place in its first REACH bytes
(that of the least hash of the 16 bytes that start there), and equal windows name the same
place. Windows next to each other mostly name the same one, so a text has about one suffix in
REACH / 2 bytes; what its windows cover is the suffix's context. Equal windows have suffixes
that agree in their first PREFIX = LENGTH - REACH + 1 bytes.

1. Suffixes whose prefix is found nowhere else can't be part of a match and are left out; a
   context that is found twice as a whole is settled at once. Both are counts over the corpus.
2. The contexts that are left (edges of matches, mostly) enter the index. A batch becomes a
   suffix array: its suffixes sorted by their text, in buckets by prefix. The array is
   merge-scanned against itself and each level: buckets of one number meet where they lie, so
   that nothing of a level is dealt out again; suffixes that agree in PREFIX bytes come side by
   side, and the windows of their contexts are matched there. Then the batch is a level; two levels
   of one size merge, bucket by bucket, into one of twice the size, so that there are never more
   than log2(batches) levels.
3. Matched windows go back to the texts that have the context.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, delete_path, materialize, mix, new_path, signed, slices, small_side, stream

LENGTH, REACH = 400, 300
GRAM = 16
#: A whole corpus enters the index in so many batches, more where they hold more than BATCH_CONTEXTS contexts.
LEAST_BATCHES, MOST_BATCHES, BATCH_CONTEXTS = 2, 16, 200_000
#: Buckets of a level at most, and contexts in a part of the prefix classes on average.
MOST_BUCKETS, PART_CONTEXTS = 4096, 4_000
#: Contexts of one prefix that one task matches at once.
MOST_CONTEXTS = 20_000
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_BYTES = stream(256, 15013)
_TWO = stream(2, 16001)


class Strings:
    """Hashes of any substring of data in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            power, self.back = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64)))) for b in (_BASE, _INVERSE))
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[:n], dtype=np.uint64)))

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Differences of sums, brought back to the power of 0, so that equal strings agree wherever they stand."""
        with np.errstate(over="ignore"):
            return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))


def sampled(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, first, last): sampled places, and the first and last start of the windows that name each. No window crosses the end of a text."""
    none = np.zeros(0, np.int64)
    n = len(data)
    sizes = np.diff(ends)
    if n < length or not (sizes >= length).any():
        return none, none, none
    padded = np.concatenate((data, np.zeros(GRAM, np.uint8)))
    eight = np.ndarray((n + 8,), "<u8", padded.data, strides=(1,))
    with np.errstate(over="ignore"):
        low = mix(eight[:n] * _TWO[0] + eight[8 : n + 8] * _TWO[1])
    value = (low & U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= reach:
        value[: n - span] = np.minimum(value[: n - span], value[span:])
        span *= 2
    rest = reach - span
    if rest:
        value[: n - rest] = np.minimum(value[: n - rest], value[rest:])
    starts = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(ends[:-1], ends[1:], strict=True) if b - a >= length])
    at = (value[starts] & U64(0xFFFFFFFF)).astype(np.int64)
    # A new run where the named place changes or a text ends.
    heads = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
    tails = np.append(heads[1:], len(starts)) - 1
    return at[heads], starts[heads], starts[tails]


def contexts(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, reach: int = REACH):
    """(owner, at, first, last, prefix, context): per sampled suffix its text, places from the text's start, and two hashes."""
    at, first, last = sampled(data, ends, length, reach)
    strings = Strings(data)
    prefix = strings.hashes(at, at + (length - reach + 1))
    with np.errstate(over="ignore"):
        context = mix(strings.hashes(first, last + length) ^ mix((at - first).astype(np.uint64) + U64(5)))
    owner = np.searchsorted(ends, at, "right") - 1
    start = ends[owner]
    return owner, at - start, first - start, last - start, prefix, context


def window_hashes(texts: list[bytes], before: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, hash) of every window of the texts. before: where the suffix starts in each; equal windows have it at the same place, so that the distance takes part in the hash."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    heads = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(texts)), counts)
    inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    start = heads[owner] + inner
    offset = np.array(before, np.int64)[owner] - inner
    with np.errstate(over="ignore"):
        return owner, inner, Strings(data).hashes(start, start + length) ^ mix(offset.astype(np.uint64) + U64(9))


def matched_windows(texts: list[bytes], before: list[int], length: int) -> list[tuple[int, int, int]]:
    """(text, from, to) for runs of windows that two or more of the texts, contexts that differ, have."""
    owner, inner, windows = window_hashes(texts, before, length)
    _, inverse, many = np.unique(windows, return_inverse=True, return_counts=True)
    at = np.flatnonzero(many[inverse] > 1)
    if not len(at):
        return []
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]]))))
    begin, end = at[new], at[np.append(new[1:] - 1, len(at) - 1)]
    return list(zip(owner[begin].tolist(), inner[begin].tolist(), inner[end].tolist(), strict=True))


_LEVEL = "part bigint, prefix bigint, suffix binary, left binary, context bigint"


def _side_by_side(rows: list[tuple[int, bytes, bytes, int, bool]], agree: int, length: int) -> list[tuple[int, int, int]]:
    """Runs of windows that suffixes share with others, rows(prefix, suffix, left, context, new) in order: neighbours of one prefix class that agree in so many bytes belong together; among old ones alone nothing is new."""
    out, start = [], 0
    for k in range(1, len(rows) + 1):
        if k < len(rows) and rows[k][0] == rows[start][0] and rows[k][1][:agree] == rows[start][1][:agree]:
            continue
        run = rows[start:k]
        if len(run) > 1 and any(new for *_, new in run):
            found = matched_windows([left + suffix for _, suffix, left, *_ in run], [len(left) for _, _, left, *_ in run], length)
            out += [(run[i][3], a, b) for i, a, b in found]
        start = k
    return out


def _rows(tables: list[tuple[pa.Table, bool]]) -> list[tuple[int, bytes, bytes, int, bool]]:
    """The rows of levels in the order of prefix class and suffix; each comes in order, so that they are merged."""
    found = []
    for t, new in tables:
        if t.num_rows:
            found += zip(*(t.column(c).to_pylist() for c in ("prefix", "suffix", "left", "context")), [new] * t.num_rows, strict=True)
    return sorted(found, key=lambda r: r[:2])


class SuffixIndex:
    """Levels of suffix arrays in the shared folder.

    A level is a table of (prefix, suffix, left, context) in buckets, sorted by part (of the prefix
    classes), prefix class and suffix text: the suffix from its sampled place to the end of its
    context, what the context has before it, and the context's hash. All levels have the same parts
    and buckets. add() takes a batch and returns the runs of matched windows.
    """

    def __init__(self, spark: SparkSession, length: int = LENGTH, reach: int = REACH, most: int = MOST_CONTEXTS, parts: int = 1):
        self.spark, self.length, self.prefix, self.most = spark, length, length - reach + 1, most
        self.buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
        self.parts = max(parts, self.buckets)
        self.levels: list[tuple[int, str]] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """batch(prefix, suffix, left, context) with distinct contexts → (context, from, to): runs of windows, counted from the context's start, that another context of the batch or of a level has; of both sides."""
        part = F.pmod(F.xxhash64("prefix"), F.lit(self.parts)).alias("part")
        new = self._write(batch.select(part, "prefix", "suffix", "left", "context").repartition(self.buckets, "part"))
        found = materialize(self._scan(new), "matches")
        self.levels.append((1, new))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * n, self._write(self.merged(a, b))))
            self._drop(a)
            self._drop(b)
        return found

    def merged(self, a: str, b: str) -> DataFrame:
        """The rows of two levels, part by part where they lie."""
        both = lambda x, y: pa.concat_tables([t for t in (x, y) if t.num_rows])
        return self.spark.table(a).groupBy("part").cogroup(self.spark.table(b).groupBy("part")).applyInArrow(both, _LEVEL)

    def _write(self, rows: DataFrame) -> str:
        """A level of rows that lie in its buckets."""
        name = f"level_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet").bucketBy(self.buckets, "part").sortBy("part", "prefix", "suffix")
        writer.option("path", new_path(self.spark, name)).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        path = self.spark.table(name).inputFiles()
        self.spark.sql(f"DROP TABLE {name}")
        if path:
            delete_path(self.spark, path[0].rpartition("/")[0])

    def drop(self) -> None:
        for _, name in self.levels:
            self._drop(name)
        self.levels = []

    def matches(self, new: str, level: str | None, sizes: DataFrame) -> DataFrame:
        """Runs of windows that a new level shares with itself, or with an older one, in prefixes of `sizes`."""
        length, agree = self.length, self.prefix
        kept = lambda name: self.spark.table(name).join(small_side(sizes), "prefix", "left_semi").groupBy("part")
        runs = "context bigint, from bigint, to bigint"

        def match(*sides: tuple[pa.Table, bool]) -> pa.Table:
            found = _side_by_side(_rows(list(sides)), agree, length) if sides[0][0].num_rows else []
            return pa.table([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ((), (), ()))], names=["context", "from", "to"])

        if level is None:
            return kept(new).applyInArrow(lambda own: match((own, True)), runs)
        return kept(new).cogroup(kept(level)).applyInArrow(lambda own, old: match((own, True), (old, False)), runs)

    def _scan(self, new: str) -> DataFrame:
        length = self.length
        both = self.spark.table(new).withColumn("new", F.lit(True))
        for _, level in self.levels:
            both = both.unionByName(self.spark.table(level).withColumn("new", F.lit(False)))
        # How many suffixes there are of each prefix of the batch, in the batch and all levels: sums come from each task, not rows.
        sizes = materialize(both.groupBy("prefix").agg(F.count("*").alias("n"), F.max("new").alias("any_new")).where("n > 1 AND any_new").drop("any_new"), "prefixes")
        few = sizes.where(F.col("n") <= self.most)
        found = self.matches(new, None, few)
        for _, level in self.levels:
            found = found.unionByName(self.matches(new, level, few))
        large = sizes.where(F.col("n") > self.most)
        if large.isEmpty():
            return found

        # A prefix with very many contexts doesn't meet in one task: its windows are counted one by one over the cluster.
        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    p, suffix, left, context = (c[i].as_py() for c in batch.columns)
                    _, inner, windows = window_hashes([left + suffix], [len(left)], length)
                    n = len(inner)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p)), pa.array(np.full(n, context)), pa.array(inner), pa.array(signed(windows))], names=["prefix", "context", "from", "window"])

        all_windows = both.join(F.broadcast(large), "prefix").select("prefix", "suffix", "left", "context")  # rows / most prefixes, no more
        all_windows = materialize(all_windows.mapInArrow(spread, "prefix bigint, context bigint, from bigint, window bigint"), "windows")
        twice = materialize(all_windows.groupBy("prefix", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "twice")
        single = all_windows.join(twice, ["prefix", "window"], "left_semi").select("context", "from", F.col("from").alias("to"))
        return found.unionByName(single)


# ------------------------------------------------------------------ a whole corpus


def _sketch(length: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in slices(batches):
            owner, _, _, _, prefix, context = contexts(data, ends, length, reach)
            if not len(owner):
                continue
            order = np.lexsort((context, owner))
            o, c, p = owner[order], context[order], prefix[order]
            head = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (c[1:] != c[:-1]))))
            n = np.diff(np.append(head, len(o)))
            yield pa.RecordBatch.from_arrays([pa.array(signed(p[head])), pa.array(signed(c[head])), batch.column(0).take(pa.array(o[head])), pa.array(n)], names=["prefix", "context", "key", "n"])

    return run


def _entries(length: int, reach: int):
    """Suffixes, with their contexts, that enter the index: of each text those whose context it lists as mixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in slices(batches):
            owner, at, first, last, prefix, context = contexts(data, ends, length, reach)
            wanted = np.asarray(batch.column(2).flatten(), np.int64)
            seen: dict[int, tuple] = {}
            for i in np.flatnonzero(np.isin(signed(context), wanted)):
                c = int(signed(context)[i])
                if c not in seen:
                    a = int(ends[owner[i]])
                    seen[c] = (int(signed(prefix)[i]), data[a + at[i] : a + last[i] + length].tobytes(), data[a + first[i] : a + at[i]].tobytes(), c)
            if seen:
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*seen.values(), strict=True), kinds, strict=True)], names=["prefix", "suffix", "left", "context"])

    return run


def _removed(length: int, reach: int, with_text: bool):
    """Per text: bytes and runs that go, and what stays. Columns: key, text, settled contexts, runs as (context, from, to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in slices(batches):
            owner, at, first, last, _, context = contexts(data, ends, length, reach)
            context = signed(context)
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            settled, runs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows = []
            for i in range(batch.num_rows):
                n = int(ends[i + 1] - ends[i])
                cover = np.zeros(n + 1, np.int32)
                whole, parts = set(settled[i] or ()), {}
                for r in runs[i] or ():
                    parts.setdefault(r["context"], []).append((r["from"], r["to"]))
                for k in range(bounds[i], bounds[i + 1]):
                    c = int(context[k])
                    if c in whole:
                        cover[first[k]] += 1
                        cover[last[k] + length] -= 1
                    else:
                        for a, b in parts.get(c, ()):
                            cover[first[k] + a] += 1
                            cover[first[k] + b + length] -= 1
                gone = np.cumsum(cover[:n]) > 0
                text = data[ends[i] : ends[i + 1]]
                kept = text[~gone].tobytes()
                n_runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
                chars = int(((text[~gone] & 0xC0) != 0x80).sum())
                rows.append((int(gone.sum()), n_runs, hashlib.sha256(kept).hexdigest(), chars, kept if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=["key", "n_removed", "n_spans", "kept_sha256", "kept_chars", "kept"])

    return run


def dedup_long_strings(docs: DataFrame, length: int = LENGTH, reach: int = REACH, batches: int | None = None, text: str = "text", doc_id: str = "doc_id", with_text: bool = False, most: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_chars of every row of docs (and kept, the bytes that stay, if asked for).

    kept_chars counts the code points that begin among the bytes that stay.

    Texts are UTF-8 bytes, null is empty. A byte goes if a string of `length` bytes covering it
    starts at another place too, in the same text or another; judged on the input. Texts shorter
    than length lose nothing. Rows with equal texts of that length lose all of it. Rows are told
    apart by nothing but their text, so null or repeated doc_ids don't matter; other columns are
    ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(whole)).alias("key"), whole.alias("text"))
    sizes = materialize(rows.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.length(F.col("text").cast("string")).cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha")), "sizes")
    long_rows = rows.where(F.octet_length("text") >= length).select("key", "text")
    sketch = long_rows.mapInArrow(_sketch(length, reach), "prefix bigint, context bigint, key binary, n bigint")
    # A text's copies count once here: they are settled by the number of rows.
    sketch = materialize(sketch.groupBy("prefix", "context", "key").agg(F.max("n").alias("n")), "sketch")
    # Sums of a prefix and of a context are aggregated before they are dealt out and come back by joins, so a frequent one is no task's burden.
    prefixes = sketch.groupBy("prefix").agg(F.sum("n").alias("total"), (F.min("context") < F.max("context")).alias("mixed")).where("total > 1").drop("total")
    shared = materialize(sketch.join(small_side(materialize(prefixes, "prefixes")), "prefix"), "shared")
    twice = shared.groupBy("context").agg(F.sum("n").alias("n")).where("n > 1").select("context", F.lit(True).alias("settled"))
    status = shared.join(small_side(materialize(twice, "twice")), "context", "left")
    status = materialize(status.select("key", "prefix", "context", F.coalesce("settled", F.lit(False)).alias("settled"), "mixed"), "status")
    lists = status.groupBy("key").agg(F.collect_list(F.when(F.col("mixed"), F.col("context"))).alias("mixed"), F.collect_list(F.when(F.col("settled"), F.col("context"))).alias("settled"))
    texts = long_rows.groupBy("key").agg(F.first("text").alias("text")).join(lists, "key")
    texts = materialize(texts.select("key", "text", "mixed", "settled"), "texts")
    entries = texts.where(F.size("mixed") > 0).select("key", "text", "mixed").mapInArrow(_entries(length, reach), "prefix bigint, suffix binary, left binary, context bigint")
    entries = materialize(entries.dropDuplicates(["context"]), "entries")
    n_entries = entries.count()
    batches = batches or min(max(LEAST_BATCHES, -(-n_entries // BATCH_CONTEXTS)), MOST_BATCHES)
    entries = entries.withColumn("batch", F.pmod(F.xxhash64("context"), F.lit(batches)))
    index, found = SuffixIndex(spark, length, reach, most, -(-n_entries // PART_CONTEXTS)), None
    for b in range(batches):
        part = index.add(entries.where(F.col("batch") == b).drop("batch"))
        found = part if found is None else found.unionByName(part)
    index.drop()
    found = found.distinct()
    runs = status.where("mixed AND NOT settled").select("key", "context").distinct().join(found, "context").groupBy("key").agg(F.collect_list(F.struct("context", "from", "to")).alias("runs"))
    judged = texts.select("key", "text", "settled").join(runs, "key", "left").select("key", "text", "settled", "runs")
    judged = judged.mapInArrow(_removed(length, reach, with_text), "key binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept_chars bigint, kept binary")
    copies = sizes.groupBy("key").agg(F.count("*").alias("copies"))
    per_key = copies.join(judged, "key", "left")
    out = sizes.join(per_key, "key")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    columns = [
        F.col("doc_id"),
        F.col("n_bytes"),
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(all_gone, F.lit(0)).otherwise(F.coalesce("kept_chars", "n_chars")).cast("long").alias("kept_chars"),
    ]
    if with_text:
        columns.append(F.when(all_gone, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept"))
    return out.select(*columns)
