"""Source divergence audit: how far the sources of a language lie apart in the words they use.

A byte-level tokenizer finds terms in the concatenated UTF-8 buffers of a batch with a lookup
table; equal terms are grouped by the xxhash of their slices and verified byte by byte. What is
shuffled are counts by (lang, source, term). The terms that enough documents of a language show
are dealt into blocks, and each block of a language is a sparse matrix of sources by terms
(CSR) in one task: the sums over its rows are reduceat sums, and the blocks' sums are added up.
A block is bounded by its number of counts, whatever the language's share of all rows; many
sources are dealt into tiles of rows besides. Probabilities are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, byte_class, materialize, small_side, slices, word_spans

#: `[^\x00-\x40\x5B-\x60\x7B-\x7F]`
TERM = byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Documents of a language that show a term, the count added to every term, what probabilities are parts of, and terms listed for a source.
MIN_DOCS, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of text counted at once.
COUNT_BYTES = 1 << 23
#: Counts (source, term) in a block, the least and the most; between, about as many as there are pairs of sources, so that a block gives back no more rows than it gets.
LEAST_BLOCK, MOST_BLOCK = 1 << 18, 1 << 22
#: Sources whose divergences from all others one task sums up.
TILE = 1024


# ------------------------------------------------------------------ terms


def grouped(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, ids): of each different slice of data the place of one that has its bytes, and for each slice which of these it equals.

    Slices are grouped by hash; every slice is then compared with its group's first one byte by
    byte, and those that only share its hash are told apart by their bytes.
    """
    whole, hash_of = memoryview(data), xxhash.xxh3_64_intdigest
    hashes = np.fromiter((hash_of(whole[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, len(starts))
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = stops - starts
    rep = first[ids]
    other = lengths != lengths[rep]
    same = np.flatnonzero(~other)
    if len(same):
        heads = np.cumsum(lengths[same]) - lengths[same]
        rel = np.arange(int(lengths[same].sum())) - np.repeat(heads, lengths[same])
        differs = data[np.repeat(starts[same], lengths[same]) + rel] != data[np.repeat(starts[rep[same]], lengths[same]) + rel]
        other[same] = np.add.reduceat(differs, heads, dtype=np.int64) > 0
    if other.any():
        more: dict[bytes, int] = {}
        first = first.tolist()
        for i in np.flatnonzero(other).tolist():
            word = bytes(whole[starts[i] : stops[i]])
            if word not in more:
                more[word] = len(first)
                first.append(i)
            ids[i] = more[word]
        first = np.array(first, np.int64)
    return first, ids


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The sorted distinct keys, and for each array of values its sums over them."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[heads], *[np.add.reduceat(v[order], heads) for v in values]


def term_counts(docs: DataFrame) -> DataFrame:
    """docs(lang, source, text), none null → (lang, source, term, n, docs): occurrences, and documents that show the term."""
    schema = "lang string, source string, term string, n bigint, docs bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in slices(batches, "text", COUNT_BYTES):
            data = LOWER[data]
            starts, stops, at = word_spans(data, ends, TERM)
            if not len(starts):
                continue
            first, ids = grouped(data, starts, stops)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(at))
            group = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], names=["lang", "source"])
            groups: dict[tuple, int] = {}
            of_doc = np.array([groups.setdefault((g["lang"], g["source"]), len(groups)) for g in group.to_pylist()])
            v = len(first)
            in_doc, n = _sums(doc * v + ids, np.ones(len(ids), np.int64))
            key, n, shown = _sums(of_doc[in_doc // v] * v + in_doc % v, n, np.ones(len(n), np.int64))
            names, slot, term = list(groups), key // v, key % v
            from_, lengths = starts[first], stops[first] - starts[first]
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            flat = data[np.repeat(from_ - offsets[:-1], lengths) + np.arange(offsets[-1])]
            words = pa.Array.from_buffers(pa.string(), v, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            side = lambda k: pa.array([g[k] for g in names], pa.string()).take(pa.array(slot))
            yield pa.RecordBatch.from_arrays([side(0), side(1), words.take(pa.array(term)), pa.array(n), pa.array(shown)], names=["lang", "source", "term", "n", "docs"])

    return docs.select("lang", "source", "text").mapInArrow(run, schema)


# ------------------------------------------------------------------ divergences


def probabilities(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + ADDED) / total), exactly: divided in steps of 1000, so that nothing leaves 64 bits for totals below 9 * 10**15."""
    q, r = np.divmod(counts + ADDED, totals)
    left = SCALE
    while left > 1:
        more, r = np.divmod(r * 1000, totals)
        q = q * 1000 + more
        left //= 1000
    return q + 1


def _block(counts: pa.Table, groups: pa.Table, tile: range) -> tuple[list, list]:
    """One block of a language: counts(source, term, n) and groups(source, total, lang_total) of all its sources.

    Returns (source, other, value) sums for the tile's sources against those after them, and the
    (source, term, value) terms by which the tile's sources lie above the language.
    """
    names = groups.column("source").to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i].encode())
    names = [names[i] for i in order]
    totals = groups.column("total").to_numpy()[order]
    where = {s: i for i, s in enumerate(names)}
    own = counts.column("source").combine_chunks().dictionary_encode()
    if isinstance(own, pa.ChunkedArray):
        own = own.combine_chunks()
    row = np.array([where[s] for s in own.dictionary.to_pylist()], np.int64)[own.indices.to_numpy()]
    terms = counts.column("term").combine_chunks().dictionary_encode()
    if isinstance(terms, pa.ChunkedArray):
        terms = terms.combine_chunks()
    column, vocabulary = terms.indices.to_numpy().astype(np.int64), terms.dictionary
    n, width = counts.column("n").to_numpy(), len(vocabulary)
    lang_p = probabilities(_by_column(column, n, width), np.int64(groups.column("lang_total")[0].as_py()))
    # CSR: the counts by source, and where each source's begin.
    by_row = np.lexsort((column, row))
    column, n, row = column[by_row], n[by_row], row[by_row]
    begin = np.searchsorted(row, np.arange(len(names) + 1))
    p = probabilities(n, totals[row])
    zero = probabilities(np.zeros(len(names), np.int64), totals)
    pairs, above = [], []
    for a in tile[: max(0, len(names) - tile.start)]:
        mine = slice(begin[a], begin[a + 1])
        over = p[mine] - lang_p[column[mine]]
        if len(over):
            best = _largest(over, vocabulary, column[mine])
            above += [(names[a], t, v) for t, v in best]
        if a + 1 == len(names):
            continue
        dense = np.full(width, zero[a])
        dense[column[mine]] = p[mine]
        # All terms as if the other source had none of them, then mended where it has.
        ordered = np.sort(dense)
        sums = np.concatenate(([0], np.cumsum(ordered)))
        base = zero[a + 1 :]
        less = np.searchsorted(ordered, base)
        total = base * less - sums[less] + (sums[-1] - sums[less]) - base * (width - less)
        rest = slice(begin[a + 1], None)
        if len(p[rest]):
            here = dense[column[rest]]
            mend = np.abs(here - p[rest]) - np.abs(here - zero[row[rest]])
            heads = begin[a + 1 : -1] - begin[a + 1]
            some = np.flatnonzero(np.diff(np.append(heads, len(mend))))
            total[some] += np.add.reduceat(mend, heads[some])
        pairs += [(names[a], names[b], v) for b, v in zip(range(a + 1, len(names)), total.tolist(), strict=True)]
    return pairs, above


def _by_column(column: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Sums of n by column, as integers."""
    order = np.argsort(column, kind="stable")
    heads = np.searchsorted(column[order], np.arange(width))
    return np.add.reduceat(n[order], heads)


def _largest(values: np.ndarray, vocabulary: pa.Array, column: np.ndarray) -> list[tuple[str, int]]:
    """The TOP largest values over 0 with their terms, and all that are as large as the last of them."""
    if (least := len(values) - TOP) > 0:
        keep = np.flatnonzero(values >= max(1, np.partition(values, least)[least]))
    else:
        keep = np.flatnonzero(values > 0)
    return list(zip(vocabulary.take(pa.array(column[keep])).to_pylist(), values[keep].tolist(), strict=True))


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, block: int = LEAST_BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): for every (lang, source) of docs its divergence from each other source of the language (part `pair`), and the terms by which it lies above the language most (part `term`, the first `top`).

    A language keeps the terms that min_docs of its documents show. p of a kept term is 1 + floor(SCALE *
    (count + ADDED) / (N + ADDED * V)), N the counts' sum over the V kept terms; a pair's value is
    the sum of |p - q| over all kept terms, 0 without any. Ranks go by value, then by the item's
    bytes. Null texts, langs and sources count as empty ones; groups without terms are groups
    too, a language with one source has no pairs, repeated rows count as often as they stand
    there, an empty table gives an empty result and other columns are ignored.
    """
    if top > TOP:
        raise ValueError(f"at most {TOP} terms are listed")
    plain = lambda c: F.make_valid_utf8(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).alias("text"))
    counts = materialize(term_counts(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")
    kept = materialize(kept, "kept")
    used = materialize(counts.select("lang", "source", "term", "n").join(small_side(kept), ["lang", "term"]), "used")
    groups = materialize(rows.select("lang", "source").distinct(), "groups")
    size = used.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("entries"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    full = groups.join(size, ["lang", "source"], "left").join(vocabulary, "lang", "left").select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "entries", "v")])
    by_lang = full.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("entries").alias("entries"), F.count("*").alias("sources"))
    full = full.drop("entries").join(by_lang, "lang").select("lang", "source", (F.col("n") + ADDED * F.col("v")).alias("total"), (F.col("lang_n") + ADDED * F.col("v")).alias("lang_total"), "v", "entries", "sources")
    full = materialize(full, "totals")
    size = F.greatest(F.lit(block), F.least(F.lit(MOST_BLOCK), F.col("sources") * F.col("sources")))
    dealt = full.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("entries") / size)).cast("int")).withColumn("tiles", F.ceil(F.col("sources") / F.lit(tile)).cast("int"))
    shape = dealt.select("lang", "blocks", "tiles").distinct()
    each_tile = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")
    entries = used.join(small_side(materialize(shape, "shape")), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), each_tile, "source", "term", "n")
    totals = dealt.where("v > 0").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "total", "lang_total", "tiles").select("lang", "block", each_tile, "source", "total", "lang_total")

    def summed(key: tuple, own: pa.Table, of: pa.Table) -> pa.Table:
        name, at = key[0].as_py(), key[2].as_py() * tile
        pairs, above = _block(own, of, range(at, at + tile)) if own.num_rows else ([], [])
        found = [("pair", *x) for x in pairs] + [("term", *x) for x in above]
        part, first, second, value = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.table([pa.array([name] * len(found), pa.string()), pa.array(part, pa.string()), pa.array(first, pa.string()), pa.array(second, pa.string()), pa.array(value, pa.int64())], names=["lang", "part", "source", "item", "value"])

    keys = ["lang", "block", "tile"]
    found = materialize(entries.groupBy(*keys).cogroup(totals.groupBy(*keys)).applyInArrow(summed, "lang string, part string, source string, item string, value long"), "blocks")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # A language without kept terms has pairs all the same.
    bare = groups.join(full.where("v = 0").select("lang").distinct(), "lang", "left_semi")
    bare = bare.alias("a").join(bare.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") < F.col("b.source"))).select("a.lang", "a.source", F.col("b.source").alias("item"), F.lit(0).cast("long").alias("value"))
    one_way = materialize(sums.unionByName(bare), "pairs")
    pairs = one_way.unionByName(one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).withColumn("part", F.lit("pair"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    columns = ["lang", "source", "part", "item", "value"]
    terms = found.where("part = 'term'").select(*columns).withColumn("rank", place).where(F.col("rank") <= top)
    return pairs.select(*columns).withColumn("rank", place).unionByName(terms).select(*columns, F.col("rank").cast("int").alias("rank"))

