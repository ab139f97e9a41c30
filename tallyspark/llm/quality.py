"""Quality rules by compression bands: zstandard ratios of the whole text and of fixed chunks.

Repetitive text compresses far better than prose, noise hardly at all. Short texts compress
worse whatever they say, so the limits depend on the length: each quarter of an octave of
lengths has limits of its own, drawn around the corpus's median ratio there. Texts are packed in
Arrow batches without a shuffle; what is shuffled for the limits are counts of rounded ratios.
Lengths of which the corpus has too few texts to say what is usual have wide fixed limits.
"""

from __future__ import annotations

import zstandard
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, materialize, slices

#: Where the corpus says too little: (bytes from, least ratio, most ratio) of original to compressed size; the last row that applies counts.
DOCUMENT_BANDS = ((0, 0.0, 3.5), (256, 1.2, 4.0), (512, 1.35, 4.0), (1024, 1.5, 4.5), (4096, 1.8, 5.0), (16384, 2.0, 6.0), (65536, 2.2, 8.0))
#: Limits lie so many spreads (median less the 16th percentile) from the median, and this share of the median at least.
SPREADS, LEAST_SHARE = 4.0, 0.08
#: Texts, or chunks, that pass the base rules and tell what is usual; fewer leave the fixed limits.
LEAST_TEXTS = 50
#: Ratios are counted in steps of 1 / RATIO_STEPS up to MOST_RATIO.
RATIO_STEPS, MOST_RATIO = 500, 50
#: Chunks are this long; the last one ends with the text and may overlap the one before. At most this share of them may lie outside the chunk band.
CHUNK_BYTES, CHUNK_BAND, CHUNK_SHARE = 2048, (1.75, 5.0), 0.25
LEVEL = 3
#: Base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
#: Bytes that begin no code point; counting the others needs no valid UTF-8.
CONTINUATION = bytes(range(0x80, 0xC0))

_ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_bytes long, ratio double, chunks array<float>"


def chunk_starts(n_bytes: int) -> list[int]:
    starts = list(range(0, n_bytes - CHUNK_BYTES + 1, CHUNK_BYTES))
    return starts + [n_bytes - CHUNK_BYTES] if starts and n_bytes % CHUNK_BYTES else starts


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that stand in the text twice or more, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    if v < 2_000_000:  # three ids fit 63 bits
        grams = (at[:-2] * v + at[1:-1]) * v + at[2:]
    else:
        pairs = np.unique(at[:-2] * v + at[1:-1], return_inverse=True)[1]
        grams = pairs * v + at[2:]
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    inside = np.zeros(n, bool)
    inside[:-2] |= twice
    inside[1:-1] |= twice
    inside[2:] |= twice
    return int(inside.sum())


def judge(text: bytes, packer: zstandard.ZstdCompressor) -> tuple:
    words = text.split()  # bytes.split() parts at ASCII white space only
    n = len(words)
    word_chars = sum(map(len, words)) - (0 if text.isascii() else len(text) - len(text.translate(None, CONTINUATION)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    duplicates = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    base_failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED_PERCENT * n
    ratio = len(text) / len(packer.compress(text)) if text else 0.0
    sizes = [len(packer.compress(text[i : i + CHUNK_BYTES])) for i in chunk_starts(len(text))]
    return n, word_chars, symbols, duplicates, repeats, base_failed, len(text), ratio, [CHUNK_BYTES / s for s in sizes]


def _limits(ratios: DataFrame, *by: str) -> DataFrame:
    """ratios(*by, r) → (*by, low, high) where there are enough of them. Counted by rounded ratio first, so that the order of rows doesn't matter and few rows are shuffled."""
    steps = F.round(F.least(F.col("r").cast("double"), F.lit(float(MOST_RATIO))) * RATIO_STEPS) / RATIO_STEPS
    counts = ratios.select(*by, steps.alias("r")).groupBy(*by, "r").agg(F.count("*").alias("n"))
    usual = counts.groupBy(*by).agg(F.expr("percentile(r, array(0.16, 0.5), n)").alias("p"), F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    away = F.greatest(SPREADS * (F.col("p")[1] - F.col("p")[0]), LEAST_SHARE * F.col("p")[1])
    return usual.select(*by, (F.col("p")[1] - away).alias("low"), (F.col("p")[1] + away).alias("high"))


def quality(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and, for its whole text (null: empty): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, the compression ratio, low and high (its limits), n_chunks and n_bad_chunks (outside the chunks' limits), the reason of a rejection (null: kept) and kept.

    Empty texts have no words and fail the base rules. Limits come from all rows of docs that
    pass the base rules. Bytes that are not UTF-8 belong to words, and count as code points unless
    they look like the rest of one. Repeated rows count as often as they stand there and get the same
    verdict, null ids stay null, other columns are ignored, and an empty table gives an empty
    result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    schema = extended(rows.select("doc_id"), _ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch, _, _ in slices(batches):
            found = [judge(t, packer) for t in batch.column(1).to_pylist()]
            columns = list(zip(*found, strict=True))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.float64(), pa.list_(pa.float32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=schema.names)

    length = F.when(F.col("n_bytes") > 0, F.floor(4 * F.log2("n_bytes"))).otherwise(F.lit(0)).cast("int")
    judged = materialize(rows.mapInArrow(run, schema).withColumn("length", length), "ratios")
    usual = judged.where(~F.col("base_failed"))
    by_length = _limits(usual.select("length", F.col("ratio").alias("r")), "length")  # a few hundred rows
    of_chunks = _limits(usual.select(F.explode("chunks").alias("r"))).select(F.col("low").alias("chunk_low"), F.col("high").alias("chunk_high"))  # one row or none
    found = judged.join(F.broadcast(by_length), "length", "left").join(F.broadcast(of_chunks), F.lit(True), "left")
    fixed = lambda k: F.coalesce(*[F.when(F.col("n_bytes") >= b[0], b[k]) for b in reversed(DOCUMENT_BANDS)])
    found = found.withColumns({"low": F.coalesce("low", fixed(1)), "high": F.coalesce("high", fixed(2)), "chunk_low": F.coalesce("chunk_low", F.lit(CHUNK_BAND[0])), "chunk_high": F.coalesce("chunk_high", F.lit(CHUNK_BAND[1]))})
    found = found.withColumns({"n_chunks": F.size("chunks").cast("long"), "n_bad_chunks": F.size(F.filter("chunks", lambda c: (c < F.col("chunk_low")) | (c > F.col("chunk_high")))).cast("long")})
    reason = F.when(F.col("base_failed"), "base").when(F.col("ratio") > F.col("high"), "repetitive").when(F.col("ratio") < F.col("low"), "incompressible").when(F.col("n_bad_chunks") > CHUNK_SHARE * F.col("n_chunks"), "chunks")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "low", "high", "n_chunks", "n_bad_chunks", reason.alias("reason"), reason.isNull().alias("kept"))
