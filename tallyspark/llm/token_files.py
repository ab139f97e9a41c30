"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A shard file is a plain sequence of records, each framed as

    length of the payload   8 bytes, little-endian unsigned
    masked CRC-32C of these 4 bytes
    payload
    masked CRC-32C of it    4 bytes

which readers of the widespread framed-record format understand. The payload is one sequence of
ids, little-endian unsigned 16 or 32 bits wide, packed with zstandard if so asked. The index
is a table with a row for each record: which shard, at what offset, how many ids, and how many
ids stand before it in the shard; with it records are read in any order.

Every attempt of a task writes a file of its own name, and the index says which one holds a
record. The index is committed by Spark, so an attempt that is lost or repeated leaves at most
a file that no row of the index names; nothing is ever renamed or replaced.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import extended, new_path, slices

END_ID = 1
#: Words whose ids a worker remembers; beyond that it starts anew.
MAX_CACHED_WORDS = 1_300_000

#: Bytes of text that are encoded at once: the more, the fewer distinct words among them.
PASS_BYTES = 8 << 20

# Fixed values of CRC-32C (reflected polynomial) and of the mask that framed records use.
CRC32C_POLYNOMIAL, MASK_DELTA, MASK_SHIFT = 0x82F63B78, 0xA282EAD8, 15
_BLOCK = 64


# ------------------------------------------------------------------ checksums


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per place in a block of 64 bytes the checksum of each byte there (64 x 256); per k the effect of 2**k blocks of zeros on each byte of a checksum (40 x 4 x 256)."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(CRC32C_POLYNOMIAL), one >> 1)
    places = np.zeros((_BLOCK, 256), np.uint32)
    places[_BLOCK - 1] = one
    for i in range(_BLOCK - 2, -1, -1):
        places[i] = (places[i + 1] >> 8) ^ one[places[i + 1] & 255]

    def zeros(x: np.ndarray, n: int) -> np.ndarray:
        for _ in range(n):
            x = (x >> 8) ^ one[x & 255]
        return x

    skips = np.zeros((40, 4, 256), np.uint32)
    for b in range(4):
        skips[0, b] = zeros(np.arange(256, dtype=np.uint32) << np.uint32(8 * b), _BLOCK)
    for k in range(1, 40):
        for b in range(4):
            skips[k, b] = _skip(skips[k - 1], skips[k - 1, b])
    return places, skips


def _skip(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part, all parts at once. A checksum is linear: blocks are summed apart and moved to their place."""
    places, skips = _tables()
    out = np.zeros(len(parts), np.uint32)
    lengths = np.array([len(p) for p in parts], np.int64)
    few = [i for i, n in enumerate(lengths) if n < 4]
    for i in few:  # too short for the block form
        x = 0xFFFFFFFF
        for byte in parts[i]:
            x = (x >> 8) ^ int(places[_BLOCK - 1][(x ^ byte) & 255])
        out[i] = x ^ 0xFFFFFFFF
    many = np.flatnonzero(lengths >= 4)
    if not len(many):
        return out
    blocks = (lengths[many] + _BLOCK - 1) // _BLOCK
    first = np.cumsum(blocks) - blocks
    grid = np.zeros((int(blocks.sum()), _BLOCK), np.uint8)
    flat = grid.reshape(-1)
    for k, i in enumerate(many):  # zeros in front change nothing; the start value is the inverse of the first four bytes
        end = (first[k] + blocks[k]) * _BLOCK
        at = end - lengths[i]
        flat[at:end] = np.frombuffer(parts[i], np.uint8)
        flat[at : at + 4] ^= 0xFF
    sums = np.zeros(len(grid), np.uint32)
    for place in range(_BLOCK):
        sums ^= places[place][grid[:, place]]
    behind = np.repeat(first + blocks, blocks) - np.arange(len(grid)) - 1
    for bit in range(int(behind.max()).bit_length()):
        some = np.flatnonzero((behind >> bit) & 1)
        sums[some] = _skip(skips[bit], sums[some])
    out[many] = np.bitwise_xor.reduceat(sums, first) ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(MASK_SHIFT)) | (crc << np.uint32(32 - MASK_SHIFT))) + np.uint32(MASK_DELTA)


def frame(payloads: list[bytes]) -> list[bytes]:
    heads = [len(p).to_bytes(8, "little") for p in payloads]
    with np.errstate(over="ignore"):
        of_heads, of_bodies = masked(crc32c(heads)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [b"".join((h, a.tobytes(), p, b.tobytes())) for h, a, p, b in zip(heads, of_heads, payloads, of_bodies, strict=True)]


def unframe(records: list[bytes]) -> list[bytes]:
    """Payloads of framed records; ValueError where a length or a checksum is wrong."""
    heads, bodies = [r[:8] for r in records], [r[12:-4] for r in records]
    for r, b in zip(records, bodies, strict=True):
        if len(r) < 16 or int.from_bytes(r[:8], "little") != len(b):
            raise ValueError("a record's length is wrong")
    with np.errstate(over="ignore"):
        said = np.array([[int.from_bytes(r[8:12], "little"), int.from_bytes(r[-4:], "little")] for r in records], np.uint32).reshape(-1, 2)
        if (said[:, 0] != masked(crc32c(heads))).any() or (said[:, 1] != masked(crc32c(bodies))).any():
            raise ValueError("a record's checksum is wrong")
    return bodies


# ------------------------------------------------------------------ encoding


# How the public file of words with word ends normalises and parts texts.
SPLIT_BY_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    None,
    "</w>",
)


class Encoder:
    """Ids of whole texts by a tokenizers file; where it drops white space, words are encoded once and remembered.

    Exact, because white space parts a text before anything else: the ids of a text are those of
    its words, one after another. Only words are joined into longer strings for the library, and
    only such whose number of end-of-word tokens is known, which is checked. Files that
    normalise or part texts in another way than SPLIT_BY_WORDS encode whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_words = (spec["normalizer"], spec["pre_tokenizer"], spec["post_processor"], spec["model"].get("end_of_word_suffix")) == SPLIT_BY_WORDS
        self.letters: dict[str, bool] = {}
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.marks = {m: self.tokenizer.encode(m.decode(), add_special_tokens=False).ids for m in (b".", b",")}
        self.clear()

    def clear(self) -> None:
        """What is remembered: a row for each word, and of each row where its ids stand in one long array. Row 0 is the end of a text."""
        self.row: dict[bytes, int] = {_END: 0}
        self.flat, self.used = np.full(1 << 16, END_ID, np.uint32), 1
        self.start, self.count, self.rows = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64), 1

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Rows of new words, whose ids follow one another."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.rows + len(counts) > len(self.start):
            self.start, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.count))
        self.flat[self.used : self.used + len(ids)] = ids
        new = np.arange(self.rows, self.rows + len(counts))
        self.start[new] = self.used + np.cumsum(counts) - counts
        self.count[new] = counts
        self.used, self.rows = self.used + len(ids), self.rows + len(counts)
        return new

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.count[rows]
        ends = np.cumsum(counts)
        return self.flat[np.repeat(self.start[rows] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)], counts

    def _alone(self, words: list[bytes]) -> None:
        if words:
            got = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
            rows = self._add(np.fromiter(chain.from_iterable(got), np.uint32), np.array([len(x) for x in got], np.int64))
            self.row.update(zip(words, rows.tolist(), strict=True))

    def _letters(self, word: bytes) -> bool:
        """Whether the tokenizer sees nothing but letters in the word, as it normalises it: then a mark behind it is a word of its own. Asked once for each character."""
        if word.isascii():
            return word.isalpha()
        for c in (seen := self.tokenizer.normalizer.normalize_str(word.decode("utf-8", "replace"))):
            if c not in self.letters:
                parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(c + ".")
                self.letters[c] = len(parts) == 2 and c.isalpha()
            if not self.letters[c]:
                return False
        return bool(seen)

    def learn(self, words: list[bytes]) -> None:
        """Adds the words, which are new, to what is remembered."""
        odd, same, marked = [], [], []
        known, marks = self.row, self.marks
        fresh: dict[bytes, None] = {}
        for w in words:
            base = low = w.lower()  # A-Z only, which the tokenizer lowers as well
            mark = low[-1:]
            if mark in marks:
                base = low[:-1]
            if not self._letters(base):
                odd.append(w)
                continue
            if base not in known:
                fresh[base] = None
            if base is not low:
                marked.append((w, base, mark))
            elif w != base:
                same.append((w, base))
        bases = list(fresh)
        parts = [bases[at : at + 1000] for at in range(0, len(bases), 1000)]
        encoded = self.tokenizer.encode_batch_fast([b" ".join(part).decode("utf-8", "replace") for part in parts], add_special_tokens=False)
        for part, one in zip(parts, encoded, strict=True):
            got = np.array(one.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[got]) + 1
            # One run of letters is one word for the tokenizer, or more; as many ends as words: exactly one each.
            if len(cuts) == len(part) and cuts[-1] == len(got):
                known.update(zip(part, self._add(got, np.diff(cuts, prepend=0)).tolist(), strict=True))
            else:
                self._alone(part)
        self._alone(odd)
        known.update((w, known[base]) for w, base in same)
        for mark, tail in self.marks.items():
            own = [(w, base) for w, base, m in marked if m == mark]
            if own:
                ids, counts = self._gather(np.array([known[b] for _, b in own], np.int64))
                ids = np.insert(ids, np.repeat(np.cumsum(counts), len(tail)), np.tile(np.array(tail, np.uint32), len(own)))
                known.update(zip((w for w, _ in own), self._add(ids, counts + len(tail)).tolist(), strict=True))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, with END_ID after them."""
        if not self.by_words:
            got = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [np.array([*e.ids, END_ID], np.uint32) for e in got]
        words: list[bytes] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            words += t.split()  # bytes.split() parts at ASCII white space only
            words.append(_END)
            sizes[i] = len(words)
        sizes = np.diff(sizes, prepend=0)
        if len(self.row) > MAX_CACHED_WORDS:
            self.clear()
        # A word's place is that of its first mention; only the distinct words are looked up among all that are remembered.
        first: dict[bytes, int] = {}
        place = np.fromiter(map(first.setdefault, words, range(len(words))), np.int64, len(words))
        self.learn([w for w in first if w not in self.row])
        rows = np.zeros(len(words), np.int64)
        rows[np.fromiter(first.values(), np.int64, len(first))] = np.fromiter(map(self.row.__getitem__, first), np.int64, len(first))
        ids, counts = self._gather(rows[place])
        ends = np.cumsum(counts)[np.cumsum(sizes) - 1]
        return [ids[a:b] for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True)]


#: Stands for the end of a text among its words, none of which has white space.
_END = b" "


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


# ------------------------------------------------------------------ files


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}") if not path.startswith("file:/") else (pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"))


def pack(ids: np.ndarray, width: int, packer: zstandard.ZstdCompressor | None) -> bytes:
    raw = ids.astype("<u2" if width == 2 else "<u4").tobytes()
    return packer.compress(raw) if packer else raw


def unpack(payload: bytes, width: int, compressed: bool) -> np.ndarray:
    raw = zstandard.decompress(payload) if compressed else payload
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype(np.uint32)


def write_token_files(docs: DataFrame, tokenizer: str, path: str | None = None, compress: bool = True, text: str = "text", doc_id: str = "doc_id") -> str:
    """Encodes every whole text of docs and writes the folder: shards, index and meta.json. Returns its path.

    Documents stand in ascending order of doc_id (nulls first, equal ids by text), END_ID after
    each; null and empty texts give END_ID alone. The range of doc_id decides the shard, so no
    task holds more than one shard's slice in memory, and copies or a large source change
    nothing. Repeated rows are written as often as they stand in docs. Other columns are left out.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    width = Encoder(tokenizer).width
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    schema = extended(rows.select("doc_id"), "file string, shard int, record bigint, offset bigint, length bigint, n_tokens bigint, first_token bigint")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId()
        store, at = _store(path)
        store.create_dir(at, recursive=True)
        file = f"shard-{shard:06d}-{uuid.uuid4().hex}.rec"
        packer = zstandard.ZstdCompressor(level=1) if compress else None
        encoder = _encoder(tokenizer)
        offset = tokens = record = 0
        out = None
        try:
            for batch, data, ends in slices(batches, "text", PASS_BYTES):
                out = out or store.open_output_stream(f"{at}/{file}")
                whole = data.tobytes()
                ids = encoder.encode([whole[ends[i] : ends[i + 1]] for i in range(len(ends) - 1)])
                records = frame([pack(x, width, packer) for x in ids])
                out.write(b"".join(records))
                lengths = np.array([len(r) for r in records], np.int64)
                counts = np.array([len(x) for x in ids], np.int64)
                n = len(records)
                columns = [batch.column(0), pa.array([file] * n), pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(record, record + n)), pa.array(offset + np.cumsum(lengths) - lengths), pa.array(lengths), pa.array(counts), pa.array(tokens + np.cumsum(counts) - counts)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                offset, tokens, record = offset + int(lengths.sum()), tokens + int(counts.sum()), record + n
        finally:
            if out:
                out.close()

    rows.mapInArrow(run, schema).write.parquet(f"{path}/index")
    store_meta = spark.createDataFrame([(json.dumps({"width": width, "compressed": compress, "end_id": END_ID}),)], "value string")
    store_meta.coalesce(1).write.text(f"{path}/meta.json")
    return path


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: doc_id, file, shard, record, offset, length, n_tokens, first_token (of the shard), start (ids of all records before it, in all shards)."""
    index = spark.read.parquet(f"{path}/index")
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row for each file
    before = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return index.join(before, "shard").select(*index.columns, (F.col("before") + F.col("first_token")).alias("start"))


def read_records(index: DataFrame, path: str, added: str, make) -> DataFrame:
    """Reads the records of the rows of index, in their order, checks both checksums, and adds columns: make(ids) gives the values of `added` (a DDL string)."""
    meta = json.loads(index.sparkSession.read.text(f"{path}/meta.json").first()[0])
    schema = extended(index, added)
    kinds = [f.type for f in pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in schema.fields[len(index.columns) :]])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(path)
        files: dict[str, pa.NativeFile] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                file, offset, length = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("file", "offset", "length"))
                records, i = [], 0
                while i < len(file):
                    j = i + 1
                    while j < len(file) and file[j] == file[i] and offset[j] == offset[j - 1] + length[j - 1]:
                        j += 1
                    if file[i] not in files:
                        for f in files.values():
                            f.close()
                        files = {file[i]: store.open_input_file(f"{at}/{file[i]}")}
                    raw = files[file[i]].read_at(offset[j - 1] + length[j - 1] - offset[i], offset[i])
                    records += [raw[offset[k] - offset[i] : offset[k] - offset[i] + length[k]] for k in range(i, j)]
                    i = j
                values = [make(unpack(p, meta["width"], meta["compressed"])) for p in unframe(records)]
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(list(v), k) for v, k in zip(zip(*values, strict=True), kinds, strict=True)]], names=schema.names)

    return index.mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def digest(ids: np.ndarray) -> tuple[int, int]:
    """How many ids, and the unsigned crc32 of them as little-endian 32-bit integers."""
    return len(ids), zlib.crc32(ids.astype("<u4").tobytes())
