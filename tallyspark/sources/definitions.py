"""Definition files, archives and models as tables; reports are read from the same files by reports.py.

Everything works on raw(project, path, content): files come from read_raw() or from a table. What
can't be read becomes an issue row, never a failure.
"""

from __future__ import annotations

import codecs
import io
import itertools
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import once
from ..functions.values import unit_of_file

# ------------------------------------------------------------------ fixed values
DEFAULT_WIDTH, DEFAULT_HEIGHT = 1280.0, 720.0
# Limits of an archive: entries, bytes of one, bytes of all.
MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL = 10_000, 256 << 20, 512 << 20
TEMPLATE_ENTRIES = ("Report/Layout", "DataModelSchema")
#: Bytes of an archive's entry that are recoded at once.
CHUNK = 1 << 20
#: Rows and bytes, more or less, that Python hands over at once.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20
#: What reading an archive may raise.
UNREADABLE = (ValueError, zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError)


def read_raw(spark: SparkSession, root: str, glob: str = "*.{json,tmdl,bim,pbit}") -> DataFrame:
    """(project, path, content) of all definition files under root, read by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    scheme = r"^[A-Za-z0-9+.-]+:(?://[^/]*)?"
    top = "/" + re.sub(scheme, "", root).strip("/") + "/"
    bare = F.regexp_replace("path", scheme, "")
    at = F.when(F.startswith(bare, F.lit(top)), F.substring(bare, F.lit(len(top) + 1), F.length(bare))).otherwise(bare)
    return files.select(F.coalesce(unit_of_file(at), F.lit("")).alias("project"), at.alias("path"), "content")


def text_of(content):
    """UTF-8 with or without a byte order mark; null where it is none."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^﻿", "")


def with_json(raw: DataFrame) -> DataFrame:
    """Adds json (text) and error: set where the file is no JSON object."""
    read = once(raw, {"_text": text_of(F.col("content"))})
    read = once(read, {"_ok": F.try_parse_json("_text").isNotNull() & F.coalesce(F.substring(F.ltrim("_text"), 1, 1) == "{", F.lit(False))})
    return read.select(*raw.columns, F.when(F.col("_ok"), F.col("_text")).alias("json"), F.when(~F.col("_ok"), F.lit("not a JSON object")).alias("error"))


# ------------------------------------------------------------------ archives


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of texts and bytes as batches of bounded rows and bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _archives(raw: DataFrame) -> DataFrame:
    return raw.where(F.lower("path").endswith(".pbit")).select("project", "path", "content")


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def unpacked(raw: DataFrame) -> DataFrame:
    """(project, path, content, error) of the two definition entries of template archives, as UTF-8, a row each. Archives that are unsafe, too large or can't be read give an error row, after the entries that were read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for project, path, content in _rows_of(batches):
            try:
                for name, data in _entries(content or b""):
                    yield project, f"{path}/{name}", data, None
            except UNREADABLE as e:
                yield project, path, None, str(e) or type(e).__name__

    schema = pa.schema([("project", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])
    return _archives(raw).mapInArrow(lambda batches: _in_batches(rows(batches), schema), "project string, path string, content binary, error string")


def archive_contents(raw: DataFrame) -> DataFrame:
    """(project, file, error, entries): a row for each archive with the names of the definition entries that were read, and why the rest could not be. Every entry is read as in unpacked, and let go."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for project, path, content in _rows_of(batches):
            names, error = [], None
            try:
                names.extend(name for name, _ in _entries(content or b""))
            except UNREADABLE as e:
                error = str(e) or type(e).__name__
            yield project, path, error, names

    schema = pa.schema([("project", pa.string()), ("file", pa.string()), ("error", pa.string()), ("entries", pa.list_(pa.string()))])
    return _archives(raw).mapInArrow(lambda batches: _in_batches(rows(batches), schema), "project string, file string, error string, entries array<string>")


def expanded(raw: DataFrame) -> DataFrame:
    """raw with the entries of its archives in their place, in the project of the archive."""
    own = unpacked(raw).where("error IS NULL").select("project", "path", "content")
    return raw.where(~F.lower("path").endswith(".pbit")).select("project", "path", "content").unionByName(own)


def _leaves(name: str) -> bool:
    return name.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", name) or ":" in re.split(r"[/\\]", name)[0]


def _entries(content: bytes, apart: tuple[str, ...] = ()) -> Iterator[tuple[str, bytes]]:
    """(name, UTF-8 content) of an archive's definition entries, one after the other; only what is read counts for the limits. Entries that the caller takes apart have no limit of their own but that of all."""
    most = lambda name: MAX_TOTAL if name in apart else MAX_ENTRY
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = z.infolist()
        if len(infos) > MAX_ENTRIES:
            raise ValueError("the archive has too many entries")
        if any(_leaves(i.filename) for i in infos):
            raise ValueError("an entry leaves the archive")
        wanted = [i for i in infos if i.filename in TEMPLATE_ENTRIES]
        if len({i.filename for i in wanted}) != len(wanted):
            raise ValueError("an entry stands twice")
        left = MAX_TOTAL
        if sum(i.file_size for i in wanted) > MAX_TOTAL or any(i.file_size > most(i.filename) for i in wanted):
            raise ValueError("the archive is too large")
        for info in sorted(wanted, key=lambda i: i.filename):
            data, read = _recoded(z, info, min(most(info.filename), left))
            left -= read
            yield info.filename, data


def _recoded(z: zipfile.ZipFile, info: zipfile.ZipInfo, most: int) -> tuple[bytes, int]:
    """An entry in UTF-8 without its mark, and its bytes as they were; read and recoded piece by piece."""
    decoder, out, size = codecs.getincrementaldecoder("utf-16-le")(), bytearray(), 0
    with z.open(info) as entry:
        while piece := entry.read(CHUNK):
            size += len(piece)
            if size > most:
                raise ValueError("the archive is too large")
            out += decoder.decode(piece).encode()
    out += decoder.decode(b"", True).encode()
    if out.startswith(codecs.BOM_UTF8):
        del out[: len(codecs.BOM_UTF8)]
    return bytes(out), size


# For the pieces of documents.
entries_of, in_batches, rows_of = _entries, _in_batches, _rows_of


# ------------------------------------------------------------------ models


def model_json(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns, measures) of model files in JSON; an expression is a text or a list of lines."""
    kind = "model STRUCT<tables: ARRAY<STRUCT<name: STRING, columns: ARRAY<STRUCT<name: STRING, dataType: STRING>>, measures: ARRAY<STRUCT<name: STRING, expression: STRING>>>>>"
    doc = with_json(raw.where(F.col("path").endswith(".bim") | F.col("path").endswith("DataModelSchema"))).where("json IS NOT NULL")
    tables = doc.select("project", F.explode(F.from_json("json", kind)["model"]["tables"]).alias("t"))
    columns = tables.select("project", F.col("t.name").alias("table"), F.explode("t.columns").alias("c")).select("project", "table", "c.name", F.col("c.dataType").alias("data_type"))
    measures = tables.select("project", F.col("t.name").alias("table"), F.explode("t.measures").alias("m"))
    lines = F.from_json("m.expression", "ARRAY<STRING>")
    text = F.when(F.ltrim("m.expression").startswith("["), F.coalesce(F.array_join(lines, "\n"), F.col("m.expression"))).otherwise(F.col("m.expression"))
    return columns, measures.select("project", "table", "m.name", F.trim(text).alias("expression"))


_MODEL_ROW = "project string, path string, kind string, table string, name string, value string"


def model_text(raw: DataFrame) -> DataFrame:
    """(project, path, kind, table, name, value) of model files in text form: columns with their type, measures with their expression, issues with a message."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(project, path, *row) for project, path, text in frame.itertuples(index=False) for row in read_model_text(text)]
            yield pd.DataFrame(rows, columns=["project", "path", "kind", "table", "name", "value"])

    files = raw.where(F.col("path").endswith(".tmdl")).select("project", "path", text_of(F.col("content")).alias("text"))
    return files.mapInPandas(run, _MODEL_ROW)


_HEAD = re.compile(r"(table|column|measure)\s+('(?:[^']|'')*'|[^\s=']+)\s*(=\s*(.*))?$")
# Spaces that count as one level, the level from which /// is part of an expression, and what may enclose one.
LEVEL, EXPRESSION_LEVEL, FENCE = 4, 3, "```"
_STEP = re.compile(rf"\t| {{{LEVEL}}}")


def _levels(line: str) -> int:
    """Tabs first, then each LEVEL spaces."""
    rest = line.lstrip("\t")
    return len(line) - len(rest) + (len(rest) - len(rest.lstrip(" "))) // LEVEL


def _outdented(line: str, levels: int) -> str:
    for _ in range(levels):
        line = _STEP.sub("", line, count=1) if _STEP.match(line) else line
    return line


def read_model_text(text: str | None) -> list[tuple[str, str | None, str | None, str]]:
    """Objects stand below their tables by one level, what describes them by two, and expressions after `=` or in the lines below by three, with or without a fence around them. Blank lines, and notes (///) above the level of expressions, are skipped."""
    if text is None:
        return [("issue", None, None, "not UTF-8")]
    lines = [(_levels(x), x.rstrip()) for x in text.splitlines()]
    lines = [(d, x) for d, x in lines if x.strip() and not (d < EXPRESSION_LEVEL and x.lstrip().startswith("///"))]
    unquoted = lambda n: n[1:-1].replace("''", "'") if n.startswith("'") else n
    rows, table = [], None
    for i, (depth, line) in enumerate(lines):
        if depth > 1:
            continue
        head = _HEAD.match(line.strip())
        if depth == 0:
            table = unquoted(head[2]) if head and head[1] == "table" else None
        elif table is not None and head and head[1] == "column":
            below = itertools.takewhile(lambda x: x[0] > 1, lines[i + 1 :])
            types = [x.split(":", 1)[1].strip() for d, x in below if d == 2 and x.strip().startswith("dataType:")]
            rows.append(("column", table, unquoted(head[2]), types[-1] if types else ""))
        elif table is not None and head and head[1] == "measure":
            below = itertools.takewhile(lambda x: x[0] >= EXPRESSION_LEVEL, lines[i + 1 :]) if head[3] else ()
            body = "\n".join([(head[4] or "").strip(), *(_outdented(x, EXPRESSION_LEVEL) for _, x in below)]).strip()
            if body.startswith(FENCE) and body.endswith(FENCE) and len(body) > 2 * len(FENCE):
                body = body.removeprefix(FENCE).removesuffix(FENCE).strip()
            rows.append(("measure", table, unquoted(head[2]), body) if body else ("issue", table, unquoted(head[2]), "a measure without an expression"))
    return rows
