"""Fill-in-middle transformation: DuckDB inside mapInArrow.

Texts are cut into tokens, and two seeded cuts part the tokens into prefix, middle and suffix, which
are put into another order between marks. Each batch of rows is registered with a DuckDB
connection of the task and goes through one SQL statement; Arrow goes in and comes out, no row
passes through Python. Everything follows from the row alone, so nothing is shuffled, and a
task that runs again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, slices

TOKEN = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are transformed, percent of these whose suffix stands first, and the seed.
RATE, SUFFIX_FIRST, SEED = 90, 20, "1"

_PLACED = r"""
WITH cut AS (
  SELECT *, regexp_extract_all(text, $token) AS tokens, sha256($seed || ':' || coalesce(id, '')) AS h FROM rows),
drawn AS (
  SELECT *, len(tokens) AS n, ('0x' || h[1:8])::BIGINT % (len(tokens) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(tokens) + 1) AS c2,
         CASE WHEN text = '' OR contains(text, $p) OR contains(text, $s) OR contains(text, $m) OR ('0x' || h[17:24])::BIGINT % 100 >= $rate THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < $suffix_first THEN 'spm' ELSE 'psm' END AS form FROM cut),
parted AS (
  SELECT * EXCLUDE (tokens), array_to_string(list_slice(tokens, 1, least(c1, c2)), '') AS prefix,
         array_to_string(list_slice(tokens, least(c1, c2) + 1, greatest(c1, c2)), '') AS middle,
         array_to_string(list_slice(tokens, greatest(c1, c2) + 1, n), '') AS suffix FROM drawn),
placed AS (
  SELECT place, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
         CASE form WHEN 'plain' THEN text WHEN 'psm' THEN $p || prefix || $s || suffix || $m || middle ELSE $s || suffix || $p || prefix || $m || middle END AS output FROM parted)
"""

#: A mark can't begin inside a part and end in the next one: it has no ending that is a beginning of a mark. So the marks cut an output where they were put.
_RESTORED = r"""
marked AS (
  SELECT *, string_split(output, $m)[2] AS middle, string_split(substring(string_split(output, $m)[1], length($p) + 1), CASE form WHEN 'psm' THEN $s ELSE $p END) AS outer_parts FROM {0}),
restored AS (
  SELECT * EXCLUDE (middle, outer_parts), CASE form WHEN 'plain' THEN output WHEN 'psm' THEN outer_parts[1] || middle || outer_parts[2] ELSE outer_parts[2] || middle || outer_parts[1] END AS text FROM marked)
"""

_ADDED = "n long, form string, prefix_chars long, middle_chars long"


def _through(rows: DataFrame, column: str, needs: list[str], sql: str, given: dict, added: str) -> DataFrame:
    """rows without the text `column`, with the columns of `added` that the SQL makes of rows(place, column, *needs), a batch of them at a time."""
    kept = [c for c in rows.columns if c != column]
    schema = extended(rows.select(*[F.col(f"`{c}`") for c in kept]), added)
    made = schema.names[len(kept) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as con:
            for batch, _, _ in slices(batches, column):
                place = pa.array(np.arange(batch.num_rows))
                con.register("rows", pa.Table.from_arrays([place, *(batch.column(c) for c in (column, *needs))], names=["place", column, *needs]))
                found = con.sql(sql, params=given).to_arrow_table().combine_chunks()
                con.unregister("rows")
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [found.column(c).chunk(0) for c in made], names=schema.names)

    return rows.mapInArrow(run, schema)


def _marks() -> dict:
    return {"p": PREFIX, "s": SUFFIX, "m": MIDDLE}


def _checked(seed: str, rate: int, suffix_first: int) -> dict:
    if not (0 <= rate <= 100 and 0 <= suffix_first <= 100):
        raise ValueError("rate and suffix_first are percentages")
    return {"token": TOKEN, "seed": seed, "rate": rate, "suffix_first": suffix_first} | _marks()


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("id"), F.make_valid_utf8(F.coalesce(F.col(text), F.lit(""))).alias("text"))


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars and output of every row of docs.

    The cuts, whether a text is transformed and its form follow from the seed and doc_id, so rows
    with equal ids and texts are alike and reruns agree; a null id counts as an empty one. Empty
    and null texts, and texts that hold one of the marks, stay plain. Bytes that are not UTF-8
    count as replacement characters. A cut may fall on either end: parts can be empty. Other
    columns are ignored, an empty table gives an empty result. A task holds SLICE_BYTES of text, or
    one longer text, and its tokens.
    """
    rows = _rows(docs, text, doc_id)
    sql = _PLACED + "SELECT n, form, prefix_chars, middle_chars, output FROM placed ORDER BY place"
    return _through(rows, "text", ["id"], sql, _checked(seed, rate, suffix_first), _ADDED + ", output string").drop("id")


def restored(outputs: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """The rows of outputs with the text that each output was made from as column `text`, in the place of the output and of any `text` before; null where output or form is null."""
    rows = outputs.select(*[F.col(f"`{c}`") for c in outputs.columns if c == output or c != "text"])
    rows = rows.withColumnsRenamed({output: "output", form: "form"})
    sql = "WITH " + _RESTORED.format("rows").lstrip() + "SELECT text FROM restored ORDER BY place"
    return _through(rows, "output", ["form"], sql, _marks(), "text string").withColumnRenamed("form", form)


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """fill_in_middle() with output_sha256 and restored_sha256, of the text rebuilt from output and form, instead of the output: one pass in which no text leaves DuckDB."""
    rows = _rows(docs, text, doc_id)
    sql = _PLACED + ", " + _RESTORED.format("placed").lstrip() + "SELECT n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM restored ORDER BY place"
    return _through(rows, "text", ["id"], sql, _checked(seed, rate, suffix_first), _ADDED + ", output_sha256 string, restored_sha256 string").drop("id")
