"""Single documents in pieces: a document may be as large as its report, so it is walked once in Python and handed over as bounded rows.

Pieces are texts of the document as they stand; what they mean is read from them in reports.py.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .definitions import UNREADABLE, entries_of, in_batches, rows_of

# Fixed value: the layout's name in an archive.
LAYOUT = "Report/Layout"

_PIECE = {"piece": ("string", pa.string()), "n": ("int", pa.int32()), "i": ("int", pa.int32()), "j": ("int", pa.int32()), "head": ("string", pa.string()), "text": ("string", pa.string())}
_skip = re.compile(r"[ \t\n\r]*").match


def is_document(path: Column) -> Column:
    """Single documents, also those out of archives."""
    return (path.endswith("report.json") & ~path.rlike(r"(^|/)definition/report\.json$")) | path.endswith(LAYOUT)


_SCHEMA = pa.schema([("project", pa.string()), ("path", pa.string()), ("content", pa.binary()), *[(c, t) for c, (_, t) in _PIECE.items()]])
_DDL = "project string, path string, content binary, " + ", ".join(f"{c} {t}" for c, (t, _) in _PIECE.items())


def taken_apart(raw: DataFrame, archives: bool = False) -> DataFrame:
    """raw with its documents in pieces, and the layouts of its archives, where asked for, which are never held as rows: (project, path, content, piece, n, i, j, head, text).

    Other files have no piece. Piece `document` is the text without the list of sections, null where it is no JSON object; `section` is the i-th of n, without
    its list of visuals; `container` the j-th visual of section i, whose name stands in head. Of a list that is written inside a text nothing is taken out.
    """
    return raw.select("project", "path", "content").mapInArrow(lambda batches: in_batches(_all_pieces(batches, archives), _SCHEMA), _DDL)


def document_pieces(raw: DataFrame) -> DataFrame:
    """The pieces of raw, or of its documents where it has not been taken apart."""
    return (raw if "piece" in raw.columns else taken_apart(raw.where(is_document(F.col("path"))))).where("piece IS NOT NULL")


def without_pieces(raw: DataFrame) -> DataFrame:
    """The files of raw that were not taken apart."""
    return raw.where("piece IS NULL").select("project", "path", "content") if "piece" in raw.columns else raw


def _all_pieces(batches: Iterator[pa.RecordBatch], archives: bool) -> Iterator[tuple]:
    for project, path, content in rows_of(batches):
        if path is not None and _document_path(path):
            yield from ((project, path, None, *p) for p in pieces(content))
        elif path is not None and archives and path.lower().endswith(".pbit"):
            try:
                # A layout is let go in pieces, so that only the limit of the whole archive holds for it.
                for name, data in entries_of(content or b"", apart=(LAYOUT,)):
                    if name == LAYOUT:
                        yield from ((project, f"{path}/{name}", None, *p) for p in pieces(data))
            except UNREADABLE:
                continue
        else:
            yield (project, path, content, *[None] * len(_PIECE))


def _document_path(path: str) -> bool:
    """As is_document."""
    return path.endswith(LAYOUT) or (path.endswith("report.json") and not re.search(r"(^|/)definition/report\.json$", path))


def pieces(content: bytes | None) -> Iterator[tuple]:
    """(piece, n, i, j, head, text) of one document."""
    try:
        text = (content or b"").decode().removeprefix("﻿")
        if not text.lstrip(" ").startswith("{"):
            raise ValueError("no object")
        end, spans, sections = _object(text, text.index("{"), "sections", "visualContainers")
    except (ValueError, RecursionError, StopIteration):
        yield "document", None, None, None, None, None
        return
    yield "document", None, None, None, None, text[:end] if sections is None else _without(text, text.index("{"), end, spans["sections"])
    for i, (start, stop, found) in enumerate(sections or ()):
        own, containers = found or ({}, None)
        yield "section", len(sections), i, None, None, _item(text, start, stop) if containers is None else _without(text, start, stop, own["visualContainers"])
        head = '{"name": %s}' % text[slice(*own["name"])] if "name" in own else "{}"
        for j, (a, b, _) in enumerate(containers or ()):
            yield "container", None, i, j, head, _item(text, a, b)


def _without(text: str, start: int, end: int, span: tuple[int, int]) -> str:
    return f"{text[start : span[0]]}[]{text[span[1] : end]}"


def _item(text: str, start: int, end: int) -> str | None:
    """An item of a list as a text: texts as what they say, null as none."""
    if text[start] == '"':
        return json.loads(text[start:end]).encode("utf-8", "replace").decode()
    return None if text[start:end] == "null" else text[start:end]


def _refused(constant: str):
    raise ValueError(constant)


def _distinct(pairs: list[tuple]) -> None:
    """Objects are only checked: no name may stand twice."""
    if len({k for k, _ in pairs}) != len(pairs):
        raise ValueError("a name stands twice")


_value = json.JSONDecoder(object_pairs_hook=_distinct, parse_constant=_refused).raw_decode


def _object(text: str, at: int, key: str, inner: str | None) -> tuple[int, dict[str, tuple[int, int]], list | None]:
    """(end, where the values of name and key stand, the items of key's list) of the object that starts at a place; inner is the key of such a list in items."""
    spans, seen, items = {}, set(), None
    at = _skip(text, at + 1).end()
    if text[at : at + 1] == "}":
        return at + 1, spans, items
    while True:
        if text[at : at + 1] != '"':
            raise ValueError("no name")
        name, at = _value(text, at)
        at = _skip(text, at).end()
        if name in seen or text[at : at + 1] != ":":
            raise ValueError("no value")
        seen.add(name)
        start = _skip(text, at + 1).end()
        if name == key and text[start : start + 1] == "[":
            at, items = _list(text, start, inner)
        else:
            _, at = _value(text, start)
        if name in (key, "name"):
            spans[name] = (start, at)
        at = _skip(text, at).end()
        if text[at : at + 1] == "}":
            return at + 1, spans, items
        if text[at : at + 1] != ",":
            raise ValueError("no end")
        at = _skip(text, at + 1).end()


def _list(text: str, at: int, inner: str | None) -> tuple[int, list[tuple]]:
    """(end, items) of the list that starts at a place; an item is (start, end, (spans, items of its inner list) or None)."""
    items = []
    at = _skip(text, at + 1).end()
    if text[at : at + 1] == "]":
        return at + 1, items
    while True:
        start, found = at, None
        if inner is not None and text[at : at + 1] == "{":
            at, *found = _object(text, at, inner, None)
        else:
            _, at = _value(text, at)
        items.append((start, at, found))
        at = _skip(text, at).end()
        if text[at : at + 1] == "]":
            return at + 1, items
        if text[at : at + 1] != ",":
            raise ValueError("no end")
        at = _skip(text, at + 1).end()
