"""Names of documents, chunks and sources, and the metadata that newspapers come with."""

from __future__ import annotations

import json
import re
from pathlib import PurePosixPath

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import compact_json

CHUNK_SCHEMA = "lectern.chunk.v1"
_DATE = re.compile(r"(\d{4})(?: +(\d\d)(?: +(\d\d))?)?")
_IDENTIFIER = re.compile("(?i)(?:gf-)?urn:")
COLUMNS = tuple("date publisher source rights title urn issue volume".split())


def chunk_name(path: str, chunk: str | int) -> str:
    """A chunk's id as JSON with sorted keys."""
    return compact_json({"article": PurePosixPath(path).stem, "chunk": str(chunk), "path": path, "schema": CHUNK_SCHEMA})


def parse_chunk_name(value: str) -> dict[str, str]:
    """The parts of a chunk's id; also of the older ``path###n``. Anything else is a path with chunk 0."""
    try:
        found = json.loads(value)
    except ValueError:
        found = None
    if isinstance(found, dict) and found.get("schema") == CHUNK_SCHEMA and {"path", "chunk"} <= found.keys():
        path, chunk, article = str(found["path"]), str(found["chunk"]), found.get("article")
    else:
        path, mark, chunk = value.rpartition("###")
        path, chunk, article = (path, chunk, None) if mark else (value, "0", None)
    return {"schema": CHUNK_SCHEMA, "path": path, "article": str(article or PurePosixPath(path).stem), "chunk": chunk}


def chunk_path(column: Column) -> Column:
    """``parse_chunk_name(...)["path"]`` in built-in functions."""
    own = F.get_json_object(column, "$.schema") == CHUNK_SCHEMA
    older = F.regexp_extract(column, r"(?s)^(.*)###(.*)$", 1)
    return F.when(own & F.get_json_object(column, "$.path").isNotNull(), F.get_json_object(column, "$.path")).when(column.contains("###"), older).otherwise(column)


def document_name(urn: Column, fallback: Column) -> Column:
    """A URN without its registry prefix, or the fallback."""
    prefix = "URN:NBN:SI:doc-"
    return F.when(urn.startswith(prefix), F.substring(urn, len(prefix) + 1, 1_000_000)).otherwise(F.coalesce(F.when(urn != "", urn), fallback))


def _text(value: object) -> str | None:
    while isinstance(value, (list, dict)):
        value = (value[0] if value else None) if isinstance(value, list) else value.get("#text")
    found = "" if value is None else str(value).strip()
    return found or None


def _entries(value: object) -> list:
    return value if isinstance(value, list) else [value]


def _of_type(value: object, attribute: str, wanted: str) -> list[dict]:
    return [x for x in _entries(value) if isinstance(x, dict) and str(x.get(attribute, "")).casefold() == wanted]


def iso_date(value: str | None) -> str | None:
    """``1934 10 10`` as ``1934-10-10``; a year, or year and month, in the same way; others unchanged."""
    found = _DATE.fullmatch(re.sub(r"\s+", " ", value)) if value is not None else None
    return "-".join(filter(None, found.groups())) if found else value


def _record(metadata: object) -> dict:
    """The record, or an empty one where the metadata has another shape."""
    outer = metadata if isinstance(metadata, dict) else {}
    inner = outer.get("Record")
    return inner if isinstance(inner, dict) else {}


def newspaper_columns(metadata: object) -> dict[str, str | None]:
    """The eight text columns of an issue from its metadata record, whose fields may be texts, lists or
    objects. A typed URN wins over a bare one."""
    record = _record(metadata)
    identifiers = record.get("identifier")
    typed = _of_type(identifiers, "@identifier_type", "urn")
    bare = (t for t in map(_text, _entries(identifiers)) if t and t.casefold().startswith("urn:"))
    urn = _text(typed[0]) if typed else next(bare, None)
    kind = lambda k: next((_text(x) for x in _of_type(record.get("format"), "@format_type", k)), None)
    plain = {k: _text(record.get(k)) for k in ("publisher", "source", "rights", "title")}
    return {"date": iso_date(_text(record.get("date"))), **plain, "urn": urn, "issue": kind("issue"), "volume": kind("volume")}


def source_identifiers(metadata: object) -> list[str]:
    """Lower-cased ``urn:`` and ``gf-urn:`` identifiers, sorted."""
    values = _entries(_record(metadata).get("identifier", []))
    texts = (v.get("#text") if isinstance(v, dict) else v for v in values)
    return sorted({t.casefold() for t in texts if isinstance(t, str) and _IDENTIFIER.match(t)})
