"""Text out of uploaded documents, by file extension."""

from __future__ import annotations

import csv
import html as html_lib
import io
import json
import re
import zipfile
from json.encoder import encode_basestring
from typing import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pandas._libs.parsers import STR_NA_VALUES
from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

# Extensions read as pictures, which hold no text without OCR.
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "webp", "tif", "tiff"]
HTML_EXTENSIONS = ["html", "htm"]
# No reader for these comes with the library; a caller may pass one, else their text is empty.
PLUGGABLE_EXTENSIONS = ["pdf", "xlsx"]

Extractor = Callable[[bytes], str]

# Parts whose content is not text, then any remaining tag; quoted attributes may hold ``>``.
HIDDEN_PARTS = (
    r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
    r"|<template\b.*?(?:</template\s*>|\z)|<rt\b.*?(?:</rt\s*>|\z)|<rp\b.*?(?:</rp\s*>|\z)"
)
# a tag with an unpaired quote ends at the next ``>``.
TAGS = r"""(?s)</?[a-zA-Z](?:[^<>'"]*+(?:(?:"[^"]*+"|'[^']*+')[^<>'"]*+)*+|[^<>]*+)>|<[!?][^>]*+>"""
# Entities decoded as plain replacements; ``&amp;`` comes last so that nothing is decoded twice.
COMMON_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
                   ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]
OTHER_ENTITY = "&(?!(?:" + "|".join(e[1:-1] for e, _ in COMMON_ENTITIES) + ");)[a-zA-Z#]"


def read_documents(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files as ``(path, modificationTime, length, content)``, subfolders included."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def decode_utf8(content: Column) -> Column:
    """UTF-8 text with undecodable bytes left out."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit("")))


@F.arrow_udf(T.StringType())
def _unescape(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html_lib.unescape(t) for t in texts.to_pylist()], pa.string())


# so that a filter on a text stays above it, as with the readers below
_unescape = _unescape.asNondeterministic()


def html_to_text(markup: Column) -> Column:
    """Visible text and title, a blank in place of markup. Scripts, styles, templates, ruby notes,
    comments and declarations are left out.

    Only texts with uncommon entities pass through Python; the others reach it as null."""
    return _decode_entities(_without_markup(markup))


def _without_markup(markup: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(markup, HIDDEN_PARTS, " "), TAGS, " ")


def _decode_entities(bare: Column) -> Column:
    common = bare
    for entity, char in COMMON_ENTITIES:
        common = F.replace(common, F.lit(entity), F.lit(char))
    return F.coalesce(_unescape(F.when(bare.rlike(OTHER_ENTITY), bare)), common)


#: Longer files and those with anything unusual in them are parsed by pandas, whose rules the short way keeps to.
SHORT_CSV = 1 << 16
_WHOLE = re.compile(r"0|-?[1-9][0-9]{0,14}").fullmatch
_DECIMAL = re.compile(r"0|-?(?:0(?=\.)|[1-9][0-9]*)(?:\.[0-9]+)?").fullmatch
_ODD, _ODD_START = ("\r", "\0", "\n\n", "\n ", "\n\t"), ("\n", " ", "\t", "\ufeff")
_NEITHER = {"true", "false", "inf", "infinity", "nan"}


def _csv_text(payload: bytes) -> str:
    told = _plain_csv(payload) if len(payload) <= SHORT_CSV else None
    if told is not None:
        return told
    frame = pd.read_csv(io.BytesIO(payload))
    return "\n".join(" ".join(str(cell) for cell in row) for row in frame.itertuples(index=False, name=None))


def _plain_csv(payload: bytes) -> str | None:
    """The cells of a file as ``pd.read_csv`` types them, by column; None where its rules are not sure to be the ones here:
    other line ends, blank or uneven rows, outer blanks, cells across lines, spelled-out values, numbers of unusual form."""
    try:
        text = payload.decode()
    except UnicodeDecodeError:
        return None
    text = text.removesuffix("\n")
    if not text or text[-1] == "\n" or text.startswith(_ODD_START) or any([x in text for x in _ODD]):
        return None
    lines = text.split("\n")
    if '"' in text:
        try:
            rows = list(csv.reader(lines, strict=True))
        except csv.Error:
            return None
        if len(rows) != len(lines):
            return None
    else:
        rows = [x.split(",") for x in lines]
    if len(set(map(len, rows))) > 1:
        return None
    columns = []
    for cells in zip(*rows[1:]):
        if not all(map(_WHOLE, cells)):
            cells = _typed(cells)
            if cells is None:
                return None
        columns.append(cells)
    return "\n".join(map(" ".join, zip(*columns)))


def _typed(cells: tuple[str, ...]) -> Sequence[str] | None:
    """Cells of a column with text or decimals; None if that is not sure."""
    complete = STR_NA_VALUES.isdisjoint(cells)
    if any(x[:1].isalpha() and x not in STR_NA_VALUES and x.lower() not in _NEITHER for x in cells):
        return cells if complete else ["nan" if x in STR_NA_VALUES else x for x in cells]
    known = cells if complete else [x for x in cells if x not in STR_NA_VALUES]
    # up to 15 digits any parser rounds alike
    if all([len(x) <= 16 and _DECIMAL(x) for x in known]):
        return [repr(float(x)) if complete or x not in STR_NA_VALUES else "nan" for x in cells]
    return None


def _json_text(payload: bytes) -> str:
    """As ``json.dumps`` with an indent of two, which walks even the smallest value by a chain of generators."""
    value = json.loads(payload)
    try:
        return _indented(value, "\n")
    except RecursionError:
        return json.dumps(value, ensure_ascii=False, indent=2)


_CONSTANTS = {None: "null", True: "true", False: "false"}
DEEPEST = 100


def _indented(value: object, line: str) -> str:
    if isinstance(value, str):
        return encode_basestring(value)
    if value is None or isinstance(value, bool):
        return _CONSTANTS[value]
    if isinstance(value, int):
        return int.__repr__(value)
    if isinstance(value, float):
        return json.dumps(value)
    if not value:
        return "{}" if isinstance(value, dict) else "[]"
    inner = line + "  "
    if len(inner) > 2 * DEEPEST:
        raise RecursionError
    if isinstance(value, dict):
        return "{" + inner + ("," + inner).join([f"{encode_basestring(k)}: {_indented(v, inner)}" for k, v in value.items()]) + line + "}"
    return "[" + inner + ("," + inner).join([_indented(v, inner) for v in value]) + line + "]"


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_RUN_TEXT = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n", f"{_WORD}noBreakHyphen": "-"}


def _docx_text(payload: bytes) -> str:
    """Body paragraphs, one per line; tables, headers and footers are not paragraphs of the body."""
    with zipfile.ZipFile(io.BytesIO(payload)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{_WORD}body")
    lines = []
    for paragraph in body.findall(f"{_WORD}p"):
        runs = [r for child in paragraph for r in ([child] if child.tag == f"{_WORD}r" else
                                                   child.findall(f"{_WORD}r") if child.tag == f"{_WORD}hyperlink" else [])]
        lines.append("".join(
            (piece.text or "") if piece.tag == f"{_WORD}t" else _RUN_TEXT.get(piece.tag, "") for run in runs for piece in run))
    return "\n".join(lines)


FILE_READERS: dict[str, Extractor] = {"csv": _csv_text, "json": _json_text, "docx": _docx_text}


def _read_files(readers: dict[str, Extractor]):
    """A function of kind and content. It counts as nondeterministic so that a filter on the text stays above it; the
    optimizer would else have every file read for the filter and once more for the text."""

    @F.arrow_udf(T.StringType())
    def read(chunks: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for kinds, payloads in chunks:
            yield pa.array([_safely(readers.get(k), p) for k, p in zip(kinds.to_pylist(), payloads.to_pylist())], pa.string())

    return read.asNondeterministic()


def _safely(reader: Extractor | None, payload: bytes | None) -> str | None:
    if reader is None or payload is None:
        return None
    try:
        return reader(payload) or ""
    except Exception:
        return ""


def extract_text(df: DataFrame, name: str = "path", content: str = "content", readers: dict[str, Extractor] = {}) -> DataFrame:
    """Adds ``text``. HTML and plain files are handled by native expressions; CSV, JSON and DOCX,
    and formats for which ``readers`` has a function, pass through Python one file at a time.
    Unreadable files and pictures have empty text."""
    readers = {**FILE_READERS, **readers}
    kind = F.col("file_kind")
    decoded = decode_utf8(F.col(content))
    by_reader = kind.isin(list(readers))
    read = _read_files(readers)(F.when(by_reader, kind), F.when(by_reader, F.col(content)))
    empty = kind.isin(IMAGE_EXTENSIONS + [k for k in PLUGGABLE_EXTENSIONS if k not in readers])
    marked = df.withColumn("file_kind", extension(F.col(name)))
    # markup is a column of its own, so that it is taken out once and not once for each use
    bare = _without_markup(F.when(kind.isin(HTML_EXTENSIONS) & ~by_reader, decoded))
    return marked.withColumn("read_text", read).withColumn("bare_text", bare).withColumn(
        "text",
        F.when(by_reader, F.coalesce("read_text", F.lit("")))
        .when(empty, F.lit(""))
        .when(kind.isin(HTML_EXTENSIONS), _decode_entities(F.col("bare_text")))
        .otherwise(decoded),
    ).drop("file_kind", "read_text", "bare_text")


def text_or_trace(content: Column) -> Column:
    """Decoded text, or for files without any a marker with the first 64 bytes in base 64."""
    text = decode_utf8(content)
    trace = F.concat(F.lit("(binaire) "), F.regexp_replace(F.base64(F.substring(content, 1, 64)), "[\r\n]", ""), F.lit("…"))
    return F.when(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]", "") == "", trace).otherwise(text)
