"""Documents out of files: slides and word documents in zip containers, and many files of mixed kinds at once.

Files come as rows of Spark's binaryFile source (path, content), so any store that Spark reads will do. A file that
cannot be read is a row with its error and stops nothing.
"""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import zipfile
import zlib
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a container may hold: entries, bytes of one entry and of all when unpacked, and how many times its own size that may be.
MOST_ENTRIES, MOST_ENTRY_BYTES, MOST_BYTES, MOST_RATIO = 10_000, 64 << 20, 256 << 20, 200
#: Characters and bytes of results that a task holds before it hands them on.
HELD = 4 << 20
_SLIDE = re.compile(r"^ppt/slides/slide(\d+)\.xml$", re.IGNORECASE)
#: Names of the two kinds of markup.
_WORD, _DRAWING = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_UNREADABLE = (ValueError, KeyError, zipfile.BadZipFile, zlib.error, ElementTree.ParseError, NotImplementedError, EOFError, OSError, csv.Error, RecursionError)


def open_container(data: bytes) -> zipfile.ZipFile:
    """The container's directory, if what it says it holds is within bounds, and no entry leads out of it."""
    z = zipfile.ZipFile(io.BytesIO(data))
    entries, total = z.infolist(), 0
    if len(entries) > MOST_ENTRIES:
        raise ValueError("too many entries")
    for e in entries:
        name = e.filename.replace("\\", "/")
        if name.startswith("/") or ".." in name.split("/") or ":" in name.split("/")[0]:
            raise ValueError("an entry leads out of the container")
        if e.flag_bits & 1:
            raise ValueError("an entry is encrypted")
        total += e.file_size
        if e.file_size > MOST_ENTRY_BYTES or total > MOST_BYTES or total > MOST_RATIO * max(len(data), 1 << 10):
            raise ValueError("unpacked it would be too large")
    return z


def _entry(z: zipfile.ZipFile, name: str) -> bytes:
    """An entry unpacked; one that holds more than its directory says is an error, found before it is all in memory."""
    with z.open(name) as f:
        data = f.read(MOST_ENTRY_BYTES + 1)
    if len(data) > MOST_ENTRY_BYTES:
        raise ValueError("unpacked it would be too large")
    return data


def _markup(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("markup with its own entities")
    return ElementTree.fromstring(data)


def word_text(data: bytes) -> str:
    """Paragraphs of a word document, an empty line after each; tabs and breaks within stay."""
    marks = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
    root = _markup(_entry(open_container(data), "word/document.xml"))
    out = []
    for p in root.iter(f"{_WORD}p"):
        out.append("".join((e.text or "") if e.tag == f"{_WORD}t" else marks.get(e.tag, "") for e in p.iter()))
    return "\n\n".join(out).strip()


def slide_texts(data: bytes) -> list[str]:
    """Texts of the slides of a presentation in the order of their numbers: a line for each run of text, the slide's number where there is none."""
    z = open_container(data)
    names = sorted((int(m[1]), e.filename) for e in z.infolist() if (m := _SLIDE.match(e.filename)))
    if not names:
        raise ValueError("no slides")
    out = []
    for k, (_, name) in enumerate(names, 1):
        runs = [(t.text or "").strip() for t in _markup(_entry(z, name)).iter(f"{_DRAWING}t")]
        out.append("\n".join(x for x in runs if x) or f"第 {k} 页")
    return out


def _plain(data: bytes) -> str:
    return data.decode("utf-8-sig")


def _table(data: bytes) -> str:
    rows = [r for r in csv.reader(io.StringIO(_plain(data), newline="")) if any(c.strip() for c in r)]
    return "\n".join("\t".join(r) for r in rows)


def _json(data: bytes) -> str:
    return json.dumps(json.loads(_plain(data)), ensure_ascii=False, indent=2)


#: How files are read, by extension: a text, or a list of the texts of its parts.
READERS = {"txt": _plain, "text": _plain, "md": _plain, "markdown": _plain, "csv": _table, "json": _json, "docx": word_text, "pptx": slide_texts}


def read_file(path: str, data: bytes) -> tuple[str, list[str], str | None]:
    """(kind, texts of the parts, error) of a file."""
    name = unquote(posixpath.basename(path))
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if kind not in READERS:
        return kind, [], f"unknown kind of file: {kind or name}"
    try:
        got = READERS[kind](data)
    except _UNREADABLE as e:
        return kind, [], f"{type(e).__name__}: {e}"
    parts = got if isinstance(got, list) else [got.strip()]
    return (kind, parts, None) if any(parts) else (kind, [], "empty")


def _handed_on(rows, schema: pa.Schema):
    """Batches of the rows, HELD characters or little more each."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if size >= HELD:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _values(batches):
    """Rows of the batches one by one: only the row at hand is held besides its batch."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in batch.columns)


_FILES = pa.schema([("path", pa.string()), ("content", pa.binary())])
_PARTS = pa.schema([("path", pa.string()), ("kind", pa.string()), ("part", pa.int32()), ("parts", pa.int32()), ("success", pa.bool_()), ("error", pa.string()), ("text", pa.string())])


def read_files(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """path, kind, part, parts, success, error, text of each part of each file: a row a slide, else a row a file.

    A file that cannot be read, is of an unknown kind, empty or null has one row without a text, success false and its error.
    Each file is read whole by one task, within the bounds of containers; the order of files is lost, that of parts is ``part``, from 0.
    """

    def parts_of(batches):
        for path, data in _values(batches):
            kind, parts, error = read_file(path or "", data or b"")
            if error is None:
                yield from ((path, kind, k, len(parts), True, None, t) for k, t in enumerate(parts))
            else:
                yield path, kind, 0, 0, False, error, None

    thin = files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content"))
    return thin.mapInArrow(lambda b: _handed_on(parts_of(b), _PARTS), "path string, kind string, part int, parts int, success boolean, error string, text string")


def binary_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, content of each file of a folder, read by Spark."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def _packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text.encode(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _escaped(text: str) -> str:
    return re.sub("[^\\t\\n\\r\\x20-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]", "", text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#13;")


def write_word(paragraphs: list[str]) -> bytes:
    """A word document of these paragraphs; line ends and tabs in them become breaks and tabs."""
    def run(text: str) -> str:
        pieces = re.split(r"([\n\t])", text)
        return "".join("<w:r><w:br/></w:r>" if x == "\n" else "<w:r><w:tab/></w:r>" if x == "\t" else f'<w:r><w:t xml:space="preserve">{_escaped(x)}</w:t></w:r>' for x in pieces if x)

    body = "".join(f"<w:p>{run(p)}</w:p>" for p in paragraphs)
    return _packed({"[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>', "word/document.xml": f'<w:document xmlns:w="{_WORD[1:-1]}"><w:body>{body}</w:body></w:document>'})


def write_slides(slides: list[list[str]]) -> bytes:
    """A presentation of slides, each a list of paragraphs."""
    def page(lines: list[str]) -> str:
        return f'<p:sld xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="{_DRAWING[1:-1]}">' + "".join(f"<a:p><a:r><a:t>{_escaped(x)}</a:t></a:r></a:p>" for x in lines) + "</p:sld>"

    return _packed({f"ppt/slides/slide{k}.xml": page(s) for k, s in enumerate(slides, 1)})


def as_containers(docs: DataFrame, id_col: str, text_col: str, kind: Column) -> DataFrame:
    """path, content: each text as a file of its kind (docx: a paragraph for each part between blank lines; pptx: a slide for each; else as it is)."""
    def packed(batches):
        for i, text, k in _values(batches):
            parts = [p for p in re.split(r"\n\s*\n", text or "") if p.strip()]
            yield f"{i}.{k}", write_word(parts) if k == "docx" else write_slides([p.split("\n") for p in parts]) if k == "pptx" else (text or "").encode()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), kind.alias("kind")).mapInArrow(lambda b: _handed_on(packed(b), _FILES), "path string, content binary")
