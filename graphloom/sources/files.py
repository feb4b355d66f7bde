"""Documents from files: text, tables, JSON, office formats, and graphs as JSON."""

from __future__ import annotations

import csv
import io
import json
import re
import subprocess
import sys
import warnings
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import suffix
from ..operators.numbering import numbered

csv.field_size_limit(sys.maxsize)  # fields may be as long as their file

TEXT = {".txt", ".md", ".markdown", ".rst", ".log", ".py", ".js", ".ts", ".java", ".c", ".cpp", ".h", ".go", ".rs", ".rb", ".sh", ".yaml", ".yml", ".toml", ".ini", ".xml", ".html", ".htm"}
PANDOC = {".epub", ".odt", ".rtf", ".doc", ".pptx"}
#: How files are read, by extension; those not named go to pandoc as well.
KINDS = {ext: "text" for ext in TEXT} | {ext: "pandoc" for ext in PANDOC} | {".csv": "table", ".tsv": "table", ".json": "json", ".jsonl": "lines", ".ndjson": "lines", ".pdf": "pdf", ".docx": "docx"}
#: Rows up to which the numbers of files are broadcast (some 300 bytes each); beyond, the join is dealt out.
BROADCAST_ROWS = 200_000
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def pipe_table(data: bytes, delimiter: str = ",") -> str:
    """Rows as a pipe table under a line with their number; ragged rows stay ragged."""
    rows = list(csv.reader(io.StringIO(data.decode("utf-8", "replace")), delimiter=delimiter))
    if not rows:
        return ""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([f"[CSV — {len(rows) - 1} righe, {len(rows[0])} colonne]", line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


def pretty_json(data: bytes) -> str:
    text = data.decode("utf-8", "replace")
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except (ValueError, RecursionError):
        return text


def json_lines(data: bytes, most: int = 100) -> str:
    """The first ``most`` valid records as one array."""
    out = []
    for line in data.decode("utf-8", "replace").splitlines():
        try:
            if line.strip():
                value = json.loads(line)
                json.dumps(value)  # what is nested too deeply to be written counts as invalid
                out.append(value)
        except (ValueError, RecursionError):
            continue
        if len(out) == most:
            break
    return json.dumps(out, indent=2, ensure_ascii=False)


def docx(data: bytes) -> str:
    """Paragraphs with headings marked, then all tables."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{W}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t"))
    out = []
    for p in body.findall(f"{W}p"):
        style = p.find(f"{W}pPr/{W}pStyle")
        name = style.get(f"{W}val", "") if style is not None else ""
        level = re.search(r"(\d+)$", name)
        mark = ("#" * int(level[1]) if level else "##") + " " if name.lower().startswith("heading") else ""
        if words(p).strip():
            out.append(mark + words(p).strip())
    for i, t in enumerate(body.findall(f"{W}tbl"), 1):
        rows = [[words(c).strip() for c in r.findall(f"{W}tc")] for r in t.findall(f"{W}tr")]
        out.append("\n".join([f"[TABELLA {i}]", *("| " + " | ".join(r) + " |" for r in rows)]))
    return "\n\n".join(out)


def _run(command: list[str], data: bytes) -> str:
    return subprocess.run(command, input=data, capture_output=True, timeout=60, check=True).stdout.decode("utf-8", "replace")


def pdf(data: bytes) -> str:
    """Text by page; pages come under ``--- Pagina i ---``.  Short results are tried again with the layout tool."""
    text = ""
    try:
        from pypdf import PdfReader

        pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]
        text = "\n\n".join(f"--- Pagina {i} ---\n{t}" for i, t in enumerate(pages, 1))
        if sum(len(t.strip()) for t in pages) >= 200:
            return text
    except Exception:  # no parser, or one that a broken file got the better of: the tool may still read it
        pass
    try:
        return _run(["pdftotext", "-layout", "-", "-"], data) or text
    except (OSError, subprocess.SubprocessError):
        if text:
            return text
        raise


def kind(ext: Column) -> Column:
    """How a file with this extension (any case) is read: text, table, json, lines, pdf, docx, pandoc, or unknown."""
    known = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.coalesce(F.element_at(known, F.lower(ext)), F.lit("unknown"))


def _docx_or_pandoc(data: bytes) -> str:
    try:
        return docx(data)
    except Exception:  # whatever is wrong with the archive or its XML
        return _run(["pandoc", "-f", "docx", "-t", "plain", "--wrap=none"], data)


def extract(ext: str, data: bytes) -> tuple[str, str | None]:
    """(text, error) of one file; a file's fault is its own error and no one else's."""
    how = KINDS.get(ext)
    try:
        if how == "text":
            return data.decode("utf-8", "replace"), None
        if how == "table":
            return pipe_table(data, "\t" if ext == ".tsv" else ","), None
        if how in ("json", "lines", "pdf", "docx"):
            return {"json": pretty_json, "lines": json_lines, "pdf": pdf, "docx": _docx_or_pandoc}[how](data), None
        text = _run(["pandoc", "-f", ext[1:] or "markdown", "-t", "plain", "--wrap=none"], data)
        return text, None if how else f"unknown extension {ext}"
    except Exception as e:
        return "", f"{type(e).__name__}: {e}"


def resolve_paths(spark: SparkSession, paths: list[str]) -> tuple[list[tuple[str, str | None]], list[str]]:
    """(found, missing): files and folders that the paths and globs name, each once, and the paths that name none.

    ``**`` matches folders of any depth; such a path comes with the pattern that its files match.  What lies in a
    folder that is named as well is left to it.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: dict[str, str | None] = {}
    missing = []
    for path in paths:
        base, pattern = path, None
        if "**" in path:
            base = path[: path.index("**")].rstrip("/") or "/"
            pattern = path
        where = jvm.org.apache.hadoop.fs.Path(base)
        fs = where.getFileSystem(conf)
        try:
            got = [x.getPath() for x in (fs.globStatus(where) or [])]
        except Py4JJavaError:  # no glob: a name with brackets
            got = []
        if not got and fs.exists(where):
            got = [where]
        if not got:
            missing.append(path)
        for x in got:
            name = fs.makeQualified(x).toString()
            if name not in found or found[name] is not None:
                found[name] = pattern
    inside = lambda a, b: a.startswith(b.rstrip("/") + "/")
    whole = [x for x, pattern in found.items() if pattern is None]
    return [(x, p) for x, p in found.items() if not any(inside(x, y) for y in whole)], missing


def glob_pattern(glob: str) -> str:
    """A regular expression for paths that end as a glob with ``**`` says."""
    out = []
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", glob.lstrip("/")):
        out.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.sub(r"([\\.^$|+(){}\[\]])", r"\\\1", part))
    return "(?:^|/)" + "".join(out) + "$"


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc_ord, path, ext, content) of files, globs and folders, each once, ordered by path.

    Paths that name nothing are told by a warning and left out; files of no bytes have no row.  Ordinals are dealt over the paths alone;
    contents are read once and are not shuffled where the paths are few enough to go to every task.
    """
    found, missing = resolve_paths(spark, paths)
    for path in missing:
        warnings.warn(f"no such file: {path}", stacklevel=2)
    plain = [x for x, pattern in found if pattern is None]
    by_pattern = [(x, pattern) for x, pattern in found if pattern]
    if not found:
        return spark.createDataFrame([], "doc_ord long, path string, ext string, content binary")
    load = lambda *names: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(names)).select("path", "content")
    files = load(*plain) if plain else None
    for x, pattern in by_pattern:
        own = load(x).where(F.col("path").rlike(glob_pattern(pattern)))
        files = own if files is None else files.unionByName(own)
    # only a path under a pattern can be found twice; which files there are is known without their contents
    order = numbered(files.select("path").distinct(), ["path"]).select(F.col("path").alias("_path"), F.col("ord").alias("doc_ord"))
    if by_pattern and len(found) > 1:
        files = files.dropDuplicates(["path"])
    if order.count() <= BROADCAST_ROWS:
        order = F.broadcast(order)
    return files.join(order, F.col("path") == F.col("_path")).select("doc_ord", "path", suffix(F.col("path")).alias("ext"), "content")


def texts(files: DataFrame) -> DataFrame:
    """(doc_ord, name, text, error) of files with ``ext`` and ``content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract((e or "").lower(), c or b"") for e, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for t, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=["doc_ord", "name", "text", "error"])

    return files.select(F.col("doc_ord").cast("long"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "ext", "content").mapInArrow(run, "doc_ord long, name string, text string, error string")


def not_blank(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.where(F.col(text_col).rlike(r"(?U)\S"))


def graphs_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graphs, bad): graph files as (doc_ord, graph_ord, json), and the paths of those that hold no graph object; bytes that are no UTF-8 are replaced."""
    made = files.select("doc_ord", "path", F.make_valid_utf8(F.col("content").cast("string")).alias("json"))
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json("json")).startswith("OBJECT"), F.lit(False))
    return made.where(ok).select("doc_ord", F.lit(0).cast("long").alias("graph_ord"), "json"), made.where(~ok).select("path")


def read_graphs(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """``graphs_of`` the files, globs and folders of ``paths``."""
    return graphs_of(read_files(spark, paths))
