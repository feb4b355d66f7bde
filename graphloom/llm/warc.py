"""WARC 1.1 records, and a builder that derives metadata and plain text from responses.

Each response gives two linked records: a metadata record (warc-fields: HTTP
status, content type, charset, title, links, text length, and all WARC and HTTP headers of the source)
and a conversion record (the plain text).  Both refer to the response by its id and carry its target URI,
date and digests; record ids are derived from their content, so a task that runs
again writes the same bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html import plain_text
from .words import refuse, slices

VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
CHARSET = re.compile(r"charset=[\"']?([\w-]+)", re.I)
TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
LINK = re.compile(r"<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
FIELD = re.compile(r"[\r\n]+\s*")
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space for URLs


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """An id that depends on nothing but its parts."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(map(str, parts)))}>"


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {FIELD.sub(' ', v)}".encode() for k, v in headers.items()), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + END + block + END


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers, block, error) of each record of a plain or gzipped file; what is cut off comes with an error."""
    if data[:2] == b"\x1f\x8b":
        try:
            data = gzip.decompress(data)
        except (OSError, EOFError) as e:
            yield {}, b"", f"gzip: {e}"
            return
    at = 0
    while at < len(data):
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(END, at)
        if not data.startswith(b"WARC/", at) or end < 0:
            yield {}, data[at:], "no WARC header"
            return
        headers: dict[str, str] = {}
        last = None
        for line in data[at:end].split(b"\r\n")[1:]:
            text = line.decode("utf-8", "replace")
            if text[:1] in (" ", "\t") and last:
                headers[last] += " " + text.strip()
            elif ":" in text:
                last, value = (x.strip() for x in text.split(":", 1))
                headers[last] = value
        size = next((v for k, v in headers.items() if k.lower() == "content-length"), "")
        if not size.isdigit():
            yield headers, b"", "no Content-Length"
            return
        block = data[end + 4 : end + 4 + int(size)]
        yield headers, block, None if len(block) == int(size) else "block cut off"
        at = end + 4 + int(size)


def split_http(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """Status, headers in order and body of an HTTP response; without a status line all is body."""
    if not block.startswith(b"HTTP/"):
        return None, [], block
    head, _, body = block.partition(END)
    first, *rest = head.decode("latin-1").split("\r\n")
    status = first.split(" ")[1] if " " in first else ""
    pairs: list[tuple[str, str]] = []
    for line in rest:
        if line[:1] in (" ", "\t") and pairs:
            pairs[-1] = (pairs[-1][0], pairs[-1][1] + " " + line.strip())
        else:
            k, _, v = line.partition(":")
            pairs.append((k.strip(), v.strip()))
    return int(status) if status.isdigit() else None, pairs, body


def response(url: str | None, html: str | None, date: str, *key: object) -> tuple[dict[str, str], bytes]:
    """A response record's headers and block for a fetched page."""
    body = (html or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + END + body
    return {"WARC-Type": "response", "WARC-Record-ID": record_id("response", url, date, *key), "WARC-Target-URI": url or "", "WARC-Date": date, "Content-Type": "application/http; msgtype=response", "WARC-Block-Digest": digest(block), "WARC-Payload-Digest": digest(body)}, block


def derive(headers: dict[str, str], block: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The metadata and conversion records of a response; other records give none."""
    h = {k.lower(): v for k, v in headers.items()}
    if h.get("warc-type") != "response":
        return []
    status, sent, body = split_http(block)
    http = {k.lower(): v for k, v in reversed(sent)}
    named = CHARSET.search(http.get("content-type", "")) or CHARSET.search(body[:1024].decode("latin-1"))
    charset = named[1].lower() if named else "utf-8"
    try:
        page = body.decode(charset, "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    source, url, date = h.get("warc-record-id", ""), h.get("warc-target-uri", ""), h.get("warc-date", "")
    text = plain_text(page).encode()
    title = TITLE.search(page)
    fields = {"http-status": str(status or ""), "http-content-type": http.get("content-type", ""), "charset": charset, "title": FIELD.sub(" ", title[1]).strip() if title else "", "source-block-digest": h.get("warc-block-digest") or digest(block), "source-payload-digest": h.get("warc-payload-digest") or digest(body), "source-length": str(len(block)), "text-length": str(len(text)), "links": str(sum(1 for _ in LINK.finditer(page)))}
    # all headers of the source, one line each in their order
    kept = [*(("source-warc-header", f"{k}: {v}") for k, v in headers.items()), *(("source-http-header", f"{k}: {v}") for k, v in sent)]
    about = b"".join(f"{k}: {FIELD.sub(' ', v)}\r\n".encode() for k, v in [*fields.items(), *kept])
    link = {"WARC-Target-URI": url, "WARC-Date": date, "WARC-Refers-To": source, "WARC-Refers-To-Target-URI": url, "WARC-Refers-To-Date": date}
    if "warc-warcinfo-id" in h:
        link["WARC-Warcinfo-ID"] = h["warc-warcinfo-id"]
    conversion = record_id("conversion", source, digest(text))
    return [
        ({"WARC-Type": "metadata", "WARC-Record-ID": record_id("metadata", source, digest(about)), **link, "WARC-Concurrent-To": conversion, "Content-Type": "application/warc-fields", "WARC-Block-Digest": digest(about)}, about),
        ({"WARC-Type": "conversion", "WARC-Record-ID": conversion, **link, "WARC-Source-Payload-Digest": fields["source-payload-digest"], "Content-Type": "text/plain; charset=utf-8", "WARC-Block-Digest": digest(text), "WARC-Payload-Digest": digest(text)}, text),
    ]


NAMES = ["warc_type", "record_id", "refers_to", "target_uri", "content_type", "source_digest", "block_digest", "content_length", "record"]
KINDS = [pa.string()] * 7 + [pa.int64(), pa.binary()]


def _row(h: dict[str, str], data: bytes, source_digest: str) -> tuple:
    """The columns ``NAMES`` of a derived record."""
    return h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Target-URI"], h["Content-Type"], source_digest, h["WARC-Block-Digest"], len(data), record(h, data)


def derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Two rows per page, ``NAMES`` with the record's bytes: the records derived from its response.

    Null urls give an empty target URI, null html an empty body.  Record ids are
    made from the id, url and date, so repeated rows give equal records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, out = [], []
            for i, (key, url, html) in enumerate(zip(*(c.to_pylist() for c in b.columns))):
                headers, block = response(url, html.decode("utf-8", "replace"), date, key)
                for h, data in derive(headers, block):
                    row.append(i)
                    out.append(_row(h, data, headers["WARC-Payload-Digest"]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(zip(*out), KINDS))], names=[id_col, *NAMES])

    refuse((id_col,), NAMES)
    source = pages.select(f"`{id_col}`", F.col(f"`{url_col}`").alias("_u"), F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b"")).alias("_b"))
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, warc_type string, record_id string, refers_to string, target_uri string, content_type string, source_digest string, block_digest string, content_length long, record binary")


def records(files: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """One row per record of WARC files in cells: ``id_col``, number, headers map, block, error.

    A null or empty file has no rows.  A broken record comes with an ``error`` and ends its file.  Repeated rows
    are read one by one.  Archives of any size are read by ``read_archives``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for i, data in enumerate(b.column(1).to_pylist()):
                for number, (headers, block, error) in enumerate(parse(data)):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([number], pa.int32()), pa.array([list(headers.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary()), pa.array([error], pa.string())], names=[id_col, "number", "headers", "block", "error"])

    source = files.select(f"`{id_col}`", F.coalesce(F.col(f"`{data_col}`").cast("binary"), F.lit(b"")).alias("_b"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, number int, headers map<string,string>, block binary, error string")


SEPARATOR, CUT = END + b"WARC/1.", len(b"WARC/1.")
SIZE = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", re.I)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """(key, pieces) of each split in a task; the key is all columns but the last, which its rows share."""
    rows = ((key, piece) for b in batches for part in slices([b]) for *key, piece in zip(*(c.to_pylist() for c in part.columns)))
    row = next(rows, None)
    while row:
        first = row[0]

        def own() -> Iterator[bytes]:
            nonlocal row
            while row and row[0] == first:
                yield row[1]
                row = next(rows, None)

        yield tuple(first), own()


def _starts(pieces: Iterator[bytes], first: bool) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of each piece of a split, from the place of the first; with the start of the record that it may be.

    ``first``: the split begins the file, whose first piece has no separator before it.
    """
    at = 0
    for i, piece in enumerate(pieces):
        if first and not i:
            yield 0, piece
        else:
            yield at - CUT, SEPARATOR[len(END) :] + piece
        at += len(piece) + len(SEPARATOR)
    yield at - CUT, b""  # where the next split's first piece begins


def _next(data: bytes, at: int) -> int:
    """Where the next record begins, if one does with ``data`` at ``at`` and is as long as it says."""
    head = data.find(END)
    size = SIZE.search(data, 0, head + 2) if head >= 0 else None
    return at + head + len(END) + int(size[1]) + len(END) if size else at + 1


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, headers map, block, error) of all records of WARC 1.x files, plain or compressed.

    Files are read by Spark's text source with the end of a record as line separator: large plain files are
    split over tasks, compressed ones are streamed, and a task holds a record at a time.  Where the separator stands a record may begin or a
    block may quote one.  A first reading gives each such place and the one that its declared length leads to; following these from the
    first on tells which are records, a row for each place and file in one task.  Records that lie over splits come in pieces, which are put together.
    A record that is cut off or has no header comes with an ``error``.  Files without bytes have no row; no file is an error of Spark's.
    """
    read = spark.read.option("lineSep", SEPARATOR.decode()).text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("_b"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, split), own in _pieces(batches):
            rows = [(at, _next(piece, at) if piece else -1) for at, piece in _starts(own, split == 0) if piece.strip() or not piece]
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array([split] * len(rows), pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=["file", "split", "at", "to"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(file, split, base, first, open) of each split: where it begins, its first record, and the one before it that may go on."""
        file, rows = None, []
        for b in batches:
            for name, split, at, to in zip(*(c.to_pylist() for c in b.columns)):
                if name != file:
                    file, base, due, last = name, 0, 0, None
                    state = None
                if state is None:
                    state = [file, split, base, None, last]
                if to < 0:  # the end of a split
                    rows.append(state)
                    base, state = base + at + CUT, None
                elif base + at >= due:
                    last, due = base + at, base + to
                    state[3] = last if state[3] is None else state[3]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), *[pa.int64()] * 4))], names=["file", "split", "base", "first", "open"])
                rows = []

    chain = read.mapInArrow(places, "file string, split long, at long, to long").repartition("file").sortWithinPartitions("file", "split", "at", F.col("to").asc())
    splits = chain.mapInArrow(follow, "file string, split long, base long, first long, open long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, split, base, first, open_), own in _pieces(batches):
            held, start, due = b"", open_, None
            for at, piece in _starts(own, split == 0):
                at += base
                if piece and not piece.strip():
                    continue
                real = first is not None and at >= first and (due is None or at >= due)
                if (real or not piece) and held:
                    whole = due is not None and at >= due
                    yield _row_of(file, held, start, None if whole else start_at)
                    held = b""
                if not piece:
                    break
                if real:
                    held, start, start_at, due = piece, at, at, _next(piece, at)
                elif held:
                    held += END + piece
                else:  # goes on with a record that began before
                    held, start_at = END + piece, at

    kind = "file string, record long, at long, data binary"
    pieces = read.join(F.broadcast(splits), ["file", "split"]).select("file", "split", "base", "first", "open", "_b").mapInArrow(cut, kind)
    over = pieces.where("at IS NOT NULL").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("at", "data"))).alias("p")).select("file", F.col("p.data").alias("data"))
    whole = pieces.where("at IS NULL").select("file", F.array("data").alias("data"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1)):
                headers, block, error = next(parse(b"".join(data.as_py())), ({}, b"", "no WARC header"))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([list(headers.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary()), pa.array([error], pa.string())], names=["file", "headers", "block", "error"])

    return whole.unionByName(over).mapInArrow(records, "file string, headers map<string,string>, block binary, error string")


def _row_of(file: str, data: bytes, record: int | None, at: int | None) -> pa.RecordBatch:
    """A record, or with ``at`` a piece of one."""
    return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([record], pa.int64()), pa.array([at], pa.int64()), pa.array([data], pa.binary())], names=["file", "record", "at", "data"])


def derive_all(archive: DataFrame) -> DataFrame:
    """(file, ``NAMES``): the derived records of the responses among ``archive``, rows of ``read_archives``; other records and faults give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, out = [], []
            for i, (headers, block) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                source = dict(headers or [])
                for h, data in derive(source, block):
                    row.append(i)
                    out.append(_row(h, data, source.get("WARC-Payload-Digest") or digest(split_http(block)[2])))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(NAMES), KINDS))], names=["file", *NAMES])

    whole = archive.where("error IS NULL").select("file", "headers", F.col("block").alias("_b"))
    return whole.mapInArrow(run, "file string, warc_type string, record_id string, refers_to string, target_uri string, content_type string, source_digest string, block_digest string, content_length long, record binary")
