"""WARC and TIFF: files not written by the package, hostile files, and archives read in splits."""

import gzip
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import bpe, gru, lm, tiff, warc, windows


# ------------------------------------------------------------ 9
def test_published_examples_of_packed_bytes():
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")
    plain = bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22" + " AA" * 10)
    assert tiff.unpack_bits(packed) == plain
    # the specification's example of LZW: 7 7 7 8 8 7 7 6 6
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    coded = int(bits.ljust(88, "0"), 2).to_bytes(11)
    assert tiff.un_lzw(coded) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) == tiff.un_lzw(tiff.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])))


def _file(order, pages):
    """A file put together by hand: pages are lists of (tag, kind, values) with blocks of data given first."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for tags, blocks in pages:
        at = []
        for b in blocks:
            at.append(len(out))
            out += b + b"\0" * (len(b) & 1)
        entries = b""
        for tag, kind, values in sorted(tags):
            values = at if values == "offsets" else [len(b) for b in blocks] if values == "counts" else values
            raw = struct.pack(f"{order}{len(values)}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", *values)
            if len(raw) > 4:
                raw, where = struct.pack(order + "I", len(out)), raw
                out += where + b"\0" * (len(where) & 1)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
def test_files_by_hand(order):
    grey = [(256, 3, [5]), (257, 3, [2]), (258, 3, [8]), (262, 3, [1]), (278, 3, [1]), (273, 4, "offsets"), (279, 4, "counts")]
    first = (grey + [(259, 3, [32773])], [b"\xfc\x07", b"\x04abcde"])  # a run of 5, then 5 literals
    planes = [(256, 3, [2]), (257, 3, [1]), (258, 3, [8, 8, 8]), (262, 3, [2]), (277, 3, [3]), (284, 3, [2]), (317, 3, [2]), (259, 3, [8]), (278, 3, [1]), (273, 4, "offsets"), (279, 4, "counts")]
    second = (planes, [zlib.compress(bytes([10, 1])), zlib.compress(bytes([20, 255])), zlib.compress(bytes([30, 0]))])
    tiles = [(256, 4, [3]), (257, 4, [2]), (258, 3, [8]), (259, 3, [1]), (322, 3, [2]), (323, 3, [2]), (324, 4, "offsets"), (325, 4, "counts")]
    third = (tiles, [b"abde", b"c\0f\0"])
    got = list(tiff.read(_file(order, [first, second, third])))
    assert [p.data for p in got] == [b"\x07" * 5 + b"abcde", bytes([10, 20, 30, 11, 19, 30]), b"abcdef"]


def _faulty():
    base = {256: (4, [4]), 257: (4, [4]), 258: (3, [8]), 259: (3, [1]), 278: (4, [4]), 273: (4, "offsets"), 279: (4, "counts")}
    for change in ({256: (4, [])}, {278: (4, [])}, {258: (3, [])}, {256: (4, [1 << 31]), 257: (4, [1 << 31])}, {256: (4, [0])}, {278: (4, [0])}, {259: (3, [7])}, {277: (3, [0])}, {317: (3, [3])}, {273: (4, [])}, {322: (4, [1]), 323: (4, [1 << 30]), 324: (4, [8]), 325: (4, [16])}, {322: (4, [0]), 323: (4, [0]), 324: (4, [8]), 325: (4, [16])}):
        tags = base | change
        yield _file("<", [([(t, k, v) for t, (k, v) in tags.items()], [b"x" * 16])])
    bomb = zlib.compress(bytes(1 << 22))
    yield _file("<", [([(256, 4, [1 << 16]), (257, 4, [1 << 16]), (259, 3, [8]), (273, 4, "offsets"), (279, 4, "counts")], [bomb])])
    # directories that overlap each other
    chain = bytearray(b"II*\0\x08\0\0\0" + b"\x05\0" * 400)
    yield bytes(chain)


def test_hostile_files_are_error_rows(spark):
    r = random.Random(4)
    good = [tiff.write([np.frombuffer(r.randbytes(40 * 30), np.uint8).reshape(40, 30)], how, p, 7, tile) for how in (1, 5, 8, 32773) for p in (1, 2) for tile in (None, (16, 16))]
    broken = []
    for g in good:
        for _ in range(40):
            b = bytearray(g)
            for _ in range(r.randrange(1, 6)):
                b[r.randrange(len(b))] = r.randrange(256)
            broken.append(bytes(b[: r.randrange(1, len(b) + 1)]) if r.random() < 0.3 else bytes(b))
    for data in [*_faulty(), *broken]:
        try:
            list(tiff.read(data))
        except tiff.TiffError:
            pass
    rows = [(i, d) for i, d in enumerate([*_faulty(), good[0]])]
    got = tiff.explode(spark.createDataFrame([*rows, rows[0], (None, None)], "id long, data binary"), "id", "data").collect()
    last = len(rows) - 1
    assert {x["id"] for x in got if x["error"] is None} >= {last} and len([x for x in got if x["id"] == 0]) == 2
    assert all(x["error"] for x in got if x["id"] not in (None, last, 1))  # without rows a strip there is one strip
    assert tiff.explode(spark.createDataFrame([], "id long, data binary"), "id", "data").count() == 0


def test_texts_are_stored_in_all_ways():
    texts = [f"text {i} ".encode() * (i + 1) for i in range(60)]
    seen = Counter()
    for t in texts:
        pages = list(tiff.read(tiff.store(t)))
        assert b"".join(p.data for p in pages).startswith(t) and tiff.store(t) == tiff.store(bytes(t))
        seen[pages[0].compression] += 1
    assert set(seen) == {tiff.DEFLATE, tiff.LZW, tiff.PACKBITS}


# ------------------------------------------------------------ 3
def _archive(n):
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Folded: one\r\n  two\r\n\r\n"
    out = [(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Length: 4\r\n\r\ninfo\r\n\r\n")]
    for i in range(n):
        block = (http + f"<title>T{i}</title><p>caf\xe9 {'x' * (i * 37 % 900)}").encode("latin-1")
        out.append(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://h/{i}\r\nWARC-Record-ID: <urn:{i}>\r\nWARC-IP-Address: 10.0.0.{i}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
    return out


def test_archives_are_read_in_splits(spark, tmp_path):
    parts = _archive(200)
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    inner = b"HTTP/1.1 200 OK\r\n\r\n\r\n\r\nWARC/1.1\r\nquoted\r\n\r\n\r\n\r\nWARC/1.0 again"
    (tmp_path / "c.warc").write_bytes(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:q>\r\nContent-Length: {len(inner)}\r\n\r\n".encode() + inner + b"\r\n\r\n" + parts[1] + parts[2][:-9])
    (tmp_path / "d.warc").write_bytes(b"")
    (tmp_path / "e.warc").write_bytes(b"no archive")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        read = warc.read_archives(spark, [str(tmp_path)])
        rows = read.collect()
        assert read.rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by = {}
    for r in rows:
        by.setdefault(r["file"].rsplit("/", 1)[1], []).append(r)
    want = [(h, b) for h, b, _ in warc.parse(b"".join(parts))]
    for name in ("a.warc", "b.warc.gz"):
        key = lambda x: x[0].get("WARC-Record-ID")
        assert sorted(((dict(r["headers"]), bytes(r["block"])) for r in by[name]), key=key) == sorted(want, key=key) and not any(r["error"] for r in by[name])
    assert [(bytes(r["block"]) == inner, r["error"]) for r in by["c.warc"]] == [(True, None), (False, None), (False, "block cut off")]
    assert "d.warc" not in by and [r["error"] for r in by["e.warc"]] == ["no WARC header"]
    made = warc.derive_all(read).collect()
    assert len(made) == 2 * (200 + 200 + 2)


@pytest.mark.parametrize("split", [300, 4000, 100_000])
def test_quoted_records_are_no_records(spark, tmp_path, split):
    """Blocks that quote whole records, longer than a split: the chain of lengths tells them from records."""
    quoted = b"HTTP/1.1 200 OK\r\n\r\n" + b"".join(warc.record({"WARC-Type": "response", "WARC-Target-URI": "http://quoted/", "WARC-Record-ID": f"<urn:q{i}>"}, b"HTTP/1.1 200 OK\r\n\r\nforged") for i in range(100))
    blocks = [b"HTTP/1.1 200 OK\r\n\r\nfirst", quoted, b"HTTP/1.1 200 OK\r\n\r\nlast", quoted[:-4] + b"x" * 5000, b""]
    data = b"".join(warc.record({"WARC-Type": "response", "WARC-Target-URI": f"http://x/{i}", "WARC-Record-ID": f"<urn:{i}>"}, b) for i, b in enumerate(blocks))
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "cut.warc").write_bytes(data[: len(data) // 2])
    (tmp_path / "z.warc.gz").write_bytes(gzip.compress(data))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        rows = warc.read_archives(spark, [str(tmp_path)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by = lambda name: sorted((dict(r["headers"])["WARC-Target-URI"], bytes(r["block"]), r["error"]) for r in rows if r["file"].endswith(name))
    want = [(f"http://x/{i}", b, None) for i, b in enumerate(blocks)]
    assert by("/a.warc") == want == by("/z.warc.gz")
    half = list(warc.parse(data[: len(data) // 2]))
    assert by("/cut.warc") == sorted((h["WARC-Target-URI"], b, e) for h, b, e in half) and half[-1][2] == "block cut off"


def test_metadata_has_all_source_headers(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"".join(_archive(3)))
    made = [r for r in warc.derive_all(warc.read_archives(spark, [str(tmp_path)])).collect() if r["refers_to"] == "<urn:1>"]
    meta = next(bytes(r["record"]).decode() for r in made if r["warc_type"] == "metadata")
    for line in ("source-warc-header: WARC-IP-Address: 10.0.0.1", "source-http-header: Set-Cookie: a=1", "source-http-header: Set-Cookie: b=2", "source-http-header: X-Folded: one two", "charset: latin-1", "title: T1", "http-status: 200"):
        assert f"\r\n{line}\r\n" in meta, line
    text = next(bytes(r["record"]).decode() for r in made if r["warc_type"] == "conversion")
    assert "café xxx" in text and f"WARC-Refers-To: <urn:1>" in text


def test_warc_awkward_tables(spark):
    t = spark.createDataFrame([(1, "http://a/" + "x" * 5000, "<p>" + "y" * 200_000)] * 2 + [(None, None, None)], "page_id long, url string, html string")
    rows = warc.derivatives(t).collect()
    assert Counter(r["page_id"] for r in rows) == {1: 4, None: 2} and len({bytes(r["record"]) for r in rows}) == 4
    files = spark.createDataFrame([], "id long, data binary")
    assert warc.records(files, "id", "data").count() == 0


# ------------------------------------------------------------ 6
def _loss(w, first, texts, end):
    return -gru.score(w, first, texts, end, n_lanes=1, width=10_000).sum() * np.log(10)


def test_gradients_are_those_of_finite_differences():
    """One step over one window with a memory so large that the step is the gradient alone."""
    rng = np.random.default_rng(3)
    first = gru.classes(np.array([9.0, 5, 4, 3, 2, 1, 1]), 3)
    w = {k: v.astype(np.float64) for k, v in gru.start(np.array([9.0, 5, 4, 3, 2, 1, 1]), first, 5).items()}
    w = {k: v + rng.normal(0, 0.2, v.shape) for k, v in w.items()}
    texts, end = [np.r_[rng.integers(0, 6, 9), 6], np.r_[rng.integers(0, 6, 4), 6]], 6
    n, big = sum(map(len, texts)), 1e12
    f32 = {k: v.astype(np.float32) for k, v in w.items()}
    after, _ = gru.train(f32, first, texts, end, {k: np.full_like(v, big) for k, v in f32.items()}, n_lanes=1, width=10_000, rate=np.float32(big**0.5))
    for k in w:
        grad = (f32[k].astype(np.float64) - after[k]) * n
        flat = rng.choice(w[k].size, min(12, w[k].size), replace=False)
        for i in flat:
            up, down = ({a: b.copy() for a, b in w.items()} for _ in range(2))
            up[k].ravel()[i] += 1e-2
            down[k].ravel()[i] -= 1e-2
            want = (_loss({a: b.astype(np.float32) for a, b in up.items()}, first, texts, end) - _loss({a: b.astype(np.float32) for a, b in down.items()}, first, texts, end)) / 2e-2
            assert abs(grad.ravel()[i] - want) < 0.02 + 0.02 * abs(want), (k, i, grad.ravel()[i], want)


# ------------------------------------------------------------ memories
def test_memories_are_bounded_by_bytes():
    from graphloom.llm.queries import vocabulary

    c = bpe.codec(vocabulary())
    c.encode([f"{i}" * 40_000 for i in range(40)])
    before = c.held
    c.held = bpe.MEMORY_BYTES + 1
    c.encode(["a"])
    assert before > 1_000_000 and c.held < 1_000 and len(c.memo) == 1
    windows.word_hashes([b"x" * 65, b"y"])
    assert b"x" * 65 not in windows._known and b"y" in windows._known
    codes = lm._Codes([b""])
    for i in range(4):
        codes[bytes([i + 65]) * (10 << 20)]
    assert codes.trim() and not codes.trim() and len(codes) == 1
