"""TIFF pages: a writer, and a reader that walks image directories.

The reader takes either byte order, strips and tiles, 8-bit samples (any number
per pixel, interleaved or in planes), compression none, LZW, PackBits or deflate, and the
horizontal predictor, and gives one row per page.  The writer makes strips or
tiles with the same choices.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import refuse, slices, with_bytes

# Fixed values of the TIFF 6.0 specification.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, DEFLATE_OLD = 1, 5, 8, 32773, 32946
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
LZW_CLEAR, LZW_END = 256, 257
#: Codes that can follow a clear code before the table is full.
LZW_MOST = 4096 - 256


class TiffError(ValueError):
    """The file breaks the format or uses what is not supported."""


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    data: bytes


# ------------------------------------------------------------ compression
def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    """The unpacked bytes, up to the run that reaches ``most``."""
    out, at = bytearray(), 0
    while at < len(data) and (most is None or len(out) < most):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three bytes and more as runs, what is between them as it is."""
    x = np.frombuffer(data, np.uint8)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(x)])
    out, done = bytearray(), 0

    def plain(upto: int) -> None:
        for i in range(done, upto, 128):
            part = data[i : min(i + 128, upto)]
            out.append(len(part) - 1)
            out.extend(part)

    for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        plain(at)
        done = at + n
        while n > 1:
            k = min(n, 128)
            out += bytes([257 - k, data[at]])
            n -= k
        if n:
            out += bytes([0, data[at]])
    plain(len(data))
    return bytes(out)


def _widths(n: int, early: int) -> np.ndarray:
    """Bits of the first n codes after a clear code, when ``early`` entries are there before the first."""
    size = np.arange(early, early + n)
    return 9 + (size >= 512) + (size >= 1024) + (size >= 2048).astype(np.int64)


def un_lzw(data: bytes, most: int | None = None) -> bytes:
    """TIFF's LZW: codes from the high bit down, a code longer one entry early; up to the code that reaches ``most``."""
    # a byte and the two after it as one number, to cut codes from
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    wide = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]
    start, bits, out = 0, 8 * len(data), bytearray()
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    while True:
        # all codes up to the next clear code, as if there were one after a full table
        width = _widths(LZW_MOST, 258)
        at = start + np.cumsum(width) - width
        width, at = width[at + width <= bits], at[at + width <= bits]
        codes = wide[at >> 3] >> (24 - (at & 7) - width) & ((1 << width) - 1)
        stop = np.flatnonzero((codes == LZW_CLEAR) | (codes == LZW_END))
        n = int(stop[0]) if len(stop) else len(codes)
        table, last = list(single), b""
        add = table.append
        for code in codes[:n].tolist():
            if not last:
                if code >= 256:
                    raise TiffError("LZW: a string code comes first")
                last = table[code]
                out += last
            else:
                if code > len(table):
                    raise TiffError("LZW: a code before its entry")
                entry = table[code] if code < len(table) else last + last[:1]
                add(last + entry[:1])
                out += entry
                last = entry
            if most is not None and len(out) >= most:
                return bytes(out)
        if not len(stop) and len(codes) == LZW_MOST:
            raise TiffError("LZW: no clear code")
        if not len(stop) or codes[n] == LZW_END:
            return bytes(out)
        start = int(at[n] + width[n])


def lzw(data: bytes) -> bytes:
    """TIFF's LZW; a clear code comes before the table would need codes of 13 bits."""
    codes: list[int] = []
    sections = []  # codes from one clear code to the next, that one included
    table: dict[int, int] = {}
    get, size, word = table.get, 258, -1
    for c in data:
        if word < 0:
            word = c
            continue
        key = word << 8 | c
        known = get(key)
        if known is not None:
            word = known
            continue
        codes.append(word)
        table[key] = size
        size += 1
        word = c
        if size == 4094:
            sections.append([*codes, LZW_CLEAR])
            table.clear()
            codes, size = [], 258
    sections.append([*codes, *([word] if word >= 0 else []), LZW_END])
    values = np.array([LZW_CLEAR, *(x for s in sections for x in s)], np.int64)
    width = np.concatenate([[9], *(_widths(len(s), 258) for s in sections)])
    bit = np.unpackbits(values.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)
    return np.packbits(bit[np.arange(16) >= 16 - width[:, None]]).tobytes()


def compress(data: bytes, how: int, level: int = 1) -> bytes:
    if how == NONE:
        return data
    if how == LZW:
        return lzw(data)
    if how == PACKBITS:
        return pack_bits(data)
    if how in (DEFLATE, DEFLATE_OLD):
        return zlib.compress(data, level)
    raise TiffError(f"compression {how}")


def decompress(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        out = data
    elif how == LZW:
        out = un_lzw(data, size)
    elif how == PACKBITS:
        out = unpack_bits(data, size)
    elif how in (DEFLATE, DEFLATE_OLD):
        try:
            out = zlib.decompressobj().decompress(data, size) if size else b""
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from None
    else:
        raise TiffError(f"compression {how}")
    if len(out) < size:
        raise TiffError(f"{len(out)} bytes where {size} are due")
    return out[:size]


# ------------------------------------------------------------ writing
def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 64, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian file of 8-bit pages, each (height, width) or (height, width, samples)."""
    out, link = bytearray(struct.pack("<2sHI", b"II", 42, 0)), 4
    for image in pages:
        image = np.ascontiguousarray(image if image.ndim == 3 else image[:, :, None], np.uint8)
        high, wide, samples = image.shape
        if tile:
            th, tw = tile
            padded = np.zeros((-(-high // th) * th, -(-wide // tw) * tw, samples), np.uint8)
            padded[:high, :wide] = image
            blocks = [padded[y : y + th, x : x + tw] for y in range(0, padded.shape[0], th) for x in range(0, padded.shape[1], tw)]
        else:
            blocks = [image[y : y + rows_per_strip] for y in range(0, high, rows_per_strip)]
        offsets, counts = [], []
        for b in blocks:
            if predictor == 2:
                b = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1)
            data = compress(b.tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) & 1)
        tags = {WIDTH: (4, [wide]), HEIGHT: (4, [high]), BITS: (3, [8] * samples), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if samples == 3 else 1]), SAMPLES: (3, [samples]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        tags |= {TILE_WIDTH: (4, [tile[1]]), TILE_HEIGHT: (4, [tile[0]]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, counts)} if tile else {ROWS_PER_STRIP: (4, [rows_per_strip]), STRIP_OFFSETS: (4, offsets), STRIP_COUNTS: (4, counts)}
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(f"<{len(values)}{TYPE_CODES[kind]}", *values)
            if len(raw) > 4:
                raw, at = struct.pack("<I", len(out)), raw
                out += at + b"\0" * (len(at) & 1)
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# ------------------------------------------------------------ reading
#: Bytes of samples that a page may have; larger ones are errors, as a few bytes can claim any size.
MOST_SAMPLES = 1 << 28


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """The image directories in order of their chain: (byte order, tag -> values)."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise TiffError("no TIFF header")
    at, seen, entries = struct.unpack(order + "I", data[4:8])[0], set(), 0
    try:
        while at:
            if at in seen:
                raise TiffError("the chain of directories loops")
            seen.add(at)
            (n,), tags = struct.unpack_from(order + "H", data, at), {}
            entries += n
            if 12 * entries > len(data):
                raise TiffError("directories overlap")
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                if kind in TYPE_CODES:
                    where = at + 10 + 12 * i
                    if TYPE_SIZES[kind] * count > 4:
                        where = struct.unpack_from(order + "I", data, where)[0]
                    if where + TYPE_SIZES[kind] * count > len(data):
                        raise TiffError(f"tag {tag} points past the end")
                    tags[tag] = list(struct.unpack_from(f"{order}{count}{TYPE_CODES[kind]}", data, where))
            yield order, tags
            at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    except struct.error:
        raise TiffError("a directory is cut off") from None


def read(data: bytes) -> Iterator[Page]:
    """The pages of a file; ``data`` holds the samples row by row, interleaved.

    Whatever a file claims, no more memory is taken than MOST_SAMPLES and the blocks allow; every fault is a ``TiffError``.
    """
    for number, (_, tags) in enumerate(directories(data)):
        one = lambda tag, default=None: (tags.get(tag) or [default])[0]
        wide, high, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        how, predictor, planar = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
        if wide is None or high is None:
            raise TiffError("no width or height")
        if min(wide, high, samples) < 1:
            raise TiffError(f"a page of {wide} x {high} x {samples} samples")
        if wide * high * samples > MOST_SAMPLES:
            raise TiffError(f"a page of {wide * high * samples} samples")
        if any(b != 8 for b in tags.get(BITS) or [1]):
            raise TiffError("only 8-bit samples are supported")
        if predictor not in (1, 2):
            raise TiffError(f"predictor {predictor}")
        tiled = TILE_OFFSETS in tags
        bh, bw = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS_PER_STRIP, high), high), wide)
        offsets, counts = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, []), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS, [])
        planes, deep = (samples, 1) if planar == 2 else (1, samples)
        if bh < 1 or bw < 1 or bh * bw * deep > MOST_SAMPLES:
            raise TiffError(f"blocks of {bw} x {bh}")
        due = planes * -(-high // bh) * -(-wide // bw)
        if len(offsets) != due or len(counts) != due:
            raise TiffError(f"{len(offsets)} blocks where {due} are due")
        spots = ((p, y, x) for p in range(planes) for y in range(0, high, bh) for x in range(0, wide, bw))
        image = np.zeros((high, wide, samples), np.uint8)
        for (p, y, x), at, n in zip(spots, offsets, counts):
            rows = bh if tiled else min(bh, high - y)
            block = np.frombuffer(decompress(data[at : at + n], how, rows * bw * deep), np.uint8).reshape(rows, bw, deep)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            image[y : y + rows, x : x + bw, p : p + deep if planar == 2 else samples] = block[: high - y, : wide - x]
        yield Page(number, wide, high, samples, how, predictor, image.tobytes())


def explode(files: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """One row per page: ``id_col``, page, width, height, samples, compression, predictor, mean, pixels, error.

    A null or unreadable file, or one with a page above MOST_SAMPLES, gives one row with an ``error`` and null fields; pages
    before the fault are kept.  Repeated rows and null ids pass through; an empty table has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, out = [], []
            for i, data in enumerate(b.column(1).to_pylist()):
                try:
                    for p in read(data):
                        row.append(i)
                        mean = float(np.frombuffer(p.data, np.uint8).mean()) if p.data else None
                        out.append((p.number, p.width, p.height, p.samples, p.compression, p.predictor, mean, p.data, None))
                except TiffError as e:
                    row.append(i)
                    out.append((None,) * 8 + (str(e),))
            kinds = [pa.int32()] * 6 + [pa.float64(), pa.binary(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 9, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *columns], names=[id_col, *names])

    names = ["page", "width", "height", "samples", "compression", "predictor", "mean", "pixels", "error"]
    source = with_bytes(files, data_col, id_col)
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, page int, width int, height int, samples int, compression int, predictor int, mean double, pixels binary, error string")


#: Rows of samples on a page that ``store`` writes: longer payloads take more pages.
PAGE_ROWS = 512
UNIT = 192
#: Ways to store, by turns of the text's CRC-32: compression, predictor, tile.
WAYS = [(how, predictor, tile) for how, predictor in ((DEFLATE, 2), (LZW, 1), (PACKBITS, 1)) for tile in (None, (16, 64))]


def store(text: bytes) -> bytes:
    """A text as TIFF pages 192 samples wide, filled up with spaces to whole rows (one at least); equal texts are stored alike."""
    payload = text + b" " * (-len(text) % UNIT if text else UNIT)
    image = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    how, predictor, tile = WAYS[zlib.crc32(text) % len(WAYS)]
    return write([image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)], how, predictor, tile=tile)


def features(pages: list[Page]) -> str:
    """Pages, compression and predictor, rows, mean sample, distinct samples and the three commonest samples."""
    data = np.frombuffer(b"".join(p.data for p in pages), np.uint8)
    count = np.bincount(data, minlength=256)
    top = np.argsort(-count, kind="stable")[:3]
    kind = f"{pages[0].compression}/{pages[0].predictor}"
    return f"pages={len(pages)};stored={kind};rows={sum(p.height for p in pages)};mean={data.sum(dtype=np.int64) * 1000 // len(data)};distinct={int((count > 0).sum())};top={','.join(map(str, top))}"


def stored_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text stored as TIFF and read back: sizes and digests of both forms, and features of the pages read.

    Null texts count as empty; equal texts give equal values; repeated rows and
    null ids pass through; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in slices(batches):
            out = []
            for text in b.column(1).to_pylist():
                media = store(text)
                pages = list(read(media))
                payload = b"".join(p.data for p in pages)
                out.append((len(text), len(payload), sha(payload), zlib.crc32(payload[-16:]), len(media), sha(media), features(pages)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=[id_col, *names])

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    refuse((id_col,), names)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    source = with_bytes(docs, text_col, id_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
