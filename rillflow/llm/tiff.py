"""TIFF: walk the image directories of a binary column and emit one row per page.

Reads classic TIFF and BigTIFF in either byte order: strips and tiles, chunky and planar samples,
no compression, PackBits, LZW and deflate, horizontal and floating-point predictors, 1 to 64 bits per
sample. Samples come back row by row, little-endian, padding of the last strip or tile cut off.

Edge cases: a null or empty value gives no rows; bytes that are no TIFF give one row with page -1 and
`error`; a broken page gives a row with its number, its `error` and null samples, and the pages after
it are still read; a directory chain that loops ends at the first directory seen twice; repeated rows
give repeated pages. Columns of the input that clash with the output names are replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import tidied

# Fixed values of the TIFF 6.0 specification: tag numbers, bytes per field type, compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION = 256, 257, 258, 259, 270
STRIP_AT, SAMPLES, ROWS, STRIP_LEN, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_LEN, FORMAT = 317, 322, 323, 324, 325, 339
TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
RAW, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946

PAGE_FIELDS = [
    T.StructField("page", T.IntegerType()),
    T.StructField("width", T.LongType()),
    T.StructField("height", T.LongType()),
    T.StructField("samples_per_pixel", T.IntegerType()),
    T.StructField("bits", T.IntegerType()),
    T.StructField("compression", T.IntegerType()),
    T.StructField("predictor", T.IntegerType()),
    T.StructField("description", T.StringType()),
    T.StructField("samples", T.BinaryType()),
    T.StructField("error", T.StringType()),
]


def unpack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        head = data[i]
        i += 1
        if head < 128:
            out += data[i : i + head + 1]
            i += head + 1
        elif head > 128:
            out += data[i : i + 1] * (257 - head)
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, the rest as literals of up to 128 bytes."""
    out, i, begin, n = bytearray(), 0, 0, len(data)

    def literals(end: int) -> None:
        for k in range(begin, end, 128):
            piece = data[k : min(k + 128, end)]
            out.append(len(piece) - 1)
            out.extend(piece)

    while i < n:
        j = i + 1
        while j < n and data[j] == data[i] and j - i < 128:
            j += 1
        if j - i >= 3:
            literals(i)
            out.append(257 - (j - i))
            out.append(data[i])
            begin = j
        i = j
    literals(n)
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bit first, one code early when the width grows."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    entries, width, last, out = list(base), 9, None, []
    held, n_held = 0, 0
    for byte in data:
        held, n_held = (held << 8) | byte, n_held + 8
        while n_held >= width:
            n_held -= width
            code = held >> n_held
            held &= (1 << n_held) - 1
            if code == 256:
                entries, width, last = list(base), 9, None
                continue
            if code == 257:
                return b"".join(out)
            if last is None:
                piece = entries[code]
            elif code < len(entries):
                piece = entries[code]
                entries.append(last + piece[:1])
            elif code == len(entries):
                piece = last + last[:1]
                entries.append(piece)
            else:
                raise ValueError(f"LZW code {code} is not defined yet")
            out.append(piece)
            last = piece
            if len(entries) + 1 >= 1 << width and width < 12:
                width += 1
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    """The encoder that unlzw() reads."""
    out, held, n_held = bytearray(), 0, 0
    known, width = {bytes([i]): i for i in range(256)}, 9
    free = 258

    def put(code: int) -> None:
        nonlocal held, n_held
        held, n_held = (held << width) | code, n_held + width
        while n_held >= 8:
            n_held -= 8
            out.append(held >> n_held)
            held &= (1 << n_held) - 1

    put(256)
    run = b""
    for i in range(len(data)):
        longer = run + data[i : i + 1]
        if longer in known:
            run = longer
            continue
        put(known[run])
        known[longer] = free
        free += 1
        if free == 4094:
            put(256)
            known, width, free = {bytes([k]): k for k in range(256)}, 9, 258
        elif free + 1 > 1 << width:
            width += 1
        run = data[i : i + 1]
    if run:
        put(known[run])
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if n_held:
        out.append((held << (8 - n_held)) & 255)
    return bytes(out)


DECODERS = {RAW: bytes, PACKBITS: unpack_bits, LZW: unlzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}


def _undo_predictor(block: np.ndarray, predictor: int, samples: int, order: str, bits: int) -> np.ndarray:
    """block: rows x bytes of one strip or tile; gives the same shape, in file byte order."""
    if predictor == 1:
        return block
    rows = block.shape[0]
    if predictor == 2 and bits in (8, 16, 32, 64):
        kind = np.dtype(f"{order}u{bits // 8}")
        x = np.ascontiguousarray(block).view(kind).reshape(rows, -1, samples)
        return np.cumsum(x, axis=1, dtype=kind.newbyteorder("=")).astype(kind).reshape(rows, -1).view(np.uint8)
    if predictor == 3 and bits in (16, 32, 64):
        size = bits // 8
        x = np.cumsum(block.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, -1)
        x = x.transpose(0, 2, 1)  # high bytes first
        return np.ascontiguousarray(x if order == ">" else x[:, :, ::-1]).reshape(rows, -1)
    raise ValueError(f"predictor {predictor} with {bits} bits")


class Tiff:
    """Directories of one file; pages() yields a dict per page."""

    def __init__(self, data: bytes):
        self.data = data
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2], "")
        if not self.order or len(data) < 8:
            raise ValueError("no TIFF header")
        magic = self._read("H", 2)[0]
        if magic not in (42, 43):
            raise ValueError("no TIFF header")
        self.big = magic == 43
        self.first = self._read("Q", 8)[0] if self.big else self._read("I", 4)[0]

    def _read(self, kind: str, at: int, n: int = 1) -> tuple:
        return struct.unpack_from(f"{self.order}{n}{kind}", self.data, at)

    def _directory(self, at: int) -> tuple[dict[int, tuple], int]:
        word, step, inline = ("Q", 20, 8) if self.big else ("I", 12, 4)
        n = self._read("Q" if self.big else "H", at)[0]
        at += 8 if self.big else 2
        if at + n * step > len(self.data):
            raise ValueError("directory ends beyond the file")
        tags = {}
        for k in range(n):
            tag, kind = self._read("H", at, 2)
            count = self._read(word, at + 4)[0]
            if kind in TYPES:
                code, size = TYPES[kind]
                where = at + 4 + inline
                if size * count > inline:
                    where = self._read(word, where)[0]
                if where + size * count > len(self.data):
                    raise ValueError(f"tag {tag} ends beyond the file")
                tags[tag] = self.data[where : where + count] if kind == 2 else self._read(code, where, count)
            at += step
        return tags, self._read(word, at)[0]

    def pages(self) -> Iterator[dict]:
        at, seen, page = self.first, set(), 0
        while at and at not in seen:
            seen.add(at)
            row = {"page": page}
            try:
                tags, at = self._directory(at)
            except (ValueError, struct.error) as e:
                yield row | {"error": f"directory: {e}"}
                return
            try:
                row |= self._page(tags)
            except Exception as e:  # noqa: BLE001  any fault of a page is that page's result
                row["error"] = f"{type(e).__name__}: {e}"
            yield row
            page += 1

    def _page(self, tags: dict[int, tuple]) -> dict:
        one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
        w, h, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        bits, how, predictor = one(BITS, 1), one(COMPRESSION, RAW), one(PREDICTOR, 1)
        out = {"width": w, "height": h, "samples_per_pixel": samples, "bits": bits, "compression": how, "predictor": predictor}
        out["description"] = tags[DESCRIPTION].rstrip(b"\0").decode("utf-8", "replace") if DESCRIPTION in tags else None
        if not w or not h:
            raise ValueError("no width or height")
        if len(set(tags.get(BITS, (1,)))) > 1 or bits not in (1, 2, 4, 8, 16, 32, 64):
            raise ValueError("bits per sample")
        if how not in DECODERS:
            raise ValueError(f"compression {how}")
        apart = one(PLANAR, 1) == 2 and samples > 1
        planes, inner = (samples, 1) if apart else (1, samples)
        if TILE_AT in tags:
            bw, bh, starts, sizes = one(TILE_W), one(TILE_H), tags[TILE_AT], tags[TILE_LEN]
        else:
            bw, bh, starts, sizes = w, min(one(ROWS, h), h), tags[STRIP_AT], tags.get(STRIP_LEN)
        across, down = -(-w // bw), -(-h // bh)
        if len(starts) < across * down * planes:
            raise ValueError("strips or tiles are missing")
        line = (bw * inner * bits + 7) // 8
        keep = (w * inner * bits + 7) // 8
        image = np.zeros((planes, h, across * line if across > 1 else line), np.uint8)
        for k in range(planes * down * across):
            plane, rest = divmod(k, down * across)
            row, col = divmod(rest, across)
            tall = bh if TILE_AT in tags else min(bh, h - row * bh)
            size = sizes[k] if sizes else line * tall
            if starts[k] + size > len(self.data):
                raise ValueError("strip or tile ends beyond the file")
            raw = DECODERS[how](self.data[starts[k] : starts[k] + size])
            if len(raw) < line * tall:
                raise ValueError("strip or tile is too short")
            block = np.frombuffer(raw, np.uint8, line * tall).reshape(tall, line)
            block = _undo_predictor(block, predictor, inner, self.order, bits)
            used = min(tall, h - row * bh)
            image[plane, row * bh : row * bh + used, col * line : (col + 1) * line] = block[:used]
        image = image[:, :, :keep]
        if bits > 8:
            size = bits // 8
            if self.order == ">":
                image = image.reshape(planes, h, -1, size)[..., ::-1].reshape(planes, h, -1)
            if apart:
                image = image.reshape(planes, h, w, size).transpose(1, 2, 0, 3)
        elif apart and bits == 8:
            image = image.transpose(1, 2, 0)
        return out | {"samples": image.tobytes()}


def read_pages(data: bytes | None) -> Iterator[dict]:
    """A dict per page of one file; see the module for broken files."""
    if not data:
        return
    try:
        file = Tiff(data)
    except (ValueError, struct.error) as e:
        yield {"page": -1, "error": str(e)}
        return
    yield from file.pages()


def encode(pages: list[dict], order: str = "<") -> bytes:
    """A classic TIFF of 8-bit pages in strips: samples, width, and perhaps compression, predictor,
    rows (per strip), description. For storing bytes as an image, and for tests."""
    out = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for p in pages:
        w, how, predictor = p["width"], p.get("compression", DEFLATE), p.get("predictor", 1)
        x = np.frombuffer(p["samples"], np.uint8).reshape(-1, w)
        h, rows = x.shape[0], p.get("rows", 1024)
        if predictor == 2:
            y = x.copy()
            y[:, 1:] -= x[:, :-1]
            x = y
        pack = {RAW: bytes, PACKBITS: pack_bits, LZW: lzw, DEFLATE: lambda b: zlib.compress(b, 1)}[how]
        starts, sizes = [], []
        for r in range(0, h, rows):
            piece = pack(x[r : r + rows].tobytes())
            starts.append(len(out))
            sizes.append(len(piece))
            out += piece
        note = p.get("description", "").encode() + b"\0"
        tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8]), (COMPRESSION, 3, [how]), (262, 3, [1]), (DESCRIPTION, 2, note), (STRIP_AT, 4, starts), (SAMPLES, 3, [1]), (ROWS, 4, [rows]), (STRIP_LEN, 4, sizes), (PREDICTOR, 3, [predictor])]
        body = bytearray(struct.pack(f"{order}H", len(tags)))
        out += b"\0" * (len(out) % 2)
        at = len(out)
        extra_at, extra = at + 2 + 12 * len(tags) + 4, bytearray()
        for tag, kind, values in tags:
            code, size = TYPES[kind]
            data = bytes(values) if kind == 2 else struct.pack(f"{order}{len(values)}{code}", *values)
            body += struct.pack(f"{order}HHI", tag, kind, len(values))
            if len(data) <= 4:
                body += data.ljust(4, b"\0")
            else:
                body += struct.pack(f"{order}I", extra_at + len(extra))
                extra += data + b"\0" * (len(data) % 2)
        out[link : link + 4] = struct.pack(f"{order}I", at)
        link = at + len(body)
        out += body + struct.pack(f"{order}I", 0) + extra
    return bytes(out)


ROW = 64


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 text, and its bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (-len(raw) % ROW if raw else ROW)


def store_text(text: str | None) -> bytes:
    """The text as a one-page greyscale TIFF 64 samples wide; the description keeps the length."""
    n, payload = payload_of(text)
    return encode([{"width": ROW, "samples": payload, "predictor": 2, "description": f"bytes={n}"}])


BATCH_BYTES = 8 << 20


def _batches(rows: Iterator[dict], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    """Record batches of about BATCH_BYTES, so that memory doesn't follow the number of rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + weigh(row)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def with_tiff(df: DataFrame, text: str, out: str = "media") -> DataFrame:
    """Replaces the column `text` by its stored TIFF `out`."""
    fields = [f for f in df.schema.fields if f.name not in (text, out)] + [T.StructField(out, T.BinaryType())]
    schema = T.StructType(fields)
    arrow = _arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            keep = [n for n in b.schema.names if n in arrow.names and n != out]
            for i, x in enumerate(texts):
                yield {n: b.column(n)[i].as_py() for n in keep} | {out: store_text(x.as_py())}

    return df.mapInArrow(tidied(lambda it: _batches(rows(it), arrow, lambda r: len(r[out]))), schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def tiff_pages(df: DataFrame, media: str, extra: list[T.StructField] = (), derive=None, drop: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of the TIFF in column `media`: the other columns of df and PAGE_FIELDS.

    `derive(media_bytes, page_row) -> dict` fills the `extra` columns where the bytes are at hand;
    `drop` leaves page columns out of the result (samples, where only what is derived is of use).
    """
    added = [f for f in [*PAGE_FIELDS, *extra] if f.name not in drop]
    fields = [f for f in df.schema.fields if f.name != media and f.name not in {a.name for a in added}] + added
    schema = T.StructType(fields)
    arrow = _arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            files = b.column(b.schema.get_field_index(media))
            keep = [n for n in b.schema.names if n in arrow.names and n != media]
            for i, x in enumerate(files):
                data = x.as_py()
                own = {n: b.column(n)[i].as_py() for n in keep}
                for page in read_pages(data):
                    row = own | page
                    if derive:
                        row |= derive(data, page)
                    yield {n: row.get(n) for n in arrow.names}

    return df.mapInArrow(tidied(lambda it: _batches(rows(it), arrow, lambda r: len(r.get("samples") or b""))), schema)
