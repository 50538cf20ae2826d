import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from rillflow.llm import media_query, tiff

random.seed(3)
NOISY = bytes(random.choice([0, 0, 0, 1, 2, random.randrange(256)]) for _ in range(64 * 700))


@pytest.mark.parametrize("how", [tiff.RAW, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip_of_strips(how, order):
    for n in (64, 6400, len(NOISY)):
        pages = [{"width": 64, "samples": NOISY[:n], "compression": how, "predictor": p, "rows": 100, "description": f"p{p}"} for p in (1, 2)]
        got = list(tiff.read_pages(tiff.encode(pages, order)))
        assert [g["page"] for g in got] == [0, 1] and all("error" not in g for g in got)
        assert all(g["samples"] == NOISY[:n] and (g["width"], g["height"]) == (64, n // 64) for g in got)
        assert [g["description"] for g in got] == ["p1", "p2"]


def test_lzw_over_many_tables():
    data = np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    assert tiff.unlzw(tiff.lzw(data)) == data
    assert tiff.unlzw(tiff.lzw(b"a" * 100_000)) == b"a" * 100_000 and tiff.unlzw(tiff.lzw(b"")) == b""


def raw_tiff(tags, blobs, order="<"):
    """tags: (tag, type, values); the values of tag None are filled with the blobs' offsets."""
    out = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0))
    at = []
    for b in blobs:
        at.append(len(out))
        out += b
    extra = bytearray()
    body = struct.pack(f"{order}H", len(tags))
    base = len(out) + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        values = at if values is None else values
        code, size = tiff.TYPES[kind]
        data = struct.pack(f"{order}{len(values)}{code}", *values)
        body += struct.pack(f"{order}HHI", tag, kind, len(values))
        body += data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(f"{order}I", base + len(extra))
        extra += data if len(data) > 4 else b""
    out[4:8] = struct.pack(f"{order}I", len(out))
    return bytes(out + body + struct.pack(f"{order}I", 0) + extra)


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiles_planes_wide_samples_and_predictors(order):
    rng = np.random.default_rng(5)
    image = rng.integers(0, 60_000, (20, 23, 2)).astype("<u2")
    blobs = []
    for plane in range(2):
        for r in (0, 16):
            for c in (0, 16):
                tile = np.zeros((16, 16), "<u2")
                piece = image[r : r + 16, c : c + 16, plane]
                tile[: piece.shape[0], : piece.shape[1]] = piece
                diff = np.diff(tile, axis=1, prepend=np.zeros((16, 1), "<u2")).astype(f"{order}u2")
                blobs.append(zlib.compress(diff.tobytes()))
    tags = [(256, 3, [23]), (257, 3, [20]), (258, 3, [16, 16]), (259, 3, [8]), (277, 3, [2]), (284, 3, [2]), (317, 3, [2]), (322, 3, [16]), (323, 3, [16]), (324, 4, None), (325, 4, [len(b) for b in blobs])]
    (page,) = tiff.read_pages(raw_tiff(tags, blobs, order))
    assert page.get("error") is None and page["samples"] == image.tobytes()
    x = rng.random((3, 5)).astype("<f4")
    high_first = x.view(np.uint8).reshape(3, 5, 4)[:, :, ::-1].transpose(0, 2, 1).reshape(3, 20)
    diff = np.diff(high_first.astype(np.int16), axis=1, prepend=0).astype(np.uint8)
    tags = [(256, 3, [5]), (257, 3, [3]), (258, 3, [32]), (259, 3, [1]), (273, 4, None), (277, 3, [1]), (278, 3, [3]), (279, 4, [60]), (317, 3, [3]), (339, 3, [3])]
    (page,) = tiff.read_pages(raw_tiff(tags, [diff.tobytes()], order))
    assert page.get("error") is None and page["samples"] == x.tobytes()


def test_broken_files_have_defined_rows():
    good = tiff.encode([{"width": 64, "samples": b"x" * 128}, {"width": 64, "samples": b"y" * 64}])
    assert list(tiff.read_pages(None)) == [] and list(tiff.read_pages(b"")) == []
    assert [r["page"] for r in tiff.read_pages(b"no tiff at all")] == [-1]
    rows = list(tiff.read_pages(good[: len(good) - 40]))
    assert rows[0]["samples"] == b"x" * 128 and "error" in rows[-1]
    for cut in range(0, len(good), 7):
        list(tiff.read_pages(good[:cut]))
    at = struct.unpack_from("<I", good, 4)[0]
    n = struct.unpack_from("<H", good, at)[0]
    looped = bytearray(good)
    second = struct.unpack_from("<I", good, at + 2 + 12 * n)[0]
    struct.pack_into("<I", looped, second + 2 + 12 * struct.unpack_from("<H", good, second)[0], at)
    assert len(list(tiff.read_pages(bytes(looped)))) == 2


def plain_read(data):
    """Width, height and samples of a little-endian, deflated TIFF of one directory, read without the operator's code."""
    assert data[:4] == b"II*\0"
    at = struct.unpack_from("<I", data, 4)[0]
    tags = {}
    for k in range(struct.unpack_from("<H", data, at)[0]):
        tag, kind, n = struct.unpack_from("<HHI", data, at + 2 + 12 * k)
        form = {1: "B", 2: "c", 3: "H", 4: "I"}.get(kind)
        if form:
            size = n * struct.calcsize(form)
            where = at + 10 + 12 * k if size <= 4 else struct.unpack_from("<I", data, at + 10 + 12 * k)[0]
            tags[tag] = struct.unpack_from(f"<{n}{form}", data, where)
    width, height, out = tags[256][0], tags[257][0], b""
    assert tags[259][0] in (8, 32946)
    for where, n in zip(tags[273], tags[279], strict=True):
        out += zlib.decompress(data[where : where + n])
    if tags.get(317, (1,))[0] == 2:
        rows = np.frombuffer(out, np.uint8).reshape(-1, width)
        out = np.cumsum(rows, axis=1, dtype=np.uint64).astype(np.uint8).tobytes()
    return width, height, out


def test_operator_keeps_other_columns_and_rows(spark):
    texts = [None, "", "a", "é" * 300, "long " * 50_000, "a"]
    df = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "doc_id long, text string, width string")
    pages = tiff.tiff_pages(tiff.with_tiff(df, "text"), "media", media_query.DIGEST, media_query.digest)
    got = {r.doc_id: r for r in pages.collect()}
    assert len(got) == 6
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.samples == payload
    assert got[2].media_sha256 == got[5].media_sha256
    media = {r.doc_id: bytes(r.media) for r in tiff.with_tiff(df, "text").collect()}
    for i, data in media.items():
        r = got[i]
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        width, height, samples = plain_read(data)
        assert samples == r.samples and width * height == len(samples)
        count = Counter(samples)
        entropy = -sum(n / len(samples) * math.log2(n / len(samples)) for n in count.values())
        size, mean, found, levels = r.feature.split()
        assert (size, levels) == (f"{width}x{height}", f"levels={len(count)}")
        assert abs(float(mean[5:]) - sum(samples) / len(samples)) < 1e-4 and abs(float(found[8:]) - entropy) < 1e-4
    assert tiff.tiff_pages(tiff.with_tiff(df.limit(0), "text"), "media").count() == 0
