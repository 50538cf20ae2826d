"""op1: every text stored as a TIFF, read back page by page, and described."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import tiff
from .common import table

DIGEST = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
]


def digest(media: bytes, page: dict) -> dict:
    """The digest columns of a stored text, from the samples that were read back."""
    if page.get("error"):
        raise ValueError(f"a stored text cannot be read back: {page['error']}")
    payload = page["samples"]
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    mean = float(counts @ np.arange(256)) / len(payload)
    entropy = float(-(share * np.log2(share)).sum())
    return {
        "n_bytes": int(page["description"].removeprefix("bytes=")),
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-tiff.ROW :]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"{page['width']}x{page['height']} mean={mean:.4f} entropy={entropy:.4f} levels={len(share)}",
    }


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its one page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pages = tiff.tiff_pages(tiff.with_tiff(docs, "text"), "media", DIGEST, digest, drop=("samples",))
    return pages.select("doc_id", *[f.name for f in DIGEST], "page", "width", "height")
