"""Katz backoff bigram model with Good-Turing discounts, and log10 scores of whole documents.

    P(w | h) = s(h) d(r) r / c(h)      where the bigram was seen r > 0 times in training
             = a(h) P(w)               else, with P(w) = s d(c) c / N, and P(unseen word) for all the rest

d is the Good-Turing discount for counts up to `LOW` (none above), a(h) gives every context total mass 1
exactly, and s scales seen mass down where discounting alone would leave nothing (else it is 1). An
unseen context leaves a(h) = 1. Each document starts after the end token and ends with it.

How it spreads: documents become chunks of at most about `CHUNK_TOKENS` tokens, each with its own sorted
vocabulary. A chunk asks for the corpus counts of its distinct words and bigrams; requests are dealt by
ranges of a uniform hash, so every bucket has its share whatever the words' frequencies, and a hot word
asks once per chunk. Buckets sum the counts, keep the model tables and answer. The number of buckets is
`BUCKETS` up to some GB and then follows the input; beyond `DIRECT` buckets, requests of a group of chunks
are merged first by coarse ranges, and the groups ask, so that rows grow with the keys and not with chunks
times buckets. Chunks lie in a table bucketed by chunk while the scores are made, so only requests and answers
are shuffled, never tokens. Words and bigrams are told apart by 64-bit hashes.

The model is three tables by kind (`unigrams`: word, training count; `bigrams`: context and word, training
count; `contexts`: context, scale s(h) and backoff weight a(h)) in rows of sorted blocks, one per bucket,
and `stat`, how many words and bigrams have each count, from which the discounts follow. `Model` reads them
back and scores texts that it has not seen with the same requests and answers.

Edge cases: null text is empty and has the end token only; without training rows every count is 0 and
only the unseen class has mass, so scores are 0; repeated rows are scored (and counted) one by one; a
null key is kept; very long texts are one chunk by themselves; an empty table gives no rows. Extra columns,
whatever their names, are left out.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remove, shared_dir, split_words, stored, tidied

CHUNK_TOKENS = 2_000_000
BYTES_AT_ONCE = 2 << 20
BYTES_PER_BUCKET = 16 << 20
BUCKETS, DIRECT = 64, 1024
LOW = 5
END = np.uint64(0x9E3779B97F4A7C15)
MAX_TABLE_BUCKETS = 20_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as gaps, byte by byte: the high bytes of the gaps are zeros."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return pack(np.ascontiguousarray(gaps).view(np.uint8).reshape(-1, 8).T)


def unpack_keys(data: bytes) -> np.ndarray:
    planes = unpack(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end token included, and offsets by text."""
    import pandas as pd

    split = split_words(texts)
    offsets = split.offsets.to_numpy()
    coded = split.values.dictionary_encode()
    words = coded.dictionary.to_pandas().to_numpy(dtype=object)
    codes = coded.indices.to_numpy()
    hashes = _mix(pd.util.hash_array(words, categorize=False)) if len(words) else np.zeros(0, np.uint64)
    full = (np.fromiter((w != "" for w in words), bool, len(words)) if len(words) else np.zeros(0, bool))[codes]
    at = np.concatenate([[0], np.cumsum(full)])[offsets]
    return np.insert(hashes[codes[full]], at[1:], END), at + np.arange(len(at))


CHUNK = T.StructType([T.StructField("chunk", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("docs", "codes", "words", "counts"))])
REQUEST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("values", T.BinaryType())])
ANSWER = T.StructType([T.StructField("kind", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("values", T.BinaryType())])
DOC = np.dtype([("key", "<i8"), ("null", "?"), ("train", "?"), ("n", "<i8")])


def _batch(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)


def chunks(docs: DataFrame) -> DataFrame:
    """docs: key, train, text -> CHUNK rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, held, size = TaskContext.get().partitionId() << 24, [], 0

        def close() -> pa.RecordBatch:
            nonlocal base
            tokens = np.concatenate([t for _, t in held])
            docs = np.concatenate([d for d, _ in held])
            words, codes = np.unique(tokens, return_inverse=True)
            counts = np.bincount(codes, np.repeat(docs["train"], docs["n"]), minlength=len(words)).astype(np.uint32)
            row = (base, pack(docs), pack(codes.astype(np.uint32)), pack_keys(words), pack(counts))
            base += 1
            return _batch(CHUNK, [row])

        for whole in batches:
            sizes = pc.binary_length(whole.column(2)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
            at = 0
            while at < whole.num_rows:
                done = sizes[at - 1] if at else 0
                to = min(max(int(np.searchsorted(sizes, done + BYTES_AT_ONCE, "right")), at + 1), whole.num_rows)
                b, at = whole.slice(at, to - at), to
                tokens, ends = token_hashes(b.column(2))
                rows = np.zeros(b.num_rows, DOC)
                rows["key"], rows["null"] = b.column(0).fill_null(0).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False)
                rows["train"], rows["n"] = b.column(1).to_numpy(zero_copy_only=False), np.diff(ends)
                if size and size + len(tokens) > CHUNK_TOKENS:
                    yield close()
                    held, size = [], 0
                held.append((rows, tokens))
                size += len(tokens)
        if held:
            yield close()

    return docs.select("key", "train", "text").mapInArrow(tidied(run), CHUNK)


def _requests(chunk: int, keys: np.ndarray, values: np.ndarray | None, n_buckets: int) -> Iterator[tuple]:
    """Rows of REQUEST: sorted keys cut into n_buckets ranges of the hash; values go along."""
    if not len(keys):
        return
    bucket = ((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(keys)]
    for x, y in zip(cuts, cuts[1:]):  # noqa: B905
        yield int(bucket[x]), chunk, pack_keys(keys[x:y]), pack(values[x:y])


def _group(rows: list[tuple], dtype: np.dtype) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Keys of each request, all values, the distinct keys, each key's place among them, and where requests end."""
    keys = [unpack_keys(r[2]) for r in rows]
    values = np.concatenate([unpack(r[3], dtype) for r in rows])
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, values, distinct, back, np.cumsum([len(k) for k in keys]).tolist()


def _sums(values: np.ndarray, back: np.ndarray, n: int) -> np.ndarray:
    if values.dtype.kind == "u":
        return np.bincount(back, values, minlength=n).astype(np.uint64)
    out = np.zeros(n, values.dtype)
    for c in values.dtype.names:
        out[c] = np.bincount(back, values[c], minlength=n)
    return out


def _firsts(values: np.ndarray, back: np.ndarray, n: int) -> np.ndarray:
    """For each value, whether it is the first above 0 of its key."""
    seen = np.flatnonzero(values > 0)
    first = np.full(n, len(values))
    np.minimum.at(first, back[seen], seen)
    own = np.zeros(len(values), bool)
    own[first[first < len(values)]] = True
    return own


def served(requests: DataFrame, n_buckets: int, dtype, at: str, kind: str, finish=None) -> DataFrame:
    """Sums the values of equal keys over all chunks. Stored rows by kind: `answer` (per chunk and bucket, in the
    order of its request; keys: whether this chunk is the first to have trained on the key, for counts),
    `table` (the bucket's trained keys and their sums) and `stat` (how many keys have each sum, for counts).
    finish: from sums to what is answered and kept instead."""
    dtype = np.dtype(dtype)
    counts = dtype.kind == "u"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[1])
        if not rows:
            return
        bucket = rows[0][0]
        _, values, distinct, back, ends = _group(rows, dtype)
        sums = _sums(values, back, len(distinct))
        full = sums > 0 if counts else sums[dtype.names[0]] > 0
        own = _firsts(values, back, len(distinct)) if counts else None
        told = sums if finish is None else finish(sums)
        del values, sums
        out = told[back]
        for r, a, b in zip(rows, [0, *ends], ends):  # noqa: B905
            yield _batch(ANSWER, [("answer", bucket, r[1], pack(own[a:b]) if counts else None, pack(out[a:b]))])
        yield _batch(ANSWER, [("table", bucket, None, pack_keys(distinct[full]), pack(told[full]))])
        if counts:
            r, n = np.unique(told[told > 0], return_counts=True)
            yield _batch(ANSWER, [("stat", bucket, None, r.tobytes(), pack(n.astype(np.uint64)))])

    dealt = requests.repartitionById(n_buckets, F.col("bucket"))
    table = stored(dealt.mapInArrow(tidied(run), ANSWER).withColumn("set", F.lit(kind)), f"{at}/{kind}", "kind")
    return table.select("set", *ANSWER.names)


def relayed(requests: DataFrame, n_coarse: int, n_groups: int, n_buckets: int, dtype, at: str, kind: str, finish=None) -> DataFrame:
    """served(), for many buckets: requests are dealt by coarse ranges, those of a group of chunks are merged,
    and the groups ask the buckets; answers go back the same way."""
    dtype = np.dtype(dtype)
    counts = dtype.kind == "u"
    relay = (F.pmod(F.xxhash64("chunk"), F.lit(n_groups)) * n_coarse + F.col("bucket")).cast("long")
    asked = stored(requests.withColumn("relay", relay), f"{at}/{kind}-relay")

    def merge(key, table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in REQUEST.names), strict=True), key=lambda r: r[1])
        _, values, distinct, back, _ = _group(rows, dtype)
        sums = _sums(values, back, len(distinct)).astype(np.uint64 if counts else dtype)
        return pa.Table.from_batches([_batch(REQUEST, list(_requests(key[0].as_py(), distinct, sums, n_buckets)))])

    wide = np.uint64 if counts else dtype
    met = served(asked.groupBy("relay").applyInArrow(merge, REQUEST), n_buckets, wide, at, kind, finish)
    answer = np.dtype(np.uint64) if counts else np.dtype(dtype if finish is None else finish(np.zeros(0, dtype)).dtype)

    def split(_key, own: pa.Table, got: pa.Table) -> pa.Table:
        rows = sorted(zip(*(own.column(c).to_pylist() for c in REQUEST.names), strict=True), key=lambda r: r[1])
        _, values, distinct, back, ends = _group(rows, dtype)
        got = got.sort_by("bucket")
        told = np.concatenate([unpack(x, answer) for x in got.column("values").to_pylist()])[back]
        if counts:
            first = np.concatenate([unpack(x, bool) for x in got.column("keys").to_pylist()])
            mine = _firsts(values, back, len(distinct)) & first[back]
        out = [("answer", r[0], r[1], pack(mine[a:b]) if counts else None, pack(told[a:b])) for r, a, b in zip(rows, [0, *ends], ends)]  # noqa: B905
        return pa.Table.from_batches([_batch(ANSWER, out)])

    back = asked.groupBy("relay").cogroup(met.filter("kind = 'answer'").withColumn("relay", F.col("chunk")).groupBy("relay")).applyInArrow(split, ANSWER)
    told = stored(back.withColumn("set", F.lit(kind)), f"{at}/{kind}-answers", "kind").select("set", *ANSWER.names)
    return told.unionByName(met.filter("kind <> 'answer'"))


class Ranges:
    """How requests are cut and served, by the size of the input in bytes."""

    def __init__(self, size: int):
        self.n_buckets = max(BUCKETS, -(-size // BYTES_PER_BUCKET))
        self.relays = self.n_buckets > DIRECT
        self.n_asked = max(BUCKETS, math.isqrt(self.n_buckets)) if self.relays else self.n_buckets
        chunks = max(1, size // (6 * CHUNK_TOKENS))
        self.n_groups = max(1, chunks * DIRECT // self.n_buckets)

    def serve(self, requests: DataFrame, dtype, at: str, kind: str, finish=None) -> DataFrame:
        if self.relays:
            return relayed(requests, self.n_asked, self.n_groups, self.n_buckets, dtype, at, kind, finish)
        return served(requests, self.n_buckets, dtype, at, kind, finish)


def statistics(table: DataFrame) -> dict[int, int]:
    """How many keys have each sum: one number per distinct count, added up where buckets have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, np.uint64).astype(np.int64)), pa.array(unpack(v, np.uint64).astype(np.int64))], names=["r", "n"])

    rows = table.filter("kind = 'stat'").select("keys", "values").mapInArrow(tidied(run), "r long, n long").groupBy("r").agg(F.sum("n").alias("n"))
    low = {r["r"]: r["n"] for r in rows.filter(F.col("r") <= LOW + 1).collect()}  # LOW + 1 rows
    total, kinds = rows.agg(F.sum(F.col("r") * F.col("n")), F.sum("n")).first()
    return {"n": low, "tokens": total or 0, "kinds": kinds or 0}


def discounts(n: dict[int, int]) -> np.ndarray:
    """Katz's d(0..LOW); 1 where the counts of counts give no factor between 0 and 1."""
    d = np.ones(LOW + 1)
    if n.get(1):
        tail = (LOW + 1) * n.get(LOW + 1, 0) / n[1]
        for r in range(1, LOW + 1):
            if n.get(r) and tail < 1:
                x = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - tail) / (1 - tail)
                if 0 < x <= 1:
                    d[r] = x
    return d


def discounted(r: np.ndarray, d: np.ndarray) -> np.ndarray:
    x = r.astype(np.float64)
    return np.where(x <= LOW, x * d[np.minimum(r, LOW).astype(np.int64)], x)


class Unigrams:
    """P(w) by training count, and P of the one class of all unseen words; they sum to 1."""

    def __init__(self, stat: dict):
        self.tokens, self.kinds, self.d = stat["tokens"], stat["kinds"], discounts(stat["n"])
        seen = self.tokens - sum(r * n * (1 - self.d[r]) for r, n in stat["n"].items() if r <= LOW)
        self.unseen = max(1 - seen / self.tokens, 1 / (self.tokens + 1)) if self.tokens else 1.0
        self.scale = (1 - self.unseen) / seen if seen else 0.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * discounted(c, self.d), self.unseen)


class Chunk:
    """Arrays of one chunk: docs, token codes, sorted word hashes; bigrams as sorted distinct keys."""

    def __init__(self, row: dict):
        self.docs, self.words = unpack(row["docs"], DOC), unpack_keys(row["words"])
        self.codes = unpack(row["codes"], np.uint32)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys (sorted by hash), the token's place among them, and the (h, w) codes of each key."""
        end = int(np.searchsorted(self.words, END))
        before = np.concatenate([[end], self.codes[:-1]]).astype(np.uint64)  # a text follows an end token
        pairs, back = np.unique((before << np.uint64(32)) | self.codes, return_inverse=True)
        h, w = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        keys = _mix(self.words[h] * np.uint64(0xC2B2AE3D27D4EB4F) + self.words[w])
        order = np.argsort(keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return keys[order], place[back], np.stack([h[order], w[order]])

    def trained(self) -> np.ndarray:
        return np.repeat(self.docs["train"], self.docs["n"])


SUMS = np.dtype([("c", "<f8"), ("seen", "<f8"), ("backed", "<f8")])
BACKOFF = np.dtype([("scale", "<f8"), ("weight", "<f8")])


def _answers(table: pa.Table, kind: str, dtype, column: str = "values") -> np.ndarray:
    own = table.filter(pc.equal(table.column("set"), kind)).sort_by("bucket")
    parts = [unpack(x, dtype) for x in own.column(column).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


RESULT = T.StructType([T.StructField("key", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def _map_chunks(table: DataFrame, columns: list[str], fn, schema: T.StructType) -> DataFrame:
    """fn(row dict) -> rows, for every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for row in fn({c: b.column(k)[i].as_py() for k, c in enumerate(columns)}):
                    yield _batch(schema, [row])

    return table.select(*columns).mapInArrow(tidied(run), schema)


def backoff(s: np.ndarray, uni: Unigrams) -> np.ndarray:
    """Scale of seen words and backoff weight of contexts, from their sums; an unseen context leaves everything to P(w)."""
    out = np.zeros(len(s), BACKOFF)
    seen_h = s["c"] > 0
    c = np.where(seen_h, s["c"], 1.0)
    left = np.where(seen_h, np.maximum(1 - s["seen"] / c, 0.5 / (c + 1)), 1.0)
    out["weight"] = left / np.maximum(np.where(seen_h, 1 - s["backed"], 1.0), uni.unseen)
    out["scale"] = np.where(seen_h, (1 - left) / np.where(seen_h, s["seen"], 1.0), 0.0)
    return out


class _Scorer:
    """Chunks of documents, their requests, and their scores from the answers."""

    def __init__(self, docs: DataFrame, key: str, text: str, train: str | None, at: str, n_asked: int = 0):
        kept = docs.select(
            F.col(key).cast("long").alias("key"), F.coalesce(F.col(train), F.lit(False)).alias("train") if train else F.lit(False).alias("train"), F.col(text).alias("text")
        )
        self.spark, self.at = docs.sparkSession, at
        size = kept.agg(F.sum(F.octet_length("text").cast("long") + 8)).first()[0] or 1
        self.ranges = Ranges(size)
        self.n_asked = n_asked or self.ranges.n_asked
        self.name = f"rillflow_chunks_{uuid.uuid4().hex}"
        n_tables = int(min(MAX_TABLE_BUCKETS, max(1, size // (3 * CHUNK_TOKENS))))
        chunks(kept).write.bucketBy(n_tables, "chunk").option("path", f"{at}/chunks").saveAsTable(self.name)
        self.table = self.spark.table(self.name)

    def close(self) -> None:
        """The table's name and files go; what was read from it must be stored."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, f"{self.at}/chunks")

    def words(self) -> DataFrame:
        n = self.n_asked
        return _map_chunks(self.table, ["chunk", "words", "counts"], lambda r: _requests(r["chunk"], unpack_keys(r["words"]), unpack(r["counts"], np.uint32), n), REQUEST)

    def bigrams(self) -> DataFrame:
        n = self.n_asked

        def ask(row: dict) -> Iterator[tuple]:
            c = Chunk(row)
            keys, place, _ = c.bigrams()
            return _requests(row["chunk"], keys, np.bincount(place, c.trained(), minlength=len(keys)).astype(np.uint32), n)

        return _map_chunks(self.table, ["chunk", "docs", "codes", "words"], ask, REQUEST)

    def contexts(self, answers: DataFrame, uni: Unigrams, d2: np.ndarray) -> DataFrame:
        """Each bigram adds to its context's sums once, from the first chunk that trained on it."""
        n_asked = self.n_asked

        def ask(row: dict, got: pa.Table) -> Iterator[list[tuple]]:
            c = Chunk(row)
            _, _, (h, w) = c.bigrams()
            r, own = _answers(got, "bigrams", np.uint64), _answers(got, "bigrams", bool, "keys")
            p = uni.p(_answers(got, "unigrams", np.uint64))
            n = len(c.words)
            sums = np.zeros(n, SUMS)
            sums["c"] = np.bincount(h[own], r[own], minlength=n)
            sums["seen"] = np.bincount(h[own], discounted(r[own], d2), minlength=n)
            sums["backed"] = np.bincount(h[own], p[w[own]], minlength=n)
            yield list(_requests(row["chunk"], c.words, sums, n_asked))

        return self._with(answers, ask, REQUEST)

    def scores(self, answers: DataFrame, uni: Unigrams, d2: np.ndarray) -> DataFrame:
        def judge(row: dict, got: pa.Table) -> Iterator[list[tuple]]:
            c = Chunk(row)
            _, place, (h, w) = c.bigrams()
            r, count = _answers(got, "bigrams", np.uint64), _answers(got, "unigrams", np.uint64)
            logp = np.log10(bigram_p(r, count[w], _answers(got, "contexts", BACKOFF)[h], uni, d2))
            base = np.log10((count + np.uint64(1)) / (uni.tokens + 1 * (uni.kinds + 1)))
            ends = np.cumsum(c.docs["n"])
            by_doc = lambda x: np.add.reduceat(x, np.concatenate([[0], ends[:-1]]))
            columns = (by_doc((count > 0)[c.codes].astype(np.int64)), by_doc(base[c.codes]), by_doc(logp[place]))
            key = [None if null else k for k, null in zip(c.docs["key"].tolist(), c.docs["null"].tolist(), strict=True)]
            yield list(zip(key, c.docs["n"].tolist(), *(x.tolist() for x in columns), strict=True))

        return self._with(answers, judge, RESULT)

    def _with(self, answers: DataFrame, fn, schema: T.StructType) -> DataFrame:
        def run(_key, own: pa.Table, got: pa.Table) -> pa.Table:
            row = {c: own.column(c)[0].as_py() for c in ("chunk", "docs", "codes", "words")}
            batches = [_batch(schema, rows) for rows in fn(row, got)]
            return pa.Table.from_batches(batches, schema=_batch(schema, []).schema)

        told = answers.filter("kind = 'answer'").select("set", "bucket", "chunk", "keys", "values")
        own = self.table.select("chunk", "docs", "codes", "words")
        return own.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, schema)


class Model:
    """The tables below a folder, for texts that come later."""

    def __init__(self, spark, at: str):
        fields = T.StructType([*ANSWER.fields, T.StructField("set", T.StringType())])
        self.tables = {kind: spark.read.schema(fields).parquet(f"{at}/{kind}").select("set", *ANSWER.names) for kind in ("unigrams", "bigrams", "contexts")}
        self.n_buckets = spark.read.parquet(f"{at}/buckets").first()[0]
        self.uni = Unigrams(statistics(self.tables["unigrams"]))
        self.d2 = discounts(statistics(self.tables["bigrams"])["n"])

    def score(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """RESULT rows of docs, stored; the model learns nothing from them."""
        at = shared_dir(docs.sparkSession)
        own = _Scorer(docs, key, text, None, at, self.n_buckets)
        try:
            words = own.words()
            answers = self._answered("unigrams", words, np.uint64(0)).unionByName(self._answered("bigrams", own.bigrams(), np.uint64(0)))
            answers = answers.unionByName(self._answered("contexts", words, backoff(np.zeros(1, SUMS), self.uni)[0]))
            return stored(own.scores(answers, self.uni, self.d2), f"{at}/scores")
        finally:
            own.close()

    def _answered(self, kind: str, requests: DataFrame, none) -> DataFrame:
        """Answers of the table's blocks to requests cut into the same ranges; none: the value of keys without a row."""
        dtype = none.dtype

        def look_up(_key, asked: pa.Table, block: pa.Table) -> pa.Table:
            keys, values = np.zeros(0, np.uint64), np.zeros(0, dtype)
            if block.num_rows:
                keys, values = unpack_keys(block.column("keys")[0].as_py()), unpack(block.column("values")[0].as_py(), dtype)
            values = np.append(values, np.array([none], dtype))
            out = []
            for bucket, chunk, data in zip(*(asked.column(c).to_pylist() for c in ("bucket", "chunk", "keys")), strict=True):
                own = unpack_keys(data)
                place = np.searchsorted(keys, own)
                hit = np.append(keys, np.uint64(0))[place] == own
                hit &= place < len(keys)
                out.append(("answer", bucket, chunk, None, pack(values[np.where(hit, place, len(keys))])))
            return pa.Table.from_batches([_batch(ANSWER, out)], schema=_batch(ANSWER, []).schema)

        blocks = self.tables[kind].filter("kind = 'table'").select("bucket", "keys", "values")
        back = requests.groupBy("bucket").cogroup(blocks.groupBy("bucket")).applyInArrow(look_up, ANSWER)
        return back.withColumn("set", F.lit(kind)).select("set", *ANSWER.names)


def score(docs: DataFrame, key: str, text: str, train: str, at: str | None = None) -> tuple[DataFrame, int]:
    """Rows (key, n_tokens, n_known, base_score, score) of all docs, learned from those where `train` is true,
    and the number of training tokens. The model tables are left below `at`, a new shared folder by default."""
    spark, at = docs.sparkSession, at or shared_dir(docs.sparkSession)
    own = _Scorer(docs, key, text, train, at)
    try:
        serve = own.ranges.serve
        stored(spark.createDataFrame([(own.ranges.n_buckets,)], "n long"), f"{at}/buckets")
        words = serve(own.words(), np.uint32, at, "unigrams")
        uni = Unigrams(statistics(words))
        bigrams = serve(own.bigrams(), np.uint32, at, "bigrams")
        d2 = discounts(statistics(bigrams)["n"])
        answers = words.unionByName(bigrams)
        contexts = serve(own.contexts(answers, uni, d2), SUMS, at, "contexts", lambda s: backoff(s, uni))
        return stored(own.scores(answers.unionByName(contexts), uni, d2), f"{at}/scores"), uni.tokens
    finally:
        own.close()


def bigram_p(r: np.ndarray, c_w: np.ndarray, back: np.ndarray, uni: Unigrams, d2: np.ndarray) -> np.ndarray:
    """P(w | h) from the bigram's count, the word's count and the context's scale and backoff weight."""
    return np.where(r > 0, back["scale"] * discounted(r, d2), back["weight"] * uni.p(c_w))
