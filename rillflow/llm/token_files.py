"""Token ids in Arrow stream-file (IPC file) format: fixed-size-list batches of equal-length sequences.

Documents are encoded where they lie, dealt to files by ranges of (key, hash of the text), and written in
that order as one stream of ids cut into sequences of `seq_len`: columns input_ids (fixed_size_list of
unsigned integers) and mask (fixed_size_list of bool, false on the padding of a file's last sequence).
A reader maps a file and slices any sequence, or any document by its place in the index, without copying
the rest. Files go to a folder shared by all executors through pyarrow's file systems.

The ranges are cut by bytes: rows are drawn for the cuts with a chance in proportion to their size, so a
key with a large share of the rows is cut too, between hashes of its texts.

Edge cases: null text is encoded as empty text, that is the end id alone; repeated keys keep all their
rows, ordered by the hash of their text, so that places are the same in every run; null keys come first;
an empty table writes no file. Extra columns are left out. Files are written under a passing name and
renamed, so a task that is run again leaves the same file. A text without a single space or line end
between other characters can't be cut and is encoded in one call, whatever its length.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import tidied

SEQ_LEN = 2048
SEQS_PER_BATCH = 256
FILE_BYTES = (16 << 20, 256 << 20)
#: Rows drawn per file, and at most, to cut the ranges of files; every row is written, drawn or not.
DRAWN_PER_FILE, DRAWN = 200, 1_000_000
BYTES_AT_ONCE = 8 << 20
#: Bytes given to the library in one call; its encodings take about 170 times the bytes of their text.
BYTES_A_CALL = 256 << 10

CUT = re.compile(r"(?<=\S) (?=\S)")

OTHER, LETTER, MARK, SPACE, LINE, WHITE = range(6)
KIND = np.zeros(256, np.uint8)
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[list(b".,;:!?%$&*#|")] = MARK
KIND[[9, 11, 12, 13, 28, 29, 30, 31]] = WHITE
KIND[0x20], KIND[0x0A] = SPACE, LINE


@dataclass(frozen=True)
class Form:
    """What the driver reads from a tokenizer's file once, for all workers.

    by_piece: the public byte-level rule without a normalizer, whose pieces of text can be told apart;
    leads: for each id, whether its token begins with a space; line: the id of a line end; apart: the
    strings of added tokens, which may stand across pieces.
    """

    wide: bool
    by_piece: bool
    leads: bytes
    line: int
    apart: tuple[str, ...]


def form(path: str) -> Form:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    spec = json.loads(tok.to_str())
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
    by_piece = by_piece and spec["model"]["type"] == "BPE" and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in added)
    line = tok.encode("\n", add_special_tokens=False).ids if by_piece else []
    leads = np.zeros(tok.get_vocab_size(), bool)
    if len(line) == 1:
        leads[[i for t, i in tok.get_vocab().items() if t.startswith("Ġ")]] = True  # a space, as byte-level vocabularies show it
    return Form(tok.get_vocab_size() > 1 << 16, bool(by_piece) and len(line) == 1, np.packbits(leads).tobytes(), line[0] if len(line) == 1 else 0, tuple(t["content"] for t in added))


def _encoder(path: str | Callable[[], str], how: Form) -> Encoder:
    """The encoder of this worker process, kept from task to task."""
    held = sys.modules.setdefault("_rillflow_encoders", types.ModuleType("_rillflow_encoders")).__dict__
    path = path() if callable(path) else path
    if path not in held:
        held[path] = Encoder(path, how)
    return held[path]


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary array."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `most` bytes, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(max(int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1, at + 1), n)
        yield at, to
        at = to


def _gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[begin[i] : begin[i] + size[i]] for all i, one after another."""
    total = int(size.sum(dtype=np.int64))
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64  # half the memory, nearly always
    shift = begin.astype(kind)
    shift -= np.cumsum(size, dtype=kind)
    shift += size
    at = np.repeat(shift, size)
    del shift
    at += np.arange(total, dtype=kind)
    return flat[at]


def _wide_spaces(data: np.ndarray) -> np.ndarray:
    """Where white space beyond ASCII begins, and how many bytes it has: (at, length) rows. Fixed values of Unicode."""
    at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    at = at[at + 1 < len(data)]
    a, b, c = data[at], data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    three = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | general | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    found = two | three
    return np.stack([at[found], np.where(two, 2, 3)[found]], axis=1)


class Encoder:
    """Ids of texts.

    A byte-level tokenizer cuts text before a single space between two other characters, on both sides of
    a single line end, and between a letter and a mark. So texts are cut there, each distinct piece of a
    batch is encoded by the library once, and ids are gathered by index. Texts with other runs of white
    space, and all texts for other tokenizers, are encoded whole.
    """

    def __init__(self, path: str, how: Form):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.form = Tokenizer.from_file(path), how
        self.dtype = np.dtype("<u4" if how.wide else "<u2")
        self.leads = np.unpackbits(np.frombuffer(how.leads, np.uint8)).astype(bool)

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, text: str) -> np.ndarray:
        """A text as it is; a long one in parts, which end before single spaces between other characters."""
        if len(text) <= BYTES_A_CALL or not self.form.by_piece:
            return self._direct([text])[0]
        parts, at = [], 0
        while at < len(text):
            m = CUT.search(text, at + BYTES_A_CALL)
            to = m.start() if m else len(text)
            parts.append(self._direct([text[at:to]])[0])
            at = to
        return np.concatenate(parts)

    def _odd(self, texts: pa.Array, data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts to encode whole: white space next to white space or at an end, and added tokens."""
        white = kind >= SPACE
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        near = white & (edge[:-1] | edge[1:])
        near[1:] |= white[1:] & white[:-1]
        for at, n in _wide_spaces(data).tolist():
            end = at + n
            if edge[at] or edge[end] or white[at - 1] or white[end]:
                near[at] = True
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(offsets, np.flatnonzero(near), "right") - 1] = True
        for word in self.form.apart:
            odd |= pc.match_substring(texts, word).to_numpy(zero_copy_only=False)
        return odd

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after another, and how many each has."""
        data, offsets = _flat(pieces)
        first = data[offsets[:-1]]
        led = np.flatnonzero(first == 0x20)
        bare = np.flatnonzero(first != 0x20)
        spaced = np.add.reduceat((KIND[data] >= SPACE).astype(np.int64), offsets[:-1])[bare] > 0 if len(bare) else np.zeros(0, bool)
        ids, sizes, order = [], [], []
        for group, glue in ((led, b""), (bare[~spaced], b"\n")):
            own = pieces.take(pa.array(group))
            text, at = _flat(own)
            for a, b in _runs(at, BYTES_A_CALL):
                joined = glue.join(own.slice(a, b - a).to_pylist()) if glue else text[at[a] : at[b]].tobytes()
                got = self._direct([joined.decode()])[0]
                if glue:
                    stops = np.flatnonzero(got == self.form.line)
                    n = np.diff(np.concatenate([[-1], stops, [len(got)]])) - 1
                    got = np.delete(got, stops)
                else:
                    n = np.diff(np.append(np.flatnonzero(self.leads[got]), len(got)))
                if len(n) != b - a:  # not the form that was read from the file: one by one
                    each = self._direct([x.decode() for x in own.slice(a, b - a).to_pylist()])
                    got, n = np.concatenate(each), np.array([len(x) for x in each])
                ids.append(got)
                sizes.append(n)
            order.append(group)
        rest = bare[spaced]
        for x in self._direct([x.decode() for x in pieces.take(pa.array(rest)).to_pylist()]):
            ids.append(x)
            sizes.append(np.array([len(x)]))
        order = np.concatenate([*order, rest])
        size = np.concatenate([np.zeros(0, np.int64), *sizes]).astype(np.int64)
        begin = np.cumsum(size) - size
        back = np.argsort(order)
        flat = np.concatenate([np.zeros(0, self.dtype), *ids])
        return _gathered(flat, begin[back], size[back]), size[back]

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, ids of these rows one after another, their offsets); each row of texts (no nulls) comes once."""
        data, offsets = _flat(texts)
        kind = KIND[data]
        odd = self._odd(texts, data, kind, offsets) if self.form.by_piece else np.ones(len(texts), bool)
        whole = np.flatnonzero(odd)
        for a, b in _runs(np.concatenate([[0], np.cumsum(np.diff(offsets)[whole])]), BYTES_AT_ONCE):
            each = [self._whole(t) for t in texts.take(pa.array(whole[a:b])).to_pylist()]
            yield whole[a:b], np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        rows = np.flatnonzero(~odd)
        if len(whole):
            texts = texts.take(pa.array(rows))
            data, offsets = _flat(texts)
            kind = KIND[data]
        if not len(rows):
            return
        cut = kind >= SPACE
        cut &= kind != WHITE
        cut[1:] |= kind[:-1] == LINE
        cut[1:] |= (kind[1:] == MARK) & (kind[:-1] == LETTER)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        edges = np.append(np.flatnonzero(cut), len(data)).astype(np.int32)
        del cut, kind
        pieces = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy()
        first = np.searchsorted(edges[:-1], offsets.astype(np.int32))
        del pieces, edges
        if not len(codes):
            yield rows, np.zeros(0, self.dtype), np.zeros(len(rows) + 1, np.int64)
            return
        flat, size = self._pieces(coded.dictionary)
        size = size.astype(np.int32)
        begin, count = (np.cumsum(size, dtype=np.int32) - size)[codes], size[codes]
        tokens = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=tokens[1:])
        ends = tokens[first]
        del tokens, codes, coded
        yield rows, _gathered(flat, begin, count), ends


ENCODED = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("key", T.LongType()),
        T.StructField("mark", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)
INDEX = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("begin", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)
#: Null keys come before all others.
NULL_KEY = -(1 << 63)


def _parts(cuts: list[tuple[int, int]], keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """How many cuts (key, mark) are at or below each row's (key, mark)."""
    if not cuts:
        return np.zeros(len(keys), np.int32)
    ck, cm = (np.array(x, np.int64) for x in zip(*cuts, strict=True))
    part, high = np.searchsorted(ck, keys, "left"), np.searchsorted(ck, keys, "right")
    for k in np.unique(keys[part < high]):
        own, a, b = keys == k, *np.searchsorted(ck, [k, k + 1] if k < np.iinfo(np.int64).max else [k, k], "left")
        b = b if b > a else len(ck)
        part[own] = a + np.searchsorted(cm[a:b], marks[own], "right")
    return part.astype(np.int32)


def _marked(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, mark (a hash of the text), text (null: empty)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key).cast("long").alias("key"), F.xxhash64(whole).alias("mark"), whole.alias("text"))


def encoded(df: DataFrame, key: str, text: str, tokenizer: str | Callable[[], str], end_id: int, cuts: list[tuple[int, int]], how: Form) -> DataFrame:
    """part (the file of the row's range), key, mark, ids with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer, how)
        width = enc.dtype.itemsize
        for whole in batches:
            texts = whole.column(2).cast(pa.large_string())
            _, at = _flat(texts)
            keys, marks = whole.column(0), whole.column(1).to_numpy(zero_copy_only=False)
            part = _parts(cuts, keys.fill_null(NULL_KEY).to_numpy(zero_copy_only=False), marks)
            for a, b in _runs(at, BYTES_AT_ONCE):
                for rows, ids, offsets in enc.encode(texts.slice(a, b - a)):
                    ids = np.insert(ids, offsets[1:], end_id)
                    edges = ((offsets + np.arange(len(offsets))) * width).astype(np.int32)
                    blob = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(edges), pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays([pa.array(part[a + rows]), keys.take(pa.array(a + rows)), pa.array(marks[a + rows]), blob], names=ENCODED.names)

    return _marked(df, key, text).mapInArrow(tidied(run, "_rillflow_encoders"), ENCODED)


def _write_file(at: str, part: int, dtype: np.dtype, seq_len: int, blobs: Iterator[pa.Buffer | bytes]) -> Iterator[None]:
    """Writes one file from ids in order, a step for each of blobs."""
    fs, folder = pa.fs.FileSystem.from_uri(at)
    fs.create_dir(folder, recursive=True)
    passing, final = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/part-{part:06d}.arrow"
    unit = pa.from_numpy_dtype(dtype.newbyteorder("="))
    schema = pa.schema([("input_ids", pa.list_(unit, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
    full = seq_len * SEQS_PER_BATCH

    def batch(ids: np.ndarray) -> pa.RecordBatch:
        n = -(-len(ids) // seq_len) * seq_len
        mask = pa.array(np.arange(n) < len(ids))
        flat = pa.array(np.concatenate([ids, np.zeros(n - len(ids), dtype)]))
        return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(x, seq_len) for x in (flat, mask)], schema=schema)

    held = np.zeros(0, dtype)
    with fs.open_output_stream(passing) as sink, pa.ipc.new_file(sink, schema) as out:
        for blob in blobs:
            held = np.concatenate([held, np.frombuffer(blob, dtype)])
            cut = len(held) // full * full
            for k in range(0, cut, full):
                out.write_batch(batch(held[k : k + full]))
            held = held[cut:]
            yield
        if len(held):
            out.write_batch(batch(held))
    fs.move(passing, final)


def write_files(tokens: DataFrame, at: str, n_parts: int, wide: bool, seq_len: int = SEQ_LEN) -> DataFrame:
    """Lazily writes the files below `at`, one per part; gives the index: key, part, begin, n_tokens."""
    dtype = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, begin = [], None, 0

        def blobs() -> Iterator[np.ndarray]:
            nonlocal part, begin
            for b in batches:
                part = b.column(0)[0].as_py() if part is None else part
                data, edges = _flat(b.column(2))
                edges = edges // dtype.itemsize
                index = [b.column(1), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(begin + edges[:-1]), pa.array(np.diff(edges))]
                out.append(pa.RecordBatch.from_arrays(index, names=INDEX.names))
                begin += int(edges[-1])
                yield data

        steps = blobs()
        head = next(steps, None)  # the part's number stands in its rows
        if head is None:
            return
        for _ in _write_file(at, part, dtype, seq_len, _chain(head, steps)):
            yield out.pop()

    dealt = tokens.repartitionById(n_parts, F.col("part")).sortWithinPartitions(F.col("key").asc_nulls_first(), "mark")
    return dealt.select("part", "key", "ids").mapInArrow(tidied(run, "_rillflow_encoders"), INDEX)


def _chain(head, rest):
    yield head
    yield from rest


class TokenFile:
    """Random access to one file: sequences and documents as views of the mapped file."""

    def __init__(self, at: str, part: int):
        fs, folder = pa.fs.FileSystem.from_uri(at)
        path = f"{folder}/part-{part:06d}.arrow"
        source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.seq_len = self.file.schema.field("input_ids").type.list_size
        self.per_batch = SEQS_PER_BATCH * self.seq_len
        self.last: tuple[int, np.ndarray] | None = None

    def _batch(self, k: int) -> np.ndarray:
        if self.last is None or self.last[0] != k:
            ids = self.file.get_batch(k).column(0)
            self.last = (k, ids.flatten().to_numpy(zero_copy_only=True))
        return self.last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i."""
        k, at = divmod(i, SEQS_PER_BATCH)
        b = self.file.get_batch(k)
        return b.column(0)[at].values.to_numpy(), b.column(1)[at].values.to_numpy(zero_copy_only=False)

    def ids(self, begin: int, n: int) -> np.ndarray:
        out = []
        while n > 0:
            k, at = divmod(begin, self.per_batch)
            piece = self._batch(k)[at : at + n]
            out.append(piece)
            begin, n = begin + len(piece), n - len(piece)
        return np.concatenate(out) if len(out) != 1 else out[0]


def read_back(index: DataFrame, at: str) -> DataFrame:
    """index and ids_crc32 (of the ids as little-endian unsigned 32-bit integers), from the files."""
    schema = T.StructType([*INDEX.fields, T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file = None, None
        for b in batches:
            crcs = []
            for p, begin, n in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if p != part:
                    part, file = p, TokenFile(at, p)
                crcs.append(zlib.crc32(file.ids(begin, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(crcs, pa.int64())], names=schema.names)

    return index.mapInArrow(tidied(run, "_rillflow_encoders"), schema)


def cuts(df: DataFrame, key: str, text: str, slots: int, file_bytes: tuple[int, int] = FILE_BYTES) -> list[tuple[int, int]]:
    """Where files end: (key, mark) cuts for files of about equal bytes; the size of a file follows the input.

    Rows are drawn by a hash of key and text, with a chance in proportion to their bytes.
    """
    least, most = file_bytes
    size = F.octet_length("text").cast("long") + 1
    rows = _marked(df, key, text).select("key", "mark", size.alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    n = max(1, round(total / min(most, max(least, total / (3 * slots)))))
    if n == 1:
        return []
    step = total / min(DRAWN_PER_FILE * n, DRAWN)  # bytes that one drawn row stands for
    chance = F.pmod(F.xxhash64("key", "mark", F.lit(41)), F.lit(1 << 30)) / (1 << 30)
    drawn = rows.filter(chance < F.col("size") / step).select(F.coalesce("key", F.lit(NULL_KEY)).alias("key"), "mark", F.greatest("size", F.lit(step)).alias("size"))
    held = drawn.toPandas().sort_values(["key", "mark"])  # about DRAWN rows at most
    if not len(held):
        return []
    share = held["size"].cumsum() / held["size"].sum() * n
    ends = (share.astype("int64").diff() > 0).to_numpy().nonzero()[0]
    return sorted({(int(held["key"].iloc[i]), int(held["mark"].iloc[i])) for i in ends})


def starts(index: DataFrame) -> DataFrame:
    """part, ahead: ids of all files before it; one row per file."""
    sums = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
