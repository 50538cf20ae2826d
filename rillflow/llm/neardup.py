"""Near duplicates of word shingles by HyperMinHash.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. The top bits of a hash choose
one of 128 buckets; of the smallest remainder in a bucket a register keeps the number of leading zeros
and the next 10 bits (the mantissa), 16 bits in all. Four registers are one band of 64 bits; documents
that share a band are candidates. The Jaccard estimate corrects the register matches for the collisions
that sets of these sizes are expected to have; pairs well below the threshold go no further. The rest is
confirmed on the full sets.

Documents of equal sets are one node. The nodes of a shared band are compared with the band's center, the
node that meets most others over all its bands; all nodes with one center are its family. Families that
this leaves in different components are compared in cells of `CELL` x `CELL` nodes (fewer, where they have more
than `CELL_SHINGLES` shingles), nodes outside the center's component against all, first by estimate, then exactly; a cell joins two components once. So no
pair is enumerated as a row, pairs inside a component are left alone, and no link between components that
share a band is lost. No cap on bands or candidates applies.

Edge cases: null, empty or blank texts have no shingles, link with nothing and are kept; texts of fewer
words than a shingle are one shingle; repeated rows of an id are one document and each gets a row; an id with
several texts is one document too, in the group of each equal text, and its near copies are those of the text
with the smallest digest, whatever the order of rows; rows
with a null id get a null component and are kept; an empty table gives no rows. The input needs the key
and text columns only; others are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


from .common import shared_dir, split_words, stored, tidied

SHINGLE = 5
PERCENT = 75
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
REST_BITS = 64 - BUCKET_BITS
MANTISSA = 10
BAND = 4
SIGMAS = 5.0
CELL, CELL_SHINGLES = 512, 4 << 20
#: Members of a family that share one copy of their center's set while they are compared with it.
CHUNK = 256
#: Ids to broadcast at most (8 bytes each), counted first; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
BYTES_AT_ONCE = 2 << 20
# Fixed odd multipliers, one for each word of a shingle.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _finish(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased, split at ASCII white space), and offsets by text."""
    import pandas as pd

    split = split_words(texts)
    offsets = split.offsets.to_numpy()
    coded = split.values.dictionary_encode()
    words = coded.dictionary.to_pandas().to_numpy(dtype=object)
    codes = coded.indices.to_numpy()
    full = np.fromiter((w != "" for w in words), bool, len(words))[codes] if len(words) else np.zeros(0, bool)
    hashes = pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)
    return hashes[codes[full]], np.concatenate([[0], np.cumsum(full)])[offsets]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted distinct shingle hashes."""
    h, at = word_hashes(texts)
    n = len(h)
    if n >= SHINGLE:
        s = np.zeros(n - SHINGLE + 1, np.uint64)
        for j in range(SHINGLE):
            s += h[j : n - SHINGLE + 1 + j] * MIX[j]
        s = _finish(s)
    for a, b in zip(at.tolist(), at[1:].tolist()):  # noqa: B905
        if b - a >= SHINGLE:
            x = np.sort(s[a : b - SHINGLE + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif b > a:
            yield _finish(np.array([(h[a:b] * MIX[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


STARTS = (np.arange(BUCKETS, dtype=np.uint64) << np.uint64(REST_BITS)).astype(np.uint64)


def _bit_length(v: np.ndarray) -> np.ndarray:
    high = v >> np.uint64(32)
    part = np.where(high > 0, high, v & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.frexp(part)[1] + 32 * (high > 0)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Sets x BUCKETS registers: 0 for an empty bucket, else 1 + (leading zeros, mantissa)."""
    low = np.zeros((len(sets), BUCKETS), np.uint64)
    empty = np.ones((len(sets), BUCKETS), bool)
    for i, x in enumerate(sets):
        if len(x):
            at = np.searchsorted(x, STARTS)
            first = x[np.minimum(at, len(x) - 1)]
            low[i], empty[i] = first, (at == len(x)) | (first >> np.uint64(REST_BITS) != STARTS >> np.uint64(REST_BITS))
    v = low & np.uint64((1 << REST_BITS) - 1)
    size = _bit_length(v)
    shift = size - 1 - MANTISSA
    down, up = np.maximum(shift, 0).astype(np.uint64), np.maximum(-shift, 0).astype(np.uint64)
    mantissa = ((v >> down) << up) & np.uint64((1 << MANTISSA) - 1)
    packed = ((REST_BITS - size).astype(np.uint64) << np.uint64(MANTISSA)) | mantissa
    return np.where(empty, 0, packed + np.uint64(1)).astype(np.uint16)


def _expected(n: int, m: int, held: dict[tuple[int, int], float] = {}) -> float:  # noqa: B006
    """Expected registers that agree by chance, for independent sets of n and m elements (sizes come rounded)."""
    if (n, m) in held:
        return held[n, m]
    lead = np.arange(REST_BITS)[:, None]
    cut = np.arange((1 << MANTISSA) + 1)[None, :]
    edge = (2.0 ** -(lead + 1.0)) * (1 + cut / (1 << MANTISSA))  # a register's share of the remainders
    p = 1.0 / BUCKETS

    def chance(k: int) -> np.ndarray:  # that the smallest remainder of a bucket falls into each register
        above = np.exp(k * np.log1p(-p * edge))
        return above[:, :-1] - above[:, 1:]

    held[n, m] = float(BUCKETS * (chance(n) * chance(m)).sum())
    return held[n, m]


def _rounded(n: int) -> int:
    """To 3 significant bits, for the cache of expected collisions."""
    drop = max(0, int(n).bit_length() - 3)
    return (int(n) >> drop) << drop


def estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> tuple[float, float]:
    """Collision-corrected Jaccard of two register rows, and its standard error at the threshold."""
    used = int(((a != 0) | (b != 0)).sum())
    same = int(((a == b) & (a != 0)).sum())
    chance = min(_expected(_rounded(na), _rounded(nb)), max(used - 1, 0))
    j = max(0.0, same - chance) / max(used - chance, 1e-9)
    return j, (PERCENT / 100 * (1 - PERCENT / 100) / max(used, 1)) ** 0.5


SIGNATURE = T.StructType(
    [
        T.StructField("doc", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("set_key", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)
SETS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("members", T.BinaryType())])


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about BYTES_AT_ONCE of text, one row at least."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        to = min(max(int(np.searchsorted(sizes, done + BYTES_AT_ONCE, "right")), at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def signatures(docs: DataFrame) -> DataFrame:
    """doc, n (set size), set_key (digest of the whole set), bands; docs: doc, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, 1):
                sets = list(shingle_sets(b.column(1)))
                bands = registers(sets).view(np.int64)
                n = np.array([len(s) for s in sets], np.int64)
                keys = [_digest(s) for s in sets]
                lists = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * bands.shape[1], pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(keys, pa.binary()), lists], names=SIGNATURE.names)

    return docs.select("doc", "text").mapInArrow(tidied(run), SIGNATURE)


def full_sets(docs: DataFrame, ids: DataFrame, reps: DataFrame) -> DataFrame:
    """doc, members (sorted set as bytes) of the documents in ids (doc), for the set that reps (doc, set_key) have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, 1):
                sets = list(shingle_sets(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(_digest, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=SETS.names)

    few = ids.count() <= BROADCAST_IDS
    chosen = docs.select("doc", "text").join(F.broadcast(ids) if few else ids, "doc", "left_semi")
    found = chosen.mapInArrow(tidied(run), SETS).groupBy("doc", "set_key").agg(F.first("members").alias("members"))  # rows of equal sets
    return found.join(reps.select("doc", "set_key"), ["doc", "set_key"]).select("doc", "members")


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
ESTIMATED = T.StructType([*PAIR.fields, T.StructField("j", T.DoubleType())])


def _likely(pairs: DataFrame) -> DataFrame:
    """a, b, j of the pairs whose estimate is not SIGMAS standard errors below the threshold.

    pairs: a, b, bands_a, bands_b, n_a, n_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.array(b.column(i).flatten().to_numpy()).reshape(b.num_rows, -1).view(np.uint16) for i in (2, 3))
            n, m = b.column(4).to_pylist(), b.column(5).to_pylist()
            got = [estimate(x[i], y[i], n[i], m[i]) for i in range(b.num_rows)]
            keep = pa.array([j >= PERCENT / 100 - SIGMAS * e for j, e in got], pa.bool_())
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([j for j, _ in got], pa.float64())], names=ESTIMATED.names)
            yield out.filter(keep)

    return pairs.select("a", "b", "bands_a", "bands_b", "n_a", "n_b").mapInArrow(tidied(run), ESTIMATED)


def _sizes_allow(n: str, m: str):
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def confirmed(pairs: DataFrame, sets: DataFrame, at: str) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity.

    b is a center of many a: its set goes once to every CHUNK of them, before theirs, and is held while they pass by.
    Up to BROADCAST_IDS pairs are broadcast to the sets; more are joined by a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for a, x in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                p = np.frombuffer(x.as_buffer(), np.uint64)
                if a is None:
                    q = p.copy()
                    keep.append(False)
                    continue
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
                keep.append(100 * both >= PERCENT * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=PAIR.names).filter(pa.array(keep, pa.bool_()))

    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = stored(pairs.select("a", "b").join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("chunks")).alias("chunk")), at)
    few = dealt.count() <= BROADCAST_IDS
    small = lambda df: F.broadcast(df) if few else df
    own = small(dealt).join(sets.select(F.col("doc").alias("a"), "members"), "a").select("a", "b", "members", "chunk")
    heads = small(dealt.select("b", "chunk").distinct()).join(sets.select(F.col("doc").alias("b"), "members"), "b")
    heads = heads.select(F.lit(None).cast("long").alias("a"), "b", "members", "chunk")
    ordered = own.unionByName(heads).repartition("b", "chunk").sortWithinPartitions("b", "chunk", F.col("a").asc_nulls_first())
    return ordered.select("a", "b", "members").mapInArrow(tidied(run), PAIR)


def components(edges: DataFrame, at: str) -> DataFrame:
    """node, root (smallest node reachable) of every node that isn't its own root; edges: a, b.

    Every node points to its smallest smaller neighbour, pointers are doubled until they end at roots,
    edges are relabelled by roots, and what still joins two roots goes round again. Hot nodes are met
    by partial aggregates and by joins with one row per node, which adaptive execution can split.
    """
    spark = edges.sparkSession
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{at}/edges0")
    labels, step = spark.createDataFrame([], "node long, root long"), 0
    while not edges.isEmpty():
        step += 1
        parent, jump = stored(edges.groupBy("u").agg(F.min("v").alias("p")), f"{at}/parent{step}"), 0
        while True:
            jump += 1
            y = parent.select(F.col("u").alias("w"), F.col("p").alias("q"))
            further = stored(parent.join(y, F.col("p") == F.col("w"), "left").select("u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), f"{at}/jump{step}_{jump}")
            parent = further.select("u", "p")
            if further.filter("moved").isEmpty():
                break
        root = parent.select(F.col("u").alias("w"), F.col("p").alias("q"))
        old = labels.join(root, labels["root"] == root["w"], "left").select("node", F.coalesce("q", "root").alias("root"))
        labels = stored(old.unionByName(parent.select(F.col("u").alias("node"), F.col("p").alias("root"))), f"{at}/labels{step}")
        half = edges.join(root, edges["u"] == root["w"], "left").select(F.coalesce("q", "u").alias("u"), "v")
        whole = half.join(root, half["v"] == root["w"], "left").select("u", F.coalesce("q", "v").alias("v"))
        edges = stored(whole.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{at}/edges{step}")
    return labels


CELLED = "center long, i int, j int, side int, doc long, root long"


def _cells(family: DataFrame, comps: DataFrame, reps: DataFrame, at: str) -> DataFrame:
    """Rows of CELLED: what is still to compare in families that lie in several components.

    family: doc, center. Outside the center's component stand the rows of side 0, cut into `rows` parts,
    against all members (side 1) in `cols` parts, of CELL documents and CELL_SHINGLES shingles each, as far as
    hashing deals them evenly: part i meets part j in cell (i, j).
    Pairs with the center were compared before.
    """
    label = lambda c, to: comps.select(F.col("node").alias(c), F.col("root").alias(to))
    known = family.join(label("doc", "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    known = known.join(label("center", "main"), "center", "left").withColumn("main", F.coalesce("main", "center"))
    known = known.join(reps.select("doc", "n"), "doc")
    known = stored(known, f"{at}/known")  # so that what follows isn't bound to a center's one partition
    outside = F.col("root") != F.col("main")
    open_ = known.groupBy("center").agg(F.count(F.when(outside, 1)).alias("out"), F.count("*").alias("all"), F.sum(F.when(outside, F.col("n"))).alias("out_n"), F.sum("n").alias("all_n")).filter("out > 0 and all > 1")
    parts = lambda count, n: F.ceil(F.greatest(F.col(count) / CELL, F.col(n) / CELL_SHINGLES)).cast("int")
    open_ = open_.select("center", parts("out", "out_n").alias("rows"), parts("all", "all_n").alias("cols"))
    part = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    open_ = stored(open_, f"{at}/open")
    own = known.join(F.broadcast(open_) if open_.count() <= BROADCAST_IDS else open_, "center")
    left = own.filter(outside).select("center", part("rows").alias("i"), every("cols").alias("j"), F.lit(0).alias("side"), "doc", "root")
    right = own.select("center", every("rows").alias("i"), part("cols").alias("j"), F.lit(1).alias("side"), "doc", "root")
    return left.unionByName(right)


def _active(cells: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows of cells with a partner of another component that sizes and estimate allow."""
    schema = T._parse_datatype_string(CELLED)

    def compare(table: pa.Table) -> pa.Table:
        side, doc, root, n = (table.column(c).to_numpy() for c in ("side", "doc", "root", "n"))
        regs = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(doc), -1).copy().view(np.uint16)
        cols, keep = np.flatnonzero(side == 1), np.zeros(len(doc), bool)
        rounded = np.array([_rounded(x) for x in n])
        sizes = np.unique(rounded[cols])
        for i in np.flatnonzero(side == 0):
            small, large = np.minimum(n[cols], n[i]), np.maximum(n[cols], n[i])
            k = cols[(root[cols] != root[i]) & (100 * small >= PERCENT * large)]
            used = ((regs[k] != 0) | (regs[i] != 0)).sum(axis=1)
            same = ((regs[k] == regs[i]) & (regs[i] != 0)).sum(axis=1)
            chance = np.minimum(np.array([_expected(rounded[i], x) for x in sizes])[np.searchsorted(sizes, rounded[k])], np.maximum(used - 1, 0))
            error = np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / np.maximum(used, 1))
            likely = k[np.maximum(same - chance, 0) / np.maximum(used - chance, 1e-9) >= PERCENT / 100 - SIGMAS * error]
            if len(likely):
                keep[i] = True
                keep[likely] = True
        return table.select(schema.names).filter(pa.array(keep))

    return cells.join(reps, "doc").select(*schema.names, "n", "bands").groupBy("center", "i", "j").applyInArrow(compare, schema)


def _cell_links(active: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components in each cell by exact comparison; two components are joined once."""

    def compare(table: pa.Table) -> pa.Table:
        side, doc, root = (table.column(c).to_numpy() for c in ("side", "doc", "root"))
        members = [np.frombuffer(x.as_buffer(), np.uint64) for c in table.column("members").chunks for x in c]
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        cols = np.flatnonzero(side == 1)
        flat = np.concatenate([members[k] for k in cols]) if len(cols) else np.zeros(0, np.uint64)
        size = np.array([len(members[k]) for k in cols], np.int64)
        begin = np.cumsum(size) - size
        out = []
        for i in np.flatnonzero(side == 0):
            own = members[i]
            if not len(flat) or not len(own):
                continue
            found = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            both = np.add.reduceat(found.astype(np.int64), begin)
            for k in cols[(100 * both >= PERCENT * (size + len(own) - both)) & (doc[cols] != doc[i])]:
                x, y = find(int(root[i])), find(int(root[k]))
                if x != y:
                    up[max(x, y)] = min(x, y)
                    out.append((max(doc[i], doc[k]), min(doc[i], doc[k])))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=PAIR.names)

    return active.join(sets, "doc").groupBy("center", "i", "j").applyInArrow(compare, PAIR)


def near_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id)."""
    at = shared_dir(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    sig = stored(signatures(docs), f"{at}/signatures")
    groups = stored(sig.filter("n > 0 and doc is not null").groupBy("set_key").agg(F.min("doc").alias("rep")), f"{at}/groups")
    reps = stored(sig.filter("n > 0").join(groups.select(F.col("rep").alias("doc"), "set_key"), ["doc", "set_key"], "left_semi").groupBy("doc").agg(F.min_by(F.struct("n", "bands", "set_key"), "set_key").alias("x")).select("doc", "x.*"), f"{at}/reps")

    bands = reps.select("doc", F.posexplode("bands").alias("band", "key")).filter("key <> 0")
    shared = bands.groupBy("band", "key").agg(F.count("*").alias("c")).filter("c > 1")
    members = stored(bands.join(shared, ["band", "key"]), f"{at}/members")
    # the document that meets most others over all its bands is the most typical of its copies
    central = members.groupBy("doc").agg(F.sum("c").alias("met"))
    center = members.join(central, "doc").groupBy("band", "key").agg((-F.max(F.struct("met", (-F.col("doc")).alias("d")))["d"]).alias("center"))
    center = stored(center, f"{at}/centers")
    family = stored(members.join(center, ["band", "key"]).filter("doc <> center").select("doc", "center").distinct(), f"{at}/family")
    star = family.select(F.col("doc").alias("a"), F.col("center").alias("b"))
    side = lambda c: reps.select(F.col("doc").alias(c), F.col("n").alias(f"n_{c}"), F.col("bands").alias(f"bands_{c}"))
    star = stored(_likely(star.join(side("a"), "a").join(side("b"), "b").filter(_sizes_allow("n_a", "n_b"))), f"{at}/star")

    ids = lambda pairs: pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    sets = stored(full_sets(docs, stored(ids(star), f"{at}/ids"), reps), f"{at}/sets")
    best = star.groupBy("a").agg(F.max(F.struct("j", (-F.col("b")).alias("nb"))).alias("x")).select("a", (-F.col("x.nb")).alias("b"))
    links = stored(confirmed(best, sets, f"{at}/dealt1"), f"{at}/links1")
    comps = components(links, f"{at}/cc1")

    def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        for c in "ab":
            root = comps.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
            pairs = pairs.join(root, c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
        return pairs.filter("root_a <> root_b").select("a", "b")

    rest = apart(star.select("a", "b").join(best, ["a", "b"], "left_anti"), comps)
    links = links.unionByName(stored(confirmed(rest, sets, f"{at}/dealt2"), f"{at}/links2"))
    comps = components(links, f"{at}/cc2")

    active = stored(_active(_cells(family, comps, reps, at), reps), f"{at}/active")
    new = stored(active.select("doc").distinct().join(sets.select("doc"), "doc", "left_anti"), f"{at}/ids3")
    more = sets.unionByName(stored(full_sets(docs, new, reps), f"{at}/sets3"))
    last = stored(_cell_links(active, more), f"{at}/links3")
    if not last.isEmpty():
        comps = components(links.unionByName(last), f"{at}/cc3")

    named = sig.select("doc", "n", "set_key").join(groups, "set_key", "left")
    rooted = named.join(comps.select(F.col("node").alias("rep"), "root"), "rep", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("root", "rep", "doc"))
    return rooted.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept")
    )


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
     '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
k AS (SELECT s, list(doc_id) AS ids FROM g GROUP BY s HAVING count(*) > 1),
p AS (SELECT a, b, count(*) AS c FROM (SELECT a, unnest(ids) AS b FROM (SELECT ids, unnest(ids) AS a FROM k)) WHERE a < b GROUP BY a, b),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reached) AS component_id, min(reached) = r.doc_id AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
