import random
import struct
import zlib
from collections import Counter
from fractions import Fraction

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from rillflow.llm import mixing, sharding
from rillflow.llm.registry import mix_documents, queries

DIR = "/root/testdata/sf0.001"


def sharded(df, n_shards, at):
    cut = sharding.chunks(df, "doc_id", "text")
    sums = sharding.slot_bytes(cut)
    slot_map = sharding.store_map(sharding.first_map(sums, n_shards), at, 1)
    return sums, slot_map, sharding.number_rows(sharding.assign(cut, slot_map), sums, slot_map).collect()


def spark_hash(*values):
    """xxhash64 as Spark chains it over long, string and boolean values."""
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<i", v) if isinstance(v, bool) else struct.pack("<q", v)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def by_hand(rows, n_shards):
    """(key, size, crc, virtual slot, shard) of every record and the number of each in its shard, in plain Python."""
    chunked = []
    for (key, text), n in Counter(rows).items():
        size, mark = len((text or "").encode()) + 1, spark_hash(text or "", text is None)
        most = max(1, sharding.CHUNK_BYTES // size)
        for c in range(-(-n // most)):
            chunked.append((spark_hash(key, mark, c) % sharding.N_SLOTS, (key is not None, key or 0), mark, zlib.crc32((text or "").encode()), size, c, min(most, n - c * most), key))
    load = Counter({s: 0 for s in range(sharding.N_SLOTS)})
    for v, *_, size, _, n, _ in chunked:
        load[v] += size * n
    shards, to = [0] * n_shards, {}
    for v in sorted(load, key=lambda v: (-load[v], v)):
        to[v] = shards.index(min(shards))
        shards[to[v]] += load[v]
    count, out = Counter(), []
    for v, _, _, crc, size, _, n, key in sorted(chunked, key=lambda x: x[:6]):
        for _ in range(n):
            out.append((key, size, crc, v, to[v], count[to[v]]))
            count[to[v]] += 1
    return out


def test_slots_shards_and_numbers_against_plain_python(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "é" * int(rng.paretovariate(1.2) * 20)) for i in range(1500)] + [(5, None), (5, None), (5, ""), (None, ""), (None, "a")] + [(7, "same text " * 90)] * 700
    df = spark.createDataFrame([(*r, "old", 0) for r in rows], "doc_id long, text string, shard string, n int").repartition(5)
    _, _, got = sharded(df, 16, str(tmp_path / "map"))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.key, r.size, r.text_crc32, r.virtual_slot, r.shard, r.slot) for r in got), key=key) == sorted(by_hand(rows, 16), key=key)


def test_whole_query_against_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(DIR + "/documents.parquet").select("doc_id", "text").collect()]
    got = queries()["op3_sharding"](spark, DIR).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.virtual_slot, r.shard, r.slot) for r in got) == sorted(by_hand(docs, 16))


def test_a_hot_key_and_a_hot_record_are_spread(spark, tmp_path):
    rows = [(1, f"text {i} " + "y" * 90) for i in range(10_000)] + [(2, "z" * 99)] * 10_000 + [(i, "x" * 99) for i in range(10, 10_010)]
    _, _, got = sharded(spark.createDataFrame(rows, "doc_id long, text string"), 16, str(tmp_path / "map"))
    by = Counter()
    for r in got:
        by[r.shard] += r.size
    assert len(got) == 30_000 and max(by.values()) < 1.01 * min(by.values())


def test_a_map_grows_into_the_new_shard_only(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (i % 90)) for i in range(3000)], "doc_id long, text string")
    sums, v1, _ = sharded(df, 16, str(tmp_path / "map"))
    v2 = sharding.store_map(sharding.grow_map(v1, sums, 16), str(tmp_path / "map"), 2)
    old, new = ({r.virtual_slot: r.shard for r in v.collect()} for v in (sharding.load_map(spark, str(tmp_path / "map"), 1), v2))
    moved = [s for s in old if old[s] != new[s]]
    assert moved and all(new[s] == 16 for s in moved) and sharding.load_map(spark, str(tmp_path / "map")).first().version == 2


def test_empty_table(spark, tmp_path):
    sums, slot_map, got = sharded(spark.createDataFrame([], "doc_id long, text string"), 4, str(tmp_path / "map"))
    assert got == [] and sums.count() == slot_map.count() == sharding.N_SLOTS
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mix_documents(spark, docs).count() == 0


def divisor(targets, house):
    """Seat by seat: the next goes to the highest quotient, of equals to the first."""
    seats = [0] * len(targets)
    for _ in range(house):
        best = max((i for i in range(len(targets)) if targets[i] > 0), key=lambda i: (Fraction(targets[i]) / (2 * seats[i] + 1), -i))
        seats[best] += 1
    return seats


def test_seats_are_those_of_the_divisor_method(spark):
    rng = random.Random(2)
    for _ in range(3):
        t = [rng.randrange(0, 500) for _ in range(9)] + [100, 100]
        df = spark.createDataFrame([(f"s{i:02d}", i, float(x), x) for i, x in enumerate(t)], "source string, place int, target double, source_size long")
        got = {(r.house, r.place): r.seats for r in mixing.seats(df, [0, 1, 7, 50, 233]).collect()}
        for h in (0, 1, 7, 50, 233):
            assert [got.get((h, i), 0) for i in range(len(t))] == divisor(t, h)


def capped(sizes, weights):
    total, fixed = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(fixed.values())
        w = sum(weights[i] for i in free)
        share = {i: left * weights[i] / w for i in free} if w else {}
        over = [i for i in free if share[i] > 3 * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: float(3 * sizes[i]) for i in over}


def test_mix_meets_capped_targets(spark):
    rng = random.Random(3)
    rows = []
    for k, (source, n) in enumerate([("a", 5), ("b", 300), ("c", 900), ("d", 2), ("é", 40), (None, 60)]):
        rows += [(k * 10_000 + i, source, "w " * rng.randrange(0, 400), "extra") for i in range(n)]
    rows += [(1, "b", None, "extra"), (2, "b", "", "extra"), (3, "b", " \t\n", "extra"), (4, "z", "", "x"), (50_000, "c", "one", "x"), (50_000, "c", "one", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, target string")
    got = mix_documents(spark, df.drop("target")).collect()
    again = mix_documents(spark, df.drop("target").repartition(7)).collect()
    plain = lambda rows: Counter((r.doc_id, r.source, r.size, r.target, r.taken, tuple(map(tuple, r.parts))) for r in rows)
    assert plain(got) == plain(again) and len(got) == len(rows)
    names = ["a", "b", "c", "d", "z", "é", None]
    sizes = [sum(r.size for r in got if r.source == s) for s in names]
    want = capped(sizes, [5, 2, 1, 5, 2, 1, 5])
    block = max(1, min(1024, sum(sizes) // (len(names) * mixing.BLOCKS_PER_SOURCE)))
    for s, size, target in zip(names, sizes, want, strict=True):
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - target) < 1e-6 * max(1, target) and r.source_size == size for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 3 * block + 1
        assert all(0 <= r.taken <= 3 * r.size and r.taken == sum(p.tokens for p in r.parts) for r in own)


def test_quotas_of_output_shards_add_up(spark):
    df = spark.createDataFrame([(f"s{i}", i, float(x), x) for i, x in enumerate([500, 300, 200, 7])], "source string, place int, target double, source_size long")
    assert mixing.block_plan(df, 1) == (1, 1007)
    rows = mixing.shard_quotas(df, 1007, 16).collect()
    assert all(r.blocks >= 0 for r in rows)
    per = Counter()
    for r in rows:
        per[r.shard] += r.blocks
    assert sum(per.values()) == 1007 and max(per.values()) - min(per.values()) <= 1
    assert [sum(r.blocks for r in rows if r.place == i) for i in range(4)] == divisor([500, 300, 200, 7], 1007)
    assert df.filter(F.lit(False)).count() == 0


def test_shards_take_their_quotas_block_by_block(spark):
    """Every token of the passes over a source's documents goes to the shard whose seats cover it, counted token by token."""
    rng = random.Random(7)
    rows = [(k * 1000 + i, f"s{k}", "w " * rng.randrange(0, 40)) for k, n in enumerate([4, 60, 25, 90]) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = df.select("doc_id", "source", F.size(F.filter(F.split("text", " "), lambda x: x != "")).cast("long").alias("size"))
    targeted = mixing.targets(mixing.weights(mixing.source_sizes(sized)))
    block = 7
    t = sorted(targeted.collect(), key=lambda r: r.place)
    houses = sum(r.source_size for r in t) // block
    by_house = [divisor([Fraction(r.target).limit_denominator(10**6) for r in t], houses * (s + 1) // 16) for s in range(16)]
    want = {r.place: [b[i] - (by_house[s - 1][i] if s else 0) for s, b in enumerate(by_house)] for i, r in enumerate(t)}
    quota = mixing.quotas(targeted, (block, houses)).cache()
    assert {r.place: r.blocks for r in quota.collect()} == want
    got = mixing.mix(sized, "doc_id", quota).collect()
    for r in t:
        own = [x for x in got if x.source == r.source]
        shard_of = [s for s, n in enumerate(want[r.place]) for _ in range(n * block)][: 3 * r.source_size]
        assert sum(x.taken for x in own) == len(shard_of)
        for s in range(16):
            assert sum(p.tokens for x in own for p in x.parts if p.shard == s) == shard_of.count(s)
        assert len([x for x in own if x.size and x.taken % x.size]) <= 1


def test_a_source_s_documents_are_taken_in_a_seeded_order(spark):
    df = spark.createDataFrame([(i, "s", 10) for i in range(400)] + [(i, "t", 1) for i in range(1000, 1400)], "doc_id long, source string, size long")
    targeted = mixing.targets(mixing.weights(mixing.source_sizes(df), (1, 8)))
    plan = mixing.quotas(targeted, (10, 440)).cache()
    taken = [frozenset(r.doc_id for r in mixing.mix(df.repartition(n), "doc_id", plan, seed).collect() if r.source == "s" and r.taken) for seed, n in ((1, 2), (1, 5), (2, 3))]
    assert taken[0] == taken[1] != taken[2] and 200 < len(taken[0]) < 400


def test_seats_beyond_32_bits(spark):
    targets = [7_000_000_000_001, 3_333_333_333_333, 1_024, 5_000_000_000_000]
    df = spark.createDataFrame([(f"s{i}", i, float(x), x) for i, x in enumerate(targets)], "source string, place int, target double, source_size long")
    house = sum(targets) // 1024
    assert house > 1 << 32
    rows = {r.place: r for r in mixing.quotas(df.withColumn("source_rows", F.lit(1)), (1024, house)).collect()}
    seats = [rows[i].seats for i in range(4)]
    assert sum(seats) == house and all(sum(rows[i].blocks) == seats[i] for i in range(4))
    assert all(Fraction(targets[i], 2 * seats[i] - 1) >= Fraction(targets[j], 2 * seats[j] + 1) for i in range(4) for j in range(4) if seats[i])
    sized = spark.createDataFrame([(i, f"s{i}", x) for i, x in enumerate(targets)], "doc_id long, source string, size long")
    got = {r.doc_id: r for r in mixing.mix(sized, "doc_id", mixing.quotas(df.withColumn("source_rows", F.lit(1)), (1024, house))).collect()}
    assert all(got[i].taken == seats[i] * 1024 for i in range(4))


def test_stage_takes_whole_documents_up_to_each_target(spark):
    rng = random.Random(4)
    rows = [(k * 1000 + i, f"s{k}", "w " * rng.randrange(20, 1500)) for k in range(7) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    size = {i: len(t.split()) for i, _, t in rows}
    own, target, most = Counter(), {}, Counter()
    for r in mix_documents(spark, df).collect():
        target[r.source], most[r.source] = r.target, max(most[r.source], r.size)
    for r in corpus_pipeline.mix(spark, df, "").collect():
        own[r.source] += size[r.doc_id]
    block = min(1024, sum(size.values()) // (7 * mixing.BLOCKS_PER_SOURCE))
    assert {s for s in target if target[s] < 0.5 * sum(size[i] for i, x, _ in rows if x == s)}
    assert all(abs(own[s] - target[s]) <= most[s] / 2 + 2 * block for s in target), {s: own[s] / target[s] for s in target}
