import math
import random
from collections import Counter, defaultdict

import pytest

from rillflow.llm import katz
from rillflow.llm.common import shared_dir


def brute(docs):
    toks = [(i, train, (t or "").encode().lower().split() + [None]) for i, t, train in docs]
    c = Counter(w for _, tr, ws in toks if tr for w in ws)
    b = Counter((p, w) for _, tr, ws in toks if tr for p, w in zip([None, *ws], ws))  # noqa: B905
    n, v = sum(c.values()), len(c)
    d1, d2 = (katz.discounts(dict(Counter(x.values()))) for x in (c, b))
    low = lambda r, d: r * d[r] if r <= katz.LOW else r
    seen = sum(low(x, d1) for x in c.values())
    unseen = max(1 - seen / n, 1 / (n + 1)) if n else 1.0
    p1 = lambda w: (1 - unseen) / seen * low(c[w], d1) if c[w] else unseen
    ctx = defaultdict(lambda: [0, 0.0, 0.0])
    for (h, w), r in b.items():
        ctx[h][0] += r
        ctx[h][1] += low(r, d2)
        ctx[h][2] += p1(w)

    def p2(w, h):
        if h not in ctx:
            return p1(w)
        count, mass, backed = ctx[h]
        left = max(1 - mass / count, 0.5 / (count + 1))
        r = b.get((h, w), 0)
        return (1 - left) / mass * low(r, d2) if r else left / max(1 - backed, unseen) * p1(w)

    rows = [(i, len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), sum(math.log10(p2(w, h)) for h, w in zip([None, *ws], ws))) for i, _, ws in toks]  # noqa: B905
    mass = [sum(p2(w, h) for w in c) + p2(b"never seen", h) for h in ctx]
    return rows, n, mass


def check(spark, docs):
    df = spark.createDataFrame(docs, "key long, text string, train boolean").repartition(3)
    before = spark.sql("SHOW TABLES").count()
    at = shared_dir(spark)
    rows, n = katz.score(df, "key", "text", "train", at)
    assert spark.sql("SHOW TABLES").count() == before
    want, n_want, mass = brute(docs)
    assert n == n_want and mass == pytest.approx([1.0] * len(mass))
    order = lambda r: (r[0] is None, r[0] or 0, r[4])
    got = sorted(map(tuple, rows.collect()), key=order)
    for g, w in zip(got, sorted(want, key=order), strict=True):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], rel=1e-9)
    again = sorted(map(tuple, katz.Model(spark, at).score(df, "key", "text").collect()), key=order)  # from the stored tables alone
    for g, w in zip(again, got, strict=True):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], rel=1e-12)
    return at


def some_docs():
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.8)) % 400}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choice(words).upper() if rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randrange(0, 60))), rng.random() < 0.8) for i in range(120)]
    return docs + [(200, None, True), (201, "", False), (202, "É é \x0b x", True), (None, "w1 w2", True), (5, "w1 w2 w3", True), (5, "w1 w2 w3", True), (300, "w1 " * 2000, False)]


def test_scores_and_exact_mass(spark, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 300)
    monkeypatch.setattr(katz, "BUCKETS", 9)
    check(spark, some_docs())


def test_requests_through_groups_of_chunks(spark, monkeypatch):
    for name, value in (("CHUNK_TOKENS", 300), ("BUCKETS", 3), ("DIRECT", 4), ("BYTES_PER_BUCKET", 1200)):
        monkeypatch.setattr(katz, name, value)
    r = katz.Ranges(25_000)
    assert r.relays and r.n_groups > 1 and r.n_asked < r.n_buckets
    at = check(spark, some_docs())
    assert spark.read.parquet(f"{at}/bigrams-relay").count() > 0


def test_requests_grow_with_the_input():
    """Keys a request at least, from 100 MB to 100 TB of text, where a chunk has a million keys."""
    for size in (10**8, 5 * 10**8, 10**10, 10**12, 10**14):
        r = katz.Ranges(size)
        chunks = size / (6 * katz.CHUNK_TOKENS)
        if r.relays:
            assert 10**6 / r.n_asked > 300  # of a chunk to a coarse range
            assert chunks / r.n_groups * 10**6 / r.n_buckets > 900  # of a group to a bucket
            assert chunks / r.n_groups * 10**6 / r.n_asked < 10**8  # that a group has in a coarse range
        else:
            assert 10**6 / r.n_buckets > 900
    assert katz.Ranges(172_000_000).n_buckets == katz.Ranges(860_000_000).n_buckets == katz.BUCKETS


def test_new_texts_are_scored_from_the_tables(spark):
    docs = some_docs()
    at = shared_dir(spark)
    katz.score(spark.createDataFrame(docs, "key long, text string, train boolean"), "key", "text", "train", at)
    new = [(1, "w1 w2 never seen words w3"), (2, "w5 w5 w5 w1"), (3, None)]
    got = {r.key: tuple(r) for r in katz.Model(spark, at).score(spark.createDataFrame(new, "key long, text string"), "key", "text").collect()}
    want, _, _ = brute(docs + [(i + 1000, t, False) for i, t in new])
    for w in want:
        if w[0] is not None and w[0] > 1000:
            g = got[w[0] - 1000]
            assert g[1:3] == w[1:3] and g[3:] == pytest.approx(w[3:], rel=1e-9)


def test_the_tables_hold_counts_and_backoff_weights(spark):
    docs = [(1, "a b a c", True), (2, "a b", True), (3, "z", False)]
    at = shared_dir(spark)
    katz.score(spark.createDataFrame(docs, "key long, text string, train boolean"), "key", "text", "train", at)
    rows = {k: [r for r in katz.Model(spark, at).tables[k].filter("kind = 'table'").collect()] for k in ("unigrams", "bigrams", "contexts")}
    assert sum(len(katz.unpack_keys(r["keys"])) for r in rows["unigrams"]) == 4  # a, b, c and the end
    assert sorted(x for r in rows["bigrams"] for x in katz.unpack(r["values"], "<u8").tolist()) == [1, 1, 1, 1, 2, 2]
    weights = [x for r in rows["contexts"] for x in katz.unpack(r["values"], katz.BACKOFF)["weight"].tolist()]
    assert len(weights) == 4 and all(w > 0 for w in weights)


def test_no_training_rows_and_empty_table(spark):
    check(spark, [(1, "a b", False), (2, None, False)])
    df = spark.createDataFrame([], "key long, text string, train boolean")
    rows, n = katz.score(df, "key", "text", "train")
    assert rows.count() == 0 and n == 0
