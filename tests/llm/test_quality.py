import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from rillflow.llm import quality as Q
from rillflow.llm import registry


def docs(spark, n=900):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        toxic, junk = rng.random() < 0.2, rng.random() < 0.25
        w = [rng.choice(words) for _ in range(40)]
        if toxic:
            w[3], w[9] = "vile", "Nasty!"
        if junk:
            w = [x + "$$$" for x in w] if rng.random() < 0.5 else [w[0]] * 40
        rows.append((i, " ".join(w), f"h{i % 5}", f"h{i % 5}/{i % 15}", int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, host string, path string, quality int, toxic int")


def test_classifier_on_held_out_rows(spark):
    df = docs(spark)
    model = Q.train(df.filter("doc_id % 3 > 0"), "text", ["quality", "toxic"])
    got = Q.classify(df.filter("doc_id % 3 = 0"), "text", model).collect()
    assert sum((r.p_quality >= 0.5) == (r.quality == 1) for r in got) >= 0.97 * len(got)
    clean = [r for r in got if r.quality]
    assert sum((r.p_toxic >= 0.5) == (r.toxic == 1) for r in clean) >= 0.97 * len(clean)


def test_sparse_sites_shrink_and_evidence_moves(spark):
    rows = [("bad", "bad/a", 0.1)] * 200 + [("good", "good/a", 0.9)] * 200 + [("new", "new/a", 0.5), (None, None, 0.5)]
    df = spark.createDataFrame(rows, "host string, path string, p_quality double").withColumn("quality_known", F.lit(None).cast("int"))
    got = {r.host: r.quality for r in Q.posteriors(df, "host", "path", ["quality"]).collect()}
    assert got["bad"] < 0.1 and got["good"] > 0.9 and abs(got["new"] - 0.5) < 0.05 and abs(got[None] - 0.5) < 0.05
    assert Q.posteriors(df, "host", "path", ["quality"]).count() == len(rows)


def test_defined_cases(spark):
    df = docs(spark, 200)
    model = Q.train(df, "text", ["quality", "toxic"])
    odd = spark.createDataFrame([(1, None, "z"), (1, None, "z"), (2, "", "z"), (3, "word " * 50_000, "z"), (4, "日本語 \U0001f600", "z")], "doc_id long, text string, p_quality string").drop("p_quality")
    got = Q.classify(odd, "text", model).collect()
    assert len(got) == 5 and all(0 <= r.p_quality <= 1 and 0 <= r.p_toxic <= 1 for r in got)
    none = Q.train(df.limit(0), "text", ["quality"])
    assert all(r.p_quality == 0.5 for r in Q.classify(odd, "text", none).collect())
    one = Q.train(df.filter("toxic = 0"), "text", ["toxic"])
    assert all(r.p_toxic < 0.5 for r in Q.classify(odd, "text", one).collect())
    assert Q.classify(odd.limit(0), "text", model).count() == 0


def test_one_label_without_the_other_counts(spark, tmp_path):
    df = docs(spark, 600)
    df.select("doc_id", "text", F.lit("en").alias("lang"), F.col("host").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    known = df.filter("doc_id % 3 > 0").select("doc_id", F.lit(None).cast("int").alias("quality"), "toxic")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in df.collect()}
    got = registry.op9_quality(spark, str(tmp_path)).collect()
    assert len(got) == 600 and all(abs(r.p_quality - 0.5) < 1e-9 for r in got)
    assert sum((r.p_toxic >= 0.5) == (toxic[r.doc_id] == 1) for r in got) >= 0.9 * len(got)


def by_hand(rows, label="quality"):
    """Posteriors in plain Python: rows of (host, path, p, known)."""
    clip = lambda p: min(max(p, Q.EDGE), 1 - Q.EDGE)
    logit = lambda p: math.log(clip(p) / (1 - clip(p)))
    e = [float(k) if k is not None else p for _, _, p, k in rows]
    mu = sum(e) / len(e)
    paths, hosts = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for (h, q, _, _), x in zip(rows, e, strict=True):
        for group in (paths[h, q], hosts[h]):
            group[0] += 1
            group[1] += x

    def strength(groups):
        noise = sum(parent * (1 - parent) for _, _, parent in groups)
        total = sum(n for n, _, _ in groups)
        between = (sum(n * (s / n - parent) ** 2 for n, s, parent in groups) - noise) / max(total - len(groups), 1)
        inner = sum(n * parent * (1 - parent) for n, _, parent in groups) / total
        return min(max(inner / between - 1 if between > 0 else Q.STRENGTH[1], Q.STRENGTH[0]), Q.STRENGTH[1])

    kh = strength([(n, s, mu) for n, s in hosts.values()])
    m = {h: (s + kh * mu) / (n + kh) for h, (n, s) in hosts.items()}
    kp = strength([(n, s, m[h]) for (h, _), (n, s) in paths.items()])
    out = []
    for (h, q, p, _), x in zip(rows, e, strict=True):
        n, s = paths[h, q]
        others = (s - x + kp * m[h]) / (n - 1 + kp)
        out.append(1 / (1 + math.exp(-(logit(p) + logit(others) - logit(mu)))))
    return out


def sites(n, seed):
    """Weak evidence, and hosts and paths of very different shares: (host, path, p, known, truth)."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        h = rng.choice(["a", "b", "c", "d", None, f"rare{rng.randrange(40)}"])
        q = rng.choice(["x", "y", None])
        share = {"a": 0.95, "b": 0.1, "c": 0.5, "d": 0.7}.get(h, 0.5) if q != "y" else 0.3
        truth = int(rng.random() < share)
        p = min(max(0.5 + (0.1 if truth else -0.1) + rng.gauss(0, 0.2), 0.001), 0.999)
        rows.append((h, q, p, truth if rng.random() < 0.3 else None, truth))
    return rows


def test_posteriors_against_plain_python(spark):
    rows = sites(700, 3) + [("one", "one", 0.4, None, 0), (None, None, 0.0, 1, 1), (None, None, 1.0, 0, 0)]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, host string, path string, p_quality double, quality_known int").repartition(6)
    got = {r.i: r.quality for r in Q.posteriors(df.withColumn("quality", F.lit("clash")), "host", "path", ["quality"]).collect()}
    want = by_hand([r[:4] for r in rows])
    assert len(got) == len(rows) and all(abs(got[i] - want[i]) < 1e-9 for i in range(len(rows)))


def test_hosts_and_paths_help_on_rows_without_labels(spark):
    rows = sites(4000, 8)
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, host string, path string, p_quality double, quality_known int")
    got = {r.i: r.quality for r in Q.posteriors(df, "host", "path", ["quality"]).collect()}
    held = [i for i, r in enumerate(rows) if r[3] is None]
    alone = sum((rows[i][2] >= 0.5) == (rows[i][4] == 1) for i in held) / len(held)
    both = sum((got[i] >= 0.5) == (rows[i][4] == 1) for i in held) / len(held)
    assert both > alone + 0.02, (alone, both)
