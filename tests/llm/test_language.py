import bisect
import functools
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rillflow.llm import langid, registry

WORDS = {"en": ["the", "house", "with", "thing", "walking", "three"], "de": ["der", "schön", "haus", "gehen", "über", "nicht"], "ru": ["дом", "это", "хорошо", "улица"], "el": ["σπίτι", "καλό", "δρόμος"]}


def corpus(spark, n=60):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(WORDS[k]) for _ in range(30)), k) for i, k in enumerate(k for k in WORDS for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, k = rng.integers(1, 7), rng.integers(1, 4)
        s = -rng.random((n, k)) * 4
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, B905, E731
        best = max(itertools.product(range(k), repeat=int(n)), key=value)
        assert abs(value(langid.viterbi(s, 1.5)) - value(best)) < 1e-9


def test_held_out_accuracy_and_defined_cases(spark):
    docs = corpus(spark)
    model = langid.train(docs.filter("doc_id % 3 > 0"), "text", "lang")
    assert model.languages == ["de", "el", "en", "ru"]
    odd = [(None, "de"), ("", None), ("123 !!! 456", "en"), ("中文 文字", "en"), ("the house " * 20_000, "x")]
    extra = spark.createDataFrame([(1000 + i, t, k) for i, (t, k) in enumerate(odd)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs.filter("doc_id % 3 = 0").unionByName(extra).withColumn("score", F.lit("clash")), "text", model).collect()}
    assert all(r.lang_pred == r.lang for r in got.values() if r.doc_id < 1000)
    assert [(got[1000 + i].lang_pred, got[1000 + i].score) for i in range(3)] == [("und", 0.0)] * 3
    assert got[1003].lang_pred in model.languages and got[1004].lang_pred == "en" and 0 <= got[1003].score <= 1
    assert got[1000].spans == []


def test_mixed_text_has_spans(spark):
    model = langid.train(corpus(spark), "text", "lang")
    text = " ".join(["the house with three"] * 5 + ["дом это улица"] * 8 + ["der schön haus nicht"] * 6)
    (one,) = langid.label(pa.array([text]), model)
    assert [s[0] for s in one[2]] == ["en", "ru", "de"] and sum(s[2] for s in one[2]) == len(text.split())
    assert [s[1] for s in one[2]] == [0, 20, 44]


def test_without_training_rows_all_is_undetermined(spark):
    docs = spark.createDataFrame([(1, "some words", None), (1, "some words", None)], "doc_id long, text string, lang string")
    model = langid.train(docs, "text", "lang")
    assert [r.lang_pred for r in langid.identify(docs, "text", model).collect()] == ["und", "und"]
    assert langid.identify(docs.limit(0), "text", model).count() == 0


def test_score_is_lower_where_words_say_less(spark):
    model = langid.train(corpus(spark), "text", "lang")
    sure, mixed, short = (s for _, s, _ in langid.label(pa.array(["the house walking three with thing", "the house дом это walking улица", "a"]), model))
    assert 0 <= mixed < sure <= 1 and 0 <= short < sure


def plain_language(docs):
    """Predictions for (doc_id, text, lang) rows in plain Python: counts, word scores, and every path's best by recursion."""
    crc = lambda i: zlib.crc32(str(i).encode())
    mask, names = (1 << 64) - 1, langid.SCRIPT_NAMES

    def grams(word):
        letters = [c for c in word.lower() if c.isalpha()]
        points = [0, *map(ord, letters), 0]
        for a, b, c in zip(points, points[1:], points[2:], strict=False):
            h = (a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F ^ c * 0x165667B19E3779F9) & mask
            h ^= h >> 29
            yield (h * 0xD6E8FEB86659FD93 & mask) >> 48, langid.SCRIPTS[bisect.bisect_right(langid.SCRIPT_STARTS, b) - 1]

    split = lambda t: re.split(r"[\x20\x09-\x0D]+", t or "")
    count, script = defaultdict(Counter), defaultdict(Counter)
    for i, text, lang in docs:
        if text is not None and lang is not None and crc(i) % 5:
            for w in split(text):
                for bucket, s in grams(w):
                    count[lang][bucket] += 1
                    script[lang][s] += 1
    languages = sorted(count)
    seen = len(set().union(*count.values()))
    total = {k: sum(c.values()) + langid.SMOOTHING * seen for k, c in count.items()}
    uses = {s: [k for k in languages if script[k][s] >= langid.SCRIPT_SHARE * sum(script[k].values())] for s in names}

    @functools.cache
    def scores(word):
        g = list(grams(word))
        if not g or not uses[g[0][1]]:
            return tuple(0.0 for _ in languages), len(g)
        raw = [sum(math.log((count[k][b] + langid.SMOOTHING) / total[k]) for b, _ in g) if k in uses[g[0][1]] else -math.inf for k in languages]
        return tuple(max(x - max(raw), -langid.WORD_LIMIT) for x in raw), len(g)

    out = {}
    for i, text, _ in docs:
        own = [scores(w) for w in split(text)]
        letters = sum(n for _, n in own)
        if not letters:
            out[i] = ("und", 0.0)
            continue
        value, back = list(own[0][0]), []
        for row, _ in own[1:]:
            steps = [max(range(len(value)), key=lambda j: value[j] - (langid.SWITCH if j != k else 0)) for k in range(len(value))]  # noqa: B023
            value = [row[k] + value[j] - (langid.SWITCH if j != k else 0) for k, j in enumerate(steps)]
            back.append(steps)
        path = [value.index(max(value))]
        for steps in reversed(back):
            path.append(steps[path[-1]])
        held = Counter()
        for k, (_, n) in zip(reversed(path), own, strict=True):
            held[k] += n
        best = max(range(len(languages)), key=lambda k: (held[k], -k))
        share = sum(n * math.exp(row[best]) / sum(map(math.exp, row)) for row, n in own) / letters
        out[i] = (languages[best], share)
    return out


def test_whole_query_against_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()]
    want = plain_language(docs)
    got = registry.op4_language(spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-6
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
