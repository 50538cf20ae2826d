import hashlib
import random
import re

from rillflow.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, window=13):
    split = lambda t: WORD.findall((t or "").translate(LOW))
    grams = {}
    for i, t in items:
        w = split(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            grams.setdefault(tuple(w[a : a + k]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, ids = split(t), set(), set()
        for k in {len(g) for g in grams}:
            for a in range(len(w) - k + 1):
                if g := grams.get(tuple(w[a : a + k])):
                    hit |= set(range(a, a + k))
                    ids |= g
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(d, "doc_id", "text", b, "item_id", "text")
    assert got.columns == ["doc_id", "text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return [tuple(r) for r in got.drop("text").collect()]


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["Alpha", "beta", "ÉCOLE", "école", "x1", "ΣΑΣ", "the", "of", "a", "zz"]
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".", "!?"]) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([40, 13, 14, 25, 12, 3, 1, 60])] + [(50, None), (51, "?!"), (52, "The OF a the of A the of a the of a the of a the"), (2, say(20))]
    items.append((60, items[0][1]))
    docs = [(i, say(rng.randrange(0, 150))) for i in range(40)]
    for i in range(40, 80):
        t = rng.choice(items)[1] or ""
        w = t.split()
        a = rng.randrange(0, max(1, len(w) - 5))
        docs.append((i, say(rng.randrange(0, 60)) + " " + " ".join(w[a : a + rng.randrange(1, 40)]) + " " + say(rng.randrange(0, 200))))
    docs += [(100, None), (101, ""), (102, "... "), (103, "the of a " * 300), (None, items[0][1]), (104, items[3][1]), (104, items[3][1]), (104, "zz zz")]
    assert sorted(run(spark, docs, items), key=key) == sorted(brute(docs, items), key=key)


def test_long_items_only_and_empty_sides(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(str(rng.randrange(10_000)) for _ in range(n))
    items = [(i, say(30)) for i in range(5)]
    w = items[1][1].split()
    docs = [(1, say(100) + " " + " ".join(w[3:16]) + " " + say(100)), (2, say(50) + " " + " ".join(w[3:15]) + " " + say(50)), (3, " ".join(w))]
    got = sorted(run(spark, docs, items), key=key)
    assert got == sorted(brute(docs, items), key=key) and [r[2] for r in got] == [13, 0, 30]
    assert all(r[2] == 0 and not r[5] for r in run(spark, docs, []))
    assert run(spark, [], items) == []


def test_many_test_rows_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    docs, items = [(1, " ".join(map(str, range(40)))), (2, "nothing here")], [(1, " ".join(map(str, range(10, 35)))), (2, "nothing")]
    assert sorted(run(spark, docs, items), key=key) == sorted(brute(docs, items), key=key)
