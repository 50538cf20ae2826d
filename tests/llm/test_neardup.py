import random

import numpy as np
import pyarrow as pa

from rillflow.llm import neardup as N


def brute(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.setdefault(i, s)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(k for k in sets if k is not None)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in keys}


def run(spark, docs):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n string").repartition(3)
    return N.near_duplicates(df, "doc_id", "text").collect()


def noisy(rng, words, share):
    return [w if rng.random() > share else f"n{rng.randrange(10**6)}" for w in words]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 8)
    rng = random.Random(11)
    docs, i = [], 0
    for n in (6, 12, 40, 150, 400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for share in [0, 0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.06, 0.08] + [0.035] * 25:
            docs.append((i, " ".join(noisy(rng, base, share))))
            i += 3
    docs += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One two"), (1004, "one TWO"), (1005, "three"), (1006, "a b c d e"), (1007, "A B C D E"), (1008, "É b c d e"), (1009, "é b c d e")]
    rng.shuffle(docs)
    docs += [docs[0], docs[1], docs[1]]
    got = run(spark, docs)
    assert len(got) == len(docs)
    want = brute(docs)
    wrong = [(r, want[r.doc_id]) for r in got if (r.n_shingles, r.component_id, r.kept) != want[r.doc_id]]
    assert not wrong
    assert sum(not r.kept for r in got) > 60


def test_null_ids_and_empty_table(spark):
    got = run(spark, [(None, "a b c d e f"), (None, None), (1, "a b c d e f")])
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 1, True)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert run(spark, []) == []


def test_registers_and_estimate():
    rng = np.random.default_rng(3)
    errors = []
    for j in (0.5, 0.75, 0.9):
        for n in (40, 400, 4000):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            other = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            k = round(n * 2 * j / (1 + j))
            b = np.sort(np.concatenate([rng.choice(a, k, replace=False), other[: n - k]]))
            x, y = N.registers([a, b])
            got, error = N.estimate(x, y, len(a), len(b))
            true = k / (len(a) + len(b) - k)
            errors.append((got - true) / max(error, 0.03))
    assert np.abs(errors).max() < 4.5
    apart = N.registers([np.sort(rng.integers(0, 1 << 63, 3000, dtype=np.uint64)), np.sort(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))])
    assert N.estimate(apart[0], apart[1], 3000, 3000)[0] < 0.1


def test_register_values():
    v = np.array([(5 << 57) | (1 << 56) | (1 << 46), (9 << 57) | 1, 11 << 57], np.uint64)
    (r,) = N.registers([v])
    assert r[5] == 1 + (0 << 10 | 1) and r[9] == 1 + (56 << 10 | 0) and r[11] == 1 + (57 << 10) and (r != 0).sum() == 3


def test_words_of_slices():
    texts = pa.array(["a B\tc", None, "  É é ", "x\x0by\x0cz"] * 500, pa.large_string())
    h, at = N.word_hashes(texts.slice(3, 1200))
    assert np.diff(at).tolist() == [3, 3, 0, 2] * 300


def test_texts_under_one_id_give_the_same_result_in_any_order(spark):
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    near = lambda w, k: " ".join([*w[:k], "changed", *w[k + 1 :]])
    rows = [(5, " ".join(base)), (5, " ".join(other)), (5, " ".join(base)), (7, near(base, 2)), (8, near(other, 3)), (9, " ".join(other)), (3, "alone " * 9)]
    found = []
    for n in (1, 3, 5):
        df = spark.createDataFrame(rows[::-1] if n == 3 else rows, "doc_id long, text string").repartition(n)
        found.append(sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df, "doc_id", "text").collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    component = {d: c for d, _, c, _ in found[0]}
    assert component[5] == component[9] == 5 and component[3] == 3 and 5 in (component[7], component[8])
