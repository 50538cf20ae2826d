"""Quality and toxicity of documents by hierarchical empirical Bayes.

A logistic classifier over the presence of telling words and the shape of the text gives every document
a probability for each label. Grouped sums of that evidence (the label itself where there is one) by
host and by path are shrunk: a path towards its host, a host towards the whole corpus, with strengths
estimated from the spread of the group means beyond sampling noise, so that sparse sites say little.
A document's posterior odds are its classifier odds times the odds of its path's posterior (without the
document itself) relative to the corpus.

The classifier is fitted on at most about `SAMPLE` labelled documents, drawn by a hash of their text: a
bound that is a parameter. Scores, sums and posteriors cover all documents.

Edge cases: null text is empty and is scored by its shape; null hosts and paths are groups of their own;
without labels, or with one class only, the classifier says 0.5 or the class's smoothed share; documents
with several labels count the largest; repeated rows count one by one; an empty table gives no rows; very long
texts are one batch by themselves. Other columns are kept; columns named like a label or p_<label> are replaced.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chance, shared_dir, split_words, stored, tidied

SAMPLE = 8000
WORDS, MIN_DOCS, MIN_Z = 300, 8, 4.0
RIDGE = 1.0
BYTES_AT_ONCE = 2 << 20
STRENGTH = (1.0, 1e6)
EDGE = 1e-6
SHAPE = ["log_words", "marks", "upper", "digits", "distinct", "repeated", "bars", "word_length"]
MARKS = ".,;:!?'\"()-$%&*#|"
#: Lengths of word beginnings that may be telling; inflected words share them.
PREFIXES = (3, 4, 5, 6, 7)


def _kinds() -> dict[str, np.ndarray]:
    """Letter, capital and digit tables of the basic plane; made once in a worker process."""
    held = sys.modules.setdefault("_rillflow_kinds", types.ModuleType("_rillflow_kinds")).__dict__
    if "letter" not in held:
        chars = [chr(i) for i in range(1 << 16)]
        held |= {"letter": np.array([c.isalpha() for c in chars]), "upper": np.array([c.isupper() for c in chars]), "digit": np.array([c.isdigit() for c in chars])}
        held["common"] = np.array([c in MARKS for c in chars])
    return held


def forms(word: str) -> list[str]:
    """What a word counts as: itself, lower-cased and without marks around it, and its beginnings."""
    w = word.strip(MARKS).lower()
    return [w, *(w[:k] + "-" for k in PREFIXES if len(w) > k)] if w else []


def features(texts: pa.Array, chosen: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts x SHAPE, row of each chosen word present, that word's number)."""
    split = split_words(texts, lower=False)
    at = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    n = len(at) - 1
    points = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    basic, word = np.minimum(points, 0xFFFF), np.cumsum(points == 0) - (points == 0)
    kinds = _kinds()
    per = {"upper": kinds["upper"][basic], "digits": kinds["digit"][basic], "letters": kinds["letter"][basic], "bars": points == ord("|"), "all": points != 0, "common": kinds["common"][basic]}
    per = {k: np.bincount(word, v, minlength=max(1, len(words))) for k, v in per.items()}
    doc = np.repeat(np.arange(n), np.diff(at))
    total = {k: np.bincount(doc, v[codes], minlength=n) if len(codes) else np.zeros(n) for k, v in per.items()}
    full = per["all"][codes] > 0 if len(codes) else np.zeros(0, bool)
    count = np.bincount(doc, full, minlength=n)
    chars, safe = np.maximum(total["all"], 1), np.maximum(count, 1)
    pairs = np.unique(doc * max(1, len(words)) + codes) if len(codes) else np.zeros(0, np.int64)
    distinct = np.bincount(pairs // max(1, len(words)), minlength=n)
    same = np.zeros(n)
    if len(codes) > 1:
        same = np.bincount(doc[1:], (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1]), minlength=n)
    odd = total["all"] - total["letters"] - total["digits"] - total["common"]
    shape = np.stack([np.log1p(count), odd / chars, total["upper"] / chars, total["digits"] / chars, distinct / safe, same / safe, total["bars"] / safe, total["all"] / safe], axis=1)
    heads, none = {f.rstrip("-")[: PREFIXES[0]] for f in chosen}, []
    own = [[chosen[f] for f in forms(w) if f in chosen] if w.strip(MARKS).lower()[: PREFIXES[0]] in heads else none for w in words]
    size = np.array([len(x) for x in own] or [0])
    flat = np.array([i for x in own for i in x], np.int64)
    used = pairs[size[pairs % max(1, len(words))] > 0]
    word, row = used % max(1, len(words)), used // max(1, len(words))
    many = size[word]
    place = np.repeat((np.cumsum(size) - size)[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return shape, np.repeat(row, many), flat[place]


@dataclass
class Model:
    """chosen words, and for each label weights over [1, shape (standardised), words]."""

    chosen: dict[str, int]
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def design(self, texts: pa.Array) -> np.ndarray:
        shape, row, word = features(texts, self.chosen)
        x = np.zeros((len(shape), 1 + shape.shape[1] + len(self.chosen)))
        x[:, 0] = 1
        x[:, 1 : 1 + shape.shape[1]] = np.clip((shape - self.mean) / self.scale, -6, 6)
        x[row, 1 + shape.shape[1] + word] = 1
        return x


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        to = min(max(int(np.searchsorted(sizes, done + BYTES_AT_ONCE, "right")), at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept is free."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(x.shape[1])
    w[0] = np.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        ridge = np.full(x.shape[1], RIDGE)
        ridge[0] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-4:
                break
    return w


def train(labelled: DataFrame, text: str, labels: list[str], sample: int = SAMPLE) -> Model:
    """labelled: text and 0/1 columns `labels`; a null says nothing of its label only."""
    n = labelled.count()
    draw = chance(F.xxhash64(text))
    some = labelled.select(F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.col(c).cast("int").alias(c) for c in labels]).filter(draw < (sample / n if n > sample else 1.1))
    sums = [f"{k}_{c}" for c in labels for k in ("m", "n")]  # documents with the label known, and with it set
    fields = ", ".join(f"{c} long" for c in sums)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, 0):
                split = split_words(b.column(0), lower=False)
                held: dict[str, list[int]] = {}
                for words, *y in zip(split.to_pylist(), *(b.column(1 + i).to_pylist() for i in range(len(labels))), strict=True):
                    for w in {f for w in words for f in forms(w)}:
                        k = held.setdefault(w, [0] * len(sums))
                        for i, v in enumerate(y):
                            if v is not None:
                                k[2 * i] += 1
                                k[2 * i + 1] += v
                cols = list(zip(*held.values(), strict=True)) or [()] * len(sums)
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=["word", *sums])

    counts = some.mapInArrow(tidied(count, "_rillflow_kinds"), f"word string, {fields}").groupBy("word").agg(*[F.sum(c).alias(c) for c in sums])
    total = some.agg(*[F.count(c).alias(f"m_{c}") for c in labels], *[F.sum(c).alias(c) for c in labels]).first()
    z = []
    for c in labels:
        p = (total[c] or 0) / max(1, total[f"m_{c}"])
        m = F.col(f"m_{c}")
        z.append(F.when(m >= MIN_DOCS, F.abs(F.col(f"n_{c}") - p * m) / F.sqrt(p * (1 - p) * m + 1e-9)))
    best = F.greatest(*z) if len(z) > 1 else z[0]
    telling = counts.select("word", best.alias("z")).filter(F.col("z") >= MIN_Z).orderBy(F.col("z").desc(), "word").limit(WORDS)  # the classifier's features
    chosen = {r["word"]: i for i, r in enumerate(telling.collect())}
    model = Model(chosen, np.zeros(len(SHAPE)), np.ones(len(SHAPE)), {})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, 0):
                x = model.design(b.column(0))
                x[:, 1 : 1 + len(SHAPE)] = features(b.column(0), {})[0]
                yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary()), *b.columns[1:]], names=["x", *labels])

    got = some.mapInArrow(tidied(rows, "_rillflow_kinds"), f"x binary, {', '.join(f'{c} int' for c in labels)}").toPandas()  # about `sample` rows
    if len(got):
        x = np.stack([np.frombuffer(b, np.float32) for b in got["x"]]).astype(np.float64)
        shape = x[:, 1 : 1 + len(SHAPE)]
        model.mean, model.scale = shape.mean(axis=0), np.maximum(shape.std(axis=0), 1e-3)
        x[:, 1 : 1 + len(SHAPE)] = np.clip((shape - model.mean) / model.scale, -6, 6)
    model.weights = {c: np.zeros(1 + len(SHAPE) + len(chosen)) for c in labels}
    for c in labels:
        y = got[c].to_numpy(np.float64, na_value=np.nan)
        known = ~np.isnan(y)
        if known.any():
            model.weights[c] = _logistic(x[known], y[known])
    return model


def classify(docs: DataFrame, text: str, model: Model) -> DataFrame:
    """Replaces the column `text` by p_<label> for each label."""
    labels = list(model.weights)
    given = [c for c in docs.columns if c != text and c not in {f"p_{x}" for x in labels}]
    schema = T.StructType([*(docs.schema[c] for c in given), *(T.StructField(f"p_{c}", T.DoubleType()) for c in labels)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            column = whole.schema.get_field_index(text)
            for b in _slices(whole, column):
                x = model.design(b.column(column))
                p = [1 / (1 + np.exp(-np.clip(x @ model.weights[c], -30, 30))) for c in labels]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in given), *map(pa.array, p)], names=schema.names)

    return docs.mapInArrow(tidied(run, "_rillflow_kinds"), schema)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, label: str, mean: Column, parent: Column) -> Column:
    """Pseudo-count of the prior, by moments: how far group means spread around their parent beyond sampling noise."""
    n, m = F.col("n"), mean
    noise = F.sum(parent * (1 - parent))
    between = (F.sum(n * (m - parent) * (m - parent)) - noise) / F.greatest(F.sum(n) - F.count("*"), F.lit(1))
    inner = F.sum(n * parent * (1 - parent)) / F.sum(n)
    return F.least(F.greatest(F.when(between > 0, inner / between - 1).otherwise(STRENGTH[1]), F.lit(STRENGTH[0])), F.lit(STRENGTH[1])).alias(f"k_{label}")


def posteriors(scored: DataFrame, host: str, path: str, labels: list[str]) -> DataFrame:
    """Adds <label>: the document's posterior probability. scored: host, path, p_<label>, and <label>_known (0/1 or null)."""
    evidence = {c: F.coalesce(F.col(f"{c}_known").cast("double"), F.col(f"p_{c}")) for c in labels}
    base = scored.withColumns({f"e_{c}": e for c, e in evidence.items()})
    at = shared_dir(scored.sparkSession)
    paths = base.groupBy(F.col(host).alias("h_"), F.col(path).alias("q_")).agg(F.count("*").cast("double").alias("n"), *[F.sum(f"e_{c}").alias(f"s_{c}") for c in labels])
    paths = stored(paths, f"{at}/paths")
    hosts = stored(paths.groupBy("h_").agg(F.sum("n").alias("n"), *[F.sum(f"s_{c}").alias(f"s_{c}") for c in labels]), f"{at}/hosts")
    whole = hosts.agg(*[(F.sum(f"s_{c}") / F.sum("n")).alias(f"mu_{c}") for c in labels]).first()  # one row
    top = hosts.withColumns({f"mu_{c}": F.lit(whole[f"mu_{c}"]).cast("double") for c in labels})
    k_host = top.agg(*[_strength(top, c, F.col(f"s_{c}") / F.col("n"), F.col(f"mu_{c}")) for c in labels]).first()
    shrunk = top.withColumns({f"m_{c}": (F.col(f"s_{c}") + F.lit(k_host[f"k_{c}"]) * F.col(f"mu_{c}")) / (F.col("n") + F.lit(k_host[f"k_{c}"])) for c in labels})
    shrunk = shrunk.select(F.col("h_").alias("hh_"), *[f"m_{c}" for c in labels], *[f"mu_{c}" for c in labels])
    inner = stored(paths.join(shrunk, F.col("h_").eqNullSafe(F.col("hh_"))).drop("hh_"), f"{at}/inner")
    k_path = inner.agg(*[_strength(inner, c, F.col(f"s_{c}") / F.col("n"), F.col(f"m_{c}")) for c in labels]).first()
    table = inner.withColumns({f"kp_{c}": F.lit(k_path[f"k_{c}"]).cast("double") for c in labels})  # one row per path
    joined = base.join(table, F.col(host).eqNullSafe(F.col("h_")) & F.col(path).eqNullSafe(F.col("q_")))
    for c in labels:
        others = (F.col(f"s_{c}") - F.col(f"e_{c}") + F.col(f"kp_{c}") * F.col(f"m_{c}")) / (F.col("n") - 1 + F.col(f"kp_{c}"))
        odds = _logit(F.col(f"p_{c}")) + _logit(others) - _logit(F.col(f"mu_{c}"))
        joined = joined.withColumn(c, 1 / (1 + F.exp(-odds)))
    return joined.select(*[c for c in scored.columns if c not in labels], *labels)
