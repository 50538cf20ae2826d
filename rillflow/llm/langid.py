"""Language identification of mixed-language text.

Words (runs without ASCII white space; only their letters count) get a log score per language from
hashed letter trigrams. The script of a word, read from Unicode ranges, leaves only the languages that
were seen in that script. Viterbi decoding over the words, with a penalty for every switch of language,
labels spans; the document's language is the one whose spans hold the most letters. Its score is the mean
over the letters of all words of the language's probability, given the word alone: lower for texts of other
languages in part, and for texts whose words say little.

Training takes at most about `PER_LANGUAGE` documents of each language, chosen by a hash of
their keys: a bound that is a parameter. Everything else covers all words of all documents.

Edge cases: null text and text without a letter give `und` with score 0 and no spans; words of a script
that no language was trained on carry no evidence; ties go to the language first by code point; without
any training row every document is `und`. An empty table gives no rows. Repeated rows are scored one by one. Columns of the input are
kept, apart from the names added.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chance, split_words, tidied

PER_LANGUAGE = 2000
BUCKETS = 1 << 16
#: Nats: what switching costs, and the most that one word can say against a language.
SWITCH, WORD_LIMIT = 8.0, 4.0
#: A language uses a script that holds this share of its training letters.
SCRIPT_SHARE = 0.01
SMOOTHING = 0.5
BYTES_AT_ONCE = 2 << 20

# First code points of Unicode script ranges, in order; 0 means any other.
SCRIPT_STARTS = [0x0000, 0x0041, 0x0250, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x4E00, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00]
SCRIPTS = ["other", "latin", "other", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "devanagari", "indic", "thai", "other", "georgian", "hangul", "ethiopic", "latin", "greek", "other", "hiragana", "katakana", "other", "han", "other", "hangul", "other", "han", "other"]
SCRIPT_NAMES = sorted(set(SCRIPTS))


def _letters() -> np.ndarray:
    """Whether each code point of the basic plane is a letter; made once in a worker process."""
    held = sys.modules.setdefault("_rillflow_letters", types.ModuleType("_rillflow_letters")).__dict__
    if "basic" not in held:
        held["basic"] = np.array([chr(i).isalpha() for i in range(1 << 16)])
    return held["basic"]


def _is_letter(points: np.ndarray) -> np.ndarray:
    out = _letters()[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        kinds, back = np.unique(points[high], return_inverse=True)
        out[high] = np.array([chr(x).isalpha() for x in kinds])[back]
    return out


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every letter of the words: its word, the bucket of the trigram around it, its script."""
    points = np.frombuffer(("\0" + "\0".join(words) + "\0").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = _is_letter(points) | (points == 0)
    points = points[keep]
    middle = np.flatnonzero(points != 0)
    word = np.cumsum(points == 0)[middle] - 1
    a, b, c = (points[middle + d].astype(np.uint64) for d in (-1, 0, 1))
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    script = np.array([SCRIPT_NAMES.index(s) for s in SCRIPTS])[np.searchsorted(np.array(SCRIPT_STARTS, np.uint32), points[middle], "right") - 1]
    return word, (h >> np.uint64(48)).astype(np.int64), script


@dataclass
class Model:
    """languages in code-point order; logp: languages x BUCKETS; uses: scripts x languages."""

    languages: list[str]
    logp: np.ndarray
    uses: np.ndarray

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """words x languages scores, best 0 and none below -WORD_LIMIT; and letters per word."""
        k, n = len(self.languages), len(words)
        word, bucket, script = grams(words)
        letters = np.bincount(word, minlength=n)
        scores = np.stack([np.bincount(word, self.logp[i][bucket], minlength=n) for i in range(k)], axis=1).astype(np.float64)
        first = np.zeros(n, np.int64)
        at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        first[word[at]] = script[at]
        known = self.uses[first]
        some = known.any(axis=1)
        scores[~known & some[:, None]] = -np.inf
        scores -= scores.max(axis=1, keepdims=True)
        scores = np.maximum(scores, -WORD_LIMIT)
        scores[(letters == 0) | ~some] = 0
        return scores, letters


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path of languages over words: sum of scores minus `switch` for each change.

    If no run of words gains as much against the best single language as one switch costs, that
    language is the best path; else dynamic programming finds it.
    """
    n = len(scores)
    best = int(scores.sum(axis=0).argmax())
    gain = np.cumsum((scores - scores[:, best : best + 1]).max(axis=1))
    if n == 0 or (gain - np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]))).max() <= switch:
        return np.full(n, best)
    back = []
    value = scores[0].tolist()
    kinds = range(len(value))
    for row in scores[1:].tolist():
        top = max(value)
        lead = value.index(top)
        step = [i if value[i] >= top - switch else lead for i in kinds]
        value = [row[i] + (value[i] if step[i] == i else top - switch) for i in kinds]
        back.append(step)
    path = [value.index(max(value))]
    for step in reversed(back):
        path.append(step[path[-1]])
    return np.array(path[::-1])


COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("n", T.LongType())])


def train(docs: DataFrame, text: str, lang: str, key: str | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """Letter trigram and script counts of about per_language documents of each language.

    They are drawn by a hash of `key`; without one by a hash of the text, which draws copies together.
    """
    docs = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(key or text).alias("draw"))
    docs = docs.filter("text is not null and lang is not null")
    sizes = docs.groupBy("lang").count().select("lang", F.least(F.lit(1.0), per_language / F.col("count")).alias("share"))
    sample = docs.join(F.broadcast(sizes), "lang").filter(chance(F.col("draw")) < F.col("share")).select("lang", "text")  # a row per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            texts = b.column(1).to_pylist()
            for one in sorted(set(langs)):
                _, bucket, script = grams([w for i in np.flatnonzero(langs == one) for w in texts[i].split()])
                for kind, x in ((0, bucket), (1, script)):
                    at, n = np.unique(x, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int64))], names=COUNTS.names)

    rows = sample.mapInArrow(tidied(run, "_rillflow_letters"), COUNTS).groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toPandas()  # at most languages x (BUCKETS + scripts)
    languages = sorted(rows["lang"].unique().tolist())
    counts, scripts = np.zeros((len(languages), BUCKETS)), np.zeros((len(SCRIPT_NAMES), len(languages)))
    for i, one in enumerate(languages):
        own = rows[rows["lang"] == one]
        g, s = own[own["kind"] == 0], own[own["kind"] == 1]
        counts[i, g["at"].to_numpy()] = g["n"].to_numpy()
        scripts[s["at"].to_numpy(), i] = s["n"].to_numpy() / max(1, s["n"].sum())
    seen = max(1, int((counts.sum(axis=0) > 0).sum()))
    logp = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * seen))
    return Model(languages, logp, scripts >= SCRIPT_SHARE)


ADDED = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())]))),
]


def label(texts: pa.Array, model: Model) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """(language, score, spans) of each text."""
    split = split_words(texts, lower=False)
    at = split.offsets.to_numpy().tolist()
    coded = split.values.dictionary_encode()
    codes = coded.indices.to_numpy()
    if not model.languages or not len(codes):
        return [("und", 0.0, [])] * len(texts)
    scores, letters = model.word_scores(coded.dictionary.to_pylist())
    share = np.exp(scores)
    share /= share.sum(axis=1, keepdims=True)
    out = []
    for a, b in zip(at, at[1:]):  # noqa: B905
        own = codes[a:b]
        n = letters[own]
        total = int(n.sum())
        if not total:
            out.append(("und", 0.0, []))
            continue
        path = viterbi(scores[own])
        held = np.bincount(path, n, minlength=len(model.languages))
        best = int(held.argmax())
        cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
        spans = [(model.languages[path[x]], x, y - x) for x, y in zip(cuts, cuts[1:])]  # noqa: B905
        out.append((model.languages[best], min(1.0, float(n @ share[own, best]) / total), spans))
    return out


def identify(docs: DataFrame, text: str, model: Model, spans: bool = True) -> DataFrame:
    """Adds lang_pred, score and (where asked for) spans to docs."""
    added = ADDED if spans else ADDED[:2]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in {a.name for a in ADDED}] + added)
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = {f.name: f.type for f in to_arrow_schema(T.StructType(added))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            column = whole.schema.get_field_index(text)
            sizes = pc.binary_length(whole.column(column)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
            at = 0
            while at < whole.num_rows:
                done = sizes[at - 1] if at else 0
                to = min(max(int(np.searchsorted(sizes, done + BYTES_AT_ONCE, "right")), at + 1), whole.num_rows)
                b, at = whole.slice(at, to - at), to
                got = list(zip(*label(b.column(column), model), strict=True))
                columns = [b.column(b.schema.get_field_index(f.name)) for f in schema.fields[: len(schema.fields) - len(added)]]
                for f, x in zip(added, got, strict=False):
                    x = [[dict(zip(("lang", "first_word", "n_words"), s, strict=True)) for s in y] for y in x] if f.name == "spans" else list(x)
                    columns.append(pa.array(x, kinds[f.name]))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(tidied(run, "_rillflow_letters"), schema)
