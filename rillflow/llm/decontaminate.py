"""Benchmark decontamination by winnowing.

Of every run of `w` successive k-gram hashes the smallest is kept (the rightmost of equals), on the
training and on the test side alike. Two texts that share k + w - 1 = 13 words in a row share a kept
hash at the same place of that run, so the join of fingerprints finds every shared span of 13 words.
A joined pair fixes an alignment of document and item; comparing the words along it extends the hit
and confirms every window on the words themselves. Items of fewer than 13 words are one window: for
each length that occurs, all grams of that length are fingerprints (winnowing with w = 1); a table of bits
of the items' grams drops nearly all others before they become rows.

The document side is cut into words and exploded once, and joined, never collected. What is compared with
the test side (fingerprints, word sequences, alignments) is broadcast while it numbers at most
`BROADCAST_ROWS` rows of bounded size (counted first, words too); beyond that the joins shuffle and adaptive
execution splits hot fingerprints. Ids of items, of which any number may have the same words, join by key.

Edge cases: null or wordless texts have no words, no hits and are not contaminated; null or wordless
items have no windows; repeated documents are judged one by one; items of equal words count as many
items; a null item_id counts as the empty string; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD, ascii_lower, shared_dir, stored, words

WINDOW = 13
GRAM = 5
BROADCAST_ROWS = 500_000
#: Words of the items broadcast at most, about 8 bytes each, and bits of the table of short items.
BROADCAST_WORDS = 4_000_000
BITS = 1 << 16
POSITION = (1 << 31) - 1


def text_words(text: Column) -> Column:
    """Lower-cased (A-Z) words; null gives none."""
    return words(ascii_lower(text), NOT_WORD)


def _marks(h: str, k: int, w: int) -> Column:
    """Winnowed fingerprints of the word-hash array h: hash in the high 32 bits, mirrored place in the low 31."""
    gram = lambda x, i: (F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k))).bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(1 << 31)).bitwiseOR(F.lit(POSITION).cast("long") - i)  # noqa: E731, E501
    n = F.size(h)
    return F.when(n >= k + w - 1, F.transform(F.slice(h, F.lit(1), n - (k - 1)), gram)).otherwise(F.array().cast("array<long>"))


def fingerprints(df: DataFrame, keys: list[str], w_col: str, plans: list[tuple[int, int, int]], bits: bytes | None = None) -> DataFrame:
    """keys, plan, fp, at: kept hashes and the places of their grams (from 0). keys must be small columns.

    plans: (number, k, w) of each kind of fingerprint. bits: a table in which fingerprints of plans other than 0 are looked up.
    """
    out = df.select(*keys, F.transform(w_col, lambda x: F.xxhash64(x)).alias("h_"))
    for plan, k, w in plans:  # a step each, so that a step's array is made once
        if w > 1:
            out = out.withColumn(f"g{plan}_", _marks(F.col("h_"), k, w))
            g = F.col(f"g{plan}_")
            low = F.transform(F.slice(g, F.lit(1), F.greatest(F.size(g) - (w - 1), F.lit(0))), lambda x, i: F.least(x, *(F.get(g, i + j) for j in range(1, w))))  # noqa: B023
            out = out.withColumn(f"m{plan}_", F.array_distinct(low)).drop(f"g{plan}_")
        else:
            marks = _marks(F.col("h_"), k, w)
            out = out.withColumn(f"m{plan}_", marks if bits is None else F.filter(marks, lambda x: F.substring(F.lit(bits), F.pmod(F.shiftrightunsigned(x, 31), F.lit(BITS)).cast("int") + 1, 1) == F.lit(b"\x01")))
    numbered = F.concat(*[F.transform(f"m{p}_", lambda x: F.struct(F.lit(p).alias("plan"), x.alias("mark"))) for p, _, _ in plans])  # noqa: B023
    mark = F.col("m_.mark")
    # explode() would push a filter on the array's size, and with it the array's whole computation, below each step
    return out.select(*keys, F.explode_outer(numbered).alias("m_")).filter(mark.isNotNull()).select(
        *keys, F.col("m_.plan").alias("plan"), F.shiftrightunsigned(mark, 31).alias("fp"), (F.lit(POSITION).cast("long") - mark.bitwiseAND(F.lit(POSITION))).cast("int").alias("at")
    )


def test_items(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """ik, iw, n, ids: one row per distinct word sequence of the benchmark."""
    w = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), text_words(F.col(text)).alias("iw"))
    return (
        w.filter(F.size("iw") > 0)
        .groupBy("iw")
        .agg(F.collect_set("id").alias("ids"))
        .select(F.xxhash64("iw", F.size("iw")).alias("ik"), "iw", F.size("iw").alias("n"), "ids")
    )


def _small(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def decontaminate(docs: DataFrame, key: str, text: str, items: DataFrame, item_id: str, item_text: str, window: int = WINDOW) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256 and contaminated to docs (columns of those names are replaced).

    Rows of equal key and text are judged once and alike; other columns are kept, whatever their names but those that end in _.
    """
    k, span = min(GRAM, window), window
    at = shared_dir(docs.sparkSession)
    test = stored(test_items(items, item_id, item_text), f"{at}/test")
    short = sorted(r[0] for r in test.filter(F.col("n") < span).select("n").distinct().collect())  # at most window - 1 numbers
    plans = [(0, k, span - k + 1), *((n, n, 1) for n in short)]
    marks = None
    for plan in plans:
        chosen = test.filter(F.col("n") >= span) if not plan[0] else test.filter(F.col("n") == plan[0])
        some = fingerprints(chosen, ["ik", "n"], "iw", [plan])
        marks = some if marks is None else marks.unionByName(some)
    marks = stored(marks.select("plan", "fp", "ik", "n", F.col("at").alias("item_at")), f"{at}/marks")
    n_words = test.agg(F.sum(F.size("iw").cast("long"))).first()[0] or 0
    small = marks.count() <= BROADCAST_ROWS and n_words <= BROADCAST_WORDS
    bits = bytearray(BITS)
    for r in marks.filter("plan > 0").select(F.pmod("fp", F.lit(BITS)).cast("int")).distinct().collect():  # at most BITS numbers
        bits[r[0]] = 1

    kept = docs.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    keyed = kept.select(F.col(key).alias("k_"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t_"), F.col(text).alias("x_"))
    own = fingerprints(keyed.select("k_", "t_", text_words(F.col("x_")).alias("w_")), ["k_", "t_"], "w_", plans, bytes(bits))
    found = own.join(_small(marks, small), ["plan", "fp"]).select("k_", "t_", "ik", "n", (F.col("at") - F.col("item_at")).alias("shift"))
    found = stored(found.distinct(), f"{at}/found")
    few = found.count() <= BROADCAST_ROWS  # then the texts stay where they are

    texts = keyed.alias("d")
    placed = (
        texts.join(_small(found, few).alias("f"), F.col("f.k_").eqNullSafe(F.col("d.k_")) & (F.col("f.t_") == F.col("d.t_")))
        .select("f.k_", "f.t_", "ik", "shift", text_words(F.col("x_")).alias("w_"), "n")
        .select("k_", "t_", "ik", "shift", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.get("w_", j + F.col("shift"))).alias("seg"))
    )
    w = F.least(F.col("n"), F.lit(span))
    equal = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.coalesce(F.get("seg", j) == F.get("iw", j), F.lit(False)))
    starts = F.filter(F.sequence(F.lit(0), F.col("n") - w), lambda s: F.forall(F.sequence(s, s + w - 1), lambda j: F.get("eq", j)))
    hits = (
        placed.join(_small(test.select("ik", "iw", "n"), small), "ik")
        .select("k_", "t_", "ik", "shift", "n", equal.alias("eq"))
        .select("k_", "t_", "ik", "shift", w.alias("w"), F.explode_outer(starts).alias("s"))
        .filter(F.col("s").isNotNull())
    )
    hits = stored(hits, f"{at}/hits")
    places = F.sequence(F.col("s") + F.col("shift"), F.col("s") + F.col("shift") + F.col("w") - 1)
    n_hit = hits.select("k_", "t_", F.explode(places).alias("p")).distinct().groupBy("k_", "t_").agg(F.count("*").alias("n_hit"))
    named = hits.select("k_", "t_", "ik").distinct().join(test.select("ik", "ids"), "ik")
    ids = named.select("k_", "t_", F.explode("ids").alias("id")).distinct().groupBy("k_", "t_").agg(F.array_sort(F.collect_set("id")).alias("ids"))  # a document's items
    judged = n_hit.alias("a").join(ids.alias("b"), F.col("a.k_").eqNullSafe(F.col("b.k_")) & (F.col("a.t_") == F.col("b.t_"))).select("a.k_", "a.t_", "n_hit", "ids")

    counted = kept.withColumn("kk_", F.col(key)).withColumn("tt_", F.xxhash64(F.coalesce(text, F.lit("")))).withColumn("n_words", F.size(text_words(F.col(text))).cast("long"))
    out = counted.join(judged, F.col("kk_").eqNullSafe(F.col("k_")) & (F.col("tt_") == F.col("t_")), "left")
    none = F.array().cast("array<string>")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        *kept.columns,
        "n_words",
        hit.alias("n_hit"),
        F.size(F.coalesce("ids", none)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("ids", none)), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bk))),
m AS (SELECT doc_id, item_id, i, dg.k FROM dg JOIN bw ON dg.k = bw.k AND dg.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0)) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""
