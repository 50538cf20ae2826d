"""The registered queries on the smallest tables, the pipeline against brute force, and the SQL oracle."""

import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from rillflow.llm import registry

from .test_decontaminate import brute as contaminated
from .test_neardup import brute as duplicates

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_tiff_pages": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op2_winnowing": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op3_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_language": "doc_id held_out lang_pred score",
    "op5_katz": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6_mixing": "doc_id size source_size target taken",
    "op7_token_files": "doc_id start n_tokens ids_crc32",
    "op8_neardup": "doc_id n_shingles component_id kept",
    "op9_quality": "doc_id quality toxic kept",
    "op10_site_style": "page_id url text n_chars",
}


def test_all_ten_are_registered():
    assert set(registry.queries()) == set(COLUMNS) and set(registry.oracle_sql()) <= set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_every_row_has_its_row(spark, name):
    df = registry.queries()[name](spark, DIR)
    want = COLUMNS[name].split()
    assert df.columns[: len(want)] == want
    key = want[0]
    table = spark.read.parquet(f"{DIR}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    assert Counter(r[0] for r in df.select(key).collect()) == Counter(r[0] for r in table.select(key).collect())


def test_oracle(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        p = f"{DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if Path(p).is_dir() else ''}'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, DIR)
        rel = con.execute(sql)
        names = [c[0] for c in rel.description]
        assert Counter(map(tuple, df.select(names).collect())) == Counter(rel.fetchall())


def test_stages_keep_and_drop_what_they_should(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = spark.createDataFrame([(90_001, "123 ...", "en", "s", 7), (90_002, None, "en", "s", 0), (90_001, "123 ...", "en", "s", 7)], docs.schema)
    docs = docs.unionByName(odd)
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "mix", "tokens"] and corpus_pipeline.ORACLE_SQL is None
    lang = stages["language"](spark, docs, DIR)
    assert lang.columns == docs.columns
    left = sorted(r.doc_id for r in lang.collect())
    assert left == sorted(i for i in rows if re.search(r"[^\W\d_]", rows[i].text or ""))
    unique = stages["near_duplicates"](spark, lang.unionByName(lang.limit(3)), DIR)
    own = brute_kept = {i for i, (_, c, k) in duplicates([(i, rows[i].text) for i in left]).items() if k}
    assert Counter(r.doc_id for r in unique.collect()) == Counter(own)
    clean = stages["benchmark"](spark, unique, DIR)
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in contaminated([(i, rows[i].text) for i in brute_kept], items) if r[5]}
    assert Counter(r.doc_id for r in clean.collect()) == Counter(brute_kept - dirty)
    mixed = stages["mix"](spark, clean, DIR)
    taken = {r.doc_id: round(r.taken / r.size + 1e-9) for r in registry.mix_documents(spark, clean).collect() if r.size}
    got = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and sum(abs(got[i] - n) for i, n in taken.items()) <= 0.01 * len(taken) and max(got.values()) <= 3
    out = stages["tokens"](spark, mixed, DIR).collect()
    assert Counter(r.doc_id for r in out) == got


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)
