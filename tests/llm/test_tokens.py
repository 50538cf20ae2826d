import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rillflow.llm import token_files as TF
from rillflow.llm.common import shared_dir
from rillflow.llm.registry import token_rows, tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return TF.Encoder(tokenizer_path(), TF.form(tokenizer_path()))


def plain(encoder, texts):
    return [encoder.tok.encode(t, add_special_tokens=False).ids for t in texts]


def encoded(encoder, texts):
    out = {}
    for rows, ids, at in encoder.encode(pa.array(texts, pa.large_string())):
        out |= {r: ids[x:y].tolist() for r, x, y in zip(rows.tolist(), at.tolist(), at[1:].tolist(), strict=False)}
    return [out.pop(i) for i in range(len(texts))]


def test_pieces_give_the_library_s_ids(encoder):
    assert encoder.form.by_piece
    rng = random.Random(1)
    texts = ["", " ", "  a", "a  b\n c", " lead", "trail ", "a\x1c b", "<|endoftext|> foo <|endoftext|>bar", "end<|endoftext|>", "it's don't\t\tx \n\n y", "x\ny", "x\n\ny", "\nx", "x\n", "ßüé Ünï ǅ ɐ", "日本 語", "a b", "ab...\nCd,", "%%% a$$$ b### !!"]
    texts += ["a\u3000 b", "a \u3000b", "\u00a0a b", "a b\u00a0", "a\u2003b c", "a\u0085\nb", "ab.\u0301 c", "é. e\u0301. f", "a\tb c", "\ta", "a.\u3000b c", "you'll! it's, 'S."]
    texts += ["".join(rng.choice("   \n\n\tab Zé1.!'日\u3000\x1c\u200b%|<>") for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += [" ".join("".join(rng.choice("abcé.,!'\n1\u3000\u00a0") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    assert encoded(encoder, texts) == plain(encoder, texts)
    for i in range(0, 100, 7):
        assert encoded(encoder, texts[i : i + 7]) == plain(encoder, texts[i : i + 7])
    assert encoded(encoder, ["", ""]) == [[], []] and encoded(encoder, []) == []


def test_long_texts_in_parts(encoder, monkeypatch):
    monkeypatch.setattr(TF, "BYTES_A_CALL", 60)
    texts = ["word  by  word " * 50, "one\tline " * 40 + " ", "x" * 500, "plain words here " * 30 + "end", "  <|endoftext|> a b " * 20]
    assert encoded(encoder, texts) == plain(encoder, texts)


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    other = TF.Encoder(path, TF.form(path))
    assert not other.form.by_piece
    texts = ["Hello there", "", "a  b\nc"]
    assert encoded(other, texts) == plain(other, texts)


def test_files_round_trip_in_key_order(spark, encoder):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["the", "house!", "é", "zz\nyy", "!"]) for _ in range(rng.randrange(0, 90)))) for i in rng.sample(range(1000), 200)]
    docs += [(2000, None), (2001, ""), (2002, "word " * 30_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, start int, ids string").repartition(5)
    at = shared_dir(spark)
    cuts = TF.cuts(df, "doc_id", "text", 8, (2000, 4000))
    assert len(cuts) > 5
    index = TF.write_files(TF.encoded(df, "doc_id", "text", tokenizer_path(), 0, cuts, encoder.form), f"{at}/t", len(cuts) + 1, wide=False, seq_len=64)
    index.write.parquet(f"{at}/i")
    index = spark.read.parquet(f"{at}/i")
    got = {r.key: (r.part, r.begin, r.n_tokens, r.ids_crc32) for r in TF.read_back(index, f"{at}/t").collect()}
    ahead = {r.part: r.ahead for r in TF.starts(index).collect()}
    pos = 0
    for key, text in sorted(docs):
        ids = encoder.tok.encode(text or "", add_special_tokens=False).ids + [0]
        part, begin, n, crc = got[key]
        assert (ahead[part] + begin, n, crc) == (pos, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert TF.TokenFile(f"{at}/t", part).ids(begin, n).tolist() == ids
        pos += n
    first = TF.TokenFile(f"{at}/t", 0)
    ids, mask = first.sequence(0)
    assert len(ids) == len(mask) == 64 and mask.all()


def test_repeated_null_and_missing_keys(spark):
    rows = [(7, "a b"), (7, "a b"), (None, "c"), (1, None)]
    got = token_rows(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and sorted(r.start for r in got)[0] == 0
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, 1, 7, 7]
    assert token_rows(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_hot_key_is_cut_between_files_in_the_same_way_each_time(spark, encoder):
    rows = [(5, f"text number {i} " * 20) for i in range(600)] + [(None, f"no key {i} " * 20) for i in range(300)] + [(i, "x") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cuts = TF.cuts(df, "doc_id", "text", 8, (2000, 20_000))
    assert sum(k == 5 for k, _ in cuts) > 3 and sum(k == TF.NULL_KEY for k, _ in cuts) > 2
    found = []
    for parts in (3, 7):
        at = shared_dir(spark)
        index = TF.write_files(TF.encoded(df.repartition(parts), "doc_id", "text", tokenizer_path(), 0, cuts, encoder.form), at + "/t", len(cuts) + 1, wide=False, seq_len=64)
        index.write.parquet(at + "/i")
        got = TF.read_back(spark.read.parquet(at + "/i"), at + "/t").collect()
        sizes = {}
        for r in got:
            sizes[r.part] = sizes.get(r.part, 0) + r.n_tokens
        assert max(sizes.values()) < 6 * sum(sizes.values()) / len(sizes)
        found.append(sorted(((r.key is not None, r.key or 0, r.part, r.begin, r.n_tokens, r.ids_crc32) for r in got)))
    assert found[0] == found[1] and len(found[0]) == 1000
    assert TF.cuts(df.repartition(9), "doc_id", "text", 8, (2000, 20_000)) == cuts


def test_parts_count_cuts_at_or_below():
    rng = random.Random(3)
    cuts = sorted({(rng.randrange(-3, 4), rng.randrange(-9, 9)) for _ in range(20)} | {((1 << 63) - 1, 3), (-(1 << 63), -2)})
    rows = [(rng.choice([*range(-4, 5), (1 << 63) - 1, -(1 << 63)]), rng.randrange(-10, 10)) for _ in range(500)]
    got = TF._parts(cuts, np.array([k for k, _ in rows]), np.array([m for _, m in rows]))
    assert got.tolist() == [sum(c <= r for c in cuts) for r in rows]
