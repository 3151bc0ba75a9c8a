import random

import pytest

from millrace.llm import tokens

DOCS = "doc_id long, text string, words string, ids string, block long"
TEXTS = [
    None, "", " ", "\n\n  \t x", "the cat's CAT the", "it's  we'LL they've 'tis", "don''t", "a" * 5000, "naïve Straße ſpeck ﬁn", "日本語のテキスト、混在 text", "emoji 👩‍👩‍👧 🇩🇪", "x y z\u0085w", "12,345.67e8 ½ ² Ⅷ", "<|endoftext|> is ordinary", "͸ unassigned \U0001fae9 signs", "\u0000\u001c\u001f controls", " lead and trail ", "\r\n\r\n", "tab\tsep\t\tx", "'s", "''s 's", "﻿bom", "é combining",
]


def encoded(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "clash", "clash", 0) for i, t in enumerate(texts)], DOCS)
    return tokens.encode(df, **options)


@pytest.mark.parametrize("block_words", [400_000, 7])
def test_ids_equal_those_of_the_tokenizer(spark, block_words):
    rng = random.Random(1)
    wild = ["".join(rng.choice("ab '\n\t1.,ſß日é  ") for _ in range(rng.randrange(60))) for _ in range(200)]
    texts = TEXTS + wild
    want = [tokens.encoding().encode_ordinary(t) if t else [] for t in texts]
    got = {r.doc_id: r.ids for r in encoded(spark, texts, block_words=block_words).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_round_trip(spark):
    got = {r.doc_id: r.text for r in tokens.decode(encoded(spark, TEXTS)).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [t or "" for t in TEXTS]


def test_another_vocabulary(spark):
    got = {r.doc_id: r.ids for r in encoded(spark, TEXTS, name="byte_bpe_multi_50k").collect()}
    enc = tokens.encoding(name="byte_bpe_multi_50k")
    assert [got[i] for i in range(len(TEXTS))] == [enc.encode_ordinary(t) if t else [] for t in TEXTS]


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "x")], "doc_id long, text string")
    a_b, x = (tokens.encoding().encode_ordinary(t) for t in ("a b", "x"))
    assert sorted(((r.doc_id, r.ids) for r in tokens.encode(df).collect()), key=repr) == [(1, a_b), (1, a_b), (None, x)]
    assert tokens.encode(df.limit(0)).count() == 0


@pytest.mark.parametrize("block_ids", [1_000_000, 3])
def test_a_text_for_each_row_of_ids(spark, block_ids):
    df = spark.createDataFrame([(1, "hello world"), (1, "foo bar baz"), (None, "x"), (None, None), (2, "")], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in tokens.decode(tokens.encode(df), block_ids=block_ids).collect()]
    assert sorted(got, key=repr) == sorted([(1, "hello world"), (1, "foo bar baz"), (None, "x"), (None, ""), (2, "")], key=repr)
    odd = spark.createDataFrame([(5, [70000, None, 64]), (6, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in tokens.decode(odd).collect()} == {5: "a", 6: ""}
    assert tokens.decode(tokens.encode(df.limit(0))).count() == 0


def test_each_word_is_encoded_once(spark):
    df = spark.createDataFrame([(i, "the same words again") for i in range(500)], "doc_id long, text string").repartition(6)
    cut = tokens.blocks(df, block_words=50)
    assert cut.count() > 20 and tokens.word_table(cut).count() == 4
