"""Ids and decoded texts against the tokenizers library."""

import random

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from siltworks.llm.bpe import Vocabulary, decode, encode, word_vocabulary

HARD = [
    "", " ", "\n", "Don't STOP we'll they'd I'm he's", "'s 's's don''t", "<|endoftext|> a<|startoftext|>b <|endoftext|>", "<|endoftext", "a" * 3000,
    "ΑΣ ΟΔΟΣ Σ ΣΑΣ", "İstanbul ıI", "é ́ ǟ", "café x y　z\x85w", "a\x1cb\x1fc\x1d", "日本語テキスト 한국어 ไทย العربية", "👩‍👩‍👧 ☃ 🇩🇪",
    "12345 3.14 ½ ² ٣", "!!!??? --- $$$*** &&&%%%", "aaaaabaaaaa", "x​y﻿z", "\x00\x01 \x7f", "ß ẞ Ǆ ǅ ﬁ", "word</w> </w>", "  lead and trail  ", "supercalifragilisticexpialidocious" * 40,
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(word_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_hard_texts_and_random_strings(library):
    vocab = Vocabulary(word_vocabulary())
    rng = random.Random(5)
    alphabets = ["ab", "aehinort ", "abcdefghijklmnopqrstuvwxyz'", "aéèüßñç ", "0123456789.,- ", "aA!?$ \n\t"]
    texts = HARD + ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(1, 60))) for _ in range(6000)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert vocab.encode(text) == want.ids, text


def test_every_token_alone(library):
    vocab = Vocabulary(word_vocabulary())
    words = [t.replace("</w>", "") for t in list(vocab.tokens.values())[::7]]
    for text, want in zip(words, library.encode_batch(words, add_special_tokens=False)):
        assert vocab.encode(text) == want.ids, text


def test_documents(spark, library):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path).selectExpr("doc_id", "text", "lang as ids", "1 as c0")
    extra = spark.createDataFrame([(None, None, "x", 1), (-1, "", None, 1), (-1, "", None, 1)], "doc_id long, text string, ids string, c0 int")
    out = decode(encode(docs.union(extra), word_vocabulary()), word_vocabulary())
    assert out.columns == ["doc_id", "text", "c0", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == pq.read_metadata(path).num_rows + 3
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert encode(docs.limit(0), word_vocabulary()).collect() == []
