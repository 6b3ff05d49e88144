"""Exact BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece exactly one token can end its encoding. An automaton over all tokens
lists, for each prefix, the tokens that are suffixes of it, longest first; the one that is
compatible with the last token of the prefix before it is stored. Following the stored tokens back
from the end gives the encoding, the same ids that merging pairs by rank would give.

Two neighbouring tokens are compatible if no merge of lower rank would have joined a right end of
the first with a left end of the second while both existed. The test unrolls both merge trees from
the latest merge to the earliest.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import mapped, sha256_hex, without

#: Words kept in a worker before the older half is forgotten; bounds memory only.
CACHED_WORDS = 200_000
CACHED_PAIRS = 1_000_000
NEVER = 1 << 60
#: These separate words for str.split but are no white space for the tokenizer.
ODD_SPACES = regex.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"\p{White_Space}+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files of byte-level BPE."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A vocabulary file with word-end suffix: tokens, merge ranks and the automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.tokens: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        # inside a piece a symbol is a byte, and its last one a byte plus 256
        size = max(self.tokens) + 1
        self.length, self.rank, self.parts = [0] * size, [-1] * size, [(-1, -1)] * size
        self.joined: dict[int, int] = {}
        self.symbols: list[str] = [""] * size
        self.automaton = ahocorasick.Automaton()
        for text, i in model["vocab"].items():
            final = text.endswith(self.suffix) and text != self.suffix
            body = [byte_of[c] for c in (text.removesuffix(self.suffix) if final else text)]
            if final:
                body[-1] += 256
            s = "".join(map(chr, body))
            self.symbols[i], self.length[i] = s, len(s)
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        id_of = {s: i for i, s in enumerate(self.symbols) if s}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y = model["vocab"][a], model["vocab"][b]
            t = id_of[self.symbols[x] + self.symbols[y]]
            self.rank[t], self.parts[t] = rank, (x, y)
            self.joined[x << 20 | y] = rank
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        marks = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.marks = regex.compile(f"({marks})")

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging keeps a boundary between these two tokens."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, x: int, y: int) -> bool:
        rank, parts = self.rank, self.parts
        x_ends = y_ends = NEVER  # rank of the merge that uses the token up
        while True:
            joint = self.joined.get(x << 20 | y)
            # of equal merges the leftmost comes first
            if joint is not None and joint < x_ends and joint <= y_ends:
                return False
            if rank[x] < 0 and rank[y] < 0:
                return True
            if rank[y] >= rank[x]:
                y_ends, y = rank[y], parts[y][0]
            else:
                x_ends, x = rank[x], parts[x][1]

    def stands(self, token: int) -> bool:
        """Whether the token's own text encodes as this token alone."""
        known = self.whole.get(token)
        if known is None:
            a, b = self.parts[token]
            if a < 0:
                known = True
            else:  # both halves stand, and nothing joins them before the token's own merge
                known = self.stands(a) and self.stands(b) and self._split_until(a, b, self.rank[token])
            self.whole[token] = known
        return known

    def _split_until(self, x: int, y: int, end: int) -> bool:
        rank, parts = self.rank, self.parts
        x_ends = y_ends = end
        while True:
            joint = self.joined.get(x << 20 | y)
            if joint is not None and joint < x_ends and joint <= y_ends and joint < end:
                return False
            if rank[x] < 0 and rank[y] < 0:
                return True
            if rank[y] >= rank[x]:
                y_ends, y = rank[y], parts[y][0]
            else:
                x_ends, x = rank[x], parts[x][1]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        text = data[:-1].decode("latin-1") + chr(data[-1] + 256)
        last = [-1] * (len(text) + 1)
        length = self.length
        for end, token in self.automaton.iter(text):
            if last[end + 1] < 0:
                start = end + 1 - length[token]
                if self.compatible(last[start], token) if start else self.stands(token):
                    last[end + 1] = token
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= length[last[at]]
        out.reverse()
        return out

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a text without white space."""
        lowered = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        return tuple(chain.from_iterable(self.piece(p.encode()) for p in self.pieces.findall(lowered)))

    def known(self, word: str) -> tuple[int, ...]:
        ids = self.new.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                ids = self.word(word)
            if len(word) < 64:
                if len(self.new) >= CACHED_WORDS:
                    self.old, self.new = self.new, {}
                self.new[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for n, part in enumerate(self.marks.split(text) if "<|" in text else [text]):
            if n % 2:
                out.append(self.special[part])
                continue
            words = SPACE.split(part) if ODD_SPACES.search(part) else part.split()
            new, known = self.new, self.known
            for w in words:
                ids = new.get(w)
                if ids is None:
                    ids = known(w)
                    new = self.new
                out += ids
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encoded(path: str, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            ends, ids = [0], []
            for t in batch.column(text).to_pylist():
                ids.append(np.array(vocab.encode(t) if t else [], dtype=np.int32))
                ends.append(ends[-1] + len(ids[-1]))
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [f"c{i}" for i in range(batch.num_columns + 1)])

    return run


def _decoded(path: str, ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path).tokens
        table = pa.array([tokens.get(i, "") for i in range(max(tokens) + 1)])
        for batch in batches:
            lists = batch.column(ids)
            words = table.take(lists.flatten())
            offsets = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()))).astype(np.int32)
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words), " ")
            if lists.null_count:
                texts = pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [f"c{i}" for i in range(batch.num_columns + 1)])

    return run


IDS = T.ArrayType(T.IntegerType())


def _added(df: DataFrame, run, *added: tuple[str, T.DataType]) -> DataFrame:
    # columns travel under plain numbers, so that no name can clash
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    fields = [*inner.schema.fields, *(T.StructField("", kind) for _, kind in added)]
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    return mapped(inner, run, schema).toDF(*df.columns, *(name for name, _ in added))


def encode(df: DataFrame, vocabulary_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """df plus a column of token ids (array of int), as the vocabulary's own library encodes text_col.

    A null or empty text has no ids. Strings of special tokens inside a text become those tokens.
    Rows are independent, so repeated rows get equal ids, and other columns pass through; an
    existing column called out is replaced.
    """
    df = without(df, out)
    return _added(df, _encoded(vocabulary_path, df.columns.index(text_col)), (out, IDS))


def decode(df: DataFrame, vocabulary_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df plus the text of its ids: the tokens joined by one space, special tokens included.

    Null ids give a null text and no ids an empty one; an existing column called out is replaced.
    """
    df = without(df, out)
    return _added(df, _decoded(vocabulary_path, df.columns.index(ids_col)), (out, T.StringType()))


def encode_and_decode(df: DataFrame, vocabulary_path: str, text_col: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """decode(encode(df)) in one pass, so that a task has one Python worker."""
    df = without(df, ids, decoded)
    there = _encoded(vocabulary_path, df.columns.index(text_col))
    back = _decoded(vocabulary_path, len(df.columns))
    return _added(df, lambda batches: back(there(batches)), (ids, IDS), (decoded, T.StringType()))


def word_vocabulary() -> str:
    """Where the public vocabulary with word ends lies."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and digests of its ids and of their decoded text."""
    path = word_vocabulary()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_and_decode(docs, path)
    return out.selectExpr(
        "doc_id", "cast(size(ids) as bigint) as n_tokens", "sha2(array_join(cast(ids as array<string>), ' '), 256) as ids_sha256"
    , "decoded").select("doc_id", "n_tokens", "ids_sha256", sha256_hex("decoded").alias("decoded_sha256"))
