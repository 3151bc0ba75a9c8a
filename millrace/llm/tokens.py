"""Encoding a whole corpus with a public byte-level BPE tokenizer (problem 6).

Method: a table of distinct words. Spark splits the texts into the tokenizer's
words; each distinct word is encoded once; ids are joined back by position.

The tokens of a corpus are far more than its texts, so they are never exploded
into rows. Texts are cut into blocks of about BLOCK_WORDS words. In a block every
text is a list of codes into the block's own list of distinct words. Only those
lists are exploded: (block, code, word) meets (word, ids) in a shuffle in which
a word stands once a block, however frequent it is. At last each block's codes
meet the ids of its words, and the ids of a text come out by array arithmetic.

Texts with signs that the JVM's Unicode tables don't know are split by the
tokenizer itself, so the result doesn't depend on the Java version.

Defined results: a null text and the empty text both give the empty list; blank
texts are ordinary; the strings of special tokens in a text are ordinary text;
repeated doc_ids and null ones give a row each, in encoding and decoding; columns
other than id and text are ignored; ids without a piece decode to nothing, and bytes
that aren't UTF-8 to the replacement sign.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize, ship

#: Where the public tokenizers' files are.
TOKENIZERS = "/opt/tokenizers"
#: Words of a block; with them it has some ten thousand distinct words and a few MB.
BLOCK_WORDS = 400_000
#: Fixed value: the word pattern of the tokenizer's vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BLOCKS = "block long, doc_ids array<long>, lengths array<int>, codes array<int>, words array<string>"


def _ranks(directory: str, name: str) -> dict[bytes, int]:
    path = os.path.join(directory, f"{name}.tiktoken")
    if not os.path.exists(path):  # the package that holds the files may be elsewhere on this machine
        import public_tokenizers

        path = public_tokenizers.path(f"{name}.tiktoken")
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@lru_cache(maxsize=4)
def encoding(directory: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    """The tokenizer, read from its file once a process."""
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=_ranks(directory, name), special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def _one(values) -> pa.ListArray:
    """One row that holds them all."""
    values = values if isinstance(values, pa.Array) else pa.array(values, pa.int32())
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _block(number: int, ids: pa.Array, lengths, codes, distinct: pa.Array, name: str) -> pa.RecordBatch:
    columns = [pa.array([number], pa.int64()), _one(ids), _one(lengths), _one(codes), _one(distinct)]
    return pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", "lengths", "codes", name])


def _blocker(block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts as lists of words, or null with the raw text, into rows of _BLOCKS."""
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            words, raw = batch.column("words"), batch.column("raw")
            if raw.null_count < batch.num_rows:
                lists = words.to_pylist()
                for i, text in enumerate(raw.to_pylist()):
                    if text is not None:
                        lists[i] = _pattern().findall(text)
                words = pa.array(lists, pa.list_(pa.string()))
            lengths = np.diff(words.offsets.to_numpy())
            flat, base = words.flatten(), np.concatenate([[0], np.cumsum(lengths)])
            ids = batch.column("doc_id")
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(base, base[start] + block_words, "right")) - 1)
                part = flat.slice(base[start], base[end] - base[start]).dictionary_encode()
                yield _block(number, ids.slice(start, end - start), lengths[start:end], part.indices, part.dictionary, "words")
                number += 1
                start = end

    return run


def blocks(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The corpus in blocks of _BLOCKS, written to the shared folder."""
    ship(documents.sparkSession)
    unknown = F.coalesce(F.col("text").rlike(r"\p{Cn}"), F.lit(False))
    split = F.regexp_extract_all(F.col("text"), F.lit("(?U)" + PATTERN), F.lit(0))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(unknown, F.array().cast("array<string>")).otherwise(F.coalesce(split, F.array().cast("array<string>"))).alias("words"),
        F.when(unknown, F.col("text")).alias("raw"),
    )
    return materialize(rows.mapInArrow(_blocker(block_words), _BLOCKS), "blocks")


def _encoder(directory: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(directory, name).encode_ordinary
        for batch in batches:
            words = batch.column("word")
            yield pa.RecordBatch.from_arrays([words, pa.array([encode(w) for w in words.to_pylist()], pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def word_table(cut: DataFrame, directory: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(word, ids): each distinct word of the blocks, encoded once."""
    words = cut.select(F.explode("words").alias("word")).distinct()
    return materialize(words.mapInArrow(_encoder(directory, name), "word string, ids array<int>"), "words")


def _assemble(block: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of a block's texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    if not block.num_rows:
        return schema.empty_table()
    lists = words.column("ids").combine_chunks() if words.num_rows else pa.array([], pa.list_(pa.int32()))
    place = words.column("code").to_numpy() if words.num_rows else np.zeros(0, np.int32)
    sizes, starts = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    offsets = lists.offsets.to_numpy()
    sizes[place], starts[place] = np.diff(offsets), offsets[:-1] - (offsets[0] if len(offsets) else 0)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    one = lambda c: block.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    codes = one("codes")
    many = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(starts[codes] - ends[:-1], many) + np.arange(ends[-1])
    cuts = ends[np.concatenate([[0], np.cumsum(one("lengths"), dtype=np.int64)])]
    ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat[at] if len(at) else flat[:0], pa.int32()))
    return pa.Table.from_arrays([block.column("doc_ids").combine_chunks().flatten(), ids], schema=schema)


def encode(documents: DataFrame, directory: str = TOKENIZERS, name: str = "byte_bpe_50k", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, ids) of every document of (doc_id, text)."""
    cut = blocks(documents, block_words)
    words = word_table(cut, directory, name)
    listed = cut.select("block", F.posexplode("words").alias("code", "word"))
    coded = listed.join(words, "word").select(F.col("block").alias("of"), "code", "ids")
    texts = cut.select("block", "doc_ids", "lengths", "codes")
    return texts.groupBy("block").cogroup(coded.groupBy("of")).applyInArrow(_assemble, "doc_id long, ids array<int>")


def pieces(spark, directory: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, piece): the bytes of each id; as many rows as the vocabulary has entries."""
    rows = [(number, bytearray(piece)) for piece, number in _ranks(directory, name).items()]
    return spark.createDataFrame(rows, "id int, piece binary")


#: Ids of a block that is decoded at once.
BLOCK_IDS = 1_000_000


def _id_blocker(block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lists, docs = batch.column("ids"), batch.column("doc_id")
            lengths = np.diff(lists.offsets.to_numpy())
            flat, base = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(base, base[start] + block_ids, "right")) - 1)
                distinct, codes = np.unique(flat[base[start] : base[end]], return_inverse=True)
                yield _block(number, docs.slice(start, end - start), lengths[start:end], codes.astype(np.int32), pa.array(distinct, pa.int32()), "ids")
                number += 1
                start = end

    return run


def _spell(block: pa.Table, listed: pa.Table) -> pa.Table:
    """The texts of a block, from the pieces of its distinct ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    if not block.num_rows:
        return schema.empty_table()
    parts = [b""] * listed.num_rows
    for code, piece in zip(listed.column("code").to_pylist(), listed.column("piece").to_pylist(), strict=True):
        parts[code] = piece or b""
    one = lambda c: block.column(c).combine_chunks().flatten()
    codes = one("codes").to_pylist()
    ends = np.cumsum(one("lengths").to_numpy(zero_copy_only=False), dtype=np.int64).tolist()
    texts = [b"".join([parts[c] for c in codes[a:b]]).decode("utf-8", "replace") for a, b in zip([0, *ends], ends, strict=False)]
    return pa.Table.from_arrays([one("doc_ids"), pa.array(texts, pa.string())], schema=schema)


def decode(encoded: DataFrame, directory: str = TOKENIZERS, name: str = "byte_bpe_50k", block_ids: int = BLOCK_IDS) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids), by a join of ids with their pieces.

    As in encoding, rows go in blocks, and only a block's distinct ids meet the
    vocabulary, whose size is fixed, so it is broadcast.
    """
    spark = encoded.sparkSession
    ship(spark)
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.filter("ids", lambda x: x.isNotNull()), F.array().cast("array<int>")).cast("array<int>").alias("ids"))
    cut = materialize(rows.mapInArrow(_id_blocker(block_ids), "block long, doc_ids array<long>, lengths array<int>, codes array<int>, ids array<int>"), "id-blocks")
    listed = cut.select(F.col("block").alias("of"), F.posexplode("ids").alias("code", "id")).join(F.broadcast(pieces(spark, directory, name)), "id", "left").select("of", "code", "piece")
    return cut.select("block", "doc_ids", "lengths", "codes").groupBy("block").cogroup(listed.groupBy("of")).applyInArrow(_spell, "doc_id long, text string")
