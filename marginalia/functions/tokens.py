"""Counting and cutting texts by the tokens of a vocabulary file: byte-level BPE ranks (``.tiktoken``), a tokenizer's JSON
(``.json``) or a SentencePiece model (``.model``). The file's path is a parameter and must be readable on every executor."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern published with the byte-level BPE vocabularies of 50,257 entries.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are encoded in stretches of about this many characters, cut before a single space between words. The split pattern begins a
#: piece there, so that counts by byte-level BPE don't depend on the cuts; other kinds of vocabularies may differ by a token at a cut.
STRETCH = 1_000_000
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")

_encoders: dict[str, Callable[[str], list[int]]] = {}


def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids, special tokens taken as ordinary text; loaded once in a process."""
    if path in _encoders:
        return _encoders[path]
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    elif path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        encode = lambda x: t.encode(x, add_special_tokens=False).ids
    elif path.endswith(".model"):
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        raise ValueError(f"unknown kind of vocabulary: {path}")
    _encoders[path] = encode
    return encode


def count(text: str, path: str = VOCABULARY) -> int:
    encode, n, at = encoder(path), 0, 0
    while len(text) - at > STRETCH and (cut := BOUNDARY.search(text, at + STRETCH)):
        n, at = n + len(encode(text[at : cut.start()])), cut.start()
    return n + len(encode(text[at:]))


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """The number of tokens; null for null."""
    @F.pandas_udf(T.LongType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series([None if x is None else count(x, vocabulary) for x in series], dtype="Int64")

    return run(text)


def would_truncate(text: Column, window: int, vocabulary: str = VOCABULARY, special: int = 2) -> Column:
    """Whether a text and the special tokens around it exceed a model's window."""
    return token_count(text, vocabulary) + special > window


def truncate(text: Column, window: int, vocabulary: str = VOCABULARY, special: int = 2) -> Column:
    """``struct<ids array<int>, truncated boolean>``: the first ids that fit the window beside the special tokens."""
    @F.pandas_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("truncated", T.BooleanType())]))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode, room = encoder(vocabulary), max(window - special, 0)
        for series in texts:
            ids = [encode(x or "") for x in series]
            yield pd.DataFrame({"ids": [i[:room] for i in ids], "truncated": [len(i) > room for i in ids]})

    return run(text)
