"""Words and their hashes, for whole Arrow columns at a time.

A word is a run of letters and digits, each character lower-cased by itself; its hash depends on nothing but its characters.
``hashed_words`` reads the characters of all texts as one array: a table tells which of them belong to words, another what each adds to the
hash, so that no word becomes a Python string.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import regex

WORD = regex.compile(r"[\p{L}\p{N}]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD1342543DE82EF95)
PART = 1 << 20  # characters that are read at once


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return [w.lower() for w in WORD.findall(text)] if text else []


def fold(text: str) -> str:
    """Without case and accents: composed and decomposed forms agree."""
    if text.isascii():
        return text.lower()
    flat = unicodedata.normalize("NFKD", text)
    if not flat.isascii():
        code = np.frombuffer(flat.encode("utf-32-le", "replace"), np.uint32)
        flat = code[~_tables()[2][code]].tobytes().decode("utf-32-le")
    return flat.casefold()


def bare_words(text: str | None) -> list[str]:
    return WORD.findall(fold(text)) if text else []


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character: whether it belongs to words, what it adds to a hash (as much as its lower case), whether it is a combining mark."""
    last = sys.maxunicode + 1
    every = np.delete(np.arange(last, dtype=np.uint32), slice(0xD800, 0xE000))  # no halves of pairs
    text = every.tobytes().decode("utf-32-le")
    code = lambda m: [int(every[i]) for i in range(m.start(), m.end())]
    inside, mark, lower = np.zeros(last, bool), np.zeros(last, bool), np.arange(last)
    for m in WORD.finditer(text):
        inside[every[m.start() : m.end()]] = True
    mark[[i for m in regex.finditer(r"\p{M}+", text) for i in code(m) if unicodedata.combining(chr(i))]] = True
    for i in (i for m in regex.finditer(r"[\p{Lu}\p{Lt}\p{Nl}]+", text) for i in code(m)):
        if len(low := chr(i).lower()) == 1:
            lower[i] = ord(low)
    worth = np.random.default_rng(20240229).integers(0, 2**63, last, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return inside, worth[lower], mark


def hashed_words(texts: list[str | None], bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in one array, and where each text's words start in it (one more at the end). With ``bare``, of the
    texts without case and accents."""
    texts = [(fold(x) if bare else x) if x else "" for x in texts]
    found, count, at = [], [], 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) < PART):
            size, end = size + len(texts[end]) + 1, end + 1
        h, starts = _hash("\n".join(texts[at:end]))
        edge = np.cumsum([len(x) + 1 for x in texts[at:end]])
        found.append(h)
        count.append(np.diff(np.searchsorted(starts, edge), prepend=0))
        at = end
    start = np.concatenate([[0], *count]).cumsum()
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), start


def _hash(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, and at which character each begins."""
    inside, worth, _ = _tables()
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    word = inside[code]
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = last - first
    if not len(first):
        return np.zeros(0, np.uint64), first
    offset = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(offset, size)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()), BASE))
        h = np.add.reduceat(worth[code[word]] * power[place], offset)
        h = (h ^ (h >> np.uint64(32)) ^ size.astype(np.uint64)) * MIX
    return h ^ (h >> np.uint64(29)), first


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each word but the last n - 1; order matters."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - n + 1, np.uint64)
        for i in range(n):
            h = (h ^ words[i : len(words) - n + 1 + i]) * MIX
            h ^= h >> np.uint64(29)
        return h


def gram_sets(words: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of n-grams of each text, sorted, in one array, and where each begins; of a text of fewer than n words none."""
    count = np.maximum(np.diff(start) - n + 1, 0)
    edge = np.concatenate([[0], np.cumsum(count)])
    all_ = grams(words, n)[np.arange(edge[-1]) + np.repeat(start[:-1] - edge[:-1], count)] if edge[-1] else np.zeros(0, np.uint64)
    for a, b in each(edge):
        all_[a:b].sort()
    new = np.ones(len(all_), bool)
    new[1:] = all_[1:] != all_[:-1]
    new[edge[:-1][count > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return all_[new], kept[edge]


def each(start: np.ndarray):
    return zip(start[:-1].tolist(), start[1:].tolist())


def as_signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
