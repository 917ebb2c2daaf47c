"""What the operators of this subpackage share: column names, row keys, and word hashing over Arrow buffers."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.session import map_batches as map_texts  # noqa: F401

#: Bytes of text hashed at once; a longer single text is one batch of its own.
BATCH_BYTES = 1 << 20

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have yet, also when case is ignored."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit key of a row's id and whole text; only rows that are alike in both share it. Nulls count as values."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> None:
    global _POW, _INV
    if len(_POW) < n:
        n = max(n, BATCH_BYTES + 1)
        for name, r in (("_POW", _R), ("_INV", _R_INV)):
            steps = np.full(n, r, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more than there are texts)."""
    texts = texts.cast(pa.large_string())
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def batches(*columns: pa.Array, limit: int = BATCH_BYTES) -> Iterator[list[pa.Array]]:
    """Slices of the columns with about limit bytes of the first, which holds texts; no text is cut."""
    _, at = _buffers(columns[0])
    start = 0
    while start < len(columns[0]):
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield [c.slice(start, end - start) for c in columns]
        start = end


#: What a character beyond ASCII is: a break between words, part of one, or a word by itself.
_BREAK, _PART, _ALONE = 0, 1, 2
#: Scripts without spaces between words, and kana.
_UNSPACED = ((0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3041, 0x30FF), (0x3100, 0x312F), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point: punctuation, spaces, controls and signs break; letters, digits and marks are parts; letters of scripts without spaces, and pictographs, stand alone."""
    out = np.full(0x110000, _PART, np.uint8)
    for first, last in _UNSPACED:
        out[first : last + 1] = _ALONE
    for c in (*range(128, 0x20000), *range(0xE0000, 0xE0200)):
        kind = unicodedata.category(chr(c))
        if kind[0] in "PZ" or kind in ("Cc", "Sm", "Sc", "Sk") or c in (0x200B, 0x2060, 0xFEFF):
            out[c] = _BREAK
        elif kind == "So":
            out[c] = _ALONE
    return out


def _beyond_ascii(data: np.ndarray, word: np.ndarray, cut: np.ndarray) -> None:
    """Sets word and cut, both by byte, for the characters beyond ASCII."""
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return
    size = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
    code = data[lead].astype(np.int64) & (0x7F >> size)
    for j in range(1, 4):
        more = size > j
        code[more] = code[more] << 6 | (data[lead[more] + j] & 0x3F)
    kind = _classes()[np.minimum(code, 0x10FFFF)]
    off = kind == _BREAK
    for j in range(4):
        word[lead[off & (size > j)] + j] = False
    alone = kind == _ALONE
    cut[lead[alone]] = True
    cut[lead[alone] + size[alone]] = True


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (one more than there are texts).

    Words are runs of letters, digits, marks and underscores; each letter of a script without spaces (ideographs,
    kana, Thai and others) and each pictograph is a word, and Unicode punctuation, spaces and signs break words
    as ASCII's do. Characters beyond ASCII are taken in their NFKC form. Texts are to be in lower case already. A null text has no words. The hash is a polynomial of the bytes modulo 2**64,
    taken as a difference of running sums, so no word is visited in Python.
    """
    data, at = _buffers(texts)
    if len(data) and data.max() >= 128:  # one form of each character: ligatures, full width, composed marks
        data, at = _buffers(pc.utf8_normalize(texts.cast(pa.large_string()), "NFKC"))
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    _powers(n + 1)
    word = np.zeros(n + 1, bool)
    word[:n] = _WORD[data]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    _beyond_ascii(data, word, cut)
    before = np.zeros(n + 1, bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut))
    ends = np.flatnonzero(before & (~word | cut))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POW[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _INV[starts]), np.searchsorted(starts, at)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of k words: entry i is of words i to i + k - 1. Grams that cross a text's end are to be dropped by the caller."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(_R) + words[j : j + n]
    return mix(h)


#: Most rows of 64-bit keys that are broadcast (some 30 MB when hashed); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most limit rows."""
    return df.limit(limit + 1).count() <= limit


def without(docs: DataFrame, key: str, lost: DataFrame) -> DataFrame:
    """The rows of docs whose key isn't in lost (column key, materialised). lost is broadcast only if it is small enough."""
    return docs.join(F.broadcast(lost) if small(lost) else lost, key, "left_anti")
