"""Text of a record, words and shingles, as TESTDATA.md defines them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

# \w of Python without the underscore; the JVM's counterpart is NOT_WORD.
WORD = re.compile(r"[^\W_]+")
NOT_WORD = r"[^\p{L}\p{N}]+"
# White space as Python's str knows it, for JVM patterns.
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]"

CACHE_LIMIT = 1 << 20


def record_text(full_text="full_text", tokens="tokens", spaces="trailing_whitespace") -> Column:
    """``full_text``; where null, the tokens with a blank after each that is flagged.  Null if both are null.

    A missing token counts as empty, a missing flag as false, arrays of unequal length are padded.
    """
    joined = F.array_join(
        F.zip_with(
            F.col(tokens),
            F.coalesce(F.col(spaces), F.array().cast("array<boolean>")),
            lambda t, w: F.concat(F.coalesce(t, F.lit("")), F.when(w, " ").otherwise("")),
        ),
        "",
    )
    return F.coalesce(F.col(full_text), joined)


def word_hashes(texts: list[str], cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of some texts, in order, and the number of words of each.  ``cache`` is cleared when it grows too large."""
    if len(cache) > CACHE_LIMIT:
        cache.clear()
    flat: list[str] = []
    counts = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = WORD.findall(t.lower())
        counts[i] = len(words)
        flat += words
    for w in set(flat).difference(cache):
        cache[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(cache.__getitem__, flat), np.uint64, len(flat)), counts


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M3
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each run of ``size`` words, by starting position."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        acc = mix(acc * _M1 + words[k : k + n] + np.uint64(k + 1))
    return acc


def shingles_of_batch(texts: list[str], size: int, cache: dict, batch: int = 256) -> Iterator[np.ndarray]:
    """The shingle hashes of each text by position, computed for a few texts at a time."""
    for k in range(0, len(texts), batch):
        words, counts = word_hashes(texts[k : k + batch], cache)
        every = shingle_hashes(words, size)
        for begin, n in zip(np.cumsum(counts) - counts, counts):
            yield every[begin : begin + max(0, n - size + 1)]
