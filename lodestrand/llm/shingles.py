"""Word shingles of many documents at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

SHINGLE = 5
#: Bytes of words: ASCII letters and digits, and every byte of a longer UTF-8 sequence, once spelled() has been over the text.
_IN_WORD = np.asarray([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Scripts written without spaces: each character is a word.
_ALONE = re.compile("([\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A number for every byte, and an odd one for every word of a shingle."""
    byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return byte, mix(np.arange(7, 7 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse modulo 2 ** 64."""
    odd = 0x9E3779B97F4A7C15
    up, down = np.full(n, odd, np.uint64), np.full(n, pow(odd, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def runs_hashed(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of bytes that inside marks: a polynomial of its bytes modulo 2 ** 64, mixed with its length.

    Works through blocks that begin where a run does, so that memory doesn't grow with more than the longest run.
    """
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), np.uint64)
    byte, a = _tables()[0], 0
    while a < len(starts):
        lo = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, lo + _BLOCK, "right")))
        length = int(ends[b - 1] - lo)
        up, down = _powers(-(-length // _BLOCK) * _BLOCK)
        sums = np.zeros(length + 1, np.uint64)
        np.cumsum(byte[data[lo : lo + length]] * up[:length], out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        hashes[a:b] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return starts, hashes


def spelled(text: str) -> str:
    """text in lower case, with spaces for other than letters and digits beyond ASCII, and around characters of scripts without spaces."""
    text = text.lower()
    if text.isascii():
        return text
    for c in set(text):
        if c > "\x7f" and not c.isalnum() and not "\u0300" <= c <= "\u036f":  # combining marks belong to their letter
            text = text.replace(c, " ")
    return _ALONE.sub(r" \1 ", text)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a zero byte after each text, and where each text starts."""
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return np.frombuffer(b"\0".join(texts) + b"\0", np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64)


def document_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, hash, occurrences) of each document's distinct shingles, by document, then hash.

    Words are lower-cased runs of letters and digits, or single characters of scripts without spaces. A text of one to four words has
    one shingle, of all its words. Lone surrogates count as question marks.
    """
    data, offsets = joined([spelled(t).encode("utf-8", "replace") for t in texts])
    starts, words = runs_hashed(data, _IN_WORD[data])
    doc = np.searchsorted(offsets, starts, "right") - 1
    weights = _tables()[1]
    if len(words) >= SHINGLE:
        n = len(words) - SHINGLE + 1
        sums = sum((words[j : j + n] * weights[j] for j in range(1, SHINGLE)), words[:n] * weights[0])
        whole = doc[:n] == doc[SHINGLE - 1 :]
        hashes, owner = mix(sums[whole]), doc[:n][whole]
    else:
        hashes, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    per_doc = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    short = np.flatnonzero((per_doc > 0) & (per_doc < SHINGLE))
    if len(short):
        first = np.searchsorted(doc, short)
        own = [mix(np.asarray([sum(int(words[f + j]) * int(weights[j]) for j in range(per_doc[d])) + int(per_doc[d]) & (1 << 64) - 1], np.uint64))[0] for d, f in zip(short, first, strict=True)]
        hashes, owner = np.concatenate([hashes, np.asarray(own, np.uint64)]), np.concatenate([owner, short])
    order = np.argsort(hashes, kind="stable")
    kind = np.uint16 if len(texts) <= 1 << 16 else np.int64  # of 16 bits, numpy sorts by radix
    order = order[np.argsort(owner[order].astype(kind), kind="stable")]
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(hashes)))
