"""Byte-pair token ids of whole texts, as the public vocabulary files give them.

A text is cut before every single space between two other characters. No pre-token of the files' pattern spans such a
place, so the cuts don't change the ids, and the ids of a segment can be remembered. That memory is bounded by CACHE_BYTES and
given back at the end of a task by Encoder.rest(); longer segments than CACHE_CHARS are never kept.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from functools import lru_cache

from .shared import tidy

CACHE_BYTES, CACHE_CHARS = 40 << 20, 48
#: What a remembered segment takes besides its own bytes and those of its ids.
OVERHEAD = 180
#: Spelled in a text, this is id 50256 to byte_bpe_50k.json.
SPECIAL = "<|endoftext|>"
_DOUBLE, _CUT = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder != "little" or out.itemsize != 4:
        return b"".join(i.to_bytes(4, "little") for i in ids)
    return out.tobytes()


class _Ids(dict):
    """Segment to its packed ids, filled on demand."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead, self.size = encode, lead, 0

    def clear(self) -> None:
        super().clear()
        self.size = 0

    def __missing__(self, segment: str) -> bytes:
        ids = packed(self.encode(self.lead + segment))
        if len(segment) <= CACHE_CHARS:
            self.size += OVERHEAD + len(segment) + len(ids)
            if self.size > CACHE_BYTES:
                self.clear()
            self[segment] = ids
        return ids


class Encoder:
    """Token ids by one vocabulary file of the public tokenizers' package, or one at path."""

    def __init__(self, name: str = "byte_bpe_50k", path: str | None = None):
        import public_tokenizers as public
        import tiktoken

        with open(path or public.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.name = name
        encode = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first, self.later = _Ids(encode, ""), _Ids(encode, " ")
        self.whole = None

    def ids(self, text: str) -> bytes:
        if SPECIAL in text and self.name == "byte_bpe_50k":
            return self._by_library(text)
        parts = text.split(" ") if not _DOUBLE.search(text) else _CUT.split(text)
        if len(parts) > 1 and not parts[0]:  # the text begins with a space, which belongs to the segment after it
            return b"".join(map(self.later.__getitem__, parts[1:]))
        return self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:])) if text else b""

    def rest(self) -> None:
        """Forgets all segments, at the end of a task."""
        self.first.clear()
        self.later.clear()
        tidy()

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4

    def _by_library(self, text: str) -> bytes:
        if self.whole is None:
            import public_tokenizers as public
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
        return packed(self.whole.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k", path: str | None = None) -> Encoder:
    """One encoder for each worker process, with its memory of segments."""
    return Encoder(name, path)
