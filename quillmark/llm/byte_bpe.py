"""Ids of a byte-level BPE tokenizer file.

The vocabulary, the pattern that splits text and the ids are the file's. A cache of words was
tried and costs more than the merges it saves.
"""

from __future__ import annotations

import base64
import json

import numpy as np


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it prints in Latin-1, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of(path: str) -> dict[bytes, int]:
    """Bytes and ids from a ``tokenizers`` JSON file or a ``tiktoken`` rank file."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = {t["content"] for t in file["added_tokens"]}
    own = byte_of_char()
    return {bytes(own[c] for c in piece): i for piece, i in file["model"]["vocab"].items() if piece not in special}


class Encoder:
    """Ids of whole texts; strings of special tokens are ordinary text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = ranks_of(path)
        self.kind = np.dtype("<u2" if max(ranks.values()) < 1 << 16 else "<u4")
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._encode, self._bytes = own.encode_ordinary, own.decode_single_token_bytes

    def whole(self, text: str) -> list[int]:
        return self._encode(text)

    def lengths(self, text: str) -> list[int]:
        """Bytes of each token."""
        return [len(self._bytes(i)) for i in self._encode(text)]

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned integers of ``kind``."""
        return np.array(self._encode(text), self.kind).tobytes()
