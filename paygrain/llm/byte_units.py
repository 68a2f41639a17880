"""Byte-level BPE of texts by cached parts.

The split pattern never lets a piece run from a visible character into white space, so a
text may be cut before any single space that a visible character follows, and its parts
encoded on their own. Parts repeat a lot; each task keeps what it has encoded.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

# Entries kept per worker: about 200 bytes each.
CACHE_ENTRIES = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (a vocabulary, of bounded size)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PartCache(dict):
    """Values of parts, made when first asked for; emptied when it grows too large.

    A part that does not begin with a visible character has no value of its own (None):
    its white space belongs together with its neighbour's.
    """

    def __init__(self, make: Callable[[str], object], entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, part: str) -> object:
        value = None if not part or part[0].isspace() else self.make(" " + part)
        if len(self) >= self.entries:
            self.clear()
        self[part] = value
        return value


_made: dict[tuple, object] = {}


def once(key: tuple, make: Callable[[], object]) -> object:
    """What a worker process makes once and keeps for its later tasks."""
    if key not in _made:
        _made[key] = make()
    return _made[key]


def encoding(ranks: dict[bytes, int], pattern: str):
    """The library's encoder for these ranks."""
    import tiktoken

    return once(
        ("encoding", pattern, hash(tuple(ranks.items()))),
        lambda: tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}),
    )


def token_counter(ranks: dict[bytes, int], pattern: str) -> Callable[[str], int]:
    """A function from a text to its number of tokens."""
    encoder = encoding(ranks, pattern)
    encode = encoder.encode_ordinary
    cache = once(("counts", id(encoder)), lambda: PartCache(lambda part: len(encode(part))))

    def count(text: str) -> int:
        first, *rest = text.split(" ")
        try:
            return len(encode(first)) + sum(map(cache.__getitem__, rest))
        except TypeError:  # a part without a value of its own
            return len(encode(text))

    return count
