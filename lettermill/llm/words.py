"""Word rules shared by the operators, once for Python bytes and once for Spark columns.

Texts reach Python as UTF-8 bytes (a Spark string cast to binary), so that texts Python could not
decode still pass. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Letters, digits and everything beyond ASCII, after A-Z were lower-cased.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Anything but ASCII white space.
SPACE_GAP = r"[\x20\x09-\x0D]+"

_LOWERED = bytes.maketrans(UPPER.encode() + b"\t\n\v\f\r", LOWER.encode() + b" " * 5)
_ALNUM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).translate(_LOWERED)

#: Texts are cut to pieces of about this many bytes, at a gap between words, so that memory stays bounded.
PIECE = 1 << 20


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def word_array(text: Column, gap: str) -> Column:
    """The words of a text between gaps, as an array; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def pieces(raw: bytes) -> Iterator[bytes]:
    """raw, which has its gaps as white space, in pieces that end at gaps."""
    at, n = 0, len(raw)
    while n - at > PIECE:
        end = raw.rfind(b" ", at, at + PIECE)
        if end < at:  # a single word longer than a piece
            end = raw.find(b" ", at + PIECE)
            if end < 0:
                break
        yield raw[at:end]
        at = end + 1
    yield raw[at:] if at else raw


def alnum_words(text: bytes | None) -> Iterator[list[bytes]]:
    """Words of letters, digits and non-ASCII, lower-cased; piece by piece."""
    for piece in pieces((text or b"").translate(_ALNUM)):
        yield piece.split()


def space_words(text: bytes | None) -> Iterator[list[bytes]]:
    """Words between ASCII white space, lower-cased; piece by piece."""
    for piece in pieces((text or b"").translate(_LOWERED)):
        yield piece.split()


def word_hashes(text: bytes | None, words=space_words) -> np.ndarray:
    """One 64-bit hash per word, in order."""
    parts = [np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w)) for w in words(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of width words; a shorter text is one run, none has none."""
    h = word_hashes(text)
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        k = min(width, len(h))
        run = np.full(len(h) - k + 1, 0x9E3779B97F4A7C15 * k & (1 << 64) - 1, np.uint64)
        for i in range(k):
            run = mix(run * np.uint64(0xD1342543DE82EF95) + h[i : len(h) - k + 1 + i])
    return np.unique(run)
