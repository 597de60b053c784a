"""64-bit hashes of the words of whole batches of texts, by array operations on their bytes.

Words are runs of bytes other than the six ASCII blanks; A-Z count as a-z. The hash of a word is the sum
of a random number for each byte at its place, finalized by a mixer: there is no algebra between places
that words could be built on, so any two words collide with a chance of 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BLANKS = (0x20, *range(0x09, 0x0E))
PLACES = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _value(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return mix(mix(((place.astype(U) << U(8)) | byte) * U(0x9E3779B97F4A7C15) + U(0xD1342543DE82EF95)))


_FOLDED = np.arange(256, dtype=U)
_FOLDED[ord("A") : ord("Z") + 1] += U(32)
_VALUES = _value(np.arange(PLACES, dtype=U)[:, None], _FOLDED[None, :])
_VALUES[:, list(BLANKS)] = 0
_VALUES = _VALUES.ravel()
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(BLANKS)] = False


def hashed_words(texts: pa.Array | list) -> list[np.ndarray]:
    """The hashes of the words of each text; none for a null."""
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.string())
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return []
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return [np.zeros(0, U)] * n
    word = _IS_WORD[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    start[heads] |= word[heads]  # a text's first word begins even where the text before ends in one
    at = np.flatnonzero(start)
    per_text = np.searchsorted(at, offsets)
    if not len(at):
        return [np.zeros(0, U)] * n
    length = np.diff(np.r_[at, len(data)])
    place = np.arange(at[0], len(data)) - np.repeat(at, length)
    body = data[at[0] :]
    values = _VALUES[(np.minimum(place, PLACES - 1) << 8) | body]
    if length.max() > PLACES:
        far = np.flatnonzero((place >= PLACES) & _IS_WORD[body])
        values[place >= PLACES] = 0
        values[far] = _value(place[far], _FOLDED[body[far]])
    hashes = mix(np.add.reduceat(values, at - at[0]))
    return [hashes[a:b] for a, b in zip(per_text[:-1].tolist(), per_text[1:].tolist(), strict=True)]
