"""The distinct words of whole batches of texts: words are found by array operations on bytes and numbered by Arrow's
own hash table, so no Python string is made for a word's repetitions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def content(texts: pa.Array | Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins; the end comes last. A null is empty."""
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.large_string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, body = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def distinct(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Of words that begin at the places, and end where the next one does, the number of each among the distinct
    ones; and these, in the order first seen."""
    if not len(start):
        return np.zeros(0, np.int64), []
    places = np.append(start, len(data)).astype(np.int64, copy=False)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data)))
    found = words.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary.to_numpy(zero_copy_only=False).tolist()
