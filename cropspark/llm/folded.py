"""Words of letters and digits: A-Z lower-cased, runs of other ASCII characters between them."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x80:] = _IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x41:0x5B] = True
_SPACED = np.frombuffer(bytes(LOWER[b] if _IS_WORD[b] else 0x20 for b in range(256)), np.uint8)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and their bounds; a missing text is empty."""
    rows = pc.cast(pc.fill_null(texts, ""), pa.large_binary())
    offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
    return np.frombuffer(rows.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spaced(texts: pa.Array) -> pa.Array:
    """The texts with words in lower case and a space for every other ASCII character."""
    data, offsets = raw(texts)
    return pc.cast(pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_SPACED[data])]), pa.large_string()).cast(pa.string())


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of words of each text."""
    if not len(data):
        return np.zeros(len(offsets) - 1, np.int64)
    inside = _IS_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    return np.diff(np.concatenate([[0], np.cumsum(begins)])[offsets])


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.translate(LOWER))
