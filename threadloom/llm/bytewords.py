"""Words of whole texts by a table over bytes: the splitting runs in numpy and Arrow, Python need only see each different word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = 0x20


def plain_table(blanks: bytes) -> np.ndarray:
    """Bytes that stay as they are, but for ``blanks``, which part words."""
    table = np.arange(256, dtype=np.uint8)
    table[list(blanks)] = BLANK
    return table


def letter_table() -> np.ndarray:
    """Letters A-Z as a-z, a-z and all bytes of characters beyond ASCII as they are; everything else parts words."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalpha() else BLANK
    return table


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins; null texts are empty."""
    filled = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(filled.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the words of all texts in a row, the different words, and where each text's words begin."""
    mapped = table[data]
    letter, head = mapped != BLANK, np.zeros(len(mapped) + 1, bool)
    head[offsets] = True
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= head[1:-1] | ~letter[:-1]
    ends[:-1] &= head[1:-1] | ~letter[1:]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(begins):
        return np.empty(0, np.int64), pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64)
    cuts = np.concatenate([[0], np.cumsum(ends - begins)])  # of the words without the blanks between them
    pieces = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(cuts), pa.py_buffer(mapped[letter])])
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, np.searchsorted(begins, offsets)


def distinct(rows: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of row and code (below ``size``) in order, and how often each occurs."""
    pairs, n = np.unique(rows * size + codes, return_counts=True)
    return pairs // max(size, 1), pairs % max(size, 1), n
