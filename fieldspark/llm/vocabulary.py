"""Words of Arrow text columns as codes into a vocabulary of their own, exact: no hash stands for a word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import CHUNK_BYTES
from .words import BLANKS, buffers, chunks, spans


@dataclass
class Coded:
    """Texts a .. b - 1 of a column: their words as ``codes`` into ``words``; text k has those from first[k] to first[k + 1]."""

    a: int
    b: int
    words: pa.Array
    codes: np.ndarray
    first: np.ndarray

    def counts(self, new: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows: where each text's entries start, the codes of its different words, and how often it holds them.

        new: another code for each word of the vocabulary.
        """
        codes = self.codes if new is None else new[self.codes]
        row = np.repeat(np.arange(self.b - self.a), np.diff(self.first))
        cells, n = np.unique(row * max(len(self.words), 1) + codes, return_counts=True)
        row, code = np.divmod(cells, max(len(self.words), 1))
        return np.searchsorted(row, np.arange(self.b - self.a + 1)), code.astype(np.int32), n


def coded(column: pa.Array, breaks: np.ndarray = BLANKS, most: int = CHUNK_BYTES) -> Iterator[Coded]:
    """The texts of a column, at most some ``most`` bytes at a time (a longer text stands alone)."""
    data, offsets = buffers(column)
    for a, b in chunks(offsets, most):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = spans(part, own, breaks)
        ends = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        packed = np.ascontiguousarray(part[~breaks[part]]) if len(part) else part
        array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
        both = array.dictionary_encode()
        yield Coded(a, b, both.dictionary, both.indices.to_numpy(zero_copy_only=False).astype(np.int64), first)
