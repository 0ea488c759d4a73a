"""The tokens of `functions.text.tokens` for whole Arrow batches in workers: bytes are classed, cut and counted in arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at a time.
SLICE = 1 << 20
#: The lower-case form of ASCII letters and digits, 0 for all other bytes.
LOWER = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    LOWER[_c] = LOWER[bytes([_c]).upper()[0]] = _c


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The first row and the texts of each slice: SLICE bytes at most, or a single text; null counts as empty."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64), 0
    while start < len(texts):
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE, side="right")))
        yield start, pc.fill_null(texts.slice(start, stop - start).cast(pa.large_string()), "")
        start = stop


def cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row and token of each token of one slice, in no order that matters."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    low = LOWER[data]
    inside = low != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = bounds[:-1][bounds[:-1] < len(data)]
    begins[first] = inside[first]  # a run ends with its text
    found = [_words(low[inside], np.flatnonzero(begins[inside]))]
    rows = [np.searchsorted(bounds, np.flatnonzero(begins), side="right") - 1]
    lead = np.flatnonzero((data >= 0xE4) & (data <= 0xE9))
    lead = lead[lead + 2 < len(data)]
    if len(lead):
        one, two, three = data[lead].astype(np.int32), data[lead + 1].astype(np.int32), data[lead + 2].astype(np.int32)
        code = (one & 15) << 12 | (two & 63) << 6 | three & 63
        row = np.searchsorted(bounds, lead, side="right") - 1
        lead = np.flatnonzero((two & 0xC0 == 0x80) & (three & 0xC0 == 0x80) & (code >= 0x4E00) & (code <= 0x9FFF) & (lead + 2 < bounds[row + 1]))
        row, chars = row[lead], np.stack([one[lead], two[lead], three[lead]], axis=1).astype(np.uint8)
        for n in (2, 3):
            at = np.flatnonzero(row[: 1 - n] == row[n - 1 :])
            grams = np.hstack([chars[at + i] for i in range(n)])
            found.append(_words(grams.ravel(), np.arange(len(at)) * 3 * n))
            rows.append(row[at])
    return np.concatenate(rows), pa.concat_arrays(found)


def _words(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    offsets = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, number of the word, and frequency of each different word of each text of a slice, by rows; and the words."""
    row, words = cut(texts)
    coded = words.dictionary_encode()
    n = max(1, len(coded.dictionary))
    key, freq = np.unique(row * n + coded.indices.to_numpy(), return_counts=True)
    return key // n, key % n, freq, coded.dictionary
