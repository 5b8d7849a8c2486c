"""Words of whole Arrow text columns as numpy arrays: byte spans, 64-bit word hashes, rolling window hashes.

Everything works on the UTF-8 bytes of a run of rows, so no Python object is made per word. Only ASCII A-Z is
lower-cased and only ASCII bytes separate words; every byte from 0x80 on belongs to a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 2 << 20  # rows are worked on in runs of about so many bytes; a longer text is a run of its own
HASH_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

ALNUM = np.array([48 <= b < 58 or 97 <= b < 123 or b >= 128 for b in range(256)])
NOT_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])

_ODD, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def text_runs(batches: Iterator[pa.RecordBatch], column: int, limit: int = RUN_BYTES):
    """Yield (rows, bytes, offsets) for runs of whole rows."""
    for batch in batches:
        data, at = column_bytes(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[at[i]:at[j]], at[i:j + 1] - at[i]
            i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = ALNUM):
    """Byte starts and ends of the words, and for each row the index of its first word (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word, from prefix sums of a polynomial over the bytes."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASH_BYTES, "right")))
        lo, n = int(starts[i]), int(ends[j - 1] - starts[i])
        up, down = _power(max(n + 1, HASH_BYTES + 1))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:lo + n]] * up[:n], out=sums[1:])
        a = starts[i:j] - lo
        out[i:j] = mix((sums[ends[i:j] - lo] - sums[a]) * down[a])
        i = j
    return out


def window_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (word indices) and hashes of all runs of ``k`` words that stay within one row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums, weights = np.zeros(n, np.uint64), _power(max(k, 2))[0]
    for j in range(k):
        sums += words[j:j + n] * weights[j]
    end = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + k <= end)
    return at, mix(sums[at])


def row_of(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The row of each word index."""
    return np.searchsorted(first, words, "right") - 1


def lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """A list column from the length of each row and all values in order."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)


def union(spans) -> list[tuple[int, int]]:
    """Ranges ``[start, stop)`` in order, overlapping and touching ones merged."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def cut_words(batches: Iterator[pa.RecordBatch], text: int, spans: int, keep: int):
    """Cut the word ranges of column ``spans`` out of column ``text`` and keep the first ``keep`` columns.

    What stands between the words of a range goes with them; a row that had words and keeps none goes.
    """
    for rows, data, offsets in text_runs(batches, text):
        starts, ends, first = word_spans(LOWER[data], offsets, ALNUM)
        texts, left = {}, np.ones(rows.num_rows, bool)
        for i, found in enumerate(rows.column(spans).to_pylist()):
            if found:
                here, parts, gone = int(offsets[i]), [], 0
                for a, b in union((s["start"], s["stop"]) for s in found):
                    parts.append(data[here:starts[first[i] + a]].tobytes())
                    here, gone = int(ends[first[i] + b - 1]), gone + b - a
                texts[i] = b"".join([*parts, data[here:offsets[i + 1]].tobytes()]).decode()
                left[i] = gone < first[i + 1] - first[i]
        if texts:
            field = rows.schema.field(text)
            rows = rows.set_column(text, field, pa.array([texts.get(i, t) for i, t in enumerate(rows.column(text).to_pylist())], field.type))
        yield rows.select(range(keep)).filter(pa.array(left))
