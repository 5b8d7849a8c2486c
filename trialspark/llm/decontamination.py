"""Benchmark decontamination of eligibility texts by broadcast word windows.

The windows of the benchmark items are hashed into sorted arrays and broadcast in blocks of a checked size; every
block is looked up in one streaming pass over the texts, so no text is shuffled and no window of a text leaves its
task. Hits are verified word by word before they count.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trialspark.llm.text_arrays import ALNUM, LOWER, column_bytes, cut_words, lists, row_of, text_runs, union, window_hashes, word_hashes, word_spans

WINDOW = 10
BLOCK_CHARS = 8 << 20  # characters of benchmark text in one broadcast block of some 40 MB, 200 MB while it is built


class WindowBlock(NamedTuple):
    """Benchmark windows as arrays: some 45 bytes a word besides the words themselves, and no Python object a window."""

    ids: list  # of the items
    data: np.ndarray  # lower-cased bytes of all items
    starts: np.ndarray  # of the words, in data
    ends: np.ndarray
    by_length: dict[int, tuple[np.ndarray, ...]]  # length: (hashes, first occurrence of each text, first words, items), see window_block

    def words(self, at: int, k: int) -> bytes:
        return _words(self.data, self.starts, self.ends, at, k)


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, k: int) -> bytes:
    return b" ".join(data[s:e].tobytes() for s, e in zip(starts[at:at + k], ends[at:at + k], strict=True))


def window_block(rows: list[tuple], window: int) -> WindowBlock:
    """The windows of items (id, text), for each length in order of their hashes.

    Occurrences are sorted by hash and item. Neighbours with the very same words are one text; ``hashes`` and ``edge`` have one
    entry a text (and ``edge`` one more at the end), ``at`` and ``item`` one an occurrence, an item once for each text.
    """
    data, offsets = column_bytes(pa.array([r[1] or "" for r in rows], pa.string()))
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, ALNUM)
    hashes, counts = word_hashes(data, starts, ends), np.diff(first)
    block = WindowBlock([r[0] for r in rows], data, starts.astype(np.int32), ends.astype(np.int32), {})
    for k in np.unique(np.minimum(counts, window)).tolist():
        if not k:
            continue
        at, values = window_hashes(hashes, first, k)
        item = row_of(at, first)
        if k < window:  # a shorter window is a whole item
            at, values, item = (x[counts[item] == k] for x in (at, values, item))
        order = np.lexsort((item, values))
        at, values, item = at[order].astype(np.int32), values[order], item[order].astype(np.int32)
        new = np.concatenate(([True], values[1:] != values[:-1]))
        for i in np.flatnonzero(~new).tolist():
            new[i] = block.words(at[i], k) != block.words(at[i - 1], k)
        kept = new | np.concatenate(([True], item[1:] != item[:-1]))
        edge = np.append(np.flatnonzero(new[kept]), kept.sum()).astype(np.int32)
        block.by_length[k] = values[new], edge, at[kept], item[kept]
    return block


def _hits(data, offsets, block: WindowBlock):
    """Verified hits as (row, first word, words, items), and the word spans of the run."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, ALNUM)
    hashes, out = word_hashes(low, starts, ends), []
    for k, (known, edge, places, items) in block.by_length.items():
        at, values = window_hashes(hashes, first, k)
        where = np.minimum(np.searchsorted(known, values), len(known) - 1)
        near = np.flatnonzero(known[where] == values)
        for a, i, row in zip(at[near], where[near].tolist(), row_of(at[near], first), strict=True):
            words = _words(low, starts, ends, a, k)
            here = known[i]
            while i < len(known) and known[i] == here:  # texts with one hash
                if block.words(places[edge[i]], k) == words:
                    out.append((int(row), int(a - first[row]), k, items[edge[i]:edge[i + 1]]))
                i += 1
    return out, starts, ends, first


def _mark(batches, at: int, n: int, id_type: pa.DataType, block: WindowBlock, later: bool):
    """The first ``n`` columns with the hits of one block; ``later`` adds them to those of earlier blocks."""
    ids = block.ids
    for rows, data, offsets in text_runs(batches, at):
        hits, _, _, first = _hits(data, offsets, block)
        spans, named = {}, {}
        if later:
            for i, (had, held) in enumerate(zip(rows.column(n + 1).to_pylist(), rows.column(n + 2).to_pylist(), strict=True)):
                if had:
                    spans[i], named[i] = [(s["start"], s["stop"]) for s in had], set(held)
        for row, a, k, found in hits:
            spans.setdefault(row, []).append((a, a + k))
            named.setdefault(row, set()).update(ids[i] for i in found.tolist())
        merged = [union(spans.get(i, ())) for i in range(rows.num_rows)]
        flat = [x for m in merged for x in m]
        pairs = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32())], ["start", "stop"])
        yield pa.RecordBatch.from_arrays(
            [*rows.columns[:n], pa.array(np.diff(first), pa.int64()), lists(np.array([len(m) for m in merged]), pairs),
             pa.array([sorted(named.get(i, ())) for i in range(rows.num_rows)], pa.list_(id_type))],
            [*rows.schema.names[:n], "n_words", "spans", "item_ids"])


def _with_hits(texts: DataFrame, column: str, benchmark: DataFrame, item: str, item_text: str, window: int, block_chars: int, cut: bool = False) -> DataFrame:
    """``texts`` with ``n_words``, ``spans`` and ``item_ids`` appended, by one streaming pass for each benchmark block.

    With ``cut`` the last pass takes the spans out of the texts instead of appending anything.
    """
    items = benchmark.select(F.col(item).alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    blocks = max(1, -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // block_chars))
    part, id_type = F.pmod(F.xxhash64("i", "t"), F.lit(blocks)), items.schema["i"].dataType
    n, at, id_arrow = len(texts.columns), texts.columns.index(column), to_arrow_type(id_type)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema), "n_words bigint",
                        "spans array<struct<start:int,stop:int>>", f"item_ids array<{id_type.simpleString()}>"])
    own = texts.schema
    for b in range(blocks):
        shared = texts.sparkSession.sparkContext.broadcast(window_block([(r.i, r.t) for r in items.where(part == b).collect()], window))

        def scan(batches, shared=shared, later=b > 0, last=cut and b == blocks - 1):
            found = _mark(batches, at, n, id_arrow, shared.value, later)
            return cut_words(found, at, n + 1, n) if last else found

        texts = texts.mapInArrow(scan, own if cut and b == blocks - 1 else schema)
    return texts


def find_contamination(eligibilities: DataFrame, benchmark: DataFrame, *, key: str = "nct_id", text: str = "criteria",
                       item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every eligibility text with the benchmark items that occur in it.

    Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and non-ASCII characters. An item gives all
    its runs of ``window`` words; an item with fewer words gives one shorter run. Returns one row per input row: ``key``,
    ``n_words``, ``spans`` (merged word ranges ``[start, stop)`` inside any occurrence) and ``item_ids`` (distinct,
    ascending).

    Null or empty texts have no words and no hits; null or empty items give no window; repeated rows are each treated
    alone; an empty benchmark gives empty lists; other columns, whatever their names, are ignored. Work is one streaming
    pass per ``block_chars`` characters of benchmark text, each block broadcast on its own; an item is never cut, so a
    block exceeds that by chance of its hash or by one long item only. The benchmark is measured and collected here.
    """
    found = _with_hits(eligibilities.select(F.col(key).alias("k"), F.col(text).alias("t")), "t", benchmark, item, item_text, window, block_chars)
    return found.select(F.col("k").alias(key), "n_words", "spans", "item_ids")


def remove_contamination(eligibilities: DataFrame, benchmark: DataFrame, *, text: str = "criteria", remove: str = "spans",
                         item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``eligibilities``, all columns kept, without what occurs in the benchmark.

    ``remove="spans"`` cuts the words of every hit, with what stands between them, out of the text, and drops a text
    whose words are all hit; ``remove="documents"`` drops every text with a hit. Texts without a hit stay untouched,
    null and empty ones too. Edge cases are those of ``find_contamination``.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    columns = eligibilities.columns
    own = eligibilities.toDF(*(f"c{i}" for i in range(len(columns))))
    at = columns.index(text)
    found = _with_hits(own, f"c{at}", benchmark, item, item_text, window, block_chars, cut=remove == "spans")
    if remove == "documents":
        found = found.where(F.size("spans") == 0).select(*own.columns)
    return found.toDF(*columns)
