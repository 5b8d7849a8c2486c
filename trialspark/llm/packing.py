"""Best-fit packing of eligibility texts into sequences of several permitted lengths.

Only lengths decide a packing, and no piece is longer than the largest capacity. So the counts of pieces by length, a table
bounded by that capacity, are packed on the driver by best-fit decreasing with whole ranges of equal bins at a time; Spark
ranks the pieces of each length and places every one of them by its rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.text_arrays import ALNUM, LOWER, NOT_SPACE, text_runs, word_spans
from trialspark.session import checkpointed

CAPACITIES, OVERHEAD = (512, 2048, 8192), 32
FIELDS = "piece int, start bigint, n_tokens int, bin_id bigint, bin_capacity int, bin_used int, bin_offset int"


def token_counts(eligibilities: DataFrame, *, key: str = "nct_id", text: str = "criteria") -> DataFrame:
    """``key`` and ``n``: words of ASCII letters, digits and non-ASCII characters, and every other mark that is no space."""

    def count(batches):
        for rows, data, offsets in text_runs(batches, 1):
            _, _, first = word_spans(LOWER[data], offsets, ALNUM)
            marks = np.concatenate(([0], np.cumsum(NOT_SPACE[data] & ~ALNUM[LOWER[data]])))[offsets]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(first) + np.diff(marks), pa.int64())], ["k", "n"])

    own = eligibilities.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return own.mapInArrow(count, f"k {own.schema['k'].dataType.simpleString()}, n bigint").withColumnRenamed("k", key)


def plan_bins(counts: dict[int, int], capacities: tuple[int, ...], overhead: int) -> tuple[list[tuple], list[tuple]]:
    """Best-fit decreasing over counted lengths.

    Returns fills (length, first rank, end rank, first bin, pieces per bin, tokens already in the bin) and bins (first,
    end, used). Longer pieces go first, each into the open bin with the least room that takes it. If none does, the size
    opens whose cost (capacity plus ``overhead``) per token is least when the pieces left fill it, the smaller in a tie.
    """
    lengths = sorted((n for n in counts if n > 0 and counts[n]), reverse=True)
    below = np.zeros(max(capacities) + 2, np.int64)
    for n in lengths:
        below[n] = n * counts[n]
    below = np.cumsum(below)  # tokens in pieces of at most n tokens
    rooms: list[int] = []
    open_bins: dict[int, list[tuple[int, int, int]]] = {}
    fills, bins = [], 0

    def put(room, lo, hi, cap):
        if room not in open_bins:
            insort(rooms, room)
            open_bins[room] = []
        open_bins[room].append((lo, hi, cap))

    for n in lengths:
        left, rank = counts[n], 0
        shorter = int(below[n - 1])
        while left:
            i = bisect_left(rooms, n)
            if i < len(rooms):
                room = rooms[i]
                lo, hi, cap = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[i]
            else:
                def price(c, left=left, shorter=shorter, n=n):
                    own = min(left, c // n) * n
                    return (c + overhead) / (own + min(c - own, shorter)), c

                cap = room = min((c for c in capacities if c >= n), key=price)
                lo, hi = bins, bins + max(1, left // (cap // n))
                bins = hi
            per = min(room // n, left)
            m = min(hi - lo, left // per)
            fills.append((n, rank, rank + m * per, lo, per, cap - room))
            put(room - per * n, lo, lo + m, cap)
            if lo + m < hi:
                put(room, lo + m, hi, cap)
            rank, left = rank + m * per, left - m * per
    return fills, sorted((lo, hi, cap - room) for room, held in open_bins.items() for lo, hi, cap in held)


def _lookup(fills: list[tuple], bins: list[tuple], capacities: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Fills cut at the borders of bins with equal contents, sorted by (length, rank)."""
    starts, rows = [b[0] for b in bins], []
    for n, lo, hi, first, per, before in fills:
        while lo < hi:
            b0, b1, used = bins[bisect_left(starts, first + 1) - 1]
            end = min(hi, lo + (b1 - first) * per)
            rows.append((n, lo, first, per, before, min(c for c in capacities if c >= used), used))
            lo, first = end, b1
    table = np.array(sorted(rows), np.int64).reshape(-1, 7)
    return dict(zip(("n", "rank", "bin", "per", "before", "capacity", "used"), table.T, strict=True))


def pack_texts(eligibilities: DataFrame, *, key: str = "nct_id", text: str = "criteria", capacities: tuple[int, ...] = CAPACITIES,
               overhead: int = OVERHEAD, salts: int | None = None) -> DataFrame:
    """Every piece of every text with its bin: ``key``, ``piece``, ``start``, ``n_tokens``, ``bin_id``, ``bin_capacity``,
    ``bin_used`` and ``bin_offset``.

    A text of more tokens than the largest capacity is cut into pieces of that many and a rest; ``start`` is the first
    token of a piece in its text. Bins are numbered from 0, hold each token once and are cut down to the least capacity
    that takes their contents. Bins are dealt by (length, hash and order of the key), whatever the partitions are.

    Texts without a token, null ones too, give one piece of 0 tokens without a bin; repeated rows are packed each;
    extra columns are ignored; an empty table gives an empty result. Every text is read once: lengths are checkpointed, and
    their counts, at most
    ``max(capacities)`` numbers, reach the driver. ``salts`` says over how many tasks one length is ranked.
    """
    capacities = tuple(sorted(capacities))
    most, spark = capacities[-1], eligibilities.sparkSession
    salts = salts or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sized = checkpointed(token_counts(eligibilities, key=key, text=text).withColumnRenamed(key, "k"))
    cut = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / most) - 1, F.lit(0)).cast("int")))
    pieces = sized.select("k", "n", cut.alias("piece")).select(
        "k", "piece", (F.col("piece").cast("long") * most).alias("start"), F.least(F.col("n") - F.col("piece") * most, F.lit(most)).cast("int").alias("n_tokens"),
        F.pmod(F.xxhash64("k", "piece"), F.lit(salts)).cast("int").alias("salt"))
    counts = pieces.groupBy("n_tokens", "salt").agg(F.count("*").alias("c"))
    total = {r.n_tokens: r.c for r in counts.groupBy("n_tokens").agg(F.sum("c").alias("c")).collect()}
    shared = spark.sparkContext.broadcast(_lookup(*plan_bins(total, capacities, overhead), capacities))
    ahead = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # over salts, not pieces
    before = counts.select("n_tokens", "salt", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("ahead"))
    order = Window.partitionBy("n_tokens", "salt").orderBy("k", "piece")
    ranked = pieces.withColumn("own", F.row_number().over(order) - 1).join(before, ["n_tokens", "salt"]).select(
        "k", "piece", "start", "n_tokens", (F.col("ahead") + F.col("own")).alias("rank"))

    def place(batches):
        table = shared.value
        known = (table["n"] << 44) + table["rank"]
        for batch in batches:
            n, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4))
            at = np.maximum(np.searchsorted(known, (n << 44) + rank, "right") - 1, 0)
            none = n == 0
            if len(known):
                f = {c: v[at] for c, v in table.items()}
            else:
                f = {c: np.zeros(len(n), np.int64) for c in ("rank", "bin", "before", "capacity", "used")} | {"per": np.ones(len(n), np.int64)}
            step = rank - f["rank"]
            values = [(f["bin"] + step // f["per"], pa.int64()), (f["capacity"], pa.int32()), (f["used"], pa.int32()), (f["before"] + step % f["per"] * n, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(v, t, mask=none) for v, t in values)],
                                             ["k", *(c.split()[0] for c in FIELDS.split(", "))])

    return ranked.mapInArrow(place, f"k {sized.schema['k'].dataType.simpleString()}, {FIELDS}").withColumnRenamed("k", key)
