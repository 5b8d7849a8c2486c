"""Hard negatives of labelled vectors, read from blocks along a Hilbert curve by the bounds of their zone maps.

Vectors are put in the order of a Hilbert curve and written as Parquet blocks. A zone map holds, for each block, the least and
the greatest value of every dimension and the rows of every label. Interval arithmetic turns a zone map and an anchor into bounds
of all scores in the block, so an anchor reads only the blocks that its windows of scores can need: those whose interval
meets a window and can still be among the best, given what other blocks are sure to offer. Inside a block the same test
skips runs of rows.

The registry stores no vectors of its own; the operator takes studies whose features have been put in an array column.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.knn_join import quantised
from trialspark.session import checkpointed, shared_folder

BLOCK, MOST_BLOCKS = 4096, 1024  # rows of a block, unless that made more blocks than may be broadcast as zone maps
RUN, CHUNK, PART = 512, 256, 1 << 14  # rows that a block is read in, anchors of one product, anchors of one task
CURVE_BITS = 128  # of a place on the curve
LOWEST, HIGHEST = -(2**63) + 1, 2**63 - 1  # where scores end


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The places on a Hilbert curve, as rows of bytes that sort like them, of points with ``bits`` bits a dimension."""
    x = cells.astype(np.uint32).T.copy()
    n, top = len(x), np.uint32(1 << (bits - 1))
    q = int(top)
    while q > 1:  # from axes to the transposed index: undo the turns from the coarse level down
        p = np.uint32(q - 1)
        for i in range(n):
            high = (x[i] & np.uint32(q)) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), int(top)
    while q > 1:
        turn = np.where((x[n - 1] & np.uint32(q)) != 0, turn ^ np.uint32(q - 1), turn)
        q >>= 1
    x ^= turn
    planes = [(x[i] >> np.uint32(b)) & np.uint32(1) for b in reversed(range(bits)) for i in range(n)]
    return np.packbits(np.array(planes, np.uint8).T, axis=1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: in floating point where that is exact, and beyond 63 bits the nearest number that fits."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, LOWEST, HIGHEST).astype(np.int64)


def interval_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible inner product of each anchor with any vector between ``low`` and ``high``, with room for rounding."""
    up, down = np.maximum(anchors, 0).astype(np.float64), np.minimum(anchors, 0).astype(np.float64)
    low, high = low.astype(np.float64), high.astype(np.float64)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    room = 1e-9 * (up - down) @ np.maximum(np.abs(low), np.abs(high)).T
    return least - room, most + room


def _spread(data: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of every dimension over all rows; each task sends one row."""

    def task(batches):
        low, high = np.full(dim, HIGHEST), np.full(dim, LOWEST)
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(0), dim)
                low, high = np.minimum(low, v.min(0)), np.maximum(high, v.max(0))
        yield pa.RecordBatch.from_arrays([pa.array([low.tolist()]), pa.array([high.tolist()])], ["low", "high"])

    each = data.select("v").mapInArrow(task, "low array<bigint>, high array<bigint>").select(F.posexplode(F.arrays_zip("low", "high")).alias("d", "x"))
    found = each.groupBy("d").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high")).orderBy("d").collect()
    return np.array([r.low for r in found]), np.array([r.high for r in found])


def write_blocks(data: DataFrame, dim: int) -> tuple[str, DataFrame]:
    """Write (k, label, v) as Parquet blocks along the curve; the path, and the zone map of every block.

    The widest dimensions are cut into as many cells as the bits of a place allow. ``data`` is not empty.
    """
    low, high = _spread(data, dim)
    width = high.astype(np.float64) - low.astype(np.float64)
    bits = max(1, min(8, CURVE_BITS // dim))
    axes = np.sort(np.argsort(-width, kind="stable")[:CURVE_BITS // bits])

    def place(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            v = _matrix(batch.column(2), dim)[:, axes].astype(np.float64)
            cell = np.clip((v - low[axes]) / np.maximum(width[axes], 1) * (1 << bits), 0, (1 << bits) - 1)
            curve = hilbert(cell, bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in curve], pa.binary())], ["k", "label", "v", "curve"])

    kind, rows = data.schema["k"].dataType.simpleString(), data.count()
    blocks = min(MOST_BLOCKS, -(-rows // BLOCK))
    # rows of one place on the curve may fill several blocks
    laid = data.mapInArrow(place, f"k {kind}, label {data.schema['label'].dataType.simpleString()}, v array<bigint>, curve binary")
    laid = laid.repartitionByRange(blocks, "curve", F.xxhash64("k", "v")).withColumn("block", F.spark_partition_id()).sortWithinPartitions("block", "curve")
    path = f"{shared_folder(data.sparkSession)}/blocks-{uuid.uuid4().hex}"
    laid.select("block", "k", "label", "v").write.partitionBy("block").parquet(path)

    def zones(batches):
        found: dict[int, list] = {}
        for batch in batches:
            where, v = batch.column(0).to_numpy(), _matrix(batch.column(2), dim) if batch.num_rows else None
            for b in np.unique(where):
                here = where == b
                zone = found.setdefault(int(b), [np.full(dim, HIGHEST), np.full(dim, LOWEST), {}])
                zone[0], zone[1] = np.minimum(zone[0], v[here].min(0)), np.maximum(zone[1], v[here].max(0))
                for label, n in zip(*np.unique(batch.column(1).to_numpy()[here], return_counts=True), strict=True):
                    zone[2][int(label)] = zone[2].get(int(label), 0) + int(n)
        for b, (lo, hi, labels) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([lo.tolist()]), pa.array([hi.tolist()]), pa.array([list(labels)], pa.list_(pa.int64())),
                                              pa.array([list(labels.values())], pa.list_(pa.int64()))], ["block", "low", "high", "labels", "counts"])

    own = data.sparkSession.read.parquet(path).select(F.col("block").cast("long"), F.col("label").cast("long"), "v")
    return path, own.mapInArrow(zones, "block long, low array<bigint>, high array<bigint>, labels array<bigint>, counts array<bigint>")


def _read(asked: DataFrame, path: str, zone_rows: list, dim: int, same: bool, limit: int) -> DataFrame:
    """(a, w, rank, k, score): for each window of scores of each anchor its first ``limit`` rows of the same label or of others.

    ``asked`` has one row an anchor: ``a``, ``label``, ``v``, how many rows share its key (``m``) and its ``windows`` (w, low, high).
    """
    spark, kind = asked.sparkSession, asked.schema["a"].dataType.simpleString()
    low, high = np.array([z.low for z in zone_rows]), np.array([z.high for z in zone_rows])
    merged = [dict() for _ in zone_rows]
    for z, m in zip(zone_rows, merged, strict=True):
        for label, n in zip(z.labels, z.counts, strict=True):
            m[label] = m.get(label, 0) + n
    zones = spark.sparkContext.broadcast((low, high, np.array([z.block for z in zone_rows]), merged))

    def route(batches):
        low, high, names, labels = zones.value
        totals = np.array([sum(m.values()) for m in labels])
        for batch in batches:
            for c in range(0, batch.num_rows, CHUNK):
                some = batch.slice(c, CHUNK)
                least, most = interval_bounds(_matrix(some.column(2), dim), low, high)
                order = np.argsort(-least, axis=1, kind="stable")
                row, block = [], []
                for i, (label, m, windows) in enumerate(zip(some.column(1).to_pylist(), some.column(3).to_pylist(), some.column(4).to_pylist(), strict=True)):
                    own = np.array([z.get(label, 0) for z in labels])
                    rows = own if same else totals - own
                    need = np.zeros(len(names), bool)
                    for w in windows:
                        inside = (least[i] >= w["low"]) & (most[i] <= w["high"]) & (rows > 0)
                        sure = order[i][inside[order[i]]]
                        enough = np.flatnonzero(np.cumsum(rows[sure]) >= limit + m)  # the anchor's own rows do not count
                        floor = max(float(w["low"]), least[i][sure[enough[0]]] if len(enough) else -np.inf)
                        need |= (most[i] >= floor) & (least[i] <= w["high"]) & (rows > 0)
                    at = np.flatnonzero(need)
                    row.append(np.full(len(at), i))
                    block.append(names[at])
                at = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(block), pa.int32()), *(some.column(j).take(at) for j in (0, 1, 2, 4))],
                                                 ["block", "a", "label", "v", "windows"])

    parts = F.greatest(F.lit(1), F.ceil(asked.select(F.count("*")).scalar() / PART)).cast("int")
    window = "array<struct<w:bigint,low:bigint,high:bigint>>"
    sent = checkpointed(asked.select("a", "label", "v", "m", "windows").mapInArrow(route, f"block int, a {kind}, label long, v array<bigint>, windows {window}")
                        .withColumn("part", F.pmod(F.xxhash64("a", "label"), parts)))
    needed = sent.select("block", "part").distinct()
    wanted = [r.block for r in needed.select("block").distinct().collect()]  # as many as there are zone maps
    blocks = spark.read.parquet(path).where(F.col("block").isin(wanted)).select(F.col("block"), F.col("k").alias("a"), F.col("label").cast("long").alias("label"), "v")
    data = blocks.join(needed, "block").select("block", "part", F.lit(True).alias("read"), "a", "label", "v", F.lit(None).cast(window).alias("windows"))
    met = data.unionByName(sent.withColumn("read", F.lit(False))).repartition("block", "part").sortWithinPartitions("block", "part", "read")

    def solve(batches):
        place, seekers = None, None
        for batch in batches:
            where = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            edges = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]).any(1), [True]))) if batch.num_rows else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                here = tuple(where[a, :2])
                if here != place:
                    if seekers:
                        yield seekers.best()
                    place, seekers = here, _Seekers(dim, same, limit)
                if where[a, 2]:
                    for c in range(a, b, RUN):
                        seekers.meet(batch.slice(c, min(RUN, b - c)))
                else:
                    seekers.add(batch.slice(a, b - a))
        if seekers:
            yield seekers.best()

    found = met.select("block", "part", "read", "a", "label", "v", "windows").mapInArrow(solve, f"a {kind}, w bigint, k {kind}, score bigint")
    rank = F.row_number().over(Window.partitionBy("a", "w").orderBy(F.col("score").desc(), "k"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


class _Seekers:
    """The anchors of one task and what they have found in one block so far."""

    def __init__(self, dim: int, same: bool, limit: int):
        self.dim, self.same, self.limit = dim, same, limit
        self.batches: list[pa.RecordBatch] = []
        self.found: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.v = None

    def add(self, anchors: pa.RecordBatch) -> None:
        self.batches.append(anchors)

    def _settle(self) -> None:
        table = pa.Table.from_batches(self.batches).combine_chunks()
        column = lambda n: pa.concat_arrays(table.column(n).chunks)
        self.a, self.label, self.v = column("a"), column("label").to_numpy(), _matrix(column("v"), self.dim)
        windows = column("windows")
        flat, lengths = windows.flatten(), np.array([len(w) for w in windows], np.int64)
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        self.w, self.low, self.high = (flat.field(i).to_numpy() for i in range(3))
        self.floor = self.low.astype(np.float64)  # of scores that can still be of use

    def meet(self, rows: pa.RecordBatch) -> None:
        """Score a run of a block against the anchors whose windows its bounds meet."""
        if self.v is None:
            self._settle()
        v, keys, labels = _matrix(rows.column(5), self.dim), rows.column(3), rows.column(4).to_numpy()
        least, most = interval_bounds(self.v, v.min(0)[None], v.max(0)[None])
        open_ = np.flatnonzero((most[self.owner, 0] >= self.floor) & (least[self.owner, 0] <= self.high))
        for c in range(0, len(open_), CHUNK):
            windows = open_[c:c + CHUNK]
            anchors, at = np.unique(self.owner[windows], return_inverse=True)
            scores = _scores(self.v[anchors], v)
            fits = (labels[None, :] == self.label[anchors][:, None]) == self.same
            mine = self.a.take(pa.array(anchors)).to_numpy(zero_copy_only=False)[:, None] == keys.to_numpy(zero_copy_only=False)[None, :]
            fits &= ~mine
            got = fits[at] & (scores[at] >= self.low[windows][:, None]) & (scores[at] <= self.high[windows][:, None])
            i, j = np.nonzero(got)
            self.found.append((windows[i], scores[at[i], j], keys.take(pa.array(j))))
        if sum(len(f[0]) for f in self.found) > 1 << 18:
            self._trim()

    def _trim(self) -> None:
        """Keep the first ``limit`` of every window and learn from the last of them what is still of use."""
        if not self.found:
            return
        window, score = (np.concatenate([f[i] for f in self.found]) for i in (0, 1))
        key = pa.concat_arrays([f[2] for f in self.found])
        names = key.to_numpy(zero_copy_only=False)
        order = np.lexsort((names, -score.astype(np.float64), window)) if np.abs(score).max(initial=0) < 2**53 else np.array(
            sorted(range(len(score)), key=lambda i: (window[i], -int(score[i]), names[i])), np.int64)
        window, score = window[order], score[order]
        start = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1]))) if len(window) else np.zeros(0, np.int64)
        rank = np.arange(len(window)) - np.repeat(start, np.diff(np.append(start, len(window))))
        full = rank == self.limit - 1
        self.floor[window[full]] = np.maximum(self.floor[window[full]], score[full] - np.abs(score[full].astype(np.float64)) * 1e-9)
        keep = rank < self.limit
        self.found = [(window[keep], score[keep], key.take(pa.array(order[keep])))]

    def best(self) -> pa.RecordBatch:
        self._trim()
        if not self.found or self.v is None:
            empty = self.batches[0].column("a").slice(0, 0) if self.batches else pa.nulls(0)
            return pa.RecordBatch.from_arrays([empty, pa.array([], pa.int64()), empty, pa.array([], pa.int64())], ["a", "w", "k", "score"])
        window, score, key = self.found[0]
        return pa.RecordBatch.from_arrays([self.a.take(pa.array(self.owner[window])), pa.array(self.w[window]), key, pa.array(score)], ["a", "w", "k", "score"])


def mine_hard_negatives(studies: DataFrame, anchors: DataFrame, *, key: str = "nct_id", vector: str = "features", label: str = "label_binary",
                        scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score`` for each anchor.

    A score is the inner product of vectors whose components count as ``floor(scale * x)``; higher scores come first, ties by
    the smaller key. The ``positives`` of an anchor are its first other studies of the same label. For each of them the
    first ``negatives`` studies of other labels are mined whose score is between ``low`` and ``high`` per cent of the
    positive's; a negative positive score leaves none. ``label`` is a whole number. ``anchors`` are rows of ``studies``, or others.

    Rows with a null key or label, and vectors that are null, empty or hold null or non-finite components, take no part;
    vectors of several lengths are an error. Rows of the anchor's own key are never its positives or negatives; an anchor key that repeats
    asks once, with its least label and vector; other repeated rows are found each; extra columns are ignored; an empty side gives no rows.
    All rows are searched; the zone maps decide what is read and never the result.
    """
    def labelled(df):
        own = df.where(F.col(label).isNotNull()).select(F.struct(F.col(key).alias("k"), F.col(label).cast("long").alias("label")).alias("kl"), F.col(vector).alias("v"))
        return quantised(own.where("kl.k IS NOT NULL"), key="kl", vector="v", scale=scale).select("k.k", "k.label", "v")

    data = checkpointed(labelled(studies))
    asked = labelled(anchors).groupBy(F.col("k").alias("a")).agg(F.min(F.struct("label", "v")).alias("one"), F.count("*").alias("m"))
    kind, spark = data.schema["k"].dataType.simpleString(), studies.sparkSession
    first = data.select(F.size("v").alias("n")).first()
    out = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long"
    if first is None:
        return spark.createDataFrame([], out)
    asked = asked.select("a", "one.label", "one.v")
    times = data.groupBy(F.col("k").alias("a")).agg(F.count("*").alias("m"))
    asked = checkpointed(asked.join(times, "a", "left").withColumn("m", F.coalesce("m", F.lit(0))))
    dim = first.n
    if data.where(F.size("v") != dim).union(asked.where(F.size("v") != dim).select("a", "label", "v")).limit(1).count():
        raise ValueError(f"vectors of {dim} components and of others are mixed")
    path, zones = write_blocks(data, dim)
    zone_rows = zones.groupBy("block").agg(  # a block that several tasks read has several
        F.collect_list("low").alias("low"), F.collect_list("high").alias("high"), F.flatten(F.collect_list("labels")).alias("labels"),
        F.flatten(F.collect_list("counts")).alias("counts")).orderBy("block").collect()
    zone_rows = [type("Zone", (), {"block": z.block, "low": np.min(z.low, axis=0), "high": np.max(z.high, axis=0), "labels": z.labels, "counts": z.counts})
                 for z in zone_rows]
    window = lambda w, a, b: F.struct(w.cast("long").alias("w"), a.cast("long").alias("low"), b.cast("long").alias("high"))
    any_score = F.array(window(F.lit(0), F.lit(LOWEST), F.lit(HIGHEST)))
    best = checkpointed(_read(asked.withColumn("windows", any_score), path, zone_rows, dim, True, positives))
    share = lambda p: F.col("score").cast("decimal(20,0)") * p / 100
    hit = best.where("score >= 0").select("a", window(F.col("rank"), F.ceil(share(low)), F.floor(share(high))).alias("x"))
    hit = hit.groupBy("a").agg(F.collect_list("x").alias("windows"))  # as many as there are positives
    mined = _read(asked.join(hit, "a"), path, zone_rows, dim, False, negatives)
    pairs = best.select("a", F.col("rank").cast("long").alias("w"), F.col("k").alias("positive_id"), F.col("score").alias("positive_score"))
    return mined.join(pairs, ["a", "w"]).select(F.col("a").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
                                                F.col("k").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
