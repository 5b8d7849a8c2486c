"""Exact top-k join of vectors by inner product over Voronoi groups.

Vectors are grouped by their nearest pivot. Summaries of the groups (how many vectors, how far they reach, the distances of
the ones nearest to the pivot) bound every query's k-th best score from below and every group's best score from above, so
a query goes only to the groups that can matter. Groups are cut into blocks of bounded size; each block meets its queries in
small matrix products. The registry stores no vectors, so this operator is general.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.session import checkpointed

PIVOTS, SAMPLE = 32, 2000  # pivots, and the vectors they are picked from: both only steer the work
DATA_BLOCK, QUERY_CHUNK, QUERY_PART = 4096, 512, 1 << 16  # vectors of a block, queries of one product and of one task
SLACK = 1e-6  # relative room for rounding in the bounds


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def quantised(vectors: DataFrame, *, key: str, vector: str, scale: float) -> DataFrame:
    """(k, v): ``floor(scale * x)`` of the vectors whose components are all finite numbers; others are left out."""
    x = lambda c: c.cast("double")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")))
    own = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("k IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return own.where(finite).select("k", F.transform("v", lambda c: F.floor(x(c) * scale).cast("long")).alias("v"))


def pick_pivots(data: DataFrame, dim: int, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Up to ``pivots`` vectors far from each other, out of the ``sample`` vectors with the least hashes of their keys."""
    rows = data.orderBy(F.xxhash64("k"), "k").limit(sample).select("v").toArrow().column("v").combine_chunks()
    points = _matrix(rows, dim).astype(np.float64)
    if not len(points):
        return np.zeros((0, dim))
    chosen, far = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def _assign(data: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """(k, v, cell, far): the nearest pivot of every vector, the first of equals, and its distance."""

    def assign(batches):
        square = (pivots**2).sum(1)
        for batch in batches:
            v = _matrix(batch.column(1), dim).astype(np.float64)
            cell = (square - 2 * v @ pivots.T).argmin(1) if len(v) else np.zeros(0, np.int64)
            far = np.sqrt(((v - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], ["k", "v", "cell", "far"])

    return data.mapInArrow(assign, f"k {data.schema['k'].dataType.simpleString()}, v array<bigint>, cell int, far double")


def _score(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact integer inner products, by floating-point matrix product where that is exact; beyond 63 bits the nearest long."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(np.float64) @ data.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return queries @ data.T
    return np.clip(queries.astype(object) @ data.astype(object).T, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def top_k_join(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: float = 64.0,
               pivots: int = PIVOTS) -> DataFrame:
    """``query_id``, ``rank``, ``key`` and ``score``: the ``k`` best vectors of every query by inner product.

    Components count as ``floor(scale * x)``, so scores are exact integers. A query never finds rows with its own key;
    ties go to the smaller key; fewer than ``k`` others give all of them. Pivots, up to ``pivots`` of a bounded sample, and
    one summary for each are all that reaches the driver; they decide where work is done and never the result.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null key; vectors
    of another length than the first query's are an error; repeated rows are found and asked each, so that a repeated query
    has its ranks once, for the least of its vectors; extra columns are ignored; without queries or others the result is empty.
    """
    data = checkpointed(quantised(vectors, key=key, vector=vector, scale=scale))
    asked = quantised(queries, key=key, vector=vector, scale=scale).groupBy("k").agg(F.min("v").alias("v"))
    kind = data.schema["k"].dataType.simpleString()
    out = f"query_id {kind}, rank int, {key} {kind}, score bigint"
    first, spark = data.select(F.size("v").alias("n")).first(), vectors.sparkSession
    if first is None:
        return spark.createDataFrame([], out)
    dim = first.n
    if data.where(F.size("v") != dim).union(asked.where(F.size("v") != dim)).limit(1).count():
        raise ValueError(f"vectors of {dim} components and of others are mixed")
    centres = pick_pivots(data, dim, pivots)
    cells = checkpointed(_assign(data, centres, dim))
    near = cells.select("cell", F.col("far")).groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("reach"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / DATA_BLOCK)).cast("int")
    summary = {r.cell: (r.n, r.reach, r.blocks) for r in near.select("*", blocks.alias("blocks")).collect()}
    # the k + 1 least distances of each cell, kept while rows are merged, so no cell is ever sorted whole; each key stands for one
    # row, since a query leaves out all rows of its own key
    keys = cells.groupBy("k").agg(F.min(F.struct("far", "cell")).alias("n")).select("n.cell", "n.far")
    nearest = _nearest(keys, k + 1)
    shared = spark.sparkContext.broadcast((centres, summary, nearest))
    counts = spark.createDataFrame([(c, b) for c, (_, _, b) in summary.items()], "cell int, blocks int")
    parts = max(1, -(-asked.count() // QUERY_PART))
    stored = cells.join(F.broadcast(counts), "cell").select(
        "cell", F.pmod(F.xxhash64("k", "far"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        F.lit(False).alias("asks"), "k", "v")

    def route(batches):
        centres, summary, nearest = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, QUERY_CHUNK):
                some = batch.slice(a, QUERY_CHUNK)
                q = _matrix(some.column(1), dim).astype(np.float64)
                norm = np.linalg.norm(q, axis=1)
                base = {cell: q @ centres[cell] for cell in summary}
                lower = np.hstack([base[c][:, None] - norm[:, None] * near[None, :] for c, near in nearest.items()])
                lower = np.sort(lower, axis=1)[:, ::-1]
                sure = lower[:, k] if lower.shape[1] > k else np.full(len(q), -np.inf)  # k other keys besides the query's
                sure = np.where(sure < -(2.0**63), -np.inf, np.minimum(sure, 2.0**63))  # where scores end, all tie
                least = sure - SLACK * (1 + np.abs(np.where(np.isfinite(sure), sure, 0)))
                row, cell, block = [], [], []
                for c, (_, reach, blocks) in summary.items():
                    at = np.flatnonzero(base[c] + norm * reach >= least)
                    row.append(np.repeat(at, blocks))
                    cell.append(np.full(len(at) * blocks, c))
                    block.append(np.tile(np.arange(blocks), len(at)))
                at = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell), pa.int32()), pa.array(np.concatenate(block), pa.int32()),
                                                  *(c.take(at) for c in some.columns)], ["cell", "block", "k", "v"])

    sent = asked.mapInArrow(route, f"cell int, block int, k {kind}, v array<bigint>").select(
        "cell", "block", F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int").alias("part"), F.lit(True).alias("asks"), "k", "v")
    met = stored.unionByName(sent).repartition("cell", "block", "part").sortWithinPartitions("cell", "block", "part", "asks", "k")

    def solve(batches):
        place, names, values = None, [], []
        for batch in batches:
            where = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            edges = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]).any(1), [True]))) if batch.num_rows else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                here, ids, v = tuple(where[a, :3]), batch.column(4).slice(a, b - a), _matrix(batch.column(5).slice(a, b - a), dim)
                if here != place:
                    place, names, values = here, [], []
                if not where[a, 3]:
                    names.append(ids)
                    values.append(v.copy())
                elif names:
                    names, values = [pa.concat_arrays(names)], [np.concatenate(values)]
                    for c in range(0, len(v), QUERY_CHUNK):
                        row, at, scores = _best(_score(v[c:c + QUERY_CHUNK], values[0]), ids[c:c + QUERY_CHUNK], names[0], k)
                        yield pa.RecordBatch.from_arrays([ids[c:c + QUERY_CHUNK].take(pa.array(row)), names[0].take(pa.array(at)), pa.array(scores)], ["q", "k", "s"])

    found = met.mapInArrow(solve, f"q {kind}, k {kind}, s bigint")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc(), "k"))  # with the limit, every task keeps k for a query
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("k").alias(key), F.col("s").alias("score"))


def _best(scores: np.ndarray, ids: pa.Array, names: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the ``k`` best of every row, a query's own name left out; ``names`` ascend, so ties keep the smaller."""
    own = ids.to_numpy(zero_copy_only=False)[:, None] == names.to_numpy(zero_copy_only=False)[None, :]
    row, column = [], []
    for j in range(len(scores)):
        line = np.flatnonzero(~own[j])
        s = scores[j, line]
        if len(s) > k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            above, level = np.flatnonzero(s > edge), np.flatnonzero(s == edge)
            line = line[np.concatenate((above, level[:k - len(above)]))]
        row.append(np.full(len(line), j))
        column.append(line)
    row, column = np.concatenate(row), np.concatenate(column)
    return row, column, scores[row, column]


def _nearest(cells: DataFrame, k: int) -> dict[int, np.ndarray]:
    """The ``k`` least distances to the pivot in every cell: each task sends ``k`` for each cell it has, and those are merged."""

    def least(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            cell, far = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(cell):
                held[c] = np.sort(np.concatenate((held.get(c, far[:0]), far[cell == c])))[:k]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([h.tolist() for h in held.values()], pa.list_(pa.float64()))], ["cell", "far"])

    parts = cells.select("cell", "far").mapInArrow(least, "cell int, far array<double>").select("cell", F.explode("far").alias("far"))
    merged = parts.groupBy("cell").agg(F.slice(F.array_sort(F.collect_list("far")), 1, k).alias("far"))
    return {r.cell: np.array(r.far) for r in merged.collect()}
