"""Explanations of the fitted tree models: node statistics and additive contributions per row."""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trialspark.session import shared_folder

# The helpers below run on the executors; ship them with the task instead of importing them there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def node_table(spark: SparkSession, tree_model) -> DataFrame:
    """The nodes of a tree ensemble as rows, read from its saved form."""
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    tree_model.write().save(path)
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n.id.alias("node"), n.prediction.alias("prediction"),
        n.impurityStats[0].alias("cover"), n.gain.alias("gain"), n.leftChild.alias("left"), n.rightChild.alias("right"),
        n.split.featureIndex.alias("feature"), n.split.leftCategoriesOrThreshold.alias("cut"),
        n.split.numCategories.alias("categories"))


def node_importance(spark: SparkSession, tree_model, names: Sequence[str], top: int = 15) -> DataFrame:
    """(feature, metric, score, score_norm) by mean gain, splits, mean cover and total gain.

    Each metric is divided by its largest value; the ``top`` features by mean gain are kept.
    """
    splits = node_table(spark, tree_model).where("left >= 0")
    known = spark.createDataFrame(list(enumerate(names)), "feature int, name string")
    per = splits.groupBy("feature").agg(
        F.avg("gain").alias("gain"), F.count(F.lit(1)).cast("double").alias("weight"),
        F.avg("cover").alias("cover"), F.sum("gain").alias("total_gain"))
    wide = known.join(per, "feature", "left").fillna(0.0).drop("feature").withColumnRenamed("name", "feature")
    best = wide.orderBy(F.col("gain").desc(), "feature").limit(top)
    return normalized_long(best, "feature", ["gain", "weight", "cover", "total_gain"])


def normalized_long(wide: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """One row per (key, metric), scores divided by the largest of the metric."""
    long = wide.unpivot(key, list(metrics), "metric", "score")
    top = F.max("score").over(Window.partitionBy("metric"))  # one row per feature
    return long.withColumn("score_norm", F.when(top > 0, F.col("score") / top).otherwise(0.0))


def importance_divergence(importances: DataFrame, top: int = 20, limit: float = 0.3) -> DataFrame:
    """Normalised importances of both models, their difference, agreement and a divergence flag."""
    everyone = Window.partitionBy()  # one row per feature
    norm = lambda c: F.col(c) / F.greatest(F.max(c).over(everyone), F.lit(1e-9))
    d = importances.withColumns({"clf_norm": norm("clf_importance"), "reg_norm": norm("reg_importance")})
    d = d.orderBy(F.col("mean_importance").desc(), "feature").limit(top)
    d = d.withColumn("delta", F.abs(F.col("clf_norm") - F.col("reg_norm")))
    agree = 1 - F.col("delta") / F.greatest(F.max("delta").over(everyone), F.lit(1e-9))
    return d.withColumns({"agreement": agree, "diverges": F.col("delta") > limit})


def _shapley_factors(met: Sequence[np.ndarray], share: np.ndarray) -> list[np.ndarray]:
    """The Shapley value of every feature of a path whose product has one factor a feature: 1 or 0 where it is known (met or
    not), its share of the training cover where it is not.

    With the product as a polynomial in t, factors share + met * t, the values follow from its coefficients (EXTEND) after
    one factor is taken out again (UNWIND).
    """
    m = len(met)
    c = [np.ones(np.broadcast(met[0], share[..., 0]).shape)]
    for j in range(m):
        c = [a * share[..., j] + b * met[j] for a, b in zip([*c, 0.0], [0.0, *c], strict=True)]
    weight = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
    out = []
    for i in range(m):
        q = c[m]
        with_it = weight[m - 1] * q
        for k in range(m - 1, 0, -1):
            q = c[k] - share[..., i] * q
            with_it = with_it + weight[k - 1] * q
        without = sum(w * a for w, a in zip(weight, c)) / share[..., i]
        out.append((met[i] - share[..., i]) * np.where(met[i] > 0, with_it, without))
    return out


class PackedTrees:
    """A tree ensemble as arrays: the splits of every tree, and its leaves by how many features lead to them.

    What a leaf adds to each feature depends only on which of its features go its way. A path of few features has a table of
    all cases; a row finds its case from the bits of its decisions. Longer paths are worked out row by row. Rows that decide alike at
    every split of a tree share its contributions, so they are looked up once for each pattern of decisions.
    """

    TABLE, WORD = 8, 64  # features of a path with a table, splits whose decisions fit into one word

    def __init__(self, nodes: pa.Table, weights: Sequence[float], width: int):
        self.width, self.base, self.trees = width, 0.0, []
        columns = {c: nodes.column(c).to_pylist() for c in nodes.column_names}
        rows: dict[int, dict[int, int]] = {}
        for i, (tree, node) in enumerate(zip(columns["tree"], columns["node"], strict=True)):
            rows.setdefault(tree, {})[node] = i
        for tree, at in sorted(rows.items()):
            splits = [i for i in at.values() if columns["left"][i] >= 0]
            place, leaves = {i: k for k, i in enumerate(splits)}, {}
            stack = [(at[0], {})]
            while stack:
                i, seen = stack.pop()
                if columns["left"][i] < 0:
                    leaves.setdefault(len(seen), []).append((columns["prediction"][i] * weights[tree], list(seen.items())))
                    continue
                feature = columns["feature"][i]
                for child, goes_left in ((at[columns["left"][i]], True), (at[columns["right"][i]], False)):
                    share, steps = seen.get(feature, (1.0, ()))
                    stack.append((child, {**seen, feature: (share * columns["cover"][child] / columns["cover"][i], (*steps, (place[i], goes_left)))}))
            self.base += sum(v * math.prod(share for _, (share, _) in path) for group in leaves.values() for v, path in group)
            cuts = [(columns["feature"][i], columns["cut"][i], columns["categories"][i]) for i in splits]
            self.trees.append((
                np.array([f for f, _, _ in cuts], np.int64), np.array([c[0] if n < 0 else 0.0 for _, c, n in cuts]),
                [(k, f, c) for k, (f, c, n) in enumerate(cuts) if n >= 0], [self._pack(m, group, len(splits)) for m, group in leaves.items() if m]))

    def _pack(self, m: int, group: list, splits: int):
        """Leaves of ``m`` features: the decisions each feature needs, its share, and where its contribution goes."""
        value, onto = np.array([v for v, _ in group]), np.zeros((len(group), m, self.width))
        share = np.array([[part for _, (part, _) in path] for _, path in group])
        for leaf, (_, path) in enumerate(group):
            onto[leaf, range(m), [f for f, _ in path]] = 1.0
        onto = onto.reshape(-1, self.width)
        if m <= self.TABLE and splits <= self.WORD:
            asked = np.array([[sum(1 << k for k, _ in steps) for _, (_, steps) in path] for _, path in group], np.uint64)
            wanted = np.array([[sum(left << k for k, left in steps) for _, (_, steps) in path] for _, path in group], np.uint64)
            case = np.arange(1 << m)
            met = [((case >> i) & 1)[None, :].astype(float) for i in range(m)]
            table = np.stack(_shapley_factors(met, share[:, None, :]), axis=2) * value[:, None, None]
            return True, asked, wanted, table.reshape(-1, m), onto
        longest = max(len(steps) for _, path in group for _, (_, steps) in path)
        need = np.full((len(group), m, longest), 2 * splits)  # a column that is always true fills up
        for leaf, (_, path) in enumerate(group):
            for i, (_, (_, steps)) in enumerate(path):
                need[leaf, i, :len(steps)] = [2 * k + (not left) for k, left in steps]
        return False, need, share, value, onto

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Path-dependent Shapley values of the summed trees, one row per input row."""
        phi, columns = np.zeros((self.width, len(x))), np.ascontiguousarray(x.T)
        for feature, cut, categorical, groups in self.trees:
            if not len(feature):
                continue
            left = columns[feature] <= cut[:, None]
            for k, f, values in categorical:
                left[k] = np.isin(columns[f], values)
            bits = np.zeros((-(-len(feature) // self.WORD) * 8, len(x)), np.uint8)
            packed = np.packbits(left, axis=0, bitorder="little")
            bits[:len(packed)] = packed
            bits = np.ascontiguousarray(bits.T)
            words = bits.view("<u8")
            one = words[:, 0] if words.shape[1] == 1 else bits.view(f"S{bits.shape[1]}")[:, 0]
            _, first, same = np.unique(one, return_index=True, return_inverse=True)
            here = np.zeros((len(first), self.width))
            for tabled, *group in groups:
                here += (self._looked_up if tabled else self._worked_out)(words[first], left[:, first].T, *group)
            for f in np.unique(feature):
                phi[f] += here[:, f].take(same.ravel())
        return phi.T

    @staticmethod
    def _looked_up(words, left, asked, wanted, table, onto):
        cases, word = np.zeros((len(words), len(asked)), np.intp), words[:, :1]
        for i in range(asked.shape[1]):
            cases |= ((word & asked[:, i]) == wanted[:, i]).astype(np.intp) << i
        cases += np.arange(len(asked)) << asked.shape[1]
        return table.take(cases.ravel(), axis=0).reshape(len(words), -1) @ onto

    @staticmethod
    def _worked_out(words, left, need, share, value, onto):
        decided = np.concatenate((np.stack((left, ~left), axis=2).reshape(len(left), -1), np.ones((len(left), 1), bool)), axis=1)
        met = decided[:, need].all(axis=3).astype(float)  # pattern, leaf, feature
        parts = _shapley_factors([met[:, :, i] for i in range(met.shape[2])], share)
        return (np.stack(parts, axis=2) * value[:, None]).reshape(len(left), -1) @ onto


def explain(spark: SparkSession, pipeline, frame: DataFrame, id_col: str, names: Sequence[str]) -> DataFrame:
    """(id, base, raw, contributions array): base + sum of contributions = raw ensemble score.

    The node table is as small as the model; packed into arrays it travels with the task, and rows stay where they are.
    """
    model = pipeline.stages[-1]
    trees = PackedTrees(node_table(spark, model).toArrow(), list(model.treeWeights), len(names))
    for_rows = pipeline.transform(frame).select(id_col, vector_to_array("features").alias("x"))
    id_type = for_rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            phi = trees.contributions(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, phi.size + 1, phi.shape[1]), pa.int32()), pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(phi), trees.base)), pa.array(trees.base + phi.sum(axis=1)), lists],
                                             [id_col, "base", "raw", "contributions"])

    return for_rows.mapInArrow(run, f"{id_col} {id_type}, base double, raw double, contributions array<double>")


def mean_contributions(explained: DataFrame, names: Sequence[str], top: int = 15) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    long = explained.select(F.posexplode("contributions").alias("i", "value"))
    labels = F.array(*[F.lit(n) for n in names])
    agg = long.groupBy("i").agg(F.avg(F.abs("value")).alias("mean_abs_contribution"))
    d = agg.select(F.get(labels, F.col("i")).alias("feature"), "mean_abs_contribution")
    return d.orderBy(F.col("mean_abs_contribution").desc(), "feature").limit(top)


def row_waterfall(explained: DataFrame, names: Sequence[str], id_col: str, top: int = 10) -> DataFrame:
    """The ``top`` contributions per row by size, then listed by signed value."""
    labels = F.array(*[F.lit(n) for n in names])
    pairs = F.transform("contributions", lambda v, i: F.struct(
        (-F.abs(v)).alias("size"), F.get(labels, i).alias("feature"), v.alias("value")))
    best = F.slice(F.array_sort(pairs), 1, top)
    ordered = F.array_sort(F.transform(best, lambda p: F.struct(p["value"].alias("value"), p["feature"].alias("feature"))))
    return explained.select(id_col, F.posexplode(ordered).alias("position", "p")).select(id_col, "position", "p.*")
