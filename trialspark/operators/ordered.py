"""Order-based operators that never sort a whole group in one task.

A plain window over a group, or Spark's exact ``percentile``, brings every row of the group to one
task; with one group holding a third of a 100 TB table that task never ends. Here ordered values are
first counted per (group, value), then cut into *value buckets*: a monotone function of the value, so
the bucket of a row never depends on sampling or on the partition it came from. Prefix totals over
the buckets are small (at most a few thousand per factor of two in the value range), and inside one
bucket only the distinct values of a very narrow range remain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_PER_OCTAVE = 2048


def value_bucket(value: Column) -> Column:
    """Monotone integer bucket of a number, about 0.03 % of its magnitude wide."""
    v = value.cast("double")
    magnitude = (F.floor(F.log2(F.abs(v)) * _PER_OCTAVE) + F.lit(1 << 22)).cast("long")
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, magnitude).otherwise(-magnitude)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named keys in which NULL equals NULL; keeps the left keys.

    With no keys the right side is a one-row aggregate, read as one scalar subquery.
    """
    if not keys:
        row = right.select(F.struct(*right.columns).alias("row")).scalar()
        names = right.columns
        left = left.withColumn("__row", row)
        return left.withColumns({c: F.col("__row")[c] for c in names}).drop("__row")
    r = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    cond = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__{k}"))
        cond = one if cond is None else cond & one
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__{k}" for k in keys])


def prefix_sums(
    df: DataFrame, key: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """Add ``<s>_before`` (strictly before ``key``) and ``<s>_total`` per group.

    ``df`` has one row per (group, key), as a ``groupBy(*by, key)`` leaves it; ``key`` is numeric and
    not NULL.
    """
    by = list(by)
    d = df.withColumn("_b", value_bucket(F.col(key)))
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    coarse = d.groupBy(*by, "_b").agg(*[F.sum(s).alias(f"_c_{s}") for s in sums])
    group = Window.partitionBy(*by)
    earlier = group.orderBy(order("_b")).rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select(
        *by, "_b",
        *[F.coalesce(F.sum(f"_c_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_c_{s}").over(group).alias(f"{s}_total") for s in sums],
    )
    inside = (
        Window.partitionBy(*by, "_b").orderBy(order(key)).rowsBetween(Window.unboundedPreceding, -1)
    )
    fine = d.withColumns({f"_f_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    out = join_on(fine, coarse, [*by, "_b"])
    out = out.withColumns({f"{s}_before": F.col(f"_o_{s}") + F.col(f"_f_{s}") for s in sums})
    return out.drop("_b", *[f"_o_{s}" for s in sums], *[f"_f_{s}" for s in sums])


def exact_percentiles(
    df: DataFrame, value: str | Column, probs: dict[str, float], by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Exact, linearly interpolated percentiles: one row per group with a non-NULL value.

    ``probs`` maps output column to probability; ``weight`` names a positive repeat count of a row.
    With ``by`` empty the result is one row, all NULL when there is no value.
    """
    by = list(by)
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    counts = (
        df.select(*by, v.alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*by, "_v").agg(F.sum("_w").alias("_n"))
        .withColumn("_b", value_bucket(F.col("_v")))
    )
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    coarse = counts.groupBy(*by, "_b").agg(F.sum("_n").alias("_c")).select(
        *by, "_b", "_c",
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_o"),
        F.sum("_c").over(group).alias("_total"),
    )
    position = {name: F.lit(float(p)) * (F.col("_total") - 1) for name, p in probs.items()}
    ranks = [f(pos) for pos in position.values() for f in (F.floor, F.ceil)]
    wanted = F.lit(False)
    for r in ranks:
        wanted = wanted | ((F.col("_o") <= r) & (r < F.col("_o") + F.col("_c")))
    near = join_on(counts, coarse.where(wanted), [*by, "_b"])
    inside = (
        Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    )
    near = near.withColumn("_s", F.col("_o") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_s") <= rank) & (rank < F.col("_s") + F.col("_n")), F.col("_v")))

    aggs = []
    for name, pos in position.items():
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        aggs.append((low + (high - low) * F.max(pos - F.floor(pos))).alias(name))
    return near.groupBy(*by).agg(*aggs)


def count_at_most(values: Column, bound: Column, strict: bool = False) -> Column:
    """How many elements of an ascending array are at most (or, ``strict``, less than) ``bound``: a binary search in SQL."""
    fits = (lambda v: v < bound) if strict else (lambda v: v <= bound)
    half = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")
    step = lambda s, _: F.when(s["low"] >= s["high"], s).when(fits(F.get(values, half(s))), F.struct(
        (half(s) + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), half(s).alias("high")))
    start = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1.0)).cast("int"))
    return F.aggregate(steps, start, step, lambda s: s["low"])


def with_ranks(
    df: DataFrame, order: Sequence[tuple[str, bool]], ranks: dict[str, Sequence[str]]
) -> DataFrame:
    """Competition ranks (``RANK``) by ``order`` = [(column, descending)], NULLs last.

    ``ranks`` maps each output column to its partition columns. Ranks come from counts per distinct
    order key, cut at the first order column, which should have few distinct values next to the rows
    (a volume count, a date, a year); they are joined back once.
    """
    cols = [c for c, _ in order]
    parts = list(dict.fromkeys(c for by in ranks.values() for c in by))
    sort = lambda pairs: [
        F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in pairs
    ]
    ahead = lambda w: F.coalesce(
        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    keys = df.groupBy(*parts, *cols).agg(F.count(F.lit(1)).alias("_n"))
    out = keys
    for name, by in ranks.items():
        own = keys.groupBy(*by, *cols).agg(F.sum("_n").alias("_n")) if len(by) < len(parts) else keys
        first = own.groupBy(*by, cols[0]).agg(F.sum("_n").alias("_n"))
        first = first.select(*by, cols[0], ahead(Window.partitionBy(*by).orderBy(*sort(order[:1]))).alias("_r"))
        ranked = join_on(own, first, [*by, cols[0]])
        if len(cols) > 1:
            inside = Window.partitionBy(*by, cols[0]).orderBy(*sort(order[1:]))
            ranked = ranked.withColumn("_r", F.col("_r") + ahead(inside))
        ranked = ranked.select(*by, *cols, (F.col("_r") + 1).cast("long").alias(name))
        out = join_on(out, ranked, [*by, *cols])
    return join_on(df, out.drop("_n"), [*parts, *cols])


def with_rank(df: DataFrame, order: Sequence[tuple[str, bool]], out: str, by: Sequence[str] = ()) -> DataFrame:
    return with_ranks(df, order, {out: by})


def stratified_order(
    df: DataFrame, strata: Sequence[str], id_col: str, seed: int = 42
) -> DataFrame:
    """Add ``_pos`` (0-based random order inside the stratum) and ``_size`` of the stratum.

    The order follows a hash of (id, seed), so it is the same on every run and partitioning. Rows are
    cut into 4096 hash ranges, so even a stratum holding most rows is ordered by many tasks.
    """
    strata = list(strata)
    h = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    d = df.withColumn("_h", h).withColumn("_hb", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    sizes = d.groupBy(*strata, "_hb").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*strata)
    earlier = group.orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *strata, "_hb",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"),
        F.sum("_n").over(group).alias("_size"),
    )
    inside = Window.partitionBy(*strata, "_hb").orderBy("_h", id_col)
    d = d.withColumn("_rn", F.row_number().over(inside))
    out = join_on(d, sizes, [*strata, "_hb"])
    return out.withColumn("_pos", F.col("_o") + F.col("_rn") - 1).drop("_h", "_hb", "_o", "_rn")
