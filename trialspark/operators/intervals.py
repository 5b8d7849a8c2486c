"""Counting overlapping date intervals without forming pairs.

For a closed interval [S, E] and any other [s, e] of its group (inverted ones, e < s, included):

    overlap  =  [s <= E and e >= S]  =  [s <= E] - [e < S] + [s > E and e < S]

The first two terms are running counts per day. The days that intervals ask for are rows of the same table as the days on
which they start and end, thousands a group whatever the number of studies, so every row finds both of its counts by equality.
The third term is zero for two well-formed intervals; it matters only where one of them is inverted, and is a
two-dimensional dominance count, taken over a radix tree of the start days (``_dominance``). It is left out of the plan
where no interval is inverted.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from trialspark.operators.ordered import join_on
from trialspark.session import checkpointed, stored

_DIGITS = 6  # radix-16 digits of a day distance: 24 bits, over 45,000 years


def count_overlaps(
    df: DataFrame,
    *,
    id_col: str = "nct_id",
    start: str = "start_date",
    end: str = "completion_date",
    by: Sequence[str] = (),
    open_end: date | str | None = "2035-12-31",
    out: str = "overlaps",
    unique_ids: bool = True,
    method: str = "sweep",
    inverted: bool | None = None,
) -> DataFrame:
    """Add ``out``: how many *other* rows of the group have an intersecting closed interval.

    Rows without a start count 0 and are counted by nobody. A missing end becomes ``open_end``. NULL
    is a group of its own. "Other" means another ``id_col``: with ``unique_ids=False`` repeated ids
    are handled by a second sweep inside (group, id). ``method='pairs'`` forms the pairs, for tests. ``inverted`` tells
    whether intervals that end before they start may occur; None looks while the plan is built, and stores the counts
    per day, and the distinct intervals if so.
    """
    by = list(by)
    end_col = F.col(end).cast("date")
    if open_end is not None:
        end_col = F.coalesce(end_col, F.lit(str(open_end)).cast("date"))
    d = df.withColumns({"_s": F.unix_date(F.col(start).cast("date")), "_e": F.unix_date(end_col)})
    if method == "pairs":
        return _by_pairs(d, id_col, by, out)
    counted = _meeting(d, by, out, inverted)
    if unique_ids:
        own = F.expr("CAST(_s <= _e AS BIGINT)")
    else:
        counted, own = _meeting(counted, [*by, id_col], "_own", inverted), F.col("_own")
    result = F.coalesce(F.col(out) - own, F.lit(0)).cast("long")
    return counted.select(*df.columns, result.alias(out))


def _meeting(d: DataFrame, by: list[str], out: str, inverted: bool | None) -> DataFrame:
    """``d`` plus ``out``: rows of the group whose interval meets [_s, _e], the row itself included."""
    known = d.where("_s IS NOT NULL AND _e IS NOT NULL")
    stage = inverted is None
    if stage:  # a maximum, so that joins which only add columns to ``d`` are left out
        inverted = bool(known.agg(F.max(F.col("_e") < F.col("_s"))).first()[0])
    # Every day that is looked up has a row: the end of an interval and the day before its start.
    days = (
        known.select(*by, F.expr("inline(array(struct(_s AS _day, 1L AS _start, 0L AS _end), struct(_e AS _day, 0L AS _start, 1L AS _end),"
                                 " struct(_s - 1 AS _day, 0L AS _start, 0L AS _end)))"))
        .groupBy(*by, "_day").agg(F.sum("_start").alias("_start"), F.sum("_end").alias("_end"))
    )
    w = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)  # one row per distinct day of the group
    days = days.select(*by, "_day", F.sum("_start").over(w).alias("_started"), F.sum("_end").over(w).alias("_ended"))
    if stage:  # both joins read it, and its size is known then: where it is small, no row of ``d`` is shuffled for them
        days = stored(days)
    counted = join_on(d, days.select(*by, F.col("_day").alias("_e"), "_started"), [*by, "_e"], "left").withColumn("_before", F.col("_s") - 1)
    counted = join_on(counted, days.select(*by, F.col("_day").alias("_before"), "_ended"), [*by, "_before"], "left")
    answer = F.when(F.col("_s").isNotNull() & F.col("_e").isNotNull(), F.col("_started") - F.col("_ended"))
    counted = counted.withColumn(out, answer).drop("_started", "_before", "_ended")
    if not inverted:
        return counted
    iv = known.groupBy(*by, "_s", "_e").agg(F.count(F.lit(1)).alias("_n"))
    counted = join_on(counted, _dominance(checkpointed(iv) if stage else iv, by), [*by, "_s", "_e"], "left")
    return counted.withColumn(out, F.col(out) + F.coalesce("_gap", F.lit(0))).drop("_gap")


def _dominance(iv: DataFrame, by: list[str]) -> DataFrame:
    """(group, _s, _e, _gap): rows with start > _e and end < _s.

    A well-formed interval asks only for inverted rows (channel 0); an inverted one asks for all rows
    (channel 1). With x = top - start the test is x < top - _e: x shares the leading digits of that
    bound and then has a smaller digit, so every bound is a few tree nodes and every row one node a
    level. Groups without an inverted interval take no part.
    """
    key = [*by, "_ch", "_node"]
    groups = iv.groupBy(*by).agg(
        F.max("_s").alias("_top"), F.min("_e").alias("_low"), F.max(F.expr("_s - _e")).alias("_gap"))
    groups = groups.where("_gap > 0")
    iv = join_on(iv, groups, by) if by else join_on(iv, groups, []).where("_top IS NOT NULL")

    # No bound exceeds top - low, so the levels above its leading digit stay unused.
    levels = F.expr(f"explode(filter(array({', '.join(map(str, range(_DIGITS)))}),"
                    " k -> shiftright(_top - _low, 4 * k) > 0))").alias("_k")
    rows = iv.select(*by, "_s", "_e", "_top", "_n", levels).select(
        *by, F.expr("shiftright(_top - _s, 4 * _k) * 8L + _k").alias("_node"), F.col("_e").alias("_y"), "_n",
        F.expr("explode(if(_e < _s, array(0, 1), array(1)))").alias("_ch"))

    # A well-formed interval fits only into a gap longer than itself.
    asks = iv.where("_e < _top AND _low < _s AND (_e < _s OR _e - _s <= _gap - 2)")
    asks = asks.select(*by, "_s", "_e", "_top", levels).select(
        *by, "_s", "_e", "_k", F.expr("shiftright(_top - _e, 4 * _k)").alias("_prefix"))
    asks = asks.where("_prefix & 15 > 0").select(
        *by, "_s", "_e", "_k", "_prefix", F.expr("explode(sequence(1, _prefix & 15))").alias("_back"))
    asks = asks.select(
        *by, "_s", "_e", F.expr("if(_e < _s, 1, 0)").alias("_ch"),
        F.expr("(_prefix - _back) * 8L + _k").alias("_node"))
    probe_days = asks.select(*key, F.col("_s").alias("_y"), F.expr("0L").alias("_n"))
    w = Window.partitionBy(*key).orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)
    below = (
        rows.unionByName(probe_days).groupBy(*key, "_y").agg(F.sum("_n").alias("_n"))
        .select(*key, F.col("_y").alias("_s"), F.sum("_n").over(w).alias("_below")).where("_below > 0")
    )
    hits = join_on(asks, below, [*key, "_s"])
    return hits.groupBy(*by, "_s", "_e").agg(F.sum("_below").alias("_gap"))


def _by_pairs(d: DataFrame, id_col: str, by: list[str], out: str) -> DataFrame:
    cols = [c for c in d.columns if c not in ("_s", "_e")]
    d = d.withColumn("_row", F.monotonically_increasing_id())
    known = d.where(F.col("_s").isNotNull() & F.col("_e").isNotNull())
    b = known.select(*[F.col(k).alias(f"_b_{k}") for k in by],
                     F.col(id_col).alias("_b_id"), F.col("_s").alias("_bs"), F.col("_e").alias("_be"))
    cond = (F.col(id_col) != F.col("_b_id")) & (F.col("_s") <= F.col("_be")) & (F.col("_e") >= F.col("_bs"))
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    return d.join(b, cond, "left").groupBy("_row", *cols).agg(F.count("_b_id").alias(out)).drop("_row")


def competitors_in_window(
    studies: DataFrame,
    *,
    condition: str,
    window_start,
    window_end,
    open_end: date | str = "2030-12-31",
    columns: Sequence[str] = (
        "nct_id", "condition", "overall_status", "phase", "enrollment", "start_date",
        "completion_date", "sponsor_name", "sponsor_type", "n_countries", "n_facilities",
    ),
) -> DataFrame:
    """Studies of a condition whose interval meets the query window."""
    from trialspark.functions.filters import overlaps_window, text_contains

    end = F.coalesce(F.col("completion_date"), F.lit(str(open_end)).cast("date"))
    low, high = (F.lit(str(x)).cast("date") for x in (window_start, window_end))
    keep = text_contains(F.coalesce(F.col("condition"), F.lit("")), condition)
    found = studies.where(keep & overlaps_window(F.col("start_date"), end, low, high))
    return found.select(*[c for c in columns if c in studies.columns])
