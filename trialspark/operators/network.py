"""Site co-participation networks: which sites share trials.

Pairs per trial grow with the square of its sites. Among the top sites of a condition that is bounded; elsewhere
the sites of a trial are cut into blocks, so that a task only ever meets one block with another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from trialspark.functions import columns as X, filters as P
from trialspark.operators.landscape import condition_studies
from trialspark.operators.ordered import join_on
from trialspark.session import stored
from trialspark.sources.registry import TrialTables


def network_nodes(tables: TrialTables, condition: str, n_sites: int = 30, min_trials: int = 2) -> DataFrame:
    """The ``n_sites`` named sites with most distinct trials, at least ``min_trials`` each."""
    ids = condition_studies(tables, condition).select("nct_id")
    rows = tables.facilities.where(P.named_site()).join(ids, "nct_id", "left_semi")
    rows = rows.select("nct_id", "name", "city", "country", X.site_key("name", "city", "country").alias("site_key"))
    counts = rows.groupBy("site_key").agg(
        F.count_distinct("nct_id").alias("n_trials"),
        F.min(F.struct("name", "city", "country")).alias("meta"))
    top = counts.where(F.col("n_trials") >= min_trials).orderBy(F.col("n_trials").desc(), "site_key").limit(n_sites)
    return top.select("site_key", "meta.*", "n_trials")


def network_edges(tables: TrialTables, condition: str, n_sites: int = 30, min_trials: int = 2) -> DataFrame:
    """(site_a, site_b, shared_trials) among the top sites, any country.

    A trial yields at most n_sites * (n_sites - 1) / 2 pairs.
    """
    ids = condition_studies(tables, condition).select("nct_id")
    top = network_nodes(tables, condition, n_sites, min_trials).select("site_key")
    member = (
        tables.facilities.where(P.named_site())
        .select("nct_id", X.site_key("name", "city", "country").alias("site_key"))
        .join(top, "site_key", "left_semi").join(ids, "nct_id", "left_semi").distinct()
    )
    a = member.withColumnRenamed("site_key", "site_a")
    b = member.withColumnRenamed("site_key", "site_b")
    pairs = a.join(b, "nct_id").where("site_a < site_b")
    return pairs.groupBy("site_a", "site_b").agg(F.count(F.lit(1)).alias("shared_trials"))


def shared_trial_edges(
    rows: DataFrame, *, trial: str = "nct_id", site: Sequence[str] = ("facility_name", "city"),
    within: Sequence[str] = ("condition", "country"), min_shared: int = 2, block_sites: int = 256, page_trials: int = 4096,
) -> DataFrame:
    """Pairs of sites sharing at least ``min_shared`` trials inside the same ``within`` values.

    Exact for trials of any size. Sites in fewer than ``min_shared`` trials cannot be in a result and go
    first. Where a group's trials have so many sites in common that pairs of each trial would be more than pairs of all its
    sites, its trials become bits, ``page_trials`` of them a page, and a pair is formed once a page; elsewhere every trial
    is a page. The sites of a page are dealt over blocks and block meets block, so one task joins a bounded square. Pairs
    of a group of one page are complete as they are formed and never shuffled; those of the others are counted before they
    are. The trials' sites are stored while the plan is built, to see which kinds of groups there are.
    """
    within, site = list(within), list(site)
    member = rows.select(trial, *within, *site).where(F.col(site[0]).isNotNull()).distinct()
    enough = member.groupBy(*within, *site).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_shared)
    member = join_on(member, enough.drop("n"), [*within, *site], "left_semi")
    sizes = member.groupBy(trial, *within).agg(F.count(F.lit(1)).alias("_size"))
    # Each pair of sites stands for one word of 64 trials where they are packed, and for one trial where they are not.
    groups = join_on(
        sizes.groupBy(*within).agg(F.count(F.lit(1)).alias("_trials"), F.sum(F.col("_size") * F.col("_size")).alias("_formed")),
        enough.groupBy(*within).agg(F.count(F.lit(1)).alias("_sites")), within)
    groups = groups.select(*within, F.ceil(F.col("_trials") / page_trials).cast("int").alias("_pages"), (
        F.col("_formed") > F.col("_sites") * F.col("_sites") * F.ceil(F.col("_trials") / 64)).alias("_packed"))
    sizes = join_on(sizes, groups, within).withColumns({"_blocks": F.ceil(F.col("_size") / block_sites).cast("int"), "_page": F.when(
        F.col("_packed"), F.pmod(F.xxhash64(trial), "_pages").cast("int"))}).drop("_size")
    member = stored(join_on(member, sizes, [trial, *within]))
    kinds = {tuple(r) for r in member.select("_packed", (F.col("_pages") > 1).alias("paged")).distinct().collect()}

    pair = [*within, *[f"{c}_a" for c in site], *[f"{c}_b" for c in site]]
    parts, out = [], []
    if (True, False) in kinds or (True, True) in kinds:
        packed = _packed_sites(member.where("_packed"), trial, within, site, 4 * block_sites)
        if (True, False) in kinds:
            out.append(_block_pairs(packed.where("_pages = 1"), within, ["_page"], site, min_shared))
        if (True, True) in kinds:
            parts.append(_block_pairs(packed.where("_pages > 1"), within, ["_page"], site, 1))
    if (False, False) in kinds or (False, True) in kinds or not kinds:
        single = member.where("NOT _packed").select(
            *within, F.col(trial).alias("_trial"), *site, F.lit(None).cast("array<bigint>").alias("_bits"), "_blocks")
        parts.append(_block_pairs(single, within, ["_trial"], site, 1))
    if parts:
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        out.append(both.groupBy(*pair).agg(F.sum("shared_trials").alias("shared_trials")).where(F.col("shared_trials") >= min_shared))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _packed_sites(member: DataFrame, trial: str, within: list[str], site: list[str], block_sites: int) -> DataFrame:
    """One row for each page and site: ``_bits`` has a bit for every trial of the page, in words of 64."""
    key = [*within, "_pages", "_page"]
    place = F.row_number().over(Window.partitionBy(*within, "_page").orderBy(trial)) - 1
    places = member.select(trial, *key).distinct().withColumn("_place", place)
    placed = join_on(member.select(trial, *within, *site), places, [trial, *within])
    word = F.floor(F.col("_place") / 64).cast("int").alias("_word")
    words = placed.groupBy(*key, *site, word).agg(F.bit_or(F.expr("shiftleft(1L, _place % 64)")).alias("_set"))
    sites = words.groupBy(*key, *site).agg(F.map_from_entries(F.collect_list(F.struct("_word", "_set"))).alias("_words"))
    pages = placed.groupBy(*key).agg(F.floor(F.max("_place") / 64).cast("int").alias("_last"))
    sites = join_on(sites, pages, key)
    counts = sites.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block_sites).cast("int").alias("_blocks"))
    bits = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda w: F.coalesce(F.try_element_at("_words", w), F.lit(0).cast("long")))
    return join_on(sites, counts, key).select(*key, *site, bits.alias("_bits"), "_blocks")


def _block_pairs(sites: DataFrame, within: list[str], page: list[str], site: list[str], min_shared: int) -> DataFrame:
    """(within, site a, site b, shared_trials) of every page, with at least ``min_shared`` there.

    A site of block i is the first of a pair in the meetings with blocks j >= i and the second in those with j <= i.
    """
    dealt = sites.withColumn("_block", F.pmod(F.xxhash64(*site), "_blocks").cast("int"))
    first = dealt.withColumns({"_lo": F.col("_block"), "_hi": F.explode(F.sequence(F.col("_block"), F.col("_blocks") - 1))})
    second = dealt.withColumns({"_hi": F.col("_block"), "_lo": F.explode(F.sequence(F.lit(0), F.col("_block")))})
    key = [*within, *page, "_lo", "_hi"]
    sides = [d.select(*key, *[F.col(c).alias(f"{c}_{tag}") for c in site], F.col("_bits").alias(f"_bits_{tag}"))
             for d, tag in ((first, "a"), (second, "b"))]

    def less(x: str, y: str):
        out, same = F.lit(False), F.lit(True)
        for c in site:
            out = out | (same & (F.col(f"{c}_{x}") < F.col(f"{c}_{y}")))
            same = same & F.col(f"{c}_{x}").eqNullSafe(F.col(f"{c}_{y}"))
        return F.coalesce(out, F.lit(False))

    both = F.zip_with("_bits_a", "_bits_b", lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long"))
    shared = F.when(F.col("_bits_a").isNull(), F.lit(1).cast("long")).otherwise(
        F.aggregate(both, F.lit(0).cast("long"), lambda n, x: n + x))
    pairs = join_on(*sides, key).withColumn("_turned", less("b", "a")).where(
        less("a", "b") | (F.col("_turned") & (F.col("_lo") < F.col("_hi"))))
    turned = lambda c, x, y: F.when(F.col("_turned"), F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}")
    pairs = pairs.select(*within, *[turned(c, "a", "b") for c in site], *[turned(c, "b", "a") for c in site], shared.alias("shared_trials"))
    return pairs.where(F.col("shared_trials") >= min_shared)
