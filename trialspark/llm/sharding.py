"""Shards of eligibility texts that all match the mixture of the whole, by proportional stratified interleaving.

The texts of a stratum are shuffled by a seeded hash and ranked; rank over size of the stratum is a fraction that grows evenly
from 0 to 1 in every stratum, so in the order of the fractions each stretch holds the strata in their proportions. That order
is cut into shards of equal numbers of rows.

Both ranks are made from counts: a hash is cut into ranges, and so is the fraction; only the rows of one narrow range are
ordered together. All of it is SQL on a short row for each text; the texts themselves are not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.ordered import join_on

RANGES = 1 << 16  # of the hash within a stratum, and of the fraction over all rows
COPIES = 4096  # equal rows that are told apart at once


def _hash(*parts: str | Column) -> Column:
    return F.md5(F.concat_ws("|", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts)))


def _digits(h: Column, n: int) -> Column:
    return F.conv(F.substring(h, 1, n), 16, 10).cast("long")


def _earlier(window) -> Column:
    return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def shard_texts(eligibilities: DataFrame, *, stratum: Sequence[str] = ("gender",), key: str = "nct_id", text: str = "criteria", shards: int = 16,
                seed: int = 42) -> DataFrame:
    """``key``, ``n_bytes``, ``checksum``, ``shard`` and ``slot`` of every text; shards differ by one row at most.

    ``stratum`` names the columns whose mixture every shard shall match. ``n_bytes`` counts the UTF-8 bytes of the text,
    ``checksum`` is their CRC-32; ``slot`` numbers the rows of a shard from 0 without gaps, in the interleaved order, so any
    stretch of a shard is mixed as well.

    A null text has no bytes and the checksum 0; null and empty strata count as one; a null key is a key; rows that are equal in
    key, strata, length and checksum are numbered and placed each; an empty table gives no rows; extra columns are ignored. The result
    depends on the rows and the seed alone. A stratum of any share of the rows is ordered by many tasks.
    """
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = eligibilities.select(F.col(key).alias("k"), F.octet_length(data).cast("long").alias("n_bytes"), F.crc32(data).alias("checksum"), _hash(*stratum).alias("s"))
    counted = rows.groupBy("k", "n_bytes", "checksum", "s").count()
    some = counted.withColumn("block", F.explode(F.sequence(F.lit(0), ((F.col("count") - 1) / COPIES).cast("long"))))
    left = F.least(F.col("count") - F.col("block") * COPIES, F.lit(COPIES)) - 1
    copies = some.withColumn("copy", F.explode(F.sequence(F.lit(0), left.cast("int")))).withColumn("copy", F.col("block") * COPIES + F.col("copy"))
    shuffled = copies.select("k", "n_bytes", "checksum", "s", _hash(F.lit(seed), "k", "n_bytes", "checksum", "copy").alias("h"))
    shuffled = shuffled.withColumn("range", _digits(F.col("h"), 4))

    sizes, own = shuffled.groupBy("s", "range").agg(F.count("*").alias("n")), Window.partitionBy("s")
    sizes = sizes.select("s", "range", _earlier(own.orderBy("range")).alias("before"), F.sum("n").over(own).alias("size"))
    ranked = join_on(shuffled.withColumn("rank", F.row_number().over(Window.partitionBy("s", "range").orderBy("h"))), sizes, ["s", "range"])
    # each stratum starts at its own place, or the only rows of many small strata would all stand at one fraction
    start = _digits(_hash(F.lit(seed), "s"), 8).cast("double") / 2**32
    fraction = (F.col("before") + F.col("rank") - 1 + start) / F.col("size")
    placed = ranked.select("k", "n_bytes", "checksum", "s", "h", fraction.alias("fraction")).withColumn("cell", F.floor(F.col("fraction") * RANGES))

    cells = placed.groupBy("cell").agg(F.count("*").alias("n"))  # RANGES rows at most
    everything = Window.partitionBy(F.lit(0))
    cells = cells.select("cell", _earlier(everything.orderBy("cell")).alias("before"), F.sum("n").over(everything).alias("rows"))
    inside = F.row_number().over(Window.partitionBy("cell").orderBy("fraction", "s", "h"))
    place = join_on(placed.withColumn("rank", inside), cells, ["cell"]).withColumn("place", F.col("before") + F.col("rank") - 1)
    shard = F.expr(f"place * {shards} DIV rows")
    return place.withColumn("shard", shard).select(
        F.col("k").alias(key), "n_bytes", "checksum", F.col("shard").cast("int").alias("shard"),
        (F.col("place") - F.expr(f"(shard * rows + {shards - 1}) DIV {shards}")).alias("slot"))
