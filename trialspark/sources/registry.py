"""The registry as a set of lazy DataFrames: loading, source resolution, text ingest, sinks."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.storagelevel import StorageLevel

from trialspark.functions import columns as X, constants as C
from trialspark.sources.schemas import SCHEMAS, conform


@dataclass(frozen=True)
class TrialTables:
    """Lazy registry tables; only ``studies`` is mandatory."""

    studies: DataFrame
    calculated_values: DataFrame | None = None
    eligibilities: DataFrame | None = None
    designs: DataFrame | None = None
    facilities: DataFrame | None = None
    countries: DataFrame | None = None
    sponsors: DataFrame | None = None
    conditions: DataFrame | None = None
    interventions: DataFrame | None = None
    outcome_counts: DataFrame | None = None

    @classmethod
    def of(cls, tables: dict[str, DataFrame]) -> "TrialTables":
        """From a name -> DataFrame mapping; unknown names are ignored."""
        if "studies" not in tables:
            raise ValueError("the 'studies' table is required")
        return cls(**{t: conform(tables[t], t) for t in C.TABLES if t in tables})

    def present(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}

    def create_views(self, prefix: str = "") -> None:
        """Register every table as a temp view for SQL text."""
        for name, df in self.present().items():
            df.createOrReplaceTempView(prefix + name)

    def persist(self, names: Iterable[str] = C.TABLES) -> "TrialTables":
        """Keep the named tables (spilling to disk) across queries; release with ``unpersist``."""
        wanted = set(names)
        return TrialTables(**{
            n: df.persist(StorageLevel.MEMORY_AND_DISK) if n in wanted else df
            for n, df in self.present().items()
        })

    def unpersist(self) -> None:
        for df in self.present().values():
            df.unpersist()


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def load_tables(spark: SparkSession, directory: str, only: Iterable[str] = C.TABLES) -> dict[str, DataFrame]:
    """Known tables stored as ``<directory>/<table>.parquet``; missing ones are skipped."""
    found = {}
    for table in only:
        path = f"{directory.rstrip('/')}/{table}.parquet"
        if table in SCHEMAS and path_exists(spark, path):
            found[table] = spark.read.parquet(path)
    return found


def load_registry(spark: SparkSession, directory: str) -> TrialTables:
    return TrialTables.of(load_tables(spark, directory))


_TEXT_FORMAT = {"sep": "|", "quote": '"', "escape": '"'}


def read_text_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A pipe-delimited registry file with a header.

    Columns are matched by header name, so files may hold more columns, or in another order. Line breaks inside quoted
    text, as in eligibilities, do not keep a file from being split: see ``_quoted_records``.
    """
    if table == "eligibilities":
        raw = _quoted_records(spark, path)
    else:
        raw = spark.read.options(**_TEXT_FORMAT).option("header", True).csv(path)
    cleaned = raw.select(*[X.null_tokens(f"`{c}`").alias(c) for c in raw.columns])
    df = conform(cleaned, table)
    return normalize_studies(df) if table == "studies" else df


def _quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of delimited files whose quoted fields hold line breaks, read by as many tasks as the files have blocks.

    A line starts a record if an even number of quotes stands before it. Quotes are counted per file block, the blocks of
    a file are summed up, and lines are then numbered inside their block. Only the pieces of records are shuffled.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'))))
    before = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    own = lines.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    blocks = own.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), F.count_if(F.col("odd") == 0).alias("even_starts"), F.count_if(F.col("odd") == 1).alias("odd_starts"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    blocks = blocks.withColumn("shift", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    started = F.when(F.col("shift") == 0, F.col("even_starts")).otherwise(F.col("odd_starts"))
    blocks = blocks.select("file", "block", "shift", F.coalesce(F.sum(started).over(earlier), F.lit(0)).alias("records"))
    upto = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = own.join(blocks, ["file", "block"]).withColumn("starts", F.col("odd") == F.col("shift"))
    placed = placed.withColumn("record", F.col("records") + F.sum(F.col("starts").cast("int")).over(upto))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    records = placed.groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("text"))
    records = records.select("record", F.rtrim("text", F.lit("\r")).alias("text")).where("text <> ''")
    header = spark.read.options(**_TEXT_FORMAT).option("header", True).csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in header)
    # the header is the first record of every file
    return records.where("record > 1").select(F.from_csv("text", schema, {**_TEXT_FORMAT, "maxCharsPerColumn": "-1"}).alias("r")).select("r.*")


def normalize_studies(df: DataFrame) -> DataFrame:
    """Phase repair and title-cased status, applied before studies are stored."""
    repaired = X.literal_map(C.PHASE_SPELLINGS)[X.normalized("phase")]
    return df.withColumns({
        "phase": F.coalesce(repaired, F.trim("phase"), F.lit(C.PHASE_UNKNOWN)),
        "overall_status": F.initcap(F.lower(F.trim("overall_status"))),
    })


def ingest_text_tables(spark: SparkSession, raw_dir: str, processed_dir: str) -> dict[str, DataFrame]:
    """Text files -> one parquet per table; returns the stored tables."""
    written = []
    for table in C.TABLES:
        path = f"{raw_dir.rstrip('/')}/{table}.txt"
        if path_exists(spark, path):
            write_table(read_text_table(spark, path, table), processed_dir, table)
            written.append(table)
    return load_tables(spark, processed_dir, written)


def write_table(df: DataFrame, directory: str, table: str) -> str:
    path = f"{directory.rstrip('/')}/{table}.parquet"
    df.write.mode("overwrite").parquet(path)
    return path


def save_modeling_table(df: DataFrame | None, directory: str) -> str:
    if df is None:
        raise RuntimeError("nothing to save: build the modeling table first")
    return write_table(df, directory, "modeling_df")


def load_modeling_table(spark: SparkSession, directory: str) -> DataFrame:
    path = f"{directory.rstrip('/')}/modeling_df.parquet"
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no saved modeling table at {path}")
    return spark.read.parquet(path)


def store_bucketed(tables: TrialTables, prefix: str, path: str, buckets: int = 200) -> TrialTables:
    """Write every table to ``path`` in the same buckets of ``nct_id`` and read them back as ``<prefix><table>``.

    Joins and groupings on ``nct_id`` then need no shuffle: a bucket of one table meets the same bucket of the others. Size
    ``buckets`` so that one of the largest table fits a task. The tables stay until they are dropped.
    """
    spark = tables.studies.sparkSession
    for name, df in tables.present().items():
        df.repartition(buckets, "nct_id").write.format("parquet").bucketBy(buckets, "nct_id").sortBy("nct_id").option(
            "path", f"{path.rstrip('/')}/{name}").mode("overwrite").saveAsTable(prefix + name)
    return load_bucketed(spark, prefix)


def load_bucketed(spark: SparkSession, prefix: str, only: Iterable[str] = C.TABLES) -> TrialTables:
    """The tables that ``store_bucketed`` left in the catalog."""
    return TrialTables.of({t: spark.table(prefix + t) for t in only if spark.catalog.tableExists(prefix + t)})


def resolve_source(
    spark: SparkSession, candidates: Iterable[tuple[str, str]], raw_dir: str | None = None,
    processed_dir: str | None = None,
) -> tuple[TrialTables, str]:
    """First usable source of ``candidates`` = [(name, directory)]: non-empty readable studies.

    Raw text files come last, ingested into ``processed_dir``.
    """
    for name, directory in candidates:
        tables = load_tables(spark, directory)
        if "studies" in tables and not tables["studies"].isEmpty():
            return TrialTables.of(tables), name
    if raw_dir is not None and processed_dir is not None:
        tables = ingest_text_tables(spark, raw_dir, processed_dir)
        if "studies" in tables:
            return TrialTables.of(tables), "raw text"
    raise FileNotFoundError("no source holds a readable, non-empty studies table")


def load_from_jdbc(
    spark: SparkSession, url: str, partitions: dict[str, dict], schema: str = "ctgov",
    only: Iterable[str] = C.TABLES, **options: str,
) -> TrialTables:
    """A live relational registry.

    ``partitions[table]`` takes partitionColumn / lowerBound / upperBound / numPartitions for every table,
    so that each is read by many tasks.
    """
    wanted = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
    if lacking := [t for t in only if any(k not in partitions.get(t, {}) for k in wanted)]:
        raise ValueError(f"say how to partition {', '.join(lacking)}: {', '.join(wanted)}")
    tables = {}
    for table in only:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"{schema}.{table}")
        for k, v in {**options, **partitions[table]}.items():
            reader = reader.option(k, v)
        tables[table] = reader.load()
    return TrialTables.of(tables)


def query_registry(spark: SparkSession, tables: TrialTables, sql: str, **args) -> DataFrame:
    """SQL text over the registry views; ``:name`` parameters are bound, never spliced."""
    tables.create_views()
    return spark.sql(sql, args=args)
