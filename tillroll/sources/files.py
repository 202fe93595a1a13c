"""Reading the input tables, writing and reloading results."""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tillroll.session import stage
from tillroll.sources.buckets import Buckets, enough_buckets, read_bucketed, write_bucketed

logger = logging.getLogger(__name__)

BAD_LINE = "_bad_line"


def read_table(
    spark: SparkSession, path: str | list[str], schema: StructType, fmt: str = "csv"
) -> DataFrame:
    """One lazy scan of a CSV (with header) or Parquet table, every row of all files below.

    The header must name the declared columns and a malformed line fails the
    job.  Rows with missing keys stay: they match no offer and no shopper, but
    a purchase of a missing brand is a purchase.
    """
    reader = spark.read.schema(schema).option("recursiveFileLookup", True)
    if fmt == "csv":
        reader = (
            reader.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
        )
    return reader.format(fmt).load(path)


def split_bad_lines(
    spark: SparkSession, path: str | list[str], schema: StructType
) -> tuple[DataFrame, DataFrame]:
    """A CSV table's good rows, and its malformed lines as ``file`` and ``line``.

    A line is malformed if a field is not of its column's type or if there are
    too few or too many fields.  The text is parsed once, into a staged table
    with a folder for either kind.  A header in another order fails the job, as
    ever.
    """
    reader = (
        spark.read.schema(StructType([*schema.fields, StructField(BAD_LINE, StringType())]))
        .option("recursiveFileLookup", True)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_LINE)
        # Whether a line is malformed must not depend on the columns asked for.
        .option("columnPruning", False)
    )
    parsed = reader.csv(path).withColumn("_file", F.col("_metadata.file_path"))
    both = stage(
        parsed.withColumn("_bad", F.col(BAD_LINE).isNotNull()), "lines", partition_by="_bad"
    )
    good = both.where("not _bad").select(*schema.names)
    bad = both.where("_bad").select(F.col("_file").alias("file"), F.col(BAD_LINE).alias("line"))
    return good, bad


def require_keys(table: DataFrame, keys: Sequence[str], name: str) -> None:
    """Fail if a row of an offers or history table lacks a key."""
    missing = table.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in keys]).first().asDict()
    if any(missing.values()):
        raise ValueError(f"{name}: rows without {({k: n for k, n in missing.items() if n})}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def save_versioned(df: DataFrame, folder: str, name: str) -> str | None:
    """Save under a time-stamped name; warn and save nothing if empty.

    Written once, in the order of ``df``, and counted while it is written.
    """
    if df.isEmpty():
        logger.warning("%s has no rows, nothing saved", name)
        return None
    path = f"{folder.rstrip('/')}/{name}.{time.time_ns()}"
    seen = Observation()
    # One partition's rows are one file, so files are in the order of the rows.
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
    logger.info("saved %s rows to %s", seen.get["rows"], path)
    return path


def load_saved(spark: SparkSession, paths: Sequence[str]) -> list[DataFrame]:
    """The saved tables, in the order of ``paths``."""
    return [spark.read.parquet(path) for path in paths]


def file_list(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All files below ``paths`` with length and modification time; none is opened.

    One read, however many paths there are.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    modified = F.unix_millis("modificationTime").alias("modified")
    return reader.load(list(paths)).select("path", "length", modified)


def file_state(spark: SparkSession, *paths: str) -> str:
    """Names, lengths and modification times of all files below ``paths``, as one digest."""
    files = file_list(spark, paths)
    # Added up on the cluster: there may be very many files.
    mixed = F.bit_xor(F.xxhash64("path", "length", "modified"))
    return digest([sorted(paths), *files.agg(F.count("*"), F.sum("length"), mixed).first()])


def digest(parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def frame_state(*frames: DataFrame) -> str:
    """State of what ``frames`` read: their plans and the files under them."""
    spark = frames[0].sparkSession
    files = sorted({f for frame in frames for f in frame.inputFiles()})
    plans = [frame.semanticHash() for frame in frames]
    return digest([plans, file_state(spark, *files) if files else ""])


def _manifest(spark: SparkSession, path: str) -> dict:
    try:
        rows = spark.read.text(f"{path.rstrip('/')}.manifest").collect()
    except AnalysisException:  # there is none
        return {}
    return json.loads(rows[0][0]) if rows else {}


def _write_manifest(spark: SparkSession, path: str, content: Mapping) -> None:
    row = spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1)
    row.write.mode("overwrite").text(f"{path.rstrip('/')}.manifest")


def reuse_or_build(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    state: str,
    counts: Mapping[str, Column] | None = None,
    more: Callable[[], Mapping[str, int]] = dict,
    buckets: Buckets | None = None,
) -> tuple[DataFrame, dict[str, int]]:
    """The table at ``path``, built unless it was finished from inputs in ``state``.

    A manifest beside the table, written last, holds the state and the numbers
    that ``counts``, aggregates over the built rows, gave while it was written,
    with what ``more`` knows after that.  With ``buckets`` the table is kept in them, a
    large one in ``enough_buckets``.
    """
    if buckets:
        state = digest([state, buckets])
    found = _manifest(spark, path)
    if found.get("state") != state:
        logger.warning("%s is missing or of other inputs, building it", path)
        _write_manifest(spark, path, {"state": None})
        seen, rows = Observation(), build()
        if buckets:
            buckets = enough_buckets(rows, buckets)
        if counts:
            rows = rows.observe(seen, *[c.alias(n) for n, c in counts.items()])
        if buckets:
            write_bucketed(rows, path, buckets)
        else:
            rows.write.mode("overwrite").parquet(path)
        found = {"state": state, "counts": (dict(seen.get) if counts else {}) | dict(more())}
        if buckets:
            found["buckets"] = buckets.count
        _write_manifest(spark, path, found)
    table = spark.read.parquet(path)
    if buckets:
        count = found.get("buckets", buckets.count)
        table = read_bucketed(spark, path, table.schema, buckets._replace(count=count))
    return table, found["counts"]
