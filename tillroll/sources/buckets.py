"""Tables kept in buckets of a key, so that joins on it need no shuffle of them."""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillroll.operators.joins import hot_keys
from tillroll.session import piece_rows


class Buckets(NamedTuple):
    """``count`` buckets by the hash of ``key``; rows of a file are in order of it and ``order``."""

    key: str
    count: int
    order: tuple[str, ...] = ()


def enough_buckets(rows: DataFrame, buckets: Buckets) -> Buckets:
    """``buckets``, or a multiple of them, so that one has no more rows than a piece on average.

    A join by bucket has one task for each, which must not grow with the table.
    """
    most = buckets.count * piece_rows(rows.sparkSession)
    return buckets._replace(count=buckets.count * max(1, math.ceil(rows.count() / most)))


def spread(rows: DataFrame, buckets: Buckets) -> DataFrame:
    """One partition per bucket, but the rows of a hot key in pieces of several partitions.

    A piece is a file of its own in the key's bucket, so that no task writes
    more of a key than one piece.  Null is a key like any other here.
    """
    key, count = buckets.key, F.lit(buckets.count)
    place = F.pmod(F.hash(key), count)
    hot = hot_keys(rows, [key])
    if hot is None:
        return rows.repartitionById(buckets.count, place)
    # The same when a lost task runs again, see join_lookup.
    piece = F.pmod(F.xxhash64(F.spark_partition_id(), *rows.columns), F.col("_pieces"))
    beside = rows.join(
        F.broadcast(hot.withColumnRenamed(key, "_hot")), F.col(key).eqNullSafe(F.col("_hot")), "left"
    )
    shifted = F.pmod(place + F.coalesce(piece, F.lit(0)), count).cast("int").alias("_place")
    placed = beside.select(*rows.columns, shifted)
    return placed.repartitionById(buckets.count, F.col("_place")).drop("_place")


def _name(path: str) -> str:
    return f"tillroll_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def write_bucketed(rows: DataFrame, path: str, buckets: Buckets) -> None:
    """Write ``rows`` to the folder ``path``, over what is there."""
    rows.sparkSession.sql(f"drop table if exists {_name(path)}")  # the entry, not its files
    writer = spread(rows, buckets).write.mode("overwrite").option("path", path)
    writer = writer.bucketBy(buckets.count, buckets.key)
    writer.sortBy(buckets.key, *buckets.order).saveAsTable(_name(path))


def read_bucketed(spark: SparkSession, path: str, schema: StructType, buckets: Buckets) -> DataFrame:
    """The table in ``path`` with its buckets, also if another session wrote it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    order = ", ".join((buckets.key, *buckets.order))
    spark.sql(f"drop table if exists {_name(path)}")
    spark.sql(
        f"create table {_name(path)} ({columns}) using parquet"
        f" clustered by ({buckets.key}) sorted by ({order}) into {buckets.count} buckets"
        f" location '{path}'"
    )
    return spark.table(_name(path))
