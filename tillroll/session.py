"""Where intermediate tables live, and the settings the library reads.

Settings, all optional, taken from the running session:

``spark.checkpoint.dir``
    Shared folder for intermediate tables.  Required on a cluster.
``spark.tillroll.broadcastBytes``
    Largest lookup table, measured, that is broadcast (default 256 MiB).
``spark.tillroll.pieceRows``
    A join key with more rows than this is split into pieces of about so many
    rows when the lookup is too large to broadcast (default 2,000,000).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Worth setting when the session is made.  The wide feature plans use more
# generated classes than the default cache holds, so without this each run
# compiles them anew.
SESSION_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.codegen.cache.maxEntries": "2000",
    "spark.sql.session.timeZone": "UTC",
}

DEFAULT_BROADCAST_BYTES = 256 * 1024 * 1024
DEFAULT_PIECE_ROWS = 2_000_000

_local_folders: dict[str, str] = {}
_staged: dict[str, list[str]] = {}
_after_staging: list[Callable[[SparkSession], None]] = []


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.tillroll.broadcastBytes", str(DEFAULT_BROADCAST_BYTES)))


def piece_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.tillroll.pieceRows", str(DEFAULT_PIECE_ROWS)))


def work_folder(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if shared:
        return f"{shared.rstrip('/')}/tillroll-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="tillroll-")
    return _local_folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that outlives lost executors, and gives later
    plans column pruning and true file sizes.  ``partition_by`` is a column of few
    values, each of which gets a folder.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=partition_by)
    _staged.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    for call in _after_staging:
        call(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def after_staging(call: Callable[[SparkSession], None]) -> Iterator[None]:
    """Make ``call`` after each table that is staged meanwhile."""
    _after_staging.append(call)
    try:
        yield
    finally:
        _after_staging.remove(call)


def staged_mark(spark: SparkSession) -> int:
    """How many tables have been staged so far, for ``release_staged``."""
    return len(_staged.get(spark.sparkContext.applicationId, ()))


def release_staged(spark: SparkSession, mark: int = 0, keep: int = 0) -> int:
    """Free the space of the tables staged since ``mark``; they read as empty afterwards.

    Whoever called for the tables calls this when their results are used up.
    The last ``keep`` of them stay.
    """
    paths = _staged.get(spark.sparkContext.applicationId, [])
    end = max(len(paths) - keep, mark)
    released = paths[mark:end]
    for path in released:
        spark.range(0).write.mode("overwrite").parquet(path)
    del paths[mark:end]
    return len(released)
