"""The feature matrix of a log that grows, from sums kept between runs.

A folder holds, for each batch of log files that was taken in, what the
matrix needs of them in a form that can be added up:

==========  ===============================================================
measures    look-back sums per shopper and band, as ``lookback.add_up`` has
depts       recent spend and quantity per shopper and dept
offered     copies of each whole row on offer
shoppers    spend per shopper, all shoppers of the log
dept_days   last day of each category under each dept
reduced     the rows that have to do with some offer, as they are
bad         malformed lines, if they are put aside
files       the batch's files, rows read and rows kept; written last
==========  ===============================================================

A run lists the log's files, reads those that no batch has in that state, and
writes their batch.  A file that is gone or was changed takes its batch out;
the other files of that batch are read again.  Batches without their ``files``,
as a failed run leaves them, are not looked at.  Then the sums of all batches are
added up, which reads no log file.  The sums belong to the offers, the history
and the options: other ones begin a folder of their own.

The dept of an offer is that of its category's last purchase, so new files may
change it; ``depts`` therefore has all depts of a shopper.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions import cents, day_diff, money, zero_if_null
from tillroll.operators import lookback as lb
from tillroll.operators import market as mk
from tillroll.operators.joins import fits_broadcast, join_lookup
from tillroll.operators.reduction import flag_offered
from tillroll.operators.spine import dept_last_days, latest_dept, with_dept
from tillroll.plans import features as ft
from tillroll.plans.pipeline import Inputs, history_table
from tillroll.session import stage
from tillroll.sources import files, schemas
from tillroll.sources.schemas import ITEMS

logger = logging.getLogger(__name__)

FILES_SCHEMA = (
    "batch string, path string, length bigint, modified bigint, searched bigint, kept bigint"
)
# Batches are merged into one when there are more.
MOST_BATCHES = 64


class Grown(NamedTuple):
    features: DataFrame  # X1..X87
    totals: DataFrame  # spend of every shopper in the log
    reduced: DataFrame  # rows that have to do with some offer
    reduction: dict[str, int]  # rows searched and rows kept, over all files
    files_read: int  # by this run
    bad_lines: DataFrame | None  # malformed lines of all files, if they are put aside


class _Store:
    """The batches of one folder."""

    def __init__(self, spark: SparkSession, folder: str, bad_lines: bool):
        self.spark, self.folder = spark, folder
        self.parts = [part for part in ADD if bad_lines or part != "bad"]

    def path(self, part: str, batch: str) -> str:
        return f"{self.folder}/{part}/{batch}"

    def taken(self) -> DataFrame:
        """All files taken in, of live batches and of others."""
        reader = self.spark.read.schema(FILES_SCHEMA).option("recursiveFileLookup", True)
        try:
            return reader.parquet(f"{self.folder}/files")
        except AnalysisException:  # nothing yet
            return self.spark.createDataFrame([], FILES_SCHEMA)

    def drop(self, batches: Sequence[str]) -> None:
        """Take batches out: their list of files comes first, so they are never half there."""
        for part in ("files", *self.parts):
            for batch in batches:
                self.spark.range(0).write.mode("overwrite").parquet(self.path(part, batch))

    def read(self, part: str, batches: Sequence[str]) -> DataFrame:
        parts = [self.spark.read.parquet(self.path(part, batch)) for batch in batches]
        return reduce(DataFrame.unionByName, parts)


def _sum_by(*keys: str, **how: Callable) -> Callable[[DataFrame], DataFrame]:
    def add(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(*[how.get(c, F.sum)(c).alias(c) for c in values])

    return add


def _add_copies(rows: DataFrame) -> DataFrame:
    return _sum_by(*[c for c in rows.columns if c != "copies"])(rows)


ADD: dict[str, Callable[[DataFrame], DataFrame]] = {
    "measures": lb.add_up,
    "depts": _sum_by("id", "dept"),
    "offered": _add_copies,
    "shoppers": _sum_by("id"),
    "dept_days": _sum_by("category", "dept", last=F.max),
    "reduced": lambda rows: rows,
    "bad": lambda rows: rows,
}


def recent_by_dept(
    transactions: DataFrame,
    spine: DataFrame,
    recent_days: int,
    before_offer: bool,
    small: bool | None = None,
) -> DataFrame:
    """Recent spend and quantity of the spine's shoppers in every dept."""
    bought = transactions.select("id", "dept", "date", "purchasequantity", "purchaseamount")
    rows = join_lookup(
        bought.where("dept is not null"), spine.select("id", "offerdate"), "id", small=small
    )
    ago = day_diff("offerdate", "date")
    rows = rows.where(ago <= recent_days)
    if before_offer:
        rows = rows.where(ago > 0)
    quantity = zero_if_null(F.col("purchasequantity").cast("bigint"))
    return rows.groupBy("id", "dept").agg(
        F.sum(zero_if_null(cents("purchaseamount"))).alias("cents"),
        F.sum(quantity).alias("quantity"),
    )


def _take_in(
    store: _Store,
    new: DataFrame,
    rows: DataFrame,
    bad: DataFrame | None,
    offers: DataFrame,
    spine: DataFrame,
    day_limits: Sequence[int | None],
    recent_days: int,
    before_offer: bool,
) -> str:
    """Write the batch of ``rows`` and ``bad`` lines, the contents of the ``new`` files."""
    batch = uuid.uuid4().hex
    small = fits_broadcast(spine)
    events = lb.history_events(rows, spine, before_offer, small)
    flagged = flag_offered(rows, offers, only=True)
    spend = F.sum(zero_if_null(cents("purchaseamount"))).alias("cents")
    parts = {
        "measures": lb.add_up(lb.event_measures(events, day_limits, recent_days)),
        "depts": recent_by_dept(rows, spine, recent_days, before_offer, small),
        "offered": mk.whole_row_counts(rows, offers, spine if before_offer else None, small),
        "shoppers": rows.where("id is not null").groupBy("id").agg(spend),
        "dept_days": dept_last_days(rows, offers),
        "reduced": flagged.select(*rows.columns),
    }
    if bad is not None:
        parts["bad"] = bad
    for part, table in parts.items():
        table.write.parquet(store.path(part, batch))
    searched = rows.count()
    kept = store.read("reduced", [batch]).count()
    counted = new.select(
        F.lit(batch).alias("batch"),
        "path",
        "length",
        "modified",
        F.lit(searched).cast("bigint").alias("searched"),
        F.lit(kept).cast("bigint").alias("kept"),
    )
    counted.write.parquet(store.path("files", batch))
    return batch


def _merge(store: _Store, batches: list[str]) -> str:
    """Make one batch of many; the old ones go when the new one is whole."""
    merged = uuid.uuid4().hex
    for part in store.parts:
        ADD[part](store.read(part, batches)).write.parquet(store.path(part, merged))
    known = store.taken().where(F.col("batch").isin(batches))
    numbers = known.select("batch", "searched", "kept").distinct()
    sums = numbers.agg(F.sum("searched").alias("searched"), F.sum("kept").alias("kept")).first()
    known.select(
        F.lit(merged).alias("batch"),
        "path",
        "length",
        "modified",
        F.lit(sums["searched"]).alias("searched"),
        F.lit(sums["kept"]).alias("kept"),
    ).write.parquet(store.path("files", merged))
    store.drop(batches)
    return merged


def update(
    spark: SparkSession,
    inputs: Inputs,
    folder: str,
    key_types: Mapping[str, str] | None = None,
    fmt: str = "csv",
    *,
    outcome: bool = True,
    day_limits: Sequence[int | None] = lb.DAY_LIMITS,
    recent_days: int = lb.RECENT_DAYS,
    before_offer: bool = False,
    dedupe: bool = True,
    strict_dept: bool = True,
    most_batches: int = MOST_BATCHES,
    bad_lines: bool = False,
) -> Grown:
    """X1..X87 over all files of the log; only files that are new or changed are read.

    The same rows as ``features.feature_matrix`` over the whole log.  One run at
    a time may use a folder.  ``key_types`` gives the types of dept, category,
    company and brand, ``fmt`` is csv or parquet.  A malformed line of the log ends the
    run; with ``bad_lines`` those of CSV files are put aside.
    """
    types = dict(key_types or {})
    offer_types = {k: v for k, v in types.items() if k != "dept"}
    offers = files.read_table(spark, inputs.offers, schemas.offers_schema(**offer_types), fmt)
    offers = stage(offers, "offers")
    files.require_keys(offers, ["offer", *ITEMS], "offers")
    history = history_table(spark, inputs.history, outcome, fmt)
    files.require_keys(history, ["id", "offer", "offerdate"], "history")
    spine = ft.build_spine(history, offers)

    aside = bad_lines and fmt == "csv"
    options = [types, fmt, outcome, list(day_limits), recent_days, before_offer]
    options += ["bad lines aside"] * aside
    state = files.digest([files.file_state(spark, inputs.offers, inputs.history), options])
    store = _Store(spark, f"{folder.rstrip('/')}/{state[:32]}", aside)

    present = stage(files.file_list(spark, [inputs.transactions]), "present")
    taken = stage(store.taken(), "taken")
    keys = ["path", "length", "modified"]
    gone = join_lookup(taken, present, keys, "left_anti").select("batch").distinct()
    stale = [r[0] for r in gone.collect()]
    live = sorted(r[0] for r in taken.select("batch").distinct().collect() if r[0] not in stale)
    valid = taken.where(F.col("batch").isin(live)).select(*keys)
    new = stage(join_lookup(present, valid, keys, "left_anti"), "new-files")
    store.drop(stale)

    found = new.count()
    if found:
        log_schema = schemas.transactions_schema(**types)
        # A list of paths only for what was added; a whole log is named by its folder.
        paths = [r[0] for r in new.select("path").collect()] if live else inputs.transactions
        if aside:
            rows, bad = files.split_bad_lines(spark, paths, log_schema)
        else:  # text is parsed once here too
            rows, bad = files.read_table(spark, paths, log_schema, fmt), None
            rows = rows if fmt == "parquet" else stage(rows, "new-rows")
        live.append(
            _take_in(store, new, rows, bad, offers, spine, day_limits, recent_days, before_offer)
        )
    logger.info("%s new files, %s batches of which %s went", found, len(live), len(stale))
    if not live:
        raise ValueError(f"no files below {inputs.transactions}")
    if len(live) > most_batches:
        live = [_merge(store, live)]

    dept_map = stage(latest_dept(ADD["dept_days"](store.read("dept_days", live))), "dept-map")
    measured = with_dept(spine, dept_map, strict_dept)
    measured = stage(measured, "spine")
    small = fits_broadcast(measured)
    looked = lb.per_shopper(
        lb.roll_up(store.read("measures", live)),
        ft.lookback_features(ITEMS, day_limits, recent_days),
    )
    own_dept = join_lookup(
        store.read("depts", live), measured.select("id", "dept"), ["id", "dept"], "left_semi", small
    )
    by_dept = own_dept.groupBy("id").agg(
        (F.sum("cents") / F.lit(100.0)).alias("dept_recent_amount"),
        F.sum("quantity").alias("dept_recent_quantity"),
    )
    looked = looked.join(by_dept, "id", "left").fillna(0, subset=by_dept.columns[1:])

    shoppers = stage(ADD["shoppers"](store.read("shoppers", live)), "shoppers")
    rollup = mk.rollup_of(ADD["offered"](store.read("offered", live)), dedupe)
    matrix = ft.matrix_from_rollup(
        looked, measured, small, ft.grid_names(ITEMS, day_limits), rollup, offers, shoppers.count()
    )
    counted = store.taken().where(F.col("batch").isin(live))
    counted = counted.select("batch", "searched", "kept").distinct()
    sums = counted.agg(F.sum("searched").alias("searched"), F.sum("kept").alias("kept")).first()
    totals = shoppers.select("id", money("cents").alias("total_spend"))
    reduced = store.read("reduced", live)
    lines = store.read("bad", live) if aside else None
    return Grown(matrix, totals, reduced, sums.asDict(), found, lines)
