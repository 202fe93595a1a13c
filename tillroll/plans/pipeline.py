"""From the input files to the saved feature tables, in one call."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from tillroll.operators import lookback as lb
from tillroll.operators.joins import fits_broadcast
from tillroll.operators.keysets import compare_frequency
from tillroll.operators.market import shopper_totals
from tillroll.operators.reduction import reduced_table
from tillroll.operators.spine import category_dept_map
from tillroll.plans import features as ft
from tillroll.session import release_staged, stage, staged_mark
from tillroll.sources import files, schemas
from tillroll.sources.buckets import Buckets
from tillroll.sources.schemas import ITEMS


class Inputs(NamedTuple):
    offers: str
    transactions: str
    history: str


class Results(NamedTuple):
    totals: DataFrame  # spend of every shopper in the log
    matched: dict[str, DataFrame]  # purchases that match the own offer, per item
    features: DataFrame  # X1..X87 with the offer's columns, by shopper
    reduction: dict[str, int]  # rows searched and rows kept
    saved_base: str | None
    saved_features: str | None
    mark: int  # of the staged tables before the run
    bad_lines: DataFrame | None  # malformed lines of the log, if they were put aside

    def release(self) -> None:
        """Free the run's staged tables; the frames above are used up then."""
        release_staged(self.totals.sparkSession, self.mark)


def history_table(
    spark: SparkSession, path: str, outcome: bool = True, fmt: str = "csv"
) -> DataFrame:
    """A history file with or without the outcome columns."""
    schema = schemas.train_history_schema() if outcome else schemas.test_history_schema()
    return files.read_table(spark, path, schema, fmt)


def offers_of_both(
    spark: SparkSession, train: str, test: str, fmt: str = "csv"
) -> DataFrame:
    """How often each offer occurs in a history with and in one without outcome."""
    left = history_table(spark, train, True, fmt)
    right = history_table(spark, test, False, fmt)
    return compare_frequency(left, right, "offer", ("train_offer", "test_offer"))


def run(
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
    buckets: int | None = None,
    bad_lines: bool = False,
) -> Results:
    """Build and save the base features and the full matrix.

    ``folder`` keeps the log of a CSV file as Parquet, in order of shoppers,
    the reduction and the dept map.  A later run reuses what was made from the
    same files with the same key types and builds the rest anew.  A log in
    Parquet is read where it is.  ``outcome`` says whether the history has the
    outcome columns, ``key_types`` gives the types of dept, category, company
    and brand.  With ``buckets`` the log is kept in so many buckets of shoppers, or
    a multiple of that if they would have more rows than one piece may,
    one in Parquet too: a history too large to broadcast is then joined without
    a shuffle of the log, unless a shopper has more rows than one piece may have.
    A malformed line of the log ends the run; with ``bad_lines`` those of a CSV log are
    kept in a table of their own, and the results are of the others.
    """
    mark = staged_mark(spark)
    types = dict(key_types or {})
    offer_types = {k: v for k, v in types.items() if k != "dept"}
    folder = folder.rstrip("/")
    aside = bad_lines and fmt == "csv"
    log_state = files.digest([files.file_state(spark, inputs.transactions), types, fmt, aside])
    state = files.digest([log_state, files.file_state(spark, inputs.offers)])

    offers = stage(
        files.read_table(spark, inputs.offers, schemas.offers_schema(**offer_types), fmt), "offers"
    )
    files.require_keys(offers, ["offer", *ITEMS], "offers")
    history = history_table(spark, inputs.history, outcome, fmt)
    files.require_keys(history, ["id", "offer", "offerdate"], "history")
    log_schema = schemas.transactions_schema(**types)
    bad = None

    def log() -> DataFrame:
        if not aside:
            return files.read_table(spark, inputs.transactions, log_schema, fmt)
        good, lines = files.split_bad_lines(spark, inputs.transactions, log_schema)
        lines.write.mode("overwrite").parquet(f"{folder}/bad-lines")
        return good

    if buckets:
        transactions, _ = files.reuse_or_build(
            spark,
            f"{folder}/transactions-by-shopper",
            log,
            log_state,
            buckets=Buckets("id", buckets, ("date",)),
        )
    elif fmt != "parquet":
        # Ranges of shoppers and days: a shopper with very many purchases is several files.
        transactions, _ = files.reuse_or_build(
            spark,
            f"{folder}/transactions",
            lambda: log().repartitionByRange("id", "date").sortWithinPartitions("id", "date"),
            log_state,
        )
    else:
        transactions = log()
    if aside:
        bad = spark.read.parquet(f"{folder}/bad-lines")
    dept_map, _ = files.reuse_or_build(
        spark, f"{folder}/dept-map", lambda: category_dept_map(transactions, offers), state
    )
    reduced, counts = reduced_table(spark, f"{folder}/reduced", transactions, offers, state)

    spine = ft.build_spine(history, offers, dept_map)
    small = fits_broadcast(spine)
    names = ft.grid_names(day_limits=day_limits)
    looked = stage(
        ft.lookback_table(
            transactions,
            spine,
            day_limits=day_limits,
            recent_days=recent_days,
            before_offer=before_offer,
            small_spine=small,
        ),
        "lookback",
    )
    base = ft.base_from_lookback(looked, spine, small, names)
    saved_base = files.save_versioned(ft.sorted_for_export(base), folder, "base-features")

    full = stage(
        ft.matrix_from_lookback(
            looked,
            spine,
            small,
            names,
            transactions,
            offers,
            before_offer,
            dedupe,
            keep_offer_columns=True,
        ),
        "matrix",
    )
    features = ft.sorted_for_export(full)
    saved = files.save_versioned(features.drop(*ft.OFFER_COLUMNS), folder, "all-features")

    events = lb.history_events(reduced, spine, before_offer, small=small)
    matched = {item: lb.matched_events(events, item) for item in ITEMS}
    return Results(
        shopper_totals(transactions), matched, features, counts, saved_base, saved, mark, bad
    )
