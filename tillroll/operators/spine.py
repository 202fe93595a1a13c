"""The spine: one row per shopper with the offer that shopper received."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions import recode_label
from tillroll.operators.joins import fits_broadcast, join_lookup


def history_with_offers(history: DataFrame, offers: DataFrame) -> DataFrame:
    """History joined with its offers; ``repeater``, if any, becomes ``label``.

    Works for a history with or without an outcome.  Histories of offers that
    are not in ``offers`` drop out.
    """
    spine = join_lookup(history, offers, "offer")
    if "repeater" in spine.columns:
        spine = spine.withColumn("repeater", recode_label("repeater"))
        spine = spine.withColumnRenamed("repeater", "label")
    return spine


def dept_last_days(transactions: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """The last day each category was sold under each dept; tables of this kind can be added up.

    The aggregate has only dates in its buffer, so it stays a hash aggregate and
    shrinks the table before the shuffle.
    """
    known = transactions.where("category is not null and dept is not null")
    if categories is not None:
        wanted = categories.select("category").distinct()
        known = join_lookup(known, wanted, "category", "left_semi")
    return known.groupBy("category", "dept").agg(F.max("date").alias("last"))


def latest_dept(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("category").agg(F.max_by("dept", F.struct("last", "dept")).alias("dept"))


def dept_last_places(transactions: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """The last place each category was sold under each dept, by file and split.

    ``transactions`` is read straight from files.  Rows of a split are numbered in
    their order, whatever other splits its task reads.
    """
    placed = transactions.where("category is not null and dept is not null").select(
        "category",
        "dept",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    if categories is not None:
        wanted = categories.select("category").distinct()
        placed = join_lookup(placed, wanted, "category", "left_semi")
    return placed.groupBy("category", "dept", "file", "start").agg(F.max("row").alias("row"))


def category_dept_map(
    transactions: DataFrame, categories: DataFrame | None = None, order: str = "date"
) -> DataFrame:
    """One dept per category: that of its latest purchase, ties to the larger.

    Rows without a category or a dept say nothing.  With ``categories``, a
    table of keys, only those are mapped.  With ``order="file"`` it is the dept of
    the category's last line instead, files in order of their paths.
    """
    if order == "date":
        return latest_dept(dept_last_days(transactions, categories))
    if order != "file":
        raise ValueError(f"order is date or file, not {order}")
    places = dept_last_places(transactions, categories)
    last = F.max_by("dept", F.struct("file", "start", "row"))
    return places.groupBy("category").agg(last.alias("dept"))


def category_dept_conflicts(transactions: DataFrame) -> DataFrame:
    """Categories sold under more than one dept."""
    pairs = transactions.where("dept is not null").select("category", "dept").distinct()
    return pairs.groupBy("category").agg(F.count("*").alias("depts")).where("depts > 1")


def with_dept(spine: DataFrame, dept_map: DataFrame, strict: bool = False) -> DataFrame:
    """Add the dept of each shopper's offered category.

    The map is read several times, so pass a table rather than a query.
    Shoppers whose category is not in the map drop out, or with ``strict``
    raise a KeyError.
    """
    small = fits_broadcast(dept_map)
    if strict:
        known = dept_map.select("category")
        missing = join_lookup(spine, known, "category", "left_anti", small)
        names = missing.select("category").distinct().limit(10).collect()
        if names:
            raise KeyError(f"categories without a dept, among them {[r[0] for r in names]}")
    return join_lookup(spine, dept_map, "category", small=small)


def duplicate_ids(history: DataFrame) -> DataFrame:
    """Shoppers with more than one row; the features need there to be none."""
    return history.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1")


def require_unique_ids(history: DataFrame) -> None:
    repeated = duplicate_ids(history).select("id").limit(10).collect()
    if repeated:
        raise ValueError(f"shoppers with several offers, among them {[r[0] for r in repeated]}")
