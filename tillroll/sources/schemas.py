"""Declared schemas; nothing is inferred.

Key columns may be integers or text, depending on the data set, so their
types are parameters.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

ITEMS = ("category", "company", "brand")


def offers_schema(category: str = "int", company: str = "bigint", brand: str = "int") -> StructType:
    return StructType.fromDDL(
        f"offer bigint, category {category}, quantity int, company {company}, "
        f"offervalue decimal(6,2), brand {brand}"
    )


def transactions_schema(
    dept: str = "int", category: str = "int", company: str = "bigint", brand: str = "int"
) -> StructType:
    return StructType.fromDDL(
        f"id bigint, chain int, dept {dept}, category {category}, company {company}, "
        f"brand {brand}, date date, productsize double, productmeasure string, "
        "purchasequantity int, purchaseamount decimal(12,2)"
    )


def train_history_schema() -> StructType:
    return StructType.fromDDL(
        "id bigint, chain int, offer bigint, market int, repeattrips int, "
        "repeater string, offerdate date"
    )


def test_history_schema() -> StructType:
    return StructType.fromDDL("id bigint, chain int, offer bigint, market int, offerdate date")
