"""Scalar expressions.  All are built-in column functions, no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_diff(offer_date: Column | str, date: Column | str) -> Column:
    """Whole days from ``date`` to ``offer_date``; negative if bought later."""
    return F.datediff(F.to_date(_col(offer_date)), F.to_date(_col(date)))


def cents(amount: Column | str) -> Column:
    """Money as whole cents, so that sums are exact and stay in one long."""
    return (_col(amount).cast("decimal(12,2)") * 100).cast("bigint")


def money(whole_cents: Column | str) -> Column:
    """Cents back to a double with two decimals; nothing becomes zero."""
    return zero_if_null(whole_cents) / F.lit(100.0)


def zero_if_null(value: Column | str) -> Column:
    return F.coalesce(_col(value), F.lit(0))


def recode_label(repeater: Column | str) -> Column:
    """'t' becomes '1', 'f' becomes '0', anything else stays as it is."""
    value = _col(repeater)
    return F.when(value == "t", "1").when(value == "f", "0").otherwise(value)


def spend_or_share(spend: Column | str, share: Column | str) -> Column:
    """The spend if it reaches the share, else the share times -100."""
    return F.when(_col(spend) >= _col(share), _col(spend)).otherwise(_col(share) * -100)
