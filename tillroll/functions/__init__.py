from tillroll.functions.expressions import (
    cents,
    day_diff,
    money,
    recode_label,
    spend_or_share,
    zero_if_null,
)

__all__ = [
    "cents",
    "day_diff",
    "money",
    "recode_label",
    "spend_or_share",
    "zero_if_null",
]
