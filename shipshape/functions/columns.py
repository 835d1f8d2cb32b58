"""Small Column helpers shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp0(x) -> Column:
    """Negative -> 0, NULL stays NULL (``greatest`` would turn NULL into 0)."""
    x = _c(x)
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def flag01(cond: Column) -> Column:
    """Boolean condition -> 1.0 / 0.0; a NULL condition counts as 0.0."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def yes_no_to_double(x) -> Column:
    """'Yes' -> 1.0, anything else (including NULL) -> 0.0."""
    return flag01(_c(x) == "Yes")


def double_to_yes_no(x) -> Column:
    return F.when(_c(x) == 1.0, F.lit("Yes")).otherwise(F.lit("No"))


def presence(x) -> Column:
    """1.0 where a left join found a partner (the column is not NULL), else 0.0."""
    return F.when(_c(x).isNull(), F.lit(0.0)).otherwise(F.lit(1.0))


def order_key(date1="order_date", no="order_no", date2="settlement_date", cust="customer_code") -> Column:
    """date-order-date-customer text key; NULL if any part is NULL (``concat``)."""
    dash = F.lit("-")
    return F.concat(_c(date1).cast("string"), dash, _c(no), dash, _c(date2).cast("string"), dash, _c(cust))


def order_key3(date1="order_date", no="order_no", cust="customer_code") -> Column:
    """date-order-customer text key of the free-good list."""
    dash = F.lit("-")
    return F.concat(_c(date1).cast("string"), dash, _c(no), dash, _c(cust))


def to_double(x) -> Column:
    """Text -> double; unparsable text -> NULL (ANSI ``cast`` would raise)."""
    return _c(x).try_cast("double")


def to_date_fmt(x, fmt: str) -> Column:
    """Text -> date by pattern; unparsable text -> NULL.

    A two-digit year ('yy') is read the way the legacy parser the reference
    switches to reads it: within 80 years before and 20 years after today
    (Spark's own parser maps 'yy' to 2000-2099)."""
    d = F.try_to_date(_c(x), fmt)
    if "yy" in fmt and "yyyy" not in fmt:
        d = F.when(F.year(d) > F.year(F.current_date()) + 20, F.add_months(d, -1200)).otherwise(d)
    return d
