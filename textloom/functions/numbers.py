"""Numbers as text for publication."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The blank that does not break, and what stands for an undefined number.
BLANK, UNDEFINED = "\u00a0", "\u2013"


def number_text(n: Column) -> Column:
    """A whole number with blanks between thousands."""
    return F.coalesce(F.replace(F.format_number(n.cast("long"), 0), F.lit(","), F.lit(BLANK)), F.lit(UNDEFINED))


def percent_text(n: Column, total: Column) -> Column:
    """100 * n / total with one decimal behind a comma; `< 0,1` for what is not 0 but rounds to it; undefined without a total."""
    share = F.try_divide(n.cast("double") * 100, total.cast("double"))
    text = F.translate(F.format_number(F.bround(share, 1), 1), ",.", BLANK + ",")
    text = F.when((n > 0) & (text == "0,0"), F.lit(f"<{BLANK}0,1")).otherwise(text)
    return F.when(n.isNotNull() & (total > 0), text).otherwise(F.lit(UNDEFINED))


def percent_label(n: Column, total: Column) -> Column:
    text = percent_text(n, total)
    return F.when(text == UNDEFINED, text).otherwise(F.concat(text, F.lit(BLANK + "%")))


def share_table(rows, column: str = "n"):
    """rows with their counts as text, and their shares of the sum."""
    total = rows.agg(F.sum(column).alias("__total"))  # one row
    return rows.crossJoin(F.broadcast(total)).withColumn("share", percent_text(F.col(column), F.col("__total"))).withColumn(column,
        number_text(F.col(column))).drop("__total")
