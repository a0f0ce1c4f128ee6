"""Look-ups in fixed tables and score bands, as expressions rather than joins."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def look_up(key: Column, mapping: dict, default=None) -> Column:
    """Value for a key in a literal map, with a default."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    found = F.try_element_at(literal, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def banded(score: Column, bands: list[tuple], field: int = 1) -> Column:
    """The text of the first band whose lower bound the score reaches; bands run from high to low."""
    result = None
    for band in bands[:-1]:
        condition, value = score >= F.lit(band[0]), F.lit(band[field])
        result = F.when(condition, value) if result is None else result.when(condition, value)
    return result.otherwise(F.lit(bands[-1][field]))


def count_where(condition: Column) -> Column:
    """Rows for which a condition holds, as bigint and 0 for no rows."""
    return F.count(F.when(condition, F.lit(1)))


#: In a table of counts: how many rows each of its rows stands for.
ROWS = "n_rows"


def rows_where(df: DataFrame, condition: Column | None = None) -> Column:
    """How many rows (for which a condition holds) a group has, where a row of a table of counts stands for ``ROWS`` of them."""
    if ROWS in df.columns:
        n = F.col(ROWS) if condition is None else F.when(condition, F.col(ROWS))
        return F.coalesce(F.sum(n), F.lit(0)).cast("bigint")
    return F.count(F.lit(1)) if condition is None else count_where(condition)
