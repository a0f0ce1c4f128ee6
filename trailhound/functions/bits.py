"""A set of texts as a bit map of fixed size: what it does not hold is certainly not in the set."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slot(value: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(slots)).cast("int")


def bit_map(values: DataFrame, column: str, slots: int) -> Column:
    """The column's values as a literal array of ``slots / 64`` numbers: at most so many rows come to the driver, whatever the set."""
    at = slot(F.col(column), slots)
    words = values.select(F.shiftright(at, 6).alias("word"), at.bitwiseAND(F.lit(63)).alias("bit")).distinct().groupBy("word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    bits = [0] * (slots >> 6)
    for r in words.collect():
        bits[r["word"]] = r["bits"]
    return F.from_json(F.lit(json.dumps(bits)), "array<bigint>")  # folded to a literal when the plan is made


def may_hold(bits: Column, value: Column, slots: int) -> Column:
    """Whether a value may be in the set; a plain expression, so it runs in the scan stage. Null is never in it."""
    at = slot(value, slots)
    word = F.get(bits, F.shiftright(at, 6))
    return F.call_function("shiftright", word, at.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1
