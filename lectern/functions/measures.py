"""Measured values: sentences, numbers with units, conversion, review, display."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed
from .text import any_of, strip


def unit_table(spark: SparkSession) -> DataFrame:
    """(token, place, kind, factor, offset, unit_si): the units that are known, in order."""
    rows = [(t, k, kind, factor, offset, fixed.CANONICAL_UNITS[kind]) for k, (t, (kind, factor, offset)) in enumerate(fixed.UNITS.items())]
    return spark.createDataFrame(rows, "token string, place int, kind string, factor double, offset double, unit_si string")


def _unit_map() -> Column:
    cells = [x for t, (kind, factor, offset) in fixed.UNITS.items() for x in (F.lit(t), F.struct(F.lit(kind).alias("kind"), F.lit(factor).alias("factor"), F.lit(offset).alias("offset"), F.lit(fixed.CANONICAL_UNITS[kind]).alias("unit_si")))]
    return F.create_map(*cells)


def sentences(text: Column) -> Column:
    """Sentences of 25 to 500 characters that hold a space and no markup."""
    low, high = fixed.SENTENCE_CHARS
    pieces = F.filter(F.split(text, r"(?U)(?<=[.!?])\s+|\n+"), lambda s: F.contains(s, F.lit(" ")))
    pieces = F.transform(pieces, strip)
    clean = lambda s: ~reduce(lambda a, b: a | b, [F.contains(s, F.lit(mark)) for mark in fixed.NOT_PROSE])
    return F.filter(pieces, lambda s: F.length(s).between(low, high) & clean(s))


def looks_like_unit(token: Column) -> Column:
    return (F.length(token) <= 4) & token.rlike(r"[\p{Lu}°µ/%]") & ~F.array_contains(any_of(fixed.NOT_UNITS), F.lower(token))


def extract_quantities(texts: DataFrame, text_column: str, keys: list[str]) -> DataFrame:
    """One row per number with a unit, known or plausible, of every sentence.

    Known units give value_si and status "auto"; unit-shaped strangers, and a bare degree
    sign beside a Celsius or Fahrenheit reading, wait as "pending_llm".
    """
    pattern = F.lit("(?U)" + fixed.QUANTITY_PATTERN)
    rows = texts.select(*keys, F.explode(sentences(F.col(text_column))).alias("sentence")).where(F.col("sentence").rlike(r"\d"))
    groups = [F.regexp_extract_all("sentence", pattern, F.lit(k)) for k in (1, 2, 3)]
    rows = rows.select(*keys, "sentence", F.explode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("number", "tail", "token"), strict=True)])).alias("m"))
    rows = rows.select(*keys, "sentence", *[F.col("m").getField(n).alias(n) for n in ("number", "tail", "token")])
    rows = rows.where(~F.col("token").isin(*fixed.NEVER_UNITS))
    rows = rows.withColumn("unit", F.try_element_at(_unit_map(), F.col("token")))
    doubtful = (F.col("token") == "°") & F.col("sentence").rlike(r"(?U)°\s?[CF]\b")
    known = F.col("unit").isNotNull() & ~doubtful
    rows = rows.where(known | doubtful | looks_like_unit(F.col("token")))
    value = F.col("number").cast("double")
    return rows.select(
        *keys,
        F.when(known, F.col("unit.kind")).otherwise("unknown").alias("quantity_kind"),
        F.when(known, value * F.col("unit.factor") + F.col("unit.offset")).alias("value_si"),
        F.when(known, F.col("unit.unit_si")).alias("unit_si"),
        strip(F.concat("number", "tail")).alias("value_original"),
        F.col("token").alias("unit_original"),
        F.col("sentence").alias("context_sentence"),
        F.when(known, F.lit(0.95)).otherwise(F.lit(0.4)).alias("confidence"),
        F.when(known, F.lit("auto")).otherwise(F.lit("pending_llm")).alias("status"),
    )


def apply_verdict(rows: DataFrame) -> DataFrame:
    """Settles pending rows from a verdict (verdict_kind, verdict_unit, confident; all null: no answer).

    Units are looked up by token; what cannot be converted goes to review.  Of values with
    a tolerance or range the part before the first "±", then "-", counts, so negative numbers go to review.
    """
    unit = F.try_element_at(_unit_map(), F.coalesce("verdict_unit", F.lit("")))
    first = F.element_at(F.split(F.element_at(F.split("value_original", "±"), 1), "-"), 1)
    value = F.when(strip(first).rlike(r"^[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"), strip(first).cast("double"))
    answered = F.col("verdict_kind").isNotNull() & F.coalesce("confident", F.lit(False))
    usable = answered & (F.col("verdict_kind") != "not_a_quantity") & ~F.col("verdict_kind").isin("fraction", "level") & (unit["kind"] == F.col("verdict_kind")) & value.isNotNull()
    usable = F.coalesce(usable, F.lit(False))
    status = F.when(F.col("verdict_kind") == "not_a_quantity", "rejected").when(usable, "auto").otherwise("pending_review")
    return rows.select(
        "*",
        status.alias("new_status"),
        F.when(usable, value * unit["factor"] + unit["offset"]).alias("new_value_si"),
        F.when(usable, unit["unit_si"]).alias("new_unit_si"),
        F.when(usable, F.lit(0.75)).alias("new_confidence"),
    )


def _three_digits(value: Column) -> Column:
    """Whole numbers from 100 on, else three significant digits without trailing zeros."""
    size = F.abs(value)
    places = F.when(size > 0, 2 - F.floor(F.log10(size))).otherwise(0)
    scale = F.pow(F.lit(10.0), places.cast("double"))
    small = F.round(value * scale) / scale
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.12f", small), r"0+$", ""), r"\.$", "")
    return F.when(size >= 100, F.format_string("%.0f", F.round(value))).otherwise(shown)


def display(value: Column, unit: Column, kind: Column) -> Column:
    """A value as a person would write it: scaled by its family, three digits."""
    fixed_units = {"fraction": (value * 100, " %"), "level": (value, " dB"), "temperature": (value, " K"), "velocity": (value, " m/s")}
    out = F.when(value.isNull(), F.lit("?"))
    for name, (shown, suffix) in fixed_units.items():
        out = out.when(kind == name, F.concat(_three_digits(shown), F.lit(suffix)))
    for name, scales in fixed.DISPLAY_SCALES.items():
        for k, (factor, symbol) in enumerate(scales):
            last = k == len(scales) - 1
            out = out.when((kind == name) & (F.lit(True) if last else F.abs(value) >= factor), F.concat(_three_digits(value / factor), F.lit(" " + symbol)))
    return out.otherwise(F.trim(F.concat(_three_digits(value), F.lit(" "), F.coalesce(unit, F.lit("")))))
