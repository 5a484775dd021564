"""KPI values as text, and repair of money text that was given too large a unit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyhouse.functions.money import dbl

# Units, largest first, and the pattern of an amount below one unit.
UNITS = ((1e9, "B"), (1e6, "M"), (1e3, "K"))
TOO_LARGE_UNIT = r"\$0\.\d+[BMK]\b"


def fixed(value: Column, digits: int) -> Column:
    """Decimal text with a fixed number of digits, rounded half up."""
    return F.round(value.cast("decimal(38,8)"), digits).cast(f"decimal(38,{digits})").cast("string")


def money_text(value: Column) -> Column:
    """``$1.23B``, ``$4.56M``, ``$7.89K`` or ``$12``."""
    v = dbl(value)
    out = None
    for size, unit in UNITS:
        text = F.concat(F.lit("$"), fixed(v / F.lit(size), 2), F.lit(unit))
        out = F.when(F.abs(v) >= size, text) if out is None else out.when(F.abs(v) >= size, text)
    return out.otherwise(F.concat(F.lit("$"), fixed(v, 0)))


def percent_text(value: Column) -> Column:
    return F.concat(fixed(dbl(value), 2), F.lit("%"))


def days_text(value: Column) -> Column:
    return F.concat(fixed(dbl(value), 1), F.lit(" days"))


def count_text(value: Column, noun: str) -> Column:
    return F.concat(F.format_number(value, 0), F.lit(f" {noun}"))


def _one_unit_down(token: Column) -> Column:
    amount = F.regexp_extract(token, r"(0\.\d+)", 1).cast("decimal(38,12)") * F.lit(1000)
    unit = F.substring(token, -1, 1)
    return (F.when(unit == "B", F.concat(F.lit("$"), F.round(amount, 2).cast("decimal(38,2)").cast("string"), F.lit("M")))
            .when(unit == "M", F.concat(F.lit("$"), F.round(amount, 2).cast("decimal(38,2)").cast("string"), F.lit("K")))
            .otherwise(F.concat(F.lit("$"), F.round(amount, 0).cast("decimal(38,0)").cast("string"))))


def shift_units(text: Column) -> Column:
    """Rewrite every ``$0.73B`` as ``$730.00M`` (and M to K, K to dollars) anywhere in a text."""
    between = F.split(text, TOO_LARGE_UNIT)
    tokens = F.transform(F.regexp_extract_all(text, F.lit(f"({TOO_LARGE_UNIT})"), F.lit(1)), _one_unit_down)
    return F.array_join(F.zip_with(between, tokens, lambda b, t: F.concat(b, F.coalesce(t, F.lit("")))), "")
