"""Display labels of the trace screens."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the span kinds, by code.
KIND_NAMES = {1: "INTERNAL", 2: "SERVER", 3: "CLIENT", 4: "PRODUCER", 5: "CONSUMER"}


def kind_label(kind: Column) -> Column:
    label = F
    for code, name in KIND_NAMES.items():
        label = label.when(kind == code, name)
    return label.otherwise("UNSPECIFIED")


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _above_quotient(ns: Column, unit: int) -> Column:
    """True when the double ns/unit is not below the exact quotient.

    The product quotient*unit is taken in two exact halves, so the sign of
    the difference is exact.
    """
    q = ns.cast("double") / F.lit(float(unit))
    big = q * F.lit(134217729.0)
    high = big - (big - q)
    low = q - high
    return (high * F.lit(float(unit)) - ns.cast("double")) + low * F.lit(float(unit)) >= 0


def _fixed_point(ns: Column, unit: int, digits: int) -> Column:
    """ns/unit with a fixed number of decimals, nearest to the double quotient."""
    step = unit // 10**digits
    rest = ns % step
    up = (rest * 2 > step) | ((rest * 2 == step) & _above_quotient(ns, unit))
    scaled = _div(ns, step) + up.cast("bigint")
    return F.concat(
        _div(scaled, 10**digits).cast("string"),
        F.lit("."),
        F.lpad((scaled % 10**digits).cast("string"), digits, "0"),
    )


def duration_label(ns: Column) -> Column:
    """Nanoseconds as text with the unit that fits; NULL reads '0 ms'."""
    return (
        F.when(ns.isNull(), "0 ms")
        .when(ns < 1_000, F.concat(ns.cast("string"), F.lit(" ns")))
        .when(ns < 1_000_000, F.concat(_fixed_point(ns, 1_000, 2), F.lit(" µs")))
        .when(ns < 1_000_000_000, F.concat(_fixed_point(ns, 1_000_000, 2), F.lit(" ms")))
        .otherwise(F.concat(_fixed_point(ns, 1_000_000_000, 3), F.lit(" s")))
    )


def status_badge(error_count: Column) -> Column:
    return F.when(error_count > 0, F.concat(error_count.cast("string"), F.lit(" ERR"))).otherwise("OK")


def text_preview(text: Column, width: int = 100) -> Column:
    """Text cut to width characters, the last three of them dots."""
    return (
        F.when(text.isNull() | (text == ""), "(empty response)")
        .when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("...")))
        .otherwise(text)
    )
