"""Display labels against the arithmetic they stand for."""

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from spanloom.functions.labels import duration_label, kind_label, status_badge, text_preview
from spanloom.operators.exploration import chat_models


def fixed(ns, unit, digits):
    # nearest to the double quotient, larger one on an exact tie
    return Decimal(ns / unit).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)


def expected(ns):
    if ns is None:
        return "0 ms"
    if ns < 1_000:
        return f"{ns} ns"
    if ns < 1_000_000:
        return f"{fixed(ns, 1_000, 2)} µs"
    if ns < 1_000_000_000:
        return f"{fixed(ns, 1_000_000, 2)} ms"
    return f"{fixed(ns, 1_000_000_000, 3)} s"


def test_duration_label(spark):
    values = [None, 0, 999, 1000, 1005, 1015, 1025, 1125, 999_995, 999_994, 1_000_000, 1_005_000, 1_015_625_000,
              999_995_000, 999_999_999, 1_000_000_000, 59_999_500_000, 2**53 - 1, *range(1005, 60_000, 10),
              *range(1_005_000, 90_000_000, 310_000), *range(1_000_500_000, 90_000_000_000, 901_000_000)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, ns bigint")
    rows = frame.select("i", duration_label(F.col("ns")).alias("label")).collect()
    wrong = [(values[r.i], r.label, expected(values[r.i])) for r in rows if r.label != expected(values[r.i])]
    assert wrong == []


def test_small_labels(spark):
    row = spark.range(1).select(
        *[kind_label(F.lit(k)).alias(f"k{k}") for k in range(7)],
        kind_label(F.lit(None).cast("int")).alias("none"),
        status_badge(F.lit(3)).alias("bad"),
        status_badge(F.lit(0)).alias("good"),
        text_preview(F.lit("")).alias("empty"),
        text_preview(F.lit("x" * 100)).alias("fits"),
        text_preview(F.lit("y" * 101)).alias("long"),
    ).collect()[0]
    assert list(row)[:7] == ["UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER", "UNSPECIFIED"]
    assert (row.none, row.bad, row.good) == ("UNSPECIFIED", "3 ERR", "OK")
    assert (row.empty, row.fits, row.long) == ("(empty response)", "x" * 100, "y" * 97 + "...")


def test_chat_models(spark):
    names = ["bge-chat", "nomic-embed", "E5-large", "zeta", "Chatty", "alpha", "my-embedding"]
    frame = spark.createDataFrame([(n,) for n in names], "model string")
    assert [r.model for r in chat_models(frame).collect()] == ["Chatty", "bge-chat", "alpha", "zeta"]
    assert [r.model for r in chat_models(frame, "CHAT").collect()] == ["Chatty", "bge-chat"]
