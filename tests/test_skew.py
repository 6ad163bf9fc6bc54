"""Very large keys: adaptive execution must be able to split them."""

import pytest
from pyspark.sql import functions as F

from exports import spans_frame
from spanloom.operators.timeline import waterfall
from spanloom.operators.tree import orphan_spans, parent_child, root_spans

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def tight(spark):
    before = {k: spark.conf.get(k) for k in SETTINGS if k != "spark.sql.adaptive.autoBroadcastJoinThreshold"}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield spark
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key, value in before.items():
        spark.conf.set(key, value)


def hot_trace(spark):
    """One star-shaped trace with half of all spans, and many small ones."""
    template = spans_frame(spark, [{"span": "x"}])
    number = F.col("id")
    hot = number % 2 == 0
    return (
        spark.range(0, 40_000, 1, 16)
        .crossJoin(template.drop("trace_id", "span_id", "parent_span_id", "start_time_unix_nano"))
        .withColumns({
            "trace_id": F.when(hot, "hot").otherwise(F.concat(F.lit("t"), (number % 4001).cast("string"))),
            "span_id": F.md5(number.cast("string")),
            "parent_span_id": F.when(hot & (number > 0), F.md5(F.lit("0"))),
            "start_time_unix_nano": number,
        })
        .drop("id")
    )


@pytest.mark.parametrize("query", [waterfall, parent_child, root_spans, orphan_spans])
def test_hot_trace_is_split(tight, query):
    frame = query(hot_trace(tight))
    rows = frame.collect()
    assert len(rows) == {"waterfall": 40_000, "parent_child": 40_000, "root_spans": 20_001, "orphan_spans": 0}[query.__name__]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan
