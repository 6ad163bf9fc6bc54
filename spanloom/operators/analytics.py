"""Totals per lake or project and metrics per model."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.genai import is_llm_request, with_request_columns
from .filters import is_error, scoped
from .ranks import disc_rank, values_at_ranks


def _ratio(part, whole):
    """Unrounded share as a double, 0.0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _wide_sum(column):
    """Exact sum as decimal(38,0) from two BIGINT sums. Nanoseconds of some ten
    billion one-second spans no longer fit a BIGINT."""
    giga = F.lit(10**9)
    high = F.sum(F.call_function("div", F.col(column), giga)).cast("decimal(28,0)")
    low = F.sum(F.col(column) % giga).cast("decimal(28,0)")
    return (high * F.lit(10**9).cast("decimal(10,0)") + low).cast("decimal(38,0)")


def overview(spans: DataFrame, project_id=None, approximate_traces=False) -> DataFrame:
    """One row of totals; zeros and an empty list when there are no spans.

    The totals are summed per trace first, so the exact count of traces comes
    from the same shuffle and all buffers are plain numbers. With
    approximate_traces a sketch counts the traces and nothing is shuffled by
    trace. Service names are collected on their own, from one column.
    """
    rows = with_request_columns(scoped(spans, project_id))
    sums = {
        "total_spans": F.count(F.lit(1)),
        "total_llm_requests": F.count_if(is_llm_request(F.col("model"), F.col("system"), F.col("name"))),
        "total_input_tokens": F.sum("input_tokens"),
        "total_output_tokens": F.sum("output_tokens"),
        "_errors": F.count_if(is_error()),
    }
    named = [column.alias(name) for name, column in sums.items()]
    if approximate_traces:
        totals = rows.agg(F.approx_count_distinct("trace_id").alias("total_traces"), *named)
    else:
        totals = (
            rows.groupBy("trace_id")
            .agg(*named)
            .agg(F.count(F.lit(1)).alias("total_traces"), *[F.sum(n).alias(n) for n in sums])
        )
    names = services(spans, project_id).agg(F.sort_array(F.collect_list("service_name"))).scalar()
    return totals.select("total_traces", *[F.coalesce(n, F.lit(0)).alias(n) for n in sums]).select(
        "total_traces",
        "total_spans",
        "total_llm_requests",
        "total_input_tokens",
        "total_output_tokens",
        (F.col("total_input_tokens") + F.col("total_output_tokens")).alias("total_tokens"),
        names.alias("unique_services"),
        _ratio(F.col("_errors"), F.col("total_spans")).alias("error_rate"),
    )


def services(spans: DataFrame, project_id=None) -> DataFrame:
    """Distinct service names."""
    return (
        scoped(spans, project_id)
        .where(F.col("service_name").isNotNull() & (F.col("service_name") != ""))
        .select("service_name")
        .distinct()
    )


def llm_requests(spans: DataFrame) -> DataFrame:
    """Spans that count as model requests, with the attributes that decide it."""
    return (
        with_request_columns(spans)
        .where(is_llm_request(F.col("model"), F.col("system"), F.col("name")))
        .select("trace_id", "span_id", "name", "model", "system")
    )


def status_counts(spans: DataFrame) -> DataFrame:
    """Spans and error spans per status code; only one code is an error."""
    return spans.groupBy("status_code").agg(
        F.count(F.lit(1)).alias("span_count"),
        F.sum(F.when(is_error(), 1).otherwise(0)).alias("error_count"),
    )


def model_spans(spans: DataFrame, project_id=None) -> DataFrame:
    """Spans that name a request model; an empty model name counts as one."""
    return with_request_columns(scoped(spans, project_id)).where(F.col("model").isNotNull())


def model_p95(spans: DataFrame, project_id=None, exact=False) -> DataFrame:
    """95th percentile of the latency per model, by sketch or exactly."""
    rows = model_spans(spans, project_id)
    if exact:
        return values_at_ranks(rows, ["model"], "duration_ns", {"p95_latency_ns": disc_rank(0.95)}).select(
            "model", "p95_latency_ns"
        )
    return rows.groupBy("model").agg(
        F.percentile_approx("duration_ns", 0.95, 10_000).alias("p95_latency_ns")
    )


def model_analytics(spans: DataFrame, project_id=None, exact_p95=False) -> DataFrame:
    """Requests, tokens, latency and errors per model, busiest first.

    The percentile comes from a mergeable sketch inside the same aggregation;
    exact_p95 replaces it by the exact value at the price of a second pass.
    Ratios and times are not rounded: display code rounds.
    """
    rows = model_spans(spans, project_id)
    metrics = [
        F.count(F.lit(1)).alias("request_count"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("total_output_tokens"),
        _wide_sum("duration_ns").cast("double").alias("_duration_ns"),
        F.count_if(is_error()).alias("error_count"),
    ]
    if exact_p95:
        p95 = model_p95(spans, project_id, exact=True).withColumnRenamed("model", "_model")
        grouped = (
            rows.groupBy("model").agg(*metrics).join(p95, F.col("model") == F.col("_model"))
        )
    else:
        sketch = F.percentile_approx("duration_ns", 0.95, 10_000).alias("p95_latency_ns")
        grouped = rows.groupBy("model").agg(*metrics, sketch)
    seconds = F.col("_duration_ns") / F.lit(1e9)
    return grouped.select(
        "model",
        "request_count",
        "total_input_tokens",
        "total_output_tokens",
        (F.col("total_input_tokens") + F.col("total_output_tokens")).alias("total_tokens"),
        F.when(seconds > 0, F.col("total_output_tokens") / seconds).otherwise(0.0).alias("tokens_per_sec"),
        (F.col("_duration_ns") / F.col("request_count") / F.lit(1e6)).alias("avg_latency_ms"),
        (F.col("p95_latency_ns") / F.lit(1e6)).alias("p95_latency_ms"),
        "error_count",
        _ratio(F.col("error_count"), F.col("request_count")).alias("error_rate"),
    ).orderBy(F.desc("request_count"), "model")


def latency_percentiles(spans: DataFrame) -> DataFrame:
    """Median and tail latency over all spans.

    The median averages the two middle values of an even count; p95 and p99 are
    the values at 0-based position floor(n * p) of the sorted list.
    """
    at = lambda p: lambda n: F.floor(n * F.lit(p)) + 1
    one_key = spans.select(F.lit(0).alias("_all"), "duration_ns")
    found = values_at_ranks(
        one_key,
        ["_all"],
        "duration_ns",
        {
            "_low": lambda n: F.floor((n + 1) / F.lit(2)),
            "_high": lambda n: F.floor(n / F.lit(2)) + 1,
            "p95_ns": at(0.95),
            "p99_ns": at(0.99),
        },
        one_key=True,
    )
    return found.select(
        F.col("n").alias("span_count"),
        ((F.col("_low") + F.col("_high")) / F.lit(2.0)).alias("p50_ns"),
        "p95_ns",
        "p99_ns",
    )


def throughput(spans: DataFrame) -> DataFrame:
    """Requests (traces) and spans per second of the covered wall time."""
    per_trace = spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("_spans"),
        F.min("start_time_unix_nano").alias("_start"),
        F.max("end_time_unix_nano").alias("_end"),
    )
    return per_trace.agg(
        F.count(F.lit(1)).alias("request_count"),
        F.coalesce(F.sum("_spans"), F.lit(0)).alias("span_count"),
        (F.max("_end") - F.min("_start")).alias("wall_ns"),
    ).select(
        "request_count",
        "span_count",
        "wall_ns",
        F.try_divide(F.col("request_count"), F.col("wall_ns") / F.lit(1e9)).alias("requests_per_sec"),
        F.try_divide(F.col("span_count"), F.col("wall_ns") / F.lit(1e9)).alias("spans_per_sec"),
    )
