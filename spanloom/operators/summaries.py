"""Small rows in place of spans: parts of traces, and sketches per day, project and model.

Both add up: a trace is the sum of its parts, a percentile comes from merged sketches. So
they are made once for a commit of the lake and put together when asked.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.genai import is_llm_request, with_request_columns
from .analytics import _ratio, _wide_sum
from .filters import is_error

#: Folders by hash of the trace id, so that one trace is looked for in one of them.
BUCKETS = 16
#: Accuracy of the sketches: KLL with k 200 has a rank error of about 1.7 % (at 99 % confidence), HLL with 2**12 registers about 1.6 %.
KLL_K, HLL_LOG_K = 200, 12
RANK_ERROR, DISTINCT_ERROR = 0.0165, 0.05


def bucket_of(trace_id):
    return F.pmod(F.xxhash64(trace_id), F.lit(BUCKETS)).cast("int")


def trace_parts(spans: DataFrame) -> DataFrame:
    """One row per trace, project, service, commit and day of spans that have commit and start_date."""
    return spans.groupBy("trace_id", "project_id", "service_name", "commit", "start_date").agg(
        F.min("start_time_unix_nano").alias("first_start"),
        F.max("end_time_unix_nano").alias("last_end"),
        F.sum("duration_ns").alias("duration_ns"),
        F.count(F.lit(1)).alias("span_count"),
        F.count_if(is_error()).alias("error_count"),
    ).withColumn("bucket", bucket_of("trace_id"))


def summaries_of_parts(parts: DataFrame) -> DataFrame:
    """One row per trace, as trace_summaries of its spans."""
    return parts.groupBy("trace_id").agg(
        F.min("first_start").alias("start_time_unix_nano"),
        F.max("last_end").alias("end_time_unix_nano"),
        (F.max("last_end") - F.min("first_start")).alias("wall_clock_duration_ns"),
        F.sum("duration_ns").alias("aggregate_span_duration_ns"),
        F.sum("span_count").alias("span_count"),
        F.max("service_name").alias("service_name"),
        F.sort_array(F.array_remove(F.collect_set("service_name"), "")).alias("services"),
        F.max("project_id").alias("project_id"),
        F.sum("error_count").alias("error_count"),
    )


def sketch_parts(spans: DataFrame) -> DataFrame:
    """One row per commit, day, project and model (null: spans without one), with sketches of latencies and trace ids."""
    rows = with_request_columns(spans)
    return rows.groupBy("commit", "start_date", "project_id", "model").agg(
        F.count(F.lit(1)).alias("span_count"),
        F.count_if(is_llm_request(F.col("model"), F.col("system"), F.col("name"))).alias("llm_count"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        _wide_sum("duration_ns").alias("duration_ns"),
        F.count_if(is_error()).alias("error_count"),
        F.kll_sketch_agg_bigint("duration_ns", F.lit(KLL_K)).alias("latencies"),
        F.hll_sketch_agg("trace_id", F.lit(HLL_LOG_K)).alias("traces"),
    )


def models_of_sketches(parts: DataFrame) -> DataFrame:
    """The columns of model_analytics from sketch parts; the percentile is that of the merged sketch."""
    whole = parts.where("model IS NOT NULL").groupBy("model").agg(
        F.sum("span_count").alias("request_count"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("total_output_tokens"),
        F.sum("duration_ns").cast("double").alias("_duration_ns"),
        F.sum("error_count").alias("error_count"),
        F.kll_merge_agg_bigint("latencies").alias("_latencies"),
    )
    seconds = F.col("_duration_ns") / F.lit(1e9)
    return whole.select(
        "model", "request_count", "total_input_tokens", "total_output_tokens",
        (F.col("total_input_tokens") + F.col("total_output_tokens")).alias("total_tokens"),
        F.when(seconds > 0, F.col("total_output_tokens") / seconds).otherwise(0.0).alias("tokens_per_sec"),
        (F.col("_duration_ns") / F.col("request_count") / F.lit(1e6)).alias("avg_latency_ms"),
        (F.kll_sketch_get_quantile_bigint("_latencies", F.lit(0.95)) / F.lit(1e6)).alias("p95_latency_ms"),
        "error_count", _ratio(F.col("error_count"), F.col("request_count")).alias("error_rate"),
    ).orderBy(F.desc("request_count"), "model")


def totals_of_sketches(parts: DataFrame) -> DataFrame:
    """One row: spans, errors, about how many distinct traces, and latency percentiles of the merged sketches; zeros without parts."""
    whole = parts.agg(
        F.coalesce(F.sum("span_count"), F.lit(0)).alias("span_count"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("error_count"),
        F.hll_sketch_estimate(F.hll_union_agg("traces")).alias("_traces"),
        F.kll_merge_agg_bigint("latencies").alias("_latencies"),
    )
    at = lambda p: F.when(F.col("span_count") > 0, F.kll_sketch_get_quantile_bigint("_latencies", F.lit(p)))
    return whole.select(
        "span_count", "error_count", F.when(F.col("span_count") > 0, F.col("_traces")).otherwise(0).alias("distinct_traces"),
        at(0.5).alias("p50_ns"), at(0.95).alias("p95_ns"), at(0.99).alias("p99_ns"),
    )
