"""Attributes, events and links of single spans, and lists of model names."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import as_bigint, attribute_map, events_array, first_text, json_fields, json_key, links_array
from ..functions.genai import DISPLAY_KEYS, display_columns
from ..functions.labels import duration_label, kind_label, text_preview

# Parts of names that mark an embedding model.
EMBEDDING_MARKS = ["embedding", "embed", "nomic", "bge", "e5"]


def attributes_map(spans: DataFrame) -> DataFrame:
    return spans.select("trace_id", "span_id", attribute_map("attributes_json").alias("attributes"))


def attributes_exploded(spans: DataFrame) -> DataFrame:
    """One row per attribute."""
    return spans.select("trace_id", "span_id", F.explode(attribute_map("attributes_json")).alias("key", "value"))


def attribute_counts(spans: DataFrame) -> DataFrame:
    """Number of span and resource attributes per span."""
    return spans.select(
        "trace_id",
        "span_id",
        F.size(attribute_map("attributes_json")).cast("bigint").alias("attribute_count"),
        F.size(attribute_map("resource_attributes_json")).cast("bigint").alias("resource_attribute_count"),
    )


def genai_attributes(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The raw text of chosen attributes, one column per key with dots as underscores."""
    parsed = spans.select("trace_id", "span_id", json_fields("attributes_json", keys).alias("_a"))
    return parsed.select(
        "trace_id", "span_id", *[F.col("_a").getField(k).alias(k.replace(".", "_")) for k in keys]
    )


def genai_info(spans: DataFrame) -> DataFrame:
    """Model, system, tokens, temperature and finish reason of each span."""
    parsed = spans.select("trace_id", "span_id", json_fields("attributes_json", DISPLAY_KEYS).alias("_a"))
    return parsed.select(
        "trace_id", "span_id", *[c.alias(n) for n, c in display_columns(F.col("_a")).items()]
    )


def token_cast(spans: DataFrame, key: str) -> DataFrame:
    """Text of a token attribute beside its tolerant integer reading."""
    text = json_key("attributes_json", key)
    return spans.select("trace_id", "span_id", text.alias("token_text")).withColumn(
        "tokens", as_bigint(F.col("token_text"))
    )


def span_events(spans: DataFrame) -> DataFrame:
    """Span events as rows."""
    return spans.select("trace_id", "span_id", F.explode(events_array("events_json")).alias("_e")).select(
        "trace_id",
        "span_id",
        F.col("_e.name").alias("event_name"),
        F.col("_e.time_unix_nano").alias("time_unix_nano"),
        F.col("_e.attributes").alias("attributes_json"),
        F.col("_e.dropped_attributes_count").alias("dropped_attributes_count"),
    )


def span_links(spans: DataFrame) -> DataFrame:
    """Links to other spans as rows."""
    return spans.select("trace_id", "span_id", F.explode(links_array("links_json")).alias("_l")).select(
        "trace_id",
        "span_id",
        F.col("_l.trace_id").alias("linked_trace_id"),
        F.col("_l.span_id").alias("linked_span_id"),
        F.col("_l.trace_state").alias("trace_state"),
        F.col("_l.attributes").alias("attributes_json"),
        F.col("_l.dropped_attributes_count").alias("dropped_attributes_count"),
        F.col("_l.flags").alias("flags"),
    )


def project_resolution(spans: DataFrame, project_keys=("project.id",)) -> DataFrame:
    """Project of each span: its own attributes first, then those of its resource."""
    own = json_fields("attributes_json", project_keys)
    shared = json_fields("resource_attributes_json", project_keys)
    return spans.select("trace_id", "span_id", own.alias("_own"), shared.alias("_shared")).select(
        "trace_id",
        "span_id",
        first_text(*[F.col(side).getField(k) for side in ("_own", "_shared") for k in project_keys]).alias(
            "project_id"
        ),
    )


def span_labels(spans: DataFrame) -> DataFrame:
    """Kind name, duration text and short id of each span."""
    return spans.select(
        "trace_id",
        "span_id",
        F.substring("span_id", 1, 8).alias("short_id"),
        F.coalesce(first_text(F.col("service_name")), F.lit("unknown")).alias("service_label"),
        kind_label(F.col("kind")).alias("kind_label"),
        duration_label(F.col("duration_ns")).alias("duration_label"),
    )


def text_previews(texts: DataFrame, column: str, width: int = 100) -> DataFrame:
    return texts.withColumn("preview", text_preview(F.col(column), width))


def chat_models(models: DataFrame, contains: str | None = None) -> DataFrame:
    """Models that can chat, those named so first.

    A name with 'chat' in it is a chat model; otherwise a mark of an embedding
    model rules it out. contains keeps names with that text, in any case.
    """
    name = F.lower("model")
    is_chat = F.when(name.contains("chat"), True).otherwise(~name.rlike("|".join(EMBEDDING_MARKS)))
    kept = models.where(is_chat)
    if contains:
        kept = kept.where(name.contains(contains.lower()))
    return kept.orderBy(F.when(name.contains("chat"), 0).otherwise(1), "model")
