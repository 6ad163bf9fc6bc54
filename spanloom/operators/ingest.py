"""Validation of raw trace exports before they are accepted."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# What the ingest endpoint speaks.
TRACES_PATH, HEALTH_PATH = "/v1/traces", "/healthz"
PROTOBUF = "application/x-protobuf"
MAX_BODY_BYTES = 4 * 1024 * 1024


def _authorized(token: str) -> Column:
    given = F.col("authorization")
    return F.coalesce(given.isin(f"Bearer {token}", token), F.lit(False)) | F.coalesce(
        F.col("api_key") == F.lit(token), F.lit(False)
    )


def ingest_validate(
    exports: DataFrame, auth_token: str | None = None, max_body_bytes: int = MAX_BODY_BYTES
) -> DataFrame:
    """Add outcome: 'accepted', 'health', or why the request is turned away.

    exports has method, path, content_type, body_size and decodable, and with
    auth_token also authorization and api_key. The checks run in this order, and
    the first that fails decides. An empty body is turned away: as a log record
    of length zero it would make the rest of its segment unreadable.
    """
    media = F.coalesce(F.substring_index("content_type", ";", 1), F.lit(""))
    outcome = F.when(F.col("body_size") > max_body_bytes, "too large").when(
        (F.col("method") == "GET") & (F.col("path") == HEALTH_PATH), "health"
    )
    outcome = outcome.when((F.col("method") != "POST") | (F.col("path") != TRACES_PATH), "not found")
    if auth_token:
        outcome = outcome.when(~_authorized(auth_token), "unauthorized")
    outcome = (
        outcome.when(media != PROTOBUF, "unsupported media type")
        .when(F.col("body_size") == 0, "empty body")
        .when(~F.col("decodable"), "malformed export")
        .otherwise("accepted")
    )
    return exports.withColumn("outcome", outcome)


def _counters() -> list[Column]:
    accepted = F.col("outcome") == "accepted"
    total = lambda column: F.coalesce(F.sum(F.when(accepted, F.col(column))), F.lit(0))
    return [
        F.count_if(accepted).alias("accepted_requests"),
        total("n_resource_spans").alias("accepted_resource_spans"),
        total("n_spans").alias("accepted_spans"),
        F.count_if(~F.col("outcome").isin("accepted", "health")).alias("rejected_requests"),
    ]


def ingest_stats(validated: DataFrame) -> DataFrame:
    """Counters over validated exports."""
    return validated.agg(*_counters())


def watch_ingest(validated: DataFrame, observation: Observation | str) -> DataFrame:
    """The same counters on the side of whatever the exports are used for. A
    name instead of an observation reports them with the progress of a stream."""
    return validated.observe(observation, *_counters())
