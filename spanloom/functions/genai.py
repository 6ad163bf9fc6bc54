"""Generative-AI attributes of a span."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .attributes import as_bigint, first_text, json_fields, non_empty

# Attribute keys in the order in which they are tried.
MODEL_KEYS = ["gen_ai.request.model", "gen_ai.response.model", "llm.model", "model"]
SYSTEM_KEYS = ["gen_ai.system", "llm.system"]
PROMPT_TOKEN_KEYS = [
    "gen_ai.usage.prompt_tokens",
    "gen_ai.usage.input_tokens",
    "llm.usage.prompt_tokens",
]
COMPLETION_TOKEN_KEYS = [
    "gen_ai.usage.completion_tokens",
    "gen_ai.usage.output_tokens",
    "llm.usage.completion_tokens",
]
TOTAL_TOKEN_KEYS = ["gen_ai.usage.total_tokens", "llm.usage.total_tokens"]
TEMPERATURE_KEYS = ["gen_ai.request.temperature", "llm.temperature"]
FINISH_KEYS = ["gen_ai.response.finish_reasons", "llm.finish_reason"]
PROMPT_KEYS = ["gen_ai.prompt", "llm.prompt"]

DISPLAY_KEYS = (
    MODEL_KEYS + SYSTEM_KEYS + PROMPT_TOKEN_KEYS + COMPLETION_TOKEN_KEYS
    + TOTAL_TOKEN_KEYS + TEMPERATURE_KEYS + FINISH_KEYS + PROMPT_KEYS
)

# The keys the aggregate analytics count. They are fewer than the
# keys of the single-span display on purpose; both definitions exist side by side.
REQUEST_MODEL = "gen_ai.request.model"
REQUEST_SYSTEM = "gen_ai.system"
INPUT_TOKENS = "gen_ai.usage.input_tokens"
OUTPUT_TOKENS = "gen_ai.usage.output_tokens"


def request_columns(attributes: Column | str = "attributes_json") -> Column:
    """Struct(model, system, input_tokens, output_tokens) for the analytics; one parse."""
    return json_fields(attributes, [REQUEST_MODEL, REQUEST_SYSTEM, INPUT_TOKENS, OUTPUT_TOKENS])


# Columns in which the lake keeps the request values beside the JSON they come from.
PROMOTED = {
    "model": "gen_ai_model",
    "system": "gen_ai_system",
    "input_tokens": "gen_ai_input_tokens",
    "output_tokens": "gen_ai_output_tokens",
}


def with_request_columns(spans):
    """Add model, system, input_tokens and output_tokens as columns.

    Spans of the lake carry them already; then no JSON is read or parsed, and
    predicates on them reach the Parquet scan.
    """
    if set(PROMOTED.values()) <= set(spans.columns):
        return spans.withColumns({name: F.col(kept) for name, kept in PROMOTED.items()})
    return (
        spans.withColumn("_request", request_columns())
        .withColumns({
            "model": F.col("_request").getField(REQUEST_MODEL),
            "system": F.col("_request").getField(REQUEST_SYSTEM),
            "input_tokens": as_bigint(F.col("_request").getField(INPUT_TOKENS)),
            "output_tokens": as_bigint(F.col("_request").getField(OUTPUT_TOKENS)),
        })
        .drop("_request")
    )


def with_promoted(spans):
    """Add the columns that the lake keeps, unless they are there."""
    if set(PROMOTED.values()) <= set(spans.columns):
        return spans
    return with_request_columns(spans).withColumnsRenamed(PROMOTED)


def is_llm_request(model: Column, system: Column, name: Column) -> Column:
    return model.isNotNull() | system.isNotNull() | name.like("%llm%") | name.like("%generate%")


def _joined(text: Column) -> Column:
    """A JSON list reads as its items joined by commas, other text as it is."""
    return F.when(
        text.startswith("["), F.array_join(F.from_json(text, "array<string>"), ",")
    ).otherwise(text)


def display_columns(fields: Column) -> dict[str, Column]:
    """The resolved values of one span, from the struct of DISPLAY_KEYS."""

    def pick(keys):
        return [fields.getField(k) for k in keys]

    model, system = first_text(*pick(MODEL_KEYS)), first_text(*pick(SYSTEM_KEYS))
    prompt = F.coalesce(*pick(PROMPT_TOKEN_KEYS))
    completion = F.coalesce(*pick(COMPLETION_TOKEN_KEYS))
    prompt_n, completion_n = prompt.try_cast("double"), completion.try_cast("double")
    total = F.coalesce(*pick(TOTAL_TOKEN_KEYS))
    return {
        "is_gen_ai": (
            model.isNotNull()
            | system.isNotNull()
            | prompt.isNotNull()
            | first_text(*pick(PROMPT_KEYS)).isNotNull()
        ),
        "model": model,
        "system": system,
        "prompt_tokens": prompt_n,
        "completion_tokens": completion_n,
        "total_tokens": F.when(total.isNotNull(), total.try_cast("double")).otherwise(
            prompt_n + completion_n
        ),
        "temperature": F.coalesce(*pick(TEMPERATURE_KEYS)).try_cast("double"),
        "finish_reason": non_empty(_joined(F.coalesce(*pick(FINISH_KEYS)))),
    }
