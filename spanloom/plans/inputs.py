"""Span-shaped views over the event and conversation tables.

Each view is a pure projection: no join, window or shuffle, so filters and
column pruning reach the Parquet scan and the work grows with the tables alone.
The expressions are written once and rendered for either SQL dialect; the
checks render them for the second engine.
"""

from pyspark.sql import DataFrame, SparkSession

_SPARK = {
    "{STR}": "string",
    "{DIV}": "div",
    "{MICROS}": "unix_micros(cast(ts AS timestamp))",
}
_ANSI = {"{STR}": "varchar", "{DIV}": "//", "{MICROS}": "epoch_us(ts)"}

SPANS_PER_TRACE = 40
EVENTS_PER_SEGMENT = 2500

# Traces are runs of 40 events. By trace number they are chains, stars, binary
# trees or forests of small stars; a few spans name a lost parent or themselves.
_BLOCK = "(event_id {DIV} 40)"
_POS = "(event_id % 40)"
_PARENT_POS = (
    "CASE _BLOCK_ % 4 WHEN 0 THEN _POS_ - 1 WHEN 1 THEN 0 WHEN 2 THEN (_POS_ - 1) {DIV} 2 "
    "ELSE _POS_ - _POS_ % 10 END"
)
_SPAN_ID = "substr(md5(concat('s-', cast(_ID_ AS {STR}))), 1, 16)"
_PARENT = (
    "CASE WHEN _POS_ = 0 THEN NULL "
    "WHEN _BLOCK_ % 4 = 3 AND _POS_ % 10 = 0 THEN '' "
    "WHEN event_id % 97 = 0 THEN substr(md5(concat('lost-', cast(event_id AS {STR}))), 1, 16) "
    "WHEN event_id % 101 = 0 THEN _SELF_ "
    "ELSE _UP_ END"
)
_START = "({MICROS} * 1000)"
_DURATION = "(cast(floor(abs(value) * 1000000) AS bigint) * (1 + event_id % 3 * 50) + event_id % 1000)"
_SERVICE = (
    "CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 17 = 0 THEN '' "
    "ELSE concat('svc-', cast((user_id + event_id) % 5 AS {STR})) END"
)
_PROJECT = "CASE WHEN user_id % 13 = 0 THEN NULL ELSE concat('proj-', cast(user_id % 3 AS {STR})) END"
_MODEL = """'"model-', cast(user_id % 4 AS {STR}), '"'"""
_TOKENS_IN, _TOKENS_OUT = "cast(20 + user_id % 50 AS {STR})", "cast(10 + event_id % 300 AS {STR})"
_ATTRIBUTES = (
    "CASE WHEN event_type <> 'purchase' THEN props "
    "WHEN event_id % 7 = 5 THEN concat('{\"gen_ai.request.model\": ', " + _MODEL + ", "
    "', \"gen_ai.usage.input_tokens\": \"', " + _TOKENS_IN + ", '\", "
    "\"gen_ai.usage.output_tokens\": \"invalid_number\"}') "
    "WHEN event_id % 7 = 3 THEN concat('{\"gen_ai.response.finish_reasons\": [\"stop\", \"length\"], "
    "\"gen_ai.response.model\": ', " + _MODEL + ", "
    "', \"gen_ai.usage.completion_tokens\": ', " + _TOKENS_OUT + ", "
    "', \"gen_ai.usage.prompt_tokens\": ', " + _TOKENS_IN + ", '}') "
    "WHEN event_id % 7 = 1 THEN concat('{\"gen_ai.request.model\": ', " + _MODEL + ", "
    "', \"gen_ai.usage.input_tokens\": \"', " + _TOKENS_IN + ", '.5\", "
    "\"gen_ai.usage.output_tokens\": \"1e3\"}') "
    "ELSE concat('{\"gen_ai.request.model\": ', " + _MODEL + ", "
    "', \"gen_ai.request.temperature\": 0.7, \"gen_ai.system\": \"sys-', cast(user_id % 2 AS {STR}), "
    "'\", \"gen_ai.usage.input_tokens\": ', " + _TOKENS_IN + ", "
    "', \"gen_ai.usage.output_tokens\": ', " + _TOKENS_OUT + ", '}') END"
)
_RESOURCE = (
    "concat('{', "
    "CASE WHEN project_id IS NULL THEN '' ELSE concat('\"project.id\": \"', project_id, '\"') END, "
    "CASE WHEN project_id IS NULL OR service_name IS NULL THEN '' ELSE ', ' END, "
    "CASE WHEN service_name IS NULL THEN '' ELSE concat('\"service.name\": \"', service_name, '\"') END, "
    "'}')"
)
_EVENTS = (
    "concat('[{\"attributes\": ', props, ', \"dropped_attributes_count\": 0, \"name\": \"', event_type, "
    "'\", \"time_unix_nano\": ', cast(start_time_unix_nano + 1000 AS {STR}), '}]')"
)
_LINKS = (
    "CASE WHEN event_id % 10 = 0 AND event_id > 40 THEN concat('[{\"attributes\": {\"rel\": \"retry\"}, "
    "\"dropped_attributes_count\": 0, \"flags\": 1, \"span_id\": \"', _EARLIER_SPAN_, "
    "'\", \"trace_id\": \"', _EARLIER_TRACE_, '\", \"trace_state\": \"\"}]') ELSE '[]' END"
)
_TRACE_ID = "md5(concat('t-', cast(_ID_ AS {STR})))"


def _fill(text: str) -> str:
    own = _SPAN_ID.replace("_ID_", "event_id")
    up = _SPAN_ID.replace("_ID_", f"(event_id - _POS_ + {_PARENT_POS})")
    return (
        text.replace("_SELF_", own)
        .replace("_UP_", up)
        .replace("_EARLIER_SPAN_", _SPAN_ID.replace("_ID_", "(event_id - 40)"))
        .replace("_EARLIER_TRACE_", _TRACE_ID.replace("_ID_", "(_BLOCK_ - 1)"))
        .replace("_BLOCK_", _BLOCK)
        .replace("_POS_", _POS)
    )


# first step: columns that the second step refers to by name
_EVENT_BASE = {
    "event_id": "event_id",
    "event_type": "event_type",
    "props": "props",
    "trace_id": _TRACE_ID.replace("_ID_", "_BLOCK_"),
    "span_id": _SPAN_ID.replace("_ID_", "event_id"),
    "parent_span_id": _PARENT,
    "name": "CASE WHEN event_type = 'purchase' THEN 'llm.generate' ELSE concat('event.', event_type) END",
    "kind": "cast(user_id % 7 AS int)",
    "service_name": _SERVICE,
    "project_id": _PROJECT,
    "start_time_unix_nano": _START,
    "duration_ns": _DURATION,
    "status_code": "cast(CASE WHEN event_type = 'error' THEN 2 WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS int)",
    "status_message": "CASE WHEN event_type = 'error' THEN 'failed' END",
    "attributes_json": _ATTRIBUTES,
    "source_file": "concat('wal-', cast(1 + event_id {DIV} 2500 AS {STR}), '-0.wal')",
    "source_offset": "cast((event_id % 2500) * 100 AS bigint)",
}

_EVENT_SPAN = {
    "trace_id": "trace_id",
    "span_id": "span_id",
    "parent_span_id": "parent_span_id",
    "name": "name",
    "kind": "kind",
    "service_name": "service_name",
    "project_id": "project_id",
    "start_time_unix_nano": "start_time_unix_nano",
    "end_time_unix_nano": "start_time_unix_nano + duration_ns",
    "duration_ns": "duration_ns",
    "status_code": "status_code",
    "status_message": "status_message",
    "scope_name": "'scope'",
    "scope_version": "'1.0'",
    "trace_state": "cast(NULL AS {STR})",
    "flags": "cast(0 AS bigint)",
    "resource_attributes_json": _RESOURCE,
    "attributes_json": "attributes_json",
    "events_json": _EVENTS,
    "links_json": _LINKS,
    "dropped_attributes_count": "cast(0 AS bigint)",
    "dropped_events_count": "cast(0 AS bigint)",
    "dropped_links_count": "cast(0 AS bigint)",
    "source_file": "source_file",
    "source_offset": "source_offset",
}

# One trace per conversation: turn 0 is the root of a star.
_CHAT_MODEL = """'"model-', cast(conv_id % 4 AS {STR}), '"'"""
_CHAT_IN, _CHAT_OUT = "cast(20 + conv_id % 50 AS {STR})", "cast(length(text) AS {STR})"
_CHAT = {
    "trace_id": "md5(concat('c-', cast(conv_id AS {STR})))",
    "span_id": "substr(md5(concat('c-', cast(conv_id AS {STR}), '-', cast(turn AS {STR}))), 1, 16)",
    "parent_span_id": "CASE WHEN turn > 0 THEN substr(md5(concat('c-', cast(conv_id AS {STR}), '-0')), 1, 16) END",
    "name": "CASE WHEN role = 'assistant' THEN 'llm.generate' ELSE concat(role, '.message') END",
    "kind": "cast(CASE WHEN role = 'assistant' THEN 3 ELSE 1 END AS int)",
    "service_name": "concat('chat-', role)",
    "project_id": "concat('proj-', cast(conv_id % 3 AS {STR}))",
    "start_time_unix_nano": "(1700000000000 + conv_id * 1000000 + turn * 1000) * 1000000",
    "end_time_unix_nano": (
        "(1700000000000 + conv_id * 1000000 + turn * 1000 + cast(length(text) AS bigint)) * 1000000"
    ),
    "duration_ns": "cast(length(text) AS bigint) * 1000000",
    "status_code": "cast(CASE WHEN length(text) % 17 = 0 THEN 2 ELSE 0 END AS int)",
    "attributes_json": (
        "CASE WHEN role <> 'assistant' THEN '{}' "
        "WHEN turn % 7 = 5 THEN concat('{\"gen_ai.request.model\": ', " + _CHAT_MODEL + ", "
        "', \"gen_ai.usage.input_tokens\": \"', " + _CHAT_IN + ", '\", "
        "\"gen_ai.usage.output_tokens\": \"invalid_number\"}') "
        "WHEN turn % 7 = 3 THEN concat('{\"gen_ai.response.model\": ', " + _CHAT_MODEL + ", "
        "', \"gen_ai.usage.completion_tokens\": ', " + _CHAT_OUT + ", "
        "', \"gen_ai.usage.prompt_tokens\": ', " + _CHAT_IN + ", '}') "
        "ELSE concat('{\"gen_ai.request.model\": ', " + _CHAT_MODEL + ", "
        "', \"gen_ai.request.temperature\": 0.7, \"gen_ai.system\": \"sys-', cast(conv_id % 2 AS {STR}), "
        "'\", \"gen_ai.usage.input_tokens\": ', " + _CHAT_IN + ", "
        "', \"gen_ai.usage.output_tokens\": ', " + _CHAT_OUT + ", '}') END"
    ),
}


# Attributes of every kind, and a project named by the span, by a vendor's key of the span, or by its resource.
PROJECT_KEYS = ("project.id", "vendor.project")
_NESTED = {
    "scope_name": "concat('scope-', cast(event_id % 3 AS {STR}))",
    "project_id": (
        "CASE WHEN event_id % 4 = 0 THEN concat('own-', cast(event_id % 5 AS {STR})) "
        "WHEN event_id % 4 = 1 THEN concat('vendor-', cast(event_id % 5 AS {STR})) ELSE project_id END"
    ),
    "attributes_json": (
        "concat('{\"deep\": {\"inner\": {\"n\": ', cast(event_id AS {STR}), '}, \"list\": [1, {\"k\": \"v\"}, [true, 2.5]]}, \"none\": {}, ', "
        "CASE WHEN event_id % 4 = 0 THEN concat('\"project.id\": \"own-', cast(event_id % 5 AS {STR}), '\", ') ELSE '' END, "
        "'\"raw.id\": \"', md5(cast(event_id AS {STR})), '\", \"twice.key\": \"second\", \"unset.key\": \"\"', "
        "CASE WHEN event_id % 4 < 2 THEN concat(', \"vendor.project\": \"vendor-', cast(event_id % 5 AS {STR}), '\"') ELSE '' END, '}')"
    ),
}


def _render(columns: dict[str, str], tokens: dict[str, str]) -> list[str]:
    rendered = []
    for name, text in columns.items():
        text = _fill(text)
        for token, value in tokens.items():
            text = text.replace(token, value)
        rendered.append(f"{text} AS {name}")
    return rendered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_spans(spark: SparkSession, sf_dir: str, keep_event_id=False) -> DataFrame:
    """Spans with all columns, one per event."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    base = table(spark, sf_dir, "events").selectExpr(*_render(_EVENT_BASE, _SPARK))
    extra = ["event_id"] if keep_event_id else []
    return base.selectExpr(*_render(_EVENT_SPAN, _SPARK), *extra)


def chat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of model conversations, one per turn."""
    return table(spark, sf_dir, "conversations").selectExpr(*_render(_CHAT, _SPARK))


def nested_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_spans with event_id and harder attributes, scopes and projects."""
    spans = event_spans(spark, sf_dir, keep_event_id=True)
    hard = {text.rsplit(" AS ", 1)[1]: text.rsplit(" AS ", 1)[0] for text in _render(_NESTED, _SPARK)}
    return spans.selectExpr(*[f"{hard.get(name, name)} AS {name}" for name in spans.columns])


def nested_spans_sql() -> str:
    """The same as a table `nested` over `spans`."""
    return f"nested AS (SELECT * REPLACE ({', '.join(_render(_NESTED, _ANSI))}) FROM spans)"


def event_spans_sql() -> str:
    """The same spans as common table expressions for the checking engine."""
    base = ", ".join(_render({**_EVENT_BASE}, _ANSI))
    span = ", ".join(_render(_EVENT_SPAN, _ANSI))
    return f"span_base AS (SELECT {base} FROM events), spans AS (SELECT {span}, event_id FROM span_base)"


def chat_spans_sql() -> str:
    return f"llm AS (SELECT {', '.join(_render(_CHAT, _ANSI))} FROM conversations)"
