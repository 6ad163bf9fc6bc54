"""Queries on traces, analytics, tree shape and attributes."""

from functools import reduce
from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.genai import INPUT_TOKENS, OUTPUT_TOKENS, REQUEST_MODEL, REQUEST_SYSTEM
from ..functions.labels import duration_label
from ..operators import analytics, exploration, timeline, traces, tree
from ..operators.filters import scoped, tenant_scope
from .catalog import query
from .inputs import chat_spans, chat_spans_sql, event_spans, event_spans_sql, table

SPANS = f"WITH {event_spans_sql()}"
SPANS_RECURSIVE = f"WITH RECURSIVE {event_spans_sql()}"
CHAT = f"WITH {chat_spans_sql()}"
TRACE_ID = md5(b"t-3").hexdigest()

_SUMMARY = """
  SELECT trace_id, min(start_time_unix_nano) AS start_time_unix_nano,
    max(end_time_unix_nano) AS end_time_unix_nano,
    max(end_time_unix_nano) - min(start_time_unix_nano) AS wall_clock_duration_ns,
    cast(sum(duration_ns) AS bigint) AS aggregate_span_duration_ns,
    count(*) AS span_count, max(service_name) AS service_name,
    coalesce(list_sort(list(DISTINCT service_name) FILTER (service_name IS NOT NULL AND service_name <> '')), []) AS services,
    max(project_id) AS project_id,
    count(*) FILTER (status_code = 2) AS error_count
  FROM spans"""
_TOP = " GROUP BY trace_id ORDER BY start_time_unix_nano DESC, trace_id LIMIT "


@query("trace_list", f"{SPANS} {_SUMMARY} {_TOP} 100")
def _(spark, sf):
    return traces.trace_list(event_spans(spark, sf))


@query("trace_summaries", f"{SPANS} {_SUMMARY} GROUP BY trace_id")
def _(spark, sf):
    return traces.trace_summaries(event_spans(spark, sf))


@query("traces_by_project", f"{SPANS} {_SUMMARY} WHERE project_id = 'proj-1' {_TOP} 100")
def _(spark, sf):
    return traces.trace_list(event_spans(spark, sf), project_id="proj-1")


@query("traces_by_service", f"{SPANS} {_SUMMARY} WHERE service_name = 'svc-2' {_TOP} 50")
def _(spark, sf):
    return traces.trace_list(event_spans(spark, sf), service="svc-2", limit=50)


@query("tenant_scoped_traces", f"{SPANS} {_SUMMARY} WHERE project_id = 'proj-2' {_TOP} 100")
def _(spark, sf):
    return traces.trace_list(tenant_scope(event_spans(spark, sf), "proj-2", "proj-2"))


@query(
    "trace_detail",
    f"""{SPANS} SELECT * EXCLUDE (event_id) FROM spans WHERE trace_id = '{TRACE_ID}'
    ORDER BY start_time_unix_nano, span_id""",
)
def _(spark, sf):
    return traces.trace_detail(event_spans(spark, sf), TRACE_ID)


# Texts that would change a query they were pasted into. As bound values they match nothing.
HOSTILE = ["proj-1' OR 'a' = 'a", "x' OR TRUE --", "y'; DELETE FROM events; --", '" OR "" = "', "z' UNION ALL SELECT 1 --", "_%"]


_HOSTILE_SQL = ", ".join("('" + text.replace("'", "''") + "')" for text in HOSTILE)


@query(
    "injection_safe",
    f"""{SPANS} SELECT place, text, 0::bigint AS found, (SELECT count(*) FROM spans) AS span_count
    FROM (VALUES {_HOSTILE_SQL}) t(text), (VALUES ('list by project'), ('list by service'), ('detail'), ('models'), ('tenant')) p(place)""",
)
def _(spark, sf):
    spans = event_spans(spark, sf)
    total = spans.agg(F.count(F.lit(1))).scalar()
    asked = {
        "list by project": lambda text: traces.trace_list(spans, project_id=text),
        "list by service": lambda text: traces.trace_list(spans, service=text),
        "detail": lambda text: traces.trace_detail(spans, text),
        "models": lambda text: analytics.model_analytics(spans, project_id=text),
        "tenant": lambda text: tenant_scope(spans, text),
    }
    parts = [
        ask(text).agg(F.count(F.lit(1)).alias("found")).select(F.lit(place).alias("place"), F.lit(text).alias("text"), "found")
        for place, ask in asked.items()
        for text in HOSTILE
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("span_count", total)


@query(
    "trace_header",
    f"""{SPANS} SELECT trace_id, min(start_time_unix_nano) AS min_start, max(end_time_unix_nano) AS max_end,
      greatest(max(end_time_unix_nano) - min(start_time_unix_nano), 1) AS wall_clock_ns,
      cast(sum(duration_ns) AS bigint) AS aggregate_ns, count(*) FILTER (status_code = 2) AS error_count,
      coalesce(list_sort(list(DISTINCT service_name) FILTER (service_name IS NOT NULL AND service_name <> '')), []) AS services
    FROM spans GROUP BY trace_id""",
)
def _(spark, sf):
    return traces.trace_header(event_spans(spark, sf))


def _label_sql(ns: str) -> str:
    """Duration text; a nudge of one nanosecond turns exact ties upwards."""

    def fixed(unit, digits, exact):
        step = unit // 10**digits
        tie = f"CASE WHEN {ns} % {step} = {step // 2} AND {ns} % {exact} = 0 THEN 1 ELSE 0 END"
        return f"printf('%.{digits}f', ({ns} + {tie}) / {float(unit)})"

    return f"""CASE WHEN {ns} IS NULL THEN '0 ms' WHEN {ns} < 1000 THEN concat(cast({ns} AS varchar), ' ns')
      WHEN {ns} < 1000000 THEN concat({fixed(1000, 2, 125)}, ' µs')
      WHEN {ns} < 1000000000 THEN concat({fixed(1000000, 2, 15625)}, ' ms')
      ELSE concat({fixed(1000000000, 3, 1953125)}, ' s') END"""


@query(
    "trace_rows",
    f"""{SPANS}, listed AS ({_SUMMARY} {_TOP} 100)
    SELECT trace_id, CASE WHEN trace_id = '' THEN '(missing trace id)' ELSE trace_id END AS trace_label,
      CASE WHEN len(services) > 0 THEN services ELSE [coalesce(service_name, 'unknown')] END AS service_labels,
      span_count, {_label_sql('wall_clock_duration_ns')} AS duration,
      CASE WHEN error_count > 0 THEN concat(cast(error_count AS varchar), ' ERR') ELSE 'OK' END AS status
    FROM listed""",
)
def _(spark, sf):
    return traces.trace_rows(traces.trace_list(event_spans(spark, sf)))


@query(
    "dashboard_totals",
    f"""{SPANS}, listed AS ({_SUMMARY} {_TOP} 100)
    SELECT count(*) AS trace_count, cast(coalesce(sum(span_count), 0) AS bigint) AS total_spans,
      cast(coalesce(sum(error_count), 0) AS bigint) AS total_errors FROM listed""",
)
def _(spark, sf):
    return traces.dashboard_totals(traces.trace_list(event_spans(spark, sf)))


@query(
    "trace_verification",
    f"""{SPANS}, expected AS (SELECT DISTINCT md5(concat(CASE WHEN event_id % 300 = 0 THEN 'gone-' ELSE 't-' END,
      cast(event_id // 40 AS varchar))) AS trace_id FROM events WHERE event_type = 'purchase')
    SELECT e.trace_id, EXISTS (SELECT 1 FROM spans s WHERE s.trace_id = e.trace_id) AS verified FROM expected e""",
)
def _(spark, sf):
    expected = (
        table(spark, sf, "events")
        .where("event_type = 'purchase'")
        .selectExpr(
            "md5(concat(CASE WHEN event_id % 300 = 0 THEN 'gone-' ELSE 't-' END, "
            "cast(event_id div 40 AS string))) AS trace_id"
        )
        .distinct()
    )
    return traces.trace_verification(expected, event_spans(spark, sf))


# --- analytics --------------------------------------------------------------


def _attr(key: str) -> str:
    return f"json_extract_string(attributes_json, '$.\"{key}\"')"


_REQUEST = (
    f"({_attr(REQUEST_MODEL)} IS NOT NULL OR {_attr(REQUEST_SYSTEM)} IS NOT NULL "
    "OR name LIKE '%llm%' OR name LIKE '%generate%')"
)
_IN, _OUT = f"try_cast({_attr(INPUT_TOKENS)} AS bigint)", f"try_cast({_attr(OUTPUT_TOKENS)} AS bigint)"


def _overview_sql(source: str, where: str = "") -> str:
    return f"""SELECT count(DISTINCT trace_id) AS total_traces, count(*) AS total_spans,
      count(*) FILTER ({_REQUEST}) AS total_llm_requests,
      cast(coalesce(sum({_IN}), 0) AS bigint) AS total_input_tokens,
      cast(coalesce(sum({_OUT}), 0) AS bigint) AS total_output_tokens,
      cast(coalesce(sum({_IN}), 0) + coalesce(sum({_OUT}), 0) AS bigint) AS total_tokens,
      coalesce(list_sort(list(DISTINCT service_name) FILTER (service_name IS NOT NULL AND service_name <> '')), []) AS unique_services,
      CASE WHEN count(*) = 0 THEN 0.0::double ELSE (count(*) FILTER (status_code = 2))::double / count(*) END AS error_rate
    FROM {source} {where}"""


@query("overview", f"{SPANS} {_overview_sql('spans')}")
def _(spark, sf):
    return analytics.overview(event_spans(spark, sf))


@query("overview_by_project", f"{SPANS} {_overview_sql('spans', chr(32) + 'WHERE project_id = ' + chr(39) + 'proj-0' + chr(39))}")
def _(spark, sf):
    return analytics.overview(event_spans(spark, sf), project_id="proj-0")


@query("overview_chat", f"{CHAT} {_overview_sql('llm')}")
def _(spark, sf):
    return analytics.overview(chat_spans(spark, sf))


@query("overview_empty", f"{SPANS} {_overview_sql('spans', 'WHERE false')}")
def _(spark, sf):
    return analytics.overview(scoped(event_spans(spark, sf), project_id="no such project"))


@query(
    "services",
    f"{SPANS} SELECT DISTINCT service_name FROM spans WHERE service_name IS NOT NULL AND service_name <> ''",
)
def _(spark, sf):
    return analytics.services(event_spans(spark, sf))


@query(
    "llm_requests",
    f"""{SPANS} SELECT trace_id, span_id, name, {_attr(REQUEST_MODEL)} AS model, {_attr(REQUEST_SYSTEM)} AS system
    FROM spans WHERE {_REQUEST}""",
)
def _(spark, sf):
    return analytics.llm_requests(event_spans(spark, sf))


@query(
    "status_counts",
    f"""{SPANS} SELECT status_code, count(*) AS span_count,
      cast(sum(CASE WHEN status_code = 2 THEN 1 ELSE 0 END) AS bigint) AS error_count
    FROM spans GROUP BY status_code""",
)
def _(spark, sf):
    return analytics.status_counts(event_spans(spark, sf))


def _model_sql(source: str) -> str:
    seconds = "(sum(duration_ns)::double / 1e9::double)"
    return f"""SELECT {_attr(REQUEST_MODEL)} AS model, count(*) AS request_count,
      cast(coalesce(sum({_IN}), 0) AS bigint) AS total_input_tokens,
      cast(coalesce(sum({_OUT}), 0) AS bigint) AS total_output_tokens,
      cast(coalesce(sum({_IN}), 0) + coalesce(sum({_OUT}), 0) AS bigint) AS total_tokens,
      CASE WHEN {seconds} > 0 THEN coalesce(sum({_OUT}), 0)::double / {seconds} ELSE 0.0::double END AS tokens_per_sec,
      sum(duration_ns)::double / count(*)::double / 1e6::double AS avg_latency_ms,
      quantile_disc(duration_ns, 0.95)::double / 1e6::double AS p95_latency_ms,
      count(*) FILTER (status_code = 2) AS error_count,
      (count(*) FILTER (status_code = 2))::double / count(*) AS error_rate
    FROM {source} WHERE {_attr(REQUEST_MODEL)} IS NOT NULL GROUP BY 1 ORDER BY request_count DESC, model"""


@query("model_analytics", f"{SPANS} {_model_sql('spans')}")
def _(spark, sf):
    return analytics.model_analytics(event_spans(spark, sf), exact_p95=True)


@query("model_analytics_chat", f"{CHAT} {_model_sql('llm')}")
def _(spark, sf):
    return analytics.model_analytics(chat_spans(spark, sf), exact_p95=True)


# A sketch holds every value until a group outgrows its accuracy, so at the
# checked sizes it must give the exact value.
@query("model_analytics_sketch", f"{SPANS} {_model_sql('spans')}")
def _(spark, sf):
    return analytics.model_analytics(event_spans(spark, sf))


_P95 = f"""SELECT {_attr(REQUEST_MODEL)} AS model, quantile_disc(duration_ns, 0.95) AS p95_latency_ns
    FROM spans WHERE {_attr(REQUEST_MODEL)} IS NOT NULL GROUP BY 1"""


@query("model_p95", f"{SPANS} {_P95}")
def _(spark, sf):
    return analytics.model_p95(event_spans(spark, sf), exact=True)


@query("model_p95_approx", f"{SPANS} {_P95}")
def _(spark, sf):
    return analytics.model_p95(event_spans(spark, sf))


@query(
    "latency_percentiles",
    f"""{SPANS}, ranked AS (SELECT duration_ns, row_number() OVER (ORDER BY duration_ns) AS r,
      count(*) OVER () AS n FROM spans)
    SELECT max(n) AS span_count,
      (max(duration_ns) FILTER (r = (n + 1) // 2) + max(duration_ns) FILTER (r = n // 2 + 1)) / 2.0::double AS p50_ns,
      max(duration_ns) FILTER (r = cast(floor(n * 0.95::double) AS bigint) + 1) AS p95_ns,
      max(duration_ns) FILTER (r = cast(floor(n * 0.99::double) AS bigint) + 1) AS p99_ns
    FROM ranked""",
)
def _(spark, sf):
    return analytics.latency_percentiles(event_spans(spark, sf))


@query(
    "throughput",
    f"""{SPANS} SELECT count(DISTINCT trace_id) AS request_count, count(*) AS span_count,
      max(end_time_unix_nano) - min(start_time_unix_nano) AS wall_ns,
      count(DISTINCT trace_id) / ((max(end_time_unix_nano) - min(start_time_unix_nano))::double / 1e9::double) AS requests_per_sec,
      count(*) / ((max(end_time_unix_nano) - min(start_time_unix_nano))::double / 1e9::double) AS spans_per_sec
    FROM spans""",
)
def _(spark, sf):
    return analytics.throughput(event_spans(spark, sf))


# --- shape ------------------------------------------------------------------

_EDGE = "p.trace_id = c.trace_id AND p.span_id = c.parent_span_id AND c.parent_span_id <> ''"


@query(
    "parent_child",
    f"""{SPANS} SELECT c.trace_id, c.span_id, c.name, p.span_id AS parent_span_id, p.name AS parent_name,
      c.start_time_unix_nano - p.start_time_unix_nano AS start_after_parent_ns
    FROM spans c LEFT JOIN spans p ON {_EDGE}""",
)
def _(spark, sf):
    return tree.parent_child(event_spans(spark, sf))


@query(
    "root_spans",
    f"""{SPANS} SELECT trace_id, span_id, start_time_unix_nano FROM spans c
    WHERE NOT EXISTS (SELECT 1 FROM spans p WHERE {_EDGE})""",
)
def _(spark, sf):
    return tree.root_spans(event_spans(spark, sf))


@query(
    "orphan_spans",
    f"""{SPANS} SELECT trace_id, span_id, parent_span_id FROM spans c
    WHERE parent_span_id IS NOT NULL AND parent_span_id <> '' AND NOT EXISTS (SELECT 1 FROM spans p WHERE {_EDGE})""",
)
def _(spark, sf):
    return tree.orphan_spans(event_spans(spark, sf))


_CHILDREN = f"""{SPANS} SELECT c.trace_id, c.parent_span_id, c.span_id AS child_span_id,
      row_number() OVER (PARTITION BY c.trace_id, c.parent_span_id ORDER BY c.start_time_unix_nano, c.span_id) AS child_rank
    FROM spans c JOIN spans p ON {_EDGE}"""


@query("children", _CHILDREN)
def _(spark, sf):
    return tree.children(event_spans(spark, sf))


@query("children_of_large_parents", _CHILDREN)
def _(spark, sf):
    return tree.children(event_spans(spark, sf), limit=12)


_TREE = f"""{SPANS_RECURSIVE}, edge AS (
      SELECT c.trace_id, c.span_id, p.span_id AS parent, c.start_time_unix_nano AS st, c.event_id,
        lpad(cast(row_number() OVER (PARTITION BY c.trace_id, p.span_id ORDER BY c.start_time_unix_nano, c.span_id) AS varchar), 6, '0') AS step
      FROM spans c LEFT JOIN spans p ON {_EDGE}),
    walk AS (
      SELECT trace_id, span_id, parent, span_id AS root, 0::bigint AS depth, step AS path,
        false AS hidden, event_id % 11 = 3 AS folded FROM edge WHERE parent IS NULL
      UNION ALL
      SELECT e.trace_id, e.span_id, e.parent, w.root, w.depth + 1, w.path || '/' || e.step,
        w.hidden OR w.folded, e.event_id % 11 = 3 FROM edge e JOIN walk w ON e.trace_id = w.trace_id AND e.parent = w.span_id),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY path) - 1 AS preorder FROM walk),
    sized AS (SELECT a.trace_id, a.span_id, count(*) AS subtree_size FROM walk a
      JOIN walk b ON a.trace_id = b.trace_id AND (b.path = a.path OR starts_with(b.path, a.path || '/')) GROUP BY 1, 2),
    kids AS (SELECT trace_id, parent, count(*) AS n FROM edge WHERE parent IS NOT NULL GROUP BY 1, 2),
    tree AS (SELECT e.trace_id, e.span_id, e.parent AS parent_span_id, o.root AS root_span_id, o.depth,
        coalesce(k.n, 0) AS child_count, o.preorder, z.subtree_size, o.hidden
      FROM edge e LEFT JOIN ordered o ON o.trace_id = e.trace_id AND o.span_id = e.span_id
      LEFT JOIN sized z ON z.trace_id = e.trace_id AND z.span_id = e.span_id
      LEFT JOIN kids k ON k.trace_id = e.trace_id AND k.parent = e.span_id)"""
_TREE_ALL = f"{_TREE} SELECT * EXCLUDE (hidden) FROM tree"
_TREE_FOLDED = f"{_TREE} SELECT * EXCLUDE (hidden) FROM tree WHERE depth IS NOT NULL AND NOT hidden"


@query("span_tree", _TREE_ALL)
def _(spark, sf):
    return tree.span_tree(event_spans(spark, sf))


@query("span_tree_of_large_traces", _TREE_ALL)
def _(spark, sf):
    return tree.span_tree(event_spans(spark, sf), limit=12)


def _folded(spark, sf, **limit):
    spans = event_spans(spark, sf, keep_event_id=True)
    return tree.span_tree_collapsed(spans, F.col("event_id") % 11 == 3, **limit)


@query("span_tree_collapsed", _TREE_FOLDED)
def _(spark, sf):
    return _folded(spark, sf)


@query("span_tree_collapsed_of_large_traces", _TREE_FOLDED)
def _(spark, sf):
    return _folded(spark, sf, limit=12)


@query(
    "waterfall",
    f"""{SPANS}, bounds AS (SELECT trace_id, min(start_time_unix_nano) AS lo,
      greatest(max(end_time_unix_nano) - min(start_time_unix_nano), 1) AS wall FROM spans GROUP BY trace_id),
    placed AS (SELECT trace_id, span_id, duration_ns, wall, start_time_unix_nano - lo AS relative_start_ns,
      greatest(0.0::double, least(1.0::double, (start_time_unix_nano - lo)::double / wall::double)) AS offset_ratio
      FROM spans JOIN bounds USING (trace_id)),
    sized AS (SELECT *, greatest(0.005::double, least(1.0::double - offset_ratio, duration_ns::double / wall::double)) AS width_ratio FROM placed)
    SELECT trace_id, span_id, relative_start_ns, offset_ratio, width_ratio,
      offset_ratio * 100::double AS offset_percent, width_ratio * 100::double AS width_percent FROM sized""",
)
def _(spark, sf):
    return timeline.waterfall(event_spans(spark, sf))


_EVENT_ROWS = """(SELECT *, unnest(from_json(events_json,
  '[{"attributes":"JSON","dropped_attributes_count":"BIGINT","name":"VARCHAR","time_unix_nano":"BIGINT"}]')) AS e,
  generate_subscripts(json_extract(events_json, '$[*]'), 1) - 1 AS i FROM spans)"""


@query(
    "event_timeline",
    f"""{SPANS} SELECT trace_id, span_id, i AS event_index, e.name AS event_name,
      e.time_unix_nano - start_time_unix_nano AS relative_time_ns,
      replace(e.attributes::varchar, ' ', '') AS attributes_json FROM {_EVENT_ROWS}""",
)
def _(spark, sf):
    rows = timeline.event_timeline(event_spans(spark, sf))
    # engines print nested JSON with different spacing
    return rows.withColumn("attributes_json", F.replace("attributes_json", F.lit(" "), F.lit("")))


# --- attributes -------------------------------------------------------------

@query(
    "attributes_map",
    f"""{SPANS}, kv AS (SELECT trace_id, span_id, attributes_json, unnest(json_keys(attributes_json)) AS k FROM spans)
    SELECT trace_id, span_id, map_from_entries(list((k, replace(attributes_json ->> concat('$."', k, '"'), ' ', '')) ORDER BY k)) AS attributes
    FROM kv GROUP BY trace_id, span_id""",
)
def _(spark, sf):
    return exploration.attributes_map(event_spans(spark, sf)).withColumn(
        "attributes", F.transform_values("attributes", lambda k, v: F.replace(v, F.lit(" "), F.lit("")))
    )


@query(
    "attributes_exploded",
    f"""{SPANS}, kv AS (SELECT trace_id, span_id, attributes_json, unnest(json_keys(attributes_json)) AS key FROM spans)
    SELECT trace_id, span_id, key, replace(attributes_json ->> concat('$."', key, '"'), ' ', '') AS value FROM kv""",
)
def _(spark, sf):
    return exploration.attributes_exploded(event_spans(spark, sf)).withColumn(
        "value", F.replace("value", F.lit(" "), F.lit(""))
    )


@query(
    "attribute_counts",
    f"""{SPANS} SELECT trace_id, span_id, len(json_keys(attributes_json)) AS attribute_count,
      len(json_keys(resource_attributes_json)) AS resource_attribute_count FROM spans""",
)
def _(spark, sf):
    return exploration.attribute_counts(event_spans(spark, sf))


_SHOWN = [REQUEST_MODEL, REQUEST_SYSTEM, INPUT_TOKENS, OUTPUT_TOKENS]


@query(
    "genai_attributes",
    f"""{SPANS} SELECT trace_id, span_id, {', '.join(f"{_attr(k)} AS {k.replace('.', '_')}" for k in _SHOWN)} FROM spans""",
)
def _(spark, sf):
    return exploration.genai_attributes(event_spans(spark, sf), _SHOWN)


@query(
    "token_cast",
    f"""{SPANS} SELECT trace_id, span_id, {_attr(INPUT_TOKENS)} AS token_text, {_IN} AS tokens FROM spans""",
)
def _(spark, sf):
    return exploration.token_cast(event_spans(spark, sf), INPUT_TOKENS)


def _first(*keys, empty=True):
    texts = [f"nullif({_attr(k)}, '')" if empty else _attr(k) for k in keys]
    return f"coalesce({', '.join(texts)})"


_DISPLAY = f"""SELECT trace_id, span_id,
      {_first('gen_ai.request.model', 'gen_ai.response.model', 'llm.model', 'model')} AS model,
      {_first('gen_ai.system', 'llm.system')} AS system,
      {_first('gen_ai.usage.prompt_tokens', 'gen_ai.usage.input_tokens', 'llm.usage.prompt_tokens', empty=False)} AS p,
      {_first('gen_ai.usage.completion_tokens', 'gen_ai.usage.output_tokens', 'llm.usage.completion_tokens', empty=False)} AS c,
      {_first('gen_ai.usage.total_tokens', 'llm.usage.total_tokens', empty=False)} AS t,
      {_first('gen_ai.request.temperature', 'llm.temperature', empty=False)} AS temp,
      {_first('gen_ai.prompt', 'llm.prompt')} AS prompt,
      CASE WHEN json_type(attributes_json, '$."gen_ai.response.finish_reasons"') = 'ARRAY'
        THEN array_to_string(from_json(attributes_json -> '$."gen_ai.response.finish_reasons"', '["VARCHAR"]'), ',')
        ELSE {_first('gen_ai.response.finish_reasons', 'llm.finish_reason')} END AS finish"""


def _info_sql(source):
    return f"""SELECT trace_id, span_id,
      (model IS NOT NULL OR system IS NOT NULL OR p IS NOT NULL OR prompt IS NOT NULL) AS is_gen_ai,
      model, system, try_cast(p AS double) AS prompt_tokens, try_cast(c AS double) AS completion_tokens,
      CASE WHEN t IS NOT NULL THEN try_cast(t AS double) ELSE try_cast(p AS double) + try_cast(c AS double) END AS total_tokens,
      try_cast(temp AS double) AS temperature, finish AS finish_reason FROM ({_DISPLAY} FROM {source})"""


@query("genai_info", f"{SPANS} {_info_sql('spans')}")
def _(spark, sf):
    return exploration.genai_info(event_spans(spark, sf))


@query("genai_info_chat", f"{CHAT} {_info_sql('llm')}")
def _(spark, sf):
    return exploration.genai_info(chat_spans(spark, sf))


@query(
    "span_events",
    f"""{SPANS} SELECT trace_id, span_id, e.name AS event_name, e.time_unix_nano AS time_unix_nano,
      replace(e.attributes::varchar, ' ', '') AS attributes_json, e.dropped_attributes_count AS dropped_attributes_count
    FROM {_EVENT_ROWS}""",
)
def _(spark, sf):
    return exploration.span_events(event_spans(spark, sf)).withColumn(
        "attributes_json", F.replace("attributes_json", F.lit(" "), F.lit(""))
    )


@query(
    "span_links",
    f"""{SPANS}, rows AS (SELECT trace_id, span_id, unnest(from_json(links_json,
      '[{{"attributes":"JSON","dropped_attributes_count":"BIGINT","flags":"BIGINT","span_id":"VARCHAR","trace_id":"VARCHAR","trace_state":"VARCHAR"}}]')) AS l FROM spans)
    SELECT trace_id, span_id, l.trace_id AS linked_trace_id, l.span_id AS linked_span_id, l.trace_state AS trace_state,
      replace(l.attributes::varchar, ' ', '') AS attributes_json, l.dropped_attributes_count AS dropped_attributes_count, l.flags AS flags
    FROM rows""",
)
def _(spark, sf):
    return exploration.span_links(event_spans(spark, sf)).withColumn(
        "attributes_json", F.replace("attributes_json", F.lit(" "), F.lit(""))
    )


@query(
    "project_resolution",
    f"""{SPANS} SELECT trace_id, span_id, coalesce(nullif(json_extract_string(attributes_json, '$."project.id"'), ''),
      nullif(json_extract_string(resource_attributes_json, '$."project.id"'), '')) AS project_id FROM spans""",
)
def _(spark, sf):
    return exploration.project_resolution(event_spans(spark, sf))


# --- labels -----------------------------------------------------------------


@query(
    "duration_label",
    f"""SELECT event_id, ns, {_label_sql('ns')} AS label FROM
    (SELECT event_id, cast(floor(abs(value) * 1000) AS bigint) * power(10, event_id % 6)::bigint // 100 * 5 AS ns FROM events)""",
)
def _(spark, sf):
    return (
        table(spark, sf, "events")
        .selectExpr(
            "event_id",
            "cast(floor(abs(value) * 1000) AS bigint) * cast(power(10, event_id % 6) AS bigint) div 100 * 5 AS ns",
        )
        .withColumn("label", duration_label(F.col("ns")))
    )


@query(
    "span_kind_label",
    f"""{SPANS} SELECT trace_id, span_id, substr(span_id, 1, 8) AS short_id,
      coalesce(nullif(service_name, ''), 'unknown') AS service_label,
      CASE kind WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'SERVER' WHEN 3 THEN 'CLIENT' WHEN 4 THEN 'PRODUCER'
        WHEN 5 THEN 'CONSUMER' ELSE 'UNSPECIFIED' END AS kind_label, {_label_sql('duration_ns')} AS duration_label
    FROM spans""",
)
def _(spark, sf):
    return exploration.span_labels(event_spans(spark, sf))


@query(
    "text_preview",
    """SELECT conv_id, turn, CASE WHEN text IS NULL OR text = '' THEN '(empty response)'
      WHEN length(text) > 100 THEN concat(substr(text, 1, 97), '...') ELSE text END AS preview FROM conversations""",
)
def _(spark, sf):
    return exploration.text_previews(table(spark, sf, "conversations"), "text").select("conv_id", "turn", "preview")


_MODEL_NAME = """concat(CASE {n} % 6 WHEN 0 THEN 'Chat-' WHEN 1 THEN 'nomic-embed-' WHEN 2 THEN 'bge-' WHEN 3 THEN 'e5-chat-'
  WHEN 4 THEN 'E5-' ELSE 'instruct-' END, cast({n} % 20 AS {s}))"""


@query(
    "chat_models",
    f"""WITH m AS (SELECT DISTINCT {_MODEL_NAME.format(n='conv_id', s='varchar')} AS model FROM conversations)
    SELECT model FROM m WHERE (contains(lower(model), 'chat')
      OR NOT regexp_matches(lower(model), 'embedding|embed|nomic|bge|e5')) AND contains(lower(model), '1')
    ORDER BY CASE WHEN contains(lower(model), 'chat') THEN 0 ELSE 1 END, model""",
)
def _(spark, sf):
    models = (
        table(spark, sf, "conversations")
        .selectExpr(f"{_MODEL_NAME.format(n='conv_id', s='string')} AS model")
        .distinct()
    )
    return exploration.chat_models(models, contains="1")
