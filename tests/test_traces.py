"""Exact small cases of trace and model analytics."""

import pytest
from exports import spans_frame

from spanloom.operators.analytics import (
    latency_percentiles, model_analytics, model_p95, overview, services, status_counts, throughput,
)
from spanloom.operators.exploration import attributes_map, genai_info, project_resolution, token_cast
from spanloom.operators.filters import tenant_scope
from spanloom.operators.timeline import event_timeline, waterfall
from spanloom.operators.traces import dashboard_totals, trace_detail, trace_header, trace_list, trace_rows

MODEL = '{"gen_ai.request.model": "gpt-4o", "gen_ai.usage.input_tokens": %s, "gen_ai.usage.output_tokens": %s}'


def test_wall_clock_is_not_the_sum_of_durations(spark):
    spans = spans_frame(spark, [
        {"span": "root", "start": 0, "end": 100},
        {"span": "a", "parent": "root", "start": 10, "end": 90},
        {"span": "b", "parent": "root", "start": 10, "end": 90},
    ])
    row = trace_list(spans).collect()[0]
    assert (row.wall_clock_duration_ns, row.aggregate_span_duration_ns, row.span_count) == (100, 260, 3)


def test_tokens_are_read_tolerantly(spark):
    spans = spans_frame(spark, [
        {"span": "a", "attributes_json": MODEL % (500, 100)},
        {"span": "b", "attributes_json": MODEL % ('"300"', '"invalid_number"')},
    ])
    row = model_analytics(spans).collect()[0]
    assert (row.request_count, row.total_input_tokens, row.total_output_tokens, row.total_tokens) == (2, 800, 100, 900)
    total = overview(spans).collect()[0]
    assert (total.total_llm_requests, total.total_tokens) == (2, 900)


@pytest.mark.parametrize("text, tokens", [
    ("12.5", 13), ("-12.5", -13), ("1e3", 1000), ("", None), ("junk", None), ("7", 7), (None, None),
    ("99999999999999999999", None),
])
def test_token_cast(spark, text, tokens):
    value = "null" if text is None else f'"{text}"'
    spans = spans_frame(spark, [{"span": "a", "attributes_json": '{"a.b": %s}' % value}])
    assert token_cast(spans, "a.b").collect()[0].tokens == tokens


def test_only_status_two_is_an_error(spark):
    spans = spans_frame(spark, [
        {"span": str(code), "status": code, "attributes_json": MODEL % (1, 1)} for code in (0, 1, 2)
    ])
    assert trace_list(spans).collect()[0].error_count == 1
    assert round(overview(spans).collect()[0].error_rate, 4) == 0.3333
    row = model_analytics(spans, exact_p95=True).collect()[0]
    assert row.error_count == 1 and round(row.error_rate, 4) == 0.3333
    assert {r.status_code: r.error_count for r in status_counts(spans).collect()} == {0: 0, 1: 0, 2: 1}


def test_empty_input(spark):
    spans = spans_frame(spark, [])
    total = overview(spans).collect()[0].asDict()
    assert total.pop("unique_services") == [] and set(total.values()) == {0}
    assert trace_list(spans).count() == model_analytics(spans).count() == services(spans).count() == 0
    assert model_analytics(spans, exact_p95=True).count() == latency_percentiles(spans).count() == 0
    assert dashboard_totals(trace_list(spans)).collect()[0].total_spans == 0
    assert throughput(spans).collect()[0].spans_per_sec is None


TENANTS = [
    {"trace": "aa", "span": "1", "project": "alpha", "service": "s1", "attributes_json": MODEL % (1, 1)},
    {"trace": "bb", "span": "2", "project": "beta", "service": "s2", "attributes_json": MODEL % (2, 2)},
]


def test_tenants_see_their_own_rows(spark):
    spans = spans_frame(spark, TENANTS)
    own = tenant_scope(spans, "alpha")
    assert [r.trace_id for r in trace_list(own).collect()] == ["aa"]
    assert trace_detail(own, "bb").count() == 0
    assert overview(own).collect()[0].total_spans == 1
    assert model_analytics(own).collect()[0].total_input_tokens == 1
    assert tenant_scope(spans, "alpha", "alpha").count() == 1
    assert tenant_scope(spans, None).count() == 2 and tenant_scope(spans, None, "beta").count() == 1
    with pytest.raises(PermissionError):
        tenant_scope(spans, "alpha", "beta")


@pytest.mark.parametrize("text", ["' OR '1'='1", "alpha' --", "alpha'; DROP TABLE x; --", '" OR ""="', "%", "' UNION SELECT 1 --"])
def test_hostile_text_is_a_plain_value(spark, text):
    spans = spans_frame(spark, TENANTS)
    assert trace_list(spans, project_id=text).count() == 0
    assert trace_list(spans, service=text).count() == 0
    assert trace_detail(spans, text).count() == 0
    assert model_analytics(spans, project_id=text).count() == 0
    assert spans.count() == 2


def test_limits(spark):
    spans = spans_frame(spark, TENANTS)
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            trace_list(spans, limit=limit)
    assert trace_list(spans, limit=1).count() == 1


def test_filters_come_before_grouping(spark):
    spans = spans_frame(spark, [
        {"span": "1", "service": "a", "project": "p", "end": 10},
        {"span": "2", "service": "b", "project": "q", "end": 99, "status": 2},
    ])
    row = trace_list(spans, service="a").collect()[0]
    assert (row.span_count, row.end_time_unix_nano, row.error_count, row.services) == (1, 10, 0, ["a"])
    assert trace_list(spans).collect()[0].project_id == "q"


def test_header_and_rows(spark):
    spans = spans_frame(spark, [{"trace": "", "span": "1", "start": 5, "end": 5, "service": ""}])
    header = trace_header(spans).collect()[0]
    assert (header.wall_clock_ns, header.services) == (1, [])
    row = trace_rows(trace_list(spans)).collect()[0]
    assert (row.trace_label, row.service_labels, row.duration, row.status) == ("(missing trace id)", [""], "0 ns", "OK")


def test_waterfall(spark):
    spans = spans_frame(spark, [
        {"span": "a", "start": 0, "end": 1000},
        {"span": "b", "start": 500, "end": 501},
        {"span": "c", "start": 900, "end": 900, "duration_ns": 400},
    ])
    rows = {r.span_id: (r.relative_start_ns, r.offset_ratio, r.width_ratio) for r in waterfall(spans).collect()}
    assert rows == {"a": (0, 0.0, 1.0), "b": (500, 0.5, 0.005), "c": (900, 0.9, 1 - 0.9)}


def test_percentiles(spark):
    def at(durations):
        spans = spans_frame(spark, [{"span": str(i), "duration_ns": d} for i, d in enumerate(durations)])
        return tuple(latency_percentiles(spans).collect()[0])

    for n in (1, 2, 19, 20, 21, 100, 137):
        values = [(i * 7919) % 1000 * 10**9 for i in range(n)]
        ordered = sorted(values)
        median = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
        assert at(values) == (n, median, ordered[int(n * 0.95)], ordered[int(n * 0.99)])


def test_exact_model_quantile_with_a_hot_model(spark):
    import random

    rng = random.Random(4)
    rows, groups = [], {"hot": [], "rare": []}
    for i in range(3000):
        model = "rare" if i % 100 == 0 else "hot"
        duration = rng.choice([0, 1, 5, 10**6, rng.randrange(10**12), 2**62])
        groups[model].append(duration)
        rows.append({"span": str(i), "duration_ns": duration, "attributes_json": '{"gen_ai.request.model": "%s"}' % model})
    found = {r.model: r.p95_latency_ns for r in model_p95(spans_frame(spark, rows), exact=True).collect()}
    import math
    assert found == {m: sorted(v)[math.ceil(len(v) * 0.95) - 1] for m, v in groups.items()}


def test_genai_fallbacks(spark):
    cases = [
        ('{"gen_ai.request.model": "", "llm.model": "m"}', {"is_gen_ai": True, "model": "m"}),
        ('{"gen_ai.usage.prompt_tokens": 3, "gen_ai.usage.output_tokens": 4}',
         {"is_gen_ai": True, "prompt_tokens": 3.0, "completion_tokens": 4.0, "total_tokens": 7.0}),
        ('{"llm.usage.total_tokens": "9", "gen_ai.usage.input_tokens": 1}', {"total_tokens": 9.0, "completion_tokens": None}),
        ('{"gen_ai.response.finish_reasons": ["stop", "length"]}', {"finish_reason": "stop,length", "is_gen_ai": False}),
        ('{"llm.prompt": "hi"}', {"is_gen_ai": True}),
        ("not json", {"is_gen_ai": False, "model": None}),
        ('{"gen_ai.request.temperature": 0.2, "gen_ai.system": "s", "x": NaN}', {"temperature": 0.2, "system": "s"}),
    ]
    spans = spans_frame(spark, [{"span": str(i), "attributes_json": j} for i, (j, _) in enumerate(cases)])
    rows = {r.span_id: r.asDict() for r in genai_info(spans).collect()}
    for i, (_, expected) in enumerate(cases):
        assert {k: rows[str(i)][k] for k in expected} == expected


def test_attribute_map_of_broken_json(spark):
    texts = ["not json", "", '{"a": 1, "b.c": {"d": null}}', "{broken"]
    spans = spans_frame(spark, [{"span": str(i), "attributes_json": t} for i, t in enumerate(texts)])
    rows = {r.span_id: r.attributes for r in attributes_map(spans).collect()}
    assert rows["0"] == {"raw": "not json"} and rows["1"] == {} and rows["3"] == {"raw": "{broken"}
    assert rows["2"] == {"a": "1", "b.c": '{"d":null}'}


def test_event_timeline_of_odd_json(spark):
    spans = spans_frame(spark, [
        {"span": "1", "start": 100, "events_json": '[{"name": "x", "time_unix_nano": 130, "attributes": {"k": 1}}, {"name": "y", "time_unix_nano": 90}]'},
        {"span": "2", "events_json": "broken"},
        {"span": "3", "events_json": "{}"},
        {"span": "4", "events_json": ""},
    ])
    rows = event_timeline(spans).orderBy("event_index").collect()
    assert [(r.event_name, r.relative_time_ns, r.attributes_json) for r in rows if r.event_name] == [
        ("x", 30, '{"k":1}'), ("y", -10, None),
    ]
    assert {r.span_id for r in rows} == {"1"}


def test_project_aliases(spark):
    spans = spans_frame(spark, [
        {"span": "1", "attributes_json": '{"vendor.project_id": "v"}', "resource_attributes_json": '{"project.id": "p"}'}
    ])
    assert project_resolution(spans).collect()[0].project_id == "p"
    assert project_resolution(spans, ["project.id", "vendor.project_id"]).collect()[0].project_id == "v"


def test_exact_quantiles_of_negative_values(spark):
    from spanloom.operators.ranks import disc_rank, values_at_ranks

    values = [-(2**62), -70_000_000, -5, -1, 0, 1, 2, 3, 200_000, 2**61]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v bigint")
    ranks = {f"p{i}": disc_rank(i / 10) for i in range(1, 11)}
    row = values_at_ranks(df, ["k"], "v", ranks).first()
    assert [row[f"p{i}"] for i in range(1, 11)] == values and row.n == 10


def test_trace_list_prunes_days(spark, tmp_path):
    from exports import one_span, record, write

    from spanloom.operators.traces import trace_list
    from spanloom.sources import lake as lakes
    from spanloom.streaming.materialize import materialize_available

    day = 86_400 * 10**9
    write(tmp_path / "wal", "wal-1-0.wal", *[record(one_span(i, start=i * day, end=i * day + 5)) for i in range(4)])
    materialize_available(spark, str(tmp_path / "wal"), str(tmp_path / "lake"))
    lake = str(tmp_path / "lake")
    listed = trace_list(lakes.lake_spans(spark, lake, keep_day=True), limit=2)
    assert listed.collect() == trace_list(lakes.lake_spans(spark, lake), limit=2).collect()
    plan = listed._jdf.queryExecution().toString()
    assert any("start_date" in p.split("]")[0] for p in plan.split("PartitionFilters: [")[1:])
