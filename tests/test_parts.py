"""Answers from stored summaries are those from the spans, and the spans stay closed."""

import random

import pytest

from spanloom.operators.analytics import model_analytics
from spanloom.operators.traces import trace_detail, trace_list
from spanloom.schema import SPAN
from spanloom.sources import lake as lakes
from spanloom.sources import parts

DAY = 86_400 * 10**9


def _span(n, trace, day, project, service, model=None):
    start = day * DAY + n * 1000
    values = dict.fromkeys(SPAN.fieldNames(), "") | {f.name: 0 for f in SPAN.fields if f.dataType.typeName() != "string"}
    values |= {
        "trace_id": f"t{trace}", "span_id": f"s{n}", "parent_span_id": None, "project_id": project, "service_name": service, "start_time_unix_nano": start,
        "end_time_unix_nano": start + 50 + n, "duration_ns": 50 + n, "status_code": 2 if n % 5 == 0 else 0,
        "attributes_json": f'{{"gen_ai.request.model": "{model}"}}' if model else "{}", "resource_attributes_json": "{}", "events_json": "[]", "links_json": "[]",
    }
    return tuple(values[name] for name in SPAN.fieldNames())


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """Twelve days; most traces live on one day, some reach back over many; three commits, two of them summarised."""
    lake, chance, n = str(tmp_path_factory.mktemp("lake")), random.Random(5), 0
    for commit in range(3):
        rows = []
        for _ in range(300):
            n += 1
            trace = chance.randint(0, 60)
            day = chance.randint(0, 11) if trace < 15 else trace % 12  # a few long traces
            rows.append(_span(n, trace, day, chance.choice(["p", "q", None]), chance.choice(["a", "b", "", None]), chance.choice([None, "m1", "m2"])))
        lakes.append_spans(spark.createDataFrame(rows, SPAN), lake, f"batch-{commit:012d}")
        if commit < 2:
            parts.summarise(spark, lake)
    return lake


def same(a, b):
    assert [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()]


def test_recent_traces(spark, lake, monkeypatch):
    monkeypatch.setattr(parts, "MORE", 3)
    spans = lakes.lake_spans(spark, lake)
    for project, service, limit in ((None, None, 5), ("p", None, 5), (None, "a", 3), ("q", "b", 100), ("none", None, 5)):
        same(parts.recent_traces(spark, lake, project, service, limit), trace_list(spans, project, service, limit))


def test_one_trace(spark, lake):
    spans = lakes.lake_spans(spark, lake)
    for trace, project, since, until in (("t3", None, None, None), ("t3", "p", None, None), ("t40", None, 2 * DAY, 5 * DAY), ("t3", None, 3 * DAY, 8 * DAY), ("none", None, None, None)):
        same(parts.lake_trace(spark, lake, trace, project, since, until), trace_detail(spans, trace, project, since, until))


def test_covered_commits_stay_closed(spark, lake):
    """A trace of one day opens that day alone; list and sketches open no spans at all once everything is covered."""
    whole = str(lake) + "-covered"
    lakes.append_spans(lakes.committed_spans(spark, lake), whole, "batch-000000000000")
    parts.summarise(spark, whole)
    opened = parts.lake_trace(spark, whole, "t40").inputFiles()
    assert opened and all("start_date=1970-01-05" in f for f in opened)  # 40 % 12 days after the first
    assert len(parts.lake_trace(spark, whole, "t3", since=3 * DAY, until=5 * DAY).inputFiles()) < len(parts.lake_trace(spark, whole, "t3").inputFiles())
    for frame in (parts.lake_models(spark, whole), parts.lake_totals(spark, whole), parts.recent_traces(spark, whole, limit=2)):
        assert not any("/spans/" in f for f in frame.inputFiles())
    newest = parts.recent_traces(spark, whole, limit=1)
    pruned = newest._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "start_date" in pruned and "1970-01-0" not in pruned  # the last of the twelve days, or one shortly before it
    same(newest, trace_list(lakes.lake_spans(spark, whole), limit=1))


def test_sketches(spark, lake):
    spans = lakes.lake_spans(spark, lake)
    for project in (None, "p"):
        # a sketch of few values holds them all
        same(parts.lake_models(spark, lake, project).drop("p95_latency_ms"), model_analytics(spans, project).drop("p95_latency_ms"))
    total = parts.lake_totals(spark, lake).first()
    assert (total.span_count, total.error_count) == (900, 180) and abs(total.distinct_traces - spans.select("trace_id").distinct().count()) <= 3


def test_compaction_and_leftovers(spark, lake):
    copy = str(lake) + "-copy"
    spans = lakes.committed_spans(spark, lake)
    for commit in range(2):
        lakes.append_spans(spans.where(f"status_code = {2 * commit}"), copy, f"batch-{commit:012d}")
    parts.summarise(spark, copy)
    # a part that nothing names: its writer was lost
    parts.trace_parts(lakes._commit_rows(spark, copy, ["batch-000000000000"])).write.partitionBy("start_date", "bucket").parquet(f"{copy}/summaries/part=lost/traces")
    assert parts.compact_and_summarise(spark, copy) == 900
    assert len(parts.covered(spark, copy)) == 3  # two are live no more
    same(parts.recent_traces(spark, copy, limit=50), trace_list(spans, limit=50))
    assert parts.lake_totals(spark, copy).first().span_count == 900


def test_no_lake(spark, tmp_path):
    empty = str(tmp_path / "none")
    assert parts.summarise(spark, empty) == 0
    assert parts.recent_traces(spark, empty).collect() == parts.lake_models(spark, empty).collect() == parts.lake_trace(spark, empty, "t").collect() == []
    assert tuple(parts.lake_totals(spark, empty).first()) == (0, 0, 0, None, None, None)
