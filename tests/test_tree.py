"""Tree columns on both paths against a plain walk."""

import random

import pytest
from exports import spans_frame
from pyspark.sql import functions as F

from spanloom.operators.ranks import running_sum
from spanloom.operators.tree import children, orphan_spans, parent_child, root_spans, span_tree, span_tree_collapsed


def walk(rows, folded=()):
    """{(trace, span): (parent, root, depth, child_count, preorder, subtree, hidden)} by recursion."""
    last = {}
    for row in sorted(rows, key=lambda r: r["start"]):
        last[row["trace"], row["span"]] = row
    out = {}
    for trace in {r["trace"] for r in rows}:
        nodes = {s: r for (t, s), r in last.items() if t == trace}
        kids, roots = {}, []
        for span, row in nodes.items():
            parent = row["parent"] or None
            (kids.setdefault(parent, []) if parent in nodes else roots).append(span)
        place = lambda s: (nodes[s]["start"], s)
        number = 0
        stack = [(s, s, 0, False) for s in sorted(roots, key=place, reverse=True)]
        order, info = [], {}
        while stack:
            span, root, depth, hidden = stack.pop()
            info[span] = [root, depth, number, hidden]
            number += 1
            order.append(span)
            below = hidden or span in folded
            stack += [(k, root, depth + 1, below) for k in sorted(kids.get(span, []), key=place, reverse=True)]
        size = dict.fromkeys(info, 1)
        for span in reversed(order):
            if info[span][1]:
                size[nodes[span]["parent"]] += size[span]
        for span, row in nodes.items():
            parent = row["parent"] if row["parent"] in nodes else None
            root, depth, pre, hidden = info.get(span, [None] * 4)
            out[trace, span] = (parent, root, depth, len(kids.get(span, [])), pre, size.get(span), hidden)
    return out


def found(frame):
    return {
        (r.trace_id, r.span_id): (r.parent_span_id, r.root_span_id, r.depth, r.child_count, r.preorder, r.subtree_size)
        for r in frame.collect()
    }


def forest(seed, traces, spans):
    rng = random.Random(seed)
    rows = []
    for t in range(traces):
        names = [f"s{i}" for i in range(rng.randint(1, spans))]
        for i, name in enumerate(names):
            kind = rng.random()
            parent = (
                None if kind < 0.1 else "" if kind < 0.15 else "lost" if kind < 0.2
                else rng.choice(names) if kind < 0.3 else names[rng.randint(max(0, i - 3), i)] if i else None
            )
            rows.append({"trace": f"t{t}", "span": name, "parent": parent, "start": rng.randint(0, 5) * 10 + i % 7})
    return rows


CHAIN = [{"trace": "c", "span": f"n{i:03d}", "parent": f"n{i-1:03d}" if i else None, "start": i} for i in range(37)]
ODD = [
    {"trace": "o", "span": "self", "parent": "self", "start": 0},
    {"trace": "o", "span": "x", "parent": "y", "start": 1},
    {"trace": "o", "span": "y", "parent": "x", "start": 2},
    {"trace": "o", "span": "below", "parent": "x", "start": 3},
    {"trace": "o", "span": "3a", "parent": "3b", "start": 3},
    {"trace": "o", "span": "3b", "parent": "3c", "start": 3},
    {"trace": "o", "span": "3c", "parent": "3a", "start": 3},
    {"trace": "o", "span": "orphan", "parent": "lost", "start": 4},
    {"trace": "o", "span": "plain", "parent": "", "start": 5},
    {"trace": "o", "span": "kid", "parent": "plain", "start": 6},
]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_chains_and_cycles(spark, limit):
    rows = CHAIN + ODD
    tree = found(span_tree(spans_frame(spark, rows), limit=limit))
    assert tree == {k: v[:6] for k, v in walk(rows).items()}
    assert tree["c", "n036"][2] == 36 and tree["o", "below"][2] is None and tree["o", "orphan"][2] == 0


@pytest.mark.parametrize("seed", range(6))
def test_random_forests(spark, seed):
    rows = forest(seed, traces=40, spans=60)
    assert found(span_tree(spans_frame(spark, rows))) == {k: v[:6] for k, v in walk(rows).items()}


def test_random_forest_taken_apart(spark):
    rows = forest(99, traces=6, spans=60)
    # some traces above the limit, some below
    assert found(span_tree(spans_frame(spark, rows), limit=20)) == {k: v[:6] for k, v in walk(rows).items()}


@pytest.mark.parametrize("limit", [100_000, 10])
def test_collapse(spark, limit):
    rows = forest(5, traces=8, spans=40) + CHAIN
    folded = {"s3", "s7", "n020"}
    tree = span_tree_collapsed(spans_frame(spark, rows), F.col("span_id").isin(*folded), limit=limit)
    expected = {k: v[:6] for k, v in walk(rows, folded).items() if v[2] is not None and not v[6]}
    assert found(tree) == expected


def test_small_batches_split_traces(spark):
    rows = forest(11, traces=30, spans=50)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(span_tree(spans_frame(spark, rows))) == {k: v[:6] for k, v in walk(rows).items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_repeated_span_id_keeps_the_last(spark):
    rows = [
        {"trace": "t", "span": "a", "parent": None, "start": 0},
        {"trace": "t", "span": "b", "parent": None, "start": 1},
        {"trace": "t", "span": "c", "parent": "b", "start": 2},
        {"trace": "t", "span": "b", "parent": "a", "start": 3},
    ]
    for limit in (100, 0):
        tree = found(span_tree(spans_frame(spark, rows), limit=limit))
        assert tree == {k: v[:6] for k, v in walk(rows).items()} and tree["t", "c"][2] == 2


def test_edges(spark):
    spans = spans_frame(spark, ODD)
    assert {r.span_id for r in root_spans(spans).collect()} == {"orphan", "plain"}
    assert [r.span_id for r in orphan_spans(spans).collect()] == ["orphan"]
    pairs = {r.span_id: r.parent_span_id for r in parent_child(spans).collect()}
    assert pairs["orphan"] is None and pairs["plain"] is None and pairs["kid"] == "plain" and len(pairs) == 10
    for limit in (100, 0):
        ranks = {(r.parent_span_id, r.child_span_id): r.child_rank for r in children(spans, limit=limit).collect()}
        assert ranks["x", "y"] == 1 and ranks["x", "below"] == 2


def test_running_sum_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else rng.choice("abc"), rng.randint(0, 50), i, rng.randint(0, 9)) for i in range(4000)]
    frame = spark.createDataFrame(rows, "k string, o int, i int, v int")
    got = {r.i: r.total for r in running_sum(frame, ["k"], ["o", "i"], F.col("v"), "total").collect()}
    sums, expected = {}, {}
    for k, o, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        sums[k] = sums.get(k, 0) + v
        expected[i] = sums[k]
    assert got == expected


def test_full_ties_of_a_span_id_are_settled_alike(spark):
    """The same id twice in one export with equal times: both forms keep the same span."""
    from spanloom.operators import tree

    schema = "trace_id string, span_id string, parent_span_id string, name string, attributes_json string, start_time_unix_nano bigint, end_time_unix_nano bigint, source_file string, source_offset bigint, collapsed boolean"
    row = lambda span, parent, name: ("t", span, parent, name, "{}", 1, 2, "f", 0, False)
    rows = [row("r", None, "root"), row("q", None, "root"), row("a", "r", "one"), row("a", "q", "two"), row("a", None, "zero"), row("b", "a", "leaf")]
    seen = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        for limit in (100_000, 1):
            df = spark.createDataFrame(order, schema).repartition(3)
            seen.add(tuple(sorted((r.span_id, r.parent_span_id, r.depth) for r in tree.span_tree(df, limit).select("span_id", "parent_span_id", "depth").collect() if r.parent_span_id)))
    assert seen == {(("a", "r", 1), ("b", "a", 2))}


def test_rounds_of_doubling_keep_numbers_alone(spark, monkeypatch):
    """Trees taken apart store ids where spans are numbered and where siblings are ranked, not in every round."""
    from spanloom.operators import ranks, tree

    kept, cut = [], tree.cut_lineage
    for module in (tree, ranks):
        monkeypatch.setattr(module, "cut_lineage", lambda df: kept.append(df.dtypes) or cut(df))
    assert found(span_tree(spans_frame(spark, CHAIN + ODD), limit=1)) == {k: v[:6] for k, v in walk(CHAIN + ODD).items()}
    with_ids = [c for c in kept if any(t == "string" for _, t in c)]
    assert len(kept) > 12 and len(with_ids) <= 4  # the large traces, the numbers, the links, the siblings
