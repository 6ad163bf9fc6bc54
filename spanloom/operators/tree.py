"""Shape of traces: parents, roots, depth, pre-order and subtree folding.

Almost all traces are small, so the tree columns come from one shuffle by trace
and vectorised array work on whole traces. Traces above a size limit never meet
in one task: for them the same columns come from pointer doubling, joins that
halve the remaining distance to the root in every round.

A span whose parent is missing is a root. Spans that hang below a parent cycle
are reachable from no root and get NULL root, depth and pre-order.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.attributes import non_empty
from ..session import cut_lineage
from .ranks import LARGE_KEY_ROWS, join_aggregate, running_sum, split_by_size

NODE = ["trace_id", "span_id"]
TREE_SCHEMA = (
    "trace_id string, span_id string, parent_span_id string, root_span_id string, "
    "depth bigint, child_count bigint, preorder bigint, subtree_size bigint, "
    "ancestor_collapsed boolean"
)


# of repeated span ids the one that sorts last by these columns stays
_LATEST = ["start_time_unix_nano", "end_time_unix_nano", "source_file", "source_offset"]
# and, where all of these tie (twice in one export), by these
_TIES = ["parent_span_id", "name", "attributes_json"]


def _latest_order(spans: DataFrame) -> list[str]:
    return _LATEST + [c for c in _TIES if c in spans.columns]


def _with_parent(spans: DataFrame) -> DataFrame:
    return spans.withColumn("parent_span_id", non_empty(F.col("parent_span_id")))


def latest_spans(spans: DataFrame, *columns: str) -> DataFrame:
    """The given columns of one row per (trace_id, span_id)."""
    return (
        spans.groupBy(*NODE)
        .agg(F.max_by(F.struct(*columns), F.struct(*_latest_order(spans))).alias("_kept"))
        .select(*NODE, *[F.col(f"_kept.{c}").alias(c) for c in columns])
    )


def _ids(spans: DataFrame) -> DataFrame:
    return spans.select(F.col("trace_id").alias("p_trace"), F.col("span_id").alias("p_span"))


def _to_parent():
    return (F.col("trace_id") == F.col("p_trace")) & (F.col("parent_span_id") == F.col("p_span"))


def parent_child(spans: DataFrame) -> DataFrame:
    """Every span beside its parent; parent columns are NULL for roots and orphans."""
    parents = latest_spans(spans, "name", "start_time_unix_nano").select(
        "trace_id",
        F.col("span_id").alias("parent_span_id"),
        F.col("name").alias("parent_name"),
        F.col("start_time_unix_nano").alias("parent_start"),
    )
    named = _with_parent(spans).select(*NODE, "parent_span_id", "name", "start_time_unix_nano")
    return join_aggregate(named, parents, ["trace_id", "parent_span_id"], "left").select(
        *NODE,
        "name",
        F.when(F.col("parent_start").isNotNull(), F.col("parent_span_id")).alias("parent_span_id"),
        "parent_name",
        (F.col("start_time_unix_nano") - F.col("parent_start")).alias("start_after_parent_ns"),
    )


def root_spans(spans: DataFrame) -> DataFrame:
    """Spans without a parent in their trace: no parent id, or one that never arrived."""
    return (
        _with_parent(spans)
        .join(_ids(spans), _to_parent(), "left_anti")
        .select(*NODE, "start_time_unix_nano")
    )


def orphan_spans(spans: DataFrame) -> DataFrame:
    """Spans that name a parent which is not in their trace."""
    return (
        _with_parent(spans)
        .where(F.col("parent_span_id").isNotNull())
        .join(_ids(spans), _to_parent(), "left_anti")
        .select(*NODE, "parent_span_id")
    )


def children(spans: DataFrame, limit: int = LARGE_KEY_ROWS) -> DataFrame:
    """Children of every parent in start order, one row per child.

    The children stay rows instead of one list per parent: a list has to fit
    into one task, and a parent may have any number of children.
    """
    siblings = ["trace_id", "parent_span_id"]
    order = ["start_time_unix_nano", "child_span_id"]
    named = (
        _with_parent(spans)
        .where(F.col("parent_span_id").isNotNull())
        .select(*siblings, F.col("span_id").alias("child_span_id"), "start_time_unix_nano")
    )

    def present(edges):
        return edges.join(_ids(spans), _to_parent(), "left_semi")

    small, large = split_by_size(named, siblings, limit)
    window = Window.partitionBy(*siblings).orderBy(*order)
    ranked = present(small).withColumn("child_rank", F.row_number().over(window).cast("bigint"))
    if large is not None:
        one = F.lit(1).cast("bigint")
        ranked = ranked.unionByName(running_sum(present(large), siblings, order, one, "child_rank"))
    return ranked.select(*siblings, "child_span_id", "child_rank")


# --- traces that fit a task -------------------------------------------------


def _runs(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the row before it in any column."""
    first = np.zeros(len(columns[0]), dtype=bool)
    first[:1] = True
    for column in columns:
        first[1:] |= column[1:] != column[:-1]
    return first


def _lift(up: np.ndarray, combine: Callable[[np.ndarray], None]) -> np.ndarray:
    """Follow up-pointers to the end by doubling; roots point to themselves.

    combine is called before each doubling with the current pointers. Rows on or
    below a cycle never come to rest; their pointer ends as -1.
    """
    for _ in range(int(np.ceil(np.log2(max(len(up), 2)))) + 1):
        further = up[up]
        combine(up)
        if np.array_equal(further, up):
            break
        up = further
    return np.where(up[up] == up, up, -1)


def _codes(strings: pa.ChunkedArray) -> np.ndarray:
    return strings.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _tree_columns(table: pa.Table) -> pa.Table:
    """Tree columns for a table of whole traces, all traces at once."""
    rows = table.num_rows
    codes = _codes(table.column("trace_id")).astype(np.int64)
    pool = _codes(pa.chunked_array(table.column("span_id").chunks + table.column("parent_span_id").chunks))
    width = int(np.nanmax(pool)) + 1
    key = codes * width + pool[:rows].astype(np.int64)
    by_key = np.argsort(key, kind="stable")
    last = by_key[np.append(key[by_key][1:] != key[by_key][:-1], True)]
    if len(last) < rows:  # repeated span ids
        return _tree_columns(table.take(np.sort(last)))

    wanted = pool[rows:].astype(float)
    known = ~np.isnan(wanted)
    seek = codes * width + np.where(known, wanted, 0).astype(np.int64)
    at = by_key[np.clip(np.searchsorted(key, seek, sorter=by_key), 0, rows - 1)]
    found = known & (key[at] == seek)
    is_root = ~found
    up = np.where(found, at, np.arange(rows))
    span, parent = (
        table.column(c).to_numpy(zero_copy_only=False) for c in ("span_id", "parent_span_id")
    )
    n = rows

    depth = (~is_root).astype(np.int64)
    marked = table.column("collapsed").to_numpy(zero_copy_only=False).astype(bool)
    above = np.where(is_root, False, marked[up])
    state = {"depth": depth, "above": above}

    def climb(pointers):
        state["depth"] = state["depth"] + state["depth"][pointers]
        state["above"] = state["above"] | state["above"][pointers]

    reach = _lift(up, climb)
    # rows that end on a span which is no root belong to a cycle
    reach = np.where((reach >= 0) & is_root[np.clip(reach, 0, None)], reach, -1)
    alive = reach >= 0
    depth = np.where(alive, state["depth"], -1)

    # subtree sizes: one pass per level, deepest first
    size = np.ones(n, dtype=np.int64)
    levels = np.argsort(depth, kind="stable")
    edges = np.searchsorted(depth[levels], np.arange(int(depth.max(initial=-1)) + 2))
    for d in range(len(edges) - 2, 0, -1):
        rows = levels[edges[d]:edges[d + 1]]
        np.add.at(size, up[rows], size[rows])

    # siblings by start time; the roots of a trace are siblings as well
    start = table.column("start_time_unix_nano").to_numpy()
    above_key = np.where(is_root, -1, up)
    by_sibling = np.lexsort((span, start, above_key, codes))
    head = _runs(codes[by_sibling], above_key[by_sibling])
    total = np.cumsum(np.where(alive, size, 0)[by_sibling]) - np.where(alive, size, 0)[by_sibling]
    earlier = np.empty(n, dtype=np.int64)
    earlier[by_sibling] = total - np.maximum.accumulate(np.where(head, total, 0))

    # pre-order: own shift plus that of all ancestors, again level by level
    pre = earlier.copy()
    for d in range(1, len(edges) - 1):
        rows = levels[edges[d]:edges[d + 1]]
        pre[rows] = pre[up[rows]] + 1 + earlier[rows]

    kids = np.zeros(n, dtype=np.int64)
    np.add.at(kids, up[found], 1)
    dead = ~alive
    return pa.table({
        "trace_id": table.column("trace_id"),
        "span_id": table.column("span_id"),
        "parent_span_id": pa.array(np.where(found, parent, None), pa.string()),
        "root_span_id": pa.array(np.where(alive, span[np.clip(reach, 0, None)], None), pa.string()),
        "depth": pa.array(depth, pa.int64(), mask=dead),
        "child_count": pa.array(kids, pa.int64()),
        "preorder": pa.array(pre, pa.int64(), mask=dead),
        "subtree_size": pa.array(size, pa.int64(), mask=dead),
        "ancestor_collapsed": pa.array(state["above"].astype(bool), pa.bool_(), mask=dead),
    })


def _whole_traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut a stream sorted by trace into tables of whole traces and number them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        trace = batch.column("trace_id")
        last = trace[batch.num_rows - 1].as_py()
        if held and held[-1].column("trace_id")[0].as_py() == last:
            held.append(batch)  # still inside one trace
            continue
        starts = _runs(trace.to_numpy(zero_copy_only=False))
        cut = int(np.flatnonzero(starts)[-1])
        if cut or held:
            done = [*held, batch.slice(0, cut)]
            yield from _tree_columns(pa.Table.from_batches(done)).to_batches()
        held = [batch.slice(cut)]
    if held:
        yield from _tree_columns(pa.Table.from_batches(held)).to_batches()


def _small_trees(spans: DataFrame) -> DataFrame:
    order = _latest_order(spans)
    return (
        spans.select(*dict.fromkeys([*NODE, "parent_span_id", "collapsed", *order]))
        .repartition("trace_id")
        .sortWithinPartitions("trace_id", *order)
        .select(*NODE, "parent_span_id", "collapsed", "start_time_unix_nano")
        .mapInArrow(_whole_traces, TREE_SCHEMA)
    )


# --- traces of any size -----------------------------------------------------


Fold = dict[str, Callable[[Column, Column], Column]]


def _climbed(links: DataFrame, fold: Fold, gather: str | None = None) -> DataFrame:
    """Fold columns from each span to its root by pointer doubling.

    links has node, up (NULL at a root) and the columns of fold, which combine a
    span's value with that of the ancestor it points to; nodes are numbers, since every
    round shuffles and stores its rows. gather names a column
    that works the other way: it is summed over all descendants. After k rounds
    it holds the sum over less than 2^k levels, and the ancestor 2^k levels up
    takes that over. Sums are taken per ancestor before the join, so a span with
    very many descendants meets one row.

    Only open rows are joined, those that have not reached their root. The right side
    of each join has one row per key, so where many rows share an
    ancestor adaptive execution can split the left side. While any row off the
    cycles is open, each round finishes some; once the number of open rows
    stands still, they all lie on or below a cycle, and they keep a non-NULL up.
    """
    columns = ["node", "up", *fold, *([gather] if gather else [])]
    before = None
    while True:
        open_rows = links.where(F.col("up").isNotNull())
        still_open = open_rows.count()
        if still_open in (0, before):
            return links
        before = still_open
        step = links.select(F.col("node").alias("u_node"), F.col("up").alias("u_up"), *[F.col(c).alias(f"u_{c}") for c in fold])
        climbed = open_rows.join(step, F.col("up") == F.col("u_node")).select(
            "node", F.col("u_up").alias("up"), *[f(F.col(c), F.col(f"u_{c}")).alias(c) for c, f in fold.items()], *([gather] if gather else []),
        )
        further = climbed.unionByName(links.where(F.col("up").isNull()).select(*columns))
        if gather:
            gained = open_rows.groupBy(F.col("up").alias("g_node")).agg(F.sum(gather).alias("gain"))
            further = further.join(gained, F.col("node") == F.col("g_node"), "left").withColumn(gather, F.col(gather) + F.coalesce("gain", F.lit(0)))
        links = cut_lineage(further.select(*columns))


def _large_trees(nodes: DataFrame) -> DataFrame:
    """The columns of _small_trees without ever gathering a trace.

    Spans have numbers in between, frozen by a checkpoint; ids are as long as many numbers.
    """
    numbered = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()))
    parents = numbered.select(
        F.col("trace_id").alias("p_trace"), F.col("span_id").alias("p_span"), F.col("node").alias("up"), F.col("collapsed").alias("p_mark")
    )
    nodes = cut_lineage(
        numbered.join(parents, _to_parent(), "left").select(
            *NODE,
            "start_time_unix_nano",
            F.col("p_span").alias("parent_span_id"),
            "node",
            "up",
            F.coalesce("p_mark", F.lit(False)).alias("below_mark"),
        )
    )
    has_parent = F.col("up").isNotNull().cast("bigint")
    climbed = _climbed(
        nodes.select(
            "node",
            "up",
            F.coalesce("up", "node").alias("root"),
            has_parent.alias("depth"),
            F.col("below_mark").alias("ancestor_collapsed"),
            F.lit(1).cast("bigint").alias("subtree_size"),
        ),
        {
            "root": lambda own, above: above,
            "depth": lambda own, above: own + above,
            "ancestor_collapsed": lambda own, above: own | above,
        },
        gather="subtree_size",
    )
    # what never came to rest hangs below a cycle
    alive = climbed.where(F.col("up").isNull()).drop("up")
    # siblings have one parent, or are the roots of one trace
    siblings = nodes.join(alive.select("node", "subtree_size"), "node").select(
        "node", "up", F.when(F.col("up").isNull(), F.col("trace_id")).alias("_trace"), "start_time_unix_nano", "span_id", "subtree_size"
    )
    upto = running_sum(siblings, ["_trace", "up"], ["start_time_unix_nano", "span_id"], F.col("subtree_size"), "_upto")
    # own place among the siblings; summed with that of all ancestors it is the pre-order
    shift = F.col("_upto") - F.col("subtree_size") + has_parent
    order = _climbed(
        cut_lineage(upto.select("node", "up", shift.alias("preorder"))),
        {"preorder": lambda own, above: own + above},
    ).select("node", "preorder")
    kids = nodes.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("child_count"))
    roots = nodes.where(F.col("up").isNull()).select(F.col("node").alias("root"), F.col("span_id").alias("root_span_id"))
    return (
        nodes.join(alive.join(roots, "root"), "node", "left")
        .join(kids, "node", "left")
        .join(order, "node", "left")
        .select(
            *NODE,
            "parent_span_id",
            "root_span_id",
            "depth",
            F.coalesce("child_count", F.lit(0)).cast("bigint").alias("child_count"),
            "preorder",
            "subtree_size",
            "ancestor_collapsed",
        )
    )


# --- public -----------------------------------------------------------------


def _trees(spans: DataFrame, collapsed: Column | None, limit: int) -> DataFrame:
    mark = F.lit(False) if collapsed is None else F.coalesce(collapsed, F.lit(False))
    marked = _with_parent(spans).withColumn("collapsed", mark)
    small, large = split_by_size(marked, ["trace_id"], limit)
    result = _small_trees(small)
    if large is None:
        return result
    nodes = latest_spans(large, "parent_span_id", "start_time_unix_nano", "collapsed")
    return result.unionByName(_large_trees(nodes))


def span_tree(spans: DataFrame, limit: int = LARGE_KEY_ROWS) -> DataFrame:
    """Place of every span in its trace.

    preorder counts the spans of the trace in the order in which an indented
    listing shows them: roots and siblings by start time, children after their
    parent. limit is the trace size from which on traces are taken apart.
    """
    return _trees(spans, None, limit).drop("ancestor_collapsed")


def span_tree_collapsed(spans: DataFrame, collapsed: Column, limit: int = LARGE_KEY_ROWS) -> DataFrame:
    """The tree without the descendants of the spans that the predicate collapses."""
    return (
        _trees(spans, collapsed, limit)
        .where(F.col("depth").isNotNull() & ~F.col("ancestor_collapsed"))
        .drop("ancestor_collapsed")
    )
