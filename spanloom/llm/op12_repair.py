"""Repair of conversations with wrong role order, by dynamic programming over a grammar.

A row of a conversation is a letter: its role's initial and its fault. What the cheapest
edits do from one state of the wanted role order to another is a matrix over costs and
edit letters, with "cheaper, then ASCII-least" as addition and "one after the other" as
multiplication (min-plus); a run of rows is the product of its letters' matrices.

* Re-Pair. Conversations repeat each other, so Spark counts the adjacent pairs of letters of
  all distinct runs, the most frequent pairs become letters of their own, and so on.
  Each such rule has one matrix, the product of those of its two letters, made bottom-up;
  its edit letters are ropes that share those of its parts. Rules are shared by all conversations.
* A run's matrix is the product over its few letters left. Two audits of a run that cost
  the same never are the beginning of one another (the rest would be inserts, which
  cost), so the ASCII-least of parts is the ASCII-least of the whole.
* Conversations are cut into runs of RUN rows after a range-partitioned sort, so a very
  long one is worked on by many tasks; its runs' matrices are multiplied FAN at a time. Rows that repeat are kept as
  blocks of BLOCK copies. Only the hash of a repaired conversation is taken in one
  stream, as SHA-256 has to be.

Defined cases: a null role, text, turn or conv_id counts as one space in the damage; a
null conv_id is a conversation, null turns come first; rows of the same turn are ordered by
role and text as damaged; rows that repeat count each; an unknown role can't be kept; a conversation without rows after
the damage has zeros, no audit and the hash of the empty text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import table, worker_state, written
from spanloom.operators.ranks import join_aggregate

#: Rows of a run, runs multiplied at once, and copies of a row in a block.
RUN, FAN, BLOCK = 1024, 16, 4096
#: Letters of rules start here (a private area of 6,400 code points), so there are at most so many rules.
FIRST_RULE, RULES = 0xE000, 6400
#: A round of new rules is the last if it shortens the runs by less than one in SHORTER letters.
SHORTER = 64
ROLES = {"u": "user", "a": "assistant"}
#: States of the wanted order (s?(ua)+)?: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1


class Rope(NamedTuple):
    """Edit letters: a text, or two ropes one after the other."""

    text: str
    left: Rope | None = None
    right: Rope | None = None

    def spelled(self) -> str:
        out, todo = [], [self]
        while todo:
            rope = todo.pop()
            if rope.left is None:
                out.append(rope.text)
            else:
                todo += (rope.right, rope.left)
        return "".join(out)


def joined(left: Rope, right: Rope) -> Rope:
    if left.left is None and not left.text:
        return right
    if right.left is None and not right.text:
        return left
    return Rope("", left, right)


def precedes(one: Rope, other: Rope) -> bool:
    """ASCII order; parts that are the same object are passed over."""
    a, b = [one], [other]
    while a and b:
        x, y = a.pop(), b.pop()
        if x is y:
            continue
        if x.left is not None:
            a += (x.right, x.left)
            b.append(y)
        elif y.left is not None:
            b += (y.right, y.left)
            a.append(x)
        else:
            size = min(len(x.text), len(y.text))
            if x.text[:size] != y.text[:size]:
                return x.text[:size] < y.text[:size]
            for stack, rest in ((a, x.text[size:]), (b, y.text[size:])):
                if rest:
                    stack.append(Rope(rest))
    return not a and bool(b)


#: (from state, to state) -> (cost, edit letters), without what can't be reached.
Matrix = dict[tuple[int, int], tuple[int, Rope]]
ONE: Matrix = {(s, s): (0, Rope("")) for s in STATES}


def add(matrix: Matrix, place: tuple[int, int], cost: int, rope: Rope) -> None:
    had = matrix.get(place)
    if had is None or cost < had[0] or (cost == had[0] and precedes(rope, had[1])):
        matrix[place] = (cost, rope)


def product(left: Matrix, right: Matrix) -> Matrix:
    out: Matrix = {}
    for (start, middle), (cost, rope) in left.items():
        for end in STATES:
            if more := right.get((middle, end)):
                add(out, (start, end), cost + more[0], joined(rope, more[1]))
    return out


def inserts() -> Matrix:
    """Any number of inserted rows."""
    once: Matrix = {(s, STEP[r][s]): (INSERT, Rope("I")) for r in ROLES for s in STEP[r]}
    out, some = dict(ONE), dict(ONE)
    for _ in STATES:  # more would go round in circles
        some = product(some, once)
        for place, (cost, rope) in some.items():
            add(out, place, cost, rope)
    return out


INSERTS = inserts()


def letter_matrix(letter: str) -> Matrix:
    """Inserts, then what may be done to a row: s, u, a and others (o), in capitals when the text is cut short; x must go."""
    row: Matrix = {}
    cut = CUT if letter.isupper() else 0
    for state in STATES:
        add(row, (state, state), DELETE, Rope("D"))
        if letter == "x":
            continue
        if state in STEP.get(letter.lower(), ()):
            add(row, (state, STEP[letter.lower()][state]), KEEP + cut, Rope("K"))
        for role in ROLES:
            if state in STEP[role]:
                add(row, (state, STEP[role][state]), REROLE + cut, Rope("R"))
    return product(INSERTS, row)


class Matrices(dict):
    """The matrix of each letter; those of rules from the rules, in the order they were made."""

    def __init__(self, rules: list[str]):
        super().__init__({letter: letter_matrix(letter) for letter in "suaoSUAOx"})
        for number, (left, right) in enumerate(rules):
            self[chr(FIRST_RULE + number)] = product(self[left], self[right])

    def of(self, run: str) -> Matrix:
        out = ONE
        for letter in run:
            out = product(out, self[letter])
        return out


def cells(matrix: Matrix) -> list[tuple[int, int, int, str]]:
    return [(start, end, cost, rope.spelled()) for (start, end), (cost, rope) in matrix.items()]


def from_cells(values) -> Matrix:
    return {(c["start"], c["end"]): (c["cost"], Rope(c["audit"])) for c in values}


CELLS = "array<struct<start:int,end:int,cost:long,audit:string>>"
CELL_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _cell_array(matrices: list[Matrix]) -> pa.Array:
    return pa.array([[dict(zip(("start", "end", "cost", "audit"), c)) for c in cells(m)] for m in matrices], CELL_TYPE)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: what the damage leaves of the rows, by the checksum of `conv_id:turn`."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault, role, text = F.col("fault"), F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select("conv_id", "turn", "role", "text", (F.crc32(key) % 20).alias("fault")).where("fault <> 0")
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def is_cut(text: Column) -> Column:
    return ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def faulty(rows: DataFrame) -> DataFrame:
    """Blocks of equal rows in place of rows(conv_id, turn, role, text, copies).

    New columns: block, k (copies in it), letter (of the first copy), blank, duplicate and truncated (copies with that first fault).
    The other copies of a block repeat the first and have the letter x.
    """
    # a null turn comes first, as in the order of rows
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    same = same.withColumn("same", F.sha2(F.to_json(F.struct("conv_id", "role", "text")), 256))
    first = same.groupBy("same").agg(F.min(turn).alias("first"))
    each = join_aggregate(same, first, ["same"]).withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 1) div {BLOCK})")))
    k = F.least(F.lit(BLOCK), F.col("n") - F.col("block") * BLOCK)
    new = (F.col("first") == turn) & (F.col("block") == 0)
    blank = is_blank(F.col("text"))
    cut = new & ~blank & is_cut(F.col("text"))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(blank | ~new, "x").when(cut, F.upper(known)).otherwise(known)
    return each.select(
        "conv_id", "turn", "role", "text", "block", k.alias("k"), letter.alias("letter"), F.when(blank, k).otherwise(0).alias("blank"),
        F.when(blank, 0).when(new, k - 1).otherwise(k).alias("duplicate"), cut.cast("long").alias("truncated"),
    )


def _id_type(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def in_runs(blocks: DataFrame) -> DataFrame:
    """Blocks in order, as a written table: part and place give the order; after the last block of a run stands a row with its letters in `run`,
    the first and last role initials, and its adjacent initials that are not in order.
    """
    names = ("part", "place", "conv_id", "k", "role", "text", "run", "first", "last", "illegal")
    kinds = (pa.int32(), pa.int64(), None, pa.int64(), *(pa.string(),) * 5, pa.int64())

    def cut(batches):
        part, place, run, first, last, illegal, id_kind = TaskContext.get().partitionId(), 0, "", None, None, 0, None
        conv, started = None, False

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, kind or id_kind) for c, kind in zip(zip(*out) if out else [[]] * len(names), kinds)], names=names)

        for batch in batches:
            id_kind, out = batch.column("conv_id").type, []
            for conv_id, role, text, k, letter in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "k", "letter"))):
                if started and (conv_id != conv or len(run) + k > RUN):
                    out.append((part, place, conv, None, None, None, run, first, last, illegal))
                    place, run, first, last, illegal = place + 1, "", None, None, 0
                conv, started = conv_id, True
                out.append((part, place, conv, k, role, None if letter == "x" else text, None, None, None, None))
                initial = role[:1]
                if run:
                    illegal += last + initial not in LEGAL
                else:
                    first = initial
                illegal += k - 1  # copies of a row: equal initials
                run, last, place = run + letter + "x" * (k - 1), initial, place + 1
            yield batch_of(out)
        if started:
            yield batch_of([(part, place, conv, None, None, None, run, first, last, illegal)])

    ordered = blocks.select("conv_id", "turn", "role", "text", "block", "k", "letter").repartitionByRange("conv_id", "turn", "role", "text", "block")
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "role", "text", "block")
    schema = f"part int, place long, conv_id {_id_type(blocks)}, k long, role string, text string, run string, first string, last string, illegal long"
    return written(ordered.mapInArrow(cut, schema), "runs")


def grammar(runs: DataFrame) -> tuple[list[str], DataFrame]:
    """Re-Pair over runs(run): pairs of letters by rule, and runs(run, packed) written with the rules' letters.

    Each round takes the most frequent pairs that share no letter, so their order does not matter. Rules only save work: results are the same with any.
    """
    rules: list[str] = []
    packed = written(runs.withColumn("packed", F.col("run")), "packed")
    while len(rules) < RULES:
        size = F.length("packed")
        pairs = packed.where(size > 1).select(F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substr("packed", i, F.lit(2)))).alias("pair"))
        counted = pairs.groupBy("pair").count().where("count > 1").orderBy(F.desc("count"), "pair").limit(RULES).collect()
        total = packed.agg(F.sum(size)).first()[0] or 0
        taken, used, gained = [], set(), 0
        for pair, count in counted:
            if not used & set(pair) and len(rules) + len(taken) < RULES:
                taken.append(pair)
                used |= set(pair)
                gained += count
        if gained * SHORTER < total or not taken:
            break
        shorter = F.col("packed")
        for pair in taken:
            shorter = F.replace(shorter, F.lit(pair), F.lit(chr(FIRST_RULE + len(rules))))
            rules.append(pair)
        packed = written(packed.withColumn("packed", shorter), "packed")
    return rules, packed


def run_matrices(runs: DataFrame) -> DataFrame:
    """run, cells of the distinct runs(run)."""
    rules, packed = grammar(runs.select("run").distinct())
    shared = packed.sparkSession.sparkContext.broadcast(rules)

    def multiply(batches):
        # one matrix for each rule and worker, with ropes that share their parts
        known = worker_state(shared.value, lambda: Matrices(shared.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("run"), _cell_array([known.of(p) for p in batch.column("packed").to_pylist()])], names=["run", "cells"])

    return written(packed.mapInArrow(multiply, f"run string, cells {CELLS}"), "matrices")


def conversation_matrices(runs: DataFrame) -> DataFrame:
    """conv_id, cells, illegal of the conversations in runs(conv_id, part, place, run, first, last, illegal)."""
    matrices = run_matrices(runs)
    order = Window.partitionBy("conv_id").orderBy("part", "place")
    seam = F.concat(F.lag("last").over(order), F.col("first"))
    numbered = runs.select("conv_id", "run", (F.row_number().over(order) - 1).alias("nth"), (F.col("illegal") + F.coalesce((~seam.isin(*LEGAL)).cast("int"), F.lit(0))).alias("illegal"))
    found = written(numbered.join(matrices, "run").drop("run"), "conversation-runs")
    schema = f"conv_id {_id_type(runs)}, nth int, illegal long, cells {CELLS}"

    def multiply(batches):
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                matrix = ONE
                for part in sorted(parts, key=lambda p: p["nth"]):
                    matrix = product(matrix, from_cells(part["cells"]))
                out.append(matrix)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("nth"), batch.column("illegal"), _cell_array(out)], names=["conv_id", "nth", "illegal", "cells"])

    while found.agg(F.max("nth")).first()[0]:
        together = found.groupBy("conv_id", F.expr(f"nth div {FAN}").cast("int").alias("nth")).agg(F.sum("illegal").alias("illegal"), F.collect_list(F.struct("nth", "cells")).alias("parts"))
        found = written(together.mapInArrow(multiply, schema), "conversation-runs")
    return found.drop("nth")


def with_audits(found: DataFrame) -> DataFrame:
    """conv_id, illegal, cost, audit: the cheapest way to an end of the wanted order."""

    def choose(batches):
        for batch in batches:
            best = []
            for values in batch.column("cells").to_pylist():
                whole: Matrix = {}
                for (start, end), (cost, rope) in product(from_cells(values), INSERTS).items():
                    if start == START and end in (START, ASSISTANT):
                        add(whole, (0, 0), cost, rope)
                best.append(whole[0, 0])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("illegal"), pa.array([b[0] for b in best], pa.int64()), pa.array([b[1].spelled() for b in best], pa.string())],
                                             names=["conv_id", "illegal", "cost", "audit"])

    return written(found.mapInArrow(choose, f"conv_id {_id_type(found)}, illegal long, cost long, audit string"), "audits")


class Repaired:
    """Repaired rows of a conversation, from its audit and its rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _next(self) -> str:
        role = "a" if self.state == USER else "u"
        self.state = STEP[role][self.state]
        return ROLES[role]

    def inserted(self):
        while self.audit[self.at: self.at + 1] == "I":
            self.at += 1
            yield self._next(), ""

    def row(self, role: str, text: str | None, copies: int):
        """What stands up to these copies of a row, the row included."""
        for _ in range(copies):
            yield from self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = STEP[role[0]][self.state]
                yield role, text
            elif edit == "R":
                yield self._next(), text


def repaired_hashes(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: a conversation streams through one task, behind its audit."""
    kind = _id_type(rows)
    lead = audits.select("conv_id", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("k"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = lead.unionByName(rows.where("k is not null").select("conv_id", "part", "place", "k", "role", "text"))

    def stream(batches):
        conv, made, digest, some, id_kind = None, None, None, False, None

        def put(pieces):
            nonlocal some
            for role, text in pieces:
                digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], id_kind), pa.array([h for _, h in out], pa.string())], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            id_kind, out = batch.column("conv_id").type, []
            for conv_id, part, k, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "k", "role", "text"))):
                if part < 0:
                    if made:
                        put(made.inserted())
                        out.append((conv, digest.hexdigest()))
                    conv, made, digest, some = conv_id, Repaired(text), hashlib.sha256(), False
                else:
                    put(made.row(role, text, k))
            yield batch_of(out)
        if made:
            put(made.inserted())
            yield batch_of([(conv, digest.hexdigest())])

    return both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").mapInArrow(stream, f"conv_id {kind}, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """Faults, cost and audit of the cheapest repair and the hash of its rows, for every conversation of the damaged table."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    blocks = written(faulty(damaged(rows)), "blocks")
    ordered = in_runs(blocks)
    audits = with_audits(conversation_matrices(ordered.where("run is not null")))
    counts = blocks.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), *(F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")),
    )
    # one row of each kind for a conversation, brought together by one grouping, which takes null for a key like any
    together = rows.select("conv_id").distinct()
    for more in (counts, audits, repaired_hashes(ordered, audits)):
        together = together.unionByName(more, allowMissingColumns=True)
    numbers = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return together.groupBy("conv_id").agg(*numbers, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


#: The same by a walk over the rows: a table of moves in place of matrices and grammar. The checksum is taken bit by bit.
ORACLE = r"""
WITH RECURSIVE keyed AS (
    SELECT dense_rank() OVER (ORDER BY conv_id) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
    FROM conversations
), faulted AS (
    SELECT g, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 AS f
    FROM keyed
), damaged AS (
    SELECT g, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
    FROM faulted WHERE f <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), seen AS (
    SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
           NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) || left(role, 1) AS pair
    FROM placed
), ins(f, t, c, a, made) AS (
    VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
           (0, 2, 2, 'I', 'user:' || chr(10)), (1, 2, 2, 'I', 'user:' || chr(10)), (3, 2, 2, 'I', 'user:' || chr(10)), (2, 3, 2, 'I', 'assistant:' || chr(10)),
           (0, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))
), moves(initial, f, t) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
edits AS (
    SELECT g, i, f, t, 'K' AS edit, cut::INT AS c, role || ':' || text || chr(10) AS made FROM seen JOIN moves USING (initial) WHERE NOT blank AND NOT again
    UNION ALL
    SELECT g, i, f, t, 'R', 2 + cut::INT, CASE moves.initial WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text || chr(10) FROM seen, moves WHERE moves.initial <> 's' AND NOT blank AND NOT again
    UNION ALL
    SELECT g, i, f, f, 'D', 3, '' FROM seen, (VALUES (0), (1), (2), (3)) AS states(f)
), walk AS (
    SELECT DISTINCT g, 0::BIGINT AS i, 0 AS st, {'c': 0::BIGINT, 'a': '', 'made': ''} AS best FROM damaged
    UNION ALL
    SELECT walk.g, walk.i + 1, edits.t, min({'c': best.c + ins.c + edits.c, 'a': best.a || ins.a || edits.edit, 'made': best.made || ins.made || edits.made})
    FROM walk JOIN ins ON ins.f = walk.st JOIN edits ON edits.g = walk.g AND edits.i = walk.i + 1 AND edits.f = ins.t
    GROUP BY walk.g, walk.i, edits.t
), repaired AS (
    SELECT walk.g, min({'c': best.c + ins.c, 'a': best.a || ins.a, 'made': best.made || ins.made}) AS best
    FROM walk JOIN (SELECT g, max(i) AS i FROM seen GROUP BY g) AS ends ON ends.g = walk.g AND ends.i = walk.i JOIN ins ON ins.f = walk.st WHERE ins.t IN (0, 3)
    GROUP BY walk.g
), counted AS (
    SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
           count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM seen GROUP BY g
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(left(best.made, greatest(length(best.made) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM keyed) AS every LEFT JOIN counted USING (g) LEFT JOIN repaired USING (g)
"""
