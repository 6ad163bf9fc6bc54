"""Personal data: base patterns, and a skip-chain conditional random field that adds to them.

Nodes are the tokens (runs without white space) that hold a digit or an at sign; any
other token is fixed to "none", which parts the chain, so inference has to visit the
nodes only. Labels: none, email, ip, card, phone. Potentials:

* unary: features of the token's form, of the tokens beside it and of its length;
* chain: label pairs of nodes that stand side by side;
* skip: label pairs of a node and the last one before it with the same text, and with
  the same form (digits as 9, letters as a), however far away in the document.

Weights are fitted by pseudo-likelihood on the documents with nodes among SAMPLE_DOCS
documents of the smallest hash, the spans of the base patterns being the labels (tokens
that a base pattern matched but whose check failed are left out of the fit). Inference is
loopy belief propagation over all documents of a batch at once. A run of neighbouring
nodes whose belief in one kind is at least SURE becomes a span if it touches no base
span and has what every entity of the kind has (`possible`). It finds what a greedy base pattern loses by running from one entity into the next,
and repeats of a certain entity carry uncertain ones along.

Defined cases: a null text counts as empty; base spans always stay; a table in which
the base patterns find nothing gives a field that adds nothing; repeated rows give
repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, fixed by the query's contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NODE = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = "\x20\x09\x0a\x0b\x0c\x0d"

SAMPLE_DOCS, SAMPLE_CHARS = 2000, 20_000
FEATURES = 1 << 12
ROUNDS = 12
SURE = 0.9
PENALTY = 1e-3
#: Where the fit starts from, and is held to: agreement along the chain, of equal tokens, of tokens of equal form.
SHARED = (0.0, 1.0, 0.5)
LABELS = 1 + len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, passes its check) by kind, then start."""
    found = []
    if "@" in text:
        found += [(0, *m.span(), True) for m in EMAIL.finditer(text)]
    for m in IP.finditer(text):
        found.append((1, *m.span(), all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split("."))))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        found.append((2, *m.span(), 16 <= len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        for m in PHONE.finditer(text):
            found.append((3, *m.span(), 8 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15))
    return found


def nodes_of(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens that hold a digit or an at sign."""
    out, end = [], 0
    for m in NODE.finditer(text):
        at = m.start()
        if at < end:
            continue
        start = max(text.rfind(c, end, at) for c in EDGES) + 1
        token = TOKEN.match(text, max(start, end))
        end = token.end()
        out.append(token.span())
    return out


def form(token: str) -> str:
    return re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", token))


def short_form(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", form(token))


_FEATURES: dict[str, list[int]] = {}


def _number(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % FEATURES


def token_features(token: str) -> list[int]:
    """Hashed features of a token's form; kept for the worker's next texts."""
    found = _FEATURES.get(token)
    if found is None:
        digits = sum(c.isdigit() for c in token)
        names = ["bias", f"form {short_form(token)}", f"digits {min(digits, 20)}", f"share {round(4 * digits / len(token))}", f"dots {min(token.count('.'), 5)}",
                 f"at {min(token.count('@'), 2)} {'.' in token.rpartition('@')[2]}", f"plus {token[0] == '+'}", f"bracket {token[0] == '('}", f"dash {'-' in token}", f"letters {any(c.isalpha() for c in token)}"]
        if len(_FEATURES) > 200_000:
            _FEATURES.clear()
        found = _FEATURES[token] = [_number(n) for n in names]
    return found


class Graph:
    """Nodes of some texts, their features, and the edges between them."""

    def __init__(self):
        self.spans: list[tuple[int, int, int]] = []  # text, start, end
        self.rows: list[int] = []
        self.columns: list[int] = []
        self.edges: tuple[list, list, list] = ([], [], [])  # node before, node, kind of edge

    def add(self, number: int, text: str) -> None:
        nodes = nodes_of(text)
        by_text: dict[str, int] = {}
        by_form: dict[str, int] = {}
        first = len(self.spans)
        tokens = [text[a:b].strip(".,;:!?\"'") or text[a:b] for a, b in nodes]
        for i, ((start, end), token) in enumerate(zip(nodes, tokens)):
            node = first + i
            beside = i and text[nodes[i - 1][1]: start].strip(EDGES) == ""
            after = i + 1 < len(nodes) and text[end: nodes[i + 1][0]].strip(EDGES) == ""
            own = token_features(token)
            around = [_number(f"before {short_form(tokens[i - 1]) if beside else '-'} {short_form(token)}"), _number(f"after {short_form(tokens[i + 1]) if after else '-'} {short_form(token)}")]
            self.rows += [node] * (len(own) + 2)
            self.columns += own + around
            shape = form(token)
            links = [(node - 1, 0)] if beside else []
            if token in by_text:
                links.append((by_text[token], 1))
            elif shape in by_form:
                links.append((by_form[shape], 2))
            by_text[token] = by_form[shape] = node
            for before, kind in links:
                for values, value in zip(self.edges, (before, node, kind)):
                    values.append(value)
            self.spans.append((number, start, end))

    def arrays(self):
        return np.array(self.rows, np.int64), np.array(self.columns, np.int64), *(np.array(e, np.int64) for e in self.edges)


def labels_of(graph: Graph, bases: dict[int, list]) -> np.ndarray:
    """Per node the kind of the base span it lies in, 0 for none, -1 where a match failed its check."""
    out = np.zeros(len(graph.spans), np.int64)
    for i, (number, start, end) in enumerate(graph.spans):
        for kind, a, b, sound in bases[number]:
            if a < end and start < b:
                if sound:
                    out[i] = kind + 1
                    break
                if kind >= 2 and b - a >= 8:
                    out[i] = -1
    return out


def unary(weights: np.ndarray, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, LABELS))
    for label in range(LABELS):
        out[:, label] = np.bincount(rows, weights=weights[columns, label], minlength=n)
    return out


def fit(graph: Graph, labels: np.ndarray, steps: int = 200, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and of label pairs per kind of edge, by pseudo-likelihood (Adagrad)."""
    rows, columns, left, right, kind = graph.arrays()
    n = len(graph.spans)
    weights, prior = np.zeros((FEATURES, LABELS)), np.array(SHARED)[:, None, None] * np.eye(LABELS)
    pairs = prior.copy()
    known = labels >= 0
    if not known.any():
        weights[:, 0] = 1.0
        return weights, pairs
    truth = np.eye(LABELS)[np.maximum(labels, 0)] * known[:, None]
    both = known[left] & known[right]
    left, right, kind = left[both], right[both], kind[both]
    sums_w, sums_p = np.full_like(weights, 1e-6), np.full_like(pairs, 1e-6)
    for _ in range(steps):
        score = unary(weights, rows, columns, n)
        np.add.at(score, right, pairs[kind, labels[left]])
        np.add.at(score, left, pairs[kind, :, labels[right]])
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        miss = (p * known[:, None] - truth) / known.sum()
        step_w, step_p = PENALTY * weights, PENALTY * (pairs - prior)
        for label in range(LABELS):
            step_w[:, label] += np.bincount(columns, weights=miss[rows, label], minlength=FEATURES)
        np.add.at(step_p, (kind, labels[left]), miss[right])
        np.add.at(step_p.transpose(0, 2, 1), (kind, labels[right]), miss[left])
        sums_w += step_w**2
        sums_p += step_p**2
        weights -= rate * step_w / np.sqrt(sums_w)
        pairs -= rate * step_p / np.sqrt(sums_p)
    return weights, pairs


def beliefs(graph: Graph, weights: np.ndarray, pairs: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of all nodes by loopy belief propagation (sum-product, damped)."""
    rows, columns, left, right, kind = graph.arrays()
    n = len(graph.spans)
    own = unary(weights, rows, columns, n)
    source, target = np.concatenate((left, right)), np.concatenate((right, left))
    potential = np.concatenate((pairs[kind], pairs[kind].transpose(0, 2, 1)))  # [edge, label of source, label of target]
    back = np.concatenate((np.arange(len(left)) + len(left), np.arange(len(left))))
    messages = np.zeros((len(source), LABELS))

    def total():
        out = own.copy()
        for label in range(LABELS):
            out[:, label] += np.bincount(target, weights=messages[:, label], minlength=n)
        return out

    for _ in range(rounds if len(source) else 0):
        without = total()[source] - messages[back]
        joint = without[:, :, None] + potential
        top = joint.max(1, keepdims=True)
        new = np.log(np.exp(joint - top).sum(1)) + top[:, 0]
        new -= new.max(1, keepdims=True)
        messages = 0.5 * messages + 0.5 * new
    score = total()
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def train(docs: DataFrame, sample: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Weights from the `sample` documents with the smallest hash of their id among those with nodes."""
    with_nodes = docs.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS)).select(F.xxhash64("doc_id").alias("h"), "text")
    texts = [r.text for r in with_nodes.orderBy("h", F.xxhash64("text")).limit(sample).collect()]
    graph, bases = Graph(), {}
    for i, text in enumerate(texts):
        graph.add(i, text)
        bases[i] = base_matches(text)
    return fit(graph, labels_of(graph, bases))


def find(texts: list[str | None], weights: np.ndarray, pairs: np.ndarray) -> tuple[list[list], list[list]]:
    """Per text its base spans and its added spans: (kind, start, end), by kind, then start."""
    graph, base = Graph(), [[] for _ in texts]
    for i, text in enumerate(texts):
        if text and NODE.search(text):
            base[i] = [m[:3] for m in base_matches(text) if m[3]]
            graph.add(i, text)
    more = [[] for _ in texts]
    if not graph.spans:
        return base, more
    p = beliefs(graph, weights, pairs)
    label = np.where(p.max(1) >= SURE, p.argmax(1), 0)
    run = None
    for (number, start, end), kind in zip(graph.spans, label.tolist()):
        text = texts[number]
        if run and (not kind or run[0] != number or run[1] != kind or text[run[3]: start].strip(EDGES)):
            _close(run, texts, base, more)
            run = None
        if kind:
            run = [number, kind, run[2] if run else start, end]
    if run:
        _close(run, texts, base, more)
    return base, [sorted(m) for m in more]


def possible(kind: int, text: str) -> bool:
    """Whether a span has what every entity of its kind has: digits in number (and check digit), an at sign, three dots."""
    digits = re.sub(r"[^0-9]", "", text)
    if kind == 0:
        return 0 < text.find("@") < len(text) - 1
    if kind == 1:
        return text.count(".") >= 3 and len(digits) >= 4
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def _close(run: list, texts: list, base: list, more: list) -> None:
    number, kind, start, end = run
    text = texts[number][start:end]
    start, end = start + len(text) - len(text.lstrip("\"'([<")), end - (len(text) - len(text.rstrip(".,;:!?\"')]>")))
    if start < end and possible(kind - 1, texts[number][start:end]) and not any(a < end and start < b for _, a, b in base[number]):
        more[number].append((kind - 1, start, end))


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, ..., base_sha256, spans, n_added for docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches):
        weights, pairs = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                base, more = find(part.column("text").to_pylist(), weights, pairs)
                columns = {"doc_id": part.column("doc_id")}
                for kind, name in enumerate(KINDS):
                    columns[f"n_{name}"] = pa.array([sum(k == kind for k, _, _ in own) for own in base], pa.int64())
                columns["base_sha256"] = pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own in base])
                columns["spans"] = pa.array([joined(sorted([*own, *added])) for own, added in zip(base, more)])
                columns["n_added"] = pa.array([len(added) for added in more], pa.int64())
                yield pa.RecordBatch.from_pydict(columns)

    kinds = ", ".join(f"n_{name} long" for name in KINDS)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {kinds}, base_sha256 string, spans string, n_added long")


def mask(text: str, spans: list) -> str:
    """The text with each span replaced by its kind; overlapping spans as one, named by the first."""
    out, at = [], 0
    for start, end, kind in sorted((start, end, kind) for kind, start, end in spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """docs with the spans in `text` replaced; all other columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.select("doc_id", "text")))

    def run(batches):
        weights, pairs = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                base, more = find(texts, weights, pairs)
                new = [mask(t, [*own, *added]) if own or added else t for t, own, added in zip(texts, base, more)]
                yield part.set_column(part.schema.get_field_index("text"), part.schema.field("text"), pa.array(new, part.schema.field("text").type))

    return docs.mapInArrow(run, docs.schema)


def op5_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
