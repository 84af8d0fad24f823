"""Personal data: fixed patterns, and a skip-chain conditional random field that carries their labels to like tokens.

The patterns find the base spans (email, ip, card, phone). The field's nodes are the tokens with a digit or an at sign,
all others being O for certain. Neighbouring tokens are joined in a chain; tokens of the same core, or of the same last
digits, are joined however far apart, each to the next one, so a document has no more edges than twice its tokens.
Tokens inside base spans have their label; loopy message passing gives the others' beliefs, so a number that the
document elsewhere shows in full is found where it is written without its country code. Runs of tokens of one believed
label that meet no base span are added as spans. Base spans always stay.

Weights are learned here, by pseudo-likelihood, from a bounded sample of the documents, the base spans as labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.llm.common import small_batches, with_columns_of

KINDS = ("email", "ip", "card", "phone")
#: Documents, and tokens, that the weights are learned from at most.
TRAIN_DOCUMENTS, TRAIN_TOKENS = 5_000, 100_000
#: Belief from which a token gets a label that the patterns did not give it.
BELIEF = 0.95
ROUNDS = 12
#: Remainders that the sample is drawn by.
_SPLIT = 1 << 50

# The patterns' fixed forms, written so that no text takes them more than linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SOME = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EDGE = ".,;:!?\"'#*$&%|<>[]{}=~`"

Span = tuple[int, int, str]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end(), "email"
            done = m.end()


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap, failing ones dropped; by start, then kind."""
    found = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def tokens(text: str) -> list[tuple[int, int]]:
    """Places of the runs without white space that have a digit or an at sign, edge marks stripped."""
    out, at = [], 0
    while m := _SOME.search(text, at):
        start, end = m.start(), m.end()
        while start > at and not text[start - 1].isspace():
            start -= 1
        n = len(text)
        while end < n and not text[end].isspace():
            end += 1
        at = end
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        while start < end and text[start] in _EDGE:
            start += 1
        if start < end:
            out.append((start, end))
    return out


FEATURES = 22


def _features(token: str) -> list[int]:
    digits = _NOT_DIGIT.sub("", token)
    n, dots = len(digits), token.count(".")
    letters = sum(c.isalpha() for c in token)
    plain = not letters and "@" not in token
    parts = token.split(".")
    return [
        1, "@" in token and "." in token.partition("@")[2], "@" in token, n == 0, 1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 8, 9 <= n <= 11, 12 <= n <= 19, n >= 20,
        plain and dots == 3 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts), plain and dots == 3, 1 <= dots <= 2, token[0] == "+", token[0] == "(",
        plain and "-" in token, letters > 0, 0 < letters and len(token) >= 16 and "@" not in token, plain and 12 <= n <= 19 and luhn(digits), token.isascii() and token.isdigit(), len(token) > 24, letters > n,
    ]


def _core(token: str) -> list[tuple[str, str]]:
    """Names under which a token meets its like: its text, and its last digits if these are many."""
    digits = _NOT_DIGIT.sub("", token)
    names = [("text", token.casefold())]
    if len(digits) >= 7 and not any(c.isalpha() for c in token):
        names.append(("digits", digits[-7:]))
    return names


class Graph:
    """Nodes and edges of many documents side by side."""

    def __init__(self) -> None:
        self.places: list[tuple[int, int, int]] = []  # document, start, end
        self.features: list[list[int]] = []
        self.labels: list[int] = []  # 0 is O
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, doc: int, text: str, base: list[Span]) -> None:
        found = tokens(text)
        first, last_of, at = len(self.places), {}, 0
        for i, (start, end) in enumerate(found, first):
            token = text[start:end]
            while at < len(base) and base[at][1] <= start:
                at += 1
            label = next((1 + KINDS.index(k) for s, e, k in base[at : at + 4] if s < end and e > start), 0)
            self.places.append((doc, start, end))
            self.features.append(_features(token))
            self.labels.append(label)
            if i > first and self.places[i - 1][2] + 1 >= start:
                self.chain.append((i - 1, i))
            for name in _core(token):
                before = last_of.get(name)
                if before is not None and (not self.skip or self.skip[-1] != (before, i)):
                    self.skip.append((before, i))
                last_of[name] = i


def _edges(pairs: list[tuple[int, int]]) -> np.ndarray:
    return np.array(pairs, np.int64).reshape(-1, 2)


class Field:
    """The weights: of a token's features for each label, and of two joined tokens' labels."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    @classmethod
    def learned(cls, x: np.ndarray, y: np.ndarray, steps: int = 300) -> Field:
        """x: features, then for each label the numbers of neighbours before, after, and of its like that have it.

        Pseudo-likelihood: each label given the neighbours' true ones, which is a softmax of linear scores.
        """
        k = len(KINDS) + 1
        w = np.zeros((x.shape[1], k))
        m, v = np.zeros_like(w), np.zeros_like(w)
        onehot = np.eye(k)[y]
        weight = (1 / np.maximum(onehot.sum(0), 1))[y]  # labels count alike
        weight /= max(weight.sum(), 1e-9)
        for t in range(1, steps + 1 if len(x) else 1):
            s = x @ w
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.T @ ((p - onehot) * weight[:, None]) + 1e-3 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        before, after, like = w[FEATURES : FEATURES + k], w[FEATURES + k : FEATURES + 2 * k], w[FEATURES + 2 * k :]
        return cls(w[:FEATURES], (before + after.T) / 2, (like + like.T) / 2)

    def beliefs(self, graph: Graph) -> np.ndarray:
        """Of each node the probability of each label, by loopy message passing with the base labels held."""
        y = np.array(graph.labels, np.int64)
        u = np.array(graph.features, float).reshape(-1, FEATURES) @ self.unary
        held = y > 0
        u[held] = np.where(np.eye(u.shape[1])[y[held]] > 0, 0.0, -1e3)
        chain, skip = _edges(graph.chain), _edges(graph.skip)
        a = np.concatenate([chain[:, 0], skip[:, 0]])
        b = np.concatenate([chain[:, 1], skip[:, 1]])
        kind = np.concatenate([np.zeros(len(chain), int), np.ones(len(skip), int)])
        forth = np.stack([self.chain, self.skip])[kind]  # label of a, label of b
        n = len(a)
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        potential = np.concatenate([forth, forth.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        message = np.zeros((2 * n, u.shape[1]))
        for _ in range(ROUNDS if n else 0):
            total = u.copy()
            np.add.at(total, target, message)
            s = (total[source] - message[back])[:, :, None] + potential
            top = s.max(1, keepdims=True)
            new = (top + np.log(np.exp(s - top).sum(1, keepdims=True)))[:, 0]
            new -= new.max(1, keepdims=True)
            message = (message + new) / 2
        np.add.at(u, target, message)
        p = np.exp(u - u.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _training_rows(graph: Graph) -> np.ndarray:
    k, n = len(KINDS) + 1, len(graph.labels)
    y = np.array(graph.labels, np.int64)
    extra = np.zeros((n, 3 * k), np.int64)
    chain, skip = _edges(graph.chain), _edges(graph.skip)
    np.add.at(extra, (chain[:, 1], y[chain[:, 0]]), 1)
    np.add.at(extra, (chain[:, 0], k + y[chain[:, 1]]), 1)
    np.add.at(extra, (skip[:, 1], 2 * k + y[skip[:, 0]]), 1)
    np.add.at(extra, (skip[:, 0], 2 * k + y[skip[:, 1]]), 1)
    return np.concatenate([np.array(graph.features, np.int64).reshape(-1, FEATURES), extra, y[:, None]], 1)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        graph, names = Graph(), batch.column(0).to_pylist()
        for i, text in enumerate(batch.column(1).to_pylist()):
            if _SOME.search(text):
                graph.add(i, text, base_spans(text))
        if graph.labels:
            at = [names[doc] for doc, _, _ in graph.places], [start for _, start, _ in graph.places]
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in at], pa.array(_training_rows(graph).tolist(), pa.list_(pa.int64()))], names=["name", "start", "row"])


def train(docs: DataFrame) -> Field:
    """Learns from about TRAIN_DOCUMENTS documents, by hash of all there are, and the first TRAIN_TOKENS tokens by that hash.

    Which these are depends on the documents alone, not on how they are dealt.
    """
    count = docs.count()
    share = math.ceil(min(1.0, TRAIN_DOCUMENTS / max(count, 1)) * _SPLIT)
    named = docs.filter("text is not null").withColumn("name", F.xxhash64("doc_id", "text"))
    drawn = named.filter(F.pmod("name", F.lit(_SPLIT)) < share).select("name", "text")
    rows = drawn.mapInArrow(_sampled, "name long, start long, row array<long>").orderBy("name", "start").limit(TRAIN_TOKENS).toPandas()["row"]
    data = np.array(rows.tolist(), np.int64).reshape(-1, FEATURES + 3 * (len(KINDS) + 1) + 1)
    return Field.learned(data[:, :-1].astype(float), data[:, -1])


def added_spans(graph: Graph, beliefs: np.ndarray, base: dict[int, list[Span]]) -> dict[int, list[Span]]:
    """Runs of joined tokens of one label, none of them in a base span."""
    best = beliefs.argmax(1)
    sure = (best > 0) & (beliefs.max(1) >= BELIEF) & (np.array(graph.labels) == 0)
    joined = {b for _, b in graph.chain}
    out: dict[int, list[Span]] = {}
    for i in np.flatnonzero(sure):
        doc, start, end = graph.places[i]
        kind, own = KINDS[best[i] - 1], out.setdefault(doc, [])
        if own and i in joined and sure[i - 1] and own[-1][2] == kind and own[-1][1] == graph.places[i - 1][2]:
            own[-1] = (own[-1][0], end, kind)
        else:
            own.append((start, end, kind))
    return {d: [s for s in own if not any(a < s[1] and b > s[0] for a, b, _ in base.get(d, ()))] for d, own in out.items()}


def spans_of(texts: list[str | None], field: Field) -> list[list[tuple[str, int, int, bool]]]:
    """Of each text its spans (kind, start, end, base) by start, then kind."""
    graph, base = Graph(), {}
    for i, text in enumerate(texts):
        if text and _SOME.search(text):
            base[i] = base_spans(text)
            graph.add(i, text, base[i])
    more = added_spans(graph, field.beliefs(graph), base) if graph.labels else {}
    out = []
    for i in range(len(texts)):
        both = [(s, e, k, True) for s, e, k in base.get(i, ())] + [(s, e, k, False) for s, e, k in more.get(i, ())]
        out.append([(k, s, e, b) for s, e, k, b in sorted(both, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))])
    return out


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _span_array(found: list) -> pa.Array:
    return pa.array([[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in spans] for spans in found], _SPAN_ARROW)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, pii) of every row of docs (doc_id, text): the spans, in code points, ends exclusive.

    A null or empty text has none. Every row, repeated or with a null doc_id, is searched for itself; an empty table
    has no rows. Other columns are not read. Long texts are searched whole, in linear time.
    """
    small_batches(docs.sparkSession)
    rows = with_columns_of(docs, doc_id=T.LongType(), text=T.StringType())
    shared = docs.sparkSession.sparkContext.broadcast(train(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _span_array(spans_of(batch.column(1).to_pylist(), shared.value))], names=["doc_id", "pii"])

    return rows.mapInArrow(run, f"doc_id long, pii {SPANS}")


def written_spans(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each span, or run of overlapping ones, as <KIND> of its first."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with the personal data in text masked and n_chars, if there, set to the new length; other columns stay."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(with_columns_of(docs, doc_id=T.LongType(), text=T.StringType())))
    at, schema = docs.schema.names.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            clean = [t if t is None else redacted(t, s) for t, s in zip(texts, spans_of(texts, shared.value), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
