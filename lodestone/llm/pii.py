"""Personal data by patterns and a skip-chain conditional random field.

Base spans: e-mail, IP, card and phone patterns, leftmost and non-overlapping per
kind, each kept if it passes its check (parts up to 255, Luhn, digit counts).

The field then adds spans that the patterns alone miss. Its nodes are a document's
tokens with an ASCII digit or an @. Node potentials come from the token's shape; chain
potentials join neighbouring nodes, one table each for nodes side by side, with one or
two words between them, and with up to eight. Nodes that repeat each other (the same
digits, however written, or the same last seven, or the same address) are all linked to
one shared node by a skip potential, and so are, by a weaker one, nodes that are similar:
with one half of at least ten digits in common (as after one wrong digit), or with the
same name before the @. A document's graph so has a few links a node, and
every occurrence is two links from every other. Nodes in base spans are clamped, and so
is a shared node whose clamped occurrences all have one kind. Loopy sum-product message
passing runs until the messages settle and makes the labels of one document agree. A
run of nodes of one kind with a marginal over ``CERTAIN`` and outside base spans
becomes an added span.

The weights are fitted by pseudo-likelihood to a bounded sample of documents
(``SAMPLE_DOCS``), read whole. Labelled are nodes in base spans, nodes that a pattern
matched alone and whose check failed (O), and nodes with few digits (O); all others are
open: nothing is learned from them as a label, so the field does not learn that what the
patterns miss is nothing. Equal rows of the sample are counted on the executors.

Null texts count as empty. Digits are ASCII digits; others are letters like any. Offsets
are code points, ends exclusive. Rows that repeat an id get a result each, rows without
one too; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

KINDS = ("email", "ip", "card", "phone")
CERTAIN = 0.9
#: Messages have settled when an undamped update changes none by more; every ``ROUNDS`` rounds
#: without that the damping doubles, at most ``HALVINGS`` times: then a document has not settled.
SETTLED = 1e-4
ROUNDS, HALVINGS = 100, 8
SAMPLE_DOCS = 2000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9.]{7,}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_OTHER = re.compile(r"[^0-9]+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_RUN = re.compile(r"\S+")

Span = tuple[int, int, int]  # start, kind, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern's leftmost matches, found from each @ outwards in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at)  # a run before this @ cannot reach over it
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[tuple[int, int, bool]]:
    """Four dotted numbers and whether they pass; runs of digits and dots are walked part by part."""
    for run in _DOTTED.finditer(text):
        parts, at, places = run[0].split("."), run.start(), []
        for p in parts:
            places.append(at)
            at += len(p) + 1
        n = 0
        while n + 3 < len(parts):
            if all(parts[n : n + 4]):
                yield places[n], places[n + 3] + len(parts[n + 3]), all(_byte(p) for p in parts[n : n + 4])
                n += 4
            else:
                n += 1


def _byte(digits: str) -> bool:
    core = digits.lstrip("0")
    return len(core) <= 3 and int(core or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if n % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if 14 <= m.end() - m.start() < 64 else ""
        yield m.start(), m.end(), 14 <= len(digits) <= 19 and luhn(digits)


def phones(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _PHONE.finditer(text):
        yield m.start(), m.end(), 10 <= len(_digits(m[0])) <= 15


def matches(text: str) -> tuple[list[Span], list[Span]]:
    """(start, kind, end) of all pattern matches: those that pass, sorted, and the others."""
    if not _HINT.search(text):
        return [], []
    passed, failed = [(a, 0, z) for a, z in emails(text)], []
    for k, find in enumerate((ips, cards, phones), 1):
        for a, z, ok in find(text):
            (passed if ok else failed).append((a, k, z))
    return sorted(passed), failed


def base_spans(text: str) -> list[Span]:
    return matches(text)[0]


def _digits(token: str) -> str:
    return _OTHER.sub("", token)


# -- the field ---------------------------------------------------------------

LABELS = len(KINDS) + 1  # 0 is O, kinds follow
_EDGE = ".,;:!?()[]{}<>\"'|*#$%&"
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
#: Words between two nodes up to which each chain table reaches.
GAPS = (0, 2, 8)
#: Skip links: between equal tokens, between similar ones.
LINKS = 2


def shape(token: str) -> list[float]:
    digits, core = _digits(token), token.strip(_EDGE)
    n, letters = len(digits), any(c.isalpha() for c in token)
    quads = _QUAD.fullmatch(core) is not None
    return [
        1.0, "@" in token, "@" in token and "." in token.rpartition("@")[2], n <= 2, 3 <= n <= 4, 5 <= n <= 9, 10 <= n <= 13, 14 <= n <= 19, n > 19,
        token.startswith("+"), "(" in token, "-" in token, letters, quads, quads and all(map(_byte, core.split("."))), core == digits != "", 14 <= n <= 19 and luhn(digits),
    ]


SHAPES = len(shape(""))


def _keys(token: str) -> tuple[str | None, list[str]]:
    """What equal tokens share, and what similar ones do."""
    digits, core = _digits(token), token.strip(_EDGE).lower()
    if "@" in core:
        name = core.partition("@")[0]
        return f"t{core}", [f"n{name}"] if len(name) >= 4 else []
    if len(digits) < 5:
        return None, []
    half = len(digits) // 2
    return f"d{digits[-7:]}", [f"l{len(digits)}:{digits[:half]}", f"r{len(digits)}:{digits[half:]}"] if len(digits) >= 10 else []


class Graph:
    """A document's nodes, their shapes, known labels (-1: open), and links: ``chain``
    (node, table) from a node to the next one, ``groups`` of equal tokens and of similar."""

    def __init__(self, text: str, base: list[Span]):
        found = [(m.start(), m.end(), m[0]) for m in _RUN.finditer(text) if _HINT.search(m[0])]
        self.tokens = [t for _, _, t in found]
        self.spans = [(a, z) for a, z, _ in found]
        self.shapes = np.array([shape(t) for t in self.tokens], float).reshape(len(found), SHAPES)
        self.known = np.full(len(found), -1)
        for start, kind, end in base:
            for n in self._within(start, end):
                self.known[n] = kind + 1
        self.chain = []
        for n in range(len(found) - 1):
            words = sum(1 for _ in islice(_RUN.finditer(text, self.spans[n][1], self.spans[n + 1][0]), GAPS[-1] + 1))
            if words <= GAPS[-1]:
                self.chain.append((n, next(g for g, most in enumerate(GAPS) if words <= most)))
        equal: dict[str, list[int]] = {}
        alike: dict[str, dict[str, list[int]]] = {}
        for n, token in enumerate(self.tokens):
            key, others = _keys(token)
            if key:
                equal.setdefault(key, []).append(n)
                for k in others:
                    alike.setdefault(k, {}).setdefault(key, []).append(n)
        # similar tokens that are all equal have their link already
        self.groups = [[g for g in equal.values() if len(g) > 1], [[n for g in of.values() for n in g] for of in alike.values() if len(of) > 1]]

    def _within(self, start: int, end: int) -> Iterator[int]:
        """Nodes that overlap a span."""
        for n in range(bisect_right(self.spans, start, key=lambda s: s[1]), len(self.spans)):
            if self.spans[n][0] >= end:
                return
            yield n

    def labels(self, failed: list[Span]) -> np.ndarray:
        """Labels to learn from: the known ones and O as the module says; -1 for open nodes."""
        y = self.known.copy()
        y[(y < 0) & (self.shapes[:, 3:5].any(axis=1)) & (self.shapes[:, 1] == 0)] = 0
        for start, _, end in failed:
            inside = list(islice(self._within(start, end), 2))
            if len(inside) == 1 and y[inside[0]] < 0:
                y[inside[0]] = 0
        return y


class Field:
    """Weights: ``unary`` (shape, label), ``chain`` (gap, label, label) and ``skip`` >= 0
    for equal and for similar tokens."""

    def __init__(self) -> None:
        self.unary = np.zeros((SHAPES, LABELS))
        self.chain = np.zeros((len(GAPS), LABELS, LABELS))
        self.skip = np.array([5.0, 1.0])

    def fit(self, rows: np.ndarray, weight: np.ndarray, steps: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> None:
        """Pseudo-likelihood: each node's label given its neighbours' labels. ``rows`` as
        :func:`training_rows` makes them, ``weight`` how often each occurs."""
        cut = np.cumsum([SHAPES, 1, len(GAPS) * LABELS, len(GAPS) * LABELS])
        x, y, before, after, peers = np.split(rows.astype(float), cut, axis=1)
        before, after, peers = (v.reshape(len(rows), -1, LABELS) for v in (before, after, peers))
        hot, share = np.eye(LABELS)[y[:, 0].astype(int)], (weight / weight.sum())[:, None]
        for _ in range(steps):
            z = x @ self.unary + np.einsum("ngl,glm->nm", before, self.chain) + np.einsum("ngm,glm->nl", after, self.chain) + np.einsum("k,nkl->nl", self.skip, peers)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = share * (hot - e / e.sum(axis=1, keepdims=True))
            self.unary += rate * (x.T @ g - ridge * self.unary)
            self.chain += rate * (np.einsum("ngl,nm->glm", before, g) + np.einsum("nl,ngm->glm", g, after) - ridge * self.chain)
            self.skip = np.maximum(0.0, self.skip + rate * np.einsum("nl,nkl->k", g, peers))

    def marginals(self, g: Graph) -> np.ndarray:
        """Loopy sum-product in the log domain, all messages at once, damped by half at
        first; a shared node per group follows the document's own nodes."""
        n, groups = len(g.known), [(k, group) for k, of in enumerate(g.groups) for group in of]
        node = np.concatenate([g.shapes @ self.unary, np.zeros((len(groups), LABELS))])
        kinds = [set(g.known[m].tolist()) - {-1} for _, m in groups]
        known = np.concatenate([g.known, np.array([k.pop() if len(k) == 1 else -1 for k in kinds], int)])
        fixed = known >= 0
        node[fixed] = -50.0
        node[fixed, known[fixed]] = 50.0
        a = np.array([*(m for m, _ in g.chain), *(m for _, group in groups for m in group)], int)
        b = np.array([*(m + 1 for m, _ in g.chain), *(n + k for k, (_, group) in enumerate(groups) for _ in group)], int)
        pull = self.skip[np.array([k for k, group in groups for _ in group], int)]
        tables = np.concatenate([self.chain[np.array([t for _, t in g.chain], int)], pull[:, None, None] * np.eye(LABELS)])
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        sent, step, rounds, moved = np.zeros((len(src), LABELS)), 0.5, 0, np.inf
        while len(src) and moved > SETTLED:
            belief = node.copy()
            np.add.at(belief, dst, sent)
            z = (belief[src] - sent[back])[:, :, None] + tables
            top = z.max(axis=1)
            new = top + np.log(np.exp(z - top[:, None, :]).sum(axis=1))
            change = new - new.max(axis=1, keepdims=True) - sent
            sent, moved, rounds = sent + step * change, np.abs(change).max(), rounds + 1
            if rounds == ROUNDS * (HALVINGS + 1):
                break
            if rounds % ROUNDS == 0:
                step /= 2
        g.settled = not len(src) or bool(moved <= SETTLED)
        belief = node.copy()
        np.add.at(belief, dst, sent)
        belief = belief[:n]
        e = np.exp(belief - belief.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def added_spans(self, text: str, base: list[Span], certain: float = CERTAIN) -> tuple[list[Span], bool]:
        """The spans, and whether the document's messages have settled."""
        if not _HINT.search(text):
            return [], True
        g = Graph(text, base)
        if not (g.known < 0).any():
            return [], True
        p = self.marginals(g)
        label = np.where((g.known < 0) & (p.max(axis=1) >= certain), p.argmax(axis=1), 0)
        beside, out = {n for n, gap in g.chain if gap == 0}, []
        for n in np.flatnonzero(label).tolist():
            kind = int(label[n]) - 1
            if n - 1 in beside and label[n - 1] == label[n] and not (_whole(kind, g.tokens[n]) and _whole(kind, g.tokens[n - 1])):
                out[-1] = (out[-1][0], kind, g.spans[n][1])
            else:
                out.append((g.spans[n][0], kind, g.spans[n][1]))
        # punctuation around a token is no part of it
        trimmed = []
        for a, k, z in out:
            while a < z and text[a] in _EDGE.replace("(", ""):
                a += 1
            while a < z and text[z - 1] in _EDGE.replace(")", ""):
                z -= 1
            trimmed.append((a, k, z))
        return trimmed, g.settled


def _whole(kind: int, token: str) -> bool:
    """Whether a token is all of one item of its kind."""
    n = len(_digits(token))
    return ("@" in token, _QUAD.fullmatch(token.strip(_EDGE)) is not None, 14 <= n <= 19, 10 <= n <= 15)[kind]


#: Columns of a training row: shape, label, and one-hot labels of the node before and the
#: one behind by gap, and of equal and similar tokens.
ROW = SHAPES + 1 + (2 * len(GAPS) + LINKS) * LABELS


def training_rows(text: str) -> np.ndarray:
    """A row of small integers for each labelled node of a text."""
    base, failed = matches(text)
    g = Graph(text, base)
    y, n = g.labels(failed), len(g.known)
    before, after, peers = (np.zeros((n, k, LABELS), np.uint8) for k in (len(GAPS), len(GAPS), LINKS))
    for m, gap in g.chain:
        if y[m] >= 0:
            before[m + 1, gap, y[m]] = 1
        if y[m + 1] >= 0:
            after[m, gap, y[m + 1]] = 1
    for k, groups in enumerate(g.groups):
        for group in groups:
            labels = np.bincount(y[group][y[group] >= 0], minlength=LABELS)
            for m in group:  # the labels of the others
                peers[m, k] |= (labels - (np.arange(LABELS) == y[m])) > 0
    rows = np.concatenate([g.shapes.astype(np.uint8), np.maximum(y, 0)[:, None].astype(np.uint8), *(v.reshape(n, v.shape[1] * LABELS) for v in (before, after, peers))], axis=1)
    return rows[y >= 0]


def fit_field(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Field:
    """Fit the weights to a sample of about ``sample_docs`` documents with a digit or an
    @, chosen by a hash of id and text, all of each read. Only distinct training rows and
    their numbers reach the driver."""
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`"), F.lit("pii")).alias("key")).filter(F.col("text").rlike("[0-9@]"))
    share = min(1.0, sample_docs / max(rows.count(), 1))
    rows = rows.filter(F.pmod("key", F.lit(1 << 30)) < int((1 << 30) * share)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                distinct, counts = np.unique(np.concatenate([training_rows(t) for t in b.column(0).to_pylist()]), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in distinct], pa.binary()), pa.array(counts)], names=["row", "n"])

    got = sorted((bytes(r.row), r.n) for r in map_arrow(rows, run, "row binary, n bigint").groupBy("row").agg(F.sum("n").alias("n")).collect())
    field = Field()
    if got:
        field.fit(np.frombuffer(b"".join(r for r, _ in got), np.uint8).reshape(-1, ROW), np.array([n for _, n in got], float))
    return field


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))


def find_pii(docs: DataFrame, field: Field, text: str = "text", doc_id: str = "doc_id", certain: float = CERTAIN) -> DataFrame:
    """One row per document: doc_id, base and added, both arrays of (start, kind, end)
    with kind the place in KINDS, and whether its messages have settled."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            out: list[list] = [[], []]
            settled = []
            for t in b.column(1).to_pylist():
                base = base_spans(t)
                added, still = field.added_spans(t, base, certain)
                settled.append(still)
                for column, spans in zip(out, (base, added), strict=True):
                    column.append([{"start": a, "kind": k, "end": z} for a, k, z in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, item) for c in out), pa.array(settled, pa.bool_())], names=["doc_id", "base", "added", "settled"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    span = "array<struct<start:int,kind:int,end:int>>"
    return map_arrow(rows, run, f"doc_id {kind}, base {span}, added {span}, settled boolean")


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans per kind, base_sha256 and spans (text)."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(col: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(col), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), "settled")
