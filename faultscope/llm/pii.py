"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field labels further candidates: groups of digits, spelt-out
addresses, and words equal to the local part of an address. Its nodes are all candidates of a document
in text order, base spans among them with their label given. Neighbours are joined by chain factors;
each candidate is also joined to the last one before it with the same or a similar value (equal
digits without country code, equal local part), however far back, and to the first base span of that
value, by skip factors. Loopy message passing lets labels agree over all repeated or similar mentions;
a group of any size has at most two skip factors for each mention.

Factors are learned from the documents themselves: label frequencies by shape, and how often labels
agree along chain and skip edges whose both ends are base spans."""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import whole_texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
# Matches of these begin where a run of digits begins, and take whole runs, so no start is tried twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GROUP = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ().-]{0,3}[0-9])++(?![0-9A-Za-z])")
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{2,64}) ?(?:\(at\)|\[at\]|<at>) ?([A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}){1,8})")
_WORD = re.compile(r"[A-Za-z0-9._%+-]+")
PRIOR_SAME, PRIOR_OTHER, LIMIT, ROUNDS, DAMPING = 20.0, 1.0, 2.5, 30, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:] or 0) <= 255 for p in text.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the run of local characters before an @ belongs to it, back to the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if _octets(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass
class Node:
    start: int
    end: int
    shape: str
    key: str
    label: int | None


def _digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _shape(text: str, digits: str) -> str:
    """Number of digits, marks between them, and whether the number is valid where that can be told."""
    marks = "".join(sorted({c for c in text if not c.isdigit()}))
    valid = _octets(text) if marks == "." and text.count(".") == 3 else luhn(digits) if len(digits) > 11 else "-"
    return f"d{len(digits)}|{marks}|{valid}"


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[Node]:
    """Nodes in text order. Candidates that touch a base span are left to it."""
    nodes = []
    for a, b, kind in base:
        value = text[a:b]
        if kind == "email":
            nodes.append(Node(a, b, "address", "@" + value.split("@")[0].casefold(), 1))
        else:
            digits = _digits_of(value)
            nodes.append(Node(a, b, _shape(value, digits), digits[-10:] if kind == "phone" else value if kind == "ip" else digits, KINDS.index(kind) + 1))
    taken = [(a, b) for a, b, _ in base]

    def free(a: int, b: int) -> bool:
        return all(b <= x or y <= a for x, y in taken)

    if _DIGIT.search(text):
        for m in _GROUP.finditer(text):
            digits = _digits_of(m[0])
            if 7 <= len(digits) <= 19 and free(*m.span()):
                quad = m[0].count(".") == 3 and len(m[0]) == len(digits) + 3
                nodes.append(Node(*m.span(), _shape(m[0], digits), m[0] if quad else digits[-10:] if len(digits) <= 11 else digits, None))
    if "at" in text and ("(at)" in text or "[at]" in text or "<at>" in text):
        nodes += [Node(*m.span(), "spelt", "@" + m[1].casefold(), None) for m in _SPELT.finditer(text) if free(*m.span())]
    names = {n.key[1:] for n in nodes if n.shape == "address" and len(n.key) > 4 and not n.key[1:].isalpha()}
    if names:
        for m in _WORD.finditer(text):
            word = m[0].rstrip(".").casefold()
            if word in names and free(m.start(), m.start() + len(word)):
                nodes.append(Node(m.start(), m.start() + len(word), "local", "@" + word, None))
    nodes.sort(key=lambda n: (n.start, n.end))
    return nodes


def edges_of(nodes: list[Node]) -> list[tuple[int, int, str]]:
    out = [(i, i + 1, "chain") for i in range(len(nodes) - 1)]
    last: dict[str, int] = {}
    given: dict[str, int] = {}
    for i, node in enumerate(nodes):
        if node.label is not None:
            given.setdefault(node.key, i)
    for i, node in enumerate(nodes):
        joined = {last.get(node.key), given.get(node.key) if node.label is None else None} - {None, i}
        out += [(min(i, j), max(i, j), "skip") for j in joined]
        last[node.key] = i
    return out


def observed(text: str) -> Counter:
    """What a document adds to the counts that factors are learned from."""
    out: Counter = Counter()
    nodes = candidates(text, base_spans(text))
    for n in nodes:
        out["shape", n.shape, n.label or 0] += 1
    for i, j, kind in edges_of(nodes):
        if nodes[i].label and nodes[j].label:
            out["edge", kind, int(nodes[i].label == nodes[j].label)] += 1
    return out


def factors(counts: list[tuple[str, str, int, int]]) -> dict:
    """Log factors: ``shapes`` by shape and label (within a limit, so that a mention's own shape does not
    outweigh an equal value elsewhere), ``chain`` and ``skip`` for agreement."""
    shapes: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(LABELS))
    same = {"chain": [PRIOR_OTHER, PRIOR_OTHER], "skip": [PRIOR_OTHER, PRIOR_SAME]}
    for group, name, value, n in counts:
        if group == "shape":
            shapes[name][value] += n
        else:
            same[name][value] += n
    unary = {}
    for name, n in shapes.items():
        total = sum(n) + 0.5 * len(LABELS)
        logs = [math.log((x + 0.5) / total) for x in n]
        unary[name] = [max(-LIMIT, min(LIMIT, 0.5 * (x - logs[0]))) for x in logs]
    chain, skip = (math.log(same[k][1] / same[k][0]) for k in ("chain", "skip"))
    return {"shapes": unary, "chain": max(-0.25, min(0.25, chain)), "skip": max(2 * LIMIT, skip)}


def infer(nodes: list[Node], model: dict) -> np.ndarray:
    """Label probabilities of all nodes by damped sum-product message passing on the whole document."""
    n, k = len(nodes), len(LABELS)
    unary = np.zeros((n, k))
    for i, node in enumerate(nodes):
        if node.label is None:
            unary[i] = model["shapes"].get(node.shape, [0.0] + [-LIMIT] * (k - 1))
        else:
            unary[i] = -50.0
            unary[i, node.label] = 0.0
    links = edges_of(nodes)
    if not links:
        return _softmax(unary)
    a = np.array([e[0] for e in links] + [e[1] for e in links])
    b = np.array([e[1] for e in links] + [e[0] for e in links])
    back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
    agree = np.tile(np.exp([model[e[2]] for e in links]), 2)[:, None]
    messages = np.zeros((len(a), k))
    for _ in range(max(ROUNDS, 2 * math.isqrt(n))):
        belief = unary.copy()
        np.add.at(belief, b, messages)
        out = np.exp(_centred(belief[a] - messages[back]))
        new = _centred(np.log(out.sum(axis=1, keepdims=True) + (agree - 1) * out))
        change = np.abs(new - messages).max()
        messages = DAMPING * messages + (1 - DAMPING) * new
        if change < 1e-4:
            break
    np.add.at(unary, b, messages)
    return _softmax(unary)


def _centred(x: np.ndarray) -> np.ndarray:
    return x - x.max(axis=1, keepdims=True)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(_centred(x))
    return e / e.sum(axis=1, keepdims=True)


def all_spans(text: str, base: list[tuple[int, int, str]], model: dict) -> list[tuple[int, int, str]]:
    """Base spans and those that the field adds where some kind is likelier than none."""
    if not base:
        return base  # labels spread from base spans only
    nodes = candidates(text, base)
    if all(n.label for n in nodes):
        return base
    found, added = infer(nodes, model), []
    for node, p in zip(nodes, found, strict=True):
        if node.label is None and p[1:].max() > p[0]:
            added.append((node.start, node.end, KINDS[int(p[1:].argmax())]))
    return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def learn(docs: DataFrame) -> dict:
    """Factors from the counts of all documents: one row for each shape and label reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                if "@" in text or _DIGIT.search(text):
                    total += observed(text)
        rows = [(*k, v) for k, v in total.items()]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["grp", "name", "value", "n"])

    counts = docs.select("text").mapInArrow(count, "grp string, name string, value int, n bigint").groupBy("grp", "name", "value").agg(F.sum("n").alias("n"))
    return factors([tuple(r) for r in counts.collect()])


SPANS = "array<struct<start:bigint,stop:bigint,kind:string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``text``, the ``base`` spans and all ``spans``: start, stop (exclusive), kind.

    Offsets are code points. Null texts are empty and have no spans. Rows are independent, repeated
    or not; ids may be null; an empty table gives no rows. Spans of different kinds may overlap."""
    docs = whole_texts(docs, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            base, every = [], []
            for t in batch["text"].to_pylist():
                found = base_spans(t)
                base.append([{"start": a, "stop": b, "kind": k} for a, b, k in found])
                every.append([{"start": a, "stop": b, "kind": k} for a, b, k in all_spans(t, found, model)] if found else [])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array(base, _SPANS), pa.array(every, _SPANS)], names=["doc_id", "text", "base", "spans"])

    return docs.mapInArrow(find, f"doc_id bigint, text string, base {SPANS}, spans {SPANS}")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span, or overlapping spans together, replaced by the first one's kind."""
    out, end = [], 0
    for a, b, kind in spans:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; null texts stay null, all other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(json.dumps(learn(docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")))))

    @F.pandas_udf("string")
    def clean(texts):
        model = json.loads(shared.value)
        return texts.map(lambda t: redact(t, all_spans(t, base_spans(t), model)), na_action="ignore")

    return docs.withColumn(text, clean(F.col(f"`{text}`")))
