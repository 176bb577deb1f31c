"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased; words of letters with one blank around them give n-grams of one to three characters,
hashed to ``BUCKETS`` features. Document frequencies are counted over all documents that may be learned from:
tasks add up counts of fixed size, which meet in two rounds of sums. Weights are learned by
follow-the-regularised-leader with an elastic net, one example after another, on a bounded sample
with as many documents of each language (``SAMPLE_ROWS`` in all), and a temperature is then fitted
on a fifth of the sample that the weights have not seen. Every document is scored with its whole text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.llm.words import mix
from faultscope.session import materialize

BUCKETS = 1 << 15
#: Lengths of n-grams and the odd factor that hashes each.
WIDTHS = {1: 0x9E3779B97F4A7C15, 2: 0xBF58476D1CE4E5B9, 3: 0x94D049BB133111EB}
#: Documents that weights and temperature are learned from, over all languages.
SAMPLE_ROWS = 8_000
PASSES, ALPHA, BETA, L1, L2 = 2, 0.5, 1.0, 1e-4, 1e-4
UNKNOWN = "und"
#: Characters that one step takes; a longer text is counted in several.
_STEP = 1 << 20
_BLOCK = 1 << 12
COUNTS = "block int, lot int, counts binary"
_COUNTS = pa.schema([("block", pa.int32()), ("lot", pa.int32()), ("counts", pa.binary())])
VECTOR = "doc_id bigint, lang string, indices binary, values binary"
_VECTOR = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("indices", pa.binary()), ("values", pa.binary())])


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null id is one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


@cache
def _letters() -> np.ndarray:
    """Per code point its lower-case letter, 0 for what is no letter."""
    return np.array([ord(c.lower()[0]) if (c := chr(i)).isalpha() else 0 for i in range(0x110000)], dtype=np.uint32)


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters of a text; what stands before, between and after words is one 0 each."""
    low = _letters()[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]
    keep = low > 0
    keep[1:] |= low[:-1] > 0
    return np.concatenate(([0], low[keep], [0] * bool(low[-1:].any()))).astype(np.uint64)


def term_counts(letters: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of the hashed n-grams of what ``letters_of`` gives."""
    total = np.zeros(buckets, dtype=np.int64)
    shift = np.uint64(65 - buckets.bit_length())
    for a in range(0, len(letters), _STEP):
        grams = []
        for n, factor in WIDTHS.items():
            first = letters[a:min(a + _STEP, len(letters) - n + 1)]
            gram = first + np.uint64(1)
            for k in range(1, n):
                gram |= letters[a + k:a + k + len(first)] << np.uint64(21 * k)
            grams.append(gram * np.uint64(factor) >> shift)
        total += np.bincount(np.concatenate(grams).view(np.int64), minlength=buckets)
    return total


def sparse(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Features that a text has and 1 + ln of their counts; None without a letter."""
    letters = letters_of(text or "")
    if not letters.any():
        return None
    counts = term_counts(letters)
    at = np.flatnonzero(counts > 0)  # several times faster than of the counts
    return at, 1 + np.log(counts[at])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def vector(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[at]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def probabilities(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return softmax(self.vector(at, tf) @ self.weights[at] / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = sparse(text)
        if not self.languages or found is None:
            return UNKNOWN, 0.0
        p = self.probabilities(*found)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Leader:
    """Follow-the-regularised-leader for one weight row per feature, one column per class."""

    def __init__(self, features: int, classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        held = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -held / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax(x @ w)
        error[label] -= 1
        g = x[:, None] * error
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores that makes the labels likeliest, by golden section on its logarithm.

    A label counts as one that would hold in n + 1 of n + (number of classes) cases, so that scores without an
    error among n examples do not become certain."""
    n, classes = scores.shape
    target = np.full((n, classes), 1 / (n + classes))
    target[np.arange(n), labels] = (n + 1) / (n + classes)

    def loss(log_t: float) -> float:
        z = scores / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - (z * target).sum(axis=1)).mean())

    low, high, part = np.log(0.02), np.log(50.0), (5 ** 0.5 - 1) / 2
    a, b = high - part * (high - low), low + part * (high - low)
    for _ in range(60):
        if loss(a) <= loss(b):
            high, b = b, a
            a = high - part * (high - low)
        else:
            low, a = a, b
            b = low + part * (high - low)
    return float(np.exp((low + high) / 2))


def fit(rows: list[tuple[int, str, np.ndarray, np.ndarray]], languages: list[str], idf: np.ndarray) -> Model:
    """``rows`` of id, language, features and values, in any order."""
    model = Model(languages, idf, np.zeros((len(idf), len(languages))), 1.0)
    number = {language: i for i, language in enumerate(languages)}
    drawn = sorted(rows, key=lambda r: (int(mix(np.array([r[0]], dtype=np.int64).view(np.uint64))[0]), r[1], r[2].tobytes(), r[3].tobytes()))
    examples = [(at, model.vector(at, tf), number[language]) for _, language, at, tf in drawn]
    apart, learned = examples[::5], [e for i, e in enumerate(examples) if i % 5]
    leader = Leader(len(idf), len(languages))
    for _ in range(PASSES):
        for example in learned or apart:
            leader.learn(*example)
    model.weights = leader.weights()
    if apart and learned and len(languages) > 1:
        model.temperature = temperature(np.array([x @ model.weights[at] for at, x, _ in apart]), np.array([y for *_, y in apart]))
    return model


def _frequencies(learnable: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and how many texts there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, lot = np.zeros(buckets + 1, dtype=np.int64), 0, 0
        for b in batches:
            for text in b["text"]:
                total[:-1] += term_counts(letters_of(text.as_py()), buckets) > 0
                n += 1
        lot = int(mix(np.array([total.sum(), n], dtype=np.int64).view(np.uint64))[0] & np.uint64(63))
        total[-1] = n
        yield pa.RecordBatch.from_pylist([{"block": k, "lot": lot, "counts": total[a:a + _BLOCK].tobytes()} for k, a in enumerate(range(0, buckets + 1, _BLOCK))], schema=_COUNTS)

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), dtype=np.int64) for c in part["counts"])
        return pa.Table.from_pylist([{"block": part["block"][0].as_py(), "lot": 0, "counts": total.tobytes()}], schema=_COUNTS)

    lots = learnable.select("text").mapInArrow(count, COUNTS).groupBy("block", "lot").applyInArrow(add, COUNTS)
    sums = lots.groupBy("block").applyInArrow(add, COUNTS).collect()
    if not sums:
        return np.zeros(buckets, dtype=np.int64), 0
    total = np.concatenate([np.frombuffer(r.counts, dtype=np.int64) for r in sorted(sums, key=lambda r: r.block)])
    return total[:-1], int(total[-1])


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model of the documents that are not held out and have a text with a letter and a language.

    ``rows`` bounds the expected number of documents that weights are learned from: each language gives an equal
    part of it, drawn by a hash of id. Languages are few by nature; their counts, the document frequencies
    (``BUCKETS`` numbers) and the weights (``BUCKETS`` by languages) come to the driver."""
    learnable = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    learnable = learnable.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r.lang: r.n for r in learnable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), 1.0)
    frequency, n_docs = _frequencies(learnable, BUCKETS)
    idf = (np.log((1 + n_docs) / (1 + frequency)) + 1).astype(np.float32).astype(np.float64)
    shares = {language: min(1.0, rows / len(languages) / n) for language, n in sizes.items()}
    share = F.try_element_at(F.from_json(F.lit(json.dumps(shares)), "map<string,double>"), F.col("lang"))
    drawn = learnable.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < share * float(1 << 30))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for key, body, language in zip(b["doc_id"], b["text"], b["lang"], strict=True):
                if vector := sparse(body.as_py()):
                    at, tf = vector
                    found.append({"doc_id": key.as_py(), "lang": language.as_py(), "indices": at.astype("<u4").tobytes(), "values": tf.astype("<f4").tobytes()})
            yield pa.RecordBatch.from_pylist(found, schema=_VECTOR)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [
            (key, language, np.frombuffer(at, "<u4").astype(np.int64), np.frombuffer(tf, "<f4").astype(np.float64))
            for b in batches for key, language, at, tf in zip(*(b[c].to_pylist() for c in ("doc_id", "lang", "indices", "values")), strict=True)]
        model = fit(sample, languages, idf)
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.astype("<f4").tobytes()], "temperature": [model.temperature]})

    sample = materialize(drawn.mapInArrow(vectors, VECTOR), "language-sample")
    found = sample.coalesce(1).mapInArrow(learn, "weights binary, temperature double").first()
    if not found:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), 1.0)
    weights = np.frombuffer(found["weights"], "<f4").reshape(BUCKETS, len(languages))
    return Model(languages, idf, weights.astype(np.float64), found["temperature"])


def languages(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``held_out``, ``lang_pred`` and ``score``, the calibrated probability of that language.

    Null texts and texts without a letter (and all texts, if nothing could be learned) are ``und`` with score 0.
    Equal texts get equal results; ties go to the first language in code-point order. Rows stand alone; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            found = [own.predict(t.as_py()) for t in b["text"]]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["held_out"], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    key = F.col(f"`{doc_id}`").cast("long")
    rows = docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(predict, "doc_id bigint, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``languages`` by the model that ``train`` learns from the same documents."""
    return languages(docs, train(docs, rows, doc_id, text, lang), doc_id, text)
