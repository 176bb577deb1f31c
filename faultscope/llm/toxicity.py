"""Toxicity by Levenshtein automata over a learned lexicon, with context windows for quotations.

The lexicon is learned from a bounded sample of labelled documents: words that toxic documents have
and others lack, and word beginnings (stems) of which that holds for several words. It is kept as a
trie. The Levenshtein automata of all its terms are intersected with the trie as one machine: a state
is the set of trie nodes reached with a number of errors, made when first met, so that most words die
within a few characters. A word that is one edit from a term of five characters or more (two for long terms) counts with a weight
learned for such misspellings of that term; near words of clean documents count by their own record.

Two limits: a term of fewer than five characters (a stem's length less one) is found only as it is
spelled, and a term enters the lexicon only if toxic documents hold it at 50 times the rate of clean
ones, where clean documents count in full that only quote it.

Weights are log likelihood ratios. A hit inside quotation marks or after a word of reported speech in
its context window counts in part. Their sum with the prior gives the score through the logistic
function. Labels are read from training rows only; id, language and source are not looked at."""

from __future__ import annotations

import json
import math
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from hashlib import md5
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from faultscope.llm.common import whole_texts
from faultscope.session import materialize

WORD = re.compile(r"\w+")
SAMPLE_ROWS = 12_000
CONTEXT = 48
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’"}
REPORTED = frozenset("said says wrote writes called calls quote quoted quoting sagte schrieb nannte zitat dit écrit appelé citation dijo escribió llamó cita".split())
#: Log ratio assumed for misspellings and for quoted hits as a part of others, worth this many documents.
FUZZY_WEIGHT, QUOTED_PART, PRIOR_DOCS = 4.0, 0.35, 4.0


def allowed_errors(term: str, stem: bool) -> int:
    length = len(term) - (1 if stem else 0)
    return 0 if length < 5 else 1 if length < 10 else 2


class Automaton:
    """Finds the lexicon entry nearest to a word: ``(entry, errors)`` or None."""

    def __init__(self, terms: list[tuple[str, bool]], most_states: int = 100_000):
        self.terms, self.most_states = terms, most_states
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.budget = [0]
        for i, (term, stem) in enumerate(terms):
            node = 0
            budget = allowed_errors(term, stem)
            self.budget[0] = max(self.budget[0], budget)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], budget)
            if self.ends[node] is None or terms[self.ends[node]][1] < stem:
                self.ends[node] = i
        self._reset()

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.final: list[tuple[int, int] | None] = []
        self.stem: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, members: set[tuple[int, int]]) -> int:
        stack = list(members)
        while stack:  # leaving out a character of the term
            node, errors = stack.pop()
            for child in self.children[node].values():
                step = (child, errors + 1)
                if errors < self.budget[child] and step not in members:
                    members.add(step)
                    stack.append(step)
        key = frozenset(members)
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.moves.append({})
            hits = [(e, self.ends[n]) for n, e in key if self.ends[n] is not None and e <= allowed_errors(*self.terms[self.ends[n]])]
            best = min(hits, default=None)
            stems = min((h for h in hits if self.terms[h[1]][1]), default=None)
            self.final.append(best and (best[1], best[0]))
            self.stem.append(stems and (stems[1], stems[0]))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        reached = set()
        for node, errors in self.members[state]:
            for label, child in self.children[node].items():
                if label == c:
                    reached.add((child, errors))
                elif errors < self.budget[child]:
                    reached.add((child, errors + 1))
            if errors < self.budget[node]:
                reached.add((node, errors + 1))
        to = self.moves[state][c] = self._state(reached) if reached else -1
        return to

    def nearest(self, word: str) -> tuple[int, int] | None:
        if len(self.members) > self.most_states:
            self._reset()
        state, begun = self.start, None
        for c in word:
            state = self.moves[state].get(c) if c in self.moves[state] else self._move(state, c)
            if state < 0:
                return begun
            if self.stem[state] and (begun is None or self.stem[state][1] < begun[1]):
                begun = self.stem[state]
        end = self.final[state]
        return end if end and (begun is None or end[1] <= begun[1]) else begun


def _log_ratio(pos: float, neg: float, n_pos: int, n_neg: int) -> float:
    return math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))


def word_list(text: str) -> str:
    """The distinct words of a text, in order; copies and nearly all near copies differ little in it."""
    return " ".join(sorted(set(WORD.findall(text.lower()))))


def fit(rows: list[tuple[str, int]]) -> dict:
    """The model of labelled texts as plain values. Texts of the same words count once, as clean if one is."""
    rows = [(text, label) for text, label in rows if label in (0, 1)]
    sets: dict[str, int] = {}
    for text, label in rows:
        words = word_list(text)
        sets[words] = min(sets.get(words, 1), label)
    model = learn_words(sets.items())
    scorer, marks = Scorer(model), {}
    for text, label in rows:
        words, mark = word_list(text), (label, scorer.only_quoted(text))
        marks[words] = min(marks.get(words, mark), mark)
    quotations = [label for label, only in marks.values() if only]
    return with_quotations(model, sum(quotations), len(quotations) - sum(quotations))


def with_quotations(model: dict, toxic: int, clean: int) -> dict:
    """The model with the part that a quoted hit counts, from the texts whose hits are all quoted."""
    if not model["weights"]:
        return model
    own = _log_ratio(toxic, clean, *model["texts"]) / max(model["weights"])
    n = toxic + clean
    return model | {"quoted": min(1.0, max(0.0, (PRIOR_DOCS * QUOTED_PART + n * own) / (PRIOR_DOCS + n)))}


def learn_words(rows: Iterable[tuple[str, int]]) -> dict:
    """The lexicon and its weights from different word lists. They are read once and kept as packed numbers."""
    names: list[str] = []
    numbers: dict[str, int] = {}
    toxic: list[bytes] = []
    clean: list[bytes] = []
    for listed, label in rows:
        found = array("I")
        for w in listed.split(" ") if listed else []:
            if w not in numbers:
                numbers[w] = len(names)
                names.append(w)
            found.append(numbers[w])
        (toxic if label == 1 else clean).append(found.tobytes())

    def words_of(packed: bytes) -> list[str]:
        return [names[i] for i in array("I", packed)]

    n_pos, n_neg = len(toxic), len(clean)
    model = {"prior": math.log((n_pos + 0.5) / (n_neg + 1.5)), "terms": [], "weights": [], "fuzzy": [], "known": {}, "quoted": QUOTED_PART, "texts": [n_pos, n_neg]}
    if not n_pos or not n_neg:
        return model
    votes, prefix_votes, forms = defaultdict(set), defaultdict(set), defaultdict(set)
    for words in map(words_of, toxic):
        if not words:
            continue
        vote = min(crc32(w.encode()) for w in words)
        for w in words:
            votes[w].add(vote)
            for n in range(4, min(9, len(w))):
                prefix_votes[w[:n]].add(vote)
                forms[w[:n]].add(w)
    # With so many independent votes, less than half a word is expected to qualify by chance.
    needed = max(3, math.ceil(math.log((len(votes) + 1) / 0.5) / math.log((n_pos + n_neg) / n_pos)))
    words_left = {w for w, v in votes.items() if len(v) >= needed and len(w) >= 3}
    stems_left = {
        p for p, v in prefix_votes.items()
        if len(v) >= needed and len(forms[p]) >= 3 and len(v - votes[max(forms[p], key=lambda w: (len(votes[w]), w))]) >= needed / 2}
    against, stem_against = defaultdict(int), defaultdict(int)
    for words in map(words_of, clean):
        for w in words:
            if w in words_left:
                against[w] += 1
        for p in {w[:n] for w in words for n in range(4, min(9, len(w) + 1)) if w[:n] in stems_left}:
            stem_against[p] += 1
    strong = math.log(50)
    stems = {p for p in stems_left if _log_ratio(len(prefix_votes[p]), stem_against[p], n_pos, n_neg) >= strong}
    stems = {p for p in stems if not any(p[:n] in stems for n in range(4, len(p)))}
    terms = {w for w in words_left if _log_ratio(len(votes[w]), against[w], n_pos, n_neg) >= strong and not any(w[:n] in stems for n in range(4, len(w) + 1))}
    entries = [(w, False) for w in sorted(terms)] + [(p, True) for p in sorted(stems)]
    model["terms"] = entries
    model["weights"] = [_log_ratio(len(prefix_votes[t]), stem_against[t], n_pos, n_neg) if stem else _log_ratio(len(votes[t]), against[t], n_pos, n_neg) for t, stem in entries]
    automaton, near = Automaton(entries), {}
    seen = defaultdict(lambda: [0, 0])
    for group, side in ((toxic, 0), (clean, 1)):
        for words in map(words_of, group):
            for w in words:
                if w not in near:
                    near[w] = automaton.nearest(w)
                if near[w] and near[w][1]:
                    seen[w][side] += 1
    fuzzy = [[0, 0] for _ in entries]
    for w, (pos, neg) in seen.items():
        fuzzy[near[w][0]][0] += pos
        fuzzy[near[w][0]][1] += neg
        if neg:
            model["known"][w] = min(_log_ratio(pos, neg, n_pos, n_neg), model["weights"][near[w][0]])
    model["fuzzy"] = [(PRIOR_DOCS * FUZZY_WEIGHT + (p + n) * _log_ratio(p, n, n_pos, n_neg)) / (PRIOR_DOCS + p + n) for p, n in fuzzy]
    return model


class Scorer:
    def __init__(self, model: dict, most_words: int = 300_000):
        self.model, self.most_words = model, most_words
        self.automaton = Automaton([tuple(t) for t in model["terms"]])
        self.weights: dict[str, tuple[int, float] | None] = {}

    def _weight(self, word: str) -> tuple[int, float] | None:
        found = self.automaton.nearest(word)
        if not found:
            return None
        entry, errors = found
        weight = self.model["weights"][entry] if not errors else self.model["known"].get(word, self.model["fuzzy"][entry])
        return (entry, weight) if weight > 0 else None

    def hits(self, text: str) -> list[tuple[int, float, bool]]:
        """Entry, weight and whether quoted, for each place of a lexicon word or near one."""
        low = text.lower()
        words = set(WORD.findall(low))
        if len(self.weights) > self.most_words:
            self.weights = {}
        known = self.weights
        for w in words:
            if w not in known:
                known[w] = self._weight(w)
        found = {w for w in words if known[w]}
        if not found:
            return []
        return [(*known[m[0]], quoted(low, m.start(), m.end())) for m in WORD.finditer(low) if m[0] in found]

    def only_quoted(self, text: str) -> bool:
        hits = self.hits(text)
        return bool(hits) and all(h[2] for h in hits)

    def score(self, text: str) -> float:
        best: dict[int, float] = {}
        for entry, weight, in_quotes in self.hits(text):
            best[entry] = max(best.get(entry, 0.0), weight * (self.model["quoted"] if in_quotes else 1.0))
        odds = self.model["prior"] + sum(best.values())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def quoted(text: str, start: int, end: int) -> bool:
    """Whether a quotation opens before and closes after a place, both within its context window, or
    one of the three words before it reports speech."""
    before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    for opening, closing in QUOTES.items():
        if opening == closing:
            if before.count(opening) % 2 and closing in after:
                return True
        elif opening in before and closing in after and before.rfind(opening) > before.rfind(closing):
            return True
    return any(w in REPORTED for w in WORD.findall(before)[-3:])


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from; a null id is one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> dict:
    """The model of at most ``rows`` labelled documents that are not held out, drawn by hash of id.

    Null labels are left out; of several labels of an id the largest holds. The sample is bounded and
    written once. Its texts stay where they are: tasks send their distinct words on, which one task learns
    from, and later whether all hits are quoted. Only the small model and two counts come to the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = whole_texts(docs, doc_id, text).join(F.broadcast(drawn), "doc_id").select("text", "toxic")
    sample = materialize(sample, "toxicity-sample")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([word_list(t.as_py()) for t in b["text"]], pa.string()), b["toxic"]], ["words", "toxic"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = learn_words((w.as_py(), label.as_py()) for b in batches for w, label in zip(b["words"], b["toxic"], strict=True))
        yield pa.RecordBatch.from_pydict({"model": [json.dumps(model)]})

    words = sample.mapInArrow(lists, "words string, toxic int").groupBy("words").agg(F.min("toxic").alias("toxic"))
    found = words.repartition(1).mapInArrow(learn, "model string").first()
    if not found:
        return fit([])
    model = json.loads(found["model"])

    def quotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            keys = pa.array([md5(word_list(t.as_py()).encode()).digest() for t in b["text"]], pa.binary())
            only = pa.array([scorer.only_quoted(t.as_py()) for t in b["text"]], pa.bool_())
            yield pa.RecordBatch.from_arrays([keys, b["toxic"], only], ["words", "toxic", "only_quoted"])

    marks = sample.mapInArrow(quotations, "words binary, toxic int, only_quoted boolean")
    marks = marks.groupBy("words").agg(F.min(F.struct("toxic", "only_quoted")).alias("mark")).where("mark.only_quoted")
    counts = marks.agg(F.coalesce(F.sum("mark.toxic"), F.lit(0)).alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    return with_quotations(model, counts["toxic"], counts["n"] - counts["toxic"])


def score_column(text: Column, model: dict, spark) -> Column:
    shared = spark.sparkContext.broadcast(model)

    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for part in parts:  # one text at a time is a Python string
            yield pa.array([scorer.score(t.as_py() or "") for t in part], pa.float64())

    score.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, DoubleType())(text)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Null texts are empty and score by the prior, as all texts without a hit do. Equal texts score
    equally. Without labels no text is predicted toxic. Other columns are ignored."""
    model = train(docs, labels, rows, doc_id, text)
    scored = whole_texts(docs, doc_id, text).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("text"), model, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
