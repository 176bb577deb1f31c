"""Spelling variants: a vocabulary acceptor composed with a one-edit transducer and the acceptor again.

The composed machine accepts the pairs of words that one inserted, deleted or replaced code point
tells apart. Its paths match up to the first difference, take the edit there and match to the end, so
every pair has one path. Pairs are enumerated by partitions of the machine's initial states: a state
stands for what the words of a pair have in common outside a region of places where the edit may be
(shorter length ``m``, region ``lo`` to ``hi``, the symbols before and those after it). With two halves as regions
every word is in four partitions at most. A partition of too many words is cut into the two halves of its
region, down to one place, where an alphabet of A symbols allows A + A * A words at most. So hot
beginnings and ends of words need no cap. Each partition builds its own minimised acceptor."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import whole_texts
from faultscope.session import materialize

LEAST_LENGTH, LEAST_COUNT, RATIO, MISSPELT = 6, 5, 5, 199
#: Words of a partition that one task composes at once; larger partitions are cut.
MOST_WORDS = 20_000
#: Words that a task counts before it sends its counts on.
HELD_WORDS = 1 << 18
KEY = ("m", "lo", "hi", "head", "tail")
NEAR = "word string, n bigint, near array<struct<n:bigint,word:string>>"
_NEAR = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.list_(pa.struct([("n", pa.int64()), ("word", pa.string())])))])
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def count_words(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, misspelt: int = MISSPELT, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``word`` and ``n`` of the runs of letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased.

    With h = crc32 of ``<doc_id>:<run>``, a run loses its code point h % length where ``misspelt``
    divides h (0: never). Null ids write as an empty text. Null texts have no words. Tasks add up their
    own counts, so that frequent words are not shuffled one by one."""
    run = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for b in batches:
            for key, low in zip(b["doc_id"].to_pylist(), pc.ascii_lower(b["text"]), strict=True):
                seed = zlib.crc32(b"%s:" % (b"" if key is None else str(key).encode()))
                for word, n in Counter(run.findall(low.as_py())).items():
                    if misspelt and not (h := zlib.crc32(word.encode(), seed)) % misspelt:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least_length:
                            continue
                    total[word] = total.get(word, 0) + n
                if len(total) > HELD_WORDS:
                    yield _counts(total)
                    total = {}
        yield _counts(total)

    found = whole_texts(docs, doc_id, text).mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _counts(total: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], schema=_COUNTS)


class Acceptor:
    """The minimised acceptor of a sorted list of distinct words, built word by word.

    ``arcs[q]`` maps symbols to states, ``lengths[q]`` has bit k if the state accepts a word of k symbols."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.lengths: list[int] = []
        self._known: dict[tuple, int] = {}
        path: list[tuple[bool, dict[str, int]]] = [(False, {})]
        last = ""
        for word in words:
            common = 0
            most = min(len(word), len(last))
            while common < most and word[common] == last[common]:
                common += 1
            self._freeze(path, last, common)
            path += [(False, {}) for _ in range(len(word) - common)]
            path[-1] = (True, path[-1][1])
            last = word
        self._freeze(path, last, 0)
        self.start = self._state(*path[0])

    def _freeze(self, path: list, last: str, depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            path[-1][1][last[len(path) - 1]] = self._state(final, arcs)

    def _state(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, *arcs.items())
        found = self._known.get(key)
        if found is None:
            found = self._known[key] = len(self.arcs)
            lengths = int(final)
            for q in arcs.values():
                lengths |= self.lengths[q] << 1
            self.arcs.append(arcs)
            self.lengths.append(lengths)
        return found

    def common(self, p: int, q: int, length: int, but: str = "") -> list[str]:
        """Words of ``length`` symbols that both states accept and that do not begin with ``but``."""
        arcs, lengths, found = self.arcs, self.lengths, []
        todo = [(p, q, length, "")]
        while todo:
            p, q, left, word = todo.pop()
            if not left:
                found.append(word)
                continue
            left -= 1
            one, two = arcs[p], arcs[q]
            if p != q and len(two) < len(one):
                one, two = two, one
            for a, x in one.items():
                y = two.get(a)
                if y is not None and lengths[x] >> left & 1 and lengths[y] >> left & 1 and (word or a != but):
                    todo.append((x, y, left, word + a))
        return found


def one_edit_pairs(acceptor: Acceptor, length: int, places: int) -> Iterator[tuple[str, str]]:
    """Pairs that the composed machine accepts, if their shorter word has ``length`` symbols and the
    edit is among the first ``places``: equal lengths by the order of their symbols, else the longer one first."""
    arcs, lengths, common = acceptor.arcs, acceptor.lengths, acceptor.common
    todo = [(acceptor.start, "")]
    while todo:
        q, before = todo.pop()
        left = length - len(before)
        if left < 0 or len(before) >= places:
            continue
        here = sorted(arcs[q].items())
        same = [(a, x) for a, x in here if left and lengths[x] >> (left - 1) & 1]
        for i, (a, x) in enumerate(same):
            for b, y in same[:i]:
                for rest in common(x, y, left - 1):
                    yield before + b + rest, before + a + rest
        if lengths[q] >> left & 1:
            for a, x in here:
                if lengths[x] >> left & 1:
                    for rest in common(x, q, left, a):
                        yield before + a + rest, before + rest
        todo += [(x, before + a) for a, x in here]


def _composed(rows: list[tuple[str, int]], m: int, lo: int, hi: int, tail: int) -> list[dict]:
    """Near words within one partition: all words share ``lo`` symbols before and ``tail`` symbols after."""
    full = {word[lo:len(word) - tail]: (word, n) for word, n in rows}
    near: dict[str, list] = {}
    for one, two in one_edit_pairs(Acceptor(sorted(full)), m - lo - tail, hi - lo):
        a, b = full[one], full[two]
        near.setdefault(one, []).append({"n": b[1], "word": b[0]})
        near.setdefault(two, []).append({"n": a[1], "word": a[0]})
    return [{"word": full[r][0], "n": full[r][1], "near": found} for r, found in near.items()]


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by partition; each partition is composed when its last row is there."""
    key, held, out = None, [], []
    for b in batches:
        columns = [b[c].to_pylist() for c in (*KEY, "word", "n")]
        for m, lo, hi, head, tail, word, n in zip(*columns, strict=True):
            if (m, lo, hi, head, tail) != key:
                if len(held) > 1:
                    out += _composed(held, *key[:3], len(key[4]))
                key, held = (m, lo, hi, head, tail), []
            held.append((word, n))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_pylist(out, schema=_NEAR)
                out = []
    if len(held) > 1:
        out += _composed(held, *key[:3], len(key[4]))
    yield pa.RecordBatch.from_pylist(out, schema=_NEAR)


def _partitions(rows: DataFrame, cut: bool) -> DataFrame:
    """Rows of ``word``, ``n``, ``m`` with a region, by the two halves of that region."""
    half = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int") if cut else F.floor(F.col("m") / 2).cast("int")
    regions = F.array(F.struct(F.col("lo").alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("hi").alias("hi")))
    out = rows.select("word", "n", "m", F.explode(regions).alias("r")).select("word", "n", "m", "r.lo", "r.hi")
    after = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    return out.select("word", "n", "m", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")).alias("head"),
                      F.substring("word", F.char_length("word") - after + 1, after).alias("tail"))


def neighbours(words: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """``word``, ``n``, ``near`` (array of ``n`` and ``word``) of distinct ``words`` with counts ``n``.

    A word has a row for each partition with near words of it, and no near word twice."""
    lengths = F.array(F.char_length("word"), F.char_length("word") - 1)
    start = words.select("word", "n", F.explode(lengths).alias("m")).where("m >= 0").withColumns({"lo": F.lit(0), "hi": F.col("m") + 1})
    rows, found, cut = _partitions(start, False), None, True
    while cut:
        hot = rows.where("hi - lo > 1").groupBy(F.xxhash64(*KEY).alias("hot")).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most_words)
        hot = materialize(hot.select("hot"), "hot-partitions")
        cut = not hot.isEmpty()
        here = rows
        if cut:
            marked = F.xxhash64(*KEY) == F.col("hot")
            here = rows.join(hot, marked & F.expr("hi - lo > 1"), "left_anti")
            rows = materialize(_partitions(rows.where("hi - lo > 1").join(hot, marked, "left_semi"), True), "cut-partitions")
        near = here.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_enumerate, NEAR)
        found = near if found is None else found.unionByName(near)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of a table of ``word`` and ``form``: the form that has no form itself.

    Steps double by the round. As counts grow by a ratio with each step, chains and rounds are few."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = RATIO, most_words: int = MOST_WORDS) -> DataFrame:
    """Per word of ``words`` (``word``, ``n``): ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are near if one inserted, deleted or replaced code point tells them apart. ``form`` is the
    near word of largest ``n`` (ties: the first in code-point order) if that is at least ``ratio`` times the word's
    own, else null, as is ``form_n`` then; ``root`` follows forms to the last one. Counts of repeated words add
    up; null words and words of no count above 0 are left out, other columns are ignored. An empty table gives an empty one."""
    if ratio < 2:
        raise ValueError("the ratio of a form to its variant is at least 2, so that forms do not lead in circles")
    counted = words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")).where("word IS NOT NULL AND n IS NOT NULL")
    vocabulary = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "vocabulary")
    parts = neighbours(vocabulary, most_words).select(
        "word", F.size("near").cast("long").alias("n_near"), F.array_min(F.transform("near", lambda x: F.struct((-x["n"]).alias("n"), x["word"].alias("word")))).alias("best"))
    near = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    joined = vocabulary.join(near, "word", "left")
    large = -F.col("best.n") >= ratio * F.col("n")
    described = materialize(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, F.col("best.word")).alias("form"), F.when(large, -F.col("best.n")).alias("form_n")), "forms-of-words")
    last = roots(described.where("form IS NOT NULL"))
    return described.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
