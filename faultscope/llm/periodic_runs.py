"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words with smallest period q, at least two periods long, that no neighbouring
word extends. Periods below ``SHORT`` are found by comparing all words with those q further on. A scale
holds the periods from P to 2 P, P doubling from ``SHORT``:

1. Every ``P / 4`` consecutive words have a digest; those that a run of period up to ``P / 8`` covers
   are left out, so that equal digests are more than ``P / 8`` apart and no value has more than 16 partners in reach.
2. Minima of windows of ``P / 4`` such digests are kept. They depend on the window's words only, and so repeat
   at distance q inside a run of period q. Equal minima P to 2 P apart are seeds.
3. If a run has nothing but words left out in its first period, two long runs of one shorter period touch there;
   all lags between P and 2 P that bring these two into step are seeds.
4. Seeds are extended to both sides by binary search on prefix digests, and what is found is compared word by word.

Cost is about linear in the words for each scale, and scales end at half of the longest text. Words are
compared by 64-bit digests, which for words of up to eight bytes of one length are one to one."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import bytes_of, whole_texts
from faultscope.llm.words import batches, mix, prefix_digests, words_of

SHORT, LEAST_LENGTH = 48, 12
RESULT = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_NO_VALUE = np.uint64((1 << 64) - 1)
_EMPTY = np.empty((0, 3), dtype=np.int64)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by running minima from both ends of blocks."""
    blocks = np.full(-(-len(values) // width) * width, _NO_VALUE)
    blocks[:len(values)] = values
    blocks = blocks.reshape(-1, width)
    from_left = np.minimum.accumulate(blocks, axis=1).ravel()
    from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    last = len(values) - width + 1
    return np.minimum(from_right[:last], from_left[width - 1:width - 1 + last])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Whether a value is the least of some ``width`` consecutive ones."""
    low = sliding_min(values, width)
    around = np.full(len(low) + 2 * (width - 1), _NO_VALUE)
    around[width - 1:width - 1 + len(low)] = ~low
    return (values == ~sliding_min(around, width)) & (values != _NO_VALUE)


def lag_runs(x: np.ndarray, lags: range, least_length: int) -> np.ndarray:
    """Start, end and lag of all longest stretches that repeat at each lag, by direct comparison."""
    found = [_EMPTY]
    for q in lags:
        if q >= len(x):
            break
        least = max(least_length - q, q)
        same = np.flatnonzero(x[q:] == x[:-q])
        if len(same) < least:
            continue
        cuts = np.flatnonzero(np.diff(same) != 1)
        begin, end = same[np.concatenate(([0], cuts + 1))], same[np.append(cuts, len(same) - 1)] + 1
        long = end - begin >= least
        found.append(np.column_stack((begin[long], end[long] + q, np.full(long.sum(), q))))
    return np.concatenate(found)


def _smallest_periods(runs: np.ndarray) -> np.ndarray:
    """One row for each start and end. A stretch that repeats at q and has a smaller period repeats at a divisor of q as well."""
    order = np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))
    runs = runs[order]
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def _equal_minima(x: np.ndarray, digests, runs: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags where equal minimizers stand ``scale`` to twice that apart."""
    width = scale // 4
    values = mix(digests.windows(width))
    covered = runs[(runs[:, 2] <= width // 2) & (runs[:, 1] - runs[:, 0] >= width)]
    mark = np.zeros(len(values) + 1, dtype=np.int32)
    np.add.at(mark, covered[:, 0], 1)
    np.subtract.at(mark, covered[:, 1] - width + 1, 1)
    values[np.cumsum(mark)[:-1] > 0] = _NO_VALUE
    if len(values) < width:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(window_minima(values, width))
    order = np.lexsort((at, values[at]))
    at, value = at[order], values[at][order]
    places, lags, step = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 1
    while step < len(at):
        lag = at[step:] - at[:-step]
        near = (value[step:] == value[:-step]) & (lag < 2 * scale)
        if not near.any():
            break
        near &= lag >= scale
        places.append(at[:-step][near])
        lags.append(lag[near])
        step += 1
    return np.concatenate(places), np.concatenate(lags)


def _steps_between_runs(digests, runs: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags that bring two touching long runs of one short period into step."""
    long = runs[(runs[:, 2] <= scale // 8) & (runs[:, 1] - runs[:, 0] >= scale)]
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    places, lags = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in np.flatnonzero((long[1:, 2] == long[:-1, 2]) & (long[1:, 0] <= long[:-1, 1])):
        (a, a_end, q), (b, b_end, _) = long[k].tolist(), long[k + 1].tolist()
        turn = np.flatnonzero(digests.of(np.arange(a, a + q), q) == digests.of(np.array([b]), q))
        if not len(turn):
            continue
        most = min(2 * scale - 1, min(a_end - a, b_end - b) + q)
        lag = np.arange(scale + (b - a - int(turn[0]) - scale) % q, most + 1, q)
        places.append(np.maximum(a, b - lag))
        lags.append(lag)
    return np.concatenate(places), np.concatenate(lags)


def _extended(x: np.ndarray, digests, places: np.ndarray, lags: np.ndarray) -> np.ndarray:
    """The longest stretches around ``places`` that repeat at ``lags``, where at least a lag long."""
    ahead, back = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    for bit in reversed(range(int(len(x)).bit_length())):
        more = ahead + (1 << bit)
        fits = np.flatnonzero(places + lags + more <= len(x))
        same = fits[digests.of(places[fits], more[fits]) == digests.of(places[fits] + lags[fits], more[fits])]
        ahead[same] = more[same]
        more = back + (1 << bit)
        fits = np.flatnonzero(places >= more)
        same = fits[digests.of(places[fits] - more[fits], more[fits]) == digests.of((places + lags - more)[fits], more[fits])]
        back[same] = more[same]
    long = ahead + back >= lags
    found = np.unique(np.column_stack((places - back, places + ahead + lags, lags, places))[long], axis=0)
    found = found[np.concatenate(([True], (found[1:, :3] != found[:-1, :3]).any(axis=1)))] if len(found) else found
    out = []
    for begin, end, q, place in found.tolist():
        unequal = np.flatnonzero(x[begin:end - q] != x[begin + q:end])
        if len(unequal):  # digests of unlike stretches were equal
            unequal += begin
            begin = max([begin, *(unequal[unequal < place] + 1)[-1:]])
            end = min([end, *(unequal[unequal >= place] + q)[:1]])
        if end - begin >= 2 * q:
            out.append((begin, end, q))
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def find_runs(x: np.ndarray, text_starts: np.ndarray, text_ends: np.ndarray, least_length: int = LEAST_LENGTH, short: int = SHORT) -> np.ndarray:
    """Start, end and smallest period of all runs of ``least_length`` words or more, by start and period.

    ``x`` has the words' digests of texts one after another, with an unlike value between any two."""
    if short < 48:
        raise ValueError("minimizers need periods of 48 words or more")
    runs = _smallest_periods(lag_runs(x, range(1, short), least_length))
    scale = short
    while True:
        large = np.flatnonzero(text_ends - text_starts >= 2 * scale)
        if not len(large):
            return runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        # the texts that are long enough, moved together, each with the value that follows it
        a, b = text_starts[large], text_ends[large] + 1
        new = np.concatenate(([0], np.cumsum(b - a)[:-1]))
        index = np.repeat(a - new, b - a) + np.arange((b - a).sum())
        part = x[np.minimum(index, len(x) - 1)]
        part[new + (b - a) - 1] = mix(np.arange(len(new), dtype=np.uint64) + np.uint64(1 << 63))
        text = np.searchsorted(a, runs[:, 0], side="right") - 1
        inside = (text >= 0) & (runs[:, 1] < b[text])
        shift = (a - new)[text[inside]]
        known = runs[inside] - np.column_stack((shift, shift, np.zeros_like(shift)))
        digests = prefix_digests(part)
        seeds = [_equal_minima(part, digests, known, scale), _steps_between_runs(digests, known, scale)]
        found = _extended(part, digests, *(np.concatenate(s) for s in zip(*seeds, strict=True)))
        shift = (a - new)[np.searchsorted(new, found[:, 0], side="right") - 1]
        runs = _smallest_periods(np.concatenate((runs, found + np.column_stack((shift, shift, np.zeros_like(shift))))))
        scale *= 2


def _described(ids: list, texts: list[bytes], least_length: int) -> pa.RecordBatch:
    words = words_of(texts)
    n, k = words.counts(), len(texts)
    starts = words.first[:-1] + np.arange(k)
    x = np.empty(len(words.digests) + k, dtype=np.uint64)
    x[np.arange(len(words.digests)) + words.owners()] = words.digests
    x[starts + n] = mix(np.arange(k, dtype=np.uint64) + np.uint64(1 << 62))
    runs = find_runs(x, starts, starts + n, least_length)
    mark = np.zeros(len(x) + 1, dtype=np.int32)
    np.add.at(mark, runs[:, 0] + runs[:, 2], 1)
    np.subtract.at(mark, runs[:, 1], 1)
    gone = np.cumsum(mark)[:-1] > 0
    cuts = np.searchsorted(runs[:, 0], np.append(starts, len(x)))
    rows = []
    for i, raw in enumerate(texts):
        own, kept = runs[cuts[i]:cuts[i + 1]], raw.split()
        if len(own):
            kept = compress(kept, ~gone[starts[i]:starts[i] + n[i]])
        rows.append({
            "doc_id": ids[i], "n_words": int(n[i]), "collapsed": b" ".join(kept).decode(),
            "runs": [{"start": a - int(starts[i]), "length": b - a, "period": q} for a, b, q in own.tolist()],
        })
    return pa.RecordBatch.from_pylist(rows, schema=_RESULT)


def periodic_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``runs`` (start, length, period in words, by start, then period)
    and ``collapsed``: the words that no run has after its first period, joined by one space.

    Words are runs of characters outside space and 0x09-0x0D. A run has ``least_length`` words and two
    periods at least. Null texts and texts without words have no words and no runs. Rows stand alone, so
    repeated rows, equal and null ids are harmless. Other columns are ignored. No row is shuffled."""

    def describe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts = part["doc_id"].to_pylist(), bytes_of(part["text"])
            for a, b in batches([len(t) for t in texts]):
                yield _described(ids[a:b], texts[a:b], least_length)

    return whole_texts(docs, doc_id, text).mapInArrow(describe, RESULT)


def repeated_tails(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``text``, where a tenth of the texts repeats a part of its words to the end.

    With h = crc32 of the id in decimal and g = floor(h / 10): if 10 divides h, words from a = g % n on are the
    p = 1 + floor((n - a) / (3 + g % 8)) words from a over and over. Null ids and texts without words stay as they are."""
    docs = whole_texts(docs, doc_id, text)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(tail, " ")).otherwise(F.lit(""))

    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    return docs.select("doc_id", F.when(h % 10 == 0, F.get(F.transform(F.array(words), repeated), F.lit(0))).otherwise(F.col("text")).alias("text"))
