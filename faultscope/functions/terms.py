"""Terms of whole texts, cut and counted in Arrow batches: the words and n-grams of ``clean_text`` and ``word_ngrams``.

Spark translates letters that fold to one; the batches fold the rest, blank and count.
A term's hash is made of the hashes of its words, so that strings are only made where they are asked for. A batch is
worked on in lots of about ``LOT`` bytes of text, which bounds a worker's memory whatever the size of the batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from faultscope.functions.text import ensure_str, fold_single

LOT = 1 << 19
MOST_WORDS = 500_000
#: Texts of fewer words than this on average are counted together.
SHORT = 100
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b == 95 else 32 for b in range(256))
_K, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_A, _B, _C = np.uint64(30), np.uint64(27), np.uint64(31)
_HASHES: dict[bytes, bytes] = {}


def words_of(text: bytes | None, cleaned: bool = False) -> list[bytes]:
    """Words of at least two characters, as ``words(clean_text(text))`` cuts them."""
    if not text:
        return []
    if cleaned:
        if not text.isascii():
            return [w for w in text.split(b" ") if len(w.decode("utf-8", "replace")) > 1]
        return [w for w in text.split(b" ") if len(w) > 1]
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.decode("utf-8", "replace")).encode("ascii", "ignore")
    return [w for w in text.translate(_LETTERS).split() if len(w) > 1]


def _hashed(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, remembered for as long as a worker lives."""
    try:
        told = b"".join(map(_HASHES.__getitem__, words))
    except KeyError:
        if len(_HASHES) > MOST_WORDS:
            _HASHES.clear()
        for w in set(words).difference(_HASHES):
            _HASHES[w] = blake2b(w, digest_size=8).digest()
        told = b"".join(map(_HASHES.__getitem__, words))
    return np.frombuffer(told, "<u8")


def _longer(grams: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of terms that are one word longer."""
    x = grams * _K + word
    x = (x ^ (x >> _A)) * _M1
    x = (x ^ (x >> _B)) * _M2
    return x ^ (x >> _C)


def gram_hashes(words: list[bytes], low: int, high: int) -> np.ndarray:
    """Hashes of all n-grams for n in ``low..high``, with repeats: all of a length before those of the next."""
    first = grams = _hashed(words)
    out = [grams] if low == 1 else []
    for n in range(2, high + 1):
        grams = _longer(grams[:-1], first[n - 1:])
        if n >= low:
            out.append(grams)
    return np.concatenate(out).view(np.int64)


def lots(batches: Iterator[pa.Array]) -> Iterator[list[bytes | None]]:
    """Texts in lists of about ``LOT`` bytes."""
    for batch in batches:
        told, size = [], 0
        for text in batch.cast(pa.binary()).to_pylist():
            told.append(text)
            size += len(text or b"")
            if size >= LOT:
                yield told
                told, size = [], 0
        if told:
            yield told


def counted(texts: list[bytes | None], ngrams: tuple[int, int], cleaned: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of rows, and the distinct hashes of each row, ascending, with their counts."""
    told = [words_of(text, cleaned) for text in texts]
    together = sum(map(len, told)) < SHORT * len(told)
    return _counted_together(told, *ngrams) if together else _counted_singly(told, *ngrams)


def _counted_singly(told: list[list[bytes]], low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets, hashes, counts = [0], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    for words in told:
        own = np.sort(gram_hashes(words, low, high))
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1])))
        hashes.append(own[first])
        counts.append(np.diff(first, append=len(own)).astype(np.int32))
        offsets.append(offsets[-1] + len(first))
    return np.array(offsets), np.concatenate(hashes), np.concatenate(counts)


def _counted_together(told: list[list[bytes]], low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for many short texts, without a step for each."""
    row = np.repeat(np.arange(len(told)), np.fromiter(map(len, told), np.int64, len(told)))
    first = grams = _hashed([*chain.from_iterable(told)])
    hashes, rows = ([grams], [row]) if low == 1 else ([], [])
    for n in range(2, high + 1):  # terms that reach into the next text drop out
        grams = _longer(grams[:-1], first[n - 1:])
        if n >= low:
            inside = row[:-(n - 1)] == row[n - 1:]
            hashes.append(grams[inside])
            rows.append(row[:-(n - 1)][inside])
    found, row = np.concatenate(hashes).view(np.int64), np.concatenate(rows)
    order = np.argsort(found, kind="stable")
    order = order[np.argsort(row[order].astype(np.uint16 if len(told) < 1 << 16 else np.int64), kind="stable")]
    found, row = found[order], row[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(found)), bool), (found[1:] != found[:-1]) | (row[1:] != row[:-1]))))
    return np.searchsorted(row[at], np.arange(len(told) + 1)), found[at], np.diff(at, append=len(found)).astype(np.int32)


def hashed_terms(text: str, ngrams: tuple[int, int] = (1, 2), cleaned: bool = False) -> Column:
    """``terms`` (hashes, ascending) and ``tfs`` of a text column."""

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in lots(batches):
            offsets, hashes, counts = counted(texts, ngrams, cleaned)
            yield pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (hashes, counts)], names=["terms", "tfs"])

    return _udf(found, "struct<terms:array<bigint>,tfs:array<int>>")(given_text(text, cleaned))


def listed_terms(text: str, ngrams: tuple[int, int] = (1, 2), cleaned: bool = False) -> Column:
    """The distinct terms of a text column as an array of ``hash``, ``term`` and ``tf``, in the order of hashes."""
    low, high = ngrams

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in lots(batches):
            offsets, hashes, terms, counts = [0], [np.empty(0, np.int64)], [], [np.empty(0, np.int64)]
            for text in texts:
                words = words_of(text, cleaned)
                told = [*words] if low == 1 else []
                for n in range(max(2, low), high + 1):
                    told += map(b" ".join, zip(*(words[i:] for i in range(n))))
                own, at, n_own = np.unique(gram_hashes(words, low, high), return_index=True, return_counts=True)
                hashes.append(own)
                counts.append(n_own.astype(np.int64))
                terms += [told[i] for i in at.tolist()]
                offsets.append(len(terms))
            parts = [pa.array(np.concatenate(hashes)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(np.concatenate(counts))]
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, names=["hash", "term", "tf"]))

    return _udf(found, "array<struct<hash:bigint,term:string,tf:bigint>>")(given_text(text, cleaned))


def given_text(text: str, cleaned: bool) -> Column:
    """What goes to the batches: a text that has its single letters folded."""
    return ensure_str(F.col(text)) if cleaned else fold_single(ensure_str(F.col(text)))


def hash_of(term: bytes) -> int:
    """The hash of a term, its words joined by a blank."""
    parts = [_hashed([w]) for w in term.split(b" ")]
    return int(reduce(_longer, parts).view(np.int64)[0])


def term_hash(term: str) -> Column:
    """``hash_of`` a column of terms."""

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if t is None else hash_of(t) for t in batch.cast(pa.binary()).to_pylist()], pa.int64())

    return _udf(found, "bigint")(F.col(term))


def _udf(found: Callable[[Iterator[pa.Array]], Iterator[pa.Array]], kind: str) -> Callable[[Column], Column]:
    return F.arrow_udf(found, kind)
