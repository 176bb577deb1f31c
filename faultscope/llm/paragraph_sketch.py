"""Document fingerprints: invertible Bloom lookup tables over paragraph digests.

A text is cut into paragraphs: lines, and within a line after each word whose digest is divisible by
4, so that long lines have several and an edit changes only those near it. A sketch has three tables
of cells; each paragraph adds one to the count, its digest to the sum and a check digest to the check
sum of one cell in each. Sketches of equal size subtract cell by cell: what two versions share is
gone, and peeling cells with a single digest recovers those that differ. Where peeling stops early,
both versions are sketched anew with four times the cells."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm import exchange
from faultscope.llm.common import arrow_table, bytes_of, whole_texts
from faultscope.llm.words import batches, mix, words_of

CELLS, TABLES, GROWTH = 24, 3, 4
_BATCH_CELLS = 1 << 20
COMPARED = "doc_id bigint, n_paragraphs bigint, n_other bigint, likeness double, only_here array<bigint>, only_other array<bigint>"
_COMPARED = pa.schema([
    ("doc_id", pa.int64()), ("n_paragraphs", pa.int64()), ("n_other", pa.int64()), ("likeness", pa.float64()),
    ("only_here", pa.list_(pa.int64())), ("only_other", pa.list_(pa.int64())),
])
EDITED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDITED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


@dataclass
class Paragraphs:
    """Distinct digests (a repeated paragraph has one for each time) with the text they belong to."""

    owner: np.ndarray
    key: np.ndarray
    n_texts: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.owner, minlength=self.n_texts)

    def of(self, texts: np.ndarray) -> Paragraphs:
        """Those of some texts only, which are numbered in the order given."""
        place = np.full(self.n_texts, -1)
        place[texts] = np.arange(len(texts))
        owner = place[self.owner]
        return Paragraphs(owner[owner >= 0], self.key[owner >= 0], len(texts))

    def moved(self, places: np.ndarray) -> Paragraphs:
        """Text i takes the paragraphs of text ``places[i]``."""
        order = np.argsort(self.owner, kind="stable")
        n = self.counts()
        first = np.concatenate(([0], np.cumsum(n)))
        sizes = n[places]
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[places], sizes)
        return Paragraphs(np.repeat(np.arange(len(places)), sizes), self.key[order[at]], len(places))


def paragraphs_of(texts: list[bytes]) -> Paragraphs:
    owners, keys = [], []
    for a, b in batches([len(t) for t in texts]):
        words = words_of(texts[a:b], lines=True)
        if not len(words.digests):
            continue
        owner = words.owners()
        cut = words.new_line | np.concatenate(([True], (words.digests[:-1] & np.uint64(3)) == 0))
        cut |= np.concatenate(([True], owner[1:] != owner[:-1]))
        starts = np.flatnonzero(cut)
        turn = mix(words.digests + (np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))).astype(np.uint64))
        owners.append(owner[starts] + a)
        keys.append(mix(np.add.reduceat(turn, starts)))
    if not keys:
        return Paragraphs(np.empty(0, np.int64), np.empty(0, np.uint64), len(texts))
    owner, key = np.concatenate(owners), np.concatenate(keys)
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1]))))
    time = np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))
    return Paragraphs(owner, np.where(time > 0, mix(key + time.astype(np.uint64)), key), len(texts))


def _check(key: np.ndarray) -> np.ndarray:
    return mix(key ^ np.uint64(0xA5A5A5A55A5A5A5A)) & np.uint64(0xFFFFFFFF)


def _cells(owner: np.ndarray, key: np.ndarray, size: int) -> list[np.ndarray]:
    part = size // TABLES
    return [owner * size + k * part + (mix(key + np.uint64(k + 1)) % np.uint64(part)).astype(np.int64) for k in range(TABLES)]


class Sketches:
    """Cells of ``n`` texts side by side, ``size`` for each."""

    def __init__(self, n: int, size: int):
        self.n, self.size = n, size
        self.count = np.zeros(n * size, dtype=np.int64)
        self.key = np.zeros(n * size, dtype=np.uint64)
        self.check = np.zeros(n * size, dtype=np.uint64)

    def add(self, owner: np.ndarray, key: np.ndarray, sign: np.ndarray | int = 1) -> Sketches:
        sign = np.broadcast_to(np.asarray(sign, dtype=np.int64), len(key))
        factor = sign.astype(np.uint64)
        for at in _cells(owner, key, self.size):
            np.add.at(self.count, at, sign)
            np.add.at(self.key, at, key * factor)
            np.add.at(self.check, at, _check(key) * factor)
        return self

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.size)
        out.count, out.key, out.check = self.count - other.count, self.key - other.key, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, digest and sign of all that could be recovered, and whether nothing is left of a text."""
        owners, keys, signs = [], [], []
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            sign = self.count[look]
            key = self.key[look] * sign.astype(np.uint64)
            pure = self.check[look] * sign.astype(np.uint64) == _check(key)
            look, sign, key = look[pure], sign[pure], key[pure]
            if not len(look):
                break
            owner = look // self.size
            _, once = np.unique(mix(key) + owner.astype(np.uint64), return_index=True)
            owner, key, sign = owner[once], key[once], sign[once]
            self.add(owner, key, -sign)
            owners.append(owner)
            keys.append(key)
            signs.append(sign)
            touched = np.unique(np.concatenate(_cells(owner, key, self.size)))
            look = touched[np.abs(self.count[touched]) == 1]
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        done = ~left.reshape(self.n, self.size).any(axis=1)
        empty = np.empty(0, np.int64)
        return (np.concatenate([empty, *owners]), np.concatenate([empty.astype(np.uint64), *keys]), np.concatenate([empty, *signs]), done)

    def hexes(self) -> list[str]:
        cells = np.zeros(self.n * self.size, dtype=np.dtype([("count", "<i2"), ("key", "<u8"), ("check", "<u4")]))
        cells["count"], cells["key"], cells["check"] = self.count, self.key, self.check & np.uint64(0xFFFFFFFF)
        data, width = cells.tobytes().hex(), 2 * cells.itemsize * self.size
        return [data[i * width:(i + 1) * width] for i in range(self.n)]


def fingerprints(found: Paragraphs, cells: int = CELLS) -> list[str]:
    """Count, digest sum and check sum of all cells, as hexadecimal little-endian numbers."""
    return Sketches(found.n_texts, cells).add(found.owner, found.key).hexes()


def differences(a: Paragraphs, b: Paragraphs, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, digest and sign (1: only in ``a``, -1: only in ``b``) of all paragraphs of texts that differ."""
    out, left, size = [], np.arange(a.n_texts), cells
    while len(left):
        failed = []
        for part in np.array_split(left, max(1, -(-len(left) * size // _BATCH_CELLS))):
            x, y = a.of(part), b.of(part)
            gap = Sketches(len(part), size).add(x.owner, x.key).minus(Sketches(len(part), size).add(y.owner, y.key))
            owner, key, sign, done = gap.peel()
            good = done[owner]
            out.append((part[owner[good]], key[good], sign[good]))
            failed.append(part[~done])
        left, size = np.concatenate(failed), size * GROWTH
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))


def likeness(a: Paragraphs, b: Paragraphs, cells: int = CELLS) -> np.ndarray:
    """Shared paragraphs over all of both texts, from the differing ones; 1 for two texts without any."""
    differ = np.bincount(differences(a, b, cells)[0], minlength=a.n_texts)
    total = a.counts() + b.counts()
    return np.where(total > 0, (total - differ) / np.maximum(total + differ, 1), 1.0)


def compare_versions(versions: DataFrame, doc_id: str = "doc_id", text: str = "text", other: str = "other_text") -> DataFrame:
    """For each row the paragraph digests that only one of its two versions has, and their likeness.

    Null texts count as empty. Two texts without words have likeness 1. Rows are independent."""

    def compare(rows):
        for batch in rows:
            a, b = paragraphs_of(bytes_of(batch["a"])), paragraphs_of(bytes_of(batch["b"]))
            owner, key, sign = differences(a, b)
            alike, n_a, n_b = likeness(a, b), a.counts(), b.counts()
            yield from arrow_table([
                {"doc_id": i, "n_paragraphs": int(n_a[k]), "n_other": int(n_b[k]), "likeness": float(alike[k]),
                 "only_here": sorted(key[(owner == k) & (sign > 0)].view(np.int64).tolist()), "only_other": sorted(key[(owner == k) & (sign < 0)].view(np.int64).tolist())}
                for k, i in enumerate(batch["doc_id"].to_pylist())], _COMPARED).to_batches()

    a, b = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (text, other))
    return versions.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), a.alias("a"), b.alias("b")).mapInArrow(compare, COMPARED)


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of an edited one, whose last quarter is the next text's beginning.

    The next text is that of the next larger id; after the last comes the first again, and a single
    document is its own next. Rows of equal id follow each other by text, a null id comes first; null
    texts are empty. Equal texts have equal fingerprints; runs of white space do not count. Documents
    are dealt by ranges of id; the first rows of a range also go to the one before it."""
    docs = whole_texts(docs, doc_id, text)
    chunks = exchange.plan_chunks(docs, "doc_id", "text")
    place = F.coalesce("doc_id", F.lit(exchange.LEAST_ID))
    least = docs.agg(F.min(place).alias("m")).first()["m"]
    own, last = chunks.number(F.col("doc_id")), len(chunks.bounds)
    bounds = F.from_json(F.lit(str(chunks.bounds)), "array<bigint>")
    begins = (F.get(bounds, F.col("own") - 1) == F.col("place")) if chunks.bounds else F.lit(False)
    homes = F.array_compact(F.array(
        F.struct(F.col("own").alias("chunk"), F.lit(0).alias("part")),
        F.when(begins, F.struct((F.col("own") - 1).alias("chunk"), F.lit(1).alias("part"))),
        F.when(F.col("place") == F.lit(least), F.struct(F.lit(last).alias("chunk"), F.lit(2).alias("part"))),
    ))
    dealt = docs.withColumns({"own": own, "place": place}).select("doc_id", "text", "place", F.explode(homes).alias("home")).select("doc_id", "text", "place", "home.chunk", "home.part")

    def sketch(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by([("part", "ascending"), ("place", "ascending"), ("text", "ascending")])
        n = chunk["part"].to_pylist().count(0)
        if not n:
            return _EDITED.empty_table()
        texts = chunk["text"].slice(0, n + 1).to_pylist()
        edited = []
        for one, following in zip(texts, texts[1:], strict=False):
            tail = len(one) // 4
            edited.append(one[:len(one) - tail] + following[:tail])
        found = paragraphs_of([t.encode() for t in texts])
        ours, changed = found.of(np.arange(n)), paragraphs_of([t.encode() for t in edited])
        following = found.moved(np.arange(1, n + 1))
        columns = [
            chunk["doc_id"].slice(0, n).to_pylist(), [len(t) for t in texts[:n]], [sha256(t.encode()).hexdigest() for t in edited],
            fingerprints(ours), fingerprints(changed), likeness(ours, changed), likeness(ours, following),
        ]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EDITED, strict=True)], schema=_EDITED)

    return dealt.groupBy("chunk").applyInArrow(sketch, EDITED)
