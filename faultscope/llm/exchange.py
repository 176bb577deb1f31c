"""Looking up digests of all documents without a row for each.

Documents are dealt to chunks by ranges of their id. A chunk sends its distinct digests, sorted and
delta-coded, as one binary row to each shard of the digest space; a shard compares what all chunks
sent and answers each chunk in the order in which it asked. A passage that occurs a million times
is sent once by each chunk, so no shard sees a hot key, and both chunks and shards grow in number,
not in size."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_ID = -(1 << 63)
REQUEST = "shard int, chunk int, digests binary, counts binary"


@dataclass(frozen=True)
class Chunks:
    """``bounds`` are the first ids of all chunks but chunk 0."""

    bounds: list[int]
    rows: int
    shards: int

    def number(self, doc_id: Column) -> Column:
        """The chunk of an id by binary search; a null id goes to chunk 0."""
        if not self.bounds:
            return F.lit(0)
        steps = len(self.bounds).bit_length()
        table = F.from_json(F.lit(json.dumps(self.bounds)), "array<bigint>")
        start = F.coalesce(doc_id, F.lit(LEAST_ID))

        def advance(found: Column, step: Column) -> Column:
            ahead = (found + step).cast("int")
            fits = (ahead <= len(self.bounds)) & (F.coalesce(F.get(table, ahead - 1), F.lit(LEAST_ID)) <= start)
            return F.when(fits, ahead).otherwise(found)

        return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(steps))]), F.lit(0), advance)


def plan_chunks(docs: DataFrame, doc_id: str, text: str, most_bytes: int = 8 << 20) -> Chunks:
    """Ranges of ids that hold about as many rows each, of ``most_bytes`` of text on average.

    Small tables get 64 ranges. Beyond 4096 ranges they grow with the data up to 32 times
    ``most_bytes``, since the number of binary rows is chunks times shards."""
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    held = min(max(size["b"] / 64, 1 << 16), most_bytes)
    held = max(held, min(size["b"] / 4096, 32 * most_bytes))
    n_chunks = max(1, math.ceil(size["b"] / held))
    shards = 1 << max(6, math.ceil(math.log2(max(1.0, size["b"] / held))))
    bounds: list[int] = []
    if n_chunks > 1:
        parts = [k / n_chunks for k in range(1, n_chunks)]
        found = docs.agg(F.percentile_approx(doc_id, parts, max(10_000, 10 * n_chunks)).alias("b")).first()["b"]
        bounds = sorted(set(found or []))
    return Chunks(bounds, size["n"], shards)


def pack(values: np.ndarray, base: int) -> bytes:
    """Sorted 64-bit values from ``base`` on, as the bytes of their steps, lowest bytes first."""
    steps = np.diff(values, prepend=np.uint64(base))
    width = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 0
    return bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(data: bytes, n: int, base: int) -> np.ndarray:
    width = data[0]
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, :width] = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(width, n).T
    out = np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)
    return out + np.uint64(base)


def planes(values: np.ndarray) -> bytes:
    """32-bit values byte by byte, which compresses well where most are small."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def requests(chunk: int, digests: np.ndarray, counts: np.ndarray | None, shards: int, bits: int = 64) -> list[dict]:
    """One row for each shard that has a share of the sorted ``digests``, which have ``bits`` bits."""
    shift = bits - (shards.bit_length() - 1)
    cuts = np.searchsorted(digests, np.arange(shards, dtype=np.uint64) << np.uint64(shift))
    ends = np.append(cuts[1:], len(digests))
    return [
        {"shard": s, "chunk": chunk, "digests": len(part).to_bytes(4, "little") + pack(part, s << shift),
         "counts": None if counts is None else planes(counts[a:b])}
        for s, (a, b) in enumerate(zip(cuts, ends, strict=True)) if b > a for part in [digests[a:b]]
    ]


def received(shard: int, data: bytes, shards: int, bits: int = 64) -> np.ndarray:
    shift = bits - (shards.bit_length() - 1)
    return unpack(data[4:], int.from_bytes(data[:4], "little"), shard << shift)
