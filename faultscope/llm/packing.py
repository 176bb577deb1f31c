"""Packing documents into sequences by shortest-pack-first over the histogram of lengths.

Documents are cut into pieces of the whole sequence length and a rest. Only the histogram of rests
reaches the driver (one number for each length). Lengths are placed longest first, all documents of a
length at once: into the shortest open packing patterns, those with the most room, as long as it fits;
a pattern of which only some are needed is split; what fits nowhere opens patterns of its own length.
Rests then find their place by length and rank."""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultscope.llm.common import whole_texts
from faultscope.llm.tokens import Memo, byte_level_ids, byte_pre_tokens, tokenizer
from faultscope.session import materialize

_MEMOS: dict[str, Memo] = {}
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
_BEFORE = pa.schema([("length", pa.int64()), ("lot", pa.int32()), ("before", pa.int64())])
_SLOTS = pa.schema([(name, pa.int64()) for name in ("length", "low", "high", "sequence", "offset")])


@lru_cache(maxsize=64)
def _layout(n: int) -> struct.Struct:
    return struct.Struct(f"<{n}I")


def _memo(path: str) -> Memo:
    if path not in _MEMOS:
        ids = byte_level_ids(path) or (lambda word: tokenizer(path).encode(word, add_special_tokens=False).ids)

        def encoded(pre_tokens: list[str]) -> list[bytes]:
            return [_layout(len(found)).pack(*found) for found in map(ids, pre_tokens)]

        _MEMOS[path] = Memo(encoded)
    return _MEMOS[path]


def pieces(docs: DataFrame, path: str, size: int, with_ids: bool = False) -> DataFrame:
    """Token pieces of each row: all of ``size`` tokens but the last. A document's tokens are those of
    its text and one id 0. ``ids`` (unsigned little-endian 32-bit) is null unless asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, whole = _memo(path), tokenizer(path)
        for batch in (whole_batch.slice(a, 512) for whole_batch in batches for a in range(0, whole_batch.num_rows, 512)):
            out = []
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                pre_tokens = byte_pre_tokens(text)
                if pre_tokens is None:
                    ids = np.asarray(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
                else:
                    ids = memo.joined(pre_tokens)
                ids += bytes(4)
                n = len(ids) // 4
                for start in range(0, n, size):
                    part = ids[4 * start:4 * (start + size)]
                    out.append((key, start, len(part) // 4, zlib.crc32(part), n, part if with_ids else None))
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

    return docs.mapInArrow(cut, PIECES)


def patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in order) and how often each is used, for counts by length."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    done: list[tuple[tuple[int, ...], int]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for space in range(size - 1, length - 1, -1):
            while left and room[space]:
                pattern, count = room[space].pop()
                used = min(count, left)
                if used < count:
                    room[space].append((pattern, count - used))
                left -= used
                longer = pattern + (length,)
                (done if space == length else room[space - length]).append((longer, used))
            if not left:
                break
        while left:
            each = size // length
            used = left // each if left >= each else 1
            n = each if left >= each else left
            pattern = (length,) * n
            (done if n * length == size else room[size - n * length]).append((pattern, used))
            left -= used * n
    return done + [p for space in sorted(room) for p in room[space]]


def _slots(used: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): for each place of a pattern, the ranks
    of that length that it takes and the sequence of the first one."""
    taken: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, count in used:
        offset = 0
        for length in pattern:
            out.append((length, taken[length], taken[length] + count, sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    return out


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    """An Arrow table is read without Python workers; lists of rows would start a second set of them on each executor."""
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def packed(docs: DataFrame, path: str, size: int = 1024, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece its document, place in it, checksum, sequence and offset there.

    Every row is a document of at least one token (id 0), also with a null or empty text; rows of
    equal id are packed each by itself, a null id is kept. An empty table gives no piece. Other
    columns are ignored. Sequences are numbered from 0: first the rests' ones, then the full ones."""
    docs = whole_texts(docs, doc_id, text)
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path, size, with_ids), "pieces")
    lots = max(64, min(4096, spark.sparkContext.defaultParallelism * 8))
    # Rows that agree in all of these are the same piece of repeated rows; any order of them is right.
    lot = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(lots)).cast("int")
    keyed = cut.withColumn("lot", lot)
    counts = keyed.groupBy("length", "lot").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lot", "n"))).alias("lots")).collect()
    histogram = {r["length"]: sum(x["n"] for x in r["lots"]) for r in sums}
    used = patterns({k: n for k, n in histogram.items() if k < size}, size)
    slots = [*_slots(used), (size, 0, histogram.get(size, 0), sum(n for _, n in used), 0)]
    before = []
    for r in sums:
        seen = 0
        for x in r["lots"]:
            before.append((r["length"], x["lot"], seen))
            seen += x["n"]
    # At most size * lots and a few times size rows: their number does not grow with the documents.
    before_df = F.broadcast(spark.createDataFrame(_table(before, _BEFORE)))
    slots_df = F.broadcast(spark.createDataFrame(_table(slots, _SLOTS)))
    order = Window.partitionBy("length", "lot").orderBy("doc_id", "start", "ids_crc32")
    ranked = keyed.join(before_df, ["length", "lot"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
    placed = ranked.alias("r").join(slots_df.alias("s"), F.expr("r.length = s.length AND rank >= low AND rank < high")).drop(F.col("s.length"))
    kept = ["ids"] if with_ids else []
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset", *kept)
