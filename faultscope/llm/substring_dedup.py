"""Duplicate word spans across documents by an exchange of window digests.

This stands in for a relative Lempel-Ziv parse: no factors (source block, position, length) are made.
Chunks are documents in ascending id. The digest of every window is looked up among those of all earlier
chunks and of the earlier part of its own one, and the words of the windows found are the duplicate
spans. These are the words that factors of at least a window's length would cover, from whatever
source, so none is needed for the result; where a span was copied from is not known.

Windows are compared by 64-bit digests. For a window without an earlier occurrence, the chance of a
false one is the number of windows over 2^64 (1e-11 at 30 GB, 1e-6 at 100 TB)."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm import exchange
from faultscope.llm.common import arrow_table, bytes_of, whole_texts
from faultscope.llm.words import batches, windows_of, words_of

ANSWER = "chunk int, shard int, earlier binary"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, spans array<struct<start:bigint,length:bigint>>"
_REQUEST = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("digests", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int32()), ("shard", pa.int32()), ("earlier", pa.binary())])
_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
])


def _in_order(chunk: pa.Table) -> pa.Table:
    return chunk.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if len(chunk) else chunk


def _windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window digests of a chunk, the index of each first word, and the first word of each text."""
    found, starts, first = [], [], [np.zeros(1, dtype=np.int64)]
    for a, b in batches([len(t) for t in texts]):
        words = words_of(texts[a:b])
        digests, at = windows_of(words, width)
        base = first[-1][-1]
        found.append(digests)
        starts.append(at + base)
        first.append(words.first[1:] + base)
    return np.concatenate(found or [np.empty(0, np.uint64)]), np.concatenate(starts or [np.empty(0, np.int64)]), np.concatenate(first)


def duplicate_spans(docs: DataFrame, width: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its words without those of duplicate spans, and the spans (in words).

    A word goes if a window of ``width`` consecutive words of its document covers it and the same
    words also start earlier: in a document of smaller id, or before in the same one. Null texts and
    texts without words give no words and an empty ``kept_text``; shorter texts than a window are
    kept. Rows of equal id count as documents in the order of their texts; null ids come first.
    ``kept_text`` has the words joined by one space. Other columns are ignored."""
    docs = whole_texts(docs, doc_id, text)
    chunks = exchange.plan_chunks(docs, "doc_id", "text")
    shards = chunks.shards
    dealt = docs.withColumn("chunk", chunks.number(F.col("doc_id"))).groupBy("chunk")

    def ask(chunk: pa.Table) -> pa.Table:
        digests = _windows(bytes_of(_in_order(chunk)["text"]), width)[0]
        return arrow_table(exchange.requests(chunk["chunk"][0].as_py(), np.unique(digests), None, shards), _REQUEST)

    def answer(shard: pa.Table) -> pa.Table:
        rows = sorted(shard.to_pylist(), key=lambda r: r["chunk"])
        asked = [exchange.received(r["shard"], r["digests"], shards) for r in rows]
        every = np.concatenate(asked)
        order = np.argsort(every, kind="stable")
        earlier = np.zeros(len(every), dtype=bool)
        earlier[order[1:]] = every[order[1:]] == every[order[:-1]]
        cuts = np.cumsum([len(x) for x in asked])[:-1]
        return arrow_table(
            [{"chunk": r["chunk"], "shard": r["shard"], "earlier": len(e).to_bytes(4, "little") + (np.packbits(e).tobytes() if e.any() else b"")}
             for r, e in zip(rows, np.split(earlier, cuts), strict=True)], _ANSWER)

    def cut(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _in_order(chunk)
        texts = bytes_of(chunk["text"])
        digests, starts, first = _windows(texts, width)
        _, once, which = np.unique(digests, return_index=True, return_inverse=True)
        known = [np.empty(0, dtype=bool)]
        for r in sorted(answers.to_pylist(), key=lambda r: r["shard"]):
            n, bits = int.from_bytes(r["earlier"][:4], "little"), np.frombuffer(r["earlier"], dtype=np.uint8, offset=4)
            known.append(np.unpackbits(bits, count=n).astype(bool) if len(bits) else np.zeros(n, dtype=bool))
        earlier = np.concatenate(known)[which] | (once[which] != np.arange(len(which)))
        cover = np.zeros(first[-1] + 1, dtype=np.int32)
        np.add.at(cover, starts[earlier], 1)
        np.subtract.at(cover, starts[earlier] + width, 1)
        gone = np.cumsum(cover)[:-1] > 0
        out = []
        for i, (key, raw) in enumerate(zip(chunk["doc_id"].to_pylist(), texts, strict=True)):
            lost = gone[first[i]:first[i + 1]]
            n_lost = int(lost.sum())
            kept = raw.split()
            edges = np.flatnonzero(np.diff(np.concatenate(([0], lost.view(np.int8), [0])))) if n_lost else []
            out.append({
                "doc_id": key, "n_words": len(lost), "n_removed": n_lost,
                "kept_text": b" ".join(compress(kept, ~lost) if n_lost else kept).decode(),
                "spans": [{"start": int(a), "length": int(b - a)} for a, b in zip(edges[0::2], edges[1::2], strict=True)],
            })
        return arrow_table(out, _RESULT)

    answers = dealt.applyInArrow(ask, exchange.REQUEST).groupBy("shard").applyInArrow(answer, ANSWER)
    return dealt.cogroup(answers.groupBy("chunk")).applyInArrow(cut, RESULT)
