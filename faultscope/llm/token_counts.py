"""Token counts in two tiers, without moving a pre-token.

Tier one is a broadcast table of the lengths, in tokens, of the most frequent pre-tokens of all
documents; tier two a cache in each worker, filled by the tokenizer for pre-tokens that tier one lacks.
Pre-tokens are counted inside the tasks, and only these counts are shuffled. Token counts are the
tokenizer's in any case; the table only decides how often it is asked."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import whole_texts
from faultscope.llm.tokens import Memo, tokenizer, word_pre_tokens
from faultscope.session import materialize

_MEMOS: dict[str, Memo] = {}
_TABLES: dict[int, dict[str, int]] = {}
#: A task sends its counts on when it has met so many different pre-tokens.
MOST_COUNTED = 200_000


def _lengths(path: str, pre_tokens: list[str]) -> list[int]:
    return [len(e) for e in tokenizer(path).encode_batch_fast(pre_tokens, add_special_tokens=False)]


def _memo(path: str) -> Memo:
    if path not in _MEMOS:
        _MEMOS[path] = Memo(lambda pre_tokens: _lengths(path, pre_tokens))
    return _MEMOS[path]


def frequent_pre_tokens(docs: DataFrame, sample_docs: int | None, table_size: int) -> list[str]:
    """The most frequent pre-tokens of all documents, or of about ``sample_docs`` drawn by hash of their
    ids. Texts that the library alone can cut are not in it."""
    if sample_docs is not None:
        share = min(1.0, sample_docs / max(docs.count(), 1))
        docs = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(math.ceil(share * (1 << 40))))
    schema = pa.schema([("w", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                seen.update(word_pre_tokens(text) or ())
                if len(seen) > MOST_COUNTED:
                    yield pa.RecordBatch.from_pydict({"w": list(seen), "n": list(seen.values())}, schema=schema)
                    seen.clear()
        yield pa.RecordBatch.from_pydict({"w": list(seen), "n": list(seen.values())}, schema=schema)

    counts = docs.select("text").mapInArrow(count, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    # Classes of counts an eighth of a doubling wide tell which terms can be among the first, so that tasks
    # send the driver little more than it keeps.
    counts = materialize(counts.withColumn("class", F.floor(F.log2("n") * 8).cast("int")), "pre-tokens")
    lowest, left = 0, table_size
    for r in sorted(counts.groupBy("class").count().collect(), reverse=True):
        lowest, left = r["class"], left - r["count"]
        if left <= 0:
            break
    return [r["w"] for r in counts.where(F.col("class") >= lowest).orderBy(F.desc("n"), "w").limit(table_size).collect()]


def token_counts(
    docs: DataFrame, path: str, limit: int = 2048, sample_docs: int | None = None, table_size: int = 30_000, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    Tokens are those of the tokenizer file at ``path`` for the whole text, none added, special
    strings taken as the library takes them. A null text counts as empty: no bytes, no tokens. Each
    row is counted by itself, repeated or not; ids may be null; other columns are ignored."""
    docs = whole_texts(docs, doc_id, text)
    words = frequent_pre_tokens(docs, sample_docs, table_size)
    lengths = _lengths(path, words)
    packed = docs.sparkSession.sparkContext.broadcast(("\n".join(words), bytes(min(n, 255) for n in lengths)))

    def frequent() -> dict[str, int]:
        joined, sizes = packed.value
        known = _TABLES.get(id(joined))
        if known is None:
            _TABLES.clear()
            known = _TABLES[id(joined)] = {w: n for w, n in zip(joined.split("\n"), sizes, strict=False) if n < 255}
        return known

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tier_one, memo, whole = frequent(), _memo(path), tokenizer(path)
        for batch in batches:
            n_tokens = []
            for text in batch["text"].to_pylist():
                pre_tokens = word_pre_tokens(text)
                if pre_tokens is None:
                    n_tokens.append(len(whole.encode(text, add_special_tokens=False)))
                    continue
                found = [tier_one[w] for w in pre_tokens if w in tier_one]
                total = sum(found)
                if len(found) < len(pre_tokens):
                    rare = [w for w in pre_tokens if w not in tier_one]
                    total += sum(map(memo.of(rare).__getitem__, rare))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(n_tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = sized.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
