"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF word shingles.

1. Shingle counts of all documents meet in shards (``exchange``), which return document frequencies.
2. A document can reach the threshold with another one only if that share of its own weight lies in
   shingles that some other document has; all others are done.
3. The rest draw samples. One sample of a document is the shingle with the smallest
   value and its quantised weight; two documents agree on it with the probability of their weighted
   Jaccard similarity. Equal samples of a whole band make a candidate.
4. In each bucket, members are compared by exact weighted Jaccard similarity with a head, then with
   more heads in rounds, but never with members that links have already joined. The first head is the member whose
   shingles are the most common ones: of copies that were edited here and there it is the text they
   come from, which joins them in one round. A pair meets in one bucket only, that of the first band it shares.
5. Links at or above the threshold give components.

A shingle's weight is its count times sqrt(1 + ln(N / df) / ln N), between count and 1.42 times that.
Plain IDF would give the few edited words of a copy many times the weight of what a large group of
copies shares, and no copy of such a group would be found."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.llm import exchange
from faultscope.llm.common import arrow_table, bytes_of, whole_texts
from faultscope.llm.components import component_of
from faultscope.llm.words import batches, mix, windows_of, words_of
from faultscope.session import materialize

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 6
#: Samples drawn; the first ``BANDS * ROWS`` make the bands, all of them the estimate before a comparison.
SAMPLES = 256
BITS = 48
#: Text that is cut into shingles at once, and weighted shingles that are sampled at once.
_LOT_BYTES, _LOT_KEYS = 1 << 19, 1 << 16
#: Standard deviations by which samples may differ more often than expected at the threshold: a chance of 2e-4 for a pair exactly there.
DEVIATIONS = 3.5
_OWN = ("doc_id", "rank", "whole", "shared", "nibbles", "bands")
ANSWER = "chunk int, shard int, shared binary, frequency binary"
SKETCH = "doc_id bigint, digest binary, copy_of bigint, rank bigint, bands array<bigint>, nibbles array<bigint>, keys binary, weights binary, whole double, shared double"
_REQUEST = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("digests", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int32()), ("shard", pa.int32()), ("shared", pa.binary()), ("frequency", pa.binary())])
_SKETCH = pa.schema([
    ("doc_id", pa.int64()), ("digest", pa.binary()), ("copy_of", pa.int64()), ("rank", pa.int64()), ("bands", pa.list_(pa.int64())), ("nibbles", pa.list_(pa.int64())),
    ("keys", pa.binary()), ("weights", pa.binary()),
    ("whole", pa.float64()), ("shared", pa.float64()),
])


def shingles(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, shingle and count, by owner and shingle. A text of fewer words than ``width`` has one
    shingle of all its words, a text without words none."""
    parts = []
    for a, b in batches([len(t) for t in texts], _LOT_BYTES):
        words = words_of(texts[a:b])
        n, owner = words.counts(), words.owners()
        found = []
        for size in [width, *range(1, width)]:
            if size < width and not (n == size).any():
                continue
            digests, start = windows_of(words, size)
            of = owner[start]
            if size < width:
                short = n[of] == size
                digests, of = digests[short], of[short]
            found.append((of + a, digests >> np.uint64(64 - BITS)))
        owner, key = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((key, owner))
        owner, key = owner[order], key[order]
        new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])))) if len(key) else np.empty(0, np.int64)
        parts.append((owner[new], key[new], np.diff(np.append(new, len(key)))))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    owner, key, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    return owner, key, count


def idf(frequency: np.ndarray, n_docs: int) -> np.ndarray:
    return np.sqrt(1 + np.log(n_docs / np.minimum(frequency, n_docs)) / np.log(max(n_docs, 2)))


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 at the middles of n equal parts, by bisection."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 64.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


_GAMMA = _gamma_quantiles()
_LOG_GAMMA = np.log(_GAMMA)


def weighted_samples(key: np.ndarray, weight: np.ndarray, starts: np.ndarray, n_samples: int) -> np.ndarray:
    """Per weighted set (rows; sets begin at ``starts`` and are sorted by key) its consistent samples.

    Sets are taken in lots, so that what is held beside the result does not grow with their number."""
    ends = np.append(starts[1:], len(key))
    out = np.empty((len(starts), n_samples), dtype=np.uint64)
    for a, b in batches((ends - starts).tolist(), _LOT_KEYS):
        at = slice(starts[a], ends[b - 1])
        out[a:b] = _samples(key[at], weight[at], starts[a:b] - starts[a], n_samples)
    return out


def _samples(key: np.ndarray, weight: np.ndarray, starts: np.ndarray, n_samples: int) -> np.ndarray:
    log_weight = np.log(weight)
    sizes = np.diff(np.append(starts, len(key)))
    out = np.empty((len(starts), n_samples), dtype=np.uint64)
    for j in range(n_samples):
        bits = mix(key ^ mix(np.full(1, j + 1, dtype=np.uint64)))
        r = _GAMMA[bits & np.uint64(0xFFFF)]
        beta = (bits >> np.uint64(32)).astype(np.float64) / (1 << 32)
        t = np.floor(log_weight / r + beta)
        value = _LOG_GAMMA[(bits >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (t - beta + 1)
        hit = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, starts), sizes))
        best = hit[np.searchsorted(hit, starts)]
        out[:, j] = mix(key[best] ^ mix(t[best].astype(np.int64).view(np.uint64)))
    return out


def band_digests(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(samples), bands), dtype=np.uint64)
    for k in range(rows):
        out = mix(out ^ samples[:, k::rows][:, :bands])
    return out.view(np.int64)


def nibbles_of(samples: np.ndarray) -> np.ndarray:
    """The lowest four bits of all samples, 16 samples to a 64-bit value."""
    n, width = samples.shape
    out = np.zeros((n, -(-width // 16) * 16), dtype=np.uint64)
    out[:, :width] = samples & np.uint64(15)
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return np.bitwise_or.reduce(out.reshape(n, -1, 16) << shifts, axis=2).view(np.int64)


def unlike(a: str, b: str) -> Column:
    """In how many samples two arrays of nibbles differ."""
    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    return F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda total, n: total + n)


def most_unlike(n_samples: int, similarity: float, deviations: float | None) -> float:
    """Differing nibbles that two documents at the threshold exceed by so many standard deviations only."""
    if deviations is None:
        return n_samples
    q = (1 - similarity) * 15 / 16
    return n_samples * q + deviations * (n_samples * q * (1 - q)) ** 0.5


def met_before(a: str, b: str, band: str) -> Column:
    """Whether two documents share a band before this one."""
    earlier = (F.slice(x, F.lit(1), F.col(band)) for x in (a, b))
    return F.exists(F.zip_with(*earlier, lambda x, y: x == y), lambda same: same)


def _ranks(centrality: np.ndarray, ids: list[int]) -> np.ndarray:
    """Numbers that order documents by centrality (0 to 1), then by a hash of their id."""
    order = mix(np.array(ids, dtype=np.int64).view(np.uint64)) >> np.uint64(24)
    return ((np.clip(centrality, 0, 1) * ((1 << 22) - 1)).astype(np.int64) << 40) | order.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / (float(a[1].sum()) + float(b[1].sum()) - both)


def sketches(docs: DataFrame, similarity: float, bands: int, rows: int) -> DataFrame:
    """Band digests and weighted shingles of the documents that can have a near duplicate.

    Of equal texts of a chunk the one of the smallest id has them; the others name it in ``copy_of``, so that
    a text meets itself once for each chunk and not for each copy."""
    chunks = exchange.plan_chunks(docs, "doc_id", "text")
    shards, n_docs = chunks.shards, chunks.rows
    dealt = docs.withColumn("chunk", chunks.number(F.col("doc_id"))).groupBy("chunk")

    def ask(chunk: pa.Table) -> pa.Table:
        found, n = np.unique(shingles(bytes_of(chunk["text"]))[1], return_counts=True)
        return arrow_table(exchange.requests(chunk["chunk"][0].as_py(), found, n, shards, BITS), _REQUEST)

    def answer(shard: pa.Table) -> pa.Table:
        asked = shard.to_pylist()
        keys = [exchange.received(r["shard"], r["digests"], shards, BITS) for r in asked]
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, weights=np.concatenate([exchange.unplanes(r["counts"]) for r in asked])).astype(np.int64)[which]
        out = []
        for r, frequency in zip(asked, np.split(total, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
            shared = frequency > 1
            out.append({"chunk": r["chunk"], "shard": r["shard"], "shared": len(shared).to_bytes(4, "little") + np.packbits(shared).tobytes(),
                        "frequency": exchange.planes(frequency[shared])})
        return arrow_table(out, _ANSWER)

    def sketch(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        texts = bytes_of(chunk["text"])
        owner, key, tf = shingles(texts)
        frequency = [np.empty(0, dtype=np.int64)]
        for r in sorted(answers.to_pylist(), key=lambda r: r["shard"]):
            n = int.from_bytes(r["shared"][:4], "little")
            shared = np.unpackbits(np.frombuffer(r["shared"], dtype=np.uint8, offset=4), count=n).astype(bool)
            part = np.ones(n, dtype=np.int64)
            part[shared] = exchange.unplanes(r["frequency"])
            frequency.append(part)
        known, frequency = np.unique(key), np.concatenate(frequency)
        ends = np.searchsorted(owner, np.arange(len(texts) + 1))
        weights = np.empty(len(key), dtype=np.float32)
        whole, shared, common = np.zeros((3, len(texts)))
        for a, b in batches(np.diff(ends).tolist(), _LOT_KEYS):
            at = slice(ends[a], ends[b])
            of, n, df = owner[at] - a, tf[at], frequency[np.searchsorted(known, key[at])]
            weights[at] = weight = n * idf(df, n_docs)
            whole[a:b] = np.bincount(of, weights=weight, minlength=b - a)
            shared[a:b] = np.bincount(of, weights=weight * (df > 1), minlength=b - a)
            common[a:b] = np.bincount(of, weights=n * np.log(df), minlength=b - a) / np.maximum(np.bincount(of, weights=n, minlength=b - a), 1) / np.log(max(n_docs, 2))
        del owner, tf, known, frequency
        open_ = (whole > 0) & (shared >= similarity * whole * (1 - 1e-9))
        ids, firsts, copies = chunk["doc_id"].to_pylist(), {}, []
        digests = [blake2b(t, digest_size=16).digest() if o else b"" for t, o in zip(texts, open_, strict=True)]
        del texts
        for i in sorted((i for i in np.flatnonzero(open_).tolist() if ids[i] is not None), key=ids.__getitem__):
            if firsts.setdefault(digests[i], i) != i:
                copies.append({"doc_id": ids[i], "digest": digests[i], "copy_of": ids[firsts[digests[i]]]})
        taken = np.sort(np.array(list(firsts.values()), dtype=np.int64))
        ranks = _ranks(common[taken], [ids[o] for o in taken])
        sizes = ends[taken + 1] - ends[taken]
        out = []
        for a, b in batches(sizes.tolist(), _LOT_KEYS):
            at = np.concatenate([np.arange(ends[o], ends[o + 1]) for o in taken[a:b]])
            lot_key, lot_weight, lot_ends = key[at], weights[at], np.cumsum(sizes[a:b])
            starts = lot_ends - sizes[a:b]
            samples = weighted_samples(lot_key, lot_weight.astype(np.float64), starts, max(SAMPLES, bands * rows))
            signed, nibbles = band_digests(samples[:, :bands * rows], bands, rows), nibbles_of(samples)
            out.append(arrow_table([
                {"doc_id": ids[o], "digest": digests[o], "rank": int(ranks[a + k]), "bands": signed[k].tolist(), "nibbles": nibbles[k].tolist(),
                 "keys": int(y - x).to_bytes(4, "little") + exchange.pack(lot_key[x:y], 0), "weights": lot_weight[x:y].tobytes(),
                 "whole": float(whole[o]), "shared": float(shared[o])}
                for k, (o, x, y) in enumerate(zip(taken[a:b], starts, lot_ends, strict=True))], _SKETCH))
        return pa.concat_tables([*out, arrow_table(copies, _SKETCH)])

    answers = dealt.applyInArrow(ask, exchange.REQUEST).groupBy("shard").applyInArrow(answer, ANSWER)
    found = dealt.cogroup(answers.groupBy("chunk")).applyInArrow(sketch, SKETCH)
    return materialize(found, "sketches")


def _vector(keys: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    return exchange.unpack(keys[4:], int.from_bytes(keys[:4], "little"), 0), np.frombuffer(weights, dtype=np.float32).astype(np.float64)


def _similarities(pairs):
    for batch in (whole.slice(a, 256) for whole in pairs for a in range(0, whole.num_rows, 256)):
        rows = zip(*(batch[c].to_pylist() for c in ("u_keys", "u_weights", "v_keys", "v_weights")), strict=True)
        alike = [weighted_jaccard(_vector(a, b), _vector(c, d)) for a, b, c, d in rows]
        yield pa.RecordBatch.from_arrays([batch["u"], batch["v"], pa.array(alike, pa.float64())], names=["u", "v", "similarity"])


def _texts_joined(members: DataFrame, vectors: DataFrame, similarity: float, bound: float) -> DataFrame:
    """``doc_id`` and ``root`` of the documents that links join to a smaller id.

    ``members`` are rows of ``band``, ``bucket`` and ``_OWN``. A round compares the heads of each bucket
    with its members of other components, then takes the heads out of it, and joins components. So
    every two members of a bucket are compared unless they meet in another one, other links have joined them, their weights
    rule the threshold out (what two documents have in common is at most the lesser ``shared``) or
    their samples differ in more than ``bound`` places. A bucket's first
    head is the one of highest rank; then heads are drawn by hash, four times as many each round, so that rounds are few."""
    u = vectors.select(F.col("doc_id").alias("u"), F.col("keys").alias("u_keys"), F.col("weights").alias("u_weights"))
    v = vectors.select(F.col("doc_id").alias("v"), F.col("keys").alias("v_keys"), F.col("weights").alias("v_weights"))
    members = members.withColumn("component", F.col("doc_id"))
    roots, n_heads = None, 1

    def possible(common: Column, rest: Column) -> Column:
        return common >= F.lit(similarity * (1 - 1e-5)) * rest

    while True:
        first = roots is None
        lot = -F.col("rank") if first else F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 32) - 1))
        buckets = members.groupBy("band", "bucket").agg(
            F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.min(lot).alias("least"),
            F.max("shared").alias("most"), F.min("whole").alias("lightest"))
        drawn = (lot == F.col("least")) | (F.lit(False) if first else lot < F.lit(float(1 << 32)) * n_heads / F.col("n"))
        open_ = members.join(buckets.where("low < high"), ["band", "bucket"])
        common = F.least("shared", "most")
        open_ = open_.where(possible(common, F.col("whole") + F.greatest(F.col("lightest") - common, F.lit(0.0))))
        open_ = materialize(open_.select("band", "bucket", *_OWN, "component", drawn.alias("is_head")), "open-buckets")
        if open_.isEmpty():
            return roots
        heads = open_.where("is_head").select("band", "bucket", *[F.col(c).alias("head" if c == "doc_id" else f"head_{c}") for c in (*_OWN, "component")])
        common = F.least("shared", "head_shared")
        pairs = open_.join(heads, ["band", "bucket"]).where(
            (F.col("component") != F.col("head_component")) & possible(common, F.col("whole") + F.col("head_whole") - common)
            & (unlike("nibbles", "head_nibbles") <= F.lit(bound)) & ~met_before("bands", "head_bands", "band"))
        pairs = pairs.select(F.greatest("doc_id", "head").alias("u"), F.least("doc_id", "head").alias("v")).distinct()
        checked = pairs.join(u, "u").join(v, "v").mapInArrow(_similarities, "u bigint, v bigint, similarity double")
        links = materialize(checked.where(F.col("similarity") >= similarity).select("u", "v"), "links")
        roots = component_of(links if roots is None else links.union(roots.select(F.col("doc_id").alias("u"), F.col("root").alias("v"))))
        roots = roots.withColumnRenamed("node", "doc_id")
        members = open_.where("NOT is_head").drop("component", "is_head").join(roots, "doc_id", "left").select("band", "bucket", *_OWN, F.coalesce("root", "doc_id").alias("component"))
        n_heads *= 4


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text", deviations: float | None = DEVIATIONS,
) -> DataFrame:
    """``doc_id`` and ``class_id`` of every row: the smallest id of its component of near duplicates.

    Equal texts are one class. A null text or one without words is a class of its own, like a
    document without a near duplicate. Rows of null id get a null class and link to nothing; rows of
    equal id are one document with several texts. Other columns are ignored. ``deviations`` bounds the
    differing samples of a pair that is compared; with None every pair that shares a band is compared
    exactly unless its weights rule it out."""
    docs = whole_texts(docs, doc_id, text)
    every = sketches(docs, similarity, bands, rows)
    texts = every.where("copy_of IS NULL")
    first = texts.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    named = materialize(texts.select("doc_id", "digest").join(first, "digest"), "copies")
    vectors = materialize(texts.join(first.withColumnRenamed("first_id", "doc_id"), ["digest", "doc_id"], "left_semi"), "distinct-texts")
    members = vectors.select(*_OWN, F.posexplode("bands").alias("band", "bucket"))
    bound = most_unlike(max(SAMPLES, bands * rows), similarity, deviations)
    roots = _texts_joined(members, vectors.select("doc_id", "keys", "weights"), similarity, bound)
    if roots is None:
        found = named.select("doc_id", "digest", F.col("first_id").alias("class"))
    else:
        found = named.join(roots.withColumnRenamed("doc_id", "first_id"), "first_id", "left").select("doc_id", "digest", F.coalesce("root", "first_id").alias("class"))
    copies = every.where("copy_of IS NOT NULL").select(F.col("doc_id").alias("copy"), "digest", F.col("copy_of").alias("doc_id"))
    copied = copies.join(found, ["doc_id", "digest"]).select(F.col("copy").alias("doc_id"), "class")
    classes = found.select("doc_id", "class").union(copied).groupBy("doc_id").agg(F.min("class").alias("class"))
    return docs.select("doc_id").join(classes, "doc_id", "left").select("doc_id", F.coalesce("class", "doc_id").alias("class_id"))
