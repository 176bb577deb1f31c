from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultscope.functions import terms
from faultscope.functions.text import clean_text
from faultscope.llm.tokens import Memo
from faultscope.operators import case_index, learning, tfidf

TEXTS = ["Ünité ﬁre ½ a Été", "pump pump  PUMP fire", "été", "", None, "ß straße Ǆ x", "Åẛ ㎏ 漢字 ok", "one_two ½kg", "a b"]


def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS * 3)), "id bigint, text string")


def test_batches_count_what_the_columns_count(spark, monkeypatch):
    """Same terms and counts as cut by column expressions, in small lots too, and hashes that stand for terms."""
    monkeypatch.setattr(terms, "LOT", 8)
    docs = rows(spark)
    for ngrams in ((1, 2), (2, 3), (1, 1)):
        want = Counter(tfidf.count_terms(tfidf.add_grams(docs, "text", ngrams), "id").collect())
        got = tfidf.text_postings(docs, "text", "id", ngrams).collect()
        assert Counter((r.id, r.term, r.tf) for r in got) == want
        assert all(terms.hash_of(r.term.encode()) == r.hash for r in got)
        assert Counter(map(tuple, tfidf.hash_postings(docs, "text", "id", ngrams).collect())) == Counter((r.id, r.hash, r.tf) for r in got)
    cleaned = docs.select("id", clean_text(F.col("text")).alias("text"))
    again = tfidf.text_postings(cleaned, "text", "id", (1, 2), cleaned=True).collect()
    assert sorted(again) == sorted(tfidf.text_postings(docs, "text", "id").collect())


def test_only_rare_terms_are_exchanged(spark):
    """Of a table beyond the limit the frequent terms are broadcast; nothing is lost, at any limit."""
    postings = spark.createDataFrame([(d, t, 1) for d in range(20) for t in ["all", f"own{d}", f"pair{d // 2}"]], "id bigint, term string, tf int")
    vocabulary = tfidf.fit_vocabulary(postings, 20)
    for most in (0, 1, 5, 11, 100):
        assert tfidf.join_terms(postings, vocabulary, max_broadcast=most).count() == 60
    near, far = tfidf.split_terms(postings, vocabulary, 5)
    assert near.select("term").distinct().collect() == [("all",)]
    assert far.where("term = 'all'").isEmpty() and far.count() == 40


def test_terms_of_another_hash_are_refused(spark, tmp_path):
    index = case_index.build_index(rows(spark), str(tmp_path / "index"), "id")
    assert case_index.load_index(spark, index.path) == index and index.hashing == case_index.HASHING


def test_forest_statistics_leave_room_for_four_tasks():
    assert learning.classifier(learning.FULL_FOREST, 100).getMaxMemoryInMB() <= 256


def test_known_pre_tokens_are_only_joined(monkeypatch):
    memo = Memo(lambda words: [w.encode() for w in words])
    assert memo.joined(["a", "b", "a"]) == b"aba" and memo.joined([]) == b""
    monkeypatch.setattr(memo, "of", None)
    assert memo.joined(["b", "a"]) == b"ba"


def test_ids_of_pre_tokens_come_without_offsets(monkeypatch):
    """A new pre-token is encoded alone by the library's model, and by itself, where nothing before looked at its text."""
    import numpy as np

    from faultscope.llm import packing, tokens
    from faultscope.llm.queries import vocabulary

    path = vocabulary("byte_bpe_50k.json")
    whole = tokens.tokenizer(path)
    texts = [*filter(None, TEXTS), "".join(map(chr, range(0x180))), "it's  12 3½\n\n x\t\x7f", "\xad\xa0\x85", "x" * 3000, "Σ İ Ⱥ Ⱦ 漢字  🙂  "]
    memo = packing._memo(path)
    monkeypatch.setattr(memo, "of", None)
    for text in texts:
        want = np.asarray(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert memo.joined(tokens.byte_pre_tokens(text)) == want
        assert b"".join(np.asarray(tokens.byte_level_ids(path)(w), "<u4").tobytes() for w in tokens.byte_pre_tokens(text)) == want


def test_computed_results_stay_within_their_number():
    memo = Memo(lambda words: [w.encode() for w in words], most=3)
    assert memo.joined(list("abcdab")) == b"abcdab" and len(memo.each) <= 3


def test_computed_results_stay_within_their_bytes():
    """Long pre-tokens count for what they take, frequent ones stay known, and a worker's other steps keep their room."""
    import tracemalloc

    often = []
    memo = Memo(lambda words: [often.append(w) or b"often" if w == "often" else w.encode() for w in words], most_bytes=8 << 20)
    tracemalloc.start()
    for i in range(30_000):
        assert memo.joined([f"{i:01000}", "often"]) == f"{i:01000}often".encode()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(often) == 1 and held < 10 << 20
    assert memo.joined(["y" * (5 << 20)]) == b"y" * (5 << 20) and len(memo.each) > 0


@pytest.mark.parametrize("ngrams", [(1, 1), (1, 2), (2, 2), (1, 3), (2, 3)])
def test_short_texts_are_counted_together(ngrams):
    texts = [None, b"", b"a", b"ok ok ok", b"pump fire pump fire", b"b", b"fire", b"x"]
    told = [terms.words_of(t) for t in texts]
    together, singly = terms._counted_together(told, *ngrams), terms._counted_singly(told, *ngrams)
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(together, singly))
    assert all(a.tolist() == b.tolist() for a, b in zip(terms._counted_together([], *ngrams), terms._counted_singly([], *ngrams)))
