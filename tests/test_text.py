import re
import sys
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from faultscope.functions import text as tx


def python_clean(s):
    """Independent check of the cleaner: decompose, keep ASCII, letters and underscores only."""
    s = "" if s is None else s
    kept = "".join(c for c in unicodedata.normalize("NFKD", s) if ord(c) < 128).lower()
    return " ".join(re.findall("[a-z_]+", kept))


def test_clean_known_cases(column):
    cases = {
        "fumée décès brûlé": "fumee deces brule",
        "l’alimentation œdème ½ 39°C x_y — NBSP fin": "lalimentation deme c x_y nbsp fin",
        "overheating": "overheating",
        "ﬁn 5㎏ ℡ (⒜) Ⅳ": "fin kg tel a iv",
        None: "",
        "  A1B2\x1c\x1f--C\n": "a b c",
        "": "",
    }
    assert column(tx.clean_text, list(cases)) == list(cases.values())


def test_clean_every_code_point(column):
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    lines = ["".join(f"a{c}b " for c in chars[i:i + 500]) for i in range(0, len(chars), 500)]
    assert column(tx.clean_text, lines) == [python_clean(t) for t in lines]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=200))
def test_clean_random_text(spark, texts):
    texts = [t.replace("\x00", "") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    got = [r[1] for r in df.select("i", tx.clean_text(F.col("v"))).orderBy("i").collect()]
    assert got == [python_clean(t) for t in texts]


def test_language_guess(column):
    cases = {
        "the pump is near the patient": "en",
        "le scanner est dans la salle": "fr",
        "": "fr",
        "the le": "fr",
        "the,pump is": "en",
        "the the the le la": "fr",
        None: "fr",
        "the\nis le": "fr",
    }
    assert column(tx.guess_language, list(cases)) == list(cases.values())


def test_ngrams(column):
    got = column(lambda v: tx.word_ngrams(tx.words(tx.clean_text(v)), 1, 2), ["The red X pump!", "one", "", "a b c"])
    assert got == [["the", "red", "pump", "the red", "red pump"], ["one"], [], []]
    got = column(lambda v: tx.word_ngrams(tx.words(tx.clean_text(v)), 1, 3), ["aa bb cc"])
    assert got == [["aa", "bb", "cc", "aa bb", "bb cc", "aa bb cc"]]


def test_clip(column):
    got = column(lambda v: tx.clip_text(v, 4), ["  ab\x00cdef ", None, "abc\n", "\x1cx "])
    assert got == ["abcd", "", "abc", "x"]
    assert column(lambda v: tx.clip_text(v, None), ["x" * 50000]) == ["x" * 50000]


def test_labels_and_percent(column):
    assert column(tx.decision_label, [0.5, 0.49, 1.0], "double") == ["Critique", "Pas critique", "Critique"]
    assert column(lambda v: tx.decision_label(v, 0.9), [0.5, 0.95], "double") == ["Pas critique", "Critique"]
    assert column(tx.confidence_percent, [0.1234], "double") == [12.3]
    assert column(lambda v: tx.ensure_str(v, floating=True), [1.5, float("nan"), None], "double") == ["1.5", "", ""]
    assert column(tx.plain_lower, ["ÉaB"]) == ["éab"]
