"""Pre-tokens of byte-pair vocabularies, and caches in front of the library that encodes them.

Both public vocabularies cut a text into pre-tokens that are encoded one by one. Texts are cut here by an
equal pattern of explicit character classes: those of the Latin blocks by a small one that is always
there, others by one of the basic plane, built when first needed, in which characters beyond it have
stand-ins. To the library go, whole, only texts with a special token's string, with characters that this
Python's Unicode tables lack, or whose lower case would be composed anew."""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LAST_LATIN = 0x24F


def _class(test: Callable[[str], bool], last: int = LAST_LATIN) -> str:
    """Ranges of the characters up to the last one, the end of the Latin blocks, that pass a test."""
    out, begin = "", None
    for i in range(last + 2):
        good = i <= last and test(chr(i))
        if good and begin is None:
            begin = i
        elif not good and begin is not None:
            out += re.escape(chr(begin)) + ("" if begin == i - 1 else "-" + re.escape(chr(i - 1)))
            begin = None
    return out


_BLANK = "\t\n\x0b\x0c\r \x85\xa0"
_WIDE_BLANK = _BLANK + "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d"
#: Characters whose lower case leaves the Latin blocks or is two characters, and all beyond them.
_ODD = re.compile("[^\x00-ɏ]|[İȺȾ]")


def _patterns(last: int, blank: str) -> tuple[re.Pattern, re.Pattern]:
    """Patterns of the word and of the byte-level vocabulary for characters up to the last one."""
    letter = _class(lambda c: unicodedata.category(c)[0] == "L", last)
    number = _class(lambda c: unicodedata.category(c)[0] == "N", last)
    word = f"{_CONTRACTED}|[{letter}]+|[{number}]|[^{blank}{letter}{number}]+"
    byte = f"{_CONTRACTED}| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+"
    return re.compile(word), re.compile(byte)


@cache
def _wide() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Both patterns for the basic plane, and one of the characters whose class is not known here."""
    return *_patterns(0xFFFF, _WIDE_BLANK), re.compile(f"[{_class(lambda c: unicodedata.category(c) in ('Cn', 'Cs'), 0xFFFF)}]")


_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _stand_in(found: re.Match) -> str:
    """A character of the basic plane of the same class."""
    kind = unicodedata.category(found[0])
    return "\uffff" if kind == "Cn" else {"L": "ª", "N": "½"}.get(kind[0], "\ue000")


def _cut(text: str, which: int) -> list[str] | None:
    plain, patterns = _BEYOND.sub(_stand_in, text), _wide()
    if patterns[2].search(plain):
        return None
    if plain == text:
        return patterns[which].findall(text)
    return [text[m.start():m.end()] for m in patterns[which].finditer(plain)]


WORD_PATTERN, BYTE_PATTERN = _patterns(LAST_LATIN, _BLANK)
SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")


def word_pre_tokens(text: str) -> list[str] | None:
    """Pre-tokens of the lower-casing word vocabulary, or None where only the library is exact."""
    if "<|" in text and SPECIAL.search(text):
        return None
    if not _ODD.search(text):
        return WORD_PATTERN.findall(text.lower())
    # The library lowers character by character, so a last sigma is like any other.
    low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return _cut(low, 0) if unicodedata.is_normalized("NFC", low) else None


def byte_pre_tokens(text: str) -> list[str] | None:
    """Pre-tokens of the byte-level vocabulary, or None where only the library is exact."""
    if "<|" in text and SPECIAL.search(text):
        return None
    try:
        text.encode("latin-1")  # the quickest proof that no character is an odd one
    except UnicodeEncodeError:
        if _ODD.search(text):
            return _cut(text, 1)
    return BYTE_PATTERN.findall(text)


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Characters that stand for the bytes of a pre-token in byte-level vocabularies: themselves if printable, else those from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_STANDS_FOR = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(_PRINTABLE)))}


def byte_level_ids(path: str) -> Callable[[str], list[int]] | None:
    """The ids of one pre-token by the library's model alone, without the offsets that it keeps for whole texts; None if
    the vocabulary does more to a text than byte-level pre-tokens."""
    from tokenizers import pre_tokenizers

    whole = tokenizer(path)
    cut = whole.pre_tokenizer
    if whole.normalizer is not None or not isinstance(cut, pre_tokenizers.ByteLevel) or cut.add_prefix_space:
        return None
    tokenize, blank = whole.model.tokenize, chr(_STANDS_FOR[32])

    def ids(word: str) -> list[int]:
        plain = word.isascii() and word.isprintable()
        return [t.id for t in tokenize(word.replace(" ", blank) if plain else word.encode().decode("latin-1").translate(_STANDS_FOR))]

    return ids


#: What a table takes for an entry beside its key and value, at most.
_ENTRY_BYTES = 100


class _Computed(dict):
    """Computes what it does not have. At half of ``most`` results or ``most_bytes`` it begins anew; what it held
    until then is still taken from there, so that frequent pre-tokens stay known."""

    def __init__(self, compute: Callable[[list[str]], Iterable], most: int, most_bytes: int):
        super().__init__()
        self.compute, self.most, self.most_bytes, self.held, self.older = compute, most, most_bytes, 0, {}

    def __missing__(self, pre_token: str):
        found = self.older.get(pre_token)
        if found is None:
            (found,) = self.compute([pre_token])
        size = sys.getsizeof(pre_token) + sys.getsizeof(found) + _ENTRY_BYTES
        if size > self.most_bytes // 2:
            return found
        if len(self) >= max(1, self.most // 2) or self.held + size > self.most_bytes // 2:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self.held += size
        self[pre_token] = found
        return found


class Memo:
    """Remembers results by pre-token for as long as a worker lives; begins anew beyond ``most`` of them or, where
    results are joined, beyond ``most_bytes``, since other steps share the worker."""

    def __init__(self, compute: Callable[[list[str]], Iterable], most: int = 400_000, most_bytes: int = 48 << 20):
        self.compute, self.most, self.known, self.each = compute, most, {}, _Computed(compute, most, most_bytes)

    def of(self, pre_tokens: Iterable[str]) -> dict:
        """A table that has at least these pre-tokens."""
        missing = [w for w in set(pre_tokens) if w not in self.known]
        if len(self.known) + len(missing) > self.most:
            self.known = {}
            missing = list(set(pre_tokens))
        for a in range(0, len(missing), 20_000):
            part = missing[a:a + 20_000]
            self.known.update(zip(part, self.compute(part), strict=True))
        return self.known

    def joined(self, pre_tokens: list[str]) -> bytes:
        """Results in a row; each new one is computed where it stands."""
        return b"".join(map(self.each.__getitem__, pre_tokens))
