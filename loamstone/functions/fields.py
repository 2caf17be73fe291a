"""Both searchable fields of a text as numbers of asked terms, in one pass over the text.

The definition is that of ``text.tokens`` and ``text.ngrams``. A scan that normalizes a text, which
the JVM can't, takes its terms in the same step: a word is cleaned, folded and looked up once for
all its occurrences.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from loamstone.functions.text import CJK, SIGNS

_CJK = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), CJK)
_KEPT_WORDS = 1_000_000


@lru_cache(maxsize=1)
def _blank() -> dict[int, str]:
    """Signs, control characters and every kind of space, each to one space."""
    spaces = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "Z"]
    return dict.fromkeys([*map(ord, SIGNS), *range(0x20), 0x7F, 0x85, *spaces], " ")


_RUN = re.compile(f"[{_CJK}]+|[^{_CJK} ]+")
_IS_CJK = re.compile(f"[{_CJK}]")


class Terms:
    """Numbers of the terms of a vocabulary; -1 stands for every other term."""

    def __init__(self, vocabulary: list[str]):
        self.number = {term: k for k, term in enumerate(vocabulary)}
        self.words: dict[str, tuple[int, int | None]] = {}
        self.blank = _blank()

    def _word(self, word: str) -> tuple[int, int | None]:
        """The number of a word, and of its form without diacritics where that differs and shows."""
        if len(self.words) >= _KEPT_WORDS:
            self.words.clear()
        plain = word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")
        get = self.number.get
        told = self.words[word] = (get(word.lower(), -1), get(plain.lower(), -1) if plain and plain != word else None)
        return told

    def of(self, text: str | None) -> tuple[list[int], list[int]]:
        """The terms of the content field and of the field of pairs and folded words, in order."""
        if not text:
            return [], []
        if not text.isascii():
            text = unicodedata.normalize("NFKC", text)
        clean = text.translate(self.blank)
        known, get = self.words, self.number.get
        whole = [(known.get(word) or self._word(word))[0] for word in clean.split(" ") if word]
        parts: list[int] = []
        for run in _RUN.findall(clean):
            if not run.isascii() and _IS_CJK.match(run):
                parts += [get(run[k : k + 2], -1) for k in range(len(run) - 1)] if len(run) > 1 else [get(run, -1)]
                continue
            number, plain = known.get(run) or self._word(run)
            parts.append(number)
            if plain is not None:
                parts.append(plain)
        return whole, parts
