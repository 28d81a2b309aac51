"""Sentences and content tokens of one text in Python, for kernels: the same as text.py's and tokenizers.py's "whitespace"."""

from __future__ import annotations

import re

from docloom.functions import text as T

_SPACE = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", T.SPACE)
_BLANKS = re.compile(f"[{_SPACE}]+")
_BLANK = "".join(filter(_BLANKS.fullmatch, map(chr, range(0x10000))))
_END = re.compile(f"[{T.char_class(T.TERMINATORS)}]")
_PIECES = re.compile(T.PIECES.replace(T.SPACE, _SPACE).removesuffix("$") + r"\Z")
#: Python's white space that is none here.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Words whose tokens a worker remembers; with more it begins anew.
CACHE_WORDS = 200_000


class _Tokens(dict):
    """word: its token, empty if it is none."""

    def __missing__(self, word: str) -> str:
        t = word.strip(T.TOKEN_MARKS)
        t = t.lower() if t.isascii() else t
        t = "" if t in _STOP or (len(t) == 1 and "a" <= t <= "z") else t
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = t
        return t


_STOP = frozenset(T.STOPWORDS)
_tokens = _Tokens()


def _piece(p: str) -> str:
    end = _END.search(p)
    if end is None or end.end() == len(p):
        return p.strip(_BLANK)
    return p[: end.end()].strip(_BLANK) + _BLANKS.sub("", p[end.end() :])


def sentences(text: str | None, newline_boundary: bool = True) -> list[str]:
    segments = (text or "").split("\n") if newline_boundary else [text or ""]
    return [s for g in segments for p in _PIECES.findall(g) if (s := _piece(p))]


def content_tokens(sentence: str) -> list[str]:
    words = filter(None, _BLANKS.split(sentence)) if _SEPARATORS.search(sentence) else sentence.split()
    return [*filter(None, map(_tokens.__getitem__, words))]


def nodes(text: str | None, newline_boundary: bool = True, min_sentence_length: int = 25) -> tuple[list[int], list[list[str]]]:
    """Positions and tokens of the sentences that are long enough and have tokens. Positions count all sentences."""
    found = [(k, content_tokens(s)) for k, s in enumerate(sentences(text, newline_boundary)) if len(s) >= min_sentence_length]
    return [k for k, t in found if t], [t for _, t in found if t]
