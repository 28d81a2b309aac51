"""Text functions as Column expressions.

White space is Unicode's throughout, spelled out as a class so that SQL engines without Java's
``(?U)`` read the same patterns. Case folding is ASCII's unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, for use inside a character class; Java's and RE2's syntax alike.
SPACE = r" \t\n\x0b\f\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Sentence ends, closing marks that stay with their sentence, marks of noise.
TERMINATORS = "。．.｡！!？?"
CLOSERS = "」』）)】〉"
NOISE = "!?！？。、"
# Marks trimmed off tokens, parts of speech that carry content, stop words.
TOKEN_MARKS = "'\"`“”、。,.:;()[]{}!?"
CONTENT_POS = ["名詞", "動詞", "形容詞", "副詞", "カスタム", "固有名詞"]
STOPWORDS = [
    "する", "なる", "ある", "いる", "こと", "もの", "これ", "それ", "あれ", "ため", "よう", "そして", "しかし",
    "the", "a", "an", "and", "or", "of", "to", "for", "with", "this", "that", "from", "have", "has", "was", "were", "been", "is", "are", "it",
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def char_class(chars: str) -> str:
    """The characters, escaped for use inside a class."""
    return "".join("\\" + c if c in r"[]\^-." else c for c in chars)


TRIM = rf"^[{SPACE}]+|[{SPACE}]+$"
PIECES = rf"[^{char_class(TERMINATORS)}]*[{char_class(TERMINATORS)}](?:[{SPACE}]*[{char_class(CLOSERS)}!?！？])*|[^{char_class(TERMINATORS)}]+$"
HEAD = rf"^[^{char_class(TERMINATORS)}]*[{char_class(TERMINATORS)}]?"
MARKS = rf"^[{char_class(TOKEN_MARKS)}]+|[{char_class(TOKEN_MARKS)}]+$"
LINE_END = r"[\r\n]+\z"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, TRIM, "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def is_blank(c: Column) -> Column:
    return ~F.rlike(c, F.lit(rf"[^{SPACE}]"))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def collapse(c: Column) -> Column:
    """White-space runs become one blank; none at the ends."""
    return trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def strip_line_end(c: Column) -> Column:
    """All line feeds and carriage returns at the end go."""
    return F.regexp_replace(c, LINE_END, "")


def _piece(p: Column) -> Column:
    head = F.regexp_extract(p, HEAD, 0)
    return F.concat(trim(head), F.regexp_replace(F.substr(p, F.length(head) + 1), f"[{SPACE}]", ""))


def sentences(text: Column, newline_boundary: bool = True) -> Column:
    """An array of sentences; closing marks and runs of ! and ? stay with the sentence before. Blank or null text: none."""
    segments = F.split(F.coalesce(text, F.lit("")), "\n", -1) if newline_boundary else F.array(F.coalesce(text, F.lit("")))
    cut = F.flatten(F.transform(segments, lambda s: F.regexp_extract_all(s, F.lit(PIECES), F.lit(0))))
    return F.filter(F.transform(cut, _piece), lambda s: s != "")


def is_noise(sentence: Column) -> Column:
    return F.rlike(sentence, F.lit(f"^[{NOISE}]*$"))


def first_sentences(text: Column, count: int) -> Column:
    return F.slice(sentences(text), 1, count) if count > 0 else F.array().cast("array<string>")


def fallback_sentence(text: Column) -> Column:
    """Struct (position, text) of the first sentence that isn't noise, or null."""
    numbered = F.transform(sentences(text), lambda s, i: F.struct(i.alias("position"), s.alias("text")))
    return F.get(F.filter(numbered, lambda s: ~is_noise(s["text"])), F.lit(0))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def normalised_token(surface: Column) -> Column:
    """The token less marks at its ends, ASCII ones in lower case; null if nothing or a single ASCII letter is left."""
    t = F.regexp_replace(trim(surface), MARKS, "")
    t = F.when(is_ascii(t), ascii_lower(t)).otherwise(t)
    return F.when((t != "") & ~t.rlike("^[a-z]$"), t)


def is_stopword(token: Column) -> Column:
    return token.isin(STOPWORDS)


def is_content_word(pos: Column, surface: Column) -> Column:
    return (F.size(pos) > 0) & (F.get(pos, F.lit(0)).isin(CONTENT_POS) | surface.rlike("[A-Za-z]"))


def preferred_form(normalized: Column, dictionary: Column, surface: Column) -> Column:
    """The first of the two forms that is neither blank nor a star, else the surface; trimmed."""
    usable = lambda c: F.when(~is_blank(c) & (trim(c) != "*"), trim(c))
    return F.coalesce(usable(normalized), usable(dictionary), trim(surface))


def since_seconds(now_seconds: Column, days: Column | int) -> Column:
    days = days if isinstance(days, Column) else F.lit(days)
    return F.greatest(now_seconds.cast("long") - days.cast("long") * 86400, F.lit(0).cast("long"))


def matches_extension(path: Column, extensions: Column) -> Column:
    return F.exists(extensions, lambda e: F.endswith(ascii_lower(path), e))


def effective_extensions(extensions: Column) -> Column:
    given = F.transform(extensions, lambda e: ascii_lower(trim(e)))
    return F.when(extensions.isNull() | (F.size(extensions) == 0), F.array(F.lit(".md"), F.lit(".markdown"))).otherwise(given)
