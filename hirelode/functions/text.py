"""String helpers that compile to JVM expressions."""

from __future__ import annotations

import functools
import html.entities
import json
import operator
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode classes, and "." stops at "\n" only.
UNICODE = "(?Ud)"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def quote(word: str) -> str:
    """`word` as a literal inside a regular expression."""
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|/&#" else ch for ch in word)


def any_of(words: Iterable[str]) -> str:
    return "|".join(quote(w) for w in dict.fromkeys(words))


def literal(words: Iterable[str]) -> str:
    """SQL array literal of a word list: one expression instead of one call per word."""
    quoted = (w.replace("\\", "\\\\").replace("'", "\\'") for w in words)
    return "array(" + ", ".join(f"'{w}'" for w in quoted) + ")"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once, however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# All Unicode blanks, and the four ASCII separators.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def utrim(value: Column | str) -> Column:
    """Trim every Unicode blank, not only U+0020."""
    return F.btrim(col(value), F.lit(BLANKS))


def text_or_blank(value: Column | str) -> Column:
    return F.coalesce(col(value), F.lit(""))


def non_blank(value: Column | str) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(utrim(value), F.lit(""))


def first_non_empty(*candidates: Column | str, default: str | None = None) -> Column:
    """First candidate with visible text, else `default`."""
    return F.coalesce(*[non_blank(c) for c in candidates], F.lit(default))


def first_only(first: Column | str, default: str) -> Column:
    """First-generation variant: only the first candidate counts, blank or not."""
    return F.coalesce(non_blank(first), F.lit(default))


def first_match(cases: Iterable[tuple[Column, object]], default: object) -> Column:
    """CASE over ordered (condition, value) pairs."""
    branches = list(cases)
    chosen = F.when(*branches[0])
    for condition, value in branches[1:]:
        chosen = chosen.when(condition, value)
    return chosen.otherwise(default)


def needed(words: Iterable[str]) -> list[str]:
    """Words that decide a substring test: one that contains another of the list does not."""
    distinct = list(dict.fromkeys(words))
    return [w for w in distinct if not any(o != w and o in w for o in distinct)]


def contains_any(value: Column | str, words: Iterable[str]) -> Column:
    """Whether a word occurs as a substring; for short texts and long lists."""
    return col(value).rlike(any_of(needed(words)))


def has_any(value: Column | str, words: Iterable[str]) -> Column:
    """The same as byte searches, for long texts and a few words."""
    return functools.reduce(operator.or_, (col(value).contains(w) for w in needed(words)))


def contains_whole_word(value: Column | str, *words: str) -> Column:
    return col(value).rlike(rf"{UNICODE}\b(?:{any_of(words)})\b")


def fold_umlauts(value: Column | str) -> Column:
    """Trimmed lower-case text with German umlauts spelled out; null becomes blank."""
    folded = F.lower(utrim(text_or_blank(value)))
    for letter, spelled in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        folded = F.replace(folded, F.lit(letter), F.lit(spelled))
    return folded


def clean_text(value: Column | str) -> Column:
    """Lower-case words of ASCII letters and digits, one blank between them."""
    words = F.regexp_replace(F.lower(text_or_blank(value)), "[^a-z0-9]+", " ")
    return F.btrim(words)


def tokens(value: Column | str) -> Column:
    """Distinct words of the cleaned text."""
    words = F.split(F.lower(text_or_blank(value)), "[^a-z0-9]+")
    return F.array_remove(F.array_distinct(words), "")


def unquote(value: Column | str) -> Column:
    """Percent-decoding that leaves "+" and what is no escape alone."""
    raw = col(value)
    escapes = F.regexp_replace(raw, "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(F.replace(escapes, F.lit("+"), F.lit("%2B")))
    return F.when(raw.contains("%"), F.coalesce(decoded, raw)).otherwise(raw)


def form_encode(value: Column | str) -> Column:
    """Query-string encoding: blank as "+", "~" kept, "*" escaped."""
    encoded = F.url_encode(col(value))
    encoded = F.replace(encoded, F.lit("%7E"), F.lit("~"))
    return F.replace(encoded, F.lit("*"), F.lit("%2A"))


# The characters of HTML: all named references, those that need no semicolon, the numbers that stand for
# another code page, and those that stand for nothing.
_NAMED = {f"&{name}": chars for name, chars in html.entities.html5.items() if name.endswith(";")}
_BARE = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_CODE_PAGE = {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
_REFERENCE = "&(?:[A-Za-z][A-Za-z0-9]*+|#[0-9]++|#[xX][0-9A-Fa-f]++);?"
_PIECE = f"({_REFERENCE}|[^&]++|&)"


def unescape_html(value: Column | str) -> Column:
    """Replace named and numeric character references, each once, from left to right.

    A reference may lack its semicolon if it is a number or one of the names that never needed one, of
    which the longest that the text begins with counts.
    """
    named = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>")
    code_page = F.from_json(F.lit(json.dumps(_CODE_PAGE)), "map<string,string>")

    def numeric(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^&#[xX]?0*([0-9A-Fa-f]*);?$", 1)
        sixteen = piece.rlike("^&#[xX]")
        # Longer ones are beyond the last character, and too long to convert.
        short = F.length(digits) <= F.when(sixteen, 6).otherwise(7)
        whole = F.when(short, F.concat(F.lit("0"), digits)).otherwise("1114112")
        base16 = F.when(sixteen & short, whole).otherwise(F.conv(whole, 10, 16))
        point = F.conv(base16, 16, 10)
        number = point.cast("bigint")
        nothing = (
            number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127)
            | number.between(0xFDD0, 0xFDEF) | (number % 65536 >= 65534)
        )
        return (
            F.when((number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), "\ufffd")
            .when(nothing, "")
            .when(number.between(0x80, 0x9F), F.try_element_at(code_page, point))
            .otherwise(F.decode(F.unhex(F.lpad(base16, 8, "0")), "UTF-32"))
        )

    def by_name(piece: Column) -> Column:
        bare = F.regexp_extract(piece, f"^&(?:{'|'.join(_BARE)})", 0)
        chars = F.try_element_at(named, F.concat(bare, F.lit(";")))
        rest = F.substring(piece, F.length(bare) + 1, F.length(piece))
        return F.coalesce(F.try_element_at(named, piece), F.when(bare != "", F.concat(chars, rest)), piece)

    def decoded(piece: Column) -> Column:
        meant = F.when(piece.startswith("&#") & (F.length(piece) > 2), numeric(piece)).otherwise(by_name(piece))
        return F.when(piece.startswith("&") & (piece != "&"), meant).otherwise(piece)

    def replaced(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(f"(?s){_PIECE}"))
        new = F.array_join(F.transform(pieces, decoded), "")
        return F.when(text.contains("&"), new).otherwise(text)

    return let(col(value), replaced)


def round_half_even(value: Column, digits: int = 2) -> Column:
    """Round the exact binary value, ties to even, as correct decimal printing does.

    `round` and `bround` look at the shortest decimal spelling instead: 2.675 is stored below the
    tie and has to give 2.67. Exact for |value| < 2**20 and up to 3 digits.
    """
    scale = 10**digits
    size = F.abs(value)
    lower = F.floor(size * scale)
    tie = lower * 10 + 5
    head = F.floor(size * 2**20) / F.lit(float(2**20))
    over = (head * (scale * 10) - tie) + (size - head) * (scale * 10)
    up = (over > 0) | ((over == 0) & (lower % 2 == 1))
    rounded = (lower + up.cast("bigint")) / F.lit(float(scale))
    return F.when(value < 0, -rounded).otherwise(rounded)
