"""Column helpers that give regex, trimming and number parsing the semantics of
dynamic-typed text tools: Unicode classes, ``.`` stopping only at ``\\n``, NULL
(not ``''``) for "no match", and lenient float parsing that never raises."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from papertrail import fixed_values as V
from papertrail.functions.dialect import java_pattern

_EXTRA_SPACE = r"\x1c-\x1f"
_WORD = r"\p{L}\p{N}_"
#: Stands for a user's pattern that does not compile.
BAD_PATTERN = "Invalid pattern"
_DIGITS = [chr(c) for c in range(128, 0x20000) if unicodedata.category(chr(c)) == "Nd"]


def user_pattern(pattern: str | None) -> str | None:
    """A user's pattern in the dialect of ``re`` for java.util.regex, or BAD_PATTERN: not valid, or beyond
    what java.util.regex can do."""
    if pattern is None:
        return None
    return java_pattern(pattern) or BAD_PATTERN


def ascii_digits(col: Column) -> Column:
    """Decimal digits of every script as ASCII digits.  ``col`` stands once in the expression: it may be a search."""
    return F.translate(col, "".join(_DIGITS), "".join(str(unicodedata.decimal(c)) for c in _DIGITS))


#: Patterns with an equivalent that takes linear time.  A run of blanks before an amount is taken from its first blank
#: only; from any other the match would have begun earlier.
LINEAR = {V.PATTERNS["amount"]: r"(?:\$\s*+|(?<!\s)\s++)?\d{1,3}(?:,\d{3})*(?:\.\d{2})?"}


def java_regex(pattern: str, ignore_case: bool = False, dotall: bool = False) -> str:
    """Adapt a pattern to java.util.regex: ``U`` = Unicode classes and case,
    ``d`` = only ``\\n`` ends a line; ``\\s`` also covers the four separators
    U+001C..U+001F, and words are made of letters, all kinds of numbers and ``_``
    (no combining marks)."""
    pattern = LINEAR.get(pattern, pattern)
    out, in_class, i = [], False, 0
    while i < len(pattern):
        step = 2 if pattern[i] == "\\" else 1
        token = pattern[i:i + step]
        if token == r"\s":
            token = r"\s" + _EXTRA_SPACE if in_class else rf"[\s{_EXTRA_SPACE}]"
        elif token == r"\w":
            token = _WORD if in_class else f"[{_WORD}]"
        elif token == r"\b" and not in_class:
            token = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
        elif token == "[":
            in_class = True
        elif token == "]":
            in_class = False
        out.append(token)
        i += step
    return f"(?Ud{'i' if ignore_case else ''}{'s' if dotall else ''})" + "".join(out)


def ascii_regex(pattern: str, ignore_case: bool = False, dotall: bool = False) -> str:
    """``java_regex`` for texts of ASCII only, where plain classes and word borders mean the same and are faster."""
    pattern = LINEAR.get(pattern, pattern)
    out, in_class, i = [], False, 0
    while i < len(pattern):
        step = 2 if pattern[i] == "\\" else 1
        token = pattern[i:i + step]
        if token == r"\s":
            token = r"\s" + _EXTRA_SPACE if in_class else rf"[\s{_EXTRA_SPACE}]"
        in_class = token == "[" or in_class and token != "]"
        out.append(token)
        i += step
    return f"(?d{'i' if ignore_case else ''}{'s' if dotall else ''})" + "".join(out)


def _regex(pattern: str, plain: bool, ignore_case: bool = False, dotall: bool = False) -> str:
    """The pattern for texts of ASCII only if ``plain``, else for any.  Case folding may lead from other letters of a
    pattern to ASCII (the long s), so such patterns have one form."""
    return (ascii_regex if plain and pattern.isascii() else java_regex)(pattern, ignore_case, dotall)


def is_ascii(col: Column) -> Column:
    return F.octet_length(col) == F.length(col)


_STRIP = java_regex(r"^\s+|\s+\z")
_ASCII_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
_ONLY_SPACE = java_regex(r"\A\s+\z")
_FLOAT = (r"\A[+-]?(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)"
          r"(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?\z")
_FLOAT_NAME = r"(?i)\A[+-]?(?:inf|infinity|nan)\z"


def strip(col: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(col, _STRIP, "")


def trimmed(col: Column, plain: bool) -> Column:
    """``strip``; ``plain`` here and below: the text is known to be ASCII."""
    return F.btrim(col, F.lit(_ASCII_SPACE)) if plain else strip(col)


def is_blank(col: Column) -> Column:
    """True for a non-empty value made of white space only."""
    return col.rlike(_ONLY_SPACE)


def search(col: Column, pattern: str, group: int = 0, ignore_case: bool = True,
           dotall: bool = False, plain: bool = False) -> Column:
    """First match's group, NULL when there is none.

    The one-element array binds the match, so the pattern runs once per row (``nullif``
    would run it twice).
    """
    match = F.regexp_extract(col, _regex(pattern, plain, ignore_case, dotall), group)
    return F.get(F.filter(F.array(match), lambda m: m != ""), F.lit(0))


def found(col: Column, pattern: str, ignore_case: bool = True, plain: bool = False) -> Column:
    return col.rlike(_regex(pattern, plain, ignore_case))


def find_all(col: Column, pattern: str, group: int = 0, ignore_case: bool = False, ascii_only: Column | None = None,
             plain: bool = False) -> Column:
    """All matches' groups in order, empty array when there is none.  ``ascii_only``: whether the text is, where that
    is already a column."""
    def search_with(plain: bool) -> Column:
        return F.regexp_extract_all(col, F.lit(_regex(pattern, plain, ignore_case)), F.lit(group))

    if plain:
        return search_with(True)
    return F.when(is_ascii(col) if ascii_only is None else ascii_only, search_with(True)).otherwise(search_with(False))


def first_of(col: Column, patterns: list[str], ignore_case: bool = True, plain: bool = False) -> Column:
    """Group 1 of the first pattern in the list that matches, trimmed."""
    return trimmed(F.coalesce(*[search(col, p, 1, ignore_case, plain=plain) for p in patterns]), plain)


def parse_amount(col: Column) -> Column:
    """Number behind a matched amount such as ``$ 1,234.50``.

    NULL when an ASCII match holds one of the separators U+001C..U+001F: float parsing does not
    take those for white space.
    """
    return F.when(~col.rlike(r"\A[\x00-\x7f]*[\x1c-\x1f][\x00-\x7f]*\z"),
                  F.regexp_replace(ascii_digits(col), "[^0-9.]", "").try_cast("double"))


def parse_ascii_amount(col: Column) -> Column:
    """``parse_amount`` of a match in an ASCII text."""
    return F.when(~col.rlike(r"[\x1c-\x1f]"), F.regexp_replace(col, "[^0-9.]", "").try_cast("double"))


def parse_float(col: Column) -> Column:
    """Float of free text, NULL when it is not a number."""
    text = ascii_digits(strip(col))
    return F.when(text.rlike(_FLOAT), F.replace(text, F.lit("_"), F.lit("")).try_cast("double")) \
        .when(text.rlike(_FLOAT_NAME), text.try_cast("double"))


def float_text(col: Column) -> Column:
    """Shortest decimal text of a double with at least one decimal place:
    ``1100.0``, ``26000000.0``, ``1e+16``, ``1e-05``."""
    size = F.abs(col)

    def plain(scale: int) -> Column:
        return F.regexp_replace(
            col.cast(f"decimal(38,{scale})").cast("string"), r"(\.[0-9]+?)0+$", "$1")

    mantissa = F.regexp_replace(F.substring_index(col.cast("string"), "E", 1), r"\.0$", "")
    exponent = F.substring_index(col.cast("string"), "E", -1).try_cast("int")
    scientific = F.concat(
        mantissa, F.lit("e"), F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
        F.when(F.abs(exponent) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(exponent).cast("string"))
    return F.when((size == 0) | ((size >= 1e-3) & (size < 1e7)), col.cast("string")) \
        .when((size >= 1e7) & (size < 1e16), plain(18)) \
        .when((size >= 1e-4) & (size < 1e-3), plain(24)) \
        .when(size < float("inf"), scientific) \
        .when(F.isnan(col), F.lit("nan")) \
        .otherwise(F.when(col > 0, F.lit("inf")).otherwise(F.lit("-inf")))


def truthy(value: Column, value_num: Column) -> Column:
    """A typed pair counts as present when it is a non-empty text or a non-zero number."""
    return F.coalesce(value != "", value_num != 0, F.lit(False))


def as_text(value: Column, value_num: Column) -> Column:
    """One text form of a typed pair."""
    return F.coalesce(value, float_text(value_num))


def as_number(value: Column, value_num: Column) -> Column:
    """One number form of a typed pair, NULL when it is not numeric."""
    return F.coalesce(value_num, parse_float(value))
