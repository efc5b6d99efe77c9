"""Text and key functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CJK = "一-鿿"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, however often and however deeply later steps use them: the optimiser doesn't merge
    projections across the generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def bound(c: Column, body: Callable[[Column], Column]) -> Column:
    """body of c, which is computed once a row, however often body names it."""
    return F.transform(F.array(c), body)[0]


def _forms() -> tuple[dict[str, str], dict[str, str], list[str]]:
    """Characters whose compatibility form (NFKC) has other letters, digits, Han characters or blanks: those of one and of several, and
    pairs of an ASCII letter and a mark that make one character, which keys don't keep."""
    one, several = {}, {}
    for code in range(0x80, 0x30000):
        c = chr(code)
        form = unicodedata.normalize("NFKC", c)
        if form != c and (re.search(f"[0-9A-Za-zı{CJK}\\s]", form) or len(form) == 1 and ord(form) < 0x80):
            (one if len(form) == 1 else several)[c] = form
    letters = [chr(k) for k in (*range(65, 91), *range(97, 123))]
    pairs = []
    for code in range(0x300, 0x370):
        bases = "".join(x for x in letters if len(unicodedata.normalize("NFC", x + chr(code))) == 1)
        if bases:
            pairs.append(f"[{bases}]{chr(code)}")
    return one, several, pairs


_ONE, _SEVERAL, _PAIRS = _forms()


def half_width(c: Column) -> Column:
    """Compatibility form of a text, as far as it bears on letters, digits, Han characters, ASCII signs and blanks.

    Full-width and enclosed characters, Roman numerals, units, fractions and the like become what they stand for; a letter with
    a mark of its own that makes one character goes with the mark. Only texts that have a form of several characters are looked at by character.
    """
    table = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in _SEVERAL.items())), F.lit("\x02"), F.lit("\x01"))  # one literal
    several, marked = "".join(_SEVERAL), rf"(?=[A-Za-z][\x{{300}}-\x{{36F}}])(?:{'|'.join(_PAIRS)})"
    spread = lambda t: F.array_join(F.transform(F.split(t, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    whole = lambda t: F.when(F.translate(t, several, "") != t, spread(t)).otherwise(t)
    form = lambda x: F.regexp_replace(bound(F.translate(x, "".join(_ONE), "".join(_ONE.values())), whole), marked, "")
    return bound(c, lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), form(x)).otherwise(x))


#: What begins a certificate number: up to six Han characters, the last one this (fixed value).
_ANCHOR = f"[{CJK}]{{1,6}}械"


def registration_key(c: Column) -> Column:
    """Registration number as a key; null if nothing is left.

    The part before the first separator (comma, semicolon, bar, backslash or a lowercase s, as the separators are spelled at the
    source), half-width, in capitals, letters, digits and Han characters only. Of several numbers run together the first stays if it has six digits
    and 120 characters at most; a key of more than 120 characters gives its first such number, or null.
    """
    first = F.get(F.split(F.trim(c), r"[，,;；|\\s]+"), 0)
    clean = F.regexp_replace(F.upper(F.regexp_replace(half_width(first), r"\s+", "")), f"[^0-9A-Z{CJK}]+", "")
    fits = lambda x: (F.length(x) <= 120) & (F.length(F.regexp_replace(x, "[^0-9]", "")) >= 6)

    def chosen(clean: Column, parts: Column) -> Column:
        own, whole = F.get(parts, 0), F.when(F.length(clean) <= 120, clean)
        return F.when((F.size(parts) >= 2) & fits(own), own).otherwise(F.coalesce(whole, F.get(F.filter(parts, fits), 0)))

    numbers = lambda x: F.regexp_extract_all(x, F.lit(f"({_ANCHOR}.*?)(?={_ANCHOR}|$)"), F.lit(1))
    read = bound(clean, lambda x: F.when(x == "", None).otherwise(bound(numbers(x), lambda parts: chosen(x, parts))))
    return F.when(c.rlike(r"\A[0-9A-Z]{1,120}\z"), c).otherwise(read)  # a key already


def loose_key(c: Column) -> Column:
    """Lookup key: capitals, letters, digits and Han characters, no separators."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), f"[^0-9A-Z{CJK}]+", "")


#: Signs that are taken off both ends of company names (fixed values).
EDGES = "()[]{}<>，,。.;；:：/\\|·"


def company_key(c: Column, suffixes: Sequence[str], replacements: dict[str, str] | None = None) -> Column:
    """Company name without its legal forms, taken off the end again and again, the longest first, while something is left; null for no name.

    The compatibility form without white space and without signs at its ends; a whole name that has a replacement becomes that. After each
    legal form signs at the ends go too. Of what is left the letters, digits and Han characters stay, in capitals.
    """
    signs = f"[{re.escape(EDGES)}]"
    trimmed = lambda x: F.regexp_replace(x, f"^{signs}+|{signs}+$", "")
    plain = trimmed(F.regexp_replace(half_width(F.trim(c)), r"\s+", ""))
    if replacements:
        plain = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in replacements.items() for x in p]), plain), plain)
    ends = "|".join(sorted((re.escape(x) for x in suffixes if x), key=len, reverse=True))
    # a form is taken off where something stands before it; signs may stand between forms
    short = F.regexp_replace(plain, f"(?i)(?<=.)(?:(?:{ends}){signs}*)+$", "") if ends else plain
    return F.nullif(F.regexp_replace(F.upper(trimmed(short)), f"[^0-9A-Z{CJK}]+", ""), F.lit(""))


def keyword_pattern(words: Sequence[str]) -> str:
    """Pattern of a text in lower case that has one of the words: those of ASCII letters, digits and hyphens as whole tokens, others anywhere."""
    token = lambda w: rf"(?<![a-z0-9]){re.escape(w)}(?![a-z0-9])" if re.fullmatch(r"[a-z0-9\\-]+", w) else re.escape(w)
    return "|".join(token(w.lower()) for w in words)


def has_keyword(c: Column, words: Sequence[str]) -> Column:
    """Whether a text in lower case has one of the words, by keyword_pattern: a pattern is tried for those alone that are whole tokens."""
    tokens = [w for w in words if re.fullmatch(r"[a-z0-9\\-]+", w)]
    tests = [F.contains(c, F.lit(w.lower())) for w in words if w not in tokens] + ([c.rlike(keyword_pattern(tokens))] if tokens else [])
    return reduce(or_, tests)


def keyword_hits(c: Column, words: Sequence[str]) -> Column:
    """Array of the words that a text has, by keyword_pattern."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.array_compact(F.array(*[F.when(has_keyword(low, [w]), F.lit(w)) for w in words]))


def first_text(*columns: Column) -> Column:
    """The first that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def bin_score(value: Column, bins: Sequence[tuple[float, int]]) -> Column:
    """Score of the first bin whose upper end holds the value; 0 if none does."""
    out = F.lit(0)
    for upper, score in reversed(bins):
        out = F.when(value <= upper, F.lit(score)).otherwise(out)
    return out


def ladder(value: Column, steps: Sequence[tuple[float, str]], low: str) -> Column:
    """Name of the highest step that the value reaches; low if none."""
    out = F.lit(low)
    for least, name in sorted(steps):
        out = F.when(value >= least, F.lit(name)).otherwise(out)
    return out


def price(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")


def any_date(c: Column) -> Column:
    """Date from the first ten characters in any of four spellings; null if none fits."""
    text = F.substring(F.trim(c), 1, 10)
    return F.coalesce(*[F.try_to_date(text, f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd")], F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd"))
