"""Names, codes and titles."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from cropspark import constants as K


def _accent_pairs() -> tuple[str, str]:
    """Every BMP character that canonical decomposition turns into one base character plus marks."""
    source, target = [], []
    for code in range(0xC0, min(0x10000, sys.maxunicode)):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if len(parts) < 2:
            continue
        base = [p for p in parts if unicodedata.category(p) != "Mn"]
        if len(base) == 1 and len(base) < len(parts):
            source.append(char)
            target.append(base[0])
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _accent_pairs()


def strip_accents(c: Column) -> Column:
    """Drop accents and other combining marks. Plain ASCII text, the common case, passes untouched."""
    stripped = F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}+", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), stripped).otherwise(c)


def strip(c: Column) -> Column:
    """Trim every kind of white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze_spaces(c: Column) -> Column:
    """Trim and turn every run of white space (also NBSP and line breaks) into one blank."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise_name(c: Column) -> Column:
    """Join key of a name: upper case, no accents, single blanks."""
    return squeeze_spaces(strip_accents(F.upper(c)))


def normalise_text(c: Column) -> Column:
    """Lower case, cut at the first parenthesis, no accents."""
    return strip_accents(strip(F.substring_index(F.lower(c), "(", 1)))


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def capitalise(c: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def canon_product(c: Column) -> Column:
    """Display name: no asterisks, single blanks, first letter upper and the rest as given."""
    clean = squeeze_spaces(F.replace(c, F.lit("*"), F.lit(" ")))
    return F.concat(F.upper(F.substring(clean, 1, 1)), clean.substr(F.lit(2), F.length(clean)))


def product_key(c: Column) -> Column:
    return normalise_name(F.replace(c, F.lit("*"), F.lit(" ")))


def canon_market(c: Column, aliases: dict[str, str] | None = None) -> Column:
    clean = squeeze_spaces(c)
    return F.coalesce(_lookup(aliases or K.MARKET_ALIAS, clean), clean)


def canon_title(c: Column, aliases: dict[str, str] | None = None, minor: list[str] | None = None) -> Column:
    """Title case with minor words in lower case unless they come first."""
    clean = squeeze_spaces(c)
    small = F.array(*[F.lit(w) for w in (minor or K.MINOR_WORDS)])
    words = F.transform(
        F.split(F.lower(clean), " "),
        lambda w, i: F.when((i > 0) & F.array_contains(small, w), w).otherwise(capitalise(w)),
    )
    return F.coalesce(_lookup(aliases or K.DEPARTMENT_ALIAS, F.upper(clean)), F.array_join(words, " "))


def canon_group(c: Column, aliases: dict[str, str] | None = None) -> Column:
    clean = squeeze_spaces(c)
    blank = (clean == "") | (F.lower(clean) == "nan")
    named = F.coalesce(_lookup(aliases or K.GROUP_ALIAS, F.upper(clean)), capitalise(clean))
    return F.when(clean.isNotNull() & ~blank, named)


def zero_pad(c: Column, width: int) -> Column:
    """Pad on the left with zeros; unlike lpad, a longer input is kept whole."""
    text = F.trim(c.cast("string"))
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def valid_code(c: Column, digits: int = 5) -> Column:
    """The code when it is exactly ``digits`` digits, else missing."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(rf"^\d{{{digits}}}$"), text)


def drop_prefix(c: Column, pattern: str) -> Column:
    return F.trim(F.regexp_replace(c, rf"^(?:{pattern})", ""))


def decimal_comma(c: Column) -> Column:
    return F.replace(F.trim(c.cast("string")), F.lit(","), F.lit(".")).try_cast("double")


def csv_guard(c: Column) -> Column:
    """Neutralise a text cell that a spreadsheet would run as a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_cell(c: Column) -> Column:
    """RFC 4180 cell: quote when needed, double the quotes, missing is empty."""
    guarded = csv_guard(c)
    quoted = F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(guarded.rlike(r'[",\n\r]'), quoted).otherwise(guarded), F.lit(""))


def ordered_keyword(c: Column, rules: list[tuple[str, str]], default: str | None, last_wins: bool = False) -> Column:
    """Label a text by regular-expression rules; first match wins, or the last one when asked."""
    ordered = list(reversed(rules)) if last_wins else rules
    out = None
    for pattern, label in ordered:
        out = F.when(c.rlike(pattern), label) if out is None else out.when(c.rlike(pattern), label)
    return out.otherwise(F.lit(default))
