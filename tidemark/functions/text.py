"""Text expressions: normalization, keyword coding with vetoes, extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.columns import col

# fixed values: German letters written out
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))


def normalize(x) -> Column:
    """Lower case, umlauts written out, white space collapsed, trimmed; NULL stays NULL."""
    out = F.lower(col(x))
    for a, b in UMLAUTS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def street_key(x) -> Column:
    """Address key: normalized, 'str.', 'strasse' and '-' brought to one form, no blanks before the number."""
    out = normalize(x)
    out = F.regexp_replace(out, r"str(asse|\.)?( |$)", "strasse ")
    out = F.regexp_replace(out, r"[-,.]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"(\d) ([a-z])$", "$1$2"))


def mentions(x, word: str, veto_after: tuple[str, ...] = (), veto_before: tuple[str, ...] = ()) -> Column:
    """True if the normalized text has a word that begins like `word` and is not next to a veto. Possessive matching keeps the veto from
    being evaded by a shorter match."""
    after = "".join(rf"(?! {v})" for v in veto_after)
    before = "".join(rf"(?<!{v} )" for v in veto_before)
    return F.coalesce(normalize(x).rlike(rf"{before}\b{word}\w*+{after}"), F.lit(False))


def first_year(x, low: int, high: int) -> Column:
    """The first plausible four-digit year, NULL without one."""
    years = F.regexp_extract_all(col(x), F.lit(r"\b(\d{4})\b"), F.lit(1))
    return F.try_element_at(F.filter(F.transform(years, lambda y: y.cast("int")), lambda y: y.between(low, high)), F.lit(1))


def coordinates(x) -> Column:
    """(lat, lon) of a text with exactly two decimal numbers, put in order if they stand the other way round; else NULL."""
    n = F.transform(F.regexp_extract_all(col(x), F.lit(r"(-?\d+\.\d+)"), F.lit(1)), lambda v: v.cast("double"))
    a, b = F.try_element_at(n, F.lit(1)), F.try_element_at(n, F.lit(2))
    swap = (a < 20) & (b > 40)
    return F.when(F.size(n) == 2, F.struct(F.when(swap, b).otherwise(a).alias("lat"), F.when(swap, a).otherwise(b).alias("lon")))


def clock_hour(x) -> Column:
    """Hour with minutes as a fraction from 'hh:mm' anywhere in the text."""
    h, m = F.regexp_extract(col(x), r"(\d{1,2}):(\d{2})", 1), F.regexp_extract(col(x), r"(\d{1,2}):(\d{2})", 2)
    return F.when(h != "", h.cast("int") + m.cast("int") / 60)


def yes(x) -> Column:
    return F.coalesce(F.lower(F.trim(col(x))).isin("ja", "yes", "x", "1", "true"), F.lit(False))


def house_variants(x) -> Column:
    """'12a-14' -> itself, '12a', '12': what a directory may hold for a house number, most exact first."""
    s = F.lower(F.trim(col(x)))
    return F.array_distinct(F.filter(F.array(s, F.regexp_extract(s, r"^(\d+[a-z]?)", 1), F.regexp_extract(s, r"^(\d+)", 1)), lambda v: v != ""))


def decimal_comma(x, digits: int = 1) -> Column:
    """A number with so many digits behind a comma; as a decimal of six digits, ties rounded away from 0."""
    return F.replace(F.round(col(x).cast("decimal(18,6)"), digits).cast(f"decimal(18,{digits})").cast("string"), F.lit("."), F.lit(","))


def word_with_vetoes(x, word: str, after: tuple[str, ...] = (), before: tuple[str, ...] = (), window: int = 20) -> Column:
    """True if the word stands somewhere in the normalized text without any veto in the `window` characters behind it or before it. Every occurrence is looked at."""
    parts = F.split(normalize(x), rf"\Q{word}\E", -1)
    near = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.right(F.element_at(parts, i), F.lit(window)).alias("l"), F.left(F.element_at(parts, i + 1), F.lit(window)).alias("r")))
    bad = lambda n: _any(n["r"], after) | _any(n["l"], before)
    return F.coalesce(F.when(F.size(parts) > 1, F.exists(near, lambda n: ~bad(n))), F.lit(False))


def _any(x: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def affirmed(x, word: str, negations: tuple[str, ...], breaks: str = r"[.;!?\n]") -> Column:
    """True if a clause of the normalized text has the word and no negation before it in the same clause."""
    clauses = F.split(F.regexp_replace(F.lower(col(x)), r"[\t\r\f ]+", " "), breaks, -1)
    denied = r"(^|[^a-z])(" + "|".join(negations) + r")([^a-z]|$)"
    return F.coalesce(F.exists(clauses, lambda c: F.contains(c, F.lit(word)) & ~F.substring_index(c, word, 1).rlike(denied)), F.lit(False))


def address_key(x) -> Column:
    """Key of an address whatever its spelling: umlauts written out, 'str.', 'str' and 'strasse' as one, punctuation dropped, 'number letter' and 'number - number' closed up, leading zeros
    of the number and anything behind a comma or in brackets dropped."""
    out = F.regexp_replace(normalize(x), r"\([^)]*\)", " ")
    out = F.regexp_replace(out, r",.*$", "")
    out = F.regexp_replace(out, r"str(asse|\.)?([ 0-9]|$)", "strasse $2")
    out = F.regexp_replace(out, r"pl(atz|\.)([ 0-9]|$)", "platz $2")
    out = F.regexp_replace(out, r"[.'\"/]", " ")
    out = F.regexp_replace(out, r" *- *", "-")
    out = F.regexp_replace(out, r" +", " ")
    out = F.regexp_replace(out, r" 0+([0-9])", " $1")
    return F.trim(F.regexp_replace(out, r"([0-9]) ([a-z])$", "$1$2"))
