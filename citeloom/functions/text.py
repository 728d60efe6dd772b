"""Column functions over text: clean-up, formulas, sentences, pointers, titles, dates, pages. All run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

SENTENCE, HELD = "\x01", "\x02"


def cleaned(c: Column) -> Column:
    """White space squeezed, none before , ; . and none just inside parentheses."""
    c = F.regexp_replace(c, r"\s+", " ")
    c = F.regexp_replace(c, r"\s+([,;.])", "$1")
    return F.regexp_replace(c, r"\(\s*(.*?)\s*\)", "($1)")


def formulas(c: Column) -> Column:
    """The formulas of a text, in order (P5)."""
    return F.regexp_extract_all(c, F.lit(fixed.FORMULA), F.lit(1))


def formulas_protected(c: Column) -> Column:
    """Each formula replaced by FORMULA0, FORMULA1, ... (P5): the text is split at formulas and joined again by number."""
    parts = F.split(F.regexp_replace(c, fixed.FORMULA, HELD), HELD, -1)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("FORMULA"), (i - 1).cast("string"), x))), "")


def formulas_restored(c: Column, found: Column) -> Column:
    """FORMULAn replaced by the n-th formula, by exact number."""
    numbers = F.regexp_extract_all(c, F.lit(r"FORMULA(\d+)"), F.lit(1))
    parts = F.split(F.regexp_replace(c, r"FORMULA\d+", HELD), HELD, -1)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.coalesce(F.get(found, F.get(numbers, i - 1).cast("int")), F.lit("")), x))), "")


def _abbreviations() -> str:
    return "|".join(re.escape(a) for a in sorted(fixed.ABBREVIATIONS))


def sentences(c: Column) -> Column:
    """The sentences of a text (P7): cut after . ! ? and a blank, except after an abbreviation, and at line feeds."""
    for _ in range(2):  # neighbouring abbreviations share a blank
        c = F.regexp_replace(c, rf"(^|[ (\n\x02])({_abbreviations()}) ", f"$1$2{HELD}")
    c = F.translate(F.regexp_replace(c, r"([.!?]) ", f"$1{SENTENCE}"), "\n" + HELD, SENTENCE + " ")
    return F.split(c, SENTENCE, -1)


def pointers(c: Column) -> Column:
    """The pointer keys of a sentence, in order."""
    return F.regexp_extract_all(c, F.lit(r"cit\d+"), F.lit(0))


def pointers_replaced(c: Column, replacement: str = "[$1]") -> Column:
    """citN by its exact number, so that cit1 doesn't touch cit12 (P10)."""
    return F.regexp_replace(c, r"\bcit(\d+)\b", replacement)


def title_cleaned(c: Column) -> Column:
    """Whatever isn't a letter or digit goes from a title's start."""
    return F.trim(F.regexp_replace(F.trim(c), r"^[^a-zA-Z0-9]+", ""))


def numbering_dropped(c: Column) -> Column:
    """A title without leading arabic or roman numbering."""
    return F.trim(F.regexp_replace(F.trim(c), r"^(?:\d+(?:\.\d+)*\.?|[IVXLC]+[.)])\s+", ""))


def eval_normalised(c: Column) -> Column:
    """Lower case, without quotes, brackets and , : ; and with single blanks."""
    c = F.translate(F.lower(F.coalesce(c, F.lit(""))), fixed.EVAL_DROPPED, "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def signature(*cs: Column) -> Column:
    return F.concat_ws("||", *cs)


def pages_stripped(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, fixed.PAGES, ""))


def year_and_page(c: Column) -> Column:
    return c.rlike(fixed.YEAR_PAGE)


def reference_contained(a: Column, b: Column) -> Column:
    """Either contains the other, or b contains the first 20 characters of a longer a; never for empty ones."""
    either = F.contains(a, b) | F.contains(b, a) | ((F.length(a) > 10) & F.contains(b, F.substring(a, 1, 20)))
    return (a != "") & (b != "") & either


def publication_date(c: Column) -> Column:
    """yyyy-MM-dd, yyyy-MM or yyyy as a date, missing parts 01."""
    return (
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"))
        .when(c.rlike(r"^\d{4}-\d{2}$"), F.try_to_timestamp(F.concat(c, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date"))
        .when(c.rlike(r"^\d{4}$"), F.try_to_timestamp(F.concat(c, F.lit("-01-01")), F.lit("yyyy-MM-dd")).cast("date"))
    )


def page_range(start: Column, end: Column, text: Column) -> Column:
    """from-to, from alone, or the text; an end alone gives null."""
    return F.when(start.isNotNull() & end.isNotNull(), F.concat_ws("-", start, end)).when(start.isNotNull(), start).when(end.isNull(), text)


def rhetorical_type(title: Column) -> Column:
    """The canonical title of that name, whatever its case."""
    out = F.lit(None).cast("string")
    for t in fixed.TITLES:
        out = F.when(F.lower(title) == t.lower(), t).otherwise(out)
    return out


def context(section: Column, citation: Column, mode: str) -> Column:
    """The classifier's input by mode: WS with section, WoS without, M with it if there is one (P20)."""
    if mode not in ("WS", "WoS", "M"):
        raise ValueError(f"mode must be WS, WoS or M, not {mode!r}")
    with_section = F.concat(F.coalesce(section, F.lit("")), F.lit(". "), citation)
    if mode == "WoS":
        return citation
    return with_section if mode == "WS" else F.when(F.coalesce(section, F.lit("")) == "", citation).otherwise(with_section)


def uri(kind: str, *parts: Column) -> Column:
    """A name that is the same in every run."""
    return F.concat(F.lit(f"{kind}/"), F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 16))
