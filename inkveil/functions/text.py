"""Column functions on text: punctuation, normal forms, ids, dates and labels."""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, the white space that counts, and plain forms of common punctuation.
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BLANK = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0    　"
PLAIN_ONE = {"“": '"', "”": '"', "‟": '"', "‘": "'", "’": "'", "‛": "'", "‚": ",", "–": "-", "‐": "-", "‑": "-", "‒": "-", "‹": "<", "›": ">", "•": "*", "¿": "?", "¡": "!", "‖": "|"}
PLAIN_MORE = {"…": "...", "—": "--", "―": "--", "«": "<<", "»": ">>", "„": ",,", "‼": "!!", "⁇": "??"}


def _plain_forms() -> dict[str, str]:
    """An ASCII form of every other punctuation character (category P): what compatibility
    decomposition leaves of it, else by what its name says; those that say nothing stay."""
    by_name = (
        ("DOUBLE QUOTATION", '"'), ("QUOTATION", "'"), ("APOSTROPHE", "'"), ("HYPHEN", "-"), ("DASH", "-"), ("PARENTHESIS", "()"), ("SQUARE BRACKET", "[]"), ("CURLY BRACKET", "{}"),
        ("CORNER BRACKET", "[]"), ("BRACKET", "[]"), ("QUESTION MARK", "?"), ("EXCLAMATION MARK", "!"), ("SEMICOLON", ";"), ("COLON", ":"), ("COMMA", ","), ("FULL STOP", "."), ("PERCENT SIGN", "%"),
        ("ASTERISK", "*"), ("BULLET", "*"), ("AMPERSAND", "&"), ("NUMBER SIGN", "#"), ("SOLIDUS", "/"), ("LOW LINE", "_"), ("TILDE", "~"),
    )
    out = {}
    for code in range(128, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind[0] != "P":
            continue
        plain = unicodedata.normalize("NFKD", c)
        name = unicodedata.name(c, "")
        form = next((f for n, f in by_name if n in name), "")
        if not plain.isascii() or not plain.strip():
            plain = form[-1 if kind == "Pe" and len(form) == 2 else 0 : 2 if kind == "Pe" else 1] if form else ""
        if plain:
            out[c] = plain
    return out


_FORMS = _plain_forms() | PLAIN_ONE | PLAIN_MORE
PLAIN_ONE = {c: f for c, f in _FORMS.items() if len(f) == 1}
PLAIN_MORE = {c: f for c, f in _FORMS.items() if len(f) > 1}
#: A character beyond ASCII and the Latin letters, among which there is no punctuation.
MAY_CHANGE = r"[^\x00-\x7F\u00C0-\u024F]"
#: Characters that a page's text drops, and the one that it takes for a space.
DROPPED, NARROW = "​﻿", " "

#: Fixed value: vehicle registration formats, the first that fits at a place counts.
PLATES = "|".join((
    r"[A-Z]{2}[0-9]{2}\s[A-Z]{3}",
    r"[A-Z][0-9]{1,3}\s[A-Z]{3}",
    r"[A-Z]{3}\s[0-9]{1,3}\s[A-Z]",
    r"[0-9]{3}\s[DX]{1}\s[0-9]{3}",
    r"[A-Z]{1,2}\s[0-9]{1,4}",
    r"[0-9]{1,3}\s[A-Z]{1,3}",
    r"[0-9]{1,4}\s[A-Z]{1,2}",
    r"[A-Z]{1,3}\s[0-9]{1,4}",
    r"[A-Z]{1,3}\s[0-9]{1,3}",
))


def plain_punctuation(text: Column) -> Column:
    """Punctuation as its nearest ASCII form; letters, accents and currency stay. Most texts have
    none that changes, which one look tells."""
    one = F.translate(text, "".join(PLAIN_ONE), "".join(PLAIN_ONE.values()))
    plain = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), PLAIN_MORE.items(), one)
    return F.when(text.rlike(MAY_CHANGE), plain).otherwise(text)


def stripped(text: Column, chars: str = PUNCT) -> Column:
    return F.btrim(text, F.lit(chars))


def normalised(text: Column) -> Column:
    """Plain punctuation, lower case, no white space and then no punctuation around."""
    return stripped(F.btrim(F.lower(plain_punctuation(text)), F.lit(BLANK)))


def normalised_words(text: Column) -> Column:
    """The words of a term or a line: the normal form split on single spaces, each stripped, empty ones gone."""
    words = F.transform(F.split(normalised(text), " "), lambda w: stripped(F.btrim(w, F.lit(BLANK))))
    return F.filter(words, lambda w: w != "")


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def page_clean(text: Column) -> Column:
    """A page's text without zero-width marks, narrow spaces as spaces, stripped; null if nothing is left."""
    return F.nullif(F.btrim(F.translate(text, NARROW + DROPPED, " "), F.lit(BLANK)), F.lit(""))


def token_equals(token: Column, word: Column) -> Column:
    """Equal, or equal after a plural s or a possessive: all final s go, then all final apostrophes."""
    return (token == word) | (F.rtrim(F.rtrim(token, F.lit("s")), F.lit("'")) == word)


def fused_before(token: Column, word: Column, least: int = 4) -> Column:
    """The token ends with the word: a space is missing before it."""
    return (F.length(word) >= least) & (token != word) & token.endswith(word)


def fused_after(token: Column, word: Column, least: int = 4) -> Column:
    """The token begins with the word: a space is missing after it."""
    return (F.length(word) >= least) & (token != word) & token.startswith(word)


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"))


def pdf_date(text: Column) -> Column:
    """The first fourteen digits as a timestamp; an offset is not applied; null if there are fewer or they are no date."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits) >= 14, F.try_to_timestamp(F.substring(digits, 1, 14), F.lit("yyyyMMddHHmmss")))


def clean_job_id(job_id: Column) -> Column:
    """Control characters gone, characters that paths can't have as -, no points around."""
    return F.btrim(F.regexp_replace(F.regexp_replace(job_id, "[\\x00-\\x1f\\x7f]", ""), '["\\\\:|<>*?]', "-"), F.lit("."))


def job_base(job_id: Column) -> Column:
    """The part before the version of base:version-timestamp, cleaned; the whole id if it has no version."""
    return F.when(job_version(job_id).isNotNull(), clean_job_id(F.split(job_id, ":")[0])).otherwise(clean_job_id(job_id))


def job_version(job_id: Column) -> Column:
    parts = F.split(job_id, ":")
    version = F.split(F.get(parts, F.lit(1)), "-")
    return F.when((F.size(parts) == 2) & (F.size(version) == 2) & version[0].rlike("^[0-9]+$"), version[0].cast("int"))


def plates(text: Column) -> Column:
    """Vehicle registrations in both readings of 0/O and 1/I, each once."""
    found = lambda a, b: F.regexp_extract_all(F.translate(text, a, b), F.lit(f"({PLATES})"), 0)
    return F.array_distinct(F.concat(found("01", "OI"), found("OI", "01")))


def service_label(service: Column) -> Column:
    return F.translate(F.lower(service), "_", "-")


def xml_section(tag: str, items: Column, as_list: bool = True) -> Column:
    """Items as lines in a tag: list items begin with "- ", other text ends with a point."""
    lines = F.transform(items, lambda x: F.when(x.startswith("-"), x).otherwise(F.concat(F.lit("- "), x))) if as_list else F.transform(items, lambda x: F.when(x.endswith("."), x).otherwise(F.concat(x, F.lit("."))))
    return F.concat(F.lit(f"<{tag}>\n"), F.array_join(lines, "\n"), F.lit(f"\n</{tag}>"))


def isclose(a: Column, b: Column, relative: float = 1e-9) -> Column:
    return F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))


def at_least_about(a: Column, b: Column, relative: float = 0.1) -> Column:
    """Greater, or equal within a relative tolerance."""
    return (a > b) | (F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b)))
