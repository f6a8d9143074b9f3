"""Names, tokens, redaction and escapes as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomgraph.schema import PII_KEYS

# The patterns of redaction and search, as the tables' consumers know them.
PII_PAIR = r'(?i)"(email|phone|cpf|cnpj|password|token|secret|api_key)"\s*:\s*"[^"]*"'
EMAIL = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+"
SEARCH_SIGNS = r"[.*^$()\-+:\";\\'/]"
SEARCH_WORDS = r"(?i)\b(AND|OR|NOT|NEAR)\b"


@F.pandas_udf(StringType())
def _without_marks(values: pd.Series) -> pd.Series:
    def plain(s):
        return None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    return values.map(plain, na_action="ignore")


def _single_letters() -> tuple[str, str]:
    """The letters up to U+017F that decompose to one other letter and marks, and those letters."""
    pairs = []
    for k in range(0xC0, 0x180):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != chr(k):
            pairs.append((chr(k), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _single_letters()


def _latin_pattern() -> str:
    """Text of ASCII, MARKED and letters up to U+017F that stand for themselves, as a class of few ranges."""
    same = [k for k in range(0xC0, 0x180) if chr(k) in MARKED or unicodedata.normalize("NFKD", chr(k)) == chr(k)]
    ranges = "".join(rf"\x{{{k:x}}}-" if k - 1 not in same else rf"\x{{{k:x}}}" if k + 1 not in same else "" for k in same if k - 1 not in same or k + 1 not in same)
    return rf"^[\x00-\x7f{ranges}]*+$"


LATIN = _latin_pattern()


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def without_marks(c: Column) -> Column:
    """Compatibility decomposition without combining marks. Text of ASCII and European Latin letters never leaves the
    JVM; only other text goes to Python, in Arrow batches."""
    latin = c.rlike(LATIN)
    return F.when(is_ascii(c), c).when(latin, F.translate(c, MARKED, PLAIN)).otherwise(_without_marks(F.when(~latin, c)))


def normalize_name(c: Column, ascii_only: bool = False) -> Column:
    """Lower case, marks dropped, runs of anything but a-z and 0-9 as one hyphen; `node` if nothing is left.
    ascii_only: the caller knows that there are no other letters."""
    plain = F.lower(F.trim(c)) if ascii_only else without_marks(F.lower(F.trim(c)))
    name = F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(c.isNull(), None).when(name == "", "node").otherwise(name)


def qualified(label: Column, name: Column, ascii_only: bool = False) -> Column:
    return F.concat(F.lower(label), F.lit(":"), normalize_name(name, ascii_only))


def search_terms(pattern: str) -> list[str]:
    """The tokens of a search pattern, signs and operator words taken out; none: everything matches."""
    import re

    text = re.sub(SEARCH_WORDS, " ", re.sub(SEARCH_SIGNS, " ", pattern))
    folded = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return sorted({t for t in re.split(r"[\W_]+", folded) if t})


def tokens(c: Column) -> Column:
    """Distinct folded tokens: runs of letters and digits."""
    parts = F.split(without_marks(F.lower(c)), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def has_tokens(c: Column, terms: list[str]) -> Column:
    """Whether all the terms, folded letters and digits as search_terms gives them, are tokens of the text: a search
    that ends at the first place, where tokens() would make all of them."""
    low, found = F.lower(c), F.lit(True)
    for t in terms:
        found = found & low.rlike(rf"(?<![a-z0-9]){t}(?![a-z0-9])")
    every = "".join(rf"(?=.*(?<![\p{{L}}\p{{N}}]){t}(?![\p{{L}}\p{{N}}]))" for t in terms)
    return F.when(is_ascii(c), found).otherwise(without_marks(low).rlike(f"(?s)^{every}"))


def redact_text(c: Column, most: int = 500) -> Column:
    """Values of personal keys and e-mail addresses replaced, then cut; null and empty give an empty text."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), PII_PAIR, '"$1":"[REDACTED]"'), EMAIL, "[EMAIL]"), 1, most)


def redaction_sql(name: str, most: int = 500) -> str:
    """redact_text as SQL over a column."""
    pair, mail = (p.replace("\\", "\\\\") for p in (PII_PAIR, EMAIL))
    return f"""substr(regexp_replace(regexp_replace(coalesce({name}, ''), '{pair}', '"$1":"[REDACTED]"'), '{mail}', '[EMAIL]'), 1, {most})"""


def redact_properties(c: Column) -> Column:
    """A JSON object with the values of personal top-level keys (any case) replaced; keys of any letters and values of all types, nulls
    and nested objects among them, stay as they are, keys in their order. What is JSON but no object stays; of text that is no JSON, or that
    repeats a key, pairs of a personal key and a string are replaced."""
    parsed = F.try_parse_json(c)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    entries = F.when(is_object, parsed).cast("map<string,variant>")

    def pair(k: Column) -> Column:
        name = F.to_json(F.array(k))
        value = F.when(F.lower(k).isin(*PII_KEYS), F.lit('"[REDACTED]"')).otherwise(F.coalesce(F.to_json(F.element_at(entries, k)), F.lit("null")))
        return F.concat(F.substring(name, F.lit(2), F.length(name) - 2), F.lit(":"), value)

    hidden = F.concat(F.lit("{"), F.array_join(F.transform(F.json_object_keys(c), pair), ","), F.lit("}"))
    return F.when(is_object, hidden).when(parsed.isNotNull(), c).otherwise(F.regexp_replace(c, PII_PAIR, '"$1":"[REDACTED]"'))


def html_escape(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def script_escape(c: Column) -> Column:
    """JSON that can stand in a script element."""
    for sign, name in (("<", "\\u003C"), (">", "\\u003E"), ("/", "\\/")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def safe_error(c: Column, most: int = 200) -> Column:
    return F.regexp_replace(F.substring(c, 1, most), r"/[^\s,)]+", "[PATH]")


def last_segment(c: Column) -> Column:
    return F.element_at(F.split(c, r"\."), -1)
