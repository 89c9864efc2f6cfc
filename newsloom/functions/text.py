"""Column functions over text. All of them run inside the JVM unless the docstring says otherwise."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The function words that never count as a token.
STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "at", "by",
    "from", "as", "is", "are", "was", "were", "be", "been", "it", "its", "that", "this",
]

# Named character references that feeds use.
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“",
    "mdash": "—", "ndash": "–", "hellip": "…",
}

WORDS_PER_MINUTE = 220
HEAD, TAIL = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def bounded(pattern: str) -> str:
    """ASCII word boundaries around a pattern; Java's own are Unicode-aware."""
    return f"{HEAD}(?:{pattern}){TAIL}"


def _ahead(pattern: str) -> str:
    """Where a bounded pattern begins. What lies ahead is tried first, as it fails at nearly every place; looking behind everywhere takes longer."""
    inner = pattern.removeprefix(f"{HEAD}(?:").removesuffix(f"){TAIL}")
    try:
        re.compile(inner)
    except re.error:
        return pattern
    return f"(?=(?:{inner}){TAIL}){HEAD}" if bounded(inner) == pattern else pattern


def terms(words: list[str], substrings: list[str] = ()) -> str:
    """A case-insensitive alternation of bounded words and of plain substrings."""
    parts = [bounded("|".join(map(re.escape, words)))] if words else []
    return "(?i)" + "|".join([*parts, *map(re.escape, substrings)])


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _cleaned(c: Column) -> Column:
    """Lower-cased, with one space for each run of other characters than letters and digits: much cheaper than to clear them one by one and to split at any white space."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")


def _cut(c: Column) -> Column:
    """Lower-cased runs of letters and digits; an empty one where a text does not begin or end with such a run."""
    return F.split(_cleaned(_text(c)), " ")


def _stem(w: Column) -> Column:
    return F.when((F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, 1, F.length(w) - 1)).otherwise(w)


def word_list(c: Column) -> Column:
    """All words in order; the token sets below are made of them."""
    return F.filter(_cut(c), lambda w: w != "")


def spaced_words(c: Column) -> Column:
    """The words of `word_list` as one text with a space before, between and behind them: one pass and no list."""
    return _cleaned(F.concat(F.lit(" "), _text(c), F.lit(" ")))


def cluster_tokens_of(words: Column) -> Column:
    return F.filter(F.array_distinct(words), lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))  # distinct first: fewer words are tested


def class_tokens_of(words: Column) -> Column:
    return F.array_distinct(F.transform(cluster_tokens_of(words), _stem))


def overlap_tokens_of(words: Column) -> Column:
    return F.filter(F.array_distinct(words), lambda w: F.length(w) > 3)


def class_tokens(c: Column) -> Column:
    """Distinct stemmed tokens of more than two characters, without function words."""
    return class_tokens_of(_cut(c))


def cluster_tokens(c: Column) -> Column:
    """As class_tokens, but not stemmed."""
    return cluster_tokens_of(_cut(c))


def overlap_tokens(c: Column) -> Column:
    """Distinct tokens of more than three characters, function words included."""
    return overlap_tokens_of(_cut(c))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; zero if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def shared_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def restates(deck: Column, headline: Column, share: float = 0.8) -> Column:
    """More than that share of the deck's tokens stand in the headline already."""
    both = F.array(F.struct(overlap_tokens(deck).alias("d"), overlap_tokens(headline).alias("h")))  # an element is computed once, however often it is used
    return F.exists(both, lambda x: (F.size(x["d"]) > 0) & (shared_count(x["d"], x["h"]) > share * F.size(x["d"])))


def proper_nouns(c: Column) -> Column:
    """Lower-cased words with a leading capital that do not begin their sentence."""
    each = lambda s: F.transform(F.slice(F.split(s, r"\s+"), 2, F.size(F.split(s, r"\s+"))), lambda w: F.regexp_replace(w, "[^A-Za-z0-9]", ""))
    words = F.flatten(F.transform(F.split(_text(c), r"(?<=[.!?])\s+"), each))
    return F.array_distinct(F.transform(F.filter(words, lambda w: w.rlike("^[A-Z]") & (F.length(w) > 1)), F.lower))


def expressive_length(run: Column, names: Column) -> Column:
    """Words of a run that are neither names nor function words."""
    return F.size(F.filter(run, lambda w: ~F.array_contains(names, w) & ~w.isin(STOPWORDS)))


def quoted_runs(c: Column) -> Column:
    """Word counts of the passages of ten or more characters in double quotes."""
    return F.transform(F.regexp_extract_all(_text(c), F.lit('"([^"]{10,})"'), F.lit(1)), lambda q: F.size(word_list(q)))


def style_lint(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels of the (pattern, label) rules a text breaks, then "exclamation" for a mark outside quotes."""

    def labels(text: Column) -> Column:
        found = [F.when(text.rlike(f"(?i){_ahead(p)}"), F.lit(label)) for p, label in rules]
        loud = F.when(text.contains("!") & F.regexp_replace(text, '"[^"]*"', "").contains("!"), F.lit("exclamation"))
        return F.array_compact(F.array(*found, loud))

    return F.transform(F.array(_text(c)), labels)[0]  # a list's element is computed once, however often it is used


@F.pandas_udf(StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without diacritics (Python: the JVM functions have no normaliser)."""
    return s.map(lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c) not in ("Mn", "Me", "Lm", "Sk")))


def slugify(c: Column, most: int = 80) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(ascii_fold(F.lower(_text(c))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(dashed, 1, most), "-+$", "")


def digest_slug(title: Column, most: int = 60) -> Column:
    """A short slug; a title without any usable character falls back on its length."""
    short = F.regexp_replace(F.substring(slugify(title), 1, most), "-+$", "")
    return F.when(short == "", F.concat(F.lit("item-"), F.length(_text(title)).cast("string"))).otherwise(short)


def monogram(c: Column) -> Column:
    """Initials of the first two words, or the first two letters of a single one."""
    words = F.split(F.trim(F.regexp_replace(_text(c), "[^A-Za-z0-9 ]", " ")), r"\s+")
    return F.upper(F.when(F.size(words) == 1, F.substring(words[0], 1, 2)).otherwise(F.concat(F.substring(words[0], 1, 1), F.substring(words[1], 1, 1))))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(_text(c), r"\s+"), lambda w: w != ""))


def read_minutes(*parts: Column) -> Column:
    """Minutes at a fixed pace over all parts, one at least, halves rounded up."""
    n = sum((word_count(p) for p in parts[1:]), word_count(parts[0]))
    return F.greatest(F.lit(1), F.floor(n / WORDS_PER_MINUTE + 0.5).cast("int"))


def escape_xml(c: Column) -> Column:
    out = _text(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def safe_json(c: Column) -> Column:
    """JSON text that may stand inside a script element."""
    out = c
    for raw, safe in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def _character(ref: Column) -> Column:
    """The character of a numeric reference (#10 or #xA), or null if it tells none."""
    hexadecimal = ref.startswith("#x")
    digits = F.regexp_replace(F.when(hexadecimal, F.substring(ref, 3, 1 << 30)).otherwise(F.substring(ref, 2, 1 << 30)), "^0+(?=.)", "")
    code = F.when(F.length(digits) > 7, None).when(hexadecimal, F.conv(digits, 16, 10)).when(digits.rlike("^[0-9]+$"), digits).cast("int")
    known = (code < 0x110000) & ~code.between(0xD800, 0xDFFF)  # halves of a pair are no characters
    return F.when(known, F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32"))


def decode_entities(c: Column) -> Column:
    """Numeric and the named references of feeds, in one pass; unknown names and impossible numbers stay as they are."""
    named = F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv])

    def piece(p: Column) -> Column:
        ref = F.regexp_extract(p, "^(#x?[0-9a-fA-F]+|[a-zA-Z]+);", 1)
        told = F.when(ref == "", None).when(ref.startswith("#"), _character(ref)).otherwise(named[ref])
        return F.coalesce(F.concat(told, F.substring(p, F.length(ref) + 2, F.length(p))), F.concat(F.lit("&"), p))

    pieces = F.split(c, "&", -1)
    whole = lambda x: F.concat(x[0], F.array_join(F.transform(F.slice(x, 2, F.size(x)), piece), ""))  # noqa: E731 - what stands behind each ampersand
    return F.when(~c.contains("&"), c).otherwise(F.transform(F.array(pieces), whole)[0])


def strip_tags(c: Column) -> Column:
    """CDATA unwrapped, tags to spaces, white space collapsed."""
    plain = F.regexp_replace(F.regexp_replace(_text(c), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def squash(c: Column) -> Column:
    return F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]", "")


def label_colon(c: Column) -> Column:
    """A headline that opens with a label of one or two words and a colon."""
    before = F.substring_index(_text(c), ": ", 1)
    return _text(c).contains(": ") & (word_count(before) <= 2)


def via_publisher(title: Column) -> Column:
    """The outlet an aggregator names after the last spaced dash of a title, or null."""
    got = F.regexp_extract(_text(title), r"\s[-–—]\s([^-–—]{2,40})$", 1)
    return F.when(got == "", None).otherwise(F.trim(got))
