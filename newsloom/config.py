"""Configuration as data: beats, publishers, blocked hosts, weights and patterns.

Callers bring their own. The defaults here fit the invented words of the test tables, so every
query has something to find.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from newsloom.functions.text import bounded


@dataclass(frozen=True)
class Beat:
    id: str
    label: str
    blurb: str = ""
    keywords: tuple[str, ...] = ()
    queries: tuple[str, ...] = ()
    quota: int = 2
    min_quota: int = 1
    digest_quota: int | None = None


@dataclass(frozen=True)
class Book:
    """Publishers in order of precedence (host, name, tier) and blocked hosts."""

    publishers: tuple[tuple[str, str, int], ...] = ()
    blocked: tuple[str, ...] = ()


@dataclass(frozen=True)
class Weights:
    """Shares of the seven terms of a cluster's score."""

    # Scores are compared with those of other tools that use the same shares.
    corroboration: float = 0.26
    substance: float = 0.20
    urgency: float = 0.12
    recency: float = 0.18
    source_quality: float = 0.16
    novelty: float = 0.06
    publisher_diversity: float = 0.02


def any_word(*forms: str) -> str:
    """A pattern of any of these words or phrases, whole, with any white space inside a phrase."""
    return bounded("|".join(r"\s+".join(f.split(" ")) for f in forms))


@dataclass(frozen=True)
class Patterns:
    """Case-insensitive patterns of a headline's kind.

    The defaults are a plain start for English general news; a desk brings the words of its own field.
    """

    quantity: str = r"[$€£¥]\s*\d|\d\s*%|" + any_word(r"\d+ (?:percent|thousand|million|billion|tonnes|people)")
    event: str = any_word("signs", "signed", "votes", "voted", "agrees", "agreed", "resigns", "resigned", "elects", "elected", "fines", "fined", "orders", "ordered", "opens", "closes")
    corporate: str = any_word("proud to", "our (?:mission|values|people|story)", "meet the team", "behind the scenes", "a message from")
    breaking: str = any_word("power cut", "evacuated", "evacuation", "explosion", "earthquake", "state of emergency", "product recall", "stops? working")
    release: str = any_word("introduces", "introduced", "debuts", "publishes", "published", "first edition", "on sale", "open to the public", r"version \d+")


@dataclass(frozen=True)
class Config:
    beats: tuple[Beat, ...]
    book: Book
    relevant_words: tuple[str, ...] = ()
    relevant_parts: tuple[str, ...] = ()
    weights: Weights = field(default_factory=Weights)
    patterns: Patterns = field(default_factory=Patterns)
    style: tuple[tuple[str, str], ...] = ()
    excluded_sources: tuple[str, ...] = ()


#: A plain start of (pattern, label) rules of style.
STYLE = (
    (any_word("very"), "filler: very"),
    (any_word("basically"), "filler: basically"),
    (any_word("obviously", "of course"), "opinion: obviously"),
    (any_word("going forward"), "office: going forward"),
)

#: For the test tables: their words are invented, and so are these.
TEST = Config(
    beats=(
        Beat("north", "Rewh", "orre thatin", ("rewh", "thatin", "erst", "andthe", "reing"), (), 2, 1, 6),
        Beat("south", "Ontion", "heand", ("ontion", "heon", "thre", "inthe", "anhe", "erst"), (), 2, 1, 6),
        Beat("east", "Einer", "verung", ("einer", "verung", "enge", "lichkeit", "undder"), ("nicht used",), 1, 1, 4),
        Beat("west", "Leou", "", (), ("tion eau", "elle ment", "cióna ados"), 1, 0, 4),
    ),
    book=Book(
        (
            ("ththan.example.com", "Ththan", 1),
            ("example.com", "Example", 2),
            ("thre.example.net", "Thre", 1),
            ("example.net", "Netpaper", 3),
            ("example.org", "Orgpaper", 2),
        ),
        ("casino-win.example.com", "free-bets.example.com"),
    ),
    relevant_words=("the", "thre", "einer", "der", "la", "el", "en"),
    relevant_parts=("tion", "heon", "ment"),
    patterns=Patterns(quantity=r"\d", event=bounded("of|and|elle"), corporate=bounded("journey|ofthe|erst"), breaking=bounded("ea|heed|que"), release=bounded("ti|ing|des")),
    style=((bounded("erand"), "hype: erand"), (bounded("onthe"), "filler: onthe"), ("therein", "filler: therein")),
    excluded_sources=("src13",),
)


def local(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table as a local relation (by way of Arrow): planned without a job or a Python worker."""
    schema = StructType.fromDDL(ddl)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema.fields]
    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), schema)


def publishers(spark: SparkSession, book: Book) -> DataFrame:
    rows = [(i, h, n, t) for i, (h, n, t) in enumerate(book.publishers)]
    return local(spark, rows, "list_pos int, host string, name string, tier int")


def blocked(spark: SparkSession, book: Book) -> DataFrame:
    return local(spark, [(h,) for h in book.blocked], "host string")


def beats(spark: SparkSession, config: Config) -> DataFrame:
    rows = [(i, b.id, b.label, b.blurb, list(b.keywords), list(b.queries), b.quota, b.min_quota, b.digest_quota or b.quota) for i, b in enumerate(config.beats)]
    return local(spark, rows, "pos int, id string, label string, blurb string, keywords array<string>, queries array<string>, quota int, min_quota int, digest_quota int")
