"""Stable hashes and the seeded generator."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

OFFSET, PRIME, WORD = 2166136261, 16777619, 0xFFFFFFFF
# Backgrounds of a cover, and numbers drawn for its tones before the background is.
PLATES, TONE_DRAWS = 100, 12


def hash32(c: Column) -> Column:
    """32-bit FNV-1a over a text's characters (below U+10000), as an unsigned number."""
    return F.aggregate(
        F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != ""),
        F.lit(OFFSET).cast("long"),
        lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(PRIME)).bitwiseAND(F.lit(WORD)),
    )


def hash32_of(text: str) -> int:
    h, units = OFFSET, text.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[i : i + 2], "little")) * PRIME) & WORD
    return h


def draws(seed: int, n: int) -> list[float]:
    """The first n numbers of the 32-bit mulberry generator."""
    out, a = [], seed & WORD
    for _ in range(n):
        a = (a + 0x6D2B79F5) & WORD
        t = ((a ^ (a >> 15)) * (a | 1)) & WORD
        t = (((t + (((t ^ (t >> 7)) * (t | 61)) & WORD)) & WORD) ^ t) & WORD
        out.append((t ^ (t >> 14)) / 4294967296)
    return out


def _times(a: Column, b: Column) -> Column:
    """The product of two 32-bit numbers modulo 2**32, by halves that stay within a long."""
    high = (F.shiftright(a, 16) * b).bitwiseAND(F.lit(0xFFFF)) * F.lit(0x10000)
    return (a.bitwiseAND(F.lit(0xFFFF)) * b + high).bitwiseAND(F.lit(WORD))


def random_draws(seed: Column, n: int) -> Column:
    """An array of the generator's first n numbers for a seed; each depends on the seed and its place alone."""
    step = lambda v, f: F.transform(v, f)
    state = step(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")), lambda k: (seed + k * F.lit(0x6D2B79F5).cast("long")).bitwiseAND(F.lit(WORD)))
    first = step(state, lambda a: _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1))))
    second = step(first, lambda t: (t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(WORD)).bitwiseXOR(t))
    return step(second, lambda t: t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0))


def cover_choice(seed: Column, motifs: Column, plates: int = PLATES, tone_draws: int = TONE_DRAWS) -> Column:
    """struct(plate, motif): a cover's background number and its subject of those its section allows (null without any).

    The generator is seeded with the hash of a text; its first numbers go into the cover's tones.
    """
    d = random_draws(hash32(seed), tone_draws + 2)
    n = F.coalesce(F.size(motifs), F.lit(0))
    motif = F.when(n > 0, F.get(motifs, F.floor(d[tone_draws + 1] * n).cast("int")))
    return F.struct(F.floor(d[tone_draws] * plates).cast("int").alias("plate"), motif.alias("motif"))


@F.pandas_udf(StringType())
def edition_hash(raw: pd.Series) -> pd.Series:
    """SHA-256 of an edition's stories, written anew from its raw JSON without white space."""

    def one(text: str | None) -> str | None:
        try:
            stories = json.loads(text)["stories"]
        except (TypeError, ValueError, KeyError):
            return None
        return hashlib.sha256(json.dumps(stories, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()

    return raw.map(one)
