import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsloom.sources import totals
from newsloom.sources.totals import ArchiveTotals

DAYS = [dt.date(2026, 1, d) for d in (1, 2, 3, 4)]
SCHEMA = "date date, story long, beat string, url string, publisher string, tier int"


def cited(seed, day, n=120):
    r = random.Random(seed)
    some = lambda v: None if r.random() < 0.05 else v
    return [(day, some(r.randint(0, 15)), some(f"b{r.randint(0, 3)}"), some(f"u{r.randint(0, 90)}"), some(f"p{r.randint(0, 12)}"), r.choice([1, 2, None])) for _ in range(n)]


def plainly(rows):
    rows = [x for x in rows if x[0]]

    def told(part):
        n = lambda k: len({x[k] for x in part} - {None})
        return {"stories": len({(x[0], x[1]) for x in part if x[1] is not None}), "urls": n(3), "primary_sources": sum(x[5] == 1 for x in part), "publishers": n(4), "beats": n(2)}

    out = {day: told([x for x in rows if x[0] == day]) | {"sources": told([x for x in rows if x[0] == day])["urls"]} for day in {x[0] for x in rows}}
    return out | {None: told(rows) | {"sources": sum(x["sources"] for x in out.values())}}


def found(kept):
    return {r.date: {k: r[k] for k in ("stories", "urls", "primary_sources", "publishers", "beats", "sources")} for r in kept.signals().collect()}


def test_dates_added_one_by_one_and_again(spark, tmp_path):
    kept = ArchiveTotals(spark, str(tmp_path / "totals"), buckets=4)
    assert found(kept) == plainly([])
    rows = {day: cited(k, day) for k, day in enumerate(DAYS)}
    for day in DAYS:
        kept.add(spark.createDataFrame(rows[day] + [(None, 1, "b", "u", "p", 1)], SCHEMA))
    assert found(kept) == plainly(sum(rows.values(), []))
    rows[DAYS[1]] = cited(9, DAYS[1], 30)  # a date that is added again replaces itself
    kept.add(spark.createDataFrame(rows[DAYS[1]], SCHEMA))
    kept.add(spark.createDataFrame([], SCHEMA))
    assert found(kept) == plainly(sum(rows.values(), []))
    numbers = kept._table("numbers", "value string, number long, kind string, bucket int")
    assert numbers.count() == numbers.select("kind", "value").distinct().count() == numbers.select("kind", "bucket", "number").distinct().count()


def test_numbers_beyond_a_page(spark, tmp_path):
    kept = ArchiveTotals(spark, str(tmp_path / "totals"), buckets=2)
    wide = lambda day, n: spark.range(n).select(F.lit(day).alias("date"), F.lit(1).alias("story"), F.lit("b").alias("beat"), F.concat(F.lit("u"), "id").alias("url"), F.lit("p").alias("publisher"), F.lit(1).alias("tier"))
    kept.add(wide(DAYS[0], 150_000))
    kept.add(wide(DAYS[1], 40_000))
    total = found(kept)[None]
    assert (total["urls"], total["sources"], total["publishers"], total["stories"]) == (150_000, 190_000, 1, 2)


def test_a_writer_lost_before_its_counts_leaves_the_earlier_date(spark, tmp_path, monkeypatch):
    kept = ArchiveTotals(spark, str(tmp_path / "totals"), buckets=4)
    rows = cited(1, DAYS[0])
    kept.add(spark.createDataFrame(rows, SCHEMA))
    with monkeypatch.context() as m:
        m.setattr(F, "count_if", lambda c: 1 / 0)  # after the numbers and the bitmaps, before the counts
        with pytest.raises(ZeroDivisionError):
            kept.add(spark.createDataFrame(cited(2, DAYS[0]), SCHEMA))
    assert found(kept) == plainly(rows)
    later = cited(2, DAYS[1])
    kept.add(spark.createDataFrame(later, SCHEMA))
    assert found(kept) == plainly(rows + later)


def test_totals_read_no_citations(spark, tmp_path):
    kept = ArchiveTotals(spark, str(tmp_path / "totals"), buckets=4)
    kept.add(spark.createDataFrame(cited(1, DAYS[0]), SCHEMA))
    plan = kept.signals()._jdf.queryExecution().executedPlan().toString()
    assert "numbers" not in plan and "Expand" not in plan and "Python" not in plan


def test_bitmaps_are_begun_after_the_shuffle(spark, tmp_path, monkeypatch):
    """Bytes shuffled for bitmaps do not grow by 4 kB for each page and task."""
    seen, plain = [], totals.bitmaps
    monkeypatch.setattr(totals, "bitmaps", lambda placed: seen.append(plain(placed)) or seen[-1])
    kept = ArchiveTotals(spark, str(tmp_path / "totals"), buckets=2)
    rows = cited(3, DAYS[0], 400) + cited(4, DAYS[1], 400)
    kept.add(spark.createDataFrame(rows, SCHEMA).repartition(8))
    assert found(kept) == plainly(rows)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    aggregates = [i for i, line in enumerate(plan.splitlines()) if "bitmap_construct_agg" in line]
    assert len(aggregates) == 2 and not any("Exchange" in line for line in plan.splitlines()[aggregates[0] : aggregates[1]])


def test_staged_rows_are_gone_after_an_addition(spark, tmp_path):
    kept = ArchiveTotals(spark, str(tmp_path / "totals"), buckets=2)
    kept.add(spark.createDataFrame(cited(5, DAYS[0]), SCHEMA))
    assert not [p for p in (tmp_path / "totals" / "staged").glob("*")]
