import random

from newsloom.operators import dedup


def brute(rows):
    """(scope, id) of the rows in order: the nth of an id gets n plus the taken numbers before the free one."""
    out, seen = {}, {}
    taken = {(s, i) for _, s, i in rows}
    for pos, s, i in sorted(rows):
        n = seen[s, i] = seen.get((s, i), 0) + 1
        if n == 1:
            out[pos] = i
            continue
        used = sorted(int(t.rsplit("-", 1)[1]) for u, t in taken if i is not None and u == s and t and t.startswith(f"{i}-") and t[len(i) + 1 :].isdigit() and t[len(i) + 1] != "0" and int(t[len(i) + 1 :]) >= 2)
        out[pos] = None if i is None else f"{i}-{n + sum(k - j <= n for j, k in enumerate(used))}"
    return out


def test_suffixes_equal_the_plain_count(spark):
    r = random.Random(2)
    rows = [(p, r.choice("uv"), r.choice(["x", "y", "x-2", "x-3", "x-7", "y-2", "z", None, "x-2-2", "x-02", "z-1"])) for p in range(300)]
    df = spark.createDataFrame(rows, "pos int, s string, id string").repartition(5)
    assert {x.pos: x.id for x in dedup.suffix_collisions(df, "id", ["pos"], ["s"]).collect()} == brute(rows)


def test_an_id_of_many_rows_and_taken_numbers(spark):
    rows = [(p, "u", "x") for p in range(20_000)] + [(20_000 + k, "u", f"x-{3 * k + 2}") for k in range(3_000)]
    found = {x.pos: x.id for x in dedup.suffix_collisions(spark.createDataFrame(rows, "pos int, s string, id string"), "id", ["pos"], ["s"]).collect()}
    assert len(set(found.values())) == 23_000
    free = (k for k in range(2, 40_000) if k % 3 != 2 or k > 3 * 2_999 + 2)
    assert [found[p] for p in range(20_000)] == ["x"] + [f"x-{next(free)}" for _ in range(19_999)]
