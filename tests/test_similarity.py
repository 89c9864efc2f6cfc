import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import similarity


def longest(a, b, n):
    """(length, end on the left) of the longest common run of at least n words, the first that ends; by the plain table."""
    best, row = (0, 0), [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                if new[j] > best[0]:
                    best = (new[j], i)
        row = new
    return best if best[0] >= n else None


@pytest.mark.parametrize("more_than,vocabulary", [(7, 500), (7, 2), (2, 30), (0, 40)])
def test_runs_equal_the_plain_table(spark, more_than, vocabulary):
    """Copied passages in other surroundings, texts of few different words, passages at both ends, equal texts."""
    r = random.Random(vocabulary)
    word = lambda: f"w{r.randrange(vocabulary)}"
    passages = [[word() for _ in range(r.randint(6, 40))] for _ in range(6)]
    text = lambda: sum((r.choice(passages)[r.randint(0, 3) :] if r.random() < 0.5 else [word() for _ in range(r.randint(0, 9))] for _ in range(r.randint(0, 5))), [])
    left, right = [text() for _ in range(25)], [text() for _ in range(15)] + passages[:2]
    left.append(right[0])
    a = spark.createDataFrame([(i, " ".join(t), 0) for i, t in enumerate(left)], "i long, t string, h int")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(right)], "j long, u string")
    found = {(x.left_id, x.right_id): (x.run_len, x.run_end) for x in similarity.shared_runs(a, b, "i", F.col("t"), "j", F.col("u"), more_than).collect()}
    wanted = {(i, j): got for i, t in enumerate(left) for j, u in enumerate(right) if (got := longest(t, u, more_than + 1))}
    assert found == wanted


def test_a_common_passage_is_a_row_a_pair(spark):
    """Of 300 words that all texts share only the ends are joined."""
    r = random.Random(4)
    passage = [f"p{r.randrange(10_000)}" for _ in range(300)]
    side = lambda k, n: spark.createDataFrame([(i, " ".join([f"{k}{i}x{r.randrange(99)}" for _ in range(9)] + passage + [f"{k}{i}"])) for i in range(n)], "i long, t string")
    runs = similarity.shared_runs(side("a", 20), side("b", 10), "i", F.col("t"), "i", F.col("t"))
    assert {(x.run_len, x.run_end) for x in runs.collect()} == {(300, 309)} and runs.count() == 200
    marks = similarity.anchors(side("a", 20), "i", F.col("t"), 8, 4, "left")
    assert marks.count() < 0.5 * 20 * 310


def test_null_and_short_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (4, "a b c d e f g h")], "i long, t string")
    assert [tuple(x) for x in similarity.shared_runs(df, df, "i", F.col("t"), "i", F.col("t")).collect()] == [(4, 4, 8, 8)]
    assert similarity.shared_runs(df.where("false"), df, "i", F.col("t"), "i", F.col("t")).count() == 0


def most_rows(df):
    """The most rows that any step of the plan gave, after df was collected."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        inner = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else None
        children = node.children()
        todo += [inner] if inner is not None else [children.apply(i) for i in range(children.size())]
    return most


def test_copied_headlines_are_no_pairs(spark):
    """3,000 copies of one headline cost a row each; the first of them, or an earlier headline that is like it, is what they restate."""
    rows = [(0, "alpha bravo charlie delta golf")] + [(i, "delta bravo charlie alpha") for i in range(1, 3001)] + [(4000 + i, f"other{i} thing{i}") for i in range(20)]
    got = similarity.first_restated(spark.createDataFrame(rows, "i long, t string"), "i", F.col("t"), "i")
    assert {(x.id, x.earlier, x.similarity) for x in got.collect()} == {(i, 0, 0.8) for i in range(1, 3001)}
    assert most_rows(got) < 10_000


@pytest.mark.parametrize("at_least", [0.6, 0.3, 0.85])
def test_restated_equals_all_pairs(spark, at_least):
    """Copies, parts and sets over few words, equal places in the order, null titles."""
    r = random.Random(5)
    words = [f"word{k}" for k in range(14)]
    rows = [(i, r.randint(0, 40), " ".join(r.sample(words, r.choice([0, 1, 2, 3, 4, 5, 8, 10])))) for i in range(250)] + [(900, 3, None)]
    sets = {i: (at, i, frozenset((t or "").split())) for i, at, t in rows}
    wanted = {}
    for at, i, a in sets.values():
        near = [(x, j, len(a & b) / len(a | b)) for x, j, b in sets.values() if (x, j) < (at, i) and a and b and len(a & b) / len(a | b) > at_least]
        if near:
            wanted[i] = (at, *min(near))
    found = similarity.first_restated(spark.createDataFrame(rows, "i long, d int, t string"), "i", F.col("t"), "d", at_least).collect()
    assert {x.id: (x.at, x.earlier_at, x.earlier, x.similarity) for x in found} == wanted and len(found) == len(wanted)
