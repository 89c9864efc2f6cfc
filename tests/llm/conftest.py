import random

import pytest

from newsloom.llm.base import prepare

WORDS = "the of and rewh thatin erst onhe tion ment ea heon ing le que ver ung".split()


@pytest.fixture(autouse=True)
def ready(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def docs_rows():
    """Odd and plain texts: null, empty, blank, repeated rows, one id twice, copies, near copies, long ones."""
    r = random.Random(5)
    prose = lambda n: "\n".join(" ".join(r.choice(WORDS) + str(r.randint(0, 40)) * (r.random() < 0.2) for _ in range(12)) + "." for _ in range(n))
    base, passage = prose(14), prose(9)
    rows = [(0, base), (1, base), (2, base.replace("rewh", "rewhx", 1)), (3, None), (4, ""), (5, " \n\t "), (6, "a"), (7, "Two words"), (8, "é" * 500 + "\n" + passage)]
    rows += [(9, prose(3) + "\n" + passage), (10, passage + "\n" + prose(2)), (11, "ab" * 700), (12, "A b.  C\n D"), (13, prose(120)), (13, "other text under one id"), (14, base), (14, base), (None, "no id " + prose(1))]
    rows += [(i, prose(r.randint(1, 6))) for i in range(20, 60)]
    return rows


@pytest.fixture()
def docs(spark, docs_rows):
    """With columns that clash with names the operators use inside."""
    return spark.createDataFrame([(*x, "s", 1, 2) for x in docs_rows], "doc_id long, text string, size string, shard int, n long").repartition(3)


@pytest.fixture()
def empty(docs):
    return docs.where("false")
