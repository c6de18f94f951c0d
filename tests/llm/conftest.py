from pathlib import Path

import pytest

ODD_TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "word"),
    (5, "the same text of a few words and no more than that"),
    (5, "the same text of a few words and no more than that"),
    (None, "a text without an id but with quite a few words"),
    (7, "long " * 50_000),
    (8, "é😀ß 　ünï 漢字 " * 20),
]


@pytest.fixture
def odd_docs(spark):
    """Nulls, blanks, repeated rows, a very long text, and columns whose names clash."""
    clashing = ["_id", "_key", "_spans", "_n", "_copy", "_none", "_score", "_toxic", "_judged", "_f"]
    rows = [(i, t, "x", 1.0, 2, *range(len(clashing))) for i, t in ODD_TEXTS]
    more = ", ".join(f"{c} int" for c in clashing)
    return spark.createDataFrame(
        rows, f"doc_id long, text string, cls string, score double, base int, {more}"
    )


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture
def steps(spark):
    """The names of step folders made since the test began."""
    folder = Path(spark.conf.get("spark.checkpoint.dir")) / "rateline"
    names = lambda: {p.name for p in folder.glob("*")}
    before = names()
    return lambda: {n.rsplit("-", 1)[0] for n in names() - before}
