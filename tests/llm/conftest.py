import pytest

SCHEMA = "doc_id long, text string, lang string, id long, row long, key string, fp long, chunk int, kind int, h long, source string"


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls in either, empty and blank texts, repeated rows, ties, a very long text without spaces and one with many."""
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "a b"), (4, "a b"), (None, "x y z"), (None, None), (5, "word " * 30_000), (6, "q" * 70_000), (7, "Ünï çödé　x y\x1cz"),
        (8, "a  b"), (9, "a\tb"), (10, "A B"), (11, "the same text, twice over."), (12, "the same text, twice over."), (13, "  \n\n  lead and trail  \n"), (14, "idiot moron."),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows, tmp_path_factory):
    """The same as a table in two files, with columns whose names the operators use themselves."""
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    rows = [(i, t, None, 1, 2, "k", 3, 4, 5, 6, None) for i, t in edge_rows]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.filter("false")
