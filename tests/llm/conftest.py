"""Small tables with awkward rows, in the layout that queries read."""

from __future__ import annotations

import pytest

LONG = ("alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4000).strip()
NEAR = "the quick brown fox jumps over the lazy dog while seven other animals look on and wait for the evening to come down slowly over all the hills around them"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, id string, node string, size long, hash long, key string, value string, n long, words long"


def doc(doc_id, text, source="web", lang="en"):
    return (doc_id, text, lang, source, len(text) if text is not None else None, 1, "x", "y", 2, 3, "k", "v", 4, 5)


ODD = [
    doc(1, None), doc(2, ""), doc(3, " \t\n "), doc(4, "one"), doc(5, "one"), doc(6, "é ü 你好 \U0001f600 a b c"),
    doc(7, LONG, "hot"), doc(8, LONG, "hot"), doc(9, NEAR, None), doc(10, NEAR + " again", None), doc(11, NEAR.replace("fox", "cat"), "web"),
    doc(12, "x" * 200_000), doc(13, "mail a@b.co or x.y@z.example.org, +1 (555) 010-7788, 10.0.0.1, 300.1.1.1, card 4111 1111 1111 1111."),
    doc(14, "a\n\na\na\nb  c\r\n\td"), doc(14, "a\n\na\na\nb  c\r\n\td"), doc(None, "no id here", None, None), doc(15, "0" * 50_000), doc(16, "a.b@" * 20_000), doc(17, NEAR, "web"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables as a query's folder and gives its path."""

    def make(**tables) -> str:
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
