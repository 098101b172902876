import numpy as np
import pytest

from weft.llm.queries import QUERIES
from weft.llm.reading import counted, covering_ranks, document_features, everyday_words, features, prose, reading_bands, vocabulary

EASY = "The dog is in the park and it is big. We can see the sun. It was a hot day. "
HARD = "The administrative considerations regarding environmental infrastructure demonstrate that the comprehensive evaluation of contemporary methodologies is fundamentally interdependent with the organisational responsibilities of the participating institutions. "


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, band string")


def test_covering_ranks():
    doc, rank, count = np.array([2, 0, 0, 2, 0, 3]), np.array([1.0, 1, 90, 7, 5, 4]), np.array([6.0, 6, 1, 1, 3, 2])
    core, wide = covering_ranks(doc, rank, count, 5, (0.6, 0.61))
    assert core.tolist() == [1, 0, 1, 4, 0] and wide.tolist() == [5, 0, 1, 4, 0]
    assert covering_ranks(doc, rank, count, 5, (1.0,))[0].tolist() == [90, 0, 7, 4, 0]
    assert covering_ranks(*(np.zeros(0, k) for k in (int, float, float)), 2, (0.5,))[0].tolist() == [0, 0]


def test_everyday_words(spark):
    d = counted(docs(spark, [(1, "a b c"), (2, "a b"), (3, "a <i>d</i>"), (4, "z z z"), (5, None), (6, "!!")]).select("doc_id", "text").where("text is not null"))
    ratings = spark.createDataFrame([(1, 1), (2, 2), (2, 3), (3, 1), (4, None), (6, 1), (9, 1)], "doc_id long, band int")
    assert everyday_words(d, ratings, 0.6) == {"a", "b"} and everyday_words(d, ratings, 0.3) == {"a", "b", "c", "d"}
    assert everyday_words(d, ratings.where("band > 9")) == frozenset()


def test_vocabulary_ranks_share_ties(spark):
    got = {r.word: (r.n, r["rank"]) for r in vocabulary(counted(docs(spark, [(1, "a a a b b c c d"), (2, ""), (3, "D <b>e</b>")]).select("doc_id", "text"))).collect()}
    assert got == {"a": (3, 1), "b": (2, 4), "c": (2, 4), "d": (2, 4), "e": (1, 5)}


def test_bands(spark):
    rows = [(i, (EASY if i % 2 else HARD) * (3 + i % 4)) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "   "), (103, EASY), (104, "x = 1;\n" * 200), (105, "2031-01-01 INFO power=12 node=7\n" * 50), (106, "Le chien est dans le parc et il est grand. Nous avons vu la rivière. " * 8), (107, "a;b;c\n1;2;3\n" * 80), (108, "- The dog is in the park\n- We can see it\n" * 12), (109, HARD * 3_000), (1, EASY * 4)]
    ratings = spark.createDataFrame([(i, 1 if i % 2 else 4, None) for i in range(20)] + [(3, 4, "wrong"), (2, None, None), (999, 2, None), (None, 1, None)], "doc_id long, band int, rater string")
    got = {r.doc_id: r.band for r in reading_bands(docs(spark, rows), ratings).collect()}
    assert {k: v for k, v in got.items() if k < 100} == {i: 1 if i % 2 else 4 for i in range(40)}
    assert {k for k in got if k >= 100} == {108, 109} and got[109] == 4


def test_joining_ranks_gives_the_same(spark):
    d = counted(docs(spark, [(1, EASY * 4), (2, HARD * 2), (3, "!!!"), (4, EASY + HARD)]).select("doc_id", "text"))
    ranks = vocabulary(d)
    a, b = ({r.doc_id: r.asDict() for r in document_features(d, ranks, frozenset(("the", "is")), most=m).collect()} for m in (10**6, 0))
    assert a == b and a[3]["core_rank"] == a[3]["wide_rank"] == 0 and a[1]["common"] > a[2]["common"] > 0


def test_features_of_odd_texts():
    for text in ("", "—" * 200_000, "a" * 300_000, "\n" * 100_000, "<" * 50_000, "&" * 50_000, "<!--" * 20_000, "word " * 100_000):
        f = features(text)
        assert f["n_words"] >= 0


def test_empty_tables(spark):
    r = spark.createDataFrame([], "doc_id long, band int")
    assert reading_bands(docs(spark, []), r).count() == 0
    assert reading_bands(docs(spark, [(1, EASY * 9)]), r).count() == 0


def test_prose_needs_words(spark):
    d = counted(docs(spark, [(1, "the dog is in the park " * 8), (2, "the dog is in the park " * 9)]).select("doc_id", "text"))
    assert [r.doc_id for r in prose(document_features(d, vocabulary(d), frozenset(("the", "in"))), 0.1).collect()] == [2]


def test_held_out_agreement(spark):
    """Bands placed by half of the raters' documents agree with the other half as far as raters agree with each other; rank and sentences do without letters too."""
    root = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{root}/reading_labels.parquet").toPandas()
    train, test = labels[labels.doc_id % 2 == 0], labels[labels.doc_id % 2 == 1]
    for scale, least in ((("core", "wide", "length", "letters"), 0.9), (("core", "wide", "length"), 0.85)):
        got = reading_bands(spark.read.parquet(f"{root}/documents.parquet"), spark.createDataFrame(train[["doc_id", "band"]]), scale=scale).toPandas()
        both = test.merge(got, on="doc_id", how="left", suffixes=("", "_found"))
        assert both.band_found.notna().all()
        assert (both.band == both.band_found).mean() > least


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
