import pytest
from pyspark.sql import functions as F

from spindrel.functions import arrow as A
from spindrel.functions import text as X


def values(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, x string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x")).alias("y")).collect()]


def test_normalized(spark):
    texts = [
        '"NORTH AMERICAN AIRCRAFT SERVICES, INC."', "1-800-Flowers.Com Inc", "1Malaysia Development Bhd",
        "AIG United Guaranty Insurance (Asia) Ltd", "Alba Group plc &amp; Co KG", "", None, "Éa été",
    ]
    assert values(spark, texts, X.normalized) == [
        ["north", "american", "aircraft", "services", "inc"], ["1-800-flowers", "com", "inc"], ["1malaysia", "development", "bhd"],
        ["aig", "united", "guaranty", "insurance", "asia", "ltd"], ["alba", "group", "plc", "co", "kg"], [], None, ["éa", "été"],
    ]


def test_windows(spark):
    got = values(spark, ["Change in fiscal year", ""], lambda x: X.windows(X.word_tokens(x), 5))
    assert got[0] == [
        ["NONE", "NONE", "Change", "in", "fiscal"], ["NONE", "Change", "in", "fiscal", "year"],
        ["Change", "in", "fiscal", "year", "NONE"], ["in", "fiscal", "year", "NONE", "NONE"],
    ]
    assert got[1] == []


def test_names(spark):
    names = ["Apple Inc", "CommonWealth REIT Co", "Cognosante LLC", "Plain", "Apple Corp"]
    assert values(spark, names, X.strip_common) == ["Apple", "CommonWealth REIT", "Cognosante", "Plain", "Applerp"]
    assert values(spark, names, lambda x: X.strip_common(x, anchored=True))[4] == "Apple"
    assert values(spark, ["Federal Home Loan Mortgage Corp", ""], X.initials) == ["FHLMC", ""]


def test_disclaimer_and_sentences(spark):
    assert values(spark, ["THIS IS A NOTE", "Text", ""], lambda x: X.is_disclaimer(x, ["THIS IS", ""])) == [True, False, False]
    assert values(spark, ["One. Two!  Three", "", "End. "], X.sentences) == [["One.", "Two!", "Three"], [], ["End."]]


def test_replace(spark):
    patterns = [r"(?P<NUM>\d+)", r"(?P<EMPTY>#+)"]
    assert values(spark, ["a 12 ##b", None, ""], lambda x: A.multi_replace(patterns, x)) == ["a  NUM  b", None, ""]
    assert values(spark, ["a 12 ##b"], lambda x: A.multi_annotate(patterns, x)) == ["a  12 NUM  b"]
    assert values(spark, ["A&eacute;&amp;", None], A.repair_text) == ["Aé&", None]


@pytest.mark.parametrize(("a", "b", "jaro", "winkler"), [
    ("MARTHA", "MARHTA", 0.944444444, 0.961111111), ("DIXON", "DICKSONX", 0.766666667, 0.813333333),
    ("", "", 1.0, 1.0), ("a", "", 0.0, 0.0), ("abc", "xyz", 0.0, 0.0),
])
def test_similarity(a, b, jaro, winkler):
    assert A.jaro_similarity(a, b) == pytest.approx(jaro)
    assert A.winkler_similarity(a, b) == pytest.approx(winkler)
