import html
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrel.functions import arrow as A

from spindrel.functions import text as X
from spindrel.operators import aggregates as G
from spindrel.operators import candidates as C
from spindrel.operators import features as P
from spindrel.operators import mentions as M
from spindrel.operators import ml
from spindrel.operators.kb import build_kb, load_kb, store_kb


@pytest.fixture(scope="module")
def kb(spark):
    companies = spark.createDataFrame(
        [(1, "Goodwin Procter LLP", "Utopia", 0), (2, "Bank of America", None, 1), (3, "Acme Inc", "Utopia", 2), (4, "ACME INC", "Elsewhere", 3)],
        "id long, name string, domicile string, ord long",
    )
    forms = spark.createDataFrame([(3, "Roadrunner Supply")], "id long, form string")
    tickers = spark.createDataFrame([(2, "BAC")], "id long, ticker string")
    return build_kb(companies, forms, tickers)


def test_sentence_mentions(spark):
    text = "Goodwin Procter LLP next previous EQUITY RESIDENTIAL and Bank of America"
    words = "goodwin procter llp equity residential bank america of".split()
    rows = spark.createDataFrame([(0, 2, 1, 2.0, 1.0, text)], "story_id long, par_idx int, sent_idx int, paragraph double, sentence double, s string")
    rows = rows.withColumn("tokens", X.word_tokens(F.col("s")))
    ltoken = spark.createDataFrame([(w,) for w in words], "ltok string")
    white = spark.createDataFrame([("of", "Bank", "America")], "token string, prev string, next string")
    got = M.sentence_mentions(rows, ltoken, white).orderBy("tok_idx").collect()
    assert [tuple(r[:7]) + (r["token_cnt"],) for r in got] == [
        ("Goodwin Procter LLP", "NONE", "NONE", "next", "previous", 0.0, 2.0, 3),
        ("EQUITY RESIDENTIAL", "next", "previous", "and", "Bank", 0.5555555555555556, 2.0, 2),
        ("Bank of America", "RESIDENTIAL", "and", "NONE", "NONE", 1.0, 2.0, 3),
    ]


def test_knowledge_base(kb, spark, tmp_path):
    assert {tuple(r) for r in kb.full_names.where("key like 'acme%'").collect()} == {("acme inc", 4)}  # the last one wins
    assert kb.ltoken.where("ltok in ('bank', 'bac', 'roadrunner', 'boa')").count() == 4
    assert ("of", "Bank", "America") in {tuple(r) for r in kb.whitelist.collect()}
    assert kb.token_freq.where("token = 'Inc'").first()["freq"] == 1.0
    store_kb(kb, str(tmp_path))
    assert load_kb(spark, str(tmp_path)).company.count() == 4


def test_candidates(kb, spark):
    texts = ["Bank of America", "acme", "Roadrunner Supply", "BAC", "Procter unknown", "nothing"]
    mentions = spark.createDataFrame([(7, t) for t in texts], "story_id long, text string")
    got = {(r["text"], r["coid"], r["route"]) for r in C.cascade(mentions, kb).collect()}
    assert got == {
        ("Bank of America", 2, "exact"), ("acme", 3, "stripped"), ("Roadrunner Supply", 3, "surface"), ("BAC", 2, "ticker"), ("Procter unknown", 1, "token"),
    }
    assert not [x for x in got if x[0] == "nothing"]
    rows = C.generate_candidates(mentions, kb, with_map=True)
    assert rows.where("text = 'BAC'").first()["candidates"] == {2: 1.0}
    tags = spark.createDataFrame([(7, 2, "H")], "story_id long, coid long, relevance string")
    assert {(r["text"], r["relevance"]) for r in C.relevance(rows, tags).where("candidate in (1, 2)").collect()} >= {("BAC", "H"), ("Procter unknown", "NO")}
    assert {r["text"]: r["is_tagged"] for r in C.tagged_mentions(mentions, kb, tags).collect()}["nothing"] is False


def test_token_route(spark):
    index = spark.createDataFrame([("token1", 1), ("token2", 1), ("token2", 2), ("token3", 3)], "ltok string, coid long")
    texts = spark.createDataFrame([("token1 & (token2)",)], "text string")
    assert [tuple(r) for r in C.token_route(texts, index).collect()] == [("token1 & (token2)", 1, 1.5)]


def test_token_route_prunes_common_words_exactly(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(40)]
    index = {(t, c) for c in range(300) for t in [rng.choice(names), rng.choice(["inc", "co", "of"]), *(["big"] if c % 3 else [])]}
    texts = [" ".join(rng.choices([*names, "inc", "co", "of", "big", "unknown"], k=rng.randint(1, 5))) for _ in range(150)]
    count = Counter(t for t, _ in index)
    want = set()
    for text in set(texts):
        sums = {}
        for w in text.split():
            for t, c in index:
                if t == w:
                    sums[c] = sums.get(c, 0) + 1 / count[w]
        sums = {c: round(s, 9) for c, s in sums.items()}
        best = sorted(sums.items(), key=lambda x: (-x[1], x[0]))[: C.TOP]
        want |= {(text, c, s) for c, s in best if s > C.SHARE * best[0][1]}
    rows = spark.createDataFrame([(t,) for t in set(texts)], "text string")
    got = C.token_route(rows, spark.createDataFrame(sorted(index), "ltok string, coid long"))
    assert {(r["text"], r["coid"], round(r["weight"], 7)) for r in got.collect()} == {(t, c, round(s, 7)) for t, c, s in want}


def test_story_token_frequencies(spark):
    rows = [
        (0, "headline_token1", "text_token1, text_token2 text_token1 text_token1"),
        (1, "headline_token2, headline_token2", "text_token2 text_token2 text_token2"),
    ]
    stories = spark.createDataFrame(rows, "story_id long, headline string, text string")
    got = {r["token"]: r["freq"] for r in G.story_token_frequencies(M.tokenized(stories)).collect()}
    assert (got["headline_token2"], got["text_token2"], got["headline_token1"], got["SENTENCE_START"], got["SENTENCE_END"]) == (2, 4, 1, 4, 4)


def test_unique_mentions(spark):
    rows = spark.createDataFrame([("same", "w"), ("same", "w"), ("other", "w")], "text string, next_word string")
    assert [tuple(r) for r in G.unique_mentions_per_word(rows, "next_word").collect()] == [("w", 2)]


def test_scores(spark):
    df = spark.range(1).select(
        G.f1_score(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))).alias("f"), G.f1_score(F.array(F.lit(1)), F.array(F.lit(3))).alias("z"),
        G.normalize_scores(F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(1.0))).alias("m"),
    )
    row = df.first()
    assert (row["f"], row["z"], row["m"]) == (0.5, 0.0, {"a": 1.0, "b": 0.5})


def test_countries(spark):
    gazetteer = spark.createDataFrame([("city", "mclean", "US"), ("name", "france", "FR"), ("city", "france", "XX")], "kind string, key string, code string")
    rows = spark.createDataFrame([(1, "MCLEAN, Va."), (2, "France France McLean"), (3, ""), (4, None)], "story_id long, text string")
    got = {(r["story_id"], r["code"]): r["share"] for r in P.text_countries(rows, gazetteer).collect()}
    assert got[(1, "US")] == 1.0 and (3, "US") not in got


def test_empty_inputs(kb, spark):
    none = spark.createDataFrame([], "story_id long, headline string, text string, source string")
    mentions = M.extract_mentions(none, kb)
    assert mentions.count() == 0 and C.generate_candidates(mentions, kb).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None)], none.schema)
    assert M.extract_mentions(nulls, kb).count() == 0
    assert P.document_features(nulls).first()["doc_number_ratio"] is None


def test_stages(spark):
    rows = spark.createDataFrame([(1, True, 3.0, 5.0, "x"), (2, False, 1.0, 5.0, "y"), (3, False, None, 5.0, "z")], "story_id long, b boolean, v double, c double, s string")
    out = ml.Numerizer(keep=("story_id",)).transform(rows).orderBy("story_id").collect()
    assert [round(r["v"], 6) for r in out] == [1.336306, -0.267261, -1.069045] and {r["c"] for r in out} == {0.0} and "s" not in out[0]
    assert ml.front(rows, ["s"]).columns[0] == "s"
    assert ml.FeatureSelector(["v"]).get_params() == {"features": ["v"]} and "fitted" not in ml.ModelWrapper(None, ["v"]).get_params()
    assert ml.Pipeline([ml.PipelinePrint("m"), ml.FeatureSelector(["v"])]).fit_transform(rows).columns == ["v"]


def test_wrapped_model_equals_a_plain_fit(spark):
    from pyspark.ml.classification import LogisticRegression

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x @ [1.5, -2.0, 0.3] + rng.logistic(size=400) > 0.4).astype(float)
    rows = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, label double")
    model = ml.ModelWrapper(LogisticRegression(regParam=0.01, standardization=False, maxIter=200, tol=1e-12), ["a", "b", "c"])
    got = [r["prediction"] for r in model.fit(rows).transform(rows).orderBy("id").collect()]
    z = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(4), np.array([0.01, 0.01, 0.01, 0.0])
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) / len(z) + np.diag(penalty), z.T @ (p - y) / len(z) + penalty * w)
    assert np.abs(np.r_[model.fitted.coefficients.toArray(), model.fitted.intercept] - w).max() < 1e-3
    assert got == (z @ w > 0).astype(float).tolist()


def test_repaired_text(spark):
    texts = ["&#8217;s &eacute;t&eacute; &amp;amp; e\u0301", "", None, "&lt;b&gt;" * 1000, "&bogus; &#x1F600;"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", A.repair_text(F.col("t")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {i: None if t is None else unicodedata.normalize("NFC", html.unescape(t)) for i, t in enumerate(texts)}


def test_corpus_f1(spark):
    p = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 7)], "story_id long, coid long")
    t = spark.createDataFrame([(1, 5), (3, 9)], "story_id long, coid long")
    assert tuple(G.corpus_f1(p, t).first()) == (3, 2, 1, 1 / 3, 0.5, 0.4)
    assert tuple(G.corpus_f1(p.limit(0), t.limit(0)).first()) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_streaming(kb, spark, tmp_path):
    from spindrel.streaming.mentions import tag_stream

    rows = [(1, "Bank of America grows", "Bank of America and Acme Inc."), (2, "No", "no")]
    spark.createDataFrame(rows, "story_id long, headline string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("story_id long, headline string, text string").parquet(str(tmp_path / "in"))
    seen = []
    tag_stream(stream, kb, lambda df, n: seen.extend(r["text"] for r in df.collect()), str(tmp_path / "ck")).awaitTermination()
    assert sorted(seen)[-2:] == ["Bank of America", "Bank of America"]


def test_xml(spark, tmp_path):
    from spindrel.sources import xml

    (tmp_path / "s.xml").write_text(
        '<R><Story_Identifier StoryId="1" Date="02 Jan 2012"><Headline>A &amp;amp; B</Headline><Story_text>T</Story_text><Source>S</Source>'
        '<Editor_Tags><Tag OrgID="5" Relevance="H"/></Editor_Tags></Story_Identifier>'
        '<Story_Identifier StoryId="2" Date="03 Jan 2012"><Headline></Headline><Story_text>U</Story_text></Story_Identifier></R>'
    )
    rows = {r["story_id"]: r for r in xml.read_stories(spark, str(tmp_path / "s.xml")).collect()}
    assert rows[1]["headline"] == "A & B" and str(rows[1]["date"]) == "2012-01-02" and rows[1]["tags"] == {5: "H"}
    assert rows[2]["headline"] == "None" and rows[2]["tags"] == {}
    (tmp_path / "c.xml").write_text("<L><Company><OrgID>5</OrgID><Full_Name>X Inc</Full_Name><Domicile>Y</Domicile></Company></L>")
    companies = xml.read_companies(spark, str(tmp_path / "c.xml"))
    tags = xml.story_tags(xml.read_stories(spark, str(tmp_path / "s.xml")))
    xml.write_tags(tags, companies, str(tmp_path / "out"))
    assert [tuple(r) for r in xml.read_tags(spark, str(tmp_path / "out")).collect()] == [(1, 5, "X Inc", "H")]
    xml.one_document(tags, companies, str(tmp_path / "one.xml"), "Test")
    assert "<Dataset>Test</Dataset>" in (tmp_path / "one.xml").read_text()


def test_lists(spark, tmp_path):
    from spindrel.sources import tables

    (tmp_path / "l.txt").write_text("#c\n\nfirst\nsecond\n")
    assert [r[0] for r in tables.read_list(spark, str(tmp_path / "l.txt")).collect()] == ["first", "second"]
    assert tables.read_list(spark, str(tmp_path / "none.txt"), missing_ok=True).count() == 0
    with pytest.raises(ValueError):
        tables.from_df(spark.range(1))
