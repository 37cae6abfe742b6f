import re

import duckdb
import pytest

from spindrel.plans.oracle import ORACLE
from spindrel.plans.queries import QUERIES

TABLES = "documents labels pages".split()
NO_SQL = {"multi_replace", "multi_annotate", "model_predictions"}
FEW = [
    "doc_sentences", "kb_whitelist", "mentions", "candidates_cascade", "mention_features", "doc_features", "mention_doc_features", "mc_features_only",
    "mc_tfidf", "train_data", "f1_by_story", "f1_of_corpus", "mention_json", "mention_html", "stories_xml", "companies_xml", "list_lines",
    "surface_forms_json", "gazetteer_parquet",
]


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLE) == NO_SQL and not set(ORACLE) - set(QUERIES)


@pytest.mark.parametrize("name", FEW)
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    show = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    rows = lambda df: sorted(tuple(map(show, r)) for r in df[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name,shown", [("multi_replace", " {1} "), ("multi_annotate", " {0} {1} ")])
def test_patterns_over_whole_texts(spark, sf, name, shown):
    def plain(text):
        out, at = "", 0
        for m in re.finditer("([0-9]+)|([*#]+)|([A-Z]{3,})", text):
            kind = "NUMBER" if m[1] else "UPPER" if m[3] else ""
            out += text[at : m.start()] + (shown.format(m[0], kind) if kind else "")
            at = m.end()
        return out + text[at:]

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r["doc_id"], plain(r["text"] or "")) for r in docs)
    assert any("\n" in t for _, t in want)
    assert sorted(map(tuple, QUERIES[name](spark, sf).select("story_id", "text").collect())) == want
