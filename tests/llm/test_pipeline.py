"""The pipeline and the registered queries, against plain Python."""

import glob

import __spark_entry__
import corpus_pipeline
import duckdb
import pytest
from spindrel.llm import toxicity
from spindrel.llm.common import shared_dir
from spindrel.llm.queries import ORACLE, QUERIES


def test_stages(spark, sf, tmp_path):
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: [r[0] for r in df.select("doc_id").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        kept = ids(out)
        assert len(kept) == len(set(kept)) and set(kept) <= set(ids(docs))
        if name == "toxicity":
            machine = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            scored = toxicity.score(docs.select("doc_id", "text"), machine)
            assert set(kept) == set(ids(scored.where("predicted = 0")))
        elif name == "exact_dedup":
            squeeze = lambda r: "".join(c for c in r["text"] or "" if c not in " \t\n\x0b\x0c\r")
            best = {}
            for r in docs.collect():
                k = squeeze(r)
                best[k] = min(best.get(k, (0, 1 << 60)), (-len(r["text"] or ""), r["doc_id"]))
            assert set(kept) == {i for _, i in best.values()}
        if name == "bpe":
            assert set(kept) == set(ids(docs)) and {"n_tokens", "ids", "ids_sha256"} <= set(out.columns)
        else:
            assert out.columns == first.columns
        docs = out
    root = shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{root}/spindrel/*/*"))
    assert sorted(ids(corpus_pipeline.run(spark, sf))) == sorted(ids(docs))
    assert len(set(glob.glob(f"{root}/spindrel/*/*")) - before) == 1  # the result alone is left


def test_registered():
    names = {n.split("_")[0] for n in QUERIES}
    assert names == {f"op{i}" for i in range(1, 11)} and "pipeline" in __spark_entry__.queries()
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, got[cols].astype(str).to_numpy())) == sorted(map(tuple, want[cols].astype(str).to_numpy()))
