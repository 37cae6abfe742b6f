"""Stories, companies and tags derived from the ``documents`` and ``labels`` tables.

The commonest capitalised words become companies, aliases, tickers, places and
the blacklist, by their rank.  Their number is fixed, so the knowledge base is
small at every size of the documents.
"""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.candidates import generate_candidates
from ..operators.kb import KnowledgeBase, build_kb, load_kb, store_kb
from ..operators.mentions import extract_mentions
from ..session import ship
from ..sources.scratch import folder

#: Ranks of words by what they become (both ends included), and the number of three-word names.
RANKS = {"company": (1, 300), "surface": (301, 360), "ticker": (361, 390), "name": (391, 415), "city": (416, 440)}
PHRASES, BLACK = 20, (7, 8)
WORD, PHRASE = "[A-Z][a-z]{4,}", "[A-Z][a-z]{4,} [a-z]{2,} [a-z]{2,}"
DISCLAIMERS = ["All rights", "Licensed", "This work"]

_stored: dict[tuple[str, str, bool], str] = {}
_written: dict[tuple[str, str, str], str] = {}
_words: dict[tuple[str, str], tuple[list[str], list[str]]] = {}


class Demo:
    """The derived tables over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _top(self, pattern: str, n: int) -> list[str]:
        """The ``n`` commonest matches that at least two documents have."""
        each = F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        counts = self.table("documents").select(F.explode(each).alias("w")).groupBy("w").count().where("count >= 2")
        return [r["w"] for r in counts.orderBy(F.desc("count"), "w").limit(n).collect()]

    @cached_property
    def words(self) -> tuple[list[str], list[str]]:
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _words:
            _words[key] = self._top(WORD, RANKS["city"][1]), self._top(PHRASE, PHRASES)
        return _words[key]

    def _rows(self, rows: list[dict], schema: str) -> DataFrame:
        data = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
        return self.spark.range(1).select(F.inline(data))

    def _ranked(self, kind: str) -> list[tuple[int, str]]:
        low, high = RANKS[kind]
        return [(i, w) for i, w in enumerate(self.words[0], 1) if low <= i <= high]

    @cached_property
    def companies(self) -> DataFrame:
        places = dict(enumerate(w for _, w in self._ranked("name")))
        form = ("{}", "{} Inc", "{} Holdings", "{} & Co")
        named = [(i, form[i % 4].format(w)) for i, w in self._ranked("company")]
        named += [(1000 + i, p) for i, p in enumerate(self.words[1], 1)]
        rows = [{"id": i, "name": n, "domicile": places.get(i % 25), "ord": i} for i, n in named]
        return self._rows(rows, "id: long, name: string, domicile: string, ord: long")

    @cached_property
    def surface_forms(self) -> DataFrame:
        return self._rows([{"id": (i - 300) * 4, "form": w} for i, w in self._ranked("surface")], "id: long, form: string")

    @cached_property
    def tickers(self) -> DataFrame:
        return self._rows([{"id": (i - 360) * 7, "ticker": w} for i, w in self._ranked("ticker")], "id: long, ticker: string")

    @cached_property
    def gazetteer(self) -> DataFrame:
        rows = [{"kind": k, "key": w.lower(), "code": f"C{i - RANKS[k][0]}"} for k in ("name", "city") for i, w in self._ranked(k)]
        return self._rows(rows, "kind: string, key: string, code: string")

    @cached_property
    def blacklist(self) -> DataFrame:
        return self._rows([{"text": w.lower()} for i, w in self._ranked("company") if i in BLACK], "text: string")

    @cached_property
    def stories(self) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        head = F.substring_index(text, "\n", 1)
        return self.table("documents").select(
            F.col("doc_id").alias("story_id"), head.alias("headline"),
            F.substring(text, F.length(head) + 2, F.length(text)).alias("text"), "source",
        )

    @cached_property
    def story_tags(self) -> DataFrame:
        each = F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
        words = self._rows([{"coid": i, "w": w} for i, w in self._ranked("company")], "coid: long, w: string")
        labels = self.table("labels").where("quality = 1").select("doc_id", F.when(F.col("toxic") == 0, "H").otherwise("L").alias("relevance"))
        found = self.table("documents").join(labels, "doc_id").select(F.col("doc_id").alias("story_id"), "relevance", F.explode(each).alias("w"))
        return found.join(words, "w").select("story_id", "coid", "relevance")

    def _kb(self, plain: bool) -> KnowledgeBase:
        """Built and stored once for each session and folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, plain)
        if key not in _stored:
            built = build_kb(self.companies) if plain else build_kb(self.companies, self.surface_forms, self.tickers)
            path = folder(self.spark, "kb")
            store_kb(built, path)
            _stored[key] = path
        return load_kb(self.spark, _stored[key])

    @cached_property
    def kb(self) -> KnowledgeBase:
        return self._kb(plain=False)

    @cached_property
    def plain_kb(self) -> KnowledgeBase:
        return self._kb(plain=True)

    def _once(self, name: str, make) -> DataFrame:
        """A table that many plans read, written once for each session and folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _written:
            path = folder(self.spark, name)
            make().write.parquet(path)
            _written[key] = path
        return self.spark.read.parquet(_written[key])

    def mentions(self, plain: bool = False) -> DataFrame:
        kb = self.plain_kb if plain else self.kb
        return self._once(f"mentions-{plain}", lambda: extract_mentions(self.stories, kb, DISCLAIMERS, self.blacklist))

    def candidates(self) -> DataFrame:
        return self._once("candidates", lambda: generate_candidates(self.mentions(), self.kb))
