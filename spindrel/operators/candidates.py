"""Candidate companies of mentions, and their truth in story tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .kb import KnowledgeBase
from .mentions import extract_mentions

#: Candidates of the token route that are looked at, and the share of the best weight they must exceed.
TOP, SHARE = 3, 0.80
#: Weights are rounded to nine places; a bound must leave more than that.
_SLACK = 1e-8


def _direct(kb: KnowledgeBase) -> list[tuple[str, DataFrame, str, bool, float]]:
    """(route, index, its key, whether the text is lower-cased, weight), in the order of the cascade."""
    return [
        ("exact", kb.full_names, "key", True, 10.0),
        ("stripped", kb.stripped, "key", True, 2.0),
        ("surface", kb.surface, "form", False, 1.0),
        ("initials", kb.initials, "key", False, 1.0),
        ("ticker", kb.tickers, "ticker", False, 1.0),
    ]


def routes(texts: DataFrame, kb: KnowledgeBase) -> dict[str, DataFrame]:
    """(text, coid, weight) of each route over distinct ``texts`` (text), whether or not an earlier one hits."""

    def match(index: DataFrame, key: str, lower: bool, weight: float) -> DataFrame:
        keyed = index.select(F.col(key).alias("__k"), F.col("id").alias("coid"))
        value = F.lower("text") if lower else F.col("text")
        return texts.join(keyed, value == F.col("__k")).select("text", "coid", F.lit(weight).alias("weight"))

    found = {name: match(*rest) for name, *rest in _direct(kb)}
    return found | {"token": token_route(texts, kb.ltoken_coid)}


def token_route(texts: DataFrame, ltoken_coid: DataFrame) -> DataFrame:
    """Each word of a text gives 1 / n to each of the n companies that have it; the best few are kept.

    Some company has the word that gives most, so the best weight is at least
    that.  The commonest words whose gifts together stay within SHARE of it
    can't make a candidate of a company that has no other word of the text:
    they meet only companies that another word has found, not all that have
    them ("inc").
    """
    counts = ltoken_coid.groupBy("ltok").agg(F.count("*").alias("n"))
    words = texts.select("text", F.explode(X.normalized(F.col("text"), fix=False)).alias("word")).groupBy("text", "word").agg(F.count("*").alias("m"))
    given = words.join(counts, F.col("word") == F.col("ltok")).select("text", "word", "n", (F.col("m") / F.col("n")).alias("w"))
    common = Window.partitionBy("text").orderBy(F.desc("n"), "word")
    given = given.withColumns({"below": F.sum("w").over(common), "most": F.max("w").over(Window.partitionBy("text"))})
    given = given.withColumn("late", F.col("below") <= SHARE * F.col("most") - _SLACK).select("text", "word", "w", "late")
    index = ltoken_coid.select("ltok", "coid")
    early = given.where(~F.col("late")).join(index, F.col("word") == F.col("ltok")).select("text", "coid", "w")
    found = early.select("text", F.col("coid").alias("__c")).distinct().join(given.where("late"), "text")
    late = found.join(index, (F.col("word") == F.col("ltok")) & (F.col("__c") == F.col("coid"))).select("text", "coid", "w")
    sums = early.unionByName(late).groupBy("text", "coid").agg(F.round(F.sum("w"), 9).alias("weight"))
    best = Window.partitionBy("text").orderBy(F.desc("weight"), "coid")
    ranked = sums.withColumns({"rank": F.row_number().over(best), "most": F.max("weight").over(Window.partitionBy("text"))})
    return ranked.where((F.col("rank") <= TOP) & (F.col("weight") > SHARE * F.col("most"))).select("text", "coid", "weight")


def cascade(texts: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """(text, coid, weight, route): the rows of the first route that hits, for each distinct text.

    Texts look their key up in each index once; only those that no index knows
    go on to the words.
    """
    found, hits = texts.select("text").distinct(), []
    for name, index, key, lower, weight in _direct(kb):
        ids = index.groupBy(F.col(key).alias("__k")).agg(F.collect_list("id").alias(f"__{name}"))
        value = F.lower("text") if lower else F.col("text")
        found = found.join(ids, value == F.col("__k"), "left").drop("__k")
        hits.append(F.when(F.col(f"__{name}").isNotNull(), F.struct(F.col(f"__{name}").alias("ids"), F.lit(weight).alias("weight"), F.lit(name).alias("route"))))
    found = found.select("text", F.coalesce(*hits).alias("hit"))
    direct = found.where("hit is not null").select("text", F.explode("hit.ids").alias("coid"), "hit.weight", "hit.route")
    rest = token_route(found.where("hit is null").select("text"), kb.ltoken_coid)
    return direct.unionByName(rest.withColumn("route", F.lit("token")))


def generate_candidates(mentions: DataFrame, kb: KnowledgeBase, with_map: bool = False) -> DataFrame:
    """``mentions`` with candidate, candidate_weight and candidate_name, a row for each candidate.

    The cascade runs over distinct texts and is joined back; mentions without
    a candidate go.  ``with_map`` adds all candidates of the mention as a map.
    """
    found = cascade(mentions, kb).select(F.col("text").alias("__t"), "coid", "weight")
    if with_map:
        maps = found.groupBy("__t").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("coid", "weight")))).alias("candidates"))
        found = found.join(maps, "__t")
    named = found.join(kb.company.select(F.col("id").alias("coid"), F.col("name").alias("candidate_name")), "coid")
    named = named.withColumnsRenamed({"coid": "candidate", "weight": "candidate_weight"})
    return mentions.join(named, F.col("text") == F.col("__t")).drop("__t")


def token_candidates(mentions: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """(text, coid, token): companies by each word of a mention, in the older way that compares lower case with names as written."""
    words = mentions.select("text").distinct().select("text", F.explode(X.normalized(F.col("text"))).alias("token"))
    return words.join(kb.token_coid, "token").select("text", "coid", "token").distinct()


def relevance(candidates: DataFrame, story_tags: DataFrame) -> DataFrame:
    """``candidates`` with ``relevance``: that of the story's tag, or NO."""
    tags = story_tags.select(F.col("story_id").alias("__s"), F.col("coid").alias("__c"), F.col("relevance").alias("__r"))
    joined = candidates.join(tags, (F.col("story_id") == F.col("__s")) & (F.col("candidate") == F.col("__c")), "left")
    return joined.withColumn("relevance", F.coalesce("__r", F.lit("NO"))).drop("__s", "__c", "__r")


def tagged(candidates: DataFrame, story_tags: DataFrame) -> DataFrame:
    """``candidates`` with is_tagged: whether the story has the tag."""
    return relevance(candidates, story_tags.withColumn("relevance", F.lit("x"))).withColumn("is_tagged", F.col("relevance") == "x").drop("relevance")


def tagged_mentions(mentions: DataFrame, kb: KnowledgeBase, story_tags: DataFrame) -> DataFrame:
    """``mentions`` with is_tagged: whether any candidate is a tag of the story (false without one)."""
    hits = cascade(mentions, kb).select(F.col("text").alias("__t"), "coid")
    pairs = mentions.select("story_id", "text").distinct().join(hits, F.col("text") == F.col("__t"))
    good = pairs.join(story_tags.select("story_id", "coid"), ["story_id", "coid"], "left_semi").select("story_id", "text").distinct()
    return mentions.join(good.withColumn("__y", F.lit(True)), ["story_id", "text"], "left").withColumn("is_tagged", F.coalesce("__y", F.lit(False))).drop("__y")


def train_data(stories: DataFrame, kb: KnowledgeBase, story_tags: DataFrame, target: str = "y", **options) -> DataFrame:
    """Mentions of ``stories`` with a truth column."""
    return tagged_mentions(extract_mentions(stories, kb, **options), kb, story_tags).withColumnRenamed("is_tagged", target)
