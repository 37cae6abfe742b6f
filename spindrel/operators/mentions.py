"""Mentions: runs of knowledge-base tokens in sentences.

Each token carries its neighbours out of the sentence's array, so the join with
the knowledge base needs no window.  Only the few tokens that pass it are
shuffled, by sentence, to find runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .kb import KnowledgeBase

#: Leading words whose characters are stripped from a mention, in this order.
LEADING = ("ON ", "If ", "And ", "Of ", "On ")
FIELDS = (
    "text", "previous_word2", "previous_word", "next_word", "next_word2", "pos_in_sentence", "paragraph", "sentence",
    "token_cnt", "story_id",
)


def paragraphs(stories: DataFrame, separator: str = "\n") -> DataFrame:
    """(story_id, par_idx, par_count, paragraph); the headline is paragraph 0."""
    parts = X.paragraphs(F.coalesce("headline", F.lit("")), F.coalesce("text", F.lit("")), separator)
    return stories.select("story_id", parts.alias("p")).select(
        "story_id", F.size("p").alias("par_count"), F.posexplode("p").alias("par_idx", "paragraph")
    )


def sentences(pars: DataFrame) -> DataFrame:
    """(story_id, par_idx, par_count, sent_idx, sent_count, sentence)."""
    parts = pars.withColumn("s", X.sentences(F.col("paragraph")))
    return parts.select(
        "story_id", "par_idx", "par_count", F.size("s").alias("sent_count"), F.posexplode("s").alias("sent_idx", "sentence")
    )


def sentence_mentions(rows: DataFrame, ltoken: DataFrame, whitelist: DataFrame, blacklist: DataFrame | None = None) -> DataFrame:
    """The mentions of ``rows`` (story_id, par_idx, sent_idx, paragraph, sentence, tokens).

    A token counts if its lower case is in ``ltoken`` and it starts with a
    capital or stands between two words as ``whitelist`` has it.  Neighbours
    beyond the sentence are NONE, which is never a token of a mention.
    """
    at = lambda i: F.coalesce(F.get("tokens", i), F.lit(X.PADDING))
    around = F.transform(
        "tokens",
        lambda t, i: F.struct(
            i.alias("i"), t.alias("token"), F.when(i > 1, at(i - 2)).otherwise(X.PADDING).alias("prev2"),
            F.when(i > 0, at(i - 1)).otherwise(X.PADDING).alias("prev"), at(i + 1).alias("next"), at(i + 2).alias("next2"),
        ),
    )
    key = ["story_id", "par_idx", "sent_idx"]
    each = rows.select(*key, "paragraph", "sentence", F.size("tokens").alias("len"), F.inline(around))
    known = each.join(ltoken.select("ltok"), F.lower("token") == F.col("ltok"), "left_semi")
    white = whitelist.select(F.col("token").alias("wt"), F.col("prev").alias("wp"), F.col("next").alias("wn"), F.lit(True).alias("listed"))
    flagged = known.join(white, (F.col("token") == F.col("wt")) & (F.col("prev") == F.col("wp")) & (F.col("next") == F.col("wn")), "left")
    flagged = flagged.where(X.starts_upper(F.col("token")) | F.col("listed")).drop("wt", "wp", "wn", "listed")
    run = F.col("i") - F.row_number().over(Window.partitionBy(*key).orderBy("i"))
    runs = flagged.withColumn("run", run).groupBy(*key, "run").agg(
        F.min("i").alias("start"),
        F.count("*").alias("token_cnt"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]), " ").alias("text"),
        F.min_by("prev2", "i").alias("previous_word2"),
        F.min_by("prev", "i").alias("previous_word"),
        F.max_by("next", "i").alias("next_word"),
        F.max_by("next2", "i").alias("next_word2"),
        F.first("paragraph").alias("paragraph"),
        F.first("sentence").alias("sentence"),
        F.first("len").alias("len"),
    )
    found = runs.withColumn(
        "pos_in_sentence",
        F.when(F.col("len") > F.col("token_cnt"), F.col("start") / (F.col("len") - F.col("token_cnt"))).otherwise(F.col("start").cast("double")),
    )
    for word in LEADING:
        stripped = F.expr(f"trim(LEADING '{word}' FROM text)")
        found = found.withColumn("text", F.when(F.startswith("text", F.lit(word)), stripped).otherwise(F.col("text")))
    if blacklist is not None:
        found = found.join(blacklist.select(F.col("text").alias("__black")), F.lower("text") == F.col("__black"), "left_anti")
    return found.select(*FIELDS, "par_idx", "sent_idx", F.col("start").cast("int").alias("tok_idx"))


def tokenized(stories: DataFrame, disclaimers: list[str] | None = None, separator: str = "\n") -> DataFrame:
    """Sentences of stories with tokens and positions from 0 to 1.

    Paragraphs that are disclaimers go, after they were counted.
    """
    pars = paragraphs(stories, separator)
    if disclaimers:
        pars = pars.where(~X.is_disclaimer(F.col("paragraph"), disclaimers))
    share = lambda i, n: F.when(F.col(n) > 1, F.col(i) / (F.col(n) - 1)).otherwise(F.col(i).cast("double"))
    return sentences(pars).select(
        "story_id", "par_idx", "sent_idx", share("par_idx", "par_count").alias("paragraph"),
        share("sent_idx", "sent_count").alias("sentence"), X.word_tokens(F.col("sentence")).alias("tokens"),
    )


def extract_mentions(
    stories: DataFrame, kb: KnowledgeBase, disclaimers: list[str] | None = None, blacklist: DataFrame | None = None, separator: str = "\n"
) -> DataFrame:
    """All mentions of ``stories`` (story_id, headline, text): FIELDS and par_idx, sent_idx, tok_idx."""
    return sentence_mentions(tokenized(stories, disclaimers, separator), kb.ltoken, kb.whitelist, blacklist)
