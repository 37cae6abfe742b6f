"""Features of mentions, documents and mention-candidates.

Each family is a registry from a name to a column over the joined row; adding a
feature is adding an entry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrow import jaro, jaro_winkler
from .aggregates import share_of_candidate, share_of_text, token_freqs
from .kb import KnowledgeBase

Registry = dict[str, Callable[[], Column]]


def _near(a: str, b: str) -> Column:
    return F.concat(F.col(a), F.col(b))


#: The words and patterns that flags look for.
MENTION: Registry = {
    "mention_is_ticker": lambda: F.col("__ticker"),
    "mention_is_one_word": lambda: F.col("token_cnt") == 1,
    "mention_character_length": lambda: F.length("text"),
    "mention_follows_copyright": lambda: F.rlike(_near("previous_word", "previous_word2"), F.lit("^©[ \t\n\f\r]?[1|2][0-9]{3}")),
    "mention_prev_is_about": lambda: F.col("previous_word") == "About",
    "mention_prev2_is_SYMBOL": lambda: F.col("previous_word2") == "SYMBOL",
    "mention_prev2_is_ISSUER": lambda: F.col("previous_word2") == "ISSUER",
    "mention_followed_by_8K": lambda: (F.col("paragraph") == 0) & F.contains(_near("next_word", "next_word2"), F.lit("8-K")),
    "mention_followed_by_logo": lambda: F.contains(_near("next_word", "next_word2"), F.lit("logo")),
    "mention_followed_by_orthe": lambda: _near("next_word", "next_word2") == "orthe",
    "mention_token_score": lambda: F.col("__score"),
    "mention_is_exact_match": lambda: F.col("__exact"),
    "mention_is_lowercase_match": lambda: F.col("__lower"),
    "mention_is_surface_form": lambda: F.col("__surface"),
    "mention_is_token_match": lambda: F.col("__tokens"),
}

#: The words and patterns of document features.
DOCUMENT: Registry = {
    "doc_character_length": lambda: F.length("text"),
    "doc_number_count": lambda: F.size(F.regexp_extract_all("text", F.lit(r"[0-9]+[.|,][0-9]+"), F.lit(0))),
    "doc_number_ratio": lambda: F.try_divide(DOCUMENT["doc_number_count"](), F.col("doc_token_cnt")),
    "doc_contains_form4": lambda: F.contains("text", F.lit("Form 4")),
    "doc_DJ_headline": lambda: F.when(
        F.startswith("headline", F.lit("DJ")) & ~F.contains("text", F.lit("Form 4")) & ~F.contains("headline", F.lit("8-K")), 0
    ).otherwise(1),
    "doc_source": lambda: F.col("source"),
}


def story_token_freqs(stories: DataFrame) -> DataFrame:
    """(token, freq) of the lower-cased tokens of story texts, over the commonest."""
    return token_freqs(stories.select(F.explode(X.word_tokens(F.coalesce("text", F.lit("")))).alias("t")).select(F.lower("t").alias("token")))


def mention_features(mentions: DataFrame, kb: KnowledgeBase, stories: DataFrame) -> DataFrame:
    """``mentions`` with the MENTION features and mention_count.

    What depends on the text alone is found once for each distinct text and
    joined back.  A text without words has a null token score.
    """
    texts = mentions.select("text").distinct()

    def flag(rows: DataFrame, name: str, value: Column, index: Column, table: DataFrame) -> DataFrame:
        keys = table.select(index.alias("__k")).distinct().withColumn(name, F.lit(True))
        joined = rows.join(keys, value == F.col("__k"), "left").drop("__k")
        return joined.withColumn(name, F.coalesce(name, F.lit(False)))

    text = F.col("text")
    flags = flag(texts, "__ticker", F.upper(text), F.col("ticker"), kb.tickers)
    flags = flag(flags, "__exact", text, F.col("name"), kb.company)
    flags = flag(flags, "__lower", F.lower(text), F.col("key"), kb.full_names)
    flags = flag(flags, "__surface", text, F.col("form"), kb.surface)
    flags = flag(flags, "__tokens", X.normalized(text), F.col("tokens"), kb.normalized_names)
    words = texts.select("text", F.explode(X.normalized(text)).alias("token"))
    in_names = kb.token_freq.select("token", F.col("freq").alias("kf"))
    wanted = words.select("token").distinct()
    in_stories = story_token_freqs(stories).join(wanted, "token", "left_semi").select("token", F.col("freq").alias("df"))
    scored = words.join(in_names, "token", "left").join(in_stories, "token", "left")
    score = scored.groupBy("text").agg(F.avg(F.coalesce("kf", F.lit(0.0)) / F.coalesce("df", F.lit(1.0))).alias("__score"))
    known = flags.join(score, "text", "left").withColumnRenamed("text", "__t")
    joined = mentions.join(known, F.col("text") == F.col("__t"))
    # Fields of the mention stay where a feature has the same name.
    new = {n: c() for n, c in MENTION.items() if n not in mentions.columns}
    return share_of_text(joined.withColumns(new).select(*mentions.columns, *new))


def text_countries(texts: DataFrame, gazetteer: DataFrame, key: str = "story_id", text: str = "text") -> DataFrame:
    """(key, code, share): countries by capitalised phrases, names before cities; no row without a hit.

    Phrases are counted for each key before the lookup, so a word that fills a
    story crosses the shuffle once.
    """
    phrases = texts.select(key, F.explode(X.capital_phrases(F.col(text))).alias("p")).groupBy(key, F.lower("p").alias("p"))
    counts = phrases.agg(F.count("*").alias("n"))
    of = lambda kind: gazetteer.where(F.col("kind") == kind).select(F.col("key").alias(f"{kind}_key"), F.col("code").alias(f"{kind}_code"))
    found = counts.join(of("name"), F.col("p") == F.col("name_key"), "left").join(of("city"), F.col("p") == F.col("city_key"), "left")
    coded = found.select(key, F.coalesce("name_code", "city_code").alias("code"), "n").where("code is not null")
    sums = coded.groupBy(key, "code").agg(F.sum("n").alias("n"))
    return sums.select(key, "code", (F.col("n") / F.sum("n").over(Window.partitionBy(key))).alias("share"))


def document_features(stories: DataFrame) -> DataFrame:
    """(story_id, doc_token_cnt, the DOCUMENT features), a row for each story."""
    texts = stories.withColumns({c: F.coalesce(c, F.lit("")) for c in ("headline", "text")})
    count = F.size(X.normalized(F.concat("headline", "text"), fix=False))
    counted = texts.withColumn("doc_token_cnt", count)
    return counted.select("story_id", "doc_token_cnt", *[c().alias(n) for n, c in DOCUMENT.items()])


def document_countries(stories: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Countries of each story's text, which is read twice in a row."""
    twice = stories.select("story_id", F.concat(F.coalesce("text", F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))
    return text_countries(twice, gazetteer)


def add_document_features(mentions: DataFrame, stories: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``mentions`` with document features and doc_countries (a map); found once for each story that has a mention."""
    used = stories.join(mentions.select("story_id").distinct(), "story_id", "left_semi")
    shares = document_countries(used, gazetteer).groupBy("story_id")
    maps = shares.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "share")))).alias("doc_countries"))
    per_story = document_features(used).join(maps, "story_id", "left")
    empty = F.from_json(F.lit("{}"), "map<string,double>")
    return mentions.join(per_story.withColumn("doc_countries", F.coalesce("doc_countries", empty)), "story_id")


def candidate_features(rows: DataFrame, kb: KnowledgeBase, gazetteer: DataFrame, countries: DataFrame, append: bool = True) -> DataFrame:
    """Mention-candidates with mc_country, mc_jaro_distance, mc_is_exact_match, mc_is_close_match and mc_count.

    ``countries``: (story_id, code, share).  mc_country is null without a
    domicile, else the share of its country in the story or 0.  Similarities
    are computed once for each distinct pair.  Without ``append`` only keys and
    features are returned.
    """
    names = gazetteer.where(F.col("kind") == "name").select(F.col("key").alias("__k"), F.col("code").alias("__code"))
    company = kb.company.join(names, F.lower("domicile") == F.col("__k"), "left").select(
        F.col("id").alias("__id"), "domicile", F.col("stripped").alias("__stripped"), "__code"
    )
    base = rows.join(company, F.col("candidate") == F.col("__id"))
    pairs = base.select("text", "candidate_name", "__stripped").distinct()
    pairs = pairs.withColumns(
        {
            "mc_jaro_distance": jaro(F.lower("text"), F.lower("candidate_name")),
            "__jw": jaro_winkler(F.col("text"), F.col("__stripped")),
        }
    ).select(F.col("text").alias("__t"), F.col("candidate_name").alias("__n"), F.col("__stripped").alias("__s"), "mc_jaro_distance", "__jw")
    base = base.join(pairs, (F.col("text") == F.col("__t")) & (F.col("candidate_name") == F.col("__n")) & (F.col("__stripped") == F.col("__s")))
    share = countries.select(F.col("story_id").alias("__story"), F.col("code").alias("__c"), F.col("share").alias("__share"))
    base = base.join(share, (F.col("story_id") == F.col("__story")) & (F.col("__code") == F.col("__c")), "left")
    new = {
        "mc_country": F.when(F.col("domicile").isNull(), None).otherwise(F.coalesce("__share", F.lit(0.0))),
        "mc_jaro_distance": F.col("mc_jaro_distance"),
        "mc_is_exact_match": F.lower("text") == F.lower("candidate_name"),
        "mc_is_close_match": F.col("__jw") > 0.95,
    }
    keys = rows.columns if append else ["story_id", "text", "candidate"]
    return share_of_candidate(base.withColumns(new).select(*keys, *new))


def optional_candidate_features(rows: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """Features that are not part of the default set: shared words, Jaro-Winkler, edit distance, surface form."""
    a, b = X.normalized(F.col("text")), X.normalized(F.col("candidate_name"))
    forms = kb.surface.select(F.col("form").alias("__f"), F.col("id").alias("__i"), F.lit(True).alias("__yes"))
    joined = rows.join(forms, (F.col("text") == F.col("__f")) & (F.col("candidate") == F.col("__i")), "left")
    return joined.withColumns(
        {
            "mc_common_tokens": F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(b))),
            "mc_jaro_winkler": jaro_winkler(F.col("text"), F.col("candidate_name")),
            "mc_levenshtein_distance": F.levenshtein("text", "candidate_name"),
            "mc_is_surfaceform": F.coalesce("__yes", F.lit(False)),
        }
    ).drop("__f", "__i", "__yes")


#: The words that TF-IDF counts.
TERM = r"[\p{L}\p{M}\p{N}_]{2,}"


def _weights(texts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, term, w): TF-IDF weights of each of the distinct ``texts`` over their length as a vector."""
    terms = texts.select(key, F.explode(F.regexp_extract_all(F.lower(key), F.lit(TERM), F.lit(0))).alias("term"))
    counts = terms.groupBy(key, "term").agg(F.count("*").alias("tf")).join(idf, "term")
    raw = counts.withColumn("v", F.col("tf") * F.col("idf"))
    return raw.select(key, "term", (F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))).alias("w"))


def tfidf_features(rows: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """Mention-candidates with mc_tfidf and mc_tfidf_share, which are not part of the default set.

    mc_tfidf: cosine of the TF-IDF weights of text and company name, with
    ln((1 + n) / (1 + df)) + 1 over all company names; words that no name has
    count for nothing.  mc_tfidf_share: that over its sum for the text in the
    story, 0 if the sum is.  Weights are found once for each distinct text and
    name, and only pairs that occur are compared.
    """
    names = kb.company.select("name")
    terms = names.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(TERM), F.lit(0)))).alias("term"))
    n = names.agg(F.count("*")).scalar()
    idf = terms.groupBy("term").agg(F.count("*").alias("df")).select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    pairs = rows.select("text", "candidate_name").distinct()
    left = _weights(pairs.select("text").distinct(), idf, "text")
    right = _weights(pairs.select("candidate_name").distinct(), idf, "candidate_name").withColumnRenamed("w", "w2")
    dots = pairs.join(left, "text").join(right, ["candidate_name", "term"])
    dots = dots.groupBy("text", "candidate_name").agg(F.sum(F.col("w") * F.col("w2")).alias("mc_tfidf"))
    joined = rows.join(dots, ["text", "candidate_name"], "left").withColumn("mc_tfidf", F.coalesce("mc_tfidf", F.lit(0.0)))
    total = F.sum("mc_tfidf").over(Window.partitionBy("story_id", "text"))
    share = F.when(total != 0, F.col("mc_tfidf") / total).otherwise(F.lit(0.0))
    return joined.select(*rows.columns, "mc_tfidf", share.alias("mc_tfidf_share"))


def tag_frequencies(story_tags: DataFrame, stories: DataFrame, first: int | None = 100, order: str = "story_id") -> DataFrame:
    """(candidate, tagged_cnt) over the ``first`` stories in order; None: over all."""
    kept = story_tags
    if first is not None:
        kept = story_tags.join(stories.select("story_id", F.col(order).alias("__o")).orderBy("__o").limit(first).select("story_id"), "story_id", "left_semi")
    return kept.groupBy(F.col("coid").alias("candidate")).agg(F.count("*").alias("tagged_cnt"))


def add_tag_frequency(rows: DataFrame, freqs: DataFrame) -> DataFrame:
    """``rows`` with tagged_cnt, 0 for candidates without a tag."""
    named = freqs.select(F.col("candidate").alias("__c"), F.col("tagged_cnt"))
    return rows.join(named, F.col("candidate") == F.col("__c"), "left").withColumn("tagged_cnt", F.coalesce("tagged_cnt", F.lit(0))).drop("__c")
