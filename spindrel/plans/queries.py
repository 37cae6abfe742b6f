"""The registered queries: one for each operator or family of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrow as A
from ..functions import text as X
from ..operators import aggregates as G
from ..operators import candidates as C
from ..operators import features as P
from ..operators import mentions as M
from ..operators import ml
from ..sources.scratch import folder
from .demo import DISCLAIMERS, Demo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as long, doubles rounded to nine places, arrays as text."""

    def col(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 9)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), " ")
        return c.alias(f.name)

    return df.select(*[col(f) for f in df.schema])


def query(f: Callable[[Demo], DataFrame]) -> Callable[[Demo], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(Demo(spark, sf_dir)))
    return f


# Text


@query
def doc_paragraphs(d: Demo) -> DataFrame:
    return M.paragraphs(d.stories)


@query
def doc_sentences(d: Demo) -> DataFrame:
    return M.sentences(M.paragraphs(d.stories))


@query
def disclaimer_paragraphs(d: Demo) -> DataFrame:
    return M.paragraphs(d.stories).where(X.is_disclaimer(F.col("paragraph"), DISCLAIMERS)).select("story_id", "par_idx", "paragraph")


@query
def normalized_tokens(d: Demo) -> DataFrame:
    return d.stories.select("story_id", X.normalized(F.col("text")).alias("tokens"))


@query
def token_windows(d: Demo) -> DataFrame:
    names = d.companies.select("id", X.windows(X.word_tokens(F.col("name")), 5).alias("w"))
    return names.select("id", F.posexplode("w").alias("pos", "w")).select("id", "pos", F.array_join("w", "|").alias("around"))


@query
def token_freqs(d: Demo) -> DataFrame:
    return P.story_token_freqs(d.stories)


@query
def token_frequencies(d: Demo) -> DataFrame:
    return G.story_token_frequencies(M.tokenized(d.stories))


@query
def fixed_text(d: Demo) -> DataFrame:
    return d.table("pages").select("page_id", X.fix_text(F.col("html")).alias("fixed"))


@query
def strip_common(d: Demo) -> DataFrame:
    return d.companies.select("id", X.strip_common(F.col("name")).alias("stripped"))


@query
def initials(d: Demo) -> DataFrame:
    return d.companies.select("id", X.initials(F.col("name")).alias("initials"))


def _whole(d: Demo) -> DataFrame:
    """Whole texts: headline and body as they stand."""
    return d.table("documents").select(F.col("doc_id").alias("story_id"), F.coalesce("text", F.lit("")).alias("text"))


@query
def multi_replace(d: Demo) -> DataFrame:
    return _whole(d).select("story_id", A.multi_replace(PATTERNS, F.col("text")).alias("text"))


@query
def multi_annotate(d: Demo) -> DataFrame:
    return _whole(d).select("story_id", A.multi_annotate(PATTERNS, F.col("text")).alias("text"))


PATTERNS = [r"(?P<NUMBER>[0-9]+)", r"(?P<EMPTY>[*#]+)", r"(?P<UPPER>[A-Z]{3,})"]


# Knowledge base


@query
def kb_name_tokens(d: Demo) -> DataFrame:
    return d.kb.name_token


@query
def kb_token_freq(d: Demo) -> DataFrame:
    return d.kb.token_freq


@query
def kb_token_coid(d: Demo) -> DataFrame:
    return d.kb.token_coid


@query
def kb_whitelist(d: Demo) -> DataFrame:
    return d.kb.whitelist


@query
def kb_full_names(d: Demo) -> DataFrame:
    return d.kb.full_names


@query
def kb_stripped(d: Demo) -> DataFrame:
    return d.kb.stripped


@query
def kb_initials(d: Demo) -> DataFrame:
    return d.kb.initials


@query
def kb_surface_forms(d: Demo) -> DataFrame:
    return d.kb.surface


@query
def kb_surface_inverted(d: Demo) -> DataFrame:
    return G.invert(d.kb.surface, "id", "form")


@query
def kb_vocabulary(d: Demo) -> DataFrame:
    return d.kb.ltoken


@query
def kb_ltoken_coid(d: Demo) -> DataFrame:
    return d.kb.ltoken_coid


# Mentions


@query
def mentions(d: Demo) -> DataFrame:
    return M.extract_mentions(d.stories, d.kb, DISCLAIMERS, d.blacklist)


@query
def mention_counts(d: Demo) -> DataFrame:
    return G.share_of_text(d.mentions()).select("story_id", "par_idx", "sent_idx", "tok_idx", "text", "mention_count")


@query
def mention_labels(d: Demo) -> DataFrame:
    return d.mentions().select("story_id", "par_idx", "sent_idx", "tok_idx", X.mention_label().alias("label"))


@query
def unique_mentions_per_word(d: Demo) -> DataFrame:
    return G.unique_mentions_per_word(d.mentions(), "previous_word")


# Candidates


def _route(name: str, plain: bool = False):
    def run(d: Demo) -> DataFrame:
        kb = d.plain_kb if plain else d.kb
        return C.routes(d.mentions(plain).select("text").distinct(), kb)[name]

    run.__name__ = f"candidates_{name}"
    query(run)


for _name in ("exact", "stripped", "surface", "ticker", "token"):
    _route(_name)
_route("initials", plain=True)


@query
def candidates_cascade(d: Demo) -> DataFrame:
    return C.cascade(d.mentions(), d.kb)


@query
def candidates_all(d: Demo) -> DataFrame:
    found = C.generate_candidates(d.mentions(), d.kb)
    return found.select("story_id", "par_idx", "sent_idx", "tok_idx", "text", "candidate", "candidate_weight", "candidate_name")


@query
def candidates_by_name_token(d: Demo) -> DataFrame:
    return C.token_candidates(d.mentions(), d.kb)


@query
def relevance_labels(d: Demo) -> DataFrame:
    return C.relevance(d.candidates(), d.story_tags).select("story_id", "par_idx", "sent_idx", "tok_idx", "candidate", "relevance")


@query
def is_tagged_candidate(d: Demo) -> DataFrame:
    return C.tagged(d.candidates(), d.story_tags).select("story_id", "par_idx", "sent_idx", "tok_idx", "candidate", "is_tagged")


@query
def is_tagged_mention(d: Demo) -> DataFrame:
    return C.tagged_mentions(d.mentions(), d.kb, d.story_tags).select("story_id", "par_idx", "sent_idx", "tok_idx", "text", "is_tagged")


@query
def train_data(d: Demo) -> DataFrame:
    found = C.train_data(d.stories, d.kb, d.story_tags, disclaimers=DISCLAIMERS, blacklist=d.blacklist)
    return found.select("story_id", "par_idx", "sent_idx", "tok_idx", "text", "y")


# Features


@query
def mention_doc_features(d: Demo) -> DataFrame:
    found = P.add_document_features(d.mentions(), d.stories, d.gazetteer)
    shares = F.transform(F.array_sort(F.map_entries("doc_countries")), lambda x: F.concat(x["key"], F.lit(":"), F.round(x["value"] * 1e9).cast("long")))
    names = ("doc_token_cnt", *P.DOCUMENT)
    return found.select("story_id", "par_idx", "sent_idx", "tok_idx", *names, shares.alias("doc_countries"))


@query
def mention_json(d: Demo) -> DataFrame:
    found = d.mentions().select("*", F.length("text").alias("mention_character_length"), (F.col("token_cnt") == 1).alias("mention_is_one_word"))
    shown = X.as_json("token_cnt", "mention_character_length", "mention_is_one_word")
    return found.select("story_id", "par_idx", "sent_idx", "tok_idx", shown.alias("shown"))


@query
def mention_html(d: Demo) -> DataFrame:
    shown = X.mention_html("text", "previous_word", "next_word", "token_cnt")
    return d.mentions().select("story_id", "par_idx", "sent_idx", "tok_idx", shown.alias("shown"))


@query
def mention_features(d: Demo) -> DataFrame:
    return P.mention_features(d.mentions(), d.kb, d.stories)


@query
def doc_features(d: Demo) -> DataFrame:
    return P.document_features(d.stories)


@query
def doc_countries(d: Demo) -> DataFrame:
    return P.document_countries(d.stories, d.gazetteer)


def _features(d: Demo) -> DataFrame:
    found = d.candidates()
    used = d.stories.join(found.select("story_id").distinct(), "story_id", "left_semi")
    return P.candidate_features(found, d.kb, d.gazetteer, P.document_countries(used, d.gazetteer))


KEYS = ("story_id", "par_idx", "sent_idx", "tok_idx", "candidate")


@query
def mc_features(d: Demo) -> DataFrame:
    return _features(d).select(*KEYS, "mc_country", "mc_jaro_distance", "mc_is_exact_match", "mc_is_close_match", "mc_count")


@query
def mc_features_only(d: Demo) -> DataFrame:
    found = d.candidates()
    used = d.stories.join(found.select("story_id").distinct(), "story_id", "left_semi")
    return P.candidate_features(found, d.kb, d.gazetteer, P.document_countries(used, d.gazetteer), append=False)


@query
def mc_tfidf(d: Demo) -> DataFrame:
    return P.tfidf_features(d.candidates(), d.kb).select(*KEYS, "mc_tfidf", "mc_tfidf_share")


@query
def mc_optional_features(d: Demo) -> DataFrame:
    found = P.optional_candidate_features(d.candidates(), d.kb)
    return found.select(*KEYS, "mc_common_tokens", "mc_jaro_winkler", "mc_levenshtein_distance", "mc_is_surfaceform")


@query
def tag_freqs(d: Demo) -> DataFrame:
    return P.add_tag_frequency(d.candidates(), P.tag_frequencies(d.story_tags, d.stories)).select(*KEYS, "tagged_cnt")


# Learning and scores


@query
def class_weights(d: Demo) -> DataFrame:
    found = ml.Numerizer(d.story_tags).labelled(d.candidates(), ("H", "L", "NO"))
    return found.select(*KEYS, "relevance", "is_H", "is_L", "is_NO", "sample_weight")


NUMBERS = ("token_cnt", "pos_in_sentence", "paragraph", "sentence", "candidate_weight")


@query
def numerized(d: Demo) -> DataFrame:
    rows = ml.front(d.candidates().select(*KEYS, *NUMBERS), list(KEYS))
    return ml.Numerizer(keep=KEYS).transform(rows)


@query
def model_predictions(d: Demo) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression

    found = C.tagged(_features(d), d.story_tags).withColumn("label", F.col("is_tagged").cast("double"))
    names = ["mc_jaro_distance", "mc_country", "mc_count", "candidate_weight", "token_cnt"]
    path = folder(d.spark, "features")  # read in each step of the fit
    found.select(*KEYS, "label", *names).write.parquet(path)
    rows = ml.Numerizer(keep=(*KEYS, "label")).transform(d.spark.read.parquet(path))
    stages = [ml.PipelinePrint("learning"), ml.ModelWrapper(LogisticRegression(regParam=0.01, maxIter=10), names)]
    out = ml.Pipeline(stages).fit_transform(rows)
    return ml.FeatureSelector([*KEYS, "label", "prediction"]).transform(out)


@query
def f1_by_story(d: Demo) -> DataFrame:
    predicted = d.candidates().groupBy("story_id").agg(F.collect_set("candidate").alias("p"))
    true = d.story_tags.groupBy("story_id").agg(F.collect_set("coid").alias("t"))
    none = F.array().cast("array<long>")
    both = predicted.join(true, "story_id", "full").select("story_id", F.coalesce("p", none).alias("p"), F.coalesce("t", none).alias("t"))
    return both.select("story_id", G.f1_score(F.col("p"), F.col("t")).alias("f1"))


@query
def f1_of_corpus(d: Demo) -> DataFrame:
    return G.corpus_f1(d.candidates().withColumnRenamed("candidate", "coid"), d.story_tags)


@query
def normalized_scores(d: Demo) -> DataFrame:
    sums = d.candidates().groupBy("story_id", "candidate").agg(F.sum("candidate_weight").alias("w"))
    maps = sums.groupBy("story_id").agg(F.map_from_entries(F.collect_list(F.struct("candidate", "w"))).alias("m"))
    return maps.select("story_id", F.explode(G.normalize_scores(F.col("m"))).alias("candidate", "score"))


@query
def xml_roundtrip(d: Demo) -> DataFrame:
    from ..sources.xml import read_tags, write_tags

    path = folder(d.spark, "tags-xml")
    write_tags(d.story_tags, d.companies, path)
    return read_tags(d.spark, path)


# Sources: what is written is read again


def _letters(c: str):
    return F.trim(F.regexp_replace(c, "[^A-Za-z0-9,. ]", ""))


@query
def stories_xml(d: Demo) -> DataFrame:
    from ..sources.xml import read_stories, write_stories

    tags = d.story_tags.groupBy("story_id").agg(F.map_from_entries(F.collect_list(F.struct("coid", "relevance"))).alias("tags"))
    rows = d.stories.select("story_id", F.lit("2012-01-02").cast("date").alias("date"), _letters("headline").alias("headline"), _letters("text").alias("text"), "source")
    path = folder(d.spark, "stories-xml")
    write_stories(rows.join(tags, "story_id", "left"), path)
    pairs = F.transform(F.array_sort(F.map_entries("tags")), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["value"]))
    return read_stories(d.spark, path).select("story_id", F.col("date").cast("string").alias("date"), "headline", "text", "source", pairs.alias("tags"))


@query
def companies_xml(d: Demo) -> DataFrame:
    from ..sources.xml import read_companies, write_companies

    path = folder(d.spark, "companies-xml")
    write_companies(d.companies, path)
    return read_companies(d.spark, path).select("id", "name", "domicile")


@query
def list_lines(d: Demo) -> DataFrame:
    from ..sources.tables import read_list

    path = folder(d.spark, "list")
    lines = F.explode(F.array(F.lit("# comment"), F.lit(" "), F.col("name")))
    d.companies.select(lines.alias("value")).write.text(path)
    return read_list(d.spark, path, "line")


def _index(d: Demo, rows: DataFrame, value: str, end: str) -> DataFrame:
    from ..sources.tables import read_index

    path = folder(d.spark, value) + end
    lists = rows.groupBy("id").agg(F.collect_list(value).alias(f"{value}s"))
    lists.write.json(path) if end else lists.write.parquet(path)
    return read_index(d.spark, path, value)


@query
def surface_forms_json(d: Demo) -> DataFrame:
    return _index(d, d.surface_forms, "form", ".json")


@query
def tickers_parquet(d: Demo) -> DataFrame:
    return _index(d, d.tickers, "ticker", "")


@query
def gazetteer_parquet(d: Demo) -> DataFrame:
    from ..sources.tables import read_gazetteer

    path = folder(d.spark, "gazetteer")
    d.gazetteer.withColumn("key", F.upper("key")).write.parquet(path)
    return read_gazetteer(d.spark, path)
