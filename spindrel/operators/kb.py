"""The knowledge base: indexes of company names as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .aggregates import token_freqs, union_index


@dataclass
class KnowledgeBase:
    """One DataFrame for each index.

    No join is told to broadcast: indexes are broadcast where Spark finds them
    under its threshold, and shuffled beyond it.
    """

    company: DataFrame  # id, name, domicile, ord, stripped, initials
    name_token: DataFrame  # ord, pos, token
    token_freq: DataFrame  # token, freq
    token_coid: DataFrame  # token, coid
    whitelist: DataFrame  # token, prev, next
    full_names: DataFrame  # key, id
    stripped: DataFrame  # key, id
    initials: DataFrame  # key, id
    surface: DataFrame  # form, id
    tickers: DataFrame  # ticker, id
    ltoken: DataFrame  # ltok
    ltoken_coid: DataFrame  # ltok, coid
    normalized_names: DataFrame  # tokens


def last_wins(company: DataFrame, key) -> DataFrame:
    """(key, id): of companies with one key the last in file order."""
    return company.groupBy(key.alias("key")).agg(F.max_by("id", "ord").alias("id"))


def whitelist(company: DataFrame, cross_boundary: bool = True) -> DataFrame:
    """(token, prev, next) of name tokens that don't start with a capital.

    Neighbours reach over into the name before and after (``cross_boundary``):
    then the only window is over one row for each company.
    """
    named = company.select("ord", X.word_tokens(F.col("name")).alias("t")).where(F.size("t") > 0)
    pad = F.lit(X.PADDING)
    if cross_boundary:
        order = Window.orderBy("ord")
        before = F.coalesce(F.lag(F.element_at("t", -1)).over(order), pad)
        after = F.coalesce(F.lead(F.element_at("t", 1)).over(order), pad)
    else:
        before, after = pad, pad
    padded = named.select(F.concat(F.array(before), F.col("t"), F.array(after)).alias("t"))
    triples = F.transform(
        F.slice("t", F.lit(2), F.size("t") - 2),
        lambda x, i: F.struct(x.alias("token"), F.get("t", i).alias("prev"), F.get("t", i + 2).alias("next")),
    )
    return padded.select(F.inline(triples)).where(~X.starts_upper(F.col("token"))).distinct()


def build_kb(companies: DataFrame, surface_forms: DataFrame | None = None, tickers: DataFrame | None = None) -> KnowledgeBase:
    """``companies`` (id, name, domicile, ord), ``surface_forms`` (id, form), ``tickers`` (id, ticker).

    Without surface forms or tickers those indexes are empty.  With surface
    forms, stripped names and initials count among them.
    """
    spark = companies.sparkSession
    company = companies.select(
        "id", "name", "domicile", "ord", X.strip_common(F.col("name")).alias("stripped"), X.initials(F.col("name")).alias("initials")
    )
    name_token = company.select("ord", F.posexplode(X.word_tokens(F.col("name"))).alias("pos", "token"))
    freq = token_freqs(name_token)
    pair = lambda df, tokens, coid="id": df.select(F.explode(tokens).alias("token"), F.col(coid).alias("coid"))
    index = pair(company, X.normalized(F.col("name"), lowercase=False, fix=False)).distinct()
    by_initials = last_wins(company, F.col("initials"))
    of_initials = by_initials.select(F.col("key").alias("token"), F.col("id").alias("coid"))
    vocabulary, indexes = [freq.select("token"), by_initials.select("key")], [index, of_initials]

    surface = spark.createDataFrame([], "form string, id long")
    if surface_forms is not None:
        forms = surface_forms.select("id", "form").union(company.select("id", "stripped")).union(company.select("id", "initials"))
        surface = forms.select("form", "id").distinct()
        of_forms = pair(surface, X.normalized(F.col("form"), lowercase=False)).distinct()
        vocabulary.append(of_forms.select("token"))
        indexes.append(of_forms)
    by_ticker = spark.createDataFrame([], "ticker string, id long")
    if tickers is not None:
        by_ticker = tickers.select("ticker", "id").distinct()
        vocabulary.append(by_ticker.select("ticker"))
        indexes.append(by_ticker.select(F.col("ticker").alias("token"), F.col("id").alias("coid")))

    token_coid = union_index(*indexes)
    return KnowledgeBase(
        company=company,
        name_token=name_token,
        token_freq=freq,
        token_coid=token_coid,
        whitelist=whitelist(company),
        full_names=last_wins(company, F.lower("name")),
        stripped=last_wins(company, F.lower("stripped")),
        initials=by_initials,
        surface=surface,
        tickers=by_ticker,
        ltoken=union_index(*vocabulary).select(F.lower("token").alias("ltok")).distinct(),
        ltoken_coid=token_coid.select(F.lower("token").alias("ltok"), "coid").distinct(),
        normalized_names=company.select(X.normalized(F.col("name")).alias("tokens")).distinct(),
    )


def store_kb(kb: KnowledgeBase, path: str) -> None:
    """Writes each index as a Parquet table, so that later plans scan it and know its size."""
    for f in fields(kb):
        getattr(kb, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")


def load_kb(spark: SparkSession, path: str) -> KnowledgeBase:
    return KnowledgeBase(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(KnowledgeBase)})
