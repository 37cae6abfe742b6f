"""Counts, shares, inversions and scores that other operators build on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_freqs(tokens: DataFrame, token: str = "token", normalize: bool = True) -> DataFrame:
    """(token, freq): how often each token occurs, as a share of the commonest if ``normalize``."""
    counts = tokens.groupBy(F.col(token).alias("token")).agg(F.count("*").alias("freq"))
    if not normalize:
        return counts
    return counts.select("token", (F.col("freq") / counts.agg(F.max("freq")).scalar()).alias("freq"))


def story_token_frequencies(sentences: DataFrame) -> DataFrame:
    """(token, freq) over all tokens of ``sentences`` (with ``tokens``), and one start and end for each sentence."""
    marks = F.array(F.lit("SENTENCE_START"), F.lit("SENTENCE_END"))
    return token_freqs(sentences.select(F.explode(F.concat("tokens", marks)).alias("token")), normalize=False)


def unique_mentions_per_word(mentions: DataFrame, field: str) -> DataFrame:
    """(word, n_mentions): distinct mention texts next to each value of ``field``."""
    return mentions.groupBy(F.col(field).alias("word")).agg(F.countDistinct("text").alias("n_mentions"))


def invert(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """(value, keys): the sorted set of keys of each value."""
    return pairs.groupBy(value).agg(F.sort_array(F.collect_set(key)).alias("keys"))


def union_index(*indexes: DataFrame) -> DataFrame:
    """The union of (key, id) indexes, each pair once."""
    out = indexes[0]
    for x in indexes[1:]:
        out = out.union(x)
    return out.distinct()


def share_of_text(mentions: DataFrame, story: str = "story_id", text: str = "text") -> DataFrame:
    """``mentions`` with mention_count: rows of the text in its story over the sum of that over the story's rows.

    On mentions or on mention-candidates, whichever rows are given.
    """
    n = F.count("*").over(Window.partitionBy(story, text))
    counted = mentions.withColumn("__n", n)
    return counted.withColumn("mention_count", F.col("__n") / F.sum("__n").over(Window.partitionBy(story))).drop("__n")


def share_of_candidate(rows: DataFrame, story: str = "story_id", candidate: str = "candidate") -> DataFrame:
    """``rows`` with mc_count: rows of the candidate in its story over those of the commonest."""
    counted = rows.withColumn("__n", F.count("*").over(Window.partitionBy(story, candidate)))
    return counted.withColumn("mc_count", F.col("__n") / F.max("__n").over(Window.partitionBy(story))).drop("__n")


def f1_score(predicted: Column, true: Column) -> Column:
    """F1 of two arrays as sets; 0 without overlap."""
    hits = F.size(F.array_intersect(predicted, true))
    total = F.size(F.array_distinct(predicted)) + F.size(F.array_distinct(true))
    return F.when(hits > 0, 2 * hits / total).otherwise(F.lit(0.0))


def corpus_f1(predicted: DataFrame, true: DataFrame, key: str = "story_id", item: str = "coid") -> DataFrame:
    """One row (n_predicted, n_true, n_both, precision, recall, f1) over all distinct (key, item) of both; no item at all gives 0."""
    p = predicted.select(key, item).distinct().withColumn("__p", F.lit(1))
    both = p.join(true.select(key, item).distinct().withColumn("__t", F.lit(1)), [key, item], "full")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = both.agg(n("__p").alias("n_predicted"), n("__t").alias("n_true"), n(F.col("__p") * F.col("__t")).alias("n_both"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    hits = F.col("n_both")
    return sums.withColumns(
        {
            "precision": share(hits, F.col("n_predicted")),
            "recall": share(hits, F.col("n_true")),
            "f1": share(2 * hits, F.col("n_predicted") + F.col("n_true")),
        }
    )


def normalize_scores(scores: Column, weight: float = 1.0) -> Column:
    """A map of scores over its largest, times ``weight``; empty if that can't be formed."""
    top = F.array_max(F.map_values(scores))
    usable = (F.size(scores) > 0) & (top != 0)
    return F.when(usable, F.transform_values(scores, lambda _, v: weight * v / top)).otherwise(F.map_filter(scores, lambda _k, _v: F.lit(False)))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with sample_weight: rows of the rarest label over rows of the own."""
    counts = rows.groupBy(F.col(label).alias("__label")).count()
    weights = counts.select("__label", (counts.agg(F.min("count")).scalar() / F.col("count")).alias("sample_weight"))
    return rows.join(weights, rows[label].eqNullSafe(F.col("__label"))).drop("__label")


def one_hot(rows: DataFrame, label: str, values: list[str]) -> DataFrame:
    """``rows`` with a 0/1 column ``is_<value>`` for each value of ``label``."""
    return rows.withColumns({f"is_{v}": (F.col(label) == v).cast("int") for v in values})
