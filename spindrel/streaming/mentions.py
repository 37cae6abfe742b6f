"""Mentions, candidates and counts of a stream of stories.

Each micro-batch runs the batch plans: a story is in one batch, and nothing is
kept between batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.aggregates import share_of_text
from ..operators.candidates import generate_candidates
from ..operators.kb import KnowledgeBase
from ..operators.mentions import extract_mentions


def tag_stream(
    stories: DataFrame, kb: KnowledgeBase, sink: Callable[[DataFrame, int], None], checkpoint: str, with_candidates: bool = False, **options
) -> StreamingQuery:
    """Starts a query that gives each batch's mentions (with mention_count) or candidates to ``sink``."""

    def batch(rows: DataFrame, number: int) -> None:
        found = extract_mentions(rows, kb, **options)
        sink(generate_candidates(found, kb) if with_candidates else share_of_text(found), number)

    return stories.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
