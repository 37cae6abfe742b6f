"""Stages of a model pipeline: selection, scaling, labels, a wrapped estimator."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .aggregates import class_weights, one_hot
from .candidates import relevance

log = logging.getLogger(__name__)
#: What a stage learns, and is no setting.
LEARNED = ("fitted",)
#: Numbers that say nothing about the class.
KEYS = ("candidate", "story_id")


class Stage:
    """A stage that learns nothing; ``transform`` maps a DataFrame to another."""

    def fit(self, rows: DataFrame) -> "Stage":
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, rows: DataFrame) -> DataFrame:
        return self.fit(rows).transform(rows)

    def get_params(self) -> dict[str, Any]:
        """The settings that the stage was made with."""
        return {k: v for k, v in vars(self).items() if k not in LEARNED}


@dataclass
class Apply(Stage):
    """Any function from DataFrame to DataFrame as a stage."""

    function: Any

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.function(rows)


@dataclass
class FeatureSelector(Stage):
    """The given columns."""

    features: list[str]

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.features)


@dataclass
class PipelinePrint(Stage):
    """Logs its message and passes the rows on."""

    message: str

    def transform(self, rows: DataFrame) -> DataFrame:
        log.info("%s", self.message)
        return rows


def front(rows: DataFrame, names: list[str]) -> DataFrame:
    """The given columns first, the others after them in their order."""
    return rows.select(*names, *[c for c in rows.columns if c not in names])


@dataclass
class Numerizer(Stage):
    """Numeric columns, centred and divided by their population deviation.

    Booleans become 0 and 1; nulls become 0 before scaling; a constant column is
    only centred.  Keys and columns of other types go, unless in ``keep``.
    With story tags, ``labelled`` adds relevance, its indicators and weights.
    """

    story_tags: DataFrame | None = None
    keep: tuple[str, ...] = ()

    def numeric(self, rows: DataFrame) -> list[str]:
        kinds = (T.NumericType, T.BooleanType)
        return [f.name for f in rows.schema if isinstance(f.dataType, kinds) and f.name not in (*KEYS, *self.keep)]

    def transform(self, rows: DataFrame) -> DataFrame:
        names = self.numeric(rows)
        base = rows.select(*self.keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
        sums = base.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in names])
        row = sums.first()  # two numbers for each column
        scaled = {c: (F.col(c) - F.lit(row[c]["m"] or 0.0)) / F.lit(row[c]["s"] or 1.0) for c in names}
        return base.withColumns(scaled) if scaled else base

    def labelled(self, rows: DataFrame, values: tuple[str, ...] = ("H", "M", "L", "NO")) -> DataFrame:
        if self.story_tags is None:
            raise ValueError("labels need story tags")
        return one_hot(class_weights(relevance(rows, self.story_tags), "relevance"), "relevance", list(values))


class ModelWrapper(Stage):
    """An estimator of ``pyspark.ml`` as a stage: ``transform`` adds its prediction."""

    def __init__(self, model: Any, features: list[str], label: str = "label"):
        self.model, self.features, self.label, self.fitted = model, features, label, None

    def _vectors(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.features, outputCol="__features", handleInvalid="keep").transform(rows)

    def fit(self, rows: DataFrame) -> "ModelWrapper":
        model = self.model.copy({self.model.featuresCol: "__features", self.model.labelCol: self.label})
        self.fitted = model.fit(self._vectors(rows))
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        out = self.fitted.transform(self._vectors(rows))
        return out.drop("__features", "rawPrediction", "probability")


@dataclass
class Pipeline(Stage):
    """Stages one after the other."""

    stages: list[Stage]

    def fit(self, rows: DataFrame) -> "Pipeline":
        for stage in self.stages:
            rows = stage.fit(rows).transform(rows)
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        for stage in self.stages:
            rows = stage.transform(rows)
        return rows
