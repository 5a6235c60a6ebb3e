"""The column filters and scalers of ``cleaning`` as stages of a ``pyspark.ml`` pipeline (inventory X5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame

from . import cleaning


class _Chosen(Model):
    """Keeps the columns that fitting chose, beside those it didn't look at."""

    def __init__(self, columns: Sequence[str], kept: Sequence[str]):
        super().__init__()
        self.columns, self.kept = list(columns), list(kept)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*[c for c in self.columns if c not in set(self.kept)])


class CorrelationFilter(Estimator):
    """Drops a column if any earlier one correlates with it above the threshold."""

    def __init__(self, columns: Sequence[str], threshold: float = 0.9):
        super().__init__()
        self.columns, self.threshold = list(columns), threshold

    def _fit(self, dataset: DataFrame) -> _Chosen:
        kept = cleaning.correlation_filter(dataset, self.columns, self.threshold).where("kept").select("feature").collect()  # a row per column
        return _Chosen(self.columns, [r.feature for r in kept])


class VarianceFilter(Estimator):
    """Drops columns whose population variance doesn't exceed the threshold."""

    def __init__(self, columns: Sequence[str], threshold: float = 0.01):
        super().__init__()
        self.columns, self.threshold = list(columns), threshold

    def _fit(self, dataset: DataFrame) -> _Chosen:
        kept = cleaning.variances(dataset, self.columns, self.threshold).where("kept").select("feature").collect()  # a row per column
        return _Chosen(self.columns, [r.feature for r in kept])


class _Scaled(Model):
    """Shifts and divides each column by what fitting found; a divisor of 0 counts as 1."""

    def __init__(self, shift: dict[str, float], width: dict[str, float]):
        super().__init__()
        self.shift, self.width = shift, width

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: (dataset[c] - self.shift[c]) / (self.width[c] or 1.0) for c in self.shift})


class PopulationScaler(Estimator):
    """Zero mean and unit population deviation, or with ``span`` the range from 0 to 1."""

    def __init__(self, columns: Sequence[str], span: bool = False):
        super().__init__()
        self.columns, self.span = list(columns), span

    def _fit(self, dataset: DataFrame) -> _Scaled:
        from pyspark.sql import functions as F

        low, wide = (F.min, lambda c: F.max(c) - F.min(c)) if self.span else (F.avg, F.stddev_pop)
        s = dataset.agg(*[F.struct(low(c).cast("double").alias("a"), wide(c).cast("double").alias("b")).alias(c) for c in self.columns]).first()
        known = [c for c in self.columns if s[c].a is not None]
        return _Scaled({c: s[c].a for c in known}, {c: s[c].b for c in known})
