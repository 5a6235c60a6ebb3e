"""Missing values from regressions on all other columns, by sums over rows alone (inventory M3, M4).

A round reads the rows once.  Tasks fill in what the last round's models say and
add up, for each column with gaps, the products of all columns over the rows where
it is known; Spark adds these up, and the driver solves each column's regression
from its sums.  What the driver sees is bounded by the columns, not by the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import staged
from .cleaning import median_impute, mode_impute

#: The flat priors of Bayesian ridge regression, and its steps.
PRIOR, STEPS, CLOSE = 1e-6, 300, 1e-3
#: Columns whose products are added up; each with gaps needs their square.
MOST_COLUMNS = 512


def bayesian_ridge(n: float, mean_x: np.ndarray, mean_y: float, sxx: np.ndarray, sxy: np.ndarray, syy: float) -> np.ndarray:
    """Coefficients, the intercept first, of the regression whose noise and weight precisions have the most evidence; from centred sums of products."""
    value, vector = np.linalg.eigh(sxx)
    value = np.maximum(value, 0)
    along = vector.T @ sxy
    alpha, lam, old = 1 / (max(syy, 0.0) / n + np.finfo(float).eps), 1.0, None
    for _ in range(STEPS):
        coef = vector @ (along / (value + lam / alpha))
        if old is not None and np.abs(old - coef).sum() < CLOSE:
            break
        old = coef
        rest = max(syy - 2 * coef @ sxy + coef @ sxx @ coef, 0.0)
        gamma = (alpha * value / (lam + alpha * value)).sum()
        lam = (gamma + 2 * PRIOR) / ((coef**2).sum() + 2 * PRIOR)
        alpha = (n - gamma + 2 * PRIOR) / (rest + 2 * PRIOR)
    return np.concatenate([[mean_y - mean_x @ coef], coef])


def solved(gram: np.ndarray, c: int) -> np.ndarray:
    """The coefficients of column c on all others, from the products of 1 and all columns."""
    others = [j for j in range(gram.shape[0]) if j not in (0, c)]
    n = gram[0, 0]
    if n < 2:
        return np.concatenate([[gram[0, c] / max(n, 1)], np.zeros(len(others))])
    mean = gram[0] / n
    centred = gram - n * np.outer(mean, mean)
    return bayesian_ridge(n, mean[others], mean[c], centred[np.ix_(others, others)], centred[others, c], centred[c, c])


def chance(x: np.ndarray, coef: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))


def filled(x: np.ndarray, missing: np.ndarray, models: Mapping[int, np.ndarray], binary: set[int], ordinal: Mapping[int, tuple[int, int]]) -> np.ndarray:
    """The rows with each gap as its column's model says.

    The numbers that a row lacks depend on each other; rows that lack the same ones
    are solved together, so that all their models hold at once.
    """
    out = x.copy()
    weights = np.zeros((x.shape[1], x.shape[1] + 1))  # the intercept last
    for c, coef in models.items():
        weights[c, [j for j in range(x.shape[1]) if j != c]], weights[c, -1] = coef[1:], coef[0]
    numbers = [c for c in models if c not in binary and c not in ordinal]
    kinds, which = np.unique(missing[:, numbers], axis=0, return_inverse=True)
    for k, kind in enumerate(kinds):
        gone = [c for c, g in zip(numbers, kind, strict=True) if g]
        if gone:
            rows = np.flatnonzero(which.ravel() == k)
            held = [j for j in range(x.shape[1]) if j not in gone]
            rest = x[np.ix_(rows, held)] @ weights[np.ix_(gone, held)].T + weights[gone, -1]
            out[np.ix_(rows, gone)] = np.linalg.lstsq(np.eye(len(gone)) - weights[np.ix_(gone, gone)], rest.T, rcond=None)[0].T
    for c in models.keys() - set(numbers):
        rows = np.flatnonzero(missing[:, c])
        value = x[rows] @ weights[c, :-1] + weights[c, -1]
        out[rows, c] = value >= 0 if c in binary else np.clip(np.round(value), *ordinal[c])
    return out


def regression_imputation(df: DataFrame, columns: Sequence[str], rounds: int = 100, tolerance: float = 1e-3, binary: Sequence[str] = (), ordinal: Mapping[str, tuple[int, int]] | None = None) -> tuple[DataFrame, list[float]]:
    """The table without gaps in ``columns``, and the largest change of each round.

    Numbers by Bayesian ridge regression, ``ordinal`` columns too (rounded and clipped
    to their levels), ``binary`` ones (0 and 1) by a logistic model that makes one
    Newton step a round.  Starts from the median, or the mode of binary and ordinal
    columns; ends when no number changes by more than ``tolerance`` times the largest
    known one, and no class.  A column without any known value stays null.
    """
    if len(columns) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    ordinal = {columns.index(c): v for c, v in (ordinal or {}).items()}
    named = [*binary, *[columns[c] for c in ordinal]]
    binary = {columns.index(c) for c in binary}
    known = df.agg(*[F.count(c) for c in columns], *[F.count_if(F.col(c).isNull()) for c in columns], *[F.max(F.abs(F.col(c).cast("double"))) for c in columns]).first()
    p = len(columns)
    used = [c for c in range(p) if known[c]]
    gaps = [c for c in used if known[p + c]]
    largest = max((known[2 * p + c] for c in used), default=0.0) or 1.0
    start = median_impute(mode_impute(df.withColumn("__m", F.array(*[F.col(c).isNull() for c in columns])), named) if named else df.withColumn("__m", F.array(*[F.col(c).isNull() for c in columns])), [c for c in columns if c not in named])
    kept = [c for c in df.columns if c not in columns]
    start = start.select(*kept, "__m", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("__x"))
    sums = [T.StructField("__of", T.IntegerType()), T.StructField("__sum", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in start.schema.fields], *sums])  # rows of sums have nulls there

    def turn(models: Mapping[int, np.ndarray], logits: Mapping[int, np.ndarray]):
        """A task: fills in, and adds up for the next round; -1 has the largest change and the number of classes that changed."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {c: np.zeros((p + 1, p + 1)) for c in gaps}
            slope = {c: np.zeros(p) for c in binary}
            most = changed = 0.0
            names = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                missing = batch.column("__m").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                new = filled(x, missing, models, binary, ordinal)
                step = np.abs(new - x)
                classes = [*binary, *ordinal]
                changed += step[:, classes].astype(bool).sum()
                most = max(most, np.delete(step, classes, 1).max(initial=0.0))
                wide = np.column_stack([np.ones(len(new)), new])
                whole = None
                for c in gaps:
                    own = wide[~missing[:, c]]
                    if c in binary:  # the products of a Newton step, and the slope in the place of the column
                        held = np.delete(own, c + 1, 1)
                        chances = chance(held, logits[c])
                        total[c][:p, :p] += (held * (chances * (1 - chances))[:, None]).T @ held
                        slope[c] += held.T @ (own[:, c + 1] - chances)
                    else:
                        whole = wide.T @ wide if whole is None else whole
                        gone = wide[missing[:, c]]
                        total[c] += whole - gone.T @ gone
                names = batch.schema
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, new.size + 1, p), pa.int32()), pa.array(new.ravel()))
                columns = [cells.cast(f.type) if f.name == "__x" else batch.column(f.name) for f in batch.schema]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(new), pa.int32()), pa.nulls(len(new), pa.list_(pa.float64()))], [*batch.schema.names, "__of", "__sum"])
            if names is not None:
                for c in binary & set(gaps):
                    total[c][p, :p] = slope[c]
                rows = [(c, m.ravel().tolist()) for c, m in total.items()] + [(-1, [most, changed])]
                empty = [pa.nulls(len(rows), f.type) for f in names]
                yield pa.RecordBatch.from_arrays([*empty, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], [*names.names, "__of", "__sum"])

        return run

    models: dict[int, np.ndarray] = {}
    logits = {c: np.zeros(p) for c in binary}
    state, moves = start, []
    for r in range(rounds + 1):
        held = staged(state.mapInArrow(turn(models, logits), schema), "imputed")
        state = held.where("__of is null").select(*start.columns)
        if r:
            most, changed = held.where("__of = -1").agg(F.max(F.col("__sum")[0]), F.sum(F.col("__sum")[1])).first()
            moves.append(float(most or 0.0))
            if (most or 0.0) < tolerance * largest and not changed:
                break
        if r == rounds or not gaps:
            break
        sums_of = held.where("__of >= 0").groupBy("__of").agg(Summarizer.sum(array_to_vector("__sum")).alias("s"))
        for row in sums_of.collect():  # a row for each column with gaps
            c, gram = row["__of"], row.s.toArray().reshape(p + 1, p + 1)
            if c in binary:
                step = np.linalg.solve(gram[:p, :p] + 1e-6 * np.eye(p), gram[p, :p])
                logits[c] = logits[c] + step
                models[c] = logits[c]
            else:
                models[c] = solved(gram, c + 1)
    value = lambda i, c: F.when(F.lit(bool(known[i])), F.col("__x")[i]).cast(df.schema[c].dataType).alias(c)
    return state.select(*[value(columns.index(c), c) if c in columns else F.col(c) for c in df.columns]), moves
