"""Named statistics, feature names and the wide contract of a segment's feature row."""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Fixed order of the sixteen statistics of a series.
STATISTICS = ("mean", "median", "std", "mad", "iqr", "min", "max", "p25", "p75", "skewness", "kurtosis", "entropy", "slope", "autocorr_lag1", "gini_index", "valid_n")
#: Fixed domain of a segment's status.
STATUSES = ("perfect", "no_signals", "delT_neg", "value_err", "index_err", "fileOrHeader_missing", "type_err", "unboundLocal", "attributeErr", "KeyError", "other_err")

FUNCTIONS: dict[str, Callable] = {}


def register(f: Callable) -> Callable:
    """Makes a column or kernel function available by its name."""
    FUNCTIONS[f.__name__] = f
    return f


def with_statistics(base: Iterable[str], summarised: Iterable[str], statistics: Iterable[str] = STATISTICS) -> list[str]:
    """Column names of the wide contract: each summarised name once per statistic, the others as they are."""
    chosen, statistics = set(summarised), list(statistics)
    return [name for b in base for name in ([f"{b}_{s}" for s in statistics] if b in chosen else [b])]


def kept_features(names: Iterable[str], statistics: Iterable[str] = ("mean", "p25", "p75", "skewness", "entropy"), without: Iterable[str] = ("valid_n", "MSE_")) -> list[str]:
    """Names that hold none of ``without`` and, if they end in a statistic, end in one of ``statistics``."""
    wanted, without = tuple(statistics), tuple(without)
    dropped = tuple(f"_{s}" for s in STATISTICS if s not in wanted)
    return [n for n in names if not any(w in n for w in without) and not n.endswith(dropped)]


def status_of(error: BaseException | None) -> str:
    """The status code of a failed segment."""
    if error is None:
        return "perfect"
    # fixed mapping, most specific class first
    for kind, status in (
        (FileNotFoundError, "fileOrHeader_missing"),
        (UnboundLocalError, "unboundLocal"),
        (IndexError, "index_err"),
        (KeyError, "KeyError"),
        (ValueError, "value_err"),
        (TypeError, "type_err"),
        (AttributeError, "attributeErr"),
    ):
        if isinstance(error, kind):
            return status
    return "other_err"
