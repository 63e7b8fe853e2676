"""T-norms on columns of truth values in [0, 1]. Nulls give nulls."""
from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _no_null(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(a.isNotNull() & b.isNotNull(), f(a, b))


@dataclass(frozen=True)
class TNorm:
    conjunction: Callable[[Column, Column], Column]
    #: Of the values of a group.
    grouped: Callable[[Column], Column]

    def negation(self, a: Column) -> Column:
        return 1 - a

    def disjunction(self, a: Column, b: Column) -> Column:
        return 1 - self.conjunction(1 - a, 1 - b)


NORMS = {"product": TNorm(lambda a, b: a * b, F.product), "godel": TNorm(_no_null(F.least), F.min)}


def get(name: str) -> TNorm:
    if name not in NORMS:
        raise ValueError(f"no t-norm {name!r}")
    return NORMS[name]
