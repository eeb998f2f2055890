"""Bounds on columns, from the filters that Spark pushes down to a Python source."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from datetime import UTC, date, datetime

import numpy as np
from pyspark.sql.datasource import DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual


def plain(x) -> float:
    """A bound as a number; times in microseconds, as they are without a zone."""
    if isinstance(x, datetime):
        x = x.replace(tzinfo=None) if x.tzinfo is None else x.astimezone(UTC).replace(tzinfo=None)
        return float((np.datetime64(x, "us") - np.datetime64(0, "us")).astype(np.int64))
    if isinstance(x, date):
        return plain(datetime(x.year, x.month, x.day))
    return float(x)


class BoundedReader(DataSourceReader):
    """Keeps the least and greatest value of some columns. Filters stay in the plan, so bounds may be coarse."""

    columns: Sequence[str] = ()

    def __init__(self):
        self.bounds: dict[str, tuple[float, float]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)) and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                given = [plain(x) for x in (f.value if isinstance(f, In) else [f.value]) if x is not None]
                if given:
                    low, high = self.bound(f.attribute[0])
                    low = low if isinstance(f, (LessThan, LessThanOrEqual)) else max(low, min(given))
                    high = high if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else min(high, max(given))
                    self.bounds[f.attribute[0]] = low, high
            yield f

    def bound(self, column: str) -> tuple[float, float]:
        return self.bounds.get(column, (-math.inf, math.inf))

    def within(self, axis: np.ndarray, *columns: str) -> tuple[int, int]:
        """From the first to after the last place of an axis that is inside the bounds of its columns."""
        inside = np.ones(len(axis), bool)
        for c in columns:
            low, high = self.bound(c)
            inside &= (axis >= low) & (axis <= high)
        at = np.flatnonzero(inside)
        return (int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0)
