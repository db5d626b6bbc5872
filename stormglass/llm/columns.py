"""Columns of the caller whose names an operator uses inside."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame


def keeps_columns(*reserved: str) -> Callable:
    """Decorates an operator on documents: columns named like `reserved` come back untouched."""
    def decorate(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            clash = {c: f"kept {c}" for c in docs.columns if c.lower() in reserved}
            out = operator(docs.withColumnsRenamed(clash), *args, **options)
            return out.withColumnsRenamed({v: k for k, v in clash.items()})
        return run
    return decorate
