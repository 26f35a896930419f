"""The rules of ``normal`` and ``pages`` on columns: the very functions that the reader calls, on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def lifted(rule: Callable, kind: str) -> Callable[..., Column]:
    """rule, a function of one or two values, as a function of as many columns; nulls are passed on as None."""
    def column(*columns: Column) -> Column:
        out = T._parse_datatype_string(kind)  # needs a session

        def run(first: pa.Array, *more: pa.Array) -> pa.Array:
            return pa.array(map(rule, first.to_pylist(), *(x.to_pylist() for x in more)), to_arrow_type(out))

        one = lambda a: run(a)
        two = lambda a, b: run(a, b)
        f = (one, two)[len(columns) - 1]
        f.__annotations__ = dict.fromkeys([*"ab"[: len(columns)], "return"], pa.Array)
        return F.arrow_udf(f, returnType=out)(*columns)

    return column
