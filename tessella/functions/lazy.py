"""Python functions as Columns whose UDF is made at the call, so modules can be imported before a session exists."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F


def lazy_pandas_udf(kind: str):
    def wrap(f):
        @wraps(f)
        def call(*columns):
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap
