"""Memoisation of large Column expressions.

Building a recognizer catalogue's span expression issues tens of thousands of
py4j calls; the result is an immutable, unresolved expression that any
number of plans may share.  Builders decorated here return the same Column
for the same arguments within one Spark application.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column


def _key(a):
    if isinstance(a, Column):
        return ("column", str(a))
    if isinstance(a, list):
        return tuple(_key(x) for x in a)
    return a


def column_memo(fn):
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args, **kwargs):
        from pyspark import SparkContext

        sc = SparkContext._active_spark_context
        app = sc.applicationId if sc is not None else None
        key = (app, tuple(_key(a) for a in args), tuple(sorted((k, _key(v)) for k, v in kwargs.items())))
        try:
            hit = cache.get(key)
        except TypeError:  # unhashable argument: build without caching
            return fn(*args, **kwargs)
        if hit is None:
            hit = cache[key] = fn(*args, **kwargs)
        return hit

    return wrapper
