"""Reuse Column expression trees within one Spark application.

Building a large expression (the rule ladders, the measures) from Python is
thousands of small gateway calls. The trees depend only on their arguments,
not on data, so they are built once per application and reused by every
query; Catalyst still resolves them freshly inside each plan.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import SparkSession

_LOCK = threading.RLock()  # memoised builders may call each other
_CACHE: dict[tuple, object] = {}


def per_application(fn):
    @functools.wraps(fn)
    def wrapper(*args):
        session = SparkSession.getActiveSession()
        if session is None:
            return fn(*args)
        from stocklens.session import app_id

        key = (app_id(session), fn.__module__, fn.__qualname__, args)
        with _LOCK:
            if key not in _CACHE:
                _CACHE[key] = fn(*args)
            return _CACHE[key]

    return wrapper
