"""Settings of the command line: defaults, and a JSON file over them."""

from __future__ import annotations

import copy
import json

from pyspark.sql import SparkSession

from .sources.files import exists

DEFAULTS = {"sources": {}, "engine": {"root": "memory", "clusters": None, "least_user_messages": 1}, "search": {"top_k": 5}}


def merged(given: dict) -> dict:
    """The defaults with given values over them: sections value by value, other keys whole."""
    out = copy.deepcopy(DEFAULTS)
    for key, value in given.items():
        if isinstance(out.get(key), dict) and isinstance(value, dict):
            out[key].update(value)
        else:
            out[key] = value
    return out


def load(spark: SparkSession, path: str | None) -> dict:
    """Settings of a file in any store; none, or an empty one, gives the defaults."""
    if not path or not exists(spark, path):
        return merged({})
    text = spark.read.text(path, wholetext=True).first()
    return merged(json.loads(text.value) if text and text.value.strip() else {})
