"""Steps that are kept under what they were made from, so that runs which share a step make it once.

A step is named by a digest of its parameters, of the code that makes it, and of the files it reads (path, length, time of
change). It is written to a new folder below the shared one; a line of text that names this folder is written last, so an
interrupted run leaves no step that looks whole, and two runs at the same time each write their own and the later line wins.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from txlens.session import new_dir, shared_dir


def files(spark: SparkSession, paths: Iterable[str]) -> list[list]:
    """(path, length, time of change) of the files under the paths; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sorted(paths)).select("path", "length", "modificationTime")
    return sorted([r.path, r.length, r.modificationTime.timestamp()] for r in rows.collect())


def address(name: str, params: Mapping, inputs: list, code: Iterable[object] = ()) -> str:
    """Digest of a step: equal parameters, files and source texts have equal addresses."""
    text = json.dumps([name, dict(sorted(params.items())), inputs, [inspect.getsource(c) for c in code]], sort_keys=True, default=str)
    return f"{name}-{hashlib.sha256(text.encode()).hexdigest()[:24]}"


def folder(spark: SparkSession, name: str, params: Mapping, inputs: list, code: Iterable[object] = ()) -> str:
    """A folder of the step's own, for steps that keep their state themselves."""
    return f"{shared_dir(spark)}/kept/{address(name, params, inputs, code)}"


def kept(spark: SparkSession, name: str, params: Mapping, inputs: list, build: Callable[[], DataFrame], code: Iterable[object] = ()) -> DataFrame:
    """The step's table, made only if no run has made it yet."""
    at = folder(spark, name, params, inputs, code)
    try:
        return spark.read.parquet(spark.read.text(at).first().value)
    except AnalysisException:
        path = new_dir(spark, name)
        build().write.parquet(path)
        spark.createDataFrame([(path,)], "value string").coalesce(1).write.mode("overwrite").text(at)
        return spark.read.parquet(path)
