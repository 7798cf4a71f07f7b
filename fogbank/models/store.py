"""Versioned model store: immutable version folders, and a manifest per version that is committed last.

A save writes a new folder and then one manifest (a line of JSON with the folder's name and facts such as features, kind and Spark
version). A save that breaks off leaves a folder without a manifest, which no reader sees; readers take the newest manifest whose
facts fit and whose folder can be read, so they get the former version. Folders are never written twice. Old ones stay until the
owner of the store expires them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

MANIFESTS = "manifests"


def commit(spark: SparkSession, path: str, write: Callable[[str], None], facts: dict) -> str:
    """Write a new version with ``write(folder)``, then its manifest. Returns the folder."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    folder = f"{path.rstrip('/')}/versions/{version}"
    write(folder)
    line = json.dumps({"version": version, "spark": spark.version, **facts}, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path.rstrip('/')}/{MANIFESTS}/{version}")
    return folder


def versions(spark: SparkSession, path: str, facts: dict | None = None) -> Iterator[str]:
    """Folders of the complete versions, newest first, whose manifests hold ``facts`` and this Spark version."""
    try:
        # One line per version kept.
        lines = [json.loads(r["value"]) for r in spark.read.text(f"{path.rstrip('/')}/{MANIFESTS}/*").collect()]
    except AnalysisException:
        return
    wanted = {"spark": spark.version, **(facts or {})}
    for m in sorted(lines, key=lambda m: m["version"], reverse=True):
        if all(m.get(k) == v for k, v in wanted.items()):
            yield f"{path.rstrip('/')}/versions/{m['version']}"


def load(spark: SparkSession, path: str, read: Callable[[str], object], facts: dict | None = None):
    """``read(folder)`` of the newest version that fits and can be read; None if there is none."""
    for folder in versions(spark, path, facts):
        try:
            return read(folder)
        except (AnalysisException, AttributeError, KeyError, TypeError, json.JSONDecodeError) as unreadable:
            # Damaged or of another layout; any other fault is not a reason to pass a version over.
            print(f"passing over {folder}: {type(unreadable).__name__}")
    return None
