"""Ships this package to the executors, so that Python workers find it wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    home = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(home):  # already imported from a shipped archive
        return
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), "palimpsest.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    z.write(at, os.path.join("palimpsest", os.path.relpath(at, home)))
    sc.addPyFile(target)


def ship_for_state(spark: SparkSession) -> None:
    """As ship, for keyed state with timers: the driver starts a Python process too, which gets no Python files but this path."""
    ship(spark)
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([p for p in (known, home) if p])


def ship_active() -> None:
    """As ship, for functions that make columns and know no session."""
    session = SparkSession.getActiveSession()
    if session is not None:
        ship(session)
