"""Session helpers: a tuned local session, and making this package importable by executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_attached: set[str] = set()


def attach(spark: SparkSession) -> SparkSession:
    """Ship this package to the executors, once for each application, so that Python functions of it run there."""
    sc = spark.sparkContext
    if sc.applicationId not in _attached:
        _attached.add(sc.applicationId)
        top = Path(__file__).resolve().parent
        out = os.path.join(tempfile.mkdtemp(prefix="emberlog-"), "emberlog.zip")
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent).as_posix())
        sc.addPyFile(out)
    return spark


def session(master: str = "local[*]", app: str = "emberlog", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; conf: further settings, dots as double underscores."""
    builder = SparkSession.builder.master(master).appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return attach(builder.getOrCreate())
