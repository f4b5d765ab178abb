"""The one place that builds a session for tests, the bench and scripts."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Settings that every result of this library depends on.
FIXED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}
#: Settings that only matter for a single machine.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("keepstone")
    for key, value in {**FIXED_CONF, **LOCAL_CONF}.items():
        builder = builder.config(key, value)
    session = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@functools.cache
def _archive() -> str:
    """This package as a zip file; one for each driver process."""
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="keepstone-code-")), "keepstone.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    return path


@functools.cache
def _ship(application: str, session: SparkSession) -> None:
    session.sparkContext.addPyFile(_archive())


def ship(session: SparkSession) -> None:
    """Let Python workers on executors import this package, wherever it lies on the driver; once for each application."""
    _ship(session.sparkContext.applicationId, session)


def small_batches(session: SparkSession, rows: int, size: int) -> None:
    """Bound the session's Arrow batches, of rows that are large; they are only ever made smaller."""
    for name, least in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", session.conf.get(key).lower()).groups()
        if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= least:
            session.conf.set(key, str(least))
