"""What a session needs so that Python workers find this package."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PACKAGE = os.path.basename(os.path.dirname(os.path.abspath(__file__)))

#: Spark contexts (by application) that have the package's archive.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even if the caller only extended ``sys.path``.

    Workers on this machine get the path; a cluster gets an archive of the package through Spark's own file service.
    """
    context = spark.sparkContext
    if not context.master.startswith("local"):
        if context.applicationId not in _SHIPPED:
            context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), PACKAGE), "zip", ROOT, PACKAGE))
            _SHIPPED.add(context.applicationId)
        return
    env = context.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
