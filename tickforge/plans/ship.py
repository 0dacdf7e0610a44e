"""Give executors this package, wherever the session's workers look for modules."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


#: Spark's default limit on the bytes of a generated method, and the one above which HotSpot doesn't compile it.
_LIMIT, _DEFAULT, _COMPILED = "spark.sql.codegen.hugeMethodLimit", "65535", "8000"


def ship(spark: SparkSession) -> SparkSession:
    """Add the package as a zip to the session's Python files, once for each application; the driver serves it to executors.

    Wide projections (parsers, encoders) make generated methods that the JVM would only interpret: where the session has no limit of its own,
    Spark runs these operator by operator instead.
    """
    context = spark.sparkContext
    if spark.conf.get(_LIMIT) == _DEFAULT:
        spark.conf.set(_LIMIT, _COMPILED)
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        path = os.path.join(tempfile.mkdtemp(prefix="tickforge-"), "tickforge_package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for f in sorted(root.rglob("*.py")):
                out.write(f, f.relative_to(root.parent))
        context.addPyFile(path)
        _SHIPPED.add(context.applicationId)
    return spark
