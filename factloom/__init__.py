"""A fact store with hybrid retrieval, and operators for preparing training data, on Spark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Make this package known to the executors' Python workers: once per application, and only where it isn't
    on the workers' path anyway (``PYTHONPATH``, or installed)."""
    application, root = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    installed = root.parent.name in ("site-packages", "dist-packages")
    on_path = any(p and Path(p).resolve() == root.parent for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if application in _SHIPPED or installed or on_path:
        return
    folder = tempfile.mkdtemp(prefix="factloom-")  # the driver serves the archive from here as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "factloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(application)
