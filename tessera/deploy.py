"""Brings this package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

TOP = Path(__file__).resolve().parent


def importable(master: str) -> bool:
    """Whether workers find the package by themselves: they run on this machine, in this folder or with it in PYTHONPATH."""
    home = str(TOP.parent)
    paths = [os.path.realpath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    return master.startswith("local") and (os.path.realpath(os.getcwd()) == home or home in paths)


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's files once, unless workers can import it anyway."""
    context = spark.sparkContext
    if importable(context.master) or getattr(context, "_tessera_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(TOP.rglob("*.py")):
            z.write(file, file.relative_to(TOP.parent))
    context.addPyFile(str(target))
    context._tessera_shipped = True
