"""The package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame


def shipped(frame: DataFrame) -> DataFrame:
    """The frame, once its session's Python workers can import this package wherever they run.

    Where the package is installed on every machine this changes nothing; else Spark hands it out with the tasks.
    """
    context = frame.sparkSession.sparkContext
    if not getattr(context, "_lexisift_shipped", False):
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="lexisift-")) / "lexisift.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(target))
        context._lexisift_shipped = True
    return frame
