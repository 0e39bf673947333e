"""Ship worker-side Python code with the task instead of requiring the package
on every executor: cloudpickle serialises registered modules by value."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile

from pyspark import cloudpickle


def ship_by_value(module_name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


_SHIPPED: set[str] = set()


def ship_package(spark) -> None:
    """Send the whole package to the executors of this session, once: for code
    whose modules keep caches in the worker process (modules shipped by value
    are new in every task)."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if sc.applicationId in _SHIPPED or not os.path.isdir(root):   # already inside an archive: it was shipped
        return
    folder = tempfile.mkdtemp(prefix="chemscore-ship-")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "chemscore-package"), "zip", root, "chemscore"))
    _SHIPPED.add(sc.applicationId)
