"""Plug-ins from a file outside the library (2.15): imported on the driver, and found by Python workers."""

from __future__ import annotations

import importlib.util
import os
import sys
from types import ModuleType

from pyspark.sql import SparkSession


def load(spark: SparkSession, path: str) -> ModuleType:
    """The module in a file. What it registers is registered; its functions may run in tasks, as the file is sent to them under its name.

    A name that another loaded module has is an error, unless that is the same file, which is returned as it stands.
    """
    path = os.path.abspath(os.path.expanduser(path))
    name = os.path.basename(path).split(".", 1)[0]
    known = sys.modules.get(name)
    if known is not None:
        if getattr(known, "__file__", None) != path:
            raise ImportError(f"another module is named {name}")
        return known
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    sys.modules[name] = module
    try:
        spec.loader.exec_module(module)
    except BaseException:
        del sys.modules[name]
        raise
    spark.sparkContext.addPyFile(path)
    return module
