"""Python data-flow paths: the project flow over Python files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.operators.flow import project_paths


def python_paths(files: DataFrame) -> DataFrame:
    """files: file, text. Production Python files only. severity is one rung lower for paths that start at a parameter."""
    return project_paths(files.filter(F.lower("file").endswith(".py")))
