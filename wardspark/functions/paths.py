"""Path column functions (``/`` separated; backslashes are normalised first)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Everything before the last ``/``; ``.`` for a bare name."""
    cut = F.length(path) - F.length(file_name(path)) - 1
    return F.when(cut >= 0, F.left(path, F.greatest(cut, F.lit(0)))).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """Suffix with its dot; empty for names such as ``.cursorrules`` or ``Makefile``."""
    return F.regexp_extract(file_name(path), r"(?s)[^.](\.[^.]+)\z", 1)


def relative_dirs(path: Column, target: Column) -> Column:
    """Directory names between the target and the file."""
    below = F.substring(path, F.length(F.rtrim(target, F.lit("/"))) + 2, F.length(path))
    dirs = F.split(below, "/")
    return F.slice(dirs, 1, F.size(dirs) - 1)
