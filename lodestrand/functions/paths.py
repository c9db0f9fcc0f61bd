"""File paths as text, without a look at any file system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(path: Column | str) -> Column:
    """An absolute path without empty components, `.` and `..`, folded over its components with a stack; `..` at the root stays there. Null and
    paths that aren't absolute are given back as they are, since what they are relative to isn't known. Links aren't followed."""
    path = F.col(path) if isinstance(path, str) else path
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    step = lambda stack, x: F.when(x == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(x)))
    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(path.startswith("/"), F.concat(F.lit("/"), F.array_join(folded, "/"))).otherwise(path)


def canonical_text(path: str) -> str:
    """canonical() of one path."""
    stack: list[str] = []
    for part in path.split("/"):
        if part == "..":
            del stack[-1:]
        elif part not in ("", "."):
            stack.append(part)
    return "/" + "/".join(stack) if path.startswith("/") else path
