"""JSON cells as readable text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# The fields that are scores or ids rather than words.
SKIPPED = ("conf", "confidence", "score", "prob", "id", "bbox", "box", "xyxy", "index", "idx")


def _phrase(node) -> str:
    """The words of a cell in document order, at any depth."""
    out, left = [], [node]
    while left:
        node = left.pop()
        if isinstance(node, str) and node:
            out.append(node)
        elif isinstance(node, dict):
            left.extend(v for k, v in reversed(node.items()) if k.lower() not in SKIPPED)
        elif isinstance(node, list):
            left.extend(reversed(node))
    return ", ".join(out)


def flatten_json(cell: Column) -> Column:
    """``[{"label": "dog", "conf": 0.9}]`` becomes ``dog``; a cell that is no JSON stays as it is.

    Only cells that open like JSON travel to Python; the others cross as NULLs.
    """
    def read_cells(cells):
        def one(s):
            try:
                return None if s is None else _phrase(json.loads(s))
            except (ValueError, RecursionError):  # no JSON, or nested deeper than the parser reads
                return s
        return cells.map(one)

    read_cells.__annotations__ = {"cells": pd.Series, "return": pd.Series}
    read = F.pandas_udf(read_cells, "string")
    opens = cell.rlike(r"^\s*[\[{]")
    return F.when(opens, read(F.when(opens, cell))).otherwise(cell)


def clean_cell(cell: Column) -> Column:
    """Any source cell normalised for indexing: JSON unwrapped, handles and spaces gone."""
    return T.clean_text(flatten_json(cell))
