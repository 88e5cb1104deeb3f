"""What the training-data operators share: white space, and the library's lineage cuts and checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.shared import cut, new_path, shared_dir, small

__all__ = ["SPACE", "WORD_RE", "cut", "new_path", "shared_dir", "small", "whole"]

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
