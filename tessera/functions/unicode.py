"""Unicode forms that Spark has no function for, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _slug(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda t: re.sub(r"[^\w-]", "", unicodedata.normalize("NFKC", t or ""))[:32] or "qa")


def nfkc(text: Column) -> Column:
    """Compatibility composition: full-width forms and ligatures become plain letters."""
    return _nfkc(text)


def slug(text: Column) -> Column:
    """At most 32 word characters and hyphens of the text's NFKC form; 'qa' if none is left."""
    return _slug(text)
