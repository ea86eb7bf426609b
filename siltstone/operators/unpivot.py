"""One row for each top-level key of a JSON object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import quoted


def unpivot_json_object(df: DataFrame, column: str, passthrough: list[str] | None = None, key_name: str = "key", value_name: str = "value") -> DataFrame:
    """Null, malformed and non-object JSON yield no rows; strings come without quotes, other values as JSON text."""
    keep = [quoted(c) for c in (passthrough if passthrough is not None else [c for c in df.columns if c != column])]
    # a map keeps each value's JSON text; it is parsed once a row, not once a key
    parsed = F.from_json(quoted(column), "map<string,string>")
    return df.select(*keep, F.explode(parsed).alias(key_name, value_name))
