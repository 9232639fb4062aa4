"""Regular expressions: Spark's own by default, and a guarded way with a time limit for each distinct value."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Seconds that one value may take in the guarded way.
BUDGET = 2.0


def valid(pattern: str) -> bool:
    """Whether Java, and so Spark, accepts the pattern; without a JVM Python's reading stands in."""
    from py4j.protocol import Py4JJavaError
    from pyspark import SparkContext
    from pyspark.errors import PySparkException

    sc = SparkContext._active_spark_context
    if sc is None:
        try:
            regex.compile(pattern)
        except regex.error:
            return False
        return True
    try:
        sc._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def matches(v: Column, pattern: str) -> Column:
    """A match anywhere, without regard to case unless the pattern turns that off."""
    return v.rlike(f"(?iu){pattern}")


def guarded(rows: DataFrame, key: Column, pattern: str, budget: float = BUDGET) -> DataFrame:
    """Distinct values of a key with hit (null where the time limit ran out): each value is matched once."""
    compiled = f"(?i){pattern}"

    @pandas_udf("boolean")
    def test(s: pd.Series) -> pd.Series:
        own = regex.compile(compiled)

        def one(x):
            if x is None:
                return False
            try:
                return own.search(x, timeout=budget) is not None
            except TimeoutError:
                return None

        return s.map(one).astype("object")

    return rows.select(key.alias("value")).where("value is not null").distinct().withColumn("hit", test("value"))
