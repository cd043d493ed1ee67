"""The scalar functions by name in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

# name: (arguments, type, expression)
FUNCTIONS = {
    "similarity": ("cosine DOUBLE", "DOUBLE", "(1 + cosine) / 2"),
    "half_up": ("x DOUBLE", "BIGINT", "floor(x + 0.5)"),
    "search_scale": ("n DOUBLE", "DOUBLE", "CASE WHEN n <= 19 THEN 0.168D ELSE 1.24D * cbrt(n - 15) - 1.8D END + 0.8D"),
    "final_scale": ("n DOUBLE", "DOUBLE", "greatest(0.5D, CASE WHEN n <= 21 THEN 0.5D ELSE 1.24D * cbrt(n - 15) - 1.8D END)"),
    "score_cutoff": ("n DOUBLE", "DOUBLE", "1.5D * power(n, 0.3D) + 3.5D"),
    "field_value": ("d2 DOUBLE, d0 DOUBLE", "INT", "CAST(floor(255 / (1 + d2 / (d0 * d0)) + 0.5) AS INT)"),
    "is_permutation_candidate": ("inv DOUBLE, ord DOUBLE", "BOOLEAN", "ord < 0.6D AND inv > 0.9D"),
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions for this session as SQL expressions, which the optimizer sees through."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
