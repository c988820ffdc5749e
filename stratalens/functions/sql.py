"""The library's scalar functions for SQL, as temporary functions of a session whose bodies are SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from stratalens.functions.text import ID_SHAPES, quoted, references

SPACE = r"(?U)[\s\x{A0}]+"
OTHER_SIGNS = r"[^\p{L}\p{N}]"
#: Name, parameter, body.
FUNCTIONS = {
    "sl_unescaped": references("t"),
    "sl_normalized": f"trim(regexp_replace(sl_unescaped(coalesce(t, '')), {quoted(SPACE)}, ' '))",
    "sl_key": "upper(sl_normalized(t))",
    "sl_identifier": f"regexp_replace(sl_key(t), {quoted(OTHER_SIGNS)}, '')",
    "sl_sha256": "sha2(coalesce(t, ''), 256)",
} | {f"sl_is_{kind}": f"coalesce(t rlike {quoted(shape)}, false)" for kind, shape in ID_SHAPES.items()}


def register(spark: SparkSession) -> list[str]:
    """Registers them in the session; returns their names. A null text counts as empty, but for sl_unescaped, which gives null."""
    for name, body in FUNCTIONS.items():
        kind = "BOOLEAN" if name.startswith("sl_is_") else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
