"""Session functions for SQL users. All are SQL expressions, so Spark inlines them into the query."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .masks import MaskSet
from .names import DEVICE_NAMES
from .text import CONFLICT_INFIX, parent_sql

_NFC = (
    "CASE WHEN octet_length(p) <> char_length(p) THEN reflect('com.ibm.icu.text.Normalizer', 'compose', p, false) ELSE p END"
)


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _function(spark: SparkSession, signature: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def register_sql(spark: SparkSession) -> list[str]:
    """Create norm_key, exact_key, path_parent, path_name, path_depth, is_conflict_copy and windows_name_fault."""
    devices = "(?i)^(" + "|".join(DEVICE_NAMES) + r")(\..*)?$"
    fault = f"""element_at(filter(transform(split(p, '/'), s -> CASE
        WHEN s RLIKE {_quoted(r'[. ]\z')} OR instr(s, ':') > 0 THEN 'mangled'
        WHEN s RLIKE {_quoted(r'[<>"|?*\\\x00-\x1f]')} THEN 'rejected'
        WHEN s RLIKE {_quoted(devices)} THEN 'unusable' END), f -> f IS NOT NULL), 1)"""
    fault = fault.replace("element_at(", "try_element_at(", 1)
    made = {
        "norm_key(p STRING) RETURNS STRING": f"upper({_NFC})",
        "exact_key(p STRING) RETURNS STRING": _NFC,
        "path_parent(p STRING) RETURNS STRING": parent_sql("p"),
        "path_name(p STRING) RETURNS STRING": "substring_index(p, '/', -1)",
        "path_depth(p STRING) RETURNS INT": "length(p) - length(replace(p, '/', ''))",
        "is_conflict_copy(p STRING) RETURNS BOOLEAN": f"contains(substring_index(p, '/', -1), '{CONFLICT_INFIX}')",
        "windows_name_fault(p STRING) RETURNS STRING": fault,
    }
    for signature, body in made.items():
        _function(spark, signature, body)
    return [s.split("(")[0] for s in made]


def register_masks(spark: SparkSession, name: str, masks: list[str]) -> None:
    """Create `name`(path): whether any of the masks hits the file."""
    regex = MaskSet.of([m for m in masks if m.strip()]).file_regex()
    _function(spark, f"{name}(p STRING) RETURNS BOOLEAN", f"upper({_NFC}) RLIKE {_quoted(regex)}")
