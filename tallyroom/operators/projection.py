"""Publishing a subset: allow-listed fields, approved findings, denied keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _keep(value: Column, fields: dict) -> Column:
    return F.struct(*[
        (value[name] if inner is None else _keep(value[name], inner)).alias(name) for name, inner in fields.items()
    ])


def allow_listed(df: DataFrame, column: str, fields: dict) -> DataFrame:
    """Only the named fields of a nested record; ``fields`` maps a name to None
    or to the fields of the inner record."""
    return df.withColumn(column, _keep(F.col(column), fields))


def approved_findings(receipts: DataFrame, findings: DataFrame, key: str, finding: str, approved: str) -> DataFrame:
    """Findings that their receipt lists in the array ``approved``, of receipts
    whose review is approved, signed and dated (blank is neither)."""
    filled = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    signed = receipts.filter((F.col("review") == "approved") & filled("reviewer") & filled("reviewed_at"))
    listed = signed.select(key, F.explode(approved).alias(finding)).distinct()
    return findings.select(key, finding).distinct().join(listed, [key, finding], "left_semi")


def key_form(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


# A string literal and, for a key, the colon after it: scanning whole literals
# keeps text inside values from looking like a key.
JSON_STRING = r'"(?:[^"\\]|\\.)*"\s*:?'


def json_keys(document: Column) -> Column:
    """Keys at any depth of a JSON text, as written."""
    literals = F.regexp_extract_all(document, F.lit(JSON_STRING), F.lit(0))
    return F.transform(
        F.filter(literals, lambda s: s.endswith(":")), lambda s: F.regexp_extract(s, r'^"(.*)"\s*:$', 1)
    )


def denied_keys(df: DataFrame, document: str, denied: list[str]) -> DataFrame:
    """One row per denied key found anywhere in the document, key as written."""
    return df.withColumn("found_key", F.explode(json_keys(F.col(document)))).filter(
        key_form(F.col("found_key")).isin(denied)
    )


def denied_columns(schema: T.DataType, denied: list[str], path: str = "$") -> list[str]:
    """The same rule for typed data: paths of denied fields in a schema."""
    found = []
    if isinstance(schema, T.StructType):
        for field in schema.fields:
            here = f"{path}.{field.name}"
            if "".join(ch for ch in field.name.lower() if ch.isalnum()) in denied:
                found.append(here)
            found += denied_columns(field.dataType, denied, here)
    elif isinstance(schema, T.ArrayType):
        found += denied_columns(schema.elementType, denied, f"{path}[]")
    elif isinstance(schema, T.MapType):
        found += denied_columns(schema.valueType, denied, f"{path}{{}}")
    return found
