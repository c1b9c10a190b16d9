"""Registry inputs: the classification structure and governing-body directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroom.functions.text import ID_FORM
from tallyroom.operators.gates import broken_rules
from tallyroom.operators.hierarchy import build_levels

# The published header and level numbers of the classification.
CLASSIFICATION_HEADER = ["Level", "Hierarchical structure", "Code", "Class title"]
LEVEL_NUMBERS = {"1": "region", "2": "province-territory", "3": "census-division", "4": "census-subdivision"}

BODY_FIELDS = {
    "id": "STRING",
    "body_type": "STRING",
    "status": "STRING",
    "official_names": "MAP<STRING, STRING>",
    "province": "STRING",
    "url": "STRING",
    "external_ids": "MAP<STRING, STRING>",
    "geography_ids": "ARRAY<STRING>",
    "legal_type": "STRING",
    "tier": "STRING",
    "parent_ids": "ARRAY<STRING>",
    "effective_from": "DATE",
    "effective_to": "DATE",
}


def read_classification(spark: SparkSession, path: str) -> DataFrame:
    """Geography rows ``(code, title, level, parent_code, reason)``. The header
    must match; a level that does not fit the code length is refused."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in CLASSIFICATION_HEADER])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("quote", '"').option("escape", '"').csv(path)
    built = build_levels(rows.select(F.trim("Code").alias("code"), F.trim("Class title").alias("title"), F.trim("Level").alias("_n")), "code")
    declared = F.coalesce(*[F.when(F.col("_n") == n, F.lit(level)) for n, level in LEVEL_NUMBERS.items()])
    return built.withColumn(
        "reason",
        F.when(~F.col("code").rlike("^[0-9]+$") | F.col("level").isNull(), "code has no level")
        .when(declared.isNull() | (declared != F.col("level")), "level does not fit the code"),
    ).drop("_n")


def governing_bodies(documents: DataFrame, document: str) -> DataFrame:
    """One body per JSON record with its unknown fields and broken rules.

    The field set is closed: a field nobody declared refuses the record.
    """
    schema = ", ".join(f"{name}: {kind}" for name, kind in BODY_FIELDS.items())
    keys = F.map_keys(F.from_json(document, "MAP<STRING, STRING>"))
    unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(f) for f in BODY_FIELDS])))
    rows = documents.select(F.from_json(document, f"STRUCT<{schema}>").alias("b"), unknown.alias("unknown")).select("b.*", "unknown")
    rules = [
        ("unknown-field", F.size("unknown") > 0),
        ("id", ~F.col("id").rlike(ID_FORM)),
        ("names", F.size("official_names") == 0),
        ("url", F.col("url").isNotNull() & ~F.col("url").startswith("https://")),
        ("repeated-geography", F.size("geography_ids") > F.size(F.array_distinct("geography_ids"))),
        ("end-before-start", F.coalesce(F.col("effective_to") < F.col("effective_from"), F.lit(False))),
    ]
    return rows.withColumn("violations", broken_rules(rules))


def external_ids(bodies: DataFrame) -> DataFrame:
    """``(scheme, value, body)`` rows; a value that two bodies claim is found
    with ``gates.duplicate_keys`` on (scheme, value)."""
    return bodies.select(F.explode("external_ids").alias("scheme", "value"), F.col("id").alias("body"))
