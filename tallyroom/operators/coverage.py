"""Provenance, coverage counts, reconciled totals and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.operators.gates import first_reason
from tallyroom.operators.skew import spread_join


def provenance_verdicts(records: DataFrame, snapshots: DataFrame, catalog: DataFrame, national) -> DataFrame:
    """``records(record, source_id, adapter, jurisdiction)`` to their snapshot
    and catalog row. ``national`` is the jurisdiction every record may use. A
    source behind very many records is a hot key; snapshot and catalog meet
    first, so the records are joined once.
    """
    sources = snapshots.select(
        "source_id", F.lit(True).alias("_snap"), F.col("adapter").alias("_sa"), F.col("jurisdiction").alias("_sj"), F.col("approved").alias("_ok")
    ).join(catalog.select("source_id", F.lit(True).alias("_cat"), F.col("adapter").alias("_ca")), "source_id", "full")
    differs = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    return spread_join(records, sources, ["source_id"], "left", spread_on=["record"]).select(
        "record",
        first_reason([
            ("no snapshot", F.col("_snap").isNull()),
            ("source is not in the catalog", F.col("_cat").isNull()),
            ("snapshot and catalog adapters differ", differs("_sa", "_ca")),
            ("record and snapshot adapters differ", differs("_sa", "adapter")),
            ("licence is not approved", ~F.col("_ok")),
            ("source belongs to another jurisdiction", (F.col("_sj") != national) & differs("_sj", "jurisdiction")),
        ]).alias("reason"),
    )


def layer_verdicts(layers: DataFrame, observed: DataFrame) -> DataFrame:
    """Evidence rules of coverage layers.

    ``layers(jurisdiction, layer, status, sources, expected)`` and
    ``observed(jurisdiction, layer, bodies)``: a claimed layer names a source, a
    partial one has a verified body, a complete one has exactly the expected
    number of them.
    """
    claimed = F.col("status").isin("partial", "complete")
    bodies = F.coalesce("bodies", F.lit(0))
    return layers.join(observed, ["jurisdiction", "layer"], "left").select(
        "jurisdiction", "layer", "status",
        first_reason([
            ("claimed coverage requires a locked source", claimed & (F.coalesce(F.size("sources"), F.lit(0)) < 1)),
            ("partial coverage requires a verified body", (F.col("status") == "partial") & (bodies < 1)),
            ("complete coverage requires an expected count", (F.col("status") == "complete") & (F.coalesce("expected", F.lit(0)) < 1)),
            ("complete coverage has another count", (F.col("status") == "complete") & (bodies != F.col("expected"))),
        ]).alias("reason"),
    )


def layer_cover(layers: DataFrame, required: list[str]) -> DataFrame:
    """Whether each jurisdiction of ``layers(jurisdiction, layer)`` states exactly
    the required layers, each once: what is missing and what is unexpected or
    repeated. Only the required layers are gathered by name, so no list grows
    with the rows."""
    known = F.col("layer").isin(required)
    held = layers.groupBy("jurisdiction").agg(
        F.collect_set(F.when(known, F.col("layer"))).alias("_held"), F.count(F.when(known, F.lit(1))).alias("_known"),
        F.count(F.when(F.coalesce(~known, F.lit(True)), F.lit(1))).alias("unexpected"),
    )
    missing = F.array_join(F.array_except(F.array(*[F.lit(r) for r in sorted(required)]), F.col("_held")), ", ")
    repeated = F.col("_known") - F.size("_held")
    return held.select(
        "jurisdiction", missing.alias("missing"), "unexpected", repeated.cast("bigint").alias("repeated"),
        first_reason([
            ("a required layer is missing", missing != ""), ("a layer is unexpected", F.col("unexpected") > 0), ("a layer is repeated", repeated > 0),
        ]).alias("reason"),
    )


def counts_by(rows: DataFrame, sets: list[list[str]], date: str) -> DataFrame:
    """Counts and newest date for several groupings in one pass."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(
        F.count(F.lit(1)).alias("records"), F.max(date).alias("newest")
    ).select(*columns, "records", "newest")


def three_totals(official: DataFrame, emitted: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Official, emitted and active counts per key and the first disagreement."""
    n = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    joined = n(official, "official").join(n(emitted, "emitted"), key, "left").join(n(active, "active"), key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select(key, "official", zero("emitted"), zero("active")).withColumn(
        "unmatched", F.col("official") - F.col("emitted")
    ).withColumn(
        "reason",
        first_reason([
            ("official and emitted differ", F.col("official") != F.col("emitted")),
            ("emitted and active differ", F.col("emitted") != F.col("active")),
        ]),
    )


def progress_report(stages: DataFrame, key: str, stage: str) -> DataFrame:
    """Completed stages, open stages and readiness per key, and one total row.

    ``stages`` has one row per key and stage, so a list of open stages is as
    long as the declared stage list.
    """
    open_stage = F.when(F.col("status") != "complete", F.col(stage))
    rows = stages.groupBy(key).agg(
        F.count(F.lit(1)).alias("stages"), F.count(F.when(F.col("status") == "complete", F.lit(1))).alias("completed"),
        F.array_sort(F.collect_list(open_stage)).alias("_open"),
    ).select(
        key, "stages", "completed",
        F.array_join(F.transform("_open", lambda s: s.cast("string")), ",").alias("blockers"), (F.size("_open") == 0).alias("ready"),
    )
    total = rows.agg(
        F.sum("stages").alias("stages"), F.sum("completed").alias("completed"), F.count(F.when(F.col("ready"), F.lit(1))).alias("_r"),
        F.count(F.lit(1)).alias("_n"), F.bool_and("ready").alias("ready"),
    ).select(
        F.lit(None).cast(stages.schema[key].dataType).alias(key), "stages", "completed",
        F.concat(F.col("_r").cast("string"), F.lit(" of "), F.col("_n").cast("string"), F.lit(" ready")).alias("blockers"), "ready",
    )
    return rows.unionByName(total)
