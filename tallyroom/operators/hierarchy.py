"""Geography hierarchy, governing bodies and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.operators.gates import first_reason
from tallyroom.operators.skew import hot_keys, spread_join
from tallyroom.session import cut_lineage

# Code length and parent code length of each geography level.
LEVELS = {1: "region", 2: "province-territory", 4: "census-division", 7: "census-subdivision"}
PARENT_LENGTH = {2: 1, 4: 2, 7: 4}
PARENT_LEVEL = {"province-territory": "region", "census-division": "province-territory", "census-subdivision": "census-division"}


def build_levels(df: DataFrame, code: str, levels: dict[int, str] = LEVELS, parents: dict[int, int] = PARENT_LENGTH) -> DataFrame:
    """Level from the code length and parent code by prefix."""
    size = F.length(code)
    level = F.coalesce(*[F.when(size == n, F.lit(name)) for n, name in levels.items()])
    parent = F.coalesce(*[F.when(size == n, F.substring(code, 1, p)) for n, p in parents.items()])
    return df.withColumn("level", level).withColumn("parent_code", parent)


def hierarchy_verdicts(nodes: DataFrame, parent_level: dict[str, str], parent_length: dict[str, int]) -> DataFrame:
    """``nodes(code, level, parent_code)``: the parent exists, has the level
    above and its code is the prefix. A parent of very many children is a hot
    key of this join."""
    parents = nodes.select(F.col("code").alias("parent_code"), F.col("level").alias("_plevel"))
    roots = nodes.filter(~F.col("level").isin(list(parent_level)))
    children = nodes.filter(F.col("level").isin(list(parent_level)))
    joined = spread_join(children, parents, ["parent_code"], "left", spread_on=["code"])
    want = F.coalesce(*[F.when(F.col("level") == l, F.lit(p)) for l, p in parent_level.items()])
    prefix = F.coalesce(*[F.when(F.col("level") == l, F.substring("code", 1, n)) for l, n in parent_length.items()])
    judged = joined.select(
        "code", "level", "parent_code",
        first_reason([
            ("parent is required", F.col("parent_code").isNull()),
            ("parent is absent", F.col("_plevel").isNull()),
            ("parent has the wrong level", F.col("_plevel") != want),
            ("parent code is not the prefix", F.col("parent_code") != prefix),
        ]).alias("reason"),
    )
    top = roots.select(
        "code", "level", "parent_code", F.when(F.col("parent_code").isNotNull(), "root cannot have a parent").alias("reason")
    )
    return judged.unionByName(top)


def incompatible(bodies: DataFrame, allowed: dict[str, list[str]], body_type: str, tier: str) -> DataFrame:
    """Bodies whose tier the matrix does not allow; an unknown type allows none."""
    ok = F.lit(False)
    for kind, tiers in allowed.items():
        ok = ok | ((F.col(body_type) == kind) & F.col(tier).isin(tiers))
    return bodies.filter(~F.coalesce(ok, F.lit(False)))


def body_geographies(bodies: DataFrame, geographies: DataFrame) -> DataFrame:
    """``bodies(body, province, geography_ids)`` against
    ``geographies(geography, geo_province)``: each claim known and in the
    body's province."""
    claims = bodies.select("body", "province", F.explode("geography_ids").alias("geography"))
    joined = spread_join(claims, geographies, ["geography"], "left", spread_on=["body"])
    return joined.select(
        "body", "geography",
        F.when(F.col("geo_province").isNull(), "unknown")
        .when(F.col("geo_province") != F.col("province"), "other-province")
        .otherwise("ok").alias("status"),
    )


def parent_verdicts(bodies: DataFrame) -> DataFrame:
    """``bodies(body, province, body_type, tier, parent_ids)``: a lower tier has
    parents, others have none, each parent exists in the same province and is an
    upper-tier regional body. One row per (body, parent), or per body without."""
    exploded = bodies.select("body", "province", "tier", F.explode_outer("parent_ids").alias("parent"))
    parents = bodies.select(
        F.col("body").alias("parent"), F.col("province").alias("_pp"), F.col("body_type").alias("_pt"), F.col("tier").alias("_ptier")
    )
    lower = F.col("tier") == "lower-tier"
    none = F.col("parent").isNull()
    return spread_join(exploded, parents, ["parent"], "left", spread_on=["body"]).select(
        "body", "parent",
        first_reason([
            ("lower tier requires a parent", lower & none),
            ("only a lower tier has parents", ~lower & ~none),
            ("unknown parent", ~none & F.col("_ptier").isNull()),
            ("parent is in another province", ~none & F.coalesce(F.col("_pp") != F.col("province"), F.lit(False))),
            (
                "parent is not an upper-tier regional body",
                ~none & ~F.coalesce((F.col("_pt") == "regional-government") & (F.col("_ptier") == "upper-tier"), F.lit(False)),
            ),
        ]).alias("reason"),
    )


def ancestor_chains(nodes: DataFrame, most: int = 64) -> DataFrame:
    """``nodes(code, parent_code)`` to (code, ancestors nearest first), up to the root.

    The chains are built on the codes that are parents, a far smaller table, by
    pointer doubling: a round appends to each chain the chain of its top, so d
    levels take about log2(d) rounds. They then meet all nodes in one join that
    spreads a parent of very many children. A node below a loop, or with more
    than ``most`` levels above it, has null ancestors; the others keep theirs.
    """
    used = nodes.filter("parent_code IS NOT NULL").select(F.col("parent_code").alias("code")).distinct()
    parents = nodes.select("code", "parent_code").join(used, "code", "left_semi")
    chains = cut_lineage(parents.select(F.col("code").alias("parent_code"), F.array("code").alias("_chain"), F.col("parent_code").alias("_top")))
    length = 1
    while length <= most and not chains.filter("_top IS NOT NULL").isEmpty():
        above = chains.select(F.col("parent_code").alias("_top"), F.col("_chain").alias("_more"), F.col("_top").alias("_next"))
        # a parent that is no node itself ends the chain
        longer = spread_join(chains, above, ["_top"], "left", spread_on=["parent_code"], hot=hot_keys(chains.filter("_top IS NOT NULL"), ["_top"]))
        chains = cut_lineage(longer.select(
            "parent_code", F.when(F.col("_more").isNull(), F.col("_chain")).otherwise(F.concat("_chain", "_more")).alias("_chain"),
            F.col("_next").alias("_top"),
        ))
        length *= 2
    whole = F.col("_top").isNull() & (F.size("_chain") <= most)
    done = chains.select("parent_code", F.when(whole, F.col("_chain")).alias("_chain"))
    below = nodes.filter("parent_code IS NOT NULL").select("code", "parent_code")
    return spread_join(below, done, ["parent_code"], "inner", spread_on=["code"]).select("code", F.col("_chain").alias("ancestors"))


def contained(claims: DataFrame, governed: DataFrame, chains: DataFrame) -> DataFrame:
    """Claims ``(body, parent, geography)`` whose geography is, or lies under, a
    geography the parent governs ``governed(parent, geography)``."""
    above = chains.select(F.col("code").alias("geography"), "ancestors")
    via = spread_join(claims, above, ["geography"], "left", spread_on=["body"]).select(
        "body", "parent", "geography",
        F.explode(F.when(F.col("ancestors").isNull(), F.array("geography")).otherwise(F.concat(F.array("geography"), F.col("ancestors")))).alias("ancestor"),
    )
    held = governed.select("parent", F.col("geography").alias("ancestor"), F.lit(True).alias("_held")).distinct()
    return spread_join(
        via, held, ["parent", "ancestor"], "left", spread_on=["body", "geography"], hot=hot_keys(claims, ["parent"])
    ).groupBy("body", "parent", "geography").agg(F.coalesce(F.bool_or("_held"), F.lit(False)).alias("contained"))


def stage_verdicts(stages: DataFrame, key: str, stage: str) -> DataFrame:
    """``stages(key, stage, status)``: completed stages form a prefix and only
    the first unfinished stage is active or blocked.

    Plain aggregates say this without ordering a group: the first open stage is
    a minimum, and a late completion is a maximum beyond it.
    """
    status = F.col("status")
    per = stages.groupBy(key).agg(
        F.min(F.when(status != "complete", F.col(stage))).alias("first_open"),
        F.max(F.when(status == "complete", F.col(stage))).alias("last_done"),
        F.max(F.when(status.isin("in-progress", "blocked"), F.col(stage))).alias("last_active"),
        F.count(F.when(status == "in-progress", F.lit(1))).alias("active"),
        F.count(F.when(status == "complete", F.lit(1))).alias("completed"),
        F.count(F.lit(1)).alias("stages"),
    )
    return per.withColumn(
        "reason",
        first_reason([
            ("completed stage follows unfinished work", F.coalesce(F.col("last_done") > F.col("first_open"), F.lit(False))),
            ("only the first unfinished stage may be active", F.coalesce(F.col("last_active") > F.col("first_open"), F.lit(False))),
            ("more than one stage in progress", F.col("active") > 1),
        ]),
    )


def coverage_status(layers: DataFrame, key: str, layer: str, status: str, administrative: list[str]) -> DataFrame:
    """Complete when every layer is complete or not applicable, partial when an
    administrative layer has evidence, else planned."""
    admin = F.col(layer).isin(administrative)
    return layers.groupBy(key).agg(
        F.bool_and(F.col(status).isin("complete", "not-applicable")).alias("_all"),
        F.bool_or(admin & F.col(status).isin("partial", "complete")).alias("_some"),
        F.count(F.lit(1)).alias("layers"),
    ).select(
        key, "layers",
        F.when(F.col("_all"), "complete").when(F.col("_some"), "partial").otherwise("planned").alias("status"),
    )
