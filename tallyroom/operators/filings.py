"""Filing receipts: spend trees, levy tables and per-capita figures.

Input is the long fact table ``(code, line, cents)`` for spend and
``(code, tier, class, measure, cents)`` for levies, one row per address (see
``gates.single_valued``). Amounts are whole cents, so sums are exact in any
order and identities compare integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.operators.gates import first_reason
from tallyroom.operators.skew import hot_keys, spread_join

# Addresses, tolerances and floors of the filing format.
SPEND_ADDRESS = r"^slc\.40X\.L(\d{4})\.C01\.07$"
LEVY_ADDRESS = r"^slc\.26A\.L(\d{4})\.C01\.(\d{2})$"
POPULATION_ADDRESS = "slc.02X.L0041.C01.01"
GRAND_LINE = "9910"
OTHER_GROUP = "1999"
TOLERANCE_CENTS = 51
POPULATION_FLOOR = 5000
EDUCATION_RATE = 0.00153
EDUCATION_RATE_TOLERANCE = 0.00005
PROPERTY_CLASSES = {
    "0010": "Residential",
    "0050": "Multi-residential",
    "0110": "Farmland",
    "0140": "Managed forests",
    "0210": "Commercial",
    "0310": "Parking lot",
    "0320": "Office building",
    "0340": "Shopping centre",
    "0510": "Industrial",
    "0610": "Large industrial",
    "0705": "Landfill",
    "0710": "Pipelines",
}
RESIDENTIAL = "0010"
MEASURES = {
    "02": "weighted_assessment",
    "03": "total_taxes",
    "04": "lower_or_single_tier",
    "05": "upper_tier",
    "06": "education",
    "16": "assessment",
}
TIER_LABELS = {"LT": "lower-tier", "ST": "single-tier", "UT": "upper-tier"}


def group_of(line: Column) -> Column:
    """The rollup line a component belongs to: its two leading digits and 99."""
    return F.concat(F.substring(line, 1, 2), F.lit("99"))


def spend_groups(facts: DataFrame) -> DataFrame:
    """One row per filer and group: printed rollup, component sum and count; the
    grand total travels as a group of its own (``grand`` set, nothing else).

    Partial aggregation reduces a filer of any size to at most one row per
    two-digit group before the shuffle.
    """
    line, amount = F.col("line"), F.col("cents")
    grand = line == GRAND_LINE
    rollup = line.endswith("99")
    part = ~rollup & ~grand
    return facts.groupBy("code", F.when(~grand, group_of(line)).alias("grp")).agg(
        F.max(F.when(rollup, amount)).alias("printed"),
        F.coalesce(F.sum(F.when(part, amount)), F.lit(0)).cast("bigint").alias("parts"),
        F.count(F.when(part, F.lit(1))).alias("n_parts"),
        F.max(F.when(grand, amount)).alias("grand"),
    )


def group_identity(groups: DataFrame, tolerance: int = TOLERANCE_CENTS) -> DataFrame:
    """Components against the printed rollup of their group."""
    other = F.col("grp") == OTHER_GROUP
    # Lines of the group without a rollup are never its members, printed or not.
    gap = F.when(other, F.lit(0)).otherwise(F.col("parts")) - F.col("printed")
    return (
        groups.filter("grp IS NOT NULL").drop("grand").withColumn("difference", gap)
        .withColumn(
            "reason",
            F.when(~other & F.col("printed").isNull(), "no-rollup")
            .when(F.abs(gap) > tolerance, "parts-differ"),
        )
        .withColumn("status", F.when(F.col("reason").isNull(), "accepted").otherwise("refused"))
    )


def spend_totals(facts: DataFrame, tolerance: int = TOLERANCE_CENTS) -> DataFrame:
    """Per filer: totals and the refusal ladder in filing order — missing grand
    total, orphan components, group identity (first group by code), grand
    identity."""
    body, other = F.col("grp").isNotNull(), F.col("grp") == OTHER_GROUP
    named = body & ~other
    orphan = named & F.col("printed").isNull()
    # A printed rollup of the other group has no members and is judged like any group.
    members = F.when(other, F.lit(0)).otherwise(F.col("parts"))
    off = body & F.col("printed").isNotNull() & (F.abs(members - F.col("printed")) > tolerance)
    joined = spend_groups(facts).groupBy("code").agg(
        F.max("grand").alias("grand"),
        # at most one hundred two-digit groups exist, so this set is bounded
        F.array_join(F.array_sort(F.collect_set(F.when(orphan, F.col("grp")))), ",").alias("orphans"),
        F.min(F.when(off, F.col("grp"))).alias("bad_group"),
        F.coalesce(F.sum(F.when(body, F.col("printed"))), F.lit(0)).cast("bigint").alias("functions_cents"),
        F.coalesce(F.sum(F.when(other, F.col("parts"))), F.lit(0)).cast("bigint").alias("other_cents"),
        F.max(F.when(body, F.col("printed"))).alias("largest_function"),
        F.min(F.when(body, F.col("printed"))).alias("smallest_function"),
    )
    return joined.withColumn(
        "reason",
        first_reason([
            ("missing grand total", F.col("grand").isNull()),
            ("component lines without a published rollup", F.col("orphans") != ""),
            ("components do not sum to their group", F.col("bad_group").isNotNull()),
            (
                "functions plus other do not sum to the grand total",
                F.abs(F.col("functions_cents") + F.col("other_cents") - F.col("grand")) > tolerance,
            ),
        ]),
    ).withColumn("status", F.when(F.col("reason").isNull(), "accepted").otherwise("refused"))


def share_policy(totals: DataFrame) -> DataFrame:
    """Whether an accepted filer's shares may be shown, and why not.

    No share without a positive total; none when a part exceeds the whole; a
    negative part keeps its share and gets a note.
    """
    whole = F.col("grand")
    largest = F.greatest(F.coalesce("largest_function", F.lit(0)), F.col("other_cents"))
    smallest = F.least(F.coalesce("smallest_function", F.lit(0)), F.col("other_cents"))
    # Shares are judged at the six places they are published with.
    def share(x: Column) -> Column:
        return F.round(x.cast("decimal(20,0)") / whole.cast("decimal(20,0)"), 6)

    return (
        totals.filter(F.col("status") == "accepted")
        .withColumn(
            "policy",
            F.when(whole <= 0, "withheld-no-positive-total")
            .when(share(largest) > 1, "withheld-part-exceeds-whole")
            .when(share(smallest) < 0, "reported-with-negative-note")
            .otherwise("reported"),
        )
        .withColumn("shares_reported", F.col("policy").startswith("reported"))
        .select("code", "grand", "functions_cents", "other_cents", "policy", "shares_reported")
    )


def nest_spend(facts: DataFrame) -> DataFrame:
    """Filer → groups → components, ordered by code.

    The address space bounds both levels (two digits each) because an address
    occurs once per filer.
    """
    line = F.col("line")
    body = facts.filter(line != GRAND_LINE)
    groups = body.groupBy("code", group_of(line).alias("grp")).agg(
        F.max(F.when(line.endswith("99"), F.col("cents"))).alias("printed"),
        F.sort_array(F.collect_list(F.when(~line.endswith("99"), F.struct("line", "cents")))).alias("components"),
    )
    total = F.coalesce(
        F.when(F.col("grp") != OTHER_GROUP, F.col("printed")),
        F.aggregate("components", F.lit(0).cast("bigint"), lambda acc, c: acc + c["cents"]),
    )
    return (
        groups.withColumn("amount", total)
        .groupBy("code")
        .agg(F.sort_array(F.collect_list(F.struct("grp", "amount", "components"))).alias("functions"))
    )


def comparability(population: Column, tier: Column, floor: int = POPULATION_FLOOR) -> Column:
    """Blockers of a cross-filer reading; the tier blocker always stands."""
    return F.array_compact(F.array(
        F.concat(F.lit("tier-scope-differs:"), F.coalesce(tier, F.lit(""))),
        F.when(population < floor, F.lit("population-below-declared-floor")),
    ))


def per_capita(cents: Column, population: Column) -> Column:
    """Money per head at two places, null without a positive population."""
    safe = F.when(population > 0, population)
    return F.round(
        F.try_divide(cents.cast("decimal(20,0)"), safe.cast("decimal(20,0)")) / F.lit(100).cast("decimal(3,0)"), 2
    ).cast("decimal(20,2)")


def measure_pivot(facts: DataFrame, keys: list[str], measures: dict[str, str]) -> DataFrame:
    """Long to wide with a declared measure list, in one aggregation."""
    return facts.groupBy(*keys).agg(*[
        F.max(F.when(F.col("measure") == code, F.col("cents"))).alias(name) for code, name in measures.items()
    ])


def levy_verdicts(facts: DataFrame, tolerance: int = TOLERANCE_CENTS) -> DataFrame:
    """Levy receipt per filer with its ladder: upper tier, no assessment, no
    education, rate outside the provincial constant, class parts, no classes,
    and no residential total."""
    # All rows of a filer stay in, so an upper tier without a listed class is
    # still seen; unlisted classes count for nothing but the tier.
    wide = facts.groupBy("code", "class").agg(
        F.max("tier").alias("tier"),
        *[F.max(F.when(F.col("measure") == code, F.col("cents"))).alias(name) for code, name in MEASURES.items()],
    )
    parts = (
        F.coalesce("lower_or_single_tier", F.lit(0))
        + F.coalesce("upper_tier", F.lit(0))
        + F.coalesce("education", F.lit(0))
    )
    home = F.col("class") == RESIDENTIAL
    counted = F.col("class").isin(list(PROPERTY_CLASSES)) & F.col("total_taxes").isNotNull()
    filers = wide.groupBy("code").agg(
        F.max("tier").alias("tier"),
        F.max(F.when(home, F.col("assessment"))).alias("assessment"),
        F.max(F.when(home, F.col("education"))).alias("education"),
        F.max(F.when(home, F.col("total_taxes"))).alias("total_taxes"),
        F.max(F.when(home, F.coalesce("lower_or_single_tier", F.lit(0)))).alias("lower_or_single_tier"),
        F.max(F.when(home, F.coalesce("upper_tier", F.lit(0)))).alias("upper_tier"),
        F.min(F.when(counted & (F.abs(parts - F.col("total_taxes")) > tolerance), F.col("class"))).alias("bad_class"),
        F.count(F.when(counted, F.lit(1))).alias("n_classes"),
    )
    rate = F.try_divide(F.col("education").cast("double"), F.col("assessment").cast("double"))
    return (
        filers.withColumn("education_rate", rate)
        .withColumn(
            "reason",
            first_reason([
                ("upper tier levies through its members", F.coalesce(F.col("tier") == "UT", F.lit(False))),
                ("no residential assessment", F.coalesce(F.col("assessment") <= 0, F.lit(True))),
                ("no residential education levy", F.col("education").isNull()),
                (
                    "education rate outside the provincial constant",
                    F.abs(F.col("education_rate") - F.lit(EDUCATION_RATE)) > F.lit(EDUCATION_RATE_TOLERANCE),
                ),
                ("class parts do not sum to the printed total", F.col("bad_class").isNotNull()),
                ("no taxable property class", F.coalesce(F.col("n_classes") == 0, F.lit(True))),
                ("residential class has no printed total", F.col("total_taxes").isNull()),
            ]),
        )
        .withColumn("status", F.when(F.col("reason").isNull(), "accepted").otherwise("refused"))
    )


def levy_shares(verdicts: DataFrame) -> DataFrame:
    """Residential split of an accepted levy receipt at six places."""
    whole = F.when(F.col("total_taxes") > 0, F.col("total_taxes")).cast("decimal(20,0)")

    def share(name: str) -> Column:
        return F.round(F.col(name).cast("decimal(20,0)") / whole, 6).cast("decimal(18,6)").alias(f"{name}_share")

    return verdicts.filter("status = 'accepted'").select(
        "code", "total_taxes", share("lower_or_single_tier"), share("upper_tier"), share("education"), "education_rate"
    )


def materiality(lines: DataFrame, key: str, floor_share: float = 0.0025) -> DataFrame:
    """Each line against the materiality floor of its levy."""
    levy = lines.groupBy(key).agg(F.sum("cents").cast("bigint").alias("levy"), F.count(F.lit(1)).alias("_n"))
    share = F.col("cents").cast("double") / F.col("levy").cast("double")
    joined = spread_join(lines, levy.drop("_n"), [key], "inner", hot=hot_keys(levy, [key], "_n"))
    return joined.withColumn("material", F.col("levy").isNotNull() & (share >= floor_share))
