"""Lineage: closure, verification and cycles by joining a frontier.

Each round joins only the frontier and is written to the checkpoint folder, so
a lost executor replays one round. State is a set of nodes, never of pairs. The
joins of a search are not broadcast: each table would be small enough, but the
driver builds them all and holds those of many rounds until it collects its garbage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.operators.skew import FAN, hot_keys, hot_row_limit, salted_copies, spread_join
from tallyroom.session import cut_lineage


def _settled_hot(edges: DataFrame, keys: list[str]) -> DataFrame | None:
    """Hot keys of an edge table, or None when it has none: the loops join many
    times, so they look once, by one number, and skip the salting when there is nothing to spread."""
    most = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return cut_lineage(hot_keys(edges, keys)) if (most or 0) > hot_row_limit(edges) else None


def _join(big: DataFrame, small: DataFrame, key: str, how: str, spread_on: str, hot: DataFrame | None) -> DataFrame:
    return big.join(small, key, how) if hot is None else spread_join(big, small, [key], how, spread_on=[spread_on], hot=hot)


def _sorted(df: DataFrame) -> DataFrame:
    """A side of a join that is sorted on the executors, however small."""
    return df.hint("merge")


class _Links:
    """Edges written once, the out-edges of a hub spread over salts, for joins
    with one frontier after another."""

    def __init__(self, edges: DataFrame, src: str = "src", dst: str = "dst", hot: DataFrame | None | str = "look"):
        self.rows = cut_lineage(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
        self.hot = _settled_hot(self.rows, ["src"]) if isinstance(hot, str) else hot
        if self.hot is not None:
            salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("dst"), F.lit(FAN)).cast("int")).otherwise(F.lit(0))
            self.rows = cut_lineage(self.rows.join(self.hot, "src", "left").select("src", "dst", salt.alias("_salt")))

    def follow(self, frontier: DataFrame, how: str = "left_semi") -> DataFrame:
        """Edges that leave the frontier ``(src, …)``."""
        if self.hot is None:
            return self.rows.join(_sorted(frontier), "src", how)
        return self.rows.join(_sorted(salted_copies(frontier, self.hot)), ["src", "_salt"], how)


def reachable(
    start: DataFrame, edges: DataFrame | _Links, node: str = "node", src: str = "src", dst: str = "dst", by: tuple[str, ...] = ()
) -> DataFrame:
    """Every node reached from ``start`` along ``edges``, with its least number
    of steps; for each value of the columns ``by`` of ``start``, which hold no nulls."""
    links = edges if isinstance(edges, _Links) else _Links(edges, src, dst)
    frontier = cut_lineage(start.select(node, *by).distinct().withColumn("steps", F.lit(0)))
    seen, step = frontier, 0
    while not frontier.isEmpty():
        step += 1
        reached = links.follow(frontier.select(F.col(node).alias("src"), *by), "inner" if by else "left_semi")
        reached = reached.select(F.col("dst").alias(node), *by).distinct()
        frontier = cut_lineage(reached.join(_sorted(seen), [node, *by], "left_anti").withColumn("steps", F.lit(step)))
        seen = seen.unionByName(frontier)
    return seen


def _hops(near: DataFrame, by: DataFrame) -> DataFrame:
    """``near(node, one, two)`` with three and four hops from ``by``; where the
    strand ends the last node stands for the rest."""
    far = by.select(F.col("node").alias("two"), F.col("one").alias("_a"), F.col("two").alias("_b"))
    return spread_join(near, _sorted(far), ["two"], "left", spread_on=["node"], hot=_settled_hot(near, ["two"])).select(
        "node", "one", "two", F.coalesce("_a", "two").alias("three"), F.coalesce("_b", "two").alias("four"), F.col("_a").isNotNull().alias("_open")
    )


def _strands(steps: DataFrame) -> list[DataFrame]:
    """Jumps along nodes with a single way on, ``steps(node, next)``: table k
    holds one, two, three and four jumps of 4^k steps. The last table reaches
    every end; a ring has none and stops after as many steps as there are nodes."""
    tables, size, width = [], steps.count(), 1
    jump = steps
    while size:
        far = jump.select(F.col("node").alias("next"), F.col("next").alias("_far"))
        twice = spread_join(jump, _sorted(far), ["next"], "left", spread_on=["node"], hot=_settled_hot(jump, ["next"])).select(
            "node", F.col("next").alias("one"), F.coalesce("_far", "next").alias("two")
        )
        twice = cut_lineage(twice)
        table = cut_lineage(_hops(twice, twice))
        tables.append(table.drop("_open"))
        width *= 4
        if width >= size or table.filter("_open").isEmpty():
            break
        jump = table.select("node", F.col("four").alias("next"))
    return tables


def _landings(steps: DataFrame, last: DataFrame) -> DataFrame:
    """``(node, end)`` for the nodes with one way on: where their strand ends, or
    null in a ring, which leads nowhere else."""
    ends = last.select("node", F.col("four").alias("end"))
    ring = steps.select(F.col("node").alias("end"), F.lit(True).alias("_ring"))
    found = spread_join(ends, _sorted(ring), ["end"], "left", spread_on=["node"], hot=_settled_hot(ends, ["end"]))
    return cut_lineage(found.select("node", F.when(F.col("_ring").isNull(), F.col("end")).alias("end"), F.lit(True).alias("_strand")))


def reached(
    start: DataFrame, edges: DataFrame | _Links, node: str = "node", src: str = "src", dst: str = "dst", worth: int = 2,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Every node reached from ``start`` along ``edges``, in rounds that do not grow with the
    length of unbranched strands.

    Nodes with one way on are jumped over by doubled pointers: every way out of a
    branching node is led to the end of its strand once, and the search goes
    from branching node to branching node along these ways alone. The nodes in between are
    marked last, long jumps before short ones. State is one row per node and
    table; a strand of n nodes takes log4(n) tables and as many marking rounds.
    Where all strands end within ``worth`` - 1 tables, the plain search is as short.
    Start sets told apart by the columns ``by``, which hold no nulls, share the
    strands and the rounds.
    """
    links = edges if isinstance(edges, _Links) else _Links(edges, src, dst)
    ways = links.rows.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.min("dst").alias("next"))
    steps = cut_lineage(ways.filter("_n = 1 AND next <> node").select("node", "next"))
    tables = _strands(steps)
    if len(tables) < max(worth, 1):
        return reachable(start, links, node, by=by).select(node, *by)
    landings, keep = _landings(steps, tables[-1]), "_strand IS NULL OR end IS NOT NULL"
    land = F.when(F.col("_strand"), F.col("end")).otherwise(F.col("node")).alias("node")
    entries = start.select(F.col(node).alias("node"), *by).distinct()
    first = entries.join(_sorted(landings), "node", "left").filter(keep).select(land, *by)
    turns = spread_join(
        links.rows.select("src", "dst"), _sorted(steps.select(F.col("node").alias("src"))), ["src"], "left_anti", spread_on=["dst"], hot=links.hot
    ).select("src", F.col("dst").alias("node"))
    hot = _settled_hot(links.rows.select(F.col("dst").alias("node")), ["node"])
    led = spread_join(turns, _sorted(landings), ["node"], "left", spread_on=["src"], hot=hot).filter(keep).select("src", land)
    landed = reachable(first, _Links(led, dst="node"), by=by).select(F.col("node").alias("src"), *by)
    out = links.follow(landed, "inner" if by else "left_semi").select(F.col("dst").alias("node"), *by)
    marked = cut_lineage(entries.unionByName(out).distinct())
    for table in reversed(tables):
        passed = marked.join(_sorted(table), "node").select(F.explode(F.array("node", "one", "two", "three", "four")).alias("node"), *by)
        marked = cut_lineage(marked.unionByName(passed).distinct())
    return marked.select(F.col("node").alias(node), *by)


def lineage_verified(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(node, is_leaf, verified)``: whether all leaves below a node are
    verified, and whether any is. Both are reachability against the edges, in one
    search."""
    leaves = nodes.filter("is_leaf AND verified IS NOT NULL").select("node", F.col("verified").alias("_good"))
    above = reached(leaves, _Links(edges, "dst", "src"), by=("_good",))
    above = above.groupBy("node").agg(F.bool_and("_good").alias("_all"), F.bool_or("_good").alias("_any"))
    told = lambda name: F.coalesce(F.col(name), F.lit(False))
    return nodes.select("node").join(_sorted(above), "node", "left").select(
        "node", told("_all").alias("fully_verified"), told("_any").alias("any_verified")
    )


def _peel(edges: DataFrame, hot_src: DataFrame | None, hot_dst: DataFrame | None) -> DataFrame:
    """Drop edges until every source is also a target and every target a source."""
    live, size = cut_lineage(edges), -1
    while True:
        count = live.count()
        if count in (0, size):
            return live
        size = count
        # Both sets come from the written table, so a round reads it three times.
        targets, sources = live.select(F.col("dst").alias("src")).distinct(), live.select(F.col("src").alias("dst")).distinct()
        live = _join(live, targets, "src", "left_semi", "dst", hot_src)
        live = _join(live, sources, "dst", "left_semi", "src", hot_dst)
        live = cut_lineage(live.select("src", "dst"))


def _colours(links: _Links) -> DataFrame:
    """Each node's greatest node that reaches it, by label propagation."""
    edges = links.rows
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    labels = cut_lineage(nodes.withColumn("colour", F.col("node")).withColumn("fresh", F.lit(True)))
    while not labels.filter("fresh").isEmpty():
        moving = labels.filter("fresh").select(F.col("node").alias("src"), "colour")
        pushed = links.follow(moving, "inner").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("pushed"))
        grown = F.coalesce(F.col("pushed") > F.col("colour"), F.lit(False))
        labels = cut_lineage(
            labels.drop("fresh").join(pushed, "node", "left")
            .select("node", F.greatest("colour", "pushed").alias("colour"), grown.alias("fresh"))
        )
    return labels.drop("fresh")


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that lie on a dependency cycle.

    Peeling removes what cannot be cyclic; the rest is split into strongly
    connected components by colouring: the greatest reaching node colours a
    node, and the component of a colour's root is what reaches the root within
    the colour.
    """
    edges = cut_lineage(edges.select("src", "dst").distinct())
    # Later rounds work on a part of these edges, so their hubs are among these.
    hot_src, hot_dst = _settled_hot(edges, ["src"]), _settled_hot(edges, ["dst"])
    back = None if hot_dst is None else hot_dst.withColumnRenamed("dst", "src")
    live = _peel(edges, hot_src, hot_dst)
    loops = live.filter("src = dst").select(F.col("src").alias("node"))
    found = loops
    while not live.isEmpty():
        links = _Links(live, hot=hot_src)
        colours = _colours(links)
        tinted = _join(live, colours.withColumnRenamed("node", "src").withColumnRenamed("colour", "cs"), "src", "inner", "dst", links.hot)
        tinted = _join(tinted, colours.withColumnRenamed("node", "dst").withColumnRenamed("colour", "cd"), "dst", "inner", "src", hot_dst)
        within = tinted.filter("cs = cd").select("src", "dst")
        roots = colours.filter("node = colour").select("node")
        members = reachable(roots, _Links(within, "dst", "src", hot=back)).select("node")
        members = cut_lineage(members.join(colours, "node"))
        sizes = members.groupBy("colour").agg(F.count(F.lit(1)).alias("n"))
        several = sizes.filter("n > 1").select("colour")
        found = found.unionByName(
            spread_join(members, several, ["colour"], "left_semi", spread_on=["node"], hot=hot_keys(sizes, ["colour"], "n")).select("node")
        )
        gone = members.select("node")
        rest = _join(live, gone.withColumnRenamed("node", "src"), "src", "left_anti", "dst", hot_src)
        rest = _join(rest, gone.withColumnRenamed("node", "dst"), "dst", "left_anti", "src", hot_dst)
        live = _peel(rest.select("src", "dst"), hot_src, hot_dst)
    return found.distinct()


def primary_citation(refs: DataFrame, inputs: DataFrame, facts: DataFrame) -> DataFrame:
    """Citation of each printed reference within two levels: the fact itself, or
    the first input fact that has a link, direct inputs before theirs. Without a
    link below it a node has no citation.

    ``refs(ref_id, node_id)``, ``inputs(node_id, position, input_id)``,
    ``facts(fact_id, url)``.
    """
    f = facts.select("fact_id", "url")

    def place(first: Column, second: Column) -> Column:
        return F.struct(first.cast("bigint").alias("p1"), second.cast("bigint").alias("p2")).alias("position")

    # Resolve each cited node once, then hand the answer to all its references.
    nodes = refs.select("node_id").distinct()
    direct = nodes.join(f.withColumnRenamed("fact_id", "node_id"), "node_id").select(
        "node_id", F.lit(0).alias("level"), place(F.lit(0), F.lit(0)), F.col("node_id").alias("fact_id"), "url"
    )
    one = inputs.join(nodes, "node_id", "left_semi").select("node_id", "position", F.col("input_id").alias("next"))
    hot_next = hot_keys(inputs.select(F.col("input_id").alias("next")), ["next"])
    first = spread_join(one, f.withColumnRenamed("fact_id", "next"), ["next"], spread_on=["node_id", "position"], hot=hot_next).select(
        "node_id", F.lit(1).alias("level"), place(F.col("position"), F.lit(0)), F.col("next").alias("fact_id"), "url"
    )
    below = inputs.select(F.col("node_id").alias("next"), F.col("position").alias("p2"), F.col("input_id").alias("deep"))
    two = spread_join(one, below, ["next"], spread_on=["node_id", "position"], hot=hot_next)
    second = spread_join(
        two, f.withColumnRenamed("fact_id", "deep"), ["deep"], spread_on=["node_id", "position"],
        hot=hot_next.withColumnRenamed("next", "deep"),
    ).select(
        "node_id", F.lit(2).alias("level"), place(F.col("position"), F.col("p2")), F.col("deep").alias("fact_id"), "url"
    )
    every = direct.unionByName(first).unionByName(second)
    rank = F.when((F.col("level") == 0) | F.col("url").isNotNull(), F.struct("level", "position", "fact_id"))
    best = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("url").alias("u"))))
    picked = every.groupBy("node_id").agg(best.alias("_b"), F.count_distinct("fact_id").alias("facts"))
    return spread_join(refs, picked, ["node_id"], "left", spread_on=["ref_id"]).select(
        "ref_id", F.col("_b.r.fact_id").alias("primary_fact"), F.col("_b.u").alias("url"), F.col("_b.r.level").alias("level"),
        F.coalesce("facts", F.lit(0)).alias("facts"),
    )
