"""Operators on graphs held as tables of nodes and edges.

Edges have source and target; nodes have identity.  Searches go by frontiers: a
round joins the newest nodes with the edges and keeps those not met before, so
the work is that of the edges reached, however many paths lead there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import names
from tributary.operators.cut import cut

DAMPING = 0.85
TRACE_DEPTH = 5


def _chosen(rows: DataFrame, keys: list[str], pick, order: str) -> DataFrame:
    """One row for each key; chosen by an aggregate, so tasks combine before anything is shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("__row"))
    return best.select(*[c if c in keys else F.col(f"__row.{c}").alias(c) for c in rows.columns])


def last_wins(edges: DataFrame, order: str = "seq") -> DataFrame:
    """One edge for each pair of ends, the one of the highest order."""
    return _chosen(edges, ["source", "target"], F.max_by, order)


def first_wins(nodes: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each identity, the one of the lowest order."""
    return _chosen(nodes, ["identity"], F.min_by, order)


def with_virtual(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and the edges' missing ends, whose type is 'unknown'."""
    ends = edges.select(F.col("source").alias("identity")).union(edges.select("target")).distinct()
    missing = ends.join(nodes, "identity", "left_anti").withColumn("type", F.lit("unknown"))
    return nodes.unionByName(missing, allowMissingColumns=True)


def degrees(edges: DataFrame) -> DataFrame:
    """identity, in_degree, out_degree of every end of an edge; one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("identity"), F.lit(1).alias("o")), F.struct(F.col("target").alias("identity"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.identity").agg(F.sum(1 - F.col("e.o")).alias("in_degree"), F.sum("e.o").alias("out_degree"))


def reversed_(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def _steps(edges: DataFrame, upstream: bool = False) -> DataFrame:
    """The pairs of ends, written once for all rounds of a search."""
    return cut((reversed_(edges) if upstream else edges.select("source", "target")).distinct())


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = TRACE_DEPTH, upstream: bool = False) -> DataFrame:
    """(origin, node, distance) of every node within depth of each origin, itself left out.

    Every round's frontier is written, so a round reads the edges once; while
    the frontier is small it is broadcast and the edges stay where they are.
    """
    steps = _steps(edges, upstream)
    seen = starts.select(F.col("identity").alias("origin"), F.col("identity").alias("node"), F.lit(0).alias("distance"))
    frontier, k = seen, 0
    while depth is None or k < depth:
        k += 1
        met = frontier.join(steps, F.col("node") == F.col("source")).select("origin", F.col("target").alias("node")).distinct()
        frontier = cut(met.join(seen, ["origin", "node"], "left_anti").withColumn("distance", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if k % 5 == 0:
            seen = cut(seen)
    return seen.where("distance > 0")


def trace(edges: DataFrame, start: str, upstream: bool = False, depth: int | None = TRACE_DEPTH) -> DataFrame:
    """node, distance of a dataset's lineage in one direction."""
    origin = edges.sparkSession.createDataFrame([(start,)], "identity string")
    return reach(edges, origin, depth, upstream).select("node", "distance")


def find_start(ids: DataFrame, query: str) -> DataFrame:
    """The node that a query names: exact, else the first that contains it, case ignored."""
    low = F.lower("identity")
    hit = ids.where(low.contains(query.lower())).withColumn("rank", F.when(low == query.lower(), 0).otherwise(1))
    return hit.orderBy("rank", "identity").limit(1).select("identity")


def one_hop(edges: DataFrame, node: str) -> DataFrame:
    ups = edges.where(F.col("target") == node).select(F.col("source").alias("neighbour"), F.lit("upstream").alias("direction"))
    return ups.union(edges.where(F.col("source") == node).select(F.col("target").alias("neighbour"), F.lit("downstream").alias("direction"))).distinct()


def unified(edges: DataFrame, node: str) -> DataFrame:
    """All edges at a node with their kind, and whether it is a source or a sink."""
    at = edges.where((F.col("source") == node) | (F.col("target") == node))
    flags = at.agg((F.count_if(F.col("target") == node) == 0).alias("is_source"), (F.count_if(F.col("source") == node) == 0).alias("is_sink"))
    way = F.when(F.col("target") == node, "in").otherwise("out")
    return at.select(way.alias("direction"), "source", "target", "type", "confidence_score").crossJoin(F.broadcast(flags))


def weighted_impact(edges: DataFrame, nodes: DataFrame, start: str, depth: int | None = None) -> DataFrame:
    """Everything downstream with importance times the decay of distance, and a citation."""
    reached = trace(edges, start, depth=depth)
    known = nodes.select(F.col("identity").alias("node"), "importance_score")
    out = reached.join(known, "node", "left")
    impact = F.coalesce("importance_score", F.lit(1)) * names.decay(F.col("distance"))
    return out.select("node", "distance", F.round(impact, 2).alias("impact"), F.round(names.citation_confidence(F.col("distance")), 2).alias("confidence"))


def roles(data: DataFrame, edges: DataFrame) -> DataFrame:
    """SOURCE without incoming edges, TERMINAL with incoming only, else INTERMEDIATE."""
    joined = data.join(degrees(edges), "identity", "left")
    n_in, n_out = F.coalesce("in_degree", F.lit(0)), F.coalesce("out_degree", F.lit(0))
    role = F.when(n_in == 0, "SOURCE").when(n_out == 0, "TERMINAL").otherwise("INTERMEDIATE")
    return joined.withColumn("role", role).drop("in_degree", "out_degree")


def distance_importance(data: DataFrame, edges: DataFrame, base: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """min(100, int(10 * (base + sum of 1.5 ** -distance over the data nodes downstream))).

    An origin whose score has reached 100 takes no further part in the search:
    what it would still meet can't change its score.
    """
    steps, mine = _steps(edges), data.select(F.col("identity").alias("node")).distinct()
    own = data.select(F.col("identity").alias("origin"), F.lit(1.0).alias("s"))
    if base is not None:
        known = base.select(F.col("identity").alias("origin"), "base")
        own = own.join(known, "origin", "left").select("origin", F.coalesce("base", "s").cast("double").alias("s"))
    score = lambda s: F.least(F.lit(100), F.floor(F.round(s * 10, 9)))
    sums = cut(own)
    seen = data.select(F.col("identity").alias("origin"), F.col("identity").alias("node"))
    frontier, k = seen, 0
    while depth is None or k < depth:
        k += 1
        open_ = sums.where(score(F.col("s")) < 100).select("origin")
        met = frontier.join(open_, "origin", "left_semi").join(steps, F.col("node") == F.col("source")).select("origin", F.col("target").alias("node")).distinct()
        frontier = cut(met.join(seen, ["origin", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        gained = frontier.join(mine, "node", "left_semi").groupBy("origin").agg((F.count(F.lit(1)) * names.decay(F.lit(k))).alias("gain"))
        sums = cut(sums.join(gained, "origin", "left").select("origin", (F.col("s") + F.coalesce("gain", F.lit(0.0))).alias("s")))
        seen = seen.unionByName(frontier)
        if k % 5 == 0:
            seen = cut(seen)
    return sums.select(F.col("origin").alias("identity"), score(F.col("s")).cast("int").alias("importance_score"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """identity, rank: damping 0.85, uniform teleport, dangling mass spread evenly.

    Stops after ``rounds``, or when the ranks change by less than tolerance
    times the number of nodes in all; without a tolerance all rounds are run.
    """
    links = edges.select("source", "target").distinct()
    out = links.groupBy("source").agg(F.count(F.lit(1)).alias("out"))
    links = cut(links.join(out, "source"))
    nodes = cut(nodes.select("identity").join(out.withColumnRenamed("source", "identity"), "identity", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("identity", F.lit(0.0).alias("rank"))
    ranks = nodes.select("identity", "out", F.lit(1.0 / n).alias("rank"))
    for k in range(1, rounds + 1):
        given = links.join(ranks.select(F.col("identity").alias("source"), "rank"), "source")
        got = given.groupBy(F.col("target").alias("identity")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        share = F.coalesce("got", F.lit(0.0)) + F.col("lost") / n
        fresh = nodes.join(got, "identity", "left").crossJoin(F.broadcast(lost))
        fresh = fresh.select("identity", "out", ((1 - DAMPING) / n + DAMPING * share).alias("rank"))
        if k % 5 == 0 or tolerance is not None:
            fresh = cut(fresh)
        if tolerance is not None:
            moved = fresh.join(ranks.select("identity", F.col("rank").alias("old")), "identity").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if moved < tolerance * n:
                return fresh.select("identity", "rank")
        ranks = fresh
    return ranks.select("identity", "rank")


def flags(nodes: DataFrame, edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Importance, hub, sink and dead-code flags of every module.

    nodes: identity, is_informational.  The hub threshold is max(0.05, 3.5 / n).
    """
    spread = ranks.where("rank > 0").agg(F.min("rank").alias("least"), F.max("rank").alias("most"))
    total = nodes.agg(F.count(F.lit(1)).alias("n"))
    rows = nodes.join(ranks, "identity", "left").join(degrees(edges), "identity", "left").crossJoin(F.broadcast(spread)).crossJoin(F.broadcast(total))
    rank, out = F.coalesce("rank", F.lit(0.0)), F.coalesce("out_degree", F.lit(0))
    raw = F.col("identity").rlike("^(seeds|data)/") | F.coalesce(F.col("layer") == "raw", F.lit(False)) if "layer" in nodes.columns else F.col("identity").rlike("^(seeds|data)/")
    runs = ~F.col("is_informational")
    high = rank > F.greatest(F.lit(0.05), F.lit(3.5) / F.col("n"))
    sink = (out == 0) & (high | F.col("identity").rlike("models/|marts/")) & runs
    return rows.select(
        "identity",
        rank.alias("pagerank_score"),
        names.importance(rank, F.col("least"), F.col("most"), raw).alias("importance_score"),
        (high & runs).alias("is_architectural_hub"),
        sink.alias("is_sink_node"),
        ((out == 0) & ~F.col("identity").rlike("^(seeds|data)/") & ~sink & runs).alias("is_dead_code_candidate"),
    )


def executable(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The subgraph without informational nodes."""
    kept = nodes.where(~F.col("is_informational"))
    return kept, induced(edges, kept)


def induced(edges: DataFrame, nodes: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Edges with both ends among the nodes, of some types only if these are given."""
    ids = nodes.select("identity")
    if types is not None:
        edges = edges.where(F.col("type").isin(types))
    return edges.join(ids, edges["source"] == ids["identity"], "left_semi").join(ids, F.col("target") == ids["identity"], "left_semi")


def strong_components(edges: DataFrame) -> DataFrame:
    """(identity, component) of nodes in strongly connected components of two or more.

    Colouring: nodes without a way in or out are trimmed; every node takes the
    least identity that reaches it; a colour's nodes that reach its root are a
    component and leave the graph.
    """
    left = cut(edges.select("source", "target").where("source <> target").distinct())
    done: DataFrame | None = None
    while not left.isEmpty():
        while True:
            between = left.select(F.col("source").alias("identity")).intersect(left.select(F.col("target").alias("identity")))
            kept = cut(induced(left, between))
            same = kept.count() == left.count()
            left = kept
            if same:
                break
        if left.isEmpty():
            break
        colour = left.select(F.col("source").alias("identity")).union(left.select("target")).distinct().withColumn("colour", F.col("identity"))
        while True:
            seen = left.join(colour, left["source"] == colour["identity"]).select(F.col("target").alias("identity"), "colour")
            fresh = cut(colour.unionByName(seen).groupBy("identity").agg(F.min("colour").alias("colour")))
            changed = fresh.join(colour.withColumnRenamed("colour", "old"), "identity").where("colour <> old").isEmpty()
            colour = fresh
            if changed:
                break
        a, b = colour.select(F.col("identity").alias("source"), F.col("colour").alias("c")), colour.select(F.col("identity").alias("target"), F.col("colour").alias("d"))
        inside = left.join(a, "source").join(b, "target").where("c = d").select("source", "target")
        roots = colour.where("identity = colour").select("identity")
        back = reach(inside, roots, None, upstream=True).select(F.col("node").alias("identity"), F.col("origin").alias("component"))
        found = cut(back.unionByName(back.select(F.col("component").alias("identity"), "component")).distinct())
        done = found if done is None else done.unionByName(found)
        gone = found.select("identity").union(roots).distinct()
        left = cut(left.join(gone, left["source"] == gone["identity"], "left_anti").join(gone, F.col("target") == gone["identity"], "left_anti"))
    return done if done is not None else edges.select(F.col("source").alias("identity"), F.col("source").alias("component")).limit(0)


def cycle_members(edges: DataFrame) -> DataFrame:
    """Nodes on any cycle, self-loops included."""
    loops = edges.where("source = target").select(F.col("source").alias("identity"))
    return strong_components(edges).select("identity").union(loops).distinct()


def integrity(data: DataFrame, transformations: DataFrame, edges: DataFrame, registry: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """Warnings (type, node, severity), one rule a table.

    data has identity and role; registry, if given, canonical_name and namespace.
    Each strongly connected component and each self-loop is one cycle.
    declared: edges of configuration files; they link nodes but bear no data, so roles don't follow from them.
    """
    warn = lambda df, kind, severity: df.select(F.lit(kind).alias("type"), F.col("identity").alias("node"), F.lit(severity).alias("severity"))
    deg = degrees(edges if declared is None else edges.select("source", "target").union(declared.select("source", "target")))
    known = data.select("identity").union(transformations.select("identity"))
    loops = edges.where("source = target").select(F.col("source").alias("identity")).distinct()
    cycles = strong_components(edges).select(F.col("component").alias("identity")).distinct().union(loops)
    reads = edges.join(data.where("role = 'TERMINAL'"), F.col("source") == F.col("identity")).join(transformations.select(F.col("identity").alias("t")), F.col("target") == F.col("t"), "left_semi")
    writes = edges.join(data.where("role = 'SOURCE'"), F.col("target") == F.col("identity")).join(transformations.select(F.col("identity").alias("t")), F.col("source") == F.col("t"), "left_semi")
    out = warn(cycles, "cycle", "high")
    for df, kind, severity in (
        (deg.join(known, "identity", "left_anti"), "undefined_reference", "medium"),
        (data.join(deg, "identity", "left_anti"), "orphan", "low"),
        (data.where("role = 'INTERMEDIATE'").join(deg.where("out_degree > 0"), "identity", "left_anti"), "dangling_sink", "medium"),
        (transformations.join(deg, "identity", "left_anti"), "isolated_transformation", "medium"),
        (reads, "logic_error", "high"),
        (writes, "logic_error", "high"),
    ):
        out = out.unionByName(warn(df, kind, severity))
    if registry is not None:
        out = out.unionByName(warn(collisions(registry).withColumnRenamed("canonical_name", "identity"), "collision_risk", "medium"))
    return out


def collisions(registry: DataFrame) -> DataFrame:
    """Canonical names used in more than one namespace."""
    spaces = registry.groupBy("canonical_name").agg(F.sort_array(F.collect_set("namespace")).alias("namespaces"))
    return spaces.where(F.size("namespaces") > 1)


def health(warnings: DataFrame, data: DataFrame, transformations: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: score from 0 to 100 and the counts it is made of."""
    w = warnings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")], *[F.count_if(F.col("type") == t).alias(a) for t, a in (("orphan", "orphan_nodes"), ("isolated_transformation", "isolated_transformations"), ("undefined_reference", "unresolved_datasets"))], F.count(F.lit(1)).alias("warning_count"))
    e = edges.agg(F.count(F.lit(1)).alias("total_edges"), F.count_if(F.col("confidence_score") < 0.5).alias("heuristic_edges"))
    d, t = data.agg(F.count(F.lit(1)).alias("data_nodes")), transformations.agg(F.count(F.lit(1)).alias("transformation_nodes"))
    row = w.crossJoin(e).crossJoin(d).crossJoin(t)
    loss = F.col("high") * 20 + F.col("medium") * 10 + F.col("low") * 5 + F.when(F.col("total_edges") > 0, F.col("heuristic_edges") / F.greatest("total_edges", F.lit(1)) * 30).otherwise(0)
    score = F.when(F.col("data_nodes") == 0, 0).otherwise(F.greatest(F.lit(0), F.floor(F.round(F.lit(100.0) - loss, 9))))
    return row.withColumn("health_score", score.cast("int")).drop("high", "medium", "low")


def acyclic(edges: DataFrame) -> DataFrame:
    """Edges without those inside a component that lead to a smaller or the same identity."""
    plain = edges.select("source", "target").where("source <> target").distinct()
    scc = strong_components(plain)
    a, b = scc.select(F.col("identity").alias("source"), F.col("component").alias("c")), scc.select(F.col("identity").alias("target"), F.col("component").alias("d"))
    tagged = plain.join(a, "source", "left").join(b, "target", "left")
    return tagged.where("c is null or d is null or c <> d or source < target").select("source", "target")


def depths(edges: DataFrame) -> DataFrame:
    """(identity, depth, previous): the longest path to each node of an acyclic graph."""
    steps = cut(edges.select("source", "target").distinct())
    ids = steps.select(F.col("source").alias("identity")).union(steps.select("target")).distinct()
    best = cut(ids.select("identity", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("previous")))
    grown = best
    while True:
        on = grown.select(F.col("identity").alias("source"), (F.col("depth") + 1).alias("d"))
        offers = steps.join(on, "source").groupBy("target").agg(F.max("d").alias("d"), F.min_by("source", F.struct(-F.col("d"), F.col("source"))).alias("by"))
        better = cut(best.join(offers, best["identity"] == offers["target"]).where("d > depth").select("identity", F.col("d").alias("depth"), F.col("by").alias("previous")))
        if better.isEmpty():
            return best
        best = cut(best.join(better, "identity", "left_anti").unionByName(better))
        grown = better


def critical_path(edges: DataFrame) -> DataFrame:
    """(place, identity) along a longest path; ties go to the least identity."""
    best = depths(acyclic(edges))
    path = cut(best.orderBy(F.desc("depth"), "identity").limit(1).select("identity"))
    jump = best.where("previous is not null").select("identity", "previous")
    # Jumps double: each round adds as many nodes as the path has so far.
    while True:
        jump = cut(jump)
        more = cut(path.join(jump, "identity").select(F.col("previous").alias("identity")))
        if more.isEmpty():
            break
        path = path.unionByName(more)
        jump = jump.join(jump.select(F.col("identity").alias("previous"), F.col("previous").alias("further")), "previous").select("identity", F.col("further").alias("previous"))
    return best.join(path.distinct(), "identity", "left_semi").select(F.col("depth").alias("place"), "identity")


def resolve_imports(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Import records (importer, name, seq) to edges dependency -> dependent.

    A module is found by its file name, by any dotted suffix of its path, else by
    the name's last part; of several modules the one of the highest seq counts.
    """
    stem = F.regexp_replace("identity", r"\.py$", "")
    parts = F.split(stem, "/")
    n = F.size(parts)
    keys = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))
    keys = F.when(F.col("identity").endswith(".py"), F.concat(F.array(names.basename(F.col("identity"))), keys)).otherwise(F.array(names.basename(stem), names.basename(F.regexp_replace("identity", r"\.[^./]*$", ""))))
    table = nodes.select("identity", "seq", F.explode(F.array_distinct(keys)).alias("key"))
    table = table.groupBy("key").agg(F.max_by("identity", "seq").alias("identity"))
    last = F.regexp_extract("name", r"([^.]*)$", 1)
    exact = table.select(F.col("key").alias("name"), F.col("identity").alias("exact"))
    loose = table.select(F.col("key").alias("last"), F.col("identity").alias("loose"))
    found = edges.withColumn("last", last).join(exact, "name", "left").join(loose, "last", "left").withColumn("source", F.coalesce("exact", "loose"))
    found = found.where("source is not null and source <> importer")
    yaml = F.col("source").rlike(r"\.ya?ml$") | F.col("importer").rlike(r"\.ya?ml$")
    kind = F.when(F.col("source").rlike("^(seeds|data)/"), "dbt_source").when(yaml, "describes").otherwise(F.col("type"))
    return found.select("source", F.col("importer").alias("target"), kind.alias("type"), "seq")


def expand_drift(edges: DataFrame, drifted: DataFrame, dependents: bool = True) -> DataFrame:
    """Neighbours of nodes whose signature changed: dependents, or dependencies."""
    ids = drifted.select(F.col("identity").alias("d"))
    at, other = ("source", "target") if dependents else ("target", "source")
    return edges.join(ids, F.col(at) == F.col("d"), "left_semi").select(F.col(other).alias("identity")).distinct()


def enrich(found: DataFrame, nodes: DataFrame, on: str = "node") -> DataFrame:
    """Type and namespace of traced nodes; 'unknown' where there are none."""
    info = nodes.select(F.col("identity").alias(on), "type", "namespace")
    return found.join(info, on, "left").fillna("unknown", ["type", "namespace"])


def assert_acyclic(edges: DataFrame) -> None:
    """Raise ValueError if any node lies on a cycle."""
    some: Column = cycle_members(edges).limit(5)
    bad = [r[0] for r in some.collect()]
    if bad:
        raise ValueError(f"the graph has cycles, for one through {', '.join(map(str, bad))}")
