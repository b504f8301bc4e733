"""Property-graph operators on two tables: nodes(id, name, labels, props) and edges(edge_id, src, dst, rel_type, props, valid_from)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..common import checked_broadcast, cut_lineage, delete, stored
from ..functions import text as X
from . import resolve, retrieval

# Labels and edge types the system itself writes.
SYSTEM_LABELS = ("__Community__", "Category", "CommunitySummary")


#: Ids of a frontier up to which they are broadcast, to keep the edges that touch them.
NEAR = 1_000_000


def from_star(t) -> tuple[DataFrame, DataFrame]:
    """A graph of the order schema's tables; line items give several edges of a kind between two nodes."""
    ids = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    node = lambda df, p, key, name, label, prop: df.select(
        ids(p, key).alias("id"), name.alias("name"), F.array(F.lit(label)).alias("labels"), F.create_map(F.lit("kind"), F.lit(label), F.lit("v"), F.col(prop).cast("string")).alias("props")
    )
    nodes = [
        node(t("region"), "r", "r_regionkey", F.col("r_name"), "Region", "r_regionkey"), node(t("nation"), "n", "n_nationkey", F.col("n_name"), "Nation", "n_regionkey"),
        node(t("customer"), "c", "c_custkey", F.col("c_name"), "Customer", "c_mktsegment"), node(t("supplier"), "s", "s_suppkey", F.col("s_name"), "Supplier", "s_nationkey"),
        node(t("part"), "p", "p_partkey", F.col("p_name"), "Part", "p_brand"), node(t("orders"), "o", "o_orderkey", ids("Order#", "o_orderkey"), "Order", "o_orderstatus"),
    ]

    def edge(df, rel, src, dst, when=None, also=()):
        made = df.select(src.alias("src"), dst.alias("dst"), (F.col(when).cast("date").cast("string") if when else F.lit(None).cast("string")).alias("valid_from"), *also)
        tail = [F.lit("#"), *[F.col(c).cast("string") for c in also]] if also else []
        return made.select(F.concat(F.lit(rel + ":"), "src", F.lit(">"), "dst", *tail).alias("edge_id"), "src", "dst", F.lit(rel).alias("rel_type"), "valid_from")

    li = t("lineitem").withColumn("line", F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")))
    edges = [
        edge(t("nation"), "PART_OF", ids("n", "n_nationkey"), ids("r", "n_regionkey")), edge(t("customer"), "LOCATED_IN", ids("c", "c_custkey"), ids("n", "c_nationkey")),
        edge(t("supplier"), "LOCATED_IN", ids("s", "s_suppkey"), ids("n", "s_nationkey")), edge(t("orders"), "PLACED", ids("c", "o_custkey"), ids("o", "o_orderkey"), "o_orderdate"),
        edge(li, "CONTAINS", ids("o", "l_orderkey"), ids("p", "l_partkey"), None, ("line",)), edge(li, "SUPPLIED_BY", ids("p", "l_partkey"), ids("s", "l_suppkey"), None, ("line",)),
    ]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


def named(nodes: DataFrame) -> DataFrame:
    """id and name (or id) of nodes that are not the system's."""
    free = ~F.arrays_overlap("labels", F.array(*map(F.lit, SYSTEM_LABELS)))
    return nodes.where(free).select("id", F.coalesce("name", "id").alias("name"), "labels").where("trim(name) <> ''")


def both_ways(edges: DataFrame) -> DataFrame:
    """A row for each end of an edge; a loop has one."""
    e = edges.select("edge_id", "src", "dst", "rel_type", "valid_from")
    return e.unionByName(e.where("src <> dst").select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_type", "valid_from"))


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 1, limit: int | None = 20) -> DataFrame:
    """seed, id, name, hop, rel_types, valid_from: paths of 1 to `hops` edges from seeds(name), no edge twice, either direction.

    A hop reads the edges and keeps those that touch the frontier before anything is shuffled, as long as the frontier's ids are
    NEAR at most. Paths with the same seed, end, edges' kinds and first date differ only in edges they may not use again; these
    are kept as long as hops remain, and paths are told apart no more than that at the last one.
    """
    start = cut_lineage(named(nodes).join(checked_broadcast(seeds.select("name").distinct()), "name", "left_semi").select(F.col("id").alias("seed")))
    step = both_ways(edges)
    at = start.select("seed", F.col("seed").alias("src"), F.array().cast("array<string>").alias("path"), F.lit("").alias("rel_types"), F.lit(None).cast("string").alias("valid_from"))
    found = []
    for hop in range(1, hops + 1):
        ids = at.select("src").distinct()
        touched = step.join(F.broadcast(ids), "src", "left_semi") if ids.limit(NEAR + 1).count() <= NEAR else step
        frontier = checked_broadcast(at.withColumnRenamed("valid_from", "vf"))
        next_ = touched.join(frontier, "src").where(~F.array_contains("path", F.col("edge_id")))
        first = F.col("valid_from") if hop == 1 else F.col("vf")
        kinds = F.col("rel_type") if hop == 1 else F.concat("rel_types", F.lit(">"), "rel_type")
        at = next_.select("seed", F.col("dst").alias("src"), F.array_append("path", F.col("edge_id")).alias("path"), kinds.alias("rel_types"), first.alias("valid_from"))
        if hop < hops:
            at = cut_lineage(at)
        found.append(at.select("seed", F.col("src").alias("id"), F.lit(hop).alias("hop"), "rel_types", "valid_from").distinct())
    reached = reduce(DataFrame.unionByName, found).join(checked_broadcast(start.select(F.col("seed").alias("id"))), "id", "left_anti")
    out = reached.join(named(nodes).select("id", "name"), "id")
    return out if limit is None else out.orderBy("hop", "name", "seed", "rel_types", "valid_from").limit(limit)


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def simple(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, rel_type: one undirected edge between named nodes; the last edge's type is kept.

    Edges are shuffled by their lesser end alone, which serves the join with its node and the grouping; what is left goes to the
    greater end without the edges' ids. An inner join with distinct ids is not moved below the grouping, as a semi join is.
    """
    ids = named(nodes).select("id").distinct()
    ends = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "rel_type", "edge_id").repartition("a")
    held = ends.join(ids.withColumnRenamed("id", "a"), "a", "left_semi")
    once = held.groupBy("a", "b").agg(F.max_by("rel_type", "edge_id").alias("rel_type"))
    return once.join(ids.withColumnRenamed("id", "b"), "b").select("a", "b", "rel_type")


def overlay(order: list, props) -> Column:
    """Aggregate: one map of a group's maps, in the order of the columns `order`; later values replace earlier ones.

    Entries instead of maps are sorted (maps have no order); the session's duplicate-key policy plays no part.
    """
    rows = F.array_sort(F.collect_list(F.struct(*order, F.map_entries(props).alias("e"))))
    lay = lambda acc, x: F.concat(F.filter(acc, lambda old: ~F.exists(x["e"], lambda new: new["key"] == old["key"])), x["e"])
    return F.map_from_entries(F.aggregate(rows, F.array().cast("array<struct<key:string,value:string>>"), lay))


def move_edges(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """edges with props, re-pointed by remap(dup, canon); loops born of it go; equal (src, dst, type) merge, props overlaid."""
    to = lambda c: checked_broadcast(remap).select(F.col("dup").alias(c), F.col("canon").alias(f"_{c}"))
    moved = edges.join(to("src"), "src", "left").join(to("dst"), "dst", "left")
    touched = F.col("_src").isNotNull() | F.col("_dst").isNotNull()
    moved = moved.select("edge_id", F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"), "rel_type", "props", touched.alias("moved"))
    return merge_parallel(moved.where("NOT (moved AND src = dst)").drop("moved"))


def merge_parallel(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, rel_type): the lowest id, later edges' props over earlier ones'."""
    return edges.groupBy("src", "dst", "rel_type").agg(F.min("edge_id").alias("edge_id"), overlay(["edge_id"], F.col("props")).alias("props"))


def merge_props(nodes: DataFrame, remap: DataFrame) -> DataFrame:
    """Canonical nodes with their duplicates' props laid over theirs (id and name aside); duplicates are gone."""
    tagged = nodes.join(checked_broadcast(remap).withColumnRenamed("dup", "id"), "id", "left")
    key = F.coalesce("canon", "id")
    own = F.col("canon").isNull()
    props = F.when(own, F.col("props")).otherwise(F.map_filter("props", lambda k, _: ~k.isin("id", "name")))
    return tagged.groupBy(key.alias("id")).agg(F.max(F.when(own, F.col("name"))).alias("name"), overlay([(~own).alias("later"), F.col("id").alias("from")], props).alias("props"))


#: Words of 64 bits of a sieve at most: what is broadcast of ids, however many they are.
SIEVE = 1 << 20


def _sieve(ids: DataFrame):
    """Splits frames by whether a column may hold one of ids(id): split(df, *columns) -> rows that may, rows that surely do not.

    Each id sets three bits of one of SIEVE words; the words are broadcast and the rows are not shuffled. Ids that are not among
    them may pass as such, so what may hold one is still to be joined; none that is among them is missed. Null is none.
    """
    bits = lambda c: reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(F.xxhash64(c), k).bitwiseAND(63).cast("int")) for k in (32, 40, 48)])
    place = lambda c: F.xxhash64(c).bitwiseAND(SIEVE - 1)
    words = ids.select(place("id").alias("place"), bits("id").alias("bits")).groupBy("place").agg(F.bit_or("bits").alias("bits"))

    def split(df, *columns):
        may = F.lit(False)
        for k, c in enumerate(columns):
            # at most SIEVE rows
            df = df.join(F.broadcast(words.select(F.col("place").alias(f"_p{k}"), F.col("bits").alias(f"_b{k}"))), place(c) == F.col(f"_p{k}"), "left")
            may = may | F.coalesce(F.col(c).isNotNull() & (F.col(f"_b{k}").bitwiseAND(bits(c)) == bits(c)), F.lit(False))
        own = [f"_{x}{k}" for k in range(len(columns)) for x in "pb"]
        return df.where(may).drop(*own), df.where(~may).drop(*own)

    return split


def fold_properties(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """HAS_PROPERTY targets named "Key: Value" become props of their source; they and their edges go.

    Nodes and edges that a sieve of the ids rules out are passed on as they are; the others alone are joined.
    """
    held = edges.where("rel_type = 'HAS_PROPERTY'").select(F.col("src").alias("id"), F.col("dst").alias("p"))
    text = nodes.select(F.col("id").alias("p"), F.col("name").alias("text")).where("text LIKE '%:%'")
    key = F.regexp_replace(F.replace(F.lower(X.strip(F.get(F.split("text", ":", 2), 0))), F.lit(" "), F.lit("_")), "[^a-zA-Z0-9_]", "")
    pairs = held.join(text, "p").select("id", "p", key.alias("k"), X.strip(F.get(F.split("text", ":", 2), 1)).alias("v")).where("k NOT IN ('id', '')")
    new = pairs.groupBy("id", "k").agg(F.max_by("v", "p").alias("v")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("new"))
    gone = held.select("p").distinct()
    mine, others = _sieve(held.select("id").unionByName(held.select(F.col("p").alias("id"))))(nodes, "id")
    kept = mine.join(gone.withColumnRenamed("p", "id"), "id", "left_anti").join(new, "id", "left")
    props = F.when(F.col("new").isNull(), F.col("props")).otherwise(F.map_concat(F.map_filter("props", lambda k, _: ~F.array_contains(F.map_keys("new"), k)), F.col("new")))
    kept = kept.withColumn("props", props).select(nodes.columns)
    mine, apart = _sieve(gone.withColumnRenamed("p", "id"))(edges, "src", "dst")
    left = mine.join(gone.withColumnRenamed("p", "src"), "src", "left_anti").join(gone.withColumnRenamed("p", "dst"), "dst", "left_anti")
    return kept.unionByName(others), left.select(edges.columns).unionByName(apart)


def numbered(df: DataFrame, *order, name: str = "ord") -> DataFrame:
    """Rows numbered from 1 in an order over all of them: by range, with the counts of the ranges before. The order is total."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, before, starts = F.shiftright("_at", 33), 0, []
    for r in dealt.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a range
        starts.append((r["part"], before))
        before += r["count"]
    offsets = spark.createDataFrame(starts, "_part long, _before long")
    number = (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("int")
    return dealt.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, number).drop("_at", "_part", "_before")


def missing_members(members: DataFrame, existing: DataFrame, rel: str) -> DataFrame:
    """src, dst, rel_type for members(src, dst) without such an edge yet."""
    return members.join(existing.where(F.col("rel_type") == rel).select("src", "dst"), ["src", "dst"], "left_anti").withColumn("rel_type", F.lit(rel))


def sanitized(edges: DataFrame) -> DataFrame:
    return edges.where("src IS NOT NULL AND dst IS NOT NULL")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of their key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def louvain(edges: DataFrame, least_gain: float = 1e-3) -> DataFrame:
    """node, community (its smallest node) from edges(a, b), by Louvain's moves, at every size by grouped joins.

    Edges that lack an end are left out. In a round half of the nodes (by a hash) join the neighbouring community with the largest gain, so that neighbours do not
    swap for ever; no task holds more than partial sums. A level's rounds go on until two in a row, one for each half, no
    longer raise modularity by `least_gain`; the best state is kept, its communities become nodes, and levels go on until one gains
    nothing. What Spark has inferred of a round's rows is not handed on, as it would grow with every round: states are tables.
    Inside, nodes are numbers in the order of their names. A level's weights are laid out by their far end once; a round shuffles
    them once, and finds the modularity of the state it starts from along the way.
    """
    spark, kept = edges.sparkSession, []
    pair = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))
    once = stored(pair, kept)
    numbers = numbered(once.select(F.col("a").alias("node")).unionByName(once.select(F.col("b").alias("node"))).distinct(), "node", name="top")
    of = stored(numbers.select("node", F.col("top").cast("long").alias("top")), kept)
    names = stored(of.select(F.col("top").alias("x"), F.col("node").alias("s")), kept)
    ends = once.join(of.select(F.col("node").alias("a"), F.col("top").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("top").alias("y")), "b").select("x", "y", "w")
    # a loop counts from both of its ends
    both = ends.unionByName(ends.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"), "w"))
    w = stored(both.withColumn("w", F.when(F.col("x") == F.col("y"), 2 * F.col("w")).otherwise(F.col("w"))), kept)
    double_m, reached = w.agg(F.sum("w")).first()[0] or 1.0, None
    while True:
        state = stored(w.groupBy("x").agg(F.sum("w").alias("k")).withColumn("c", F.col("x")), kept)
        loops = w.where("x = y").agg(F.sum("w")).first()[0] or 0.0
        near = cut_lineage(w.where("x <> y").join(state.select("x", "k"), "x").select("x", "y", "w", "k").repartition("y").sortWithinPartitions("y"))
        best, idle, turn = state, 0, 0
        state, score = _moved(near, state, names, double_m, loops, turn, kept)
        reached = score if reached is None else reached
        while idle < 2:
            turn += 1
            after, now = _moved(near, state, names, double_m, loops, turn, kept)
            idle = 0 if now > score + least_gain else idle + 1
            best, score = (state, now) if now > score else (best, score)
            state = after
        if score <= reached + least_gain:
            break
        reached = score
        of = stored(of.join(best.select(F.col("x").alias("top"), "c"), "top").select("node", F.col("c").alias("top")), kept)
        c = best.select("x", "c")
        w = stored(w.join(c, "x").join(c.select(F.col("x").alias("y"), F.col("c").alias("d")), "y").groupBy(F.col("c").alias("x"), F.col("d").alias("y")).agg(F.sum("w").alias("w")), kept)
    name = of.groupBy("top").agg(F.min("node").alias("community"))
    found = cut_lineage(of.join(name, "top").select("node", "community"))
    for path in kept:
        delete(spark, path)
    return found


def modularity(w: DataFrame, state: DataFrame, double_m: float) -> float:
    """Of the communities c of state(x, k, c) in the weights w(x, y, w), both ways."""
    c = state.select("x", "c")
    inside = w.join(c, "x").join(c.select(F.col("x").alias("y"), F.col("c").alias("d")), "y").where("c = d").agg(F.sum("w")).first()[0] or 0.0
    expected = state.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum((F.col("t") / double_m) ** 2)).first()[0] or 0.0
    return inside / double_m - expected


def _moved(near: DataFrame, state: DataFrame, names: DataFrame, double_m: float, loops: float, turn: int, kept: list[str]) -> tuple[DataFrame, float]:
    """state(x, k, c) after the nodes whose turn it is have joined the neighbouring community with the largest gain, and the
    modularity before. near(x, y, w, k): weights between nodes, with that of all of x's; loops: sum of the weights of loops.

    A community's weight goes with each member, so that a node's options are summed and compared where the node lies.
    """
    held = state.select("x", "k", "c").join(state.groupBy("c").agg(F.sum("k").alias("tot")), "c")
    # each half in turn, dealt anew after both
    may = F.pmod(F.xxhash64("s", F.lit(turn // 2)) + turn, F.lit(2)) == 0
    own = held.join(names, "x").select("x", "k", "c", "tot", F.lit(0.0).alias("in"), F.when(may, 2).otherwise(1).alias("own"))
    options = near.join(held.select(F.col("x").alias("y"), "c", "tot"), "y").select("x", "k", "c", "tot", F.col("w").alias("in"), F.lit(0).alias("own"))
    options = options.unionByName(own).repartition("x").groupBy("x", "k", "c").agg(F.sum("in").alias("in"), F.max("tot").alias("tot"), F.max("own").alias("own"))
    mine = F.col("own") > 0
    rest = F.col("tot") - F.when(mine, F.col("k")).otherwise(F.lit(0.0))
    gain = F.round(F.col("in") - F.col("k") * rest / double_m, 9)
    best = options.groupBy("x", "k").agg(
        F.max_by("c", F.struct(gain.alias("g"), mine.alias("stay"), F.col("c").alias("name"))).alias("to"),
        F.max(F.when(mine, F.col("c"))).alias("before"), F.max("own").alias("own"), F.sum(F.when(mine, F.col("in"))).alias("inside"),
    )
    new = stored(best.select("x", "k", F.when(F.col("own") == 2, F.col("to")).otherwise(F.col("before")).alias("c"), "before", "inside"), kept)
    sums = new.groupBy("before").agg(F.sum("k").alias("t"), F.sum("inside").alias("inside")).agg(F.sum("inside").alias("inside"), F.sum((F.col("t") / double_m) ** 2).alias("expected")).first()
    return new, ((sums["inside"] or 0.0) + loops) / double_m - (sums["expected"] or 0.0)


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node) from edges(a, b).

    Each round hooks every node to the one around it, itself included, with most edges (ties to the greater name), contracts the
    trees that this makes and goes on with the edges between them. A node that stays a root has no neighbour with more edges, so
    each of its edges takes up at most one part in the degree of a neighbour that is hooked: roots are half of the nodes at most,
    and rounds at most the logarithm of their number. Tables of a round are removed with the next; only the maps from nodes to
    roots, at most half as long each time, stay until they are put together.
    """
    spark, maps = edges.sparkSession, []
    # parallel edges count once, and the tables are read once and not in every round
    first: list[str] = []
    held = stored(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), first)
    left, kept = held.where("a <> b"), first
    loops: list[str] = []
    alone = stored(held.where("a = b").select(F.col("a").alias("node")), loops)
    while not left.isEmpty():
        now: list[str] = []
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        counted = both.repartition("a").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("a")))
        # seen from b: its neighbour with most edges, and its own number, which is that of the rows
        around = counted.groupBy(F.col("b").alias("node")).agg(F.max(F.struct("n", F.col("a").alias("to"))).alias("best"), F.count(F.lit(1)).alias("n"))
        own = F.struct("n", F.col("node").alias("to"))
        up = stored(around.select("node", F.greatest("best", own)["to"].alias("to")), now)
        while True:  # paths to the roots are halved
            on = up.select(F.col("node").alias("to"), F.col("to").alias("further"))
            step: list[str] = []
            new = stored(up.join(on, "to").select("node", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("went")), step)
            done = new.where("went").isEmpty()
            for path in now:
                delete(spark, path)
            up, now = new.select("node", "to"), step
            if done:
                break
        ends = left.join(up.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges_left: list[str] = []
        left = stored(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), edges_left)
        for path in kept:
            delete(spark, path)
        maps, kept = [*maps, (up, now)], edges_left
    of = None
    for up, _ in reversed(maps):
        of = up if of is None else up.join(of.select(F.col("node").alias("to"), F.col("to").alias("root")), "to", "left").select("node", F.coalesce("root", "to").alias("to"))
    if of is None:
        found = cut_lineage(alone.select("node", F.col("node").alias("component")))
    else:
        of = of.unionByName(alone.join(of.select("node"), "node", "left_anti").select("node", F.col("node").alias("to")))
        of = stored(of, loops)
        found = cut_lineage(of.join(of.groupBy("to").agg(F.min("node").alias("component")), "to").select("node", "component"))
    for path in [*kept, *loops, *(path for _, paths in maps for path in paths)]:
        delete(spark, path)
    return found


def canonical(clusters: DataFrame, scores: DataFrame) -> DataFrame:
    """cluster, id of the node to keep: 10 * degree + props, then the shorter name, then the smaller id."""
    order = Window.partitionBy("cluster").orderBy(F.col("score").desc(), F.length("name"), "id")
    return clusters.join(scores, "id").withColumn("r", F.row_number().over(order)).where("r = 1").select("cluster", "id")


def merged_into(nodes: DataFrame, edges: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes, edges after each group(cluster, id) became its canonical node: props laid over its own, edges moved and merged."""
    ends = edges.select(F.col("src").alias("id"), "edge_id").unionByName(edges.where("src <> dst").select(F.col("dst").alias("id"), "edge_id"))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    scores = nodes.join(degree, "id", "left").select("id", "name", (10 * F.coalesce("degree", F.lit(0)) + F.size("props")).alias("score"))
    keep = canonical(groups, scores)
    remap = cut_lineage(groups.join(keep.select("cluster", F.col("id").alias("canon")), "cluster").where("id <> canon").select(F.col("id").alias("dup"), "canon"))
    kept = merge_props(nodes, remap).join(nodes.select("id", "labels"), "id")
    return cut_lineage(kept.select("id", "name", "labels", "props")), cut_lineage(move_edges(edges, remap))


def cleanup(nodes: DataFrame, edges: DataFrame, embed, threshold: float = 0.85, rel_threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes(id, name, labels, props), edges(edge_id, src, dst, rel_type, props) after a whole clean-up, in its order.

    Equal names become one node; the nodes that remain get their vectors from embed(nodes) -> id, embedding; kinds of edges with
    names alike become the shortest of them; nodes alike by label become one; parallel edges become one.
    """
    names = named(nodes).select("id", X.exact_key(F.col("name")).alias("cluster"))
    nodes, edges = merged_into(nodes, edges, names)
    kinds = edges.select("rel_type").distinct().select(F.lit(0).alias("block"), F.col("rel_type").alias("id"), F.replace("rel_type", F.lit("_"), F.lit(" ")).alias("name"), F.array(F.lit(1.0)).alias("embedding"))
    stars = cut_lineage(resolve.star_clusters(kinds, rel_threshold or threshold, "lexical"))
    members = stars.select("seed", "id").unionByName(stars.select("seed", F.col("seed").alias("id")).distinct())
    # the shortest of a cluster; of equally short ones the first
    to = members.groupBy("seed").agg(F.min_by("id", F.struct(F.length("id"), (F.col("id") != F.col("seed")).alias("later"), "id")).alias("kind")).join(members, "seed").select(F.col("id").alias("rel_type"), "kind")
    edges = edges.join(to, "rel_type", "left").withColumn("rel_type", F.coalesce("kind", "rel_type")).drop("kind")
    held = named(nodes).join(embed(nodes), "id", "left").select("id", "name", "labels", "embedding")
    found = cut_lineage(resolve.clusters(held, threshold))
    groups = found.select(F.col("seed").alias("cluster"), "id").unionByName(found.select(F.col("seed").alias("cluster"), F.col("seed").alias("id")).distinct())
    return merged_into(nodes, edges, groups)


def refined(nodes: DataFrame, edges: DataFrame, mention: str, chunks: DataFrame, top: int = 3, least: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """nodes, edges(src, rel_type, dst) after a whole refinement: properties folded, types as labels, MENTIONS of the chunks that
    an edge type names, SIMILAR_TO between chunks(vec_id, embedding)."""
    folded, left = fold_properties(nodes, edges)
    labelled = folded.withColumn("labels", F.array_union(F.array(F.lit("__Entity__")), F.array(F.col("props")["kind"])))
    mentions = left.where(F.col("rel_type") == mention).select(F.least("src", "dst").alias("src"), F.lit("MENTIONS").alias("rel_type"), F.greatest("src", "dst").alias("dst")).distinct()
    near = retrieval.nearest(chunks, chunks.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), top).where(F.col("score") > least)
    similar = near.select(F.col("query_id").cast("string").alias("src"), F.lit("SIMILAR_TO").alias("rel_type"), F.col("id").cast("string").alias("dst"))
    return labelled, left.select("src", "rel_type", "dst").unionByName(mentions).unionByName(similar)


def evidence(found: DataFrame, edges: DataFrame, mentions: DataFrame, chunks: DataFrame, per_entity: int = 10) -> DataFrame:
    """query_id, rank, id, rel_type, dst, chunk, text: of found(query_id, rank, id) the entities' first edges, and the text of the
    chunk that mentions each, where there is one. mentions(id, chunk), chunks(chunk, text)."""
    ids = checked_broadcast(found.select("id").distinct())
    first = Window.partitionBy("id").orderBy("edge_id")
    held = edges.withColumnRenamed("src", "id").join(ids, "id", "left_semi").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= per_entity).drop("_r")
    told = mentions.join(ids, "id", "left_semi").groupBy("id").agg(F.min("chunk").alias("chunk"))
    texts = chunks.join(checked_broadcast(told.select("chunk").distinct()), "chunk", "left_semi").select("chunk", "text")
    return found.join(held, "id").join(told, "id", "left").join(texts, "chunk", "left").select("query_id", "rank", "id", "rel_type", "dst", "chunk", "text")
