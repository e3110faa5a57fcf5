"""Graph operators over edge tables."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window, functions as F

from foliant.storage import discard, materialize, parts_of


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node id reachable from each node that has an edge.

    Contracts the graph round by round: every node takes the name of the first of its neighbours, if that comes before
    itself, and edges are renamed, without loops and repeats, until none is left. The first round orders nodes by id,
    which takes away one whole side of a graph whose sides lie apart; later ones by a hash that is new every round, so
    that chains shrink too. Then the names are followed from the last round to the first. Every step is an aggregate with
    map-side combining or a sort-merge join of two written tables: both spill, and the engine can split a node with very
    many neighbours. Rounds keep the partitions of their shuffles.
    """
    pairs = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u <> v")
    pairs = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "components")
    names = []
    while not pairs.isEmpty():
        if len(names) == most_rounds:
            raise RuntimeError("components did not settle")
        at = lambda node: F.xxhash64(node, F.lit(len(names))) if names else F.col(node)  # noqa: B023, E731
        turned = at("u") < at("v")
        turned = pairs.select(F.when(turned, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(turned, F.col("u")).otherwise(F.col("v")).alias("v"))
        first = materialize(turned.groupBy(F.col("u").alias("node")).agg(F.min_by("v", at("v")).alias("name")), "components-names")
        ends = turned.join(first.select(F.col("node").alias("u"), F.col("name").alias("a")).hint("merge"), "u")
        ends = ends.join(first.select(F.col("node").alias("v"), F.col("name").alias("b")).hint("merge"), "v", "left").select("a", F.coalesce("b", "v").alias("b"))
        pairs = materialize(ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components", pairs)
        names.append(first)
    discard(pairs)
    if not names:
        return pairs.sparkSession.createDataFrame([], "node long, component long")
    last = names.pop()
    while names:
        first = names.pop()
        then = last.select(F.col("node").alias("name"), F.col("name").alias("then")).hint("merge")
        moved = first.join(then, "name", "left").select("node", F.coalesce("then", "name").alias("name"))
        last = materialize(moved.unionByName(last.join(first.hint("merge"), "node", "left_anti")), "components-names", first, last)
    least = materialize(last.groupBy("name").agg(F.least(F.min("node"), F.col("name")).alias("component")), "components-least")
    moved = last.where("node <> name").join(least.hint("merge"), "name").select("node", "component")
    return moved.unionByName(least.select(F.col("name").alias("node"), "component"))


def bipartite_edges(df: DataFrame, key: str, items: str) -> DataFrame:
    """One edge per distinct (key, item); rows without items have none."""
    return df.where(F.size(items) > 0).select(F.col(key), F.explode(F.array_distinct(F.col(items))).alias("item")).where(F.col("item").isNotNull()).distinct()


def degrees(edges: DataFrame, side: str) -> DataFrame:
    return edges.groupBy(side).agg(F.count(F.lit(1)).alias("degree"))


def graph_stats(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Edges, nodes of each side, nodes and mean degree with two digits, half to even."""
    counts = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct(left).alias("n_left"), F.count_distinct(right).alias("n_right"))
    nodes = F.col("n_left") + F.col("n_right")
    return counts.withColumns({"n_nodes": nodes, "mean_degree": F.bround(F.coalesce(F.try_divide(2.0 * F.col("n_edges"), nodes), F.lit(0.0)), 2)})


def two_hop(edges: DataFrame, start: DataFrame, left: str, right: str) -> DataFrame:
    """All edges of the left nodes that a start right node touches."""
    reached = edges.join(start.select(right).distinct(), right, "left_semi").select(left).distinct()
    return edges.join(reached, left, "left_semi")


def induced(edges: DataFrame, nodes: DataFrame, left: str, right: str, node: str = "node") -> DataFrame:
    """Edges with both ends among ``nodes``."""
    return edges.join(nodes.select(F.col(node).alias(left)), left, "left_semi").join(nodes.select(F.col(node).alias(right)), right, "left_semi")


def giant_component(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Edges of the largest component (ties: the smallest id); node ids must be numbers of one space."""
    edges = materialize(edges, "giant-edges")
    parts = materialize(connected_components(edges, left, right), "giant")
    largest = parts.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "component").limit(1)
    nodes = parts.join(F.broadcast(largest), "component", "left_semi").select(F.col("node").alias(left))  # one row
    return edges.join(nodes, left, "left_semi")


def node_indices(nodes: DataFrame, node: str, part_rows: int = 1_000_000) -> DataFrame:
    """Contiguous indices from 0 in node order without a window over all nodes: sorted ranges, offsets by their counts."""
    distinct = materialize(nodes.select(node).distinct(), "node-list")
    parts = 1 + distinct.count() // part_rows
    ranged = materialize(distinct.repartitionByRange(parts, node).withColumn("_b", F.spark_partition_id()), "node-ranges", distinct)
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for a million nodes
    offsets = ranged.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    at = F.row_number().over(Window.partitionBy("_b").orderBy(node))
    return ranged.withColumn("_at", at).join(F.broadcast(offsets), "_b").select(node, (F.col("_o") + F.col("_at") - 1).alias("index"))


def edge_index(edges: DataFrame, left: str, right: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges by the contiguous indices of both sides (``left_index, right_index``), and both sides' indices."""
    lefts, rights = node_indices(edges, left), node_indices(edges, right)
    named = edges.join(lefts.withColumnRenamed("index", "left_index"), left).join(rights.withColumnRenamed("index", "right_index"), right)
    return named.select("left_index", "right_index"), lefts, rights


def left_features(lefts: DataFrame, vectors: DataFrame, node: str, vector: str) -> DataFrame:
    """A vector for each indexed node; a missing or a zero one raises."""
    both = lefts.join(vectors.select(node, vector), node, "left")
    fine = F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    return both.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit("a node without a vector")).cast("boolean"))).select("index", F.col(vector).alias("features"))


def right_features(rights: DataFrame) -> DataFrame:
    """The identity matrix of the right side, a row as the index of its one."""
    return rights.select("index", F.col("index").alias("one_at"))


def is_connected(edges: DataFrame, left: str, right: str) -> DataFrame:
    """One row: number of components and whether there is just one."""
    parts = connected_components(edges, left, right).agg(F.count_distinct("component").alias("n_components"))
    return parts.withColumn("connected", F.col("n_components") == 1)


def is_bipartite(edges: DataFrame, left: str, right: str) -> DataFrame:
    """One row: nodes that are on both sides and whether there are none."""
    both = edges.select(F.col(left).alias("n")).distinct().join(edges.select(F.col(right).alias("n")).distinct(), "n", "left_semi")
    return both.agg(F.count(F.lit(1)).alias("n_on_both_sides")).withColumn("bipartite", F.col("n_on_both_sides") == 0)


def label_propagation(edges: DataFrame, left: str, right: str, most_rounds: int = 50) -> DataFrame:
    """``node, label``: communities by most frequent neighbour label, ties to the smallest label.

    A node's own label counts once, which ends the swapping of labels between two sides. Rounds end when no label
    changes; labels that still do after ``most_rounds`` are an error. Votes are counted by (node, label) with
    map-side combining.
    """
    both = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
    parts = parts_of(edges)
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "label-edges", parts=parts)
    held = materialize(both.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node")), "labels", parts=parts)
    labels = held
    for _ in range(most_rounds):
        heard = both.join(labels.withColumnRenamed("node", "v"), "v").select("u", "label").unionByName(labels.withColumnRenamed("node", "u"))
        votes = heard.groupBy("u", "label").agg(F.count(F.lit(1)).alias("n"))
        chosen = votes.groupBy(F.col("u").alias("node")).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("chosen"))
        new = materialize(chosen.join(labels, "node"), "label-votes", held, parts=parts)
        held, labels = new, new.select("node", F.col("chosen").alias("label"))
        if not new.where("label <> chosen").limit(1).count():
            discard(both)
            return labels
    raise RuntimeError(f"labels still change after {most_rounds} rounds")


def modularity(edges: DataFrame, communities: DataFrame, left: str, right: str, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of ``node, label`` over undirected edges, each counted once."""
    ends = edges.select(F.col(left).alias("a"), F.col(right).alias("b"))
    named = ends.join(communities.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(communities.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    inner = named.agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("la") == F.col("lb")).alias("inner"))
    degree = named.select(F.col("la").alias("l")).unionByName(named.select(F.col("lb").alias("l"))).groupBy("l").agg(F.count(F.lit(1)).alias("k"))
    spread = degree.agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("s"))
    return inner.join(F.broadcast(spread), F.lit(True)).select((F.col("inner") / F.col("m") - resolution * F.col("s") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"))


def connected_parts(edges: DataFrame, communities: DataFrame, left: str, right: str) -> DataFrame:
    """Communities (``node, label``) cut into their connected parts, each named by its smallest node.

    A part keeps all edges that its nodes have inside the community, so modularity only grows.
    """
    a, b = (communities.select(F.col("node").alias(n), F.col("label").alias(f"l_{n}")) for n in ("a", "b"))
    ends = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    inside = ends.join(a, "a").join(b, "b").where("l_a = l_b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    parts = connected_components(inside)
    return communities.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("label"))


def with_lone_nodes(communities: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """``node, label``: the communities, and every one of ``nodes`` that no edge touches as a community of its own."""
    lone = nodes.select(F.col(node).cast("long").alias("node")).distinct().join(communities, "node", "left_anti")
    return communities.unionByName(lone.select("node", F.col("node").alias("label")))


def community_sizes(communities: DataFrame) -> DataFrame:
    """``size, n``: how many communities have how many nodes."""
    return communities.groupBy("label").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def leiden(edges: DataFrame, left: str, right: str, resolution: float = 1.0, most_levels: int | None = None, most_rounds: int = 10) -> DataFrame:
    """``node, label``: as ``louvain``, with communities cut into their connected parts before they become nodes of the
    next level, so every community is connected."""
    return louvain(edges, left, right, resolution, most_levels, most_rounds, refined=True)


def louvain(edges: DataFrame, left: str, right: str, resolution: float = 1.0, most_levels: int | None = None, most_rounds: int = 10, refined: bool = False) -> DataFrame:
    """``node, label``: communities by greedy gains of modularity, level by level.

    In a round every node looks at the communities of its neighbours, and of those that would gain, half (by a hash
    that is new every round, so that no two nodes change places for ever) move to the one of largest gain, ties to
    the smallest label; a move needs a positive gain. When no node would gain, or after ``most_rounds``, communities
    become the nodes of the next level, their edges summed. It ends with a level on which no node would gain from the
    start, or after ``most_levels`` if that is given. Neighbours' weights are summed by (node, community) with
    map-side combining.
    """
    parts = parts_of(edges)
    ends = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
    weighted = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u", "v").agg(F.count(F.lit(1)).cast("double").alias("w"))
    weighted = materialize(weighted, "louvain-edges", parts=parts)
    whole = None
    for level in count() if most_levels is None else range(most_levels):
        total = weighted.agg(F.sum("w")).first()[0]
        if not total:
            break
        strength = materialize(weighted.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")), "louvain-strength", parts=parts)
        labels = strength.select("node", F.col("node").alias("label"))
        settled, held = False, []
        for turn in range(most_rounds):
            sums = strength.join(labels, "node").groupBy("label").agg(F.sum("k").alias("s"))
            own = strength.join(labels, "node").join(sums, "label")
            heard = weighted.where("u <> v").join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node"), "label").agg(F.sum("w").alias("w"))
            gains = heard.join(sums, "label").join(own.select("node", "k", F.col("label").alias("mine"), F.col("s").alias("mine_s")), "node")
            stay = F.when(F.col("label") == F.col("mine"), F.col("s") - F.col("k")).otherwise(F.col("s"))
            gains = gains.withColumn("gain", F.col("w") - resolution * F.col("k") * stay / total)
            best = gains.groupBy("node", "mine", "k", "mine_s").agg(F.min(F.struct((-F.round("gain", 9)).alias("g"), "label")).alias("b"), F.max(F.when(F.col("label") == F.col("mine"), F.col("gain"))).alias("here"))
            alone = -resolution * F.col("k") * (F.col("mine_s") - F.col("k")) / total  # staying without a neighbour there
            gain = (-F.col("b.g") > F.coalesce("here", alone) + 1e-9) & (-F.col("b.g") > 0) & (F.col("b.label") != F.col("mine"))
            turns = F.pmod(F.xxhash64("node", F.lit(level), F.lit(turn)), F.lit(2)) == 0
            step = best.select("node", gain.alias("gains"), F.when(gain & turns, F.col("b.label")).otherwise(F.col("mine")).alias("to"))
            new = labels.join(step, "node", "left").select("node", F.coalesce("to", "label").alias("label"), F.coalesce("gains", F.lit(False)).alias("gains"))
            new = materialize(new, "louvain-labels", *held, parts=parts)
            held = [new]
            settled = not new.where("gains").limit(1).count()
            labels = new.select("node", "label")
            if settled:
                break
        if settled and turn == 0 and whole is not None:
            break
        if refined:
            labels = materialize(connected_parts(weighted, labels, "u", "v"), "louvain-parts", *held, parts=parts)
            held = [labels]
        before = [whole] if whole is not None else []
        whole = labels if whole is None else whole.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", F.col("next").alias("label"))
        whole = materialize(whole, "louvain-communities", *before, parts=parts)
        names = labels.select(F.col("node").alias("u"), F.col("label").alias("lu"))
        summed = weighted.join(names, "u").join(names.select(F.col("u").alias("v"), F.col("lu").alias("lv")), "v").groupBy(F.col("lu").alias("u"), F.col("lv").alias("v")).agg(F.sum("w").alias("w"))
        weighted = materialize(summed, "louvain-edges", weighted, strength, *held, parts=parts)
    return whole if whole is not None else ends.select(F.col("u").alias("node"), F.col("u").alias("label"))
