"""Community detection on the weighted tag graph (G5-G7), as iterative DataFrame jobs.

Graph input: edges (src, dst, weight) with src <= dst; src == dst is a loop. Tags are strings.
Objective (G6): resolution modularity Q = sum_C [ w_in(C) / m - gamma * (K_C / 2m)^2 ] with
m = total edge weight, K_C = summed node strength (a loop counts twice), w_in = internal weight.

Local moving (Blondel et al. 2008) in rounds of one job each: every node finds its best neighbouring
community or a new one of its own, and a share of the nodes (by hash of node and round) moves there. A
round that doesn't raise Q is taken back and the share halved; below the least share only moves that touch
no community in common are made, whose gains add up, so Q must rise. It ends when no node gains by moving.

Louvain contracts communities into nodes (internal weight becomes loops) and moves those, level by
level. Leiden (Traag et al. 2019) first refines each community: its nodes, alone at first, merge only into
connected and well-connected parts of it; contraction is on those parts, which start out in their
community. Both go back to single tags when no level moves anything, and end when no tag gains either: the
result is a local optimum (``unsettled`` counts what still gains). Leiden's communities are connected since
each ends as one part; Louvain's are split where they aren't, and moving goes on.

The driver reads a few numbers a round; states are tables in spark.checkpoint.dir, dropped as they are
replaced.
"""

from __future__ import annotations

from itertools import count

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_state, state_path
from ..session import materialize as cut_lineage  # state of a loop, as a table

EPS = 1e-9
#: Shares of nodes that a round moves: 1/2, 1/4 ... 1/2^LEAST_SHARE, then independent moves.
LEAST_SHARE = 4
_LOG = None  # optional callable(str) for progress of the iterative loops


def _log(msg: str) -> None:
    if _LOG is not None:
        _LOG(msg)


def strengths(edges: DataFrame) -> DataFrame:
    """(node, k): incident weight per node, loops counted twice."""
    ends = edges.select(F.col("src").alias("node"), "weight").unionByName(edges.select(F.col("dst").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.sum("weight").alias("k"))


def symmetric(edges: DataFrame) -> DataFrame:
    """(a, b, weight) both directions, loops dropped."""
    e = edges.filter(F.col("src") != F.col("dst"))
    return (e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
             .unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"), "weight")))


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0,
               node_col: str = "tag", comm_col: str = "cluster_id") -> DataFrame:
    """One row (modularity, total_weight, communities) for a node -> community map."""
    mem = membership.select(F.col(node_col).alias("n"), F.col(comm_col).alias("c"))
    ea = edges.join(mem.withColumnRenamed("n", "src").withColumnRenamed("c", "ca"), "src") \
              .join(mem.withColumnRenamed("n", "dst").withColumnRenamed("c", "cb"), "dst")
    w_in = ea.filter(F.col("ca") == F.col("cb")).groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("w_in"))
    kc = strengths(edges).join(mem.withColumnRenamed("n", "node"), "node").groupBy("c").agg(F.sum("k").alias("K"))
    m = edges.select(F.sum("weight")).scalar()
    per = kc.join(w_in, "c", "left").select(F.coalesce("w_in", F.lit(0.0)).alias("w_in"), "K")
    return per.agg(
        (F.sum("w_in") / m - F.lit(float(resolution)) * F.sum(F.col("K") * F.col("K")) / (F.lit(4.0) * m * m)).alias("modularity"),
        F.count(F.lit(1)).alias("communities")).withColumn("total_weight", m)


class _Kept:
    """Tables of a loop: put writes one, only_keep drops all but those still read."""

    def __init__(self, spark, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def put(self, df: DataFrame) -> DataFrame:
        path = state_path(self.spark, self.name)
        df.write.parquet(path)
        out = self.spark.read.parquet(path)
        self.paths[path] = out
        return out

    def only_keep(self, *frames: DataFrame | None) -> None:
        for path in [p for p, df in self.paths.items() if all(df is not f for f in frames)]:
            del self.paths[path]
            drop_state(self.spark, path)


def _share(node_col: str, rnd: int, share: int):
    """One node in 2^share, by hash of node and round."""
    return F.pmod(F.xxhash64(F.col(node_col), F.lit(f"{rnd}")), F.lit(1 << share)) == 0


class Level:
    """A graph as the loops read it: edges, nodes (node, k), around (a, k, b, weight: both directions of every edge but loops).

    around is dealt by b and kept so for the joins of all rounds; what an executor loses is read again from its table.
    """

    def __init__(self, edges: DataFrame):
        self.spark, self.edges = edges.sparkSession, edges
        self.nodes = cut_lineage(strengths(edges), "nodes")
        m, loops = edges.agg(F.sum("weight"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")))).collect()[0]
        self.m, self.loops = m or 0.0, loops or 0.0
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        both = symmetric(edges).join(self.nodes.select(F.col("node").alias("a"), "k"), "a").select("a", "k", "b", "weight")
        self.around = cut_lineage(both, "around").repartition(parts, "b").persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        self.around.unpersist()


def proposals(around: DataFrame, state: DataFrame, gamma: float, m: float) -> DataFrame:
    """What each node would do next: node, k, comm, big (its community's strength), own (weight into it), gain, target.

    around: neighbours; state: (node, k, comm). target null: a community of its own.
    """
    big = state.groupBy(F.col("comm").alias("cb")).agg(F.sum("k").alias("big"))
    met = around.join(state.select(F.col("node").alias("b"), F.col("comm").alias("cb")), "b").select(
        "a", "k", "cb", "weight", F.lit(False).alias("own"))
    here = state.select(F.col("node").alias("a"), "k", F.col("comm").alias("cb"), F.lit(0.0).alias("weight"), F.lit(True).alias("own"))
    into = met.unionByName(here).groupBy("a", "k", "cb").agg(F.sum("weight").alias("w"), F.max("own").alias("own")).join(big, "cb")
    pull = F.lit(float(gamma) / (2.0 * m)) * F.col("k")
    away = F.when(~F.col("own"), F.struct(F.round(pull * F.col("big") - F.col("w"), 9).alias("s"), F.col("cb").alias("c")))
    each = into.groupBy(F.col("a").alias("node"), "k").agg(
        F.max(F.when(F.col("own"), F.col("cb"))).alias("comm"), F.max(F.when(F.col("own"), F.col("big"))).alias("big"),
        F.max(F.when(F.col("own"), F.col("w"))).alias("own"), F.min(away).alias("best"))
    stay = F.col("own") - F.lit(float(gamma) / (2.0 * m)) * F.col("k") * (F.col("big") - F.col("k"))
    there = -F.col("best.s")
    join_best = F.coalesce(there >= 0, F.lit(False))  # a community of its own scores 0
    return each.select("node", "k", "comm", "big", "own", (F.when(join_best, there).otherwise(0.0) - stay).alias("gain"),
                       F.when(join_best, F.col("best.c")).alias("target"))


def independent(wanted: DataFrame) -> DataFrame:
    """Of moves (node, comm, gain, target) those that gain most among all that touch either of their communities."""
    touched = wanted.select("node", "gain", F.explode(F.array("comm", "target")).alias("c"))
    first = touched.groupBy("c").agg(F.max(F.struct("gain", "node")).alias("f")).select("c", F.col("f.node").alias("node"))
    both = touched.join(first, ["c", "node"], "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(both.where("n = 2"), "node", "left_semi")


def local_moving(level: Level, start: DataFrame | None = None, gamma: float = 1.0) -> tuple[DataFrame, bool]:
    """(node, comm) of a partition in which no node gains by moving, and whether any moved on the way.

    start: (node, comm) to begin with, each node alone if None. Communities that changed are named by their first node."""
    nodes, m, around = level.nodes, level.m, level.around
    if start is None:
        start = nodes.select("node", F.col("node").alias("comm"))
    if m <= 0:
        return start, False
    first = nodes.join(start.select("node", "comm"), "node")
    kept = _Kept(level.spark, "moves")
    state, best, best_q, wanted, share, free, moved = kept.put(first), None, 0.0, 0, 1, False, False
    for rnd in count():
        now = kept.put(proposals(around, state, gamma, m))
        n, own, squares = now.agg(F.sum((F.col("gain") > EPS).cast("long")), F.sum("own"), F.sum(F.col("k") * F.col("big"))).collect()[0]
        q = (own / 2 + level.loops) / m - gamma * squares / (4 * m * m)
        _log(f"round {rnd}: {n} nodes gain, Q={q:.6f}, share 1/{1 << share}")
        if best is None or q > best_q or free:
            moved, share = moved or best is not None, max(1, share - 1)
            best, best_q, wanted = now, q, n
        else:
            share += 1
        if wanted == 0:
            break
        kept.only_keep(best)
        free = share > LEAST_SHARE
        gains, new = F.col("gain") > EPS, F.coalesce("target", F.concat("node", F.lit(f"\0{rnd}")))
        if free:
            moves = independent(best.where(gains).select("node", "comm", "gain", new.alias("target"))).select("node", "target")
            state = kept.put(best.select("node", "k", "comm").join(moves, "node", "left").select(
                "node", "k", F.coalesce("target", "comm").alias("comm")))
        else:
            state = best.select("node", "k", F.when(gains & _share("node", rnd, share), new).otherwise(F.col("comm")).alias("comm"))
    out = cut_lineage(named(best.select("node", "comm")), "communities") if moved else start
    kept.only_keep()
    return out, moved


def named(memb: DataFrame) -> DataFrame:
    """(node, comm) with each community named by its first node."""
    first = memb.groupBy("comm").agg(F.min("node").alias("name"))
    return memb.join(first, "comm").select("node", F.col("name").alias("comm"))


def unsettled(edges: DataFrame, memb: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Nodes that would gain more than EPS by moving (node, gain, target): none, for a local optimum of Q. memb: (node, comm)."""
    level = Level(_weighted(edges))
    state = level.nodes.join(memb.select("node", "comm"), "node")
    return proposals(level.around, state, gamma, level.m or 1.0).where(F.col("gain") > EPS).select("node", "gain", "target")


def refine(level: Level, memb: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(node, part): Leiden's refinement of a partition (node, comm).

    Each node of a community starts alone and may once join another part of its community: one that it has an
    edge to, that is well connected to the rest of the community, and that makes Q no worse. Nodes that move
    and parts that receive are told apart by a coin each round, so what is joined stays, and parts are
    connected. Of the nodes that would join a part those do that gain even if all of them were there
    (without the edges among them), and the one that gains most.
    """
    nodes = level.nodes.join(memb.select("node", "comm"), "node")
    if level.m <= 0:
        return cut_lineage(nodes.select("node", F.col("node").alias("part")), "parts")
    scale = F.lit(float(gamma) / (2.0 * level.m))
    inner = (level.around.join(memb.select(F.col("node").alias("b"), F.col("comm").alias("cb")), "b")
             .join(memb.select(F.col("node").alias("a"), F.col("comm").alias("ca")), "a")
             .where(F.col("ca") == F.col("cb")).select("a", "k", "b", "weight"))
    parts = int(level.spark.conf.get("spark.sql.shuffle.partitions"))
    inner = cut_lineage(inner, "inner").repartition(parts, "b").persist(StorageLevel.MEMORY_AND_DISK)
    within = inner.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("within"))
    whole = nodes.groupBy("comm").agg(F.sum("k").alias("whole"))
    kept = _Kept(level.spark, "refined")
    state = kept.put(nodes.join(whole, "comm").join(within, "node", "left").select(
        "node", "k", "whole", F.coalesce("within", F.lit(0.0)).alias("within"), F.col("node").alias("part")))
    for rnd in count():
        met = inner.join(state.select(F.col("node").alias("b"), F.col("part").alias("pb")), "b").select(
            "a", "pb", "k", "weight", F.lit(None).cast("double").alias("whole"), F.lit(None).cast("double").alias("within"))
        here = state.select(F.col("node").alias("a"), F.col("part").alias("pb"), "k", F.lit(0.0).alias("weight"), "whole", "within")
        into = met.unionByName(here).groupBy("a", "pb").agg(F.sum("weight").alias("w"), F.max("k").alias("k"), F.max("whole").alias("whole"),
                                                            F.max("within").alias("within"))
        own = F.col("whole").isNotNull()
        parts = into.where(own).groupBy("pb").agg(
            F.sum("k").alias("big"), (F.count(F.lit(1)) == 1).alias("single"),
            (F.sum(F.col("within") - F.col("w")) >= scale * F.sum("k") * (F.max("whole") - F.sum("k")) - EPS).alias("fine"))
        gain = F.col("w") - scale * F.col("k") * F.col("big")
        offer = F.struct(F.round(gain, 9).alias("gain"), "pb", "single")
        each = into.join(parts, "pb").groupBy(F.col("a").alias("node")).agg(
            F.max("k").alias("k"), F.max("whole").alias("whole"), F.max("within").alias("within"), F.max(F.when(own, F.col("pb"))).alias("part"),
            F.max(own & F.col("single") & F.col("fine")).alias("free"),
            F.max(F.when(~own & F.col("fine") & (gain > -EPS), offer)).alias("to"))
        wish = kept.put(each.withColumn("to", F.when(F.col("free"), F.col("to"))).drop("free"))
        if wish.where(F.col("to").isNotNull()).isEmpty():
            break
        ready = wish.where(_share("node", rnd, 1) & (~F.col("to.single") | ~_share("to.pb", rnd, 1))).select(
            "node", "k", F.col("to.gain").alias("gain"), F.col("to.pb").alias("pb"))
        sums = ready.groupBy("pb").agg(F.sum("k").alias("all"), F.max(F.struct("gain", "node"))["node"].alias("first"))
        together = F.col("gain") - scale * F.col("k") * (F.col("all") - F.col("k")) > -EPS
        moves = ready.join(sums, "pb").where(together | (F.col("node") == F.col("first"))).select("node", "pb")
        state = kept.put(wish.drop("to").join(moves, "node", "left").select(
            "node", "k", "whole", "within", F.coalesce("pb", "part").alias("part")))
        kept.only_keep(state)
        _log(f"refinement round {rnd}")
    out = cut_lineage(state.select("node", "part"), "parts")
    kept.only_keep()
    inner.unpersist()
    return out


def contract(edges: DataFrame, memb: DataFrame) -> DataFrame:
    """Communities become nodes; parallel edges are summed, internal weight becomes loops."""
    ea = (edges.join(memb.select(F.col("node").alias("src"), F.col("comm").alias("ca")), "src")
               .join(memb.select(F.col("node").alias("dst"), F.col("comm").alias("cb")), "dst"))
    return ea.groupBy(F.least("ca", "cb").alias("src"), F.greatest("ca", "cb").alias("dst")).agg(F.sum("weight").alias("weight"))


def split_disconnected(edges: DataFrame, memb: DataFrame) -> DataFrame:
    """Connected components inside each community; community id = component's min node.

    Each round a node takes the smallest label of itself and its neighbours, and then the label
    that this label's node has (pointer jumping), so rounds grow with the logarithm of a component's
    length. Rounds go on until one changes nothing.
    """
    label = cut_lineage(memb.select("node", F.col("node").alias("lab")))
    intra = cut_lineage(symmetric(edges).join(memb.select(F.col("node").alias("a"), F.col("comm").alias("ca")), "a")
                        .join(memb.select(F.col("node").alias("b"), F.col("comm").alias("cb")), "b")
                        .filter(F.col("ca") == F.col("cb")).select("a", "b"))
    while True:
        nb = intra.join(label.select(F.col("node").alias("b"), F.col("lab").alias("lb")), "b").groupBy("a").agg(F.min("lb").alias("mn"))
        near = cut_lineage(label.join(nb.withColumnRenamed("a", "node"), "node", "left").select(
            "node", F.col("lab").alias("old"), F.least("lab", F.coalesce("mn", "lab")).alias("lab")))
        target = near.select(F.col("node").alias("lab"), F.col("lab").alias("further"))
        new = cut_lineage(near.join(target, "lab", "left").select("node", "old", F.least("lab", F.coalesce("further", "lab")).alias("lab")))
        label = new.select("node", "lab")
        if new.filter(F.col("lab") != F.col("old")).isEmpty():
            return label.select("node", F.col("lab").alias("comm"))


def _weighted(edges: DataFrame) -> DataFrame:
    return cut_lineage(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"),
                                    F.col("weight").cast("double").alias("weight")), "edges")


def _through(mapping: DataFrame, memb: DataFrame) -> DataFrame:
    """(tag, comm) followed by (node, comm) of the communities."""
    return cut_lineage(mapping.join(memb.select(F.col("node").alias("comm"), F.col("comm").alias("next")), "comm")
                       .select("tag", F.col("next").alias("comm")), "mapping")


def _sizes(memb: DataFrame) -> tuple[int, int]:
    """(nodes, communities) of (node, comm)."""
    return memb.agg(F.count(F.lit(1)), F.count_distinct("comm")).collect()[0]


def _contracted(level: Level, memb: DataFrame, base: Level) -> Level:
    """The next level; the one below goes, unless it is the base."""
    out = Level(cut_lineage(contract(level.edges, memb), "level"))
    if level is not base:
        level.close()
    return out


def louvain(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(tag, comm), a connected local optimum, before numbering by G7. comm is a member tag."""
    base = Level(_weighted(edges))
    flat, moved = local_moving(base, None, resolution)
    while moved:
        mapping = flat.select(F.col("node").alias("tag"), "comm")
        level, memb = base, flat
        while True:  # each level that moves anything has fewer nodes
            level = _contracted(level, memb, base)
            memb, up = local_moving(level, None, resolution)
            if not up:
                break
            mapping = _through(mapping, memb)
        level.close()
        whole = named(split_disconnected(base.edges, mapping.select(F.col("tag").alias("node"), "comm")))
        flat, moved = local_moving(base, cut_lineage(whole, "communities"), resolution)
    base.close()
    return flat.select(F.col("node").alias("tag"), "comm")


def leiden(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(tag, comm) by local moving, refinement and contraction on the refined parts, until no tag gains by moving."""
    base = Level(_weighted(edges))
    flat, moved = local_moving(base, None, resolution)
    while moved:
        mapping = base.nodes.select(F.col("node").alias("tag"), F.col("node").alias("comm"))
        level, memb = base, flat
        n, communities = _sizes(memb)
        while n > communities:  # until every community is one part
            parts = refine(level, memb, resolution)
            if _sizes(parts.withColumnRenamed("part", "comm"))[1] == n:  # only if rounding hides every merge: then connected pieces
                parts = split_disconnected(level.edges, memb).withColumnRenamed("comm", "part")
            by_part = parts.withColumnRenamed("part", "comm")
            mapping = _through(mapping, by_part)
            inside = cut_lineage(parts.join(memb, "node").groupBy(F.col("part").alias("node")).agg(F.min("comm").alias("comm")), "inside")
            level = _contracted(level, by_part, base)
            memb, _ = local_moving(level, inside, resolution)
            n, communities = _sizes(memb)
        if level is not base:
            level.close()
        mapping = _through(mapping, memb)
        flat, moved = local_moving(base, mapping.select(F.col("tag").alias("node"), "comm"), resolution)
    base.close()
    return flat.select(F.col("node").alias("tag"), "comm")


def heaviest(around: DataFrame, lab: DataFrame) -> DataFrame:
    """What label each node would take: node, comm, target. lab: (node, comm); target: the neighbours' heaviest label, ties: the smallest."""
    votes = (around.join(lab.select(F.col("node").alias("b"), F.col("comm").alias("lb")), "b")
                   .groupBy("a", "lb").agg(F.sum("weight").alias("w")))
    best = votes.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.round(-F.col("w"), 9).alias("nw"), F.col("lb"))).alias("x"))
    return lab.join(best, "node", "left").select("node", "comm", F.coalesce("x.lb", "comm").alias("target"))


def label_propagation(edges: DataFrame, limit: int = 500) -> DataFrame:
    """Deterministic weighted label propagation (Raghavan et al. 2007): each round one half
    of the nodes takes the neighbour label of largest total weight (ties: smallest label), until every
    node carries its best label. A graph that hasn't settled after limit rounds raises an error."""
    edges = _weighted(edges)
    around = cut_lineage(symmetric(edges), "around")
    kept = _Kept(edges.sparkSession, "labels")
    lab = strengths(edges).select("node", F.col("node").alias("comm"))
    for rnd in range(limit):
        now = kept.put(heaviest(around, lab))
        kept.only_keep(now)
        if now.where("target != comm").isEmpty():
            return split_disconnected(edges, now.select("node", "comm")).select(F.col("node").alias("tag"), "comm")
        lab = now.select("node", F.when(_share("node", rnd, 1), F.col("target")).otherwise(F.col("comm")).alias("comm"))
    raise RuntimeError(f"labels haven't settled in {limit} rounds")


def unsettled_labels(edges: DataFrame, memb: DataFrame) -> DataFrame:
    """Nodes with a neighbour label heavier than their own (node). memb: (node, comm)."""
    around = symmetric(edges)
    votes = (around.join(memb.select(F.col("node").alias("b"), F.col("comm").alias("lb")), "b")
                   .groupBy(F.col("a").alias("node"), "lb").agg(F.round(F.sum("weight"), 9).alias("w")))
    own = votes.join(memb.select("node", F.col("comm").alias("lb")), ["node", "lb"]).select("node", F.col("w").alias("mine"))
    top = votes.groupBy("node").agg(F.max("w").alias("top"))
    return top.join(own, "node", "left").where(F.col("top") > F.coalesce("mine", F.lit(0.0))).select("node")


def number_clusters(assign: DataFrame) -> DataFrame:
    """(tag, cluster_id) with ids ranked by (size desc, smallest member tag). The ranking runs
    over one row per community (bounded by the vocabulary)."""
    sizes = assign.groupBy("comm").agg(F.count(F.lit(1)).alias("size"), F.min("tag").alias("first_tag"))
    ids = sizes.select("comm", (F.row_number().over(Window.orderBy(F.col("size").desc(), F.col("first_tag").asc())) - 1)
                       .cast("bigint").alias("cluster_id"))
    return assign.join(ids, "comm").select("tag", "cluster_id")
