"""Paths of several edges: walks, trails, acyclic and shortest paths, as joins hop by hop.

All begin at a set of distinct starts (s, sl: key and label) and give a row a path: s, sl, t, tl, len and, where asked
for, the arrays nodes and rels and the cost. Loops whose number of rounds depends on the data cut their lineage each
round. What is joined by several keys each round is not broadcast (the hint): Spark takes 64 MB for such a table, however
small.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .expand import Edges

#: Hops up to which the joins are one plan; beyond, each hop is cut.
UNROLLED = 3


@dataclass(frozen=True)
class Wanted:
    """What a path's row has to hold."""

    nodes: bool = False
    rels: bool = False


class Paths:
    def __init__(self, edges: Edges, wanted: Wanted, rel: Column, node_of, node_test=None, weight: str | None = None) -> None:
        """rel: an edge as a struct; node_of(df): df with a column `node`, the struct of the node t; node_test: a filter for nodes within the path."""
        self.e, self.wanted, self.rel, self.node_of, self.node_test, self.weight = edges, wanted, rel, node_of, node_test, weight
        self.one_label = len({*edges.near_labels, *edges.far_labels}) == 1

    def ends(self, *names: str) -> list[str]:
        """The columns that tell nodes apart: labels only if there are several."""
        return [n for x in names for n in ([x] if self.one_label else [x, f"{x}l"])]

    def begin(self, starts: DataFrame) -> DataFrame:
        df = starts.select("s", "sl", F.col("s").alias("t"), F.col("sl").alias("tl"), F.lit(0).cast("long").alias("len"))
        if self.wanted.nodes:
            df = self.node_of(df).withColumn("nodes", F.array("node")).drop("node")
        if self.wanted.rels:
            df = df.withColumn("rels", F.array().cast(f"array<{self._rel_type()}>"))
        if self.weight:
            df = df.withColumn("cost", F.lit(0.0))
        return df

    def _rel_type(self) -> str:
        return self.e.df.select(self.rel.alias("r")).schema["r"].dataType.simpleString()

    def hop(self, df: DataFrame, keep: list[str] = (), keep_eid: bool = False) -> DataFrame:
        """Each row with each edge that goes on from its t."""
        e = self.e
        on = F.col("t") == F.col(e.near)
        if not self.one_label:
            on &= F.col("tl") == F.col(e.near_label)
        columns = ["s", "sl", F.col(e.far).alias("t2"), F.col(e.far_label).alias("tl2"), (F.col("len") + 1).alias("len"), *keep]
        if self.wanted.nodes:
            columns.append("nodes")
        if self.wanted.rels:
            columns.append(F.concat("rels", F.array(self.rel)).alias("rels"))
        if self.weight:
            columns.append((F.col("cost") + F.col(self.weight)).alias("cost"))
        if keep_eid:
            columns.append(F.col(e.rel.eid).alias("eid"))
        out = df.join(e.df, on).select(*columns).withColumnsRenamed({"t2": "t", "tl2": "tl"})
        return out

    def arrive(self, df: DataFrame) -> DataFrame:
        if not self.wanted.nodes:
            return df
        return self.node_of(df).withColumn("nodes", F.concat("nodes", F.array("node"))).drop("node")

    def walks(self, starts: DataFrame, low: int, high: int, mode: str, summed: bool = False, merged: bool = False) -> DataFrame:
        """Walks of low to high edges; trails repeat no edge, acyclic ones no node.

        summed: walks of one length between two nodes are one row, with their number in `n`; so a hop makes no more rows
        than there are pairs, however many walks there are. merged: where they began doesn't matter either; starts says
        in `n` how often each counts, and a hop makes no more rows than there are nodes.
        """
        seen = {"trail": "edges_seen", "acyclic": "nodes_seen"}.get(mode)
        now = self.begin(starts)
        if merged:
            now = starts.select(F.lit(None).cast(starts.schema["s"].dataType).alias("s"), F.lit(None).cast("string").alias("sl"), F.col("s").alias("t"), F.col("sl").alias("tl"), F.lit(0).cast("long").alias("len"), "n")
        elif summed:
            now = now.withColumn("n", F.lit(1).cast("long"))
        mark = F.struct("t", "tl") if not self.one_label else F.col("t")
        if mode == "trail":
            now = now.withColumn(seen, F.array().cast("array<bigint>"))
        if mode == "acyclic":
            now = now.withColumn(seen, F.array(mark))
        out = [now] if low == 0 else []
        for n in range(1, high + 1):
            if n > 1 and self.node_test is not None:
                now = self.node_test(now)
            now = self.hop(now, [seen] if seen else ["n"] if summed else [], mode == "trail")
            if summed and (n > 1 or merged):
                now = now.groupBy("s", "sl", "t", "tl", "len").agg(F.sum("n").alias("n"))
            if mode == "trail":
                now = now.where(~F.array_contains(seen, F.col("eid"))).withColumn(seen, F.array_append(seen, F.col("eid"))).drop("eid")
            if mode == "acyclic":
                now = now.where(~F.array_contains(seen, mark)).withColumn(seen, F.array_append(seen, mark))
            now = self.arrive(now)
            if high > UNROLLED:
                now = cut(now)
                if now.isEmpty():
                    break
            if n >= low:
                out.append(now)
        df = out[0] if out else now
        for more in out[1:]:
            df = df.unionByName(more)
        return df.drop(seen) if seen else df

    def shortest(self, starts: DataFrame, high: int, every: bool, targets: DataFrame | None = None) -> DataFrame:
        """For each start and each other node that it reaches, one of the shortest paths, or every one.

        targets: the pairs (s, sl, t, tl) that are asked for, if these are known. The search of a start ends with its last
        target.
        """
        keys = self.ends("s", "t")
        if targets is not None:
            targets = cut(targets.select("s", "sl", "t", "tl").distinct())
        now = cut(self.begin(starts))
        levels: list[DataFrame] = []
        visited = now.select(*keys)  # a union of levels that are written already
        for n in range(1, high + 1):
            if n > 1 and self.node_test is not None:
                now = self.node_test(now)
            found = self.hop(now).join(visited.hint("merge"), keys, "left_anti")
            if not every:
                rest = [c for c in found.columns if c not in keys]
                found = found.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("x")).select(*keys, "x.*")
            now = cut(self.arrive(found))
            if now.isEmpty():
                break
            levels.append(now)
            visited = visited.union(now.select(*keys))
            if targets is not None:
                targets = cut(targets.join(now.select(*keys).distinct().hint("merge"), keys, "left_anti"))
                if targets.isEmpty():
                    break
                now = now.join(targets.select(*self.ends("s")).distinct(), self.ends("s"), "left_semi")
        out = levels[0] if levels else now
        for level in levels[1:]:
            out = out.unionByName(level)
        return out

    @staticmethod
    def _cheapest(df: DataFrame, keys: list[str], *then: str) -> DataFrame:
        """The row of least cost of each key, of equal ones the least in the columns `then`."""
        order = ["cost", *then]
        rest = [c for c in df.columns if c not in keys and c not in order]
        return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("x")).select(*keys, "x.*")

    def _weights(self) -> bool:
        """Leaves out edges without a weight; an error if one is negative. Whether one is 0."""
        w = F.col(self.weight)
        if dict(self.e.df.dtypes)[self.weight] in ("double", "float"):
            w = F.when(~F.isnan(w), w)
        self.e = replace(self.e, df=self.e.df.where(w.isNotNull()))
        least = self.e.df.agg(F.min(w)).first()[0]
        if least is not None and least < 0:
            raise ValueError(f"the weight {least}: cheapest paths need weights that are not negative")
        return least == 0

    def weighted(self, starts: DataFrame, every: bool, targets: DataFrame | None = None, far: DataFrame | None = None) -> DataFrame:
        """For each start and each other node that it reaches, one of the cheapest paths, or every one.

        Edges without a weight (null or NaN) are no way; a negative weight is an error. Of several cheapest paths, those that
        visit a node twice (by edges of weight 0) are left out. targets: the pairs (s, sl, t, tl) that are asked for, if
        these are known; far: the ends (t, tl) that are asked for of every start. Nothing goes on that costs as much as the
        dearest of these.
        """
        zero = self._weights()
        keys, at = self.ends("s", "t"), self.ends("s")
        if targets is not None:
            targets = cut(targets.select(*keys).distinct())
        elif far is not None:
            far = cut(far.select(*self.ends("t")).distinct())
            asked_for = far.count()
        best = cut(self.begin(starts).withColumn("new", F.lit(1)))

        def going_on(best: DataFrame) -> DataFrame:
            """What the last round found, but for what costs as much as all that is asked for."""
            now = best.where("new = 1")
            if targets is not None:
                # a start goes on without bound until all of its targets are reached
                reached = targets.join(best.select(*keys, "cost").hint("merge"), keys, "left")
                bound = reached.groupBy(*at).agg(F.max(F.coalesce("cost", F.lit(float("inf")))).alias("bound"))
                return now.join(bound, at).where("cost < bound").drop("bound")
            if far is not None:
                reached = best.join(far, self.ends("t"), "left_semi").groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.max("cost").alias("bound")).where(F.col("n") == asked_for).drop("n")
                return now.join(reached, at, "left").where("bound is null or cost < bound").drop("bound")
            return now

        now = best
        while True:
            found = self.hop(now if self.node_test is None else self.node_test(now).union(now.where("len = 0")))
            if self.wanted.nodes:
                found = self.arrive(self._cheapest(found, keys, "len"))
            # one exchange a round: what is known and what is found meet by key, and of equal costs the known stays
            best = cut(self._cheapest(best.withColumn("new", F.lit(0)).unionByName(found.withColumn("new", F.lit(1))), keys, "new", "len"))
            now = going_on(best)
            if now.isEmpty():
                break
        best = best.drop("new")
        apart = (F.col("s") != F.col("t")) if self.one_label else (F.col("s") != F.col("t")) | (F.col("sl") != F.col("tl"))
        if targets is not None:
            asked = best.join(targets, keys, "left_semi").where(apart)
        if not every:
            return best.where(apart) if targets is None else asked
        # an edge is on a cheapest path if it closes the difference of its ends' costs
        cost = best.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col("cost").alias("known")).hint("merge")
        mark = F.col("t") if self.one_label else F.struct("t", "tl")
        now, out = self.begin(starts), None
        seen = ["visited"] if zero else []
        now = cut(now.withColumn("visited", F.array(mark)) if zero else now)
        while True:
            tight = self.hop(now, seen).join(cost, [F.col(k) == F.col(f"k_{k}") for k in keys]).where(F.abs(F.col("cost") - F.col("known")) <= 1e-9 * F.greatest(F.lit(1.0), F.col("known"))).drop("known", *[f"k_{k}" for k in keys])
            tight = tight.where(~F.array_contains("visited", mark)).withColumn("visited", F.array_append("visited", mark)) if zero else tight
            now = cut(self.arrive(tight.where(apart)))
            if now.isEmpty():
                break
            out = now if out is None else out.unionByName(now)
        if out is None:
            return best.limit(0)
        out = out.drop("visited")
        return out if targets is None else out.join(targets, keys, "left_semi")
