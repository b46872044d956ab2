"""Iterative operators on edge tables: upstream totals, closures, components, greedy orders.

Loops run on the driver, data stays in DataFrames. ``settle`` writes the state of each
round to the shared folder, which survives lost executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostrata.operators.state import settle


def closing_edges(held: list[tuple]) -> list[tuple]:
    """Edges (up, down) that close a cycle when the network is walked upstream, depth first, from the smallest node on."""
    ups: dict = {}
    for up, down in sorted(held):
        ups.setdefault(down, []).append(up)
    cut, path, seen = [], set(), set()
    for start in sorted(ups):
        if start in seen:
            continue
        stack = [(start, list(ups[start]))]
        seen.add(start)
        path.add(start)
        while stack:
            node, todo = stack[-1]
            if not todo:
                stack.pop()
                path.discard(node)
                continue
            up = todo.pop()
            if up in path:
                cut.append((up, node))
            elif up not in seen:
                seen.add(up)
                path.add(up)
                stack.append((up, list(ups.get(up, ()))))
    return cut


#: Edges held up by cycles that the driver takes.
HELD = 1_000_000


def upstream_totals(nodes: DataFrame, edges: DataFrame, most: int | None = None, cut_cycles: bool = False) -> DataFrame:
    """node, total: own length and that of everything upstream; where a line splits its total is divided evenly among the branches.

    nodes: node, length. edges: up, down; those from a node to itself don't count. By topological levels, each from the
    totals of the last, until no node is left. What a cycle holds stays null, or with ``cut_cycles`` cycles are cut where
    they close: edges that one holds up go to the driver, ``HELD`` at most, else an error. More than ``most`` levels, where a caller sets it, are an error.
    """
    edges = edges.where("up <> down")
    fan = edges.groupBy("up").agg(F.count("*").alias("ways"))
    for end in ("up", "down"):
        edges = edges.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    weighted = settle(edges.join(fan, "up").select("up", "down", "ways"))
    need = weighted.groupBy(F.col("down").alias("node")).agg(F.count("*").alias("need"))
    open_ = settle(nodes.join(need, "node", "left").select("node", F.col("length").cast("double").alias("total"), F.coalesce("need", F.lit(0)).alias("need")))
    done, level = None, 0
    while True:
        ready = open_.where("need = 0").select("node", "total")
        if ready.limit(1).count() == 0:
            if not cut_cycles:
                left = open_.select("node", F.lit(None).cast("double").alias("total"))
                return left if done is None else done.unionByName(left)
            held = weighted.join(open_.select(F.col("node").alias("up")), "up", "left_semi").select("up", "down").distinct()
            rows = held.limit(HELD + 1).collect()
            if not rows:
                return open_.select("node", "total") if done is None else done
            if len(rows) > HELD:
                raise ValueError(f"cycles hold up more than {HELD} edges")
            cut = held.sparkSession.createDataFrame(closing_edges([tuple(r) for r in rows]), held.schema)
            lost = weighted.join(cut, ["up", "down"], "left_semi").groupBy(F.col("down").alias("node")).agg(F.count("*").alias("lost"))
            open_ = settle(open_.join(lost, "node", "left").select("node", "total", (F.col("need") - F.coalesce("lost", F.lit(0))).alias("need")))
            weighted = settle(weighted.join(cut, ["up", "down"], "left_anti").select("up", "down", "ways"))
            continue
        if level == most:
            raise ValueError(f"more than {most} levels")
        level += 1
        done = ready if done is None else done.unionByName(ready)
        if level % 50 == 0:  # keeps the plan of the union short
            done = settle(done)
        sent = weighted.join(ready, weighted.up == ready.node).groupBy(F.col("down").alias("node")).agg(F.sum(F.col("total") / F.col("ways")).alias("more"), F.count("*").alias("got"))
        open_ = settle(open_.where("need > 0").join(sent, "node", "left").select("node", (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("need") - F.coalesce("got", F.lit(0))).alias("need")))


def closure(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b, depth) of every pair that a path joins, with the shortest depth; the frontier alone is joined in each round.

    Pairs more than ``most`` edges apart, where a caller sets it, are an error.
    """
    known = settle(edges.select("a", "b").distinct().withColumn("depth", F.lit(1)))
    frontier, depth = known, 1
    while True:
        depth += 1
        step = frontier.select("a", F.col("b").alias("_m")).join(edges.select(F.col("a").alias("_m"), "b").distinct(), "_m").select("a", "b").distinct()
        frontier = settle(step.join(known, ["a", "b"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.limit(1).count() == 0:
            return known
        if most is not None and depth > most:
            raise ValueError(f"paths of more than {most} edges")
        known = settle(known.unionByName(frontier))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): smallest node that each node of (a, b) edges reaches.

    In each round every node hooks onto its smallest neighbour where that is smaller, chains of hooks are halved until they
    are flat, and the edges are contracted to what still joins different nodes. A path of rising nodes is one round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = settle(both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
    open_ = settle(both.where("a <> b").distinct())
    while open_.limit(1).count():
        hook = settle(open_.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")))
        while True:
            up = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
            flat = settle(hook.join(up, "to").select("node", F.col("next").alias("to"), (F.col("next") < F.col("to")).alias("moved")))
            moved = flat.where("moved").limit(1).count()
            hook = settle(flat.select("node", "to"), hook, flat)
            if not moved:
                break
        a, b = (hook.select(F.col("node").alias(c), F.col("to").alias(f"_{c}")) for c in "ab")
        # nodes without an open edge keep their label
        label = settle(label.join(hook.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), label)
        open_ = settle(open_.join(a, "a").join(b, "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), open_, hook)
    return label


def _visits(touch: float, by_last: bool, most: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        if len(items) > most:
            raise ValueError(f"a group of more than {most} items")
        d = items.sort_values("item", kind="stable")
        item, x, y, r = (d[c].to_numpy() for c in ("item", "x", "y", "r"))
        n = len(d)
        at = dict(zip(item.tolist(), range(n), strict=True))
        parent = np.array([at.get(p, -1) for p in d["parent"].tolist()])
        parent[parent == np.arange(n)] = -1
        taken, covered, near = np.zeros(n, bool), np.zeros(n, bool), np.full(n, np.inf)
        out = []

        def take(k: int, why: str, promoted: bool, gap: float) -> np.ndarray:
            """Centre distances to the item that is taken; whatever lies within it, at any depth, is covered."""
            out.append((len(out), item[k], why, promoted, gap))
            taken[k] = True
            while (new := (parent >= 0) & (taken | covered)[parent] & ~covered).any():
                covered[new] = True
            far = np.sqrt((x - x[k]) ** 2 + (y - y[k]) ** 2)
            np.minimum(near, np.maximum(0, far - r - r[k]), out=near)
            return far

        last = take(0, "start", False, 0.0)
        while (left := np.flatnonzero(~(taken | covered))).size:
            close = left[(last if by_last else near)[left] <= touch]
            why, pool, gaps = ("touches", close, last) if close.size else ("closest", left, near)
            k = pool[np.argmin(gaps[pool])]  # the first of equals is the smallest item
            up = parent[k] if parent[k] >= 0 else k
            last = take(up, why, bool(up != k), gaps[k])
        told = pd.DataFrame(out, columns=["step", "item", "why", "promoted", "gap"])
        told.insert(0, "grp", items["grp"].iloc[0])
        return told

    return run


def visit_orders(items: DataFrame, touch: float, by_last: bool = False, most: int = 10_000) -> DataFrame:
    """grp, step, item, why, promoted, gap: the order in which the items of each group are visited, one group to a task.

    items: grp, item (unique in its group), parent (an item of the group that it lies within, or null), x, y, r (centre and
    radius). The smallest item starts. Next comes what touches: of the items within ``touch`` of any item visited so far (of
    the last one's centre, with ``by_last``) that whose centre is nearest to the last one's; if none touches, the item with the
    smallest gap to any visited; ties by item. An item with a parent gives way to it (``promoted``), and what lies within a
    visited item, at any depth, is visited with it and has no row. gap is the distance that decided. Rows without item or place
    have no part, a radius of null is 0, and rows without group are a group. Each step depends on all before, so a group is
    one task's work: memory grows with its items, no pairs are made, and more than ``most`` items are an error.
    """
    typed = items.select(
        F.col("grp").cast("long"), F.col("item").cast("long"), F.coalesce("parent", "item").cast("long").alias("parent"),
        F.col("x").cast("double"), F.col("y").cast("double"), F.coalesce(F.col("r").cast("double"), F.lit(0.0)).alias("r"),
    ).dropna(subset=["item", "x", "y"])
    return typed.groupBy("grp").applyInPandas(_visits(touch, by_last, most), "grp long, step int, item long, why string, promoted boolean, gap double")


def first_seen(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """First row of each value by order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(value).orderBy(*order))).where("_n = 1").drop("_n")


def compose_chains(links: DataFrame, product, most: int = 60) -> DataFrame:
    """(node, root, value): values along each node's chain of parents, composed from the root down.

    links: node, parent (null at a root), value; ``product`` composes two values. Pointers double in each round, so that
    a chain of length n takes log n joins. A node more than ``most`` links from its root, without one, or with a null on
    its chain, is null.
    """
    state = settle(links.select("node", "parent", "value", F.col("parent").isNotNull().cast("int").alias("far")))
    for _ in range(max(1, most.bit_length())):
        up = state.select(F.col("node").alias("_n"), F.col("parent").alias("_p"), F.col("value").alias("_v"), F.col("far").alias("_f"))
        on = F.col("_p").isNotNull()
        joined = state.join(up, state.parent == up._n, "left")
        further = [F.when(on, F.col("_p")).otherwise(F.col("parent")).alias("parent"), F.when(on, product(F.col("_v"), F.col("value"))).otherwise(F.col("value")).alias("value"), F.when(on, F.col("far") + F.col("_f")).otherwise(F.col("far")).alias("far")]
        state = settle(joined.select("node", *further), state)
        if state.join(state.select(F.col("node").alias("_n"), F.col("parent").alias("_p")), F.col("parent") == F.col("_n")).where("_p is not null").limit(1).count() == 0:
            break
    roots = links.where("parent is null").select(F.col("node").alias("root"), F.col("value").alias("_r"))
    near = state.withColumn("_to", F.when(F.col("far") <= most, F.coalesce("parent", "node")))
    own = near.join(roots, F.col("_to") == F.col("root"), "left")
    return own.select("node", "root", F.when(F.col("root").isNull(), None).when(F.col("parent").isNull(), F.col("value")).otherwise(product(F.col("_r"), F.col("value"))).alias("value"))
