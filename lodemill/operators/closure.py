"""Reaching along dependency edges: what roots reach, how near a taint is, order of layers, components and cycles.

Both advance a frontier table one step a round; every round's table is written to the shared folder, so plans
stay short and a lost executor costs one round. Nothing is collected but whether a frontier is empty.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill import shared
from lodemill.shared import kept, new_path, scratch


def written(df: DataFrame, name: str) -> DataFrame:
    """shared.written(), to be met by sorting: of the many rounds' joins none sends a table by way of the driver."""
    return shared.written(df, name).hint("merge")


def _read(spark: SparkSession, kinds, path: str) -> DataFrame:
    return spark.read.schema(kinds).parquet(path).hint("merge")


def reach(edges: DataFrame, roots: DataFrame, depth: int = 10, stop: DataFrame | None = None) -> DataFrame:
    """root, node, depth (least number of steps, up to `depth`) of edges(src, dst) from roots(root).

    stop(node): nodes that are reached but not passed. The root itself is not reached by 0 steps; a cycle may
    reach it again. Each round writes its own front beside the earlier ones and reads the folder for what has
    been seen, so nothing is written twice. Keys of edges may be skewed: each round is an equi-join with a
    distinct, both of which aggregate or split by Spark's own means.
    """
    spark = edges.sparkSession
    steps = written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "steps")
    stops = None if stop is None else written(stop.select("node").distinct(), "stops")
    front = written(roots.select("root", F.col("root").alias("node")).distinct(), "front")
    folder, kinds = new_path(spark, "reached"), None
    for at in range(1, depth + 1):
        passing = front if stops is None or at == 1 else front.join(stops, "node", "left_anti")
        new = passing.join(steps, passing["node"] == steps["src"]).select("root", F.col("dst").alias("node")).distinct()
        if kinds is not None:
            new = new.join(_read(spark, kinds, folder), ["root", "node"], "left_anti")
        found = new.withColumn("depth", F.lit(at))
        kinds = found.schema
        found.write.parquet(f"{folder}/round={at}")
        front = _read(spark, kinds, f"{folder}/round={at}").select("root", "node")
        if front.isEmpty():
            break
    if kinds is None:
        return front.withColumn("depth", F.lit(0)).limit(0)
    return _read(spark, kinds, folder).select("root", "node", "depth")


def distances(edges: DataFrame, targets: DataFrame, depth: int = 10) -> DataFrame:
    """node, steps: the least number of steps, 1 to `depth`, of edges(src, dst) from a node to any of targets(node); others are left out.

    One search against the edges from all targets at once: a round joins the edges to the nodes that the last one found,
    so a node is found once and an edge is looked at in one round. The rows are those of nodes, whatever they reach."""
    spark = edges.sparkSession
    steps = written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "steps")
    front = targets.select(F.col("node").alias("dst")).distinct()
    folder, kinds = new_path(spark, "distances"), None
    for at in range(1, depth + 1):
        new = steps.join(front, "dst").select(F.col("src").alias("node")).distinct()
        if kinds is not None:
            new = new.join(_read(spark, kinds, folder).select("node"), "node", "left_anti")
        found = new.withColumn("steps", F.lit(at))
        kinds = found.schema
        found.write.parquet(f"{folder}/round={at}")
        front = _read(spark, kinds, f"{folder}/round={at}").select(F.col("node").alias("dst"))
        if front.isEmpty():
            break
    if kinds is None:
        return steps.select(F.col("src").alias("node"), F.lit(0).alias("steps")).limit(0)
    return _read(spark, kinds, folder).select("node", "steps")


def tainted(edges: DataFrame, roots: DataFrame, copyleft: DataFrame, depth: int = 10, counted: bool = False) -> DataFrame:
    """root, is_tainted, steps: whether a root reaches a node of copyleft(node) in 1 to `depth` steps, and how near the nearest is (null: none).

    The nearest one is reached without passing another, so a search from all of them at once, backwards, needs no pruning.
    counted: also n_reached, how many nodes a root reaches in as many steps without passing one of copyleft; this is a search
    from every root, with a row for each pair."""
    near = distances(edges, copyleft, depth).withColumnRenamed("node", "root")
    found = roots.select("root").distinct().join(near, "root", "left").select("root", F.col("steps").isNotNull().alias("is_tainted"), "steps")
    if not counted:
        return found
    numbers = reach(edges, roots, depth, copyleft).groupBy("root").agg(F.count("*").alias("n_reached"))
    return found.join(numbers, "root", "left").withColumn("n_reached", F.coalesce("n_reached", F.lit(0).cast("long")))


#: Rounds of nodes that are ready before layers() turns to chosen dependencies.
READY_ROUNDS = 12


def _chained(single: DataFrame) -> DataFrame:
    """node, top, steps: of nodes with one dependency (node, up, and how many steps it stands for, or 1), the first node down
    their chain that is none of them, by doubling; null where the chain runs in a circle or to null."""
    own = F.col("steps") if "steps" in single.columns else F.lit(1).cast("long").alias("steps")
    at = written(single.select("node", F.col("up").alias("top"), own, F.lit(True).alias("moved")), "chains")
    for _ in range(at.count().bit_length() + 1):
        above = at.select(F.col("node").alias("top"), F.col("top").alias("higher"), F.col("steps").alias("more"), F.lit(True).alias("met"))
        further = F.col("met").isNotNull()
        at = written(at.join(above, "top", "left").select("node", F.when(further, F.col("higher")).otherwise(F.col("top")).alias("top"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), further.alias("moved")), "chains")
        if at.where("moved").isEmpty():
            break
    return at.select("node", F.when(~F.col("moved"), F.col("top")).alias("top"), "steps")


def _longest(edges: DataFrame, base: DataFrame) -> DataFrame:
    """node, layer of base(node, layer: what it has in any case): the greatest sum of steps along edges(src, dst, steps) to a node
    of base plus that one's layer; null on or behind a circle or a null dst.

    Every node follows one dependency that it has chosen; all chains of choices are added up by doubling, then each node
    chooses the dependency that came out highest, until none is better. Sums only grow, and after k choices those along at
    most k edges are right, so there are never more choices than edges on a path, mostly a few however long paths are."""
    value = base.select("node", "layer", F.lit(False).alias("endless"))
    choice = base.select("node", F.lit(None).cast(edges.schema["dst"].dataType).alias("up"), F.lit(None).cast("long").alias("steps"))
    while True:
        there = value.select(F.col("node").alias("dst"), F.col("layer").alias("below"), "endless")
        met = edges.join(there, "dst", "left").select("src", "dst", "steps", (F.col("below") + F.col("steps")).alias("sum"), F.coalesce("endless", F.lit(True)).alias("endless"))
        best = met.groupBy(F.col("src").alias("node")).agg(F.max_by(F.struct("dst", "steps"), F.struct(F.coalesce("sum", F.lit(-1)), "dst")).alias("to"), F.max("sum").alias("sum"), F.bool_or("endless").alias("lost"))
        state = value.join(choice, "node").join(best, "node", "left")
        lost = F.col("endless") | F.coalesce("lost", F.lit(False))
        better = ~lost & F.coalesce(F.col("sum") > F.col("layer"), F.lit(False))
        state = written(state.select("node", lost.alias("endless"), (better | (lost & ~F.col("endless"))).alias("changed"), F.when(better, F.col("to.dst")).otherwise(F.col("up")).alias("up"), F.when(better, F.col("to.steps")).otherwise(F.col("steps")).alias("steps")), "choices")
        if state.where("changed").isEmpty():
            return value.select("node", F.when(~F.col("endless"), F.col("layer")).alias("layer"))
        choice = state.select("node", "up", "steps")
        # an endless node ends a chain without a layer
        summed = _chained(state.where("NOT endless AND up IS NOT NULL").select("node", "up", "steps"))
        stops = state.where("endless OR up IS NULL").join(base, "node").select(F.col("node").alias("top"), F.when(~F.col("endless"), F.col("layer")).alias("layer"))
        run = summed.join(stops, "top", "left").select("node", (F.col("layer") + F.col("steps")).alias("layer"))
        value = written(run.unionByName(stops.select(F.col("top").alias("node"), "layer")).select("node", "layer", F.col("layer").isNull().alias("endless")), "sums")


def layers(edges: DataFrame, most: int | None = None) -> DataFrame:
    """node, layer of edges(src depends on dst): 0 without dependencies, else one more than the highest of them; null on or behind a cycle.

    Chains of nodes with one dependency are cut short by doubling, so the rounds that follow are as many as nodes with
    several dependencies lie on one path. A round writes its nodes beside the earlier rounds' and, of what still waits,
    how many dependencies are open. Where nodes are still getting ready after READY_ROUNDS, paths are long: the rest is left
    to _longest(), whose rounds do not grow with them. An error if `most` is given and there are more layers.
    """
    spark = edges.sparkSession
    steps = written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "steps")
    open_ = written(steps.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.first("dst").alias("up")), "open")
    chains = written(_chained(open_.where("n = 1").select("node", "up")), "chains")
    to = chains.select(F.col("node").alias("dst"), "top", F.col("steps").alias("more"))
    several = steps.join(open_.where("n > 1").select(F.col("node").alias("src")), "src", "left_semi").join(to, "dst", "left")
    several = written(several.select("src", F.when(F.col("more").isNull(), F.col("dst")).otherwise(F.col("top")).alias("dst"), (F.coalesce("more", F.lit(0)) + 1).alias("steps")), "branches")
    waiting = written(open_.where("n > 1").select("node", "n", F.lit(0).cast("long").alias("layer")), "waiting")
    every = steps.select(F.col("src").alias("node")).union(steps.select(F.col("dst").alias("node"))).distinct()
    folder = new_path(spark, "layers")
    ready = every.join(open_.select("node"), "node", "left_anti").withColumn("layer", F.lit(0).cast("long"))
    kinds = ready.schema
    for at in count():
        ready.write.parquet(f"{folder}/round={at}")
        front = _read(spark, kinds, f"{folder}/round={at}").select("node", "layer")
        if front.isEmpty() or (at and waiting.isEmpty()):
            rest = waiting.select("node", F.lit(None).cast("long").alias("layer"))
            break
        met = several.join(front.select(F.col("node").alias("dst"), "layer"), "dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("met"), F.max(F.col("layer") + F.col("steps")).alias("above"))
        left = waiting.join(met, "node", "left").select("node", (F.col("n") - F.coalesce("met", F.lit(0))).alias("n"), F.greatest("layer", "above").alias("layer"))
        left = written(left, "waiting")
        ready, waiting = left.where("n = 0").select("node", "layer"), left.where("n > 0")
        if at == READY_ROUNDS:
            ready.write.parquet(f"{folder}/round={at + 1}")
            base = left.select("node", "layer")
            among = several.join(waiting.select(F.col("node").alias("src")), "src", "left_semi").join(base.select(F.col("node").alias("dst"), F.lit(True).alias("open")), "dst", "left")
            # what else they need is in their layer so far; a null dst leads into a circle
            rest = _longest(written(among.where("open OR dst IS NULL").select("src", "dst", "steps"), "among"), written(base, "base"))
            rest = rest.join(waiting.select("node"), "node", "left_semi")
            break
    done = _read(spark, kinds, folder).select("node", "layer").unionByName(rest)
    tops = done.select(F.col("node").alias("top"), "layer")
    chained = chains.join(tops, "top", "left").select("node", (F.col("layer") + F.col("steps")).alias("layer"))
    out = written(done.unionByName(chained), "layered")
    if most is not None and (out.agg(F.max("layer")).first()[0] or 0) >= most:
        raise ValueError(f"more than {most} layers")
    return out


def _coloured(edges: DataFrame) -> DataFrame:
    """node, colour: the greatest node that a node of edges(src, dst) can be reached from, itself included."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    state = written(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("changed")), "colours")
    while not (moved := state.where("changed")).isEmpty():
        sent = edges.join(moved.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("new"))
        joined = state.join(sent, "node", "left")
        better = F.coalesce(F.col("new") > F.col("colour"), F.lit(False))
        state = written(joined.select("node", F.greatest("colour", "new").alias("colour"), better.alias("changed")), "colours")
    return state.select("node", "colour")


def components(edges: DataFrame) -> DataFrame:
    """node, component of the nodes that lie on a cycle of edges(src, dst): nodes that reach each other share the least of them.

    Nodes before and behind all cycles go first: those that have a layer, along the edges or against them. Of the rest each
    takes the greatest node that reaches it as its colour; what reaches that node within its colour is its component. Rounds
    are as many as steps lead through the cyclic part, and again for parts that several colours are left of."""
    spark = edges.sparkSession
    held = written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    with scratch(spark):
        onto = layers(held).where("layer IS NULL").select("node")
        out_of = layers(held.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("layer IS NULL").select("node")
        core = onto.join(out_of, "node")
        inside = held.join(core.select(F.col("node").alias("src")), "src", "left_semi").join(core.select(F.col("node").alias("dst")), "dst", "left_semi")
        rest = kept(inside.select("src", "dst"), "core")
    core_edges, folder = rest, new_path(spark, "components")
    spark.createDataFrame([], held.select(F.col("src").alias("node"), F.col("src").alias("of")).schema).write.parquet(f"{folder}/round=0/step=0")
    for at in count(1):
        if rest.isEmpty():
            break
        colours = written(_coloured(rest), "coloured")
        both = rest.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst")
        same = written(both.where("a = b").select("src", "dst", F.col("a").alias("of")), "same")
        found = colours.where("node = colour").select("node", F.col("colour").alias("of"))
        front = found
        for back in count():
            front.write.parquet(f"{folder}/round={at}/step={back}")
            front = _read(spark, found.schema, f"{folder}/round={at}/step={back}")
            if front.isEmpty():
                break
            seen = _read(spark, found.schema, f"{folder}/round={at}").select("node")
            front = same.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "of").distinct().join(seen, "node", "left_anti")
        done = _read(spark, found.schema, f"{folder}/round={at}").select("node")
        left = same.join(done.select(F.col("node").alias("src")), "src", "left_anti").join(done.select(F.col("node").alias("dst")), "dst", "left_anti")
        rest = written(left.select("src", "dst"), "rest")
    every = _read(spark, held.select(F.col("src").alias("node"), F.col("src").alias("of")).schema, folder).select("node", "of")
    least = every.groupBy("of").agg(F.min("node").alias("component"), F.count("*").alias("n"))
    loops = core_edges.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop"))
    named = every.join(least, "of").join(loops, "node", "left")
    return written(named.where("n > 1 OR loop").select("node", "component"), "cyclic")


def cycles(edges: DataFrame) -> DataFrame:
    """node, component, place: the nodes of components(), and of one cycle of each component the place of its nodes, from 0 on at the least (null: on another one).

    Of a component every node goes on to its least successor there; these steps run into circles, which are found by doubling
    (after as many steps as there are nodes only circles are left). Of several circles the one of the least node is taken."""
    spark = edges.sparkSession
    of = components(edges)
    with scratch(spark):
        ends = edges.join(of.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
        steps = written(ends.where("a = b").groupBy(F.col("src").alias("node"), F.col("a").alias("component")).agg(F.min("dst").alias("next")), "next")
        at = steps.select("node", F.col("next").alias("to"), F.least("node", "next").alias("least"))
        for _ in range(steps.count().bit_length()):
            at = written(at, "jumps")
            far = at.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("least").alias("other"))
            at = at.join(far, "to").select("node", F.col("further").alias("to"), F.least("least", "other").alias("least"))
        at = written(at, "jumps")
        circle = at.select(F.col("to").alias("node")).distinct().join(at.select("node", "least"), "node").join(steps, "node")
        first = circle.groupBy("component").agg(F.min("least").alias("first"))
        chosen = written(circle.join(first, "component").where("least = first").select("node", "component", "next", "first"), "circle")
        length = chosen.groupBy("component").agg(F.count("*").alias("length"))
        onward = _chained(chosen.where("node <> first").select("node", F.col("next").alias("up"))).select("node", "steps")
        placed = chosen.join(length, "component").join(onward, "node", "left").select("node", F.when(F.col("node") == F.col("first"), 0).otherwise(F.col("length") - F.col("steps")).cast("long").alias("place"))
        return kept(of.join(placed, "node", "left").select("node", "component", "place"), "cycles")
