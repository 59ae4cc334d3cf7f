"""Order of a call graph: strongly connected components, levels of the contracted graph, callees first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import forget, written
from ..functions.scan import BLOCK, running


#: No way down has that many calls; ways round a circle, which double in every round, stop there.
FAR = 1 << 40


def settled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst) -> (name, level) of all that reach no cycle, and the names that do.

    The level is the longest way down to a name that calls nothing. A round settles the names all of whose
    callees are settled; an edge to a name with one open edge only is led on to where that one goes, so chains
    take the logarithm of their length. What is known of a name by settled callees is a row without dst.
    A round groups what is still open once and joins it once; what was settled earlier is not read again.
    """
    names = edges.select("src").union(edges.select("dst")).distinct()
    none, at_most = F.lit(None).cast(edges.schema["dst"].dataType), lambda w: F.least(w, F.lit(FAR))
    left = written(edges.select("src", "dst", F.lit(1).cast("long").alias("w")).union(names.select("src", none, F.lit(0).cast("long"))), "edges")
    known: list[DataFrame] = []
    while True:
        over = lambda c: F.max(F.when(c, F.col("w")))
        state = left.groupBy("src").agg(F.min("dst").alias("to"), F.max("dst").alias("other"), over(F.col("dst").isNotNull()).alias("by"), over(F.col("dst").isNull()).alias("floor"))
        state = written(state, "state")
        done = state.where("to is null").select(F.col("src").alias("name"), F.col("floor").alias("level"))
        if done.isEmpty():
            break
        if len(known) == 16:
            former, known = known, [written(union(known), "levels")]
            for df in former:
                forget(df)
        known.append(done)
        # a name with one open edge to a name that is settled by now is as good as settled: no edge may be led past the end
        single = state.where("to = other and to <> src").join(done.withColumnRenamed("name", "to"), "to", "left")
        through = single.select("src", F.when(F.col("level").isNull(), F.col("to")).alias("to"), "by", F.greatest("floor", F.col("by") + F.col("level")).alias("floor"))
        lookup = state.where("to is null").select("src", "to", "by", "floor").union(through).withColumnRenamed("src", "dst").withColumn("met", F.lit(True))
        seen = left.where("dst is not null").join(lookup, "dst", "left")
        edge = F.struct(F.when(F.col("met"), F.col("to")).otherwise(F.col("dst")).alias("dst"), at_most(F.col("w") + F.when(F.col("to").isNotNull(), F.col("by")).otherwise(F.lit(0))).alias("w"))
        end = F.struct(none.alias("dst"), at_most(F.col("w") + F.col("floor")).alias("w"))
        led = seen.select("src", F.inline(F.array_compact(F.array(F.when(F.col("met").isNull() | F.col("to").isNotNull(), edge), F.when((F.col("floor") > 0) | (F.col("met") & F.col("to").isNull()), end)))))
        former, left = left, written(led.union(state.where("to is not null and floor > 0").select("src", none, "floor")), "edges")
        forget(former)
    nothing = names.select(F.col("src").alias("name"), F.lit(0).cast("long").alias("level")).where("false")
    return union([*known, nothing] if not known else known), state.select(F.col("src").alias("name"))


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(src, dst) -> (name, component) of names that lie on cycles with others; component is the smallest name.

    Colours run forward: every name takes the greatest name that reaches it. Within a colour, what reaches
    the name of the colour is its component. Found components leave the graph, and the rest is coloured again.
    """
    left, found = written(edges.select("src", "dst"), "edges"), None
    while not left.isEmpty():
        colour = written(left.select(F.col("src").alias("name")).union(left.select("dst")).distinct().withColumn("colour", F.col("name")), "colours")
        while True:
            told = left.join(colour, left["src"] == colour["name"]).groupBy("dst").agg(F.max("colour").alias("told"))
            after = written(colour.join(told, colour["name"] == told["dst"], "left").select("name", "colour", F.greatest("colour", F.coalesce("told", "colour")).alias("next")), "colours")
            moved = not after.where("next > colour").isEmpty()
            forget(colour)
            colour = after.select("name", F.col("next").alias("colour"))
            if not moved:
                break
        inside = left.join(colour.select(F.col("name").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("name").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b")
        inside = written(inside.select("src", "dst"), "inside")
        reached = written(colour.where("name = colour"), "reached")
        front = reached
        while True:
            back = inside.join(front.withColumnRenamed("name", "dst"), "dst").select(F.col("src").alias("name"), "colour").distinct().join(reached, ["name", "colour"], "left_anti")
            front = written(back, "front")
            if front.isEmpty():
                break
            reached = written(reached.union(front), "reached")
        found = reached if found is None else found.union(reached)
        gone = reached.select("name")
        left = written(left.join(gone.withColumnRenamed("name", "src"), "src", "left_anti").join(gone.withColumnRenamed("name", "dst"), "dst", "left_anti").select("src", "dst"), "edges")
    if found is None:
        return edges.select(F.col("src").alias("name"), F.col("src").alias("component")).where("false")
    least = found.groupBy("colour").agg(F.min("name").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(least, "colour").select("name", "component")


def call_levels(calls: DataFrame) -> DataFrame:
    """(caller, callee) -> (name, component, level): callees have lower levels than callers, and names that
    call each other in a circle share a component (its smallest name) and a level.

    A name that calls itself is no circle; rows with nulls are no calls; repeated calls count once. Names are
    numbered once, and the rounds work on numbers.
    """
    names = calls.select(F.col("caller").alias("name")).union(calls.select("callee")).where("name is not null").distinct()
    names = written(names.select("name", F.monotonically_increasing_id().alias("id")), "names")
    of = lambda c, k: names.select(F.col("name").alias(c), F.col("id").alias(k))
    edges = calls.where("caller <> callee").select("caller", "callee").join(of("caller", "src"), "caller").join(of("callee", "dst"), "callee").select("src", "dst").distinct()
    edges = written(edges, "calls")
    levels, open_ = settled(edges)
    if open_.isEmpty():
        return names.join(levels.withColumnRenamed("name", "id"), "id", "left").select("name", F.col("name").alias("component"), F.coalesce("level", F.lit(0)).alias("level"))
    side = lambda c: open_.withColumnRenamed("name", c)
    circles = written(strongly_connected(edges.join(side("src"), "src", "left_semi").join(side("dst"), "dst", "left_semi")), "circles")
    of = lambda c: circles.select(F.col("name").alias(c), F.col("component").alias(f"{c}_component"))
    drawn = edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left").select(F.coalesce("src_component", "src").alias("src"), F.coalesce("dst_component", "dst").alias("dst")).where("src <> dst").distinct()
    levels, _ = settled(written(drawn, "drawn"))
    named = names.join(circles.withColumnRenamed("name", "id"), "id", "left")
    least = named.where("component is not null").groupBy("component").agg(F.min("name").alias("least"))
    named = named.join(least, "component", "left").select("name", F.coalesce("least", "name").alias("least"), F.coalesce("component", "id").alias("id"))
    return named.join(levels.withColumnRenamed("name", "id"), "id", "left").select("name", F.col("least").alias("component"), F.coalesce("level", F.lit(0)).alias("level"))


def callees_first(closure: DataFrame, levels: DataFrame, block: int = BLOCK) -> DataFrame:
    """(root, name) with its place in the source of the root: callees before callers, circles together."""
    met = closure.join(levels, "name", "left").withColumns({"component": F.coalesce("component", "name"), "level": F.coalesce("level", F.lit(0))})
    return running(met, ["root"], ["level", "component", "name"], {"place": F.lit(1)}, block=block)
