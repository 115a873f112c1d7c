"""Layers of a station brought into one coordinate system, along the pairs that are aligned with each other."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from floorgraph.sources.shared import new_folder, stored

_C = F.col


def product(a: Column, b: Column) -> Column:
    """a b of 3x3 matrices, row by row in arrays of nine."""
    return F.array(*[reduce(add, [a[3 * i + k] * b[3 * k + j] for k in range(3)]) for i in range(3) for j in range(3)])


def inverse(m: Column) -> Column:
    """Null for a singular matrix."""
    # the minor that leaves out row i and column j, signed by the cyclic order of what is left
    minor = lambda i, j: m[(i + 1) % 3 * 3 + (j + 1) % 3] * m[(i + 2) % 3 * 3 + (j + 2) % 3] - m[(i + 1) % 3 * 3 + (j + 2) % 3] * m[(i + 2) % 3 * 3 + (j + 1) % 3]
    det = reduce(add, [m[j] * minor(0, j) for j in range(3)])
    return F.when(F.abs(det) > 0, F.array(*[minor(j, i) / det for i in range(3) for j in range(3)]))


def align_layers(pairs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(graph, layer, root, depth, matrix): how each layer's points come into the system of its graph's root.

    ``pairs``: graph, ord, a, b, matrix (nine numbers, b's points to a's);
    ``wanted``: graph, layer, at most one row a graph.  The root is the wanted
    layer if it is in a pair, else B1 if that is, else the first by name.
    Breadth-first over all graphs at once, a round a level: T[next] = T[this] M.
    A layer that several reach is taken from the one that was reached first, of
    one layer's pairs from the first in order.  Layers that the root does not
    reach are left out; so are pairs with a null, and the way back over a
    singular matrix.
    """
    spark = pairs.sparkSession
    folder = new_folder(spark, "layers")
    sound = pairs.select("graph", "ord", "a", "b", "matrix").dropna()
    there = sound.select("graph", "ord", _C("a").alias("this"), _C("b").alias("next"), _C("matrix").alias("step"))
    back = sound.select("graph", "ord", _C("b").alias("this"), _C("a").alias("next"), inverse(_C("matrix")).alias("step")).where("step is not null")
    ways = stored(there.unionByName(back), f"{folder}/ways")
    ends = F.explode(F.array("a", "b")).alias("layer")
    layers = sound.select("graph", ends).distinct()
    asked = layers.limit(0) if wanted is None else wanted.select("graph", "layer").distinct()
    named = layers.join(asked.withColumn("_asked", F.lit(True)), ["graph", "layer"], "left")
    first = F.struct(F.when(_C("_asked"), 0).when(_C("layer") == "B1", 1).otherwise(2).alias("rank"), "layer")
    root = named.groupBy("graph").agg(F.min(first)["layer"].alias("root"))
    same = F.array(*[F.lit(float(i == j)) for i in range(3) for j in range(3)])
    no_turns = F.array().cast(f"array<{pairs.schema['ord'].dataType.simpleString()}>")
    begun = root.select("graph", _C("root").alias("layer"), "root", same.alias("matrix"), no_turns.alias("turns"))
    level, depth = stored(begun, f"{folder}/reached/depth=0"), 0
    schema = level.schema.add("depth", IntegerType())
    reached = lambda: spark.read.schema(schema).parquet(f"{folder}/reached")
    while not level.isEmpty():
        depth += 1
        on = level.withColumnRenamed("layer", "this").join(ways, ["graph", "this"])
        # the turns taken since the root stand in the order in which a queue would hold the layers
        turn = F.struct(F.concat("turns", F.array("ord")).alias("turns"), product(_C("matrix"), _C("step")).alias("matrix"))
        fresh = on.select("graph", _C("next").alias("layer"), "root", turn.alias("t")).join(reached().select("graph", "layer"), ["graph", "layer"], "left_anti")
        taken = fresh.groupBy("graph", "layer", "root").agg(F.min("t").alias("t"))
        level = stored(taken.select("graph", "layer", "root", "t.matrix", "t.turns"), f"{folder}/reached/depth={depth}")
    return reached().select("graph", "layer", "root", "depth", "matrix")
