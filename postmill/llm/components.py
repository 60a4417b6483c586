"""Connected components of an edge table by contraction.

Each round hooks every node to its least neighbour, follows that once more, and renames the
ends of all edges; edges within a name vanish, so the table shrinks by a factor a round. The
names of the nodes are carried along. State is tables in the shared folder; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.session import discard, saved


def _hooks(edges: DataFrame) -> DataFrame:
    """(u, to): every node of an edge with the least of its neighbours and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge; nodes of one component share a label, one of its nodes."""
    left = saved(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    names = None
    while True:
        hook = saved(_hooks(left), "hooks")
        far = hook.select(F.col("u").alias("to"), F.col("to").alias("far"))
        jump = saved(hook.join(far, "to").select("u", F.col("far").alias("to")), "jumps")
        if names is None:
            new = jump.select(F.col("u").alias("node"), F.col("to").alias("label"))
        else:
            new = names.join(jump, F.col("label") == F.col("u"), "left").select("node", F.coalesce("to", "label").alias("label"))
        new = saved(new, "names")
        moved = left.join(jump.select(F.col("u").alias("a"), F.col("to").alias("x")), "a").join(jump.select(F.col("u").alias("b"), F.col("to").alias("y")), "b")
        rest = saved(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(left, hook, jump, *([names] if names is not None else []))
        left, names = rest, new
        if left.isEmpty():
            discard(left)
            return names
