"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.shared import materialize
from spindrift.operators import graph


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id that can be reached) of every end of the edges (a, b), whose nodes are longs.

    Loops (a = b) and repeated edges do no harm, edges with a null end count for nothing, an empty table gives an empty result. Each round
    of labels is written to the shared folder, so that a lost executor costs one round at most.
    """
    own = materialize(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).where("a IS NOT NULL AND b IS NOT NULL"), "edges")
    ends = own.select(F.col("src").alias("id")).union(own.select("dst")).distinct()
    return graph.components(ends, own)
