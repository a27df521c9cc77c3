"""Components of links between documents, by the library's stars."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import graph


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); component is the smallest node that it reaches.

    Loops, repeated and reversed edges do no harm.
    """
    return graph.components(edges.select("u", "v").toDF("a", "b")).withColumnRenamed("iri", "node")
