"""What each node of a query's plan did."""

from __future__ import annotations

from pyspark.sql import DataFrame


def node_rows(df: DataFrame) -> list[tuple[int, str, int | None]]:
    """Runs a query for its counters: (depth, node, rows that left it) from the root down; None where a node does not count."""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    found: list[tuple[int, str, int | None]] = []

    def walk(node, depth: int) -> None:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan(), depth)
        if name.endswith("QueryStage"):
            return walk(node.plan(), depth)
        counter = node.metrics().get("numOutputRows")
        found.append((depth, name, counter.get().value() if counter.isDefined() else None))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), depth + 1)

    walk(run.executedPlan(), 0)
    return found


def in_engine(df: DataFrame) -> bool:
    """Whether a query runs without leaving for Python workers."""
    return not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("InPandas", "InArrow", "EvalPython"))
