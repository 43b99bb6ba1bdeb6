"""EXPLAIN and EXPLAIN ANALYZE: plans as rows, with what each node was expected to give and gave."""

from __future__ import annotations

from pyspark.sql import DataFrame

SCHEMA = "depth int, node string, detail string, estimated_bytes string, actual_rows long"


def _children(node) -> list:
    """Below adaptive plans and query stages stands what they ran."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if kind.endswith("QueryStageExec"):
        return [node.plan()]
    seq = node.children()
    return [seq.apply(i) for i in range(seq.size())]


def _estimate(node) -> str | None:
    link = node.logicalLink()
    return str(link.get().stats().sizeInBytes()) if link.isDefined() else None


def _rows(node, depth: int, ran: bool) -> list[tuple]:
    name = node.nodeName()
    wrapper = name.startswith(("AdaptiveSparkPlan", "WholeStageCodegen", "InputAdapter")) or node.getClass().getSimpleName().endswith("QueryStageExec")
    out = []
    if not wrapper:
        count = node.metrics().get("numOutputRows")
        out.append((depth, name, node.simpleString(25)[:200], _estimate(node), count.get().value() if ran and count.isDefined() else None))
    for child in _children(node):
        out += _rows(child, depth + (not wrapper), ran)
    return out


def explain(df: DataFrame, analyze: bool) -> DataFrame:
    """One row for each node of the physical plan, from the top. With analyze the query is run, its rows counted where
    they arise, and the plan is the one that adaptive execution came to; a node that counts no rows has none."""
    execution = df._jdf.queryExecution()
    if analyze:
        execution.toRdd().count()
    return df.sparkSession.createDataFrame(_rows(execution.executedPlan(), 0, analyze), SCHEMA)
