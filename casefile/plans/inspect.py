"""Physical-plan checks used by tests and when tuning a job.

They walk the executed plan (through adaptive and query-stage wrappers) and
report shuffles and scans, so a test can assert e.g. "one Exchange" or "no
binary column crosses a shuffle".
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def _children(node):
    kids = node.children()
    return [kids.apply(i) for i in range(kids.size())]


def _unwrap(node):
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return node.executedPlan()
    if name.endswith("QueryStage"):
        return node.plan()
    return node


def plan_nodes(df: DataFrame) -> list:
    """All physical operators of ``df``'s executed plan (depth first)."""
    out, stack = [], [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = _unwrap(stack.pop())
        out.append(node)
        stack.extend(_children(node))
        if node.nodeName() in ("ReusedExchange",):
            stack.append(node.child())
    return out


def _output_types(node) -> list[tuple[str, str]]:
    attrs = node.output()
    return [(attrs.apply(i).name(), attrs.apply(i).dataType().simpleString()) for i in range(attrs.size())]


def exchanges(df: DataFrame) -> list[dict]:
    """Shuffle exchanges: partitioning text and the columns they carry."""
    found = []
    for node in plan_nodes(df):
        if node.nodeName() in ("Exchange", "ShuffleExchange"):
            found.append({"partitioning": node.outputPartitioning().toString(),
                          "columns": _output_types(node)})
    return found


def broadcasts(df: DataFrame) -> list[list[tuple[str, str]]]:
    """Columns of every broadcast exchange."""
    return [_output_types(n) for n in plan_nodes(df) if n.nodeName() == "BroadcastExchange"]


def scans(df: DataFrame) -> list[dict]:
    """File scans with the columns they read and the filters they push."""
    found = []
    for node in plan_nodes(df):
        if node.nodeName().startswith("Scan"):
            try:
                meta = node.metadata()
            except Exception:  # noqa: BLE001 - scans without file metadata (RDD, Python source)
                found.append({"node": node.nodeName(), "read_schema": None, "pushed_filters": None})
                continue
            found.append({
                "node": node.nodeName(),
                "read_schema": meta.get("ReadSchema").getOrElse(None) if meta.contains("ReadSchema") else None,
                "pushed_filters": meta.get("PushedFilters").getOrElse(None) if meta.contains("PushedFilters")
                else None,
            })
    return found


def binary_in_shuffles(df: DataFrame) -> list[str]:
    """Names of binary columns carried by any shuffle or broadcast (should be empty)."""
    bad = []
    for ex in exchanges(df):
        bad += [n for n, t in ex["columns"] if t == "binary"]
    for cols in broadcasts(df):
        bad += [n for n, t in cols if t == "binary"]
    return bad
