"""Read-only SQL: a guard on the parsed plan, a bounded result and its envelope."""

from __future__ import annotations

import re
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

# Nodes of a parsed plan that only read; any other is refused.
READS = {
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Sample", "Sort", "SubqueryAlias", "Tail", "Union", "Unpivot",
    "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedPivot", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedUnpivot", "UnresolvedWith", "Values", "Window", "WithWindowDefinition",
}
# Functions that run code outside of Spark's expressions.
CALLS = {"reflect", "java_method", "try_reflect"}
# Expressions that name a function or a column by a value, and those of an analysed plan that run foreign code.
COMPUTED = {"ExpressionWithUnresolvedIdentifier", "PlanWithUnresolvedIdentifier"}
FOREIGN = {"CallMethodViaReflection", "ScriptTransformation", "HiveSimpleUDF", "HiveGenericUDF", "HiveGenericUDTF", "HiveUDAFFunction"}
#: Names of catalog tables start so; queries from outside may not read them.
PRIVATE = "_tabular_"


class NotReadOnly(ValueError):
    """The statement isn't a query."""


def _nodes(spark: SparkSession, root) -> list:
    """All plans and expressions in a plan, wherever a node holds them: in lists, options, pairs or maps."""
    of = spark._jvm.java.lang.Class.forName
    tree, product, many = of("org.apache.spark.sql.catalyst.trees.TreeNode"), of("scala.Product"), of("scala.collection.Iterable")
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if not hasattr(x, "_target_id"):
            continue
        if tree.isInstance(x):
            found.append(x)
        parts = x.iterator() if many.isInstance(x) else x.productIterator() if product.isInstance(x) else None
        while parts is not None and parts.hasNext():
            todo.append(parts.next())
    return found


def _names(seq) -> list[str]:
    return [seq.apply(i) for i in range(seq.size())]


def _walk(spark: SparkSession, plan) -> tuple[list[str], list[str], list[list[str]]]:
    """Kinds of all plans in a parsed plan, the functions called, and the parts of the names of the relations read."""
    plans = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
    kinds, calls, relations = [], [], []
    for node in _nodes(spark, plan):
        kind = node.nodeName()
        if plans.isInstance(node):
            kinds.append(kind)
        if kind == "UnresolvedRelation":
            relations.append(_names(node.multipartIdentifier()))
        elif kind == "UnresolvedTableValuedFunction":
            calls.append(_names(node.name())[-1].lower())
        elif kind == "UnresolvedFunction":
            calls.append(_names(node.nameParts())[-1].lower())
        elif kind in COMPUTED:
            calls.append(kind)
    return kinds, calls, relations


def parsed(spark: SparkSession, sql: str):
    """The parsed plan of one statement; it isn't analysed, and nothing runs."""
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # the JVM's parse error
        raise NotReadOnly(f"not one readable statement: {str(e).splitlines()[0][:200]}") from e


def leading_keyword(sql: str) -> str:
    """The first word after white space and comments, in capitals."""
    found = re.match(r"(?s)(?:\s+|--[^\n]*(?:\n|$)|/\*.*?\*/)*([A-Za-z]*)", sql)
    return found[1].upper()


def check_read_only(spark: SparkSession, sql: str, *, explain: bool = True, private: bool = True) -> str:
    """The statement without a final semicolon; raises for all but one SELECT or WITH, or EXPLAIN of one.

    Every plan within it must be one that reads, wherever it stands, and no
    function may run foreign code or be named by an expression.  A relation is a
    name; one of several parts must be a table that the catalog has, as a file
    would be read otherwise.  Without ``explain``, EXPLAIN is refused, too, and
    without ``private``, catalog tables.  Parsing is on the JVM, so a session of
    Spark Connect isn't served.
    """
    text = sql.strip().rstrip(";").strip()
    allowed = ("SELECT", "WITH", "EXPLAIN") if explain else ("SELECT", "WITH")
    if leading_keyword(text) not in allowed:
        raise NotReadOnly(f"only {', '.join(allowed)} may begin a query")
    plan = parsed(spark, text)
    if explain and plan.nodeName() == "ExplainCommand":
        plan = plan.logicalPlan()
    kinds, calls, relations = _walk(spark, plan)
    for kind in kinds:
        if kind not in READS:
            raise NotReadOnly(f"{kind} isn't allowed")
    for name in calls:
        if name in CALLS or name in COMPUTED:
            raise NotReadOnly(f"{name} isn't allowed")
    for parts in relations:
        if len(parts) > 1 and not spark.catalog.tableExists(".".join(f"`{p.replace('`', '``')}`" for p in parts)):
            raise NotReadOnly(f"{'.'.join(parts)} isn't a table of the catalog")
    if not private and any(PRIVATE in p.lower() for parts in relations for p in parts):
        raise NotReadOnly("catalog tables aren't open to queries")
    return text


def checked_query(spark: SparkSession, sql: str, *, explain: bool = True, private: bool = True) -> DataFrame:
    """The query as a DataFrame, once its analysed plan, where all functions are known, calls no foreign code either."""
    df = spark.sql(check_read_only(spark, sql, explain=explain, private=private))
    for node in _nodes(spark, df._jdf.queryExecution().analyzed()):
        if node.getClass().getSimpleName() in FOREIGN:
            raise NotReadOnly(f"{node.nodeName()} isn't allowed")
    return df


def referenced_names(spark: SparkSession, sql: str, known: list[str]) -> list[str]:
    """The names in ``known`` that a query reads, in order; names it defines itself don't count."""
    read = {r[-1].lower() for r in _walk(spark, parsed(spark, sql.strip().rstrip(";")))[2]}
    return sorted(n for n in known if n.lower() in read)


def run_query(spark: SparkSession, sql: str, max_rows: int = 200, *, explain: bool = True, private: bool = False) -> dict[str, Any]:
    """Columns, at most ``max_rows`` rows, and whether there were more; an error has its kind and a message.  Catalog tables are closed."""
    n = max(1, max_rows)
    try:
        df = checked_query(spark, sql, explain=explain, private=private)
        rows = df.limit(n + 1).collect()
    except NotReadOnly as e:
        return {"status": "error", "error_type": "not_read_only", "message": str(e)}
    except (AnalysisException, ParseException) as e:
        return {"status": "error", "error_type": e.getCondition() or "analysis", "message": str(e).splitlines()[0], "parameters": dict(e.getMessageParameters() or {})}
    names = result_names(df.columns)
    return {"status": "ok", "columns": names, "rows": [dict(zip(names, r, strict=True)) for r in rows[:n]], "row_count": min(len(rows), n), "truncated": len(rows) > n}


def result_names(names: list[str]) -> list[str]:
    """Repeated names get ``__2``, ``__3``; empty ones ``column_N``."""
    out: list[str] = []
    for i, name in enumerate(names, 1):
        base = name or f"column_{i}"
        k = sum(1 for x in names[: i - 1] if x == name) + 1
        new = base if k == 1 else f"{base}__{k}"
        while new in out:
            k += 1
            new = f"{base}__{k}"
        out.append(new)
    return out
