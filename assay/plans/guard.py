"""A guard over parsed plans: only reading statements pass, and none that reach files, settings or the JVM."""

from __future__ import annotations

import re
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

#: Statements that read the catalog or explain a plan, by parsed class.
READING = {"DescribeRelation", "DescribeTable", "DescribeColumn", "DescribeQueryCommand", "DescribeFunction", "DescribeNamespace", "ShowTables", "ShowColumns", "ShowFunctions", "ShowViews", "ShowNamespaces", "ShowCurrentNamespaceCommand", "ShowTableProperties", "ExplainCommand"}
#: Functions that run code of their own or show what lies outside the data.
FORBIDDEN = {"reflect", "java_method", "try_reflect", "input_file_name", "assert_true", "raise_error"}
FORMATS = {"csv", "json", "parquet", "orc", "text", "binaryfile", "avro", "xml", "delta", "jdbc"}
LEADING = {"SELECT", "WITH", "DESCRIBE", "DESC", "SHOW", "EXPLAIN", "FROM", "VALUES", "TABLE", "("}


class WriteNotAllowed(ValueError):
    """The statement does more than read registered data."""


class BadQuery(ValueError):
    """The statement cannot be parsed or run."""


def leading_keyword(sql: str) -> str:
    """The first word after white space and comments."""
    at = 0
    while at < len(sql):
        rest = sql[at:]
        if rest[0].isspace():
            at += 1
        elif rest.startswith("--"):
            end = rest.find("\n")
            if end < 0:
                return ""
            at += end + 1
        elif rest.startswith("/*"):
            depth, k = 1, 2
            while k < len(rest) and depth:
                if rest.startswith("/*", k):
                    depth, k = depth + 1, k + 2
                elif rest.startswith("*/", k):
                    depth, k = depth - 1, k + 2
                else:
                    k += 1
            at += k
        else:
            m = re.match(r"[A-Za-z]+|\(", rest)
            return m[0].upper() if m else rest[0]
    return ""


def _line(e: Exception) -> str:
    """The first line of an error that says something."""
    return next((x.strip() for x in str(e).split("\n") if x.strip()), type(e).__name__)[:300]


def _items(seq: Any) -> list[Any]:
    return [seq.apply(i) for i in range(seq.size())]


def _name(node: Any) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def check(spark: SparkSession, sql: str) -> str:
    """'query' or 'catalog'; raises WriteNotAllowed or BadQuery."""
    if leading_keyword(sql) not in LEADING:
        raise WriteNotAllowed(f"{leading_keyword(sql) or 'an empty statement'} is not allowed; only reading statements are")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except PySparkException as e:
        raise BadQuery(_line(e)) from e
    except Exception as e:  # the parser's own error, as Java throws it
        raise BadQuery(_line(e)) from e
    jvm = spark.sparkContext._jvm
    command = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    statement = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")
    subquery = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    nodes, kind = [(plan, True)], "query"
    while nodes:
        node, top = nodes.pop()
        name = _name(node)
        if command.isInstance(node) or statement.isInstance(node):
            if not (top and name in READING):
                raise WriteNotAllowed(f"{name} is not allowed")
            kind = "catalog"
            if name == "ExplainCommand":
                nodes.append((node.logicalPlan(), False))
                continue
        if name in ("ScriptTransformation", "InsertIntoDir"):
            raise WriteNotAllowed(f"{name} is not allowed")
        if name == "UnresolvedRelation":
            parts = [str(p) for p in _items(node.multipartIdentifier())]
            if len(parts) > 1 and parts[0].lower() in FORMATS:
                raise WriteNotAllowed("files are read by load_dataset only")
        expressions = _items(node.expressions())
        while expressions:
            e = expressions.pop()
            if _name(e) in ("UnresolvedFunction",):
                called = str(_items(e.nameParts())[-1]).lower()
                if called in FORBIDDEN:
                    raise WriteNotAllowed(f"{called} is not allowed")
            if subquery.isInstance(e):
                nodes.append((e.plan(), False))
            expressions += _items(e.children())
        nodes += [(c, False) for c in _items(node.children())]
        if name == "UnresolvedWith":
            nodes += [(r._2(), False) for r in _items(node.cteRelations())]
    return kind


def own_limit(spark: SparkSession, sql: str) -> int | None:
    """The LIMIT that the statement itself ends in, of a text that ``check`` lets pass."""
    node = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    while _name(node) == "UnresolvedWith":
        node = node.child()
    if _name(node) != "GlobalLimit" or not node.limitExpr().foldable():
        return None
    return int(str(node.limitExpr().eval(None)))
