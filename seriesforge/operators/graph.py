"""The graph of a data lake: datasets, the columns they can be joined and filtered by, their values and hierarchies.

Nodes and edges are tables, so a graph of many values is no driver object. Nodes: id, node_type (DATASET,
DISCRIMINATOR, VALUE, VALUE_COLUMN), name (dataset or column) and value. Edges: source, target, edge_type
(DATASET_HAS_DISCRIMINATOR, DATASET_HAS_VALUE_COL, DISCRIMINATOR_HAS_VALUE, CHILD_OF).
"""

from __future__ import annotations

import json
from collections import deque
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .profile import column_values, dependencies, union_all, value_edges

NODE = ("id", "node_type", "name", "value")
EDGE = ("source", "target", "edge_type")


def build(frames: dict[str, DataFrame], discriminators: dict[str, list[str]], values: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of datasets, given the columns of each that are discriminators and values."""
    node = lambda df, kind, name, value: df.select(F.concat_ws("", F.lit({"DATASET": "ds:", "DISCRIMINATOR": "disc:", "VALUE": "val:", "VALUE_COLUMN": "valcol:"}[kind]), name, *([F.lit("="), value] if value is not None else [])).alias("id"), F.lit(kind).alias("node_type"), name.alias("name"), (value if value is not None else F.lit(None).cast("string")).alias("value"))
    edge = lambda df, a, b, kind: df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("edge_type"))
    nodes, edges = [], []
    for name, df in frames.items():
        discs, vals = discriminators.get(name, []), values.get(name, [])
        one = df.sparkSession.range(1)
        nodes.append(node(one, "DATASET", F.lit(name), None))
        for c in discs:
            nodes.append(node(one, "DISCRIMINATOR", F.lit(c), None))
            edges.append(edge(one, F.lit(f"ds:{name}"), F.lit(f"disc:{c}"), "DATASET_HAS_DISCRIMINATOR"))
        for c in vals:
            nodes.append(node(one, "VALUE_COLUMN", F.lit(c), None))
            edges.append(edge(one, F.lit(f"ds:{name}"), F.lit(f"valcol:{c}"), "DATASET_HAS_VALUE_COL"))
        if not discs:
            continue
        found = column_values(df, discs)
        nodes.append(node(found, "VALUE", F.col("column"), F.col("value")))
        edges.append(edge(found, F.concat(F.lit("disc:"), F.col("column")), F.concat(F.lit("val:"), F.col("column"), F.lit("="), F.col("value")), "DISCRIMINATOR_HAS_VALUE"))
        if len(discs) > 1:
            for child, parent in sorted(tuple(r) for r in dependencies(df, discs).select("child", "parent").collect()):  # a row for each pair of columns at most
                pairs = value_edges(df, child, parent)
                edges.append(edge(pairs, F.concat(F.lit("val:"), F.col("child")), F.concat(F.lit("val:"), F.col("parent")), "CHILD_OF"))
    return union_all(nodes).distinct(), union_all(edges).distinct()


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, n: the numbers of nodes and edges of each type."""
    return nodes.groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")))


def related(edges: DataFrame, dataset: str) -> DataFrame:
    """dataset, discriminator: the others that share a discriminator with a dataset."""
    has = edges.where("edge_type = 'DATASET_HAS_DISCRIMINATOR'")
    own = has.where(F.col("source") == f"ds:{dataset}").select("target")
    name = lambda c, n: F.substr(F.col(c), F.lit(n))
    return has.where(F.col("source") != f"ds:{dataset}").join(own, "target", "left_semi").select(name("source", 4).alias("dataset"), name("target", 6).alias("discriminator"))


def hierarchy(edges: DataFrame, column: str) -> DataFrame:
    """parent, children: the values of a column under each value that stands above them."""
    own = edges.where("edge_type = 'CHILD_OF'").where(F.col("source").startswith(f"val:{column}="))
    return own.groupBy(F.substr("target", F.lit(5)).alias("parent")).agg(F.array_sort(F.collect_set(F.substr("source", F.lit(5)))).alias("children"))


def column_steps(edges: DataFrame) -> dict[str, list[str]]:
    """The columns right above each column; as small as the schema."""
    of = lambda c: F.regexp_extract(c, "^val:([^=]*)=", 1)
    rows = edges.where("edge_type = 'CHILD_OF'").select(of("source").alias("child"), of("target").alias("parent")).distinct().collect()
    out: dict[str, list[str]] = {}
    for child, parent in sorted(tuple(r) for r in rows):
        out.setdefault(child, []).append(parent)
    return out


def bridge(steps: dict[str, list[str]], start: str, end: str) -> list[str] | None:
    """The shortest way up from a column to another."""
    ways, seen = deque([[start]]), {start}
    while ways:
        way = ways.popleft()
        if way[-1] == end:
            return way
        for above in steps.get(way[-1], []):
            if above not in seen:
                seen.add(above)
                ways.append([*way, above])
    return None


def join_path(edges: DataFrame, a: str, b: str, steps: dict[str, list[str]] | None = None) -> dict | None:
    """How two datasets can be joined: directly, by the discriminators they share, or by a hierarchy from a column of the
    first up to one of the second; None if neither."""
    rows = edges.where("edge_type = 'DATASET_HAS_DISCRIMINATOR'").where(F.col("source").isin(f"ds:{a}", f"ds:{b}")).select("source", "target").collect()
    own = {d: {r.target.removeprefix("disc:") for r in rows if r.source == f"ds:{d}"} for d in (a, b)}
    shared = sorted(own[a] & own[b])
    if shared:
        return {"join_type": "direct", "columns": shared}
    steps = steps if steps is not None else column_steps(edges)
    ways = [w for x in sorted(own[a]) for y in sorted(own[b]) if (w := bridge(steps, x, y))]
    return {"join_type": "hierarchical", "columns": min(ways, key=len)} if ways else None


def save(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def to_json(nodes: DataFrame, edges: DataFrame) -> str:
    """The graph as one JSON document, for graphs that a person looks at."""
    return json.dumps({"nodes": [r.asDict() for r in nodes.select(*NODE).orderBy("id").collect()], "links": [r.asDict() for r in edges.select(*EDGE).orderBy(*EDGE).collect()]}, default=str, sort_keys=True)


def from_json(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    found = json.loads(text)
    rows = lambda part, cols: [tuple(r.get(c) for c in cols) for r in found[part]]
    kind = lambda cols: ", ".join(f"{c} string" for c in cols)
    return spark.createDataFrame(rows("nodes", NODE), kind(NODE)), spark.createDataFrame(rows("links", EDGE), kind(EDGE))


def to_graphml(nodes: DataFrame, edges: DataFrame) -> str:
    """The graph as GraphML."""
    lines = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    lines += [f'<key id="{k}" for="{"edge" if k == "edge_type" else "node"}" attr.name="{k}" attr.type="string"/>' for k in ("node_type", "name", "value", "edge_type")]
    lines.append('<graph edgedefault="directed">')
    data = lambda r, keys: "".join(f'<data key="{k}">{quoteattr(str(r[k]))[1:-1]}</data>' for k in keys if r[k] is not None)
    lines += [f"<node id={quoteattr(r.id)}>{data(r, NODE[1:])}</node>" for r in nodes.orderBy("id").collect()]
    lines += [f"<edge source={quoteattr(r.source)} target={quoteattr(r.target)}>{data(r, EDGE[2:])}</edge>" for r in edges.orderBy(*EDGE).collect()]
    return "\n".join([*lines, "</graph>", "</graphml>"])
