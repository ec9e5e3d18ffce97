"""Bulk loading: a schema file and a file of mappings give a graph."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import CatalogFault, Graph
from ..functions.expressions import interval_of_text
from ..types import default_column, is_interval, spark_type
from .files import read

#: Names of primitive and temporal types in schema files.
_PRIMITIVE = {"DT_BOOL": "BOOL", "DT_SIGNED_INT32": "INT32", "DT_SIGNED_INT64": "INT64", "DT_UNSIGNED_INT32": "UINT32", "DT_UNSIGNED_INT64": "UINT64", "DT_FLOAT": "FLOAT", "DT_DOUBLE": "DOUBLE", "DT_DATE": "DATE", "DT_DATE32": "DATE", "DT_DATETIME": "TIMESTAMP", "DT_INTERVAL": "INTERVAL", "DT_STRING": "STRING"}
_TEMPORAL = {"date": "DATE", "date32": "DATE", "datetime": "TIMESTAMP", "timestamp": "TIMESTAMP", "interval": "INTERVAL"}


def _yaml(path: str) -> dict[str, Any]:
    try:
        import yaml
    except ImportError as e:
        raise CatalogFault("YAML files need PyYAML; give load_graph() dictionaries instead") from e
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def _type(spec: dict[str, Any]) -> T.DataType:
    if "primitive_type" in spec:
        return spark_type(_PRIMITIVE[spec["primitive_type"]])
    if "temporal" in spec:
        return spark_type(_TEMPORAL[next(iter(spec["temporal"]))])
    return T.StringType()


def _properties(spec: dict[str, Any]) -> dict[str, T.DataType]:
    return {p["property_name"]: _type(p["property_type"]) for p in spec.get("properties") or []}


def _column(rows: DataFrame, spec: dict[str, Any], default: int) -> str:
    """The column that a mapping means: by place if it has one, else by name."""
    index = spec.get("index", None if spec.get("name") in rows.columns else default)
    return rows.columns[index] if index is not None else spec["name"]


def _value(column: str, kind: T.DataType):
    raw = F.col(f"`{column}`")
    return interval_of_text(raw.cast("string")) if is_interval(kind) else raw.cast(kind)


def load_graph(spark: SparkSession, schema: str | dict[str, Any], mapping: str | dict[str, Any], folder: str | None = None) -> Graph:
    """The graph of a schema (a YAML file or its content), read from the files that the mapping names, relative to folder."""
    if folder is None and isinstance(mapping, str):
        folder = os.path.dirname(mapping)
    schema = _yaml(schema) if isinstance(schema, str) else schema
    mapping = _yaml(mapping) if isinstance(mapping, str) else mapping
    meta = mapping.get("loading_config", {}).get("format", {}).get("metadata", {})
    options = {"delim": meta.get("delimiter", "|"), "header": meta.get("header_row", True), "quote": meta.get("quote_char", '"'), "quoting": meta.get("quoting", True), "escape": meta.get("escape_char", "\\"), "escaping": meta.get("escaping", False)}
    options["quoting"] = True  # a quoted field is read as one in either case
    at = lambda name: name if "://" in name or name.startswith("/") else f"{folder or '.'}/{name}"
    graph = Graph(spark)
    kinds, keys = {}, {}
    for v in schema["schema"]["vertex_types"]:
        kinds[v["type_name"]], keys[v["type_name"]] = _properties(v), v["primary_keys"][0]
    nodes = {m["type_name"]: m for m in mapping.get("vertex_mappings") or []}
    for label, props in kinds.items():
        if label not in nodes:
            graph.add_nodes(label, spark.createDataFrame([], T.StructType([T.StructField(p, k) for p, k in props.items()])), keys[label])
            continue
        m = nodes[label]
        rows = read(spark, [at(x) for x in m["inputs"]], options)
        given = {c["property"]: _column(rows, c.get("column", {}), i) for i, c in enumerate(m.get("column_mappings") or [])} or dict(zip(props, rows.columns, strict=False))
        columns = [(F.coalesce(_value(given[p], k), default_column(k)) if p in given and p != keys[label] else _value(given[p], k) if p in given else default_column(k)).alias(p) for p, k in props.items()]
        graph.add_nodes(label, rows.select(*columns).dropDuplicates([keys[label]]), keys[label])
    edges = {(t["source_vertex"], m["type_name"], t["destination_vertex"]): (m, t) for m in schema["schema"].get("edge_types") or [] for t in m["vertex_type_pair_relations"]}
    maps: dict[tuple[str, str, str], list] = {}
    for m in mapping.get("edge_mappings") or []:
        t = m["type_triplet"]
        maps.setdefault((t["source_vertex"], t["edge"], t["destination_vertex"]), []).append(m)
    for (a, name, b), (spec, pair) in edges.items():
        props = _properties(spec) | _properties(pair)
        ends = {"_src": graph.node(a).key_type, "_dst": graph.node(b).key_type}
        df = spark.createDataFrame([], T.StructType([T.StructField(p, k) for p, k in {**ends, **props}.items()]))
        for m in maps.get((a, name, b), []):
            rows = read(spark, [at(x) for x in m["inputs"]], options)
            src = _column(rows, (m.get("source_vertex_mappings") or [{}])[0].get("column", {"index": 0}), 0)
            dst = _column(rows, (m.get("destination_vertex_mappings") or [{}])[0].get("column", {"index": 1}), 1)
            given = {c["property"]: _column(rows, c.get("column", {}), i + 2) for i, c in enumerate(m.get("column_mappings") or [])}
            columns = [F.col(f"`{src}`").cast(ends["_src"]).alias("_src"), F.col(f"`{dst}`").cast(ends["_dst"]).alias("_dst"), *[(F.coalesce(_value(given[p], k), default_column(k)) if p in given else default_column(k)).alias(p) for p, k in props.items()]]
            for end, label in (("_src", a), ("_dst", b)):
                have = graph.node(label)
                rows_ = rows.select(*columns) if end == "_src" else rows_
                rows_ = rows_.join(have.df.select(F.col(f"`{have.key}`").alias("_there")), F.col(end) == F.col("_there"), "left_semi")
            df = df.unionByName(rows_)
        graph.add_edges(name, a, b, df)
        graph.multiplicities[name] = pair.get("relation", "MANY_TO_MANY")
    return graph
