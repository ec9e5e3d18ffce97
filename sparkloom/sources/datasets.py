"""Small graphs that are built in."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..catalog import CatalogFault, Graph
from .bulk import load_graph

#: People, programs, and who knows whom and made what, with weights.
_PEOPLE = [(1, "marko", 29), (2, "vadas", 27), (4, "josh", 32), (6, "peter", 35)]
_SOFTWARE = [(3, "lop", "java"), (5, "ripple", "java")]
_KNOWS = [(1, 2, 0.5), (1, 4, 1.0)]
_CREATED = [(1, 3, 0.4, 2020), (4, 3, 0.4, 2022), (6, 3, 0.2, 2023), (4, 5, 1.0, 2021)]


def modern_graph(spark: SparkSession) -> Graph:
    """Six nodes and six edges."""
    g = Graph(spark)
    g.add_nodes("person", spark.createDataFrame(_PEOPLE, "id long, name string, age int"), "id")
    g.add_nodes("software", spark.createDataFrame(_SOFTWARE, "id long, name string, lang string"), "id")
    g.add_edges("knows", "person", "person", spark.createDataFrame(_KNOWS, "_src long, _dst long, weight double"))
    return g.add_edges("created", "person", "software", spark.createDataFrame(_CREATED, "_src long, _dst long, weight double, since int"))


DATASETS = {"modern_graph": modern_graph}


def load_dataset(spark: SparkSession, name: str, folder: str | None = None) -> Graph:
    """A built-in data set; with a folder, the one whose graph.yaml (schema) and import.yaml (mappings of files) stand there."""
    if folder is not None:
        return load_graph(spark, f"{folder}/graph.yaml", f"{folder}/import.yaml")
    if name not in DATASETS:
        raise CatalogFault(f"no data set {name}: give the folder that holds its files")
    return DATASETS[name](spark)
