"""Decision tree of a delimited file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statloom import schemas
from statloom.operators import tree
from statloom.sources.files import categorical_rows
from statloom.storage import load_model, save_model


def tree_of_file(spark: SparkSession, path: str, schema: str = schemas.LENSES_SCHEMA, **options) -> DataFrame:
    """Nodes of the tree trained on a tab-delimited file whose last column is the label."""
    rows = categorical_rows(spark, path, schema)
    *features, label = rows.columns
    return tree.train(rows, features, label, **options)


def stored_tree(spark: SparkSession, nodes: DataFrame, path: str) -> DataFrame:
    """Save a tree and read it back."""
    save_model(nodes, path)
    return load_model(spark, path, schemas.NODE_SCHEMA)
