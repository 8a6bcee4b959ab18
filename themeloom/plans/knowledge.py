"""Queries over the knowledge base: items of the nested records and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import entity_number
from ..operators import hierarchy as H
from ..operators import nested as N
from ..operators.states import latest_state
from ..session import materialise, ship

LINKS = ("subclass_of", "located_in")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item in labels, aliases and properties of every record, with the key and place it stands at."""
    nodes = N.shred(table(spark, sf_dir, "wikidata_summary"), "rec_no", ["labels", "aliases", "properties"], leaves_only=True)
    return N.items(nodes).withColumnRenamed("rec", "rec_no")


def p1_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat tables that the records fall into, by schema path, with their numbers of rows."""
    return N.schema_paths(N.shred(table(spark, sf_dir, "wikidata_summary"), "rec_no", ["labels", "aliases", "properties"]))


def p1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the nested fields in the flat table of its schema path, with its label and its parent's; labels as text, ordinals joined by dots."""
    nodes = N.with_parents(N.shred(table(spark, sf_dir, "wikidata_summary"), "rec_no", ["labels", "aliases", "properties"]))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ".")
    return nodes.select(F.col("rec").alias("rec_no"), "field", "schema_path", text("label").alias("label"), text("parent").alias("parent"), "kind", "text")


def _forests(spark: SparkSession, sf_dir: str, paths: bool) -> DataFrame:
    """Both hierarchies at once, kept apart by `link`."""
    current = materialise(latest_state(table(spark, sf_dir, "wikidata_summary"), entity_number("id"), "seen_at", "rec_no", {"rec_no": F.col("rec_no"), "properties": F.col("properties")}))
    found = N.items(N.shred(current, "key", ["properties"], leaves_only=True)).where(F.col("item_key").isin(*LINKS))
    links = found.select(F.col("item_key").alias("link"), "rec", entity_number("item").alias("parent")).where("parent is not null")
    return H.hierarchy(links, "rec", "parent", current.select("key"), paths=paths, within="link")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, root and depth of every node of the two hierarchies."""
    return _forests(spark, sf_dir, False).select("link", F.col("node").alias("node_no"), "kind", F.col("root").alias("root_no"), "depth")


def p7_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path from the root and number of descendants of every node of a tree; the path as text, ids joined by ``/``."""
    trees = _forests(spark, sf_dir, True).where("kind = 'tree'")
    return trees.select("link", F.col("node").alias("node_no"), F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))).alias("path"), "n_descendants")


def p7_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every descendant of every node of a tree, and how many steps it is below it."""
    below = H.descendants(_forests(spark, sf_dir, True).where("kind = 'tree'"))
    return below.select("link", F.col("node").alias("node_no"), F.col("descendant").alias("descendant_no"), "distance")


def p7_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities on cycles and below them, and the node of each cycle that its back edge is counted at."""
    return _forests(spark, sf_dir, False).where("kind <> 'tree'").select("link", F.col("node").alias("node_no"), "kind", "back_edge")


QUERIES = {f.__name__: f for f in (p1_found, p1_tables, p1_nodes, p7_found, p7_paths, p7_descendants, p7_cycles)}
