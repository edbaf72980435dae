"""Tables and text files in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or that of the context; in a local session beside the warehouse."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, by: tuple[str, ...] = (), path: str | None = None) -> str:
    """The folder that ``df`` is written (or, to ``path``, appended) to as Parquet, one subfolder for each value of ``by``.

    Rows of one value meet in few files: they are dealt by ``by`` first,
    which the planner splits where a value is large.
    """
    path = path or new_path(df.sparkSession, label)
    if by:
        df = df.hint("rebalance", *by)
    df.write.mode("append").partitionBy(*by).parquet(path)
    return path


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: rounds of one job start from it, and a lost executor costs no more than its tasks."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of :func:`kept` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "kept_path", None):
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def text_lines(df: DataFrame, line: Column, label: str, by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> str:
    """The folder that ``line`` of each row is written to as text, in ``order`` within each value of ``by``."""
    path = new_path(df.sparkSession, label)
    if by:
        df = df.repartition(*by)
    if order:
        df = df.sortWithinPartitions(*by, *order)
    df.select(*by, line.alias("value")).write.partitionBy(*by).text(path)
    return path


def mesh_lines(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """value: the lines of a mesh file, ND number x y depth and E3T number and its nodes."""
    n = nodes.select(F.format_string("ND %d %.6f %.6f %.6f", F.col("node"), F.col("x"), F.col("y"), F.col("value")).alias("value"))
    return n.union(cells.select(F.format_string("E3T %d %d %d %d 1", F.col("cell"), F.col("a"), F.col("b"), F.col("c"))))


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and cells of mesh files; other lines are passed over."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    number = lambda k, kind: F.get("p", F.lit(k)).cast(kind)
    nodes = parts.filter("p[0] = 'ND'").select(number(1, "bigint").alias("node"), number(2, "double").alias("x"), number(3, "double").alias("y"), number(4, "double").alias("value"))
    cells = parts.filter("p[0] = 'E3T'").select(*[number(k, "bigint").alias(c) for k, c in enumerate(("cell", "a", "b", "c"), 1)])
    return nodes, cells


def long_form(ragged: DataFrame, arrays: list[str]) -> DataFrame:
    """One row for each element of ``arrays``, which go together, as files of ragged trajectories have them."""
    return ragged.withColumn("row", F.explode(F.arrays_zip(*arrays))).select(*[c for c in ragged.columns if c not in arrays], *[F.col(f"row.{a}").alias(a) for a in arrays])


def rings_of_geojson(features: DataFrame, text: str) -> DataFrame:
    """``features`` with name, number and ring (array of lon and lat) from GeoJSON text of polygons or points."""
    schema = "type string, properties struct<name:string,number:bigint>, geometry struct<type:string,coordinates:string>"
    f = features.withColumn("feature", F.from_json(text, schema))
    ring = F.from_json(F.regexp_replace("feature.geometry.coordinates", r"^\[\[(.*)\]\]$", "[$1]"), "array<array<double>>")
    return f.select("*", F.col("feature.properties.name").alias("name"), F.col("feature.properties.number").alias("number"), ring.alias("ring")).drop("feature")


def polygons_of_wkt(shapes: DataFrame, text: str) -> DataFrame:
    """One row for each polygon of MULTIPOLYGON text: part (from 0) and ring (array of structs x, y)."""
    rings = F.regexp_extract_all(text, F.lit(r"\(\(([^()]*)\)\)"), F.lit(1))
    point = lambda p: F.struct(F.split_part(F.trim(p), F.lit(" "), F.lit(1)).cast("double").alias("x"), F.split_part(F.trim(p), F.lit(" "), F.lit(2)).cast("double").alias("y"))
    parts = shapes.select("*", F.posexplode(rings).alias("part", "body"))
    return parts.withColumn("ring", F.transform(F.split("body", ","), point)).drop("body")

