"""Station packages: JSON documents in, partitioned index tables out.

A package is a folder ``<root>/<station_id>/<version>/`` with metadata.json,
navigation_graph.json and, optionally, route_video_edges.json.  All packages
below a root are read at once.  The index tables are partitioned by station
and version and rebuilt by overwriting the partitions concerned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floorgraph.functions.text import first_non_empty, name_key
from floorgraph.sources import schemas as sc

_C = F.col
KEYS = ["station_id", "version"]


def decoded(path: Column) -> Column:
    """A path as a file's metadata names it, without percent signs; a plus stands for itself."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _documents(spark: SparkSession, root: str | list[str], name: str, schema: str) -> DataFrame:
    """Documents of this name with the station and version of their folder; missing ones are no rows."""
    docs = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).schema(schema).json(root)
    path = F.split(F.col("_metadata.file_path"), "/")
    folder = docs.select("*", decoded(F.element_at(path, -3)).alias("_station"), decoded(F.element_at(path, -2)).alias("_version"))
    return folder


def read_packages(spark: SparkSession, root: str | list[str]) -> dict[str, DataFrame]:
    """stations, nodes, edges and video_edges of every package below ``root``, or in a list of folders of packages.

    Node keys are numbered where they are missing.
    """
    meta = _documents(spark, root, "metadata.json", sc.METADATA)
    stations = meta.select(
        F.coalesce("station_id", "_station").alias("station_id"), F.coalesce("version", "_version").alias("version"),
        first_non_empty(_C("station_name"), _C("station_id"), _C("_station")).alias("station_name"), F.coalesce("line_ids", F.array().cast("array<string>")).alias("line_ids"),
    )
    graph = _documents(spark, root, "navigation_graph.json", sc.GRAPH)
    named = lambda df: df.withColumnsRenamed({"_station": "station_id", "_version": "version"})
    nodes = named(graph.select("_station", "_version", F.posexplode("nodes").alias("_at", "n")).select("_station", "_version", "_at", "n.*"))
    nodes = nodes.where("node_id <> ''").withColumn("node_key", F.coalesce("node_key", _C("_at") + 1)).withColumn("node_key_str", F.coalesce("node_key_str", F.format_string("N%04d", _C("_at") + 1))).drop("_at")
    edges = named(graph.select("_station", "_version", F.explode("edges").alias("e")).select("_station", "_version", "e.*"))
    videos = named(_documents(spark, root, "route_video_edges.json", sc.VIDEOS).select("_station", "_version", F.explode("edges").alias("e")).select("_station", "_version", "e.*"))
    return {"stations": stations, "nodes": nodes, "edges": edges, "video_edges": videos}


def facility_kind() -> tuple[Column, Column]:
    """Facility type and subtype of a node; null for nodes that are none."""
    kind = F.when((_C("poi_type") == "toilet") | (_C("type") == "toilet"), "toilet").when(_C("connector_type").isin("elevator", "escalator", "stair"), _C("connector_type")).when(_C("type").isin("gate", "elevator"), _C("type")).when(_C("type") == "poi", first_non_empty(_C("poi_type"), F.lit("poi")))
    subtype = F.when(kind == "toilet", first_non_empty(_C("toilet_gender"), F.lit("both"))).when(kind == "gate", _C("gate_type"))
    return kind, subtype


def index_tables(packages: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """platform_nodes, exit_nodes, facility_nodes and video_edges of the packages."""
    nodes = packages["nodes"]
    doors = nodes.where("type = 'platform_position' and platform_id is not null and car is not null")
    centre = doors.groupBy(*KEYS, "platform_id", "car").agg(*[F.avg(_C("position")[i]).alias(f"m{i}") for i in range(3)], F.count("*").cast("int").alias("source_door_count"), F.sort_array(F.collect_list("car_door")).alias("source_doors"))
    away = sum(((_C("position")[i] - _C(f"m{i}")) * (_C("position")[i] - _C(f"m{i}")) for i in range(3)), F.lit(0.0))
    w = Window.partitionBy(*KEYS, "platform_id", "car").orderBy(F.round(away, 9), "node_key")
    platforms = doors.join(centre, [*KEYS, "platform_id", "car"]).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    kind, subtype = facility_kind()
    facilities = nodes.select(*KEYS, "node_id", kind.alias("facility_type"), subtype.alias("facility_subtype"), first_non_empty(_C("label"), _C("node_id")).alias("label"), "node_key_str", "layer", "position")
    return {
        "platform_nodes": platforms.select(*KEYS, "platform_id", "car", "line_id", "direction", "node_id", "node_key_str", "position", "source_door_count", "source_doors"),
        "exit_nodes": nodes.where(_C("type").isin("exit", "exit_elevator") & (F.coalesce("exit_number", F.lit("")) != "")).select(*KEYS, "node_id", "exit_number", "node_key_str", _C("type").alias("node_type"), "layer", "position"),
        "facility_nodes": facilities.where("facility_type is not null"),
        "video_edges": packages["video_edges"].where("edge_id is not null").select(*KEYS, "edge_id", "video_title", F.coalesce(F.nullif("url", F.lit("")), "r2_url").alias("url"), "from_node_key", "to_node_key", "route_edge_type", "connector_type", "transport_mode", F.coalesce("used_by_count", F.lit(0)).alias("used_by_count")),
    }


def write_index(tables: dict[str, DataFrame], root: str) -> None:
    """Overwrite the partitions of the stations and versions at hand; the others stay.

    Checks the key of each table first, so nothing is written of a package with repeated keys.
    """
    keys = {"platform_nodes": ["platform_id", "car"], "exit_nodes": ["node_id"], "facility_nodes": ["node_id"], "video_edges": ["edge_id"]}
    for name, table in tables.items():
        repeated = table.groupBy(*KEYS, *keys[name]).count().where("count > 1").limit(1).collect()
        if repeated:
            raise ValueError(f"{name}: repeated key {repeated[0].asDict()}")
    for name, table in tables.items():
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(f"{root}/{name}")


def upsert_stations(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Station records by id, new ones over old, the new version active; ordered by name and id on output."""
    rank = Window.partitionBy("station_id").orderBy(F.desc("_new"))
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r", "_new").orderBy("station_name", "station_id")


def station_listing(stations: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(station_id, name, is_alias): each station and a row for each other name that it is shown by."""
    own = stations.select("station_id", _C("station_name").alias("name"), F.lit(False).alias("is_alias"))
    if aliases is None:
        return own
    other = stations.join(aliases, "station_id").where(name_key(_C("alias")) != name_key(_C("station_name")))
    return own.unionByName(other.select("station_id", _C("alias").alias("name"), F.lit(True).alias("is_alias")).distinct())
