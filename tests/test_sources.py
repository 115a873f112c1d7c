"""Round trips of packages, files and streams."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from floorgraph.sources import files, packages
from floorgraph.streaming import ingest


def write_package(root, station, version, nodes, edges=(), videos=None, **meta):
    folder = root / station / version
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "metadata.json").write_text(json.dumps({"station_id": station, "version": version, "station_name": meta.get("name", station.upper()), "line_ids": ["1"]}))
    (folder / "navigation_graph.json").write_text(json.dumps({"nodes": nodes, "edges": list(edges)}, indent=2))
    if videos is not None:
        (folder / "route_video_edges.json").write_text(json.dumps({"edges": videos}))


def nodes():
    doors = [{"node_id": f"d{i}", "type": "platform_position", "platform_id": "P", "car": 1, "car_door": f"1-{i}", "line_id": "1", "direction": "up", "position": [x, 0.0, 0.0]} for i, x in enumerate((0.0, 1.0, 5.0), 1)]
    return [*doors, {"node_id": "x", "type": "exit", "exit_number": "3", "position": [0, 1, 2], "node_key": 70}, {"node_id": "t", "type": "poi", "poi_type": "toilet", "label": "WC"}, {"node_id": "u", "type": "exit"}]


def test_packages_to_index(spark, tmp_path):
    write_package(tmp_path / "in", "s1", "v1", nodes(), [{"edge_id": "e", "from": "d1", "to": "x", "type": "vertical"}], [{"edge_id": "A_B", "video_title": "t", "r2_url": "r"}])
    write_package(tmp_path / "in", "s2", "v1", nodes()[:2])
    read = packages.read_packages(spark, str(tmp_path / "in"))
    assert sorted(r.station_id for r in read["stations"].collect()) == ["s1", "s2"]
    assert read["edges"].count() == 1
    tables = packages.index_tables(read)
    platform = tables["platform_nodes"].where("station_id = 's1'").first()
    assert (platform.node_id, platform.source_door_count, platform.source_doors, platform.node_key_str) == ("d2", 3, ["1-1", "1-2", "1-3"], "N0002")
    assert [(r.node_id, r.exit_number) for r in tables["exit_nodes"].collect()] == [("x", "3")]
    assert [(r.facility_type, r.facility_subtype, r.label) for r in tables["facility_nodes"].collect()] == [("toilet", "both", "WC")]
    assert tables["video_edges"].first().url == "r"
    packages.write_index(tables, str(tmp_path / "index"))
    # another version of one station leaves the other's partition alone
    write_package(tmp_path / "new", "s2", "v1", nodes()[:1])
    packages.write_index(packages.index_tables(packages.read_packages(spark, str(tmp_path / "new"))), str(tmp_path / "index"))
    stored = {r.station_id: r.source_door_count for r in spark.read.parquet(str(tmp_path / "index" / "platform_nodes")).collect()}
    assert stored == {"s1": 3, "s2": 1}


def test_repeated_keys_stop_the_write(spark, tmp_path):
    write_package(tmp_path / "in", "s", "v", [nodes()[3], nodes()[3]])
    with pytest.raises(ValueError, match="exit_nodes"):
        packages.write_index(packages.index_tables(packages.read_packages(spark, str(tmp_path / "in"))), str(tmp_path / "index"))
    assert not (tmp_path / "index").exists()


def test_station_records(spark):
    schema = "station_id string, station_name string, line_ids array<string>, version string"
    old = spark.createDataFrame([("a", "Zed", ["1"], "v1"), ("b", "Ay", ["2"], "v1")], schema)
    new = spark.createDataFrame([("a", "Bee", ["1"], "v2")], schema)
    assert [(r.station_id, r.version) for r in packages.upsert_stations(old, new).collect()] == [("b", "v1"), ("a", "v2")]
    aliases = spark.createDataFrame([("a", "Bee "), ("a", "Old Bee")], "station_id string, alias string")
    assert sorted((r.name, r.is_alias) for r in packages.station_listing(new, aliases).collect()) == [("Bee", False), ("Old Bee", True)]


def test_csv_encodings(spark, tmp_path):
    for name, encoding in (("a.csv", "utf-8-sig"), ("b.csv", "cp949")):
        (tmp_path / name).write_bytes("역,선,번호\n서울,1호선,3\n".encode(encoding))
        rows = files.read_csv(spark, str(tmp_path / name))
        assert rows.columns == ["역", "선", "번호"] and rows.first()["역"] == "서울"


def test_csv_is_judged_by_all_its_bytes(spark, tmp_path):
    plain = "".join(f"{i},line,{i}\n" for i in range(20_000))
    (tmp_path / "late.csv").write_bytes(("a,b,c\n" + plain + "서울,1호선,3\n").encode("cp949"))
    assert len(plain) > 1 << 16
    assert [r.b for r in files.read_csv(spark, str(tmp_path / "late.csv")).where("c = 3 and a <> '3'").collect()] == ["1호선"]
    (tmp_path / "early [1].csv").write_bytes("\ufeffc,d\n역,x\n".encode())
    rows = files.read_csv(spark, str(tmp_path / "*.csv"))
    assert sorted(rows.columns) == ["a", "b", "c", "d"] and rows.count() == 20_002
    assert [(r.a, r.c) for r in rows.where("d = 'x'").collect()] == [(None, "역")]
    (tmp_path / "bad.csv").write_bytes(b"a\n\xff\xff\n")
    with pytest.raises(ValueError, match="bad.csv"):
        files.read_csv(spark, str(tmp_path / "bad.csv"))


@pytest.mark.parametrize(("size", "readers"), [(1, 3), (2, 1), (7, 4), (100, 2)])
def test_row_api_is_read_by_executors(spark, tmp_path, size, readers):
    asked = str(tmp_path)

    def fetch(page, page_size):
        import os
        import pathlib

        marker = pathlib.Path(asked, f"{page_size}-{page}")
        if not marker.exists():  # every page fails once
            marker.touch()
            raise OSError(f"page {page}")
        return {"items": [{"a": i, "pid": os.getpid()} for i in range((page - 1) * page_size, min(page * page_size, 23))]}

    rows = files.read_rows_api(spark, fetch, "a, pid, none", page_size=size, unwrap=("items",), readers=readers).collect()
    import os

    assert sorted(int(r.a) for r in rows) == list(range(23)) and {r.none for r in rows} == {None}
    assert str(os.getpid()) not in {r.pid for r in rows}


def test_row_api_pages(spark):
    wrap = lambda item: {"response": {"body": {"items": {"item": item}}}}
    pages = [wrap([{"a": 1, "b": ""}, {"B2": "x"}]), wrap({"a": 3})]
    rows = files.read_rows_api(spark, files.iterate_pages(pages), "a, b, B2", page_size=2)
    out = files.normalised(rows, {"first": ["a"], "second": ["b", "B2"], "third": ["zzz"]})
    assert [tuple(r) for r in out.collect()] == [("1", None, None), (None, "x", None), ("3", None, None)]


HEADERS = {
    "png": b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + b"\0" * 10,
    "gif": b"GIF89a" + struct.pack("<HH", 30, 20) + b"\0" * 20,
    "bmp": b"BM" + b"\0" * 16 + struct.pack("<ii", 50, -60) + b"\0" * 8,
    "jpg": b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"\0" * 14 + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 77, 88) + b"\0" * 10,
    "vp8x": b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (199).to_bytes(3, "little"),
    "huge": b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 30000, 10) + b"\0" * 10,
    "none": b"plain text that is no image at all",
    "tiny": b"GIF87a" + struct.pack("<HH", 3, 2),
    "long": b"\xff\xd8" + (b"\xff\xe1" + struct.pack(">H", 65535) + b"\0" * 65533) * 17 + b"stray\xff\xc2" + struct.pack(">HBHH", 17, 8, 480, 640) + b"\0" * 10,
}


def test_image_sizes(spark, tmp_path):
    for name, data in HEADERS.items():
        (tmp_path / name).write_bytes(data)
    out = {r.path.rpartition("/")[2]: (r.width, r.height, r.status) for r in files.image_sizes(spark, str(tmp_path)).collect()}
    assert out == {
        "png": (640, 480, "ok"), "gif": (30, 20, "ok"), "bmp": (50, 60, "ok"), "jpg": (88, 77, "ok"), "vp8x": (100, 200, "ok"), "huge": (30000, 10, "too_large"), "none": (None, None, "unreadable"),
        "tiny": (3, 2, "ok"), "long": (640, 480, "ok"),
    }


def test_file_listing(spark, tmp_path):
    for name in ("a.png", "b.png"):
        (tmp_path / name).write_bytes(b"x")
    done = spark.createDataFrame([("a",)], "name string")
    out = files.list_files(spark, [str(tmp_path)], {"has_polygons": done})
    assert {r.name: r.has_polygons for r in out.collect()} == {"a": True, "b": False}


def test_compact_json_and_path_text(spark, tmp_path):
    df = spark.createDataFrame([("n", [1.5, -0.0, 2.0]), ("m", [0.1234567, 3.0, 4.0])], "node_id string, position array<double>")
    files.write_json_lines(df.coalesce(1), str(tmp_path / "out"), ["position"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == ['{"node_id":"m","position":[0.123457, 3, 4]}', '{"node_id":"n","position":[1.5, 0, 2]}']
    route = spark.createDataFrame([("r", 2, "b", [0.0, 0.0, 1.0]), ("r", 1, "a", [1.0, 2.5, 0.0]), ("r", 3, "c", None)], "route string, ord int, node_id string, position array<double>")
    assert files.path_text(route).first().text == "a [1, 2.5, 0]\nb [0, 0, 1]"


def test_arrivals_are_indexed_once(spark, tmp_path):
    args = (str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "state"))
    write_package(tmp_path / "in", "s1", "v1", nodes())
    ingest.index_arrivals(spark, *args).awaitTermination(120)
    write_package(tmp_path / "in", "s2", "v1", nodes()[:2])
    ingest.index_arrivals(spark, *args).awaitTermination(120)
    stored = spark.read.parquet(str(tmp_path / "index" / "platform_nodes"))
    assert {r.station_id: r.source_door_count for r in stored.collect()} == {"s1": 3, "s2": 2}


def test_arrivals_under_odd_names(spark, tmp_path):
    args = (str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "state"))
    for name, n in (("s 3+x", 3), ("ö%41", 2)):
        write_package(tmp_path / "in", name, "v1", nodes()[:n])
    ingest.index_arrivals(spark, *args).awaitTermination(120)
    stored = spark.read.parquet(str(tmp_path / "index" / "platform_nodes"))
    assert {r.station_id for r in stored.collect()} == {"s 3+x", "ö%41"}


def test_windowed_counts_match_the_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    # in one file ordered by time nothing is late
    batch.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = ingest.windowed_counts(ingest.event_stream(spark, str(tmp_path / "events"), batch.schema), "1 day")
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    ours = {(r.start, r.event_type): r.n for r in spark.table("counts").collect()}
    want = {(r.start, r.event_type): r.n for r in batch.groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert ours == want


def test_sessions_match_the_batch(spark, sf_dir):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert ingest.sessions(batch, "1 hour").agg(F.sum("n")).first()[0] == batch.count()
