"""The catalogue's tables as views over the driver's tables.

Each view is a list of expressions that both Spark and DuckDB read, so that a
query and its SQL start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_PHOTOS = {
    "id": "event_id",
    "folder_id": "user_id",
    "date_taken": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END",
    "modified_utc": "ts + INTERVAL 1 DAY",
    "file_size": "CAST(round(value * 100) AS BIGINT)",
    "ext": "CASE event_type WHEN 'click' THEN '.png' WHEN 'purchase' THEN '.mp4' WHEN 'signup' THEN '.mov' ELSE '.jpg' END",
    "width": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(640 + (event_id % 5) * 640 AS INT) END",
    "height": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(480 + (event_id % 5) * 480 AS INT) END",
    "lat": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST((user_id * 37) % 120 - 60 AS DOUBLE) + CAST(event_id % 7 AS DOUBLE) * CAST(0.05 AS DOUBLE)"
    " + CASE WHEN day(ts) > 15 THEN CAST(2.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END END",
    "lon": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST((user_id * 53) % 340 - 170 AS DOUBLE) + CAST(event_id % 4 AS DOUBLE) * CAST(0.05 AS DOUBLE) END",
    "is_favorite": "event_type = 'purchase'",
    "state": "CAST(event_id % 5 AS INT)",
    "camera_make": "CASE user_id % 4 WHEN 0 THEN 'Canon' WHEN 1 THEN 'Apple' ELSE NULL END",
    "file_stem": "concat(CASE event_id % 8 WHEN 0 THEN 'IMG_' WHEN 1 THEN 'Screenshot_' WHEN 2 THEN 'whatsapp image ' WHEN 3 THEN 'funny_meme_'"
    " WHEN 4 THEN 'VID_' WHEN 5 THEN 'download-' WHEN 6 THEN 'my insta ' ELSE 'doc' END, CAST(event_id AS STRING))",
    "folder_path": "CASE user_id % 6 WHEN 0 THEN '/lib/DCIM' WHEN 1 THEN '/lib/WhatsApp Images' WHEN 2 THEN '/lib/Screenshots'"
    " WHEN 3 THEN '/lib/Downloads' WHEN 4 THEN '/lib/Memes' ELSE '/lib/Misc' END",
}
_FACES = {
    "face_id": "vec_id",
    "photo_id": "vec_id % 200",
    "embedding": "embedding",
    "person_id": "CAST(label AS BIGINT)",
    "is_unassigned": "vec_id % 5 = 0",
    "is_ignored": "vec_id % 17 = 0",
    "confidence": "CAST(vec_id * 37 % 101 AS DOUBLE) / 101",
    "created": "CAST('2024-01-01 00:00:00' AS TIMESTAMP_NTZ) + INTERVAL 1 HOUR * CAST(vec_id AS INT)",
}
_BOXES = {
    "box_id": "vec_id",
    "photo_id": "vec_id % 50",
    "x": "CAST(vec_id * 7 % 20 AS DOUBLE) / 20",
    "y": "CAST(vec_id * 3 % 20 AS DOUBLE) / 20",
    "w": "CAST(0.2 AS DOUBLE)",
    "h": "CAST(0.2 AS DOUBLE)",
    "confidence": "CAST(vec_id * 37 % 101 AS DOUBLE) / 101",
}
_FILES = {
    "id": "doc_id",
    "file_path": "concat('/lib/', source, '/doc', CAST(doc_id AS STRING), '.txt')",
    "file_size": "n_chars",
    "content": "text",
}
_TRIPS = {
    "trip_id": "o_orderkey",
    "name": "concat('Trip ', CAST(o_orderkey AS STRING))",
    "start_date": "o_orderdate",
    "end_date": "o_orderdate + INTERVAL 1 DAY * CAST(o_orderkey % 10 AS INT)",
    "distance_km": "round(o_totalprice / 1000, 1)",
    "is_favorite": "o_orderpriority = '1-URGENT'",
}
_TRIP_PHOTOS = {
    "trip_id": "l_orderkey",
    "seq": "l_linenumber",
    "photo_id": "l_partkey",
    "date_taken": "l_shipdate",
    "ext": "CASE WHEN l_returnflag = 'R' THEN '.mp4' ELSE '.jpg' END",
}


def _select(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {table}"


_PLAIN = {
    "photos_v": (_PHOTOS, "events"),
    "faces_v": (_FACES, "embeddings"),
    "boxes_v": (_BOXES, "embeddings"),
    "files_v": (_FILES, "documents"),
    "trips_v": (_TRIPS, "orders"),
    "tripphotos_v": (_TRIP_PHOTOS, "lineitem"),
}
_SQL = {name: _select(*spec).replace("TIMESTAMP_NTZ", "TIMESTAMP") for name, spec in _PLAIN.items()} | {
    "personfaces_v": "SELECT person_id, face_id FROM faces_v WHERE NOT is_unassigned",
    "places_v": "SELECT CAST(n_nationkey AS BIGINT) AS place_id, concat('City', CAST(n_nationkey AS STRING), ', ', n_name, ', ', r_name) AS name,"
    " CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(n_nationkey AS DOUBLE) END AS lat, CAST(n_nationkey * 2 AS DOUBLE) AS lon"
    " FROM nation JOIN region ON n_regionkey = r_regionkey",
    "tripplaces_v": "SELECT DISTINCT l_orderkey AS trip_id, CAST(s_nationkey AS BIGINT) AS place_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; columns nobody asks for are never read."""
    if name in _PLAIN:
        columns, table = _PLAIN[name]
        return read(spark, sf_dir, table).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])
    if name == "personfaces_v":
        return view(spark, sf_dir, "faces_v").where("NOT is_unassigned").select("person_id", "face_id")
    if name == "places_v":
        nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
        both = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
        return both.selectExpr(
            "CAST(n_nationkey AS BIGINT) AS place_id",
            "concat('City', CAST(n_nationkey AS STRING), ', ', n_name, ', ', r_name) AS name",
            "CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(n_nationkey AS DOUBLE) END AS lat",
            "CAST(n_nationkey * 2 AS DOUBLE) AS lon",
        )
    line, supplier = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    return line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).selectExpr("l_orderkey AS trip_id", "CAST(s_nationkey AS BIGINT) AS place_id").distinct()


def with_views(sql: str) -> str:
    """``sql`` with the definitions of the views it names in front."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in _SQL:
            if re.search(rf"\b{name}\b", text) and name not in used:
                need(_SQL[name])
                used.append(name)

    need(sql)
    head = ", ".join(f"{n} AS ({_SQL[n]})" for n in used)
    return f"WITH {head} SELECT * FROM ({sql})" if head else sql
