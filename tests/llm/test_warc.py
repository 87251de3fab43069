import base64
import gzip
import hashlib
import json
import os
import random

import pytest

from shutterlake.llm import warc

PAGES = [(1, "http://a/x", "<p>é</p>"), (2, "http://a/y", "<p>é</p>"), (3, None, None), (4, "u v\n", ""), (5, "http://b", "x\r\n\r\nWARC/1.1\r\n" * 3), (6, "http://c", "z" * 3_000_000), (2, "http://a/y", "<p>é</p>"), (9, "http://c", "y")]


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 1, 5])
def test_round_trip(spark, tmp_path, least):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, record_type string")
    files = warc.write_archives(pages, f"file://{tmp_path}/mono", least)
    assert sum(r["records"] for r in files.collect()) == len(PAGES)
    index = warc.normalise(files, f"file://{tmp_path}/records")
    got = warc.read_archives(index).collect()
    last = {}
    for p, _, t in PAGES:
        last[t or ""] = max(last.get(t or "", p), p)
    want = sorted((p, len((t or "").encode()), digest(t), "revisit" if p != last[t or ""] and len((t or "").encode()) >= least else "response") for p, _, t in PAGES)
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in got) == want
    for r in got:
        text = next(t for p, _, t in PAGES if p == r["page_id"]) or ""
        assert (r["payload"] is None) == (r["record_type"] == "revisit") == (r["refers_to"] is not None)
        assert r["payload"] is None or bytes(r["payload"]).decode() == text
        assert r["refers_to"] in (None, last[text])
    # every record is a member of its own, and the sidecar says where
    for name in os.listdir(tmp_path / "mono"):
        if name.startswith("."):
            continue
        body = (tmp_path / "records" / name).read_bytes()
        lines = [json.loads(x) for x in (tmp_path / "records" / f"{name}.idx").read_text().splitlines()]
        assert [x["offset"] for x in lines] == [sum(y["length"] for y in lines[:k]) for k in range(len(lines))]
        parts = [gzip.decompress(body[x["offset"] : x["offset"] + x["length"]]) for x in lines]
        assert all(p.startswith(b"WARC/1.1\r\n") for p in parts)
        assert b"".join(parts) == gzip.decompress((tmp_path / "mono" / name).read_bytes())


def test_empty_and_null_ids(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    files = warc.write_archives(empty, f"file://{tmp_path}/m")
    assert warc.read_archives(warc.normalise(files, f"file://{tmp_path}/n")).count() == 0
    some = spark.createDataFrame([(None, "u", "q"), (7, "u", "q"), (None, "u", "r")], "page_id long, url string, html string")
    got = warc.read_archives(warc.normalise(warc.write_archives(some, f"file://{tmp_path}/o"), f"file://{tmp_path}/p")).collect()
    assert sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in got) == [("7", "response", "None"), ("None", "response", "None"), ("None", "revisit", "7")]


def test_very_long_payloads_and_equal_ones_of_many_rows(spark, tmp_path):
    noise = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz0123456789é", k=9_000_000))
    rows = [(1, "u", noise), (2, "u", noise), (3, "u", noise[:-1] + "x"), *((10 + k, "u", "same") for k in range(200))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    files = warc.write_archives(pages, f"file://{tmp_path}/mono")
    got = {r["page_id"]: r for r in warc.read_archives(warc.normalise(files, f"file://{tmp_path}/records")).collect()}
    assert got[1]["refers_to"] == 2 and bytes(got[2]["payload"]).decode() == noise and bytes(got[3]["payload"]).decode() == rows[2][2]
    assert [got[10 + k]["refers_to"] for k in range(200)] == [209] * 199 + [None]
