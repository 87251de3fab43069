import random

from shutterlake.sources import headers as H

SPOT = [(48, 1), (30, 1), (1800, 100)]


def header(order="little", **more):
    return H.write_header(order, {H.MAKE: "Canon", H.MODEL: "EOS", H.ORIENTATION: 6} | more.get("tags", {}), {H.TAKEN: "2024:05:01 10:11:12"}, {H.LAT_REF: "S", H.LAT: SPOT, H.LON_REF: "E", H.LON: SPOT})


FULL = ("Canon", "EOS", 6, "2024:05:01 10:11:12", "S", [48.0, 30.0, 18.0], "E", [48.0, 30.0, 18.0])
NONE = (None,) * 8


def test_both_byte_orders_and_jpeg():
    for order in ("little", "big"):
        assert H.read_header(header(order)) == FULL == H.read_header(H.in_jpeg(header(order)))


def test_what_is_no_header():
    for data in (None, b"", b"II", b"GIF89a", b"\xff\xd8\xff\xda\0\0", b"\xff\xd8\xff\xe1\0\0", b"II*\0\xff\xff\xff\xff", b"MM\0*\0\0\0\0"):
        assert H.read_header(data) == NONE


def test_cut_at_every_length():
    whole = header()
    for n in range(len(whole)):
        got = H.read_header(whole[:n])
        assert all(a is None or a == b for a, b in zip(got, FULL))
    assert H.read_header(whole[:30]) == NONE


def test_directories_that_point_to_themselves():
    whole = header()
    for tag in (H.DETAILS, H.PLACE):
        at = whole.index(tag.to_bytes(2, "little"), 10) + 8
        got = H.read_header(whole[:at] + (8).to_bytes(4, "little") + whole[at + 4 :])
        assert got[:3] == FULL[:3] and (got[3] if tag == H.DETAILS else got[5]) is None


def test_random_bytes_never_fail():
    rng = random.Random(3)
    whole = bytearray(header("big"))
    for _ in range(3000):
        broken = bytearray(whole)
        for _ in range(rng.randint(1, 12)):
            broken[rng.randrange(4, len(broken))] = rng.randrange(256)
        H.read_header(bytes(broken))


def test_table_with_clashing_names(spark):
    zero = H.write_header("big", {}, {}, {H.LAT_REF: "N", H.LAT: [(1, 0), (2, 1), (3, 1)]})
    rows = [(1, bytearray(header()), "mine"), (2, None, "mine"), (3, bytearray(zero), "mine"), (1, bytearray(header()), "mine")]
    out = H.with_headers(spark.createDataFrame(rows, "id long, content binary, camera_make string")).collect()
    assert len(out) == 4 and out[0].asDict().keys() == {"id", "camera_make", "camera_model", "orientation", "date_taken", "latitude", "longitude"}
    by = {r["id"]: r for r in out}
    assert by[1]["camera_make"] == "Canon" and abs(by[1]["latitude"] + 48.505) < 1e-9 and str(by[1]["date_taken"]) == "2024-05-01 10:11:12"
    assert by[2]["camera_make"] is None and by[3]["latitude"] is None
