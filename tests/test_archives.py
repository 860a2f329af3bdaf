"""Archives and binary shapes: round trips, quotes, empty members, byte ranges and both byte orders."""

import struct
import zipfile

from arborlens.sources import archives, shapes


def test_members_of_archives(spark, tmp_path):
    """Several members, one empty, one with quotes and line ends inside them, one in a folder, one of other columns."""
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.txt", "id\tname\tn\n" + "".join(f"{i}\trow {i}\t{i * 2}\n" for i in range(9000)))
        z.writestr("empty.txt", "")
        z.writestr("deep/two.txt", "n\tid\tother\nx\t-1\to\n7\t-2\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("one.txt", "id\tname\n5\tsame\n")
        z.writestr("quoted.csv", 'id,name\n1,"a, ""b""\nnext line"\n2,\n')
    found = {(r.archive.rpartition("/")[2], r.member, r["size"] > 0) for r in archives.zip_members(spark, str(tmp_path)).collect()}
    assert found == {("a.zip", "one.txt", True), ("a.zip", "empty.txt", False), ("a.zip", "deep/two.txt", True), ("b.zip", "one.txt", True), ("b.zip", "quoted.csv", True)}
    rows = archives.zip_table(spark, str(tmp_path), "id long, name string, n int", r"(?:.*/)?(one|two|empty)\\.txt".replace("\\\\", "\\"), bytes_a_task=1000).collect()
    own = sorted((r.place, r.id, r.name, r.n) for r in rows if r.archive.endswith("a.zip") and r.member == "one.txt")
    assert own == [(i, i, f"row {i}", 2 * i) for i in range(9000)]
    assert {(r.id, r.name, r.n) for r in rows if r.member == "deep/two.txt"} == {(-1, None, None), (-2, None, 7)}
    assert [(r.id, r.name, r.n) for r in rows if r.archive.endswith("b.zip")] == [(5, "same", None)]
    rows = archives.zip_table(spark, str(tmp_path), "id int, name string", "quoted.csv", sep=",", quote='"').orderBy("place").collect()
    assert [(r.place, r.id, r.name) for r in rows] == [(0, 1, 'a, "b"\nnext line'), (1, 2, None)]


def test_archives_are_written_and_described(spark, tmp_path):
    lines = spark.createDataFrame([(k, m, i, f"{m}{i}") for k in (1, 2) for m in ("x", "y") for i in range(50)], "archive int, member string, place long, line string")
    archives.write_zip(lines.repartition(3), str(tmp_path), {"note": "n"})
    with zipfile.ZipFile(tmp_path / "2.zip") as z:
        assert z.namelist() == ["x", "y", "note"] and z.read("y").decode().split() == [f"y{i}" for i in range(50)]


def _ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def test_shapefiles_by_ranges(spark, tmp_path):
    """Multipolygons, holes, null shapes and accents; ranges that begin inside records give the same rows."""
    rings = {
        1: [_ring((0, 0), (0, 9), (9, 9), (9, 0)), _ring((1, 1), (2, 1), (2, 2))], 2: None, 3: [_ring((5, 5), (6, 7), (7, 5)), _ring((20, 0), (20, 1), (21, 1)), _ring((30, 0), (30, 1), (31, 1))],
        4: [_ring(*[(i, i * i) for i in range(500)])],
    }
    rows = [(str(k + 10 * n), "Forêt d'été" if k == 1 else None, r) for n in range(6) for k, r in rings.items()]
    frame = spark.createDataFrame(rows, f"key string, name string, rings {shapes.RINGS}").repartition(3)
    shapes.write_shapefiles(frame, str(tmp_path))
    for size in (77, 5000, 1 << 20):
        got = {r["key"]: (r["name"], r.rings and [[(p.x, p.y) for p in x] for x in r.rings], r.other) for r in shapes.read_shapefiles(spark, str(tmp_path), ["key", "name", "other"], size).collect()}
        assert got == {k: (n or "", r and [[(p["x"], p["y"]) for p in x] for x in r], None) for k, n, r in rows}
    assert shapes.read_shapefiles(spark, str(tmp_path), ["key"], 300).count() == 24


def test_well_known_binary(spark):
    def polygon(order, rings):
        o = "<" if order else ">"
        return bytes([order]) + struct.pack(f"{o}II", 3, len(rings)) + b"".join(struct.pack(f"{o}I", len(r)) + struct.pack(f"{o}{2 * len(r)}d", *[v for p in r for v in p]) for r in rings)

    outer, hole, other = [(0, 0), (4, 0), (4, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)], [(9, 9), (10, 9), (10, 10), (9, 9)]
    both = bytes([0]) + struct.pack(">II", 6, 2) + polygon(1, [outer, hole]) + polygon(0, [other])
    rows = spark.createDataFrame([(1, bytearray(both)), (2, bytearray(polygon(0, [outer]))), (3, None)], "k int, b binary").select("k", shapes.from_wkb()("b").alias("r"))
    got = {r.k: r.r and [[(p.x, p.y) for p in x] for x in r.r] for r in rows.collect()}
    assert got == {1: [outer[:-1], hole[:-1], other[:-1]], 2: [outer[:-1]], 3: None}
