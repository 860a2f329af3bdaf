"""Values worked out by hand from the reference's formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from arborlens.functions import confidence as conf
from arborlens.functions import geo, text, vector
from arborlens.operators import claims as C
from arborlens.operators import spatial
from arborlens.operators.clustering import kmeans_per_group
from arborlens.operators.ranking import leaf_scores
from arborlens.operators.relational import best_per_group, explode_map, percentile_place, price_in_credits, tier, upsert_with
from arborlens.plans.registry import QUERIES
from arborlens.streaming.ledger import settle


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


MAPS = [("dr5ru6j", {12345: 15, 67890: 3, 11111: 7}), ("dr5ru6k", {12345: 8, 99999: 12}), ("dr5ru6m", {67890: 25, 11111: 4, 88888: 9})]


def test_map_totals(spark):
    rows = explode_map(spark.createDataFrame(MAPS, "tile string, m map<long,long>"), "m")
    got = {r.taxon: (r.n, r.tiles) for r in rows.groupBy("taxon").agg(F.sum("n").alias("n"), F.count("*").alias("tiles")).collect()}
    assert got == {12345: (23, 2), 67890: (28, 2), 11111: (11, 2), 99999: (12, 1), 88888: (9, 1)}


@pytest.mark.parametrize(
    ("native", "introduced", "want"),
    [
        ([], [], {88888: (9, 0.0), 99999: (12, 25.0), 11111: (22, 50.0), 12345: (46, 75.0), 67890: (56, 100.0)}),
        ([11111], [], {88888: (9, 0.0), 99999: (12, 25.0), 11111: (44, 50.0), 12345: (46, 75.0), 67890: (56, 100.0)}),
        ([], [67890], {88888: (9, 0.0), 99999: (12, 33.3), 11111: (22, 66.7), 12345: (46, 100.0)}),
        ([5], [], {88888: (9, 0.0), 99999: (12, 20.0), 11111: (22, 40.0), 12345: (46, 60.0), 67890: (56, 80.0), 5: (200, 100.0)}),
    ],
)
def test_leaf_scores(spark, native, introduced, want):
    occ = explode_map(spark.createDataFrame(MAPS, "tile string, m map<long,long>"), "m")
    regions = occ.select("tile").distinct().select("tile", F.lit(1).alias("eco"), F.lit(1.0).alias("weight"))
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "taxon long")
    got = {r.taxon: (r.affinity, r.leaf_score) for r in leaf_scores(occ, regions, ids(native), ids(introduced)).collect()}
    assert got == want


def test_tiers_and_single_place(spark):
    assert [one(spark, tier(F.lit(x))) for x in (0, 25, 50, 75, 100)] == ["LOW", "LOW", "ACCEPTABLE", "GOOD", "BEST"]
    assert percentile_place(spark.createDataFrame([(1, 2)], "t int, s int"), "s", "t").first().place == 100.0


def test_prices(spark):
    wants = {5: 10, 10: 10, 11: 11, 100: 55, 101: 56, 1000: 235, 10000: 685, 10001: 686}
    rows = spark.createDataFrame([(k,) for k in wants], "h int").select("h", price_in_credits(F.col("h")).alias("c"))
    assert {r.h: r.c for r in rows.collect()} == wants


def test_common_names(spark):
    blob = "; Oak; Chêne (French), oak; Tiama [Commercial]; NA; A"
    got = [(r["name"], r["language_code"], r["position"]) for r in one(spark, text.parse_common_names(F.lit(blob)))]
    assert got == [("Oak", None, 0), ("Chêne", "fr", 1), ("Tiama [Commercial]", None, 2)]
    assert one(spark, text.top_common_names(F.lit("Frangipani; Red Jasmine (English); Plumeria"), 2)).startswith("Frangipani")
    assert one(spark, text.top_common_names(F.lit(""))) == ""


def _sources(*items):
    cells = [F.struct(F.lit(u).alias("url"), F.lit(t).alias("type"), F.lit(c).cast("double").alias("credibility")) for u, t, c in items]
    return F.array(*cells) if cells else F.array().cast("array<struct<url:string,type:string,credibility:double>>")


def test_evidence_confidence(spark):
    two = _sources(("https://www.iucnredlist.org/x", "database", None), ("https://a.example/y", "database", None))
    long_ = "x" * 61
    assert one(spark, conf.conf_evidence(F.lit("conservation_status"), F.lit(long_), two)) == pytest.approx(0.89)
    single = _sources(("https://b.example", "database", 0.85))
    assert one(spark, conf.conf_evidence(F.lit("maximum_height"), F.lit("up to 30 m"), single)) == pytest.approx(0.84)
    assert one(spark, conf.conf_evidence(F.lit("cultural_significance"), F.lit("short"), _sources())) == pytest.approx(0.46)


def test_database_confidence(spark):
    assert one(spark, conf.conf_database(_sources())) == 0.53


def test_ranges_and_koeppen(spark):
    assert tuple(one(spark, text.number_range(F.lit("12; NA; 7.5")))) == (7.5, 12.0)
    assert tuple(one(spark, text.koeppen(F.lit("Cfb - Temperate oceanic")))) == ("Cfb", "Temperate oceanic")


def test_geohash_round_trip(spark):
    assert one(spark, geo.geohash(F.lit(57.64911), F.lit(10.40744), 11)) == "u4pruydqqvj"
    b = one(spark, geo.geohash_bounds(F.lit("ezs42")))
    assert (b.lat_min, b.lat_max) == pytest.approx((42.583, 42.627), abs=1e-3)


def test_areas_and_distance(spark):
    assert one(spark, geo.distance(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))) == pytest.approx(geo.RADIUS * math.pi / 2)
    square = geo.ring([(0, 0), (1, 0), (1, 1), (0, 1)])
    assert one(spark, geo.sphere_area(square)) == pytest.approx(geo.RADIUS**2 * math.radians(1) * math.sin(math.radians(1)))
    assert one(spark, geo.contains(square, F.lit(0.5), F.lit(0.5))) and not one(spark, geo.contains(square, F.lit(1.5), F.lit(0.5)))
    assert tuple(one(spark, geo.centroid(square))) == (0.5, 0.5)
    assert not one(spark, geo.valid_ring(geo.ring([(0, 0), (1, 1), (0, 0)])))


def test_clip_and_simplify(spark):
    r = spark.range(1).select(geo.ring([(0, 0), (4, 0), (4, 4), (0, 4)]).alias("r"))
    assert r.select(geo.planar_area(geo.clip_to_box((2, 2, 9, 9))("r")).alias("a")).first().a == 4.0
    line = spark.range(1).select(geo.ring([(0, 0), (1, 0.01), (2, 0), (2, 5)]).alias("r"))
    assert line.select(F.size(geo.simplify(0.1)("r")).alias("n")).first().n == 3


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vector.norm(a)) == 5.0 and one(spark, vector.cosine(a, z)) is None


def test_spatial_join_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    boxes = [(i, x := rng.uniform(-50, 50), y := rng.uniform(-50, 50), x + rng.uniform(0, 20), y + rng.uniform(0, 20)) for i in range(60)]
    frame = spark.createDataFrame(boxes, "k int, x1 double, y1 double, x2 double, y2 double")
    for cell in (1.0, 7.0, 100.0):
        got = sorted((r.a, r.b) for r in spatial.boxes_that_meet(frame, "k", cell).collect())
        want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2])
        assert got == want


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, 0.5, ["a"]), (2, None, None)], "k int, c double, r array<string>")
    new = spark.createDataFrame([(1, 0.4, []), (2, 0.1, ["b"]), (3, 0.2, ["c"])], "k int, c double, r array<string>")
    got = {r.k: (r.c, r.r) for r in upsert_with(old, new, ["k"], {"c": "greatest", "r": "concat"}).collect()}
    assert got == {1: (0.5, ["a"]), 2: (0.1, ["b"]), 3: (0.2, ["c"])}


def test_ledger_refuses_and_ignores_repeats(spark):
    moves = [(1, 10, 100), (1, 11, -150), (1, 12, -60), (1, 12, -60), (1, 13, -50), (1, 14, -40), (2, 20, -1)]
    frame = spark.createDataFrame(moves, "o int, k int, a int")
    got = [(r.key, r.accepted, r.balance) for r in settle(frame, "o", "a", "k", "k").orderBy("key").collect()]
    assert got == [(10, True, 100), (11, False, 100), (12, True, 40), (13, False, 40), (14, True, 0), (20, False, 0)]


def test_kmeans_invariants(spark):
    rows = [(g, [float(i % 3 * 10 + g), float(i)]) for g in range(3) for i in range(12)] + [(9, [1.0, 2.0]), (9, [3.0, 4.0])]
    out = kmeans_per_group(spark.createDataFrame(rows, "g int, v array<double>"), "g", "v", k=3).collect()
    sizes = {g: sum(r.size for r in out if r.g == g) for g in (0, 1, 2, 9)}
    assert sizes == {0: 12, 1: 12, 2: 12, 9: 2}
    assert sorted(r.centroid for r in out if r.g == 9) == [pytest.approx([1.0, 2.0]), pytest.approx([3.0, 4.0])]


def test_kmeans_of_large_groups_is_the_same(spark):
    rng = np.random.default_rng(3)
    rows = [(g, (rng.normal(size=3) + 9 * rng.integers(0, 3, 3)).tolist(), float(i)) for g in range(4) for i in range((60, 7, 2, 90)[g])]
    frame = spark.createDataFrame(rows, "g int, v array<double>, w double")
    show = lambda out: sorted((r.g, r.size, *np.round([*r.centroid, r.w], 6).tolist()) for r in out.collect())
    one = show(kmeans_per_group(frame, "g", "v", ("w",), k=4))
    assert show(kmeans_per_group(frame, "g", "v", ("w",), k=4, most=50)) == one and len([r for r in one if r[0] == 3]) == 4


def test_kmeans_query_equals_plain_version(spark, data):
    """Sizes and centroids of every taxon, from the definition in numpy."""
    from arborlens.operators.clustering import _lloyd
    from arborlens.plans.analogue import centroids

    own = centroids(spark, data).collect()
    x = np.array([r.v for r in own])
    x = (x - x.mean(0)) / x.std(0)
    got = {}
    for r in QUERIES["vec_cluster"](spark, data).collect():
        got.setdefault(r.taxon, []).append(r.size)
    for taxon in {r.taxon for r in own}:
        mine = x[[r.taxon == taxon for r in own]]
        near = _lloyd(mine, 5, 50) if len(mine) >= 5 else np.arange(len(mine))
        assert sorted(got[taxon]) == sorted(np.unique(near, return_counts=True)[1].tolist())


def test_index_of_lists_compares_few_pairs_of_clustered_vectors(spark):
    """All of the five nearest are found, and under 15 % of pairs are compared."""
    from arborlens.operators import ann

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 10
    x = centres[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 16))
    x[1990:] = x[0]  # equal vectors
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [])], "id long, v array<double>")
    index, sizes, middle = ann.build(rows)
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("q"), "v")
    found, lists = ann.nearest(index, sizes, middle, asked, 5)
    got = {}
    for r in found.collect():
        got.setdefault(r.q, []).append((r.dist, r.id))
    for q in range(0, 2000, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = sorted((d[i], i) for i in range(2000) if i != q)[:5]
        assert [round(a, 9) for a, _ in sorted(got[q])] == [round(a, 9) for a, _ in want]
    pairs = lists.join(sizes, "list").agg(F.sum("n")).first()[0]
    assert pairs < 0.15 * 40 * 2000


def test_index_of_lists_parts_long_lists(spark, monkeypatch):
    from arborlens.operators import ann

    monkeypatch.setattr(ann, "PART", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    index, sizes, middle = ann.build(rows, lists=3)
    assert sizes.agg(F.max("parts")).first()[0] > 3
    found, _ = ann.nearest(index, sizes, middle, rows.where("id < 20").select(F.col("id").alias("q"), "v"), 3, probes=1)
    got = {(r.q, r.id) for r in found.collect()}
    want = {(q, int(i)) for q in range(20) for i in np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[1:4]}
    assert got == want


def test_names_equal_plain_versions(spark, data):
    """Names in documents and addresses, from the stated rules without Spark."""
    import re
    from urllib.parse import unquote

    from arborlens.plans.analogue import table

    docs = {r.doc_id: r.text or "" for r in table(spark, data, "documents").collect()}
    got = {}
    for r in QUERIES["fn_parse_common_names"](spark, data).collect():
        got.setdefault(r.doc_id, []).append(r.name)
    for i, names in got.items():
        flat = docs[i].translate(str.maketrans("\n.", ";;"))
        parts = {re.sub(r"\s*\([^)]*\)", "", p).strip() for p in re.split("[;,]", flat)} | {p.strip() for p in re.split("[;,]", flat)}
        assert set(names) <= parts and all(len(n) >= 2 and n != "NA" for n in names)
    tops = {r.doc_id: r.names for r in QUERIES["fn_top_common_names"](spark, data).collect()}
    assert set(tops) == set(docs)
    urls = {r.page_id: r.url for r in table(spark, data, "pages").collect()}
    for r in QUERIES["fn_name_from_url"](spark, data).collect():
        last = unquote((urls[r.page_id] or "").split("?")[0].rstrip("/").rsplit("/", 1)[-1])
        assert r.name is None or re.sub(r"[^a-z]", "", r.name.lower()) in re.sub(r"[^a-z]", "", last.lower())


def test_entries_of_maps_are_counted_without_distinct(spark, data):
    """A map has a key once, so no task holds all pairs of tile and taxon a second time."""
    plan = QUERIES["agg_map_explode_sum"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan.lower()


def test_names_of_long_lists(spark):
    """Equal names without case, in one language, at any distance; and no step that compares a name with all before it."""
    from pyspark.sql import functions as F

    from arborlens.functions import text as T

    names = [f"n{i % 1500}" if i % 2 else f"N{i % 1500} (French)" for i in range(6000)] + ["Oak [Trade]", "oak [trade]", "дуб", "Дуб (Russian)", "x", "NA", "Ash ()", "a(b) (german)"]
    want, seen = [], set()
    for n in names:
        code = "fr" if n.endswith("(French)") else "ru" if "уб" in n else "de" if n.endswith("(german)") else None
        name = n.rsplit(" (", 1)[0] if n.endswith(("(French)", "(Russian)", "(german)")) else n
        if len(name) >= 2 and name != "NA" and (name.lower(), code) not in seen:
            seen.add((name.lower(), code))
            want.append((name, code, len(want)))
    rows = spark.createDataFrame([("; ".join(names),), (None,), ("",), ("a, b",)], "t string").select(T.parse_common_names(F.col("t")).alias("n"), T.top_common_names(F.col("t")).alias("top"))
    got = rows.collect()
    assert [tuple(x) for x in got[0].n] == want
    assert [r.n for r in got[1:]] == [None, [], []] and [r.top for r in got[1:]] == ["", "", "a, b"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan and plan.count("split(t") <= 2  # names are cut once for each column


def test_ledger_query_equals_plain_version(spark, data):
    from arborlens.plans.analogue import table

    moves = sorted((r.o_custkey, r.o_orderdate, r.o_orderkey) for r in table(spark, data, "orders").select("o_custkey", "o_orderdate", "o_orderkey").collect())
    want, balance = {}, {}
    for owner, _, key in moves:
        amount = 100 if key % 3 == 0 else -70
        ok = balance.get(owner, 0) + amount >= 0
        balance[owner] = balance.get(owner, 0) + (amount if ok else 0)
        want[key] = (owner, amount, ok, balance[owner])
    assert {r.key: (r.owner, r.amount, r.accepted, r.balance) for r in QUERIES["str_tx_ledger"](spark, data).collect()} == want


def test_simplify_query_bounds(spark, data):
    """Corners and envelope of every region's track, and no more corners after thinning than before."""
    from arborlens.plans.analogue import tiles

    own = {}
    for r in tiles(spark, data).collect():
        own.setdefault(r.eco, []).append((r.lon, r.lat))
    for r in QUERIES["geo_simplify"](spark, data).collect():
        xs, ys = zip(*own[r.eco], strict=True)
        assert r.corners == len(xs) and 2 <= r.kept <= r.corners and (r.x1, r.x2, r.y1, r.y2) == (min(xs), max(xs), min(ys), max(ys))


def test_thinning_by_pieces_stays_within_tolerance(spark):
    """Long lines in small pieces: every point lies within the tolerance of the kept line, ends stay, straight runs go."""
    from arborlens.operators import lines

    rng = np.random.default_rng(6)
    walk = np.cumsum(rng.normal(size=(900, 2)), axis=0)
    own = {1: walk.tolist(), 2: [[float(i), 0.0] for i in range(500)], 3: [[0.0, 0.0]], 4: [[0.0, 0.0], [0.0, 0.0], [5.0, 5.0]]}
    rows = spark.createDataFrame([(k, i, x, y) for k, p in own.items() for i, (x, y) in enumerate(p)] + [(2, 1000, None, 1.0)], "k int, place long, x double, y double")
    kept = {}
    for r in lines.thinned(rows, "k", "place", "x", "y", 2.0, 64).collect():
        kept.setdefault(r.k, []).append((r.place, r.x, r.y))
    assert len(kept[1]) < 450 and [p[0] for p in sorted(kept[2])][:1] == [0] and len(kept[2]) <= 20 and len(kept[3]) == 1
    for k, p in own.items():
        line = sorted(kept[k])
        assert line[0][0] == 0 and line[-1][0] == len(p) - 1
        for (i, ax, ay), (j, bx, by) in zip(line, line[1:], strict=False):
            for x, y in p[i : j + 1]:
                n = math.hypot(bx - ax, by - ay)
                d = abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / n if n else math.hypot(x - ax, y - ay)
                assert d <= 2.0 + 1e-9


def test_cluster_without_shared_folder_is_refused():
    from arborlens import workspace

    class Fake:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_dir(Fake)


def test_versions_and_log(spark):
    c = spark.createDataFrame([(1, "a", 1, 0.1), (2, "a", 2, 0.9)], "id int, claim_type string, created int, confidence double")
    got = [(r.id, r.version, r.is_current, r.supersedes) for r in C.versions(c, ["claim_type"]).orderBy("id").collect()]
    assert got == [(1, 1, False, None), (2, 2, True, 1)]
    old = spark.createDataFrame([(1, 1, "x", None)], "k int, v int, a string, b string")
    new = spark.createDataFrame([(1, 2, "x", "y")], "k int, v int, a string, b string")
    assert [tuple(r) for r in C.change_log(old, new, "k", "v", ["a", "b"]).collect()] == [(1, 2, "b", None, "y")]


def test_best_per_group_plan_limits_early(spark):
    rows = spark.range(100).selectExpr("id", "id % 5 as g")
    plan = best_per_group(rows, ["g"], F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_ranked_and_workspace(spark):
    from arborlens import workspace
    from arborlens.operators.relational import ranked

    rows = spark.createDataFrame([(f"s{i:03d}",) for i in range(200)] + [(None,)], "s string").repartition(5)
    got = [(r.s, r["rank"]) for r in ranked(rows, F.col("s").asc_nulls_last()).orderBy("rank").collect()]
    assert got == [(f"s{i:03d}", i) for i in range(200)] + [(None, 200)]
    table = workspace.materialize(rows, "x")
    assert workspace.shared_dir(spark) in table.inputFiles()[0] and table.count() == 201
    workspace.clear(spark)
    assert not workspace.materialize(rows.limit(0), "x").count()


def test_kml_and_readers(spark):
    from arborlens.sources import readers

    kml = "<kml><Document><Placemark><name>a</name><Polygon><outerBoundaryIs><LinearRing><coordinates> 0,0,0 1,0,0 1,1,0 </coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>"
    got = readers.kml_polygons(spark.createDataFrame([(kml,)], "value string")).first()
    assert got["name"] == "a" and [tuple(p) for p in got.ring] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    rows = spark.createDataFrame([(1, 2019, "a"), (1, 2020, "b"), (2, 2018, "c")], "k int, year int, v string")
    assert {r.k: r.v for r in readers.best_year(rows, ["k"], 2019, "v").collect()} == {1: "a", 2: "c"}


def test_topological_overlap_and_nearest(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "a int, x1 double, y1 double, x2 double, y2 double")
    b = spark.createDataFrame([(7, 8.0, 8.0, 20.0, 20.0), (8, 0.0, 0.0, 5.0, 5.0), (9, 5.0, 5.0, 10.0, 10.0)], "b int, x1 double, y1 double, x2 double, y2 double")
    best = spatial.largest_overlap(a, b, "a", "b", 3.0).first()
    assert (best.b, best.area) == (8, 25.0)  # of equal parts the lower key


def test_research_rules(spark):
    rows = [(1, 1, "x", 0.9), (1, 2, "x", 0.5), (1, 3, "y", 0.9), (2, 4, "x", 0.4)]
    c = spark.createDataFrame(rows, "taxon int, id int, claim_type string, confidence double")
    got = {(r.taxon, r.field): r.state for r in C.research_context(c, ["x", "y"]).collect()}
    assert got == {(1, "x"): "disputed", (1, "y"): "strong", (2, "x"): "weak", (2, "y"): "missing"}
    a = spark.createDataFrame([(1, '["p","q"]', "u"), (2, "plain", None), (3, "[]", None)], "k int, v string, h string")
    assert sorted((r.k, r.claim, r.confidence) for r in C.atomic_claims(a, "k", "v", "h").collect()) == [(1, "p", 0.8), (1, "q", 0.8), (2, "plain", 0.75)]


def test_nearest_equals_brute_force(spark):
    """Sparse, crowded and far places, ties, and places without coordinates; without a cartesian product."""
    rng = np.random.default_rng(5)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-100, 100, (200, 2)))] + [(900, 1000.0, -2000.0), (901, None, 0.0)]
    crowd = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(50, 0.01, (300, 2)))]
    places = crowd + [(1000, -90.0, -90.0), (1001, 3.0, 4.0), (1002, 3.0, 4.0), (1003, None, None)]
    p = spark.createDataFrame(points, "k int, lon double, lat double")
    q = spark.createDataFrame(places, "place int, x1 double, y1 double")
    near = spatial.nearest(p, q, ["k"], "place")
    got = {r.k: (r.place, round(r.dist, 9)) for r in near.collect()}
    for k, x, y in points:
        if x is None:
            assert k not in got
            continue
        d, place = min((math.sqrt((x - a) ** 2 + (y - b) ** 2), i) for i, a, b in places if a is not None)
        assert got[k] == (place, round(d, 9))
    assert spatial.nearest(p, q.where("place < 0"), ["k"], "place").count() == 0
    assert "Cartesian" not in near._jdf.queryExecution().toString() and "NestedLoop" not in near._jdf.queryExecution().toString()
