"""Sources and sinks: each query writes rows of the given tables in the format and reads them back with the reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlens.functions import geo
from arborlens.operators.relational import pick_per_group
from arborlens.plans.analogue import centroids, claims, occ, species, table, tile_maps, tiles
from arborlens.plans.registry import query
from arborlens.sources import archives, readers, shapes, writers
from arborlens.workspace import new_path


def _totals(maps):
    total = F.aggregate(F.map_values("species_data"), F.lit(0).cast("long"), lambda s, x: s + x)
    return maps.withColumns({"total_occurrences": total, "species_count": F.size("species_data").cast("long"), "geohash": F.lpad(F.col("tile").cast("string"), 7, "0")})


@query("SELECT r_regionkey, r_name FROM region")
def src_pg_table(spark, d):
    return table(spark, d, "region").select("r_regionkey", "r_name")


@query("SELECT lpad(CAST(tile AS VARCHAR), 7, '0') AS geohash, CAST(sum(n) AS BIGINT) AS n, count(*) AS taxa, true AS total_ok, tile % 5 <> 0 AS count_ok FROM occ GROUP BY tile")
def src_csv_stream(spark, d):
    """Tiles through CSV; every fifth declares a wrong count, which shows."""
    path = new_path(spark, "tiles-csv")
    rows = _totals(tile_maps(spark, d)).withColumn("species_count", F.col("species_count") + F.when(F.col("tile") % 5 == 0, 1).otherwise(0))
    rows.select("geohash", F.to_json("species_data").alias("species_data"), "total_occurrences", "species_count").write.csv(path, header=True, quote='"', escape='"')
    read = readers.tile_csv(spark, path)
    n = F.aggregate(F.map_values("species_data"), F.lit(0).cast("long"), lambda s, x: s + x)
    return read.select("geohash", n.alias("n"), F.size("species_data").cast("long").alias("taxa"), "total_ok", "count_ok")


@query("SELECT doc_id, md5(text) AS h FROM documents")
def src_csv_handparser(spark, d):
    path = new_path(spark, "quoted-csv")
    table(spark, d, "documents").select("doc_id", "text").write.csv(path, header=True, quote='"', escape='"', quoteAll=True, lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.quoted_csv(spark, path, "doc_id long, text string").select("doc_id", F.md5("text").alias("h"))


@query("SELECT taxon, CASE WHEN intact IN ('NA', '') THEN NULL ELSE intact END AS intact FROM species")
def src_csv_copy(spark, d):
    path = new_path(spark, "na-csv")
    species(spark, d).select("taxon", F.nullif("intact", F.lit("")).alias("intact")).write.csv(path, header=True, nullValue="NA")
    return readers.na_csv(spark, path, "taxon long, intact string")


@query("SELECT tile, taxon, n FROM occ WHERE tile % 7 <> 0")
def src_parquet_batches(spark, d):
    """Tiles whose map is a JSON array; every seventh holds text that is none, which reads as an empty map."""
    path = new_path(spark, "tiles-parquet")
    items = F.to_json(F.collect_list(F.struct(F.col("taxon").cast("string").alias("taxon_id"), F.col("n").alias("count"))))
    rows = occ(spark, d).groupBy("tile").agg(items.alias("species_data"))
    rows.withColumn("species_data", F.when(F.col("tile") % 7 == 0, "no json").otherwise(F.col("species_data"))).write.parquet(path)
    read = readers.tile_parquet(spark, path).select("tile", F.explode("species_data").alias("taxon", "n"))
    return read.select("tile", F.col("taxon").cast("long").alias("taxon"), "n")


@query("SELECT lpad(CAST(tile AS VARCHAR), 7, '0') AS geohash, count(*) AS taxa FROM occ GROUP BY tile")
def src_json_tiles(spark, d):
    path = new_path(spark, "tiles-json")
    rows = _totals(tile_maps(spark, d)).select(F.to_json(F.struct("geohash", "species_data")).alias("value"))
    tiles_a_file = 1000
    groups = max(1, -(-table(spark, d, "orders").count() // tiles_a_file))
    rows = rows.groupBy(F.pmod(F.xxhash64("value"), F.lit(groups)).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    rows.write.partitionBy("file").text(path)  # one array a file
    return readers.tile_json(spark, path).select("geohash", F.size("species_data").cast("long").alias("taxa"))


@query("SELECT taxon AS taxon_id, name AS species, lat AS latitude, lon AS longitude, CAST(2017 + tile % 8 AS INTEGER) AS year, tile AS gbif_id FROM tiles JOIN species ON taxon = tile % 500 WHERE tile % 6 <> 0 AND taxon % 2 = 0")
def src_gbif_zip(spark, d):
    """Several archives, each with its occurrences and a member without a line."""
    path = new_path(spark, "occurrences-zip")
    s = species(spark, d).select("taxon", "name")
    rows = tiles(spark, d).withColumn("taxon", F.col("tile") % 500).join(s, "taxon")
    lat = F.when(F.col("tile") % 6 != 0, F.col("lat")).cast("string")
    line = F.concat_ws("\t", F.col("tile").cast("string"), F.lit("basis"), F.col("taxon").cast("string"), "name", F.coalesce(lat, F.lit("")), F.col("lon").cast("string"), (2017 + F.col("tile") % 8).cast("string"))
    archive = (F.col("tile") % 7).alias("archive")
    head = "gbifID\tbasisOfRecord\ttaxonKey\tscientificName\tdecimalLatitude\tdecimalLongitude\tyear"
    lines = rows.select(archive, F.lit("occurrence.txt").alias("member"), (F.col("tile") + 1).alias("place"), line.alias("line"))
    heads = rows.select(archive).distinct().select("archive", F.lit("occurrence.txt").alias("member"), F.lit(0).cast("long").alias("place"), F.lit(head).alias("line"))
    archives.write_zip(lines.unionByName(heads), path, {"rights.txt": ""})
    return readers.occurrence_zip(spark, path, s.where("taxon % 2 = 0").select(F.col("taxon").alias("key"), F.col("taxon").alias("taxon_id")))


@query("SELECT tile FROM tiles WHERE tile % 500 IN (1, 2, 3, 4) AND 2010 + tile % 17 BETWEEN 2017 AND 2024 AND tile % 13 <= 10 AND tile % 11 <> 0")
def src_gbif_predicate(spark, d):
    t = F.col("tile")
    rows = tiles(spark, d).select("tile", (t % 500).alias("taxonKey"), F.when(t % 11 != 0, F.col("lat")).alias("decimalLatitude"), F.col("lon").alias("decimalLongitude"), (2010 + t % 17).alias("year"), (t % 13).alias("uncertainty"))
    return readers.occurrence_predicate(rows, [1, 2, 3, 4]).select("tile")


@query("SELECT CAST(taxon AS VARCHAR) AS id, name, CASE WHEN taxon % 3 = 0 THEN genus END AS country, CASE WHEN taxon % 2 = 0 THEN 'Invasive' END AS invasive FROM species WHERE taxon % 5 <> 0")
def src_dwca(spark, d):
    """An archive of a taxon core and two extensions, one with quotes, read by its own description."""
    path = new_path(spark, "dwca")
    s, t = species(spark, d), F.col("taxon")
    lines = lambda rows, member, place, *columns, by="\t": rows.select(F.lit("checklist").alias("archive"), F.lit(member).alias("member"), place.cast("long").alias("place"), F.concat_ws(by, *columns).alias("line"))
    i = t.cast("string")
    core = lines(s, "taxon.txt", t, i, "name", F.when(t % 5 == 0, "SYNONYM").otherwise("ACCEPTED"))
    place = s.where("taxon % 3 = 0").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    where = lines(place, "distribution.txt", t * 2 + F.col("n"), quoted(i), quoted(F.lit("a, b")), quoted(F.when(F.col("n") == 2, F.col("genus")).otherwise("old")), by=",")
    traits = lines(s.where("taxon % 2 = 0"), "speciesprofile.txt", t, i, F.lit("Invasive"))
    archives.write_zip(core.unionByName(where).unionByName(traits), path, {"meta.xml": _META})
    return readers.darwin_core(spark, path).withColumnRenamed("scientificName", "name")


#: The description of the archive that src_dwca writes.
_META = """<archive xmlns="http://rs.tdwg.org/dwc/text/">
  <core rowType="http://rs.tdwg.org/dwc/terms/Taxon" fieldsTerminatedBy="\\t" ignoreHeaderLines="0"><files><location>taxon.txt</location></files><id index="0"/>
    <field index="1" term="http://rs.tdwg.org/dwc/terms/scientificName"/><field index="2" term="http://rs.tdwg.org/dwc/terms/taxonomicStatus"/></core>
  <extension rowType="http://rs.gbif.org/terms/1.0/Distribution" fieldsTerminatedBy="," fieldsEnclosedBy='"' ignoreHeaderLines="0"><files><location>distribution.txt</location></files><coreid index="0"/>
    <field index="2" term="http://rs.tdwg.org/dwc/terms/countryCode"/></extension>
  <extension rowType="http://rs.gbif.org/terms/1.0/SpeciesProfile" fieldsTerminatedBy="\\t" ignoreHeaderLines="0"><files><location>speciesprofile.txt</location></files><coreid index="0"/>
    <field index="1" term="http://rs.gbif.org/terms/1.0/isInvasive"/></extension>
</archive>"""


@query("SELECT n_nationkey AS eco, n_name AS name, round(-180.0 + n_nationkey, 6) AS x1, CASE WHEN n_nationkey % 3 = 0 THEN 3 ELSE 2 END AS rings, CASE WHEN n_nationkey % 3 = 0 THEN 12 ELSE 8 END AS corners FROM nation")
def src_shapefile(spark, d):
    """Polygons of several rings with their table, out to shapefiles and back by byte ranges."""
    path = new_path(spark, "shapes")
    x, k = F.col("n_nationkey") - 180.0, F.col("n_nationkey")
    hole = F.transform(geo_box(x), lambda p: F.struct((x + (p["x"] - x) / 4 + 0.25).alias("x"), (p["y"] / 4 + 0.25).alias("y")))
    island = F.transform(geo_box(x + 40), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    rings = F.when(k % 3 == 0, F.array(geo_box(x), hole, island)).otherwise(F.array(geo_box(x), hole))
    shapes.write_shapefiles(table(spark, d, "nation").select(k.alias("ECO_ID"), F.col("n_name").alias("ECO_NAME"), rings.alias("rings")), path)
    rows = shapes.read_shapefiles(spark, path, ["ECO_ID", "ECO_NAME"], range_bytes=1000)
    box = F.round(geo.ring_bounds(F.get("rings", F.lit(0)))["x1"], 6)
    return rows.select(F.col("ECO_ID").cast("long").alias("eco"), F.col("ECO_NAME").alias("name"), box.alias("x1"), F.size("rings").alias("rings"), F.size(F.flatten("rings")).alias("corners"))


def geo_box(x):
    p = lambda a, b: F.struct(a.alias("x"), F.lit(float(b)).alias("y"))
    return F.array(p(x, 0), p(x + 2, 0), p(x + 2, 1), p(x, 1))


@query("SELECT n_name AS name, CAST(2.0 AS DOUBLE) AS area FROM nation")
def src_kml(spark, d):
    path = new_path(spark, "kml")
    marks = writers.ring_kml(F.col("n_name"), geo_box(F.col("n_nationkey").cast("double")))
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(marks), "").alias("marks"))
    rows.select(F.concat(F.lit("<kml><Document>"), "marks", F.lit("</Document></kml>")).alias("value")).write.text(path)
    read = readers.kml_polygons(spark.read.text(path))
    return read.select("name", F.round(geo.planar_area(F.slice("ring", 1, 4)), 6).alias("area"))


@query("SELECT taxon, coalesce(max(CASE WHEN year = 2020 THEN year END), max(year)) AS year FROM centroids GROUP BY taxon")
def src_ee_sample(spark, d):
    """An embedding table in place of a remote service: the wanted year, else the latest."""
    return readers.best_year(centroids(spark, d), ["taxon"], 2020, "v").select("taxon", "year")


@query("SELECT tile, c.cluster FROM tiles t JOIN centroids c ON t.tile % 500 = c.cluster AND 2017 + t.tile % 8 = c.year")
def src_ee_batch(spark, d):
    c = centroids(spark, d).select("cluster", "year")
    t = tiles(spark, d).select("tile", (F.col("tile") % 500).alias("cluster"), (2017 + F.col("tile") % 8).alias("year"))
    return t.join(c, ["cluster", "year"]).select("tile", "cluster")


@query("SELECT claim_type, count(*) AS n FROM claims GROUP BY claim_type")
def src_jsonl_results(spark, d):
    path = new_path(spark, "results")
    rows = claims(spark, d).select("id", "claim_type")
    rows.write.json(f"{path}/results")
    return readers.result_json(spark, f"{path}/results", "id long, claim_type string").groupBy("claim_type").agg(F.count(F.lit(1)).alias("n"))


# sinks


@query("SELECT taxon, name, native FROM species WHERE size < 10")
def snk_csv_copy(spark, d):
    path = new_path(spark, "csv")
    writers.sorted_csv(species(spark, d).where("size < 10").select("taxon", "name", "native"), path, F.col("taxon"))
    return spark.read.schema("taxon long, name string, native string").csv(path, header=True, quote='"', escape='"')


@query("SELECT taxon AS taxon_id, name AS scientific_name, family, genus, subspecies, native AS native_to, introduced AS introduced_to, size AS height FROM species")
def snk_csv_export_species(spark, d):
    path = new_path(spark, "species-csv")
    names = {"taxon": "taxon_id", "name": "scientific_name", "native": "native_to", "introduced": "introduced_to", "size": "height"}
    rows = species(spark, d).withColumnsRenamed(names).select("taxon_id", "scientific_name", "family", "genus", "subspecies", "native_to", "introduced_to", "height")
    writers.sorted_csv(rows, path, F.col("scientific_name"), F.col("taxon_id"))
    return spark.read.schema(rows.schema).csv(path, header=True, quote='"', escape='"')


@query("SELECT lower(name) AS name, string_agg(DISTINCT genus, '; ' ORDER BY genus) AS genera FROM species GROUP BY 1")
def snk_csv_griis(spark, d):
    path = new_path(spark, "griis-csv")
    rows = species(spark, d).groupBy(F.lower("name").alias("name")).agg(F.array_join(F.array_sort(F.collect_set("genus")), "; ").alias("genera"))
    writers.sorted_csv(rows, path, F.col("name"))
    return spark.read.schema(rows.schema).csv(path, header=True)


@query("SELECT tile, taxon, n FROM occ")
def snk_parquet(spark, d):
    path = new_path(spark, "occurrences")
    occ(spark, d).write.parquet(path)
    return spark.read.parquet(path)


@query("SELECT tile, lon, lat, eco FROM tiles")
def snk_geojson_feature(spark, d):
    """Features as lines of JSON, read back by their schema."""
    path = new_path(spark, "geojson")
    rows = tiles(spark, d).select(writers.feature(writers.point_geometry(F.col("lon"), F.col("lat")), F.struct("tile", "eco")).alias("value"))
    rows.write.text(path)
    read = spark.read.schema("type string, geometry struct<type:string,coordinates:array<double>>, properties struct<tile:long,eco:int>").json(path)
    return read.select("properties.tile", F.col("geometry.coordinates")[0].alias("lon"), F.col("geometry.coordinates")[1].alias("lat"), "properties.eco")


@query("SELECT n_nationkey, 'POLYGON((' || n_nationkey || '.0 0.0,' || (n_nationkey + 2) || '.0 0.0,' || (n_nationkey + 2) || '.0 1.0,' || n_nationkey || '.0 1.0,' || n_nationkey || '.0 0.0))' AS wkt FROM nation")
def snk_kml_wkt(spark, d):
    return table(spark, d, "nation").select("n_nationkey", writers.ring_wkt(geo_box(F.col("n_nationkey").cast("double"))).alias("wkt"))


@query("SELECT tile AS id, strftime(seen, '%Y-%m-%dT%H:%M:%SZ') AS datetime FROM tiles")
def snk_stac_view(spark, d):
    items = tiles(spark, d).select(writers.stac_item(F.col("tile"), F.col("lon"), F.col("lat"), F.col("seen")).alias("item"))
    return items.select(F.get_json_object("item", "$.id").cast("long").alias("id"), F.get_json_object("item", "$.properties.datetime").alias("datetime"))


_LINE = "'<urn:taxon:' || taxon || '> <urn:claim:' || claim_type || '> \"' || replace(claim_value, '\"', '\\\"') || '\" .'"


@query(f"SELECT {_LINE} || ' <urn:insight:' || id || '> <urn:aboutSpecies> <urn:taxon:' || taxon || '> ; <urn:confidence> \"' || confidence || '\" .' AS value FROM claims WHERE current")
def snk_turtle(spark, d):
    path = new_path(spark, "turtle")
    claims(spark, d).where("current").select(writers.turtle_block().alias("value")).write.text(path)
    return spark.read.text(path)


@query(f"SELECT {_LINE} AS value FROM claims WHERE current")
def snk_turtle_lean(spark, d):
    path = new_path(spark, "turtle")
    claims(spark, d).where("current").select(writers.turtle_block(provenance=False).alias("value")).write.text(path)
    return spark.read.text(path)


@query("SELECT id, count(*) * 4 AS lines FROM claims GROUP BY id")
def snk_nquads(spark, d):
    path = new_path(spark, "nquads")
    q = writers.quads(claims(spark, d))
    q.select(writers.nquad_line(q).alias("value")).write.text(path)
    return spark.read.text(path).groupBy(F.regexp_extract("value", r"<urn:graph:(\d+)/", 1).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT id, claim_type, confidence FROM claims")
def snk_jsonl(spark, d):
    path = new_path(spark, "jsonl")
    claims(spark, d).select("id", "claim_type", "confidence").write.json(path)
    return spark.read.schema("id long, claim_type string, confidence double").json(path)


@query("SELECT 'urn:insight:' || id AS node, 'urn:taxon:' || taxon AS about FROM claims")
def snk_jsonld(spark, d):
    node = F.to_json(F.map_from_arrays(F.array(F.lit("@id"), F.lit("about")), F.array(F.concat(F.lit("urn:insight:"), F.col("id").cast("string")), F.concat(F.lit("urn:taxon:"), F.col("taxon").cast("string")))))
    lines = claims(spark, d).select(node.alias("value"))
    return lines.select(F.get_json_object("value", "$['@id']").alias("node"), F.get_json_object("value", "$.about").alias("about"))


@query("SELECT '<owl:Class rdf:about=\"#' || genus || '\"/>' AS value FROM (SELECT DISTINCT genus FROM species) UNION ALL SELECT '<owl:Class rdf:about=\"#' || family || '\"><rdfs:subClassOf rdf:resource=\"#' || genus || '\"/></owl:Class>' FROM (SELECT DISTINCT genus, family FROM species)")
def snk_owl(spark, d):
    path = new_path(spark, "owl")
    writers.owl_lines(species(spark, d), "family", "genus").write.text(path)
    return spark.read.text(path)


@query("SELECT name, min(taxon) AS taxon FROM species GROUP BY name")
def src_google_sheet(spark, d):
    """A worksheet lands as CSV; the first row of a name counts."""
    path = new_path(spark, "sheet")
    species(spark, d).select("name", "taxon").write.csv(path, header=True)
    return pick_per_group(spark.read.schema("name string, taxon long").csv(path, header=True), ["name"], F.col("taxon"), "taxon")
