"""Text forms that the reference writes: a line a row, for write.text, and CSV, JSON and KML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.functions.text import claim_text, turtle_escape


def sorted_csv(df: DataFrame, path: str, *order: Column) -> None:
    """CSV with a header, in order; range-partitioned by the sort, so parts are in order and none holds all rows."""
    df.orderBy(*order).write.csv(path, header=True, quote='"', escape='"')


def feature(geometry: Column, properties: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def point_geometry(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def ring_wkt(ring: Column) -> Column:
    points = F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.concat(F.lit("POLYGON(("), F.array_join(points, ","), F.lit("))"))


def ring_kml(name: Column, ring: Column) -> Column:
    points = F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"), F.lit("0")))
    return F.concat(
        F.lit("<Placemark><name>"), name, F.lit("</name><Polygon><outerBoundaryIs><LinearRing><coordinates>"), F.array_join(points, " "),
        F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"),
    )


def stac_item(id_: Column, lon: Column, lat: Column, when: Column) -> Column:
    properties = F.struct(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"))
    return F.to_json(
        F.struct(F.lit("Feature").alias("type"), F.lit("1.0.0").alias("stac_version"), id_.cast("string").alias("id"), point_geometry(lon, lat).alias("geometry"), properties.alias("properties"))
    )


def quads(claims: DataFrame) -> DataFrame:
    """(subject, predicate, object, graph): an assertion for each claim, in a graph of its own, and what is known of it
    in a second one. Objects are N-Triples terms."""
    taxon, claim = F.concat(F.lit("urn:taxon:"), F.col("taxon").cast("string")), F.concat(F.lit("urn:insight:"), F.col("id").cast("string"))
    literal = lambda c: F.concat(F.lit('"'), turtle_escape(c), F.lit('"'))
    facts = F.array(
        F.struct(taxon.alias("s"), F.concat(F.lit("urn:claim:"), F.col("claim_type")).alias("p"), literal(claim_text(F.col("claim_value"))).alias("o"), F.lit("assertion").alias("g")),
        F.struct(claim.alias("s"), F.lit("urn:aboutSpecies").alias("p"), F.concat(F.lit("<"), taxon, F.lit(">")).alias("o"), F.lit("provenance").alias("g")),
        F.struct(claim.alias("s"), F.lit("urn:claimType").alias("p"), literal(F.col("claim_type")).alias("o"), F.lit("provenance").alias("g")),
        F.struct(claim.alias("s"), F.lit("urn:confidence").alias("p"), literal(F.col("confidence").cast("string")).alias("o"), F.lit("provenance").alias("g")),
    )
    rows = claims.select("id", F.explode(facts).alias("f"))
    graph = F.concat_ws("/", F.concat(F.lit("urn:graph:"), F.col("id").cast("string")), F.col("f.g"))
    return rows.select(F.col("f.s").alias("subject"), F.col("f.p").alias("predicate"), F.col("f.o").alias("object"), graph.alias("graph"))


def nquad_line(q: DataFrame) -> Column:
    return F.concat(F.lit("<"), q["subject"], F.lit("> <"), q["predicate"], F.lit("> "), q["object"], F.lit(" <"), q["graph"], F.lit("> ."))


def turtle_block(provenance: bool = True) -> Column:
    """A claim as Turtle on one line: the species' statement, and the claim as a node where wanted."""
    text = turtle_escape(claim_text(F.col("claim_value")))
    line = F.concat(F.lit("<urn:taxon:"), F.col("taxon").cast("string"), F.lit("> <urn:claim:"), F.col("claim_type"), F.lit('> "'), text, F.lit('" .'))
    if not provenance:
        return line
    node = F.concat(F.lit(" <urn:insight:"), F.col("id").cast("string"), F.lit("> <urn:aboutSpecies> <urn:taxon:"), F.col("taxon").cast("string"), F.lit('> ; <urn:confidence> "'), F.col("confidence").cast("string"), F.lit('" .'))
    return F.concat(line, node)


def owl_lines(rows: DataFrame, name: str, parent: str) -> DataFrame:
    """RDF/XML class elements of a two-column hierarchy, each class and link once."""
    pairs = rows.select(F.col(parent).alias("p"), F.col(name).alias("c")).where("c is not null").distinct()
    roots = pairs.where("p is not null").select("p").distinct().select(F.concat(F.lit('<owl:Class rdf:about="#'), "p", F.lit('"/>')).alias("value"))
    subs = pairs.select(F.concat(F.lit('<owl:Class rdf:about="#'), "c", F.lit('"><rdfs:subClassOf rdf:resource="#'), F.coalesce("p", F.lit("Thing")), F.lit('"/></owl:Class>')).alias("value"))
    return roots.unionByName(subs)
