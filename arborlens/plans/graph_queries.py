"""The sample graph queries, against the exported vocabulary (urn:aboutSpecies). The federated one needs a remote
endpoint and is left out."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlens.operators.graph import literal, pattern
from arborlens.operators.relational import top
from arborlens.plans.analogue import claims, species
from arborlens.plans.registry import query
from arborlens.sources.writers import quads

N = lambda: F.count(F.lit(1))


def _facts(spark, d):
    """(insight, taxon, type, confidence) by three patterns on the claims' provenance."""
    q = quads(claims(spark, d))
    rows = pattern(q, "urn:aboutSpecies", "i", "t").join(pattern(q, "urn:claimType", "i", "k"), "i").join(pattern(q, "urn:confidence", "i", "c"), "i")
    return rows.select("i", literal(F.col("t")).alias("taxon"), literal(F.col("k")).alias("type"), literal(F.col("c")).cast("double").alias("confidence"))


def _names(spark, d):
    return species(spark, d).select(F.concat(F.lit("urn:taxon:"), F.col("taxon").cast("string")).alias("taxon"), "name", "genus")


_F = "'urn:insight:' || id AS i, 'urn:taxon:' || taxon AS taxon, claim_type AS type, confidence"


@query("SELECT 'urn:taxon:' || taxon AS taxon, name FROM species ORDER BY species.taxon LIMIT 100")
def sparql_q1(spark, d):
    s = species(spark, d).orderBy("taxon").limit(100)
    return s.select(F.concat(F.lit("urn:taxon:"), F.col("taxon").cast("string")).alias("taxon"), "name")


@query("SELECT 'urn:insight:' || c.id AS i, c.claim_type AS type, c.confidence, CASE WHEN n_sources > 0 THEN 'urn:source:' || n_sources END AS source FROM claims c WHERE taxon = 7")
def sparql_q2(spark, d):
    """A required part and an optional one."""
    facts = _facts(spark, d).where("taxon = 'urn:taxon:7'")
    source = claims(spark, d).where("n_sources > 0").select(F.concat(F.lit("urn:insight:"), F.col("id").cast("string")).alias("i"), F.concat(F.lit("urn:source:"), F.col("n_sources").cast("string")).alias("source"))
    return facts.join(source, "i", "left").select("i", "type", "confidence", "source")


@query(f"SELECT i, taxon, confidence FROM (SELECT {_F} FROM claims WHERE claim_type = 'view' AND confidence > 0.8) ORDER BY confidence DESC, i LIMIT 50")
def sparql_q3(spark, d):
    return top(_facts(spark, d).where("type = 'view' and confidence > 0.8"), 50, F.col("confidence").desc(), F.col("i")).select("i", "taxon", "confidence")


@query("SELECT 'urn:taxon:' || s.taxon AS taxon, name, c.id AS claim FROM claims c JOIN species s ON c.taxon = s.taxon WHERE contains(lower(name), 'ring') OR contains(lower(name), 'gear')")
def sparql_q4(spark, d):
    n = _names(spark, d).where(F.contains(F.lower("name"), F.lit("ring")) | F.contains(F.lower("name"), F.lit("gear")))
    return _facts(spark, d).join(n, "taxon").select("taxon", "name", F.substring_index("i", ":", -1).cast("long").alias("claim"))


@query("SELECT 'urn:insight:' || c.id AS i, name, confidence FROM claims c JOIN species s ON c.taxon = s.taxon WHERE claim_type = 'purchase' ORDER BY confidence DESC, i LIMIT 100")
def sparql_q5(spark, d):
    rows = _facts(spark, d).where("type = 'purchase'").join(_names(spark, d), "taxon")
    return top(rows, 100, F.col("confidence").desc(), F.col("i")).select("i", "name", "confidence")


@query("SELECT claim_type AS type, count(*) AS n FROM claims GROUP BY 1")
def sparql_q6(spark, d):
    q = quads(claims(spark, d))
    return pattern(q, "urn:claimType", "i", "k").groupBy(literal(F.col("k")).alias("type")).agg(N().alias("n"))


@query("SELECT 'urn:taxon:' || s.taxon AS taxon, name, claim_value AS value FROM claims c JOIN species s ON c.taxon = s.taxon WHERE claim_type = 'signup'")
def sparql_q7(spark, d):
    q = quads(claims(spark, d))
    rows = pattern(q, "urn:claim:signup", "taxon", "v").join(_names(spark, d), "taxon")
    return rows.select("taxon", "name", literal(F.col("v")).alias("value"))


@query("SELECT id % 3 AS agent, count(*) AS n FROM claims GROUP BY 1")
def sparql_q8(spark, d):
    q = quads(claims(spark, d))
    agent = (F.substring_index("subject", ":", -1).cast("long") % 3).alias("agent")
    return q.where("predicate = 'urn:claimType'").groupBy(agent).agg(N().alias("n"))


@query("SELECT claim_type AS type, count(DISTINCT c.taxon) AS taxa, string_agg(DISTINCT name, ', ' ORDER BY name) AS examples FROM claims c JOIN species s ON c.taxon = s.taxon GROUP BY 1 ORDER BY taxa DESC, type LIMIT 20")
def sparql_q9(spark, d):
    g = _facts(spark, d).join(_names(spark, d), "taxon").groupBy("type")
    g = g.agg(F.countDistinct("taxon").alias("taxa"), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("examples"))
    return top(g, 20, F.col("taxa").desc(), F.col("type"))


@query("SELECT genus AS form, count(DISTINCT c.taxon) AS taxa FROM claims c JOIN species s ON c.taxon = s.taxon GROUP BY 1")
def sparql_q10(spark, d):
    return _facts(spark, d).join(_names(spark, d), "taxon").groupBy(F.col("genus").alias("form")).agg(F.countDistinct("taxon").alias("taxa"))


@query("SELECT DISTINCT 'urn:taxon:' || taxon AS taxon FROM claims WHERE contains(lower(claim_value), '\"k\": 1') OR contains(lower(claim_value), '\"k\": 7')")
def sparql_q11(spark, d):
    q = quads(claims(spark, d))
    v = F.lower(literal(F.col("v")))
    rows = pattern(q, F.col("predicate").startswith("urn:claim:"), "taxon", "v")
    return rows.where(F.contains(v, F.lit('"k": 1')) | F.contains(v, F.lit('"k": 7'))).select("taxon").distinct()


@query("SELECT 'urn:taxon:' || c.taxon AS taxon, name, created FROM claims c JOIN species s ON c.taxon = s.taxon ORDER BY created DESC, id LIMIT 50")
def sparql_q12(spark, d):
    c = top(claims(spark, d), 50, F.col("created").desc(), F.col("id")).select(F.concat(F.lit("urn:taxon:"), F.col("taxon").cast("string")).alias("taxon"), "created")
    return c.join(_names(spark, d), "taxon").select("taxon", "name", "created")


@query("SELECT claim_type AS type, round(avg(confidence), 6) AS mean, min(confidence) AS low, max(confidence) AS high, count(*) AS n FROM claims GROUP BY 1")
def sparql_q14(spark, d):
    c = F.col("confidence")
    return _facts(spark, d).groupBy("type").agg(F.round(F.avg(c), 6).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high"), N().alias("n"))


@query("SELECT 'urn:taxon:' || taxon AS subject, 'urn:claim:' || claim_type AS predicate, count(*) AS n FROM claims WHERE taxon = 7 GROUP BY ALL UNION ALL SELECT 'urn:insight:' || id, 'urn:aboutSpecies', 1 FROM claims WHERE taxon = 7")
def sparql_q15(spark, d):
    q = quads(claims(spark, d))
    own = q.where("subject = 'urn:taxon:7'").groupBy("subject", "predicate").agg(N().alias("n"))
    return own.union(q.where("predicate = 'urn:aboutSpecies' and object = '<urn:taxon:7>'").groupBy("subject", "predicate").agg(N().alias("n")))


@query("SELECT 'urn:taxon:' || taxon AS taxon, count(*) AS n FROM claims WHERE confidence >= 0.5 GROUP BY 1")
def src_sparql(spark, d):
    """A pattern with a filter over the exported graph, in place of a remote endpoint."""
    return _facts(spark, d).where("confidence >= 0.5").groupBy("taxon").agg(N().alias("n"))


@query("SELECT 'urn:taxon:' || taxon AS subject FROM species WHERE size = 3 UNION SELECT 'urn:insight:' || id FROM claims WHERE confidence > 0.9")
def set_sparql_union(spark, d):
    a = species(spark, d).where("size = 3").select(F.concat(F.lit("urn:taxon:"), F.col("taxon").cast("string")).alias("subject"))
    return a.union(_facts(spark, d).where("confidence > 0.9").select("i")).distinct()
