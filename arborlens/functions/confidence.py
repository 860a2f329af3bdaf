"""The four confidence formulas, which differ on purpose and stay apart. Sources are array<struct<url,type,credibility>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborlens.functions.text import domain

#: Credibility of source types and of known domains, looked up by substring in this order.
TYPE_CREDIBILITY = {"peer-reviewed": 0.90, "database": 0.85, "government": 0.82, "encyclopedia": 0.70, "website": 0.55, "unknown": 0.50}
DOMAIN_CREDIBILITY = {
    "iucnredlist.org": 0.98, "gbif.org": 0.95, "powo.science.kew.org": 0.96, "plantsoftheworldonline.org": 0.96, "worldfloraonline.org": 0.94,
    "tropicos.org": 0.92, "eol.org": 0.80, "wikipedia.org": 0.72, "ncbi.nlm.nih.gov": 0.90, "jstor.org": 0.90, "springer.com": 0.88,
    "nature.com": 0.92, "science.org": 0.92, "mdpi.com": 0.82, "researchgate.net": 0.75, "fao.org": 0.88, "usda.gov": 0.90, "forestry.gov.uk": 0.88,
    "arbolapp.es": 0.85,
}
#: Claim types whose text should be a number, and those that are prose.
NUMERIC_TYPES = ("maximum_height", "maximum_diameter", "maximum_tree_age", "lifespan", "elevation_ranges", "temperature_tolerance", "rainfall_requirements")
PROSE_TYPES = ("general_description", "cultural_significance", "ecological_function", "stewardship_best_practices", "agroforestry_use_cases")
_NUMBER = r"(?i)\d+\.?\d*\s*(m|cm|mm|kg|g|years|°C|°F|mm/year)"
_RANGE = r"\d+\s*[-–]\s*\d+"


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def credibility(source: Column) -> Column:
    """A source's own value, else that of its domain, else that of its type."""
    host = domain(source["url"])
    known = F.lit(None).cast("double")
    for name, value in reversed(DOMAIN_CREDIBILITY.items()):
        known = F.when(F.contains(host, F.lit(name)), value).otherwise(known)
    kind = F.lit(TYPE_CREDIBILITY["unknown"])
    for name, value in TYPE_CREDIBILITY.items():
        kind = F.when(F.lower(F.coalesce(source["type"], F.lit("unknown"))) == name, value).otherwise(kind)
    return F.coalesce(F.nullif(source["credibility"], F.lit(0.0)), known, kind)


def _agreement(n: Column, none: float) -> Column:
    return F.when(n >= 3, 0.95).when(n == 2, 0.85).when(n == 1, 0.70).otherwise(none)


def specificity(claim_type: Column, text: Column) -> Column:
    number, span, size = text.rlike(_NUMBER), text.rlike(_RANGE), F.char_length(text)
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    measured = F.when(number, 0.95).when(span, 0.85).otherwise(0.60)
    prose = F.when(words > 100, 0.90).when(words > 50, 0.85).otherwise(0.75)
    other = F.when((size > 200) & number, 0.88).when(size > 100, 0.82).when(size > 50, 0.75).otherwise(0.65)
    return F.when(claim_type.isin(*NUMERIC_TYPES), measured).when(claim_type.isin(*PROSE_TYPES), prose).otherwise(other)


def conf_evidence(claim_type: Column, text: Column, sources: Column, matches: Column | None = None) -> Column:
    """Half source score, a quarter agreement, a quarter specificity, to two decimals; matching claims add up to .05."""
    n = F.size(sources)
    distinct = lambda f: F.size(F.array_distinct(F.transform(sources, f)))
    domains, types = distinct(lambda s: domain(s["url"])), distinct(lambda s: F.coalesce(s["type"], F.lit("unknown")))
    bonus = F.least(F.lit(0.10), (domains - 1) * 0.03 + (types - 1) * 0.02)
    score = F.least(F.lit(0.98), _mean(F.transform(sources, credibility)) * (1 + F.least(F.lit(0.18), (n - 1) * 0.06)) + bonus)
    base = 0.5 * F.when(n == 0, 0.3).otherwise(score) + 0.25 * _agreement(n, 0.5) + 0.25 * specificity(claim_type, text)
    if matches is not None:
        base = F.when(matches > 0, F.least(F.lit(0.98), base + F.least(F.lit(0.05), matches * 0.02))).otherwise(base)
    return F.bround(base, 2)


def conf_database(sources: Column) -> Column:
    """As above with diversity by types alone and a fixed specificity of .80; halves round up on decimals."""
    n = F.size(sources)
    types = F.size(F.array_distinct(F.transform(sources, lambda s: s["type"])))
    mean = _mean(F.transform(sources, lambda s: F.coalesce(s["credibility"], F.lit(0.5))))
    score = F.least(F.lit(0.98), mean * (1 + F.least(F.lit(0.18), (n - 1) * 0.06)) + F.least(F.lit(0.10), (types - 1) * 0.02))
    value = 0.5 * F.when(n == 0, 0.30).otherwise(score) + 0.25 * _agreement(n, 0.70) + 0.25 * 0.80
    return F.round(value.cast("decimal(12,8)"), 2).cast("double")


def conf_sources_simple(explicit: Column, sources: Column) -> Column:
    """A given value; else the mean credibility (.7 where absent) and .03 a source, at most .1, capped at .98; else .7."""
    n = F.size(sources)
    mean = _mean(F.transform(sources, lambda s: F.coalesce(s["credibility"], F.lit(0.7))))
    return F.coalesce(F.nullif(explicit, F.lit(0.0)), F.when(n > 0, F.least(mean + F.least(0.03 * n, F.lit(0.1)), F.lit(0.98))), F.lit(0.7))


def conf_research_run(coverage: Column, critical: Column, mean_length: Column, flags: Column) -> Column:
    """.4 coverage, .3 critical fields, .2 by mean length between 50 and 200, .1 by citations."""
    size = F.least(F.greatest((mean_length - 50) / 150, F.lit(0.0)), F.lit(1.0))
    cites = F.when(flags == 0, 0.5).when(flags <= 3, 0.7).otherwise(1.0)
    return F.round(0.4 * coverage + 0.3 * critical + 0.2 * size + 0.1 * cites, 2)
