"""Versioned, source-backed claims: aggregates, supersession, change logs and gap rules."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aggregate_text(claims: DataFrame, keys: Sequence[str], text: str, separator: str = "\n\n", bullet: str = "") -> DataFrame:
    """Texts of a group joined in the order of confidence, unknown ones last, then id."""
    items = F.array_sort(F.collect_list(F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("c"), "id", F.col(text).alias("t"))))
    lines = F.transform(F.filter(items, lambda x: x["t"].isNotNull()), lambda x: F.concat(F.lit(bullet), x["t"]))
    return claims.groupBy(*keys).agg(F.array_join(lines, separator).alias("text"))


def aggregate_ranked(claims: DataFrame, keys: Sequence[str], text: str, rank: str, separator: str = "; ") -> DataFrame:
    """Texts joined by rank, unknown ones last, then confidence, then id."""
    items = F.array_sort(F.collect_list(F.struct(F.coalesce(rank, F.lit(2147483647)).alias("r"), (-F.col("confidence")).alias("c"), "id", F.col(text).alias("t"))))
    return claims.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["t"]), separator).alias("text"))


def top_claim(claims: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """The most confident claim of a group, the lower id among equals."""
    best = F.min_by(F.struct(*columns), F.struct(-F.coalesce("confidence", F.lit(-1.0)), F.col("id")))
    return claims.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


#: How the claims of each type become a field. text: all, as a list with bullets, the most confident first;
#: ranked: names by rank; top: of the most confident claim the first key that it has, with its unit.
SYNC_RULES = (
    ("popular_common_name", "ranked", ("name",), ""),
    ("etymology", "top", ("text",), ""),
    ("synonyms", "ranked", ("name",), ""),
    ("identification_features", "text", (), ""),
    ("general_description", "text", (), ""),
    ("habitat", "text", (), ""),
    ("elevation_ranges", "top", ("text",), ""),
    ("ecological_function", "text", (), ""),
    ("native_adapted_habitats", "text", (), ""),
    ("conservation_status", "top", ("iucn_status", "text"), ""),
    ("compatible_soil_types", "text", (), ""),
    ("climate_tolerance", "text", (), ""),
    ("tolerances", "text", (), ""),
    ("associated_species", "text", (), ""),
    ("growth_form", "top", ("primary", "text"), ""),
    ("leaf_type", "top", ("type", "text"), ""),
    ("deciduous_evergreen", "top", ("type", "text"), ""),
    ("flower_color", "top", ("primary", "text"), ""),
    ("fruit_type", "top", ("type", "text"), ""),
    ("bark_characteristics", "text", (), ""),
    ("maximum_height", "top", ("value", "text"), "m"),
    ("maximum_diameter", "top", ("value", "text"), "m"),
    ("lifespan", "top", ("category", "text"), ""),
    ("maximum_tree_age", "top", ("value", "text"), " years"),
    ("stewardship_best_practices", "text", (), ""),
    ("planting_recipes", "text", (), ""),
    ("pruning_maintenance", "text", (), ""),
    ("disease_pest_management", "text", (), ""),
    ("fire_management", "text", (), ""),
    ("propagation_methods", "text", (), ""),
    ("cultural_significance", "text", (), ""),
    ("agroforestry_use_cases", "text", (), ""),
    ("timber_value", "text", (), ""),
    ("non_timber_products", "text", (), ""),
    ("nutritional_caloric_value", "text", (), ""),
)


def sync_to_species(claims: DataFrame, rules: Sequence[tuple] = SYNC_RULES) -> DataFrame:
    """taxon, synced (its claims), and a column <type>_ai for each rule, from current claims (taxon, claim_type, claim_value as
    JSON, confidence, id). Unknown confidences and ranks come last, ties follow id; claims of other types count only.

    One aggregate over taxon and type, in which a type's own rule decides what is kept, and one over taxa.
    """
    v = F.col("claim_value")
    key = lambda k: F.get_json_object(v, f"$.{k}")
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, how, keys, unit in rules:
        own = F.col("claim_type") == name
        kind = F.when(own, how).otherwise(kind)
        # a unit belongs to the first key only: the text has its own
        parts = [F.concat(key(k), F.lit(unit)) if n == 0 and unit else key(k) for n, k in enumerate(keys)]
        value = F.when(own, F.coalesce(*parts) if parts else F.coalesce(key("text"), v)).otherwise(value)
    rank = F.when(kind == "ranked", F.coalesce(key("rank").try_cast("int"), F.lit(2147483647))).otherwise(0)
    order = F.struct(rank.alias("r"), (-F.coalesce("confidence", F.lit(-1.0))).alias("c"), "id")
    rows = claims.select("taxon", "claim_type", kind.alias("kind"), F.struct(order.alias("o"), value.alias("t")).alias("x"))
    g = rows.groupBy("taxon", "claim_type", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("x.t", "x.o").alias("best"), F.array_sort(F.collect_list(F.when(F.col("kind").isin("text", "ranked") & F.col("x.t").isNotNull(), F.col("x")))).alias("all")
    )
    texts = F.transform("all", lambda x: x["t"])
    listed = F.when(F.size("all") > 0, F.when(F.col("kind") == "text", F.concat(F.lit("• "), F.array_join(texts, "\n\n• "))).otherwise(F.array_join(texts, "; ")))
    g = g.select("taxon", "claim_type", "n", F.when(F.col("kind") == "top", F.col("best")).otherwise(listed).alias("value"))
    fields = [F.max(F.when(F.col("claim_type") == name, F.col("value"))).alias(f"{name}_ai") for name, *_ in rules]
    return g.groupBy("taxon").agg(F.sum("n").alias("synced"), *fields)


def versions(claims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each claim with its version, whether it is the current one, and the id that it supersedes (new to old)."""
    w = Window.partitionBy(*keys).orderBy("created", "id")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    v = F.row_number().over(w)
    return claims.withColumns({"version": v, "is_current": v == n, "supersedes": F.lag("id").over(w)})


def change_log(old: DataFrame, new: DataFrame, key: str, version: str, fields: Sequence[str]) -> DataFrame:
    """A row for each field that differs, nulls included, where the version rose."""
    o = old.select(F.col(key), F.col(version).alias("_ov"), *[F.col(f).cast("string").alias(f"_o_{f}") for f in fields])
    both = o.join(new, key).where(F.col(version) > F.col("_ov"))
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_o_{f}").alias("old_value"), F.col(f).cast("string").alias("new_value")) for f in fields]))
    return both.select(key, F.col(version).alias("version"), rows.alias("c")).select(key, "version", "c.*").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def _exact(value: float) -> Column:
    return F.lit(Decimal(str(value)))


def below_mean(claims: DataFrame, keys: Sequence[str], bound: float) -> DataFrame:
    """The groups whose mean confidence is below the bound, compared without rounding; unknown confidences do not count."""
    c = F.col("confidence").try_cast("decimal(18,12)")
    g = claims.groupBy(*keys).agg(F.sum(c).alias("_s"), F.count(c).alias("_n"))
    return g.where(F.col("_s") < _exact(bound) * F.col("_n")).select(*keys)


def research_context(claims: DataFrame, fields: Sequence[str], good: float = 0.85, weak: float = 0.50, split: float = 0.3) -> DataFrame:
    """Each taxon's state by field: missing, disputed, strong, weak or fair, in that order. Means and spreads are those of
    decimals, so one that equals a bound is decided by the bound and not by the order in which doubles are added."""
    c = F.col("confidence").try_cast("decimal(18,12)")
    g = claims.groupBy("taxon").pivot("claim_type", list(fields)).agg(F.struct(F.sum(c).alias("sum"), F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high")))
    state = lambda f: (
        F.when(F.col(f)["sum"].isNull(), "missing").when(F.col(f)["high"] - F.col(f)["low"] > _exact(split), "disputed")
        .when(F.col(f)["sum"] >= _exact(good) * F.col(f)["n"], "strong").when(F.col(f)["sum"] < _exact(weak) * F.col(f)["n"], "weak").otherwise("fair")
    )
    rows = g.select("taxon", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), state(f).alias("state")) for f in fields])).alias("s"))
    return rows.select("taxon", "s.*")


def atomic_claims(rows: DataFrame, key: str, value: str, hint: str) -> DataFrame:
    """A claim for each item of a JSON array, .80 with a source hint and .70 without; a scalar is one claim at .75."""
    items = F.from_json(value, "array<string>")
    listed = F.when(F.col(value).startswith("["), items)
    confidence = F.when(listed.isNull(), 0.75).when(F.col(hint).isNotNull(), 0.80).otherwise(0.70)
    return rows.select(key, F.explode(F.coalesce(listed, F.array(F.col(value)))).alias("claim"), confidence.alias("confidence"))
