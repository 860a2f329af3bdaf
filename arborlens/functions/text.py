"""Names, lists and other delimited text as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language named in brackets behind a common name, and its code. Regional ones name no code.
LANGUAGE_CODES = {
    "english": "en", "french": "fr", "spanish": "es", "portuguese": "pt", "german": "de", "italian": "it", "dutch": "nl", "russian": "ru",
    "japanese": "ja", "chinese": "zh", "arabic": "ar", "hindi": "hi", "swahili": "sw", "malay": "ms", "indonesian": "id", "thai": "th",
    "vietnamese": "vi", "korean": "ko", "turkish": "tr", "persian": "fa", "polish": "pl", "czech": "cs", "hungarian": "hu", "romanian": "ro",
    "greek": "el", "hebrew": "he", "swedish": "sv", "norwegian": "no", "danish": "da", "finnish": "fi", "yoruba": "yo", "igbo": "ig",
    "hausa": "ha", "zulu": "zu", "kikuyu": "ki", "amharic": "am",
}
#: Bracketed words that belong to the name.
KEPT_MARKERS = ("commercial", "trade", "general")
#: Names and words that raise a common name.
WELL_KNOWN = ("frangipani", "plumeria", "temple tree", "temple flower", "pagoda tree", "lei flower", "champa", "red jasmine")
COMMON_TERMS = ("flower", "tree", "jasmine", "rose")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def script_language(name: Column) -> Column:
    """Language that the script of a name stands for, null for Latin ones."""
    other = name.rlike("[\\u0400-\\u04FF\\u3000-\\u9FFF\\uF900-\\uFAFF\\u0600-\\u06FF\\u0900-\\u097F\\u0E00-\\u0E7F]")
    return F.when(other, (
        F.when(name.rlike("[\\u0400-\\u04FF]"), "ru").when(name.rlike("[\\u3000-\\u9FFF\\uF900-\\uFAFF]"), "ja").when(name.rlike("[\\u0600-\\u06FF]"), "ar")
        .when(name.rlike("[\\u0900-\\u097F]"), "hi").when(name.rlike("[\\u0E00-\\u0E7F]"), "th")
    ))


def _pieces(blob: Column) -> Column:
    """Names between semicolons and commas, without empty ones, NA and single letters."""
    good = lambda n: ~n.isin("", "NA", "na")
    blocks = F.filter(F.transform(F.split(blob, ";"), lambda s: F.trim(s)), good)
    names = F.flatten(F.transform(blocks, lambda s: F.transform(F.split(s, ","), lambda n: F.trim(n))))
    return F.filter(names, lambda n: good(n) & (F.char_length(n) >= 2))


def parse_common_names(blob: Column) -> Column:
    """Array of (name, language_code, position): a bracketed marker at the end gives the language and goes, unless it is
    one that belongs to the name; else the script does. The first of names equal without case, in one language, stays."""
    codes = F.create_map(*[F.lit(x) for k, v in LANGUAGE_CODES.items() for x in (k, v)])
    marked = r"^(.+?)\s*(?:\(([^)]+)\)|\[([^\]]+)\])\s*$"

    def marked_entry(n: Column, marker: Column) -> Column:
        keep = (marker == "") | F.lower(marker).isin(*KEPT_MARKERS)
        code = F.when(~keep, F.try_element_at(codes, F.lower(marker)))
        name = F.when(keep, n).otherwise(F.trim(F.regexp_extract(n, marked, 1)))
        return _let(name, lambda v: F.struct(v.alias("name"), F.coalesce(code, script_language(v)).alias("language_code")))

    def entry(n: Column) -> Column:
        marker = F.trim(F.concat(F.regexp_extract(n, marked, 2), F.regexp_extract(n, marked, 3)))
        plain = F.struct(n.alias("name"), script_language(n).alias("language_code"))
        return F.when(F.contains(n, F.lit(")")) | F.contains(n, F.lit("]")), _let(marker, lambda m: marked_entry(n, m))).otherwise(plain)

    # equal names are neighbours in an order by name, language and place: no name is compared with all before it
    entries = F.filter(F.transform(_pieces(blob), entry), lambda e: F.char_length(e["name"]) >= 2)
    keyed = F.sort_array(F.transform(entries, lambda e, i: F.struct(F.lower(e["name"]).alias("low"), e["language_code"].alias("language_code"), i.alias("i"), e["name"].alias("name"))))
    same = lambda a, b: (a["low"] == b["low"]) & a["language_code"].eqNullSafe(b["language_code"])
    firsts = _let(keyed, lambda k: F.filter(k, lambda x, i: (i == 0) | ~same(x, F.get(k, i - 1))))
    firsts = F.sort_array(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["name"].alias("name"), x["language_code"].alias("language_code"))))
    return F.transform(firsts, lambda e, i: F.struct(e["name"].alias("name"), e["language_code"].alias("language_code"), i.alias("position")))


def _without_brackets(name: Column) -> Column:
    return F.trim(F.when(F.contains(name, F.lit("(")), F.regexp_replace(name, r"\s*\(.*?\)\s*", "")).otherwise(name))


def name_score(name: Column, index: Column) -> Column:
    """Earlier, shorter, unmarked and well-known names first."""

    def score(size: Column, low: Column) -> Column:
        terms = F.lit(False)
        for t in COMMON_TERMS:
            terms = terms | F.contains(low, F.lit(t))
        return (
            1000 - index + F.when(index == 0, 5000).when(index == 1, 1000).when(index == 2, 500).otherwise(0) + F.when(size < 15, (15 - size) * 20).otherwise(0)
            + F.when(F.contains(name, F.lit("(")), 0).otherwise(200) + F.when(low.isin(*WELL_KNOWN), 2000).otherwise(0) + F.when(terms, 100).otherwise(0)
        )

    return _let(_without_brackets(name), lambda plain: _let(F.lower(plain), lambda low: score(F.char_length(plain), low)))


def scored_names(blob: Column) -> Column:
    """Array of names by descending score, ties in the order of the text."""
    names = F.filter(F.transform(F.split(blob, "[;,]"), lambda n: F.trim(n)), lambda n: n != "")
    scored = F.transform(names, lambda n, i: F.struct((-name_score(n, i)).alias("s"), i.alias("i"), n.alias("name")))
    return F.transform(F.sort_array(scored), lambda x: x["name"])


def display_name(preferred: Column, names: Column) -> Column:
    """The preferred name, else the first in Latin script, else the first."""
    latin = F.filter(names, lambda n: script_language(n).isNull())
    return F.coalesce(preferred, F.get(latin, F.lit(0)), F.get(names, F.lit(0)))


def domain(url: Column) -> Column:
    """Host of a URL, lower case, without www; 'unknown' for none."""
    low = F.regexp_replace(F.lower(url), "^[^/]*?://", "")
    host = F.regexp_replace(F.split_part(low, F.lit("/"), F.lit(1)), r"^www\.", "")
    return F.when(F.coalesce(url, F.lit("")) == "", "unknown").otherwise(host)


def name_from_url(url: Column) -> Column:
    """Words of a URL's last path part, without its extension."""
    last = F.element_at(F.split(F.split_part(url, F.lit("?"), F.lit(1)), "/"), -1)
    return F.trim(F.regexp_replace(F.regexp_replace(F.url_decode(F.regexp_replace(last, r"%(?![0-9A-Fa-f]{2})", "%25")), r"\.[A-Za-z0-9]+$", ""), "[_+-]+", " "))


def uri_quote(column: Column) -> Column:
    """Percent-encoded UTF-8 but for letters, digits, '_.-~' and '/'."""
    out = F.url_encode(column)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def list_items(column: Column, separator: str = ";") -> Column:
    """Trimmed items of a delimited list, without empty ones and NA."""
    return F.filter(F.transform(F.split(column, separator), lambda x: F.trim(x)), lambda x: ~x.isin("", "NA"))


def list_length(column: Column, separator: str = ",") -> Column:
    """0 for null, empty and NA."""
    return F.when(F.coalesce(F.nullif(F.nullif(column, F.lit("")), F.lit("NA")), F.lit("")) == "", 0).otherwise(F.size(F.split(column, separator)))


def number_range(column: Column) -> Column:
    """(low, high) of a semicolon list; an item counts by the number that it begins with."""
    numbers = F.filter(F.transform(list_items(column), lambda x: F.regexp_extract(x, r"^[+-]?[0-9]*\.?[0-9]+", 0).try_cast("double")), lambda x: x.isNotNull())
    return F.struct(F.array_min(numbers).alias("low"), F.array_max(numbers).alias("high"))


def koeppen(column: Column) -> Column:
    pattern = r"^([A-Z][A-Za-z]+)\s*-\s*(.+)$"
    part = lambda k: F.nullif(F.regexp_extract(column, pattern, k), F.lit(""))
    return F.struct(part(1).alias("code"), part(2).alias("name"))


def turtle_escape(column: Column) -> Column:
    out = column
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def csv_field(column: Column) -> Column:
    """Quoted where it holds a comma, quote or line end."""
    return F.when(column.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(column, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(column)


def file_name(column: Column) -> Column:
    return F.regexp_replace(column, "[^a-zA-Z0-9]", "_")


def plain_name(column: Column) -> Column:
    return F.regexp_replace(F.lower(column), "[^a-z0-9 ]", "")


def next_version(column: Column, part: int = 2) -> Column:
    """A dotted version with the part from 0 raised by one and later parts at zero."""
    items = F.transform(F.split(column, r"\."), lambda x: x.cast("int"))
    raised = F.transform(items, lambda x, i: F.when(i == part, x + 1).when(i > part, 0).otherwise(x))
    return F.array_join(F.transform(raised, lambda x: x.cast("string")), ".")


def json_block(column: Column) -> Column:
    """The text from the first brace to the last, null without both."""
    return F.nullif(F.regexp_extract(column, r"(?s)\{.*\}", 0), F.lit(""))


def claim_text(column: Column) -> Column:
    """A claim's JSON value as text: the first field there is of a fixed order, with a unit behind a value, else the JSON."""
    field = lambda n: F.get_json_object(column, f"$.{n}")
    value = F.when(field("unit").isNotNull(), F.concat_ws(" ", field("value"), field("unit"))).otherwise(field("value"))
    return F.coalesce(field("text"), field("name"), field("primary"), value, field("iucn_status"), field("type"), field("category"), column)


def claim_hash(taxon: Column, claim_type: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("::", taxon.cast("string"), claim_type, value), 256)


def top_common_names(blob: Column, most: int = 5, longest: int = 200) -> Column:
    """The best names of a list joined by commas: the three best scored, then names of new roots in languages not yet
    there, then any of new roots; cut at `longest` characters with dots behind."""
    root = lambda n: _without_brackets(F.lower(n))
    language = lambda n: F.when(F.contains(n, F.lit("(")), F.lower(F.regexp_extract(n, r"\((.*?)\)", 1))).otherwise("")
    state = lambda chosen, roots, langs: F.struct(chosen.alias("chosen"), roots.alias("roots"), langs.alias("langs"))
    add = lambda s, n, langs: state(F.array_append(s["chosen"], n), F.array_append(s["roots"], root(n)), langs)
    room = lambda s, n: (F.size(s["chosen"]) < most) & ~F.array_contains(s["roots"], root(n))

    def diverse(s: Column, n: Column) -> Column:
        lang = F.when(language(n) == "", "unspecified").otherwise(language(n))
        return F.when(room(s, n) & ~F.array_contains(s["langs"], lang), add(s, n, F.array_append(s["langs"], lang))).otherwise(s)

    def rest(s: Column, n: Column) -> Column:
        return F.when(room(s, n) & ~F.array_contains(s["chosen"], n), add(s, n, s["langs"])).otherwise(s)

    def choose(names: Column) -> Column:
        first = F.slice(names, 1, 3)
        marked = F.filter(F.transform(first, language), lambda x: x != "")
        begin = state(F.array_distinct(first), F.transform(first, root), marked)
        later = F.slice(names, 4, F.greatest(F.size(names) - 3, F.lit(0)))
        return F.aggregate(names, F.aggregate(later, begin, diverse), rest)["chosen"]

    chosen = _let(scored_names(blob), choose)
    line = F.array_join(chosen, ", ")
    line = _let(line, lambda v: F.when(F.char_length(v) > longest, F.concat(F.left(v, F.lit(longest)), F.lit("..."))).otherwise(v))
    return F.when(F.coalesce(blob, F.lit("")) == "", "").otherwise(line)
