"""Personal data: exact base patterns as seeds, and bootstrapped contextual extraction. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.llm.work import fresh, marked, materialize, text_keys, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Characters of the private use area: around matches, between two separators or dots, and what stands in for them when
#: a text holds them itself. None can be part of a match, so places do not change.
_MARK, _BREAK, _SAFE = "\ue000", "\ue002", "\ue001"
#: The base patterns, written without repeated groups, which recurse in Java on long runs. A break stands between two
#: adjacent separators (card) or dots (email), so that a run without a break has single ones only.
_LOCAL = f"A-Za-z0-9._%+{_BREAK}-"
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z0-9-]+"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
_CARD = r"[0-9][0-9\x20-]*[0-9]"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A word with a digit or an at sign: what an identifier may be.
_WORD = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*"


def _runs(text: Column, pattern: str, between: str | None = None) -> Column:
    """Array of (start, end, value), in code points, of the leftmost non-overlapping matches."""
    broken = text if between is None else F.regexp_replace(text, between, _BREAK)
    pieces = F.split(F.regexp_replace(broken, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK)
    plain = F.transform(pieces, lambda p: F.translate(p, _BREAK, "")) if between else pieces
    return F.when(F.size(plain) > 1, plain).otherwise(F.array().cast("array<string>"))


def _places(pieces: Column) -> Column:
    """Running lengths of the pieces, from 0."""
    return F.aggregate(pieces, F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.char_length(p))))


def _matches(pieces: str, places: str) -> Column:
    odd = F.filter(F.sequence(F.lit(0), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda i: i % 2 == 1)
    return F.transform(odd, lambda i: F.struct(F.get(places, i).alias("start"), F.get(places, i + 1).alias("end"), F.get(pieces, i).alias("value")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right: from the right, every second digit counts double, less 9 above 9."""
    n = F.char_length(digits)
    d = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    twice = lambda i: F.when(d(i) > 4, d(i) * 2 - 9).otherwise(d(i) * 2)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 1, twice(i)).otherwise(d(i)))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.char_length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(_digits(value))).otherwise(False)
    return (n >= 9) & (n <= 15) if kind == "phone" else F.lit(True)


def _of_kind(no: int, kind: str, matches: Column) -> Column:
    good = F.filter(matches, lambda m: _valid(kind, m["value"]))
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("no"), m["end"].alias("end"), m["value"].alias("value")))


def base_spans(rows: DataFrame) -> DataFrame:
    """rows with `text` -> the same with `base`: array of (start, no, end, value), by start, then kind."""
    patterns = {"email": (_EMAIL, r"(?<=\.)(?=\.)"), "ip": (_IP, None), "card": (_CARD, r"(?<=[\x20-])(?=[\x20-])"), "phone": (_PHONE, None)}
    safe = F.translate("text", _MARK + _BREAK, _SAFE + _SAFE)
    rows = rows.withColumn("safe", safe)
    may = {"email": F.contains("safe", F.lit("@")), "phone": F.contains("safe", F.lit("+"))}
    digit = F.col("safe").rlike("[0-9]")
    for kind, (pattern, between) in patterns.items():
        rows = rows.withColumn(f"p_{kind}", F.when(may.get(kind, digit), _runs(F.col("safe"), pattern, between)).otherwise(F.array().cast("array<string>")))
    rows = rows.drop("safe").withColumns({f"l_{k}": _places(F.col(f"p_{k}")) for k in KINDS})
    found = []
    for no, kind in enumerate(KINDS):
        found.append(_of_kind(no, kind, _matches(f"p_{kind}", f"l_{kind}")))
    rows = rows.withColumn("base", F.array_sort(F.concat(*found)))
    return rows.drop(*[f"{x}_{k}" for k in KINDS for x in "pl"])


def _shape(value: Column) -> Column:
    """Digits as 9, runs of letters as a, and whether the digits pass Luhn where they are long enough for a card."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(value), "[0-9]", "9"), r"\p{L}+", "a")
    n = F.char_length(_digits(value))
    bad_byte = F.exists(F.split(value, r"[^0-9]+"), lambda p: F.coalesce(p.try_cast("int") > 255, F.char_length(p) > 9))
    checks = F.concat(F.when((n >= 12) & (n <= 19), F.when(luhn(_digits(value)), "+").otherwise("-")).otherwise(""), F.when(bad_byte, ">").otherwise(""))
    mail = F.regexp_replace(plain, r"^[^@\s]+@[a9.-]+\.a$", "x@y.a")
    address = F.regexp_replace(mail, r"^9{1,3}\.9{1,3}\.9{1,3}\.9{1,3}$", "9.9.9.9")
    return F.concat(address, checks)


def _class(value: Column) -> Column:
    """The coarsest class of a value, for patterns that back off to one word."""
    return F.when(F.contains(value, F.lit("@")), "@").when(value.rlike("^[0-9+(][0-9 ().-]*$"), "9").when(value.rlike("^[0-9.]+$"), "9.").otherwise("a9")


def occurrences(rows: DataFrame) -> DataFrame:
    """rows with `text` and `base` -> the same with `words`: array of (start, end, value, no, patterns) of everything that
    may be an identifier.

    That is every word with a digit or an at sign, and every run of two to four such words in a row, trimmed of outer
    punctuation, outside the base spans; and every base span that begins in such a word, with `no` its kind. The lexical
    patterns of an occurrence are the two words before it, the word on either side, the word before it with the value's
    class, and the value's shape.
    """
    pieces = F.when(F.col("text").rlike("[0-9@]"), _runs(F.translate("text", _MARK, _SAFE), _WORD)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("pieces", pieces)
    rows = rows.withColumn("places", _places(F.col("pieces")))
    odd = F.filter(F.sequence(F.lit(0), F.greatest(F.size("pieces") - 1, F.lit(0))), lambda i: i % 2 == 1)
    spread = lambda i: F.transform(F.sequence(i, i + 6, F.lit(2)), lambda j: F.struct(i.alias("i"), j.alias("j")))
    # a run goes on while single blanks part its words
    near = lambda i, j: (j < F.size("pieces") - 1) & F.forall(F.filter(F.sequence(i, j), lambda k: (k > i) & (k % 2 == 0)), lambda k: F.get("pieces", k) == " ")
    runs = F.filter(F.flatten(F.transform(odd, spread)), lambda r: near(r["i"], r["j"]))
    lead = lambda w: F.char_length(F.regexp_extract(w, r"^[^0-9A-Za-z+(]*", 0))
    tail = lambda w: F.char_length(F.regexp_extract(w, r"[^0-9A-Za-z)]*$", 0))
    start, end = lambda r: F.get("places", r["i"]) + lead(F.get("pieces", r["i"])), lambda r: F.get("places", r["j"] + 1) - tail(F.get("pieces", r["j"]))
    own = F.transform(runs, lambda r: F.struct(r["i"].alias("i"), r["j"].alias("j"), start(r).alias("start"), end(r).alias("end"), F.lit(None).cast("int").alias("no")))
    free = F.filter(own, lambda o: (o["end"] > o["start"]) & ~F.exists("base", lambda b: (b["start"] < o["end"]) & (b["end"] > o["start"])))
    inside = lambda i, b: (b["start"] >= F.get("places", i)) & (b["start"] < F.get("places", i + 1))
    first = lambda b: F.get(F.filter(odd, lambda i: inside(i, b)), F.lit(0))
    last = lambda b: F.coalesce(F.get(F.filter(odd, lambda i: (b["end"] > F.get("places", i)) & (b["end"] <= F.get("places", i + 1))), F.lit(0)), first(b))
    seeds = F.transform("base", lambda b: F.struct(first(b).alias("i"), last(b).alias("j"), b["start"].alias("start"), b["end"].alias("end"), b["no"].alias("no")))
    every = F.concat(free, F.filter(seeds, lambda o: o["i"].isNotNull()))
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), "[0-9]", "9"), r"\s+"), lambda w: w != "")
    piece = lambda i: F.coalesce(F.get("pieces", i), F.lit(""))

    def full(o: Column) -> Column:
        left = F.concat(words(piece(o["i"] - 2)), words(piece(o["i"] - 1)))
        right = F.concat(words(piece(o["j"] + 1)), words(piece(o["j"] + 2)))
        one, two = F.coalesce(F.try_element_at(left, F.lit(-1)), F.lit("^")), F.coalesce(F.try_element_at(left, F.lit(-2)), F.lit("^"))
        next_ = F.coalesce(F.try_element_at(right, F.lit(1)), F.lit("$"))
        value = F.substring(F.col("text"), o["start"] + 1, o["end"] - o["start"])
        patterns = F.array(
            F.concat_ws(" ", two, one, F.lit("_")), F.concat_ws(" ", one, F.lit("_"), next_),
            F.concat_ws(" ", one, F.lit("_"), _class(value)), F.concat(F.lit("="), _shape(value)),
        )
        return F.struct(o["start"].alias("start"), o["end"].alias("end"), F.lower(value).alias("value"), o["no"].alias("no"), patterns.alias("patterns"))

    return rows.withColumn("words", F.transform(every, full)).drop("pieces", "places")


def discover(found: DataFrame, rounds: int = 4, confidence: float = 0.8, prior: float = 2.0, floor: float = 0.5) -> DataFrame:
    """Occurrences (value, no, patterns) -> (value, no, score): values that no base pattern knows, with the kind that
    their patterns give them.

    The graph has a link for each pattern and distinct value that occurs in it, and is scored in both directions: a
    pattern's score for a kind is the sum of its values' scores over their number plus `prior`, so that few values prove
    little; a value's score for a kind is 1 - product of (1 - score) over its patterns from `floor` on, and 1 for a seed
    of that kind, 0 for one of another. After `rounds` rounds, values from `confidence` on are found. Links are distinct;
    each round adds up by pattern and by value with partial sums between joins of written tables, so that a frequent
    word or value is no single task's.
    """
    links = materialize(found.select("value", F.explode("patterns").alias("pattern")).distinct(), "links")
    seeds = materialize(found.where("no is not null").groupBy("value").agg(F.min("no").alias("no")), "seeds")
    kinds = range(len(KINDS))
    known = materialize(seeds.select("value", *[(F.col("no") == k).cast("double").alias(f"s{k}") for k in kinds]), "known")
    fixed = known
    for _ in range(rounds):
        joined = links.join(known.withColumnRenamed("value", "v"), F.col("value") == F.col("v"), "left")
        sums = joined.groupBy("pattern").agg(*[(F.sum(F.coalesce(f"s{k}", F.lit(0.0))) / (F.count(F.lit(1)) + prior)).alias(f"r{k}") for k in kinds])
        strong = materialize(sums.where(F.greatest(*[f"r{k}" for k in kinds]) >= floor).withColumnRenamed("pattern", "p"), "patterns")
        miss = [F.sum(F.when(F.col(f"r{k}") >= floor, F.log1p(-F.least(f"r{k}", F.lit(0.999)))).otherwise(0.0)) for k in kinds]
        scores = links.join(strong, F.col("pattern") == F.col("p")).groupBy("value").agg(*[(1 - F.exp(m)).alias(f"s{k}") for k, m in zip(kinds, miss, strict=True)])
        known = materialize(fixed.unionByName(scores.join(fixed.select("value"), "value", "left_anti")), "known")
    best = F.greatest(*[F.struct(F.col(f"s{k}").alias("score"), F.lit(-k).alias("no")) for k in kinds])
    fresh_ = known.join(seeds.select("value"), "value", "left_anti").withColumn("b", best)
    return fresh_.select("value", (-F.col("b.no")).alias("no"), F.col("b.score").alias("score")).where(F.col("score") >= confidence)


def _apart(spans: Column) -> Column:
    """Of overlapping spans those that begin first, and the longest of them."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    none = F.slice(spans, 1, 0)
    return F.aggregate(order, none, lambda kept, s: F.when((F.size(kept) == 0) | (F.element_at(kept, -1)["end"] <= s["start"]), F.concat(kept, F.array(s))).otherwise(kept))


_SPANS = "array<struct<start:int,no:int,end:int,value:string>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, base, found per row of docs: base spans, and spans that patterns add, as arrays of (start, no, end, value)
    with no an index into KINDS; places in code points, end exclusive. options as in discover().

    Texts are read once: base spans and occurrences are written by row, without the text, and only rows with an
    occurrence outside the base spans are joined with what is discovered. A null text is empty; rows with equal doc_ids,
    or none, are separate rows; a text is read whole at any length. Found spans overlap neither base spans nor another.
    """
    rows = _scanned(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")))
    return _with_found(rows, **options).select("doc_id", "base", "found")


def _scanned(rows: DataFrame) -> DataFrame:
    rows = occurrences(base_spans(rows)).drop("text").withColumn("row", F.monotonically_increasing_id())
    return materialize(rows.withColumn("base", F.col("base").cast(_SPANS)), "scanned")


def _with_found(rows: DataFrame, **options) -> DataFrame:
    words = rows.select("row", F.explode("words").alias("w")).select("row", "w.*")
    named = materialize(discover(words, **options), "named")
    extra = words.where("no is null").drop("no", "patterns").join(named.withColumnRenamed("value", "v"), F.col("value") == F.col("v"))
    spans = _apart(F.collect_list(F.struct("start", "no", "end", "value")).cast(_SPANS))
    extra = materialize(extra.groupBy(F.col("row").alias("r")).agg(spans.alias("found")), "found")
    out = rows.join(extra, F.col("row") == F.col("r"), "left").drop("r", "words")
    return out.withColumn("found", F.coalesce("found", F.array().cast(_SPANS)))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counts(spans: Column) -> dict[str, Column]:
    count = lambda no: F.size(F.filter(spans, lambda s: s["no"] == no)).cast("long")
    return {f"n_{k}": count(no) for no, k in enumerate(KINDS)}


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with every span that find_pii names replaced by its kind in brackets, in that row and at that place; all
    other columns, and null texts, as they are. Rows are matched by their text, so equal texts are cut alike, whatever
    their doc_ids; texts without a span are not shuffled."""
    keyed = docs.select(text_keys(text_col)["k1"].alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = _with_found(_scanned(keyed), **options).select("doc_id", F.array_sort(F.concat("base", "found")).alias("s")).where("size(s) > 0")
    key, spans, flag = fresh(docs, "_text_key"), fresh(docs, "_spans"), fresh(docs, "_hit")
    held = materialize(found.groupBy(F.col("doc_id").alias(f"{key}k")).agg(F.first("s").alias(spans)), "spans")
    rows = marked(docs.withColumn(key, text_keys(text_col)["k1"]), flag, F.col(key), held.select(f"{key}k"))
    some = rows.where(F.col(flag)).join(held, F.col(key) == F.col(f"{key}k"), "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ends = F.concat(F.array(F.lit(0)), F.transform(F.col(spans), lambda s: s["end"]))
    kept = F.transform(F.col(spans), lambda s, i: F.concat(F.substring(F.col(text_col), F.get(ends, i) + 1, F.greatest(s["start"] - F.get(ends, i), F.lit(0))), F.get(names, s["no"])))
    rest = F.substring(F.col(text_col), F.element_at(ends, -1) + 1, F.char_length(text_col))
    some = some.withColumn(text_col, F.when(F.col(spans).isNotNull(), F.concat(F.array_join(kept, ""), rest)).otherwise(F.col(text_col)))
    return rows.where(~F.col(flag)).select(*docs.columns).unionByName(some.select(*docs.columns))
