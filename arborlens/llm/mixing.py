"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlens.llm.work import fresh, materialize, text_or_empty
from arborlens.operators.relational import ranked

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size) -> sno, source, source_size, target: the share of all sizes dealt by weight, no target above
    most times its source's size. Each round adds up two numbers over the sources until no source is above."""
    weight = F.lit(weights[-1])
    for k, w in enumerate(weights[:-1]):
        weight = F.when(F.col("sno") % len(weights) == k, w).otherwise(weight)
    by = ranked(sources, F.col("source").asc_nulls_last(), name="sno")
    by = materialize(by.withColumn("w", weight).withColumn("cap", F.col("source_size") * most), "sources")
    total = by.agg(F.sum("source_size")).first()[0] or 0
    level, above = 0.0, None
    while True:
        over = F.col("w") * F.lit(level) > F.col("cap") if above is not None else F.lit(False)
        row = by.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("w"))), F.count(F.when(over, 1))).first()
        if row[2] == above or not row[1]:
            break
        above, level = row[2], (total * share - (row[0] or 0)) / row[1]
    return by.withColumn("target", F.least(F.col("w") * F.lit(level), F.col("cap").cast("double"))).drop("w", "cap")


def _size(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def _appeal(size: Column) -> Column:
    """A document's relative number of expected copies: the square root of its words, in thousandths (whole numbers, so
    that sums do not depend on their order)."""
    return F.floor(F.sqrt(size.cast("double")) * 1000.0).cast("long")


def _expected(appeal: Column, level: Column, full: Column, most: int) -> Column:
    """Expected copies of a document: its appeal times its source's level, at most `most`; exactly that where the source
    takes all it may."""
    return F.when(full, F.lit(float(most))).otherwise(F.least(F.coalesce(appeal * level, F.lit(0.0)), F.lit(float(most))))


def _draw(doc_id: Column, text_col: str, seed: str) -> Column:
    """The document's fixed random number in 0..1, from its doc_id and text."""
    name = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(text_or_empty(text_col)))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _rank_key(u: Column, p: Column) -> Column:
    """Odds of the document's random number over its inclusion odds, folded into 0..1; 1 where nothing is drawn."""
    odds = F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))
    return F.coalesce(odds / (1 + odds), F.lit(1.0))


def _numbered(docs: DataFrame) -> DataFrame:
    """docs, written first where rows could come in another order when they are read again: a row is told from its equals by
    its place in the input."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return materialize(docs, "docs") if any(n in plan for n in ("Exchange", "Python", "Arrow", "Pandas", "Join")) else docs


def _cell(r: Column, fan: int, level: int) -> Column:
    return F.least(F.floor(r * float(fan**level)), F.lit(fan**level - 1))


def source_levels(sized: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """sources with `full` and `level`: expected copies are least(most, appeal x level), and their words add up to the
    target. Documents that would pass `most` stop there and the rest rises, found from the most appealing on over the
    distinct sizes of a source (no more than the longest text has words)."""
    kinds = sized.groupBy(F.col("source").alias("s2"), "size").agg(F.sum("size").alias("words"), F.sum(F.col("appeal") * F.col("size")).alias("pull"))
    kinds = materialize(kinds.where("size > 0"), "kinds").join(sources.select("sno", "s", "target", "source_size"), F.col("s2").eqNullSafe(F.col("s")))
    above = Window.partitionBy("sno").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("sno").orderBy(F.col("size").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("target") - most * F.coalesce(F.sum("words").over(above), F.lit(0)).cast("double")) / F.sum("pull").over(below).cast("double")
    fits = kinds.withColumn("level", level).where(_appeal(F.col("size")) * F.col("level") <= most)
    found = fits.groupBy(F.col("sno").alias("n")).agg(F.max_by("level", "size").alias("level"))
    full = (F.col("source_size") > 0) & (F.col("target") >= most * F.col("source_size"))
    return sources.join(found, F.col("sno") == F.col("n"), "left").drop("n").withColumns({"full": full, "level": F.coalesce("level", F.lit(0.0))})


def source_cuts(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "",
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", levels: int = 2, fan: int = 256,
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, sno, size, whole, p, r) of every row: certain whole copies, inclusion probability of one more, and
    rank key; and a row for each source: its sizes, level, and the last rank key (`end`) and the closing one (`close`) of
    its sample.

    The cut is found by radix: words by `fan` ranges of the rank key, then by `fan` ranges inside the range that holds
    the cut, then row by row inside the last range, so that a source with any share of the rows never meets in one task.
    Rows of which nothing is drawn take no part in it.
    """
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), _size(text_col).alias("size"), F.monotonically_increasing_id().alias("row"),
        _draw(F.col(id_col).cast("long"), text_col, seed).alias("u"),
    ).withColumn("appeal", _appeal(F.col("size")))
    sized = materialize(sized, "sized")
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    sources = materialize(source_levels(sized, sources.withColumnRenamed("source", "s"), most), "levels")
    rows = sized.join(sources, F.col("source").eqNullSafe(F.col("s"))).withColumn("c", _expected(F.col("appeal"), F.col("level"), F.col("full"), most))
    rows = rows.select("doc_id", "row", "sno", "size", "u", F.floor("c").cast("long").alias("whole"), (F.col("c") - F.floor("c")).alias("p"))
    rows = materialize(rows.withColumn("r", _rank_key(F.col("u"), F.col("p"))).drop("u"), "keyed")
    whole = rows.groupBy("sno").agg(F.sum(F.col("size") * F.col("whole")).alias("certain"))
    sources = materialize(sources.join(whole, "sno").withColumn("rest", F.col("target") - F.col("certain")).drop("certain"), "targets")
    drawn = rows.where("p > 0")
    cut = materialize(sources.select("sno", "rest", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("cell")), "cut")
    for level in range(1, levels + 1):
        own = drawn.withColumn("b", _cell(F.col("r"), fan, level))
        own = own.join(cut, "sno").where(F.floor(F.col("b") / fan) == F.col("cell")) if level > 1 else own
        words = materialize(own.groupBy("sno", "b").agg(F.sum("size").alias("n")), "words").join(cut, "sno")
        words = words.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("sno").orderBy("b")))
        at = F.struct("b", (F.col("upto") - F.col("n")).alias("n"))
        last = F.coalesce(F.min(F.when(F.col("upto") > F.col("rest"), at)), F.max(at))
        cut = words.groupBy("sno", "rest").agg(last.alias("at")).select("sno", "rest", F.col("at.n").alias("before"), F.col("at.b").alias("cell"))
        cut = materialize(cut, "cut")
    own = drawn.withColumn("b", _cell(F.col("r"), fan, levels)).join(cut, "sno").where(F.col("b") == F.col("cell"))
    key = F.struct("r", "doc_id", "size", "row")
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("sno").orderBy("r", "doc_id", "size", "row"))
    fits = F.col("upto") <= F.col("rest")
    ends = own.withColumn("upto", upto).groupBy("sno", "rest", "before", "cell")
    ends = ends.agg(F.max(F.when(fits, key)).alias("end"), F.max(F.when(fits, F.col("upto"))).alias("upto"))
    ends = materialize(ends.select("sno", "cell", "end", (F.col("rest") - F.coalesce("upto", "before")).alias("gap")), "ends")
    left = F.abs(F.col("gap") - F.col("size"))
    later = drawn.join(ends, "sno").where(~_leading(F.col("r"), key, F.col("cell"), F.col("end"), fan, levels) & (left < F.col("gap")))
    closing = later.groupBy("sno").agg(F.min(F.struct(left.alias("left"), "r", "doc_id", "size", "row")).alias("close"))
    closing = closing.select("sno", F.struct("close.r", "close.doc_id", "close.size", "close.row").alias("close"))
    cuts = sources.join(ends, "sno", "left").join(materialize(closing, "closing"), "sno", "left")
    return rows, materialize(cuts.drop("gap", "rest"), "cuts")


def _leading(r: Column, key: Column, cell: Column, end: Column, fan: int, levels: int) -> Column:
    """Whether a rank key lies before its source's cut."""
    b = _cell(r, fan, levels)
    return F.coalesce((b < cell) | ((b == cell) & (key <= end)), F.lit(False))


def mix(docs: DataFrame, fan: int = 256, levels: int = 2, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies per row of docs; options as in source_cuts.

    size counts the text's words (null: 0). Sources in code point order, null last, carry the weights in turn. A document
    is expected in the mix as often as the square root of its size says, times a level that makes the words of its
    source come to the target, and twice at most. The whole copies in that number are certain; the part that is left
    is its inclusion probability p in a Pareto order sample: documents rank by u/(1-u) over p/(1-p), u a fixed hash of
    seed, doc_id and text, and the leading ones are taken whose words fit what the certain copies leave of the target; then
    the one further document that closes the gap best, if it helps. Where the target is twice the source, every
    document is taken twice and nothing is drawn. A null doc_id hashes as 'null'; repeated rows are separate rows;
    documents without words are taken no times; reruns agree.
    """
    rows, cuts = source_cuts(docs, fan=fan, levels=levels, **options)
    placed = rows.join(cuts.drop("s"), "sno")
    extra = _leading(F.col("r"), F.struct("r", "doc_id", "size", "row"), F.col("cell"), F.col("end"), fan, levels) | F.coalesce(F.col("row") == F.col("close.row"), F.lit(False))
    n = F.when(F.col("size") > 0, F.col("whole") + (extra & (F.col("p") > 0)).cast("long")).otherwise(0).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * n).alias("taken"), n.alias("copies"))


def mixed(
    docs: DataFrame, fan: int = 256, levels: int = 2, most: int = 2, seed: str = "", id_col: str = "doc_id", source_col: str = "source",
    text_col: str = "text", **options,
) -> DataFrame:
    """docs that the mix takes, with `copies`, the number of times (in place of any such column).

    Each row is decided as it is read, from its own rank key and place and its source's cut, so no text is shuffled while the
    sources are few. Rows equal in doc_id and text are told apart by their places, so that the mix takes as many of them
    as mix() does.
    """
    docs = _numbered(docs)
    _, cuts = source_cuts(docs, fan=fan, levels=levels, most=most, seed=seed, id_col=id_col, source_col=source_col, text_col=text_col, **options)
    id_, size, times, rank, cut, row = (fresh(docs, n) for n in ("_mix_id", "_mix_size", "_mix_times", "_mix_rank", "_mix_cut", "_mix_row"))
    own = docs.withColumns({id_: F.col(id_col).cast("long"), size: _size(text_col), row: F.monotonically_increasing_id(), rank: _draw(F.col(id_col).cast("long"), text_col, seed)})
    packed = cuts.select(F.struct(*cuts.columns).alias(cut))
    rows = own.join(packed, F.col(source_col).eqNullSafe(F.col(f"{cut}.s")))
    c = lambda n: F.col(f"{cut}.{n}")
    # columns of their own, since each is used several times below
    rows = rows.withColumn(times, _expected(_appeal(F.col(size)), c("level"), c("full"), most))
    p = F.col(times) - F.floor(times)
    rows = rows.withColumn(rank, _rank_key(F.col(rank), p))
    key = F.struct(F.col(rank).alias("r"), F.col(id_).alias("doc_id"), F.col(size).alias("size"), F.col(row).alias("row"))
    lead = _leading(F.col(rank), key, c("cell"), c("end"), fan, levels)
    closing = F.coalesce(F.col(row) == c("close.row"), F.lit(False))
    n = F.when(F.col(size) > 0, F.floor(times).cast("long") + ((lead | closing) & (p > 0)).cast("long")).otherwise(0)
    return rows.withColumn("copies", n).where("copies > 0").drop(id_, size, times, rank, cut, row)
