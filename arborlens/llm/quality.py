"""Quality classifier: Bradley-Terry scores from preference pairs, cut at a quantile."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlens.llm.work import fresh, materialize

#: The score at which the cut lies.
CUT = 0.3
FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "bangs", "bars", "stops", "newlines", "distinct", "doubled",
    "top_word", "repeated_lines", "edge_symbols", "long_words", "short",
)
_DROP_UPPER = bytes(range(65, 91))
_DROP_DIGIT = b"0123456789"
_DROP_SYMBOL = b"#$%&*<>~^=+@_\\{}[]/"


def features(text: str | None) -> list[float]:
    """Shares of kinds of characters, words and lines in the whole text; zeros for one without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    size, n = len(data), len(words)
    share = lambda drop: (size - len(data.translate(None, drop))) / size
    low = data.lower().split()
    counts = Counter(low)
    lines = [x for x in data.split(b"\n") if x.strip()]
    edge = sum(1 for w in words if w[-1] in b"#$%&*!|<>~^=+@_")
    return [
        math.log(size), math.log(n), sum(map(len, words)) / n, share(_DROP_UPPER), share(_DROP_DIGIT), share(_DROP_SYMBOL), share(b"!"),
        share(b"|"), share(b".,;:?"), share(b"\n"), len(counts) / n ** 0.9, sum(a == b for a, b in zip(low, low[1:])) / n,
        max(counts.values()) / n, 1 - len(set(lines)) / len(lines), edge / n, sum(len(w) > 20 for w in words) / n, 1.0 if n < 20 else 0.0,
    ]


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                f = [features(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.list_(pa.float64()))], names=["doc_id", "f"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, f array<double>")


def fit(labelled: DataFrame, most: int = 4000, opponents: int = 4, regularisation: float = 1e-3) -> tuple[list[float], float]:
    """(doc_id, f, quality 0 or 1) -> weights and the cut.

    The weights come from at most `most` documents of each label, chosen by a hash of their ids (the documented bound):
    every document of the rarer label meets `opponents` of the other, and logistic loss on the differences of their
    features, without intercept, fits Bradley-Terry strengths. The cut is the quantile of the strengths of all labelled
    documents at the share of label 0.
    """
    labelled = labelled.where("doc_id is not null and quality in (0, 1)")
    sides = []
    for label in (0, 1):
        side = labelled.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        side = side.withColumn("i", F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")) - 1)
        sides.append(materialize(side.select("i", "f"), "side"))
    n = [s.count() for s in sides]
    zero = [0.0] * len(FEATURES)
    if not all(n):
        return zero, 0.0
    rare = 0 if n[0] <= n[1] else 1
    a, b = sides[rare].withColumnRenamed("f", "x"), sides[1 - rare].withColumnRenamed("f", "y").withColumnRenamed("i", "j")
    a = a.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(opponents - 1))))
    a = a.withColumn("j", (F.col("i") * opponents + F.col("k")) % n[1 - rare])
    sign = 1.0 if rare == 1 else -1.0  # better minus worse
    pairs = a.join(b, "j").select(F.zip_with("x", "y", lambda p, q: (p - q) * sign).alias("d"), (F.col("i") % 2).cast("double").alias("won"))
    # half of the pairs are seen from the loser's side, else there would be one class only
    d = F.when(F.col("won") == 1, F.col("d")).otherwise(F.transform("d", lambda v: -v))
    pairs = materialize(pairs.select(d.alias("d"), "won"), "pairs")
    model = LogisticRegression(featuresCol="v", labelCol="won", fitIntercept=False, regParam=regularisation, maxIter=60, tol=1e-6)
    if pairs.select("won").distinct().count() < 2:
        return zero, 0.0
    weights = model.fit(pairs.coalesce(4).withColumn("v", array_to_vector("d"))).coefficients.tolist()
    share, strength = labelled.agg(F.avg(1.0 - F.col("quality"))).first()[0], strength_of(F.col("f"), weights)
    cut = labelled.agg(F.percentile_approx(strength, float(share), 10000)).first()[0]
    return weights, float(cut)


def strength_of(f: Column, weights: list[float]) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(f, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with labels, without the documents that are held out."""
    own = labels.select(F.col("doc_id").cast("long").alias("l"), F.col("quality").cast("int").alias("quality"))
    own = own.where("l is not null and quality is not null")
    return rows.join(own, F.col("doc_id") == F.col("l")).where(~held_out(F.col("doc_id"))).select("doc_id", "f", "quality")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs.

    Only the text is scored. Labels of documents whose crc32(doc_id as text) mod 5 is 0 are never seen. The score is the
    logistic function of a document's Bradley-Terry strength, moved so that the cut quantile scores 0.3; predicted is 1
    from there on. Null and empty texts have the features of no words. Contradicting or repeated labels all count;
    without labels of both kinds every score is 0.3.
    """
    rows = materialize(feature_table(docs, id_col, text_col), "features")
    weights, cut = fit(materialize(training_rows(rows, labels), "labelled"), **options)
    z = strength_of(F.col("f"), weights) - F.lit(cut) + F.lit(math.log(CUT / (1 - CUT)))
    score = F.when(strength_of(F.col("f"), weights) >= cut, F.greatest(F.lit(CUT), 1 / (1 + F.exp(-z)))).otherwise(F.least(F.lit(CUT - 1e-9), 1 / (1 + F.exp(-z))))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs whose text scores at least 0.3, columns unchanged, in one pass over the texts: rows are written beside their
    features, the fit reads the features of labelled rows, and the cut decides each row by its own. No text is shuffled.

    Null and empty texts are scored as texts without words; equal texts stay or go together; rows without doc_id, or
    with one that others share, are decided like all others. Without labels of both kinds every row stays.
    """

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    f = fresh(docs, "_features")
    rows = materialize(docs.withColumn(f, of(F.col(text_col))), "features")
    known = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(f).alias("f"))
    weights, cut = fit(materialize(training_rows(known, labels), "labelled"), **options)
    return rows.where(strength_of(F.col(f), weights) >= cut).drop(f)
