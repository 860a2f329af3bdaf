"""The corpus pipeline, stage by stage, against plain versions of what each stage decides."""

import collections
import re

from pyspark.sql import functions as F

from arborlens.llm import decontam
from arborlens.llm.work import materialize, table


def near_copy_roots(texts):
    """Smallest id of each document's group under links of 0.8 and more over sets of five-word shingles, all pairs that
    share a shingle compared."""
    sets, parent, holders = {}, {i: i for i in texts}, collections.defaultdict(list)
    for i, t in texts.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        for g in sets[i]:
            holders[g].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in texts:
        for k in {k for g in sets[i] for k in holders[g] if k < i}:
            both = len(sets[i] & sets[k])
            if 10 * both >= 8 * (len(sets[i]) + len(sets[k]) - both):
                a, b = root(i), root(k)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in texts}


def test_stages(spark, data):
    import corpus_pipeline as pipeline

    docs = table(spark, data, "documents")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = materialize(stage(spark, docs, data), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        kept[name] = (before, after)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    labels = {r.doc_id: r.quality for r in table(spark, data, "labels").collect()}
    before, after = kept["quality"]
    known = [i for i in before if labels.get(i) == 1]
    assert sum(i in after for i in known) >= 0.95 * len(known)
    before, after = kept["near_duplicates"]
    words = {}
    for i in sorted(before):
        words.setdefault(" ".join(before[i].text.lower().split()), i)
    assert len({" ".join(r.text.lower().split()) for r in after.values()}) == len(after)
    assert set(after) <= set(words.values())
    want = near_copy_roots({i: r.text for i, r in before.items()})
    assert set(after) == set(want.values())
    before, after = kept["decontamination"]
    items = [b" ".join(decontam.words_of(r.text)) for r in table(spark, data, "benchmark").collect()]
    for i, r in before.items():
        held = any(b" " + t + b" " in b" " + b" ".join(decontam.words_of(r.text)) + b" " for t in items)
        assert not (held and i in after)
    before, after = kept["secrets"]
    assert set(after) == set(before)
    assert not any(re.search(r'(?i)token = "[0-9a-f]{40}"', r.text) for r in after.values())
    assert all(r.n_chars == len(r.text) for i, r in after.items() if r.text != before[i].text)
    before, after = kept["mixing"]
    assert after and all(1 <= r.copies <= 2 for r in after.values())


def test_run_and_registration(spark, data):
    import __spark_entry__ as entry
    import corpus_pipeline as pipeline

    assert entry.queries()["pipeline"] is pipeline.run
    assert pipeline.run(spark, data).count() > 0


def test_stages_on_odd_rows(spark, data):
    """Null ids, null, empty and repeated rows, one id with several texts, and clashing extra columns go through every
    stage; clean rows among them stay, until the mix leaves out rows without words."""
    import corpus_pipeline as pipeline

    docs = table(spark, data, "documents")
    good = [r.text for r in docs.where("length(text) between 700 and 3000").orderBy("doc_id").limit(4).collect()]
    item = table(spark, data, "benchmark").orderBy("item_id").first().text
    odd = [(None, good[0]), (None, good[1] + f" {item} "), (10**6, good[2] + " So it ends."), (10**6, good[3]), (10**6, good[3]), (10**6 + 1, None), (10**6 + 2, ""), (None, None)]
    rows = spark.createDataFrame([(i, t, "en", "src1", 0) for i, t in odd], docs.schema)
    frame = docs.unionByName(rows).select("*", *[F.lit(1).alias(n) for n in ("row", "fp", "k1", "_hit", "_keys", "size", "label", "f")])
    seen = {}
    for name, stage in pipeline.STAGES:
        before = frame
        frame = materialize(stage(spark, frame, data), name)
        assert name == "mixing" or frame.columns == before.columns
        seen[name] = collections.Counter((r.doc_id, r.text) for r in frame.where("doc_id is null or doc_id >= 1000000").collect())
        assert stage(spark, before.where("false"), data).count() == 0
    assert seen["quality"][10**6, good[3]] in (0, 2) and seen["near_duplicates"][10**6, good[3]] in (0, 1)
    assert seen["quality"][None, good[0]] == seen["near_duplicates"][None, good[0]] == seen["decontamination"][None, good[0]]
    assert not any(item in (t or "") for _, t in seen["decontamination"])
    assert all(t for _, t in seen["mixing"])
