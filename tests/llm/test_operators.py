"""Operators against brute-force versions, and their defined results for odd tables."""

import base64
import collections
import gzip
import hashlib
import io
import random
import re

import numpy as np
import pytest
from conftest import same
from pyspark.sql import functions as F

from arborlens.llm import chat, components, decontam, embed_dedup, mixing, pii, quality, queries, secrets, simhash, substring, warc
from arborlens.llm.runs import min_labels
from arborlens.llm.work import new_path, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators use inside.
CLASH = {"fp": 1, "_id": 2, "_bad": 3, "_kept_id": 4, "row": 5, "words": 6, "start": 7, "copies": 8, "label": 9, "base": 10, "u": 11, "size": 12}


def docs_frame(spark, texts, clash=False):
    rows = [(i, t, "en", f"src{(i or 0) % 3}" if i != 4 else None, len(t or "")) for i, t in texts]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.select("*", *[F.lit(v).alias(k) for k, v in CLASH.items()]) if clash else frame


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def classes(nodes, links):
    parent = {n: n for n in nodes}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: find(parent, n) for n in nodes}


@pytest.fixture(scope="module")
def documents(spark, data):
    return table(spark, data, "documents")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, duck, data, name):
    same(queries.QUERIES[name](spark, data), duck.execute(queries.ORACLE_SQL[name]))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = classes({x for p in links for x in p}, links)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_min_labels():
    rng = np.random.default_rng(0)
    i, j = rng.integers(0, 50, 40), rng.integers(0, 50, 40)
    want = classes(range(50), zip(i.tolist(), j.tolist(), strict=True))
    assert min_labels(50, i, j).tolist() == [want[n] for n in range(50)]


def test_min_labels_carries_earlier_links():
    label = min_labels(4, np.array([2]), np.array([3]))
    assert min_labels(4, np.array([3, 2]), np.array([1, 0]), label).tolist() == [0] * 4
    rng = np.random.default_rng(1)
    for n, block in ((6, 2), (40, 3), (300, 25), (300, 150)):
        for _ in range(40):
            i, j = rng.integers(0, n, n), rng.integers(0, n, n)
            label = None
            for k in range(0, n, block):
                label = min_labels(n, i[k : k + block], j[k : k + block], label)
            want = classes(range(n), zip(i.tolist(), j.tolist(), strict=True))
            assert label.tolist() == [want[x] for x in range(n)]


# 1


def test_warc_files_are_gzip_records(spark, data):
    path = new_path(spark, "warc")
    pages = table(spark, data, "pages").select("page_id", "url", "html")
    odd = spark.createDataFrame([(900, "u v\nw", None), (901, None, None), (902, "x", ""), (None, "n", "lone"), (903, "x", "é" * 10), (904, "x", "é" * 10), (904, "x", "é" * 10)], pages.schema)
    warc.write_warc(pages.unionByName(odd), path)
    out = []
    for row in spark.read.format("binaryFile").load(path).collect():
        with gzip.open(io.BytesIO(bytes(row.content))) as f:
            out.append(f.read())
    assert b"".join(out).count(b"WARC/1.1\r\n") == pages.count() + 7
    for split in (700, 1 << 24):
        got = collections.defaultdict(list)
        for r in warc.read_warc(spark, path, split_bytes=split).collect():
            got[r.page_id].append((r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload) if r.record_type == "response" else None))
            assert r.digest_ok in (True, None)
        assert sum(map(len, got.values())) == pages.count() + 7
        assert got[900] == [("revisit", 902, 0, None)] and got[902] == [("response", None, 0, b"")]
        assert got[903] == [("revisit", 904, 20, None)] and got[904] == [("response", None, 20, "é".encode() * 10)] * 2
        assert got[None] == [("response", None, 4, b"lone")]


def test_warc_minimum_and_nested_magic(spark):
    path = new_path(spark, "warc")
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "b" * 50), (4, "u", "b" * 50)], "page_id long, url string, html string")
    warc.write_warc(pages, path, min_payload=10)
    kinds = {r.page_id: r.record_type for r in warc.read_warc(spark, path, payload=False).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    record = lambda body: gzip.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n")
    rng = np.random.default_rng(5)
    bodies = [rng.integers(0, 256, 3000, dtype=np.uint8).tobytes() + warc.MAGIC * 5 for _ in range(20)]
    whole = b"".join(map(record, bodies)) + gzip.compress(b"")
    for step in (1, 500, 4096, len(whole)) if len(whole) < 10 else (500, 4096, len(whole)):
        found = [r for s in range(0, len(whole), step) for r in warc.records_in_range(io.BytesIO(whole), s, min(len(whole), s + step))]
        assert [warc.parse_record(d)["payload"] for _, d in found] == bodies


def test_warc_members_inside_payloads(spark):
    """A payload that is itself an archive, stored as it is, gives no records of its own, wherever a range starts."""
    rng = np.random.default_rng(25)
    record = lambda body, level: gzip.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n", level)
    noise = lambda n: rng.integers(0, 256, n, dtype=np.uint8).tobytes()
    inner = b"".join(record(noise(900), 6) for _ in range(3))
    bodies = [noise(70_000), noise(500) + inner + noise(70_000), b"WARC/1.0\r\n", b"", inner, noise(9_000)]
    whole = b"".join(record(b, 0) for b in bodies)
    for cuts in ([0], [0, 70_050], [0, 70_900], range(0, len(whole), 997)):
        edges = [*cuts, len(whole)]
        found = [r for s, e in zip(edges, edges[1:]) for r in warc.records_in_range(io.BytesIO(whole), s, e)]
        assert [warc.parse_record(d)["payload"] for _, d in found] == bodies
    broken = record(b"x" * 50, 6)[:-20] + record(b"y", 6)
    assert [warc.parse_record(d)["payload"] for _, d in warc.records_in_range(io.BytesIO(broken), 0, len(broken))] == [b"y"]


def test_warc_empty(spark):
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


# 2


def test_decontamination_equals_brute_force(spark, data, texts):
    items = {r.item_id: decontam.words_of(r.text) for r in table(spark, data, "benchmark").collect()}
    rng = random.Random(2)
    planted = {}
    for k, (_, w) in enumerate(sorted(items.items())[:30]):
        w = [x.decode() for x in w]
        w[0] = w[0].upper()
        if k % 3 == 0:
            w[rng.randrange(len(w))] = "changed"
        planted[10**6 + k] = "Before, it was " + ", ".join(w) + " and after."
    docs = {**texts, **planted, 3 * 10**6: "", 3 * 10**6 + 1: None}
    frame = docs_frame(spark, docs.items(), clash=True)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(frame, table(spark, data, "benchmark")).collect()}
    want = {}
    grams = collections.defaultdict(set)
    for i, w in items.items():
        for j in range(len(w) - 4):
            grams[tuple(w[j : j + 5])].add(i)
    for d, t in docs.items():
        w = decontam.words_of(t)
        for i in {i for j in range(len(w) - 4) for i in grams.get(tuple(w[j : j + 5]), ())}:
            n = len(items[i])
            best = max(decontam.weighted_similarity(w[s : s + n], items[i], 5) for s in range(max(1, len(w) - n + 1)))
            if best >= 0.8:
                want[d, i] = best
    missed = {k: v for k, v in want.items() if k not in got}
    assert not set(got) - set(want) and len(missed) <= 0.02 * len(want)
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    kept = decontam.decontaminate(frame, table(spark, data, "benchmark"))
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == set(docs) - {d for d, _ in got}


def test_decontamination_index_is_exact(spark):
    """Every pair of one size within the radius, none else, each once."""
    rng = random.Random(22)
    items = [(i, rng.choice((8, 9)), rng.getrandbits(64)) for i in range(60)]
    near = lambda fp: fp ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(22)))
    windows = [(n, near(fp)) for _, n, fp in items for _ in range(8)] + [(8, rng.getrandbits(64)) for _ in range(60)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    a = spark.createDataFrame([(n, signed(fp)) for n, fp in windows + windows[:9]], "n int, fp long")
    b = spark.createDataFrame([(i, n, signed(fp)) for i, n, fp in items], "inum long, n int, fp long")
    for radius in (3, 16):
        got = [(r.n, r.fp, r.inum) for r in decontam.near_fingerprints(a, b, radius).collect()]
        want = {(n, signed(fp), i) for n, fp in windows for i, m, item in items if n == m and (fp ^ item).bit_count() <= radius}
        assert len(got) == len(set(got)) and set(got) == want


def test_decontamination_short_items_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "..."), (4, "one two three four five six seven"), (4, "one two three four five six seven")], "item_id long, text string")
    docs = docs_frame(spark, [(1, "so ALPHA, beta it is"), (2, "alpha gamma"), (3, None), (None, "one two three four five six seven"), (5, "one two three four five six")])
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench, similarity=0.6).collect()}
    assert got == {(1, 1), (None, 4), (5, 4)}
    odd = docs_frame(spark, [(None, "so ALPHA, beta it is"), (None, "innocent"), (5, "alpha beta"), (5, "innocent"), (6, "fine"), (7, None), (7, ""), (6, "fine")], clash=True)
    kept = decontam.decontaminate(odd, bench)
    assert kept.columns == odd.columns
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter([(None, "innocent"), (5, "innocent"), (6, "fine"), (6, "fine"), (7, None), (7, "")])
    assert decontam.contaminated(docs, bench.where("false")).count() == 0
    assert decontam.contaminated(docs.where("false"), bench).count() == 0


# 3


def test_chat_round_trip(spark, data):
    odd = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (-2, 0, "a\nb", "x\\n<\\|<|<"), (-2, 1, "assistant", None), (-2, None, None, "first"), (None, 0, "assistant", "lone"), (-3, 0, "system", "s"), *[(-3, i, "user" if i % 2 else "assistant", f"t{i} " * 40) for i in range(1, 30)], (-4, 0, "assistant", "w " * 3000), (-5, 1, "user", "same"), (-5, 1, "user", "same")]
    turns = table(spark, data, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(odd, turns.schema))
    windows = chat.chat_windows(turns, budget=300, history_tokens=100).collect()
    assert all(w.n_tokens <= 300 or (w.oversize and w.n_turns == 1) for w in windows)
    own = [w for w in windows if w.conv_id == -3]
    assert len(own) > 3 and all(w.formatted.startswith("<|im_start|>system\ns<|im_end|>") for w in own) and any(w.n_repeated > 1 for w in own)
    by = collections.defaultdict(list)
    for r in turns.collect():
        by[r.conv_id].append((r.turn if r.turn is not None else -1, r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat.format_and_read(turns, budget=300, history_tokens=100).collect()}
    assert set(got) == set(by)
    for k, v in by.items():
        v.sort()
        loss = "".join(t for _, r, t in v if r == "assistant")
        g = got[k]
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in v).encode()).hexdigest()
        assert (g.n_turns, g.loss_chars, g.loss_sha256) == (len(v), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_and_read(turns.where("false")).count() == 0


def test_chat_counts_tokens(spark, data):
    """The same counts as another library's reading of the same vocabulary."""
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    own = chat._encoding(chat.TOKENIZER)
    texts = [chat.format_turn(r.role, r.text) for r in table(spark, data, "conversations").limit(300).collect()]
    texts += ["<|endoftext|> I'll  say\n\n it's 2024,\tnaïve ☃ don't" + " " * 9, "a" * 5000, "\n" * 7, ""]
    assert [len(own.encode_ordinary(t)) for t in texts] == [len(e) for e in other.encode_batch_fast(texts, add_special_tokens=False)]


# 4


def base_by_re(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in m[0] if x.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(x.isdigit() for x in m[0]) <= 15]
    return sorted(out)


def test_pii_base_spans(spark, texts):
    rng = random.Random(5)
    fuzz = {10**6 + i: "".join(rng.choice("ab.@%_+- 0123456789()..@@--  é") for _ in range(rng.randrange(120))) for i in range(1500)}
    fuzz |= {10**7: "1" * 9000 + " " + "1-" * 9000 + "a@" + "b." * 9000 + "c " + "." * 5000 + "x@y.z", 10**7 + 1: None, 10**7 + 2: ""}
    docs = {**texts, **fuzz}
    rows = pii.find_pii(docs_frame(spark, docs.items(), clash=True)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert [(s.start, s.no, s.end) for s in r.base] == base_by_re(docs[r.doc_id] or "")


def luhn_card(n):
    body = f"40000000{n:07d}"
    s = sum(int(x) if i % 2 else (2 * int(x) - 9 if int(x) > 4 else 2 * int(x)) for i, x in enumerate(reversed(body)))
    return body + str(-s % 10)


def test_pii_contexts_discover(spark):
    rows = [(i, f"Please pay card number {luhn_card(i)} today, said {i}a") for i in range(30)]
    rows += [(50 + i, f"{'of on it'.split()[i % 3]} +1 ({500 + i}) 555-{1000 + i} {'we he'.split()[i % 2]}") for i in range(30)]
    rows += [(100, "Please pay card number 4111-22x today, or card number 123456789012 now"), (101, "nothing 987654321 here"), (102, f"see {luhn_card(77)} {luhn_card(78)} there")]
    rows += [(103, "call +1 (444) 555-1234 10.1.2.3 or 1234567890123456")]
    frame = docs_frame(spark, rows, clash=True).withColumn("d", F.lit(1))
    got = {r.doc_id: r for r in pii.find_pii(frame).collect()}
    assert all(len(got[i].base) == 1 and not got[i].found for i in [*range(30), *range(50, 80)])
    assert [(s.value, s.no) for s in got[100].found] == [("4111-22x", 2), ("123456789012", 2)]
    assert [(s.value, s.no) for s in got[102].found] == [(luhn_card(77), 2), (luhn_card(78), 2)] and not got[102].base
    assert [(s.value, s.no) for s in got[103].found] == [("+1 (444) 555-1234", 3)] and [s.no for s in got[103].base] == [1]
    assert not got[101].found
    clean = pii.redact(frame)
    assert clean.columns == frame.columns
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[100] == "Please pay card number [CARD] today, or card number [CARD] now" and text[102] == "see [CARD] [CARD] there"
    assert text[103] == "call [PHONE] [IP] or 1234567890123456" and text[0] == "Please pay card number [CARD] today, said 0a"
    assert pii.find_pii(docs_frame(spark, [])).count() == 0 and pii.redact(docs_frame(spark, [(1, None)])).collect()[0].text is None


def test_pii_graph_equals_plain_version(spark):
    rng = random.Random(24)
    rows = [(f"v{rng.randrange(40)}", rng.choice([None, None, 0, 2]), [f"p{rng.randrange(12)}" for _ in range(3)]) for _ in range(120)]
    got = {r.value: (r.no, r.score) for r in pii.discover(spark.createDataFrame(rows, "value string, no int, patterns array<string>"), confidence=0.3, floor=0.2).collect()}
    links, seeds = {(v, p) for v, _, ps in rows for p in ps}, {}
    for v, no, _ in rows:
        if no is not None:
            seeds[v] = min(no, seeds.get(v, no))
    known = {v: [float(no == k) for k in range(4)] for v, no in seeds.items()}
    for _ in range(4):
        score = {p: [sum(known.get(v, [0] * 4)[k] for v, q in links if q == p) / (sum(q == p for _, q in links) + 2) for k in range(4)] for _, p in links}
        new = {}
        for v in {v for v, _ in links} - set(seeds):
            new[v] = [1 - np.prod([1 - score[p][k] for w, p in links if w == v and score[p][k] >= 0.2] or [1]) for k in range(4)]
        known = {v: known[v] for v in seeds} | new
    want = {v: max((s, -k) for k, s in enumerate(x)) for v, x in known.items() if v not in seeds}
    want = {v: (-k, s) for v, (s, k) in want.items() if s >= 0.3}
    assert set(got) == set(want) and want
    assert all(got[v][0] == want[v][0] and got[v][1] == pytest.approx(want[v][1]) for v in want)


# 5


def test_mixing(spark, data):
    docs = table(spark, data, "documents")
    odd = docs_frame(spark, [(4, "a b c"), (None, "x y"), (None, "x y"), (10**6, None), (10**6, None), (10**6 + 1, "w " * 30_000)])
    frame = docs.unionByName(odd)
    rows = mixing.mix(frame).collect()
    assert len(rows) == frame.count() and all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    result = lambda rows: collections.Counter((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows)
    assert result(rows) == result(mixing.mix(frame.repartition(7)).collect())
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source_size, r.target].append(r)
    for (size, target), own in by.items():
        assert target <= 2 * size and abs(sum(r.taken for r in own) - target) <= max([r.size for r in own], default=0)
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(s for s, _ in by))
    assert mixing.mix(frame.where("false")).count() == 0
    taken = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    assert {r.doc_id: r.copies for r in mixing.mixed(docs).collect()} == taken
    assert mixing.mixed(docs_frame(spark, [(1, "a b"), (2, "c d")], clash=True)).columns == docs_frame(spark, [], clash=True).columns


def test_mixing_includes_by_probability(spark):
    """Over 60 sources with 30 documents of each of six sizes, sizes come in as often as their expected copies say."""
    sizes = [4, 9, 25, 49, 81, 121]
    rows = [(1000 * s + 30 * k + j, "w " * n, "en", f"s{s:03d}", 0) for s in range(60) for k, n in enumerate(sizes) for j in range(30)]
    frame = spark.createDataFrame(rows, DOCS).repartition(4)
    for share in (0.6, 1.8):
        times, target = collections.Counter(), share * 30 * sum(sizes)
        for r in mixing.mix(frame, weights=(1,), share=share).collect():
            assert r.target == pytest.approx(target) and r.copies <= 2
            times[r.size] += r.copies
        over: list[int] = []  # these stop at two copies
        while True:
            level = (target - 60 * sum(over)) / (30 * sum(n**1.5 for n in sizes if n not in over))
            if not (more := [n for n in sizes if n not in over and n**0.5 * level > 2]):
                break
            over += more
        assert bool(over) == (share == 1.8)
        for n in sizes:
            assert times[n] / 1800 == pytest.approx(min(2, n**0.5 * level), abs=0.04)
    assert {r.copies for r in mixing.mix(frame, weights=(1,), share=2.0).collect()} == {2}


def test_ranked(spark):
    rows = spark.createDataFrame([(f"s{i:03d}",) for i in range(200)] + [(None,)], "s string").repartition(5)
    got = [(r.s, r["rank"]) for r in mixing.ranked(rows, F.col("s").asc_nulls_last()).orderBy("rank").collect()]
    assert got == [(f"s{i:03d}", i) for i in range(200)] + [(None, 200)]


# 6


def test_secrets(spark, texts):
    rng = random.Random(6)
    planted = {10**6 + i: f'cfg api_key = "{"".join(rng.choice("abcdef0123456789") for _ in range(32))}" done' for i in range(20)}
    plain = {2 * 10**6 + i: f"order number {rng.randrange(10**17, 10**18)} and changeme_example_password_1 there" for i in range(20)}
    docs = {**texts, **planted, **plain, 3 * 10**6: None, 3 * 10**6 + 1: ""}
    frame = docs_frame(spark, docs.items(), clash=True)
    rows = secrets.find_secrets(frame).collect()
    assert all(docs[r.doc_id][r.start : r.end] == r.value and 0 <= r.score <= 1 for r in rows)
    got = {(r.doc_id, r.value) for r in rows if r.is_secret}
    want = {(k, m[1]) for k, t in docs.items() for m in re.finditer(r'(?i)(?:token|api_key) = "([0-9a-f]{32,40})"', t or "")}
    assert got == want
    clean = secrets.redact(frame)
    assert clean.columns == frame.columns and clean.count() == len(docs)
    for r in clean.collect():
        expected = docs[r.doc_id]
        for k, v in want:
            expected = expected.replace(v, "[SECRET]") if k == r.doc_id else expected
        assert r.text == expected and (expected == docs[r.doc_id] or r.n_chars == len(expected))
    assert secrets.find_secrets(frame.where("false")).count() == 0


def test_secrets_in_assignments_and_addresses(spark, texts):
    rng = random.Random(16)
    key = lambda n, of="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(rng.choice(of) for _ in range(n))
    forms = [
        ("API_KEY={} # env", lambda: key(32, "0123456789abcdef")),
        ("export SERVICE_2_PRODUCTION_SECRET={}\nnext", lambda: key(30) + "7=="),
        ("GITHUB_TOKEN={}", lambda: "ghp_" + key(35) + "5"),
        ("see https://api.host.org/v1/items?access_token={}&page=2 there", lambda: "eyJ" + key(20) + "." + key(40) + "1"),
        ("get https://files.host.org/download/2024/{}/data now", lambda: "AKIA" + key(15, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") + "7"),
        ("AWS_SECRET_ACCESS_KEY={}", lambda: key(39) + "9"),
        ("DB_PASSWORD={} in use", lambda: key(9) + "7"),
        ('"client_secret": "{}",', lambda: key(32)),
        ("X-Api-Key: {}", lambda: key(32, "0123456789abcdef")),
    ]
    docs, want = dict(texts), set()
    for i in range(135):
        form, value = forms[i % 9][0], forms[i % 9][1]()
        docs[10**6 + i] = "notes " + form.format(value)
        want.add((10**6 + i, value))
    rows = secrets.find_secrets(docs_frame(spark, docs.items())).collect()
    assert all((docs[r.doc_id] or "")[r.start : r.end] == r.value for r in rows)
    got = {(r.doc_id, r.value) for r in rows if r.is_secret and r.doc_id >= 10**6}
    assert not got - want and len(want - got) <= 0.04 * len(want), want - got
    want &= got
    clean = {r.doc_id: r.text for r in secrets.redact(docs_frame(spark, docs.items())).where("doc_id >= 1000000").collect()}
    assert all(v not in clean[d] and "[SECRET]" in clean[d] for d, v in want)


def test_forest_removes_false_positives(spark, data):
    """On findings planted in other texts with other values, the forest beats the rule that the scanner starts from, at
    no loss worth naming; it is learnt from planted labels only."""
    docs = table(spark, data, "documents")
    words = secrets.dictionary(docs)
    assert 100 < len(words) <= 500 and "that" in words
    planted = lambda version, hosts: secrets.with_labels(secrets.labelled_findings(docs, hosts, version), words)
    model = secrets.train(planted("v1", 60))
    rows = model.transform(planted("held out", 60).withColumn("v", secrets.array_to_vector("f"))).select("value", "before", "secret", "prediction", "f").collect()
    at = {n: k for k, n in enumerate(secrets.FEATURES)}
    share = lambda rows, test: np.mean([test(r) for r in rows])
    bad, good = [r for r in rows if r.secret == 0], [r for r in rows if r.secret == 1]
    assert len(bad) > 500 and len(good) > 500
    rule = lambda r: r.f[at["key_word"]] == 1 or r.f[at["prefix"]] == 1
    assert share(good, lambda r: r.prediction == 1) > 0.97 and share(bad, lambda r: r.prediction == 1) < 0.03
    assert share(bad, rule) > 0.1
    assert all(len({r.f[k] for r in rows}) > 1 for k in range(len(secrets.FEATURES)))  # no constant feature


def test_secrets_odd_rows(spark, texts):
    key = "9f86d081884c7d659a2feaa0c55ad015"
    docs = list(texts.items()) + [(None, f'api_key = "{key}"'), (None, "innocent"), (10**6, f'api_key = "{key}"'), (10**6, "innocent"), (10**6, f'api_key = "{key}"'), (10**6, None), (10**6, "")]
    frame = docs_frame(spark, docs, clash=True).withColumnRenamed("text", "body")
    out = secrets.redact(frame, text_col="body")
    assert out.columns == frame.columns
    got = collections.Counter((r.doc_id, r.body) for r in out.where("doc_id is null or doc_id >= 1000000").collect())
    assert got == collections.Counter({(None, 'api_key = "[SECRET]"'): 1, (None, "innocent"): 1, (10**6, 'api_key = "[SECRET]"'): 2, (10**6, "innocent"): 1, (10**6, None): 1, (10**6, ""): 1})


# 7


def test_embeddings(spark, data):
    rng = np.random.default_rng(7)
    v = rng.standard_normal((60, 8))
    near = v[:20] + 0.05 * rng.standard_normal((20, 8))
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)] + [(100 + i, x.tolist(), i % 3) for i, x in enumerate(near)]
    rows += [(200 + i, v[0].tolist(), 0) for i in range(700)] + [(1000 + i, (v[1] + 1e-3 * rng.standard_normal(8)).tolist(), 1) for i in range(900)]
    rows += [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 8, 1), (9003, [None] + [1.0] * 7, 1), (9004, [float("nan")] * 8, 1), (9005, [float("inf")] * 8, 1), (9006, v[2].tolist(), None), (9007, v[2].tolist()[:7], 2), (9008, (v[2] * 1e-30).tolist(), 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit(1)).withColumn("weight", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.embedding_dedup(frame, tile=100).collect()}
    ok = [(i, np.array(x, float), k) for i, x, k in rows if x and k is not None and i not in (9002, 9003, 9004, 9005)]
    links = collections.Counter()
    pairs = []
    for a in range(len(ok)):
        for b in range(a):
            (i, x, k), (j, y, m) = ok[a], ok[b]
            if k == m and len(x) == len(y) and (x @ y) / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    want = classes([r[0] for r in rows], pairs)
    assert got == {i: (links[i], want[i], want[i] == i) for i in want}
    bits, tables = embed_dedup.plan(100_000_000, 0.93)
    assert (bits, tables) > embed_dedup.plan(1_000, 0.93) and 1e-3 > (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** tables
    assert embed_dedup.embedding_dedup(frame.where("false")).count() == 0


# 8


def simple_fingerprint(t, k, seed=42):
    import xxhash

    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_equals_brute_force(spark, texts):
    docs = {**texts, 10**6: None, 10**6 + 1: "", 10**6 + 2: "\x1c É one", 10**6 + 3: "one"}
    for k in (1, 3):
        assert all(simhash.fingerprint(t, k)[0] & (2**64 - 1) == simple_fingerprint(t, k) for t in docs.values())
    for radius in (3, 12):
        rows = simhash.simhash_components(docs_frame(spark, docs.items(), clash=True), radius=radius).collect()
        f = {i: simple_fingerprint(t, 3) for i, t in docs.items()}
        ids = sorted(f)
        want = classes(ids, [(a, b) for a in ids for b in ids if a < b and (f[a] ^ f[b]).bit_count() <= radius])
        assert {r.doc_id: r.component_id for r in rows} == want


def test_near_pairs_is_exact():
    rng = np.random.default_rng(8)
    for width, radius in ((1, 3), (1, 20), (3, 60)):
        a = rng.integers(0, 2**64, (700, width), dtype=np.uint64)
        b = np.concatenate([rng.integers(0, 2**64, (500, width), dtype=np.uint64), a[:200] ^ np.uint64(5)])
        want = {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ b[None]).sum(2) <= radius), strict=True)}
        got = [(i, j) for x, y in simhash.near_pairs(a, b, radius) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_simhash_dedup(spark):
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = words(300)
    near = base[:]
    near[150] = "other"
    rows = [(5, " ".join(base)), (3, " ".join(base)), (7, " ".join(near)), (8, " ".join(words(300))), (8, " ".join(base)), (None, " ".join(base)), (9, None), (11, ""), (12, "x"), (12, "x")]
    frame = docs_frame(spark, rows, clash=True)
    out = simhash.simhash_dedup(frame)
    assert out.columns == frame.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter([3, 8, 9, 12, None])
    assert simhash.simhash_dedup(frame.where("false")).count() == 0


def test_simhash_dedup_computes_similarity(spark):
    rng = random.Random(19)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    docs = {}
    for k, tail in enumerate([*[8] * 12, *[17] * 12, *[22] * 12, *[28] * 12, *[36] * 12, *[45] * 12]):  # similarity 0.92 to 0.63
        base = words(200)
        docs[2 * k], docs[2 * k + 1] = base, base[: 200 - tail] + words(tail)
    for k in range(20):  # four shingles, one of them changed: 0.6
        base = words(8)
        docs[1000 + 2 * k], docs[1001 + 2 * k] = base, [*base[:7], "other"]
    base = words(100)
    for k in range(30):  # a chain
        docs[2000 + k] = base[k : k + 60]
    grams = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in docs.items()}
    ids = sorted(docs)
    want = classes(ids, [(a, b) for a in ids for b in ids if a < b and 10 * len(grams[a] & grams[b]) >= 8 * len(grams[a] | grams[b])])
    assert 0.2 < sum(want[i] == i for i in ids) / len(ids) < 0.9
    frame = docs_frame(spark, [(i, " ".join(w)) for i, w in docs.items()], clash=True)
    for tile, part in ((2048, 512), (16, 4)):
        assert sorted(r.doc_id for r in simhash.simhash_dedup(frame, tile=tile, part=part).collect()) == sorted(set(want.values()))


def test_sketches():
    rng = np.random.default_rng(23)
    shared, apart = 0, 0
    for _ in range(400):  # similarity 0.8, in sets of 18 to 4,500
        n = int(rng.choice([2, 50, 500]))
        h = rng.integers(0, 2**64, 10 * n, dtype=np.uint64)
        a, b = h[: 9 * n], h[n:]
        shared += bool(set(simhash.sketches(a, 14, 4)) & set(simhash.sketches(b, 14, 4)))
        apart += bool(set(simhash.sketches(h[: 5 * n], 14, 4)) & set(simhash.sketches(h[5 * n :], 14, 4)))
        assert simhash.sketches(a, 14, 4) == simhash.sketches(a[::-1].copy(), 14, 4)
    assert shared >= 397 and apart == 0 and simhash.sketches(h[:0], 14, 4) == []


# 9


def test_quality(spark, data):
    data = data.replace("sf0.001", "sf0.01")  # enough labels to hold some out
    docs = table(spark, data, "documents").unionByName(docs_frame(spark, [(10**6, None), (10**6 + 1, ""), (None, "x")]))
    labels = table(spark, data, "labels")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    score = [(r.score, truth[r.doc_id]) for r in rows if r.doc_id in truth and r.held_out]
    wins = [a > b for a, x in score if x == 1 for b, y in score if y == 0]
    assert np.mean(wins) > 0.97
    assert np.mean([(s >= 0.3) == (q == 1) for s, q in score]) > 0.9
    flipped = labels.where(quality.held_out(F.col("doc_id"))).withColumn("quality", 1 - F.col("quality"))
    others = labels.where(~quality.held_out(F.col("doc_id")))
    again = {r.doc_id: r.score for r in quality.quality_scores(docs, others.unionByName(flipped)).collect()}
    assert again == {r.doc_id: r.score for r in rows}  # labels that are held out have no part in it
    assert {round(r.score, 9) for r in quality.quality_scores(docs, labels.where("false")).collect()} == {0.3}
    assert quality.quality_scores(docs.where("false"), labels).count() == 0


def test_keep_good(spark, data):
    """The rows that stay are those whose scores say so, with columns and repeats as they were."""
    data = data.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    one = docs.where("doc_id = 1").first().text
    odd = [(10**6, None), (10**6, one), (10**6, one), (None, one), (None, "$$$ ### !!!"), (10**6 + 1, "")]
    frame = docs.unionByName(docs_frame(spark, odd)).select("*", *[F.lit(v).alias(k) for k, v in CLASH.items()], F.lit(1).alias("_features"), F.lit(2).alias("f"))
    scores = {}
    for r, s in zip(*(sorted(x.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)) for x in (docs, quality.quality_scores(docs, labels))), strict=True):
        scores[r.text] = s.predicted
    kept = quality.keep_good(frame, labels)
    assert kept.columns == frame.columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert {k: n for k, n in got.items() if k[0] is not None and k[0] < 10**6} == {(r.doc_id, r.text): 1 for r in docs.collect() if scores[r.text]}
    assert scores[one] and got[10**6, one] == 2 and got[None, one] == 1 and got[None, "$$$ ### !!!"] == 0
    assert quality.keep_good(frame, labels.where("false")).count() == frame.count() and quality.keep_good(frame.where("false"), labels).count() == 0


# 10


def test_substring(spark, texts):
    rng = random.Random(10)
    sentence = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 12))).capitalize() + ". "
    passage = "".join(sentence() for _ in range(8))
    long_ = " ".join(f"v{rng.randrange(10**6)}" for _ in range(120))
    rows = [(1, sentence() + passage + sentence()), (2, sentence() + passage.upper() + "end."), (3, "A b. C d. "), (3, "A b. C d. "), (4, "A  B. c d."), (13, "A b. C d. E. F g. "), (14, "So. C d. E. F g. There."), (5, None), (6, ""), (None, passage), (2, "All. Other words. Here stand."), (7, "start " + long_ + " stop here. "), (8, "other words first " + long_ + " tail."), (9, passage + passage)]
    got = {r.doc_id: r for r in substring.substring_dedup(docs_frame(spark, rows, clash=True)).collect()}
    assert set(got) == {2, 4, 8, 9, 14, None} and not got[None].text  # a text without id takes part, after all others
    src = dict(rows) | {2: rows[1][1]}
    assert got[14].text == "So. There." and not got[4].text and src[2] != rows[-4][1]
    for i, r in got.items():
        kept, at = "", 0
        for s in r.removed:
            kept, at = kept + src[i][at : s.start], s.end
        assert kept + src[i][at:] == r.text
    assert got[2].text.endswith("end.") and passage.upper()[:30] not in got[2].text and not got[9].text.strip()
    assert len(got[8].text.split()) < 60
    assert all("".join(t[s:e] for s, e in substring.sentences(t)) == t for t in texts.values())
    assert substring.substring_dedup(docs_frame(spark, [])).count() == 0


def test_substring_equals_brute_force(spark, texts):
    seen, want = {}, collections.defaultdict(set)
    for d in sorted(texts):
        units = [" ".join(texts[d][s:e].lower().split()) for s, e in substring.sentences(texts[d])]
        for i in range(len(units) - 1):
            for n in (2, 3):
                part = units[i : i + n]
                if units[i] and len(part) == n and (n == 3 or len(" ".join(part).split()) >= 15 or len(units) == n):
                    if tuple(part) in seen:
                        want[d] |= set(range(i, i + n))
                    seen.setdefault(tuple(part), (d, i))
    got = {r.doc_id: r.n_removed for r in substring.substring_dedup(docs_frame(spark, texts.items())).collect()}
    assert got == {d: len(s) for d, s in want.items()}


def test_digest_is_base32(spark, data):
    row = queries.op1_warc(spark, data).orderBy("page_id").first()
    html = table(spark, data, "pages").orderBy("page_id").first().html
    assert row.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
