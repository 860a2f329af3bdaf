"""Prefix trie, token output and token alignment against plain versions, and their results on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlens.llm import align, ans, scans, tokens, trie
from arborlens.llm.chunks import Memo, byte_letters, encoder, pieces
from arborlens.llm.work import new_path, table

ODD = [
    None, "", " ", "  ", "\n", "a\tb \t c", "x \n y\n\n z ", "<|endoftext|> <s> </s> <unk>", "▁ a", "é ünïcode 漢字かな交じり　全角", "don't we'll  I'm", "a\x1c b\x00c", "tail  ",
    "\r\nline\r\n", "🙂🙂 ok", "a" * 3000, "  nb   x", "ﬁ ligature", "École İstanbul ΣΑΣ straße", "word " * 400,
]


# running numbers and XORs


def test_running(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.getrandbits(60) - (1 << 59)) for g, n in ((1, 3000), (2, 1), (-7, 40), (9, 300)) for i in range(n)]
    rng.shuffle(rows)
    got = scans.running(spark.createDataFrame(rows, "g long, i long, x long").repartition(3), "g", ["i"], "no", ("x",)).collect()
    want, held = {}, {}
    for g, i, x in sorted(rows):
        held[g] = held.get(g, 0) ^ x
        want[g, i] = (i + 1, held[g])
    assert {(r.g, r.i): (r.no, r.x) for r in got} == want
    assert scans.running(spark.createDataFrame([], "g long, i long"), "g", ["i"], "no").count() == 0


# prefix trie


def plain_trie(convs):
    """conv -> [(role, text), ...], root and all prefixes, one by one."""
    members, ends = collections.defaultdict(set), collections.defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].add(c)
    children = collections.Counter(k[:-1] for k in members if k)
    out = set()
    for k, own in members.items():
        below = [n for n in members if n[: len(k)] == k]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        leaves = sum(children[n] == 0 for n in below)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out.add((min(own), len(k), min(members[k[:-1]]) if k else None, len(own), children[k], leaves, saved, digest))
    return out


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_trie_of_branching_conversations(spark):
    """A first turn that most share, long common chains, equal conversations, and one of many turns of its own."""
    rng = random.Random(2)
    convs = {}
    for c in range(400):
        turns = [("user", "hello")] if c % 5 else []
        for _ in range(rng.randrange(6)):
            turns.append((rng.choice("ua"), rng.choice(["x", "yy", "zzz"])))
        convs[c - 50] = turns
    for c in range(1000, 1040):
        convs[c] = [("user", f"chain {i}") for i in range(80 if c % 2 else 70)]
    convs[5000] = [("user", f"own {i}") for i in range(900)]
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    held = {c: t for c, t in convs.items() if t}
    got = trie.prefix_trie(trie.paths(trie.numbered_turns(conversations(spark, rows).repartition(5))))
    assert {tuple(r) for r in got.collect()} == plain_trie(held)


def test_trie_with_shared_openings(spark):
    rng = random.Random(4)
    own = {c: [(rng.choice("ua"), rng.choice(["", "b", "cc"])) for _ in range(rng.randrange(1, 9))] for c in [*range(0, 130), 205, 207, -150, -50, -49, 300, 301]}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(c / 100) * 100  # towards zero, as the remainder is
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    rows = [(c, i, r, t) for c, turns in own.items() for i, (r, t) in enumerate(turns)]
    got = trie.prefix_trie(trie.with_shared_openings(trie.numbered_turns(conversations(spark, rows))))
    assert {tuple(r) for r in got.collect()} == plain_trie(rebuilt)


def test_trie_on_odd_rows(spark):
    rows = [(1, None, "user", None), (1, 0, None, "x"), (1, 0, None, "x"), (2, None, "user", ""), (None, 1, "user", "lost"), (2, 7, "", "x"), (2, 7, "", "x"), (3, 1, "u", "long " * 50_000)]
    frame = conversations(spark, rows).select("*", F.lit(1).alias("depth"), F.lit(2).alias("k1"), F.lit(3).alias("place"))
    got = {tuple(r) for r in trie.prefix_trie(trie.paths(trie.numbered_turns(frame))).collect()}
    assert got == plain_trie({1: [("user", ""), ("", "x"), ("", "x")], 2: [("user", ""), ("", "x"), ("", "x")], 3: [("u", "long " * 50_000)]})
    assert trie.prefix_trie(trie.with_shared_openings(trie.numbered_turns(frame.limit(0)))).count() == 0


def test_node_table():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5000):
        k1, k2 = rng.integers(-(2**63), 2**63 - 1, n), rng.integers(0, 3, n)
        t = trie.NodeTable(k1, k2)
        assert sorted(t.slots) == list(range(n)) and np.array_equal(t.find(k1, k2), t.slots)
        assert (t.find(k1, k2 + 7) == -1).all()
    with pytest.raises(ValueError):
        trie.NodeTable(np.array([5, 5]), np.array([1, 1]))


# token output


@pytest.mark.parametrize("n,most", [(0, 3), (1, 1), (700, 50), (40_000, 49_000)])
def test_blocks_decode(n, most):
    rng = np.random.default_rng(n)
    ids = ((rng.zipf(1.3, n) - 1) % most).astype(np.uint32)
    t = ans.Table(ans.quantize(np.bincount(ids, minlength=most)), 18)
    data = ans.encode_block(ids, t, lanes=64, every=16)
    assert np.array_equal(ans.decode_block(data, t), ids)
    for k in range(ans.segments(data)):  # each segment by itself
        assert np.array_equal(ans.decode_block(data, t, k, k + 1), ids[k * 1024 : (k + 1) * 1024])


@pytest.mark.parametrize("n", [0, 7, 8, 31, 32, 33, 60, 65, 4000])
def test_blocks_side_by_side_are_those_by_themselves(n):
    rng = np.random.default_rng(n)
    blocks = [((rng.zipf(1.3, n) - 1) % 900).astype(np.uint32) for _ in range(3)]
    t = ans.Table(ans.quantize(np.bincount(np.concatenate(blocks), minlength=900)), 18)
    coded = ans.encode_blocks(blocks, t, lanes=8, every=4)
    assert coded == [ans.encode_block(ids, t, lanes=8, every=4) for ids in blocks]
    for ids, data in zip(blocks, coded, strict=True):
        for a in range(0, ans.segments(data), 3):  # several segments from any checkpoint
            for b in (a + 1, a + 2, ans.segments(data)):
                assert np.array_equal(ans.decode_block(data, t, a, b), ids[a * 32 : b * 32])


def test_damage_is_seen():
    ids = np.arange(3000, dtype=np.uint32) % 40
    t = ans.Table(ans.quantize(np.bincount(ids)), 18)
    data = bytearray(ans.encode_block(ids, t))
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        ans.decode_block(bytes(data), t)
    with pytest.raises(ValueError):
        ans.decode_block(bytes(ans.encode_block(ids, t)), ans.Table(ans.quantize(np.bincount(ids) + np.arange(40)), 18))


def test_frequencies_add_up():
    for counts in ([1], [10**9, 1, 1], [1] * 2000, [10**12, *[1] * 5000, 0]):
        f = ans.quantize(np.array(counts), 13)
        assert f.sum() == 1 << 13 and ((f > 0) == (np.array(counts) > 0)).all()
    with pytest.raises(ValueError):
        ans.quantize(np.ones(9), 3)


def test_chunks_give_the_ids_of_whole_texts(texts_of):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.TOKENIZER)
    texts = [t or "" for t in ODD] + texts_of[:150]
    for size in (40, 1 << 18):
        memo, got = Memo(encoder(own, most=50), most=300), collections.defaultdict(list)
        for no, ids, _ in tokens.text_ids(texts, memo, 1, size):
            got[no] += ids.tolist()
        for no, text in enumerate(texts):
            assert got[no] == own.encode(text, add_special_tokens=False).ids + [1], text[:80]


def test_frequent_chunks_are_encoded_once():
    """However many rare ones pass by: a memo that is full keeps what was asked for last."""
    from tokenizers import Tokenizer

    encode, asked = encoder(Tokenizer.from_file(tokens.TOKENIZER)), collections.Counter()

    def counted(chunks):
        asked.update(chunks)
        return encode(chunks)

    memo = Memo(counted, most=100)
    for k in range(50):
        assert len(list(tokens.text_ids([f"common words {k}rare{j}" for j in range(40)], memo, 1))) == 40
    assert asked["common"] == asked["words"] == 1 and len(asked) == 2 + 50 * 40 and len(memo.index) <= 100


def test_a_worker_keeps_its_vocabulary():
    assert tokens._held(tokens.TOKENIZER, 1)[0] is tokens._held(tokens.TOKENIZER, 1)[0]
    assert tokens._held(tokens.TOKENIZER, 1)[0] is not tokens._held(tokens.TOKENIZER, 2)[0]


@pytest.mark.parametrize("path,specials", [(tokens.TOKENIZER, True), (align.BYTE_LEVEL, False)])
def test_encoder_gives_the_ids_of_the_tokenizer(path, specials):
    """Each character up to U+0370 and some beyond, in words, between marks and beside what composes with it."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = not specials
    signs = [c for c in map(chr, [*range(0x370), 0x1E96, 0x2028, 0x212B, 0x2C65, 0x3000, 0x4E2D, 0xFB01, 0x1F600])]
    chunks = [x for c in signs for x in (c, f"Ab{c}", f"{c}cD.", f"x{c}1{c}", f"'S{c}")] + ["", "H\u0331", "E\u0301a", "it's'Ll", "a<|endoftext|>b", "<|ENDOFTEXT|>", "12a345", "word", "word"]
    chunks += [f" {c}" for c in chunks] if not specials else []
    encode = encoder(own, most=70, specials=specials)
    whole = [e.ids for e in own.encode_batch_fast(chunks, add_special_tokens=False)]
    ids, n = encode(chunks)
    ends = np.cumsum(n).tolist()
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == whole
    which = np.array([5, 5, len(chunks) - 1, 0, 700])
    ids, n = encode(chunks, which)
    assert ids.tolist() == [x for k in which for x in whole[k]] and n.tolist() == [len(whole[k]) for k in which]
    assert encode([])[0].tolist() == []


def test_pieces_join():
    text = "ab c\nd  efg h " * 50
    for size in (1, 7, 100):
        parts = list(pieces(text, size))
        assert "".join(p for p, _ in parts) == text and [last for _, last in parts] == [False] * (len(parts) - 1) + [True]
    assert list(pieces("")) == [("", True)]


def test_crc32_of_parts():
    rng = random.Random(1)
    parts = [rng.randbytes(rng.randrange(0, 900)) for _ in range(6)]
    assert tokens.crc32_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


@pytest.fixture(scope="module")
def texts_of(spark, data):
    return [r.text or "" for r in table(spark, data, "documents").collect()]


def test_token_set_round_trip(spark, texts_of):
    """Documents over several small blocks, null and repeated ids, other columns; then parts of the stream from checkpoints."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.TOKENIZER)
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, "no id either"), (6, "the same id"), (6, "the same id")] + [(1000 + i, t) for i, t in enumerate(texts_of[:60])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(9).alias("ids"), F.lit(8).alias("shard")).repartition(3)
    path = new_path(spark, "tokens")
    tokens.write_tokens(frame, path, block=700, lanes=8, every=16)
    ids = lambda t: own.encode(t or "", add_special_tokens=False).ids + [1]
    parts = collections.defaultdict(list)
    for r in tokens.read_pieces(spark, path, blocks_a_task=5).collect():
        parts[r.shard, r.doc_no].append(r)
    docs = sorted((sorted(p, key=lambda r: r.pos) for p in parts.values()), key=lambda p: p[0].start)
    stream, at = [], 0
    for p in docs:
        assert p[0].start == at and [r.last for r in p] == [False] * (len(p) - 1) + [True]
        p_ids = [x for r in p for x in r.ids]
        at += len(p_ids)
        stream += p_ids
    order = [p[0].doc_id for p in docs]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:])
    assert max(map(len, docs)) > 2
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.read_documents(spark, path).collect())
    assert got == collections.Counter((i, len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t in rows)
    for start, n in ((0, 5), (690, 30), (1500, 2000), (at - 3, 3)):
        found = [x for r in sorted(tokens.token_range(spark, path, start, n).collect(), key=lambda r: r.start) for x in r.ids]
        assert found == stream[start : start + n]


def test_token_set_of_nothing(spark):
    path = new_path(spark, "tokens")
    tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path)
    assert tokens.read_documents(spark, path).count() == 0 and tokens.read_pieces(spark, path).count() == 0


# token alignment


def plain_alignments(texts):
    """Spans of tokens, side by side."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(align.BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=align.PIECES)
    byte_of = {letter: k for k, letter in enumerate(byte_letters())}
    docs, count = {}, collections.Counter()
    for i, t in texts.items():
        docs[i] = None
        if not t:
            continue
        ai, bi = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        at, bt = [bytes(byte_of[c] for c in a.id_to_token(x)) for x in ai], []
        for x in bi:
            p = b.id_to_piece(x)
            bt.append(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode())
        if not b"".join(at) == b"".join(bt) == (" " + t).encode():
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in (at, bt)]
        starts = [[0, *e[:-1]] for e in ends]
        links, j = [], 0
        for k in range(len(ai)):
            while ends[1][j] <= starts[0][k]:
                j += 1
            q = j
            while q < len(bi) and starts[1][q] < ends[0][k]:
                links.append((ai[k], bi[q]))
                q += 1
        x = y = within = 0
        shown = []
        for c in sorted(set(ends[0]) & set(ends[1])):
            u, v = x, y
            while x < len(ai) and ends[0][x] <= c:
                x += 1
            while y < len(bi) and ends[1][y] <= c:
                y += 1
            shown.append(",".join(map(str, ai[u:x])) + "|" + ",".join(map(str, bi[v:y])))
            within += (x - u) * (y - v)
        docs[i] = (len(ai), len(bi), len(shown), links, within, hashlib.sha256(";".join(shown).encode()).hexdigest())
        count.update(links)
    high = collections.Counter()
    for (_, y), n in count.items():
        high[y] = max(high[y], n)
    rows = set()
    for i, d in docs.items():
        if d is None:
            rows.add((i, *[0] * 7, ""))
        else:
            rows.add((i, d[0], d[1], d[2], len(d[3]), d[4], sum(count[p] == high[p[1]] for p in d[3]), sum(count[p] for p in d[3]), d[5]))
    return rows


def test_alignment_of_documents_and_odd_texts(spark, texts_of):
    """Small blocks, so that pairs of many blocks add up."""
    texts = dict(enumerate([*ODD, *texts_of[:60], texts_of[0]]))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").select("*", F.lit(1).alias("block"), F.lit(2).alias("pair"), F.lit(3).alias("total")).repartition(3)
    got = {tuple(r) for r in align.alignments(frame, block_chars=4000, most_chunks=900).collect()}
    assert got == plain_alignments(texts)
    assert align.alignments(frame.limit(0)).count() == 0


def test_alignment_of_null_ids_and_repeated_rows(spark):
    rows = [(None, "same words here"), (None, "same words here"), (4, "same words here"), (4, None)]
    got = collections.Counter(tuple(r) for r in align.alignments(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    (one,) = plain_alignments({4: "same words here"})
    n = one[7] * 3  # each pair is linked in three texts
    assert got == collections.Counter({(None, *one[1:7], n, one[8]): 2, (4, *one[1:7], n, one[8]): 1, (4, *[0] * 7, ""): 1})


def _words(n):
    rng = random.Random(11)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 12))) for _ in range(n)]


def test_alignment_blocks_end_inside_a_batch(spark):
    """A block holds block_chars characters and one document more at most, and few blocks lie in a file."""
    words = _words(30000)
    texts = {k: " ".join(words[k * 200 : k * 200 + 200]) for k in range(150)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    blocks = align.aligned_blocks(frame, block_chars=9000, most_chunks=3000).select("doc_ids", F.input_file_name().alias("file")).collect()
    assert sorted(i for b in blocks for i in b.doc_ids) == sorted(texts)
    assert max(sum(len(texts[i]) for i in b.doc_ids) for b in blocks) <= 9000 + max(map(len, texts.values()))
    assert max(collections.Counter(b.file for b in blocks).values()) <= 4


def test_alignment_of_many_new_chunks_takes_little_memory():
    """Besides what stays held, memory for new chunks does not follow their number."""
    import tracemalloc

    chunks = align._Chunks(align.BYTE_LEVEL, align.PIECES)
    new = [" " + w for w in _words(40000)]
    tracemalloc.start()
    try:
        chunks.numbers(new)
        held, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak - held < 15e6, (held, peak)


def test_trimmed_alignments_are_those_of_all():
    """Chunks that a trim keeps, and those that come again after it."""
    words = [" " + w for w in _words(300)]
    chunks = align._Chunks(align.BYTE_LEVEL, align.PIECES)
    of = lambda numbers: [(chunks.text[k], list(chunks.sizes[5 * k : 5 * k + 5]), list(chunks.links[chunks.ptr[k] : chunks.ptr[k + 1]])) for k in numbers.tolist()]
    all_ = of(chunks.numbers(words))
    block = align._Block(chunks)
    block.push([1, 2], ["".join(words[:120])[1:] + "".join(words[50:100]), "".join(words[60:90])[1:]])
    block.row(0)
    chunks.trim(40)
    assert {*words[61:90]} <= {*chunks.index} <= {*words[50:100]} and len(chunks.index) == 40 == len(chunks.text)
    assert of(chunks.numbers(words)) == all_


def test_products_are_those_of_dense_matrices():
    rng = np.random.default_rng(3)
    for block in (1, 5, 1000):
        a, b = rng.random((7, 9)) < 0.4, rng.random((9, 6)) < 0.4
        csr = lambda m: (np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1])
        out = np.zeros((7, 6), int)
        for row, ptr, cols, values in align.products(*csr(a), *csr(b), block):
            for k in range(len(ptr) - 1):
                out[row + k, cols[ptr[k] : ptr[k + 1]]] = values[ptr[k] : ptr[k + 1]]
        assert np.array_equal(out, a.astype(int) @ b.astype(int))


# mended operators


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def test_secrets_are_taken_to_their_end(spark, texts_of):
    """Values and addresses of any length, passwords in addresses, issuers' prefixes, and forms that no template has."""
    from arborlens.llm import secrets

    rng = random.Random(8)
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    value = lambda n: "".join(rng.choice(letters) for _ in range(n - 1)) + "7"
    long_, far, user = value(240), value(40), value(14)
    slack, npm = f"xoxb-{rng.randrange(10**11, 10**12)}-{value(24)}", "npm_" + value(36)
    new = {
        1: (f'password = "{long_}" and more', long_), 2: (f"see https://files.host.net/{'d/' * 400}get?access_token={far}&x=1", far), 3: (f"use postgres://admin:{user}@db.host.net/main now", user),
        4: (f"the bot {slack} answers", slack), 5: (f"registry {npm} here", npm), 6: (f"secretKey: '{(own := value(33))}'", own), 7: (f"curl -H 'X-Auth-Token: {(two := value(36))}'", two),
    }
    rows = [(i, t, "src") for i, t in enumerate(texts_of)] + [(10**6 + k, f"notes before {t} and after", "src") for k, (t, _) in new.items()]
    out = {r.doc_id: r.text for r in secrets.redact(_docs(spark, rows)).where("doc_id > 1000000").collect()}
    for k, (t, v) in new.items():
        assert not any(v[i : i + 12] in out[10**6 + k] for i in range(len(v) - 11)), (k, out[10**6 + k])
        assert out[10**6 + k].startswith("notes before ") and out[10**6 + k].endswith(" and after")
    found = secrets.candidates(_docs(spark, rows)).where("doc_id > 1000000").collect()
    whole = {r[0]: r[1] for r in rows}
    assert all(whole[r.doc_id][r.start : r.end] == r.value for r in found)


def test_hosts_of_labels_are_distinct_texts(spark, texts_of):
    from arborlens.llm import secrets

    docs = _docs(spark, [(i, t, "s") for i, t in enumerate(texts_of)] + [(5000 + i, texts_of[0], "s") for i in range(400)])
    n = len({t for t in texts_of if len(re.split(r"\s+", re.sub(r"[^\w\s.,;:!?]+", " ", t))) >= 8})
    assert secrets.labelled_findings(docs, hosts=150).select("doc_id").distinct().count() >= 0.95 * min(150, n) * len(secrets.TEMPLATES)


def test_dictionary_is_exact(spark):
    from arborlens.llm import secrets

    docs = _docs(spark, [(1, "delta alpha alpha beta beta gamma", "s"), (2, "Gamma delta zeta", "s"), (3, None, "s")])
    assert secrets.dictionary(docs, size=3) == ["alpha", "beta", "delta"]


def test_mixed_takes_what_mix_takes(spark):
    """Rows without id, equal rows, and rows with one id."""
    from arborlens.llm import mixing

    rows = [(None, "four words are here", "s")] * 1000 + [(7, f"text {i % 3} of one id", "t") for i in range(60)] + [(None, f"own text {i} " + "w " * (i % 9), "u") for i in range(400)]
    docs = _docs(spark, rows).repartition(5)
    options = {"weights": (1,), "share": 0.4}
    chosen = mixing.mix(docs, **options).collect()
    total = collections.Counter()
    for r in mixing.mixed(docs, **options).collect():
        total[r.source] += r.copies * len(r.text.split())
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    target = {r.source_size: r.target for r in chosen}
    taken = collections.Counter()
    for r in chosen:
        taken[r.source_size] += r.taken
    assert len(target) == 3
    for s, size in sizes.items():
        assert total[s] == taken[size] and abs(total[s] - target[size]) <= 12


def test_vectors_of_any_magnitude_link(spark):
    from arborlens.llm import embed_dedup

    rows = [(1, [1e200, 2e200], 0), (2, [1e-200, 2e-200], 0), (3, [1.0, 2.0], 0), (4, [5e-324, 1e-323], 0), (5, [2.0, -1.0], 0), (6, [1e308, -5e307], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5)}


def test_substring_dedup_of_rows_without_id(spark):
    from arborlens.llm import substring

    text = "First sentence is here. Second one follows it now. Third one ends the run. "
    rows = [(None, text + "Own words stay alone.", "s"), (None, "Other beginning here. " + text, "s"), (9, text, "s")]
    got = [(r.doc_id, r.text.strip()) for r in substring.substring_dedup(_docs(spark, rows)).collect()]
    assert sorted(got, key=str) == [(None, "Other beginning here."), (None, "Own words stay alone.")]
