"""Secret scans: token candidates in whole texts, and a random forest that removes false positives. DataFrame code only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.llm.work import fresh, marked, materialize, text_keys

#: Words that name a secret when they stand before it.
KEY_WORDS = "token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key|client[_-]?secret"
#: Words of placeholders, which a real secret does not hold.
PLACEHOLDERS = ("example", "sample", "test", "dummy", "change", "changeme", "your", "here", "placeholder", "default", "none", "null", "abc", "xyz", "foo", "bar", "xxxx")
#: Prefixes that issuers give their keys.
PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk-|rk_live_|AIza|ya29\.|npm_|eyJ)"
#: A candidate is a run of characters that keys are made of, with a digit or an issuer's prefix, not inside a longer run;
#: or, down to eight characters and without a digit, the value assigned to a word that names a secret.
#: '=' parts a name from its value and belongs to a run only as padding at its end; in an address '/' parts runs too.
RUN = r"[A-Za-z0-9_+/.~-]{16,}"
_PAD = r"(?:={1,2}(?![A-Za-z0-9_+/.~=-]))?"
#: Marks of our own: around a candidate, for '/' in an address, around a password in an address; and what a text's own ones become.
_MARK, _SLASH, _USER, _SAFE = "\ue000", "\ue002", "\ue003", "\ue001"
#: An address's first part up to '/', and from there each further one, however long the address is.
_ADDRESS = r"(://[^\s\"'`<>/]*|\G(?!^)[^\s\"'`<>/]*)/"
_USERINFO = r"(://[^\s/@:\"'`<>]*:)([^\s/@\"'`<>]{4,})(?=@)"
_SET = r"[:=]>?\s{0,2}[\"'`]?"
#: The cheap lookbehinds come first: few places follow a colon or an equals sign.
_ASSIGNED = rf"(?<=[\s=:>\"'`])(?<={_SET})(?<=(?i:{KEY_WORDS})[A-Za-z0-9_]{{0,12}}[\"'`]?\s{{0,2}}[:=]>?\s{{0,2}}[\"'`]?)"
_FIND = (
    rf"{_USER}([^{_USER}]+){_USER}"
    rf"|(?<![A-Za-z0-9_+/.~-])(?!(?<=:)//)(?={RUN})({RUN}{_PAD})"
    rf"|{_ASSIGNED}(?!//)([^\s\"'`<>,;(){{}}\[\]&{_USER}]{{8,}})"
)
FEATURES = (
    "length", "class_changes", "digit_share", "upper_share", "lower_share", "vowel_share", "other_share", "distinct", "hex", "dictionary", "placeholder",
    "prefix", "neighbours", "key_word", "assigned", "hash_word", "quoted", "mail", "path_test", "path_code", "all_digits",
)
#: What findings look like. Label, path (None: the document's own source), what stands before, the kind
#: of value, and what stands after. 1 is a leaked secret, 0 something that a scanner takes for one.
TEMPLATES = (
    (1, None, 'api_key = "', "hex32", '"'), (1, None, 'token = "', "hex40", '"'), (1, None, "API_KEY=", "hex32", ""), (1, None, "secret: ", "base64", ""),
    (1, None, "DB_PASSWORD=", "mixed12", ""), (1, None, 'password = "', "mixed20", '"'), (1, None, "Authorization: Bearer ", "jwt", ""),
    (1, None, "aws_secret_access_key = ", "base40", ""), (1, None, "AWS_ACCESS_KEY_ID=", "aws", ""), (1, None, "see ", "aws", " there"), (1, None, "", "ghp", ""),
    (1, None, "GITHUB_TOKEN=", "ghp", ""), (1, None, "https://api.host.net/v1/items?access_token=", "jwt", "&page=2"), (1, None, "https://files.host.net/get/", "aws", "/data"),
    (1, None, "bot ", "slack", " here"), (1, None, "SLACK_TOKEN=", "slack", ""), (1, None, "registry ", "npm", ""), (1, None, "//registry.host.net/:_authToken=", "npm", ""),
    (1, None, "clone with ", "glpat", ""), (1, None, "pay ", "stripe", ""), (1, None, "maps key ", "google", ""), (1, None, "https://admin:", "mixed12", "@db.host.net/main"),
    (0, None, "export ", "env_name", "=on"), (0, None, "", "env_name", "= "), (0, None, "set ", "env_name", " first"), (0, None, "https://user:", "placeholder", "@host.net/"), (0, None, "proxy http://guest:", "prose", "@10.0.0.1:80"),
    (1, "deploy/prod.env", "CLIENT_SECRET=", "mixed32", ""), (1, "config/settings.py", "AUTH_TOKEN = '", "hex40", "'"), (1, None, "pwd: ", "mixed12", ""),
    (1, None, "export SERVICE_2_SECRET=", "base64", ""), (1, None, '"private_key": "', "base64", '"'), (1, None, "passwd=", "phrase_secret", ""),
    (0, None, "commit ", "hex40", ""), (0, None, "sha256:", "hex64", ""), (0, None, "md5 ", "hex32", " ok"), (0, None, "checksum = ", "hex32", ""), (0, None, "id ", "uuid", ""),
    (0, None, "request_id=", "uuid", ""), (0, None, "order number ", "digits18", ""), (0, None, "card ", "digits16", ""), (0, None, "", "digits16", ""),
    (0, None, "https://www.host.net/2024/05/", "slug", ".html"), (0, None, "/usr/lib/modules/", "slug", "/index"), (0, None, "", "snake", "(x)"), (0, None, "version ", "version", ""),
    (0, None, 'api_key = "', "placeholder", '"'), (0, None, "password = ", "placeholder", ""), (0, None, "TOKEN=", "placeholder", ""), (0, None, "password: ", "prose", ""),
    (0, None, "token: ", "prose", ""), (0, None, "at ", "time", ""), (0, None, "mail to ", "mail", ""), (0, None, "etag ", "hex40", ""), (0, None, "img ", "hex64", ".png"),
    (0, "tests/fixtures/keys.py", 'api_key = "', "hex32", '"'), (0, "docs/example.md", "TOKEN=", "hex40", ""), (0, "tests/test_auth.py", "password = '", "mixed20", "'"),
)
#: Characters of context on either side of a candidate.
AROUND = 48


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, k1, path, start, end, value, before, after of every candidate, in code points of the whole text; k1 names
    the text and its path.

    The text is cut at marks set around the matches, so that pieces alternate and their lengths add up to the places;
    a mark character that stands in the text itself is swapped for another one first, which no candidate holds either.
    In an address '/' is such a mark for a while, so that it parts runs at any distance from the address's start, and a
    password before '@' is a candidate. Runs and values are taken to their own end.
    """
    text = F.translate(F.col(text_col), _MARK + _SLASH + _USER, _SAFE * 3)
    text = F.when(F.contains(text, F.lit("://")), F.regexp_replace(F.regexp_replace(text, _USERINFO, f"$1{_USER}$2{_USER}"), _ADDRESS, f"$1{_SLASH}")).otherwise(text)
    cut = F.translate(F.regexp_replace(text, _FIND, f"{_MARK}$1$2$3{_MARK}"), _SLASH, "/")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_keys(text_col, path_col)["k1"].alias("k1"), F.col(path_col).cast("string").alias("path"), cut.alias("marked"))
    rows = rows.where(F.contains("marked", F.lit(_MARK))).select("doc_id", "k1", "path", F.split("marked", _MARK).alias("pieces"))
    # pieces 0, 2, 4, ... lie between candidates 1, 3, 5, ...; one running sum gives every place
    sums = F.aggregate(
        "pieces", F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.char_length(p)))
    )
    # what stands before a candidate may begin inside the one before it: LONG_NAME_1=value
    ahead = lambda i: F.concat(F.coalesce(F.get("pieces", i - 2), F.lit("")), F.get("pieces", i - 1))
    odd = F.filter(F.sequence(F.lit(1), F.size("pieces") - 1), lambda i: i % 2 == 1)
    found = F.transform(
        odd,
        lambda i: F.struct(
            F.get("sums", i).alias("start"), F.get("sums", i + 1).alias("end"), F.get("pieces", i).alias("value"),
            F.right(ahead(i), F.lit(AROUND)).alias("before"), F.left(F.get("pieces", i + 1), F.lit(AROUND)).alias("after"),
        ),
    )
    rows = rows.where(F.size("pieces") > 1).withColumn("sums", sums)
    out = rows.select("doc_id", "k1", "path", F.explode(found).alias("c")).select("doc_id", "k1", "path", "c.*")
    named = F.lower("before").rlike(rf"({KEY_WORDS})[a-z0-9_]{{0,12}}[\"'`]?\s*[:=]>?\s*[\"'`]?$")
    in_address = F.col("before").endswith(":") & F.col("after").startswith("@")
    return out.where(F.col("value").rlike("[0-9]") | F.col("value").rlike(PREFIXES) | named | in_address)


def _share(value: Column, drop: str) -> Column:
    return 1 - F.char_length(F.regexp_replace(value, drop, "")) / F.char_length(value)


def dictionary(docs: DataFrame, text_col: str = "text", size: int = 500) -> list[str]:
    """The `size` most frequent words of four and more letters in all texts, sorted; of equally frequent ones the first by
    code point. Counts are exact and combined before their shuffle; each task keeps its own `size` best of them."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"(?<!\p{L})\p{L}{4,20}(?!\p{L})"), F.lit(0))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r["word"] for r in counts.orderBy(F.col("n").desc(), "word").limit(size).collect())


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    """Length, character transitions, dictionary coverage, path and neighbouring words, as an array in FEATURES' order."""
    v, before = F.col("value"), F.lower("before")
    near = F.regexp_replace(before, r"[\s\"'`:=>]+$", "")
    changes = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    parts = F.filter(F.split(F.lower(F.regexp_replace(v, r"(?<=[a-z])(?=[A-Z])", " ")), r"[^\p{L}]+"), lambda w: F.char_length(w) >= 3)
    known = F.array(*[F.lit(w) for w in dict.fromkeys([*words, *PLACEHOLDERS])])
    held = F.aggregate(F.filter(parts, lambda w: F.array_contains(known, w)), F.lit(0), lambda s, w: s + F.char_length(w))
    neighbours = F.filter(F.split(F.concat_ws(" ", before, F.lower("after")), r"[^\p{L}]+"), lambda w: F.char_length(w) >= 4)
    prose = F.size(F.filter(neighbours, lambda w: F.array_contains(known, w))) / F.greatest(F.size(neighbours), F.lit(1))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    cols = {
        "length": F.log(F.char_length(v).cast("double")),
        "class_changes": F.regexp_count(v, F.lit(changes)) / F.char_length(v),
        "digit_share": _share(v, "[0-9]"), "upper_share": _share(v, "[A-Z]"), "lower_share": _share(v, "[a-z]"),
        "vowel_share": _share(v, "[aeiouAEIOU]"), "other_share": _share(v, "[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(F.char_length(v), F.lit(36)),
        "hex": flag(v.rlike("^[0-9a-fA-F-]+$")), "dictionary": held / F.char_length(v), "placeholder": _share(v, f"(?i)({'|'.join(PLACEHOLDERS)})"),
        "prefix": flag(v.rlike(PREFIXES)), "neighbours": prose,
        "key_word": flag(near.rlike(f"({KEY_WORDS})[\\s\"'`:=>a-z0-9_]{{0,12}}$")), "assigned": flag(before.rlike(r"[:=]>?\s*[\"'`]?$")),
        "hash_word": flag(near.rlike(r"(commit|sha-?[0-9]{0,3}|md5|checksum|digest|etag|hash|uuid|id)$")),
        "quoted": flag(before.rlike(r"[\"'`]$") & F.col("after").rlike(r"^[\"'`]")), "mail": flag(F.col("after").rlike("^@") | before.rlike("@$") | F.contains(v, F.lit("@"))),
        "path_test": flag(F.lower("path").rlike("test|example|sample|doc|mock")), "path_code": flag(F.lower("path").rlike(r"\.(py|js|env|ya?ml|json|conf|ini|sh)$")),
        "all_digits": flag(v.rlike("^[0-9.+/=_~-]+$")),
    }
    return found.withColumn("f", F.array(*[cols[n].cast("double") for n in FEATURES]))


def _made(kind: Column, h: Column, words: Column) -> Column:
    """A value of a kind from a hash in hex (128 digits) and some words of a text."""
    base = F.translate(F.base64(F.unhex(h)), "\n", "")
    mixed = F.translate(base, "+/=", "4Kq")
    letters = F.translate(h, "0123456789", "ghkmprtvwy")
    word = lambda k: F.coalesce(F.get(words, k), F.lit("word"))
    slug = lambda by: F.concat_ws(by, word(0), word(1), word(2), word(3), F.left(F.translate(h, "abcdef", "135790"), F.lit(2)))
    uuid = F.regexp_replace(F.left(h, F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    digits = F.translate(h, "abcdef", "024681")
    cases = {
        "hex32": F.left(h, F.lit(32)), "hex40": F.left(h, F.lit(40)), "hex64": F.left(h, F.lit(64)), "base64": F.concat(F.left(base, F.lit(43)), F.lit("=")), "base40": F.left(base, F.lit(40)),
        "mixed12": F.concat(F.left(mixed, F.lit(10)), F.left(digits, F.lit(2))), "mixed20": F.concat(F.left(mixed, F.lit(19)), F.left(digits, F.lit(1))), "mixed32": F.left(mixed, F.lit(32)),
        "jwt": F.concat(F.lit("eyJ"), F.left(mixed, F.lit(24)), F.lit("."), F.substring(mixed, 25, 50)), "aws": F.concat(F.lit("AKIA"), F.upper(F.left(mixed, F.lit(16)))),
        "slack": F.concat(F.lit("xoxb-"), F.left(digits, F.lit(12)), F.lit("-"), F.left(mixed, F.lit(24))), "npm": F.concat(F.lit("npm_"), F.left(mixed, F.lit(36))),
        "glpat": F.concat(F.lit("glpat-"), F.left(mixed, F.lit(20))), "stripe": F.concat(F.lit("sk_live_"), F.left(mixed, F.lit(24))), "google": F.concat(F.lit("AIza"), F.left(mixed, F.lit(35))),
        "ghp": F.concat(F.lit("ghp_"), F.left(mixed, F.lit(36))), "phrase_secret": F.concat(F.left(letters, F.lit(5)), F.lit("-"), F.substring(letters, 7, 6)),
        "uuid": uuid, "digits18": F.left(digits, F.lit(18)), "digits16": F.left(digits, F.lit(16)), "slug": slug("-"), "snake": slug("_"),
        "env_name": F.upper(F.concat_ws("_", word(0), F.left(digits, F.lit(1)), word(1), F.when(F.left(h, F.lit(1)) < "8", "secret").otherwise("token"))),
        "version": F.concat_ws(".", F.left(digits, F.lit(1)), F.substring(digits, 3, 2), F.lit("0-beta"), F.substring(digits, 9, 8)),
        "placeholder": F.concat_ws("_", F.lit("your"), word(0), F.lit("example_here"), F.left(digits, F.lit(1))), "prose": F.concat(word(0), word(1), word(2)),
        "time": F.concat(F.lit("2024-0"), F.left(F.translate(digits, "0", "3"), F.lit(1)), F.lit("-11T0"), F.substring(digits, 3, 1), F.lit(":15:00.000Z")),
        "mail": F.concat(word(0), F.lit("."), word(1), F.left(digits, F.lit(4)), F.lit("@mail.host.net")),
    }
    out = F.lit(None).cast("string")
    for name, value in cases.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def labelled_findings(docs: DataFrame, hosts: int = 150, version: str = "v1", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, path, text, secret, from, to: findings whose label is known because they were planted, one for each of
    TEMPLATES in each of `hosts` texts (the documented bound), between words of that text.

    Hosts are the distinct texts first in the order of a hash, and every value follows from it and `version`, so reruns agree.
    Labels come from the template alone, not from any feature.
    """
    text = F.regexp_replace(F.col(text_col), r"[^\p{L}\s.,;:!?]+", " ")  # a host's own identifiers are not labelled, so they go
    own = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.lit(version), F.col(text_col)).alias("h"), F.col(path_col).cast("string").alias("source"), F.split(text, r"\s+").alias("w"))
    own = own.where(F.size("w") >= 8)
    # distinct texts first, then the bound: one row a host is broadcast
    chosen = materialize(own.select("h").distinct().orderBy("h").limit(hosts).withColumnRenamed("h", "c"), "hosts")
    own = own.join(F.broadcast(chosen), F.col("h") == F.col("c")).drop("c")
    own = own.groupBy("h").agg(F.min_by(F.struct("source", "w"), F.struct(F.coalesce("source", F.lit("")))).alias("o")).select("h", "o.*")
    kinds = F.array(*[F.struct(F.lit(k).alias("no"), F.lit(label).alias("secret"), F.lit(path).cast("string").alias("path"), F.lit(x).alias("x"), F.lit(kind).alias("kind"), F.lit(y).alias("y")) for k, (label, path, x, kind, y) in enumerate(TEMPLATES)])
    rows = own.select("h", "source", "w", F.explode(kinds).alias("t")).select("h", "source", "w", "t.*")
    seed = F.concat_ws(":", F.lit(version), F.col("h").cast("string"), F.col("no").cast("string"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("h", "no"), F.size("w").cast("long")).cast("int"))
    plain = F.filter(F.transform(F.slice("w", F.pmod(F.col("at") * 7, F.size("w")) + 1, 40), lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}]", "")), lambda x: F.char_length(x) >= 4)
    rows = rows.withColumn("value", _made(F.col("kind"), F.sha2(seed, 512), plain))
    ahead = F.concat(F.array_join(F.slice("w", F.greatest(F.col("at") - 7, F.lit(1)), 8), " "), F.lit(" "), F.col("x"))
    rows = rows.withColumn("ahead", ahead).withColumn("text", F.concat("ahead", "value", "y", F.lit(" "), F.array_join(F.slice("w", F.col("at") + 1, 8), " ")))
    return rows.select(
        F.xxhash64("h", "no").alias("doc_id"), F.coalesce("path", "source").alias("path"), "text", F.col("secret").cast("double").alias("secret"),
        F.char_length("ahead").alias("from"), (F.char_length("ahead") + F.char_length("value")).alias("to"),
    )


def with_labels(planted: DataFrame, words: list[str]) -> DataFrame:
    """Features and `secret` of the candidates that the scanner sees at planted findings; planted may be any reviewed
    findings with text, path, secret and the place from, to."""
    found = candidates(planted, "doc_id", "text", "path").join(planted.select(F.col("doc_id").alias("i"), "secret", "from", "to"), F.col("doc_id") == F.col("i"))
    return with_features(found.where((F.col("start") < F.col("to")) & (F.col("end") > F.col("from"))), words)


def train(labelled: DataFrame, most: int = 5000, trees: int = 30, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel | None:
    """A forest over at most `most` labelled findings of each kind, chosen by a hash of their values (the documented
    bound). None when there is only one kind."""
    sides = [labelled.where(F.col("secret") == s).orderBy(F.xxhash64("value", "before"), "value").limit(most) for s in (0.0, 1.0)]
    sample = materialize(sides[0].unionByName(sides[1]).select("f", "secret"), "labelled")
    if sample.select("secret").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="v", labelCol="secret", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed)
    return forest.fit(sample.coalesce(4).withColumn("v", array_to_vector("f")))


def _scored(docs: DataFrame, labelled: DataFrame | None, threshold: float, id_col: str, text_col: str, path_col: str, **options) -> DataFrame:
    words = dictionary(docs, text_col)
    found = materialize(with_features(candidates(docs, id_col, text_col, path_col), words), "candidates")
    planted = materialize(labelled_findings(docs, text_col=text_col, path_col=path_col), "findings") if labelled is None else labelled
    known = materialize(with_labels(planted, words), "labelled")
    model = train(known, **options)
    columns = ["doc_id", "k1", "start", "end", "value"]
    if model is None:
        only = known.agg(F.coalesce(F.max("secret"), F.lit(0.0))).first()[0]
        scored = found.select(*columns, F.lit(float(only)).alias("score"))
    else:
        scored = model.transform(found.withColumn("v", array_to_vector("f")))
        scored = scored.select(*columns, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
    return scored.withColumn("is_secret", F.col("score") >= threshold)


def find_secrets(
    docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", **options
) -> DataFrame:
    """doc_id, start, end, value, score, is_secret of every candidate in docs.

    labelled: findings with doc_id (one a finding), text, path, secret, from and to, for instance reviewed ones;
    labelled_findings() of the same documents where none are given. With one kind of label only, that label is every
    score. Null texts hold nothing, a null path names nothing; repeated rows give repeated findings; a text of any
    length is scanned whole.
    """
    return _scored(docs, labelled, threshold, id_col, text_col, path_col, **options).drop("k1")


def redact(
    docs: DataFrame, mask: str = "[SECRET]", labelled: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
    path_col: str = "source", size_col: str = "n_chars", **options,
) -> DataFrame:
    """docs with every found secret replaced by mask, and the text's length in size_col where there is such a column.

    A secret's value is masked wherever it stands in a text in which it was found. Rows are matched by text and path, so
    doc_ids may be null or repeated, and equal rows are masked alike; texts without a secret are not shuffled.
    """
    found = _scored(docs, labelled, threshold, id_col, text_col, path_col, **options).where("is_secret")
    key, held, flag = fresh(docs, "_text_key"), fresh(docs, "_values"), fresh(docs, "_hit")
    longest_first = F.array_sort(F.collect_set("value"), lambda a, b: F.char_length(b) - F.char_length(a))
    values = materialize(found.groupBy(F.col("k1").alias(f"{key}k")).agg(longest_first.alias(held)), "secrets")
    rows = marked(docs.withColumn(key, text_keys(text_col, path_col)["k1"]), flag, F.col(key), values.select(f"{key}k"))
    some = rows.where(F.col(flag)).join(values, F.col(key) == F.col(f"{key}k"), "left")
    text = F.aggregate(F.coalesce(held, F.array().cast("array<string>")), F.col(text_col), lambda t, v: F.replace(t, v, F.lit(mask)))
    some = some.withColumn(text_col, text)
    if size_col in docs.columns:
        some = some.withColumn(size_col, F.when(F.col(held).isNotNull(), F.char_length(text_col).cast(docs.schema[size_col].dataType)).otherwise(F.col(size_col)))
    return rows.where(~F.col(flag)).select(*docs.columns).unionByName(some.select(*docs.columns))
