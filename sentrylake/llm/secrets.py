"""Secret scanning with a random forest that removes false positives.

A high-recall pattern proposes candidates over whole texts: long runs of key
characters with a digit, and whatever a name with a credential word is given,
short or without a digit too. Names and "=" stay outside a candidate. Each
becomes a row with the text before and after it. Features are SQL expressions: length,
changes of character class, share of distinct characters, digits and capitals,
dictionary coverage, the path and the neighbouring words. The dictionary is a
list of words that stand where secrets would, and the most frequent words of
the corpus (``dictionary``). A random forest of the DataFrame machine-learning
API, trained on labelled findings that the same pattern proposes, scores them.
Scanning and scoring stay in the JVM; texts may be of any length, and the
places of many candidates in one are added up in two levels.

A null or empty text has no candidates; an unknown or null path counts as an
ordinary one. Candidates do not overlap: of two that begin at one place the
longer, named one is taken. Repeated rows give their findings each. Rows without findings
give none, as does an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CHARS = "A-Za-z0-9+/_-"
#: Padding, where nothing that could be a value follows.
_PAD = rf"(?:={{1,2}}(?![={_CHARS}]))?"
#: A run of 16 or more key characters with a digit in it, or the head of a private key.
CANDIDATE = rf"-----BEGIN [A-Z ]*PRIVATE KEY-----|(?<![{_CHARS}])(?=[A-Za-z+/_-]*+[0-9])[{_CHARS}]{{16,}}{_PAD}"
_CREDENTIAL = "key|token|secret|passw|passphrase|pwd|credential|auth|bearer|private"
#: A name with a credential word, what assigns to it, and an opening quote.
_NAMED = rf"(?:(?<![A-Za-z0-9_.-])(?=[A-Za-z0-9_.-]{{1,80}}+[\"']?\s{{0,4}}[=:])(?=[A-Za-z0-9_.-]*?(?i:{_CREDENTIAL}))[A-Za-z0-9_.-]{{1,80}}+[\"']?\s{{0,4}}(?::=|=>|[=:])\s{{0,4}}|(?<![A-Za-z0-9])(?=[Bb]earer\s))(?:(?i:bearer|basic)\s{{1,4}})?[\"']?"
#: What such a name is given: six or more key characters, or anything without white space between quotes.
_VALUE = rf"(?!-----BEGIN)(?:(?<=\")[^\s\"]{{6,512}}(?=\")|(?<=')[^\s']{{6,512}}(?=')|[{_CHARS}]{{6,}}{_PAD})"
_PROPOSED = rf"{_NAMED}{_VALUE}|{CANDIDATE}"
WORDS = (
    "example sample test demo dummy fake placeholder your here change changeme replace insert default null none undefined "
    "value string user name admin root local host server client service config setting version release build branch commit "
    "page chapter section table figure order item number code data file path image asset style script index article post "
    "user_id password passwd secret token api key access auth bearer private public account customer invoice ticket report"
).split()
_GOOD_BEFORE = r"(?i)(key|token|secret|passw|pwd|credential|auth|bearer|private)"
_BAD_BEFORE = r"(?i)(sha-?\d*|commit|checksum|digest|hash|md5|uuid|guid|\bid\b|version|order|invoice|isbn|page|etag|serial|example|placeholder)"
_ASSIGNED = r"[=:]\s*[\"']?$"
_ODD_PATH = r"(?i)(test|example|sample|fixture|docs?/|\.md$|lock|vendor|node_modules)"
_CONTEXT = 48
TREES, DEPTH, SEED = 40, 8, 7
#: So many of the corpus's words of four letters and more are in the dictionary too.
DICTIONARY_WORDS = 400
_LEVEL = 256


def dictionary(docs: DataFrame, size: int = DICTIONARY_WORDS) -> list[str]:
    """The words above and the ``size`` most frequent words of four to twelve letters in all texts."""
    found = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit("(?<![a-z0-9])[a-z]{4,12}(?![a-z0-9])"), F.lit(0))).alias("w"))
    top = found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(size)
    return sorted({*WORDS, *(r.w for r in top.collect())})


def _running(start: Column, steps: Column) -> Column:
    """``start`` and the sums of it and the first, the first two, ... of ``steps``."""
    sums = lambda xs, first: F.aggregate(xs, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    number = F.greatest(F.ceil(F.size(steps) / _LEVEL), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), number - 1), lambda i: F.slice(steps, i * _LEVEL + 1, _LEVEL))
    heads = sums(F.transform(parts, lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)), start)
    inner = F.zip_with(parts, F.slice(heads, F.lit(1), number), lambda xs, head: F.slice(sums(xs, head), F.lit(1), F.greatest(F.size(xs), F.lit(1))))
    # a part begins with the sum of all before it; the last sum of all is missing where the last part is full of steps
    return F.concat(F.flatten(inner), F.when(F.size(steps) > 0, F.array(F.element_at(heads, -1))).otherwise(F.array().cast("array<bigint>")))


def candidates(docs: DataFrame, path: Column | None = None) -> DataFrame:
    """doc_id, ordinal, start (in characters), candidate, before, after and path of every proposed string."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (path if path is not None else F.lit("")).cast("string").alias("path"))
    text = text.filter(F.col("text").rlike(_PROPOSED))
    cut = text.select("doc_id", "path", F.regexp_extract_all("text", F.lit(_PROPOSED), F.lit(0)).alias("found"), F.split("text", _PROPOSED).alias("between"))
    # each row gets its own context only: carrying the pieces of the text along would cost its length for every candidate
    n = F.size("found")
    ahead, behind = F.slice("between", F.lit(1), n), F.slice("between", F.lit(2), n)
    steps = F.slice(F.zip_with("found", behind, lambda x, b: (F.length(x) + F.length(b)).cast("long")), F.lit(1), n - 1)
    starts = _running(F.length(F.get("between", F.lit(0))).cast("long"), steps)
    names = F.transform("found", lambda x: F.regexp_extract(x, f"^{_NAMED}(?=.{{6}})", 0))
    cut = cut.withColumn("starts", starts).withColumn("names", names)
    cut = cut.select(
        "doc_id", "path", F.zip_with("found", "names", lambda x, y: F.substring(x, F.length(y) + 1, F.length(x))).alias("candidate"),
        F.zip_with("starts", "names", lambda x, y: x + F.length(y)).alias("start"),
        F.zip_with(ahead, "names", lambda x, y: F.substring(F.concat(F.substring(x, -_CONTEXT, _CONTEXT), y), -_CONTEXT, _CONTEXT)).alias("before"), F.transform(behind, lambda x: F.substring(x, 1, _CONTEXT)).alias("after"),
    )
    rows = cut.select("doc_id", "path", F.posexplode(F.arrays_zip("candidate", "start", "before", "after")).alias("ordinal", "x"))
    return rows.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "x.start", "x.candidate", "x.before", "x.after", F.coalesce("path", F.lit("")).alias("path"))


def _share(c: Column, pattern: str, n: Column) -> Column:
    return F.length(F.regexp_replace(c, pattern, "")) / n


def features(rows: DataFrame, dictionary: Sequence[str] = WORDS) -> DataFrame:
    """Adds the vector ``features``."""
    c = F.col("candidate")
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0"), "[^aB0]", "-")
    changes = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1
    words = "(" + "|".join(sorted(dictionary, key=lambda w: (-len(w), w))) + ")"
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    values = [
        F.log(n),
        changes / n,
        F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64.0)),
        _share(c, "[^0-9]", n), _share(c, "[^A-Z]", n), _share(c, "[^a-z]", n), _share(c, "[A-Za-z0-9]", n),
        flag(c.rlike("^[0-9a-f]+$")), flag(c.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-")), flag(c.rlike("^(AKIA|ASIA|gh[pousr]_|xox[baprs]-|sk[-_]|eyJ|-----BEGIN)")),
        1 - _share(F.lower(c), words, n),
        flag(F.col("path").rlike(_ODD_PATH)),
        flag(F.substring("before", -24, 24).rlike(_GOOD_BEFORE)), flag(F.substring("before", -24, 24).rlike(_BAD_BEFORE)),
        flag(F.col("before").rlike(_ASSIGNED)), flag(F.col("after").rlike("^[\"']")),
    ]
    return rows.withColumn("features", array_to_vector(F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])))


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Findings with a known label (1.0: a secret), made from hashes: what ``candidates`` proposes in texts with the shapes that scanners report."""
    h = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    b64 = lambda salt, n: F.substring(F.regexp_replace(F.base64(F.unhex(h(salt))), "[+/=]", "x"), 1, n)
    pick = lambda salt, *xs: F.element_at(F.array(*map(F.lit, xs)), F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(xs))).cast("int") + 1)
    digits = lambda salt, n: F.substring(F.translate(h(salt), "abcdef", "123456"), 1, n)
    key = pick("k", 'api_key = "', 'token = "', 'secret: "', "password=", 'auth_token: "', "Authorization: Bearer ", 'private_key = "', 'access_key = "')
    plain = pick("pl", "password=", "api_key=", "export TOKEN=", "secret: ", "https://h.example.net/a?token=", "https://h.example.net/a?x=1&api_key=", "PGPASSWORD=", "db_password = ")
    letters = lambda salt, n: F.substring(F.translate(b64(salt, 40), "0123456789", "qZwXkVjGpY"), 1, n)
    word = lambda salt: pick(salt, "hunter", "dragon", "monkey", "summer", "tiger", "orange", "winter", "falcon")
    idle = pick("i", "the ", "and ", "see ", "is ", "with ", "of ", "in the ", "to ")
    kinds = [
        # secrets
        (1.0, key, F.substring(h("a"), 1, 40)),
        (1.0, key, F.substring(h("b"), 1, 32)),
        (1.0, key, b64("c", 40)),
        (1.0, key, b64("d", 24)),
        (1.0, F.concat(key, F.lit("")), F.concat(F.lit("ghp_"), b64("e", 36))),
        (1.0, idle, F.concat(F.lit("AKIA"), F.upper(F.substring(h("f"), 1, 16)))),
        (1.0, idle, F.concat(pick("p", "ghp_", "xoxb-", "sk-", "sk_"), b64("g", 36))),
        (1.0, pick("u", "password is ", "the secret ", "use key "), b64("j", 28)),
        (1.0, plain, F.substring(h("a2"), 1, 40)),
        (1.0, plain, F.substring(h("b2"), 1, 20)),
        (1.0, plain, b64("c2", 24)),
        (1.0, plain, b64("d2", 12)),
        (1.0, key, letters("e2", 24)),
        (1.0, plain, letters("f2", 20)),
        (1.0, key, F.concat(word("g2"), digits("h2", 1), word("i2"), digits("j2", 2))),
        (1.0, plain, F.concat(word("k2"), digits("l2", 2), word("m2"), digits("n2", 1))),
        # other strings
        (0.0, pick("m", "commit ", "sha1 ", "revision hash ", "etag: ", 'md5 = "'), F.substring(h("l"), 1, 40)),
        (0.0, pick("n", "sha256:", "checksum: ", "digest = ", 'hash: "'), h("o")),
        (0.0, pick("q", "id ", "uuid = ", 'guid: "', "request id "), F.regexp_replace(F.substring(h("r"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")),
        (0.0, F.concat(idle, pick("s", "", "order ", "card ", "number ")), digits("t", 16)),
        (0.0, key, F.concat(pick("v", "your_api_key_here_", "example-token-value-", "changeme_placeholder_", "insert-secret-key-"), digits("w", 2))),
        (0.0, key, F.concat(F.repeat(pick("x", "x", "0", "a", "1"), 18), digits("y", 1))),
        (0.0, idle, F.concat(pick("z", "assets/images/page-", "chapter-section-figure-", "release-build-version-", "user_account_report_"), digits("aa", 4))),
        (0.0, idle, F.concat(F.translate(F.substring(h("bb"), 1, 18), "0123456789", "eaionrtsld"), digits("cc", 1))),
        (0.0, pick("o2", "the key: ", "token: ", "secret: ", "password: ", "key = ", "author: "), pick("p2", "remember", "through", "required", "optional", "people", "another", "reading", "between", "forgotten", "nothing")),
        (0.0, pick("q2", "password = ", 'token = "', "api_key=", "secret=", "auth: "), pick("r2", "changeme", "undefined", "your_password", "placeholder", "example", "your-token-here", "replace_me", "default", "string")),
        (0.0, pick("s2", "key=", "sort_key: ", 'primary_key = "', "https://h.example.net/a?key="), F.concat(pick("t2", "user_id", "order_number", "article", "section", "page-index"), pick("u2", "", "_name", "-path"))),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(kinds)))
    before = F.coalesce(*[F.when(kind == i, b) for i, (_, b, _) in enumerate(kinds)])
    value = F.coalesce(*[F.when(kind == i, v) for i, (_, _, v) in enumerate(kinds)])
    label = F.coalesce(*[F.when(kind == i, F.lit(y)) for i, (y, _, _) in enumerate(kinds)])
    # secrets stand in test files too, if less often, and other strings in ordinary ones
    odd = F.pmod(F.xxhash64(F.lit("path"), value), F.lit(6)) < F.when(label == 0, 2).otherwise(1)
    path = F.when(odd, pick("v2", "tests/fixtures/a.txt", "docs/setup.md", "package-lock.json")).otherwise(pick("w2", "src/app.py", "deploy/run.sh", "", "config.yml", "s"))
    text = F.concat(before, value, F.when(before.endswith('"'), F.lit('" ')).otherwise(F.lit(" ")))
    found = candidates(spark.range(rows).select(F.col("id").alias("doc_id"), text.alias("text"), path.alias("path")), F.col("path"))
    found = found.withColumn("id", F.col("doc_id")).filter(F.col("start") == F.length(before))
    return found.select(label.alias("label"), "before", "candidate", "after", "path")


def train(findings: DataFrame, dictionary: Sequence[str] = WORDS) -> RandomForestClassificationModel:
    """Fits the forest to findings with candidate, before, after, path and label."""
    rows = features(findings, dictionary).select("features", "label")
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)


def scan(docs: DataFrame, model: RandomForestClassificationModel, path: Column | None = None, threshold: float = 0.5, dictionary: Sequence[str] = WORDS) -> DataFrame:
    """One row per candidate: doc_id, ordinal, start, candidate, path, probability and secret, the forest's verdict. The dictionary is that of the training."""
    scored = model.transform(features(candidates(docs, path), dictionary))
    p = F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)
    return scored.select("doc_id", "ordinal", "start", "candidate", "path", p.alias("probability"), (p >= threshold).alias("secret"))
