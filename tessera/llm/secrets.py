"""Secrets by a random forest over candidate strings. DataFrame functions and Spark ML only."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.spans import MATCHES, marked_free, matches

#: Candidates: unbroken strings, private key headers, and what is assigned to a telling name, in quotes or not.
STRING = r"(?:\G|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{16,}+"
HEADER = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
NAMES = r"password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential"
_TO = rf"(?:{NAMES})[\"']?[\x20\t]{{0,3}}(?::=|=>|[:=])[\x20\t]{{0,3}}"
ASSIGNED = rf"(?i)(?<=\")(?<={_TO}\")[^\"\r\n]++(?=\")|(?<=')(?<={_TO}')[^'\r\n]++(?=')|(?<=[:=>\x20\t])(?<={_TO})[^\s\"'=>:,;][^\s\"',;]*+"
KINDS = ["string", "header", "assigned"]
#: The dictionary, words and syllables that make a string look written rather than drawn.
DICTIONARY = [
    "able", "access", "address", "admin", "after", "and", "api", "apple", "base", "before", "book", "build", "chapter", "change", "class", "client",
    "code", "com", "config", "content", "data", "date", "default", "demo", "dev", "doc", "dummy", "example", "field", "file", "first", "for", "from",
    "function", "get", "group", "hello", "here", "home", "http", "image", "index", "info", "ing", "insert", "item", "java", "key", "lib", "line", "list",
    "local", "main", "ment", "model", "module", "name", "new", "node", "number", "object", "order", "page", "part", "password", "path", "place", "placeholder",
    "port", "private", "product", "public", "query", "read", "report", "root", "sample", "secret", "section", "server", "service", "set", "some", "src",
    "static", "string", "table", "test", "text", "that", "the", "this", "time", "tion", "title", "token", "type", "under", "update", "user", "value",
    "version", "view", "with", "word", "work", "world", "xxx", "your", "year",
]
FOR = r"(?i)key|token|secret|passw|pwd|credential|auth|bearer|private|apikey|access"
AGAINST = r"(?i)sha\d*|md5|commit|checksum|digest|integrity|uuid|guid|\bid\b|isbn|etag|revision|hash|version|base64,"
PATHS = r"(?i)test|example|sample|fixture|doc|mock|demo"
FEATURES = ["length", "transitions", "distinct", "digits", "capitals", "hexadecimal", "coverage", "vowels", "marks", "repeats", "path", "inside_path", "near_for", "near_against", "quoted", "assigned", "kind"]
#: Rows of each of the kinds of labelled findings that are made where none are given.
MADE = 250
TREES, DEPTH, SEED = 24, 7, 5


def features(body: Column, before: Column, after: Column, path: Column, kind: Column) -> list[Column]:
    """The forest's features: of the candidate, of its place, and of the words beside it."""
    n = F.greatest(F.length(body), F.lit(1)).cast("double")
    turns = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    words = "(?i)" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    share = lambda pattern: F.regexp_count(body, F.lit(pattern)) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    made = {
        "length": F.log2(n), "transitions": share(turns), "distinct": F.size(F.array_distinct(F.split(body, ""))) / F.least(n, F.lit(40.0)),
        "digits": share("[0-9]"), "capitals": share("[A-Z]"), "hexadecimal": flag(body.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "coverage": 1 - F.length(F.regexp_replace(body, words, "")) / n, "vowels": share("(?i)[aeiou]"), "marks": share("[+/_=.-]"), "repeats": share(r"(.)\1\1"),
        "path": flag(path.rlike(PATHS)), "inside_path": flag(before.rlike(r"[/\\.]$|://\S*$")), "near_for": flag(before.rlike(FOR)), "near_against": flag(before.rlike(AGAINST)),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")), "assigned": flag(before.rlike("[:=]\\s*[\"'`]?$")), "kind": kind.cast("double"),
    }
    return [made[f].cast("double").alias(f) for f in FEATURES]


def labelled_findings(spark: SparkSession, made: int = MADE) -> DataFrame:
    """Findings (body, before, after, path, kind, label) of known kinds, drawn from hashes: what stands in for reviewed ones."""
    ids = spark.range(0, made, 1, 1).withColumn("h", F.sha2(F.col("id").cast("string"), 256)).withColumn("g", F.sha2(F.concat(F.lit("g"), "id"), 256))
    b64 = F.regexp_replace(F.base64(F.unhex("h")), "=", "")
    word = F.element_at(F.array(*[F.lit(w) for w in DICTIONARY]), (F.col("id") % len(DICTIONARY) + 1).cast("int"))
    other = F.element_at(F.array(*[F.lit(w) for w in DICTIONARY]), (F.col("id") * 7 % len(DICTIONARY) + 1).cast("int"))
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("id") % len(xs) + 1).cast("int"))
    uuid = F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4), F.substring("h", 13, 4), F.substring("h", 17, 4), F.substring("h", 21, 12))
    kinds = [
        (F.substring("h", 1, 40), pick('token = "', 'the token="', 'api_key: "', 'secret = "', 'use auth token "'), '"', 0, 1),
        (F.substring("h", 1, 32), pick('api_key = "', "apikey=", 'secret: "', 'access_token = "'), '"', 0, 1),
        (F.substr(b64, F.lit(1), F.lit(40)), pick('aws_secret_access_key = "', 'secret: "', "Authorization: Bearer ", 'client_secret = "'), '"', 0, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substr(F.regexp_replace(b64, "[+/]", "Q"), F.lit(1), F.lit(16)))), pick('key = "', "access key ", " ", 'id: "'), pick('"', " "), 0, 1),
        (F.concat(pick("sk_live_", "ghp_", "xoxb-", "glpat-"), F.substr(F.regexp_replace(b64, "[+/]", "x"), F.lit(1), F.lit(30))), pick("key: ", "", 'token = "', "export T="), " ", 0, 1),
        (F.substr(b64, F.lit(3), (F.lit(9) + F.col("id") % 6).cast("int")), pick('password = "', "pwd: '", 'secret = "'), '"', 2, 1),
        (F.lit("-----BEGIN RSA PRIVATE KEY-----"), F.lit(""), F.lit("\n"), 1, 1),
        (F.substring("g", 1, 40), pick("commit ", "sha1: ", "revision ", 'sha = "', "checksum "), " ", 0, 0),
        (F.col("g"), pick("sha256:", "digest = ", 'integrity="', "hash "), pick(" ", '"'), 0, 0),
        (uuid, pick("id=", 'uuid: "', "guid ", "/items/"), pick('"', " ", "/"), 0, 0),
        (F.concat_ws("/", F.lit("src"), word, other, F.concat(word, F.col("id").cast("string"))), pick("see ", "path/", "import "), " ", 0, 0),
        (F.concat_ws("_", F.lit("your"), word, F.lit("key_here"), F.col("id").cast("string")), pick('api_key = "', "token: ", 'secret = "'), '"', 0, 0),
        (F.concat(F.repeat(pick("x", "X", "0", "a", "1"), 15), F.lit("1"), F.repeat(pick("x", "0"), 6)), pick('token = "', "key=", " "), '"', 0, 0),
        (F.concat(word, other, word, F.col("id").cast("string"), other), pick("the ", "function ", "id ", "chapter "), " ", 0, 0),
        (F.concat_ws("-", word, other, F.lit("2024"), F.col("id").cast("string"), word), pick("https://a.example/", "/blog/", "page "), " ", 0, 0),
        (F.translate(F.substring("g", 1, 19), "abcdef", "123456"), pick("isbn ", "order ", "number ", "+", "card "), " ", 0, 0),
        (F.concat(F.base64(F.unhex("g")), F.base64(F.unhex("h"))), F.lit("data:image/png;base64,"), '"', 0, 0),
        (F.concat(word, F.lit("1")), pick('password = "', 'token = "', "secret: '"), '"', 2, 0),
        (F.concat(F.lit("<"), word, F.lit("_"), other, F.lit(">")), pick('password = "', 'token = "'), '"', 2, 0),
        (F.concat(F.lit("AKIA"), F.translate(F.upper(F.substring("h", 1, 16)), "0123456789", "QXZKJVWYGP")), pick('key = "', "access key ", " ", 'id: "'), pick('"', " "), 0, 1),
        (F.substr(F.regexp_replace(b64, "[0-9+/]", ""), F.lit(1), F.lit(16)), pick('token = "', "secret=", 'api_key: "', "password: "), pick('"', " "), 0, 1),
        (F.substr(b64, F.lit(2), (F.lit(5) + F.col("id") % 10).cast("int")), pick("password=", "DB_PASSWORD: ", "pwd: ", "secret=", "PASSWD="), pick("\n", " ", ""), 2, 1),
        (F.concat(F.initcap(word), F.substring("g", 1, 1), F.substr(b64, F.lit(9), (F.lit(1) + F.col("id") % 4).cast("int")), (F.col("id") % 89 + 10).cast("string")), pick("password=", 'password = "', "PASSWORD: ", "secret="), pick("\n", '"', " "), 2, 1),
        (F.concat(F.translate(F.substring(word, 1, 3), "aeios", "43105"), (F.col("id") % 10).cast("string"), F.translate(F.substring(other, 1, 3), "aeios", "43105")), pick("DB_PASSWORD: ", "password=", "pwd = '"), pick("\n", " ", "'"), 2, 1),
        (F.concat(b64, F.base64(F.unhex("g")), F.repeat(b64, 4), F.lit(".")), pick('token = "', "secret=", "token: "), pick('"', "\n"), 2, 1),
        (F.repeat(pick("=", "-", "_", "=-", "+", "/"), 40), pick("", " ", "\n"), pick("\n", " "), 0, 0),
        (F.concat(word, other, F.repeat(word, 2)), pick("the ", "function ", "", "see "), pick(" ", ".", ","), 0, 0),
        (F.concat_ws("_", word, other, F.lit("value"), word), pick("the ", "call ", ' "', "= "), pick(" ", "(", '"'), 0, 0),
        (F.concat_ws("/", word, F.concat(other, word), F.lit("content"), other), pick("a ", "https://a.example/", "path/"), pick(" ", "."), 0, 0),
        (word, pick("password: ", "token: ", "the secret: ", "api key = ", "credential: "), pick(" ", ".", ","), 2, 0),
        (pick("please", "enter", "must", "ask", "forgot", "change", "cannot", "reset", "required", "longer", "it", "a", "be", "their", "when", "choose", "between", "none", "optional", "through", "keep", "strong"), pick("Your password: ", "the token: ", "A secret: ", "api key = ", "credential: "), pick(" ", ".", ","), 2, 0),
        (F.concat(word, pick(".", "?", "!", ")")), pick("password: ", "token: ", "secret = "), pick(" ", "\n"), 2, 0),
        (F.concat_ws(" ", word, other, word, F.lit("please")), pick('password: "', "secret = '"), pick('"', "'"), 2, 0),
        (F.concat(pick("os.environ[", "getenv(", "config.", "${", "self."), word, pick("]", ")", "", "}", "")), pick("password=", "token = ", "secret: ", "api_key="), pick("\n", " "), 2, 0),
    ]
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    rows = [
        F.struct(b.alias("body"), column(p).alias("before"), column(a).alias("after"), pick("src1", "main.py", "test_a.py", "docs/x").alias("path"), F.lit(k).alias("kind"), F.lit(float(y)).alias("label"))
        for b, p, a, k, y in kinds
    ]
    return ids.select(F.explode(F.array(*rows)).alias("f")).select("f.*")


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> PipelineModel:
    """The forest, fitted to labelled findings (a bounded set: some thousand rows)."""
    table = findings.select(*features(*[F.col(c) for c in ("body", "before", "after", "path", "kind")]), "label").coalesce(1)
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="vector"), forest]).fit(table)


def candidates(docs: DataFrame, path: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each candidate of each whole text: `keep`, path, kind, start, stop, body, before, after."""
    rows = docs.select(*keep, F.coalesce(F.col(path), F.lit("")).alias("path"), marked_free(F.coalesce("text", F.lit(""))).alias("clean"))
    none = F.array().cast(MATCHES)
    strings = matches(F.col("clean"), STRING, 0)
    named = F.when(F.col("clean").contains("PRIVATE KEY"), matches(F.col("clean"), HEADER, 1)).otherwise(none)
    assigned = F.when(F.col("clean").rlike(f"(?i){NAMES}"), matches(F.col("clean"), ASSIGNED, 2)).otherwise(none)
    listed = rows.select(*keep, "path", F.concat(strings, named).alias("sure"), assigned.alias("more"))
    free = F.filter("more", lambda e: ~F.exists("sure", lambda b: (b["start"] == e["start"]) & (b["stop"] == e["stop"])))
    return listed.select(*keep, "path", F.explode(F.concat("sure", free)).alias("m")).select(*keep, "path", "m.*")


def secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, path: str = "source") -> DataFrame:
    """The secrets in `docs` (doc_id, text, and a path): doc_id, kind, start, stop (code points), digest, probability.

    Candidates are all unbroken strings of 16 or more, private key headers, and all values assigned to a telling name,
    quoted or not and of any length; a string within a longer value is judged by itself too. The forest, trained from `findings` (body, before, after, path, kind, label), removes those under
    `threshold`. The secret itself isn't told, but its SHA-256. There is no shuffle.

    Null and empty texts hold none. Null path counts as empty. A null doc_id is carried. Repeated rows give repeated
    findings. Empty input: empty result. Whole texts are read. Further columns are ignored.
    """
    model = fit(labelled_findings(docs.sparkSession) if findings is None else findings)
    found = candidates(docs, path)
    kept = ["doc_id", "kind", "start", "stop", "body"]
    scored = model.transform(found.select(*[F.col(c).alias(f"_{c}") for c in kept], *features(*[F.col(c) for c in ("body", "before", "after", "path", "kind")])))
    probability = vector_to_array("probability")[1]
    names = F.array(*[F.lit(k) for k in KINDS])
    return scored.where(probability >= threshold).select(
        F.col("_doc_id").alias("doc_id"), F.element_at(names, F.col("_kind") + 1).alias("kind"), F.col("_start").alias("start"), F.col("_stop").alias("stop"),
        F.sha2("_body", 256).alias("digest"), F.round(probability, 6).alias("probability"),
    )
