"""Secret scan: candidates by pattern, false positives removed by a random forest.

Everything runs as column expressions: candidate strings are cut out with the words before them, described by length,
character transitions, dictionary coverage, the file's path and the neighbouring words, and judged by a random
forest trained on labelled findings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.scale import cut_lineage

MIN_CHARS = 16
TREES = 30

# fixed values: what names a secret, what names other long strings, frequent English words and letter pairs
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "auth", "bearer", "credential", "private")
OTHER_WORDS = ("commit", "sha", "hash", "digest", "checksum", "md5", "uuid", "guid", "id", "version", "integrity", "etag",
               "revision", "card", "phone", "number", "order", "isbn", "public", "sample")
STAND_INS = ("example", "dummy", "placeholder", "changeme", "your", "xxxx", "1234567", "test", "sample", "redacted", "todo")
TEST_PATHS = ("test", "example", "fixture", "mock", "sample", "doc", "lock")
COMMON_WORDS = ("about", "after", "access", "build", "class", "client", "code", "config", "data", "default", "error", "file", "first",
                "from", "function", "group", "have", "image", "index", "info", "input", "item", "line", "list", "main", "message",
                "method", "model", "name", "note", "object", "other", "page", "path", "point", "project", "read", "request",
                "result", "service", "size", "source", "state", "string", "system", "table", "text", "that", "this", "time",
                "type", "user", "value", "version", "view", "with", "word", "work", "world", "write")
PAIRS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt")

_CHARS = "A-Za-z0-9+/_.\\-"
#: The word before, how it is joined, and a long string with a digit in it or with capitals inside.
CANDIDATE = ("(?:(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]{0,39}+)[\"']?+[ \\t]{0,4}+(:=|=>|=|:|(?<=[ \\t]))[ \\t]{0,4}+([\"'`]?+))?"
             f"(?<![{_CHARS}])(?=[{_CHARS}]*?(?:[0-9]|[a-z][A-Z]))([{_CHARS}]{{{MIN_CHARS},}}+={{0,2}})")

FEATURES = ["chars", "transitions", "kinds", "digits", "distinct", "pairs", "coverage", "hex", "dashed", "number", "standin",
            "assigned", "quoted", "secret_word", "other_word", "test_path"]


def _any(value: Column, words: tuple[str, ...]) -> Column:
    return value.rlike("(?i)" + "|".join(words)).cast("double")


def candidates(docs: DataFrame, text: str, path: str | None, keep: list[str]) -> DataFrame:
    """One row per candidate: the ``keep`` columns, nth (from 0), word, joint, quote, value and the path."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(CANDIDATE), F.lit(0))
    file = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    names = [F.col(f"`{c}`") for c in keep]
    # the outer explode keeps Spark from testing the array, and so matching every text, a second time
    rows = docs.select(*names, file.alias("__path"), F.posexplode_outer(found).alias("nth", "__match")).where(F.col("__match").isNotNull())
    parts = [F.regexp_extract("__match", CANDIDATE, g).alias(n) for g, n in enumerate(("word", "joint", "quote", "value"), 1)]
    return rows.select(*names, "nth", *parts, F.col("__path").alias("path"))


def describe(rows: DataFrame) -> DataFrame:
    """The candidates with the numbers that the forest looks at."""
    v, low = F.col("value"), F.lower("value")
    chars = F.length("value").cast("double")

    def count(pattern: str, value: Column = v) -> Column:
        return F.regexp_count(value, F.lit(pattern)).cast("double")

    covered = chars - F.length(F.regexp_replace(low, "|".join(COMMON_WORDS), ""))
    kinds = reduce(lambda a, b: a + b, [v.rlike(p).cast("double") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")])
    moves = count("[a-z](?=[A-Z0-9])") + count("[A-Z](?=[a-z0-9])") + count("[0-9](?=[A-Za-z])")
    return rows.select(
        "*", F.least(chars, F.lit(200.0)).alias("chars"), (moves / chars).alias("transitions"), kinds.alias("kinds"),
        (count("[0-9]") / chars).alias("digits"),
        (F.size(F.array_distinct(F.split("value", ""))) / F.least(chars, F.lit(64.0))).alias("distinct"),
        (count("|".join(PAIRS), low) / chars).alias("pairs"), (covered / chars).alias("coverage"),
        v.rlike("^[0-9a-fA-F]+$").cast("double").alias("hex"),
        v.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$").cast("double").alias("dashed"),
        v.rlike("^[0-9.+-]+$").cast("double").alias("number"), _any(v, STAND_INS).alias("standin"),
        F.col("joint").isin("=", ":", ":=", "=>").cast("double").alias("assigned"), (F.col("quote") != "").cast("double").alias("quoted"),
        _any(F.col("word"), SECRET_WORDS).alias("secret_word"), _any(F.col("word"), OTHER_WORDS).alias("other_word"),
        _any(F.col("path"), TEST_PATHS).alias("test_path"))


def labelled_findings(spark: SparkSession, rows: int = 1200) -> DataFrame:
    """A small table of findings with their labels (text, path, label): every kind of line in turn, values by hash."""
    def digest(salt: str) -> Column:
        return F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)).cast("binary"), 256)

    def base64(salt: str, n: int) -> Column:
        return F.substring(F.regexp_replace(F.base64(F.unhex(digest(salt))), "=+$", ""), 1, n)

    hexes, digits = F.substring(digest("a"), 1, 40), F.substring(F.regexp_replace(digest("n"), "[^0-9]", "7"), 1, 16)
    uuid = F.regexp_replace(F.substring(digest("u"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    words = F.array(*[F.lit(w) for w in COMMON_WORDS])
    some = F.concat_ws("-", *[F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(COMMON_WORDS))) + 1).cast("int")) for k in range(4)])
    kinds = [
        (F.concat(F.lit('token = "'), hexes, F.lit('"')), "app/settings.py", 1), (F.concat(F.lit('TOKEN = "'), F.upper(hexes), F.lit('"')), "src7", 1),
        (F.concat(F.lit('api_key: "'), base64("k", 40), F.lit('"')), "config/prod.yml", 1), (F.concat(F.lit("password="), base64("p", 20)), "deploy/env", 1),
        (F.concat(F.lit("secret = '"), base64("s", 32), F.lit("'")), "src3", 1), (F.concat(F.lit("auth_token: "), F.substring(digest("t"), 1, 32)), "", 1),
        (F.concat(F.lit("key AKIA"), F.upper(F.substring(digest("i"), 1, 16))), "notes/setup", 1),
        (F.concat(F.lit("commit "), hexes), "changes", 0), (F.concat(F.lit("sha256: "), digest("h")), "requirements.lock", 0),
        (F.concat(F.lit('id = "'), uuid, F.lit('"')), "src1", 0), (F.concat(F.lit("the "), digits, F.lit(" and")), "src5", 0),
        (F.concat(F.lit("card "), digits), "", 0), (F.concat(F.lit('name = "'), some, F.lit('-9"')), "app/views.py", 0),
        (F.concat(F.lit('token = "your-example-token-1234567-'), F.substring(digest("x"), 1, 4), F.lit('"')), "docs/guide", 0),
        (F.concat(F.lit('password = "changeme-'), F.substring(digest("y"), 1, 8), F.lit('"')), "tests/fixtures", 0),
        (F.concat(F.lit("md5 "), F.substring(digest("m"), 1, 32)), "", 0), (F.concat(F.lit("see https/"), some, F.lit("/page.html?v=2")), "src9", 0),
        (F.concat(F.lit("mail "), some, F.lit("."), F.substring(digits, 1, 2)), "src2", 0),
    ]
    n = len(kinds)
    base = spark.range(rows)

    def pick(i: int) -> Column:
        return reduce(lambda other, k: F.when(F.col("id") % n == k[0], k[1][i] if isinstance(k[1][i], Column) else F.lit(k[1][i])).otherwise(other),
                      enumerate(kinds), F.lit(None))

    return base.select(pick(0).alias("text"), pick(1).alias("path"), pick(2).cast("double").alias("label"))


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURES, outputCol="__features")


def train(labelled: DataFrame, text: str = "text", path: str = "path", label: str = "label", trees: int = TREES,
          seed: int = 1) -> RandomForestClassificationModel:
    """A forest from labelled findings; the first candidate of each row carries the row's label (1: a secret)."""
    rows = describe(candidates(labelled.where(F.col(label).isNotNull()), text, path, [label])).where("nth = 0")
    rows = cut_lineage(_assembler().transform(rows).select("__features", label).coalesce(1))
    forest = RandomForestClassifier(featuresCol="__features", labelCol=label, numTrees=trees, maxDepth=8, seed=seed)
    return forest.fit(rows)


def scan(docs: DataFrame, model: RandomForestClassificationModel, text: str = "text", path: str | None = None,
         keep: list[str] | None = None) -> DataFrame:
    """One row per candidate: the ``keep`` columns, nth, word, value, score (probability of a secret) and is_secret.

    Candidates are all strings of at least 16 letters, digits and ``+/_.-`` with a digit or a capital behind a small
    letter anywhere in them, numbered in text order. The whole text is read. Null and empty texts have none; a null path
    is an empty one; repeated rows and repeated candidates are all listed. ``keep`` columns named like a
    result are left out.
    """
    own = ("nth", "word", "joint", "quote", "value", "path", "score", "is_secret", *FEATURES)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in own and c != text]
    scored = model.transform(_assembler().transform(describe(candidates(docs, text, path, kept))))
    score = vector_to_array("probability")[1]
    return scored.select(*[F.col(f"`{c}`") for c in kept], "nth", "word", "value", score.alias("score"), (score >= 0.5).alias("is_secret"))
