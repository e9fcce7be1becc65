"""Secret scans (operator 4): a random forest over secret candidates.

Candidates are runs of at least MIN_LENGTH key characters with a digit or with many
changes of case, all of a word, and shorter values that are assigned to a key word
(``password=...``), found anywhere in the whole text together with what stands
around them. A random forest, trained from labelled findings, drops false positives
by length, character transitions, dictionary coverage, path and neighbouring words.
Transitions and dictionary are counted over all texts of the corpus. All of it is
DataFrame expressions and Spark's own forest; labels are a bounded DataFrame.
"""

from __future__ import annotations

from math import log
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.base import SPACE_CLASS, as_rows, cut, table

MIN_LENGTH = 16
#: Labelled findings to train on, at most.
FINDINGS = 6000
TREES, DEPTH, SEED = 20, 6, 42
NEAR = 3
CANDIDATE = "[A-Za-z0-9_+/=.\\-]{16,}"
KEYWORDS = "token|secret|passw|pwd|passphrase|credential|api.?key|access.?key|auth|bearer|private|signing"
BENIGN = "sha\\d*|md5|checksum|digest|hash|commit|uuid|guid|version|build|isbn|revision|etag|order|invoice|example|sample"
WORDS = (
    "example|sample|test|demo|dummy|placeholder|your|insert|change|replace|here|key|token|secret|password|value|string|default|"
    "user|name|admin|config|settings|server|client|service|version|release|build|data|file|path|index|image|document|page|"
    "http|https|www|com|org|net|html|json|python|java|spark|public|private|local|host|home|main|src|lib|bin|usr|var"
)
PATHS = "test|spec|example|sample|fixture|mock|doc"
#: A value that is assigned to a key word: all up to the closing quote, or up to a sign
#: that ends a value without quotes.
VALUE = r"[^\s\"'`,;<>(){}\[\]]"
ASSIGNED = rf"(?i)(?:{KEYWORDS})[A-Za-z0-9_]{{0,20}}[\"']?\s*[:=]\s*[\"']?((?<=\")[^\"\s]{{6,}}(?=\")|(?<=')[^'\s]{{6,}}(?=')|{VALUE}{{6,}}+(?!{VALUE}))"
CASES = "[a-z][A-Z].*[a-z][A-Z].*[a-z][A-Z].*[a-z][A-Z]"
#: Words of the corpus that make the dictionary, the commonest ones.
DICTIONARY = 400
#: Kinds of characters between which transitions are counted: letters, digits (0), others (_).
KINDS = "abcdefghijklmnopqrstuvwxyz0_"


class Known(NamedTuple):
    """What is known of ordinary words: the dictionary and, for each pair of kinds of
    characters, the log of how likely the second follows the first."""

    words: list[str]
    transitions: list[float]


def known_from(words: list[str], pairs: dict[tuple[str, str], int]) -> Known:
    totals = {a: sum(pairs.get((a, b), 0) for b in KINDS) for a in KINDS}
    rate = lambda a, b: log((pairs.get((a, b), 0) + 0.5) / (totals[a] + 0.5 * len(KINDS)))
    return Known(words, [rate(a, b) for a in KINDS for b in KINDS])


def kinds(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), "[^a-z0]", "_")


def learned(docs: DataFrame, size: int = DICTIONARY) -> Known:
    """Dictionary and transitions from the words of all texts. Words are counted in
    the cluster, partial counts first; the driver gets ``size`` words and a table of
    as many numbers as pairs of kinds."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("(?<![\\p{L}\\p{N}])[a-z]{3,20}(?![\\p{L}\\p{N}])"), 0)).alias("word"))
    counts = cut(words.groupBy("word").count(), "words")
    top = counts.filter(F.length("word") > 3).orderBy(F.desc("count"), "word").limit(size).collect()
    both = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    pairs = counts.select("count", F.explode(both).alias("pair")).groupBy("pair").agg(F.sum("count").alias("n")).collect()
    return known_from([r.word for r in top], {(r.pair[0], r.pair[1]): r.n for r in pairs})


def _default() -> Known:
    words, pairs = WORDS.split("|"), {}
    for w in words:
        for a, b in zip(w, w[1:]):
            pairs[a, b] = pairs.get((a, b), 0) + 1
    return known_from([], pairs)


def pieces(word: Column) -> Column:
    """The word cut behind each of its runs, so that every piece has one run; what
    follows the last run stays with it. A word with one run or none is one piece."""
    cut = F.regexp_replace(F.regexp_replace(word, CANDIDATE, "$0 "), " ([^ ]*+)\\z", "$1")
    return F.when(F.length(word) < MIN_LENGTH, F.array(word)).otherwise(F.split(cut, " "))


def candidates(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """(row, position, run, offset, word, before, after, path, value): one row for
    each candidate. position counts the text's words from 0, run the word's runs
    from 0 (-1: an assigned value in which no run is a candidate), offset is the value's first character in
    the word. word is the piece around the value; neighbours are pieces too, of the
    same word or of others."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    words = F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")
    each = lambda w, i: F.transform(pieces(w), lambda p, k: F.struct(p.alias("piece"), i.alias("position"), k.alias("run")))
    rows = as_rows(docs).withColumn("pieces", F.flatten(F.transform(words, each)))
    odd = lambda run: run.rlike("[0-9]") | run.rlike(CASES)
    looks = lambda w: (F.length(w) >= MIN_LENGTH) & w.rlike("[0-9]|[A-Z]") & odd(F.regexp_extract(w, CANDIDATE, 0))
    # what is assigned may stand in the next words: key, sign and value are joined
    assigns = lambda x, i: F.contains(x.piece, F.lit("=")) | F.contains(x.piece, F.lit(":")) | F.get("pieces", i - 1).piece.rlike("[=:][\"']?$")
    joined = lambda x, i: F.concat(
        F.when(~x.piece.rlike(f"(?i)(?:{KEYWORDS})[A-Za-z0-9_]{{0,20}}[\"']?[:=]"), F.concat_ws(" ", F.get("pieces", i - 2).piece, F.get("pieces", i - 1).piece, F.lit(""))).otherwise(F.lit("")), x.piece
    )
    values = lambda x, i: F.when((F.length(x.piece) >= 6) & assigns(x, i), F.regexp_extract_all(joined(x, i), F.lit(ASSIGNED), 1))
    place = lambda i, run, value: F.struct(i.alias("i"), run.alias("run"), value.alias("value"))
    none = F.array().cast("array<struct<i: int, run: int, value: string>>")
    found = F.transform("pieces", lambda x, i: F.concat(
        F.when(looks(x.piece), F.array(place(i, x.run, F.regexp_extract(x.piece, CANDIDATE, 0)))).otherwise(none),
        F.coalesce(F.transform(F.filter(values(x, i), lambda v: F.contains(x.piece, v) & ~looks(v)), lambda v: place(i, F.lit(-1), v)), none),
    ))
    each = rows.select("row", "pieces", F.explode(F.flatten(found)).alias("place")).select("row", "pieces", "place.*")
    where = F.col(f"row.{path}").cast("string") if path else F.lit("")
    around = lambda start, size: F.array_join(F.slice("pieces", start, size).piece, " ")
    i = F.col("i")
    own = F.get("pieces", i)
    found = each.withColumn("own", own).select(
        "row",
        F.col("own.position").cast("long").alias("position"),
        F.col("run").cast("long").alias("run"),
        F.aggregate(F.slice("pieces", i - F.col("own.run") + 1, F.col("own.run")), F.lit(0), lambda n, x: n + F.length(x.piece)).alias("start"),
        F.col("own.piece").alias("word"),
        around(F.greatest(i - NEAR + 1, F.lit(1)), F.least(i, F.lit(NEAR))).alias("before"),
        around(i + 2, F.lit(NEAR)).alias("after"),
        F.coalesce(where, F.lit("")).alias("path"),
        "value",
    )
    offset = (F.col("start") + F.position("value", "word") - 1).cast("long")
    return found.withColumn("offset", offset).drop("start")


def features(known: Known | None = None) -> dict[str, Column]:
    """Forest inputs from value, word, before, after and path."""
    known = known or _default()
    v, n = F.col("value"), F.length("value").cast("double")
    count = lambda p: F.regexp_count(v, F.lit(p)).cast("double")
    chars = F.array_distinct(F.split(v, ""))
    part = lambda c: (F.length(v) - F.length(F.replace(v, c, F.lit("")))) / n
    entropy = F.aggregate(
        F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda s, c: s - F.when(part(c) > 0, part(c) * F.log2(part(c))).otherwise(0.0)
    )
    has = lambda c, p: F.lower(c).rlike(p).cast("double")
    # the mean log chance of a character after the one before
    places = F.transform(F.filter(F.split(kinds(v), ""), lambda c: c != ""), lambda c: F.instr(F.lit(KINDS), c) - 1)
    table, width = F.array(*map(F.lit, known.transitions)), len(KINDS)
    steps = lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.get(table, a * width + b))
    likely = F.aggregate(F.array(places), F.lit(0.0), lambda _, p: F.aggregate(steps(p), F.lit(0.0), lambda s, x: s + x)) / n
    dictionary = "|".join(sorted({*WORDS.split("|"), *known.words}, key=lambda w: (-len(w), w)))
    return {
        "f_length": F.least(n, F.lit(512.0)),
        "f_digits": count("[0-9]") / n,
        "f_upper": count("[A-Z]") / n,
        "f_punct": count("[^A-Za-z0-9]") / n,
        "f_hex": v.rlike("^[0-9a-fA-F]+$").cast("double"),
        # transitions between kinds of characters, and runs of one kind
        "f_turns": (count("[0-9]+") + count("[a-z]+") + count("[A-Z]+") + count("[^A-Za-z0-9]+")) / n,
        "f_consonants": count("[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]{4,}") / n,
        "f_repeats": count("(.)\\1{2,}") / n,
        "f_entropy": entropy,
        "f_transitions": likely,
        "f_dictionary": 1 - F.length(F.regexp_replace(F.lower(v), dictionary, "")) / n,
        "f_segments": (count("/") + count("\\.")) / n,
        "f_uuid": v.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-").cast("double"),
        "f_path": has(F.col("path"), PATHS),
        "f_keyword": has(F.concat_ws(" ", "before", "word"), KEYWORDS),
        "f_benign": has(F.concat_ws(" ", "before", "after"), BENIGN),
        "f_assigned": (F.col("before").rlike("[=:]\\s*[\"']?$") | F.col("word").rlike("[=:][\"']?[A-Za-z0-9]")).cast("double"),
        "f_quoted": F.col("word").rlike("[\"']").cast("double"),
    }


def labelled_findings(spark: SparkSession, n: int = FINDINGS, first: int = 0) -> DataFrame:
    """Labelled findings (value, word, before, after, path, label) for training: n
    rows made from hashes of their numbers (from ``first`` on), half of them
    real-looking secrets (hex and base64 keys, prefixed tokens, signed tokens,
    passwords), the rest what scanners wrongly report: checksums, ids, paths,
    versions, placeholders, long numbers, times, identifiers. Replace it by reviewed
    findings where they exist."""
    rows = spark.range(first, first + n).withColumns({"h": F.sha2(F.col("id").cast("string"), 512), "k": F.pmod(F.xxhash64("id"), F.lit(1000))})
    h = lambda a, size: F.substring("h", a, size)
    b64 = F.regexp_replace(F.base64(F.unhex(h(1, 60))), "=", "")
    long64 = F.base64(F.unhex(F.col("h")))
    word64 = F.translate(b64, "+/", "xY")
    hex40, pick = h(11, 40), lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.pmod("k", F.lit(len(x))) + 1).cast("int"))
    pick2 = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.pmod(F.col("k") + F.shiftright("id", 3), F.lit(len(x))) + 1).cast("int"))
    kind = F.pmod("id", F.lit(24))
    uuid = F.concat_ws("-", h(1, 8), h(9, 4), h(13, 4), h(17, 4), h(21, 12))
    number = F.translate(h(1, 24), "abcdef", "012345")
    upper = F.upper(F.conv(h(5, 15), 16, 36))
    short = F.concat(pick("blue", "Tiger", "w1nter", "Qx", "sunny", "r00t"), pick2("#", "_", "!", "-", ""), F.substring(word64, 1, 6))
    stem = pick("get", "load", "parse", "update", "build", "read")
    ident = F.concat(stem, pick2("User", "Order", "Index", "Cache"), pick("Account", "Stream", "Table", "Value"), pick2("FromServer", "ForRequest", "WithDefault"), pick("Name", "Id2", "V3", "List"))
    cases = [
        (2, hex40), (4, b64), (5, F.concat(F.upper(h(1, 4)), upper, F.lit("7"))),
        (7, F.concat(pick("sk_live_", "pk_", "xt-", "tok_", "ghx_", "npm_", "glp-", "key-", "xob-"), F.substring(word64, 1, 34))),
        (8, h(1, 64)), (9, F.concat(F.lit("eyJ"), F.substring(word64, 1, 20), F.lit("."), F.substring(F.translate(long64, "+/=", "xYZ"), 1, 60), F.lit("."), word64)),
        (10, long64), (12, short),
        # from here on no secrets
        (13, uuid), (15, F.when(F.col("k") % 2 == 0, hex40).otherwise(h(1, 64))),
        (16, F.concat(pick("/usr/lib/", "src/main/", "www.example.com/", "docs/img/"), pick2("python3", "spark4", "page", "file2", "data"), F.lit("/part-"), F.col("k").cast("string"), F.lit(".html"))),
        (17, F.concat(pick("example", "your-token", "test_key", "sample_password"), F.lit("_placeholder_"), F.col("k").cast("string"))),
        (18, F.concat(pick("release", "version", "service-build"), F.lit("-4.1."), F.col("k").cast("string"), F.lit("-SNAPSHOT"))),
        (19, F.when(F.col("k") % 2 == 0, number).otherwise(F.concat_ws("-", F.substring(number, 1, 4), F.substring(number, 5, 4), F.substring(number, 9, 4), F.substring(number, 13, 4)))),
        (20, F.concat(F.lit("user.name"), F.col("k").cast("string"), F.lit(".mail.example.com"))),
        (21, F.concat(F.lit("20"), F.substring(number, 1, 2), F.lit("-0"), F.lit("4-1"), F.lit("2T1"), F.lit("0."), F.substring(number, 3, 2), F.lit("."), F.substring(number, 5, 6))),
        (22, ident),
        (24, pick("required", "changeme", "optional", "password", "yourpassword", "string", "disabled", "example1", "undefined", "process.env", "secret_name", "default")),
    ]
    value = None
    for stop, v in cases:
        value = F.when(kind < stop, v) if value is None else value.when(kind < stop, v)
    secret, assigned = kind < 12, kind.isin(10, 11, 22, 23)
    key = pick("token =", "secret:", "api_key =", "password =", "auth token:", "access_key =", "bearer", "private key:", "SECRET_KEY=", "authorization:")
    plain = pick("token =", "secret:", "passwd =", "password =", "db_password:", "client_secret =", "pwd:")
    other = pick("sha256", "commit", "see file", "build", "checksum", "version", "order", "uuid", "the", "of", "in", "id:", "call", "at", "card")
    keyed = (secret & (F.col("k") % 20 < 17)) | (~secret & kind.isin(15, 16) & (F.col("k") % 2 == 0))
    led = F.when(assigned, plain).when(keyed, key).when(secret, pick2("export", "then", "use", "with", "curl -H")).otherwise(other)
    glued = keyed & (F.col("k") % 5 == 0)  # key and value in one word
    own = F.when(keyed & (F.col("k") % 3 < 2), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)
    return rows.select(
        value.alias("value"),
        F.when(glued, F.concat(F.regexp_replace(led, " ", ""), own)).otherwise(own).alias("word"),
        F.concat_ws(" ", pick("then", "and", "la", "der"), F.when(~glued, led)).alias("before"),
        pick("and", "the", "file", "of", "").alias("after"),
        F.when(~secret & (F.col("k") % 7 == 0), F.lit("tests/fixtures")).otherwise(F.lit("src")).alias("path"),
        secret.cast("double").alias("label"),
    )


def train(findings: DataFrame, seed: int = SEED, known: Known | None = None) -> PipelineModel:
    """A forest on labelled findings; the caller bounds their number (FINDINGS)."""
    inputs = features(known)
    assemble = VectorAssembler(inputCols=list(inputs), outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, labelCol="label", featuresCol="features", maxMemoryInMB=64)
    ready = assemble.transform(findings.withColumns(inputs))
    return PipelineModel([assemble, forest.fit(ready)])


def scan(docs: DataFrame, model: PipelineModel, path: str | None = "source", least: float = 0.5, known: Known | None = None) -> DataFrame:
    """One row for each candidate: row, position, run, offset, value, score, is_secret.

    A null or empty text has no candidates, a null path counts as empty. A run
    of any length is one candidate. Repeated words and rows are reported each
    time. An empty table gives no rows; the caller's columns stay inside ``row``.
    """
    found = model.transform(candidates(docs, path).withColumns(features(known)))
    score = vector_to_array("probability")[1]
    return found.select("row", "position", "run", "offset", "value", F.round(score, 6).alias("score")).withColumn("is_secret", F.col("score") >= least)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's verdict; the value
    itself is shown as a hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    known = learned(docs)
    found = scan(docs, train(labelled_findings(spark), known=known), known=known)
    return found.select("row.doc_id", "position", "run", "offset", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), "score", "is_secret")
