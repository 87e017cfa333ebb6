"""Secrets: high-recall candidates, and a random forest that takes false positives out. DataFrame functions only.

Candidates are runs of at least 16 key characters with a digit among them (a name before an equals sign is apart from its value),
unquoted values of at least 8 characters after a name like token or password, user and password in an address of the web, quoted strings
without spaces, and private key blocks. None of them has a greatest length: what belongs to a secret is redacted whole. Their
features: length, shares of character classes, transitions between classes and between vowels and consonants, distinct characters,
coverage by a dictionary, words of the path, and neighbouring words and signs. The forest is fitted on the driver from
labelled findings (a table of at most FINDINGS rows, generated by rule unless given), its trees become CASE
expressions, and a candidate is a secret if their mean is at least THRESHOLD. Everything happens within a row:
no shuffle, and texts are read once.

Null text has no candidates; a null path counts as empty. Repeated rows have equal results; all columns stay, under their names, but
for one named _scan, which gives way. An empty table gives no rows. Offsets are code points.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans, trees

#: Ends of names whose unquoted value is a candidate whatever its characters, and the signs between both.
_NAMES = ("token", "secret", "password", "passwd", "pwd", "passphrase", "api[_-]key", "apikey", "access[_-]key", "secret[_-]key", "private[_-]key", "credentials", "credential", "client[_-]id", "auth")
_SIGNS = ("[=:]", "[=:] ", " [=:] ", " [=:]", ":=", " := ", " is ")
#: A lookbehind has a fixed width each, so that every engine takes it; the first ones rule out nearly all places.
_NAMED = "(?:(?<=[=:])|(?<=[=:] )|(?<= is ))(?i:" + "|".join(f"(?<={n}{x})" for n in _NAMES for x in _SIGNS) + ")"
CANDIDATE = (
    r"""-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?"""
    + f"""|{_NAMED}"""
    + r"""(?=[^\s"'&;,]{7}[.)\]}>]*+[^\s"'&;,.)\]}>])(?:[.)\]}>]*+[^\s"'&;,.)\]}>]++)++"""
    + r"""|(?<=://)[^\s/:@"'<>]*+:[^\s/:@"'<>]++(?=@)"""
    + r"""|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+(?:=++(?![A-Za-z0-9+/_-]))?"""
    + r"""|(?<=["'])[^"'\s]{8,}+(?=["'])"""
)
THRESHOLD = 0.5
#: Labelled findings that the fit uses at most.
FINDINGS = 6000

#: Common words, for coverage.
DICTIONARY = "the and for that with this from have not are was you key test example sample value name data file user admin password secret token config default your changeme placeholder dummy hello world tion ing ment able".split()
_KEYWORD = r"(?i)(token|secret|passw|pwd|api.?key|apikey|access.?key|auth|bearer|private|credential|client.?id|signing)"
_INNOCENT = r"(?i)(sha1|sha256|sha512|md5|checksum|digest|commit|revision|uuid|guid|hash|etag|integrity|order|invoice|isbn|tracking|fingerprint)"
_DUMMY = r"(?i)(example|sample|dummy|placeholder|your|changeme|xxxx|fake|mock|0000|1234567)"
_PREFIX = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|sk_live_|sk-|xox[abp]-|AIza|glpat-|ya29|-----BEGIN)"


def features(token: Column, before: Column, after: Column, path: Column) -> list[tuple[str, Column]]:
    """(name, value) of a candidate with up to 40 code points on either side."""
    n = F.greatest(F.char_length(token), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(token, F.lit(pattern)) / n
    flag = lambda c: c.cast("double")
    low = F.lower(token)
    return [
        ("length", n),
        ("digits", share("[0-9]")),
        ("uppers", share("[A-Z]")),
        ("lowers", share("[a-z]")),
        ("signs", share("[^A-Za-z0-9]")),
        ("turns", share("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])")),
        ("vowels", F.regexp_count(low, F.lit("[aeiou](?=[b-df-hj-np-tv-z])|[b-df-hj-np-tv-z](?=[aeiou])")) / n),
        ("hex", flag(token.rlike("^[0-9a-fA-F]+$"))),
        ("distinct", F.size(F.array_distinct(F.split(token, ""))) / n),
        ("known", F.lit(1.0) - F.char_length(F.regexp_replace(low, "|".join(DICTIONARY), "")) / n),
        ("prefix", flag(token.rlike(_PREFIX))),
        ("dummy", flag(token.rlike(_DUMMY))),
        ("test_path", flag(path.rlike("(?i)(test|spec|fixture|example|sample|doc)"))),
        ("config_path", flag(path.rlike(r"(?i)(\.env|config|settings|secret|\.ya?ml|\.ini|\.properties)"))),
        ("keyword", flag(before.rlike(_KEYWORD))),
        ("innocent", flag(before.rlike(_INNOCENT))),
        ("dummy_near", flag(before.rlike(_DUMMY) | after.rlike(_DUMMY))),
        ("assigned", flag(before.rlike("""[=:]\\s*["']?$"""))),
        ("quoted", flag(before.rlike("""["']$""") & after.rlike("""^["']"""))),
        ("in_address", flag(before.endswith("://") & after.startswith("@"))),
    ]


def findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """Labelled findings by rule: token, before, after, path, label. Half are secrets; the others are what scanners mistake for them."""
    pick = lambda salt, *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(xs))) + 1).cast("int"))
    hexa, other = F.sha1(F.concat(F.lit("a"), F.col("id").cast("string"))), F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 256)))
    plain = F.regexp_replace(other, "[+/=]", "x")
    size = (F.pmod(F.xxhash64("id", F.lit("n")), F.lit(25)) + 16).cast("int")
    prose = F.concat(*(pick(f"w{i}", "the", "and", "river", "winter", "people", "handed", "question", "somewhat", "garden", "mentor") for i in range(4)))
    name, lead = pick("k", "token", "secret", "api_key", "password", "auth_token", "access_key", "client_secret"), pick("l", "the of and ", "= null; ", "in a ", "", "\n", "and on 12 ")
    assign = F.concat(lead, name, pick("s", " = ", "=", ": ", " := ", " is "), pick("q", '"', '"', "'", ""))
    close = pick("q", '"', '"', "'", "")
    # Short values or values without digits stand only after a name; words and code there are no secrets.
    loose = F.substring(F.translate(plain, "0123456789", "kQ!z$Rw#mX"), F.lit(1), F.pmod(F.xxhash64("id", F.lit("o")), F.lit(17)).cast("int") + 8)
    spoken = F.concat(pick("d1", "hunter", "summer", "dragon", "orange", "monkey"), F.substring(F.regexp_replace(hexa, "[a-f]", ""), 1, 2), pick("d2", "", "x", "hunter", "Blue", "!"), F.substring(F.regexp_replace(hexa, "[a-f]", ""), 3, 2))
    dotted = F.concat(F.substring(plain, 1, 4), F.lit("."), F.substring(plain, 5, 4), F.lit("."), F.substring(plain, F.lit(9), size))
    secret = F.element_at(F.array(hexa, F.substring(plain, F.lit(1), size), F.concat(pick("p", "AKIA", "ghp_", "sk_live_", "xoxb-"), F.substring(F.upper(plain), F.lit(1), size)), F.substring(F.sha2(hexa, 256), F.lit(1), F.greatest(size, F.lit(32))), loose, spoken, dotted), (F.pmod(F.xxhash64("id", F.lit("t")), F.lit(7)) + 1).cast("int"))
    innocent = F.concat(lead, pick("i", "sha1: ", "commit ", "md5=", "checksum ", "uuid: ", "integrity=", "etag: \"", "order ", "revision "))
    digits = F.regexp_replace(F.sha2(plain, 256), "[a-f]", "")
    number = F.substring(digits, F.lit(1), size)
    word = F.concat(pick("v1", "required", "optional", "disabled", "undefined", "generated", "inherited", "authentication", "verification", "anything", "os.environ.get", "settings.load", "self.provider"), pick("v2", "", "", "-name", ".value", "_field"))
    case = F.pmod(F.xxhash64("id", F.lit("c")), F.lit(9))
    wrong = (
        F.when(case == 0, F.struct(hexa.alias("token"), innocent.alias("before"), F.lit(" ").alias("after")))
        .when(case == 1, F.struct(F.concat(prose, F.lit("4"), prose).alias("token"), lead.alias("before"), F.lit(" ").alias("after")))
        .when(case == 2, F.struct(number.alias("token"), lead.alias("before"), F.lit(" and").alias("after")))
        .when(case == 3, F.struct(F.concat(F.lit("your_"), name, F.lit("_here_1")).alias("token"), assign.alias("before"), close.alias("after")))
        .when(case == 4, F.struct(F.concat(F.substring(hexa, 1, 8), F.lit("-"), F.substring(hexa, 9, 4), F.lit("-"), F.substring(hexa, 13, 4), F.lit("-"), F.substring(hexa, 17, 12)).alias("token"), innocent.alias("before"), F.lit("\n").alias("after")))
        .when(case == 5, F.struct(prose.alias("token"), F.concat(lead, pick("j", 'class="', "title='", 'said "')).alias("before"), close.alias("after")))
        .when(case == 6, F.struct(F.concat(F.lit("example"), F.substring(plain, 1, 12)).alias("token"), assign.alias("before"), close.alias("after")))
        .when(case == 7, F.struct(word.alias("token"), assign.alias("before"), close.alias("after")))
        .otherwise(F.struct(F.concat(prose, F.lit("-2024-"), prose).alias("token"), pick("u", "https://a.example/", "/en/", " ").alias("before"), F.lit(" ").alias("after")))
    )
    # Secrets without any keyword beside them are rarer, and stand in configuration.
    login = F.struct(F.concat(pick("u1", "u", "admin", "root", "deploy", ""), F.lit(":"), loose).alias("token"), F.concat(lead, pick("u2", "https://", "postgres://", "amqp://", "url = redis://")).alias("before"), F.concat(F.lit("@"), pick("u3", "host", "db.example:5432/x", "10.0.0.7")).alias("after"))
    right = F.struct(secret.alias("token"), F.when((F.pmod(F.xxhash64("id", F.lit("b")), F.lit(10)) < 8) | (F.pmod(F.xxhash64("id", F.lit("t")), F.lit(7)) >= 4), assign).otherwise(F.concat(lead, pick("y", 'key="', "Bearer ", "x-auth: "))).alias("before"), close.alias("after"))
    base = spark.range(rows, numPartitions=1).withColumn("label", (F.col("id") % 2).cast("int"))
    right = F.when(F.pmod(F.xxhash64("id", F.lit("u")), F.lit(12)) == 0, login).otherwise(right)
    return base.select(F.when(F.col("label") == 1, right).otherwise(wrong).alias("f"), pick("path", "src3", "app/config.yml", "src/test/a.py", "README.md", "lib/x.js", "src0").alias("path"), "label").select("f.*", "path", "label")


@cache
def _fitted(spark: SparkSession) -> tuple[list, list[str]]:
    return fit(findings(spark))


def fit(labelled: DataFrame, rows: int = FINDINGS) -> tuple[list, list[str]]:
    """(trees, feature names) from labelled findings (token, before, after, path, label), at most `rows` of them."""
    f = features(F.col("token"), F.col("before"), F.col("after"), F.col("path"))
    names = [n for n, _ in f]
    got = labelled.select(*(c.alias(n) for n, c in f), F.col("label").cast("double").alias("label")).orderBy(F.xxhash64("token", "before")).limit(rows).collect()
    table = np.array([list(r) for r in got], float).reshape(len(got), len(names) + 1)
    return trees.forest(table[:, :-1], table[:, -1]), names


def scan(docs: DataFrame, path: Column, model: tuple[list, list[str]] | None = None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs, and a struct `_scan` with candidates (start, end, score) and the text redacted at the secrets."""
    forest, names = model or _fitted(docs.sparkSession)
    c = lambda name: F.col(f"__scan_{name}")
    # One column for each step: steps that are used more than once are computed once.
    step = spans.apart(docs, __scan_text=F.coalesce(docs[text_col].cast("string"), F.lit("")), __scan_path=F.coalesce(path.cast("string"), F.lit("")))
    step = step.withColumn("__scan_found", spans.matches(c("text"), CANDIDATE))
    step = step.withColumn("__scan_between", spans.around(c("text"), CANDIDATE, c("found")))
    step = step.withColumns({"__scan_near": F.transform(c("between"), lambda p: F.struct(F.right(p, F.lit(40)).alias("end"), F.left(p, F.lit(40)).alias("start"))), "__scan_starts": spans.starts(c("found"), c("between"))})
    seen = F.transform(c("found"), lambda m, i: F.struct(m.alias("token"), F.right(F.concat(F.when(i > 0, F.right(F.get(c("found"), i - 1), F.lit(40))).otherwise(F.lit("")), F.get(c("near"), i)["end"]), F.lit(40)).alias("before"), F.get(c("near"), i + 1)["start"].alias("after")))
    step = step.withColumn("__scan_seen", F.when(F.size(c("found")) > 0, seen))
    step = step.withColumn("__scan_facts", F.transform(c("seen"), lambda s: F.struct(*(v.alias(n) for n, v in features(s["token"], s["before"], s["after"], c("path"))))))
    step = step.withColumn("__scan_scores", F.expr(f"transform(__scan_facts, f -> {trees.total(forest, names, 'f')} / {len(forest)})"))
    tokens = F.zip_with(c("found"), c("scores"), lambda m, s: F.when(s >= threshold, F.lit("[SECRET]")).otherwise(m))
    redacted = F.array_join(F.zip_with(c("between"), F.concat(tokens, F.array(F.lit(""))), lambda p, m: F.concat(p, m)), "")
    rows = F.transform(c("found"), lambda m, i: F.struct(F.get(c("starts"), i).alias("start"), (F.get(c("starts"), i) + F.char_length(m)).alias("end"), F.get(c("scores"), i).alias("score")))
    empty = F.array().cast("array<struct<start: bigint, end: bigint, score: double>>")
    some = F.size(c("found")) > 0
    out = F.struct(F.when(some, rows).otherwise(empty).alias("candidates"), F.when(some & F.exists(c("scores"), lambda s: s >= threshold), redacted).otherwise(c("text")).alias("redacted"))
    return spans.together(step, docs, "_scan", out)


def secrets(threshold: float = THRESHOLD) -> Column:
    """Of scan()'s rows: the candidates that are secrets."""
    return F.filter("_scan.candidates", lambda c: c["score"] >= threshold)
