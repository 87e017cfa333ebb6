"""Personal data: exact base patterns, and further spans chosen by gradient boosted trees. DataFrame functions only.

Base kinds, leftmost and not overlapping within a kind: email, ip (parts at most 255), card (14 to 19 digits that
pass Luhn), phone (10 to 15 digits after a plus sign); a match that fails its test is dropped, not tried again. The
patterns used here find the same matches without backtracking over long runs: a match starts where the run of its first
class starts, or where the last match ended.

High-recall generators propose more spans, which may overlap: runs of grouped digits, addresses written out ("name at
host dot com"), account-like codes of letters and digits. Boosted trees score their format (digits, groups, signs, Luhn, letters)
and context (words before and after), Platt's sigmoid calibrates the margin on candidates that the trees did not see,
and a candidate is added if its probability reaches its kind's threshold, the least at which PRECISION of the calibration
candidates above it are right. Matches of the base patterns that fail their test are candidates as well. Candidates may overlap
base spans and each other, only those that a base span holds already are left out; base spans always stay.

The trees are fitted on the driver from at most CANDIDATES labelled candidates, by default generated by rule. All
scoring happens within a row, without a shuffle. Null text counts as empty. Repeated rows have equal results; all
columns stay, under their names, but for one named _pii, which gives way. An empty table gives no rows. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans, trees

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Matches of base patterns that fail their test are candidates too, of these kinds.
FAILED = {"ip": "ip_like", "card": "card_like", "phone": "phone_like"}
#: Digits that such a candidate has at least.
LEAST_DIGITS = {"ip": 4, "card": 9, "phone": 7}
#: Generators of further candidates, and the kind that their spans are reported as.
MORE = {
    "number": r"(?<![0-9A-Za-z.+(-])\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}(?![0-9A-Za-z])",
    "address": r"(?i)(?<![A-Za-z0-9._-])[a-z0-9._-]{2,}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]{2,}+\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[a-z]{2,10}(?![A-Za-z])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
PRECISION = 0.98
#: Labelled candidates that the fit uses at most.
CANDIDATES = 6000

_PHONE = r"(?i)(phone|call|tel\b|tel:|mobile|fax|cell|number is|whatsapp)"
_PERSON = r"(?i)(ssn|social security|passport|id card|national id|birth|born|dob|patient|account|iban|bank|card)"
_CARD = r"(?i)(card|visa|mastercard|amex|credit|debit|payment)"
_OTHER = r"(?i)(isbn|version|page|chapter|table|invoice|order|item|price|total|score|ratio|lines|section|figure)"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit doubled, the sum divisible by 10."""
    back = F.split(F.reverse(digits), "")
    two = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    value = F.transform(back, lambda d, i: F.when(i % 2 == 1, two(F.coalesce(d.try_cast("int"), F.lit(0)))).otherwise(F.coalesce(d.try_cast("int"), F.lit(0))))
    return F.aggregate(value, F.lit(0), lambda a, b: a + b) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda d: F.char_length(F.regexp_replace(d, "^0+", "")) < 4  # noqa: E731  no number beyond 999 is read
        return F.forall(F.split(m, "[.]"), lambda d: part(d) & (F.coalesce(F.right(d, F.lit(4)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        d = _digits(m)
        return F.char_length(d).between(14, 19) & luhn(F.left(d, F.lit(20)))
    if kind == "phone":
        return F.char_length(_digits(m)).between(10, 15)
    return F.lit(True)


def features(token: Column, before: Column, after: Column, kind: Column) -> list[tuple[str, Column]]:
    """(name, value) of a candidate with up to 40 code points on either side."""
    flag = lambda c: c.cast("double")
    d = _digits(token)
    return [
        ("length", F.char_length(token).cast("double")),
        ("digits", F.char_length(d).cast("double")),
        ("letters", F.regexp_count(token, F.lit("[A-Za-z]")).cast("double")),
        ("groups", F.regexp_count(token, F.lit("[0-9]+")).cast("double")),
        ("hyphens", F.regexp_count(token, F.lit("-")).cast("double")),
        ("dots", F.regexp_count(token, F.lit("[.]")).cast("double")),
        ("slashes", F.regexp_count(token, F.lit("/")).cast("double")),
        ("blanks", F.regexp_count(token, F.lit(" ")).cast("double")),
        ("bracket", flag(token.contains("("))),
        ("ssn", flag(token.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"))),
        ("tens", flag(token.rlike("^[(]?[0-9]{3}[)]?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$"))),
        ("date", flag(token.rlike("^([0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4})$"))),
        ("is_address", flag(kind == "address")),
        ("is_account", flag(kind == "account")),
        *((f"is_{k}", flag(kind == k)) for k in FAILED.values()),
        ("card_near", flag(before.rlike(_CARD))),
        ("plus", flag(token.startswith("+"))),
        ("dot_word", flag(token.rlike("(?i)[(\\[]dot|dot[)\\]]|[(\\[]at"))),
        ("common_end", flag(token.rlike("(?i)(com|org|net|edu|de|fr|es|uk|io)$"))),
        ("phone_near", flag(before.rlike(_PHONE))),
        ("person_near", flag(before.rlike(_PERSON))),
        ("other_near", flag(before.rlike(_OTHER))),
        ("equals", flag(before.rlike("[:=] ?$"))),
        ("digit_beside", flag(before.rlike("[0-9][ ,.-]*$") | after.rlike("^[ ,.-]*[0-9]"))),
    ]


def labelled(spark: SparkSession, rows: int = CANDIDATES) -> DataFrame:
    """Labelled candidates by rule: token, before, after, kind, label."""
    n = lambda salt, k: F.substring(F.regexp_replace(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 512), "[a-f]", ""), 1, k)
    pick = lambda salt, *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(xs))) + 1).cast("int"))
    s = pick("sep", "-", " ", ".")
    prose = pick("prose", "on the winter ", "question and ", "of in was ", "es de la ", "")
    phone, person, other = pick("ph", "call me: ", "phone ", "tel: ", "my mobile "), pick("pe", "ssn: ", "social security ", "passport ", "account ", "iban: "), pick("ot", "isbn ", "version ", "order ", "pages ", "score ", "table ")
    word = pick("word", "winter", "garden", "one", "river", "jane.doe", "mark7")
    case = F.pmod(F.xxhash64("id", F.lit("case")), F.lit(22))
    row = lambda t, b, a, kind, y: F.struct(t.alias("token"), b.alias("before"), a.alias("after"), F.lit(kind).alias("kind"), F.lit(y).alias("label"))
    ten = F.concat(n("a", 3), s, n("b", 3), s, n("c", 4))
    bracket = F.concat(F.lit("("), n("a", 3), F.lit(") "), n("b", 3), F.lit("-"), n("c", 4))
    ssn = F.concat(n("d", 3), F.lit("-"), n("e", 2), F.lit("-"), n("f", 4))
    date = F.concat(F.lit("20"), n("g", 2), pick("ds", "-", "/"), F.lit("0"), n("h", 1), pick("ds", "-", "/"), F.lit("1"), n("i", 1))
    loose = F.concat(n("j", 2), pick("ls", " ", "-", "/", "."), n("k", 3))
    iban = F.concat(pick("c", "DE", "FR", "ES", "GB"), n("l", 2), F.lit(" "), n("m", 4), F.lit(" "), n("o", 4), F.lit(" "), n("p", 4), F.lit(" "), n("q", 4))
    code = F.concat(F.lit("AB"), n("r", 2), F.lit(" ABCD EFGH"))
    written = F.concat(word, pick("at", " (at) ", " [at] ", " at "), F.lit("mail"), pick("dot", " (dot) ", " [dot] ", " dot "), pick("tld", "com", "org", "net", "de"))
    talk = F.concat(word, F.lit(" at the"), F.lit(" dot "), pick("tk", "thing", "on", "ring"))
    e, after = F.lit(" and "), pick("after", " and", ".", ", the", "\n")
    f = F.when(case == 0, row(ten, phone, after, "number", 1)).when(case == 1, row(ten, prose, after, "number", 1)).when(case == 2, row(bracket, prose, after, "number", 1)).when(case == 3, row(ssn, person, after, "number", 1)).when(case == 4, row(ssn, prose, after, "number", 1))
    f = f.when(case == 5, row(date, prose, after, "number", 0)).when(case == 6, row(loose, prose, after, "number", 0)).when(case == 7, row(loose, other, after, "number", 0)).when(case == 8, row(ten, other, after, "number", 0)).when(case == 9, row(F.concat(n("s", 4), s, n("t", 4), s, n("u", 4)), F.concat(other, n("v", 3), F.lit(" ")), e, "number", 0))
    card, near = F.concat(n("ca", 4), s, n("cb", 4), s, n("cc", 4), s, n("cd", 4)), pick("cn", "card ", "card number: ", "visa ", "credit card ", "paid with card ")
    long, short = n("la", 16), F.substring(n("sa", 13), F.lit(1), F.pmod(F.xxhash64("id", F.lit("sl")), F.lit(5)).cast("int") + 9)
    dotted = F.concat(F.lit("3"), n("da", 2), F.lit("."), n("db", 1), F.lit("."), n("dc", 2), F.lit("."), n("dd", 3))
    f = f.when(case == 14, row(card, near, after, "card_like", 1)).when(case == 15, row(long, other, after, "card_like", 0)).when(case == 16, row(short, prose, after, "card_like", 0)).when(case == 17, row(n("sb", 9), person, after, "card_like", 1))
    f = f.when(case == 18, row(dotted, F.concat(pick("dv", "version ", "section ", "", "release "), prose), after, "ip_like", 0)).when(case == 19, row(F.concat(F.lit("+"), n("pa", 1), F.lit(" "), n("pb", 3), s, n("pc", 4)), phone, after, "phone_like", 1))
    f = f.when(case == 20, row(F.concat(F.lit("+"), n("pd", 4), F.lit(" - "), n("pe", 4)), prose, after, "phone_like", 0)).when(case == 21, row(F.concat(n("ya", 2), F.lit(" "), n("yb", 4), F.lit(" "), n("yc", 3), F.lit(" "), n("yd", 2)), prose, after, "card_like", 0))
    f = f.when(case == 10, row(iban, person, after, "account", 1)).when(case == 11, row(code, prose, after, "account", 0)).when(case == 12, row(written, prose, after, "address", 1)).otherwise(row(talk, prose, after, "address", 0))
    return spark.range(rows, numPartitions=1).select(f.alias("f")).select("f.*")


def fit(rows: DataFrame, most: int = CANDIDATES) -> tuple[list, list[str], float, float, dict[str, float]]:
    """(trees, feature names, a, b, threshold of each kind): a third of the candidates calibrates and does not grow trees."""
    f = features(F.col("token"), F.col("before"), F.col("after"), F.col("kind"))
    names = [n for n, _ in f]
    got = rows.select(*(c.alias(n) for n, c in f), F.col("label").cast("double").alias("label"), "kind").orderBy(F.xxhash64("token", "before")).limit(most).collect()
    x = np.array([list(r)[:-1] for r in got], float).reshape(len(got), len(names) + 1)
    kinds = np.array([r["kind"] for r in got])
    x, y = x[:, :-1], x[:, -1]
    apart = np.arange(len(y)) % 3 == 0
    forest = trees.boosted(x[~apart], y[~apart])
    margin = sum((trees.predict(t, x[apart]) for t in forest), np.zeros(int(apart.sum())))
    a, b = trees.calibrate(margin, y[apart])
    p = 1 / (1 + np.exp(-(a * margin + b)))
    least = {}
    for kind in (*MORE, *FAILED.values()):
        own = kinds[apart] == kind
        q, t = p[own], y[apart][own]
        order = np.argsort(-q, kind="stable")
        right = np.cumsum(t[order]) / np.arange(1, len(q) + 1)
        good = np.flatnonzero(right >= PRECISION)
        least[kind] = max(0.5, float(q[order][good[-1]])) if len(good) else 2.0
    return forest, names, a, b, least


@cache
def _fitted(spark: SparkSession):
    return fit(labelled(spark))


def scan(docs: DataFrame, model=None, text_col: str = "text") -> DataFrame:
    """All columns of docs and a struct `_pii`: base and more, arrays of (kind, start, end) in order of start and kind, and how many candidates were scored."""
    forest, names, a, b, least = model or _fitted(docs.sparkSession)
    c = lambda name: F.col(f"__pii_{name}")
    step = spans.apart(docs, __pii_text=F.coalesce(docs[text_col].cast("string"), F.lit("")))
    patterns = BASE | MORE
    hint = {"email": c("text").contains("@"), "phone": c("text").contains("+"), "address": F.lower(c("text")).contains("dot")}
    none = F.array().cast("array<string>")
    step = step.withColumns({f"__pii_{k}_found": F.when(hint[k], spans.matches(c("text"), p)).otherwise(none) if k in hint else spans.matches(c("text"), p) for k, p in patterns.items()})
    step = step.withColumns({f"__pii_{k}_between": spans.around(c("text"), p, c(f"{k}_found")) for k, p in patterns.items()})
    step = step.withColumns({f"__pii_{k}_starts": spans.starts(c(f"{k}_found"), c(f"{k}_between")) for k in patterns})
    empty = F.array().cast("array<struct<start: bigint, rank: int, kind: string, end: bigint>>")

    def span(k: str, rank: int, name: str | None = None):
        return lambda m, i: F.struct(F.get(c(f"{k}_starts"), i).alias("start"), F.lit(rank).alias("rank"), F.lit(name or k).alias("kind"), (F.get(c(f"{k}_starts"), i) + F.char_length(m)).alias("end"))

    def tested(k: str, rank: int) -> Column:
        both = F.transform(c(f"{k}_found"), lambda m, i: F.struct(_passes(k, m).alias("ok"), span(k, rank)(m, i).alias("s")))
        return F.when(F.size(c(f"{k}_found")) > 0, F.transform(F.filter(both, lambda x: x["ok"]), lambda x: x["s"])).otherwise(empty)

    step = step.withColumn("__pii_base", F.array_sort(F.concat(*(tested(k, r) for r, k in enumerate(KINDS)))))

    def seen(name: str, rank: int, k: str | None = None) -> Column:
        k = k or name
        near = lambda m, i: F.struct(m.alias("token"), F.right(F.get(c(f"{k}_between"), i), F.lit(40)).alias("before"), F.left(F.get(c(f"{k}_between"), i + 1), F.lit(40)).alias("after"), F.lit(name).alias("kind"), span(k, rank, name)(m, i).alias("s"))
        kind = "array<struct<token: string, before: string, after: string, kind: string, s: struct<start: bigint, rank: int, kind: string, end: bigint>>>"
        return F.when(F.size(c(f"{k}_found")) > 0, F.transform(c(f"{k}_found"), near)).otherwise(F.array().cast(kind))

    def failed(k: str, rank: int) -> Column:
        # Fewer digits name nobody. They are by far the most, so they go before anything is compared with base spans.
        enough = lambda x: F.char_length(_digits(x["token"])) >= LEAST_DIGITS[k]
        kept = F.filter(F.filter(seen(FAILED[k], rank, k), enough), lambda x: ~_passes(k, x["token"]))
        return F.when(F.size(c(f"{k}_found")) > 0, kept).otherwise(seen(FAILED[k], rank, k))

    step = step.withColumn("__pii_seen", F.concat(*(seen(k, len(KINDS) + r) for r, k in enumerate(MORE)), *(failed(k, len(KINDS) + len(MORE) + r) for r, k in enumerate(FAILED))))
    # Candidates may overlap base spans and each other; one that a base span holds already adds nothing.
    held = lambda x: F.exists(c("base"), lambda y: (y["start"] <= x["s"]["start"]) & (x["s"]["end"] <= y["end"]))
    step = step.withColumn("__pii_seen", F.filter(c("seen"), lambda x: ~held(x)))
    step = step.withColumn("__pii_facts", F.transform(c("seen"), lambda x: F.struct(*(v.alias(n) for n, v in features(x["token"], x["before"], x["after"], x["kind"])))))
    step = step.withColumn("__pii_p", F.expr(f"transform(__pii_facts, f -> 1 / (1 + exp(-({a!r}D * {trees.total(forest, names, 'f')} + ({b!r}D)))))"))
    bar = lambda x: F.coalesce(*(F.when(x["kind"] == k, v) for k, v in least.items()))
    scored = F.zip_with(c("seen"), c("p"), lambda x, p: F.struct(x["s"].alias("s"), (p >= bar(x)).alias("ok")))
    step = step.withColumn("__pii_more", F.array_sort(F.transform(F.filter(scored, lambda x: x["ok"]), lambda x: x["s"])))
    # Of equal spans, the first generator's stays.
    first = lambda x: ~F.exists(c("more"), lambda y: (y["start"] == x["start"]) & (y["end"] == x["end"]) & (y["rank"] < x["rank"]))
    step = step.withColumn("__pii_more", F.filter(c("more"), first))
    return spans.together(step, docs, "_pii", F.struct(c("base").alias("base"), c("more").alias("more"), F.size(c("seen")).cast("long").alias("scored")))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(kind: str) -> Column:
    """Base spans of a kind."""
    return F.size(F.filter("_pii.base", lambda s: s["kind"] == kind)).cast("long")
