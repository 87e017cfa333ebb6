"""Operators on texts against brute force, round trips and held-out rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from seqlake.llm import bpe, decontaminate, kernels, minhash, pii, queries, secret_scan, suffix_index, toxicity, trees

SMALL = "/root/testdata/sf0.001"
LOWER = bytes(kernels.lower_ascii(np.arange(256, dtype=np.uint8)))


def texts(seed, letters, pieces, n, longest=60):
    r = random.Random(seed)
    return ["".join(r.choice(letters + pieces) for _ in range(r.randint(0, longest))) for _ in range(n)]


# Byte-level BPE


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(public):
    pieces = ["'s", "'re", "'ll", "n't", " '", "  ", "\u0085", "​", "\x1c", "<|endoftext|>"]
    sample = ["", " ", "'s", "a" * 5000, "don't 's 'S x''s !'s \n's  \n  a  ", "\x00\x00", "𝒳" * 300, *texts(1, list("ab '  \n\t strvemdl9.!é𝒳中١'"), pieces, 4000)]
    enc, got = bpe.encoder(queries.RANKS), []
    for _, data, off in kernels.chunks(pa.array(sample), 4000):
        ids, where, first = enc.encode_chunk(data, off)
        assert bytes(enc.decode(ids)) == data.tobytes() and (np.diff(where) > 0).all()
        got += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [public.encode_ordinary(t) for t in sample]


def test_bpe_query(spark, public):
    rows = {r.doc_id: r for r in queries.op5_byte_bpe(spark, SMALL).collect()}
    for i, t in duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall():
        ids = public.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_encode_decode_offsets(spark):
    df = spark.createDataFrame([(1, "hé llo", 9), (2, None, 9), (2, None, 9), (None, "", 9)], "doc_id long, text string, ids int")
    t = bpe.encode(df, queries.RANKS)
    assert sorted(bytes(r.decoded) for r in bpe.decode(t, queries.RANKS).collect()) == [b"", b"", b"", "hé llo".encode()]
    assert t.where("doc_id = 1").first().offsets[0] == 0 and bpe.encode(df.limit(0), queries.RANKS).count() == 0


# Decontamination


def plain_hits(docs, items, n):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = [0] * len(w), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if (x := tuple(w[k : k + m])) in windows:
                    found |= windows[x]
                    hit[k : k + m] = [1] * m
        out.append((d, len(w), sum(hit), sorted(found), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_decontamination_equals_brute_force(spark, seed):
    n = [1, 2, 5, 13][seed]
    docs = [(i, t) for i, t in enumerate(texts(seed, ["a", "b", "C", "é", " ", " ", "--"], [], 40, 120))] + [(90, None), (91, ""), (1, "a b")]
    items = [(i, t) for i, t in enumerate(texts(seed + 9, ["a", "b", "é", " ", " "], [], 6, 30))] + [(0, "b a"), (7, None)]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, items int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    want = sorted(plain_hits(docs, [(str(i), t) for i, t in items], n), key=key)
    for block, shard in ((1 << 20, 1 << 20), (20, 100)):
        got = decontaminate.scan(df, bench, n, block_bytes=block, shard_bytes=shard).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
        assert sorted([tuple(r) for r in got], key=key) == want
    assert decontaminate.scan(df.limit(0), bench).count() == 0 and decontaminate.scan(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_suffix_array_orders_suffixes():
    r = np.random.default_rng(1)
    for _ in range(50):
        s = np.append(r.integers(0, 3, r.integers(1, 60)), 0)
        keys = {i: (*s[i : i + int(np.flatnonzero(s[i:] == 0)[0])].tolist(), -1, i) for i in range(len(s))}
        want = sorted(range(len(s)), key=lambda i: [(x, 0) if x > 0 else (0, keys[i][-1]) for x in keys[i][:-1]])
        assert decontaminate.suffix_array(s, 2).tolist() == want


# Near-duplicates


def plain_components(rows, width):
    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().translate(LOWER))
        return set() if not w else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}

    sets, up, having = [shingles(t) for _, t in rows], list(range(len(rows))), {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s for j in having.get(g, ())).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                up[find(i)] = find(j)
        for g in s:
            having.setdefault(g, []).append(i)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(((d, len(sets[i]), min([x for x in groups[find(i)] if x is not None], default=None)) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    r, rows = random.Random(2), []
    vocabulary = [f"w{i}" for i in range(500)]
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([5, 30, 100, 400]))]
        for _ in range(r.randint(1, 40)):
            c = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                c[r.randrange(len(c))] = r.choice(vocabulary)
            base = c if r.random() < 0.5 else base
            rows.append((len(rows) + 5, " ".join(c) if r.random() < 0.9 else "  ".join(c).upper()))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "One two"), (904, "one  TWO"), (5, rows[3][1]), (None, rows[3][1]), (None, "solo x y z a")]
    df = spark.createDataFrame([(a, b, "q") for a, b in rows], "doc_id long, text string, node string").repartition(3)
    got = minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == plain_components(rows, 4)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_posterior_bounds_rise():
    least = minhash.least_matches(80)
    assert all(a < b for a, b in zip(least[:-1], least[1:], strict=True)) and least[-1] < 0.8 * minhash.HASHES


# Repeated strings


@pytest.mark.parametrize("length,hot,batches,full", [(200, 2_000, 2, None), (20, 2_000, 3, 4), (7, 3, 2, None), (66, 2_000, 3, 2)])
def test_suffix_removal_equals_brute_force(spark, monkeypatch, length, hot, batches, full):
    monkeypatch.setattr(suffix_index, "HOT", hot)
    if full:  # ranges are halved from batch to batch, and values are cut
        monkeypatch.setattr(suffix_index, "RANGE_ENTRIES", full)
        monkeypatch.setattr(suffix_index, "PIECE", 3)
    r = random.Random(length)
    pool = ["".join(r.choice("abé ") for _ in range(r.randint(1, 3 * length))) for _ in range(10)] + ["a" * 3 * length, "ab" * length]
    rows = [(i, "".join(r.choice(pool) if r.random() < 0.7 else "".join(r.choice("xyz") for _ in range(r.randint(0, length))) for _ in range(r.randint(0, 6)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, rows[3][1]), (3, rows[3][1]), (None, rows[5][1])]
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    want = []
    for d, b in raw:
        gone = [0] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [1] * length
        want.append((d, len(b), sum(gone), sum(g and not p for g, p in zip(gone, [0, *gone], strict=False)), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, key int").repartition(3)
    got = [(*r[:4], bytes(r[4])) for r in suffix_index.remove(df, length, batches=batches).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("full,piece,ranges", [(2 << 20, 1 << 18, 3), (20, 5, 24)])
def test_index_family_goes_on_from_its_folder(spark, tmp_path, monkeypatch, full, piece, ranges):
    monkeypatch.setattr(suffix_index, "RANGE_ENTRIES", full)
    monkeypatch.setattr(suffix_index, "PIECE", piece)
    r, every = np.random.default_rng(3), []
    for b in range(5):
        f = suffix_index.IndexFamily(spark, f"file://{tmp_path}/family", ranges=3)  # opened again for each batch
        rows = np.zeros(60, suffix_index.ENTRY)
        rows["key"], rows["c1"], rows["n"] = r.integers(0, 1 << 63, 150)[r.integers(0, 150, 60)], r.integers(0, 2, 60), 1
        if b:
            rows["key"][:30] = r.choice([k for k, _ in every], 30)
        every += zip(rows["key"].tolist(), rows["c1"].tolist(), strict=True)
        blobs = list(zip(*suffix_index._blobs(rows, suffix_index._range(rows["key"].copy(), 3)), strict=True))
        f.add(spark.createDataFrame(blobs, suffix_index.BLOBS), dealt=3)
        assert f.batches == b + 1 and len(f.levels) <= 3
    n, by = Counter(every), Counter(k for k, _ in every)
    assert f.ranges == ranges
    stored = f.blobs().select("kind", F.length("payload").alias("bytes")).collect()
    assert all(x.bytes <= piece * (8 if x.kind else suffix_index.ENTRY.itemsize) for x in stored)
    got = {}
    for row in suffix_index.IndexFamily(spark, f"file://{tmp_path}/family").blobs().groupBy("range").agg(F.collect_list(F.struct("kind", "payload")).alias("x")).collect():
        index, contents = suffix_index.matches([np.frombuffer(x.payload, suffix_index.ENTRY) for x in row.x if x.kind == 0], [np.frombuffer(x.payload, "<i8") for x in row.x if x.kind == 1])
        got |= {(e["key"], e["c1"]): (e["n"], c) for e, c in zip(index.tolist() and [dict(zip(index.dtype.names, e, strict=True)) for e in index.tolist()], contents.tolist(), strict=True)}
    assert got == {x: (m, len({y for y in n if y[0] == x[0]})) for x, m in n.items() if by[x[0]] > 1}


def thue_morse(letters, n):
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return "".join(letters[x] for x in out)


def test_words_of_regular_structure_are_told_apart(spark):
    """Sums of powers modulo 2^64 are equal for these two, whatever the base."""
    a, b = thue_morse("ab", 4096), thue_morse("ba", 4096)
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1}
    found = decontaminate.scan(df, spark.createDataFrame([(7, b)], "item_id long, text string")).collect()
    assert {r.doc_id: r.n_hit for r in found} == {1: 0, 2: 1, 3: 0}
    got = {(r[0], bytes(r[4])) for r in suffix_index.remove(df.where("doc_id < 3"), 4000).collect()}
    assert got == {(1, a.encode()), (2, b.encode())}


def test_ranks_order_strings():
    r = np.random.default_rng(8)
    for length in (1, 3, 8, 9, 20, 33):
        data = r.integers(97, 99, 300).astype(np.uint8)
        have = [data[i : i + length].tobytes() for i in range(len(data) - length + 1)]
        place = {x: i for i, x in enumerate(sorted(set(have)))}
        assert suffix_index.ranks(data, length).tolist() == [place[x] for x in have]


# Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(x) if i % 2 == 0 else 2 * int(x) - 9 * (int(x) > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def plain_spans(t):
    def good(kind, m):
        d = re.sub(r"\D", "", m)
        return kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15

    found = [(m.start(), r, f"{k}:{m.start()}:{m.end()}") for r, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], t or "") if good(k, m.group())]
    return ",".join(x[2] for x in sorted(found))


def test_base_spans_equal_python(spark):
    pieces = ["a@b.c", "1.2.3.4", "4785380592391139", "+1 (743) 555-3824", " 255"]
    rows = list(enumerate(texts(4, list("ab1.@-+ 5%_é𝒳()0"), pieces, 1500, 50))) + [(9001, None), (9002, "a" * 50000), (9003, "a@" + "b.c" * 20000), (9004, "1." * 3000), (9008, "999999999999.1.1.1 00000255.1.1.1")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, found int").repartition(4)
    got = {r.doc_id: (r.text, r.b) for r in pii.scan(df).select("doc_id", "text", pii.listed(F.col("_pii.base")).alias("b")).collect()}
    assert len(got) == len(rows) and all(b == plain_spans(t) for t, b in got.values())
    assert pii.scan(df.limit(0)).count() == 0


def test_added_spans(spark):
    t = "call 743-555-3824 or ssn 123-45-6789 and jane (at) mail (dot) com, 2024-01-02, order 4411-2222, +1 (743) 555-3824"
    more = pii.scan(spark.createDataFrame([(1, t)], "doc_id long, text string")).select(pii.listed(F.col("_pii.more")).alias("m")).first().m
    assert [t[int(a) : int(b)] for _, a, b in (x.split(":") for x in more.split(","))] == ["743-555-3824", "123-45-6789", "jane (at) mail (dot) com"]


def test_candidates_that_fail_a_base_test(spark):
    t = "pay with card 4785 3805 9239 1130 and not page 4785, +1 555 3824"
    got = pii.scan(spark.createDataFrame([(1, t, 5, 6)], "doc_id long, text string, _pii int, __pii_text int")).first()
    assert got["__pii_text"] == 6 and not got._pii.base and got._pii.scored >= 2
    assert "4785 3805 9239 1130" in [t[x.start : x.end] for x in got._pii.more]
    assert not any(t[x.start : x.end] == "4785" for x in got._pii.more)


def test_working_columns_do_not_clash(spark):
    row = (1, 'token = "11acdfb36bb72224148e6160f674b4be45601bff"', 3, 4)
    got = secret_scan.scan(spark.createDataFrame([row], "doc_id long, text string, _scan int, __scan_found int"), F.lit("a")).first()
    assert got["__scan_found"] == 4 and got._scan.redacted == 'token = "[SECRET]"'


# Secrets


def test_unquoted_secrets_in_texts(spark):
    r = random.Random(11)
    mixed = lambda n: "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    forms = [
        ("API_KEY={}\n", lambda: "sk_live_" + mixed(24)), ("see https://a.example/cb?x=1&access_token={}&lang=en now", lambda: mixed(32)), ("oauth2_client_secret={}\n", lambda: mixed(40)),
        ("export DB_PASSWORD={}\n", lambda: mixed(6) + "!" + mixed(3) + "$" + mixed(2)), ("password: {}\n", lambda: "".join(r.choice("bcdfghkQRSTVWXZ!$#") for _ in range(14))), ("secret={} \n", lambda: mixed(12)),
    ]
    rows = []
    for i in range(240):
        form, make = forms[i % len(forms)]
        value = make()
        rows.append((i, "the words before it\n" + form.format(value) + "and the words after", value))
    df = spark.createDataFrame(rows, "doc_id long, text string, value string")
    out = secret_scan.scan(df, F.lit("app/.env")).collect()
    exact = [x for x in out if x.value in [x.text[c.start : c.end] for c in x._scan.candidates]]
    assert len(exact) == len(rows)
    hit = {f: [] for f in range(len(forms))}
    for x in out:
        hit[x.doc_id % len(forms)].append(x.value not in x._scan.redacted)
    assert all(sum(h) >= 0.9 * len(h) for h in hit.values())
    plain = spark.createDataFrame([(1, "password: required-name and token: undefined, the secret = disabled here")], "doc_id long, text string")
    assert "[SECRET]" not in secret_scan.scan(plain, F.lit("src")).first()._scan.redacted


def test_secret_candidates_and_findings(spark):
    rows = [(1, 'x token = "11acdfb36bb72224148e6160f674b4be45601bff" é𝒳 4785380592391139$$$', "src1"), (2, None, None), (3, "", "a"), (4, "sha1: 11acdfb36bb72224148e6160f674b4be45601bff thtion4erandnthe12", "a"), (9, "a1" * 60000, "q"), (10, " ".join(f"k{i:015d}" for i in range(3000)), "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, src string").withColumn("found", F.lit(1))
    out = {r.doc_id: r for r in secret_scan.scan(df, F.col("src")).withColumn("secrets", secret_scan.secrets()).collect()}
    for r in out.values():
        assert [(c.start, c.end) for c in r._scan.candidates] == [m.span() for m in re.finditer(secret_scan.CANDIDATE, r.text or "")]
    assert out[1]._scan.redacted == 'x token = "[SECRET]" é𝒳 4785380592391139$$$' and not out[4].secrets and out[2]._scan.redacted == ""


def test_forest_on_unseen_findings(spark):
    forest, _ = secret_scan.fit(secret_scan.findings(spark, 2000))
    f = secret_scan.features(*(F.col(c) for c in ("token", "before", "after", "path")))
    unseen = secret_scan.findings(spark, 3000).select(*(c.alias(n) for n, c in f), "label").collect()[2000:]
    x = np.array([list(r) for r in unseen], float)
    p = sum(trees.predict(t, x[:, :-1]) for t in forest) / len(forest)
    assert ((p >= 0.5) == x[:, -1]).mean() > 0.98


def test_trees_as_sql_agree(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 3)).round(3)
    fitted = trees.boosted(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=5)
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double").select(F.struct("a", "b", "c").alias("f"))
    got = [v.y for v in df.select(F.expr(trees.total(fitted, ["a", "b", "c"], "f")).alias("y")).collect()]
    assert np.allclose(got, sum(trees.predict(t, x) for t in fitted), atol=1e-6)


# Toxicity


def test_toxicity_on_held_out_rows():
    rows = duckdb.sql("select doc_id, text, toxic from '/root/testdata/sf0.1/documents.parquet' join '/root/testdata/sf0.1/labels.parquet' using (doc_id) order by hash(doc_id)").fetchall()
    out = [zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in rows]
    model = toxicity.fit([r[1] or "" for r, o in zip(rows, out, strict=True) if not o], [r[2] for r, o in zip(rows, out, strict=True) if not o])
    logits = np.concatenate([model.logits(d, off) for _, d, off in kernels.chunks(pa.array([r[1] for r, o in zip(rows, out, strict=True) if o]))])
    y = np.array([r[2] for r, o in zip(rows, out, strict=True) if o])
    predicted = logits >= np.log(0.7 / 0.3)
    assert (predicted == y).mean() > 0.96 and predicted[y == 1].mean() > 0.88


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "you idiot", 5.0), (2, None, 0.0), (3, "", 0.0), (1, "fine words", 0.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 4 and all(r.predicted == 0 and 0 <= r.score <= 1 for r in got) and toxicity.score(docs.limit(0), model).count() == 0


def test_misspellings_share_vectors():
    r = random.Random(7)
    plain = [" ".join(r.choice(["house", "tree", "river", "stone"]) for _ in range(30)) for _ in range(300)]
    toxic = [t + " dreadfulness" * 3 for t in plain[:150]]
    model = toxicity.fit(toxic + plain[150:], [1] * 150 + [0] * 150)
    data, off = kernels.raw(pa.array([plain[0] + " dreadfulnes" * 3, plain[1]]))
    a, b = model.logits(data, off)
    assert a > b + 1


def test_toxicity_is_validated_by_folds():
    rnd = random.Random(9)
    good, bad = ["river", "winter", "garden", "people"], ["vilewort", "grimsnark"]
    texts = [" ".join(rnd.choices(good, k=8) + ([rnd.choice(bad)] * 2 if i % 3 == 0 else [])) for i in range(60)]
    labels = [int(i % 3 == 0) for i in range(60)]
    z = toxicity.cross_validated(texts, labels)
    assert all((a > 0) == (b == 1) for a, b in zip(z, labels, strict=True))
    one = toxicity.cross_validated(texts, labels, only=0)
    assert 0 < sum(x == x for x in one) < 60
