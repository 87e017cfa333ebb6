"""Spelling variants, source divergence and sharding against plain Python, with nulls, ties, repeats and empty tables."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.llm import divergence, queries, shards, spelling

SMALL = "/root/testdata/sf0.001"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(v, w)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (form, len(near), n, counts.get(form))
    rows = set()
    for w, (form, near, n, m) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n, near, m))
    return rows


def as_rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_trie_pairs_equal_all_pairs():
    rnd = random.Random(1)
    for _ in range(40):
        letters = rnd.choice(["ab", "abcé"])
        words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7))) for _ in range(rnd.choice([1, 4, 120]))})
        a, b = spelling.trie_pairs(words, np.zeros(len(words), int))
        got = sorted(tuple(sorted((words[i], words[j]))) for i, j in zip(a, b, strict=True))
        assert got == [p for p in itertools.combinations(words, 2) if one_edit(*p)]


def test_crc_of_slices():
    data = np.frombuffer(b"alpha beta" + b"x" * 200, np.uint8)
    start, end = np.array([0, 6, 6]), np.array([5, 10, 210])
    before = np.array([zlib.crc32(b"7:")] * 3, np.uint32)
    assert spelling.crc32_after(before, data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes(), zlib.crc32(b"7:")) for a, b in zip(start, end, strict=True)]


@pytest.mark.parametrize("block,at_once", [(4096, 8192), (3, 5)])
def test_spelling_groups_whatever_the_blocks(spark, block, at_once):
    rnd = random.Random(2)
    counts = {"".join(rnd.choice("abc") for _ in range(rnd.randint(6, 8))): rnd.choice([5, 5, 26, 130, 700]) for _ in range(250)}
    counts |= {"prefixa": 5, "prefix": 25, "prefixé": 9, "xprefix": 5, "refixx": 7, "y" * 3000: 50, "y" * 3001: 5, "ééééééé": 5, "éééééé": 25}
    got = as_rows(spelling.group(spark.createDataFrame(list(counts.items()), "word string, n bigint"), block=block, at_once=at_once))
    assert got == plain_groups(counts)


def test_vocabulary_of_odd_texts(spark):
    rows = [(1, "Letters LETTERS lettérs"), (1, "Letters LETTERS lettérs"), (None, "letters"), (2, None), (3, ""), (4, "12 -- 日本語 !"), (5, "letters×÷ ab" + "Z" * 100_000)]
    docs = spark.createDataFrame([(i, t, "x", 9, 8) for i, t in rows], "doc_id long, text string, word string, n long, depth int")
    want = Counter()
    for i, t in rows:
        for w in ["".join(g).lower() for ok, g in itertools.groupby(t or "", lambda c: c.isascii() and c.isalpha() or "À" <= c <= "ÿ") if ok]:
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            want[w if h % 3 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    got = {r.word: r.n for r in spelling.vocabulary(docs, spoil=3, least_points=6, least_count=2).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2 and len(w) >= 6} and got
    assert spelling.group(spelling.vocabulary(docs.limit(0))).count() == 0


def plain_audit(rows, least=3, top=200):
    docs = [(l or "", s or "", Counter("".join(g) for ok, g in itertools.groupby("".join(c.lower() if c.isascii() else c for c in t or ""), lambda c: not c.isascii() or c.isalpha()) if ok)) for l, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, groups = Counter(), defaultdict(Counter)
        for l, s, c in docs:
            if l == lang:
                df.update(c.keys())
                groups[s].update(c)
        kept = [t for t, n in df.items() if n >= least]

        def share(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize("cells,top", [(1 << 19, 200), (6, 2)])
def test_divergence_whatever_the_tiles(spark, cells, top):
    rnd = random.Random(3)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["Été", "日本", "z" * 5000]
    rows = [(rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", None]), rnd.choice([None, "", " ".join(rnd.choices(words, k=12))])) for _ in range(80)]
    rows += [("fr", "a", "une deux"), ("fr", "b", None), ("it", None, None), *rows[:10]]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, term int, value int")
    got = sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in divergence.audit(docs, cells=cells, top=top).collect())
    assert got == plain_audit(rows, top=top)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_shares_are_exact():
    c, total = [0, 5, 10**13, 3 * 10**14], 10**15
    assert divergence.shares(np.array(c), total, 77).tolist() == [1 + 10**9 * (x + 1) // (total + 77) for x in c]


def plain_best_fit(sizes, capacity):
    left, out = [], []
    for x in sizes:
        fits = [(r, i) for i, r in enumerate(left) if r >= x]
        if fits:
            i = min(fits)[1]
        else:
            i = len(left)
            left.append(max(capacity, x))
        left[i] -= x
        out.append(i)
    return out


def test_best_fit_equals_plain():
    rnd = random.Random(4)
    for _ in range(30):
        sizes = sorted((rnd.randint(1, 40) for _ in range(200)), reverse=True)
        bins = shards.BestFit(33)
        assert [bins.put(x) for x in sizes] == plain_best_fit(sizes, 33)


def test_pack_is_near_equal_and_gives_the_large_their_own():
    rnd = random.Random(5)
    sizes = [rnd.randint(1, 100) for _ in range(3000)]
    put = shards.pack([*sizes, 10**6], 16)
    load = Counter()
    for x, s in zip([*sizes, 10**6], put, strict=True):
        load[s] += x
    rest = sorted(load.values())[:-1]
    assert load[put[-1]] == 10**6 and len(load) == 16 and rest[-1] - rest[0] <= 100
    assert shards.pack([], 4) == [] and sorted(shards.pack([5, 5], 4)) == [0, 1]


def checked_shards(rows, got, n):
    """Laws of a sharding of (id, text)."""
    assert Counter(r[0] for r in rows) == Counter(r.doc_id for r in got)
    of = defaultdict(set)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    for r in got:
        assert any((r.size, r.text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts[r.doc_id])
        assert r.law == "bytes" and 0 <= r.shard < n and r.grown_shard is None
        of[(r.size, r.text_crc32)].add(r.shard)
    assert all(len(s) == 1 for s in of.values())
    for s in range(n):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_shards_of_odd_rows(spark):
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choices("abcé ", k=rnd.randint(0, 90)))) for i in range(400)]
    rows += [(i, "the same text again") for i in range(400, 600)] + [(None, None), (7, ""), (7, ""), (8, "x" * 30_000)]
    docs = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], "doc_id long, text string, shard int, size string")
    got = shards.shard(docs, 4, parts=16, hot=10).collect()
    checked_shards(rows, got, 4)
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    rest = sorted(load.values())[:-1]
    assert rest[-1] - rest[0] <= 0.05 * rest[-1]
    assert shards.shard(docs.limit(0), 4).count() == 0


def test_sharding_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_sharding(spark, SMALL).collect()
    checked_shards(rows, got, 16)
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert len(load) == 16 and max(load.values()) - min(load.values()) <= max(r.size for r in got)


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("a", "text one"), ("b", "text two")], "name string, body string")
    assert {r.name for r in shards.shard(docs, 2, id_col="name", text_col="body").collect()} == {"a", "b"}
    assert spelling.vocabulary(docs.withColumn("body", F.lit("letters")), "name", "body", least_count=1, spoil=0).collect()[0].n == 2
