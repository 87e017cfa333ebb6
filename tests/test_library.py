"""Queries against DuckDB on the smallest tables; operators against goldens and plain Python."""

import collections
import glob
import itertools
import math
import os
import pathlib
import random
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.functions import seq as S
from seqlake.operators import binning, graph, kmers, qc, similar, superkmers
from seqlake.operators import features as features_
from seqlake.plans import registry
from seqlake.plans.shared import cut
from seqlake.sources import fastx, sinks

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return repr(round(float(v), 6)) if v.__class__.__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    r = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() >= 0


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("x")).first().x


def test_canonical_goldens(spark):
    assert one(spark, "ATCG", S.canonical) == one(spark, "CGAT", S.canonical) == "ATCG"
    assert [round(one(spark, x, S.gc), 6) for x in ("ATCG", "AAAA", "CCGG", "")] == [0.5, 0, 1, 0]
    assert [round(one(spark, x, S.entropy), 6) for x in ("AAAA", "AACCGGTT", "AAAAACCCCC")] == [0, 1, 0.5]
    assert one(spark, "ACGT", lambda c: S.kmers(c, 5)) == []
    assert one(spark, "ACNGT", lambda c: S.clean_kmers(c, 2)) == ["AC", "GT"]


def test_kmers_of_long_sequences(spark):
    s = "".join(random.Random(1).choice("ACGT") for _ in range(1500))
    for k in (1, 7, 300):
        assert one(spark, s, lambda c, k=k: S.kmers(c, k)) == [s[i : i + k] for i in range(len(s) - k + 1)]


def test_ambiguous_policies(spark):
    assert one(spark, "ATNN", lambda c: S.mask_policy(c, "allow")) == "ATNN"
    assert one(spark, "ANNN", lambda c: S.mask_policy(c, "allow")) is None
    assert one(spark, "ATCN", lambda c: S.mask_policy(c, "skip")) is None
    assert one(spark, "GGTN", lambda c: S.mask_policy(c, "context")) == "GGTG"


def test_adapter_goldens():
    read = "ACGTACGTACGTACGT"
    assert qc.find_adapter(read + qc.ADAPTERS["truseq_r1"]) == (0, 16, 33, 0)
    assert qc.find_adapter(read + qc.ADAPTERS["truseq_r1"][:10]) == (0, 16, 10, 0)
    assert qc.find_adapter(read) is None and qc.find_adapter("ACG") is None


def test_adapter_presets():
    read = "ACGTACGTACGTACGT"
    assert [qc.find_adapter(read + a)[0] for a in qc.ADAPTERS.values()] == [0, 0, 2, 3, 4, 3, 6]  # both TruSeq adapters start alike
    assert qc.find_adapter(read + qc.ADAPTERS["truseq_r1"][:6], "lenient") == (0, 16, 6, 0) and qc.find_adapter(read + qc.ADAPTERS["truseq_r1"][:6]) is None
    assert qc.find_adapter(read + qc.ADAPTERS["truseq_r1"][:9], "strict") is None and qc.find_adapter(read + "AGATCGGAAG", "none") is None
    assert qc.find_adapter(read + qc.ADAPTERS["nextera"], "strict")[0] == list(qc.ADAPTERS).index("small_dna_2")


def test_mates_are_cut_at_exact_adapters(spark):
    a = qc.ADAPTERS["truseq_r1"]
    assert [one(spark, x, qc.exact_adapter) for x in ("ACGT" + a + "TT", "ACGT" + a[:8], "ACGT" + a[:6], a[:9] + "T" + a[:9], "")] == [4, 4, None, None, None]


def test_coverage_bins(spark):
    cov = [10, 10, 10, 11, 9, 40, 41, 100, 39, 70, 3]
    df = spark.createDataFrame([(i, float(c)) for i, c in enumerate(cov)], "contig_id long, coverage double")
    assert [r.bin for r in graph.coverage_bins(df).orderBy("contig_id").collect()] == [0, 0, 0, 0, 0, 1, 1, 2, 1, 2, 3]
    assert graph.coverage_bins(df.limit(0)).count() == 0


def test_cascade_reasons(spark):
    rows = [(1, "ACGT" * 18, [40] * 72), (2, "ACGT" * 18, [0] * 72), (3, "ACGTACGT", [40] * 8), (4, "", []), (5, "ACGT" * 18, [40] * 30 + [0] * 42)]
    df = spark.createDataFrame(rows, "read_id long, seq string, q array<long>")
    got = {r.read_id: r.status for r in qc.cascade(df, "lenient").collect()}
    assert got[1] == "pass" and got[2] == "failed_quality" and got[3] == "failed_length" and got[4] == "failed_quality" and got[5] == "pass"


@pytest.mark.parametrize("at_once", [graph.AT_ONCE, 0])
def test_unitigs_cycle_and_branch(spark, at_once, monkeypatch):
    nodes = spark.createDataFrame([(x, 2) for x in ("AA", "AC", "CA", "GT", "TT", "TG", "TA")], "mer string, coverage long")
    edges = spark.createDataFrame([("AC", "CA", 1), ("CA", "AC", 1), ("GT", "TT", 1), ("TT", "TG", 1), ("TT", "TA", 1)], "src string, dst string, weight long")
    spelled = graph.paths
    monkeypatch.setattr(graph, "paths", lambda n, e, c: spelled(n, e, c, at_once))
    want = {"AA": ("AA", 1), "AC": ("ACA", 2), "GT": ("GTT", 2), "TG": ("TG", 1), "TA": ("TA", 1)}
    assert {r.head: (r.seq, r.nodes) for r in graph.unitigs(cut(nodes), cut(edges), 2, cut).collect()} == want
    packed = [x.select(*(S.pack(F.col(c)).alias(c) if t == "string" else c for c, t in x.dtypes)) for x in (nodes, edges)]
    assert {r.head: (r.seq, r.nodes) for r in graph.spelled(graph.unitigs(cut(packed[0]), cut(packed[1]), 2, cut), 2, "head").collect()} == want


def test_a_path_of_a_million_nodes(spark):
    n = 1_000_000
    nodes = spark.range(n).select((F.col("id") * 7919 % n).alias("mer"), F.lit(3).cast("long").alias("coverage"))
    edges = spark.range(n - 1).select((F.col("id") * 7919 % n).alias("src"), ((F.col("id") + 1) * 7919 % n).alias("dst"), F.lit(1).cast("long").alias("weight"))
    chunks = graph.unitig_chunks(cut(nodes), cut(edges), 12, cut).select("head", "number", F.char_length("bases").alias("len"), "nodes", "coverage").orderBy("number").collect()
    assert len(chunks) == -(-n // graph.CHUNK) and {c.head for c in chunks} == {0} and max(c.nodes for c in chunks) == graph.CHUNK
    assert sum(c.nodes for c in chunks) == n and sum(c.len for c in chunks) == n + 11 and sum(c.coverage for c in chunks) == 3 * n


def test_pointers_are_followed_from_any_round():
    rnd = random.Random(8)
    for _ in range(30):
        names = rnd.sample(range(1000), 200)
        chains, cycles = [names[:50], names[50:53], names[53:54]], [names[60:67], names[70:72]]
        prev = {b: a for c in chains for a, b in itertools.pairwise(c)} | {c[i]: c[i - 1] for c in cycles for i in range(len(c))}
        want = {m: (c[0], i) for c in chains for i, m in enumerate(c)}
        for c in cycles:
            i = c.index(min(c))
            want |= {m: (min(c), j) for j, m in enumerate(c[i:] + c[:i])}
        state = {m: (p, 1) for m, p in prev.items()}
        heads = {c[0]: (c[0], 0) for c in chains}
        for _ in range(rnd.randint(0, 3)):
            new = {}
            for m, (u, d) in state.items():
                if u in heads:
                    new[m] = ("done", heads[u][0], heads[u][1] + d)
                else:
                    new[m] = ("open", state[u][0], state[u][1] + d)
            heads |= {m: x[1:] for m, x in new.items() if x[0] == "done"}
            state = {m: x[1:] for m, x in new.items() if x[0] == "open"}
        if not state:
            continue
        mer = list(state)
        # Cycles keep single steps here: their least node is found by resolve() alone.
        up, dist = zip(*((prev[m], 1) if any(m in c for c in cycles) else state[m] for m in mer), strict=True)
        known = np.array([u in heads for u in up])
        head, place = (np.array([heads.get(u, (0, 0))[j] for u in up]) for j in (0, 1))
        got = graph.resolve(np.array(mer), np.array(up), np.array(dist), head, place, known, np.array([prev[m] for m in mer]))
        assert {m: (h, p) for m, h, p in zip(mer, *(x.tolist() for x in got), strict=True)} == {m: want[m] for m in mer}


@pytest.mark.parametrize("k", [1, 9, 31, 33, 64, 127])
def test_super_kmers_equal_plain(spark, k):
    rnd = random.Random(k)
    rows = ["".join(rnd.choice("ACGT" if rnd.random() > 0.01 else "N") for _ in range(rnd.choice([0, k - 1, k, 300]))) for _ in range(40)] + ["A" * 500, "acgt", None]
    df = spark.createDataFrame([(x,) for x in rows], "seq string").repartition(3)
    plain = lambda k: collections.Counter(s[i : i + k] for s in rows if s for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT"))
    columns = [F.col(f"w{j}") for j in range(superkmers.words_of(k))]
    got = {r.mer: r.n for r in superkmers.count(df, k).select(superkmers.letters(columns, k).alias("mer"), "n").collect()}
    assert got == plain(k)
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    both = collections.Counter()
    for m, c in plain(k).items():
        both[min(m, rc(m))] += c
    got = {r.mer: r.n for r in superkmers.count(df, k, canonical=True).select(superkmers.letters(columns, k).alias("mer"), "n").collect()}
    assert got == both
    if k <= 31:
        nodes, edges = graph.build(df, k, cut, least=2)
        often = {m for m, c in plain(k).items() if c >= 2}
        assert {r.mer for r in graph.spelled(nodes, k, "mer").collect()} == often
        assert {(r.src, r.dst): r.weight for r in graph.spelled(edges, k, "src", "dst").collect()} == {(m[:-1], m[1:]): c for m, c in plain(k + 1).items() if m[:-1] in often and m[1:] in often}


def test_cleanup_by_hand(spark):
    nodes = spark.createDataFrame([("a", 5), ("b", 2), ("c", 4), ("d", 3), ("e", 9)], "mer string, coverage long")
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", 2), ("c", "d", 3)], "src string, dst string, weight long")
    kept, links = graph.cleanup(nodes, edges)
    assert {r.mer for r in kept.collect()} == {"c", "d"} and [(r.src, r.dst) for r in links.collect()] == [("c", "d")]


def test_components_and_bubbles(spark):
    names = [f"n{i:02d}" for i in range(40)]
    nodes = spark.createDataFrame([(x, 1) for x in names], "mer string, coverage long")
    path = [(names[i], names[i + 1], 1) for i in range(30)]
    edges = spark.createDataFrame(path, "src string, dst string, weight long")
    got = {r.mer: r.component for r in graph.components(nodes, edges, cut).collect()}
    assert all(got[x] == "n00" for x in names[:31]) and all(got[x] == x for x in names[31:])
    e = spark.createDataFrame([("s", "a", 1), ("s", "b", 1), ("a", "c", 1), ("b", "d", 1), ("c", "t", 1), ("d", "t", 1)], "src string, dst string, weight long")
    assert [tuple(r) for r in graph.bubbles(e).collect()] == [("s", "t", 2, "simple")]


def test_repeat_scans():
    assert features_.tandem_share("ACGACGACGTT") == 9 / 11 and features_.tandem_share("ACGT") == 0
    assert features_.inverted_share("TTACGTCC") == 0.5 and features_.inverted_share("") == 0


def plain_vector(s):
    """The 100 + 64 layout of the feature vector in plain Python."""
    n = len(s)
    grams = lambda k: [s[i : i + k] for i in range(n - k + 1)]
    share = lambda part, of: part / of if of else 0.0
    clean = lambda k: collections.Counter(m for m in grams(k) if set(m) <= set("ACGT"))
    pairs, codons = clean(2), clean(3)
    out = [share(s.count(b), n) for b in "ACGT"] + [share(pairs["".join(p)], sum(pairs.values())) for p in itertools.product("ACGT", repeat=2)]
    for family in ("TTT TTC", "TTA TTG", "TCT TCC TCA TCG", "TAT TAC", "TGT TGC", "TGG"):
        f = family.split()
        out += [share(codons[c] * len(f), sum(codons[x] for x in f)) for c in f]
    p = [share(s.count(b), sum(s.count(x) for x in "ACGT")) for b in "ACGT"]
    entropy = -sum(x * math.log2(x) for x in p if x) / 2
    out += [features_.tandem_share(s), features_.inverted_share(s), features_.direct_share(s), share(s.count("CG"), n - 1), 1 - entropy]
    runs = [(b, len(list(g))) for b, g in itertools.groupby(s)]
    out += [share(max((x for c, x in runs if c == b), default=0), n) for b in "ACGT"]
    out += [share(sum(s[i] == s[i + lag] for i in range(n - lag)), max(n - lag, 0)) for lag in (2, 3, 4)]
    diversity = [share(len(set(grams(k))), len(grams(k))) for k in (3, 4, 5, 6)]
    boxes = 0.0
    for box in range(1, min(n, 100) + 1, 5):
        if -(-n // box) > 1:
            boxes = 2.0 if box == 1 else min(2.0, math.log2(-(-n // box)) / math.log2(1 / box))
    out += [entropy, diversity[3], share(sum(1 + (x > 1) for _, x in runs), n), *diversity, boxes]
    kmer = []
    for k in (3, 4, 5, 6):
        c = clean(k)
        kmer += [share(sum(min(x, 10) == i for x in c.values()), len(c)) for i in range(1, 11)]
        packed = [sum("ACGT".index(b) * 4 ** (k - 1 - i) for i, b in enumerate(m)) for m in c]
        kmer += [min(((x * a + b) % features_.PRIME for x in packed), default=2**64 - 1) % 10_000 / 10_000 for a, b in features_.HASHES]
    return out + [0.0] * (100 - len(out)) + kmer[:64]


def test_feature_vectors_hold_all_parts(spark):
    r = random.Random(5)
    seqs = ["".join(r.choices("ACGT", [4, 3, 2, 3], k=n)) for n in (1200, 101, 7, 6, 2)] + ["ACGNTTTCCGATTTN" * 9]
    got = features_.vectors(spark.createDataFrame(list(enumerate(seqs)), "id int, seq string"), "id").collect()
    assert len(got) == len(seqs)
    for row in got:
        assert len(row.features) == 164 and row.features == pytest.approx(plain_vector(seqs[row.id]), abs=1e-9)
    assert [len(x.features) for x in features_.vectors(spark.createDataFrame([(1, ""), (2, None)], "id int, seq string"), "id").collect()] == [164, 164]


def test_files_round_trip(spark, tmp_path):
    reads = spark.createDataFrame([(i, "ACGT" * 5, [30] * 20) for i in range(25)], "read_id long, seq string, q array<long>")
    sinks.fastq(reads).coalesce(1).write.text(str(tmp_path / "r"))
    back = fastx.read_fastq(spark, str(tmp_path / "r"))
    assert back.count() == 25 and back.select("seq").distinct().first().seq == "ACGT" * 5
    assert sorted(r.header for r in back.collect())[0] == "read_0" and back.where("length(quality) = 20").count() == 25
    (tmp_path / "x.fa").write_text(">a one\nACGT\nAC\n>b\n\n>c\nTTT")
    assert sorted(map(tuple, fastx.read_fasta(spark, str(tmp_path / "x.fa")).select("header", "seq").collect())) == [("a one", "ACGTAC"), ("b", ""), ("c", "TTT")]
    (tmp_path / "t.tsv").write_text("RS_1\td__B;s__X y\nRS_2\td__B;s__\nGB_3\td__B;s__A b\nGB_4\td__C;s__X y\n")
    assert [(r.id, r.name) for r in fastx.read_taxonomy(spark, str(tmp_path / "t.tsv")).orderBy("id").collect()] == [(1, "X y"), (2, "A b")]
    with pytest.raises(ValueError):
        fastx.kind("-x.fq")
    assert fastx.kind("a/b.fna.gz") == "fasta" and fastx.kind("r.fq") == "fastq"


def test_fasta_headers_may_hold_the_sign(spark, tmp_path):
    (tmp_path / "y.fa").write_text(">a x>y\nACGT\nAC\n>b\r\nTT\r\n")
    assert sorted(map(tuple, fastx.read_fasta(spark, str(tmp_path / "y.fa")).select("header", "seq").collect())) == [("a x>y", "ACGTAC"), ("b", "TT")]


def test_wrapped_fasta(spark):
    assert one(spark, "A" * 160, sinks.wrapped) == "A" * 80 + "\n" + "A" * 80
    assert one(spark, "A" * 81, sinks.wrapped) == "A" * 80 + "\nA"


def test_sketch_error(spark):
    r = spark.createDataFrame([(1, "".join(random.Random(2).choice("ACGT") for _ in range(4000)))], "read_id long, seq string")
    e = kmers.sketch(r, "read_id", 13).select(F.hll_sketch_estimate("sketch").alias("e")).first().e
    n = kmers.count(r, 13).count()
    assert abs(e - n) < 0.05 * n


def test_kmeans_ends(spark):
    rows = [(i, [float(i % 2) * 10 + i / 100, 0.0]) for i in range(20)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    a, _ = binning.kmeans(v, "id", 2)
    assert {tuple(r) for r in a.select(F.col("id") % 2, "bin").distinct().collect()} in ({(0, 0), (1, 1)}, {(0, 1), (1, 0)})
    assert binning.seeds(v.where("id < 0"), "id", 3) == []


def test_taxa_are_the_references(spark):
    assert len(binning.TAXA) == 47 and binning.TAXA["Escherichia coli"] == 0.51 and "Plasmodium falciparum" not in binning.TAXA
    r = random.Random(7)
    rows = [(i, "".join(r.choices("ACGT", [(1 - g) / 2, g / 2, g / 2, (1 - g) / 2], k=3000))) for i, g in enumerate((0.2, 0.45, 0.55, 0.8))]
    weight = lambda m, g: (g if sum(b in "GC" for b in m) > 2 else 1 - g) / 128
    mers = ["".join(m) for m in itertools.product("ACGT", repeat=4)]
    want = {}
    for i, s in rows:
        n = [sum(s.startswith(m, p) for p in range(len(s) - 3)) for m in mers]
        cos = {t: math.sumprod(n, w) / math.sqrt(math.sumprod(n, n) * math.sumprod(w, w)) for t, g in binning.TAXA.items() for w in [[weight(m, g) for m in mers]]}
        best = sorted((-round(c, 9), t) for t, c in cos.items())
        want[i] = (best[0][1], round(-best[0][0], 6), round(best[1][0] - best[0][0], 6))
    got = binning.classify(spark.createDataFrame(rows, "id long, seq string"), "id", binning.profiles(spark), 0.0).collect()
    assert {x.id: (x.taxon, round(x.confidence, 6), round(x.margin, 6)) for x in got} == want


def test_bin_count_is_chosen_beyond_five(spark):
    r = random.Random(3)
    v = [[1000.0 * (i == 10) + r.random(), r.random()] for i in range(64)]  # the tenth is a seed for no k below 6
    n, want = len(v), []
    for k in range(2, n // 3 + 1):
        want.append((k, sum(min(math.dist(x, v[i * n // k]) ** 2 for i in range(k)) for x in v)))
    drops = [(a[1] - b[1], -b[0]) for a, b in itertools.pairwise(want)]
    best, got = binning.choose_bins(spark.createDataFrame([(i * 3, x) for i, x in enumerate(v)], "id long, v array<double>"), "id")
    assert [k for k, _ in got] == [k for k, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want])
    assert best == -max(drops)[1] > 5
    few = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "id long, v array<double>")
    assert binning.choose_bins(few, "id")[0] == 2 and binning.choose_bins(few.limit(2), "id")[0] == 1


def test_empty_tables(spark):
    r = spark.createDataFrame([], "read_id long, doc_id long, seq string, q array<long>")
    assert kmers.count(r, 3).count() == 0 and qc.cascade(r).count() == 0 and kmers.minimizers(r, 3, 2).count() == 0


def test_entry_point_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "kmer_spectrum" in e.queries()


def test_pipeline_resumes(spark, tmp_path):
    from seqlake import config, pipeline

    r = random.Random(4)
    genome = "".join(r.choice("ACGT") for _ in range(1200))
    rows = [(f"@r{i}", genome[p : p + 100]) for i, p in enumerate(r.randrange(0, 1100) for _ in range(300))]
    (tmp_path / "a.fastq").write_text("".join(f"{h}\n{s}\n+\n{'I' * len(s)}\n" for h, s in rows))
    c = config.Config(k=15)
    one = pipeline.analyze(spark, [str(tmp_path / "a.fastq")], str(tmp_path / "run"), c)
    assert one["reads"] == {"pass": 300} and one["assembly"]["longest"] > 200
    long = spark.read.parquet(str(tmp_path / "run/contigs")).orderBy(F.desc("len")).first().seq
    assert long in genome
    assert pipeline.analyze(spark, [str(tmp_path / "a.fastq")], str(tmp_path / "run"), c) == one
    assert "| assembly | n50 |" in pipeline.markdown(one)
    assert {x.name for x in pipeline.Run(spark, str(tmp_path / "run")).tables().collect()} >= {"reads", "contigs", "features"}


def test_configuration(tmp_path):
    from seqlake import config

    (tmp_path / "c.toml").write_text(config.dump(config.Config(k=21)))
    assert config.load(str(tmp_path / "c.toml")) == config.Config(k=21)
    (tmp_path / "d.toml").write_text("k = 99\n")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "d.toml"))
    assert config.parse_range("15-31") == (15, 31) and config.short(1_234_567) == "1.2M"


def test_entry_point_without_the_corpus_subpackage(tmp_path):
    top = pathlib.Path(__file__).resolve().parents[1]
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(top / name, tmp_path / name)
    shutil.copytree(top / "seqlake", tmp_path / "seqlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q.keys() >= e.oracle_sql().keys() and 'kmer_spectrum' in q and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_fixed_digits_are_those_of_printf(spark):
    rows = spark.range(1, 65).withColumn("x", F.col("id") / 64).select("x", S.fixed(F.col("x"), 4).alias("t")).collect()
    assert [r.t for r in rows] == ["%.4f" % r.x for r in rows]  # halves to even: 1/32 is 0.0312
    record = spark.createDataFrame([(1, "G" + "A" * 31, 32, 2.0)], "contig_id long, seq string, len long, coverage double")
    assert sinks.fasta(record).first().record.startswith(">contig_1 length=32 coverage=2.00 gc=0.0312\n")


@pytest.mark.parametrize("at_once", [graph.AT_ONCE, 16, 0])
def test_roots_of_paths_stars_and_rings(spark, at_once):
    """Rounds put nodes together and few of them suffice: a path and a star of ids in order, a ring, and nodes alone."""
    pairs = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(300, 500)] + [(600 + i, 600 + (i + 1) % 50) for i in range(50)] + [(700, 700)]
    nodes = spark.createDataFrame([(x,) for x in {*itertools.chain(*pairs), 800}], "mer long")
    edges = spark.createDataFrame(pairs, "src long, dst long")
    written = []
    keep = lambda df: written.append(1) or cut(df)
    found = collections.defaultdict(set)
    for r in graph.roots(nodes, edges, keep, at_once).collect():
        found[r.root].add(r.mer)
    assert sorted(map(sorted, found.values())) == [list(range(201)), list(range(300, 501)), list(range(600, 650)), [700], [800]]
    assert len(written) < 60
    sizes = {(r.component, r.size) for r in graph.component_sizes(nodes, edges, cut).collect()}
    assert sizes == {(0, 201), (300, 201), (600, 50), (700, 1), (800, 1)}


@pytest.mark.parametrize("k", [3, 5])
def test_triangles_of_packed_kmers_are_few_and_all_found(spark, k):
    """All edges of the whole graph: those that can close a triangle give the same triangles as all."""
    edges = spark.createDataFrame([(m, (m * 4 + b) % 4**k) for m in range(4**k) for b in range(4)], "src long, dst long")
    every = sorted(map(tuple, graph.triangles(edges).collect()))
    assert every and sorted(map(tuple, graph.triangles(edges, k).collect())) == every
    assert edges.where(graph._may_close(F.col("src"), k)).count() <= edges.count() if k < 5 else edges.where(graph._may_close(F.col("src"), k)).count() < edges.count() / 4


def test_pairs_and_letters_are_counted_as_by_hand(spark):
    for s in ("", "A", "AA", "AAA", "AAAAAAA", "ACACCCA", "CAAACCAAC"):
        for p in ("AA", "AC", "CC"):
            assert one(spark, s, lambda c, p=p: S.pairs_of(c, p)) == sum(s[i : i + 2] == p for i in range(len(s)))
    assert one(spark, "ACGTNgcé", lambda c: S.count_of(c, "[GCgc]")) == 4 and one(spark, "ACCA", lambda c: S.count_of(c, "C")) == 2


def test_window_bounds_of_all_lists_at_once():
    import pyarrow as pa

    lists = [[], None, [40] * 3, [0] * 9, [0] * 5 + [30] * 4 + [0] * 7, [40] * 6, [20, None, 20, 20, 20, 20, 1, 0], [15] * 4, [0, 0, 0, 60, 0, 0, 0]]

    def plain(q):
        good = [i for i in range(len(q or []) - 3) if None not in q[i : i + 4] and sum(q[i : i + 4]) >= 60]
        return (good[0], good[-1] + 4) if good else (0, len(q or []))

    for part in (lists, lists[4:], [[7] * 3, None], []):
        start, end = qc.window_bounds(pa.array(part, pa.list_(pa.int64())), 4, 15)
        assert list(zip(start.tolist(), end.tolist(), strict=True)) == [plain(q) for q in part]
    sliced = pa.array(lists, pa.list_(pa.int64()))[3:7]
    assert list(zip(*(x.tolist() for x in qc.window_bounds(sliced, 4, 15)), strict=True)) == [plain(q) for q in lists[3:7]]


def test_cycles_of_even_length_are_cut_from_pointers_of_many_steps():
    for size, steps in ((6, 2), (8, 4), (12, 8), (7, 4)):
        mer = np.random.Generator(np.random.PCG64(size)).permutation(100)[:size]
        up, before = np.roll(mer, steps), np.roll(mer, 1)
        none = np.zeros(size, np.int64)
        head, place = graph.resolve(mer, up, np.full(size, steps), none, none.astype(bool), none, before)
        assert (head == mer.min()).all() and (place == (np.arange(size) - mer.argmin()) % size).all()


def test_marked_nodes_hold_the_graph(spark):
    rnd = random.Random(5)
    rows = [("".join(rnd.choice("ACGT") for _ in range(60)),) for _ in range(20)]
    df = spark.createDataFrame(rows + rows[:15] + [("ACAC" * 9,), ("A" * 40,), ("A" * 40,), (rows[0][0][:30] + rows[1][0][20:],)], "seq string").repartition(3)
    for k in (4, 7, 31):
        nodes, edges = (cut(x) for x in graph.build(df, k, cut))
        marked = cut(graph.marks(df, k, cut))
        rows_of = lambda x: sorted(map(tuple, x.collect()))
        assert rows_of(marked.select("mer", "coverage")) == rows_of(nodes.select("mer", "coverage"))
        assert rows_of(graph.marked_edges(marked, k)) == rows_of(edges)
        assert rows_of(graph.marked_degrees(marked).select("mer", "coverage", "indeg", "outdeg")) == rows_of(graph.degrees(nodes, edges))
        assert rows_of(graph.marked_peel(marked, k)) == rows_of(graph.peel_ends(nodes, edges)[1])
        assert rows_of(graph.marked_unitigs(marked, k, cut)) == rows_of(graph.unitigs(nodes, edges, k, cut))


def test_a_bucket_of_many_rows_is_counted_whole(spark):
    rows = [("ACGTTGCAAC" * 30,)] * 7 + [("TTGACCATGA" * 5 + "N" + "ACGTTGCAAC" * 3,)] * 5
    df = spark.createDataFrame(rows, "seq string").repartition(6)
    got = {r.mer: r.n for r in superkmers.tallies(superkmers.pieces(df, 9, 2).repartition("bucket"), 9).select(superkmers.letters([F.col("w0")], 9).alias("mer"), "n").collect()}
    assert got == collections.Counter(s[i : i + 9] for (s,) in rows for i in range(len(s) - 8) if "N" not in s[i : i + 9])


def test_reads_of_an_edge_are_counted_once_each(spark):
    rows = ["ACGTACGTACGTTT", "ACGTACG", "AAAAAAAAAA", "ACGNACGTA", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "read_id long, seq string")
    got = {r.src + r.dst[-1]: r.reads for r in graph.support(df, 3).collect()}
    assert got == collections.Counter(m for s in rows if s for m in {s[i : i + 4] for i in range(len(s) - 3)} if "N" not in m)


def test_minimizers_equal_plain(spark):
    rnd = random.Random(3)
    rows = ["".join(rnd.choice("ACGT" if i % 4 else "ACGTN") for _ in range(rnd.choice([3, 6, 9, 80]))) for i in range(60)] + [None, ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "read_id long, seq string").repartition(3)
    import hashlib

    for k, w in ((5, 4), (12, 10)):
        want = set()
        for i, s in enumerate(rows):
            h = [(int(hashlib.md5(s[j : j + k].encode()).hexdigest()[:15], 16), j) for j in range(len(s or "") - k + 1)]
            want |= {(i, at, s[at : at + k]) for j in range(len(h) - min(w, len(h)) + 1 if h else 0) for at in [min(h[j : j + w])[1]]}
        assert {tuple(r) for r in kmers.minimizers(df, k, w).collect()} == want


def test_row_values_equal_expressions(spark):
    rows = ["", "A", "ACGTNNACGT", "AAAACCGTTT" * 9, "ACGT" * 30 + "G" * 7]
    s = F.col("s")
    n = F.char_length(s)
    each = [*(S.ratio(S.longest_run(s, b), n) for b in S.BASES), *(S.lag_match(s, p) for p in (2, 3, 4)), S.run_length_cost(s), *(S.distinct_share(s, k) for k in features_.SIZES)]
    got = spark.createDataFrame([(x,) for x in rows], "s string").select("s", F.array(*each).alias("v")).collect()
    for r in got:
        assert np.allclose(r.v, features_.row_values(r.s))
        plain = [r.s[i : i + 12] for i in range(len(r.s) - 11)]
        assert features_.direct_share(r.s) == (sum(plain.count(x) > 1 for x in plain) / len(plain) if plain else 0)


def test_distinct_kmers_of_keys(spark):
    rows = [("a", "ACGTACGT"), ("a", "TTTTT"), ("b", "ACGNACG"), (None, "ACGT"), ("b", None)]
    df = spark.createDataFrame(rows, "source string, seq string").repartition(2)
    got = {(r.source, r.mer) for r in kmers.distinct(df, "source", 3).select("source", superkmers.letters([F.col("packed")], 3).alias("mer")).collect()}
    assert got == {(k, s[i : i + 3]) for k, s in rows if s for i in range(len(s) - 2) if "N" not in s[i : i + 3]}


def test_kmer_hits_are_common_ancestors(spark):
    from seqlake.operators import taxonomy

    rnd = random.Random(8)
    names = lambda i: [f"d{i % 2}", f"k{i % 3}", *(f"{c}{i % 2}" if i % 5 else None for c in "pcof"), None if i % 5 == 0 or i % 7 == 0 else f"g{i % 4}", f"s{i}" if i % 5 and i % 7 else None]
    seqs = ["".join(rnd.choice("ACGT") for _ in range(50)) for _ in range(6)]
    rows = [(i, seqs[i % 6][: rnd.choice([4, 30, 50])] + rnd.choice(["", "N", seqs[i % 5][20:]]), *names(i)) for i in range(40)]
    df = taxonomy.with_ids(spark.createDataFrame(rows, "id long, seq string, " + ", ".join(f"{r} string" for r in taxonomy.RANKS)).repartition(3))
    asked, known = df.where("id % 4 = 0"), df.where("id % 4 <> 0")
    own = asked.select("id", F.explode(S.clean_kmers(F.col("seq"), 9)).alias("mer"))
    want = own.join(taxonomy.kmer_ancestors(known, 9), "mer", "left").groupBy("id", F.coalesce("taxid", F.lit(0)).alias("taxid")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, taxonomy.kmer_hits(asked, known, "id", 9, cut).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("k", [3, 4, 15])
def test_bubbles_of_marked_nodes(spark, k):
    rnd = random.Random(k)
    left, right = ("".join(rnd.choice("ACGT") for _ in range(30)) for _ in range(2))
    rows = [(left + mid + right,) for mid in ("", "A", "C", "GG", "TTT") for _ in range(2)] + [(left[:20] + b + left[21:],) for b in "ACGT" for _ in range(2)] if k < 15 else [(x,) for x in ("ACGT" * 12, "A" * 40, left + right) for _ in range(2)]
    df = spark.createDataFrame(rows, "seq string").repartition(2)
    edges = cut(graph.build(df, k, cut)[1])
    got = sorted(map(tuple, graph.marked_bubbles(cut(graph.marks(df, k, cut)), k).collect()))
    assert got == sorted(map(tuple, graph.bubbles(edges).collect())) and (got or k != 4)


def plain_search(rows, k, top):
    """similar.search() of keys divisible by 3, in plain Python."""
    held, out = collections.defaultdict(collections.Counter), []
    for key, s in rows:
        if key is not None:
            held[key].update(m for m in ((s or "")[i : i + k] for i in range(len(s or "") - k + 1)) if set(m) <= set("ACGT"))
    for q in (x for x in held if x % 3 == 0):
        found = [(-sum(c for m, c in held[t].items() if m in held[q]), t, -1 if s is None else len(s)) for t, s in rows if t is not None]
        out += [(q, t, -n, len(held[q]), None if size < 0 else size) for n, t, size in sorted(x for x in found if x[0])[:top]]
    return sorted(out, key=repr)


def searched():
    r = random.Random(5)
    words = ["".join(r.choices("ACGT", k=12)) for _ in range(9)]
    rows = [(i, "".join(r.choices(words, k=r.randrange(9))) + r.choice(["", "N", "aC", "\u00c9A"]) + "".join(r.choices(words, k=r.randrange(4)))) for i in range(-6, 60)]
    rows += [(i, rows[12][1]) for i in range(60, 90)] + [(7, rows[2][1]), (7, None), (9, rows[30][1]), (9, "ACG"), (90, None), (91, ""), (None, rows[3][1]), (93, "ACGTTG" * 60)]
    return rows


@pytest.mark.parametrize("k", [11, 16, 17])
def test_search_equals_plain(spark, monkeypatch, k):
    monkeypatch.setattr(similar, "ASKED", 700)
    monkeypatch.setattr(similar, "KNOWN", 900)
    rows = searched()
    got = similar.search(spark.createDataFrame(rows, "id long, seq string"), "id", k, F.col("key") % 3 == 0, 4, cut)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(rows, k, 4)


@pytest.mark.parametrize("at_once, matrix, spread", [(1 << 20, 1 << 20, 1 << 20), (50, 60, 7), (5, 1, 1)])
def test_search_of_a_block_in_pieces(spark, monkeypatch, at_once, matrix, spread):
    rows = searched()
    dealt = similar.pack(spark.createDataFrame(rows, "id long, seq string"), "id", 11)
    asked, known = ([similar._Block(list(map(bytes, r[1:]))) for r in similar.blocks(x, 2, 900, top).collect()] for x, top in ((dealt.where("key % 3 = 0"), None), (dealt, 4)))
    for name, size in (("AT_ONCE", at_once), ("MATRIX", matrix), ("SPREAD", spread)):
        monkeypatch.setattr(similar, name, size)
    got = []
    for q in asked:
        best = similar._Best(q, 11, 4)
        for t in known:
            best.add(t)
        got += [tuple(r.values()) for b in best.rows() for r in b.to_pylist()]
    assert sorted(got, key=repr) == plain_search(rows, 11, 4)


def test_search_writes_no_row_for_each_pair(spark, tmp_path):
    r = random.Random(7)
    texts = ["thesameforall" * 2 + "".join(r.choices("abcdefgh", k=60)) for _ in range(1200)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")

    def records() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = records()
    assert registry.queries()["kmer_search"](spark, str(tmp_path)).count() == 60 * 5
    # All 60 queries share k-mers with all 1,200 texts.
    assert records() - before < 60 * 1200 / 4
