"""Bins, taxa, reports, the reference store and mates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import binning, graph, qc
from ..sources import sinks
from . import views as V
from .registry import query
from .scalars import _cnt, _kmers
from .shared import cut

BINS = 6
_V = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS n FROM embeddings)"
_DIST = "sqrt(list_sum(list_transform(list_zip(v.v, s.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


def _seeds(k: int) -> str:
    return f"s AS (SELECT i::INTEGER AS bin, v AS c FROM v, range({k}) t(i) WHERE r = i * n // {k})"


_ASSIGN = f"{_V}, {_seeds(BINS)}, near AS (SELECT vec_id, v.v AS v, arg_min(bin, struct_pack(d := {_DIST}, b := bin)) AS bin, min({_DIST}) AS distance FROM v, s GROUP BY ALL)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query(f"WITH {_ASSIGN}, m AS (SELECT bin, avg(distance) AS m FROM near GROUP BY 1) SELECT vec_id, bin, round(distance, 6) AS distance, round(CASE WHEN m = 0 THEN 1 ELSE greatest(0, least(1, 1 - distance / (2 * m))) END, 6) AS confidence FROM near JOIN m USING (bin)")
def bin_assignment(spark: SparkSession, d: str) -> DataFrame:
    """JN7, ML4 (one round), ML5, SF31."""
    v = _vectors(spark, d)
    a = binning.confidence(binning.assign(v, binning.seeds(v, "vec_id", BINS)))
    return a.select("vec_id", "bin", F.round("distance", 6).alias("distance"), F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_ASSIGN} SELECT bin, dim - 1 AS dim, round(avg(x), 6) AS mean FROM (SELECT bin, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM near) GROUP BY ALL")
def bin_centroids(spark: SparkSession, d: str) -> DataFrame:
    """AG26."""
    v = _vectors(spark, d)
    return binning.centroids(binning.assign(v, binning.seeds(v, "vec_id", BINS))).select("bin", "dim", F.round("mean", 6).alias("mean"))


@query(" UNION ALL ".join(f"(WITH {_V}, {_seeds(k)}, near AS (SELECT vec_id, min({_DIST}) AS d FROM v, s GROUP BY 1) SELECT {k} AS k, round(sum(d * d), 4) AS inertia FROM near)" for k in range(2, 6)))
def bin_count_choice(spark: SparkSession, d: str) -> DataFrame:
    """Inertia for 2 to 5 bins, the first part of ML3, beside its SQL; `bin_count_chosen` has all k and the choice."""
    return binning.inertia(_vectors(spark, d), "vec_id", 5).select("k", F.round("inertia", 4).alias("inertia"))


@query(f"""WITH {_V}, ks AS (SELECT unnest(range(2, greatest(least(50, n // 3), 2) + 1)) AS k, n FROM (SELECT count(*) AS n FROM v)), sd AS (SELECT k, v AS c FROM (SELECT k, i, i * n // k AS place FROM ks, range(50) t(i) WHERE i < k) JOIN v ON r = place),
near AS (SELECT k, vec_id, min(list_sum(list_transform(list_zip(v.v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM v, sd GROUP BY ALL), ine AS (SELECT k, sum(d) AS inertia FROM near GROUP BY k),
dr AS (SELECT k, inertia, coalesce(lag(inertia) OVER (ORDER BY k) - inertia, 0) AS fall FROM ine) SELECT k::INTEGER AS k, round(inertia, 4) AS inertia, k = coalesce((SELECT arg_min(k, (-fall, k)) FROM dr WHERE fall > 0), 2) AS chosen FROM dr""")
def bin_count_chosen(spark: SparkSession, d: str) -> DataFrame:
    """ML3: inertia for each k up to min(50, n / 3), and whether k is chosen by the largest drop."""
    best, found = binning.choose_bins(_vectors(spark, d), "vec_id")
    return spark.createDataFrame([(k, round(x, 4), k == best) for k, x in found or [(1, 0.0)]], "k int, inertia double, chosen boolean")


@query()
def bin_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """ML4, ML7 until centroids stay, in at most 100 rounds."""
    return binning.kmeans(_vectors(spark, d), "vec_id", BINS)[0].groupBy("bin").agg(F.count("*").alias("n"))


_BC = f"{V.LONG_CONTIGS_SQL}, b AS (SELECT *, (contig_id % 12)::INTEGER AS bin FROM contigs)"


def _binned(spark: SparkSession, d: str) -> DataFrame:
    return V.long_contigs(spark, d).withColumn("bin", (F.col("contig_id") % 12).cast("int"))


_NXB = "nx AS (SELECT bin, max(len) AS n50 FROM (SELECT bin, len, sum(len) OVER (PARTITION BY bin ORDER BY len DESC) AS cum, sum(len) OVER (PARTITION BY bin) AS total FROM b) WHERE cum >= floor(total * 0.5) GROUP BY 1)"


@query(f"WITH {_BC}, {_NXB} SELECT bin, count(*) AS contigs, sum(len)::BIGINT AS bases, round(avg(len), 6) AS mean_len, list_sort(list(len))[count(*) // 2 + 1] AS median_len, max(len) AS longest, any_value(n50) AS n50, round(avg(coverage), 6) AS cov_mean, round(var_pop(coverage), 6) AS cov_var, round(stddev_pop({_cnt('[GC]')} / len), 9) AS gc_std FROM b JOIN nx USING (bin) GROUP BY bin")
def bin_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AG11, AG12, AG27, JN5, SK22."""
    b = _binned(spark, d)
    # The upper median by counts of lengths, so that no bin's lengths meet in one array.
    by = b.groupBy("bin", "len").agg(F.count("*").alias("n"))
    w = Window.partitionBy("bin")
    med = by.withColumn("cum", F.sum("n").over(w.orderBy("len"))).withColumn("t", F.sum("n").over(w)).where(F.col("cum") > F.floor(F.col("t") / 2)).groupBy("bin").agg(F.min("len").alias("median_len"))
    a = b.groupBy("bin").agg(F.count("*").alias("contigs"), F.sum("len").alias("bases"), F.round(F.avg("len"), 6).alias("mean_len"), F.max("len").alias("longest"), F.round(F.avg("coverage"), 6).alias("cov_mean"), F.round(F.var_pop("coverage"), 6).alias("cov_var"), F.round(F.stddev_pop(S.gc(F.col("seq"))), 9).alias("gc_std"))
    return a.join(graph.nx(b, 0.5, "bin").withColumnRenamed("nx", "n50"), "bin").join(med, "bin")


@query(f"WITH {_BC}, s AS (SELECT bin, avg(coverage) AS mean, var_pop(coverage) AS var FROM b GROUP BY 1), h AS (SELECT y.bin, max(x.bin) AS i FROM s x JOIN s y ON x.bin < y.bin AND abs(x.mean - y.mean) / greatest(x.mean, 1) < 0.05 AND abs(x.var - y.var) / greatest(x.var, 1) < 0.10 GROUP BY 1), m AS (SELECT bin, coalesce(i, bin) AS i FROM s LEFT JOIN h USING (bin)) SELECT bin, i AS merged_into, (dense_rank() OVER (ORDER BY i) - 1)::INTEGER AS new_bin FROM m")
def bin_merge(spark: SparkSession, d: str) -> DataFrame:
    """JN8, ML6, WN8."""
    s = _binned(spark, d).groupBy("bin").agg(F.avg("coverage").alias("mean"), F.var_pop("coverage").alias("var"))
    return binning.merge_map(s).select("bin", F.col("into").alias("merged_into"), (F.dense_rank().over(Window.orderBy("into")) - 1).alias("new_bin"))


_TAXON_LIST = ", ".join(f"'{n}'" for n in sorted(binning.TAXA))
_T = ", ".join(f"('{n}', {g}::DOUBLE)" for n, g in sorted(binning.TAXA.items()))
_CLS = f"""{V.LONG_CONTIGS_SQL}, taxa(taxon, gc) AS (VALUES {_T}), mers AS (SELECT a || b || c || d AS mer FROM (VALUES ('A'), ('C'), ('G'), ('T')) t1(a), (VALUES ('A'), ('C'), ('G'), ('T')) t2(b), (VALUES ('A'), ('C'), ('G'), ('T')) t3(c), (VALUES ('A'), ('C'), ('G'), ('T')) t4(d)),
ref AS (SELECT taxon, mer, CASE WHEN {_cnt('[GC]', 'mer')} > 2 THEN gc ELSE 1 - gc END / 128 AS ref FROM taxa, mers), w AS (SELECT contig_id, unnest({_kmers(4)}) AS mer FROM contigs), f AS (SELECT contig_id, mer, count(*)::DOUBLE AS freq FROM w GROUP BY ALL),
sc AS (SELECT contig_id, taxon, round(sum(freq * ref) / (any_value(fs) * any_value(rs)), 9) AS confidence FROM f JOIN ref USING (mer) JOIN (SELECT contig_id, sqrt(sum(freq * freq)) AS fs FROM f GROUP BY 1) USING (contig_id) JOIN (SELECT taxon, sqrt(sum(ref * ref)) AS rs FROM ref GROUP BY 1) USING (taxon) GROUP BY ALL),
cls AS (SELECT contig_id, taxon, confidence, round(confidence - lead(confidence) OVER w, 9) AS margin FROM sc WINDOW w AS (PARTITION BY contig_id ORDER BY confidence DESC, taxon) QUALIFY row_number() OVER w = 1)"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return binning.classify(V.long_contigs(spark, d), "contig_id", binning.profiles(spark))


@query(f"WITH {_CLS} SELECT contig_id, taxon, confidence, margin FROM cls WHERE confidence >= 0.6")
def taxa_classification(spark: SparkSession, d: str) -> DataFrame:
    """JN6, ML9, ML10, ML11, SF12, SF13, SF30, WN7."""
    return _classified(spark, d)


_Z = f"""share AS (SELECT contig_id, mer, freq / sum(freq) OVER (PARTITION BY contig_id) AS x FROM f), dense AS (SELECT c.contig_id, m.mer, coalesce(x, 0) AS x FROM contigs c CROSS JOIN mers m LEFT JOIN share s ON s.contig_id = c.contig_id AND s.mer = m.mer),
st AS (SELECT mer, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-10 THEN 1 ELSE stddev_pop(x) END AS s, min(x) AS lo, max(x) - min(x) AS w FROM dense GROUP BY 1), z AS MATERIALIZED (SELECT contig_id, mer, (x - m) / s AS z, CASE WHEN w < 1e-10 THEN 0.5 ELSE (x - lo) / w END AS u FROM dense JOIN st USING (mer))"""
_BT = f"""{_CLS}, {_Z}, place AS (SELECT contig_id, row_number() OVER (ORDER BY contig_id) - 1 AS r, count(*) OVER () AS n FROM contigs), sd AS (SELECT i::INTEGER AS bin, contig_id AS c FROM place, range({BINS}) t(i) WHERE r = i * n // {BINS}),
gap AS (SELECT z.contig_id, bin, round(sqrt(sum((z.z - y.z) * (z.z - y.z))), 9) AS d FROM z JOIN z y USING (mer) JOIN sd ON sd.c = y.contig_id GROUP BY ALL), nb AS (SELECT contig_id, arg_min(bin, struct_pack(d := d, b := bin)) AS bin, min(d) AS d FROM gap GROUP BY 1), md AS (SELECT bin, avg(d) AS m FROM nb GROUP BY 1),
bt AS (SELECT contig_id, bin, CASE WHEN m = 0 THEN 1 ELSE greatest(0, least(1, 1 - d / (2 * m))) END AS b, taxon, CASE WHEN contains(taxon, ' ') THEN 'species' ELSE 'genus' END AS rank, confidence AS t FROM nb JOIN md USING (bin) JOIN cls USING (contig_id) WHERE confidence >= 0.6)"""


def _bin_taxa(spark: SparkSession, d: str) -> DataFrame:
    c = V.long_contigs(spark, d)
    v = cut(binning.normalized(binning.kmer_vectors(c, "contig_id")))
    near = binning.assign(v, binning.seeds(v, "contig_id", BINS), 9)
    return binning.with_taxa(binning.confidence(near), _classified(spark, d), "contig_id")


@query(f"WITH {_BT} SELECT contig_id, bin, round(b, 6) AS binning_confidence, taxon, rank, round(t, 6) AS taxonomy_confidence, round(b * t, 6) AS confidence FROM bt")
def bin_taxa(spark: SparkSession, d: str) -> DataFrame:
    """ML2, ML7 (one round), ML8, JN4: contigs in bins of normalised 4-mer shares, each with its taxon and the product of both confidences."""
    return _bin_taxa(spark, d).withColumns({c: F.round(c, 6) for c in ("binning_confidence", "taxonomy_confidence", "confidence")})


@query(f"WITH {_BT} SELECT concat_ws(chr(9), contig_id, bin, taxon, printf('%.4f', b * t), concat(rank, '|', taxon), 'KmerTaxonomy+MLBinning') AS line FROM bt")
def sink_bin_classification(spark: SparkSession, d: str) -> DataFrame:
    """ML18, SK7: the bin as taxonomy id, rank and taxon as lineage, the method's name."""
    c = _bin_taxa(spark, d)
    return c.select(F.concat_ws("\t", F.col("contig_id").cast("string"), F.col("bin").cast("string"), "taxon", S.fixed(F.col("confidence"), 4), F.concat_ws("|", "rank", "taxon"), F.lit("KmerTaxonomy+MLBinning")).alias("line"))


@query(f"WITH {_CLS}, {_Z} SELECT contig_id, mer, round(z, 6) AS zscore, round(u, 6) AS minmax FROM z WHERE mer IN ('AAAA', 'ACGT', 'GGGG')")
def feature_normalized(spark: SparkSession, d: str) -> DataFrame:
    """ML1, ML2: normalised shares of three of the 256 columns, both ways."""
    v = cut(binning.kmer_vectors(V.long_contigs(spark, d), "contig_id"))
    both = binning.normalized(v).select("contig_id", F.col("v").alias("z")).join(binning.normalized(v, "minmax"), "contig_id")
    rows = F.array(*(F.struct(F.lit(m).alias("mer"), F.get("z", F.lit(i)).alias("zscore"), F.get("v", F.lit(i)).alias("minmax")) for m, i in (("AAAA", 0), ("ACGT", 27), ("GGGG", 170))))
    return both.select("contig_id", F.explode(rows).alias("x")).select("contig_id", "x.mer", F.round("x.zscore", 6).alias("zscore"), F.round("x.minmax", 6).alias("minmax"))


@query(f"WITH {_CLS}, t AS (SELECT taxon, count(*) AS n FROM cls WHERE confidence >= 0.6 GROUP BY 1) SELECT taxon, n, round(100.0 * n / sum(n) OVER (), 6) AS pct, n = max(n) OVER () AS dominant, (SELECT round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 9) FROM t) AS shannon FROM t")
def taxa_abundance(spark: SparkSession, d: str) -> DataFrame:
    """AG18, AG20, ML16, SE2, SK10, SK14, ST3."""
    t = _classified(spark, d).groupBy("taxon").agg(F.count("*").alias("n"))
    total = t.agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    return t.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(binning.shannon(t))).select("taxon", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("pct"), (F.col("n") == F.col("most")).alias("dominant"), F.round("shannon", 9).alias("shannon"))


@query(f"WITH {_CLS}, r AS (SELECT split_part(taxon, ' ', 1) AS genus, taxon AS species, confidence FROM cls WHERE confidence >= 0.6) SELECT CASE WHEN grouping(species) = 0 THEN 'species' ELSE 'genus' END AS rank, coalesce(species, genus) AS name, count(*) AS n, round(avg(confidence), 6) AS confidence FROM r GROUP BY GROUPING SETS ((genus), (genus, species))")
def taxa_ranks(spark: SparkSession, d: str) -> DataFrame:
    """AG19, AG21, SF37: counts of all ranks in one aggregation over grouping sets."""
    r = _classified(spark, d).select(F.split_part("taxon", F.lit(" "), F.lit(1)).alias("genus"), F.col("taxon").alias("species"), "confidence")
    g = r.groupingSets([["genus"], ["genus", "species"]], "genus", "species").agg(F.grouping("species").alias("g"), F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return g.select(F.when(F.col("g") == 0, "species").otherwise("genus").alias("rank"), F.coalesce("species", "genus").alias("name"), "n", "confidence")


@query(f"WITH {_CLS} SELECT concat_ws(chr(9), contig_id, list_position([{_TAXON_LIST}], taxon), taxon, printf('%.4f', confidence), concat('Bacteria|', split_part(taxon, ' ', 1), '|', taxon)) AS line FROM cls WHERE confidence >= 0.6")
def sink_classification(spark: SparkSession, d: str) -> DataFrame:
    """JN4, SK7, SK13, SF37."""
    c = _classified(spark, d)
    line = F.concat(F.lit("Bacteria|"), F.split_part("taxon", F.lit(" "), F.lit(1)), F.lit("|"), F.col("taxon"))
    return sinks.classification_tsv(c.select("contig_id", binning.taxon_id(F.col("taxon")).alias("taxonomy_id"), F.col("taxon").alias("taxonomy_name"), "confidence", line.alias("lineage")))


@query(f"WITH {_CLS}, n AS (SELECT taxon, count(*) AS n FROM cls WHERE confidence >= 0.6 GROUP BY 1) SELECT concat_ws(chr(9), printf('%.2f', 100.0 * n / sum(n) OVER ()), n, n, 'S', taxon) AS line FROM n")
def sink_kraken(spark: SparkSession, d: str) -> DataFrame:
    """SK8, SK9."""
    return sinks.kraken(_classified(spark, d).withColumnRenamed("taxon", "taxonomy_name"))


@query(f"WITH {_CLS} SELECT concat_ws(chr(9), count(*), 'Bacteria', split_part(taxon, ' ', 1), taxon) AS line FROM cls WHERE confidence >= 0.6 GROUP BY taxon")
def sink_krona(spark: SparkSession, d: str) -> DataFrame:
    """SK11."""
    line = F.concat(F.lit("Bacteria|"), F.split_part("taxon", F.lit(" "), F.lit(1)), F.lit("|"), F.col("taxon"))
    return sinks.krona(_classified(spark, d).select(line.alias("lineage")))


@query("SELECT n_name AS name, r_name AS parent, concat_ws('|', r_name, n_name, s_name) AS lineage, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def store_lineage(spark: SparkSession, d: str) -> DataFrame:
    """JN14: names of a dimension hierarchy joined into lineages; the fixed dimensions are small by definition and AQE broadcasts them by size."""
    s, n, r = (V.table(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("n_name").alias("name"), F.col("r_name").alias("parent"), F.concat_ws("|", "r_name", "n_name", "s_name").alias("lineage"), "s_suppkey")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def store_insert_absent(spark: SparkSession, d: str) -> DataFrame:
    """JN12, SK19: rows whose key is not there yet, by anti join."""
    c, o = V.table(spark, d, "customer"), V.table(spark, d, "orders").where("o_orderstatus = 'P'")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _NAMES))
def store_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AG29."""
    parts = [V.table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in _NAMES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_MATES = f"m AS (SELECT conv_id AS pair_id, turn % 2 AS side, turn // 2 AS k, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{V.FROM}', '{V.TO}') AS seq FROM conversations)"


def _mates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = V.table(spark, d, "conversations")
    m = c.select(F.col("conv_id").alias("pair_id"), (F.col("turn") % 2).alias("side"), F.floor(F.col("turn") / 2).alias("k"), F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), V.FROM, V.TO).alias("seq"))
    return m.where("side = 0").select("pair_id", "k", F.col("seq").alias("r1")), m.where("side = 1").select("pair_id", "k", F.col("seq").alias("r2"))


@query(f"WITH {_MATES}, p AS (SELECT pair_id, k, a.seq AS r1, b.seq AS r2 FROM (SELECT * FROM m WHERE side = 0) a JOIN (SELECT * FROM m WHERE side = 1) b USING (pair_id, k)) SELECT pair_id, k, greatest(length(r1) + length(r2) + 200, 300) AS insert_size, concat(r1, repeat('N', 10), reverse(translate(r2, 'ACGT', 'TGCA'))) AS combined, length(r1) >= 50 AND length(r2) >= 50 AS valid FROM p")
def mates_paired(spark: SparkSession, d: str) -> DataFrame:
    """JN10, SF34, SF35, SE1."""
    a, b = _mates(spark, d)
    n1, n2 = F.char_length("r1"), F.char_length("r2")
    p = a.join(b, ["pair_id", "k"])
    return p.select("pair_id", "k", F.greatest(n1 + n2 + 200, F.lit(300)).cast("long").alias("insert_size"), F.concat("r1", F.repeat(F.lit("N"), F.lit(10)), S.reverse_complement(F.col("r2"))).alias("combined"), ((n1 >= 50) & (n2 >= 50)).alias("valid"))


@query(f"WITH {_MATES} SELECT pair_id, k, length(seq) AS len FROM m a WHERE side = 0 AND NOT EXISTS (SELECT 1 FROM m b WHERE b.side = 1 AND b.pair_id = a.pair_id AND b.k = a.k)")
def mates_single(spark: SparkSession, d: str) -> DataFrame:
    """JN10: reads without a mate."""
    a, b = _mates(spark, d)
    return a.join(b, ["pair_id", "k"], "left_anti").select("pair_id", "k", F.char_length("r1").cast("long").alias("len"))


@query(f"WITH {_MATES}, p AS (SELECT greatest(length(a.seq) + length(b.seq) + 200, 300) AS s FROM (SELECT * FROM m WHERE side = 0) a JOIN (SELECT * FROM m WHERE side = 1) b USING (pair_id, k)) SELECT s // 100 * 100 AS size, count(*) AS n, min(s) AS lo, max(s) AS hi FROM p GROUP BY 1")
def mates_insert_sizes(spark: SparkSession, d: str) -> DataFrame:
    """AG23: histogram of insert sizes."""
    a, b = _mates(spark, d)
    s = a.join(b, ["pair_id", "k"]).select(F.greatest(F.char_length("r1") + F.char_length("r2") + 200, F.lit(300)).cast("long").alias("s"))
    return s.groupBy((F.floor(F.col("s") / 100) * 100).alias("size")).agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"))


@query(f"WITH {_MATES}, x AS (SELECT pair_id, k, side, length(seq) AS n, unnest({_kmers(8)}) AS mer, generate_subscripts({_kmers(8)}, 1) - 1 AS pos FROM m) SELECT side, mer, count(*) AS n, min(pos) AS first_pos, round(avg(n - pos), 6) AS mate_distance FROM x GROUP BY ALL")
def mates_kmers(spark: SparkSession, d: str) -> DataFrame:
    """SF11, SF33: k-mers with their side, place and distance to the read's end."""
    a, b = _mates(spark, d)
    side = lambda x, c, i: x.select(F.lit(i).cast("long").alias("side"), F.char_length(c).alias("len"), F.posexplode(S.kmers(F.col(c), 8)).alias("pos", "mer"))
    both = side(a, "r1", 0).unionByName(side(b, "r2", 1))
    return both.groupBy("side", "mer").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first_pos"), F.round(F.avg(F.col("len") - F.col("pos")), 6).alias("mate_distance"))


@query(f"WITH {V.READS_SQL} SELECT read_id, CASE WHEN read_id % 3 = 0 THEN concat('r', read_id, '/1') WHEN read_id % 3 = 1 THEN concat('r', read_id, ' 2:N') ELSE concat('r', read_id) END AS header, concat('r', read_id) AS pair_id, CASE WHEN read_id % 3 = 1 THEN 'R2' ELSE 'R1' END AS orientation FROM reads")
def mates_headers(spark: SparkSession, d: str) -> DataFrame:
    """SF33: pair id and orientation out of headers."""
    from ..sources.fastx import mate

    i = F.col("read_id").cast("string")
    h = F.when(F.col("read_id") % 3 == 0, F.concat(F.lit("r"), i, F.lit("/1"))).when(F.col("read_id") % 3 == 1, F.concat(F.lit("r"), i, F.lit(" 2:N"))).otherwise(F.concat(F.lit("r"), i))
    m = mate(F.col("header"))
    return V.reads(spark, d).select("read_id", h.alias("header")).select("read_id", "header", m["pair_id"].alias("pair_id"), m["orientation"].alias("orientation"))
