"""From reads to a report: stages over Parquet in a run's folder, so that a run resumes where it ended.

    python -m seqlake.pipeline analyze OUT reads.fastq ... [--config seqlake.toml]
    python -m seqlake.pipeline assemble OUT reads.fastq ...
    python -m seqlake.pipeline index OUT references.fasta [--k 21]
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as settings
from .functions import seq as S
from .operators import binning, features, graph, kmers, qc, superkmers
from .plans.shared import cut
from .sources import fastx, sinks


class Run:
    """A folder of named tables. `stage` computes a table once; a table whose success mark is there is read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        sc = self.spark.sparkContext
        mark = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return mark.getFileSystem(sc._jsc.hadoopConfiguration()).exists(mark)

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not self._exists(name):
            make().write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def text(self, name: str, lines: DataFrame) -> None:
        lines.write.mode("overwrite").text(f"{self.path}/{name}")

    def tables(self) -> DataFrame:
        """name, files, bytes of what the run holds."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.path)
        name = F.element_at(F.split("path", "/"), -2)
        return found.groupBy(name.alias("name")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def reads_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, read_id, seq, q; sequences without qualities get 30 throughout."""
    fq, fa = [p for p in paths if fastx.kind(p) == "fastq"], [p for p in paths if fastx.kind(p) == "fasta"]
    out = None
    if fq:
        out = fastx.read_fastq(spark, fq).select("file", F.concat_ws(":", F.xxhash64("file").cast("string"), F.col("read_id").cast("string")).alias("read_id"), "seq", S.phred(F.col("quality")).cast("array<long>").alias("q"))
    if fa:
        own = fastx.read_fasta(spark, fa).select("file", F.concat_ws(":", F.xxhash64("file").cast("string"), "header").alias("read_id"), "seq", F.array_repeat(F.lit(30).cast("long"), F.char_length("seq")).alias("q"))
        out = out.unionByName(own) if out is not None else own
    return out


def assemble(run: Run, reads: DataFrame, c: settings.Config) -> DataFrame:
    """Unitigs of the peeled graph as contigs (contig_id, seq, len, coverage)."""
    if c.k <= 31:
        nodes, edges = graph.of_counts(run.stage("kmers", lambda: superkmers.count(reads, c.k, edges=True, least=c.least_coverage)), c.k)
    else:
        nodes = run.stage("nodes", lambda: graph.build(reads, c.k, cut, c.least_coverage)[0])
        edges = run.stage("edges", lambda: graph.build(reads, c.k, cut, c.least_coverage)[1])
    if c.peel:
        nodes, edges = graph.peel_ends(nodes, edges)
    made = lambda: graph.unitigs(cut(nodes), cut(edges), c.k, cut).select(F.abs(F.xxhash64("head")).alias("contig_id"), "seq", F.char_length("seq").cast("long").alias("len"), "coverage").where(F.col("len") >= c.least_contig)
    return run.stage("contigs", made)


def analyze(spark: SparkSession, paths: list[str], to: str, c: settings.Config | None = None) -> dict:
    """All stages; returns the report, which is written as JSON too."""
    c = (c or settings.Config()).checked()
    run = Run(spark, to)
    checked = run.stage("reads", lambda: qc.cascade(reads_of(spark, paths), c.preset).select("file", "read_id", F.col("final").alias("seq"), "mean_q", "status"))
    good = checked.where("status = 'pass'")
    contigs = assemble(run, good, c)
    run.stage("features", lambda: features.vectors(contigs, "contig_id"))
    classes = run.stage("classification", lambda: binning.classify(contigs, "contig_id", binning.profiles(spark), c.similarity))
    counts = run.stage("abundance", lambda: kmers.count(good, 4))
    named = classes.select("contig_id", binning.taxon_id(F.col("taxon")).alias("taxonomy_id"), F.col("taxon").alias("taxonomy_name"), "confidence", F.concat(F.lit("Bacteria|"), F.col("taxon")).alias("lineage"))
    for name, lines in {"contigs.fasta": sinks.fasta(contigs), "assembly.gfa": sinks.gfa(contigs, _links(contigs, c.k), c.k - 1), "classification.tsv": sinks.classification_tsv(named), "taxa.kraken": sinks.kraken(named), "taxa.krona": sinks.krona(named), "kmers.tsv": sinks.sketch_tsv(counts)}.items():
        run.text(name, lines)
    state = {r["status"]: r["n"] for r in checked.groupBy("status").agg(F.count("*").alias("n")).collect()}
    stats = contigs.agg(F.count("*").alias("contigs"), F.sum("len").alias("bases"), F.max("len").alias("longest"), F.avg("coverage").alias("coverage")).first().asDict()
    n50 = graph.nx(contigs, 0.5).first()
    taxa = {r["taxon"]: r["n"] for r in classes.groupBy("taxon").agg(F.count("*").alias("n")).collect()}
    report = {"reads": state, "assembly": stats | {"n50": n50["nx"] if n50 else 0}, "taxa": taxa, "kmers": kmers.diversity(counts).first().asDict()}
    run.text("report.json", spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1))
    return report


def _links(contigs: DataFrame, k: int) -> DataFrame:
    """(src, dst): contigs of which one ends with the k - 1 bases that the other starts with."""
    a = contigs.select(F.col("contig_id").alias("src"), F.right("seq", F.lit(k - 1)).alias("j"))
    return a.join(contigs.select(F.col("contig_id").alias("dst"), F.left("seq", F.lit(k - 1)).alias("j")), "j").where("src <> dst").select("src", "dst")


def markdown(report: dict) -> str:
    """The report as Markdown."""
    rows = [f"| {part} | {name} | {value} |" for part, values in report.items() for name, value in sorted(values.items())]
    return "\n".join(["# Analysis", "", "| part | figure | value |", "|---|---|---|", *rows, ""])


def index(spark: SparkSession, fasta: str, to: str, k: int) -> None:
    """Import references and write their k-mer index, a folder for each k, so that one k can be replaced alone."""
    run = Run(spark, to)
    refs = run.stage("sequences", lambda: fastx.reference_sequences(fastx.read_fasta(spark, fasta)))
    kmers.index(refs, "sequence_hash", k).drop("k").write.mode("overwrite").parquet(f"{run.path}/kmer_index/k={k}")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["analyze", "assemble", "index"])
    p.add_argument("to")
    p.add_argument("paths", nargs="+")
    p.add_argument("--config")
    p.add_argument("--k", type=int, default=21)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("seqlake").getOrCreate()
    c = settings.load(a.config)
    if a.command == "index":
        index(spark, a.paths[0], a.to, a.k)
    elif a.command == "assemble":
        run = Run(spark, a.to)
        assemble(run, reads_of(spark, a.paths), c)
    else:
        print(markdown(analyze(spark, a.paths, a.to, c)))


if __name__ == "__main__":
    main()
