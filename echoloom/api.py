"""High-level entry points: scan folders for duplicates, compare, and hold an index."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CompareConfig, PreprocessConfig
from .operators import cluster, index
from .operators import compare as cmp
from .runtime import settle
from .sources import audio


def one_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a file; FileNotFoundError where there is none."""
    try:
        return spark.read.format("binaryFile").load(path).select("path", "content")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"File not found: {path}") from None
        raise


def scan_for_duplicates(spark: SparkSession, paths: str | list[str], config: CompareConfig = CompareConfig(), extensions: tuple[str, ...] = (".wav",), prepare: PreprocessConfig | None = None, sliding: bool = False, max_seconds: float | None = None) -> DataFrame:  # noqa: B008
    """Duplicate groups with their paths over one or more folders; undecodable files are passed over. Ids follow paths, so reruns agree."""
    fps = settle(audio.fingerprints(audio.scan(spark, paths, extensions), prepare=prepare, max_seconds=max_seconds, doubling="smart" if prepare else "none"))
    good = fps.where("error is null")
    return cluster.with_paths(cluster.duplicate_groups(good, config, sliding), good)


def compare_files(spark: SparkSession, one: str, other: str, config: CompareConfig = CompareConfig(), prepare: PreprocessConfig | None = None, sliding: bool = False) -> DataFrame:  # noqa: B008
    """One match row of the two files, 0 and 1, with ``error``: null, or why a file could not be fingerprinted (then the rest is null)."""
    each = [audio.fingerprints(one_file(spark, p), prepare=prepare).withColumn("file_id", F.lit(k).cast("bigint")) for k, p in enumerate((one, other))]
    fps = settle(each[0].unionByName(each[1]))
    bad = [f"{r['file_path']}: {r['error']}" for r in fps.where("error is not null").orderBy("file_id").select("file_path", "error").collect()]
    pair = spark.range(1).select(F.lit(0).cast("bigint").alias("a"), F.lit(1).cast("bigint").alias("b"))
    got = cmp.compare(pair, fps.where("error is null"), config, sliding)
    return pair.join(got, ["a", "b"], "left").withColumn("error", F.lit("; ".join(bad) or None).cast("string"))


@dataclass(frozen=True)
class FingerprintIndex:
    """A table of fingerprints and how to compare them; adding or clearing gives a new index."""

    fps: DataFrame
    config: CompareConfig = CompareConfig()

    def add(self, more: DataFrame) -> FingerprintIndex:
        """The index with more fingerprints, whose ids go on from the largest held: id k of ``more``, counted from 0, becomes next_id + k."""
        return replace(self, fps=self.fps.unionByName(more.withColumn("file_id", F.col("file_id") + self.next_id)))

    @property
    def next_id(self) -> int:
        last = self.fps.agg(F.max("file_id")).first()[0]
        return 0 if last is None else last + 1

    def clear(self) -> FingerprintIndex:
        """No files; the settings stay."""
        return replace(self, fps=self.fps.limit(0))

    def count(self) -> int:
        return self.fps.count()

    def file(self, file_id: int) -> DataFrame:
        return self.fps.where(F.col("file_id") == file_id)

    def stats(self) -> DataFrame:
        return index.stats(self.fps)

    def candidates_of(self, file_id: int) -> DataFrame:
        """(a, b, hits) of the files that share enough postings with a file, itself among them: most hits first, then the lower id."""
        return index.candidates(self.fps, self.config, self.file(file_id)).orderBy(F.desc("hits"), "b")

    def groups(self, sliding: bool = False) -> DataFrame:
        return cluster.duplicate_groups(settle(self.fps), self.config, sliding)
