"""Writers: CSV, Parquet, JSON summary, and day tables with keep-last semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsepanel.operators.joins import keep_last
from pulsepanel.sources.workdir import remove_folders, source_version


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").csv(path, header=True)
    return path


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> str:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_jsonl(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def json_summary(df: DataFrame, name: str = "summary", most: int = 10_000) -> DataFrame:
    """One nested row of an already aggregated table, ready for the JSON writer.

    Meant for summaries; a table of more than ``most`` rows is refused, since
    one row holds it all.  Write larger ones as JSON lines.
    """
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a summary holds {most} rows at most; use write_jsonl for the table itself")
    return df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))


def write_sorted(df: DataFrame, path: str, by: list[str], files: int = 8) -> str:
    """Parquet files in order: each holds one range of ``by``, sorted inside, so reading them by name gives the order."""
    df.repartitionByRange(files, *by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)
    return path


def append_days(df: DataFrame, path: str, batch: int) -> str:
    """Add rows as one numbered batch; writing the same batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return path


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Last batch wins per key."""
    rows = spark.read.option("basePath", path).parquet(path)
    return keep_last(rows, keys, [F.col("batch")]).drop("batch")


def _numbered(spark: SparkSession, path: str, kind: str) -> list[int]:
    return sorted(int(name.split("=")[1]) for name, *_ in source_version(spark, path) if name.startswith(f"{kind}="))


def _folded(spark: SparkSession, path: str) -> int | None:
    """Number of the last fold that is complete."""
    done = [k for k in _numbered(spark, path, "fold") if any(name == "_SUCCESS" for name, *_ in source_version(spark, f"{path}/fold={k}"))]
    return done[-1] if done else None


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The last complete fold and the batches after it."""
    fold = _folded(spark, path)
    later = [f"{path}/batch={b}" for b in _numbered(spark, path, "batch") if fold is None or b > fold]
    return spark.read.parquet(*([f"{path}/fold={fold}"] if fold is not None else []), *later)


def merge_batches(spark: SparkSession, path: str, keys: list[str], sums: list[str]) -> DataFrame:
    """Sums per key over all batches, folded ones included."""
    return read_batches(spark, path).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def fold_batches(spark: SparkSession, path: str, keys: list[str], sums: list[str], upto: int) -> None:
    """Add the batches up to ``upto`` into one folder ``fold=upto``, which readers take from then on.

    A fold counts once it is complete, so a reader sees the table before or
    after it.  What the fold before had replaced is deleted; what this one
    replaces stays for readers that are under way.  Doing it again changes nothing.
    """
    before = _folded(spark, path)
    if before is not None and before >= upto:
        return
    rows = read_batches(spark, path) if before is None or any(b > before for b in _numbered(spark, path, "batch")) else None
    if rows is not None:
        merge_batches(spark, path, keys, sums).write.mode("overwrite").parquet(f"{path}/fold={upto}")
    if before is not None:
        gone = [f"batch={b}" for b in _numbered(spark, path, "batch") if b <= before] + [f"fold={k}" for k in _numbered(spark, path, "fold") if k < before]
        remove_folders(spark, [f"{path}/{g}" for g in gone])


def compact_sums(spark: SparkSession, path: str, out: str, keys: list[str], sums: list[str]) -> str:
    """The batches of ``path`` added up as batch -1 of a new table; later batches may be appended to it."""
    return append_days(merge_batches(spark, path, keys, sums), out, -1)


def compact(spark: SparkSession, path: str, out: str, keys: list[str]) -> str:
    """Rewrite a batched table as one row per key under a new path."""
    read_latest(spark, path, keys).write.mode("overwrite").parquet(out)
    return out
