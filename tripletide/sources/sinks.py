"""Writers: snapshots, exports, profiles, reports. A snapshot is written beside the old one and takes its place when it is whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def save_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}.new/{name}")
    new, fs = _fs(spark, f"{path}.new")
    old, _ = _fs(spark, path)
    fs.delete(old, True)
    fs.rename(new, old)


def load_snapshot(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame] | None:
    """The tables of a snapshot; None where one of them isn't there."""
    for n in names:
        p, fs = _fs(spark, f"{path}/{n}")
        if not fs.exists(p):
            return None
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def flatten(row: DataFrame, category: str) -> DataFrame:
    """(category, metric, value) of the columns of a one-row frame, as text."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in row.columns])
    return row.select(F.lit(category).alias("category"), F.explode(cells).alias("x")).select("category", "x.*")


def write_metrics(rows: DataFrame, path: str, kind: str = "csv") -> None:
    w = rows.write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.json(path)


def write_profiles(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("overwrite").json(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles with defaults for what is missing: reliability .5, counts 0."""
    p = spark.read.schema("source_id string, reliability_score double, total_triples bigint, accepted_triples bigint, rejected_triples bigint, conflicts_caused bigint, first_seen timestamp, last_seen timestamp").json(path)
    return p.na.fill({"reliability_score": 0.5, "total_triples": 0, "accepted_triples": 0, "rejected_triples": 0, "conflicts_caused": 0})


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def send(rows: DataFrame, open_: Callable[[], Callable[[list[dict]], None]], batch: int = 500) -> None:
    """Rows to an outside store, in batches of each partition: ``open_`` gives a writer inside the task. A task that is run again sends its rows again, so the writer is to be idempotent by key."""

    def run(part: Iterator) -> None:
        write, held = open_(), []
        for r in part:
            held.append(r.asDict(True))
            if len(held) >= batch:
                write(held)
                held = []
        if held:
            write(held)

    rows.foreachPartition(run)


def latex_rows(rows: list[dict], columns: list[str]) -> str:
    """A table body of a small report."""
    return "\n".join(" & ".join(str(r[c]).replace("_", r"\_").replace("%", r"\%") for c in columns) + r" \\" for r in rows)
