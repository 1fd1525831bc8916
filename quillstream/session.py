"""Session helpers shared by every operator: table access, lineage cuts and
size-checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """``name`` of the given directory of Parquet tables."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Where it is unset, a
    temporary one on a single machine, as in tests, and an error on a cluster,
    whose machines don't share one."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    path = path or tempfile.mkdtemp(prefix="quillstream-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again, so that later
    stages neither recompute it nor depend on an executor that is gone."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def scratch(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """As ``cut``, but as a Parquet table: columnar, so that readers which
    need few columns read few, and compressed."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"scratch-{os.urandom(8).hex()}")
    (df.select(*columns) if columns else df).write.parquet(path)
    return spark.read.schema(df.select(*columns).schema if columns else df.schema).parquet(path)


def melt(df: DataFrame, keys: list[str], fields: list[str], value: str = "raw") -> DataFrame:
    """Turns the columns ``fields`` into rows (keys..., field_name, value);
    null values yield no row."""
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias(value)) for f in fields])
    cell = F.explode(F.filter(cells, lambda c: c[value].isNotNull())).alias("_cell")
    return df.select(*keys, cell).select(*keys, "_cell.field_name", f"_cell.{value}")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows over as many tasks as a shuffle has, for narrow rows that make
    much work each: a few MB of them are read by one task or two."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: Tasks that the rows of one key of ``salted_join`` are spread over.
SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``left`` joined with ``right``, which is small beside it and has each key
    once or a few times, by ``keys``. The rows of one key are spread over
    ``salts`` tasks, to each of which the rows of ``right`` go, so that a key
    with a third of all rows isn't one task's. Nulls don't meet."""
    spread = left.withColumn("_salt", (F.rand() * salts).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")
