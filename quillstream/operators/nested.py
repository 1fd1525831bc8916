"""Deeply nested records to flat, related tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nested

def flatten_objects(df: DataFrame, id_col: str = "graph_id", nodes_col: str = "nodes", labels_only: bool = False) -> DataFrame:
    """One row for each JSON object in ``nodes_col`` at any depth: the id,
    ``path``, ``parent_path``, ``dewey``, ``parent_dewey``, ``depth``,
    ``schema_path`` and ``scalars`` (map of the members that hold no object).

    ``dewey`` labels an object by its ordinals, one group for each enclosing
    object; ``path`` by its keys and positions. Both parent columns come of
    truncating the label by its last step, without a join; the empty string
    stands for no parent. ``schema_path`` is the path without positions, with
    ``$`` for the top: objects that share it have one shape and make one table;
    ``parent_schema_path`` is that of the parent. In both, ``/`` and ``~`` of keys
    are written ``~1`` and ``~0``. ``labels_only`` leaves
    out ``scalars``, for those who need just the tree.
    Edge cases: a null or empty list, null or unreadable elements, plain values
    and empty objects yield no row; of repeated keys in an object the last
    counts; repeated rows are labelled each; other columns are ignored. JSON
    may be nested to any depth.
    """
    names = ["path", "parent_path", "dewey", "parent_dewey", "schema_path", "parent_schema_path"]
    schema = lambda keys: "$" + "/".join(k.replace("~", "~0").replace("/", "~1") for k in keys)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, columns, scalars, depths, at = batch.column(0), [[] for _ in names], [], [], []
            for row, texts in enumerate(batch.column(1).to_pylist()):
                for steps, ordinals, keys, members in nested.objects(texts or []):
                    at.append(row)
                    depths.append(len(steps))
                    parts = ("/".join(steps), "/".join(steps[:-1]), "-".join(ordinals), "-".join(ordinals[:-1]), schema(keys), schema(keys[:-1]) if len(keys) > 1 else "")
                    for column, part in zip(columns, parts, strict=True):
                        column.append(part)
                    if not labels_only:
                        scalars.append(members)
            out = [ids.take(pa.array(at, pa.int32())), *[pa.array(c, pa.string()) for c in columns], pa.array(depths, pa.int32())]
            if not labels_only:
                out.append(pa.array(scalars, pa.map_(pa.string(), pa.string())))
            yield pa.RecordBatch.from_arrays(out, ["_id", *names, "depth", *([] if labels_only else ["scalars"])])

    given = df.select(F.col(id_col).alias("_id"), F.col(nodes_col).alias("_nodes")).filter(F.size("_nodes") > 0)
    kinds = f"_id {given.schema['_id'].dataType.simpleString()}, {', '.join(f'{n} string' for n in names)}, depth int" + ("" if labels_only else ", scalars map<string, string>")
    return given.mapInArrow(label, kinds).withColumnRenamed("_id", id_col)


def schema_tables(flat: DataFrame) -> DataFrame:
    """The tables that the objects fall into: one row for each schema path,
    with its parent's schema path, its number of rows, of rows with a parent,
    and its columns (sorted, comma-separated). Keys are distinct within an
    object, so the columns are gathered as pairs, never as whole lists."""
    sizes = flat.groupBy("schema_path", "parent_schema_path").agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("parent_path") != "", 1)).alias("n_with_parent"))
    names = (
        flat.select("schema_path", F.explode_outer(F.map_keys("scalars")).alias("_k")).distinct()
        .groupBy("schema_path").agg(F.array_join(F.array_sort(F.collect_list("_k")), ",").alias("columns"))
    )
    return sizes.join(names, "schema_path")


def write_tables(flat: DataFrame, path: str) -> None:
    """Writes the objects as one table for each schema path (a partition of
    the dataset), tied by ``path`` and ``parent_path``."""
    flat.write.mode("overwrite").partitionBy("schema_path").parquet(path)


def table_of(flat: DataFrame, schema_path: str, columns: list[str]) -> DataFrame:
    """The table of one schema path with the given members as columns."""
    ids = [c for c in flat.columns if c not in {"schema_path", "scalars"}]
    return flat.filter(F.col("schema_path") == schema_path).select(*ids, *[F.col("scalars")[c].alias(f"v_{c}") for c in columns])
