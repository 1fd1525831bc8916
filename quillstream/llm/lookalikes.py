"""Text that looks the same but is written with other characters, brought to
one form."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, melt
from . import folding, mojibake

_WORD = re.compile(r"[^\W\d_]+")


def _proposals(text: str) -> list[tuple[int, int, str, list[str]]]:
    """Stretches of ``text`` in which look-alikes stand: (start, end, new
    text, the words that have to be known for it)."""
    out = []
    for start, end, token, new in folding.chunks(text):
        words = [m.group().lower() for m in _WORD.finditer(new) if m.group() != token[m.start() : m.end()]]
        out.append((start, end, new, words))
    return out


def unify(df: DataFrame, keys: list[str], fields: list[str], model: dict | None = None) -> DataFrame:
    """One row for each value of ``fields`` that was in doubt: keys,
    ``field_name``, ``raw``, ``unified`` and ``changed`` (``unify_all`` has
    every value).

    Letters are composed, forms of other width or style made plain, widthless
    characters and marks of direction dropped, blanks made ordinary; what has
    a look of its own stays. Look-alikes of a foreign script are replaced where
    a token mixes scripts, by the script that dominates the token (a token of
    look-alikes alone goes by the script of its text), and only if the words
    that come out occur in the corpus, in some value of ``fields``. A value garbled by a wrong charset
    (``mojibake``) is left alone. Edge cases: null values give no row, empty
    ones stay; repeated rows come out each; other columns are ignored; whole
    texts are treated, whatever their length.
    """
    spark = df.sparkSession
    shipped = spark.sparkContext.broadcast(model or mojibake.train(df, fields))  # a few dictionaries of bounded size
    cells = melt(df, keys, fields)
    doubtful = F.col("raw").rlike(r"[^\x20-\x7e]")
    types = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = mojibake.repairer_of(shipped)
        for batch in batches:
            texts, stretches = [], []
            for raw in batch.column("raw").to_pylist():
                new, found = folding.fold_forms(raw), []
                if new != raw or not new.isascii():
                    found = _proposals(new)
                    if (new != raw or found) and repairer.repair(raw)[0] != "clean":
                        new, found = raw, []
                texts.append(new)
                stretches.append([{"start": a, "end": b, "new": t, "words": w} for a, b, t, w in found])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("new", pa.string()), ("words", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(stretches, kind)], [*batch.schema.names, "folded", "stretches"])

    folded = cells.filter(doubtful).mapInArrow(fold, f"{types}, field_name string, raw string, folded string, stretches array<struct<start: int, end: int, new: string, words: array<string>>>")
    folded = cut(folded.filter((F.col("folded") != F.col("raw")) | (F.size("stretches") > 0)))
    plain = [*keys, "field_name", "raw"]

    # The few values with look-alikes ask for the few words they need.
    asking = folded.filter(F.size("stretches") > 0)
    wanted = asking.select(F.explode("stretches").alias("s")).select(F.explode("s.words").alias("word")).distinct()
    spoken = cells.select(F.explode(F.array_distinct(F.expr(r"regexp_extract_all(lower(raw), '[\\p{L}\\p{M}]+', 0)"))).alias("word")).groupBy("word").agg(F.lit(True).alias("known"))
    known = wanted.join(spoken, "word", "left").select("word", F.coalesce("known", F.lit(False)).alias("known"))
    numbered = asking.groupBy(*plain, "folded", "stretches").agg(F.count("*").alias("_copies"))
    asked = numbered.select("*", F.posexplode("stretches").alias("_n", "_s")).select(*plain, "folded", "_copies", "_n", "_s", F.explode_outer("_s.words").alias("word"))
    judged = asked.join(known, "word", "left").groupBy(*plain, "folded", "_copies", "_n", "_s").agg(F.min(F.coalesce("known", F.lit(True))).alias("_ok"))
    gathered = judged.groupBy(*plain, "folded", "_copies").agg(F.array_sort(F.collect_list(F.when(F.col("_ok"), F.struct(F.col("_s.start").alias("a"), F.col("_s.end").alias("b"), F.col("_s.new").alias("t"))))).alias("_do"))

    # From the last stretch to the first, so that places stay right.
    piece = lambda text, s: F.concat(F.substring(text, F.lit(1), s["a"]), s["t"], F.substring(text, s["b"] + 1, F.length(text)))
    replaced = gathered.withColumn("unified", F.aggregate(F.reverse("_do"), F.col("folded"), piece))
    replaced = replaced.select(*plain, "unified", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_i")).drop("_i")
    changed = folded.filter(F.size("stretches") == 0).select(*plain, F.col("folded").alias("unified")).unionByName(replaced)
    done = changed.withColumn("changed", F.col("unified") != F.col("raw"))
    return done


def unify_all(df: DataFrame, keys: list[str], fields: list[str], model: dict | None = None) -> DataFrame:
    """As ``unify``, with the values that needed no change as well."""
    done = unify(df, keys, fields, model).filter("changed").dropDuplicates([*keys, "field_name", "raw"])
    cells = melt(df, keys, fields)
    return cells.join(done, [*keys, "field_name", "raw"], "left").select(*keys, "field_name", "raw", F.coalesce("unified", "raw").alias("unified"), F.col("unified").isNotNull().alias("changed"))
