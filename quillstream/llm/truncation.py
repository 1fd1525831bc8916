"""Texts cut off by a field limit or mid-transfer, in SQL over word trigrams."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from . import residue

#: Least number of times that a trigram or an opening is met for it to tell.
SUPPORT = 3
#: Share of its uses at an end up to which a trigram is "almost never" final.
RARELY = 0.05
#: Share of texts of an opening that end with a stop from which they all should.
MOSTLY = 0.9

# Marks that writers of fields put where they cut, and how they
# look when garbled; a full stop of Japanese and its garbled looks.
CUT_MARKS = r"(?:\.{3,}|…|\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|â€¦|вЂ¦|‚Ä¦|ÔÇª|â\x80¦|â\x80\xa6|Ã¢â‚¬Â¦|ΓÇª|窶ｦ)"
STOPS = r"(?:[.!?。！？]|ã€‚|ã\x80\x82|гЂ‚|縲[�・]?|｡｣|¡£|\x81B|�B)"
CLOSERS = r"(?:[\"'”’»«)\]\s]|â€\x9d|â€™|â€|вЂќ|ÔÇØ|‚Äù|Ã¢â‚¬Â\x9d|Â»|窶�|�)"

#: Each text once: what stands before a mark of cutting, how it ends, its words
#: without marks at their ends, and which of them end a sentence.
WORDS_SQL = """
WITH texts AS (
  SELECT *, regexp_like(shown, '@marks@@closers@*$') AS marked,
         regexp_replace(shown, '\\\\s*@marks@@closers@*$', '') AS body
  FROM (SELECT @keys@, site, field, rtrim(regexp_replace(field, '&hellip;|&#8230;', '…')) AS shown FROM @rows@)
),
split AS (
  SELECT @keys@, site, field, marked, body, NOT marked AND regexp_like(body, '@stops@@closers@*$') AS stopped,
         regexp_extract_all(regexp_replace(translate(lower(body), '0123456789”"»)]“„«([', '0000000000'), '00+', '0'),
                            '[\\\\p{IsHan}\\\\p{IsHiragana}\\\\p{IsKatakana}ー]|[^\\\\s\\\\p{IsHan}\\\\p{IsHiragana}\\\\p{IsKatakana}ー。、]+[。、]?', 0) AS w
  FROM texts
)
SELECT @keys@, site, field, marked, stopped,
       NOT stopped AND NOT marked AND regexp_like(body, '[^\\\\s.!?]{2,}[.!?][”"»)]*\\\\s+[\\\\p{Lu}¿¡“„«№0-9]|[。！？]') AS later,
       transform(w, x -> rtrim('.,;:!?。、', x)) AS w, transform(w, x -> right(x, 1) IN ('.', '!', '?', '。')) AS ends
FROM split
"""
SQL = """
WITH placed AS (  -- every trigram, 0 inside of a sentence, 1 at the end of one, 2 at an end without a stop
  SELECT inline(transform(sequence(0, size(w) - 3), i -> struct(
           concat_ws(' ', w[i], w[i + 1]) AS two, w[i + 2] AS third,
           CASE WHEN i = size(w) - 3 THEN if(stopped, 1, 2) WHEN ends[i + 2] THEN 1 ELSE 0 END AS place)))
  FROM @worded@ WHERE size(w) >= 3
),
trigrams AS (
  SELECT two, third, count_if(place = 0) AS inside, count_if(place = 1) AS at_end, count_if(place = 2) AS bare
  FROM placed GROUP BY two, third
),
open_ends AS (
  SELECT *, CASE WHEN size(w) >= 3 THEN concat_ws(' ', w[size(w) - 3], w[size(w) - 2]) END AS two,
         CASE WHEN size(w) >= 3 THEN w[size(w) - 1] END AS third,
         CASE WHEN size(w) >= 3 THEN concat_ws(' ', slice(w, 1, 3)) END AS opening
  FROM @worded@ WHERE NOT stopped AND trim(field) <> ''
),
asked AS (  -- after which two words a fragment is asked for, and of what lengths
  SELECT two, collect_set(length(third)) AS lengths FROM open_ends WHERE two IS NOT NULL GROUP BY two
),
begun AS (  -- words that such a fragment may be the beginning of
  SELECT two, fragment, sum(n) AS n FROM (
    SELECT t.two, inside + at_end AS n, third, explode(filter(lengths, k -> k < length(third))) AS k
    FROM trigrams t JOIN asked a ON t.two = a.two WHERE inside + at_end > 0)
    LATERAL VIEW explode(array(left(third, k))) AS fragment
  GROUP BY two, fragment
),
openings AS (
  SELECT opening, count(*) AS n, count_if(stopped) AS n_stopped FROM (
    SELECT concat_ws(' ', slice(w, 1, 3)) AS opening, stopped FROM @worded@ WHERE NOT marked AND size(w) >= 3)
  GROUP BY opening
),
copies AS (  -- a text's own ending, once for each row that has this very text
  SELECT two, third, text, count(*) AS n FROM (SELECT two, third, xxhash64(field) AS text FROM open_ends WHERE two IS NOT NULL)
  GROUP BY two, third, text
)
SELECT @o_keys@, o.site, o.field, o.marked,
       CASE WHEN t.inside >= @support@ AND t.at_end + t.bare - c.n <= @rarely@ * t.inside THEN 'trigram'
            WHEN b.n >= @support@ AND coalesce(t.inside + t.at_end, 0) = 0 AND coalesce(t.bare, 0) <= @rarely@ * b.n + c.n THEN 'word'
            WHEN p.n_stopped >= @support@ AND p.n_stopped >= @mostly@ * p.n THEN 'opening'
            -- Marks and stops decide where the counts don't.
            WHEN o.marked THEN 'marked'
            WHEN o.later THEN 'sentence' END AS reason
FROM open_ends o
LEFT JOIN trigrams t ON o.two = t.two AND o.third = t.third
LEFT JOIN copies c ON o.two = c.two AND o.third = c.third AND xxhash64(o.field) = c.text
LEFT JOIN begun b ON o.two = b.two AND o.third = b.fragment
LEFT JOIN openings p ON o.opening = p.opening
"""


def _run(spark: SparkSession, query: str, values: dict, name: str, rows: DataFrame) -> DataFrame:
    view = f"texts_{uuid4().hex}"
    rows.createOrReplaceTempView(view)
    for key, value in {**values, name: view}.items():
        query = query.replace(f"@{key}@", str(value))
    out = spark.sql(query)
    spark.catalog.dropTempView(view)
    return out


def find_cut(df: DataFrame, keys: list[str], text_col: str, site_col: str = "site_id", title_col: str = "title", url_col: str = "original_url", site_name_col: str = "site_name") -> DataFrame:
    """One row for each text that was cut: keys, ``site``, ``reason``.

    ``reason`` is ``trigram`` (the last three words are frequent inside of texts
    and almost never end another one), ``word`` (the last word only begins one
    that makes a frequent trigram there) or ``opening`` (texts that begin with
    these three words nearly always end with a stop); where these counts don't
    decide, ``marked`` (dots show the cut) or ``sentence`` (sentences with
    stops, then one without). Residue (``residue``, told by the row's title,
    address and site as well) is no cut text. Edge cases: null, empty and blank
    texts are not cut; texts of under three words only if marked; text is read
    whole; repeated rows come out each and count; other columns are ignored; a
    null site is a site of its own.
    """
    spark = df.sparkSession
    beside = {"_title": title_col, "_url": url_col, "_name": site_name_col}
    given = df.select(*keys, F.col(site_col).alias("site"), *[F.col(c).alias(n) for n, c in beside.items()], F.col(text_col).alias("field")).filter(F.col(text_col).isNotNull())
    quoted = lambda p: p.replace("\\", "\\\\").replace("'", "\\'")
    carried = [*keys, *beside]
    values = {"keys": ", ".join(carried), "o_keys": ", ".join(f"o.{k}" for k in carried), "marks": quoted(CUT_MARKS), "stops": quoted(STOPS), "closers": quoted(CLOSERS), "support": SUPPORT, "rarely": RARELY, "mostly": MOSTLY}
    # The words are made once and written, as three parts of the query read them.
    worded = scratch(_run(spark, WORDS_SQL, values, "rows", given))
    found = scratch(_run(spark, SQL, values, "worded", worded).filter("reason is not null").withColumn("_no", F.expr("uuid()")))
    # Only what would be found is asked whether it is residue.
    left_over = residue.find_residue(found, ["_no"], ["field", "_title"], "_url", "site", "_name").filter("residue and field_name = 'field'")
    return found.join(left_over.select("_no"), "_no", "left_anti").select(*keys, "site", "reason")


def cut_rates(df: DataFrame, cut: DataFrame, text_col: str, site_col: str = "site_id") -> DataFrame:
    """For each site how many texts it has, how many are cut, and the share."""
    sites = df.groupBy(F.col(site_col).alias("site")).agg(F.count(text_col).alias("n_texts"))
    cuts = cut.groupBy("site").agg(F.count("*").alias("n_cut"))
    joined = sites.join(cuts, sites["site"].eqNullSafe(cuts["site"]), "left").select(sites["site"], "n_texts", F.coalesce("n_cut", F.lit(0)).alias("n_cut"))
    return joined.withColumn("rate", F.when(F.col("n_texts") > 0, F.round(F.col("n_cut") / F.col("n_texts"), 6)))
