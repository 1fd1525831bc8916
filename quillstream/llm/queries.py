"""Named queries of the text operators, each a function of (spark, directory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import leakage, locales, lookalikes, mixing, mojibake, personal, residue, truncation


def _residue(spark, d):
    return residue.find_residue(table(spark, d, "link_metadata"), ["meta_id"], ["title", "description"]).filter("residue")


def p2_found(spark, d):
    return _residue(spark, d).select("meta_id", "field_name")


def p2_report(spark, d):
    """Kinds of residue by field, and how widely they recur."""
    return _residue(spark, d).groupBy("field_name", F.coalesce("kind", F.lit("recurring")).alias("kind")).agg(F.count("*").alias("n_values"), F.max("n_hosts").alias("most_hosts"))


def _garbled(spark, d):
    links = table(spark, d, "link_metadata")
    return mojibake.find_garbled(links, ["meta_id"], ["title", "description"], table(spark, d, "fetch_diagnostics"))


def p3_found(spark, d):
    return _garbled(spark, d).select("meta_id", "field_name")


def p3_restored(spark, d):
    """The original texts, where they can be had, and what had happened."""
    return _garbled(spark, d).select("meta_id", "field_name", "restored", "chain")


def p4_found(spark, d):
    return truncation.find_cut(table(spark, d, "link_metadata"), ["meta_id"], "description").select("meta_id")


def p4_rates(spark, d):
    """How often each site cuts its descriptions."""
    links = table(spark, d, "link_metadata")
    return truncation.cut_rates(links, truncation.find_cut(links, ["meta_id"], "description"), "description").withColumnRenamed("site", "site_id")


def p5_found(spark, d):
    links, entries = table(spark, d, "link_metadata"), table(spark, d, "locales")
    mapping = locales.map_locales(links, entries)
    known = links.filter("locale is not null").join(entries.select(F.col("locale_code").alias("locale")), "locale", "left_anti")
    return locales.with_locale(known, mapping).select("meta_id", "locale_code")


def p5_report(spark, d):
    """What each reference entry was typed as, and how often; the unmatched
    values one by one."""
    mapping = locales.map_locales(table(spark, d, "link_metadata"), table(spark, d, "locales"))
    shown = F.when(F.col("locale_code") == locales.UNMATCHED, F.col("locale")).otherwise(F.lit("")).alias("unmatched_value")
    return mapping.groupBy("locale_code", shown).agg(F.count("*").alias("n_spellings"), F.sum("n_rows").alias("n_rows"))


def p6_found(spark, d):
    done = lookalikes.unify(table(spark, d, "link_metadata"), ["meta_id"], ["title", "site_name"])
    return done.filter("changed").select("meta_id", "field_name")


def p6_unified(spark, d):
    """All titles and site names in one form."""
    return lookalikes.unify_all(table(spark, d, "link_metadata"), ["meta_id"], ["title", "site_name"]).select("meta_id", "field_name", "unified", "changed")


def p8_found(spark, d):
    leaks = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return leaks.select("doc_id", "item_id")


def p8_items(spark, d):
    """Which items leaked, in how many documents, and how much at most."""
    leaks = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return leaks.groupBy("item_id", "template").agg(F.count("*").alias("n_documents"), F.max("n_words").alias("most_words"), F.max("item_words").alias("item_words"))


#: Vocabulary that tokens are counted by, and its splitting pattern.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def p9_mixed(spark, d, tokenizer=TOKENIZER, pattern=PATTERN):
    counter = mixing.token_counter(spark, tokenizer, pattern)
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), counter)


def p9_shares(spark, d, tokenizer=TOKENIZER, pattern=PATTERN):
    """The shares reached beside those aimed at."""
    return mixing.shares(p9_mixed(spark, d, tokenizer, pattern), table(spark, d, "mix_targets"))


def p10_found(spark, d):
    mentions = personal.find_personal(table(spark, d, "documents"), table(spark, d, "members"))
    return mentions.select("doc_id", "pii_type", "found_text").distinct()


def p10_redacted(spark, d):
    """All texts with typed placeholders in the place of what is personal."""
    documents = table(spark, d, "documents")
    return personal.redact(documents, personal.find_personal(documents, table(spark, d, "members")))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p3_restored, p4_found, p4_rates, p5_found, p5_report, p6_found, p6_unified, p8_found, p8_items, p9_mixed, p9_shares, p10_found, p10_redacted)}
ORACLES: dict[str, str] = {}
