"""Freely typed values to the entries of a reference list of locales, by a
prefix-filter set-similarity join."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: Least Jaccard similarity of token sets at which a value means a form.
THRESHOLD = 0.55
UNMATCHED = "unmatched"
#: Forms of the reference list up to which they are shipped to every task.
FORMS_BROADCAST = 20_000

# What people call a language, by its code: three-letter codes,
# a country's code used for the language, and names in other languages.
LANGUAGE_ALIASES = {
    "cs": "ces cze cz tschechisch tchèque checo", "da": "dan dk dänisch danois danés", "de": "deu ger allemand alemán alemão niemiecki немецкий",
    "el": "ell gre gr griechisch grec griego", "en": "eng englisch anglais inglés inglês angielski английский", "es": "spa castellano castilian spanisch espagnol espanhol hiszpański испанский",
    "fi": "fin finnisch finnois finlandés", "fr": "fra fre französisch francés francês francuski французский", "hu": "hun ungarisch hongrois húngaro", "it": "ita italienisch italien",
    "ja": "jpn jp nihongo japanisch japonais japonés", "ko": "kor kr hangugeo koreanisch coréen coreano", "nl": "nld dut niederländisch néerlandais holandés", "pl": "pol polnisch polonais polaco польский",
    "pt": "por portugiesisch portugais portugués", "ru": "rus russisch russe ruso", "sv": "swe se schwedisch suédois sueco", "tr": "tur türkisch turc turco",
    "uk": "ukr ua ukrainisch ukrainien ucraniano", "zh": "zho chi cn zhongwen chinesisch chinois chino mandarin",
}
# What people call a region, by its code, besides the code and
# the name of the list.
REGION_ALIASES = {
    "US": "USA|U.S.|U.S.A.|America|Estados Unidos|États-Unis|Vereinigte Staaten", "GB": "GBR|UK|U.K.|Great Britain|Britain|England|Royaume-Uni|Reino Unido", "CA": "CAN|Kanada", "AU": "AUS|Australien",
    "IN": "IND|Indien|Bharat", "DE": "DEU|GER|Deutschland|Allemagne|Alemania", "AT": "AUT|Österreich|Autriche", "CH": "CHE|SUI|Schweiz|Suisse|Svizzera|Suiza",
    "FR": "FRA|Frankreich|Francia", "BE": "BEL|Belgien|Belgique|België|Flanders|Vlaanderen", "ES": "ESP|España|Spanien|Espagne", "MX": "MEX|México|Mexiko|Mexique", "AR": "ARG|Argentinien|Argentine",
    "PT": "PRT|POR", "BR": "BRA|Brasil|Brasilien|Brésil", "IT": "ITA|Italia|Italien", "NL": "NLD|NED|Nederland|Holland|The Netherlands|Niederlande|Pays-Bas", "PL": "POL|Polska|Polen|Pologne",
    "RU": "RUS|Россия|Russian Federation|Russland|Russie", "JP": "JPN|日本|Nippon|Nihon|Japon", "CN": "CHN|PRC|P.R.C.|中国|Mainland China|Chine|Simplified|Hans|简体", "TW": "TWN|TPE|台灣|台湾|Traditional|Hant|繁體|繁体",
    "KR": "KOR|Korea|대한민국|한국|Republic of Korea|Corée", "TR": "TUR|Türkiye|Türkei|Turquie",
}
# Words that name the variety of a language spoken in a region.
VARIETIES = {
    "US": "American|US|americano|américain|amerikanisches", "GB": "British|UK|britannique|britisches|británico", "CA": "Canadian|canadien|kanadisches|canadiense", "AU": "Australian|australien|australisches", "IN": "Indian|indien|indisches",
    "DE": "Germany", "AT": "Austrian|österreichisches|autrichien|austriaco", "CH": "Swiss|schweizer|suisse|svizzero", "BE": "Belgian|belge|belgisches|Flemish", "MX": "Mexican|mexicano|mexikanisches", "AR": "Argentine|Argentinian|argentino|Rioplatense",
    "ES": "European|Peninsular", "PT": "European|europeu|europäisches", "BR": "Brazilian|brasileiro|brasilianisches", "CN": "Simplified|Mainland", "TW": "Traditional|Taiwanese",
}
# Names of a variety in one word.
ONE_WORD = {"nl-BE": "Flemish|Vlaams|Flämisch|Flamand", "de-CH": "Schweizerdeutsch|Schwyzerdütsch", "pt-BR": "Brasileiro|Brazilian", "zh-TW": "繁體中文|繁体中文|正體中文", "zh-CN": "简体中文|簡體中文"}
SCRIPT_TAGS = {"latn", "cyrl", "jpan", "kore", "grek"}

_NOISE = re.compile(r"(?i)^\s*(?:lang|language|locale|hl)\s*=|;\s*q\s*=.*$|\.(?:utf-?8|iso-?8859-?\d+|cp\d+)\b|@\w+\s*$|,\s*\*")
_CAMEL = re.compile(r"^([a-z]{2,3})([A-Z]{2,3})$")
_DOTS = re.compile(r"(?<![^\W_])((?:[^\W_]\.){2,})")
_SPLIT = re.compile(r"[\W_]+")


def words_of(value: str) -> list[str]:
    """The words of a value: case, accents, marks, quotes, encodings and
    script tags are dropped, two codes written together are parted."""
    text = unicodedata.normalize("NFKC", value)
    text = _NOISE.sub(" ", text).strip().strip("\"'“”")
    text = _CAMEL.sub(r"\1 \2", text)
    text = _DOTS.sub(lambda m: m.group(1).replace(".", ""), text)
    text = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c) or c in "゙゚")
    return [w for w in _SPLIT.split(unicodedata.normalize("NFC", text)) if w and w not in SCRIPT_TAGS]


def tokens_of(words: list[str]) -> list[str]:
    """The token set of words: of a short word, which may be a code, the whole
    (three times, as it says as much as a longer one); of a longer word its
    pairs of letters with the edges, and its letters, which a slip that swaps
    two of them leaves alone. A repeated token is numbered."""
    seen: dict[str, int] = {}
    out = []
    for w in words:
        if len(w) <= 3:
            parts = [f"={w}"] * 3
        else:
            edged = f"^{w}$"
            parts = [edged[i : i + 2] for i in range(len(edged) - 1)] + list(w)
        for p in parts:
            seen[p] = seen.get(p, 0) + 1
            out.append(f"{p}{seen[p]}")
    return out


def reference_forms(entries: list[tuple]) -> list[tuple[str, str, list[str]]]:
    """Every form of the list's entries, (code, form, tokens), from rows
    (locale_code, language_name, native_name, country_name)."""
    forms: dict[tuple[str, str], list[str]] = {}

    def add(code: str, text: str) -> None:
        if words := words_of(text):
            forms.setdefault((code, " ".join(words)), tokens_of(words))

    for code, language, native, country in entries:
        lang, _, region = code.partition("-")
        names = [n for n in (lang, language, native, *LANGUAGE_ALIASES.get(lang, "").split()) if n]
        if not region:
            for n in names:
                add(code, n)
            continue
        places = [n for n in (region, country, *REGION_ALIASES.get(region, "").split("|")) if n]
        for n in names:
            for p in places:
                add(code, f"{n} {p}")
            for v in VARIETIES.get(region, "").split("|"):
                if v and len(n) > 3:
                    add(code, f"{v} {n}")
                    add(code, f"{n} {v}")
        for n in ONE_WORD.get(code, "").split("|"):
            add(code, n)
    return [(code, form, tokens) for (code, form), tokens in forms.items()]


def _tokens(most: int):
    """A column function to the tokens of values; of more than ``most`` none, as
    the length filter leaves such a set no form to be similar to."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokens(values: pd.Series) -> pd.Series:
        made = (tokens_of(words_of(v)) for v in values)
        return pd.Series([t if len(t) <= most else [] for t in made], dtype=object)

    return tokens


def _forms(locales: DataFrame) -> DataFrame:
    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [tuple(None if pd.isna(x) else x for x in r) for r in frame.itertuples(index=False, name=None)]
            yield pd.DataFrame(reference_forms(rows), columns=["locale_code", "form", "tokens"])

    entries = locales.select("locale_code", "language_name", "native_name", "country_name").filter("locale_code is not null")
    forms = entries.mapInPandas(spell, "locale_code string, form string, tokens array<string>").dropDuplicates(["locale_code", "form"])
    return forms.withColumn("form_id", F.concat_ws("|", "locale_code", "form"))


def map_locales(df: DataFrame, locales: DataFrame, value_col: str = "locale", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each distinct non-null value of ``value_col``: the value,
    ``locale_code`` (or ``unmatched``), ``form`` (the form it was taken for),
    ``similarity`` and ``n_rows``.

    Token sets are ordered by how rare a token is over all values and forms;
    two sets can only be as similar as ``threshold`` if they share a token
    among their first few, so only those are joined. Length and position rule
    out most of the pairs, the exact Jaccard similarity decides, and the best
    form is kept (of equals the one of the shorter code, then the lesser).
    Edge cases: null values give no row; empty values and values of signs
    alone are ``unmatched``, with an empty list everything is; values are read
    whole, whatever their length.
    """
    right = cut(_forms(locales))
    values = df.filter(F.col(value_col).isNotNull()).groupBy(F.col(value_col).alias("value")).agg(F.count("*").alias("n_rows"))
    longest = right.agg(F.max(F.size("tokens"))).collect()[0][0] or 0
    left = cut(values.withColumn("tokens", _tokens(int(longest / threshold + 1e-9))("value")))
    small = right.limit(FORMS_BROADCAST + 1).count() <= FORMS_BROADCAST

    spread = left.select(F.explode("tokens").alias("t")).unionAll(right.select(F.explode("tokens").alias("t")))
    # A token goes by its count over both sides and itself: ordered by rarity,
    # and two tokens are never taken for one.
    counted = spread.groupBy("t").agg(F.count("*").alias("n"))
    numbered = counted.select("t", F.concat(F.lpad(F.col("n").cast("string"), 12, "0"), F.col("t")).alias("r"))

    def ordered(side: DataFrame, key: str) -> DataFrame:
        """Tokens by rarity, and how many of the first decide."""
        ranked = side.select(key, F.explode("tokens").alias("t")).join(numbered, "t").groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("set"))
        return ranked.withColumn("first", F.expr(f"size(set) - cast(ceil({threshold} * size(set) - 1e-9) as int) + 1"))

    def postings(side: DataFrame, key: str, tag: str) -> DataFrame:
        return side.select(F.col(key), F.col("set").alias(f"set_{tag}"), F.posexplode(F.slice("set", 1, F.col("first"))).alias(f"at_{tag}", "r"))

    x, y = postings(ordered(left, "value"), "value", "x"), postings(ordered(right, "form_id"), "form_id", "y")
    size_x, size_y = F.size("set_x"), F.size("set_y")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (size_x + size_y) - 1e-9)
    fits = (size_y >= threshold * size_x - 1e-9) & (size_x >= threshold * size_y - 1e-9)
    room = 1 + F.least(size_x - F.col("at_x") - 1, size_y - F.col("at_y") - 1)
    shared = F.size(F.array_intersect("set_x", "set_y"))
    # Pairs are verified where they meet and only the best of a value go on;
    # a pair that meets at several tokens does no harm there.
    pairs = x.join(F.broadcast(y) if small else y, "r").filter(fits & (room >= need))
    scored = pairs.select("value", "form_id", (shared / (size_x + size_y - shared)).alias("similarity")).filter(F.col("similarity") >= threshold - 1e-9)
    code = F.substring_index("form_id", "|", 1)
    best = scored.groupBy("value").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.length(code).alias("l"), code.alias("locale_code"), F.expr("substring(form_id, instr(form_id, '|') + 1)").alias("form"))).alias("b"))
    return left.select("value", "n_rows").join(best, "value", "left").select(
        F.col("value").alias(value_col),
        F.coalesce("b.locale_code", F.lit(UNMATCHED)).alias("locale_code"),
        F.col("b.form").alias("form"),
        F.round(-F.col("b.s"), 6).alias("similarity"),
        "n_rows",
    )


def with_locale(df: DataFrame, mapping: DataFrame, value_col: str = "locale") -> DataFrame:
    """``df`` with the ``locale_code`` of its value, null where it has none.
    The mapping has one row for each value; a value that a third of the rows
    share is split over tasks by the engine's skew handling."""
    return df.join(mapping.select(value_col, "locale_code"), value_col, "left")
