"""Template residue, filler, error pages and script notices in place of content."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import folding, mojibake

#: Share of a value's telling words that belong to the language of systems
#: from which it may be residue, and hosts that then have to bear it out.
PARTLY, HOSTS = 0.75, 3

# The words of messages, notices, fillers and defaults, by
# language. A value all of whose telling words are among them says nothing of
# its own.
SYSTEM_WORDS = """
most something end while too per wait again that
page pages site website web server host gateway address url link resource document content title titles description text summary excerpt
headline tagline home homepage default sample placeholder untitled new blank empty test testing asdf qwerty xxx todo tbd tba lorem ipsum foo bar coming soon construction
found find missing exist exists moved removed deleted unavailable available temporarily permanently requested request requests error errors fatal warning notice exception uncaught traceback
recent call last typeerror keyerror valueerror nameerror undefined variable null nan index header template tpl php line srv app view stack internal bad service forbidden unauthorized denied access
permission permissions allowed blocked incident reference code status unexpected occurred happened went wrong whoops oops sorry maintenance scheduled down back shortly later again try please
connection database failed failure timed timeout expired session sign login log many minutes minute seconds moment wait loading checking check verify verifying verification human robot browser proceed
before continue javascript js script scripts scripting client-side client side cookie cookies noscript enable enabled enabling disable disabled activate activated allow turn turned switch switched off on run
support supports supported supporting require required requires need needs use full functionality functional view see display displayed displays show shown reload refresh kindly
insert enter add write replace goes here short characters max own just another your name label image example captcha security ddos protection ray complete
seite seiten angeforderte existiert mehr gefunden verfügbar aufgerufen wartungsarbeiten wartung später wiederkommen wieder versuchen erneut fehler interner serverfehler zugriff verweigert
aktivieren aktiviere aktiviert anzuzeigen anzeigen unbenanntes dokument unbenannt beispieltext eigenen inhalt einfügen steht text blindtext platzhalter titel beschreibung webseite skripte
page introuvable demandée existe déplacée erreur serveur interne accès refusé maintenance veuillez activer activez afficher titre sans exemple texte remplacer navigateur cookies contenu réessayer indisponible document
página pagina encontrada no existe acceso denegado error servidor mantenimiento debe activar active habilite usar sitio navegador título titulo aquí texto ejemplo sustituir publicar documento
não nao encontrada existe acesso negado erro servidor manutenção ative habilite seu navegador continuar exemplo documento
strona istnieje znaleziono błąd serwera dostęp zabroniony proszę włączyć włącz obsługę skryptów przeglądarce przeglądarka tytuł opis przykładowy tekst przerwa techniczna
страница найдена найден существует ошибка сервера доступ запрещён включите включить открыть сайт сайта браузере браузер скрипты технические работы заголовок страницы описание
このページを表示するには javascript 有効 にしてください お探しの ページ は 見つかりません 見つかりませんでした でした エラー メンテナンス中
"""
# Words without which none of it is a message, a filler or a default.
TRIGGERS = """
found missing exist exists unavailable error errors fatal warning exception uncaught traceback typeerror undefined null nan forbidden unauthorized denied blocked whoops oops sorry maintenance failed
timed timeout expired loading verify verifying human javascript js script scripts scripting cookie cookies noscript untitled default placeholder sample lorem ipsum asdf qwerty xxx test todo tbd tba soon construction
tagline insert goes here another bad gateway moment many new
existiert gefunden wartungsarbeiten fehler serverfehler verweigert aktivieren unbenanntes beispieltext steht platzhalter blindtext
introuvable existe erreur refusé activer activez titre exemple indisponible encontrada denegado activar active habilite aquí ejemplo sustituir mantenimiento título negado erro ative manutenção
istnieje znaleziono błąd zabroniony włączyć włącz найдена найден ошибка запрещён включите включить 見つかりませんでした 有効 エラー メンテナンス中 permission wrong
"""
# Words that tell nothing in any text.
STOP_WORDS = """
cannot cannot a an the of in on at to for from by with and or but is are was were be been being it its this that these those you your we we’re we’ll our us i me my he she they them their do does did don’t doesn’t didn’t can could
may might will would should must have has had not no if as so than then there here when where who which what how up out into over about all any some one two only very also just
der die das den dem des ein eine einen einem einer und oder ist sind war nicht kein keine hier ihr ihre ihren sie wir bitte um zu zum zur im in am an auf aus bei für mit nach von vor diese dieser dieses den
le la les l un une des du de d et ou est sont a à au aux ce cet cette ces il elle nous vous votre vos sur dans pour par avec ne pas n plus été
el la los las un una unos y o es son en de del al por para con su sus este esta no se lo que antes
o a os as um uma e é são em no na nos nas do da dos das por para com seu sua este esta não
w we z ze na do i lub jest są nie ta ten to tej się dla od po
в во на и или не с со по для у к о чтобы что это эта этот
"""
# The words of filler Latin.
FILLER_LATIN = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo
consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
"""
# Words that name fields in templates.
FIELD_WORDS = """
title titles name names description desc excerpt page pages post posts product products category categories headline heading content contents teaser item items label summary meta og seo site sitename article articles data i18n
i0n home url link image img author date body keyword keywords tag tags text value field key lang locale user username first last email subtitle caption slug id blog section brand price sku var variable str placeholder pagedescription pagetitle
"""
_SYSTEM, _TRIGGER, _STOP, _LATIN, _FIELD = (frozenset(x.split()) for x in (SYSTEM_WORDS, TRIGGERS, STOP_WORDS, FILLER_LATIN, FIELD_WORDS))
_JAPANESE = re.compile("(?:お探しの|この|ページ|は|が|を|に|して|ください|表示する|表示|見つかりません|でした|有効|無効|には|するには|ブラウザ|スクリプト|クッキー|エラー|メンテナンス|中|です|ます|サイト|JavaScript|javascript|Cookie|cookie|[。、\\s!！.])+")
_JAPANESE_TRIGGER = re.compile("見つかりません|有効|エラー|メンテナンス|無効")

#: Signs around a name that no text has, whatever the name.
_STRONG = re.compile(
    r"\{\{\{?\s*[^\s{}][^{}]*\}\}\}?|\{%-?\s*[a-z]\w*[^%{}]*%\}|<%[=-]?\s*[^%<>]+%>|<\?(?:=|php)\s*[^?<>]+\?>|[$#]\{\s*[A-Za-z_][^{}]*\}|\{\$[A-Za-z_][\w.>-]*\}|\*\|[A-Z_:]+\|\*"
    r"|\[object Object\]|%[0-9]+\$[sd]|(?<![\w'])t\(\s*'[\w.]+'\s*\)|(?<![\w'])t\(\s*\"[\w.]+\"\s*\)",
    re.I,
)
#: Signs that texts use as well; the name has to be one of a field.
_WEAK = re.compile(r"\{([A-Za-z_][\w.-]*|\d+)\}|\[\[\s*([\w.-]+)\s*\]\]|\[([A-Z][A-Z0-9_]{2,})\]|%([A-Za-z][\w.-]*)%|\$([A-Z][A-Z0-9_]*)\$|__([A-Za-z0-9]+(?:_[A-Za-z0-9]+)*)__|##\s*([\w.-]+)\s*##|@@\s*([\w.-]+)\s*@@")
_PARTS = re.compile(r"[._\-\s]+|(?<=[a-z])(?=[A-Z])")
_EMPTY = re.compile(r"(?:undefined|null|nan|none|nil|\(null\)|\(none\)|%[sd]|\{\{\s*\}\}|\{\}|\[\])", re.I)
_SEPARATOR = re.compile(r"\s*(?:::|\||»|·|\s[-–—]\s|:\s)\s*")
_TOKEN = re.compile(r"[^\W_]+(?:[’'-][^\W_]+)*")


def _names_field(name: str) -> bool:
    parts = [p.lower() for p in _PARTS.split(name) if p]
    return bool(parts) and (name.isdigit() or all(p in _FIELD for p in parts) or len(parts) > 1 and any(p in _FIELD for p in parts))


def placeholder_in(text: str) -> bool:
    """Whether a text holds an unfilled placeholder."""
    if _STRONG.search(text):
        return True
    for m in _WEAK.finditer(text):
        name = next(g for g in m.groups() if g)
        if not name.isdigit() and _names_field(name) or name.isdigit() and text.strip() == m.group():
            return True
    return False


@lru_cache(32_768)
def _belongs(word: str) -> bool:
    if word in _SYSTEM or word in _STOP:
        return True
    if "�" in word:  # a lost letter may be any
        pattern = re.compile(word.replace("�", "."))
        return any(pattern.fullmatch(w) for w in _SYSTEM)
    return False


def coverage(text: str) -> tuple[float, bool, int]:
    """(share of the telling words that systems use, whether one of them is
    telling of a message, filler or default, number of telling words)."""
    if re.search("[぀-ヿ]", text):
        return (1.0, True, 3) if _JAPANESE.fullmatch(text) and _JAPANESE_TRIGGER.search(text) else (0.0, False, 3)
    words = [w.lower() for w in _TOKEN.findall(text)]
    split = [p for w in words for p in ([w] if _belongs(w) else re.split("[’'-]", w))]
    telling = [w for w in split if w not in _STOP or w in _TRIGGER]
    telling = [w for w in telling if not w.isdigit() and not (re.fullmatch(r"[0-9a-f]{6,}", w) and any(c.isdigit() for c in w))]
    if not telling:
        return 0.0, False, 0
    hits = [_belongs(w) for w in telling]
    if not hits[-1] and all(hits[:-1]) and len(telling) > 2 and len(telling[-1]) > 1 and any(w.startswith(telling[-1]) for w in _SYSTEM):
        hits[-1] = True  # cut off
    trigger = any(w in _TRIGGER or "�" in w for w in telling)
    return sum(hits) / len(hits), trigger, len(telling)


def _latin_share(text: str) -> float:
    words = [w.lower() for w in _TOKEN.findall(text)]
    return sum(w in _LATIN or len(words) > 4 and w == words[-1] and any(x.startswith(w) for x in _LATIN) for w in words) / len(words) if len(words) >= 3 else 0.0


def strip_site(text: str, site: str | None) -> str:
    """``text`` without the name of its site behind a separator."""
    head, sep, tail = "", "", text
    for m in _SEPARATOR.finditer(text):
        head, sep, tail = text[: m.start()], m.group(), text[m.end() :]
    if sep and site and folding.fold_all(tail).strip().casefold() == folding.fold_all(site).strip().casefold():
        return head
    # A site's name of few capitalised words behind a strong separator.
    if sep.strip() in {"::", "|"} or sep.strip() in {"-", "–", "—"} and head:
        words = tail.split()
        if 0 < len(words) <= 4 and all(w[:1].isupper() or w.lower() in _STOP for w in words):
            return head
    return text


def _variants(text: str) -> Iterator[str]:
    """A text as it reads, and as it would if it had been decoded rightly."""
    yield text
    if not text.isascii() and "�" not in text and mojibake.suspicious(text):
        for wrong in ("cp1252", "iso8859_1", "cp1251", "cp1250", "mac_roman", "cp437", "cp850", "cp932"):
            if (new := mojibake._mend_utf8(text, wrong)) is not None:
                yield new
                if (more := mojibake._mend_utf8(new, wrong)) is not None:
                    yield more
        for wrong, rights in (("cp1252", "cp1251 mac_roman cp850 cp437 cp1250 cp932 euc_jp"), ("cp1251", "koi8_r cp866"), ("koi8_r", "cp1251"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("iso8859_1", "cp1250 euc_jp"), ("cp932", "euc_jp")):
            if (raw := mojibake._encode(text, wrong)) is not None:
                for right in rights.split():
                    if (new := mojibake._decode(raw, right)) is not None:
                        yield new


#: Telling words from which a sentence inside of a longer text is a message.
CONTAINED = 3
_SENTENCES = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
_MARKS = "\"'“”‘’„«».,;:!?…()"
_MARKED = re.compile(r"[{\[<%$#@*_]|\bt\(")
_KNOWN = _SYSTEM | _STOP | _LATIN


def _says_something(text: str, kept: bool = False) -> bool:
    """A quick look: whether a text has so many words of its own that it can't
    be a message, not even with the name of its site behind. ``kept``: by the
    ASCII words alone, which every reading of a garbled text keeps."""
    words = text.lower().split()
    if len(words) < 5:
        return False
    enough = max(6, len(words) // 4 + 1)
    for w in words:
        if (w.isascii() or not kept) and w not in _KNOWN and w.strip(_MARKS) not in _KNOWN and not w.isdigit():
            enough -= 1
            if not enough:
                return True
    return False


def holds_message(text: str) -> bool:
    """Whether a sentence of a text is a message as a whole. Most sentences end
    at their first word that systems don't use."""
    for sentence in _SENTENCES.split(text):
        words = sentence.lower().split(None, CONTAINED)
        if len(words) >= CONTAINED and all(w in _KNOWN or w.strip(_MARKS) in _KNOWN or w.isdigit() for w in words[:CONTAINED]):
            share, trigger, n = coverage(sentence)
            if trigger and share == 1.0 and n >= CONTAINED:
                return True
    return False


def classify(raw: str, site: str | None = None) -> tuple[str | None, float]:
    """(kind, coverage) of a value: ``placeholder``, ``empty_value``,
    ``filler``, ``message`` (errors, maintenance, notices, defaults), or None;
    the coverage is that by the language of systems, whether or not a trigger is
    there."""
    marked = _MARKED.search(raw)
    if not marked and raw.isascii() and _says_something(raw):
        return ("message", 1.0) if holds_message(raw) else (None, 0.0)
    text = folding.fold_all(raw)
    text = html.unescape(text) if "&" in text else text
    if not text.strip():
        return None, 0.0
    if (marked or text != raw) and placeholder_in(text):
        return "placeholder", 1.0
    if _says_something(text) and (_says_something(text, True) or not mojibake.suspicious(text)):
        return ("message", 1.0) if holds_message(text) else (None, 0.0)
    best = 0.0
    for variant in _variants(text):
        bare = strip_site(variant.strip(), site).strip()
        whole = bare.strip(" .!…-–—:|")
        segments = [s for s in _SEPARATOR.split(bare) if s.strip()]
        if _EMPTY.fullmatch(whole) or any(_EMPTY.fullmatch(s.strip()) for s in segments) and len(segments) > 1 and all(_EMPTY.fullmatch(s.strip()) or len(s.split()) <= 3 for s in segments):
            return "empty_value", 1.0
        if _latin_share(bare) >= 0.9:
            return "filler", 1.0
        share, trigger, n = coverage(bare)
        if trigger and n and share == 1.0:
            return "message", 1.0
        best = max(best, share)
    return ("message", 1.0) if holds_message(text) else (None, best)


def find_residue(df: DataFrame, keys: list[str], fields: list[str], url_col: str = "original_url", site_col: str = "site_id", site_name_col: str = "site_name") -> DataFrame:
    """One row for each value of ``fields`` that may be residue: keys,
    ``field_name``, ``raw``, ``kind``, ``coverage`` (share of the telling words
    that systems use), ``in_slug`` (share of them that the page's address
    has), ``in_other`` (share of them that the row's other fields have, if those
    aren't residue), ``n_hosts`` and ``n_rows`` (of the values alike) and ``residue``.

    Unfilled placeholders, rendered empty values and filler are told by their
    form. A message is told by saying nothing else, or by a sentence of it that
    does: all its telling words are those of systems, in any of the languages,
    and the address doesn't bear them out. Where only most of them are, or none is telling of a message, it
    has to recur on several hosts beside unlike addresses and unlike other
    fields. A value with few words of systems is none however widely it recurs,
    as set headings of unlike pages recur in the same way. Edge cases: null values give no row, empty ones
    are no residue; disguised, garbled and cut messages are read through their
    disguise; repeated rows come out each, and count; other columns are
    ignored; texts are read whole.
    """
    cells = df.select(*keys, F.col(site_col).alias("_site"), F.col(site_name_col).alias("_name"), F.col(url_col).alias("_url"), *[F.col(f).alias(f"_field_{k}") for k, f in enumerate(fields)])
    types = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in [*keys, "_site"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}

        def of(raw: str, name: str | None) -> tuple[str | None, float]:
            if len(known) > 50_000:
                known.clear()
            if (raw, name) not in known:
                known[raw, name] = classify(raw, name)
            return known[raw, name]

        for batch in batches:
            at, names, raws, kinds, shares, slugs, others, signs = [], [], [], [], [], [], [], []
            for i, (name, url, *values) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_name", "_url", *[f"_field_{k}" for k in range(len(fields))])), strict=True)):
                for field, raw in zip(fields, values, strict=True):
                    if raw is None:
                        continue
                    kind, share = of(raw, name)
                    if kind or share >= PARTLY:
                        bare = strip_site(raw, name)
                        words = [w for w in _TOKEN.findall(bare.lower()) if w not in _STOP]
                        slug = set(re.split(r"[^a-z0-9]+", (url or "").lower().rsplit("/", 1)[-1]))
                        # A field that is residue itself bears nothing out.
                        rest = [v for f, v in zip(fields, values, strict=True) if f != field and v is not None]
                        said = {w for v in rest if not of(v, name)[0] for w in _TOKEN.findall(v.lower())}
                        at.append(i)
                        names.append(field)
                        raws.append(raw)
                        kinds.append(kind)
                        shares.append(share)
                        slugs.append(sum(w in slug for w in words) / len(words) if words else 0.0)
                        others.append(sum(w in said for w in words) / len(words) if words else 0.0)
                        signs.append(re.sub(r"\d+", "0", unicodedata.normalize("NFKC", bare).casefold()).strip())
            kept = batch.take(pa.array(at, pa.int32())).select([*keys, "_site"])
            made = [pa.array(names, pa.string()), pa.array(raws, pa.string()), pa.array(kinds, pa.string()), *(pa.array(x, pa.float64()) for x in (shares, slugs, others)), pa.array(signs, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], [*kept.schema.names, "field_name", "raw", "kind", "coverage", "in_slug", "in_other", "_sign"])

    # Read once, as both the count of hosts and the values ask for it; what
    # stays is the small part that may be residue.
    seen = cut(cells.mapInArrow(read, f"{types}, field_name string, raw string, kind string, coverage double, in_slug double, in_other double, _sign string"))
    # Hosts are counted in two steps, so that a message met everywhere is
    # brought down to one row for each host before it is gathered.
    hosts = seen.groupBy("_sign", "_site").agg(F.count("*").alias("n")).groupBy("_sign").agg(F.count("_site").alias("n_hosts"), F.sum("n").alias("n_rows"))
    joined = seen.join(hosts, "_sign")
    told = F.col("kind").isin("placeholder", "empty_value", "filler")
    said = (F.col("kind") == "message") & (F.col("in_slug") < 0.99)
    borne_out = F.col("kind").isNull() & (F.col("n_hosts") >= HOSTS) & (F.col("in_slug") < 0.5) & (F.col("in_other") < 0.5)
    return joined.select(*keys, "field_name", "raw", "kind", "coverage", "in_slug", "in_other", "n_hosts", "n_rows", F.coalesce(told | said | borne_out, F.lit(False)).alias("residue"))
