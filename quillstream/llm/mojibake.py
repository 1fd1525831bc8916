"""Text that was decoded with the wrong charset, and its repair by minimum
description length.

A value is described by its bytes under a zstandard dictionary of its
language, in which a character beyond ASCII takes one and those that its rarity
in the language asks for, plus a charge for every character that the language
doesn't write. Dictionaries and rarity are from counts over all values.
A repair undoes one or more wrong decodings; it is chosen if it makes the
description, chain included, shorter than that of the value as it stands.
"""

from __future__ import annotations

import codecs
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import melt, scratch
from . import folding

#: Size of a language's dictionary; longer tokens, a few of which would fill it, are no words of it.
DICTIONARY_BYTES, WORD_BYTES = 32_768, 512
#: Parts that a count is added up in, so that any number of languages share it evenly.
PARTS = math.lcm(*range(1, 10))
#: Counts that a task of ``survey`` holds before it hands them on to be added up.
HELD_COUNTS = 200_000
#: Bytes charged for a step of a chain, and for a character foreign to the language.
STEP_COST, FOREIGN_COST = 2, 6
MAX_STEPS = 3
BEAM = 3

# The letters beyond a-z of each language (lower case), its
# commonest words, and its words of one letter beyond a-z.
LETTERS = {
    "en": "éèêëçïîöüñâàôûœæ", "de": "äöüßé", "fr": "àâæçéèêëîïôœùûüÿ", "es": "áéíñóúü", "pt": "àáâãçéêíóôõú",
    "pl": "ąćęłńóśźż", "it": "àèéìíòóùú", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюяё",
}
COMMON_WORDS = {
    "en": "the of and a to in is for with that its how why about from by near after before turned will has things our your on as it not",
    "de": "der die das und ein eine einen zu mit von über für wie warum ist den dem nach bei im des auf trotz fragen vor ohne",
    "fr": "le la les de des du et un une pour avec sur dans en au aux après malgré sans qui est vend idées reçues depuis près",
    "es": "el la los las de del y un una por con para en sobre tras sin que pese cerca al claves desde después",
    "pt": "o a os as de do da dos das e um uma por com para em no na sem depois que apesar sobre pela desde perto",
    "pl": "i w na z do za nad pod przez po bez mimo dla się jest że jak dlaczego przed ale pierwszy roku koszt to a lat koron się",
    "it": "il lo la gli le di del della e un una per con in su senza dopo che è",
}
ALONE = {"fr": "àâ", "es": "éóáú", "pt": "àéóá", "it": "èéòà", "ru": "авикосуяёэ", "de": "", "en": "", "pl": "ó"}

_TELLS = {w: tuple(k for k, v in COMMON_WORDS.items() if w in v.split()) for w in " ".join(COMMON_WORDS.values()).split()}
_SETS = {k: frozenset(v) | frozenset(c for c in v.upper()) for k, v in LETTERS.items()}
_LATIN = tuple(k for k in LETTERS if k != "ru")
_TYPOGRAPHIC = frozenset("‘’“”„«»–—…•·°§€£№™®©²³½¼¾×¿¡ªº−️‍ 　")
_EMOJI = re.compile("[\U0001f000-\U0001faff☀-➿]")
_JAPANESE = re.compile("[ぁ-ゟァ-ヿ㐀-鿿、-】〜！-～]")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_BEYOND = re.compile(r"[^\x00-\x7f]")
_LOST = re.compile("[\x80-\x9f�-]")
_TIDIED = re.compile(r"Ã (?=\S| )|Ã(?=[a-z])")
_LEFT_OVER = re.compile(r"\s[^\W\d_]$")
_WORDS = re.compile(r"[^\W\d_]+")
_JAPANESE_WORDS = re.compile("[㐀-鿿々]+[ぁ-ゟ]*|[ァ-ヿ]+|[ぁ-ゟ]+")
_AROUND_WORDS = ".,;:!?…()[]{}\"'“”„«»‘’—–-|/。、「」・"
_SIGN_IN_WORD = re.compile(r"(?<=[^\W\d_])[¢£¤¥¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾×÷¿¡†‡‰‹›€ƒ„‚ˆ˜√≥≤∂∑∏∫≈∆◊•](?=[^\W\d_])")

# Bytes 80 to BF as Western charsets show them; what UTF-8 makes of letters,
# signs and quotes then begins with one of three capitals or an a with a hat.
_CONTINUED = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xC0)) + "".join(map(chr, range(0x80, 0xA0)))
_AS_UTF8 = re.compile(f"[ÂÃ][{re.escape(_CONTINUED)}]|[â][{re.escape(_CONTINUED)}]{{2}}")
# Narrow kana beside ideographs, which UTF-8 read as a Japanese charset gives.
_NARROW_KANA = re.compile("[㐀-鿿][｡-ﾟ]|[｡-ﾟ][㐀-鿿]")
# Signs that stand inside of words in some texts; whether they should, the
# description tells.
_DASH_IN_WORD = re.compile(r"(?<=[^\W\d_])[–—](?=[^\W\d_])|(?<=[^\W\d_])[–—](?=[\s,.;:!?]|$)|(?:^|(?<=\s))œ(?=[^\W\d_])")
_APOSTROPHE_IN_WORD = re.compile(r"(?<=[^\W\d_])’(?=[^\W\d_])")
_ELIDING = {"en", "fr", "it"}

# Charsets that a text was decoded with, and those it was in,
# besides UTF-8, as they are mixed up.
WESTERN, CENTRAL = "cp1252 mac_roman cp437 cp850", "cp1250 iso8859_2 cp852"
CYRILLIC, EASTERN = "cp1251 koi8_r cp866 iso8859_5 mac_cyrillic", "cp932 euc_jp"
MIXED_UP = {
    "cp1252": f"mac_roman cp437 cp850 {CENTRAL} {CYRILLIC} {EASTERN}", "iso8859_1": f"mac_roman cp437 cp850 {CENTRAL} {CYRILLIC} {EASTERN}",
    "mac_roman": f"cp1252 cp437 cp850 {CYRILLIC} {EASTERN} cp1250", "cp437": f"cp1252 mac_roman cp850 {CYRILLIC} cp1250", "cp850": f"cp1252 mac_roman cp437 {CYRILLIC} cp1250",
    "iso8859_15": "cp1252 mac_roman cp850", "cp1250": f"{WESTERN} iso8859_2 cp852 {CYRILLIC}", "iso8859_2": f"cp1252 cp1250 cp852 {CYRILLIC}", "cp852": "cp1250 iso8859_2 cp1252",
    "cp1251": f"{WESTERN} cp1250 koi8_r cp866 iso8859_5 mac_cyrillic {EASTERN}", "koi8_r": "cp1251 cp866 iso8859_5 mac_cyrillic cp1252", "cp866": "cp1251 koi8_r iso8859_5 mac_cyrillic cp1252",
    "iso8859_5": "cp1251 koi8_r cp866 mac_cyrillic cp1252", "mac_cyrillic": "cp1251 koi8_r cp866 iso8859_5 cp1252 mac_roman", "cp1254": "cp1250 cp1251", "cp1253": "cp1252 cp1251",
    "cp932": "euc_jp", "euc_jp": "cp932", "gb18030": "cp932 euc_jp", "big5": "cp932 euc_jp",
}
_WIDE = {"cp932", "euc_jp", "gb18030", "big5", "utf_8"}
_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")


def _narrow(codec: str) -> dict[str, int]:
    """Byte of each character; bytes without one stand for themselves, as in
    browsers."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


_BYTE = {c: _narrow(c) for c in {*MIXED_UP, *" ".join(MIXED_UP.values()).split()} - _WIDE}
_DECODE = {c: {b: ch for ch, b in t.items()} for c, t in _BYTE.items()}
_TABLE = {c: "".join(map(chr, range(128))) + "".join(t[b] for b in range(128, 256)) for c, t in _DECODE.items()}
_ENCODE = {c: codecs.charmap_build(t) for c, t in _TABLE.items()}
_RUN = {c: re.compile("[" + re.escape("".join(t)) + "]+") for c, t in _BYTE.items()}
_WIDE_RUN = re.compile(r"[^\x00-\x7f](?:[\x00-\x7f]?[^\x00-\x7f])*[!-~]?")


def _encode(text: str, codec: str) -> bytes | None:
    if codec not in _WIDE:
        try:
            return codecs.charmap_encode(text, "strict", _ENCODE[codec])[0]
        except UnicodeEncodeError:
            return None
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        return None


def _decode(raw: bytes, codec: str) -> str | None:
    if codec not in _WIDE:
        return codecs.charmap_decode(raw, "strict", _TABLE[codec])[0]
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        return None


@lru_cache(16_384)
def languages_of(text: str) -> tuple[str, ...]:
    """The languages a text may be in: by script, then by its commonest words;
    all of the script if no word tells."""
    beyond = len(_BEYOND.findall(text))
    if beyond:
        japanese, cyrillic = len(_JAPANESE.findall(text)), len(_CYRILLIC.findall(text))
        if japanese * 2 > beyond and japanese * 4 > len(text):
            return ("ja",)
        if cyrillic and cyrillic * 2 > sum(map(str.isalpha, text)):
            return ("ru",)
    scores = dict.fromkeys(_LATIN, 0)
    for w in text.lower().split():
        for k in _TELLS.get(w, ()):
            scores[k] += 1
    most = max(scores.values())
    return tuple(k for k in _LATIN if scores[k] >= most - (1 if most < 4 else most // 4)) if most else _LATIN


@lru_cache(65_536)
def _odd_letters(word: str, lang: str) -> int:
    """Letters of a word that the language doesn't write. Words wholly in
    Cyrillic or Japanese are judged as such in a text of any language."""
    if word.isascii():
        return 0
    scripts = {"Cyrillic" if "Ѐ" <= c <= "ӿ" else "Japanese" if _JAPANESE.match(c) else "Latin" if c.isalpha() else "" for c in word} - {""}
    if scripts == {"Cyrillic"}:
        letters, alone = _SETS["ru"], ALONE["ru"]
    elif scripts == {"Japanese"}:
        return 0
    elif lang == "ja":
        return sum(c > "\x7f" and not _JAPANESE.match(c) for c in word)
    else:
        letters, alone = _SETS[lang], ALONE[lang]
    odd = sum(c > "\x7f" and c not in letters and c.isalpha() for c in word)
    odd += len(word) == 1 and word in letters and word.lower() not in alone
    return odd + any(x.islower() and y.isupper() and (x > "\x7f" or y > "\x7f") for x, y in zip(word, word[1:], strict=False))


@lru_cache(32_768)
def foreign(text: str, lang: str, seen: frozenset = frozenset()) -> int:
    """Characters beyond ASCII that the language doesn't write, or that stand
    alone where it has no such word, signs and capitals inside of words.
    ``seen``: the ideographs in use; none given, all are."""
    if text.isascii():
        return 0
    # A letter alone at the very end is what a cut leaves of a word.
    odd = sum(_odd_letters(w, lang) for w in _WORDS.findall(_LEFT_OVER.sub("", text)))
    odd += len(_SIGN_IN_WORD.findall(text))
    for c in _BEYOND.findall(text):
        if not c.isalpha():
            odd += c not in _TYPOGRAPHIC and not _JAPANESE.match(c) and not _EMOJI.match(c)
        elif seen and "㐀" <= c <= "鿿":
            odd += c not in seen
    return odd


@lru_cache(16_384)
def suspicious(text: str) -> bool:
    """Whether a text might be garbled: a quick look that lets no garbled text
    pass, but leaves the decision to the search."""
    if text.isascii():
        return False
    if _LOST.search(text) or _SIGN_IN_WORD.search(text) or _AS_UTF8.search(text) or _NARROW_KANA.search(text) or _DASH_IN_WORD.search(text):
        return True
    langs = languages_of(text)
    if not _ELIDING & set(langs) and _APOSTROPHE_IN_WORD.search(text):
        return True
    return min(foreign(text, lang) for lang in langs) > 0


class Repairer:
    """Searches for repairs by the dictionaries of the languages."""

    def __init__(self, model: dict, level: int = 3):
        self.packers, self.seen = {}, frozenset(model.get("ideographs", ""))
        for lang, (raw, trained) in model["dictionaries"].items():
            data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            self.packers[lang] = zstandard.ZstdCompressor(dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.plain = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)
        # Bytes that tell a character among all of its language; one never seen is half as frequent as one seen once.
        counted = model.get("characters", {})
        total = {lang: max(n[""], 1) for lang, n in counted.items()}
        self.rarity = {lang: {c: math.log2(total[lang] / max(n[c], 0.5)) / 8 for c in n if c} | {"": math.log2(2 * total[lang]) / 8} for lang, n in counted.items()}
        self.unknown = {"": max((r[""] for r in self.rarity.values()), default=0.0)}
        self.known: dict[tuple, tuple[str, str, str]] = {}

    def measure(self, text: str) -> tuple[float, int]:
        """(description in bytes, foreign characters) in the language that
        describes a text best."""
        raw = text.encode("utf-8", "surrogatepass")
        odd = sorted((foreign(text, x, self.seen), x) for x in languages_of(text))
        least = odd[0][0]
        few = [(n, x) for n, x in odd if n <= least + 1]
        # English seldom writes a letter beyond ASCII; each counts as a rare one.
        beyond = _BEYOND.findall(text)
        rare = sum(c.isalpha() and c < "\u0370" for c in beyond)
        return min((len(self.packers.get(x, self.plain).compress(raw)) + self._rarity(beyond, x) + FOREIGN_COST * n + rare * (x == "en"), n) for n, x in few)

    def _rarity(self, chars: list[str], lang: str) -> float:
        """What ``chars`` take by their rarity, beside one byte each; the bytes
        more that UTF-8 has for them tell nothing."""
        if not self.rarity:
            return 0
        known = self.rarity.get(lang, self.unknown)
        return sum(known.get(c, known[""]) for c in chars) + len(chars) - len("".join(chars).encode("utf-8", "surrogatepass"))

    def _steps(self, text: str, hint: str) -> dict[str, tuple[str, int]]:
        """Texts of one repair: text to (wrong>right, cost)."""
        odd, spans = self._odd(text)
        wide = any(c > "⿿" for c in odd)
        out: dict[str, tuple[str, int]] = {}

        def offer(new: str | None, wrong: str, right: str) -> None:
            if new is not None and new != text and not (_LOST.search(new) and not _LOST.search(text)):
                cost = STEP_COST - (wrong == hint)
                if new not in out or out[new][1] > cost:
                    out[new] = (f"{wrong}>{right}", cost)

        able = [w for w in MIXED_UP if (wide if w in _WIDE else odd <= _BYTE[w].keys())]
        for wrong in able:
            offer(_mend_utf8(text, wrong), wrong, "utf_8")
        if any(not suspicious(new) and self.measure(new)[0] + FOREIGN_COST < self.measure(text)[0] for new in out):
            return out  # what reads as UTF-8 throughout is no chance
        for wrong in able:
            rights = MIXED_UP[wrong]
            for a, b in spans:
                if (raw := _encode(text[a:b], wrong)) is None:
                    continue
                for right in rights.split():
                    if (new := _decode(raw, right)) is not None:
                        offer(text[:a] + new + text[b:], wrong, right)
            if wrong not in _WIDE:  # within words of which the rest is right
                for right in rights.split():
                    if right not in _WIDE:
                        table = {ord(c): _DECODE[right][_BYTE[wrong][c]] for c in odd}
                        offer(text.translate(table), wrong, right)
        return out

    def _odd(self, text: str) -> tuple[frozenset[str], set[tuple[int, int]]]:
        """The odd characters of a text, and the stretches that they may be
        part of: all of it, from the first odd word to the last, and from the
        first odd character on to the ends of the words that follow."""
        lang = min((foreign(text, x, self.seen), x) for x in languages_of(text))[1]
        letters = _SETS.get(lang, frozenset())
        odd, places = set(), []
        words = [m.span() for m in re.finditer(r"\S+", text)]
        for i, c in enumerate(text):
            if c > "\x7f":
                alpha = c.isalpha()
                if alpha:
                    before = text[i - 1 : i]
                    alone = not before.isalpha() and not text[i + 1 : i + 2].isalpha() and c.lower() not in ALONE.get(lang, "") and not _JAPANESE.match(c)
                    bad = c not in letters and c not in _SETS["ru"] and not (_JAPANESE.match(c) and (not self.seen or c < "㐀" or c > "鿿" or c in self.seen)) or before.islower() and c.isupper() or alone
                    bad = bad or c in _SETS["ru"] and lang != "ru" and before.isalpha() and before not in _SETS["ru"]
                else:
                    bad = c not in _TYPOGRAPHIC and not _JAPANESE.match(c) and not _EMOJI.match(c) or bool(_SIGN_IN_WORD.match(text, i))
                if bad:
                    odd.add(c)
                    places.append(i)
        spans = {(0, len(text))}
        if places:
            inside = [(a, b) for a, b in words if any(a <= p < b for p in places)]
            if inside:
                spans.add((inside[0][0], inside[-1][1]))
            after = [b for _, b in words if b > places[0]]
            spans.update((places[0], b) for b in (*after[:3], len(text), places[-1] + 1))
        else:
            odd = set(_BEYOND.findall(text))
        return frozenset(odd), spans

    def repair(self, text: str, hint: str = "") -> tuple[str, str, str]:
        """(status, text, chain): ``clean`` as it is, ``restored`` with the
        chain of wrong>right steps, or ``garbled``, unchanged, where no chain
        gives it back."""
        if not suspicious(text):
            return "clean", text, ""
        key = (text, hint)
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[key] = self._search(text, hint)
        return self.known[key]

    def _search(self, text: str, hint: str) -> tuple[str, str, str]:
        lost = _LOST.search(text) is not None
        if "\ufffd" in text:
            return "garbled", text, ""  # bytes are gone
        folded = folding.fold_all(text)
        if not lost and folded != text and not suspicious(folded):
            return "clean", text, ""  # disguised characters, not wrong ones
        bits, odd = self.measure(text)
        best, beam = (bits, 0, text, "", odd), [(bits, 0, text, "", odd)]
        # Blanks and hyphens without width are often tidied away after the fact.
        if (tidied := _TIDIED.sub(lambda m: "Ã\xa0" if m.group() == "Ã " else "Ã\xad", text)) != text:
            beam.append((bits, 1, tidied, "", odd))
        for _ in range(MAX_STEPS):
            fresh: dict[str, tuple] = {}
            for _, cost, current, chain, odd in beam:
                for new, (step, price) in self._steps(current, hint).items():
                    # A step that leaves as many odd characters explains nothing.
                    if new == text or min(foreign(new, x, self.seen) for x in languages_of(new)) >= max(odd, 1) and not _LOST.search(current):
                        continue
                    bits, n = self.measure(new)
                    entry = (bits + cost + price, cost + price, new, f"{chain} {step}".strip(), n)
                    if new not in fresh or fresh[new] > entry:
                        fresh[new] = entry
            beam = sorted(fresh.values())[:BEAM]
            if not beam:
                break
            best = min(best, beam[0])
            if not suspicious(best[2]):
                break
        if best[3] and not _LOST.search(best[2]):
            return "restored", best[2], best[3]
        return ("garbled" if lost else "clean"), text, ""


def _mend_utf8(text: str, wrong: str) -> str | None:
    """``text`` with every stretch that is UTF-8 read as ``wrong`` put right."""
    changed = False

    def mend(m: re.Match) -> str:
        nonlocal changed
        if (raw := _encode(m.group(), wrong)) is None or not _UTF8.search(raw):
            return m.group()
        parts, at = [], 0
        for u in _UTF8.finditer(raw):
            gap = _decode(raw[at : u.start()], wrong)
            try:
                good = u.group().decode("utf-8")
            except UnicodeDecodeError:
                continue
            if gap is None:
                return m.group()
            parts += [gap, good]
            at = u.end()
        tail = _decode(raw[at:], wrong)
        if tail is None or not parts:
            return m.group()
        changed = True
        return "".join(parts) + tail

    new = (_WIDE_RUN if wrong in _WIDE else _RUN[wrong]).sub(mend, text)
    return new if changed else None


def fitting(text: str) -> tuple[str, ...]:
    """Of the languages a text may be in, those that write its letters best."""
    langs = languages_of(text)
    if len(langs) == 1 or text.isascii():
        return langs
    odd = [foreign(text, lang) for lang in langs]
    return tuple(lang for lang, n in zip(langs, odd, strict=True) if n == min(odd))


def counted_as(text: str, untold: bool) -> tuple[str, tuple[str, ...]]:
    """The text that ``survey`` counts for a value, and what it counts it for."""
    if not untold:
        langs = () if suspicious(text) or folding.fold_all(text) != text else languages_of(text)
        return text, langs if len(langs) < 3 else ()
    plain = folding.fold_all(text)
    doubtful = suspicious(plain) or plain != text and _LOST.search(text)
    return plain, (",".join(fitting(plain)),) if plain and not doubtful else ()


def survey(cells: DataFrame, keys: list[str], untold: bool = False) -> DataFrame:
    """All values (keys, ``field_name``, ``raw``) read once: a row for each that
    might be garbled, and of the others how often a language (``_lang``) has each
    word and each character beyond ASCII (``_kind`` word or character, ``_text``,
    ``_n`` to be added up; the character "" stands for all characters). With
    ``untold`` also of those that three languages or more fit, counted for all
    that fit together (``_lang`` with commas), and of disguised ones as what they
    look like."""
    given = cells.select(*keys, "field_name", "raw")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields)
    counted = [("_lang", pa.string()), ("_kind", pa.string()), ("_text", pa.string()), ("_n", pa.int64())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}

        def add_up(schema: pa.Schema) -> pa.RecordBatch:
            rows = [(lang, kind, text, n) for (lang, kind), c in counts.items() for text, n in c.items()]
            counts.clear()
            held = [pa.array(values, t) for values, (_, t) in zip(zip(*rows, strict=True), counted, strict=True)]
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), f.type) for f in schema), *held], [*schema.names, *(name for name, _ in counted)])

        schema = None
        for batch in batches:
            schema, at = batch.schema, []
            for i, text in enumerate(batch.column("raw").to_pylist()):
                if suspicious(text):
                    at.append(i)
                plain, langs = counted_as(text, untold)
                for lang in langs:
                    counts.setdefault((lang, "word"), Counter()).update(words_of(plain, lang))
                    characters = counts.setdefault((lang, "character"), Counter())
                    characters.update(_BEYOND.findall(plain))
                    characters[""] += len(plain)
            if at:
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at, pa.int32())).columns, *(pa.nulls(len(at), t) for _, t in counted)], [*schema.names, *(name for name, _ in counted)])
            if sum(map(len, counts.values())) > HELD_COUNTS:
                yield add_up(schema)
        if counts:
            yield add_up(schema)

    return given.mapInArrow(read, f"{types}, _lang string, _kind string, _text string, _n long")


def words_of(text: str, lang: str) -> list[str]:
    """Words as a dictionary has them; of Japanese, runs of ideographs with the
    kana that follow, and runs of kana."""
    if lang == "ja":
        return _JAPANESE_WORDS.findall(text)
    return [w for w in (token.strip(_AROUND_WORDS) for token in text.split()) if w]


def model_of(surveyed: DataFrame) -> dict:
    """Dictionaries, characters and ideographs by the counts of ``survey``,
    added up over all rows; languages counted for together share evenly. A
    dictionary is of the words that save most, as many as it holds; characters
    are bounded by Unicode."""
    added = surveyed.filter("_kind is not null").groupBy("_lang", "_kind", "_text").agg(F.sum("_n").alias("_n")).withColumn("_langs", F.split("_lang", ","))
    shared = added.select(F.explode("_langs").alias("lang"), F.col("_kind").alias("kind"), F.col("_text").alias("text"), F.expr(f"_n * ({PARTS} div size(_langs))").alias("n"))
    counts = shared.groupBy("lang", "kind", "text").agg(F.sum("n").alias("n"))
    # What a word takes in the dictionary, and what having it there saves; matches begin at four bytes.
    sized = counts.filter("kind = 'word'").withColumn("size", F.octet_length("text") + F.when(F.col("lang") == "ja", 0).otherwise(1)).filter(f"size between 4 and {WORD_BYTES}")
    best = Window.partitionBy("lang").orderBy(((F.col("n") - PARTS) * F.col("size")).desc(), "text")
    ranked = sized.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= DICTIONARY_BYTES // 4)
    filled = F.sum("size").over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    held = ranked.withColumn("filled", filled).filter(F.col("filled") <= DICTIONARY_BYTES)
    words: dict[str, list[tuple[int, str]]] = {}
    characters: dict[str, dict[str, int]] = {}
    for r in held.select("lang", "text", "n", "rank").unionByName(counts.filter("kind = 'character'").select("lang", "text", "n", F.lit(0).alias("rank"))).collect():
        if r["rank"]:
            words.setdefault(r["lang"], []).append((r["rank"], r["text"]))
        else:
            characters.setdefault(r["lang"], {})[r["text"]] = r["n"] / PARTS
    # The words that save most come last, where they are cheapest to point at.
    out = {lang: "".join(w if lang == "ja" else f" {w}" for _, w in sorted(ws, reverse=True)).encode() for lang, ws in words.items()}
    ideographs = "".join(sorted(c for c in characters.get("ja", ()) if "㐀" <= c <= "鿿"))
    return {"dictionaries": {lang: (raw, False) for lang, raw in out.items() if len(raw) >= 8}, "characters": characters, "ideographs": ideographs}


def train(df: DataFrame, columns: list[str]) -> dict:
    """The model of ``columns``, from all their values but those that might be
    garbled, whether or not they tell their language."""
    return model_of(scratch(survey(melt(df, [], columns), [], untold=True), ["_lang", "_kind", "_text", "_n"]))


_REPAIRERS: dict[int, Repairer] = {}


def repairer_of(broadcast) -> Repairer:
    """The repairer of a worker, made once for each model."""
    model = broadcast.value
    if id(model) not in _REPAIRERS:
        _REPAIRERS.clear()
        _REPAIRERS[id(model)] = Repairer(model)
    return _REPAIRERS[id(model)]


# Labels of charsets, as headers and pages spell them.
LABELS = {
    "cp1252": "windows-1252 cp1252 cp-1252 win1252 ansi x-cp1252", "iso8859_1": "iso-8859-1 iso8859-1 latin1 latin-1 l1 us-ascii ascii", "cp1251": "windows-1251 cp1251 win-1251 win1251 x-cp1251",
    "cp1250": "windows-1250 cp1250 x-cp1250", "iso8859_2": "iso-8859-2 iso8859-2 latin2", "koi8_r": "koi8-r koi8r", "cp932": "shift_jis shift-jis sjis x-sjis ms_kanji windows-31j cp932",
    "euc_jp": "euc-jp eucjp x-euc-jp", "mac_roman": "macintosh mac macroman x-mac-roman", "cp437": "ibm437 cp437", "cp850": "ibm850 cp850", "cp866": "ibm866 cp866 dos-866",
}
_LABEL = {label: codec for codec, labels in LABELS.items() for label in labels.split()}


def find_garbled(df: DataFrame, keys: list[str], fields: list[str], diagnostics: DataFrame | None = None, model: dict | None = None) -> DataFrame:
    """One row for each value of ``fields`` of which a stretch is garbled:
    keys, ``field_name``, ``raw``, ``restored`` (null where it can't be had),
    ``chain`` (the wrong>right steps undone).

    ``diagnostics`` (``meta_id``, ``detected_charset``) makes a step that goes
    along with the charset the fetch saw one byte cheaper. Edge cases: null,
    empty and ASCII values are never garbled; a value with a replacement or
    control character always is; repeated rows come out each; rows without
    diagnostics, or with several, do as well; other columns are ignored. Texts
    are searched whole whatever their length. Without a ``model`` all values are
    read once for it, and what might be garbled is kept to be searched.
    """
    spark = df.sparkSession
    cells = melt(df, keys, fields)
    if model:
        cells = cells.filter(F.col("raw").rlike(r"[^\x00-\x7f]"))
    else:
        surveyed = scratch(survey(cells, keys))
        cells, model = surveyed.filter("_kind is null").select(cells.columns), model_of(surveyed)
    shipped = spark.sparkContext.broadcast(model)  # a few dictionaries of bounded size
    if diagnostics is not None:
        seen = diagnostics.filter("detected_charset is not null").groupBy("meta_id").agg(F.min(F.lower(F.trim("detected_charset"))).alias("_label"))
        cells = cells.join(seen, "meta_id", "left")
    else:
        cells = cells.withColumn("_label", F.lit(None).cast("string"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = repairer_of(shipped)
        for batch in batches:
            at, restored, chains = [], [], []
            for i, (text, label) in enumerate(zip(batch.column("raw").to_pylist(), batch.column("_label").to_pylist(), strict=True)):
                status, new, chain = repairer.repair(text, _LABEL.get((label or "").replace(" ", ""), ""))
                if status != "clean":
                    at.append(i)
                    restored.append(new if status == "restored" else None)
                    chains.append(chain)
            kept = batch.take(pa.array(at, pa.int32())).select([*keys, "field_name", "raw"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(restored, pa.string()), pa.array(chains, pa.string())], [*kept.schema.names, "restored", "chain"])

    given = cells.select(*keys, "field_name", "raw", "_label")
    types = ", ".join(f"{k} {given.schema[k].dataType.simpleString()}" for k in [*keys, "field_name", "raw"])
    return given.mapInArrow(search, f"{types}, restored string, chain string")
