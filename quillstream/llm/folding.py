"""Characters that look alike: what they stand for, and where they are wrong."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of one script that look like letters of another.
CYRILLIC = "аa еe оo рp сc уy хx ѕs іi јj ԁd ԛq ԝw һh ӏl ѵv ɡg АA ВB ЕE КK МM НH ОO РP СC ТT ХX УY ІI ЈJ ЅS ҮY ԌG ԚQ ԜW ЗЗ"
GREEK = "οo νv αa ρp υu κk ιi γy χx ϲc ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC"
OTHER = "օo ѡw ոn սu հh ցg ıi ǀl Ꭺa ᎪA ᏴB ᏟC ᎬE ᎻH ᎫJ ᏦK ᏞL ᎷM ᎾO ᏢP ᎢT ᏙV ᎳW ᏃZ"
# Cyrillic and Greek letters that resemble a Latin one with a mark.
MARKED = "ёë ЁË їï ЇÏ"

TO_LATIN = {p[0]: p[1] for p in f"{CYRILLIC} {GREEK} {OTHER} {MARKED}".split() if p[0] != p[1] and ord(p[0]) > 127}
#: Of the Cyrillic letters, those of Russian stand for their look-alikes.
TO_CYRILLIC = {p[1]: p[0] for p in f"{CYRILLIC} {MARKED}".split() if p[0] in "аеорсухёАВЕКМНОРСТХУЁЗ" and p[0] != p[1]}
#: Greek letters in Cyrillic words go through the Latin letter they resemble.
_VIA = {g: TO_CYRILLIC[latin] for g, latin in TO_LATIN.items() if latin in TO_CYRILLIC and "Ͱ" <= g <= "Ͽ"}
TO_CYRILLIC_ALL = {**TO_CYRILLIC, **_VIA}
TO_GREEK = {p[1]: p[0] for p in GREEK.split()} | {c: {p[1]: p[0] for p in GREEK.split()}[latin] for c, latin in ((q[0], q[1]) for q in CYRILLIC.split()) if latin in {p[1] for p in GREEK.split()}}
MAPS = {"Latin": TO_LATIN, "Cyrillic": TO_CYRILLIC_ALL, "Greek": TO_GREEK}

#: Characters without a width of their own, and marks of direction.
WIDTHLESS = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿\U000e0001-\U000e007f"
_WIDTHLESS = re.compile(f"[{WIDTHLESS}]")
#: Blanks other than the ordinary one.
BLANKS = "\t\n\x0b\x0c\r   -     　"
_BLANKS = re.compile(f"[{BLANKS}]")
_EMOJI = "©®‼⁉™ℹ←-⇿⌀-⏿①-⓿■-➿⤀-⥿⬀-⯿〰〽㊗㊙\U0001f000-\U0001faff#*0-9"
#: A joiner or selector that makes one sign of emoji, and tags of flags.
_JOINS = re.compile(f"(?<=[{_EMOJI}️\U0001f3fb-\U0001f3ff])(?:️|‍(?=[{_EMOJI}])|[\U000e0020-\U000e007f]+)")
#: Joiners that the spelling of Arabic and Indic scripts needs.
_SPELLED = re.compile("(?<=[؀-ࣿऀ-෿က-႟])[‌‍](?=[؀-ࣿऀ-෿က-႟])")
_BEYOND = re.compile("[^\x00-\x7f]")
#: Letters of the scripts that are told apart; a text of one of them mixes none.
_OF_SCRIPTS = tuple(re.compile(f"[{p}]") for p in ("A-Za-zª-ʯᴀ-ᶿḀ-ỿⱠ-Ɀ꜠-ꟿꬰ-꭯ﬀ-ﬆ", "Ѐ-ԯᲀ-\u1c8fⷠ-ⷿꙀ-ꚟ", "Ͱ-Ͽἀ-\u1fff"))
_STYLES = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<square>")


@lru_cache(65_536)
def plain_form(c: str) -> str:
    """The ordinary form of a letter, digit or mark of other width or style or
    of joined ones; the character itself if it is none or has a look of its
    own, as superscripts, fractions and signs have."""
    if c < "\x80":
        return c
    d = unicodedata.decomposition(c)
    if not d:
        return c
    tag = d.split(" ", 1)[0]
    if tag in _STYLES:
        return unicodedata.normalize("NFKC", c)
    if tag == "<noBreak>" and c == "‑":
        return "-"
    if tag == "<compat>":
        new = unicodedata.normalize("NFKC", c)
        joined = len(new) > 1 and new.isalpha()  # ligatures and digraphs
        roman = "Ⅰ" <= c <= "ⅿ"
        return new if (joined and unicodedata.category(c)[0] == "L") or roman else c
    return c


def strip_widthless(text: str) -> str:
    """``text`` without widthless characters but those that spelling or emoji
    need."""
    if not _WIDTHLESS.search(text):
        return text
    keep = {m.start() + i for p in (_JOINS, _SPELLED) for m in p.finditer(text) for i in range(len(m.group()))}
    return "".join(c for i, c in enumerate(text) if i in keep or not _WIDTHLESS.match(c))


def fold_forms(text: str) -> str:
    """Composed, in plain forms, without widthless characters, with ordinary
    blanks: all that needs no look at the words."""
    if text.isascii() and not _BLANKS.search(text):
        return text
    text = strip_widthless(text)
    text = _BLANKS.sub(" ", text)
    text = _BEYOND.sub(lambda m: plain_form(m.group()), text)
    return unicodedata.normalize("NFC", text)


@lru_cache(65_536)
def script_of(c: str) -> str:
    """Script of a letter by its name; empty for anything else."""
    if c < "\x80":
        return "Latin" if c.isalpha() else ""
    if not c.isalpha() and not unicodedata.category(c).startswith("M"):
        return ""
    word = unicodedata.name(c, "").split(" ", 1)[0]
    return {"LATIN": "Latin", "CYRILLIC": "Cyrillic", "GREEK": "Greek", "CJK": "Han", "HIRAGANA": "Kana", "KATAKANA": "Kana", "COMBINING": ""}.get(word, word.title())


_CHUNK = re.compile(r"[^\s\-–—/|:;,.!?()\[\]{}«»“”„\"<>]+")


def chunks(text: str) -> list[tuple[int, int, str, str]]:
    """Tokens in which letters are of a script that doesn't belong: (start,
    end, token, token in the script it should have). The dominant script is
    that of most letters which look like no other's; a token of look-alikes
    alone goes by the rest of the text."""
    if text.isascii() or sum(p.search(text) is not None for p in _OF_SCRIPTS) < 2:
        return []
    found, scripts = [], {}
    for m in _CHUNK.finditer(text):
        counts: dict[str, int] = {}
        for c in m.group():
            if s := script_of(c):
                counts[s] = counts.get(s, 0) + 1
        if counts:
            found.append((m.start(), m.end(), m.group(), counts))
            for s, n in counts.items():
                scripts[s] = scripts.get(s, 0) + n
    if len([s for s in scripts if s in MAPS]) < 2:
        return []
    out = []
    overall = max((s for s in scripts if s in MAPS), key=lambda s: scripts[s])
    for start, end, token, counts in found:
        mine = {s: n for s, n in counts.items() if s in MAPS}
        if not mine or set(counts) - set(MAPS):
            continue
        if len(mine) == 1:
            (script,) = mine
            if script == overall or script == "Latin" and overall != "Cyrillic":
                continue
            target = overall
            # Only where no token of that script shows letters of its own.
            if any(t[3].get(script) and len(t[3]) == 1 and any(script_of(c) == script and c not in MAPS[target] for c in t[2]) for t in found):
                if len(token) > 1:
                    continue
        else:
            own = {s: sum(script_of(c) == s and not any(c in MAPS[o] for o in MAPS if o != s) for c in token) for s in mine}
            target = max(mine, key=lambda s: (own[s], s == overall, mine[s]))
        table = MAPS[target]
        if all(script_of(c) in ("", target) or c in table for c in token):
            new = "".join(table.get(c, c) if script_of(c) not in ("", target) else c for c in token)
            if new != token:
                out.append((start, end, token, new))
    return out


def fold_all(text: str) -> str:
    """``fold_forms``, and look-alikes replaced wherever a token mixes scripts,
    without regard to any vocabulary: for detectors, not for repair."""
    text = fold_forms(text)
    for start, end, _, new in reversed(chunks(text)):
        text = text[:start] + new + text[end:]
    return text
