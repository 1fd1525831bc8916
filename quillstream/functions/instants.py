"""Instants out of written times.

A value is turned into a shape mask of its own length, one class character
for each character: digits become ``9`` and every letter of a word the class of
the word (month, weekday, zone, ...). A mask is matched against the grammar
once; the match says where in every value of that mask the fields lie, so all
values of a mask are read together, as a matrix of characters.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd

from .zones import ZoneTables

OK, AMBIGUOUS, GAP, INCOMPLETE, IMPOSSIBLE, NO_ZONE, UNREAD = (
    "ok", "ambiguous", "nonexistent", "incomplete", "impossible", "no_zone", "unread",
)
#: The one form that needs no change.
CANONICAL = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z", re.ASCII)

# Names of months, in the order of the year, and of weekdays.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "en abbreviated": "jan feb mar apr may jun jul aug sep oct nov dec",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "de abbreviated": "jän febr mär apr mai jun jul aug sept okt nov dez",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "fr abbreviated": "janv févr mars avr mai juin juil aoû sept oct nov déc",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "es abbreviated": "ene feb mar abr may jun jul ago set oct nov dic",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "pt abbreviated": "jan fev mar abr mai jun jul ago set out nov dez",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
    "pl": "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia",
    "pl nominative": "styczeń luty marzec kwiecień maj czerwiec lipiec sierpień wrzesień październik listopad grudzień",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "ru nominative": "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь",
    "ru abbreviated": "янв фев мар апр мая июн июл авг сен окт ноя дек",
}
WEEKDAYS = (
    "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun "
    "montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag mo di mi do fr sa so "
    "lundi mardi mercredi jeudi vendredi samedi dimanche lun mer jeu ven sam dim "
    "lunes martes miércoles jueves viernes sábado domingo mié jue vie sáb "
    "segunda terça quarta quinta sexta feira "
    "poniedziałek wtorek środa czwartek piątek sobota niedziela "
    "понедельник вторник среда четверг пятница суббота воскресенье пн вт ср чт пт сб вс"
)
# Minutes east of UTC of zone abbreviations, by their usual meaning.
ZONES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120,
    "mesz": 120, "eet": 120, "eest": 180, "msk": 180, "sast": 120, "pkt": 300, "ist": 330, "npt": 345, "wib": 420,
    "hkt": 480, "sgt": 480, "awst": 480, "jst": 540, "kst": 540, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660,
    "nzst": 720, "nzdt": 780, "brt": -180, "art": -180, "nst": -210, "ndt": -150, "ast": -240, "adt": -180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600,
}
FILLERS = "de del à a at um às as le den der o la uhr godz г год года г h clock kl ore"

_MONTH = {name: n for names in MONTHS.values() for n, name in enumerate(names.split(), 1)}
_MONTH["sept"] = 9
_CLASS = {w: "f" for w in FILLERS.split()} | {w: "W" for w in WEEKDAYS.split()} | {w: "Z" for w in ZONES} | {w: "M" for w in _MONTH} | {"t": "T", "h": "h"}
_CJK = "年月日時分秒"
_HALF = re.compile(r"(?i)(?<![^\W\d_])([ap])(\.?)( ?)(m)\b(\.?)")
_DAYHALF = "\ue000"  # stands for a.m. and p.m. until the words are classed
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"[0-9]")

_YMD = r"(?P<y>9999)(?P<u>[-/.])(?P<mo>99?)(?P=u)(?P<d>99?)"
_DMY = r"(?P<n1>99?)(?P<u>[-/.])(?P<n2>99?)(?P=u)(?P<y>9999)"
_DAY_MONTH = r"(?:W+\.?,? )?(?P<d>99?)(?:\.|M{0})?(?: f+)? (?P<mon>M+)\.?,?(?: f+)? (?P<y>9999)(?: ?f\.)?"
_MONTH_DAY = r"(?:W+\.?,? )?(?P<mon>M+)\.? (?P<d>99?)(?:x{2})?,? (?P<y>9999)"
_CJK_DATE = r"(?P<y>9999)年(?P<mo>99?)月(?P<d>99?)日"
_CLOCK = r"(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?"
_CLOCKS = rf"(?:{_CLOCK}(?: ?(?P<ap>P+))?)"
_SHORT = r"(?P<h>99?)h(?P<mi>99)"
_CJK_CLOCK = r"(?P<h>99?)時(?P<mi>99)分(?:(?P<s>99)秒)?"
_OFFSET = r"(?:Z{2,3} ?)?(?P<sign>[-+−])(?P<oh>99?)(?::?(?P<om>99))?"
_ZONE = rf"(?: ?{_OFFSET}(?:\[(?P<iana>[^\]]+)\])?(?: \([^)]*\))?| ?(?P<z>Z+)| ?\((?P<z2>Z+)\)| \[?(?P<iana2>[A-Za-zxfMWZhTP]+/[^\]\s]+)\]?)?"
_TAIL = r"(?: f+\.?)?"
_GRAMMAR = [
    re.compile(rf"(?:{g})")
    for g in (
        rf"{_YMD}(?:T|,? f* ?|[ ]+){_CLOCKS}{_ZONE}",
        rf"{_DMY}(?:T|,? (?:f+\.? )?|[ ]+)(?:{_CLOCKS}|{_SHORT.replace('<h>', '<h2>').replace('<mi>', '<mi2>')}){_ZONE}{_TAIL}",
        rf"(?P<y>9999)(?P<mo>99)(?P<d>99)[T ]?(?P<h>99)(?P<mi>99)(?:(?P<s>99)(?:[.,](?P<f>9+))?)?{_ZONE}",
        rf"{_DAY_MONTH}(?:,? (?:f+\.? )?){_CLOCKS}{_TAIL}{_ZONE}",
        rf"{_DAY_MONTH}(?:,? (?:f+\.? )?){_SHORT}{_ZONE}",
        rf"{_MONTH_DAY}(?:,? (?:f+\.? )?){_CLOCKS}{_TAIL}{_ZONE}",
        rf"(?:W+,? )?(?P<mon>M+) +(?P<d>99?) {_CLOCK} (?P<y>9999){_ZONE}",
        rf"{_CLOCKS}{_TAIL}{_ZONE},? (?:{_DAY_MONTH}|{_MONTH_DAY.replace('<mon>', '<mon2>').replace('<d>', '<d3>').replace('<y>', '<y2>')})",
        rf"{_CJK_DATE} ?{_CJK_CLOCK}{_ZONE}",
        rf"{_CJK_DATE} ?{_CLOCKS}{_ZONE}",
        r"(?P<epoch>9{10})(?:\.(?P<f>9+))?",
        r"(?P<epoch_ms>9{13})(?:\.9+)?",
        r"(?P<epoch_us>9{16})",
        r"(?P<epoch_ns>9{19})",
    )
]
_DATE_ONLY = re.compile(rf"{_YMD}|{_DMY}|{_DAY_MONTH}|{_MONTH_DAY}|{_CJK_DATE}|9{{8}}".replace("(?P<u>[-/.])", "[-/.]").replace("(?P=u)", "[-/.]").replace("?P<n1>", "?:").replace("?P<n2>", "?:").replace("?P<y>", "?:").replace("?P<mo>", "?:").replace("?P<d>", "?:").replace("?P<mon>", "?:"))
_EPOCH_UNIT = {"epoch": 1_000_000_000, "epoch_ms": 1_000_000, "epoch_us": 1_000, "epoch_ns": 1}


def shape_mask(value: str) -> str:
    """The mask of a value that holds no more than one time. Words outside the
    vocabularies are ``x``; signs, blanks and CJK date letters stay."""
    text = _HALF.sub(lambda m: _DAYHALF * len(m.group()), value)
    text = _WORD.sub(lambda m: m.group() if m.group()[0] in _CJK else _word_class(m.group()) * len(m.group()), text)
    return _DIGIT.sub("9", text).replace(_DAYHALF, "P")


@lru_cache(4096)
def _word_class(word: str) -> str:
    return _CLASS.get(word.lower(), "x")


#: Characters up to which a mask's parser is remembered; it is found anew beyond.
KEPT_MASK = 200


@lru_cache(65_536)
def parser_of(mask: str) -> tuple[str, dict[str, tuple[int, int]]]:
    """What to do with a mask: (status, field spans). Masks repeat, so each is
    matched once in a worker; a flood of new masks only costs time."""
    for rule in _GRAMMAR:
        if m := rule.fullmatch(mask):
            spans = {}
            for name in m.re.groupindex:
                if m.start(name) >= 0:
                    spans[{"h2": "h", "mi2": "mi", "mon2": "mon", "d3": "d", "y2": "y", "z2": "z", "iana2": "iana"}.get(name, name)] = m.span(name)
            return OK, spans
    return (INCOMPLETE if _DATE_ONLY.fullmatch(mask) else UNREAD), {}


def tidy(value: str) -> str:
    """Compatibility forms and blanks as ordinary ones; edges trimmed."""
    return value.strip() if value.isascii() else unicodedata.normalize("NFKC", value).strip()


def _number(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    total = np.zeros(len(chars), "int64")
    for i in range(*span):
        total = total * 10 + (chars[:, i].astype("int64") - 48)
    return total


def _words(texts: np.ndarray, span: tuple[int, int], table: dict[str, int], missing: int) -> np.ndarray:
    parts = [t[span[0] : span[1]].lower() for t in texts]
    distinct = {p: table.get(p, missing) for p in set(parts)}
    return np.array([distinct[p] for p in parts], "int64")


def _read(texts: np.ndarray, spans: dict, dmy: np.ndarray, zones: np.ndarray, tables: ZoneTables) -> tuple[np.ndarray, np.ndarray]:
    """UTC milliseconds and status of values that share a mask."""
    n, width = len(texts), len(texts[0])
    chars = texts.astype(f"<U{width}").view("<u4").reshape(n, width)
    get = lambda name, default=0: _number(chars, spans[name]) if name in spans else np.full(n, default, "int64")
    status = np.full(n, OK, object)
    millis = np.zeros(n, "int64")
    if "f" in spans:
        a, b = spans["f"]
        millis = _number(chars, (a, min(b, a + 3))) * 10 ** max(0, 3 - (b - a))
    for name, unit in _EPOCH_UNIT.items():
        if name in spans:
            return (get(name) // (1_000_000 // unit) if unit < 1_000_000 else get(name) * (unit // 1_000_000)) + millis, status
    year, hour, minute, second = get("y"), get("h"), get("mi"), get("s")
    if "n1" in spans:
        first, last = get("n1"), get("n2")
        day, month = np.where(dmy == 1, first, last), np.where(dmy == 1, last, first)
        # Without the site's order only a date that has one reading is read.
        unsure = (dmy < 0) & (first != last)
        day, month = np.where(unsure & (first > 12), first, day), np.where(unsure & (first > 12), last, month)
        status[unsure & (first <= 12) & (last <= 12)] = AMBIGUOUS
    else:
        day = get("d")
        month = _words(texts, spans["mon"], _MONTH, 0) if "mon" in spans else get("mo")
    if "ap" in spans:
        at = spans["ap"][0]
        late = (chars[:, at] | 32) == ord("p")
        wrong = (hour < 1) | (hour > 12)
        hour = np.where(wrong, 99, hour % 12 + 12 * late)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    lengths = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    fine = (year >= 1) & (month >= 1) & (month <= 12)
    length = lengths[np.where(fine, month, 0)] + (leap & (month == 2))
    fine &= (day >= 1) & (day <= length) & (hour <= 23) & (minute <= 59) & (second <= 59)
    offset = None
    if "sign" in spans:
        offset = get("oh") * 60 + get("om")
        fine &= (offset <= 14 * 60) & (get("om") < 60)
        offset = np.where(chars[:, spans["sign"][0]] == ord("+"), offset, -offset)
    elif "z" in spans:
        offset = _words(texts, spans["z"], ZONES, 0)
    status[~fine] = IMPOSSIBLE
    months = (year - 1970) * 12 + month - 1
    days = np.where(fine, months, 0).astype("datetime64[M]").astype("datetime64[D]").astype("int64") + np.where(fine, day, 1) - 1
    wall = days * 86400 + hour * 3600 + minute * 60 + second
    if offset is not None:
        return (wall - offset * 60) * 1000 + millis, status
    names = np.array([t[slice(*spans["iana"])] for t in texts], object) if "iana" in spans else zones
    utc = np.zeros(n, "int64")
    for zone in set(names):
        mine = (names == zone) if zone is not None else np.array([x is None for x in names])
        if zone not in tables.zones:
            status[mine & (status == OK)] = NO_ZONE
            continue
        utc[mine], hits = tables.utc_of_wall(zone, wall[mine])
        sub = status[mine]
        sub[(sub == OK) & (hits == 0)] = GAP
        sub[(sub == OK) & (hits > 1)] = AMBIGUOUS
        status[mine] = sub
    return utc * 1000 + millis, status


def read_instants(raw: pd.Series, zones: pd.Series, orders: pd.Series, tables: ZoneTables) -> pd.DataFrame:
    """``utc_ms`` (null unless determined), ``status`` and ``shape`` of each
    value. ``zones`` and ``orders`` (``dmy``, ``mdy`` or null) hold where a
    value says nothing of its own. A null value gives nulls."""
    n = len(raw)
    utc, status, shapes = np.zeros(n, "int64"), np.full(n, None, object), np.full(n, None, object)
    dmy = orders.map({"dmy": 1, "mdy": 0}).fillna(-1).to_numpy("int64")
    zone_of = zones.astype(object).where(zones.notna(), None).to_numpy()
    texts = np.full(n, None, object)
    groups: dict[str, list[int]] = {}
    for i, v in enumerate(raw):
        if isinstance(v, str):
            texts[i] = tidy(v)
            shapes[i] = shape_mask(texts[i])
            groups.setdefault(shapes[i], []).append(i)
    for mask, rows in groups.items():
        kind, spans = parser_of(mask) if len(mask) <= KEPT_MASK else parser_of.__wrapped__(mask)
        if kind != OK:
            status[rows] = kind
            continue
        at = np.array(rows)
        utc[at], status[at] = _read(texts[at], spans, dmy[at], zone_of[at], tables)
    good = status == OK
    return pd.DataFrame({"utc_ms": pd.Series(np.where(good, utc, 0)).where(good).astype("Int64"), "status": status, "shape": shapes})
