"""Personal information inside free text, found by voting labelers.

Candidate spans come from patterns. For each, labelers vote yes (1), no (-1) or
nothing (0): patterns, gazetteers counted over the corpus, and contexts learned
from it. How far each labeler is to be trusted is estimated by
expectation-maximisation from their agreement alone; the posteriors train the
classifier that decides.

No phrase is given as one that names stand beside. Given names and surnames are
words that recombine with one another (a place or a body keeps its partner), and
the words that stand beside such pairs, with many different ones, become the
context labelers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import salted_join, scratch

TYPES = ("email", "phone", "id_number", "address", "name")
#: Rounds of expectation-maximisation, and of the classifier's training.
ROUNDS, STEPS = 60, 400
#: Different partners from which a word is in a gazetteer, and share of a word's
#: partners that have to be in the other one.
PARTNERS, PARTNER_SHARE = 2, 0.34
#: Different names from which a word beside them is a context labeler, and the
#: shares of names among what it stands beside from which it votes yes, and up to
#: which no.
CONTEXT_NAMES, CONTEXT_YES, CONTEXT_NO = 3, 0.5, 0.05
#: Characters within which another kind of mention stands beside a name.
NEAR = 80

_C = "A-ZÀ-ÖØ-ÞŒŠŽ"
_W = "\\w’'"

# Words that patterns and context labelers go by.
TITLES = "Mr Mrs Ms Miss Dr Prof Sir Dame Lord Lady Hon Rt Herr Frau Herrn M Mme Mlle Monsieur Madame Abgeordneter Abgeordnete Senator"
STARTERS = (
    "The A An In If Does Do Is What Some Nothing Between Since Despite Without With Under Before After At On For When There It I We They He She My Our This That Let As Works Write Mail Anyone Among Vote See Bill No constituent "
    "Der Die Das Den Dem Ein Eine Wer Warum Kann Es In Zwischen Nach Ich Wir Mein Meine Im Am An Aus Zu Unter Niemand Rückfragen Seit Mit Von Und Hört Zuruf Zwischenruf Unsinn Lesen Bürgerin Bürger Pflegerin Pfleger Fraktion Millionen Stadt Dieses Berichtigte Wie "
    "Le La Les Un Une Des Il Elle Nous Mon Ma Notre Pourquoi Entre Depuis Selon Sans Pour Avant Contre Aux Chacun Personne Parmi Rappelez Je On À Et Voir Très"
)
THINGS = re.compile(
    r"^(?:['’]s)?[ \n]*(?:Bridge|Tower|Prize|Medal|Hall|House|Hospital|School|Library|Fund|Trust|Institute|Foundation|Society|Committee|Commission|Act|Bill|Report|Lane|Road|Street|St\.|Quay|Close|Terrace|Row|Ave|Avenue|Court|Wharf|Hill|Square|Station|Dam|Park|Museum|College"
    r"|Brücke|Turm|Preis|Halle|Haus|Stiftung|Straße|Platz|Schule|Bibliothek|fund\b|prize\b)"
)
STREETS_EN = "Street|St\\.|Lane|Road|Rd|Quay|Close|Terrace|Row|Avenue|Ave|Court|Hill|Wharf|Place|Square|Walk|Drive|Way|Gardens|Crescent|Mews"
STREETS_DE = "straße|strasse|str\\.|weg|gasse|allee|platz|ring|ufer|hof|brücke|damm|steig"
STREETS_FR = "rue|boulevard|bd\\.?|avenue|av\\.|impasse|quai|chemin|allée|place|cours|route|passage|square|sentier|ruelle"

EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]*[\w+-])?(?:@|\s@\s|\s?\[at\]\s?|\s?\(at\)\s?)[A-Za-z0-9][\w-]*(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[A-Za-z0-9][\w-]*)+")
PHONE = re.compile(r"(?<![\w/.+-])(?:\+\d{1,3}|\(\d{2,5}\)|00\d{2}|0\d{1,4}|\d{3}(?=[.]\d{3}[.]\d{4}(?!\d)))(?:[\s.-]?\(?\d{1,8}\)?){1,7}(?![\w/-])(?!\.\d)")
IDS = re.compile(
    r"(?<![\w/.-])(?:[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]|\d{8}-[A-Z]|[A-Z]{2}\d{8}|[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{3}|\d{6}-\d{4}|\d{3}-\d{2}-\d{4}|\d\s\d{2}\s\d{2}\s\d{2}\s\d{3}\s\d{3}\s\d{2})(?![\w/-])"
)
ID_LEFT = re.compile(r"(?:passport|card|number|no\.?|file|as|Akte|nummer|numéro|identité|passeport|sociale)(?:\s(?:no|number|Nr\.)\.?)?[\s:]+$", re.I)
ID_NOT = re.compile(r"(?:Vote|Bill|box|clause|paper|vessel registered as|lines|Drucksache|Aktenzeichen|crédit|texte no|Titel)\s+$")
PHONE_LEFT = re.compile(r"(?:ring|telephone|call|left|and|at|unter|appeler le|au|Rückruf unter|bounced,|phone|tel\.?|fax)[\s:]+$", re.I)

_PLACE = rf"(?!(?:{'|'.join(STARTERS.split())})\b)[{_C}][\w’'-]+(?:-[{_C}]\w+)*"
_POST = r"(?:[A-Z]{2}\d\s\d[A-Z]{2}|\d{5})(?!\d)"
_TAIL = rf"(?:,\s(?:Apt|Flat|Unit)\s\w+)?(?:,?\s(?:in|à)\s{_PLACE}(?:,?\s{_POST})?|,\s\d{{5}}\s{_PLACE}|,?\s{_POST}(?:\s{_PLACE})?|,\s{_PLACE}(?:,?\s{_POST})?)?"
ADDRESS = re.compile(
    rf"(?<![\w/.-])(?:(?:Flat|Unit|Apt)\s\w+,\s)?\d{{1,4}}[a-z]?\s(?:[{_C}][{_W}-]+\s){{1,3}}(?:{STREETS_EN})(?!\w){_TAIL}"
    rf"|(?<![\w/.-])\d{{1,4}}[a-z]?(?:\s(?:bis|ter|quater))?,?\s(?:{STREETS_FR})\s(?:(?:de|des|du|d[’']|aux|au|la|le|les|l[’']|de\sla|de\sl[’'])\s?)*[{_C}][{_W}-]+{_TAIL}"
    rf"|(?<![\w-])(?:(?:Am|An\sder|An\sden|Im|In\sder|Zum|Zur|Auf\sder)\s)?[{_C}][\w-]*(?:{STREETS_DE})\s\d{{1,4}}[a-z]?(?!\w|\.\d){_TAIL}"
)
ADDRESS_LEFT = re.compile(r"(?:address is|live at|of|door of|reached|last seen at|wohnt in|Anschrift|kommt in die|habite|affiché au|adresse)\s+$")
_RUN = re.compile(rf"[{_C}][{_W}-]*\.?(?:[ \n]+(?:d[’'](?=[{_C}]))?[{_C}][{_W}-]*\.?)+")
_SWAPPED = re.compile(rf"(?<![{_W}-])(?!(?:Bürgerin|Bürger|Pflegerin|Pfleger)\b)((?:d[’'])?[{_C}][{_W}-]+),[ \n]+([{_C}][a-zà-ÿ]+(?:-[{_C}][a-zà-ÿ]+|[ \n][{_C}][a-zà-ÿ]+)?(?:[ \n][{_C}]\.)?)(?![ \n](?:d[’'])?[{_C}]|[{_W}-])")
_TITLE, _START = frozenset(TITLES.split()), frozenset(STARTERS.split())
_PARTICLES = frozenset("Le La Les Des Von".split())
_TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(_TITLE)})\.?[ \n]+$")
_INITIAL = re.compile(rf"[{_C}]\.")
_SPACE = re.compile(r"\s+")
_MIDDLE = re.compile(rf"[ \n][{_C}]\.")
_LAST = re.compile(r"(\S+)\s+$")
_NEXT = re.compile(r"([,.;:!?)(—–\]\[]*)\s*([^\s,.;:!?)(]*)")
_FIGURE = re.compile(r"[0-9]+")


def _without_one(word: str) -> list[str]:
    """A word without one of its letters, each in turn: what two words that
    differ by one letter, or by two that are swapped, have in common."""
    return [word[:i] + word[i + 1 :] for i in range(len(word))] + [word]


def member_keys(name: str) -> list[tuple[str, str]]:
    """(key, part) of a member's name: as it is, by initial, by surname, and
    with a letter of one part left out; the part is what may be misspelt."""
    full = _SPACE.sub(" ", name).strip().casefold()
    given, _, last = full.rpartition(" ")
    keys = [(f"={full}", ""), (f"@{last}", ""), (f"~{given[:1]} {last}", "")]
    if len(last) >= 4:
        keys += [(f"<{given}|{v}", last) for v in _without_one(last)]
    if len(given) >= 4:
        keys += [(f">{v}|{last}", given) for v in _without_one(given)]
    return list(dict.fromkeys(keys))


def mention_keys(given: str, alt: str, surname: str, full: str, titled: bool) -> list[tuple[str, str]]:
    """Keys under which a member would be met, were the mention one."""
    words = full.split(" ")
    pairs = {(given.casefold(), surname.casefold()), (words[0], words[-1]), (words[-2], words[-1])} | ({(alt.casefold(), surname.casefold())} if alt else set())
    keys = [(f"={full}", "")]
    if titled:  # a title and a member's surname; what follows is what they said
        keys.append((f"@{words[0].rstrip(',')}", ""))
    for g, s in sorted(pairs):
        bare = g.rstrip(".")
        keys.append((f"={g} {s}", ""))
        if bare in _NOBODY:
            keys.append((f"@{s}", ""))
        if len(bare) == 1:
            keys.append((f"~{bare} {s}", ""))
        if len(s) >= 3:
            keys += [(f"<{g}|{v}", s) for v in _without_one(s)]
        if len(g) >= 3:
            keys += [(f">{v}|{s}", g) for v in _without_one(g)]
    return list(dict.fromkeys(keys))


def _near(a: str, b: str) -> bool:
    """Whether two longer words differ by one letter, or two that are swapped."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1]


_NOBODY = {t.casefold() for t in _TITLE}


def candidates(text: str) -> list[tuple]:
    """(type, start, end, votes, name) of every span that may be personal.
    ``name`` is None but for names: (given, given if the first word only opens
    a sentence, where that one begins, surname, whole name, whether a title
    stands before, word before, word behind). Spans of one type don't
    overlap."""
    out = []
    taken: list[tuple[int, int]] = []
    free = lambda a, b: all(b <= x or a >= y for x, y in taken)

    if "@" in text or "at]" in text or "at)" in text:
        for m in EMAIL.finditer(text):
            plain = "@" in m.group() and not re.search(r"\s", m.group())
            local = re.split(r"@|\[at\]|\(at\)", m.group())[0].strip()
            out.append(("email", m.start(), m.end(), [1, 1 if plain else 0, 1 if re.search(r"[._+-]|\d|[a-z]{5}", local, re.I) else -1, 1 if re.search(r"(?:\.|\[dot\]\s?)[A-Za-z]{2,}$", m.group()) else -1]))
            taken.append(m.span())
    for m in IDS.finditer(text):
        if free(*m.span()):
            left = text[max(0, m.start() - 32) : m.start()]
            digits = sum(c.isdigit() for c in m.group())
            out.append(("id_number", m.start(), m.end(), [1, 1 if ID_LEFT.search(left) else 0, -1 if ID_NOT.search(left) else 0, 1 if digits >= 6 else -1]))
            if not ID_NOT.search(left):
                taken.append(m.span())
    for m in ADDRESS.finditer(text):
        if free(*m.span()):
            left = text[max(0, m.start() - 20) : m.start()]
            placed = re.search(rf"(?:,|in|à)\s(?:\d{{5}}\s)?[{_C}][\w’'-]+(?:\s|,|$)|{_POST}", m.group())
            out.append(("address", m.start(), m.end(), [1, 1 if ADDRESS_LEFT.search(left) else 0, 1 if placed else 0, -1 if re.search(r"(?:article|Artikel|clause|Titel|Works on|page)\s$", left) else 0]))
            taken.append(m.span())
    for m in PHONE.finditer(text):
        digits, end = sum(c.isdigit() for c in m.group()), m.end() - (m.group()[-1] == ")")
        if free(*m.span()) and digits >= 7:
            left = text[max(0, m.start() - 24) : m.start()]
            enough = digits >= 10 or m.group()[0] == "+" and digits >= 8
            out.append(("phone", m.start(), end, [1 if enough else -1, 1 if PHONE_LEFT.search(left) else 0, -1 if ID_NOT.search(left) or digits > 15 else 0, 1 if m.group()[0] in "+(" or re.search(r"[ .-]\d", m.group()) else -1]))
            taken.append(m.span())

    beside = [(a, b) for a, b in taken]

    def name(start: int, end: int, given: str, surname: str, alt: tuple[str, int] | None) -> None:
        left, right = text[max(0, start - 40) : start], text[end : end + 48]
        if _labels(text, start, end):
            return  # of a speech
        titled = _TITLED.search(left) is not None
        full = _SPACE.sub(" ", text[start:end]).casefold()
        near = any(0 <= a - end <= NEAR or 0 <= start - b <= NEAR for a, b in beside)
        thing = THINGS.match(right) is not None or THINGS.match(surname) is not None
        votes = [1 if near else 0, -1 if thing else 0, 1 if titled or _MIDDLE.search(text[start:end]) else 0]
        first, at = alt or ("", start)
        out.append(("name", start, end, votes, (given, first, at, surname.upper(), full, titled, _before(left), _behind(right))))

    swapped = {m.start(): m for m in _SWAPPED.finditer(text)}
    for parts in _segments(text):
        opens = len(parts) > 2 and (not (before := text[: parts[0][1]].rstrip()[-1:]) or before in ".!?:;)]—–\"”“»")
        if not 2 <= len(parts) <= 4 + opens or _INITIAL.fullmatch(parts[-1][0]):
            continue
        surname = re.sub(r"[’']s$", "", parts[-1][0].rstrip("."))
        start, end = parts[0][1], parts[-1][1] + len(surname)
        if all(p.isupper() and len(p) > 2 for p, _ in parts) or not free(start, end) or len(surname) < 2:
            continue
        taken.append((start, end))
        name(start, end, parts[0][0].split("-")[0], surname, (parts[1][0].split("-")[0], parts[1][1]) if opens else None)
    for at, m in swapped.items():
        if free(*m.span()) and not m.group(1).isupper() or free(*m.span()) and not m.group(2).isupper():
            before = text[max(0, at - 30) : at]
            if re.search(rf"[{_C}]\.?[\w’'-]*[ \n]$", before) and not re.search(rf"(?:{'|'.join(_TITLE | _START)})\.?[ \n]$", before):
                continue
            given = re.split(r"[ \n-]", m.group(2))[0]
            if m.group(1) in _START or given in _START:
                continue
            taken.append(m.span())
            name(*m.span(), given, m.group(1), None)
    return out


def _before(left: str) -> str:
    """The word before a span, in lower case; a stop, an opening bracket or a
    capital stand for themselves."""
    word = _LAST.search(left)
    if not word:
        return "."
    w = word.group(1).lstrip("\"'“„«‘[—–-")
    if w.rstrip(".") in _TITLE:
        return "<title>"
    if not w or w[-1] in ".!?:;":
        return "."
    return "<Aa>," if w[0].isupper() and w[-1] == "," else _FIGURE.sub("0", w.lower())


def _behind(right: str) -> str:
    """The sign and the word behind a span, likewise."""
    m = _NEXT.match(right)
    sign, w = m.group(1), m.group(2)
    if sign[:1] in (".", "!", "?"):
        return "."
    return sign + ("<Aa>" if w[:1].isupper() else "0" if w[:1].isdigit() or w[:1] == "+" else "<mail>" if "@" in w else w)


def _segments(text: str) -> Iterator[list[tuple[str, int]]]:
    """Runs of capitalised words with their places; a full stop ends a run but
    after an initial, and a title or a word that opens sentences does."""
    for m in _RUN.finditer(text):
        run: list[tuple[str, int]] = []
        for p in re.finditer(r"\S+", m.group()):
            if p.group().rstrip(".") in _TITLE or p.group() in _START and not (run and p.group() in _PARTICLES):
                if run:
                    yield run
                run = []
                continue
            run.append((p.group(), m.start() + p.start()))
            if p.group().endswith(".") and not _INITIAL.fullmatch(p.group()):
                yield run
                run = []
        if run:
            yield run


def _labels(text: str, start: int, end: int) -> bool:
    """Whether a name is the label of a speech: behind a sentence, before a
    colon."""
    if not re.match(r"[ \n]*(?:\([A-Z]{2}\))?[ \n]*:", text[end : end + 10]):
        return False
    before = re.sub(rf"(?:{'|'.join(_TITLE)})\.?[ \n]+$", "", text[max(0, start - 24) : start]).rstrip(" \n")
    return not before or before[-1] in ".!?:])—”\""


def _em(patterns: np.ndarray, counts: np.ndarray, prior: float) -> np.ndarray:
    """Posterior of each vote pattern: labelers vote on their own given the
    truth; how often each votes what for either truth is estimated with it.
    Starts from the majority, which names the classes."""
    post = np.clip(0.5 + 0.25 * patterns.sum(1), 0.05, 0.95)
    for _ in range(ROUNDS):
        like = np.zeros((len(patterns), 2))
        for c, weight in ((0, counts * (1 - post)), (1, counts * post)):
            like[:, c] = math.log(max(1e-9, weight.sum() + (1 - prior if c == 0 else prior)))
            for j in range(patterns.shape[1]):
                for v in (-1, 0, 1):
                    at = patterns[:, j] == v
                    # Smoothing leans to what a labeler means by its vote.
                    lean = {(-1, 0): 2.0, (1, 1): 2.0}.get((v, c), 0.5)
                    like[at, c] += math.log((weight[at].sum() + lean) / (weight.sum() + 3.0))
        new = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -500, 500)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post


def _train(patterns: np.ndarray, counts: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression from votes (yes and no apart) and
    pairs of them to the posterior, each pattern by its count."""
    x = _features(patterns)
    w, weight = np.zeros(x.shape[1]), counts / counts.sum()
    for step in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - post)) + 1e-4 * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        delta = np.linalg.solve(hessian, gradient)
        w -= delta
        if np.abs(delta).max() < 1e-6:
            break
    return w


def _features(patterns: np.ndarray) -> np.ndarray:
    yes, no = patterns > 0, patterns < 0
    return np.concatenate([np.ones((len(patterns), 1)), yes, no], 1).astype(float)


def find_personal(documents: DataFrame, members: DataFrame, doc_id: str = "doc_id", text_col: str = "text", name_col: str = "full_name") -> DataFrame:
    """One row for each mention: ``doc_id``, ``pii_type``, ``found_text``,
    ``start`` (0-based), ``end`` and ``score``.

    All documents are read once for candidate spans and what stands beside
    them. What is counted of names is counted over the different ones: gazetteers
    of given names and surnames from how words recombine, contexts from the words
    beside them (``_voted``). Vote patterns, of which there are few, are counted;
    reliabilities are estimated and the classifier is trained on these counts on
    the driver; every candidate is then scored. ``members`` are known people
    whose names are no mentions; they are taken out by a join, however many they
    are. Edge cases: null and empty texts have no mentions; texts are read
    whole; repeated documents come out each; members without a name count for
    nothing; other columns are ignored.
    """
    spark = documents.sparkSession
    given = documents.select(F.col(doc_id).alias("_doc"), F.col(text_col).alias("_text")).filter(F.length("_text") > 0)
    types = f"_doc {given.schema['_doc'].dataType.simpleString()}, pii_type string, found_text string, start int, end int, votes array<int>, given string, alt string, alt_start int, surname string, full string, titled boolean, lctx string, rctx string"
    arrow = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()]
    names = [t.split(" ")[0] for t in types.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                for kind, a, b, votes, *name in candidates(text):
                    at.append(i)
                    rows.append((kind, text[a:b], a, b, votes, *(name[0] if name else (None,) * 8)))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([batch.column("_doc").take(pa.array(at, pa.int32())), *cols], names)

    spans = scratch(given.mapInArrow(read, types))
    key = ["given", "alt", "surname", "full", "titled", "lctx", "rctx", "votes"]
    is_name = F.col("pii_type") == "name"
    # All that is counted of names is counted over what differs, so that a name
    # met in a third of all documents is one row.
    met = scratch(spans.filter(is_name).groupBy(*key).agg(F.count("*").alias("n")))
    met = scratch(_voted(met.join(_known(met, members, name_col), ["given", "alt", "surname", "full", "titled"], "left_anti")))

    own = spans.filter(~is_name).groupBy("pii_type", "votes").agg(F.count("*").alias("n"))
    counts = own.unionByName(met.groupBy(F.lit("name").alias("pii_type"), F.col("all").alias("votes")).agg(F.sum("n").alias("n"))).collect()  # at most 3^7 patterns of a type
    scores = []
    for kind in TYPES:
        mine = [(r["votes"], r["n"]) for r in counts if r["pii_type"] == kind]
        if mine:
            patterns, n = np.array([p for p, _ in mine]), np.array([c for _, c in mine], float)
            post = _em(patterns, n, 0.5)
            weights = _train(patterns, n, post)
            p = 1 / (1 + np.exp(-np.clip(_features(patterns) @ weights, -30, 30)))
            scores += [(kind, [int(x) for x in pattern], float(q)) for pattern, q in zip(patterns, p, strict=True)]
    table = F.broadcast(spark.createDataFrame(scores, "pii_type string, votes array<int>, score double"))  # as few rows as patterns
    told = met.join(table.filter("pii_type = 'name' and score >= 0.5").select(F.col("votes").alias("all"), "score"), "all").select(*key, "use_alt", "score")
    named = salted_join(spans.filter(is_name), told, key)
    named = named.withColumn("_from", F.when(F.col("use_alt"), F.col("alt_start")).otherwise(F.col("start")))
    named = named.withColumn("found_text", F.substring("found_text", F.col("_from") - F.col("start") + 1, F.length("found_text"))).withColumn("start", F.col("_from"))
    others = spans.filter(~is_name).join(table.filter("score >= 0.5"), ["pii_type", "votes"])
    cols = [F.col("_doc").alias(doc_id), "pii_type", "found_text", "start", "end", F.round("score", 6).alias("score")]
    return others.select(*cols).unionByName(named.select(*cols))


def _known(met: DataFrame, members: DataFrame, name_col: str) -> DataFrame:
    """The mentions of ``met`` that mean a member: by the name in any of its
    forms, or with a slip of the pen in one of the two names. Both sides are
    joined by keys, however many members there are."""
    kind = "array<struct<key: string, part: string>>"

    @F.pandas_udf(kind)
    def theirs(names: pd.Series) -> pd.Series:
        return pd.Series([[{"key": k, "part": p} for k, p in member_keys(n)] for n in names], dtype=object)

    @F.pandas_udf(kind)
    def mine(given: pd.Series, alt: pd.Series, surname: pd.Series, full: pd.Series, titled: pd.Series) -> pd.Series:
        return pd.Series([[{"key": k, "part": p} for k, p in mention_keys(*r)] for r in zip(given, alt, surname, full, titled, strict=True)], dtype=object)

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x == y or _near(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    cols = ["given", "alt", "surname", "full", "titled"]
    keyed = met.select(*cols).distinct().select(*cols, F.explode(mine(*cols)).alias("k")).select(*cols, "k.key", F.col("k.part").alias("mine"))
    listed = members.select(F.col(name_col).alias("_m")).filter(F.length(F.trim("_m")) > 0).distinct().select(F.explode(theirs("_m")).alias("k")).select("k.key", F.col("k.part").alias("theirs")).distinct()
    return keyed.join(listed, "key").filter(near("mine", "theirs")).select(*cols).distinct()


def _voted(met: DataFrame) -> DataFrame:
    """``met`` with ``all`` (its votes and those of gazetteers and contexts)
    and ``use_alt`` (whether its first word only opens the sentence).

    A word is a given name if at least ``PARTNERS`` of its partners, and a
    share of them, have other partners themselves or stand where only names
    do (beside another mention, a title, a middle initial); a surname likewise,
    by the given names. A word beside spans is a context if at least
    ``CONTEXT_NAMES`` different names stand there, and a share of all that does.
    """
    thing, sure = F.col("votes")[1] < 0, (F.col("votes")[0] > 0) | (F.col("votes")[2] > 0)
    initial = F.col("given").rlike(r"^\p{L}\.?$")
    word = lambda c: F.when((F.length(c) > 2) & (F.upper(c) != F.col(c)), F.col(c))
    both = met.filter(~thing).select(F.when(F.col("alt") == "", word("given")).otherwise(word("alt")).alias("g"), F.col("surname").alias("s"), sure.alias("sure")).filter("g is not null and g <> ''")
    edges = both.groupBy("g", "s").agg(F.max("sure").alias("sure"))
    of_given, of_surname = edges.groupBy("g").agg(F.count("*").alias("n_g")), edges.groupBy("s").agg(F.count("*").alias("n_s"))
    linked = edges.join(of_given, "g").join(of_surname, "s").withColumn("linked", F.col("sure") | ((F.col("n_g") >= PARTNERS) & (F.col("n_s") >= PARTNERS)))
    enough = lambda c: (F.count_if(c) >= PARTNERS) & (F.count_if(c) >= PARTNER_SHARE * F.count("*"))
    givens = linked.groupBy("g").agg(enough(F.col("linked")).alias("_g")).filter("_g")
    surnames = linked.join(givens, "g", "left").groupBy("s").agg(enough(F.coalesce("_g", F.lit(False))).alias("_s"), F.max(F.coalesce("_g", F.lit(False)) & F.col("sure")).alias("_one"), (F.count_if(F.coalesce("_g", F.lit(False))) >= PARTNER_SHARE * F.count("*")).alias("_most")).filter("_s or _one and _most").select("s", F.lit(True).alias("_s"))
    known = met.join(givens.select(F.col("g").alias("given"), F.col("_g").alias("_g0")), "given", "left").join(givens.select(F.col("g").alias("alt"), F.col("_g").alias("_g1")), "alt", "left").join(surnames.withColumnRenamed("s", "surname"), "surname", "left")
    known = known.withColumn("_named", F.coalesce((F.col("_g0") | F.col("_g1") | initial) & F.col("_s"), F.lit(False)) & ~thing)
    known = scratch(known.withColumn("use_alt", F.col("_g0").isNull() & F.coalesce("_g1", F.lit(False))))

    def context(side: str) -> DataFrame:
        one = known.groupBy(side, "full").agg(F.max("_named").alias("_named")).groupBy(side).agg(F.count("*").alias("n"), F.count_if("_named").alias("m"))
        vote = F.when((F.col("m") >= CONTEXT_NAMES) & (F.col("m") >= CONTEXT_YES * F.col("n")), 1).when((F.col("n") >= CONTEXT_NAMES) & (F.col("m") <= CONTEXT_NO * F.col("n")), -1).otherwise(0)
        return one.select(side, vote.alias(f"_{side}"))

    told = known.join(context("lctx"), "lctx").join(context("rctx"), "rctx")
    gazetteers = F.array(F.when(F.coalesce("_g0", "_g1", F.lit(False)), 1).when(initial, 0).otherwise(-1), F.when(F.col("_s"), 1).otherwise(-1), "_lctx", "_rctx")
    return told.select("given", "alt", "surname", "full", "titled", "lctx", "rctx", "votes", "n", "use_alt", F.concat("votes", gazetteers).alias("all"))


def redact(documents: DataFrame, mentions: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` with each mention replaced by its type in square
    brackets, and ``n_mentions``. A document without mentions stays as it is;
    ids are taken to be unique."""
    found = mentions.groupBy(doc_id).agg(F.sort_array(F.collect_set(F.struct("start", "end", "pii_type")), asc=False).alias("_m"))
    joined = documents.select(doc_id, F.col(text_col).alias("text")).join(found, doc_id, "left")
    piece = lambda t, m: F.concat(F.substring(t, F.lit(1), m["start"]), F.lit("["), F.upper(m["pii_type"]), F.lit("]"), F.substring(t, m["end"] + 1, F.length(t)))
    replaced = F.when(F.col("_m").isNull(), F.col("text")).otherwise(F.aggregate(F.coalesce("_m", F.array()), F.col("text"), piece))
    return joined.select(doc_id, replaced.alias("text"), F.coalesce(F.size("_m"), F.lit(0)).alias("n_mentions"))
