"""Held-out test items inside of a corpus.

Texts are canonicalised to templates, windows of the templates are joined by
hash, and pairs with enough of them on a diagonal are read word by word, slots
included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Words of a template window with typed numbers, months and units, and of one
#: with typed names too, which says less by the word.
NUMBERED, NAMED = 12, 14
#: Words of the windows by which the words of a pair are laid beside one another.
STEP = 6
#: Share of an item's words that a passage has to hold.
SHARE = 1 / 3
#: Least share of a passage's words that are the item's own, and of its slots
#: that have to stand for one value throughout.
LIKENESS, CONSISTENT = 0.75, 0.8
#: Windows of either kind on one diagonal, as a share of an item's words, from
#: which a pair is read word by word. A passage of a third of an item of 130
#: words has as many as long as 17 of them stand unchanged on end, numbers aside.
SEEDS, NAMED_SEEDS = 0.05, 0.08
#: Words that may be changed or put in at one place.
GAP = 7
#: Diagonals that hits of one passage may be apart, by what is put in.
BAND = 16
#: Windows of items up to which they are shipped to every task (some 30 MB);
#: more are joined by shuffle.
SHIPPED_WINDOWS = 1_000_000
#: Rows of windows that are handed on at once.
CHUNK = 262_144

_REMARK = r"\[[^\[\]]*\]|\([^()]*\)"
_REMARKS, _SIGNS = re.compile(_REMARK), r"[\[\]()]"
_EDGE = "\"'“”„‚‘’«»‹›.,;:!?…()[]{}–—-·•*/"
_NUMBER = re.compile(r"[0-9][0-9.,/:’'-]*")
# Units, and words after which a capital means a place.
UNITS = frozenset(
    "million millions hectares hectare crowns months month days households families letters votes buses times percent euros pounds couronnes mois foyers familles lettres autobus fois jours kronen million "
    "monaten monate haushalte familien briefe busse mal tagen tage euro prozent millionen".split()
)
MONTHS = frozenset("january february march april may june july august september october november december janvier février mars avril mai juin juillet août septembre octobre novembre décembre januar februar märz juni juli oktober dezember".split())
_BEFORE_PLACE = frozenset("in von nach bei aus at of near above to from à de vers d’ über stadt".split())


def _kind(token: str) -> tuple[str, str, bool, bool]:
    """(word, placeholder if it always has one, whether it is capitalised,
    whether a place may follow). The word is in lower case, without marks at
    its ends."""
    bare = token.strip(_EDGE)
    low = bare.lower().replace("’", "'")
    slot = "<number>" if _NUMBER.fullmatch(bare) else "<month>" if low in MONTHS else "<unit>" if low in UNITS else ""
    return low, slot, bare[:1].isupper() and not (len(bare) > 1 and bare.isupper()), low in _BEFORE_PLACE


def _code(word: str) -> int:
    return xxhash.xxh64_intdigest(word) | 1


_SLOTS = {s: _code(s) for s in ("<number>", "<month>", "<unit>", "<name>")}
#: What is known of a word as it stands, words repeat: codes of the word (0 if
#: nothing is left of it) and of its typed form, capitalised, before a place.
_KNOWN: dict[str, tuple[int, int, bool, bool]] = {}


def templates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes of words, of words with typed numbers, of words with typed numbers
    and names, text that each is of) of all texts at once. Case, punctuation and
    layout go; numbers, months and units, and names, become placeholders of
    their kind. A name is a capitalised word that follows a preposition of
    place, as in some languages all nouns are capitalised; a text in capitals
    shows no names."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    encoded = pc.dictionary_encode(pc.list_flatten(lists))
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    if len(_KNOWN) > 500_000:
        _KNOWN.clear()
    known = []
    for t in encoded.dictionary.to_pylist():
        k = _KNOWN.get(t)
        if k is None:
            low, slot, capital, opens = _kind(t)
            k = _KNOWN[t] = (_code(low) if low else 0, _SLOTS[slot] if slot else _code(low) if low else 0, capital and not slot, opens)
        known.append(k)
    at = encoded.indices.to_numpy(zero_copy_only=False)
    if not len(at):
        return *(np.zeros(0, "uint64") for _ in range(3)), np.zeros(0, "int64")
    code, typed, capital, opens = (np.array(c, d)[at] for c, d in zip(zip(*known, strict=True), ("uint64", "uint64", bool, bool), strict=True))
    some = code != 0
    code, typed, capital, opens, row = code[some], typed[some], capital[some], opens[some], row[some]
    after = np.append(False, opens[:-1] & (row[1:] == row[:-1])) if len(row) else opens
    return code, typed, np.where(capital & after, np.uint64(_SLOTS["<name>"]), typed), row


def _windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of the window that begins at each place where one fits."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, "uint64")
    total = np.zeros(n, "uint64")
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    return total


def readings(texts: pa.Array) -> list[tuple[np.ndarray, pa.Array]]:
    """The texts without remarks in brackets, and, of those with a remark that
    may itself be a passage, with the brackets only taken away: (rows, texts)."""
    plain = pc.fill_null(texts, "")
    out = [(np.arange(len(texts)), pc.replace_substring_regex(plain, _REMARK, " "))]
    marked = np.flatnonzero(pc.match_substring_regex(plain, _SIGNS).to_numpy(zero_copy_only=False))
    more = [i for i in marked.tolist() if any(m.count(" ") >= NUMBERED - 1 and len(m.split()) >= NUMBERED for m in _REMARKS.findall(plain[i].as_py()))]
    if more:
        out.append((np.array(more), pc.replace_substring_regex(plain.take(pa.array(more)), _SIGNS, " ")))
    return out


def _emit(sizes: list[int], usual: bool = True, wanted=None):
    """A function of batches (``_key``, ``_text``) to their template windows:
    ``_key``, ``_at`` (place), ``_h``, ``_kind`` (words of the window), ``_n``
    (words of the text). ``usual``: those of both kinds of template; ``sizes``:
    windows of words as they are; ``wanted``: a broadcast of the sorted hashes
    without which a window meets nothing."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in readings(batch.column("_text")):
                words, numbered, named, row = templates(texts)
                count = np.bincount(row, minlength=len(texts)) if len(row) else np.zeros(len(texts), "int64")
                first = np.append(0, np.cumsum(count)[:-1])
                for ids, size in [*([(numbered, NUMBERED), (named, NAMED)] if usual else []), *((words, n) for n in sizes)]:
                    hashes = _windows(ids, size) + np.uint64(size)  # those of one size never meet another's
                    at = np.flatnonzero(row[: len(hashes)] == row[size - 1 : size - 1 + len(hashes)])
                    if wanted is not None and len(at):
                        known = wanted.value
                        place = np.searchsorted(known, hashes[at])
                        at = at[known[np.minimum(place, len(known) - 1)] == hashes[at]] if len(known) else at[:0]
                    of = row[at]
                    for i in range(0, len(at), CHUNK):
                        part, mine = at[i : i + CHUNK], of[i : i + CHUNK]
                        keys = batch.column("_key").take(pa.array(rows[mine]))
                        cols = [pa.array((part - first[mine]).astype("int32")), pa.array(hashes[part].view("int64")), pa.array(np.full(len(part), size, "int32")), pa.array(count[mine].astype("int32"))]
                        yield pa.RecordBatch.from_arrays([keys, *cols], ["_key", "_at", "_h", "_kind", "_n"])

    return emit


def _passage(text: np.ndarray, item: np.ndarray, size: int = STEP) -> tuple[int, list[tuple[int, int]]]:
    """Words of the item in its longest connected passage in the text, and the
    places of the windows that the two share there."""
    where: dict[int, list[int]] = {}
    for j, h in enumerate(_windows(item, size).tolist()):
        where.setdefault(h, []).append(j)
    runs: list[list] = []  # first and last place in the text, in the item, words matched, hits
    open_runs: list[list] = []
    for i, h in enumerate(_windows(text, size).tolist()):
        for j in where.get(h, ()):
            best = None
            for r in open_runs:
                di, dj = i - r[1], j - r[3]
                if di == dj == 1 or (0 < di <= size + GAP and 0 < dj <= size + GAP) and abs(di - dj) <= GAP:
                    if best is None or r[4] > best[4]:
                        best = r
            if best is None:
                runs.append([i, i, j, j, size, [(i, j)]])
                open_runs.append(runs[-1])
            else:
                best[4] += min(i - best[1], j - best[3], size)
                best[1], best[3] = i, j
                best[5].append((i, j))
        if open_runs and h in where:
            open_runs = [r for r in open_runs if i - r[1] <= size + GAP]
    most, hits = 0, []
    for i0, i1, j0, j1, matched, shared in runs:
        i1, j1 = i1 + size, j1 + size
        # A changed word near an end hides up to a window's words there.
        for step in (1, -1):
            i, j = (i1, j1) if step == 1 else (i0 - 1, j0 - 1)
            missed = 0
            while 0 <= i < len(text) and 0 <= j < len(item) and missed <= 2:
                if text[i] == item[j]:
                    matched += 1
                    missed = 0
                    if step == 1:
                        i1, j1 = i + 1, j + 1
                    else:
                        i0, j0 = i, j
                else:
                    missed += 1
                i, j = i + step, j + step
        if matched >= LIKENESS * (j1 - j0) and j1 - j0 > most:
            most, hits = j1 - j0, shared
    return most, hits


def _consistent(text: np.ndarray, item: np.ndarray, typed: np.ndarray, hits: list[tuple[int, int]], size: int = NAMED) -> bool:
    """Whether words that a placeholder stands for differ in one way
    throughout: each value of the item's slots stands for one of the text's,
    some recur, and some differ."""
    slots = {_SLOTS["<number>"], _SLOTS["<name>"]}
    places = {(i + k, j + k) for i, j in hits for k in range(size) if int(typed[j + k]) in slots}
    stands: dict[int, dict[int, int]] = {}
    for i, j in places:
        row = stands.setdefault(int(item[j]), {})
        row[int(text[i])] = row.get(int(text[i]), 0) + 1
    total = sum(sum(r.values()) for r in stands.values())
    kept = sum(max(r.values()) for r in stands.values())
    return kept >= CONSISTENT * total and any(sum(r.values()) > 1 for r in stands.values()) and any(v not in r for v, r in stands.items())


Words = tuple[np.ndarray, np.ndarray]


def words_of(texts: pa.Array, remarks: bool = True) -> list[list[Words]]:
    """(words, typed words) of each reading of each text."""
    out: list[list[Words]] = [[] for _ in range(len(texts))]
    for rows, reading in readings(texts) if remarks else [(np.arange(len(texts)), texts)]:
        words, _, typed, row = templates(reading)
        ends = np.searchsorted(row, np.arange(len(rows) + 1))
        for k, r in enumerate(rows.tolist()):
            out[r].append((words[ends[k] : ends[k + 1]], typed[ends[k] : ends[k + 1]]))
    return out


def compare(text: list[Words], item: Words, named: bool) -> tuple[int, int, bool] | None:
    """(words of the passage, words of the item, whether it only holds by its
    template) if some reading of a text holds a passage of the item, else None.
    ``named``: whether windows with typed names speak for the pair."""
    item_words, item_typed = item
    n, best = len(item_words), None
    least = n * SHARE - 1
    for words, typed in text:
        if n < NUMBERED:  # a short item has to stand as it is
            if n and np.isin(_windows(item_words, n), _windows(words, n)).all():
                return n, n, False
            continue
        span, _ = _passage(words, item_words)
        if span >= least:
            return span, n, False
        if named:
            span, hits = _passage(typed, item_typed, NAMED)
            if span >= least and _consistent(words, item_words, item_typed, hits):
                best = span, n, True
    return best


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item of which it holds a connected
    passage of at least a third of the item's words: ids, ``n_words`` (of the
    passage), ``item_words`` and ``template`` (its passage holds by the template
    only: a re-parameterised item).

    Texts are canonicalised to templates (``templates``) and cut into windows of
    ``NUMBERED`` or, with names typed as well, ``NAMED`` words, those of documents
    joined by hash with those of items. A pair with enough of them on a diagonal
    is read word by word: its passage counts if it holds as written, or by its
    template if each slot stands for one value throughout. Documents are read
    with and without remarks in
    brackets. The windows of items are shipped if they are at most
    ``SHIPPED_WINDOWS``, and windows that no item has then go no further; else
    they are joined by shuffle; documents are scanned once for
    windows and once for the pairs, and meet items as pairs only. Different
    items of one text are searched as one. Edge cases: null or empty texts hold
    and leak nothing; an item of under ``NUMBERED`` words leaks where all its
    words stand as they are; repeated documents come out each, repeated items under
    each id; other columns are ignored.
    """
    given = documents.select(F.col(doc_id).alias("_doc"), F.col(text_col).alias("_text")).filter(F.length("_text") > 0).withColumn("_key", F.xxhash64("_doc", "_text"))
    rows = items.select(F.col(item_id).alias("_item"), F.col(item_text).alias("_what")).filter(F.length(F.trim("_what")) > 0)
    one = rows.select(F.xxhash64("_what").alias("_key"), F.regexp_replace("_what", _REMARK, " ").alias("_text")).distinct()
    kind = "_key bigint, _at int, _h bigint, _kind int, _n int"
    usual = one.mapInArrow(_emit([]), kind)
    # Items of fewer words have windows of their own lengths, of which documents
    # are asked only where there are such items: at most eleven sizes.
    n_words = one.mapInArrow(_emit([1], False), kind).groupBy("_key").agg(F.max("_n").alias("_n"))
    short = sorted(r[0] for r in n_words.filter(F.col("_n") < NUMBERED).select("_n").distinct().collect())
    windows = usual.unionByName(one.mapInArrow(_emit(short, False), kind).filter(F.col("_n") == F.col("_kind"))) if short else usual
    need = F.when(F.col("_n") < NUMBERED, 1).otherwise(F.greatest(F.lit(2), F.floor(F.col("_n") * F.when(F.col("_kind") == NAMED, NAMED_SEEDS).otherwise(SEEDS)).cast("int")))
    posted = cut(windows.select("_h", "_kind", F.col("_key").alias("_which"), F.col("_at").alias("_place"), need.alias("_need")))
    shipped = posted.limit(SHIPPED_WINDOWS + 1).count() <= SHIPPED_WINDOWS
    hashes = np.sort(np.array([r[0] for r in posted.select("_h").distinct().collect()], "int64").view("uint64")) if shipped else None
    wanted = documents.sparkSession.sparkContext.broadcast(hashes) if shipped else None  # 8 bytes for each of the bounded windows
    met = given.select("_key", "_text").mapInArrow(_emit(short, wanted=wanted), kind).select("_key", "_at", "_h").join(F.broadcast(posted) if shipped else posted, "_h")
    # Hits of a passage lie on a diagonal that shifts by what is put in: of a
    # document and an item, only the diagonals are gathered.
    on = met.groupBy("_key", "_which", "_kind").agg(F.array_sort(F.collect_list((F.col("_at") - F.col("_place")).cast("int"))).alias("_d"), F.first("_need").alias("_need"))
    rich = on.filter(F.size("_d") >= F.col("_need")).filter(F.expr(f"exists(sequence(0, size(_d) - _need), i -> _d[i + _need - 1] - _d[i] <= {BAND})"))
    seeds = rich.groupBy("_key", "_which").agg(F.max(F.col("_kind") == NAMED).alias("_named"))
    pairs = given.join(seeds, "_key").join(one.withColumnsRenamed({"_key": "_which", "_text": "_said"}), "_which").select("_doc", "_which", "_text", "_said", "_named")
    # Few rows that are much work each: spread them anew.
    pairs = pairs.repartition("_doc")
    types = f"_doc {given.schema['_doc'].dataType.simpleString()}, _which bigint, n_words int, item_words int, template boolean"

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name, remarks in (("_text", True), ("_said", False)):
                coded = batch.column(name).dictionary_encode()
                made = words_of(coded.dictionary, remarks)
                sides.append([made[i] for i in coded.indices.to_pylist()])
            found = [compare(t, i[0], n) for t, i, n in zip(*sides, batch.column("_named").to_pylist(), strict=True)]
            at = pa.array([i for i, f in enumerate(found) if f], pa.int32())
            kept = [f for f in found if f]
            cols = [pa.array([f[k] for f in kept], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("_doc").take(at), batch.column("_which").take(at), *cols], ["_doc", "_which", "n_words", "item_words", "template"])

    ids = rows.select("_item", F.xxhash64("_what").alias("_which"))
    found = pairs.mapInArrow(check, types).join(ids, "_which")
    return found.select(F.col("_doc").alias(doc_id), F.col("_item").alias(item_id), "n_words", "item_words", "template")
