import collections

import pytest
from pyspark.sql import functions as F
from quillstream.llm import folding, leakage, locales, lookalikes, mixing, mojibake, personal, residue, truncation

SENTENCES = [
    "The harbour café keeps the old signal box near Larkholm.", "Our reporter spent 5 days in Ellerby, where the island school measures an archive of letters.", "Il a fallu 23 années, mais le musée des horloges sauve le marché de Noël.",
    "La niña del tranvía repara el camión de los niños cerca de Tarnwick.", "Die Bäckerei am Fluss öffnet einen Fährplan für den Winter.", "Музей часов возвращает сад за мельницей после сухого лета.",
]


def links(spark, rows):
    return spark.createDataFrame(rows, "meta_id int, site_id int, title string, description string, site_name string, original_url string, raw string")


# ---- residue


@pytest.mark.parametrize(("value", "kind"), [
    ("{{ item.title }}", "placeholder"), ("Why [ITEM_LABEL] the tramway", "placeholder"), ("%1$s", "placeholder"), ("undefined :: The Post", "empty_value"), ("Lorem ipsum dolor sit amet", "filler"),
    ("404 Not Found", "message"), ("PLEASE ENABLE JAVASCRIPT TO CONTINUE.", "message"), ("Pаge not fоund", "message"), ("PÃ¡gina no encontrada", "message"), ("Ｃｏｍｉｎｇ ｓｏｏｎ", "message"),
    ("Knitting charts with {curly} braces, explained", None), ("The undefined border between A and B", None), ("A page that cannot be found in the choir book", None), ("Why printers still set lorem ipsum", None),
    ("This tutorial shows how double braces such as {{ }} are filled", None), ("Access denied: the archive nobody may enter", None), ("", None), ("word " * 20_000, None),
])
def test_residue(value, kind):
    assert residue.classify(value, "The Post")[0] == kind


def test_residue_reads_long_garbled_messages():
    bad = "Página no encontrada. La página no existe. " * 7
    for _ in range(2):
        bad = bad.encode().decode("iso8859_1")
    assert len(bad) > 240 and residue.classify(bad, "The Post")[0] == "message"


def test_residue_operator(spark):
    rows = [(1, 1, "Page not found", None, None, "https://a/b", "r"), (1, 1, "Page not found", None, None, "https://a/b", "r"), (2, None, "", "Null and void, a play", "S", None, None), (3, 2, "Coming soon", "x", "S", "https://a/coming-soon", "r")]
    df = links(spark, rows)
    found = residue.find_residue(df, ["meta_id"], ["title", "description"]).filter("residue")
    assert sorted((r["meta_id"], r["field_name"], r["n_rows"]) for r in found.collect()) == [(1, "title", 2)] * 2
    assert residue.find_residue(df.limit(0), ["meta_id"], ["title"]).count() == 0


def test_residue_that_recurs(spark):
    # No word of it is telling of a message; hosts, address and title have to say.
    value = "Enter a short description of the page (max. {} characters)"
    rows = [(i, i, "The old signal box", value.format(i), None, f"https://a/the-night-market-{i}", "r") for i in range(3)]
    rows += [(10 + i, i, "The night market", "Write a short summary", None, f"https://a/{i}", "r") for i in (0, 0, 1)]
    rows += [(20 + i, i, "The page link", "Document link", None, f"https://a/document-link-{i}", "r") for i in range(3)]
    rows += [(30 + i, i, "A summary of the mill site at its old address", "Site address summary", None, f"https://a/{i}", "r") for i in range(3)]
    found = residue.find_residue(links(spark, rows), ["meta_id"], ["title", "description"]).filter("field_name = 'description'")
    assert {r["meta_id"]: (r["n_hosts"], r["residue"]) for r in found.collect() if r["meta_id"] < 10} == {i: (3, True) for i in range(3)}
    assert not found.filter("meta_id >= 10 and meta_id < 30 and residue").count()
    borne_out = found.filter("meta_id >= 30").collect()
    assert [(r["n_hosts"], r["residue"]) for r in borne_out] == [(3, False)] * 3 and all(r["in_other"] == 1 for r in borne_out)


# ---- charsets


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, 1, s, None, None, None, None) for i, s in enumerate(SENTENCES * 30)]
    return mojibake.train(links(spark, rows), ["title", "description"])


@pytest.mark.parametrize(("wrong", "right"), [("cp1252", "utf_8"), ("cp1251", "utf_8"), ("mac_roman", "utf_8"), ("cp437", "utf_8"), ("mac_roman", "cp1252"), ("cp437", "cp1252")])
def test_round_trip(model, wrong, right):
    repairer = mojibake.Repairer(model)
    for text in SENTENCES[2:5]:
        bad = mojibake._decode(mojibake._encode(text, right) if right != "utf_8" else text.encode(), wrong)
        assert repairer.repair(bad)[:2] == ("restored", text)


def test_clean_stays(model):
    repairer = mojibake.Repairer(model)
    for text in [*SENTENCES, "NÃO PERCA: a coleção", "ÂME SŒUR, a film", "½ price, field notes²…", "👩‍🍳 Cooking", "Rеview of thе box", "", "plain"]:
        assert repairer.repair(text)[0] == "clean"
    assert repairer.repair("red�couvre")[0] == "garbled" and repairer.repair("TardÃƒÂ³ 19 aÃƒÂ±os")[1] == "Tardó 19 años"


@pytest.mark.parametrize(("bad", "good"), [
    ("The townâ€™s oldest bakery", "The town’s oldest bakery"), ("Wexmere diary â€“ the old signal box", "Wexmere diary – the old signal box"), 
    ("La ni–a del tranv’a repara el cami—n de los ni–os", "La niña del tranvía repara el camión de los niños"),
])
def test_garbling_that_leaves_common_signs(model, bad, good):
    # Each sign is one that the language writes; that they stand so is told by the description.
    assert mojibake.Repairer(model).repair(bad)[:2] == ("restored", good)


def test_signs_that_stand_right(model):
    repairer = mojibake.Repairer(model)
    for text in ["Nobody—not even Ellerby—knows", "L’école de l’île", "CAFÉ» de l’ÎLE", "ÂGE D’OR", "NÃO «SÃO»", "18ｷﾛの散歩道"]:
        assert repairer.repair(text)[0] == "clean"


def test_every_language_that_fits_is_measured():
    text = "Zéphyrine Quévrémont"
    assert {"fr", "it", "pt"} <= set(mojibake.languages_of(text))
    plain = mojibake.Repairer({"dictionaries": {}}).measure(text)[0]
    for lang in ("fr", "it", "pt"):
        assert mojibake.Repairer({"dictionaries": {lang: (text.encode() * 9, False)}}).measure(text)[0] < plain


def test_garbled_operator(spark, model):
    rows = [(1, 1, "cafÃ© du port", None, None, None, "x"), (1, 1, "cafÃ© du port", None, None, None, "x"), (2, 1, "", SENTENCES[3], None, None, None), (3, 1, None, "a" * 50_000 + "Ã©", None, None, None)]
    df = links(spark, rows)
    diagnostics = spark.createDataFrame([(1, "Windows-1252"), (1, None)], "meta_id int, detected_charset string")
    found = mojibake.find_garbled(df, ["meta_id"], ["title", "description"], diagnostics, model).collect()
    assert sorted((r["meta_id"], r["restored"][:4]) for r in found if r["meta_id"] == 1) == [(1, "café")] * 2
    assert mojibake.find_garbled(df.limit(0), ["meta_id"], ["title"]).count() == 0


def test_models_are_of_all_values(spark, monkeypatch):
    # Words and ideographs that one value of 50,000 has are in the model, and each character is counted; sums are handed on in parts.
    monkeypatch.setattr(mojibake, "HELD_COUNTS", 10)
    rare = ["鰯と蕎麦の物語を読む。", "蜻蛉が棲む池の辺りで。", "Музей ящерицы возвращает сад после лета.", "La niña del ñandú y los pájaros cerca del puerto.", "Die Gärtnerin und der Äschenfluss öffnet den Flügel."]
    df = spark.range(50_000).select(F.concat(F.lit("The harbour café of the town and its number "), F.col("id")).alias("title"))
    model = mojibake.train(df.union(spark.createDataFrame([(t,) for t in rare], "title string")), ["title"])
    assert set(model["ideographs"]) == {c for t in rare[:2] for c in t if "㐀" <= c <= "鿿"}
    assert model["characters"]["en"]["é"] == 50_000
    words = {lang: raw.decode() for lang, (raw, _) in model["dictionaries"].items()}
    assert " ящерицы" in words["ru"] and " ñandú" in words["es"] and " Äschenfluss" in words["de"] and words["en"].endswith(" harbour") and len(words["en"].encode()) <= mojibake.DICTIONARY_BYTES


# ---- look-alikes


@pytest.mark.parametrize(("raw", "plain"), [("Ｔｈｅ ﬁn", "The fin"), ("a b​c\xad", "a bc"), ("é", "é"), ("𝐓𝐡𝐞", "The"), ("½ ² ™ № … “x” 👩‍🍳", "½ ² ™ № … “x” 👩‍🍳"), ("がく", "がく")])
def test_forms(raw, plain):
    assert folding.fold_forms(raw) == plain


def test_unify(spark, model):
    rows = [(1, 1, "Rеview: the old box", None, "Маяк Север", None, None), (2, 1, "Review: the old box", None, "Mаяк Cевер", None, None), (3, 1, "Xуzzу", None, None, None, None), (4, 1, "cafÃ©\xa0du port", None, "", None, None), (1, 1, "Rеview: the old box", None, None, None, None)]
    df = links(spark, rows)
    made = lookalikes.unify(df, ["meta_id"], ["title", "site_name"], model).filter("changed")
    assert sorted((r["meta_id"], r["field_name"], r["unified"]) for r in made.collect()) == [(1, "title", "Review: the old box")] * 2 + [(2, "site_name", "Маяк Север")]
    assert lookalikes.unify_all(df, ["meta_id"], ["title", "site_name"], model).count() == 8
    assert lookalikes.unify(df.limit(0), ["meta_id"], ["title"], model).count() == 0


def test_unify_knows_words_of_all_values(spark):
    # That two are garbled, and so left alone, is told by the words of one value of 60,000.
    words = "El tranvía de la señorita Peñaranda y el camión de la cañería del montañero Ibáñez en la montaña"
    frequent = spark.range(30_000).select(F.concat(F.lit("The harbour cafe of the town and its number "), F.col("id")).alias("title"), F.concat(F.lit("The Paper of the town "), F.col("id")).alias("site_name"))
    few = spark.createDataFrame([(words, "del\ttranv’a en la monta–a"), ("La\tse–orita Pe–aranda", None)], "title string, site_name string")
    df = frequent.union(few).withColumn("meta_id", F.monotonically_increasing_id())
    assert lookalikes.unify(df, ["meta_id"], ["title", "site_name"]).filter("changed").count() == 0


def test_unify_knows_words_of_values_that_tell_no_language(spark):
    # No common word tells the language of the value that has the words; titles and names of sites are often so.
    words = "Tranvía Señorita Peñaranda Camión Cañería Montañero Ibáñez"
    assert len(mojibake.languages_of(words)) > 2
    rows = [("The harbour cafe of the town", words), ("Se–orita Pe–aranda\tIb‡–ez", "Monta–ero\tPe–aranda")]
    df = spark.createDataFrame(rows, "title string, site_name string").withColumn("meta_id", F.monotonically_increasing_id())
    assert lookalikes.unify(df, ["meta_id"], ["title", "site_name"]).filter("changed").count() == 0


def test_unify_counts_every_value_once(spark):
    # Languages share a value that several fit; a disguised one counts as what it looks like, a garbled one doesn't.
    texts = ["Quarry Observer", "Café Köppel", "Łódka", "Quarry\xa0Observer", "Музей часов", "The harbour of the town", "", " ", None]
    model = mojibake.train(spark.createDataFrame([(t,) for t in [*texts, "CafÃ© Köppel", "a\x92b"]], "site_name string"), ["site_name"])
    counted = model["characters"]
    assert sum(n[""] for n in counted.values()) == pytest.approx(sum(len(t) for t in texts if t))
    assert sum(n.get("ö", 0) for n in counted.values()) == pytest.approx(1) and counted["pl"]["Ł"] == 1
    assert all(b" Observer" in model["dictionaries"][lang][0] for lang in ("de", "en", "es", "fr", "it", "pl", "pt"))
    assert mojibake.Repairer(model).repair("CafÃ© Köppel")[:2] == ("restored", "Café Köppel")


# ---- truncation


def test_cut_texts(spark):
    full = [f"It took {i} years, but the crossing keeper shares the old signal box near Ellerby. The plan costs {i} thousand crowns." for i in range(40)]
    heads = [f"Recipes, walks and opening hours for {p} and around" for p in ("Ellerby", "Larkholm") for _ in range(20)]
    cut = ["It took 7 years, but the crossing", "It took 7 years, but the crossing kee", "Recipes, walks and opening hours for", "The plan costs 5 thousand crowns. It took 9 years, but", "It took 8 years, but the…", "A b [...]"]
    rows = [(i, 1, None, t, None, None, None) for i, t in enumerate([*full, *heads, *cut, "", "Please enable JavaScript to continue", "%SITE_NAME%"])] + [(999, None, None, None, None, None, None)]
    df = links(spark, rows)
    found = truncation.find_cut(df, ["meta_id"], "description")
    assert sorted(r["meta_id"] for r in found.collect()) == [80 + i for i in range(len(cut))]
    rates = {r["site"]: (r["n_texts"], r["n_cut"]) for r in truncation.cut_rates(df, found, "description").collect()}
    assert rates == {1: (len(rows) - 1, 6), None: (0, 0)}
    assert truncation.find_cut(df.limit(0), ["meta_id"], "description").count() == 0


def test_cut_texts_with_little_support(spark):
    # Three uses inside are enough, and neither a text's own end nor its copies speak against them.
    full = [f"The night market sells a floating library near {p}." for p in ("Ellerby", "Larkholm", "Tarnwick")]
    cut = ["Everyone who sells a floating", "In Corvanne a keeper sells a floating", "In Corvanne a keeper sells a floating"]
    heads = ["A walk to the market sells"]
    rows = [(i, 1, None, t, None, None, None) for i, t in enumerate([*full, *cut[:1], *heads])]
    found = lambda rows: sorted((r["meta_id"], r["reason"]) for r in truncation.find_cut(links(spark, rows), ["meta_id"], "description").collect())
    assert found(rows) == [(3, "trigram")]
    assert found([(i, 1, None, t, None, None, None) for i, t in enumerate([*full, *cut[1:]])]) == [(3, "trigram"), (4, "trigram")]
    # Another text with the same end does speak against them.
    assert found([(i, 1, None, t, None, None, None) for i, t in enumerate([*full, *cut[:2]])]) == []


# ---- locales


def test_locales(spark):
    entries = spark.createDataFrame([("en", "English", "English", None), ("en-GB", "English", "English", "United Kingdom"), ("de", "German", "Deutsch", None), ("de-CH", "German", "Deutsch", "Switzerland")], "locale_code string, language_name string, native_name string, country_name string")
    want = {"Englsih": "en", "EN_gb.UTF-8": "en-GB", "British English": "en-GB", "English (Unitde Kingdom)": "en-GB", "enUK": "en-GB", "Allemand": "de", "de_SUI": "de-CH", "cy_GB": "unmatched", "Klingon": "unmatched", "": "unmatched", "-": "unmatched", "x" * 9000: "unmatched"}
    df = spark.createDataFrame([(i, v, "t") for i, v in enumerate([*want, *want, None])], "meta_id int, locale string, tokens string")
    mapping = locales.map_locales(df, entries)
    assert {r["locale"]: r["locale_code"] for r in mapping.collect()} == want and {r["n_rows"] for r in mapping.collect()} == {2}
    assert locales.with_locale(df, mapping).count() == 2 * len(want) + 1
    assert {r["locale_code"] for r in locales.map_locales(df, entries.limit(0)).collect()} == {"unmatched"}
    # The join loses nothing against all pairs.
    forms = locales.reference_forms([tuple(r) for r in entries.collect()])
    for v in want:
        t = set(locales.tokens_of(locales.words_of(v))) if len(v) < 400 else set()
        best = max(((len(t & set(s)) / len(t | set(s)), c) for c, _, s in forms), default=(0, ""))
        assert (best[0] >= locales.THRESHOLD) == (want[v] != "unmatched")


# ---- leakage

WORDS = [f"w{i}" for i in range(400)]


def test_leaks(spark):
    item, other = " ".join(WORDS[:90]), " ".join(WORDS[100:190])
    part = lambda a, b: " ".join(WORDS[a:b])
    changed = WORDS[:40]
    changed[11], changed[25] = "changed", "also"
    docs = [
        (1, f"before {part(10, 50)} after"), (2, f"before {part(10, 30)} after"), (3, " ".join(changed).upper().replace(" ", ",\n", 3)), (4, f"{part(0, 20)} (a long remark put in) {part(20, 36)}"),
        (5, f"{part(10, 24)} x {part(60, 74)}"), (6, None), (7, ""), (1, f"before {part(10, 50)} after"), (8, part(100, 190) + " " + part(0, 90)),
    ]
    docs += [(9, f"He said ({part(10, 50)}), they say."), (10, "It is a Short, one!"), (11, "It is a short two one"), (12, f"({part(10, 50)} " + "z " * 400 + ")")]
    documents = spark.createDataFrame(docs, "doc_id int, text string").withColumn("item_id", F.lit("x"))
    items = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "short one"), (5, ""), (6, item)], "item_id bigint, text string")
    found = leakage.find_leaks(documents, items).filter("not template and item_id < 6")
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(1, 1), (1, 1), (3, 1), (4, 1), (8, 1), (8, 2), (9, 1), (10, 4), (12, 1)]
    assert leakage.find_leaks(documents, items).filter("item_id = 6").count() == 7  # a copy leaks likewise
    assert leakage.find_leaks(documents, items.limit(0)).count() == 0 and leakage.find_leaks(documents.limit(0), items).count() == 0
    bound, leakage.SHIPPED_WINDOWS = leakage.SHIPPED_WINDOWS, 0
    try:
        assert leakage.find_leaks(documents, items).count() == 16
    finally:
        leakage.SHIPPED_WINDOWS = bound


def test_leaks_that_only_a_template_seeds(spark):
    # A number at every seventh word leaves no exact window of that length.
    numbered = lambda first, n: " ".join(f"{first + i}" if i % 7 == 6 else WORDS[i] for i in range(n))
    documents = spark.createDataFrame([(1, f"before {numbered(5000, 48)} after"), (2, numbered(5000, 20))], "doc_id int, text string")
    items = spark.createDataFrame([(1, numbered(1000, 120))], "item_id bigint, text string")
    found = leakage.find_leaks(documents, items).collect()
    assert [(r["doc_id"], r["item_id"], r["template"]) for r in found] == [(1, 1, False)]


def test_leaks_with_other_parameters(spark):
    # Every third word is a number; only consistent ones re-parameterise the item.
    text = lambda of: " ".join(f"{of(i)}" if i % 3 == 2 else WORDS[i] for i in range(120))
    items = spark.createDataFrame([(1, text(lambda i: 100 + i % 15))], "item_id bigint, text string")
    docs = [(k, text(lambda i, k=k: 1000 * (k + 1) + i % 15)) for k in range(20)] + [(90, text(lambda i: 7000 + i)), (91, text(lambda i: 5))]
    found = leakage.find_leaks(spark.createDataFrame(docs, "doc_id int, text string"), items).collect()
    assert sorted((r["doc_id"], r["template"]) for r in found if r["doc_id"] < 90) == [(k, True) for k in range(20)]
    assert 90 not in {r["doc_id"] for r in found}


# ---- mixing


def test_mixing(spark):
    size = F.length("text").cast("bigint")
    docs = spark.createDataFrame([(i, "x" * 10, "abc"[i % 3] if i < 60 else "a") for i in range(300)] + [(900, None, "a"), (901, "", "a"), (902, "x", None), (903, "x", "z")], "doc_id int, text string, source string").withColumn("position", F.lit(1))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets, lambda c: F.length(c).cast("bigint")).cache()
    rows = mixed.collect()
    uses = collections.Counter((r["source"], r["doc_id"]) for r in rows)
    tokens = collections.Counter()
    for r in rows:
        tokens[r["source"]] += r["n_tokens"]
    total = sum(tokens.values())
    assert max(n for (s, _), n in uses.items() if s == "a") == 1 and max(uses.values()) <= 3 and all(0 <= r["position"] <= 1 for r in rows)
    assert all(abs(tokens[s] / total - w) < 0.02 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2))) and set(tokens) == {"a", "b", "c"}
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    # Weights lean: of the source that leans to the end more than half is late.
    late = {s: sum(r["position"] > 0.5 for r in rows if r["source"] == s) / sum(r["source"] == s for r in rows) for s in "abc"}
    assert late["a"] < 0.5 < late["c"]
    assert mixing.mix(docs.limit(0), targets, lambda c: F.length(c).cast("bigint")).count() == 0
    assert mixing.shares(mixed, targets).count() == 4 and size is not None


# ---- personal information


def test_candidates():
    text = (
        "Dagny Peverell-Oake: The nurse Solange T. Villacorta signed the petition; her address is Flat 5, 26 Upper Wharf Road in Velenwick, her mail s.villa [at] box [dot] example. "
        "Ring +44 (0)7700 900 052 or 0049-30-23125-042. Vote 0044-20-752 was carried. Passport QQ 32 12 72 C. I agree with H. Halvard. Frau Käthe\nSauerbier wohnt in Köhlerweg 153a, 08442 Quenasby. Le crédit 01.20.711 passe."
    )
    got = {(k, text[a:b]) for k, a, b, *_ in personal.candidates(text)}
    assert {("email", "s.villa [at] box [dot] example"), ("phone", "+44 (0)7700 900 052"), ("phone", "0049-30-23125-042"), ("id_number", "QQ 32 12 72 C"), ("address", "Flat 5, 26 Upper Wharf Road in Velenwick"), ("address", "Köhlerweg 153a, 08442 Quenasby"), ("name", "Solange T. Villacorta"), ("name", "Käthe\nSauerbier")} <= got
    # The label of a speech is none; members are taken out later.
    assert not any("Dagny" in t for k, t in got if k == "name") and ("name", "H. Halvard") in got


def test_members_in_any_form(spark):
    members = spark.createDataFrame([("Dagny Peverell-Oake",), ("Hilmar Halvard",), (None,), ("",)], "full_name string")
    pool = [(g, s) for g in ("Solange", "Oswin", "Rupert") for s in ("Villacorta", "Crickmere", "Aldenhoven")]
    docs = [(i, f"Then {g} {s} spoke to the clerk.") for i, (g, s) in enumerate(pool)]
    forms = ["Hilmar Halvard", "H. Halvard", "Hilmar Halvrad", "Hilmer Halvard", "Halvard, Hilmar", "Dagny\nPeverell-Oake"]
    docs += [(100 + i, f"Then {n} spoke to the clerk.") for i, n in enumerate(forms)]
    found = personal.find_personal(spark.createDataFrame(docs, "doc_id int, text string"), members).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(9))
    # Two letters off is another person.
    other = personal.mention_keys("Hilmar", "", "Halbart", "hilmar halbart", False)
    assert not {k for k, _ in other if k[0] in "=@~"} & {k for k, _ in personal.member_keys("Hilmar Halvard")} and not personal._near("halvard", "halbart")


def test_names_in_frames_that_nothing_lists(spark):
    given, last = "Arvid Bertille Cosima Drusilla Emeric Fabiola".split(), "Abernethy Bracegirdle Dankworth Eccleston Grimshaw Oxenham".split()
    frames = ["Yesterday {} told the inquiry that nothing had changed.", "The minister met {} before the vote.", "It was {} who found the ledger.", "According to {}, the road was never repaired."]
    names = [f"{g} {s}" for g in given for s in last]
    docs = [(i, frames[i % 4].format(n) + f" The Hedgerow Bill is read. The Northern Isles wait for {i} ships. The Oswin Tower is closed.") for i, n in enumerate(names)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    found = {(r["doc_id"], r["found_text"]) for r in personal.find_personal(df, spark.createDataFrame([], "full_name string")).collect()}
    assert len(found & set(enumerate(names))) >= 0.9 * len(names) and len(found - set(enumerate(names))) <= 1
    # They come by the gazetteers and contexts: without them there are none.
    votes = personal._voted
    try:
        personal._voted = lambda met: votes(met).withColumn("all", F.concat("votes", F.array(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))).withColumn("use_alt", F.lit(False))
        assert personal.find_personal(df, spark.createDataFrame([], "full_name string")).count() == 0
    finally:
        personal._voted = votes


def test_personal_operator(spark):
    names = [("Solange", "Villacorta"), ("Oswin", "Crickmere"), ("Solange", "Crickmere"), ("Oswin", "Villacorta")]
    docs = [(i, f"A constituent, {g} {s}, asked me to raise this. Write to {s.lower()}@box.example, they said. The {g} Bridge is closed. Vote 0044-20-752 was carried. Ring 07700 900081.") for i, (g, s) in enumerate(names * 6)]
    df = spark.createDataFrame([*docs, (90, None), (91, ""), (0, docs[0][1])], "doc_id int, text string").withColumn("score", F.lit(0))
    members = spark.createDataFrame([("Hilmar Halvard",), (None,)], "full_name string")
    found = personal.find_personal(df, members)
    first = {(r["pii_type"], r["found_text"]) for r in found.filter("doc_id = 1").collect()}
    assert first == {("name", "Oswin Crickmere"), ("email", "crickmere@box.example"), ("phone", "07700 900081")}
    text = personal.redact(df.filter("doc_id = 1"), found).collect()[0]["text"]
    assert text == "A constituent, [NAME], asked me to raise this. Write to [EMAIL], they said. The Oswin Bridge is closed. Vote 0044-20-752 was carried. Ring [PHONE]."
    assert personal.redact(df, found).filter("doc_id = 90 and text is null and n_mentions = 0").count() == 1
    assert personal.find_personal(df.limit(0), members).count() == 0


# ---- both sides of former bounds


def test_messages_inside_of_longer_texts():
    own = "The river museum lends its maps to the village school, by Marjorie Fenwick of the Ellerby Post. "
    for n in (1, 30):
        assert residue.classify(own * n + "Please enable JavaScript to continue.", "S")[0] == "message"
        assert residue.classify(own * n + "Which scripts does a seed library need?", "S")[0] is None


def test_long_locales(spark):
    entries = spark.createDataFrame([("de-DE", "German", "Deutsch", "Germany")], "locale_code string, language_name string, native_name string, country_name string")
    values = ["de-DE", "de-DE" + " " * 500, "de-DE;q=" + "0" * 500, "German " + "x " * 50, "German Germany", "y " * 5000]
    df = spark.createDataFrame([(v,) for v in values], "locale string")
    want = dict(zip(values, ["de-DE", "de-DE", "de-DE", "unmatched", "de-DE", "unmatched"], strict=True))
    bound = locales.FORMS_BROADCAST
    try:
        for locales.FORMS_BROADCAST in (bound, 0):
            assert {r["locale"]: r["locale_code"] for r in locales.map_locales(df, entries).collect()} == want
    finally:
        locales.FORMS_BROADCAST = bound


def test_long_words_at_a_cut(spark):
    full = [f"The night market sells a floating library near {p}." for p in ("Ellerby", "Larkholm", "Tarnwick")]
    rows = [(i, 1, None, t, None, None, None) for i, t in enumerate([*full, "In Corvanne a keeper sells a floating libr", "A " + "z" * 50_000 + " is a word", "One two " + "q" * 50_000])]
    assert [(r["meta_id"], r["reason"]) for r in truncation.find_cut(links(spark, rows), ["meta_id"], "description").collect()] == [(3, "word")]
