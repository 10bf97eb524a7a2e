"""Small cases, and brute force where SQL cannot express an operator."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import abuse, boilerplate, canon, language, leak, mixing, mojibake, neardup, pii, tagger, truncation

POSTS = "id long, posts string, extra int, text string, key string, lines string, c string"


def posts(spark, texts, start=1):
    return spark.createDataFrame([(i, t, 0, "clash", "clash", "clash", "clash") for i, t in enumerate(texts, start)], POSTS)


def canonical(spark, *texts):
    rows = canon.canonicalise(posts(spark, texts), "posts").orderBy("id").collect()
    return [r["canonical"] for r in rows]


def test_canonical_forms(spark):
    found = canonical(spark, "Ｆｕｌｌ　ｗｉｄｔｈ", "été", "a​b­c", "Рауѕ", "ﬁne  \t x ", "𝗯𝗼𝗹𝗱", "👩‍💻 ok", "l1\r\nl2", None, "", " ​ ")
    assert found == ["Full width", "été", "abc", "Pays", "fine x", "bold", "👩‍💻 ok", "l1\nl2", None, "", ""]


def test_canonical_orders_marks_and_keeps_case(spark):
    a, b, c = canonical(spark, "q̣̇", "q̣̇", "Q")
    assert a == b and a != c.lower()
    assert canonical(spark, "Ä ä") == ["Ä ä"]
    long = "ａ" * 50_000
    assert canonical(spark, long) == ["a" * 50_000]


def test_canonical_marks_of_all_classes_and_hangul(spark):
    import unicodedata

    korean = "한국어 값을 뷁"
    a, b, c, d, e, f, g = canonical(spark, "\u0627\u064b\u0651", "\u0627\u0651\u064b", korean, unicodedata.normalize("NFD", korean), "\uac00\u11a8", "ᎳᎪ", "\u0915\u093e\u093c")
    assert a == b and c == d == korean and e == "\uac01" and f[0] == "W"
    # A mark of class 0 stays before the ones that follow it.
    assert g == unicodedata.normalize("NFC", "\u0915\u093e\u093c")


def test_look_alike_pairs_are_brute_force(spark):
    r = random.Random(3)
    base = ["red kettle", "blue kettle", "", None, "Red kettle"]
    texts = [t and r.choice([t, t.replace("e", "е"), t.replace(" ", "  "), t.replace("k", "ｋ")]) for t in base * 12]
    forms = dict(enumerate(canonical(spark, *texts), 1))
    expected = {(a, b) for a, b in itertools.combinations(forms, 2) if forms[a] and forms[a] == forms[b] and texts[a - 1] != texts[b - 1]}
    got = {tuple(x) for x in canon.look_alike_pairs(posts(spark, texts), "id", "posts", block=5).collect()}
    assert got == expected and got


@pytest.mark.parametrize("bucket", [4096, 3])
def test_near_duplicates_are_brute_force(spark, bucket):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.sample(words, r.randint(20, 90))) for _ in range(40)]
    for t in list(texts[:25]):
        for _ in range(3):
            w = t.split()
            for _ in range(r.randint(0, len(w) // 7)):
                w[r.randrange(len(w))] = r.choice(words)
            r.shuffle(w)
            texts.append(" ".join(w))
    common = r.sample(words, 40)
    texts += [" ".join(common[:38] + [f"z{i}"]) for i in range(12)] + ["", None, "short"] + texts[:3]
    sets = [frozenset((t or "").split()) for t in texts]
    expected = {
        (i + 1, j + 1) for i, j in itertools.combinations(range(len(texts)), 2)
        if min(len(sets[i]), len(sets[j])) >= 30 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and texts[i] != texts[j]
    }
    got = [tuple(x) for x in neardup.near_duplicate_pairs(posts(spark, texts), "id", "posts", bucket=bucket).collect()]
    assert set(got) == expected and len(got) == len(expected) > 60
    groups = {x["id"]: x for x in neardup.near_duplicate_groups(posts(spark, texts), "id", "posts", bucket=bucket).collect()}
    assert set(groups) == {i + 1 for i, s in enumerate(sets) if len(s) >= 30}
    assert all(groups[a]["group_id"] == groups[b]["group_id"] for a, b in expected)


def test_covering_tables_miss_no_pair():
    r = random.Random(9)
    for _ in range(300):
        n = r.randint(30, 70)
        a = [f"x{r.random()}" for _ in range(n)]
        d = neardup.radius(n, n, 0.8) // 2
        b = a[d:] + [f"y{r.random()}" for _ in range(d)]
        import pyarrow as pa

        _, chunk = neardup.Chunk.of_texts(pa.array([" ".join(a).replace(".", ""), " ".join(b).replace(".", "")], pa.large_string()), 1)
        met = False
        for docs, k in neardup.levels(chunk.sizes, 30, 0.8):
            if len(docs) == 2:
                keys = chunk.keys(docs, k, 1)
                met |= bool((keys[0] == keys[1]).any())
        assert met


def test_empty_tables(spark):
    none = posts(spark, [])
    assert canon.look_alike_pairs(none, "id", "posts").count() == 0
    assert neardup.near_duplicate_pairs(none, "id", "posts").count() == 0
    assert truncation.find_cut_texts(none, "id", "posts").count() == 0
    assert boilerplate.find_page_lines(none, "id", "posts").count() == 0
    assert abuse.score_texts(none, "id", "posts").count() == 0
    assert pii.find_personal(none, "id", "posts").count() == 0
    assert mojibake.find_garbled(none, "id", "posts").count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert leak.template_matches(none, "id", "posts", items, "item_id", "text").count() == 0


def test_nulls_and_blanks(spark):
    odd = posts(spark, [None, "", "  ", "\n\n", "​", "x" * 100_000])
    assert neardup.near_duplicate_pairs(odd, "id", "posts").count() == 0
    assert boilerplate.find_page_lines(odd, "id", "posts").count() == 0
    assert pii.find_personal(odd, "id", "posts").count() == 0
    assert mojibake.find_garbled(odd, "id", "posts").count() == 0
    assert {tuple(r)[1:] for r in abuse.score_texts(odd, "id", "posts").collect()} == {(0.0, 0.0, 0.0)}
    assert pii.mask_personal(odd, "id", "posts").where("text is null").count() == 1


def test_cut_texts(spark):
    whole = "We bought the small kettle last week. The lid broke after three days and nobody answered the phone."
    texts = [whole + f" It works again now, number {i}." for i in range(40)] + [whole + " The lid broke after three days and nob", whole + " The lid broke after three", whole[:-1], whole + " 😡 #fail", "no thanks"]
    got = {r["key"] for r in truncation.find_cut_texts(posts(spark, texts), "id", "posts").collect()}
    assert got == {41, 42}


def test_long_links_come_off():
    assert truncation.author_end(["The lid broke after three https://a.example/" + "x" * 400]) == "The lid broke after three"


def test_hidden_limit(spark):
    r = random.Random(1)
    rows = spark.createDataFrame([(r.randint(60, 200),) for _ in range(2000)] + [(140,)] * 200, "characters int")
    assert [x["length"] for x in truncation.hidden_limits(rows, ["characters"]).collect()] == [140]


def test_cut_platforms(spark):
    rows = spark.createDataFrame([(x,) for x in ("Red", "reddit", " Faceboo", "Tw", "Linked", None, "", "Quora", "TWITT")], "s string")
    assert [r[0] for r in rows.where(truncation.cut_platform(F.col("s"))).collect()] == ["Red", " Faceboo", "Linked", "TWITT"]


def test_page_lines(spark):
    text = "Home · Topics · Log in\n\nThe cookie banner kept coming back, so I gave up.\nPros:\n- quiet motor\nWe use cookies to make this site work.\n12 comments · 3 shares\n© 2020 Some Site. All rights reserved."
    got = sorted(r["line_no"] for r in boilerplate.find_page_lines(posts(spark, [text]), "id", "posts").collect())
    assert got == [1, 6, 7, 8]
    assert boilerplate.main_text(posts(spark, [text, None]), "id", "posts").orderBy("key").first()["main"] == "\nThe cookie banner kept coming back, so I gave up.\nPros:\n- quiet motor"


@pytest.mark.parametrize("line", ["© 2021 wren. all rights reserved.", "all rights reserved by nobody", "tous droits réservés", "halls of all rights reserved", "we use cookies here", "a lamp - a cable", "a  b", "a\u2003b | c", "plain words only", "x all rights reservedly"])
def test_page_patterns_are_all_followed(line):
    import re

    assert boilerplate._voiced(line) == (re.compile("|".join(boilerplate.VOICES)).fullmatch(line) is not None)


def test_languages(spark):
    sentences = {"en": "the shop was closed and nobody told us about it", "de": "der Laden war zu und niemand hat uns das gesagt", "es": "la tienda estaba cerrada y nadie nos lo dijo", "fr": "le magasin était fermé et personne ne nous a prévenus", "it": "il negozio era chiuso e nessuno ci ha detto niente", "pt": "a loja estava fechada e ninguém nos disse nada"}
    train = spark.createDataFrame([(i, s, code) for i, (code, s) in enumerate(list(sentences.items()) * 5)], "id long, posts string, lang string")
    model = language.fit(train, "id", "posts", "lang")
    mixed = sentences["en"].capitalize() + ". " + sentences["de"].capitalize() + "."
    rows = spark.createDataFrame([(1, mixed), (2, sentences["pt"]), (3, None), (4, "")], "id long, posts string")
    found = language.languages(rows, "id", "posts", model).selectExpr("key", "explode(found.lang) as lang").collect()
    assert {(r["key"], r["lang"]) for r in found} == {(1, "en"), (1, "de"), (2, "pt")}
    # A switch inside a sentence gives two segments, and another script is no candidate for the six.
    inside = spark.createDataFrame([(1, sentences["en"] + " " + sentences["de"]), (2, "это совсем другой язык")], "id long, posts string")
    parts = language.segments(inside, "id", "posts", model).orderBy("key", "part").collect()
    assert [(r["key"], r["lang"]) for r in parts] == [(1, "en"), (1, "de"), (2, "other")]
    assert parts[0]["text"] == sentences["en"] and parts[1]["text"] == sentences["de"]


@pytest.mark.parametrize("line", ["Home > Electronics > Headphones", "Share on Twitter", "View all comments (23)", "Was this helpful? Yes No", "This site is protected by reCAPTCHA", "Men | Women | Kids | Sale", "Ver comentarios (4)"])
def test_page_lines_of_kinds_on_no_list(line):
    author = "The kettle broke after two days and nobody ever answered my mails about it."
    assert boilerplate.page_lines([author, line, "Home · Help"]) == [False, True, True]
    assert not any(boilerplate.page_lines([author, "I could not log in, the cookie banner kept coming back.", "Terms say one thing, their help page another."]))


def test_labels(spark):
    rows = spark.createDataFrame([(x,) for x in ("en", "EN-us", "Español", "deu", "sv", "??", None, " ", "pt_XX")], "l string")
    assert [r[0] for r in rows.select(language.label_language(F.col("l"))).collect()] == ["en", "en", "es", "de", "other", None, None, None, "pt"]


@pytest.mark.parametrize(("text", "found"), [("Listen, you m0r0n.", {"abuse"}), ("Every one of you is a s c u m b a g!", {"abuse"}), ("What a stupid little box.", set()), ("Nobody should call the staff idiots.", set()), ("They breed like rats.", {"hate"}), ("Sell me your used panties.", {"sexual"}), ("The form asks for my sex.", set()), ("A batch had been recalled, said the rep.", set())])
def test_abuse(text, found):
    assert {c for c, v in abuse.Scorer().text(text).items() if v >= 0.5} == found


@pytest.mark.parametrize(
    ("text", "category"),
    [
        ("I will kill you all tonight.", "abuse"), ("Ich bringe dich um.", "abuse"), ("Te voy a matar.", "abuse"), ("Je vais te tuer.", "abuse"), ("Ti ammazzo se torni.", "abuse"), ("Vou te matar.", "abuse"), ("Nobody would miss you.", "abuse"),
        ("Those immigrants should burn.", "hate"), ("Women belong in the kitchen.", "hate"), ("Get rid of all the refugees.", "hate"), ("Nackte Frauen live.", "sexual"), ("She gave me a blowjob for the refund.", "sexual"),
        ("This kettle is a piece of garbage.", None), ("The battery died and the cable could hurt someone.", None), ("The naked wire is dangerous.", None),
    ],
)
def test_sentences_taken_from_no_data(text, category):
    assert {c for c, v in abuse.Scorer().text(text).items() if v >= 0.5} == ({category} if category else set())


@pytest.mark.parametrize(
    ("text", "abusive"),
    [
        ("You idiot, this service is unacceptable.", True),
        ("You are a moron and an insult to the shop, says the rep.", True),
        ("Listen, you idiot, I reported this twice.", True),
        ("The reply said (again) nothing, so listen, you moron.", True),
        ("Someone wrote “you idiot” and I reported it.", False),
        ("Nobody should call the staff idiots.", False),
        ("He called me \"you idiot\" on the phone.", False),
    ],
)
def test_only_enclosing_quotes_and_rejections_lower_the_score(text, abusive):
    assert (abuse.Scorer().text(text).get("abuse", 0) >= 0.5) == abusive


@pytest.mark.parametrize(("word", "term"), [("idoit", "idiot"), ("morn", "moron"), ("losr", "loser"), ("nakd", "naked"), ("vermn", "vermin"), ("idoits", "idiots"), ("diot", "idiot"), ("noron", "moron")])
def test_short_misspellings(word, term):
    assert term in abuse.Lexicon().terms(word)
    # A word that is as usual in the corpus as the term is a word of its own.
    assert term not in abuse.Lexicon({word: 10, term: 12}).terms(word)


def test_scores_of_misspelled_words(spark):
    texts = ["Listen, you idoit.", "Every one of you is a losr.", "The later the better, you said."]
    assert [r["abuse"] for r in abuse.score_texts(posts(spark, texts), "id", "posts").orderBy("key").collect()] == [1.0, 1.0, 0.0]


def test_scorers_are_kept_with_their_counts():
    a, b = {"idiot": 5}, {"idiot": 5}
    first = abuse._scorer(a)
    assert abuse._scorer(a) is first and abuse._scorer(b) is not first
    # What is known of words changes no score.
    texts = ["You are a complete idiot.", "you are an i d i o t", "l'idiot que tu es", "The lamp is fine.", "shut up, you-idiot/you"]
    kept = abuse._scorer(a)
    assert [kept.text(t) for t in texts] == [kept.text(t) for t in texts] == [abuse.Scorer(a).text(t) for t in texts]


def test_automaton_is_brute_force():
    lexicon = abuse.Lexicon()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j - 1] + (x != y), old[j] + 1, row[j - 1] + 1))
        return row[-1]

    terms, todo = [], [lexicon.trie]
    while todo:
        node = todo.pop()
        terms += [v for k, v in node.items() if not k]
        todo += [v for k, v in node.items() if k]
    for word in ("moron", "morom", "bastrad", "imbecle", "versagr", "kettle"):
        assert lexicon.near(word, 1) == {t for t in terms if t[0] == word[0] and distance(word, t) <= 1}


def test_leaks(spark):
    item = "The retired signalman from Jupkelop dismantled the pedal driven juicer near batch 9520 in the town of Trusagon."
    docs = [f"Intro. {item} End.", item.upper().replace(" ", "\n"), " ".join(item.split()[:10]), " ".join(item.split()[:9]), item.replace("Jupkelop", "Marvelop").replace("9520", "77"), None, ""]
    rows = {(r["doc"], r["verbatim"] > 0, r["one_to_one"]) for r in leak.template_matches(posts(spark, docs), "id", "posts", spark.createDataFrame([(7, item), (8, None)], "item_id long, text string"), "item_id", "text").collect()}
    assert {d for d, verbatim, _ in rows if verbatim} == {1, 2, 3}
    changed = item.replace("Jupkelop", "Marvelop").replace("9520", "77").replace("Trusagon", "Bellagon")
    assert leak.template_matches(posts(spark, [changed]), "id", "posts", spark.createDataFrame([(7, item)], "item_id long, text string"), "item_id", "text").first()["one_to_one"]


def test_numbers_with_decimals_are_one_slot(spark):
    item = "A cyclist rides 3.5 miles in the morning and then another 12,750 yards before lunch, how far is that in total?"
    other = item.replace("3.5", "12").replace("12,750", "900")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = leak.template_matches(posts(spark, [other, item, other.replace("900 yards", "12 yards")]), "id", "posts", items, "item_id", "text", numbers=True).orderBy("doc").collect()
    n = len(item.replace("3.5", "3").replace("12,750", "1").split()) - 9
    # The third gives one number for two different ones of the item.
    assert [(r["doc"], r["windows"], r["verbatim"] > 0, r["one_to_one"]) for r in found] == [(1, n, False, True), (2, n, True, True), (3, n, False, False)]


def test_budgets():
    assert mixing.fill([1, 1, 2], [10, 100, 100], 80) == pytest.approx([10, 70 / 3, 140 / 3])
    leaves = [(("a", "en"), (0.5, 80.0), 100.0), (("a", "de"), (0.5, 20.0), 20.0), (("b", "en"), (0.5, 10.0), 10.0)]
    given = mixing.leaf_budgets(leaves, 100)
    # b can give 10 only, so a gets 90, of which de can give its 18 by weight.
    assert given == pytest.approx({("a", "en"): 72.0, ("a", "de"): 18.0, ("b", "en"): 10.0})


def test_mixture(spark):
    rows = [(i, "a", "en", 10) for i in range(300)] + [(1000 + i, "b", None, 10) for i in range(20)] + [(2000, "c", "en", 5), (2001, "a", "en", 0)]
    sized = spark.createDataFrame(rows, "id long, source string, lang string, tokens long")
    targets = spark.createDataFrame([("a", 0.8, 1), ("b", 0.2, 3), ("d", 0.1, 2)], "source string, target_share double, max_repeats int")
    used = mixing.mixture(sized, "id", "tokens", ["source", "lang"], targets, "target_share", "max_repeats", budget=2400.0, slice_rows=20).collect()
    total = {s: sum(r["tokens"] * r["uses"] for r in used if r["source"] == s) for s in "abc"}
    assert total["a"] == pytest.approx(1920, abs=10) and total["b"] == pytest.approx(480, abs=10) and total["c"] == 0
    assert max(r["uses"] for r in used if r["source"] == "a") == 1 and max(r["uses"] for r in used if r["source"] == "b") == 3
    assert len({r["id"] for r in used}) == len(used)


def test_token_counts(spark):
    texts = ["Hello world, it's 2023!", "", None, "naïve café 😂  \n x"]
    got = [r["n"] for r in mixing.token_counts(posts(spark, texts).select("id", "posts"), "posts", "n").orderBy("id").collect()]
    encode = mixing.encoder(mixing.TOKENIZERS, "byte_bpe_50k.tiktoken").encode_ordinary
    assert got == [len(encode(t or "")) for t in texts] and got[1:3] == [0, 0]


def test_garbled(spark):
    clean = ["La línea de ayuda explicó que la batería está aquí", "Der Händler erklärte, die Gebühr sei für alle", "Le modèle a été testé par l'équipe", "A garantia não cobre o preço — então perdi", "NÃO é só isso"]
    texts = clean * 8
    bad = [mojibake.misread(clean[0], "utf-8", "cp1252"), mojibake.misread(clean[1], "utf-8", "cp437"), mojibake.misread(mojibake.misread(clean[2], "utf-8", "cp1252"), "utf-8", "cp1252"), clean[3].replace("ã", "�"), mojibake.misread(clean[1], "cp1252", "mac_roman")]
    got = {r["doc"] for r in mojibake.find_garbled(posts(spark, texts + bad * 2), "id", "posts").select("doc").distinct().collect()}
    assert got == set(range(41, 51))
    restored = {r["doc"]: r["restored_text"] for r in mojibake.restored_texts(posts(spark, texts + bad * 2), "id", "posts").collect()}
    assert restored[41] == clean[0] and restored[42] == clean[1] and restored[43] == clean[2]


def test_garbled_in_copied_and_rare_texts(spark):
    clean = ["Der Händler erklärte, die Gebühr sei für alle", "été ici, le modèle a été testé par l'équipe"]
    wrong = [mojibake.misread(x, "cp1252", "mac_roman") for x in clean]
    # One garbled text copied more often than its words occur, and a name that occurs nowhere else beside other restored words.
    rare = mojibake.misread("Der Händler Grünwäldchen erklärte nichts", "cp1252", "mac_roman")
    emoji = mojibake.misread("été 🦉 ici", "utf-8", "cp1252")
    texts = clean * 2 + [f"{x} {i}" for i, x in enumerate(clean * 3)] + wrong * 30 + [rare, emoji, "Łukasz aus Gdańsk kennt den Händler"]
    restored = {r["doc"]: r["restored_text"] for r in mojibake.restored_texts(posts(spark, texts), "id", "posts").collect()}
    assert set(restored) == set(range(11, 73))
    assert restored[11] == clean[0] and restored[12] == clean[1]
    assert restored[71] == "Der Händler Grünwäldchen erklärte nichts" and restored[72] == "été 🦉 ici"


def test_garbled_cyrillic_documents(spark):
    clean = [f"привет мир номер {w} сегодня идёт дождь" for w in ("один", "два", "три", "четыре", "пять")] * 6
    bad = [mojibake.misread(clean[i], "utf-8", "cp1252") for i in range(2)]
    rows = {r["doc"]: r["restored_text"] for r in mojibake.restored_texts(posts(spark, clean + bad), "id", "posts").collect()}
    assert rows == {31: clean[0], 32: clean[1]}


def test_quoted_accents_are_not_bytes():
    restore = mojibake.restorations([("utf-8", "mac_roman", 1), ("utf-8", "cp1252", 1)], frozenset("’é“Ü"))
    assert [restore(x)[0] for x in ("l’équipe", "“Über")] == [None, None]
    assert restore(mojibake.misread("🦉", "utf-8", "cp1252"))[0][0] == "🦉"


def test_undo_is_the_inverse_of_misread():
    text = "ÀÉÎõü ñ ß € “x” — 😂"
    for written, read, times in mojibake.readings():
        wrong = mojibake._apply(mojibake.misread, text, written, read, times)
        if wrong is not None and read != "utf-8":
            assert mojibake._apply(mojibake.undo, wrong, written, read, times) == text


def test_tagger_gradients():
    w = {k: v.astype(np.float64) for k, v in tagger.new_weights(3, 4).items()}
    w["tr"] = np.random.default_rng(1).normal(0, 0.3, w["tr"].shape)
    ids, tags = np.array([[1, 2, 3, 4], [5, 6, 7, 8]], np.int16), np.array([[0, 1, 2, 0], [0, 0, 3, 4]])
    loss, g = tagger.gradients(w, ids, tags)
    for name, at in (("out", (2, 1)), ("tr", (0, 1)), ("hf", (1, 5)), ("xb", (0, 3)), ("emb", (3, 1)), ("st", (0,))):
        other = {k: v.copy() for k, v in w.items()}
        other[name][at] += 1e-3
        up = tagger.gradients(other, ids, tags)[0]
        other[name][at] -= 2e-3
        down = tagger.gradients(other, ids, tags)[0]
        assert g[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-3)


def test_personal_information(spark):
    texts = ["Please write to sunny.kettle12@mail.example if you have the receipt.", "Call me on +1 857 555 0186 after six.", "Order 4454-9096-456 has been stuck since the weekend.", "My name is Ingrid Navtegard and I want an answer.", "The shop on Hollow Street closes early now.", "They shipped it to 212 Hollow Road instead of my new flat."]
    got = {(r["key"], r["kind"]) for r in pii.find_personal(posts(spark, texts), "id", "posts").collect()}
    assert got == {(1, "email"), (2, "phone"), (4, "name"), (6, "address")}
    brands = spark.createDataFrame([("ingrid navtegard",)], "brand string")
    assert pii.find_personal(posts(spark, texts), "id", "posts", brands).where("kind = 'name'").count() == 0
    masked = {r["key"]: r["text"] for r in pii.mask_personal(posts(spark, texts), "id", "posts").collect()}
    assert masked[2] == "Call me on [PHONE] after six." and masked[5] == texts[4]


def test_tagger_held_out_recall():
    """Sentences of wording that training never saw."""
    from postmill.llm.train_tagger import held_out

    recall = held_out(pii.read, 20)
    by_kind = {k: np.mean([v for (kind, _), v in recall.items() if kind == k]) for k in tagger.KINDS}
    assert by_kind["email"] > 0.9 and by_kind["address"] > 0.8 and min(by_kind.values()) > 0.6


def test_scorer_passes_spans():
    from postmill.llm.train_tagger import Maker

    make = Maker(7)
    texts, spans = zip(*[make.clause("en", k) for k in "EPIAN" for _ in range(40)])
    import pyarrow as pa

    doc, _, _, score = tagger.word_scores(pa.array(texts, pa.large_string()), pii.weights())
    passed = {int(i) for i in doc[score >= pii.weights()["scorer_limit"]]}
    assert len(passed) > 0.97 * len(texts)


def test_formats_of_parcels_do_not_hide_identity_numbers():
    texts = ["A copy of my passport 0269 9012 8379 went around.", "Tracking 4300 1033 3556 has not moved.", "El documento de identidad 81932896-U estaba a la vista."]
    assert [[k for k, _, _ in found] for found in pii.read(texts)] == [["id_number"], [], ["id_number"]]


def test_reader_reads_every_word_alike_in_any_batch():
    import pyarrow as pa

    from postmill.llm import reader

    span, filler = "Call me on +1 857 555 0186 after six.", "the lamp was fine and the cable too "
    long = [filler * n + span + " " + filler * 40 for n in (0, 10, 70, 400)]
    together = pii.read([*long, "no", "", span])
    assert together == [x for t in [*long, "no", "", span] for x in pii.read([t])]
    assert all([k for k, _, _ in x] == ["phone"] for x in [*together[:4], together[-1]])
    w, names = pii.model()
    doc, _, codes, words = reader.words_of(pa.array(long[:3], pa.large_string()))
    e = reader.scores(w, doc, codes, reader.embedded(w, reader.numbers(words, names)))
    # Texts of any lengths side by side get the scores that each gets alone from both directions of the LSTM that is trained.
    vectors = reader.embedded(w, reader.numbers(words, names))
    for d in range(3):
        alone = tagger.emissions({**w, "emb": vectors}, codes[doc == d][None])[:, 0]
        assert np.allclose(e[doc == d][:400], alone[:400], atol=1e-3)
    # Leaving out words that no tag can hold changes no best path.
    for d in range(3):
        rows = e[doc == d]
        whole = np.concatenate([rows, np.where(np.arange(tagger.TAGS) == 0, 0, -1e4)[None].astype(np.float32)])
        assert (tagger.decode({**w, "st": w["tr"][0]}, whole[:, None, :])[0, :-1] == reader.paths(w, doc, e)[doc == d]).all()


def test_masks_keep_the_stored_text():
    assert pii.masked("мир\u00a0 и (Anna Berg).", "миp и (Anna Berg).", [("name", 7, 16)]) == "мир\u00a0 и ([NAME])."


def test_unicode_tables_are_bounded():
    assert 5_000 < len(canon.fold_rows()) < 20_000 and 500 < len(canon.compose_rows()) < 3_000
    assert canon.plain_class().count("-") < 20
