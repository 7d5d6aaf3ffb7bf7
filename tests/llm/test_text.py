import random
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import lookalike, mojibake, readability, residue, tokens
from tidewheel.llm.mojibake import Detector

TOKENS = {"más": 50, "für": 40, "été": 30, "–": 90, "и": 60, "тетрадь": 40, "дорога": 40, "Führer": 30, "río": 20, "古い港の案内": 30, "Öffnungszeiten": 30, "“quiet": 20, "école": 30}
FOLDER = tokens.DEFAULT_FOLDER


@pytest.fixture(scope="module")
def garble():
    return Detector(TOKENS)


# --- look-alikes -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text, form", [
    ("Ｐａｇｅ　１", "Page 1"), ("café", "café"), ("pa​ge", "page"), ("a b c", "a b c"), ("pаge", "page"), ("ﬁne", "fine"), ("Kren\u0303ez", "Kreñez"), ("a‑b‐c", "a-b-c"),
    ("ɑlpha", "alpha"), ("доpoга", "дорога"), ("ﾃｷｽﾄ", "テキスト"), ("한", "한"), ("λίμvη", "λίμνη"), ("soft­hyphen", "softhyphen"), ("mеոd", "mend"), ("﻿x", "x"), ("ma thе road", "ma the road"), ("cr\u0435\u0302perie", "crêperie"), ("узкая дорога :: Oѕkеrwell", "узкая дорога :: Oskerwell"), ("Führer durch ԁiе Mühle", "Führer durch die Mühle"),
])
def test_stand_ins(text, form):
    assert lookalike.consistent(text) == (True, form)
    assert lookalike.consistent(form) == (False, form)


@pytest.mark.parametrize("text", ["", " ", "plain", "a  b", "… – ’ ™ ½ ² № µ º", "👨‍👩‍👧 ❤️", "PDF-архив", "JavaScriptを有効", "Öffnungszeiten", "дорога и школа", "古い港", "и", "Москва-style", "tab\tb", "дорога у моря (25 m²)", "조용한", "мой road"])
def test_ordinary_text_is_unchanged(text):
    assert lookalike.consistent(text) == (False, text)


LATIN_WORDS = {t: 0.1 for w in ("coco", "a", "cop") for t in lookalike._trigrams(w)}
RUSSIAN_WORDS = {t: 0.2 for w in ("хор", "сор") for t in lookalike._trigrams(w)}


@pytest.mark.parametrize("text, form", [
    ("Open the хор door", "Open the хор door"), ("Аррӏе pie", "Apple pie"), ("раураӏ account", "paypal account"), ("a сосо shop", "a coco shop"), ("ѕсоре of work", "scope of work"),
    ("Ꭺpple pie", "Apple pie"), ("ᏟᎪᏢ shop", "CAP shop"), ("small ᴄʜᴀʀ here", "small char here"), ("the сор said", "the сор said"), ("lost а key", "lost a key"), ("Вечер в саду", "Вечер в саду"), ("pаrк", "park"), ("ꓐook", "Book"), ("abжсd", "abжcd"),
])
def test_whole_words_are_told_by_their_letters_not_their_length(text, form):
    assert lookalike.consistent(text, (), LATIN_WORDS | RUSSIAN_WORDS)[1] == form


def test_garbled_spans_are_left_alone(garble):
    s = "Recettes mÃ¡s y río"
    assert lookalike.consistent(s, [(x.start, x.end) for x in garble.spans(s)]) == (False, s)


# --- garbled text ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("wrong", ["cp1252", "latin_1", "cp437", "cp850", "mac_roman", "cp1251"])
@pytest.mark.parametrize("text", ["más río", "Öffnungszeiten der Tür – für", "дорога и тетрадь", "古い港の案内"])
def test_utf8_read_otherwise_comes_back(garble, text, wrong):
    g = mojibake._read(text.encode(), wrong)
    if g is None:
        return
    found, fixed, whole = garble.repair(g)
    assert found and fixed == text and whole
    assert garble.repair(text) == (False, text, True)


@pytest.mark.parametrize("right, wrong, text", [("cp1251", "cp1252", "тетрадь и дорога"), ("koi8_r", "cp1251", "тетрадь и дорога"), ("cp1252", "mac_roman", "Führer für été"), ("cp1252", "cp850", "école más"), ("cp932", "cp1252", "古い港の案内")])
def test_other_pairs(garble, right, wrong, text):
    found, fixed, _ = garble.repair(mojibake._read(text.encode(right), wrong))
    assert found and fixed == text


def test_twice_and_in_part_and_entities_and_utf7(garble):
    once = "más".encode().decode("cp1252")
    assert garble.repair(once.encode().decode("cp1252"))[:2] == (True, "más")
    assert garble.repair(f"río {once} école") == (True, "río más école", True)
    assert garble.repair("m&Atilde;&iexcl;s")[:2] == (True, "más")
    assert garble.repair("f+APw-r")[:2] == (True, "für")
    assert garble.repair("f�r") == (True, "f�r", False)


@pytest.mark.parametrize("text", ["", "plain", "C++ and A+B", "R&D &amp; x", "LIÇÕES DE PÃO E IRMÃ", "MAÇÃ, LÃ E NAÇÃO", "PÃO E IRMÃ…", "¿Qué?\xa0-\xa0x", "notes:\xad x", "MAÇÃ™", "a manhã™", "ещё одна зелёная", "Гёте", "Straße", "20 °C", "ＬÃ Ｅ", "naïve café", "日本語", "한국어"])
def test_correct_text_is_left(garble, text):
    assert garble.repair(text) == (False, text, True)


GERMAN = ["Die alte Mühle am Fluss", "Mühle und Brücke", "Über die Brücke", "Die Mühle im Schnee", "Bücher für Müller", "Führer für Gärten"]
RUSSIAN = ["дорога к реке", "старая дорога", "тетрадь и дорога", "дорога у реки", "новая тетрадь", "река и берег"]


@pytest.mark.parametrize("right, wrong, correct, title", [("cp1252", "cp1251", GERMAN, "Mühle"), ("cp1252", "mac_roman", GERMAN, "Mühle"), ("cp1252", "cp437", GERMAN, "für"), ("cp1251", "cp1252", RUSSIAN, "дорога"), ("koi8_r", "cp1251", RUSSIAN, "дорога"), ("cp1251", "cp866", RUSSIAN, "тетрадь")])
def test_one_garbled_title_in_a_third_of_the_rows(spark, right, wrong, correct, title):
    g = title.encode(right).decode(wrong)
    df = spark.createDataFrame([(t,) for t in correct * 2 + [g] * 300 + ["plain"] * 600], "text string")
    d = Detector(mojibake.corpus_tokens([F.col("text")], [df]))
    assert d.repair(g) == (True, title, True)
    assert [d.repair(t) for t in correct] == [(False, t, True) for t in correct]


@pytest.mark.parametrize("right, wrong", [("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp1251", "cp437"), ("koi8_r", "cp1251")])
def test_rare_words_are_told_by_their_letters(right, wrong):
    words = "дорога старая новая тетрадь река берег город улица школа книга письмо окно дерево вода земля небо ветер рука голова время человек ребёнок женщина работа слово место друг начало дорогой красный белый зелёный большой маленький хороший плохой первый второй последний который потому когда между перед после через".split()
    d = Detector({w: 50 for w in words})
    for word in ("соседка", "горизонт", "перевозка", "молоток"):
        g = word.encode(right).decode(wrong)
        found, fixed, _ = d.repair(f"x {g} y")
        assert d.repair(f"x {word} y") == (False, f"x {word} y", True)
        assert (found, fixed) == (True, f"x {word} y") or wrong == "cp1251"  # letters of one script for another: seldom sure


def test_garbled_many_times_and_in_one_long_token(garble):
    text = "más"
    for n in range(6):
        text = text.encode().decode("cp1252")
        found, fixed, _ = garble.repair(text)
        assert found and (fixed == "más" or n > 3), n
    long = "x" * 300 + "mÃ¡s" * 20_000
    assert garble.repair(long)[0]


# --- residue -----------------------------------------------------------------------------------------------------------

PROSE = ["Visiting the quiet bridge", "Error bars explained with a kettle", "The untitled bridge, and other paintings", "JavaScript for gardeners: the ferry course", "Counting {1, 2, 3}: sets for the class", "[Updated] compass opening hours", "The $9 kettle", "Access denied? The locked ferry of 1931", "Null island and its harbour", "Lost page of the ferry manuscript found"]


WORDS = "quiet bridge ferry kettle harbour garden compass letter winter morning river castle".split()


def natural(n):
    rnd = random.Random(3)
    return [" ".join(rnd.choice(WORDS) for _ in range(6)) for _ in range(n)] + PROSE


@pytest.fixture(scope="module")
def ratios():
    none = np.zeros(residue.BUCKETS, np.float32)
    pieces = sorted({p for t in natural(300) for p in residue.pieces(residue.folded(t))})
    prose, _ = residue.learn_once(pieces, residue.Ratio(residue.seed_counts(), none))
    return residue.Ratios(prose, none, residue.learn_shapes([residue.shaped(p) for p in pieces], residue.Ratios(none, none, none)))


@pytest.mark.parametrize("text", ["{{ page.title }}", "Welcome to <%= title %>", "Shop – %s", "Lorem ipsum dolor sit amet", "404 Not Found", "Page not found | Quillmoor", "Please enable JavaScript", "Untitled", "null", "Ошибка 404", "Ｐａｇｅ ｎｏｔ ｆｏｕｎｄ", "Quillmoor: Seite nicht gefunden", "[Page title]", "PÃ¡gina no encontrada", "{0} – {1}"])
def test_residue_is_told(ratios, garble, text):
    assert residue.told([text], ratios, garble) == [True]


@pytest.mark.parametrize("text", ["", " ", *PROSE])
def test_prose_is_kept(ratios, garble, text):
    assert residue.told([text], ratios, garble) == [False]


def test_many_texts_as_one(ratios):
    texts = ["", "a", "ab", "404 not found", "visiting the quiet bridge", "x" * 500, "untitled | quillmoor"]
    assert ratios.told(texts).tolist() == [bool(ratios.told([t])[0]) for t in texts]
    assert ratios.told([]).tolist() == [] and ratios.covered([]).tolist() == []


def test_a_slot_of_any_length_is_told(ratios):
    assert ratios.told(["{{ " + "very_long_name." * 40 + "title }}", "prose and ${" + "x" * 300 + "} prose"]).tolist() == [True, True]


@pytest.mark.parametrize("share", [0.01, 0.1, 0.34])
@pytest.mark.parametrize("title", ["Just a moment...", "Access denied", "Untitled", "Page not found", "Lorem ipsum dolor sit amet", "{title}"])
def test_common_residue_is_no_prose(spark, garble, title, share):
    rows = natural(600)
    many = int(len(rows) * share / (1 - share) / 3) + 1
    df = spark.createDataFrame([(t,) for t in rows + [title, f"{title} | Quillmoor", f"{title} - Oskerwell"] * many], "text string")
    learned = residue.learn(df.selectExpr("lower(text) form"))
    told = residue.told([title, f"{title} | Quillmoor", *PROSE, *rows[:5]], residue.Ratios(*learned), garble)
    assert told == [True] * 2 + [False] * (len(PROSE) + 5)


def test_residue_of_a_kind_left_out_of_the_seeds():
    """Each line of the grammar in turn: the models are fitted without it, then asked about its texts."""
    d = Path("/root/testdata/sf0.01")
    if not d.exists():
        pytest.skip("no test tables")
    titles = {t for n in ("page_content", "page_data") for t in pq.read_table(d / f"{n}.parquet", columns=["title"])["title"].to_pylist() if t}
    pieces = sorted({p for t in titles for p in residue.pieces(residue.folded(t))})
    none = np.zeros(residue.BUCKETS, np.float32)
    plain = residue.learn_shapes(sorted({residue.shaped(p) for p in pieces}), residue.Ratios(none, none, none))
    recall = []
    for i, texts in enumerate(residue.families()):
        seeds = residue.seed_counts(i)
        prose, _ = residue.learn_once(pieces, residue.Ratio(seeds, none))
        recall.append(residue.Ratios(prose, none, plain, seeds).told([residue.folded(t) for t in texts]).mean())
    assert np.mean(recall) >= 0.85


# --- tokens ------------------------------------------------------------------------------------------------------------


def test_encoding_is_the_tokenizers_own():
    e = tokens.encoder(f"{FOLDER}/{tokens.DEFAULT_VOCABULARY}")
    rnd = random.Random(5)
    alphabet = "aà ép \n\r\t\x0b\xa0 　  'sé5²٣½.,-é世😀\x1c\x85 Рр1I'm<|endoftext|>"
    for _ in range(3000):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30)))
        assert e.encode(s).tolist() == e.model.encode_ordinary(s)
        assert e.model.decode_bytes(e.encode(s).tolist()) == s.encode()
    long = "word 12 à " * 20_000 + "x" * 5_000
    assert e.encode(long).tolist() == e.model.encode_ordinary(long)


def test_encode_frames(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hi there", "z"), (3, "hi there", "z"), (None, " ", "w")], "doc_id long, text string, ids string")
    got = [(r["doc_id"], len(r["ids"])) for r in tokens.encode(df, "text", ["doc_id"]).collect()]
    assert got == [(1, 0), (2, 0), (3, 2), (3, 2), (None, 1)]
    assert [r["n_tokens"] for r in tokens.count_tokens(df, "text", ["doc_id"]).collect()] == [0, 0, 2, 2, 1]
    assert tokens.encode(df.limit(0), "text", ["doc_id"]).count() == 0


# --- reading level -----------------------------------------------------------------------------------------------------

CUES = "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\n<i>NARRATOR: The cat saw</i>\r\n[door slams] a dog.\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\n- Old Quen: It ran off!\r\n\r\n3\r\n00:00:05,000 --> 00:00:06,000\r\nSubtitles by X www.x.test\r\n\r\n4\r\n00:00:07,000 --> 00:00:08,000\r\n♪ la la ♪\r\n"


def test_speech():
    assert readability.sentences(CUES) == [["the", "cat", "saw", "a", "dog"], ["it", "ran", "off"]]
    assert readability.sentences("{1}{20}The cat|saw it.") == [["the", "cat", "saw", "it"]]
    assert readability.sentences("WEBVTT\n\n00:01.000 --> 00:02.000\nmÃ¡s\n") == [["más"]]
    for empty in ("", " ", "no cues here", "WEBVTT\n\n", "1\n00:00:01,000 --> 00:00:02,000\n\n"):
        assert readability.sentences(empty) == []


def test_levels_of_few_documents(spark):
    cue = lambda s: f"1\n00:00:01,000 --> 00:00:02,000\n{s}\n"
    easy, hard = "The cat saw a dog.", "Notwithstanding magnetometry, the stratifological disambiguation substantiated our polarometry because terminisation relinquished it."
    rows = [(i, cue(f"{easy} {easy}") if i % 2 else cue(f"{hard} {hard}"), "en", "x") for i in range(40)] + [(90, None, None, None), (91, "", "en", ""), (92, cue(easy), None, "y"), (93, cue("x" * 200_000), "en", "y"), (None, cue(hard), "en", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, level string")
    labels = spark.createDataFrame([(i, 1 if i % 2 else 5) for i in range(30)] + [(1, 1), (99, 2), (5, None)], "doc_id long, level int")
    got = {r["doc_id"]: r["level"] for r in readability.read_levels(docs, labels).collect()}
    assert all(got[i] == (1 if i % 2 else 5) for i in range(30, 40)) and got[92] == 1 and not {1, 90, 91} & got.keys()
    assert readability.read_levels(docs, labels.limit(0)).count() == 0
    assert readability.read_levels(docs.limit(0), labels).count() == 0


# --- frames of titles --------------------------------------------------------------------------------------------------


def test_titles_with_anything_in_them(spark):
    rows = [(1, "mÃ¡s", 7), (1, "mÃ¡s", 7), (2, None, None), (3, "", 1), (4, "quіet", 2), (None, "�", 3), (5, "é" * 200_000 + "Ã©", 4), (6, "{{title}}", 5)]
    df = spark.createDataFrame(rows, "seq long, text string, restored int")
    shared = spark.sparkContext.broadcast(mojibake.corpus_tokens([F.col("text")], [df]))
    assert sorted((r["seq"] or 0) for r in mojibake.mark_garbled(df, "text", ["seq"], shared).collect()) == [0, 1, 1, 5]
    forms = {r["seq"]: r["form"] for r in lookalike.unify(df, "text", ["seq"], shared).collect()}
    assert forms[4] == "quiet" and forms[3] == "" and len(forms) == 6
    assert [r["seq"] for r in residue.mark_residue(df, ["seq"], shared).collect()] == [6]
    kept = residue.mark_residue(df, ["seq"], shared, found=False).collect()
    assert sorted((r["seq"] or 0) for r in kept) == [0, 1, 1, 2, 3, 4, 5]
    empty = df.limit(0)
    none = spark.sparkContext.broadcast(mojibake.corpus_tokens([F.col("text")], [empty]))
    assert mojibake.mark_garbled(empty, "text", ["seq"], none).count() == 0 and lookalike.unify(empty, "text", ["seq"], none).count() == 0
    assert residue.mark_residue(empty, ["seq"], none).count() == 0
