import pytest

from archivum.llm import mojibake as M

CLEAN = ["Überprüfung größtenteils gültig, Rückfrage für Bestände", "L’évaluation du risque évoque « élevé » près de l’été", "Информация о формате не найдена, проверено файлов", "INFORMAÇÃO SOBRE O PADRÃO: NÃO À DISTÂNCIA", "cost €61944 at 33 °C ± 4", "¿Qué programa abre? Según la guía, sólo número 20", "café – naïve “quoted” isn’t"]


@pytest.fixture(scope="module")
def model():
    from collections import Counter

    counts = Counter(c for t in CLEAN for a, b in M.words_of(t) for c in [*M.contexts(t[a:b]), *("+" + k for k in M.close_contexts(t[a:b]))])
    return {k: n * 200 for k, n in counts.items()}


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1250", "cp866"])
@pytest.mark.parametrize("text", CLEAN)
def test_utf8_round_trip(model, text, wrong):
    garbled = "".join(M._high(wrong)[b - 128] if b > 127 else chr(b) for b in text.encode())
    fixed, n, lost, _ = M.Repairer(model).repair("plain " + garbled + " plain")
    assert n and not lost and fixed == "plain " + text + " plain"


def test_nested_layers_and_two_passages(model):
    once = lambda t: "".join(M._high("cp1252")[b - 128] if b > 127 else chr(b) for b in t.encode())
    assert M.Repairer(model).repair(once(once(once(CLEAN[0]))))[0] == CLEAN[0]
    mixed = once(CLEAN[1]) + " und " + CLEAN[0].encode("cp1252").decode("mac_roman")
    fixed, n, *_ = M.Repairer(model).repair(mixed)
    assert fixed == CLEAN[1] + " und " + CLEAN[0] and n > 4


@pytest.mark.parametrize("meant, wrong, text", [("cp1252", "mac_roman", CLEAN[0]), ("mac_roman", "cp1252", CLEAN[0]), ("cp1251", "cp1252", CLEAN[2]), ("cp1251", "koi8-r", CLEAN[2]), ("koi8-r", "cp1251", CLEAN[2]), ("cp437", "cp1252", CLEAN[0])])
def test_single_byte_confusions_are_found(model, meant, wrong, text):
    garbled = "".join(M._high(wrong)[b - 128] if b > 127 else chr(b) for b in text.encode(meant))
    assert M.Repairer(model).repair(garbled)[1] > 0


@pytest.mark.parametrize("text", [*CLEAN, None, "", "plain", "a\xa0b so\xadft ze​ro", "Ça dépend « » NÃO"])
def test_clean_text_is_left_alone(model, text):
    assert M.Repairer(model).repair(text) == (text, 0, 0, [])


def test_lost_characters_are_reported(model):
    assert M.Repairer(model).repair("f�r alle")[1:3] == (0, 1)


def test_rows(spark):
    rows = [(1, CLEAN[0] * 30), (2, None), (3, ""), (4, CLEAN[0].encode().decode("latin-1")), (4, CLEAN[0].encode().decode("latin-1")), (5, "plain")]
    got = M.repaired(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"] for r in got} == {4} and got[0]["restored"] == CLEAN[0]
    assert M.repaired(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("meant, wrong, text", [("cp1252", "mac_roman", CLEAN[0]), ("cp1252", "cp850", CLEAN[0]), ("cp1251", "cp1252", CLEAN[2])])
def test_a_garbled_text_that_is_a_third_of_all_rows_is_found(spark, meant, wrong, text):
    import random

    draw, words = random.Random(1), " ".join(CLEAN).split()
    garbled = "".join(M._high(wrong)[b - 128] if b > 127 else chr(b) for b in text.encode(meant)) + " "
    clean = [(i, " ".join(draw.choices(words, k=60))) for i in range(400)]
    # Half of the copies are exact, the others differ in a number.
    copies = [(i, garbled * 20 + ("" if i % 2 else str(i))) for i in range(400, 600)]
    found = lambda rows: {r["doc_id"]: r["restored"] for r in M.repaired(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    got, once = found(clean + copies), found(clean + copies[1:2])
    assert set(got) == set(range(400, 600)) and set(once) == {401} and got[401] == once[401]


def test_a_garbled_source_does_not_make_itself_normal():
    from collections import Counter

    garbled = CLEAN[0].encode("cp1252").decode("mac_roman")
    counts = Counter()
    for t, n in [(CLEAN[0], 2000), (garbled, 1000)]:
        for a, b in M.words_of(t):
            counts.update({c: n for c in M.contexts(t[a:b])})
            counts.update({"+" + c: n for c in M.close_contexts(t[a:b])})
    assert M.Repairer(counts).repair(garbled)[1] >= 3 and M.Repairer(counts).repair(CLEAN[0])[1] == 0


OTHER = {
    "ja": "日本語のテキストです。文字化け", "zh": "你好世界", "ko": "안녕하세요 세계", "el": "Καλημέρα κόσμε, δοκιμή κειμένου", "tr": "Türkçe metin: ışık, şeker, ağaç", "he": "שלום עולם טקסט",
    "ar": "مرحبا بالعالم نص عربي", "pl": "Cześć żółw, zażółć gęślą jaźń", "cs": "Příliš žluťoučký kůň úpěl ďábelské ódy", "ru": "привет мир", "uk": "Привіт, світе їжак", "hu": "Árvíztűrő tükörfúrógép", "ro": "țară și oraș", "hi": "नमस्ते दुनिया", "th": "สวัสดีชาวโลก",
}


@pytest.mark.parametrize("wrong", ["latin-1", "cp1252"])
@pytest.mark.parametrize("lang", sorted(OTHER))
def test_other_scripts_are_restored_from_utf8(model, lang, wrong):
    text = OTHER[lang]
    garbled = "".join(M._high(wrong)[b - 128] if b > 127 else chr(b) for b in text.encode())
    assert M.Repairer(model).repair(garbled)[0] == text


@pytest.mark.parametrize("lang", sorted(OTHER))
def test_other_writing_is_left_alone(model, lang):
    assert M.Repairer(model).repair(OTHER[lang]) == (OTHER[lang], 0, 0, [])


@pytest.mark.parametrize("lang, meant, wrong", [("pl", "cp1250", "cp1252"), ("cs", "cp1250", "cp1252"), ("hu", "cp1250", "latin-1"), ("tr", "cp1254", "cp1252"), ("el", "cp1253", "cp1252"), ("he", "cp1255", "latin-1")])
def test_what_cannot_be_restored_is_not_changed_into_other_text(model, lang, meant, wrong):
    garbled = OTHER[lang].encode(meant, "ignore").decode(wrong, "ignore")
    assert M.Repairer(model).repair(garbled)[0] in (garbled, OTHER[lang])


def test_a_step_to_utf8_needs_a_drop(model):
    # An accent before a closing quote is a sequence by accident.
    for text in ("« L’ÉTÉ”", "NAÏ”", "RÉ»"):
        assert M.Repairer(model).repair(text)[1] == 0


def test_many_layers_end(model):
    once = lambda t: "".join(M._high("latin-1")[b - 128] if b > 127 else chr(b) for b in t.encode())
    text = "größte"
    for _ in range(8):
        text = once(text)
    assert M.Repairer(model).repair(text)[0] == "größte"


def test_contexts_are_bounded_by_scripts():
    words = ["".join(chr(0x4E00 + (i * 7 + j) % 20000) for j in range(5)) for i in range(3000)]
    assert len({c for w in words for c in M.contexts(w)}) < 10
