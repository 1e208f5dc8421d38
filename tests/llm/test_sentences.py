import random

import numpy as np
import pytest

from corpusloom.llm import sentences as S


def cut(text, **k):
    return [text[a:b] for a, b in S.units(text, **k)]


@pytest.mark.parametrize(
    "sentences",
    [
        ["“We stopped early. The signal was clear,” wrote the lead.", "Dr. Foo re-ran it, i.e. about 7% of it.", "Really?!", "He moved to the U.S.", "Whether it held, e.g. in Zed, is open."],
        ['One called it "promising!" and another "premature."', "‘Not yet,’ said Ms. Bar, ‘but ask again in 2008.’", "Wait … was it blinded?", "pH stayed near 7.11 of 3.5."],
        ["Am 14. März 1995 begann sie, am 3. Mai endete sie.", "Der 2. Durchgang dauerte 2 Wochen!", "Es nahmen ca. 9 teil, u. a. aus X, vgl. Abb. 4.", "„Ist es so?“, fragte Prof. Hat."],
        ["L'art. 12 du protocole, révisé av. l'été, cite env. 5 cas.", "« Est-ce sûr ? » a demandé Mme Kive.", "Quel écart !"],
        ["¿Es sólido?", "La pág. 8, cap. 2, cita aprox. 5 casos.", "En EE. UU. y en Rilos, p. ej., no."],
        ["Учли вес, сон и т. д.", "В 2023 г. группа проф. Х. сравнила чай, т. е. с капсулой.", "«Так ли?» — спросил он."],
        ["لم يؤكد التحليل.", "هل يغير حقا؟", "قال د. A. إن القيمة 3.19."],
        ["कितना बड़ा अंतर है!", '"क्या पक्का है?" समीक्षक ने पूछा।', "डॉ. D. ने बताया।"],
    ],
)
def test_sentences_with_blanks_between(sentences):
    assert cut(" ".join(sentences)) == sentences
    assert cut("\n\n".join(sentences)) == sentences


@pytest.mark.parametrize(
    "sentences",
    [["“很早就停止了。信号很明显。”负责人写道。", "差别真大！！", "也许是年龄……也许只是偶然。", "数值上升（见图7）。"], ["値は上がった（図5を参照。）", "「確かですか？」と査読者が尋ねた。", "朝の光（Ver.2.12）の手順は公開済みである。"]],
)
def test_sentences_without_blanks(sentences):
    assert cut("".join(sentences)) == sentences


def test_thai_by_spaces():
    assert cut("ผู้วิจัยเชื่อว่าสาเหตุหลักคือฤดูกาล ผู้เข้าร่วมประมาณ 10% ออกจากการศึกษา ดร. J. รายงานว่าดี") == ["ผู้วิจัยเชื่อว่าสาเหตุหลักคือฤดูกาล", "ผู้เข้าร่วมประมาณ 10% ออกจากการศึกษา", "ดร. J. รายงานว่าดี"]


def test_headings_lists_and_wrapped_lines():
    text = "## Key findings\n\n1. First item.\n2. second item\n\nIII. Limits\n\nA line that\nwraps here. (A bracket of its own.)\n- one\n- two only\n"
    assert cut(text) == ["## Key findings", "1. First item.", "2. second item", "III. Limits", "A line that\nwraps here.", "(A bracket of its own.)", "- one", "- two only"]


def test_edges():
    assert S.units(None) == S.units("") == S.units(" \n ") == []
    assert cut("no end") == ["no end"]
    assert cut("😀 Hi there. Bye.") == ["😀 Hi there.", "Bye."]
    assert cut("He said “it never closed. And on it went.\n\nNext one.")[-1] == "Next one."


def test_composition_is_associative_and_the_scan_exclusive():
    rnd = np.random.default_rng(1)
    fs = [rnd.integers(0, 5, (len(S.KINDS), 5)) for _ in range(9)]
    assert (S.compose(S.compose(fs[0], fs[1]), fs[2]) == S.compose(fs[0], S.compose(fs[1], fs[2]))).all()
    whole = np.tile(np.arange(5), (len(S.KINDS), 1))
    for f, got in zip(fs, S.prefix_scan(fs), strict=True):
        assert got == whole[:, 0].tolist()
        whole = S.compose(whole, f)


@pytest.mark.parametrize("times", [1, 5, 40, 1500])
def test_a_quotation_is_one_unit_at_any_length(times):
    said = "“" + "We stopped early. It was clear (or so we thought. Then). " * times + "That was all,” wrote the lead."
    text = f"Before it. {said} After it."
    assert cut(text) == cut(text, piece=500) == ["Before it.", said, "After it."]


def test_numbered_items_far_apart_count_on():
    text = "1. First item\n" + "a wrapped line of it\n" * 60 + "2. Second item\n3. Third"
    assert len(cut(text)) == len(cut(text, piece=200)) == 3


def test_pieces_give_what_one_pass_gives(spark):
    rnd = random.Random(7)
    parts = ["“We stopped. It was clear,” wrote X.", "See Fig. 3 (in U.K. too. Yes).", "\n\n", "差别真大！！", "- item\n", " ", "One e.g. two. Three?", "‘No,’ he said.", "„Ja. Nein.“", "\"So. It. Is.\"", "“ open. And", "1. one\n2. two\n", "(a. “B. c” d.)"]
    texts = ["".join(rnd.choice(parts) + " " for _ in range(60)) for _ in range(12)]
    for t in texts:
        want = S.units(t, piece=10**9)
        for piece in (17, 100, 1000):
            assert S.units(t, piece=piece) == want
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(99, None, 0), (98, "", 0)], "doc_id long, text string, end int")
    got = {}
    for r in S.sentence_units(df, piece=300).collect():
        got.setdefault(r["doc_id"], set()).add((r["start_char"], r["end_char"]))
    assert got == {k: set(S.units(t)) for k, t in enumerate(texts)}
    assert S.sentence_units(df.filter("false")).count() == 0
