import pytest

from corpusloom.llm import truncation as T

BODY = "Interviews with retired miners suggest that smoking status mattered more than cold showers itself. A second team in Kaevork could not reproduce the finding with 4747 adults and older people. "


@pytest.mark.parametrize(
    ("end", "verdict"),
    [
        ("All was well.", T.WHOLE), ("Is that enough?", T.WHOLE), ("“It is not a cure.”", T.WHOLE), ("(Reviewed by F. Name)", T.WHOLE), ("Becau…", T.CUT), ("and then...", T.CUT), ("Interview [...]", T.CUT),
        ("the estimate &#82", T.CUT), ("Drop-out in (n =", T.CUT), ("Drop-out in the Dr.", T.CUT), ("the finding ca.", T.CUT), ("claims of 1.", T.OPEN), ("enrolled, says E.", T.CUT), ("It held 3 L.", T.WHOLE),
        ("In 1995, 14 further rev", T.OPEN), ("\n\nFurther reading", T.OPEN), ("\n- adults only", T.OPEN), ("See also https://a.example/b", T.OPEN), ("the foll�", T.CUT),
    ],
)
def test_closing(end, verdict):
    assert T.closing(BODY + end)[0] == verdict


def test_blank_texts_are_whole():
    assert T.closing(None)[0] == T.closing("")[0] == T.closing("  \n")[0] == T.WHOLE


def test_alignment():
    assert T.aligned(" on the", " on the scale of Titraex. The end came.") == T.CUT
    assert T.aligned(" the sca", " the scale of Titraex. The end came.") == T.CUT
    assert T.aligned(" of Titraex", " of Titraex. The end came.") == T.CUT
    assert T.aligned(" of Titraex", " of Titraex\nThe end came.") == T.WHOLE
    assert T.aligned(" of Titraex...", " of Titraex. The end came.") == T.CUT
    assert T.aligned(" reached 38.", " reached 38.5% in all, at") == T.CUT
    assert T.aligned(" of Titraex.", " of Titraex and the end came.") == T.WHOLE
    assert T.aligned(" reading vs.", " speed was low") == T.OPEN
    assert T.aligned(" Titraex vs.", " Titraex vs." + T.END) == T.OPEN
    assert T.aligned("\n\nFurther reading", " Further reading of it shows") == T.OPEN
    assert T.aligned("", " more") == T.OPEN


def test_a_cut_copy_is_found_however_much_is_missing(spark):
    whole = " ".join(f"word{k} of" for k in range(300)) + " all."
    rows = [(1, whole[: len(whole) // 10]), (2, whole), (3, whole[: len(whole) // 2].rsplit(" ", 1)[0])]
    df = spark.createDataFrame(rows, "row_id long, text string")
    assert {(r["row_id"], r["cut"], r["branch"]) for r in T.judged(df).collect()} == {(1, True, "copy"), (3, True, "copy")}


def test_answers_do_not_depend_on_unrelated_rows(spark):
    rows = [(k, f"Study {k} of site w{k} ran. {BODY}\n\nFurther reading") for k in range(4)] + [(10, BODY + "Nothing else was measured in")]
    more = [(1000 + k, f"Row {k} says {k * 7} and nothing more about q{k}.") for k in range(3000)]
    df = spark.createDataFrame(rows, "row_id long, text string")
    large = spark.createDataFrame(rows + more, "row_id long, text string")
    assert {r[0] for r in T.truncated(df).collect()} == {r[0] for r in T.truncated(large).collect()} == {10}


def test_a_number_after_which_decimals_follow_as_a_rule_was_cut(spark):
    rows = [(k, f"In site w{k} the ratio was {k}.{k + 3} for q{k}. It took years until {10 + k}. Then all ended.") for k in range(1, 9)]
    rows += [(20, "Apart from these, in the last of all sites that we had, the ratio was 3."), (21, "Apart from these, in the first of all the others it took some time until 38.")]
    df = spark.createDataFrame(rows, "row_id long, text string")
    assert {r[0] for r in T.truncated(df).collect()} == {20}


def test_found_over_a_table(spark):
    rows = [(k, f"Study {k} of site w{k} ran. {BODY}\n\nFurther reading") for k in range(6)]
    rows += [(10, BODY + "Nothing else was measured in"), (11, BODY + "See also https://a.example/b"), (12, BODY + "Done."), (13, None), (14, ""), (15, BODY + "\n- adults only")]
    # a copy shows that what looks like a whole number was cut
    rows += [(20, BODY + "Drop-out in the Rukeis arm reached 38."), (21, BODY + "Drop-out in the Rukeis arm reached 38.5% in all.")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "row_id long, text string, segment string")
    assert {r["row_id"] for r in T.truncated(df).collect()} == {10, 20}
    assert T.truncated(df.filter("false")).count() == 0
