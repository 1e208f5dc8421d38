from decimal import Decimal

import pytest

from corpusloom.operators import units

FACTORS = [
    ("mass", "milligrams", "mg", 1.0, 0.0), ("mass", "grams", "mg", 1000.0, 0.0), ("mass", "pounds", "mg", 453592.37, 0.0), ("mass", "ounces", "mg", 28349.523125, 0.0),
    ("mass", "micrograms", "mg", 0.001, 0.0), ("temperature", "degrees Fahrenheit", "degC", 0.555556, -17.777778), ("energy", "kilocalories", "kJ", 4.184, 0.0), ("volume", "litres", "mL", 1000.0, 0.0),
]


def found(text):
    return [(u, float(v), u2, None if v2 is None else float(v2)) for u, v, u2, v2 in units.amounts(text)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("They took 3.5 mg daily.", [("milligrams", 3.5)]),
        ("A 3-mg capsule was used.", [("milligrams", 3)]),
        ("Täglich 1.700 kJ waren es bei der Gruppe.", [("kilojoules", 1700)]),
        ("La ingesta fue de 1,5 g por día.", [("grams", 1.5)]),
        ("From 2–10 degrees Celsius in the room.", [("degrees Celsius", 2), ("degrees Celsius", 10)]),
        ("Kept at −24.7 °C for the day.", [("degrees Celsius", -24.7)]),
        ("At minus 6 °C it froze.", [("degrees Celsius", -6)]),
        ("Held 3.9×10⁴ ug of it.", [("micrograms", 39000)]),
        ("Held 8 × 10^2 mL of it.", [("millilitres", 800)]),
        ("Sent at 3.3e3 kbps to the site.", [("kilobits per second", 3300)]),
        ("It held 1¼ g and 4 1/2 litres of it.", [("grams", 1.25), ("litres", 4.5)]),
        ("She took two hundred and fifty grams and seven and a half ounces.", [("grams", 250), ("ounces", 7.5)]),
        ("Er nahm zwei Gramm pro Tag.", [("grams", 2)]),
        ("Tomó 68 mil mg al día.", [("milligrams", 68000)]),
        ("Dose (mg): 93.8.", [("milligrams", 93.8)]),
        ("Serving size [g] 45.", [("grams", 45)]),
        ("Daily dose, ug/day = 2,680.", [("micrograms", 2680)]),
        ("Doses (ounces) were fixed in advance: 1.7 for the second arm and 3.8 for controls.", [("ounces", 1.7), ("ounces", 3.8)]),
        ("Fluid volumes are reported in litres throughout. Controls drank 4 and the early arm 5.", [("litres", 4), ("litres", 5)]),
        ("Waist size shrank by 6 in in the late arm.", [("inches", 6)]),
        ("Of the 412, 38 in the early arm withdrew after 5 weeks at 36%.", []),
        ("A 4G modem and 500 IU in Grade 4 lessons, p = 0.03.", []),
        ("THE ARM TOOK 65 MG OF CHICORY EVERY SINGLE DAY OF THE WEEK.", [("milligrams", 65)]),
        ("", []),
        (None, []),
        ("no amounts here", []),
    ],
)
def test_amounts(text, expected):
    assert [(u, v) for u, v, _, _ in found(text)] == expected


def test_composed_amount_is_one():
    assert found("Over the year they lost 4 pounds 6 ounces.") == [("pounds", 4.0, "ounces", 6.0)]
    assert found("He covered 5 ft 2 in on foot.") == [("feet", 5.0, "inches", 2.0)]


def test_equal_amounts_count_once_and_long_texts_are_read_whole():
    text = "They took 5 mg. " * 3 + "filler words here. " * 40_000 + "The end was 7 g."
    assert [(u, v) for u, v, _, _ in found(text)] == [("milligrams", 5), ("grams", 7)]


def test_number_styles():
    assert units.number("1,642.1", False) == Decimal("1642.1")
    assert units.number("1.663", True) == Decimal(1663)
    assert units.number("1.663", False) == Decimal("1.663")
    assert units.number("7,5", True) == Decimal("7.5")
    assert units.number("1 200", True) == Decimal(1200)


def test_conversion_rounding_nulls_and_clashing_columns(spark):
    factors = spark.createDataFrame(FACTORS, "dimension string, unit string, common_unit string, factor double, shift double")
    rows = [(1, "took 2.5 µg", "x"), (2, "4 pounds 6 ounces", "x"), (3, "at 50 °F", "x"), (3, "at 50 °F", "x"), (4, None, "x"), (5, "", None), (None, "1 g", "x")]
    chunks = spark.createDataFrame(rows, "row_id long, text string, unit string")
    got = {tuple(r) for r in units.p1_found(chunks, factors).collect()}
    assert got == {(1, "mass", 3), (2, "mass", round((4 * 453592.37 + 6 * 28349.523125) * 1000 + 1e-6)), (3, "temperature", 10000), (None, "mass", 1_000_000)}
    assert units.p1_found(chunks.filter("false"), factors).count() == 0


def test_large_amounts_come_out(spark):
    factors = spark.createDataFrame(FACTORS, "dimension string, unit string, common_unit string, factor double, shift double")
    chunks = spark.createDataFrame([(1, "It held 1000000000000 mg of it."), (2, "It held 250,000,000,000 mg and 3 × 10^12 ug of it."), (3, "It held 4e35 mg of it."), (4, "It held 9e17 g of it.")], "row_id long, text string")
    got = {tuple(r) for r in units.p1_found(chunks, factors).collect()}
    assert got == {(1, "mass", 10**15), (2, "mass", 250_000_000_000_000), (2, "mass", 3 * 10**12)}


def test_a_declared_unit_holds_to_the_end_of_its_section():
    text = "Fluid volumes are reported in litres throughout. Controls drank 4 and the early arm 5. It was warm. Nobody knew why. It stayed so. The late arm drank 7 in all.\n\nThe others drank 9."
    assert [(u, v) for u, v, _, _ in found(text)] == [("litres", 4), ("litres", 5), ("litres", 7)]
