"""Amounts stated in texts, converted to the common unit of their dimension.

An Aho-Corasick automaton holds every unit alias behind each way a number can
end before it, so one pass over a text finds all aliases that stand near a
number (`iter_long`: the longest alias wins). The number is then read leftwards
from the alias: decimal comma or point by the sentence's language, thousands
groups, fractions, powers of ten, scale words, spelled-out numbers, both ends of
a range. Where an alias stands alone ("Dose (mg): 5", "All amounts are given in
grams."), the bare numbers it governs take it. Conversion factors are joined in
as a broadcast table: `unit_factors` is fixed at a few dozen rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Context, Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Aliases by unit of `unit_factors`. SHORT ones count only next to a number or in brackets.
ALIASES = {
    "micrograms": "µg μg ug mcg microgram micrograms microgramme microgrammes microgramo microgramos Mikrogramm",
    "milligrams": "mg milligram milligrams milligramme milligrammes miligramo miligramos Milligramm",
    "grams": "g gram grams gramme grammes gramo gramos Gramm",
    "kilograms": "kg kilogram kilograms kilogramme kilogrammes kilogramo kilogramos Kilogramm kilo kilos Kilo",
    "ounces": "oz ounce ounces onza onzas once onces Unze Unzen oz.",
    "pounds": "lb lbs pound pounds libra libras livre livres Pfund lb. lbs.",
    "millilitres": "ml mL millilitre millilitres milliliter milliliters mililitro mililitros Milliliter cc",
    "centilitres": "cl cL centilitre centilitres centiliter centiliters centilitro centilitros Zentiliter",
    "litres": "l L litre litres liter liters litro litros Liter",
    "fluid ounces": "fl_oz fl._oz fl._oz. fl_oz. floz fluid_ounce fluid_ounces",
    "millimetres": "mm millimetre millimetres millimeter millimeters milímetro milímetros millimètre millimètres Millimeter",
    "centimetres": "cm centimetre centimetres centimeter centimeters centímetro centímetros centimètre centimètres Zentimeter",
    "metres": "m metre metres meter meters metro metros mètre mètres Meter Metern",
    "kilometres": "km kilometre kilometres kilometer kilometers kilómetro kilómetros kilomètre kilomètres Kilometer Kilometern",
    "inches": "in in. inch inches pulgada pulgadas pouce pouces Zoll",
    "feet": "ft ft. foot feet pie pies pied pieds Fuß",
    "miles": "mi mile miles milla millas Meile Meilen",
    "kilojoules": "kJ kilojoule kilojoules kilojulio kilojulios Kilojoule",
    "megajoules": "MJ megajoule megajoules megajulio megajulios mégajoule mégajoules Megajoule",
    "kilocalories": "kcal Cal kilocalorie kilocalories kilocaloría kilocalorías Kilokalorie Kilokalorien",
    "degrees Celsius": "°C °_C ℃ degrees_Celsius degree_Celsius degrees_C grados_Celsius grado_Celsius degrés_Celsius degré_Celsius Grad_Celsius degrees_centigrade",
    "degrees Fahrenheit": "°F °_F ℉ degrees_Fahrenheit degree_Fahrenheit degrees_F grados_Fahrenheit degrés_Fahrenheit Grad_Fahrenheit",
    "kelvin": "K kelvin kelvins Kelvin",
    "kilobits per second": "kbps kbit/s kb/s kilobits_per_second kilobit_per_second kilobits_por_segundo kilobits_par_seconde Kilobit_pro_Sekunde",
    "megabits per second": "Mbps Mbit/s Mb/s megabits_per_second megabit_per_second megabits_por_segundo mégabits_par_seconde megabits_par_seconde Megabit_pro_Sekunde",
    "gigabits per second": "Gbps Gbit/s Gb/s gigabits_per_second gigabit_per_second gigabits_por_segundo gigabits_par_seconde Gigabit_pro_Sekunde",
    "megabytes per second": "MB/s MByte/s MBps megabytes_per_second megabyte_per_second megabytes_por_segundo mégaoctets_par_seconde megaoctets_par_seconde Mo/s Megabyte_pro_Sekunde",
    "millimetres of mercury": "mmHg mm_Hg millimetres_of_mercury millimeters_of_mercury millimètres_de_mercure milímetros_de_mercurio Millimeter_Quecksilbersäule Millimeter_Quecksilber",
    "kilopascals": "kPa kilopascal kilopascals kilopascales Kilopascal",
}
DIMENSION = dict.fromkeys(["micrograms", "milligrams", "grams", "kilograms", "ounces", "pounds"], "mass")
DIMENSION |= dict.fromkeys(["millilitres", "centilitres", "litres", "fluid ounces"], "volume")
DIMENSION |= dict.fromkeys(["millimetres", "centimetres", "metres", "kilometres", "inches", "feet", "miles"], "length")
DIMENSION |= dict.fromkeys(["kilojoules", "megajoules", "kilocalories"], "energy")
DIMENSION |= dict.fromkeys(["degrees Celsius", "degrees Fahrenheit", "kelvin"], "temperature")
DIMENSION |= dict.fromkeys([u for u in ALIASES if u.endswith("per second")], "data_rate")
DIMENSION |= dict.fromkeys(["millimetres of mercury", "kilopascals"], "pressure")
#: A larger unit and the smaller one that continues it in one amount ("5 ft 10 in").
COMPOSED = {("pounds", "ounces"), ("feet", "inches"), ("kilograms", "grams"), ("litres", "millilitres"), ("kilometres", "metres"), ("metres", "centimetres")}

#: Characters before a unit in which its number, in digits or words, is read.
WINDOW = 240
SPACE = " \u00a0\u202f\u2009"
SCALES = {"thousand": 1000, "mil": 1000, "mille": 1000, "Tausend": 1000, "tausend": 1000, "million": 10**6, "millions": 10**6, "Millionen": 10**6, "millones": 10**6}
FRACTIONS = {"½": "0.5", "¼": "0.25", "¾": "0.75", "⅓": "0.3333333333", "⅔": "0.6666666667", "⅛": "0.125", "⅜": "0.375", "⅝": "0.625", "⅞": "0.875", "⅕": "0.2", "⅖": "0.4", "⅗": "0.6", "⅘": "0.8"}
SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
ONES = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(20), strict=True))
TENS = dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10), strict=True))
OTHER = {
    "null": 0, "ein": 1, "eine": 1, "einen": 1, "einem": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9, "zehn": 10, "elf": 11, "zwölf": 12, "zwanzig": 20, "dreißig": 30, "vierzig": 40, "fünfzig": 50, "hundert": 100, "einhundert": 100, "zweihundert": 200, "dreihundert": 300, "vierhundert": 400, "fünfhundert": 500, "sechshundert": 600,
    "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9, "dix": 10, "onze": 11, "douze": 12, "quinze": 15, "vingt": 20, "trente": 30, "quarante": 40, "cinquante": 50, "cent": 100,
    "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "doce": 12, "quince": 15, "veinte": 20, "treinta": 30, "cuarenta": 40, "cincuenta": 50, "cien": 100, "doscientos": 200, "trescientos": 300, "cuatrocientos": 400, "quinientos": 500, "seiscientos": 600,
}
WORD = sorted([*ONES, *TENS, "hundred", "half", "a", "and", "quarter"], key=len, reverse=True)

_S = f"[{SPACE}]"
_NUM = (
    rf"(?:\d+(?:[.,]\d+)?[eE][+-]?\d+"
    rf"|(?:\d{{1,3}}(?:[\u00a0\u202f\u2009]\d{{3}})+(?:[.,]\d+)?|\d+(?:[.,]\d+)*|(?<![\d])[.,]\d+){_S}?[×x·*]{_S}?10(?:\^[-−+]?\d+|[⁰¹²³⁴⁵⁶⁷⁸⁹⁻]+)"
    rf"|(?:\d+{_S})?\d+/\d+"
    rf"|\d*{_S}?[{''.join(FRACTIONS)}]"
    rf"|\d{{1,3}}(?:[\u00a0\u202f\u2009]\d{{3}})+(?:[.,]\d+)?"
    rf"|\d+(?:[.,]\d+)*"
    rf"|(?<!\d)[.,]\d+)"
)
_SCALE = rf"(?:{_S}(?:{'|'.join(SCALES)}))?"
_SIGN = rf"(?:(?:minus|moins|menos){_S}|(?<![\d\w])[-−–])?"
#: A number, perhaps the end of a range, at the end of a window.
NUMBER = re.compile(
    rf"(?:(?P<lo>{_SIGN}{_NUM})(?:{_S}?[-–—−]{_S}?|{_S}(?:to|bis|à|a|hasta|through){_S}))?(?P<hi>(?:(?:minus|moins|menos){_S}|(?<![\d\w])[-−–])?{_NUM})(?P<scale>{_SCALE})$"
)
WORDS = re.compile(rf"(?<![\w-])((?:{'|'.join(WORD)})(?:(?:{_S}|-)(?:{'|'.join(WORD)}))*)(?P<scale>{_SCALE})$", re.I)
OTHERS = re.compile(rf"(?<![\w-])({'|'.join(sorted(OTHER, key=len, reverse=True))})$", re.I)
LANGS = {
    "en": re.compile(r"\b(?:the|of|and|was|were|is|in|with|at|for|each|to|per|daily|group|held|arm)\b", re.I),
    "de": re.compile(r"\b(?:der|die|das|und|war|bei|mit|pro|nahm|wurden|lag|jeweils|fasste|ein|nicht|von|täglich|um|sind|erhielt)\b", re.I),
    "fr": re.compile(r"\b(?:le|la|les|des|était|été|une|par|pas|et|aux|chez|jour|chaque|pour|du|ont|prenait|reçu)\b", re.I),
    "es": re.compile(r"\b(?:el|los|las|una|fue|por|con|del|y|día|diarios|era|para|se|tomó|recibió|cada)\b", re.I),
}
STOP = re.compile(r"[.!?…](?=[\s ]+[\[(“\"«¿¡]?[A-ZÀ-ÝÄÖÜ])|\n|\[(?=\.\.\.\])")
#: A sentence that says in which unit bare numbers after it are.
DECLARES = re.compile(r"(?:given in|reported in|stated in|expressed in|measured in|are in|is in|below are in|figures in|se expresan en|están en|se dan en|exprimée?s en|données en|sont en|sind in|in)[\s ]+$", re.I)
#: Sentences whose bare numbers are amounts.
GOVERNED = re.compile(r"\b(?:received?|drank|came to|storage was|stored|kept|measures?|measured|reached|took|given|got|ran|walked|weighed|gained|consumed|transport at|freezer|erhielt(?:en)?|bekam(?:en)?|trank(?:en)?|nahm(?:en)?|reçu|pris|bu|recibi(?:ó|eron)|tom(?:ó|aron)|bebi(?:ó|eron))\b", re.I)
#: What may follow a bare amount, and what shows that a number is no amount.
BARE_AFTER = re.compile(r"(?:\.(?!\d)|[,;)](?!\d)|$|[\s ]+(?:and|y|et|und|for|at|el|para|pour|für|but|in|per|a day|daily|versus|vs)\b|[\s ]*\n|[\s ]*\[|…)")
NOT_BARE = re.compile(r"(?:(?:\b(?:wrote in|écrit en|escribieron en|since|year|grade|phase|vol\.?|no\.|nos\.|p[.p]*|n|fig\.?|ratio was|of the|over|in)[\s ]*=?[\s ]*)|\([^)]*,[\s ])$", re.I)
BARE = re.compile(rf"(?<![\w.,/])(?:{_SIGN}){_NUM}(?:{_S}?[-–—]{_S}?{_NUM}|{_S}(?:to|bis|à|a){_S}{_NUM})?(?![\w%/])")
IN_AFTER = re.compile(rf"\.|{_S}(?:in|on|from|of|at|before|after|deep|long|wide|tall|high|each|per|overall|and){_S}|[,;)\n]|$")


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    ends = [*"0123456789", *FRACTIONS, *"⁰¹²³⁴⁵⁶⁷⁸⁹"]
    gaps = ["", *SPACE, "-", "‑"]
    for unit, names in ALIASES.items():
        for name in names.split():
            for form in {name.replace("_", s) for s in " \u00a0\u202f"}:
                for end in ends:
                    for gap in gaps:
                        found.add_word(end + gap + form, (unit, len(form), "near"))
                for scale in SCALES:
                    for gap in SPACE:
                        found.add_word(scale + gap + form, (unit, len(form), "near"))
                        if scale in ("mil", "mille"):  # else "8 mi" of "8 mil mg" would match first
                            for end in ends[:10]:
                                for before in SPACE[:3]:
                                    found.add_word(end + before + scale + gap + form, (unit, len(form), "near"))
                for opening, closing in ("()", "[]"):
                    found.add_word(f"{opening}{form}{closing}", (unit, len(form) + 1, "label"))
                for gap in SPACE:
                    found.add_word(f",{gap}{form}/", (unit, len(form) + 1, "label"))
                    for word in ("in", "en"):
                        for stop in (".", " throughout", " durchgehend", " angegeben", ";", ",", " unless"):
                            found.add_word(f" {word}{gap}{form}{stop}", (unit, len(form) + len(stop), "declared"))
                if len(form) > 4 and form[0].isalpha() and "." not in form:
                    for c in (form, form.lower()):
                        if c not in found:
                            found.add_word(c, (unit, len(form), "word"))
    found.make_automaton()
    return found


_AUTOMATON = None


def automaton():
    """The alias automaton, built once a Python worker."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = _automaton()
    return _AUTOMATON


def _language(sentence: str) -> str:
    scores = {lang: len(p.findall(sentence)) for lang, p in LANGS.items()}
    return max(scores, key=lambda k: scores[k])


def _plain(number: str, comma: bool) -> Decimal:
    """A numeral without exponent; `comma`: the decimal sign is the comma."""
    number = re.sub(f"[{SPACE}]", "", number)
    dot, com = number.count("."), number.count(",")
    if dot and com:
        decimal = "." if number.rfind(".") > number.rfind(",") else ","
    elif dot + com > 1:
        decimal = ""
    elif dot + com == 1:
        sep = "." if dot else ","
        head, _, tail = number.partition(sep)
        grouped = len(tail) == 3 and 1 <= len(head) <= 3 and head != "0"
        decimal = sep if not grouped or comma == (sep == ",") else ""
    else:
        decimal = ""
    number = "".join("." if c == decimal else "" if c in ".," else c for c in number)
    return Decimal(number)


def number(text: str, comma: bool) -> Decimal:
    """The value of a numeral as NUMBER takes it."""
    text = text.strip()
    sign = 1
    if m := re.match(rf"(?:minus|moins|menos){_S}|[-−–]", text):
        sign, text = -1, text[m.end() :].strip()
    if m := re.fullmatch(rf"(.+?){_S}?[×x·*]{_S}?10\^?(.+)", text):
        return sign * _plain(m[1], comma) * Decimal(10) ** int(m[2].translate(SUPER).replace("−", "-"))
    if m := re.fullmatch(r"(.+)[eE]([+-]?\d+)", text):
        return sign * _plain(m[1], comma) * Decimal(10) ** int(m[2])
    if m := re.fullmatch(rf"(?:(\d+){_S})?(\d+)/(\d+)", text):
        return sign * (Decimal(m[1] or 0) + (Decimal(m[2]) / Decimal(m[3]) if int(m[3]) else 0))
    if text[-1] in FRACTIONS:
        return sign * (Decimal(re.sub(r"\D", "", text[:-1]) or 0) + Decimal(FRACTIONS[text[-1]]))
    return sign * _plain(text, comma)


def spelled(words: str) -> Decimal | None:
    """ "two hundred and fifty" -> 250, "seven and a half" -> 7.5, None if it says no number."""
    total, part, seen = Decimal(0), Decimal(0), False
    parts = re.split(rf"{_S}|-", words.lower())
    for k, w in enumerate(parts):
        if w in ONES:
            part, seen = part + ONES[w], True
        elif w in TENS:
            part, seen = part + TENS[w], True
        elif w == "hundred":
            part, seen = (part or 1) * 100, True
        elif w in ("half", "quarter"):
            total, seen = total + Decimal("0.5" if w == "half" else "0.25"), True
        elif w == "a" and k + 1 < len(parts) and parts[k + 1] == "hundred":
            part = Decimal(1)
    return total + part if seen else None


def _bounds(text: str) -> list[int]:
    return [0, *(m.end() for m in STOP.finditer(text)), len(text)]


def _calm(text: str) -> str:
    """Runs in capitals made small, so that their units are read; offsets stay."""
    if not re.search(r"[^a-zà-ÿ]{24,}", text):
        return text
    return re.sub(r"(?:[^a-zà-ÿ\n]*[A-ZÀ-Ý]{4,}[^a-zà-ÿ\n]*){2,}", lambda m: m[0].lower() if len(m[0].lower()) == len(m[0]) else m[0], text)


_SMALL = {"mj": "megajoules", "kj": "kilojoules", "k": "kelvin", "°c": "degrees Celsius", "°f": "degrees Fahrenheit", "kpa": "kilopascals", "mmhg": "millimetres of mercury", "mm hg": "millimetres of mercury", "cal": "kilocalories", "mbit/s": "megabits per second", "gbit/s": "gigabits per second", "mbps": "megabits per second", "gbps": "gigabits per second", "mb/s": "megabytes per second", "mbyte/s": "megabytes per second"}


def amounts(text: str | None) -> list[tuple[str, Decimal, str | None, Decimal | None]]:
    """(unit, value, unit of a composed rest, its value) of each amount in `text`.

    None and texts without numbers give an empty list. Equal amounts come once.
    """
    if not text:
        return []
    calm = _calm(text)
    small = None
    if calm is not text and calm != text:
        small = re.compile(rf"(?<=\d){_S}?({'|'.join(map(re.escape, sorted(_SMALL, key=len, reverse=True)))})(?![\w])")
    out: list[tuple[int, int, str, list[Decimal]]] = []
    labels: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    edges: list[int] | None = None

    def sentence(at: int) -> tuple[int, int]:
        nonlocal edges
        if edges is None:
            edges = _bounds(calm)
        lo = max(e for e in edges if e <= at)
        hi = min((e for e in edges if e > at), default=len(calm))
        return lo, hi

    hits: list[tuple[int, int, str, str]] = []
    for end, (unit, length, kind) in automaton().iter_long(calm):
        stop = end + 1
        hits.append((stop - length, stop, unit, kind))
    if small:
        hits += [(m.start(1), m.end(1), _SMALL[m[1]], "near") for m in small.finditer(calm)]
        hits.sort()
    for start, stop, unit, kind in hits:
        after = calm[stop : stop + 12]
        if kind in ("label", "declared"):
            labels.append((start, stop, unit, kind))
            continue
        name = calm[start:stop]
        if name[-1].isalnum() and after[:1] and (after[0].isalpha() or (after[0].isdigit() and name[-1].isalpha())):
            continue
        if name == "in" and not (calm[start - 1].isdigit() and not after.startswith(" the")) and not IN_AFTER.match(after):
            continue
        if name in ("in.", "ft.", "oz.", "lb.") and not re.match(rf"{_S}|[,;)\]\n]|$", after):
            continue
        if kind == "near" and after[:1] == "/" and re.match(r"/(?:k?g|kcal|ml|l|dl)\b", after):
            pass
        gap = start
        while gap and calm[gap - 1] in SPACE + "-‑":
            gap -= 1
        if kind == "word" and not (gap and (calm[gap - 1].isalpha())):
            continue
        window = calm[max(0, gap - WINDOW) : gap]
        m = NUMBER.search(window)
        lo, hi = sentence(start)
        comma = _language(calm[lo:hi]) != "en" if m else False
        if m and not (m.start("hi") and re.match(r"[\w.,]", window[m.start("hi") - 1]) and not m["lo"] and window[m.start("hi")].isdigit()):
            scale = SCALES.get(m["scale"].strip(SPACE), 1)
            values = [number(m["hi"], comma) * scale]
            begin = gap - len(window) + m.start("hi")
            if m["lo"]:
                first = number(m["lo"], comma) * scale
                if abs(first) <= abs(values[0]) or first < values[0]:
                    values.insert(0, first)
                    begin = gap - len(window) + m.start("lo")
            out.append((begin, stop, unit, values))
            continue
        value = None
        if m := WORDS.search(window):
            value = spelled(m[1])
            if value is not None and m["scale"]:
                value *= SCALES[m["scale"].strip(SPACE)]
        elif m := OTHERS.search(window):
            value = Decimal(OTHER[m[1].lower()])
        if value is not None:
            out.append((gap - len(window) + m.start(1), stop, unit, [value]))
    for start, stop, unit, kind in labels:
        if kind == "label":
            rest = calm[stop + 1 : stop + 60] if calm[stop : stop + 1] in ")]" else calm[stop : stop + 60]
            shift = stop + (calm[stop : stop + 1] in (")", "]"))
            head = re.match(rf"(?:/\w+)?{_S}*(?:[:=]{_S}*|(?={_S}?[-−]?\d)){_S}*(?:(?:minus|moins|menos){_S}|[-−])?(?={_NUM})", rest) or (calm[start - 1] in "[" and re.match(rf"{_S}*", rest))
            lo, hi = sentence(start)
            if head and (n := re.match(rf"(?:(?:minus|moins|menos){_S}|[-−])?{_NUM}{_SCALE}(?:(?:{_S}?[–—-]{_S}?|{_S}(?:to|bis|à|a){_S}){_NUM}{_SCALE})?(?![\w%])", rest[re.match(rf"(?:/\w+)?{_S}*[:=]?{_S}*", rest).end() :])):
                ends = _ends(n[0], _language(calm[lo:hi]) != "en")
                out.append((shift, shift + 1, unit, ends))
                continue
            taken.append((stop, hi))
            if not re.search(r"[%]", calm[stop:hi]):
                for n in BARE.finditer(calm, stop, hi):
                    if BARE_AFTER.match(calm, n.end()) and not NOT_BARE.search(calm[max(0, n.start() - 24) : n.start()]):
                        out.append((n.start(), n.end(), unit, _ends(n[0], _language(calm[lo:hi]) != "en")))
        else:
            lo, hi = sentence(start)
            if not DECLARES.search(calm[max(lo, start - 20) : start]) or re.search(r"\d", calm[lo:start]):
                continue
            # it holds for the sentences up to the next declaration or blank line
            section = calm.find("\n\n", hi)
            until = min([len(calm) if section < 0 else section, *(x[0] for x in labels if x[3] == "declared" and x[0] > stop)])
            at = hi
            while at < until:
                a, b = sentence(at)
                body = calm[a:b]
                if GOVERNED.search(body) and "%" not in body and not any(a <= o[0] < b for o in out):
                    comma = _language(body) != "en"
                    got = []
                    for n in BARE.finditer(calm, a, b):
                        if NOT_BARE.search(calm[max(a, n.start() - 24) : n.start()]):
                            continue
                        if not BARE_AFTER.match(calm, n.end()):
                            got = []
                            break
                        got.append((n.start(), n.end(), unit, _ends(n[0], comma)))
                    out += got
                if b <= at:
                    break
                at = b
    out.sort(key=lambda o: o[:2])
    seen: dict[tuple, None] = {}
    k = 0
    while k < len(out):
        begin, stop, unit, values = out[k]
        if k + 1 < len(out) and len(values) == 1:
            b2, s2, u2, v2 = out[k + 1]
            if (unit, u2) in COMPOSED and len(v2) == 1 and b2 >= stop and re.fullmatch(rf"[{SPACE},]{{0,2}}(?:and{_S})?", calm[stop:b2]):
                seen[(unit, values[0], u2, v2[0])] = None
                k += 2
                continue
        for v in values:
            seen[(unit, v, None, None)] = None
        k += 1
    return list(seen)


def _ends(text: str, comma: bool) -> list[Decimal]:
    m = NUMBER.search(text)
    if not m:
        return []
    scale = SCALES.get((m["scale"] or "").strip(SPACE), 1)
    return [number(x, comma) * scale for x in (m["lo"], m["hi"]) if x]


_SCHEMA = "row_id long, unit string, value decimal(38,8), unit2 string, value2 decimal(38,8)"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, limit, step = pa.decimal128(38, 8), Decimal(10) ** 29, Decimal("0.00000001")
    wide = Context(prec=60)
    names = ["row_id", "unit", "value", "unit2", "value2"]
    types = [pa.int64(), pa.string(), kind, pa.string(), kind]
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for unit, value, unit2, value2 in amounts(text):
                if max(abs(value), abs(value2 or 0)) < limit:  # beyond it no unit's milli amount is a long
                    rows.append((key, unit, value.quantize(step, context=wide), unit2, None if value2 is None else value2.quantize(step, context=wide)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def stated_amounts(chunks: DataFrame, factors: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """Distinct (row_id, dimension, unit, common_unit, amount_milli) of every amount stated in `text`.

    amount_milli is 1000 times the value in the common unit, rounded half up. Null
    and empty texts, and texts without an amount, give no row; a null key is kept;
    repeated rows give one; an amount whose thousandfold is no long gives none. Only `key` and `text` are read, so further columns, of
    whatever name, do not matter. `factors` (dimension, unit, common_unit, factor,
    shift) is broadcast: a fixed table of a few dozen units.
    """
    small = F.broadcast(factors.select("unit", "dimension", "common_unit", F.col("factor").cast("decimal(17,8)").alias("f"), F.col("shift").cast("decimal(17,8)").alias("s")))
    rest = F.broadcast(factors.select(F.col("unit").alias("unit2"), F.col("factor").cast("decimal(17,8)").alias("f2")))
    found = chunks.select(F.col(key).cast("long").alias("row_id"), F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull() & (F.col("text") != "")).mapInArrow(_extract, _SCHEMA)
    exact = F.col("value").try_cast("decimal(20,8)") * F.col("f") + F.coalesce(F.col("value2").try_cast("decimal(20,8)") * F.col("f2"), F.lit(0).cast("decimal(37,16)")) + F.col("s")
    large = F.col("value").try_cast("decimal(31,2)") * F.col("f").cast("decimal(15,8)") + F.coalesce(F.col("value2").try_cast("decimal(20,8)") * F.col("f2"), F.lit(0).cast("decimal(37,16)"))
    milli = lambda x: F.floor(x.try_cast("decimal(34,9)") * 1000 + F.expr("0.5BD"))
    amount = F.when(F.abs("value") < 10**11, milli(exact)).otherwise(F.floor(large.try_cast("decimal(32,3)") * 1000 + F.expr("0.5BD"))).try_cast("long")
    joined = found.join(small, "unit").join(rest, "unit2", "left").select("row_id", "dimension", "unit", "common_unit", amount.alias("amount_milli"))
    return joined.filter("amount_milli is not null").distinct()


def p1_found(chunks: DataFrame, factors: DataFrame) -> DataFrame:
    """row_id, dimension, amount_milli: distinct amounts of the pool chunks."""
    return stated_amounts(chunks, factors).select("row_id", "dimension", "amount_milli").distinct()
