"""Number reading in Korean and Japanese: arithmetic and look-ups, no loops, so whole-stage code generation holds."""

from __future__ import annotations

from voxweave.functions.dialect import Spark

DIGITS_KO = ["", "일", "이", "삼", "사", "오", "육", "칠", "팔", "구"]
DIGITS_JA = ["", "一", "二", "三", "四", "五", "六", "七", "八", "九"]
KANA = ["", "イチ", "ニ", "サン", "ヨン", "ゴ", "ロク", "ナナ", "ハチ", "キュウ"]
ONES = ["", "하나", "둘", "셋", "넷", "다섯", "여섯", "일곱", "여덟", "아홉"]
ONES_COUNT = ["", "한", "두", "세", "네", "다섯", "여섯", "일곱", "여덟", "아홉"]
TENS = ["", "열", "스물", "서른", "마흔", "쉰", "예순", "일흔", "여든", "아흔"]
UNITS_KO, UNITS_JA, UNITS_KANA = ["경", "조", "억", "만"], ["京", "兆", "億", "万"], ["ケイ", "チョウ", "オク", "マン"]
#: Sound changes of the Japanese hundreds and thousands (fixed values).
HUNDREDS_KANA = ["", "ヒャク", "ニヒャク", "サンビャク", "ヨンヒャク", "ゴヒャク", "ロッピャク", "ナナヒャク", "ハッピャク", "キュウヒャク"]
THOUSANDS_KANA = ["", "セン", "ニセン", "サンゼン", "ヨンセン", "ゴセン", "ロクセン", "ナナセン", "ハッセン", "キュウセン"]
MINUTES = ["ジュップン", "イップン", "ニフン", "サンプン", "ヨンプン", "ゴフン", "ロップン", "ナナフン", "ハップン", "キュウフン"]


def _dropped(digits: list[str], unit: str) -> list[str]:
    return ["", unit, *(d + unit for d in digits[2:])]


def _over(d: Spark, n: str, p: int) -> str:
    """The size of n, in whole units of p. The sign goes after the division, so that the least bigint needs no wider type."""
    return f"abs(({n}) div {p})" if d.name == "spark" else f"(abs(cast({n} as hugeint)) // {p})"


def _reading(d: Spark, n: str, tables: list[list[str]], units: list[str], zero: str, minus: str, bare: bool) -> str:
    """tables: thousands, hundreds, tens, ones. bare: a leading 1 before the lowest unit is not said."""
    def four(g: str) -> str:
        return "concat(" + ", ".join(d.at(d.array(t), f"{d.div(g, p)} % 10 + 1") for t, p in zip(tables, (1000, 100, 10, 1))) + ")"

    said = []
    for unit, p in zip(units, (10**16, 10**12, 10**8, 10**4)):
        g = f"cast({_over(d, n, p)} % 10000 as int)"
        one = f"when {_over(d, n, p)} = 1 then '{unit}'" if bare and p == 10**4 else ""
        said.append(f"case {one} when {g} = 0 then '' else concat({four(g)}, '{unit}') end")
    said.append(four(f"cast(abs(({n}) % 10000) as int)"))
    return f"case when {n} = 0 then '{zero}' else concat(case when {n} < 0 then '{minus}' else '' end, {', '.join(said)}) end"


def sino(d: Spark, n: str) -> str:
    t = [_dropped(DIGITS_KO, u) for u in "천백십"] + [DIGITS_KO]
    return _reading(d, n, t, UNITS_KO, "영", "마이너스 ", True)


def kanji(d: Spark, n: str) -> str:
    t = [_dropped(DIGITS_JA, u) for u in "千百十"] + [DIGITS_JA]
    return _reading(d, n, t, UNITS_JA, "零", "マイナス", False)


def katakana(d: Spark, n: str) -> str:
    t = [THOUSANDS_KANA, HUNDREDS_KANA, _dropped(KANA, "ジュウ"), KANA]
    return _reading(d, n, t, UNITS_KANA, "ゼロ", "マイナス", False)


def decimal_reading(d: Spark, text: str) -> str:
    """text: a decimal number in plain notation. The fraction is read digit by digit."""
    whole = f"cast(substring({text}, case when {text} like '-%' then 2 else 1 end, instr(concat({text}, '.'), '.') - case when {text} like '-%' then 2 else 1 end) as bigint)"
    digits = d.map(d.chars(f"substring({text}, instr(concat({text}, '.'), '.') + 1)"), "x", d.at(d.array(["영", *DIGITS_KO[1:]]), "cast(x as int) + 1"))
    return f"concat(case when {text} like '-%' then '마이너스 ' else '' end, {sino(d, whole)}, case when instr({text}, '.') > 0 then concat(' 점 ', {d.join(digits, '')}) else '' end)"


def _native(d: Spark, n: str, ones: list[str], most: int) -> str:
    own = f"concat({d.at(d.array(TENS), d.div(n, 10) + ' + 1')}, {d.at(d.array(ones), f'{n} % 10 + 1')})"
    return f"case when {n} = 20 then '스무' when {n} between 1 and {most} then {own} else {sino(d, n)} end"


def native(d: Spark, n: str) -> str:
    """Attributive native numerals for 1 to 59, as hours take them; else Sino-Korean."""
    return _native(d, n, ONES_COUNT, 59)


def native_count(d: Spark, n: str) -> str:
    return _native(d, n, ONES_COUNT, 99)


def minutes(d: Spark, n: str) -> str:
    """0 to 59; a full ten ends in the contracted form."""
    tens = d.at(d.array(["", "", "ニ", "サン", "ヨン", "ゴ"]), d.div(n, 10) + " + 1")
    lead = f"case when {n} < 10 then '' when {n} % 10 = 0 then {tens} else concat({tens}, 'ジュウ') end"
    return f"case when {n} = 0 then 'レイフン' else concat({lead}, {d.at(d.array(MINUTES), f'{n} % 10 + 1')}) end"
