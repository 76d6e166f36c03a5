"""Japanese text to kana readings: dates, times, counters, numbers and letters inside text, then a dictionary; pitch marks."""

from __future__ import annotations

from collections.abc import Mapping

from voxweave.functions import kana, numerals, text
from voxweave.functions.dialect import Spark, lit

#: Readings of days, months, hours and letters (fixed values of standard Japanese). Days not named here are the number and ニチ.
DAYS = {1: "ツイタチ", 2: "フツカ", 3: "ミッカ", 4: "ヨッカ", 5: "イツカ", 6: "ムイカ", 7: "ナノカ", 8: "ヨウカ", 9: "ココノカ", 10: "トオカ", 14: "ジュウヨッカ", 17: "ジュウシチニチ", 19: "ジュウクニチ", 20: "ハツカ", 24: "ニジュウヨッカ", 27: "ニジュウシチニチ", 29: "ニジュウクニチ"}
MONTHS = {4: "シガツ", 7: "シチガツ", 9: "クガツ"}
HOURS = {0: "レイジ", 4: "ヨジ", 7: "シチジ", 9: "クジ", 14: "ジュウヨジ", 17: "ジュウシチジ", 19: "ジュウクジ", 24: "ニジュウヨジ"}
LETTERS = ["エー", "ビー", "シー", "ディー", "イー", "エフ", "ジー", "エイチ", "アイ", "ジェー", "ケー", "エル", "エム", "エヌ", "オー", "ピー", "キュー", "アール", "エス", "ティー", "ユー", "ブイ", "ダブリュー", "エックス", "ワイ", "ゼット"]
#: A small dictionary: word, reading, and the mora after which the pitch falls (0: it does not; standard Tokyo accent). Give a larger one as a parameter.
READINGS = {
    "東京": ("トウキョウ", 0),
    "京都": ("キョウト", 1),
    "大阪": ("オオサカ", 0),
    "日本": ("ニホン", 2),
    "昭和": ("ショウワ", 0),
    "平成": ("ヘイセイ", 0),
    "令和": ("レイワ", 0),
    "今日": ("キョウ", 1),
    "天気": ("テンキ", 1),
    "学校": ("ガッコウ", 0),
    "先生": ("センセイ", 3),
    "開業": ("カイギョウ", 0),
    "休み": ("ヤスミ", 3),
    "雨": ("アメ", 1),
}


def morae(reading: str) -> list[str]:
    """Small vowels and glides belong to the mora before them; ッ, ー and ン are their own."""
    out: list[str] = []
    for c in reading:
        if c in "ァィゥェォャュョヮ" and out:
            out[-1] += c
        else:
            out.append(c)
    return out


def marked(reading: str, accent: int) -> str:
    """^ where the pitch rises and ] where it falls: before the first mora for accent 1, else after it; no fall for accent 0."""
    m = morae(reading)
    if not 0 <= accent <= len(m):
        raise ValueError(f"{reading} has {len(m)} morae, not {accent}")
    if accent == 1:
        return "^" + m[0] + "]" + "".join(m[1:])
    if not accent:
        return m[0] + ("^" + "".join(m[1:]) if m[1:] else "")
    return m[0] + "^" + "".join(m[1:accent]) + "]" + "".join(m[accent:])


def lookup(d: Spark, x: str, readings: Mapping[str, tuple[str, int]] = READINGS, pitch: bool = False) -> str:
    """x with the dictionary's words read, the longest first."""
    return text.dictionary(d, x, {k: marked(r, a) if pitch else r for k, (r, a) in readings.items()})


def _named(table: Mapping[int, str], unit: str) -> str:
    return "case n " + " ".join(f"when {k} then {lit(v)}" for k, v in table.items()) + f" else concat(r, '{unit}') end"


def units(d: Spark) -> dict[str, str]:
    """The reading with its unit; n is the number and r its plain reading. 1日 is a date, 1日中 and 1日間 are spans of time."""
    year = d.sub("r", "ヨン$", "ヨ")
    span = f"case when n = 1 then 'イチニチ' else {_named(DAYS, 'ニチ')} end"
    counters = {k: f"coalesce({kana.counter_liaison(d, 'n', lit(k))}, concat(r, {lit(v.partition('(')[0])}))" for k, v in kana.COUNTERS.items() if k != "分"}
    return {
        "年間": f"concat({year}, 'ネンカン')",
        "年": f"concat({year}, 'ネン')",
        "月": _named(MONTHS, "ガツ"),
        "日中": f"concat({span}, 'ジュウ')",
        "日間": f"concat({span}, 'カン')",
        "日": _named(DAYS, "ニチ"),
        "時間": f"concat({_named(HOURS, 'ジ')}, 'カン')",
        "時": _named(HOURS, "ジ"),
        "分": f"case when n between 0 and 59 then {numerals.minutes(d, 'n')} else concat(r, 'フン') end",
        "秒": "concat(r, 'ビョウ')",
        **counters,
    }


def numbers(d: Spark, x: str) -> str:
    """x with dates, times, counted things, plain numbers and Latin letters read. Over 18 digits, or a leading 0: digit by digit."""
    table = units(d)
    digits = "regexp_extract(x, '^[0-9]+', 0)"
    unit = "regexp_extract(x, '[^0-9]*$', 0)"
    one_by_one = d.join(d.map(d.chars(digits), "y", d.at(d.array(["ゼロ", *numerals.KANA[1:]]), "cast(y as int) + 1")), "")
    cases = " ".join(f"when '{k}' then {v}" for k, v in table.items())
    said = d.let("n", f"cast({digits} as bigint)", d.let("r", numerals.katakana(d, "n"), f"case {unit} {cases} else concat(r, {unit}) end"))
    letter = d.at(d.array(LETTERS), f"{d.cp('upper(x)')} - 64")
    own = f"case when {d.like('x', '^[A-Za-z]')} then {letter} when {d.like('x', '^[0-9]')} then case when length({digits}) > 18 or ({digits} like '0%' and length({digits}) > 1) then concat({one_by_one}, {unit}) else {said} end else x end"
    return d.join(d.map(d.find(x, f"[0-9]+({'|'.join(sorted(table, key=lambda k: (-len(k), k)))})?|[A-Za-z]|[^0-9A-Za-z]+"), "x", own), "")


def normalize_ja(d: Spark, x: str, readings: Mapping[str, tuple[str, int]] = READINGS, pitch: bool = False) -> str:
    """Dates and numbers, then the dictionary, then plain marks and blanks. Null gives null; kanji that no entry knows stay."""
    return text.whitespace(d, f"translate({lookup(d, numbers(d, x), readings, pitch)}, '、。！？（）　', ',.!?() ')")
