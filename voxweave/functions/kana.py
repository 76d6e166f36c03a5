"""Katakana to Latin letters and IPA, and the sound changes between a numeral and its counter."""

from __future__ import annotations

from voxweave.functions.dialect import Spark, lit
from voxweave.functions.numerals import KANA
from voxweave.functions.scripts import ROMAJI

SMALL = {"ャ": "a", "ュ": "u", "ョ": "o"}
#: Consonants whose IPA is not their letter (fixed values of standard transcription).
IPA = {"sh": "ɕ", "ch": "tɕ", "ts": "ts", "j": "dʑ", "f": "ɸ", "y": "j", "r": "ɾ", "g": "ɡ", "h": "h"}
PALATAL_H = "ç"


def _joined(latin: str, vowel: str) -> str:
    """キ + small ャ is kya, シ + small ャ is sha."""
    stem = latin[:-1]
    return stem + vowel if stem in ("sh", "ch", "j") else stem + "y" + vowel


def syllables() -> dict[str, str]:
    """Every mora and its Latin letters, contracted ones among them; made from the plain table by rule."""
    pairs = {k + s: _joined(v, a) for k, v in ROMAJI.items() if len(v) > 1 and v.endswith("i") for s, a in SMALL.items()}
    return ROMAJI | pairs


def ipa_of(latin: str) -> str:
    if latin == "n":
        return "ɴ"
    stem, vowel = latin[:-1], latin[-1].replace("u", "ɯ")
    if stem.endswith("y") and stem[:-1]:
        return (PALATAL_H if stem == "hy" else IPA.get(stem[:-1], stem[:-1]) + "ʲ") + vowel
    if latin == "hi":
        return PALATAL_H + vowel
    return IPA.get(stem, stem) + vowel


TOKENS = "ッ?[ァ-ヲガ-ポヴ][ャュョ]?ー?|[^ァ-ヲガ-ポヴ]"


def _case(d: Spark, x: str, table: dict[str, str]) -> str:
    return f"case {x} " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in table.items()) + f" else {x} end"


def _spelt(d: Spark, text: str, table: dict[str, str], twice: str, long: str) -> str:
    """Each mora by the table; `twice` is what ッ before m gives, `long` what ー after m gives."""
    own = "replace(replace(x, 'ッ', ''), 'ー', '')"
    each = d.let("m", _case(d, own, table), f"concat(case when x like 'ッ_%' then {twice} else '' end, m, case when x like '_%ー' then {long} else '' end)")
    return d.join(d.map(d.find(text, TOKENS), "x", each), "")


def romaji(d: Spark, text: str) -> str:
    """Hepburn letters; ッ doubles the consonant (t before ch) and ー repeats the vowel. Other characters stay."""
    return _spelt(d, text, syllables(), "case when m like 'ch%' then 't' else substring(m, 1, 1) end", "substring(m, length(m), 1)")


def ipa(d: Spark, text: str) -> str:
    """Broad IPA: ー is length, ッ the first sound held. Vowels that follow one another are not merged."""
    return _spelt(d, text, {k: ipa_of(v) for k, v in syllables().items()}, "substring(m, 1, 1)", "'ː'")


#: What 1, 3, 6, 8 and 10 do before a counter of each row of the syllabary (fixed values of standard grammar).
SHORT = {1: "イッ", 6: "ロッ", 8: "ハッ", 10: "ジュッ"}
TO_P = dict(zip("ハヒフヘホ", "パピプペポ"))
TO_B = dict(zip("ハヒフヘホ", "バビブベボ"))
#: Counters after whose 3 the sound is p, not b.
P_AFTER_THREE = ("フン",)
#: Counters after whose 3 the first sound is voiced.
VOICED_AFTER_THREE = {"カイ(階)": "ガイ", "ゲン": "ゲン"}
COUNTERS = {"本": "ホン", "匹": "ヒキ", "杯": "ハイ", "分": "フン", "回": "カイ", "個": "コ", "冊": "サツ", "歳": "サイ", "頭": "トウ", "枚": "マイ", "台": "ダイ", "番": "バン", "階": "カイ(階)"}


def counted(n: int, counter: str) -> str:
    """Katakana of 1 to 10 and a counter."""
    lead, said = (KANA[n] if n < 10 else "ジュウ"), counter.partition("(")[0]
    first = said[0]
    if first in TO_P and n in SHORT:
        return SHORT[n] + TO_P[first] + said[1:]
    if first in TO_P and n == 3:
        return lead + (TO_P if counter in P_AFTER_THREE else TO_B)[first] + said[1:]
    if first in TO_P and n == 4 and counter in P_AFTER_THREE:
        return lead + TO_P[first] + said[1:]
    if n == 3 and counter in VOICED_AFTER_THREE:
        return lead + VOICED_AFTER_THREE[counter]
    if first in "カキクケコ" and n in SHORT or first in "サシスセソタチツテト" and n in (1, 8, 10):
        return SHORT[n] + said
    return lead + said


def counter_liaison(d: Spark, n: str, counter: str) -> str:
    """n from 1 to 10 (else null) and a counter in kanji (others: null)."""
    rows = " ".join(f"when {lit(k)} then {d.at(d.array(counted(i, v) for i in range(1, 11)), f'least(greatest({n}, 1), 10)')}" for k, v in COUNTERS.items())
    return f"case when {n} between 1 and 10 then case {counter} {rows} end end"
