"""The Korean rule chain: each rule sees one boundary between syllables, so the whole chain is one look-up a boundary.

`boundary` applies the rules in order to a final, an initial and a vowel. Its results over all
combinations make one constant array, and a text is transcribed by one pass over its syllables. Choices
that need parts of speech are made by the rules named in `phonology`.
"""

from __future__ import annotations

from functools import cache

from voxweave.functions.dialect import Spark, lit
from voxweave.functions.scripts import CODA, FINAL, INITIAL, MEDIAL
from voxweave.functions.text import dictionary

TENSE = dict(zip("ㄱㄷㅂㅅㅈ", "ㄲㄸㅃㅆㅉ"))
ASPIRATE = dict(zip("ㄱㄷㅂㅈ", "ㅋㅌㅍㅊ"))
NASAL = dict(zip("ㄱㄷㅂ", "ㅇㄴㅁ"))
#: Finals of two letters: the one that stays and the one that moves.
SPLIT = {"ㄳ": "ㄱㅅ", "ㄵ": "ㄴㅈ", "ㄶ": "ㄴㅎ", "ㄺ": "ㄹㄱ", "ㄻ": "ㄹㅁ", "ㄼ": "ㄹㅂ", "ㄽ": "ㄹㅅ", "ㄾ": "ㄹㅌ", "ㄿ": "ㄹㅍ", "ㅀ": "ㄹㅎ", "ㅄ": "ㅂㅅ"}
VOWELS = ["ㅣ", "ㅕ"]  # before these ㄷ and ㅌ turn to ㅈ and ㅊ; all others are one class
HEARD = dict(zip(FINAL, CODA))


def h_rules(f: str, i: str, m: str) -> tuple[str, str]:
    """ㅎ merges with a plain stop, or is not heard."""
    stay, last = SPLIT.get(f, ("", f))
    if last == "ㅎ":
        if i in ASPIRATE:
            return stay, ASPIRATE[i]
        if i == "ㅅ":
            return stay, "ㅆ"
        if i == "ㄴ":
            return stay or "ㄴ", i
        return (stay, i) if i == "ㅇ" or stay else ("ㄷ", i)
    if i == "ㅎ" and f:
        if last == "ㅈ":
            return stay, "ㅊ"
        if last == "ㄷ" and m == "ㅣ":
            return stay, "ㅊ"
        if f in ("ㄺ", "ㄼ", "ㄵ"):
            return stay, ASPIRATE[last]
        if HEARD[f] in ASPIRATE:
            return "", ASPIRATE[HEARD[f]]
    return f, i


def palatalization(f: str, i: str, m: str) -> tuple[str, str]:
    stay, last = SPLIT.get(f, ("", f))
    if i == "ㅇ" and m in VOWELS and last in "ㄷㅌ" and last:
        return stay, {"ㄷ": "ㅈ", "ㅌ": "ㅊ"}[last]
    return f, i


def tensification(f: str, i: str, m: str) -> tuple[str, str]:
    """After a stop, and after the stem finals ㄵ ㄻ ㄼ ㄾ; ㄺ before ㄱ keeps its ㄹ."""
    if i in TENSE and f == "ㄺ" and i == "ㄱ":
        return "ㄹ", TENSE[i]
    if i in TENSE and (HEARD[f] in NASAL or f in ("ㄵ", "ㄻ", "ㄼ", "ㄾ")):
        return f, TENSE[i]
    return f, i


def liaison(f: str, i: str, m: str) -> tuple[str, str]:
    if i != "ㅇ" or f in ("", "ㅇ"):
        return f, i
    stay, last = SPLIT.get(f, ("", f))
    return stay, TENSE[last] if stay and last == "ㅅ" else last


def neutralization(f: str, i: str, m: str) -> tuple[str, str]:
    return HEARD[f], i


def assimilation(f: str, i: str, m: str) -> tuple[str, str]:
    if i == "ㄹ" and f in ("ㄱ", "ㄷ", "ㅂ", "ㅁ", "ㅇ"):
        i = "ㄴ"
    if i in ("ㄴ", "ㅁ") and f in NASAL:
        f = NASAL[f]
    if (f, i) in (("ㄴ", "ㄹ"), ("ㄹ", "ㄴ")):
        return "ㄹ", "ㄹ"
    return f, i


RULES = [h_rules, palatalization, tensification, liaison, neutralization, assimilation]


def boundary(f: str, i: str, m: str) -> tuple[str, str]:
    """The final and the next initial as they are heard; m is the vowel after them."""
    for rule in RULES:
        f, i = rule(f, i, m)
    return f, i


@cache
def tables() -> tuple[list[int], list[int]]:
    """(finals, initials) by (final * 19 + initial) * 3 + class of the vowel."""
    heard = [boundary(f, i, m) for f in FINAL for i in INITIAL for m in ("", *VOWELS)]
    return [FINAL.index(f) for f, _ in heard], [INITIAL.index(i) for _, i in heard]


#: Readings that no boundary shows (fixed values of standard pronunciation): ㄴ is added before 육 in numerals
#: and 역 (station), and ㄹ of a numeral makes the unit after it tense.
N_ADDITION = [("([십백천만억])육", "\\1뉵"), ("서울역", "서울녁")]
NUMERAL_TENSE = [(f"([십백천만][일칠팔]){a}", f"\\1{b}") for a, b in ("도또", "세쎄", "시씨", "점쩜", "조쪼")]
#: Compounds (fixed values, the examples of the standard pronunciation rules 26, 28 and 29): before the part after the
#: dot ㄴ is added, or its first consonant is tense.
ADDED_N = "솜·이불 홑·이불 막·일 삯·일 맨·입 꽃·잎 내복·약 한·여름 남존·여비 신·여성 색·연필 직행·열차 늑막·염 콩·엿 담·요 눈·요기 영업·용 식용·유 백분·율 밤·윷 솔·잎 설·익다 물·약 불·여우 물·엿 휘발·유 유들·유들"
TENSED = "문·고리 눈·동자 신·바람 산·새 손·재주 길·가 물·동이 발·바닥 굴·속 술·잔 바람·결 그믐·달 아침·밥 초승·달 등·불 창·살 강·줄기 갈·등 발·동 말·살 불·소 갈·증 물·질 발·전 몰·상식 불·세출"
#: Words that sound so only beside others.
IDIOMS = {"물가 상승": "물까 상승", "대가를 치": "대까를 치"}
#: Words whose first vowel is long (fixed values of the standard dictionary).
LONG = ("사람", "말씀", "눈보라", "많다", "없다", "대학", "전화", "세상", "영원", "건강", "회의", "예산")
#: The particle 의 at the end of a word of two or more syllables, and 의 inside a word.
PARTICLE = [("([가-힣])의([^가-힣]|$)", "\\1에\\2"), ("([가-힣])의", "\\1이")]


def _lead(c: str, change: dict[str, str]) -> str:
    """The syllable with its initial consonant changed."""
    n = ord(c) - 44032
    return chr(44032 + 588 * INITIAL.index(change[INITIAL[n // 588]]) + n % 588)


@cache
def lexicon() -> dict[str, str]:
    """Words whose spelling is changed before the rules see it."""
    out = dict(IDIOMS)
    for words, change in ((ADDED_N, {"ㅇ": "ㄴ"}), (TENSED, TENSE)):
        for a, b in (w.split("·") for w in words.split()):
            out[a + b] = a + _lead(b[0], change) + b[1:]
    return out


def loanword_span(d: Spark, text: str, start: str, end: str, words: tuple[str, ...]) -> str:
    """Whether the code points from start (from 0) to end (exclusive) are a word of the set; null text gives null."""
    return f"(substring({text}, cast({start} + 1 as int), cast({end} - ({start}) as int)) in ({', '.join(map(lit, words)) or 'null'}))"


def lengthened(d: Spark, word: str, heard: str) -> str:
    """heard with ':' after its first syllable where the word begins with one of LONG."""
    return f"case when {d.like(word, '^(' + '|'.join(LONG) + ')')} then concat(substring({heard}, 1, 1), ':', substring({heard}, 2)) else {heard} end"


def rewrite(d: Spark, text: str, rules: list[tuple[str, str]]) -> str:
    for pattern, by in rules:
        text = d.sub(text, pattern, by)
    return text


def phonology(d: Spark, text: str) -> str:
    """text as it is heard. Null gives null; whatever is not a syllable stays, and no rule crosses it.

    Read by rule, as no parts of speech are known: 의 at the end of a word is the particle; ㄺ before ㄱ
    is a stem's; ㄴ is added, and consonants are tense, only where N_ADDITION and the lexicon say so.
    """
    prepared = rewrite(d, dictionary(d, text, lexicon()), PARTICLE + N_ADDITION + NUMERAL_TENSE)
    finals, initials = map(d.array, tables())
    at = lambda k: f"coalesce({d.at('a', k)}, ' ')"
    before = f"case when k = 1 then ' ' else {at('greatest(k - 1, 1)')} end"
    after = f"case when k = {d.size('a')} then ' ' else {at('least(k + 1, ' + d.size('a') + ')')} end"
    hangul = lambda c: f"{d.cp(c)} between 44032 and 55203"
    number = lambda c: f"({d.cp(c)} - 44032)"
    vowel = lambda c: f"case {d.div(number(c), 28)} % 21 {' '.join(f'when {MEDIAL.index(v)} then {n}' for n, v in enumerate(VOWELS, 1))} else 0 end"
    key = lambda left, right: f"({number(left)} % 28 * 19 + {d.div(number(right), 588)}) * 3 + {vowel(right)} + 1"
    coda = d.at(d.array([FINAL.index(x) for x in CODA]), f"{number('c.x')} % 28 + 1")
    own = f"case when {hangul('c.n')} then {d.at(finals, key('c.x', 'c.n'))} else {coda} end"
    lead = f"case when {hangul('c.p')} then {d.at(initials, key('c.p', 'c.x'))} else {d.div(number('c.x'), 588)} end"
    said = f"case when {hangul('c.x')} then {d.chr(f'44032 + 588 * ({lead}) + {number("c.x")} % 588 - {number("c.x")} % 28 + ({own})')} else c.x end"
    triples = d.map(d.upto(d.size("a")), "k", d.struct(x=at("k"), p=before, n=after))
    whole = d.join(d.map(triples, "c", said), "")
    return d.let("a", d.chars(prepared), f"case when {d.size('a')} = 0 then '' else {whole} end")
