"""Hangul, kana and Latin scripts: arithmetic on code points and look-up tables."""

from __future__ import annotations

from voxweave.functions.dialect import Spark

INITIAL = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
MEDIAL = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINAL = ["", *"ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"]
#: The coda each final is heard as at the end of a word, and IPA values (public linguistics).
CODA = ["", *"ㄱㄱㄱㄴㄴㄴㄷㄹㄱㅁㄹㄹㄹㅂㄹㅁㅂㅂㄷㄷㅇㄷㄷㄱㄷㅂㄷ"]
IPA_INITIAL = ["k", "k͈", "n", "t", "t͈", "ɾ", "m", "p", "p͈", "s", "s͈", "", "tɕ", "t͈ɕ", "tɕʰ", "kʰ", "tʰ", "pʰ", "h"]
IPA_MEDIAL = ["a", "ɛ", "ja", "jɛ", "ʌ", "e", "jʌ", "je", "o", "wa", "wɛ", "we", "jo", "u", "wʌ", "we", "wi", "ju", "ɯ", "ɰi", "i"]
IPA_CODA = {"": "", "ㄱ": "k̚", "ㄴ": "n", "ㄷ": "t̚", "ㄹ": "l", "ㅁ": "m", "ㅂ": "p̚", "ㅇ": "ŋ"}
JAMO_NAMES = {"ㄱ": "기역", "ㄴ": "니은", "ㄷ": "디귿", "ㄹ": "리을", "ㅁ": "미음", "ㅂ": "비읍", "ㅅ": "시옷", "ㅇ": "이응", "ㅈ": "지읒", "ㅊ": "치읓", "ㅋ": "키읔", "ㅌ": "티읕", "ㅍ": "피읖", "ㅎ": "히읗"}
LETTER_NAMES = ["에이", "비", "씨", "디", "이", "에프", "지", "에이치", "아이", "제이", "케이", "엘", "엠", "엔", "오", "피", "큐", "아르", "에스", "티", "유", "브이", "더블유", "엑스", "와이", "제트"]
HIRAGANA = "".join(chr(c) for c in range(0x3041, 0x3097))
KATAKANA = "".join(chr(c + 0x60) for c in range(0x3041, 0x3097))
ROMAJI = {"ア": "a", "イ": "i", "ウ": "u", "エ": "e", "オ": "o", "カ": "ka", "キ": "ki", "ク": "ku", "ケ": "ke", "コ": "ko", "サ": "sa", "シ": "shi", "ス": "su", "セ": "se", "ソ": "so", "タ": "ta", "チ": "chi", "ツ": "tsu", "テ": "te", "ト": "to", "ナ": "na", "ニ": "ni", "ヌ": "nu", "ネ": "ne", "ノ": "no", "ハ": "ha", "ヒ": "hi", "フ": "fu", "ヘ": "he", "ホ": "ho", "マ": "ma", "ミ": "mi", "ム": "mu", "メ": "me", "モ": "mo", "ヤ": "ya", "ユ": "yu", "ヨ": "yo", "ラ": "ra", "リ": "ri", "ル": "ru", "レ": "re", "ロ": "ro", "ワ": "wa", "ヲ": "o", "ン": "n", "ガ": "ga", "ギ": "gi", "グ": "gu", "ゲ": "ge", "ゴ": "go", "ザ": "za", "ジ": "ji", "ズ": "zu", "ゼ": "ze", "ゾ": "zo", "ダ": "da", "デ": "de", "ド": "do", "バ": "ba", "ビ": "bi", "ブ": "bu", "ベ": "be", "ボ": "bo", "パ": "pa", "ピ": "pi", "プ": "pu", "ペ": "pe", "ポ": "po"}


def syllable(d: Spark, c: str) -> str:
    """The number of a Hangul syllable, or null."""
    return f"case when {d.cp(c)} between 44032 and 55203 then {d.cp(c)} - 44032 end"


def parts(d: Spark, c: str) -> tuple[str, str, str]:
    s = f"({d.cp(c)} - 44032)"
    return d.div(s, 588), d.div(f"{s} % 588", 28), f"({s} % 28)"


def compose(d: Spark, i: str, m: str, f: str) -> str:
    return d.chr(f"44032 + 588 * ({i}) + 28 * ({m}) + ({f})")


def per_char(d: Spark, text: str, change: str, is_hangul: bool = True) -> str:
    """text with `change` (of c) in place of each syllable."""
    own = f"case when {d.cp('c')} between 44032 and 55203 then {change} else c end"
    return d.join(d.map(d.chars(text), "c", own if is_hangul else change), "")


def neutral(d: Spark, text: str) -> str:
    """Each final consonant as it is heard before a pause."""
    i, m, f = parts(d, "c")
    coda = d.at(d.array([FINAL.index(x) for x in CODA]), f"{f} + 1")
    return per_char(d, text, compose(d, i, m, coda))


def ipa(d: Spark, text: str) -> str:
    i, m, f = parts(d, "c")
    return per_char(d, text, f"concat({d.at(d.array(IPA_INITIAL), i + ' + 1')}, {d.at(d.array(IPA_MEDIAL), m + ' + 1')}, {d.at(d.array([IPA_CODA[x] for x in CODA]), f + ' + 1')})")


def lookup(d: Spark, text: str, table: dict[str, str]) -> str:
    case = " ".join(f"when '{k}' then '{v}'" for k, v in table.items())
    return per_char(d, text, f"case c {case} else c end", False)


def letters(d: Spark, text: str) -> str:
    return per_char(d, text, f"case when {d.cp('c')} between 65 and 90 then {d.at(d.array(LETTER_NAMES), d.cp('c') + ' - 64')} when {d.cp('c')} between 97 and 122 then {d.at(d.array(LETTER_NAMES), d.cp('c') + ' - 96')} else c end", False)


def pairs(d: Spark, text: str, change) -> str:
    """text with each syllable changed by its neighbours: change(index of the syllable) gives SQL; neighbours beyond the ends are ''."""
    arr = d.chars(text)
    idx = f"sequence(1, length({text}))" if d.name == "spark" else f"range(1, length({text}) + 1)"
    at = lambda k: f"case when {k} between 1 and length({text}) then substring({text}, cast({k} as int), 1) else '' end"
    return f"case when length({text}) = 0 then '' else {d.join(d.map(idx, 'k', change(d, at('k'), at('k - 1'), at('k + 1'))), '')} end" if arr else text


def _f(d: Spark, c: str) -> str:
    return f"case when {c} <> '' and {d.cp(c)} between 44032 and 55203 then ({d.cp(c)} - 44032) % 28 else -1 end"


def _i(d: Spark, c: str) -> str:
    return f"case when {c} <> '' and {d.cp(c)} between 44032 and 55203 then {d.div(f'{d.cp(c)} - 44032', 588)} else -1 end"


#: Single finals that move, and the initial they become.
MOVES = {f: INITIAL.index(x) for f, x in enumerate(FINAL) if x and x in INITIAL and x not in "ㅇㅎ"}


def liaison(d: Spark, text: str) -> str:
    """A single final moves to a following syllable that begins with ㅇ; it does not cross a blank."""
    moves = d.array([MOVES.get(f, -1) for f in range(28)])

    def change(d: Spark, c: str, before: str, after: str) -> str:
        gone = f"({_f(d, c)}) in ({', '.join(map(str, MOVES))}) and ({_i(d, after)}) = 11"
        came = f"({_i(d, c)}) = 11 and ({_f(d, before)}) in ({', '.join(map(str, MOVES))})"
        cp = f"{d.cp(c)} - case when {gone} then {_f(d, c)} else 0 end + case when {came} then 588 * ({d.at(moves, f'greatest({_f(d, before)}, 0) + 1')} - 11) else 0 end"
        return f"case when ({_f(d, c)}) < 0 then {c} else {d.chr(cp)} end"

    return pairs(d, text, change)


def nasal(d: Spark, text: str) -> str:
    """A stop coda before ㄴ or ㅁ becomes the nasal of its place."""
    to = [FINAL.index({"ㄱ": "ㅇ", "ㄷ": "ㄴ", "ㅂ": "ㅁ"}.get(x, y)) for x, y in zip(CODA, FINAL)]

    def change(d: Spark, c: str, before: str, after: str) -> str:
        cp = f"{d.cp(c)} - {_f(d, c)} + {d.at(d.array(to), f'greatest({_f(d, c)}, 0) + 1')}"
        return f"case when ({_f(d, c)}) > 0 and ({_i(d, after)}) in (2, 6) then {d.chr(cp)} else {c} end"

    return pairs(d, text, change)
