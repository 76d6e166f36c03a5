"""Normalization, tokenizer classes, spans and prosody as SQL text."""

from __future__ import annotations

import re

from voxweave.functions import numerals
from voxweave.functions.dialect import Spark, lit

WORD_OR_MARK = "[A-Za-z0-9À-ɏ぀-ヿ가-힣]+|[!-/:-@\\[-`{-~、。]"
UNITS = {"km": "킬로미터", "kg": "킬로그램", "cm": "센티미터", "m": "미터", "g": "그램", "달러": "달러", "원": "원", "개": "개"}
NATIVE_UNITS = ("개", "명", "마리", "시", "번")
#: What 번 is a number of, not a count: before these it takes Sino-Korean numerals.
NUMBERED = ("번 버스", "번 출구", "번 국도", "번 홈", "번 선수")
HETERONYMS = {"the": "NONE", "that": "TENS", "with": "NONE", "for": "TENS"}
BREAKS = {"P1": "weak", "P2": "medium", "P3": "strong"}
PAUSE_MS = {"P1": 70, "P2": 200, "P3": 500}


def whitespace(d: Spark, x: str) -> str:
    return f"trim({d.sub(x, '[ \\t\\n\\r]+', ' ')})"


def symbols(d: Spark, x: str) -> str:
    return d.sub(d.sub(d.sub(f"translate({x}, '“”‘’…·', '\"\"' || chr(39) || chr(39) || '. ')", "[*#~^|]+", " "), "%", " 퍼센트"), "&", " 앤드 ")


def camel(d: Spark, x: str) -> str:
    return d.sub(x, "([a-z])([A-Z])", "\\1 \\2")


def xml(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def unit_reading(d: Spark, n: str, unit: str) -> str:
    """A count and its unit: native numerals before native counters, Sino-Korean before others."""
    said = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in UNITS.items())
    natives = ", ".join(map(lit, NATIVE_UNITS))
    return f"concat(case when {unit} in ({natives}) then {numerals.native_count(d, n)} else {numerals.sino(d, n)} end, case {unit} {said} else {unit} end)"


def dictionary(d: Spark, x: str, table: dict[str, str]) -> str:
    """x with every entry replaced in one pass from left to right, the longest entry first; nothing is replaced twice.

    Entries are taken as plain text; an empty table or text changes nothing, null gives null.
    """
    if not table:
        return x
    keys = sorted(table, key=lambda k: (-len(k), k))
    plain = lambda k: re.sub(r"[^\w ]", lambda m: "\\x27" if m[0] == "'" else "\\" + m[0], k)
    found, heads = "|".join(map(plain, keys)), "".join(plain(c) for c in sorted({k[0] for k in keys}))
    own = "case x " + " ".join(f"when {lit(k)} then {lit(table[k])}" for k in keys) + " else x end"
    return d.join(d.map(d.find(x, f"{found}|[^{heads}]+|(?s:.)"), "x", own), "")


def by_case(d: Spark, x: str, exact: dict[str, str], upper: dict[str, str]) -> str:
    """The reading of a word: its exact entry, else that of its upper-case form, else the word."""
    whens = lambda t: " ".join(f"when {lit(k)} then {lit(v)}" for k, v in t.items())
    return f"coalesce(case {x} {whens(exact)} end, case upper({x}) {whens(upper)} end, {x})"


def apply_spans(d: Spark, x: str, spans: str) -> str:
    """x with spans replaced. spans: an array of (s, e, r), code points from 0 with exclusive ends, in order and without overlap."""
    n = d.size("v")
    last = f"case when k > 1 then {d.at('v', 'greatest(k - 1, 1)')}.e else 0 end"
    pieces = d.map(d.upto(n), "k", f"concat(substring({x}, cast({last} + 1 as int), cast({d.at('v', 'k')}.s - {last} as int)), {d.at('v', 'k')}.r)")
    tail = f"substring({x}, cast({d.at('v', n)}.e + 1 as int))"
    return d.let("v", spans, f"case when {n} = 0 then {x} else concat({d.join(pieces, '')}, {tail}) end")


def numbers(d: Spark, x: str) -> str:
    """x with its numbers read in Korean: native before native counters, else Sino-Korean; over 18 digits, or with a leading 0, digit by digit."""
    units = sorted([*UNITS, *NATIVE_UNITS, *NUMBERED], key=lambda u: (-len(u), u))
    unit = "regexp_extract(x, '[^0-9.]*$', 0)"
    digits = "regexp_extract(x, '^[0-9]+', 0)"
    part = "regexp_extract(x, '[.]([0-9]+)', 1)"
    n = f"cast({digits} as bigint)"
    one_by_one = lambda t: d.join(d.map(d.chars(t), "y", d.at(d.array(["영", *numerals.DIGITS_KO[1:]]), "cast(y as int) + 1")), "")
    natives = ", ".join(map(lit, NATIVE_UNITS))
    whole = f"case when length({digits}) > 18 or ({digits} like '0%' and length({digits}) > 1) then {one_by_one(digits)} when {unit} in ({natives}) and {part} = '' then {numerals.native_count(d, n)} else {numerals.sino(d, n)} end"
    said = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in UNITS.items())
    own = f"case when {d.like('x', '^[0-9]')} then concat({whole}, case when {part} = '' then '' else concat(' 점 ', {one_by_one(part)}) end, case {unit} {said} else {unit} end) else x end"
    return d.join(d.map(d.find(x, f"[0-9]+([.][0-9]+)?({'|'.join(units)})?|[^0-9]+"), "x", own), "")


def normalize_ko(d: Spark, x: str) -> str:
    """Symbols, then numbers and units, then words of mixed case, then blanks."""
    return whitespace(d, camel(d, numbers(d, symbols(d, x))))


#: Endings that close a sentence (EF) or join clauses (EC), and particles (JX, JKB); the first that fits is taken.
ENDINGS = {"EF": "(니다|니까|어요|아요|해요|네요|세요|다|까)[.!?]?$", "EC": "(고|며|면서|지만|는데|니까|아서|어서|해서|면)$", "JKB": "(에서|에게|에|으로|로|와|과)$", "JX": "(은|는|도|만|까지|부터)$"}

#: A run of words up to the first that closes a sentence, by the same rule as pause; for Spark's regular expressions only.
SENTENCE = "(?=[^ \\t\\n\\r])(?s:.*?)(?:[.!?]|" + ENDINGS["EF"].removesuffix("[.!?]?$") + ")(?=[ \\t\\n\\r]|\\z)|(?=[^ \\t\\n\\r])(?s:.+)"


def ending(d: Spark, word: str) -> str:
    """The label of a word's ending by its last syllables; NONE if no rule fits."""
    return "case " + " ".join(f"when {d.like(word, p)} then '{k}'" for k, p in ENDINGS.items()) + " else 'NONE' end"


def pause(d: Spark, word: str) -> str:
    """The pause after a word: P3 at the end of a sentence, P2 after a comma or a joining ending, P1 after 은 and 는, else NONE."""
    closes, joins = "[.!?]$|" + ENDINGS["EF"], "[,;:]$|" + ENDINGS["EC"]  # EF goes before EC, as in ending()
    return f"case when {d.like(word, closes)} then 'P3' when {d.like(word, joins)} then 'P2' when {d.like(word, '(은|는)$')} then 'P1' else 'NONE' end"


def restored(d: Spark, word: str) -> str:
    """The word with a full stop where a sentence ends without a mark."""
    return f"concat({word}, case when {pause(d, word)} = 'P3' and not {d.like(word, '[.!?]$')} then '.' else '' end)"
