"""Every query that SQL can express, written once for both engines: name -> text over @tables.

Each runs over whole tables. Korean and Japanese inputs are derived from number and date columns.
"""

from __future__ import annotations

from collections.abc import Callable

from voxweave.functions import kana as J
from voxweave.functions import numerals as N
from voxweave.functions import phonology as P
from voxweave.functions import scripts as S
from voxweave.functions import text as T
from voxweave.functions.dialect import Spark, lit

PLANS: dict[str, Callable[[Spark], str]] = {}


def plan(f: Callable[[Spark], str]) -> Callable[[Spark], str]:
    PLANS[f.__name__] = f
    return f


def over(name: str, table: str, columns: str, **made: Callable[[Spark], str]) -> None:
    PLANS[name] = lambda d: f"select {columns}, " + ", ".join(f"{f(d)} {k}" for k, f in made.items()) + f" from @{table}"


def values(rows: list[tuple], names: str) -> str:
    return "(select * from (values " + ", ".join("(" + ", ".join("null" if x is None else lit(x) for x in r) + ")" for r in rows) + f") as v({names}))"


KEY = "cast(o_orderkey as bigint)"
over("num2words_sino", "orders", "o_orderkey", reading=lambda d: N.sino(d, KEY))
over("num2words_float", "customer", "c_custkey", reading=lambda d: N.decimal_reading(d, "cast(cast(c_acctbal as decimal(12,2)) as string)"))
over("native_numeral", "part", "p_partkey", reading=lambda d: N.native(d, "cast(p_size as bigint)"))
over("native_count", "part", "p_partkey", reading=lambda d: N.native_count(d, "cast(p_size * 2 as bigint)"))
over("int_to_ja", "orders", "o_orderkey", reading=lambda d: N.kanji(d, KEY))
over("int_to_kata", "orders", "o_orderkey", reading=lambda d: N.katakana(d, KEY))
DATED = lambda d: f"concat({N.sino(d, 'cast(year(o_orderdate) as bigint)')}, '년 ', {MONTH.format(N.sino(d, 'cast(month(o_orderdate) as bigint)'))}, '월 ', {N.sino(d, 'cast(day(o_orderdate) as bigint)')}, '일 서울의 날씨는 매우 맑고 기온은 ', {N.sino(d, 'cast(o_orderkey % 40 as bigint)')}, '도입니다.')"
over("phonology_ko", "orders", "o_orderkey", phonology=lambda d: P.phonology(d, DATED(d)))
over("ja_minutes", "events", "event_id", reading=lambda d: N.minutes(d, "cast(minute(ts) as bigint)"))
over("ja_datetime", "orders", "o_orderkey", reading=lambda d: f"concat({N.kanji(d, 'cast(year(o_orderdate) as bigint)')}, '年', {N.kanji(d, 'cast(month(o_orderdate) as bigint)')}, '月', {N.kanji(d, 'cast(day(o_orderdate) as bigint)')}, '日')")
over("ja_numbers", "customer", "c_custkey", reading=lambda d: f"concat('番号', {N.katakana(d, 'cast(c_custkey as bigint)')})")
over("ja_counter_liaison", "part", "p_partkey", reading=lambda d: J.counter_liaison(d, "(p_size % 10 + 1)", d.at(d.array(list(J.COUNTERS)), f"p_partkey % {len(J.COUNTERS)} + 1")))
over("ko_time_reading", "events", "event_id", reading=lambda d: f"concat(case when hour(ts) < 12 then '오전 ' else '오후 ' end, {N.native(d, 'cast((hour(ts) + 11) % 12 + 1 as bigint)')}, '시 ', {N.sino(d, 'cast(minute(ts) as bigint)')}, '분')")
MONTH = "case month(o_orderdate) when 6 then '유' when 10 then '시' else {} end"
over("ko_date_reading", "orders", "o_orderkey", reading=lambda d: f"concat({N.sino(d, 'cast(year(o_orderdate) as bigint)')}, '년 ', {MONTH.format(N.sino(d, 'cast(month(o_orderdate) as bigint)'))}, '월 ', {N.sino(d, 'cast(day(o_orderdate) as bigint)')}, '일')")
UNIT = "case l_linenumber % 4 when 0 then 'km' when 1 then '개' when 2 then '달러' else '번' end"
over("units_numbers", "lineitem", "l_orderkey, l_linenumber, l_partkey", reading=lambda d: T.unit_reading(d, "cast(l_quantity as bigint)", UNIT))
over("counter_label_rule", "lineitem", "l_orderkey, l_linenumber, l_partkey", label=lambda d: f"case when {UNIT} in ({', '.join(map(lit, T.NATIVE_UNITS))}) then 'native' else 'sino' end")
READ = "(select o_orderkey, {} w from @orders)"


def over_words(name: str, **made: Callable[[Spark], str]) -> None:
    PLANS[name] = lambda d: "select o_orderkey, " + ", ".join(f"{f(d)} {k}" for k, f in made.items()) + f" from {READ.format(N.sino(d, KEY))} q"


over_words("coda_neutralize", heard=lambda d: S.neutral(d, "w"))
over_words("hangul_ipa", ipa=lambda d: S.ipa(d, "w"))
over_words("liaison_simple", heard=lambda d: S.liaison(d, "w"))
over_words("nasal_assimilation", heard=lambda d: S.nasal(d, "w"))


@plan
def hangul_decompose(d: Spark) -> str:
    i, m, f = S.parts(d, "x")
    rows = d.explode(d.chars("w"), "o_orderkey", READ.format(N.sino(d, KEY)))
    kinds = f"select x, count(*) n from ({rows}) q where {d.cp('x')} between 44032 and 55203 group by x"  # at most 11,172, so the look-ups are few
    return f"select {d.at(d.array(S.INITIAL), i + ' + 1')} initial, {d.at(d.array(S.MEDIAL), m + ' + 1')} medial, {d.at(d.array(S.FINAL), f + ' + 1')} coda, cast(sum(n) as bigint) n from ({kinds}) k group by 1, 2, 3"


@plan
def hangul_compose(d: Spark) -> str:
    return f"select id, {S.compose(d, d.div('id', 588), d.div('id % 588', 28), 'id % 28')} syllable from {d.range(11172)} r"


@plan
def utf8_encode(d: Spark) -> str:
    """All code points but the surrogates and 0."""
    n = "case when id < 55295 then id + 1 else id + 2049 end"
    return f"select id, {d.chr(n)} c, {d.bytes(d.chr(n))} n_bytes from {d.range(1112063)} r"


@plan
def utf8_codepoints(d: Spark) -> str:
    return f"select cast({d.cp('x')} as bigint) cp, count(*) n, {d.bytes('x')} n_bytes from ({d.explode(d.chars('text'), 'doc_id', '@documents')}) q group by 1, 3"


@plan
def char_class_counts(d: Spark) -> str:
    c = f"case when {d.like('x', '[ \\t\\n\\r]')} then 'space' when {d.like('x', '[!-/:-@\\[-`{-~]')} then 'mark' when {d.cp('x')} < 32 or {d.cp('x')} = 127 then 'control' when {d.cp('x')} between 19968 and 40959 then 'cjk' else 'letter' end"
    return f"select class, count(*) n from (select {c} class from ({d.explode(d.chars('text'), 'doc_id', '@documents')}) q) r group by class"


over("tok_normalize", "documents", "doc_id", normalized=lambda d: f"translate({d.sub('text', '[\\t\\n\\r]', ' ')}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
over("pretokenize_counts", "documents", "doc_id", n=lambda d: d.size(d.find("text", T.WORD_OR_MARK)))
over("number_spans", "documents", "doc_id", numbers=lambda d: d.join(d.find("text", "[0-9]+"), ","), n=lambda d: d.size(d.find("text", "[0-9]+")))
over("whitespace_final", "documents", "doc_id", final=lambda d: T.whitespace(d, "text"))
over("preprocess_symbols", "documents", "doc_id", clean=lambda d: T.symbols(d, "text"))
over("normalize_pipeline", "documents", "doc_id", normalized=lambda d: T.normalize_ko(d, "text"))
over("numbers_in_text", "orders", "o_orderkey", said=lambda d: T.numbers(d, "concat('a ', o_orderkey, '번, ', cast(o_orderkey as bigint) % 60, '시 ', o_orderkey, '.05km 007 ', o_orderkey, o_orderkey, o_orderkey, o_orderkey, o_orderkey, '!')"))
over("camel_split", "events", "event_id", words=lambda d: T.camel(d, "concat(event_type, 'By', 'User')"))
over("spell_word", "nation", "n_nationkey", spelled=lambda d: S.letters(d, "n_name"))
over("readable_chunk", "part", "p_partkey", readable=lambda d: d.like("lower(p_name)", "[aeiouy]"))
over("src_text_lines", "conversations", "conv_id, turn", n=lambda d: d.size(d.keep(d.split("text", "\\n"), "x", "trim(x) <> ''")))
over("feature_shape", "embeddings", "vec_id", seq=lambda d: d.size("embedding"))
over("version_number", "region", "r_regionkey", number=lambda d: "cast(r_regionkey * 10000 + 2 * 100 + 3 as bigint)", version=lambda d: "concat(r_regionkey, '.2.3')")
over("jamo_names", "region", "r_regionkey", read=lambda d: S.lookup(d, d.at(d.array(["ㄱㄴ", "ㅎ가", "ㅋㅋ", "abc", "ㅁ ㅂ"]), "r_regionkey + 1"), S.JAMO_NAMES))
KATA = lambda d: N.katakana(d, KEY)
over("kata2hira", "orders", "o_orderkey", hiragana=lambda d: f"translate({KATA(d)}, '{S.KATAKANA}', '{S.HIRAGANA}')")
over("hira2kata", "orders", "o_orderkey", katakana=lambda d: f"translate(translate({KATA(d)}, '{S.KATAKANA}', '{S.HIRAGANA}'), '{S.HIRAGANA}', '{S.KATAKANA}')")
over("romaji", "orders", "o_orderkey", latin=lambda d: J.romaji(d, KATA(d)))
over("ja_ipa", "orders", "o_orderkey", ipa=lambda d: J.ipa(d, KATA(d)))
over("ja_punct", "customer", "c_custkey", plain=lambda d: "translate(concat(c_mktsegment, '、', c_name, '。！？（）'), '、。！？（）', ',.!?()')")
DICTIONARY = {"Apache License": "아파치 라이선스", "License": "라이선스", "the": "더", "there": "데어", "U.S.": "미국", "e.g.": "예"}
over("dict_substitution", "documents", "doc_id", replaced=lambda d: T.dictionary(d, "text", DICTIONARY))
over("dict_exact_then_upper", "nation", "n_nationkey", reading=lambda d: T.by_case(d, "n_name", {"nation1": "exact", "NATION_0": "exact"}, {"NATION1": "upper", "NATION_2": "upper"}))


@plan
def apply_spans(d: Spark) -> str:
    """The first and the last word of every text are replaced."""
    words = d.find("text", WORDS)
    first, last = f"length({d.at('w', 1)})", f"length({d.at('w', d.size('w'))})"
    spans = d.list(d.struct(s="0", e=first, r="'<first>'"), d.struct(s=f"length(t) - {last}", e="length(t)", r="'<last>'"))
    return f"select conv_id, turn, {T.apply_spans(d, 't', spans)} spliced from (select conv_id, turn, trim(text) t, {words} w from @conversations) q where {d.size('w')} > 1"


over("en_ssml_phoneme", "customer", "c_custkey", ssml=lambda d: f"concat('<phoneme alphabet=\"ipa\" ph=\"rɛd\">', {T.xml('c_name')}, '</phoneme>')")
over("process_numeric_ko", "orders", "o_orderkey", normalized_text=lambda d: f"concat({N.sino(d, KEY)}, '번')", phonology=lambda d: P.phonology(d, f"concat({N.sino(d, KEY)}, '번')"))
over("lang_list_parse", "region", "r_regionkey", langs=lambda d: d.join(d.keep(d.map(d.split(d.at(d.array(["ko, EN", " ja ,xx", "", "KO,ja,en", "zz"]), "r_regionkey + 1"), ","), "x", "lower(trim(x))"), "x", "x in ('ko', 'ja', 'en')"), ","))
over("char_meta_flags", "documents", "doc_id", flags=lambda d: d.join(d.map(d.chars("text"), "c", f"case when {d.like('c', '[0-9]')} then '1' else '0' end"), ""))
SAID = "(select o_orderkey, concat({}, case o_orderkey % 5 when 0 then '입니다.' when 1 then '이고' when 2 then '은' when 3 then '에서' else '' end) w from @orders)"
PLANS["morph_ef_rule"] = lambda d: f"select o_orderkey, {T.ending(d, 'w')} pos, {T.pause(d, 'w')} pause from {SAID.format(N.sino(d, KEY))} q"
OPTIONS = "(select event_id, case event_id % 4 when 0 then '{{\"to_ipa\": true}}' when 1 then '{{\"to_ssml\": true, \"to_json\": false}}' when 2 then '{{}}' else '{{\"vowel_length\": true}}' end opts from @events)".replace("{{", "{").replace("}}", "}")
PLANS["options_merge"] = lambda d: "select event_id, " + ", ".join(f"coalesce({d.json('opts', k)}, '{v}') {k}" for k, v in (("to_ipa", "false"), ("to_ssml", "false"), ("vowel_length", "false"), ("to_json", "true"))) + f" from {OPTIONS} q"
over("result_json_roundtrip", "events", "event_id", k=lambda d: d.json("props", "k"))
WORDS = "[^ \\t\\n\\r]+"


@plan
def heteronym_default(d: Spark) -> str:
    words = d.explode(d.find("lower(text)", "[a-z]+"), "doc_id", "@documents")
    kinds = f"select x, count(*) n from ({words}) w group by x"
    return f"select x word, coalesce(default_label, 'NONE') label, n from ({kinds}) w left join {values(list(T.HETERONYMS.items()), 'word, default_label')} t on w.x = t.word"


@plan
def en_heteronym_lookup(d: Spark) -> str:
    words = d.explode(d.find("lower(text)", "[a-z]+"), "doc_id", "@documents")
    return f"select w.doc_id, w.i, t.ipa from ({words}) w join {values([('the', 'ðə'), ('that', 'ðæt')], 'word, ipa')} t on w.x = t.word"


def paused(d: Spark) -> str:
    return f"(select *, {T.pause(d, 'x')} pause from ({d.explode(d.find('text', WORDS), 'doc_id', '@documents')}) q)"


PLANS["pause_rule"] = lambda d: f"select doc_id, pause, count(*) n from {paused(d)} p group by doc_id, pause"
PLANS["pause_duration_total"] = lambda d: f"select doc_id, cast(sum(case pause {' '.join(f'when {lit(k)} then {v}' for k, v in T.PAUSE_MS.items())} else 0 end) as bigint) ms from {paused(d)} p group by doc_id"


def tagged(d: Spark, tags: dict[str, str], x: str) -> str:
    case = " ".join(f"when '{k}' then {lit(v)}" for k, v in tags.items())
    mark = d.let("p", T.pause(d, "x"), f"case p {case} else '' end")
    return d.join(d.map(d.find("text", WORDS), "x", f"concat({x}, {mark})"), " ")


over("raw_pause_tags", "conversations", "conv_id, turn", tagged=lambda d: tagged(d, {k: f"[{k}]" for k in T.PAUSE_MS}, "x"))
over("ssml_breaks", "conversations", "conv_id, turn", ssml=lambda d: f"concat('<speak>', {tagged(d, {k: f' <break strength=\"{v}\"/>' for k, v in T.BREAKS.items()}, T.xml('x'))}, '</speak>')")


@plan
def sentence_segmentation(d: Spark) -> str:
    """Sentences end after words with P3. Spark finds them in the text itself and shuffles a row a sentence, without its text."""
    if d.name != "spark":
        run = f"select doc_id, i, x, coalesce(sum(case when pause = 'P3' then 1 else 0 end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) s from {paused(d)} p"
        return f"select doc_id, cast(s as bigint) sentence, count(*) n_words, min(i) first_word, cast(sum(length(x)) as bigint) n_chars from ({run}) q group by doc_id, s"
    each = f"select doc_id, i, {d.size(d.find('x', WORDS))} n_words, cast(length(translate(x, ' \\t\\n\\r', '')) as bigint) n_chars from (select doc_id, posexplode_outer({d.find('text', T.SENTENCE)}) as (i, x) from @documents) q where x is not null"
    return f"select doc_id, cast(i as bigint) sentence, n_words, coalesce(sum(n_words) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) first_word, n_chars from ({each}) r"


@plan
def batch_plain_join(d: Spark) -> str:
    if d.name == "spark":
        return "select conv_id, array_join(transform(array_sort(collect_list(struct(turn, translate(text, '\n', ' ') t))), x -> x.t), '\n') joined from @conversations group by conv_id"
    return "select conv_id, string_agg(translate(text, chr(10), ' '), chr(10) order by turn, translate(text, chr(10), ' ')) joined from @conversations group by conv_id"


def text_of(name: str, d: Spark, sf_dir: str = "") -> str:
    import re

    return re.sub(r"@(\w+)", lambda m: d.table(m[1], sf_dir), PLANS[name](d))
