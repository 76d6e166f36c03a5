import os

import duckdb
import pytest

from voxweave.functions import japanese, kana, numerals, phonology, scripts, text
from voxweave.functions.dialect import SPARK, lit
from voxweave.plans.queries import oracle_sql, queries
from voxweave.sources.config import compatible, resolve_device, version_number

DATA = "/root/testdata/sf0.001"


def one(spark, sql):
    return spark.sql(f"select {sql} x").first().x


@pytest.mark.parametrize("n, said", [(0, "영"), (32, "삼십이"), (2024, "이천이십사"), (100000, "십만"), (10350, "만삼백오십"), (-5, "마이너스 오"), (110000000, "일억천만"), (-(2**63), None)])
def test_sino(spark, n, said):
    got = one(spark, numerals.sino(SPARK, f"cast('{n}' as bigint)"))
    assert got == said if said else got.startswith("마이너스 구백이십이경")


def test_decimals(spark):
    assert one(spark, numerals.decimal_reading(SPARK, "'3.14'")) == "삼 점 일사"
    assert one(spark, numerals.decimal_reading(SPARK, "'-2.5'")) == "마이너스 이 점 오"


@pytest.mark.parametrize("n, said", [(1, "한"), (20, "스무"), (21, "스물한"), (99, "아흔아홉"), (100, "백")])
def test_native_count(spark, n, said):
    assert one(spark, numerals.native_count(SPARK, f"cast({n} as bigint)")) == said


def test_kana(spark):
    assert one(spark, numerals.katakana(SPARK, "cast(3600 as bigint)")) == "サンゼンロッピャク"
    assert one(spark, numerals.minutes(SPARK, "cast(30 as bigint)")) == "サンジュップン"


@pytest.mark.parametrize("f, given, heard", [(scripts.liaison, "기온은", "기오는"), (scripts.neutral, "했", "핻"), (scripts.nasal, "국무", "궁무"), (scripts.ipa, "백", "pɛk̚"), (scripts.liaison, "오늘 오전", "오늘 오전"), (scripts.liaison, "", "")])
def test_phonology(spark, f, given, heard):
    assert one(spark, f(SPARK, lit(given))) == heard


@pytest.mark.parametrize(
    "given, heard",
    [
        ("이천이십육년 팔월 십이일 서울의 날씨는 매우 맑고 기온은 이십팔도입니다.", "이처니심늉년 파뤌 시비일 서우레 날씨는 매우 말꼬 기오는 이십팔또임니다."),
        ("예산안 만 삼백오십원을 확정했습니다.", "예사난 만 삼배고시붜늘 확쩡핻씀니다."),
        ("판교역에 갈 수 있어. 서울역 만납시다", "판교여게 갈 수 이써. 서울력 만납씨다"),
        ("맑네요 국무회의를 독립 신라 잃어", "망네요 궁무회이를 동닙 실라 이러"),
        ("굳이 같이 닫히다 좋다 않는 값이 앉다", "구지 가치 다치다 조타 안는 갑씨 안따"),
        ("솜이불 홑이불 막일 삯일 맨입 꽃잎 내복약 한여름 남존여비 신여성 색연필 직행열차 늑막염", "솜니불 혼니불 망닐 상닐 맨닙 꼰닙 내봉냑 한녀름 남존녀비 신녀성 생년필 지캥녈차 능망념"),
        ("콩엿 담요 눈요기 영업용 식용유 백분율 솔잎 설익다 물약 불여우 물엿 휘발유 유들유들", "콩녇 담뇨 눈뇨기 영엄뇽 시굥뉴 백뿐뉼 솔립 설릭따 물략 불려우 물렫 휘발류 유들류들"),
        ("문고리 눈동자 신바람 손재주 길가 갈등 발전 몰상식", "문꼬리 눈똥자 신빠람 손째주 길까 갈뜽 발쩐 몰쌍식"),
        ("의사의 abc 12 ㅋ", "의사에 abc 12 ㅋ"),
        ("", ""),
    ],
)
def test_rule_chain(spark, given, heard):
    assert one(spark, phonology.phonology(SPARK, lit(given))) == heard


def test_null_texts(spark):
    null = "cast(null as string)"
    for made in (phonology.phonology(SPARK, null), kana.romaji(SPARK, null), kana.ipa(SPARK, null), text.dictionary(SPARK, null, {"a": "b"})):
        assert one(spark, made) is None


@pytest.mark.parametrize("f, given, out", [(kana.romaji, "サンビャクロッピャクキョート", "sanbyakuroppyakukyooto"), (kana.romaji, "ハッチ a", "hatchi a"), (kana.ipa, "ショーワ", "ɕoːwa"), (kana.ipa, "トーキョー", "toːkʲoː"), (kana.ipa, "", "")])
def test_kana_out(spark, f, given, out):
    assert one(spark, f(SPARK, lit(given))) == out


@pytest.mark.parametrize("n, unit, said", [(1, "本", "イッポン"), (3, "本", "サンボン"), (3, "分", "サンプン"), (4, "分", "ヨンプン"), (6, "回", "ロッカイ"), (8, "歳", "ハッサイ"), (6, "冊", "ロクサツ"), (3, "階", "サンガイ"), (2, "枚", "ニマイ"), (11, "本", None), (1, "x", None)])
def test_counters(spark, n, unit, said):
    assert one(spark, kana.counter_liaison(SPARK, f"cast({n} as int)", lit(unit))) == said


def test_dictionary(spark):
    table = {"a": "1", "ab": "2", "1": "never", "it's": "3", "u.s": "4"}
    assert one(spark, text.dictionary(SPARK, lit("ab a it's u.s uxs\n"), table)) == "2 1 3 4 uxs\n"


@pytest.mark.parametrize("spans, out", [([], "가나다라"), ([(0, 1, "A")], "A나다라"), ([(1, 2, ""), (3, 4, "ZZ")], "가다ZZ"), ([(0, 2, "x"), (2, 4, "y")], "xy")])
def test_apply_spans(spark, spans, out):
    made = SPARK.list(*(SPARK.struct(s=str(a), e=str(b), r=lit(r)) for a, b, r in spans)) if spans else "cast(array() as array<struct<s:int,e:int,r:string>>)"
    assert one(spark, text.apply_spans(SPARK, "'가나다라'", made)) == out


@pytest.mark.parametrize("word, label, tier", [("만납니다.", "EF", "P3"), ("맑고", "EC", "P2"), ("서울에서", "JKB", "NONE"), ("기온은", "JX", "P1"), ("서울", "NONE", "NONE"), ("다만,", "NONE", "P2")])
def test_endings(spark, word, label, tier):
    assert (one(spark, text.ending(SPARK, lit(word))), one(spark, text.pause(SPARK, lit(word)))) == (label, tier)


@pytest.mark.parametrize("word, accent, out", [("サクラ", 0, "サ^クラ"), ("アメ", 1, "^ア]メ"), ("ニホン", 2, "ニ^ホ]ン"), ("キョウ", 1, "^キョ]ウ"), ("ヤスミ", 3, "ヤ^スミ]"), ("キ", 0, "キ")])
def test_pitch(word, accent, out):
    assert japanese.marked(word, accent) == out


def test_config():
    assert version_number("1.2.3") == 10203 and compatible("1.4.0", 1, 2) and not compatible("2.0.0", 1, 2)
    assert resolve_device("cpu", {"device": "cuda"}, {}) == "cpu" and resolve_device(None, {"device": "cuda"}, {}) == "cuda" and resolve_device(None, {}, {}) == "auto"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_check_engine(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f[:-8]} as select * from read_parquet('{DATA}/{f}')")
    got, want = queries()[name](spark, DATA).toPandas(), c.sql(oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda t: sorted(repr([None if v is None or v != v else v for v in r]) for r in t[cols].astype(object).values.tolist())
    assert rows(got) == rows(want)


def test_sentences_end_where_the_pause_rule_says(spark, tmp_path):
    texts = ["날씨가 맑네요 기온은 높습니다. 다 까\t! 가요", "", " \n", None, "다", ". a.b c.\r\n d", "끝", "a? b; 갑니다만 합니까 c!d e.  ", "x " * 5000 + "다 y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for k, t in enumerate(texts):
        words = spark.createDataFrame([(i, w) for i, w in enumerate((t or "").split())], "i int, x string").selectExpr("i", "x", text.pause(SPARK, "x") + " p").orderBy("i").collect()
        own = []
        for i, w, p in words:
            own.append(w)
            if p == "P3" or i + 1 == len(words):
                want.append((k, sum(r[0] == k for r in want), len(own), i + 1 - len(own), len("".join(own))))
                own = []
    got = queries()["sentence_segmentation"](spark, str(tmp_path)).select("doc_id", "sentence", "n_words", "first_word", "n_chars").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 15
