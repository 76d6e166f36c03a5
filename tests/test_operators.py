import os
import pickle
import random
import tracemalloc
from datetime import datetime

import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from voxweave.operators.process import merge, process
from voxweave.operators.transliterate import read_word, transliterate
from voxweave.operators.wordpiece import WordPiece, encode, encoded, plain_vocabulary
from voxweave.plans.queries import OTHERS
from voxweave.sources import dictionaries
from voxweave.sources.lines import lines
from voxweave.streaming.columns import with_reading
from voxweave.streaming.sentences import cut_sentences, sentences

DATA = "/root/testdata/sf0.001"
TEXTS = ["", "  ", "The reading, un-known!", "Ab\0c d​e", "日本 語。ok", "x" * 101, "a\tb\nc", "naïve Ünder", "中文 mixed中"]


def library(vocab, han):
    t = Tokenizer(models.WordPiece(vocab=vocab, unk_token="[UNK]", max_input_chars_per_word=100))
    t.normalizer = normalizers.BertNormalizer(clean_text=True, handle_chinese_chars=han, strip_accents=False, lowercase=True)
    t.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    return t


@pytest.mark.parametrize("han", [False, True])
def test_wordpiece_equals_library(han):
    vocab = plain_vocabulary()
    own, other = WordPiece(vocab, special=False, split_han=han), library(vocab, han)
    for x in TEXTS:
        want = other.encode(x, add_special_tokens=False)
        ids, starts, ends = own.encode(x)
        assert (ids, list(zip(starts, ends))) == (want.ids, want.offsets), x


def test_wordpiece_many_texts_at_once():
    draw = random.Random(7)
    texts = [None, *TEXTS, "x" * 100, "İstanbul ΑΣ Σ", "😀a 😀", "\x1c\x85", "​\n​"]
    texts += ["".join(draw.choice("aBthe ing,.\n​中é\0İ😀ßΣ") for _ in range(draw.randint(0, 90))) for _ in range(600)]
    for own in (WordPiece(plain_vocabulary()), WordPiece(plain_vocabulary(), special=False, split_han=True), WordPiece({"[UNK]": 1, "i̇s": 5, "##t": 6, "σ": 7}, lower=True)):
        ids, starts, ends, at = own.encode_all(texts)
        one = pickle.loads(pickle.dumps(own))
        for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
            assert (ids[a:b].tolist(), starts[a:b].tolist(), ends[a:b].tolist()) == one.encode(t), t
    other, own = library(plain_vocabulary(), False), WordPiece(plain_vocabulary(), special=False)
    plain = [t for t in texts if t and not set(t) & set("İΣ")]  # the library lowers these by their neighbours, or to two letters
    for t in plain:
        assert own.encode(t)[0] == other.encode(t, add_special_tokens=False).ids, t


def test_wordpiece_holds_a_bounded_part(spark):
    batch = pa.record_batch({"t": [f"{k} some words, and more of them. " * 60 for k in range(4000)]})
    tracemalloc.start()
    try:
        sizes = [(x.num_rows, x.column("ids").nbytes) for x in encoded(iter([batch]), 0, WordPiece(plain_vocabulary()))]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(n for n, _ in sizes) == 4000 and max(b for _, b in sizes) < 4e6 and most < 150e6
    encode(spark.createDataFrame([("a",)], "t string"), "t", WordPiece(plain_vocabulary()))
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_wordpiece_table(spark):
    df = spark.createDataFrame([(1, None), (2, "the a"), (3, "the a")], "k int, text string")
    rows = {r.k: r for r in encode(df, "text", WordPiece(plain_vocabulary())).collect()}
    assert rows[1].ids == [2, 3] and rows[2].ids == rows[3].ids and len(rows[2].mask) == 4 and rows[2].starts == [0, 0, 4, 0]
    with pytest.raises(ValueError):
        encode(df.withColumnRenamed("k", "ids"), "text", WordPiece(plain_vocabulary()))
    assert encode(df.limit(0), "text", WordPiece(plain_vocabulary())).count() == 0


@pytest.mark.parametrize("word, said", [("banana", "바나나"), ("school", "스쿨"), ("NASA", "엔에이에스에이"), ("Apple", "아플"), ("brrr", "비아르아르아르")])
def test_transliterate(word, said):
    assert read_word(word) == said


def test_transliterate_table(spark):
    df = spark.createDataFrame([("hello, 세계",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(transliterate("t")).collect()] == ["헬로, 세계", None, ""]


def test_process(spark):
    df = spark.createDataFrame([("서울의 날씨는 매우 맑고 기온은 28도입니다.",), (None,), ("",)], "t string")
    a, b, c = (r.result for r in process(df, "t", "ko").collect())
    assert len(a) == 8 and a.normalized_text == "서울의 날씨는 매우 맑고 기온은 이십팔도입니다."
    assert a.phonology == "서우레 날씨는 매우 말꼬 기오는 이십팔또임니다."
    assert [(p.word_idx, p.pause) for p in a.pauses] == [(1, "P1"), (3, "P2"), (4, "P1"), (5, "P3")]
    assert b.normalized_text is None and b.pauses == [] and c.normalized_text == "" and c.pauses == []
    raw = process(df, "t", "ko", {"preset": "raw", "to_json": False}).first().result
    assert raw.endswith("말꼬[P2] 기오는[P1] 이십팔또임니다.[P3]")
    ssml = process(df, "t", "ko", {"to_ssml": True, "to_json": False}).first().result
    assert ssml.startswith("<speak>") and ssml.endswith('<break strength="strong"/></speak>')
    assert process(df, "t", "ko", {"tn_only": True}).first().result.phonology is None
    other = process(df, "t", "xx").first().result
    assert other.normalized_text.startswith("서울의") and other.phonology is None and other.pauses == []
    with pytest.raises(ValueError):
        process(df, "t", "ko", {"preset": "none such"})


def test_process_japanese(spark):
    df = spark.createDataFrame([("きょーは 3600 です。",)], "t string")
    say = lambda **o: process(df, "t", "ja", {"to_json": False, **o}).first().result
    assert say() == "キョーハ サンゼンロッピャク デス." and say(script="romaji") == "kyooha sanzenroppyaku desu." and say(to_ipa=True).startswith("kʲoː")


def test_merge():
    assert merge({"a": 1, "b": 2}, {"a": None}, {"b": 3}) == {"a": 1, "b": 3}
    with pytest.raises(ValueError):
        merge({"a": 1}, {"c": 1})


def test_cut_sentences():
    assert cut_sentences("One", " two. Three") == (["One two."], "Three") and cut_sentences("", "") == ([], "") and cut_sentences("", "a\n\nb! ") == (["a", "b!"], "")


def test_sentences_over_fragments(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    schema = "k string, i long, t string, at timestamp"
    stream = spark.readStream.schema(schema).json(source)
    day = lambda m: datetime(2024, 1, 1, 0, m)
    parts = [[("a", 1, "one. tw", day(0)), ("b", 1, None, day(0))], [("a", 3, "ee! four. fi", day(2)), ("a", 2, "o thr", day(1)), ("b", 2, "x. ", day(1))], [("c", 1, "y", day(59))]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        q = sentences(stream, "k", "i", "t", "at", "1 minute").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        ended = q.awaitTermination(60)
        q.stop()
        assert ended
    got = [tuple(r) for r in spark.read.parquet(out).orderBy("k", "sentence_no").collect()]
    assert got == [("a", 0, "one."), ("a", 1, "two three!"), ("a", 2, "four."), ("a", 3, "fi"), ("b", 0, "x.")]


def test_lines_and_stream_columns(spark, tmp_path):
    (tmp_path / "x.txt").write_text("12\n\n  \nexit\nb\n")
    assert sorted(r.value for r in lines(spark, str(tmp_path)).collect()) == ["12", "b"]
    from voxweave.functions.numerals import sino

    stream = with_reading(lines(spark, str(tmp_path), True).where("value rlike '^[0-9]+$'").selectExpr("cast(value as bigint) n"), sino, "n", "said")
    q = stream.writeStream.format("memory").queryName("said").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("said").first().said == "십이"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(OTHERS))
def test_other_queries_keep_rows(spark, name):
    table = "documents" if name == "wordpiece_ids" else "conversations"
    assert OTHERS[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_process_with_lexicons(spark):
    say = lambda t, lang, **o: process(spark.createDataFrame([(t,)], "t string"), "t", lang, {"to_json": False, **o}).first().result
    assert say("1日は休みで、1日中雨が降った。", "ja") == "ツイタチハヤスミデ,イチニチジュウアメガ降ッタ."
    assert say("14時30分に3本、007と11本。", "ja", script="hiragana") == "じゅうよじさんじゅっぷんにさんぼん,ぜろぜろななとじゅういちほん."
    assert say("정부는 예산을 확정했습니다 날씨가 참 맑네요", "ko", preset="raw") == "정부는[P1] 예사늘 확쩡핻씀니다.[P3] 날씨가 참 망네요.[P3]"
    assert say("여기서 3번 버스를 타고 2번 갈아타야", "ko") == "여기서 삼번 버스를 타고 두번 가라타야"
    assert say("물가 상승과 물가", "ko") == "물까 상승과 물가" and say("사람", "ko", vowel_length=True, to_ipa=True) == "saːɾam"
    assert say("abc NASA", "ko", read_latin=False) == "abc NASA" and say(None, "ko") is None and say("", "ja") == ""
    assert say("We read; I have READ <it>", "en", to_ssml=True) == '<speak>We <phoneme alphabet="ipa" ph="riːd">read</phoneme>; <break strength="medium"/> I have <phoneme alphabet="ipa" ph="rɛd">READ</phoneme> &lt;it&gt;</speak>'


def test_dictionaries(spark, tmp_path):
    put = lambda name, s: (tmp_path / name).write_text(s) and str(tmp_path / name)
    assert dictionaries.readings(spark, put("r.json", '{"空": "ソラ", "海": ["ウミ", 1]}')) == {"空": ("ソラ", 0), "海": ("ウミ", 1)}
    assert dictionaries.dictionary(spark, put("e.json", " ")) == {}
    for bad in ("[1]", '{"a": 1, "b": 2}'):
        with pytest.raises(ValueError):
            dictionaries.dictionary(spark, put("b.json", bad), 1)
    own = library(plain_vocabulary(), True)
    made = dictionaries.wordpiece(spark, put("t.json", own.to_str()))
    for x in TEXTS:
        want = own.encode(x, add_special_tokens=False)
        assert made.encode(x)[0][1:-1] == want.ids
    with pytest.raises(ValueError):
        dictionaries.wordpiece(spark, put("u.json", '{"model": {"type": "BPE"}}'))
    assert dictionaries.one_text(spark, ["a", "b"]).first().value == "a b" and dictionaries.one_text(spark, [], "d").first().value == "d"
    assert dictionaries.home("x", {}) == "x" and dictionaries.home(None, {"VOXWEAVE_HOME": "y"}) == "y" and dictionaries.home(None, {}) == os.getcwd()
