from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxweave.operators.process import process
from voxweave.operators.providers import HEADS, Encoded, RuleProvider, annotate, features
from voxweave.plans.queries import batch_invariance, invariance
from voxweave.sources.assets import folder

TEXTS = ["책 3개와 10km를 갔습니다.", None, "", "the end, 2.5", "a"]


def Fake():
    """A provider that executors get by value, as they cannot import tests."""

    @dataclass
    class Own:
        """States that tell the text's length and the token's place; one span over each text."""

        def open(self, device, threads):
            self.device = device
            return self

        def encode(self, texts):
            return [Encoded(np.array([[len(t), i] for i in range(len(t) + 1)], np.float32), [0, *range(len(t))], [0, *range(1, len(t) + 1)]) for t in texts]

        def heads(self, text, encoded):
            return {"annotations": [(0, len(text), self.device, float(encoded.states.sum()))]} if text else {}

    return Own()


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS * 20)), "k int, t string")


def test_features(df):
    for provider in (Fake(), RuleProvider(8)):
        own = provider.open("cpu", 0).encode([t or "" for t in TEXTS])
        for r in features(df, "t", provider, chunk=7).collect():
            want = own[r.k % len(TEXTS)]
            assert (r.seq_len, r.hidden_dim) == want.states.shape and r.features == want.states.ravel().tolist()
            assert r.word2ph == [b - a for a, b in zip(want.starts, want.ends)] and len(r.word2ph) == r.seq_len
    with pytest.raises(ValueError):
        features(df.withColumn("seq_len", F.lit(1)), "t", Fake())
    assert features(df.limit(0), "t", Fake()).count() == 0


def test_annotate_and_given_states(df):
    got = {r.k: r for r in annotate(df, "t", Fake(), device="cuda").collect()}
    a = got[0].annotations[0]
    assert (a.span, a.start, a.end, a.label) == (TEXTS[0], 0, len(TEXTS[0]), "cuda") and got[1].annotations == got[2].numbers == []
    made = features(df, "t", Fake()).withColumn("ends", F.expr("transform(word2ph, (x, i) -> cast(i as int))"))
    made = made.withColumn("starts", F.expr("transform(word2ph, (x, i) -> cast(greatest(i - 1, 0) as int))"))
    again = {r.k: r for r in annotate(made, "t", Fake(), device="cuda", given=("features", "starts", "ends")).collect()}
    assert all(again[k][h] == got[k][h] for k in got for h in HEADS)


def test_rules(spark):
    r = annotate(spark.createDataFrame([(TEXTS[0],)], "t string"), "t", RuleProvider()).first()
    assert [(x.span, x.label) for x in r.numbers] == [("3", "cardinal"), ("10", "cardinal")]
    assert [(x.span, x.label) for x in r.counter] == [("3개", "native"), ("10km", "sino")]
    assert [(x.span, x.label) for x in r.morphemes] == [("3개와", "JKB"), ("갔습니다.", "EF")]


def test_process_with_a_provider(df):
    plain = {r.k: r.result for r in process(df, "t", "ko").collect()}
    full = {r.k: r.result for r in process(df, "t", "ko", provider=RuleProvider()).collect()}
    for k, r in full.items():
        assert (r.normalized_text, r.phonology, r.pauses) == (plain[k].normalized_text, plain[k].phonology, plain[k].pauses)
    assert len(full[0]) == 8 and [x.span for x in full[0].counter] == ["3개", "10km"] and plain[0].counter == []


def test_asset_folder(tmp_path):
    assert folder(str(tmp_path), "ko", ()) is None
    (tmp_path / "models" / "ko").mkdir(parents=True)
    (tmp_path / "models" / "ko" / "KO_model_index.json").write_text("{}")
    assert folder(str(tmp_path), "ko") == tmp_path / "models" / "ko" and folder(str(tmp_path), "ja", ()) is None
    assert folder("none such", "ko", (str(tmp_path),)) == tmp_path / "models" / "ko"


def Neighbourly():
    """A provider whose spans depend on the other texts of a pass."""

    @dataclass
    class Own:
        def open(self, device, threads):
            return self

        def encode(self, texts):
            return [Encoded(np.full((1, 1), len(texts), np.float32), [0], [0]) for _ in texts]

        def heads(self, text, encoded):
            return {"annotations": [(0, len(text), "x", float(encoded.states[0, 0]))]}

    return Own()


def test_batch_invariance(spark, tmp_path):
    rows = [(1, 1, "가 3개"), (1, 1, "가 3개"), (1, 1, "나"), (None, 2, "다"), (None, None, "다"), (2, 1, None)] + [(k, 3, f"{k}번 the") for k in range(200)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    made = batch_invariance(spark, str(tmp_path))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, made.collect()), key=key) == sorted(((c, t, True) for c, t, _ in set(rows)), key=key)
    assert "Coalesce 1" not in made._jdf.queryExecution().toString()  # no task gets all rows
    talks = spark.createDataFrame(rows, "conv_id long, turn long, t string")
    assert invariance(talks, Neighbourly()).where("not same").count() > 100
