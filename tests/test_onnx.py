"""The provider of ONNX files, with a backbone of two operations written byte by byte: a look-up and a sum with the mask."""

import json

import numpy as np
import pytest

from voxweave.operators.onnx import OnnxProvider, execution, load, session
from voxweave.operators.providers import annotate, features
from voxweave.operators.wordpiece import WordPiece, plain_vocabulary
from voxweave.sources.assets import pinned

pytest.importorskip("onnxruntime")
DIM, FLOAT, LONG = 4, 1, 7
TEXTS = ["a text, and more", "", None, "two", "a text, and more", "one two three four five"]


def number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def part(field, x):
    """A field of a protobuf message: an int, or bytes with their length."""
    if isinstance(x, int):
        return number(field << 3) + number(x)
    x = x.encode() if isinstance(x, str) else x
    return number(field << 3 | 2) + number(len(x)) + x


def value(name, kind, dims):
    shape = b"".join(part(1, part(2, d) if isinstance(d, str) else part(1, d)) for d in dims)
    return part(1, name) + part(2, part(1, part(1, kind) + part(2, shape)))


def backbone(table):
    """states = table[input_ids]; the mask comes in through a cast, so all inputs are read."""
    node = lambda op, given, made, more=b"": part(1, b"".join(part(1, x) for x in given) + part(2, made) + part(4, op) + more)
    to_float = part(5, part(1, "to") + part(3, FLOAT) + part(20, 2))
    start = part(5, part(1, "axes") + part(8, 2) + part(20, 7))
    nodes = node("Gather", ["table", "input_ids"], "rows") + node("Cast", ["attention_mask"], "m", to_float) + node("Unsqueeze", ["m"], "mask", start) + node("Mul", ["rows", "mask"], "states")
    held = part(5, b"".join(part(1, d) for d in table.shape) + part(2, FLOAT) + part(8, "table") + part(9, table.astype("<f4").tobytes()))
    given = b"".join(part(11, value(x, LONG, ["texts", "tokens"])) for x in ("input_ids", "attention_mask"))
    graph = nodes + part(2, "backbone") + held + given + part(12, value("states", FLOAT, ["texts", "tokens", DIM]))
    return part(1, 7) + part(7, graph) + part(8, part(1, "") + part(2, 12))


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    """Assets of two versions, the second one active."""
    root = tmp_path_factory.mktemp("home")
    own, vocab = root / "models" / "ko", plain_vocabulary()
    own.mkdir(parents=True)
    for v in (1, 2):
        (own / f"small-{v}.onnx").write_bytes(backbone(np.arange(len(vocab) * DIM, dtype=np.float32).reshape(-1, DIM) * v))
    (own / "tokenizer.json").write_text(json.dumps({"model": {"type": "WordPiece", "vocab": vocab}}))
    (own / "words.json").write_text('{"a": "b"}')
    models = {f"v{v}": {"model": f"small-{v}.onnx", "tokenizer": "tokenizer.json"} for v in (1, 2)} | {"v3": {"model": "gone.onnx", "tokenizer": "tokenizer.json"}}
    index = {"active": {"variant": "small", "model": "v2", "dictionary": "v1"}, "models": {"small": models}, "dictionaries": {"v1": "words.json"}}
    (own / "KO_model_index.json").write_text(json.dumps(index))
    return root


def test_devices():
    cpu, cuda = "CPUExecutionProvider", "CUDAExecutionProvider"
    assert execution("auto", [cpu]) == execution("cpu", [cuda, cpu]) == execution("cuda", [cpu]) == [cpu]
    assert execution("auto", [cpu, cuda]) == [cuda, cpu] and execution("CUDA:1", [cuda, cpu]) == [(cuda, {"device_id": "1"}), cpu]
    with pytest.raises(ValueError):
        execution("abacus", [cpu])


def test_versions(home):
    assert pinned(str(home), "ko").model.name == "small-2.onnx" and pinned(str(home), "ko", model_version="v1").model.name == "small-1.onnx"
    for kind in ({"variant": "large"}, {"model_version": "v9"}, {"model_version": "v3"}, {"dict_version": "v9"}):
        assert pinned(str(home), "ko", **kind) is None
    assert pinned(str(home), "ja") is None


@pytest.mark.parametrize("most, version", [(512, None), (3, "v1")])
def test_states(spark, home, most, version):
    provider, words = load(spark, "KO", str(home), model_version=version)
    provider.most = most
    vocab, scale = plain_vocabulary(), 1 if version else 2
    assert words == {"a": "b"} and load(spark, "ko", str(home), model_version="v9") is None
    df = spark.createDataFrame(list(enumerate(TEXTS * 9)), "k int, t string")
    one, many = ({r.k: r for r in features(d, "t", provider).collect()} for d in (df.coalesce(1), df.repartition(7)))
    assert one == many and len(one) == len(TEXTS) * 9
    for k, r in one.items():
        ids, starts, ends = provider.tokenizer.encode(TEXTS[k % len(TEXTS)])
        want = np.arange(len(vocab) * DIM, dtype=np.float32).reshape(-1, DIM)[ids] * scale
        assert (r.seq_len, r.hidden_dim) == want.shape and r.features == want.ravel().tolist()
    spans = annotate(df.where("k = 0"), "t", provider).first()
    assert spans.numbers == [] and spans.t == TEXTS[0]


def test_sessions_are_kept(home):
    path = str(home / "models" / "ko" / "small-1.onnx")
    assert session(path, "cpu", 1) is session(path, "cpu", 1)
    plain = OnnxProvider(path, WordPiece(plain_vocabulary(), special=False)).open("cpu", 1)
    assert [x.states.shape[0] for x in plain.encode(["", "a b"])] == [0, 2]
    with pytest.raises(Exception, match="none.onnx"):
        session("/none.onnx", "cpu", 1)
