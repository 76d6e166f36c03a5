"""The pipeline's stages and run() against plain Python, with nulls, copies, near copies, secrets and clashing column names."""

import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from voxweave.llm import pretoken, quality

SCHEMA = "doc_id long, text string, lang string, n_chars long, score string, predicted string, held_out string, _text string, _id string, component_id string, _score string"
LONG = " ".join(f"word{i} and" for i in range(40)) + "."
GOOD = [f"Good plain words number {i} are written here. And there are more of them, as it should be." for i in range(60)]
BAD = ["BUY!! NOW!! *** ### " * 5 + str(i) for i in range(30)]
MORE = [GOOD[3].replace(" ", "  "), GOOD[3], GOOD[5] + "\n", LONG, LONG + " tail", "Start " + LONG, LONG.upper(), "The password = 'abcdef1234' is in this text. It is a plain text, and there are more of them here.", None, "", "x"]
ROWS = [(i, t) for i, t in enumerate(GOOD + BAD + MORE)]
ROWS += [ROWS[1], ROWS[1], (None, "A text without a number is here as well. And there are more of them, as it should be.")]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", None if t is None else len(t), *("own" for _ in range(7))) for i, t in ROWS], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def best(rows):
    """Of texts that are equal without blanks, the longest and then the first stays."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[ \t-\r]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i, t))
    return {min(g, key=lambda x: x[:3])[3] for g in groups.values()}


def firsts(rows):
    """The smallest doc_id of each component of texts with 0.8 of their 5-word shingles in common."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^ \t-\r]+", (t or "").lower())
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    low = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                    low[i] = min(low[i], low[j], key=lambda x: rows[x][0])
    return {rows[x][0] for x in low}


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = []
    for i, t in ROWS:
        raw = (t or "").encode()
        x = quality.features(quality.np.frombuffer(raw, quality.np.uint8), quality.np.array([0, len(raw)]))
        if model.score(x)[0] >= 0.7:
            rows.append((i, t))
    kept = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert kept.columns == docs.columns and texts(kept) == sorted(rows, key=str) and {r.score for r in kept.select("score").collect()} == {"own"}
    ids = {i for i, _ in rows}
    assert ids >= set(range(60)) | {None, 93, 97} and not ids & set(range(60, 90))
    keep = best(rows)
    rows = sorted({r for r in rows if r[0] in keep}, key=str)
    kept = corpus_pipeline.exact_stage(spark, kept, sf_dir)
    assert kept.columns == docs.columns and texts(kept) == rows
    keep = firsts(rows)
    rows = [r for r in rows if r[0] in keep]
    kept = corpus_pipeline.near_stage(spark, kept, sf_dir)
    assert kept.columns == docs.columns and texts(kept) == rows and len(rows) < len(ids)
    secret = re.compile("password = \'[a-z0-9]+")
    rows = [(i, None if t is None else secret.sub("<secret>", t)) for i, t in rows]
    kept = corpus_pipeline.secret_stage(spark, kept, sf_dir)
    assert kept.columns == docs.columns and texts(kept) == rows and all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept.collect())
    assert any("<secret>" in (t or "") for _, t in rows)
    own = Tokenizer.from_file(pretoken.vocabulary())
    want = sorted(((i, [*own.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows), key=str)
    got = {}
    for r in corpus_pipeline.run(spark, sf_dir).orderBy("doc_id", "start").collect():
        assert r.start == len(got.setdefault(r.doc_id, []))
        got[r.doc_id] += r.ids
    assert sorted(got.items(), key=str) == want


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
