"""The pipeline's stages, each against brute force on its own input."""

import os
import random
from collections import Counter

import pytest

import corpus_pipeline
from weft.operators.storage import shared_dir
from tests.llm.conftest import prose
from tests.llm.test_operators import brute_components, brute_repeats, check_packed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    rows, passage = [], prose(rng, 60, 3000)
    words = {"en": ["the", "house", "garden", "window", "water", "summer", "winter", "reading"], "fr": ["maison", "jardin", "fenêtre", "été", "hiver", "lecture", "toujours", "rivière"]}
    for d in range(120):
        lang = "en" if d % 3 else "fr"
        text = " ".join(rng.choice(words[lang]) + rng.choice(["", "", "s"]) for _ in range(rng.randrange(30, 120)))
        if d % 10 == 0:
            text += " " + passage
        rows.append((d, text, lang, "s", len(text)))
    rows += [(200, rows[1][1], "en", "s", 1), (201, rows[2][1] + " more", "en", "s", 1), (202, None, None, None, None), (203, "12345 !!", None, "s", 8), (204, "", "en", "s", 0), (205, "数学物理化学历史地理", None, "s", 10)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    out, folder = [docs], tmp_path_factory.mktemp("pipeline")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], None).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return [(x.columns, {r["doc_id"]: r for r in x.collect()}, x.collect()) for x in out]


def test_language(stages):
    assert [stages[k][0] for k in range(4)] == [COLUMNS] * 4
    assert set(stages[0][1]) - set(stages[1][1]) == {202, 203, 204, 205}
    assert all(stages[1][1][d] == r for d, r in stages[0][1].items() if d in stages[1][1])


def test_language_keeps_short_texts(spark, docs):
    short = [(300, "Re.", "en", "s", 3), (301, "A.", "en", "s", 2), (302, "De", "fr", "s", 2), (303, "Rare words", "en", "s", 10), (304, "é", None, "s", 1)]
    gone = [(305, "1.", "en", "s", 2), (306, "数学物理化学历史地理", None, "s", 10), (307, None, "en", "s", None)]
    got = corpus_pipeline.language(spark, docs.unionByName(spark.createDataFrame(short + gone, docs.schema)), None).where("doc_id >= 300").collect()
    assert sorted(tuple(r) for r in got) == short


def test_near_duplicates(stages):
    comp = brute_components([(d, r["text"]) for d, r in stages[1][1].items()], 80)
    assert set(stages[2][1]) == set(comp.values()) and {200, 201} & set(comp.values()) == set()
    assert all(stages[1][1][d] == r for d, r in stages[2][1].items())


@pytest.mark.parametrize("files", [True, False])
def test_near_duplicates_of_rows(spark, tmp_path, files):
    """Repeated rows, repeated ids and null ids: one row of each group, by brute force over rows."""
    rng = random.Random(31)
    texts = [prose(rng, 60) for _ in range(12)]
    rows = [(d, t, "en", "s", d) for d, t in enumerate(texts)]
    rows += [rows[0], rows[1], rows[1], (None, texts[2], "en", "s", 20), (None, texts[3] + " more", "en", "s", 21), (4, texts[4] + " more", "en", "s", 22)]
    alone = prose(rng, 50)
    rows += [(None, alone, "en", "s", 23), (None, alone, "en", "s", 24), (None, alone + " more", "en", "s", 25), (5, prose(rng, 70), "en", "s", 26), (-3, texts[6] + " more", "en", "s", 27), (None, prose(rng, 40), "en", "s", 28)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    if files:
        docs.write.parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
    groups = {}
    for k, c in brute_components([(k, r[1]) for k, r in enumerate(rows)], 80).items():
        groups.setdefault(c, []).append(rows[k])
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, None).collect()]
    assert len(got) == len(groups) == 15
    for own in groups.values():
        kept = [r for r in got if r in own]
        least = min((r[0] is None, r[0] or 0) for r in own)
        assert len(kept) == 1 and (kept[0][0] is None, kept[0][0] or 0) == least


def test_repeated_passages(stages):
    before = [stages[2][1][d] for d in sorted(stages[2][1])]
    want = brute_repeats([r["text"] for r in before], 35)
    changed = 0
    for r, (_, _, gone, _) in zip(before, want, strict=True):
        after = stages[3][1][r["doc_id"]]
        if gone:
            changed += 1
            assert len(after["text"].split()) == len(r["text"].split()) - gone and after["n_chars"] == len(after["text"])
        else:
            assert after == r
    assert changed >= 10


def test_packing(stages):
    check_packed(stages[4][2], {d: r["text"] for d, r in stages[3][1].items()})


def test_odd_columns(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, None).columns == docs.columns
    assert all(stage(spark, no_docs, None).collect() == [] for _, stage in corpus_pipeline.STAGES)
    rows = Counter(odd_docs.collect())
    language, near, repeated = (Counter(stage(spark, odd_docs, None).collect()) for _, stage in corpus_pipeline.STAGES[:3])
    assert language <= rows and {r["text"] for r in rows - language} >= {None, "", "   \n\t ", "?!"} and language[next(r for r in rows if r["text"] == "short")] == 2
    assert near <= rows
    words = lambda own: Counter(r["text"] for r in own.elements() if r["text"] and r["text"].split())
    assert set(words(near)) == set(words(rows)) and set(words(near).values()) == {1} and (rows - near).total() == 2  # the long text and a short one stood there twice
    assert {r["doc_id"] for r in rows - near} == {5, 6}
    long = max((r["text"] for r in rows if r["text"]), key=len)
    assert Counter((r["doc_id"], r["text"]) for r in repeated.elements()) == Counter((r["doc_id"], "" if r["text"] == long else r["text"]) for r in rows.elements())


def test_run(spark):
    """run() packs what the stages keep, one after another, and leaves none of their tables behind."""
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert not [x for x in set(os.listdir(folder)) - before if x.startswith("pipeline-")] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, None).collect(), docs.schema)
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(kept) == docs.count() > 100
    check_packed(rows, kept)
