"""The stages of the corpus pipeline, each against brute force on its own input."""

from __future__ import annotations

import importlib.util
from collections import Counter

import pytest

from .test_operators import brute_components, corpus, key, table, words

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)

import corpus_pipeline as P

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [r for r in corpus(9, 60) if r[0] is None or r[0] < 2008]
    rows += [(3000 + i, " ".join(f"{w}!!" for w in "THE LIVER OF STUDY DATA".split() * 8) + f" {i}") for i in range(30)]
    rows += [(5, "the same row twice of the corpus here"), (5, "the same row twice of the corpus here")]
    table(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 3000)) for i, _ in rows if i is not None and i % 2 == 0], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """Input and result of each stage."""
    out = tmp_path_factory.mktemp("stages")
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, folder).write.parquet(f"{out}/{k}")
        result = spark.read.parquet(f"{out}/{k}")
        found.append((docs, result))
        docs = result
    return found


def test_names_and_columns(stages):
    assert len(P.STAGES) == 5
    for _, result in stages[:-1]:
        assert result.columns == list(P.COLUMNS)


def test_junk_goes_and_clean_stays(stages):
    before, after = stages[0]
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert {i for i in range(3000, 3030)} <= gone
    assert after.where("doc_id < 1000").count() >= 55


def test_one_of_each_component_stays(stages):
    before, after = stages[1]
    want = brute_components([(key(r.doc_id), r.text) for r in before.collect()])
    assert sorted(key(r.doc_id) for r in after.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_every_text_of_an_id_is_looked_at(spark, folder):
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (3, text("c")), (5, text("c") + " x"), (5, text("d")), (7, text("b") + " x"), (None, None)]
    after = P.keep_one_of_each(spark, table(spark, rows).repartition(3), folder).collect()
    assert sorted((key(r.doc_id), r.text or "") for r in after) == sorted([(key(None), text("a")), (key(None), text("b")), (key(None), ""), (3, text("c")), (5, text("d"))])


def test_near_duplicates_from_80_percent_on_go(spark, folder):
    """15 pairs with 0.80 to 0.85 in common, and 15 with a little less than 0.80."""
    rows, want = [], []
    for i in range(30):
        own = [f"{i}w{j}" for j in range(104)]
        m = 9 + i % 3 if i < 15 else 12
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[: 104 - m] + [f"{i}x{j}" for j in range(m)]))]
        want += [2 * i] if i < 15 else [2 * i, 2 * i + 1]
    after = P.keep_one_of_each(spark, table(spark, rows), folder).collect()
    assert sorted(r.doc_id for r in after) == want


def test_repeats_go(stages):
    before, after = stages[2]
    rows = sorted((key(r.doc_id), r.text or "") for r in before.collect())
    seen: dict[tuple, tuple] = {}
    left = {}
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if seen.setdefault(tuple(w[s : s + 20]), (i, s)) != (i, s):
                gone[s : s + 20] = [True] * 20
        if not w or not all(gone):
            left[i] = [x for x, g in zip(w, gone, strict=True) if not g]
    got = {key(r.doc_id): words(r.text) for r in after.collect()}
    assert got == left
    clean = {i: t for i, t in rows if words(t) == left.get(i)}
    assert all(r.text == clean[key(r.doc_id)] for r in after.collect() if key(r.doc_id) in clean)


def test_sources_come_near_their_targets(stages):
    before, after = stages[3]
    size: Counter = Counter()
    for r in before.collect():
        size[r.source] += len(words(r.text))
    order = sorted(size, key=lambda s: (s is None, s))
    total, fixed = sum(size.values()), set()
    while True:
        free = [s for s in order if s not in fixed]
        share = (total - sum(3 * size[s] for s in fixed)) / sum(order.index(s) % 3 + 1 for s in free)
        want = {s: 3 * size[s] if s in fixed else share * (order.index(s) % 3 + 1) for s in order}
        over = {s for s in free if want[s] > 3 * size[s]}
        if not over:
            break
        fixed |= over
    got: Counter = Counter()
    texts: dict = {}
    for r in after.collect():
        got[r.source] += len(words(r.text))
        assert r.n_chars == len(r.text)
        texts.setdefault((r.source, key(r.doc_id)), []).extend(words(r.text))
    assert all(abs(got[s] - want[s]) <= 64 for s in order)
    have = {(r.source, key(r.doc_id)): Counter(words(r.text)) for r in before.collect()}
    for k, w in texts.items():
        assert all(n <= 3 * have[k][x] for x, n in Counter(w).items())


def test_windows_hold_every_token(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = stages[4]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(own.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect())
    rows = after.collect()
    assert sum(r.length for r in rows) == want
    full: Counter = Counter()
    for r in rows:
        full[r.sequence_id] += r.length
    assert all(n <= 1024 and n & (n - 1) == 0 for n in full.values())


def test_run(spark, folder, stages):
    assert P.run(spark, folder).count() == stages[-1][1].count()
