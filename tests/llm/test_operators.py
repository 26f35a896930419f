"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from citeweld.llm import feistel, fingerprint, maxent, minhash, mixing, packing, quality, shards, substring, topk, warc
from citeweld.llm._arrow import whole_groups
from citeweld.llm._spark import n_words
from citeweld.llm._words import chunks
from citeweld.spark import components, in_order

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did int, tie string, _c0 int, kept boolean, shard int"


def words(text):
    return [w for w in (text or "").encode().split()]


def corpus(seed=1, n=120):
    """Texts with shared passages, near copies, repeats within, odd spaces, nulls and repeated rows."""
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and liver é ñandú data-x, a1 Zürich.".split()) + rng.choice(["", "s", "ing", str(rng.randint(0, 40))])
    passage = [" ".join(word() for _ in range(30)) for _ in range(4)]
    rows = []
    for i in range(n):
        text = " ".join(word() for _ in range(rng.randint(1, 120)))
        if rng.random() < 0.3:
            text += rng.choice(["\n", "  ", "\t\x0b"]) + rng.choice(passage) + " " + word()
        if rng.random() < 0.1:
            text = text + " " + text
        rows.append((i * 3 + 1, text))
    base = " ".join(word() for _ in range(200))
    for i in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, "one two"), (2004, "one two"), (2005, "ONE two"), (None, "of no id " + passage[0]), (2006, base), (2007, base), (2008, "x" * 300_000), (2009, "long " * 30_000)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i is None or i % 5 == 0 else f"s{i % 4}", len(t or ""), 7, "t", 1, None, 9) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, corpus()).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return -(2**63) if i is None else i


# words


def test_words_are_those_of_the_pattern():
    texts = ["", None, " a  b\tc\n", "é x", "x" * 3_000_000 + " y", "\x1c a \x85 b", "A b"]
    got = []
    seen: dict[bytes, int] = {}
    for c in chunks(pa.array(texts), limit=64):
        for i in range(c.texts):
            own = slice(c.off[i], c.off[i + 1])
            w = [c.data[s:e].tobytes() for s, e in zip(c.start[own], c.end[own], strict=True)]
            for x, h in zip(w, c.hash[own].tolist(), strict=True):
                assert seen.setdefault(x, h) == h
            got.append(w)
    assert got == [words(t) for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_long_words_are_told_apart_by_all_their_bytes():
    a, b = "ab" * 600_000, "ba" + "ab" * 599_999
    hashes = [int(c.hash[0]) for x in (a, b, "ab" * 600_000) for c in chunks(pa.array([x]))]
    assert hashes[0] == hashes[2] != hashes[1]


def test_groups_of_many_batches_are_whole():
    keys = [1] * 40 + [2] * 3 + [5] * 100 + [6]
    batches = [pa.record_batch({"k": pa.array(keys[i : i + 7])}) for i in range(0, len(keys), 7)]
    got = [t["k"].to_pylist() for t in whole_groups(iter(batches), "k", 10)]
    assert [x for t in got for x in t] == keys and all(not set(a) & set(b) for a, b in zip(got, got[1:], strict=False))


def test_windows_longer_than_a_number_has_bits(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randrange(1000)}" for _ in range(130))
    rows = [(1, "a b " + passage + " c"), (2, "d " + passage + " e f")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(table(spark, rows), window=100, seed=8).collect()}
    assert got == {1: (133, 0), 2: (133, 130)}


def test_many_texts_under_no_id_cost_what_others_do(spark):
    rows = [(None, " ".join(f"w{i}-{k}" for k in range(25)) + " the same end of twenty words that all of these texts share so it goes from all of them but the first one") for i in range(300)]
    got = substring.remove_repeats(table(spark, rows)).collect()
    assert sorted(r.n_removed for r in got)[:2] == [0, 23] and len(got) == 300


def test_private_names_do_not_clash(spark):
    names = ["_left", "_right", "_t", "_next", "_at", "_sum", "_range", "before", "place", "all", "by0", "left"]
    df = spark.createDataFrame([tuple([i, *range(i, i + len(names))]) for i in range(50)], ", ".join(f"{n} long" for n in ["doc_id", *names]))
    got = shards.assign_shards(df, ["doc_id"], shards=7)
    assert got.columns == ["doc_id", *names, "row_no", "shard", "slot"]
    assert all([r[n] for n in names] == list(range(r.doc_id, r.doc_id + len(names))) for r in got.collect())


def test_a_repeated_label_counts_once(spark):
    docs = spark.createDataFrame([(i, f"good text {i} " * 5) for i in range(20)] + [(3, "good text 3 " * 5)] * 20_000, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    one = quality.train(docs.dropDuplicates(), labels)
    assert np.allclose(quality.train(docs, labels).weight, one.weight)
    assert quality.train(docs, labels, max_features=0).weight.any() == False  # noqa: E712


def test_long_runs_of_blanks_take_no_longer(spark):
    df = spark.createDataFrame([("a" + " " * 1_000_000 + "b",), ("  c d ",), (None,)], "t string")
    assert [r[0] for r in df.select(n_words(df.t)).collect()] == [2, 2, 0]
    assert fingerprint.with_fingerprint(df, "t", "f").where("f IS NOT NULL").count() == 3


def test_order_and_components(spark):
    df = spark.createDataFrame([(i % 7, i, i) for i in range(500)], "g int, i long, size long")
    rows = in_order(df, ["g", "i"], group="g", size="size").collect()
    for g in range(7):
        own = sorted((r for r in rows if r.g == g), key=lambda r: r.i)
        assert [r.row_no for r in own] == list(range(len(own)))
        assert [r.before for r in own] == [sum(x.size for x in own[:k]) for k in range(len(own))]
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 9), (7, 7), (100, 3)] + [(50, i) for i in range(51, 90)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    groups = [{1, 2, 3, 100}, {4, 5, 9}, set(range(50, 90))]
    assert got.keys() == set().union(*groups)
    assert all(len({got[i] for i in g}) == 1 and got[min(g)] in g for g in groups)


# 1


def test_substring(docs):
    rows = sorted(((key(r.doc_id), r.text) for r in docs.select("doc_id", "text").collect()))
    seen: dict[tuple, tuple] = {}
    want = {}
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if seen.setdefault(tuple(w[s : s + 20]), (i, s)) != (i, s):
                gone[s : s + 20] = [True] * 20
        want[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    got = substring.remove_repeats(docs, carry=("lang", "did")).collect()
    assert {key(r.doc_id): (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got} == want
    assert sum(r.n_removed for r in got) > 500
    for r in got:
        assert sum(x.words for x in r.removed) == r.n_removed
        assert words(r.kept_layout) == words(r.kept)
        if not r.n_removed:
            assert r.kept_layout == (dict(rows)[key(r.doc_id)] or "")


def test_substring_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    got = substring.remove_repeats(table(spark, [(5, text), (5, text), (6, text), (7, None)])).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_removed) for r in got] == [(5, 0), (5, 0), (6, 40), (7, 0)]


# 4


def shingles(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    lead = {i: i for i in sets}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((find(ids[a]), find(ids[b])))
                lead[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(docs):
    want = brute_components([(key(r.doc_id), r.text) for r in docs.collect()])
    got = minhash.near_duplicates(docs).collect()
    assert {key(r.doc_id): (r.n_shingles, key(r.component_id)) for r in got} == want
    assert all(r.kept == (key(r.doc_id) == key(r.component_id)) for r in got)


def test_near_duplicates_of_a_spread_group(spark, monkeypatch):
    """Copies that drift apart link only through each other; small blocks make them meet across parts."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 5)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_where_ids_repeat(spark):
    """Texts of one id, or of none, are linked one by one; only rows equal in id and text are one."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (3, text("c")), (5, text("c") + " x"), (5, text("d")), (7, text("b") + " x"), (9, text("e")), (9, text("e")), (10, text("a") + " y")]
    got = sorted((key(r.doc_id), r.n_shingles, key(r.component_id), r.kept) for r in minhash.near_duplicates(table(spark, rows)).collect())
    no = key(None)
    assert got == sorted([(no, 56, no, True)] * 3 + [(3, 56, 3, True), (5, 57, 3, False), (5, 56, 5, True), (7, 57, no, False), (9, 56, 9, True), (9, 56, 9, True), (10, 57, no, False)])


@pytest.mark.parametrize("percent", range(11, 101))
def test_bands_follow_the_threshold(percent):
    bands, rows = minhash.bands_for(percent)
    assert bands * rows <= minhash.HASHES and (1 - (percent / 100) ** rows) ** bands <= minhash.MISS
    assert minhash.bands_for(85) == (25, 5)


def test_thresholds_that_bands_cannot_serve(docs):
    for percent in (0, 10, 101):
        with pytest.raises(ValueError):
            minhash.near_duplicates(docs, percent=percent)


@pytest.mark.parametrize("percent", [80, 50])
def test_pairs_just_over_a_lower_threshold(spark, percent):
    """80 pairs of 100 words with a changed tail: one shingle more or less decides."""
    rows, want = [], {}
    for i in range(80):
        own = [f"{i}w{j}" for j in range(104)]
        # with the last m of 100 shingles changed, (100 - m) of (100 + m) are common
        most = (100 * 100 - percent * 100) // (100 + percent)
        m = most + i % 2
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[: 104 - m] + [f"{i}x{j}" for j in range(m)]))]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i + i % 2}
    got = minhash.near_duplicates(table(spark, rows), percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_signature_estimates():
    rng = np.random.default_rng(1)
    whole = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = whole[:3000], whole[1000:]
    least = minhash.minima(np.concatenate([a, b]), np.array([0, 3000]), minhash.FINE)
    s = minhash.signatures(least)
    assert abs(minhash.estimates(s[0], s[1]) - 0.5) < 0.06
    assert minhash.estimates(s[0], s[0]) == 1


# 3


def test_sharding(docs):
    rows = docs.select("doc_id", "text", "shard")
    got = shards.assign_shards(rows, ["doc_id"], shards=7).collect()
    n = len(got)
    assert n == rows.count()
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n // 7 + (s < n % 7)))
    for r in got:
        assert shards.locate(r.row_no, n, 7) == (r.shard, r.slot) and shards.row_at(r.shard, r.slot, n, 7) == r.row_no


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(n):
    p = feistel.Permutation(n, 5)
    out = [p(i) for i in range(n)]
    assert sorted(out) == list(range(n)) and [p.inverse(x) for x in out] == list(range(n))
    assert feistel.permute(np.arange(n), np.full(n, n), np.full(n, 5)).tolist() == out
    assert feistel.permute(np.array(out), np.full(n, n), np.full(n, 5), back=True).tolist() == list(range(n))


# 5


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 4)
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.001, 0.3, 1.0]) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (500, []), (550, [1.0, 2.0]), (551, [3.0, 1.0]), (None, [1.0] * 6), (600, [1e30, -1e30, 0.0, 0.0, 0.0, 1.0]), (3, [0.5] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), shard_rows=40).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(2**63)), 2**63 - 1), i) for i, w in ok if i != q and len(w) == len(v))[:5]
            if best:
                want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert {q: sorted(x) for q, x in got.items()} == want


# 2


def test_factorisation_identity():
    rng = np.random.default_rng(3)
    m = quality.Machine(0.1, rng.normal(size=quality.BUCKETS + 16), rng.normal(size=(quality.BUCKETS + 16, 4)).astype(np.float32), np.zeros(16), np.ones(16))
    who, at, x = np.array([0, 0, 0, 2, 2]), np.array([5, 9, 11, 5, 100]), rng.normal(size=5)
    odds, _ = m.raw(who, at, x, 3)
    for d in range(3):
        own = np.flatnonzero(who == d)
        plain = 0.1 + sum(m.weight[at[i]] * x[i] for i in own)
        pairs = sum(float(m.vector[at[i]] @ m.vector[at[j]]) * x[i] * x[j] for k, i in enumerate(own) for j in own[k + 1 :])
        assert odds[d] == pytest.approx(plain + pairs, abs=1e-4)


def test_quality_learns_and_scores_everything(spark, docs, nothing):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice("the liver is of a and study data".split()) for _ in range(60))
    rows = [(i, good() if i % 2 else good().upper().replace(" ", "!! ")) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (5000, None)], "doc_id long, quality int")
    m = quality.train(table(spark, rows), labels)
    got = {r.doc_id: r.score for r in quality.score(table(spark, rows), m).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(200, 300))
    every = quality.score(docs, m, carry=("did",)).collect()
    assert len(every) == docs.count() and all(0 <= r.score <= 1 for r in every)
    assert quality.score(nothing, m).count() == 0
    again = quality.train(table(spark, rows).repartition(5), labels)
    assert np.allclose(again.weight, m.weight)
    assert quality.train(nothing, labels).bias == pytest.approx(0)


# 6


def test_language_scores(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    low = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split() + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in low(t))
    total, distinct = sum(c.values()), len(c)
    got = maxent.language_scores(docs, chunk_bytes=20_000).collect()
    want = sorted((key(i), held(i), len(low(t)), sum(c[w] > 0 for w in low(t)), round(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in low(t)), 5)) for i, t in rows)
    assert sorted((key(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert {r.train_tokens for r in got} == {total}
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_model_is_a_distribution(spark):
    """Class probabilities sum to one, and so do those of a class's slots."""
    w = np.random.default_rng(1).normal(size=(maxent.ROWS, maxent.WIDTH)).astype(np.float32)
    past = np.arange(6, dtype=np.uint64).reshape(3, 2) * np.uint64(10**17)
    for active in (maxent.rows_of(past), maxent.rows_of(past, np.array([3, 15]))):
        assert np.allclose(sum(np.exp(maxent.log_choice(w, active, np.full(2, k))) for k in range(maxent.WIDTH)), 1, atol=1e-5)
    t = maxent.Trainer(np.zeros_like(w))
    past, kind = np.tile(past[:, :1], (1, 100)), np.full(100, 6 * maxent.SLOTS + 9)
    for _ in range(30):
        t.step(past, kind)
    assert np.exp(maxent.log_kind(t.w, past[:, :1], kind[:1]))[0] > 0.8


def test_gradients_sum_by_row():
    rng = np.random.default_rng(3)
    g, rows = rng.normal(size=(500, maxent.WIDTH)).astype(np.float32), rng.geometric(0.1, 1500) - 1
    at, sums, often = maxent.row_sums(g, rows)
    want = np.zeros((rows.max() + 1, maxent.WIDTH))
    np.add.at(want, rows, np.concatenate([g, g, g]))
    assert at.tolist() == np.unique(rows).tolist() and often.tolist() == np.bincount(rows)[at].tolist() and np.allclose(sums, want[at], atol=1e-4)


def test_a_step_holds_few_numbers_for_a_token():
    """Time goes by what is moved; a row of gradients, one of weights and what sums them are enough."""
    import tracemalloc

    rng = np.random.default_rng(4)
    past = maxent.history(rng.zipf(1.3, 8192).astype(np.uint64) % np.uint64(3000) * np.uint64(0x9E3779B97F4A7C15), np.arange(8192) // 400)
    kind = rng.integers(0, maxent.KINDS, 8192)
    t = maxent.Trainer(np.zeros((maxent.ROWS, maxent.WIDTH), np.float32))
    t.step(past, kind)
    tracemalloc.start()
    try:
        t.step(past, kind)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 6.2 * 8192 * maxent.WIDTH * 4  # 6.75 rows of 32-bit numbers for each token before, 5.7 now


def test_kinds_by_last_letters():
    from citeweld.llm._words import U, chunks, mix

    words = ["a", "Ab", "AB", "aB", "é", "x.", "Zz", "@[", "1" * 30]
    (c,) = chunks(pa.array([" ".join(words), ""]), lower=True)
    h, kind, text = maxent.tokens(c)
    low = lambda b: b + 32 if 65 <= b <= 90 else b
    ends = [(low(w.encode()[-1]), low(w.encode()[-2]) if len(w.encode()) > 1 else 0) for w in words]
    group = [1 + int(mix(np.array([x * 256 + y], U))[0]) % (maxent.CLASSES - 1) for x, y in ends]
    assert (kind // maxent.SLOTS).tolist() == [*group, 0, 0] and text.tolist() == [0] * 10 + [1]
    assert (kind % maxent.SLOTS).tolist()[:9] == [int(x) % maxent.SLOTS for x in mix(c.hash + U(77))] and h[9] == h[10] == maxent.END


def test_scores_by_plain_loops(spark, docs):
    """score is the sum over tokens of class, slot and word, each worked out alone from the weights and plain counts."""
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    texts = docs.selectExpr("doc_id", "coalesce(text, '') AS text", "coalesce(crc32(cast(doc_id AS string)) % 10 = 0, false) AS held")
    w = maxent.train(texts.where("NOT held")).astype(float)
    seen = {}
    for i, t in rows:
        (c,) = chunks(pa.array([t]), lower=True)
        h, kind, text = maxent.tokens(c)
        seen[i, t] = h.tolist(), kind.tolist(), maxent.history(h, text)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(x for i, t in rows if not held(i) for x in zip(*seen[i, t][:2], strict=True))
    size, distinct = Counter(), Counter()
    for (_, k), n in count.items():
        size[k] += n
        distinct[k] += 1
    soft = lambda bias, at, chosen: (z := w[bias] + w[at].sum(0))[chosen] - math.log(sum(math.exp(x) for x in z))
    # the weights' fit is not repeated bit by bit in another run of tasks, hence the tolerance
    for r in sorted(maxent.language_scores(docs).collect(), key=lambda r: r.n_tokens)[:12]:
        fits = []
        for i, t in rows:
            if i == r.doc_id:
                want = 0.0
                h, kind, past = seen[i, t]
                for j, (x, k) in enumerate(zip(h, kind, strict=True)):
                    group, slot = divmod(k, maxent.SLOTS)
                    p = past[:, j : j + 1]
                    want += soft(maxent.BIAS, maxent.rows_of(p)[1].ravel(), group) / math.log(10)
                    if group:
                        want += soft(maxent.BIAS + 1 + group, maxent.rows_of(p, np.array([group]))[1].ravel(), slot) / math.log(10)
                    want += math.log10((count[x, k] + 0.1) / (size[k] + 0.1 * (distinct[k] + 1)))
                fits.append(abs(want - r.score) < 0.02 * len(h))
        assert any(fits)


def test_trigrams_are_learnt(spark):
    """Each word follows from the two before it, not from one of them: held-out texts become likelier than by counts."""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        t = [rng.choice("ab"), rng.choice("ab")]
        for _ in range(60):
            t.append("ab"[(t[-1] == "a") ^ (t[-2] == "a")] if rng.random() < 0.97 else rng.choice("ab"))
        rows.append((i, " ".join(t)))
    got = maxent.language_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), rounds=6).where("held_out").collect()
    gain = sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got)
    assert gain > 0.1  # of the 0.3 that a choice of two is worth


# 7


def test_packing(docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    ids = {key(r.doc_id): np.array(own.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4") for r in docs.collect()}
    got = packing.pack(docs, path, carry=("did", "lang"), shard_bytes=100_000).collect()
    length: Counter = Counter()
    there: dict[int, list] = {}
    for r in got:
        assert r.ids == ids[key(r.doc_id)][r.start : r.start + r.length].tobytes() and r.doc_tokens == len(ids[key(r.doc_id)])
        length[key(r.doc_id)] += r.length
        there.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert length == {k: len(v) for k, v in ids.items()}
    for parts in there.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0  # full, or a power of two


def test_special_strings_are_encoded_by_the_file():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    texts = ["", "a<|endoftext|>b", "it's 12  x\n\n y é ñ  ", " x 　 y", "𝒳 😀"]
    own = Tokenizer.from_file(path)
    assert packing.encode(texts, path) == [np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_ids_of_many_texts_are_merged_together():
    """One call for all words not met before, almost none for words met; odd blanks, long words and cut steps change no id."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab1 2'sl!\t\n\x0b\x1c\x85\u00a0\u3000\u2003\u00e9\u6f22\x00") for _ in range(rng.randrange(30))) for _ in range(2000)]
    texts += ["x" * 300, "a" + " " * 300 + "b", "\n" * 300 + "a", " ", "a\u00a0 b", "a \u00a0b", "\x00" * 300]
    assert packing.encode(texts, path) == [np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    coder, calls = packing.Coder(path), []
    real = coder.ranked.encode_ordinary

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return real(text)

    coder.ranked = Counted()
    packing._tokenizers["counted"] = coder
    words = [" ".join(f"word{i}x{k}" for k in range(40)) for i in range(100)]
    first = packing.encode(words, "counted")
    assert len(calls) == 1
    assert packing.encode(words, "counted") == first == packing.encode(words, path)
    assert sum(map(len, calls[1:])) < len(calls[0]) / 20  # a few words share a slot


def test_frequent_terms_are_not_looked_up_for_each_seed(monkeypatch):
    rng = np.random.default_rng(3)
    own = [np.unique(np.r_[rng.integers(0, 20, 15), rng.integers(20, 4000, 10)]) for _ in range(300)]
    term, doc = np.concatenate(own), np.repeat(np.arange(300), [len(x) for x in own])
    tf, length = rng.integers(1, 4, len(term)), np.array([len(x) for x in own])
    idf = rng.random(4000) + 0.1
    index = packing.Index(term, doc, tf, length, idf, float(length.mean()))
    looked_up = sum(int(index.size[t]) for t in index.query_term)
    assert looked_up < 20_000  # 600,000 with the frequent ones
    monkeypatch.setattr(packing, "DENSE", 0)
    plain = packing.Index(term, doc, tf, length, idf, float(length.mean()))
    for seed in range(0, 300, 7):
        unused = np.arange(300) != seed
        assert list(index.neighbours(seed, unused)) == list(plain.neighbours(seed, unused))


def test_neighbours_follow_their_seed():
    term = np.array([0, 1, 2, 0, 1, 9, 7, 8])
    doc = np.array([0, 0, 0, 2, 2, 1, 3, 3])
    index = packing.Index(term, doc, np.ones(8), np.array([3, 1, 2, 2]), np.ones(16), 2.0)
    assert packing.order_documents(np.array([600, 300, 300, 100]), index)[:2] == [0, 2]
    assert packing.cuts(2500).tolist() == [1024, 2048, 2304, 2432, 2496, 2500]


def test_texts_on_one_subject_share_a_shard(spark):
    P = pytest.importorskip("public_tokenizers")
    rng = random.Random(7)
    rows = [(i, " ".join([f"w{rng.randrange(50)}" for _ in range(60)] + [f"subject{i % 40}"] * 12)) for i in range(400)] + [(1000, None), (None, ""), (None, "w1")]
    got = packing.pack(table(spark, rows).repartition(3), P.path("byte_bpe_50k.json"), shard_bytes=16_000).collect()
    shards: dict[int, set] = {}
    for r in got:
        if r.doc_id is not None and r.doc_id < 400:
            shards.setdefault(r.doc_id % 40, set()).add(r.sequence_id >> 40)
    assert len({r.sequence_id >> 40 for r in got}) > 5
    assert all(len(x) == 1 for x in shards.values())
    assert len({(r.doc_id, r.doc_tokens) for r in got}) == 403


def test_neighbours_are_ranked_by_all_terms():
    """Against brute force; the last two documents share only the lightest term, which 12 terms of a seed would leave out."""
    rng = np.random.default_rng(6)
    own = [np.unique(rng.integers(0, 60, rng.integers(15, 40))) for _ in range(40)]
    own += [np.r_[59, np.arange(60, 80)], np.r_[59, np.arange(80, 100)]]
    term, doc = np.concatenate(own), np.repeat(np.arange(42), [len(x) for x in own])
    tf, length = rng.integers(1, 4, len(term)), np.array([len(x) for x in own])
    idf = np.log1p((42 - np.bincount(term, minlength=100) + 0.5) / (np.bincount(term, minlength=100) + 0.5))
    index = packing.Index(term, doc, tf, length, idf, float(length.mean()))
    weight = {(d, t): w for d, t, w in zip(doc.tolist(), term.tolist(), index.weight.tolist(), strict=True)}
    for seed in range(42):
        unused = np.arange(42) != seed
        score = {d: sum(weight.get((d, t), 0) for t in own[seed].tolist()) for d in range(42) if d != seed}
        got = list(index.neighbours(seed, unused))
        assert sorted(got) == sorted(d for d in score if score[d] > 0)
        assert [score[d] for d in got] == pytest.approx(sorted((x for x in score.values() if x > 0), reverse=True))
    assert 41 in index.neighbours(40, np.ones(42, bool))


# 8


def test_archives(spark, tmp_path):
    big, other = "<p>é</p>" * 40, "y" * 99
    rows = [(3, "http://a", big), (1, "http://b\r\nX: y", big), (2, None, other), (4, "u", other), (5, "u", None), (6, "u", ""), (7, "u", big + "\r\n\r\nWARC/1.1\r\n\r\n"), (1, "http://b", big), (None, "n", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    resolved = warc.resolve_revisits(pages)
    warc.write_archives(resolved, str(tmp_path / "w"))
    got = sorted((key(r.page_id), r.record_type, r.bytes, r.digest) for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    full = lambda h: (h or "").encode()
    kind = lambda i, h: "revisit" if h == big and i != 1 else "response"
    assert got == sorted((key(i), kind(i, h), len(full(h)), hashlib.sha256(full(h)).hexdigest()) for i, _, h in rows)
    for r in warc.read_archives(spark, str(tmp_path / "w")).where("record_type = 'response'").collect():
        assert bytes(r.payload) in {full(h) for _, _, h in rows} and r.http.startswith("HTTP/1.1 200")


# 9


def test_fingerprints(docs):
    rows = sorted({(key(r.doc_id), r.text or "") for r in docs.collect()})
    got = {key(r.doc_id): r for r in fingerprint.fingerprint_edits(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 128 and 0 <= r.near_next <= 1
        a, b = ({tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} for w in (words(text), words(edited)))
        assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.25
    assert got[2003].fingerprint == got[2004].fingerprint != got[2005].fingerprint
    assert got[2006].fingerprint == got[2007].fingerprint and got[2006].near_next == 1


# 10


def test_mixing(spark, docs):
    named, pieces, sources = mixing.mix(docs, block=16, shard_slots=64)
    size = {r.source: r.source_size for r in sources.collect()}
    order = sorted(size, key=lambda s: (s is None, s))
    total = sum(size.values())
    want, fixed = {}, set()
    while True:
        free = [s for s in order if s not in fixed]
        share = (total - sum(3 * size[s] for s in fixed)) / sum(order.index(s) % 3 + 1 for s in free)
        want = {s: 3 * size[s] if s in fixed else share * (order.index(s) % 3 + 1) for s in order}
        over = {s for s in free if want[s] > 3 * size[s]}
        if not over:
            break
        fixed |= over
    assert {r.source: pytest.approx(r.target) for r in sources.collect()} == want
    taken: Counter = Counter()
    per: Counter = Counter()
    info = {(r.source_no, r.doc): r for r in named.collect()}
    places = set()
    for p in pieces.collect():
        r = info[p.source_no, p.doc]
        assert 0 <= p.from_word and p.from_word + p.words <= r.size
        taken[r.source] += p.words
        per[p.source_no, p.doc] += p.words
        places.add((p.shard, p.place))
    assert all(abs(taken[s] - want[s]) <= 16 for s in order)
    assert all(n <= 3 * info[k].size for k, n in per.items())
    assert len(places) == max(s * 64 + p for s, p in places) + 1  # every slot of every shard is drawn
    again = mixing.mix(docs.repartition(5), block=16, shard_slots=64)[1]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, pieces.collect()))
    out = mixing.mixed_documents(docs, carry=("lang",), block=16, shard_slots=64).collect()
    by: Counter = Counter()
    for r in out:
        by[r.source] += len(words(r.text))
    assert by == taken


def test_mixed_documents_with_repeated_rows(spark):
    """Each row takes its own plan: as many words as the mix takes, and no row more than three times."""
    text = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    df = spark.createDataFrame([(5, text("a", 50), "s")] * 4 + [(6, text("b", 300), "t"), (7, text("c", 200), None), (7, text("c", 200), None), (None, None, "s")], "doc_id long, text string, source string")
    taken: Counter = Counter()
    named, pieces, _ = mixing.mix(df, block=16)
    info = {(r.source_no, r.doc): r.source for r in named.collect()}
    for p in pieces.collect():
        taken[info[p.source_no, p.doc]] += p.words
    by: Counter = Counter()
    each: Counter = Counter()
    for r in mixing.mixed_documents(df, block=16).collect():
        by[r.source] += len(words(r.text))
        each.update((r.source, w) for w in words(r.text))
    assert by == taken
    assert all(n <= 3 * {"s": 4, "t": 1, None: 2}[s] for (s, _), n in each.items())


# all


def test_empty_tables(spark, nothing):
    P = pytest.importorskip("public_tokenizers")
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        substring.remove_repeats(nothing), minhash.near_duplicates(nothing), shards.assign_shards(nothing, ["doc_id"]), topk.top_k(none, none), maxent.language_scores(nothing),
        packing.pack(nothing, P.path("byte_bpe_50k.json")), warc.resolve_revisits(pages), fingerprint.fingerprint_edits(nothing), mixing.mix(nothing)[1], mixing.mixed_documents(nothing),
    ):
        assert df.count() == 0
