"""Whole runs on small files, and the parts that they rest on."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweld.config import MatchConfig, Mode
from citeweld.functions.similarity import _block, _long, jaro_winkler, jaro_winkler_many
from citeweld.operators import evaluate, labels, predicates
from citeweld.operators.candidates import candidates
from citeweld.plans import linkage
from citeweld.sources import ris, tables, writers
from citeweld.spark import components, cut

LIVER = "A long enough title about the liver: and a subtitle that is certainly longer than forty characters"


def record(*fields: tuple[str, str]) -> str:
    return "\n".join([*(f"{t}  - {v}" for t, v in fields), "ER  - ", ""]) + "\n"


def paper(number: int | None, year: str = "2010", title: str = LIVER, journal: str = "Journal of Medicine", authors: tuple[str, ...] = ("Smith, Arthur", "Doe, Jane"), **more: str) -> str:
    fields = [("TY", "JOUR"), *[("AU", x) for x in authors], ("TI", title), ("T2", journal)]
    fields += [("PY", year)] * bool(year) + list(more.items()) + ([("ID", str(number))] if number else [])
    return record(*fields)


@pytest.fixture
def save(tmp_path):
    def write(text: str, name: str = "in.ris") -> str:
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    return write


def kept(result):
    return [r["id"] for r in result.items.where("kept").orderBy("pos").collect()]


def test_remove_keeps_first_and_completes_it(spark, save):
    path = save("﻿" + paper(1, SP="12-4") + paper(2, "2011", SP="12-14", DO="10.1000/a") + paper(3, title="Another work on quite different things", authors=("Else, S",), SP="99"))
    r = linkage.dedup_one(spark, path)
    assert (r.total, r.written, r.labelled) == (3, 2, 2)
    text = "\n".join(x.value for x in r.lines.orderBy("pos").collect())
    assert "DO  - https://doi.org/10.1000/a" in text and "SP  - 12-14" in text and text.startswith("TY  - JOUR\nAU  - Smith, Arthur\nAU  - Doe, Jane\nDO")


def test_mark_labels_with_the_newest_year(spark, save):
    r = linkage.dedup_one(spark, save(paper(1, SP="12") + paper(2, "2011", SP="12")), Mode.MARK)
    assert [x["label"] for x in r.items.orderBy("pos").collect()] == ["2", "2"]
    assert all("LB  - 2" in x.value for x in r.lines.collect())


def test_years_apart_and_years_missing(spark, save):
    r = linkage.dedup_one(spark, save(paper(1, "2008", SP="12") + paper(2, "2010", SP="12")))
    assert r.written == 2
    r = linkage.dedup_one(spark, save(paper(1, "", SP="12") + paper(2, "", SP="12")))
    assert r.written == 2  # without a year nothing leads
    r = linkage.dedup_one(spark, save(paper(1, "", SP="12") + paper(2, "2010", SP="12")))
    assert kept(r) == [1] and r.items.where("kept").first()["year"] == 2010


def test_two_files(spark, save):
    old = save(paper(1, SP="12"), "old.ris")
    new = save(paper(1, "2011", SP="12") + paper(2, title="Another work on quite different things", SP="99") + paper(3, title="Another work on quite different things", SP="99"), "new.ris")
    r = linkage.dedup_two(spark, new, old)
    assert r.written == 1 and kept(r) == [2]
    r = linkage.dedup_two(spark, new, old, Mode.MARK)
    assert [x["label"] for x in r.items.orderBy("pos").collect()] == ["-1", "2", "2"]


def test_inputs_that_are_no_export(spark, save):
    with pytest.raises(ris.InvalidRis):
        linkage.dedup_one(spark, save("TY  - JOUR\nTI  - a\n"))
    with pytest.raises(ris.InvalidRis):
        linkage.dedup_one(spark, save(paper(1) + paper(1)))


def test_reading_rules(spark, save):
    chapter = record(("TY", "CHAP"), ("TI", "A series of books\nThe title of the chapter"), ("SN", "0002-9343\n978-0-306-40615-7"), ("AU", "NA"), ("SP", "3"), ("EP", "9"))
    trial = record(("TY", "JOUR"), ("AU", "Nct"), ("T2", "http://clinicaltrials.gov/show/NCT00969397"), ("TI", "A trial"))
    review = record(("TY", "JOUR"), ("T2", "Cochrane Database Syst Rev"), ("DO", "10.1002/14651858.CD011659.pub2"))
    a, b, c = ris.read_items(spark, save(chapter + trial + review)).orderBy("pos").collect()
    assert a["titles"][0] == "title of the chapter" and a["issns"] == ["00029343"] and a["isbns"] == ["030640615"] and a["page_start"] == "3" and a["several_pages"] and a["id"] == 1
    assert b["is_trial"] and b["journals"] == ["https://clinicaltrials.gov"] and b["page_start"] == "969397" and b["title"] == "A trial"
    assert c["is_cochrane"] and c["page_start"] == "11659"


def test_split_files_keep_their_order(spark, save):
    path = save("".join(paper(i, SP=str(i)) for i in range(1, 400)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert [r["id"] for r in ris.read_items(spark, path).orderBy("pos").collect()] == list(range(1, 400))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_output_names():
    assert writers.output_name("a/x.txt", Mode.MARK) == "a/x_mark.txt"
    assert writers.output_name("a/x.ris", Mode.REMOVE) == "a/x_deduplicated.ris"


def test_written_file_reads_back(spark, save, tmp_path):
    out = str(tmp_path / "out")
    linkage.dedup_one(spark, save(paper(1, SP="12") + paper(2, SP="12") + paper(3, title="Another work on quite different things", SP="9")), Mode.MARK, out)
    again = ris.read_items(spark, out, labels=True).orderBy("pos").collect()
    assert [r["label"] for r in again] == ["1", "1", None]


@pytest.mark.parametrize("two_files", [False, True])
def test_replay_by_components_agrees_with_one_pass(two_files):
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randint(3, 12)
        rows = [{"pos": i, "id": i + 1, "year": rng.choice([0, 2000, 2001, 2002, 2003]), "is_reply": rng.random() < 0.2, "title": rng.choice([None, f"t{i}"])} for i in range(n)]
        edges = {(i, j): (rng.random() < 0.6, rng.random() < 0.6) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.25}
        steps = labels.year_steps([r["year"] for r in rows], two_files)
        whole = labels.replay(rows, edges, steps, two_files)
        group = {i: i for i in range(n)}
        for _ in range(n):
            for i, j in edges:
                group[i] = group[j] = min(group[i], group[j])
        parts = {}
        for g in set(group.values()):
            own = [r for r in rows if group[r["pos"]] == g]
            parts |= labels.replay(own, {k: v for k, v in edges.items() if group[k[0]] == g}, steps, two_files)
        assert parts == whole


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(1000, i) for i in range(1001, 1100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near: dict[int, set[int]] = {}
    for x, y in edges:
        if x != y:
            near.setdefault(x, set()).add(y)
            near.setdefault(y, set()).add(x)
    assert got.keys() == near.keys()
    for x in near:
        seen, todo = {x}, [x]
        while todo:
            for z in near[todo.pop()] - seen:
                seen.add(z)
                todo.append(z)
        assert got[x] in seen and {k for k, v in got.items() if v == got[x]} == seen


def test_no_pair_of_distant_years_is_made(spark):
    """20,000 records on page 1 over 100 years: only pairs of near years, each once."""
    rows = spark.range(20_000).selectExpr("id + 1 AS pos", "CAST(1900 + id % 100 AS INT) AS year", "'1' AS page_start", "CAST(array() AS array<string>) AS dois")
    found = candidates(rows)
    per = 200
    assert found.count() == 100 * per * (per - 1) // 2 + 99 * per * per
    assert "(band#" in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("two_files", [False, True])
def test_candidates_against_all_pairs(spark, two_files):
    rng = random.Random(8)
    rows = [(i + 1, rng.choice([0, 0, 2000, 2001, 2002, 2004]), rng.choice([None, "1", "2"]), rng.sample(["x", "y", "z"], rng.choice([0, 0, 1, 2]))) for i in range(90)]
    df = spark.createDataFrame(rows, "pos long, year int, page_start string, dois array<string>")
    got = [tuple(r) for r in candidates(df, two_files).collect()]

    def met(x, y):
        near = abs(x[1] - y[1]) <= 1 if x[1] and y[1] else bool(x[1] or y[1]) or two_files
        pages, known = x[2] is not None and y[2] is not None, bool(x[3] and y[3])
        return near and ((pages and x[2] == y[2]) or (known and bool(set(x[3]) & set(y[3]))) or not (pages or known))

    want = {(x[0], y[0]) for i, x in enumerate(rows) for y in rows[i + 1 :] if met(x, y)}
    assert len(got) == len(set(got)) and set(got) == want


def test_lines_after_a_skipped_field_belong_to_the_field_before(spark, save):
    text = "TY  - JOUR\nSN  - 0002-9343\nAU  - NA\n1234-5678\nTI  - " + "t" * 1_200_000 + "\nID  - 0\nER  - \n\n"
    item = ris.read_items(spark, save(text)).first()
    assert item.issns == ["00029343", "12345678"] and item.authors == [] and item.id == 0 and len(item.titles[0]) == 1_200_000


def test_similarity():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 14)))
    a, b = [word() for _ in range(3000)], [word() for _ in range(3000)]
    long = [(" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(n)), " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(m))) for n, m in ((9, 9), (30, 28), (200, 190), (10, 200))]
    assert all(abs(jaro_winkler(x, y) - float(_block([x], [y], False)[0])) < 1e-12 for x, y in long)
    assert all(abs(jaro_winkler(x, y) - _long(x, y, False)) < 1e-12 for x, y in [*long, *zip(a, b, strict=True)] if x and y and x != y)
    a, b = a + [x for x, _ in long], b + [y for _, y in long]
    many = jaro_winkler_many(a, b)
    assert all(abs(jaro_winkler(x, y) - z) < 1e-12 for x, y, z in zip(a, b, many, strict=True))
    assert jaro_winkler("", "") == 1 and jaro_winkler("", "a") == 0
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)


def test_journals_alike():
    yes = [("N Engl J Med", "New England Journal of Medicine"), ("BMJ", "British Medical Journal"), ("JAMA", "Journal of the American Medical Association"), ("AJNR Am J Neuroradiol", "American Journal of Neuroradiology")]
    no = [("Lancet", "Nature"), ("http://a", "http://b")]
    assert all(predicates.journals_alike([x], [y], 0.9) for x, y in yes)
    assert not any(predicates.journals_alike([x], [y], 0.9) for x, y in no)


def test_thresholds():
    with pytest.raises(ValueError, match="authors"):
        MatchConfig(authors=1.5)


def test_evaluation(spark, tmp_path):
    truth = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, None), (5, 5), (6, 5)], "id int, dedupid int")
    result = spark.createDataFrame([(1, 1), (2, 1), (3, 9), (4, None), (5, None), (6, None)], "id int, dedupid int")
    out = evaluate.classified(result, truth)
    assert {r["id"]: r["outcome"] for r in out.collect()} == {1: "TP", 2: "TP", 3: "FP", 4: "TN", 5: "TN", 6: "FN"}
    m = evaluate.metrics(out).first()
    assert (m["tp"], m["fn"], m["tn"], m["fp"], m["unique_duplicates"]) == (2, 1, 2, 1, 1) and m["sensitivity"] == pytest.approx(2 / 3)
    assert evaluate.without_kept(evaluate.metrics(out)).first()["tn"] == 3
    assert {tuple(r) for r in evaluate.wrong_pairs(out).collect()} == {("FN", 5, 6), ("FP", 3, 9)}
    (tmp_path / "gold").write_text("10\t1\n11\t1\n12\t2\n")
    gold = evaluate.gold_sets(tables.read_gold(spark, str(tmp_path / "gold")))
    assert {r["id"]: r["set"] for r in gold.collect()} == {1: [1, 2], 2: [1, 2], 3: [3]}
    (tmp_path / "pairs").write_text("a\tb\na\tb\nbad\n")
    assert [tuple(r) for r in tables.read_pairs(spark, str(tmp_path / "pairs")).collect()] == [("a", "b")]


def test_streaming_absorbs_new_files(spark, tmp_path):
    from citeweld.streaming.incremental import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ris").write_text(paper(1, SP="12") + paper(2, SP="12"))
    for expected in (1, 2):
        watch(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "store")).count() == expected
        (tmp_path / "in" / "b.ris").write_text(paper(1, "2011", SP="12") + paper(2, title="Another work on quite different things", SP="99"))


def test_pairs_can_be_explained_and_tests_replaced(spark, save):
    items = ris.read_items(spark, save(paper(1, SP="12") + paper(2, SP="13", journal="J Med")))
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    r = predicates.explained(items, pairs).first()
    assert (r.pages_or_dois, r.same_work, r.journals) == (False, None, True) and r.authors == 1 and r.titles == 1
    assert predicates.compared(items, pairs).count() == 0
    assert predicates.compared(items, pairs, pages_test=lambda: F.lit(True)).first().plain
    assert predicates.compared(items, pairs, pages_test=lambda: F.lit(True), journals_test=lambda *_: False).count() == 0
    never, always = (lambda p, q: np.zeros(len(p))), (lambda p, q: np.ones(len(p)))
    assert predicates.compared(items, pairs, pages_test=lambda: F.lit(True), authors_test=never).count() == 0
    assert predicates.compared(items, pairs, pages_test=lambda: F.lit(True), titles_test=never).where("plain").count() == 0
    assert predicates.compared(items, pairs, pages_test=lambda: F.lit(True), authors_test=always, titles_test=always).first().plain
    assert predicates.compared(items, pairs, MatchConfig(authors=1.0), pages_test=lambda: F.lit(True)).where("plain").count() == 0


def test_truth_output(spark, save, tmp_path):
    records = ris.read_records(spark, save(paper(1, SP="12", DO="10.1/x") + paper(2) + paper(3)))
    truth = spark.createDataFrame([(1, 1, True), (2, None, False)], "id int, dedupid int, validated boolean")
    lines = [r.value for r in writers.truth_lines(records, truth).orderBy("pos").collect()]
    assert "CA  - Duplicate" in lines[0] and "LB  - 1" in lines[0] and "CA  - Unknown" in lines[1] and "CA  - Unknown" in lines[2]
    assert "CA  - DUPLICATE" in writers.truth_lines(records, truth, by_validation=True).orderBy("pos").first().value
    items = ris.items(records).withColumn("label", F.lit("1"))
    writers.write_table(writers.truth_rows(records, items), str(tmp_path / "truth"))
    back = tables.read_truth(spark, str(tmp_path / "truth")).orderBy("id").collect()
    assert [r.id for r in back] == [1, 2, 3] and back[0].dedupid == 1 and back[0].pages == "12" and back[0].number_authors == 2 and back[0].authors == "Smith, Arthur; Doe, Jane"


def test_first_guesses_gather_no_sets(spark):
    from citeweld.plans import catalogue

    pairs = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 3), (13, 3)], "record_id int, duplicate_id int")
    items = spark.createDataFrame([(1, None), (2, "x"), (3, None), (4, "x"), (5, "x")], "id long, label string")
    found = evaluate.prefilled(items, evaluate.gold_alone(pairs))
    assert sorted((r.id, r.outcome) for r in found.collect()) == [(1, "FN"), (2, "TP"), (3, "TN"), (4, "FP"), (4, "FP")]
    plan = catalogue.QUERIES["gold_prefill"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


def test_forms_of_long_titles_go_back_in_small_batches(spark):
    class Records:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    import pyarrow as pa

    text = "A sentence of so many words, which is followed by others. " * 300
    record = {"pos": 1, "fields": [{"tag": "TI", "value": text, "more": None}]}
    kind = pa.struct([("tag", pa.string()), ("value", pa.string()), ("more", pa.list_(pa.string()))])
    batch = pa.RecordBatch.from_pylist([record] * 40, schema=pa.schema([("pos", pa.int64()), ("fields", pa.list_(kind))]))
    back = list(ris.items(Records())(iter([batch])))
    assert sum(b.num_rows for b in back) == 40
    assert max(b.nbytes for b in back) < 10_000_000 < sum(b.nbytes for b in back)


def test_matches_of_replies_alone_do_not_join_groups(spark, monkeypatch):
    from citeweld.plans import matching

    none = matching.blank()
    own = {"pos": F.col("pos"), "id": F.col("pos"), "year": F.lit(2000), "is_reply": F.col("pos") == 20}
    items = spark.range(1, 25).withColumnRenamed("id", "pos").select(*[own.get(c, none[c]).alias(c) for c in none])
    edges = [(1, 2, True, True), (2, 3, False, True), (3, 4, False, True), (20, 21, False, True), (21, 22, False, True), (22, 23, True, False)]
    matches = spark.createDataFrame(edges, "a long, b long, plain boolean, as_reply boolean")
    used = {(r.a, r.b) for r in labels._usable(items, matches).collect()}
    assert used == {(1, 2), (20, 21), (21, 22), (22, 23)}
    found = {r.pos: r.label for r in labels.labelled(items, matches).where("label IS NOT NULL").collect()}
    rows = [r.asDict() for r in items.collect()]
    whole = labels.replay(rows, {(a, b): (p, r) for a, b, p, r in edges}, [2000], False)
    assert found == {k: s["label"] for k, s in whole.items() if s["label"] is not None} and found[2] == "1" and 3 not in found
    assert labels._usable(items.withColumn("is_reply", F.lit(False)), matches).count() == 2


def test_titles_are_compared_by_places_as_one_by_one(spark):
    import pyarrow as pa

    rng = random.Random(5)
    base = ["".join(rng.choices("aabcdeeefghi jk lmnopqrstuvwxyz0", k=n)) for n in (170, 400, 700, 701, 1500)]
    noisy = ["".join(c if rng.random() > 0.06 else rng.choice(["", "x", c + c]) for c in rng.choice(base)) for _ in range(40)]
    strings = [*base, *noisy, "a", "ab", "z" * 200, "z" * 300, "é" * 200, "ab" * 400, "ba" * 400, "b" * 300 + "a" * 300, "a" * 300 + "b" * 300]
    forms = pa.array([[x] for x in strings] + [[], [base[0], noisy[0]]], pa.list_(pa.string()))
    first, second = (np.array(v) for v in zip(*[(i, j) for i in range(len(forms)) for j in range(len(forms))], strict=True))
    lists = forms.to_pylist()
    exact = predicates.best([lists[i] for i in first], [lists[j] for j in second], cut_ends=True)
    for need in (0.5, 0.89, 0.94, 1.0):
        wanted = np.full(len(first), need)
        assert (predicates._exceed(forms, first, second, wanted) == (exact > wanted)).all()
        assert not (exact > wanted)[~predicates.may_exceed(forms, first, second, wanted)].any()
    # pairs far beyond the number of titles: each title reaches a group once
    groups = []
    run = predicates._titles(lambda p, q: groups.append(len(p)) or np.ones(len(p)))
    pairs = pa.table({"g": [0] * 600, "a": [1] * 600, "b": list(range(2, 602)), "as_reply": [False] * 600, "need": [0.5] * 600})
    own = pa.table({"h": [0] * 601, "side": [0] + [1] * 600, "pos": list(range(1, 602)), "titles": pa.array([["t"]] * 601, pa.list_(pa.string()))})
    assert run(pairs, own).num_rows == 600 and sum(groups) == 600


@pytest.mark.parametrize("two_files", [False, True])
def test_blocks_give_what_comparing_a_list_of_pairs_gives(spark, monkeypatch, two_files):
    from citeweld.operators import blocks
    from citeweld.plans import matching

    rng = random.Random(11)
    words = ["liver", "kidney", "trial", "of", "the", "long", "study", "cells", "growth", "in"]
    texts = [" ".join(rng.choices(words, k=n)) for n in (3, 8, 40, 60)]
    some = lambda values, most: sorted({rng.choice(values) for _ in range(rng.randrange(most + 1))})
    none, rows = matching.blank(), []
    for pos in range(1, 401):
        title = rng.choice(texts) + rng.choice(["", " a", " cells", " x y"])
        rows.append((pos, rng.choice([0, 2000, 2001, 2002, 2004]), rng.choice([None, None, "1", "2"]), some(["d1", "d2", "d3"], 2), some(["i1", "i2"], 1), some(["s1", "s2"], 2), some(["Smith A; Doe J", "Smith B; Doe J", "Quist Z"], 2), some(["Lancet", "Lancet Oncology", "BMJ", "Gut"], 2), some([title, title[:-3], "other words"], 2), *(rng.random() < 0.1 for _ in range(5))))
    names = "pos year page_start dois isbns issns all_authors journals titles several_pages is_reply is_phase is_cochrane is_trial".split()
    kinds = "pos long, year int, page_start string, dois array<string>, isbns array<string>, issns array<string>, all_authors array<string>, journals array<string>, titles array<string>, several_pages boolean, is_reply boolean, is_phase boolean, is_cochrane boolean, is_trial boolean"
    own = spark.createDataFrame(rows, kinds)
    items = cut(own.select(*[(F.col(c) if c in names else none[c]).alias(c) for c in none]))
    found = lambda df: sorted(map(tuple, df.select("a", "b", "plain", "as_reply").collect()))
    wanted = found(predicates.compared(items, candidates(items, two_files)))
    assert len(wanted) == len(set(wanted)) > 500
    assert found(blocks.matches(items, two_files)) == wanted
    # pieces and batches of a few rows
    monkeypatch.setattr(blocks, "PIECE", 6_000)
    monkeypatch.setattr(blocks, "CELLS", 50)
    assert found(blocks.matches(items, two_files)) == wanted
    assert found(blocks.matches(items, two_files, replies=False).where("plain").withColumn("as_reply", F.lit(None).cast("boolean"))) == [(a, b, p, None) for a, b, p, _ in wanted if p]


def test_no_pair_of_candidates_is_moved(spark):
    from citeweld.operators import blocks
    from citeweld.plans import matching

    own = {"pos": F.col("pos"), "year": F.lit(2000), "titles": F.array(F.lit("t"))}
    none = matching.blank()
    items = cut(spark.range(1, 501).withColumnRenamed("id", "pos").select(*[own.get(c, none[c]).alias(c) for c in none]))
    assert candidates(items).count() == 500 * 499 // 2
    assert blocks.dealt(items, False).count() == 500


def test_starts_rule_out_only_what_is_unlike():
    from citeweld.functions import similarity

    rng = random.Random(8)
    letters = "aabcdeeefghi jk lmnopqrstuvwxyz0"
    base = ["".join(rng.choices(letters[:k], k=n)) for n in (300, 700, 2000) for k in (4, 12, 32)]
    strings = [*base, *["".join(c if rng.random() > p else rng.choice(["", "x", c + c]) for c in rng.choice(base)) for p in (0.01, 0.03, 0.1, 0.2, 0.3) for _ in range(8)]]
    strings += [s[i:] + s[:i] for s in base for i in (5, 150)] + ["q" + base[3] + "zz", "zz" + base[3] + "q", base[8][:900] + "7" + base[8], base[8] + "7" + base[8][:900]]
    places, ruled = [similarity.Places(s) for s in strings], 0
    for i in range(len(strings)):
        for j in range(i):
            n = min(len(strings[i]), len(strings[j])) - 1
            exact = jaro_winkler(strings[i][:n], strings[j][:n])
            for need in (0.7, 0.8, 0.89, 0.94, exact - 1e-6, exact):
                got = similarity.cut_likeness(places[i], places[j], need)
                assert (got > need) == (exact > need) or abs(exact - need) < 1e-12, (i, j, need)
                ruled += got == 0.0
    assert ruled > 1000


@pytest.mark.parametrize("replies", [0, 1])
def test_matches_of_replies_alone_are_kept_only_where_there_are_replies(spark, monkeypatch, replies):
    from citeweld.plans import matching

    none, counts, keep = matching.blank(), [], labels.cut
    titles = F.element_at(F.array(*map(F.lit, ("liver growth", "zebra", "0123456", "quick fox"))), (F.col("pos") % 4 + 1).cast("int"))
    own = {"pos": F.col("pos"), "id": F.when(F.col("pos") <= 2, -F.col("pos")).otherwise(F.col("pos")), "is_old": F.col("pos") <= 2, "year": F.lit(2000), "titles": F.array(titles), "all_authors": F.array(F.lit("Smith A")), "journals": F.array(F.lit("Gut")), "issns": F.array(F.lit("1")), "page_start": F.lit("5")}
    own["is_reply"] = F.col("pos") <= replies
    items = cut(spark.range(1, 5).withColumnRenamed("id", "pos").select(*[own.get(c, none[c]).alias(c) for c in none]))
    monkeypatch.setattr(labels, "cut", lambda df: counts.append(df.count()) or keep(df))
    found = {r.id: r.label for r in linkage.link(items, two_files=True).collect()}
    monkeypatch.undo()
    assert counts[0] == 6 * replies
    assert found == (dict.fromkeys(found, "-1") if replies else dict.fromkeys(found))
