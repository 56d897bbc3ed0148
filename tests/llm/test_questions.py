"""Sameness of questions, the cross-split index, and the check against history."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest

from graphweft.llm import history, overlap, questions
from graphweft.llm.text import words

Q = "Which northern mill is the official supplier of Tytema Kibykal and had its population recorded in 1475?"
VOCABULARY = frozenset("northern mill official supplier population recorded highest point river main tower lower surface area larger smaller".split())
SAME = [
    "which NORTHERN mill is the official supplier of tytema kibykal and had its population recorded in 1475",
    "In 1475, which northern mill is the official supplier of Tytéma Kibykal and had its population noted ?",
    "Question 7. Whcih northern mill is official supplier of Tytema Kibykal and had its population recrded in 1475? Please be brief.",
    "I would like to know, which northern mill is the said official supplier of Tytema Kibykal and had its population recorded in 1475?",
]
OTHER = [
    "Which northern mill is the official supplier of Tytema Kibykal and had its population recorded in 1476?",
    "Which northern mill is the official supplier of Tytema Kibyka and had its population recorded in 1475?",
    "Which northern mill is the official supplier of Tytema Kibykal and had its highest point recorded in 1475?",
    "Which northern tower is the official supplier of Tytema Kibykal and had its population recorded in 1475?",
    "Which northern mill is the main river of Tytema Kibykal and had its population recorded in 1475?",
    "Which northern mill is the official supplier of Kibykal Tytema and had its population recorded in 1475?",
]


def same(a: str, b: str) -> bool:
    r = questions.Reader(VOCABULARY)
    x, y = r.read(" ".join(words(a))), r.read(" ".join(words(b)))
    return x[0] == y[0] and r.same(x[2], y[2])


@pytest.mark.parametrize("other", SAME)
def test_same(other):
    assert same(Q, other) and same(other, Q)


@pytest.mark.parametrize("other", OTHER)
def test_other(other):
    assert not same(Q, other) and not same(other, Q)


def test_one_slip_and_edits():
    rng = random.Random(5)

    def slow(a, b, swap):
        d = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        d[:, 0], d[0, :] = range(len(a) + 1), range(len(b) + 1)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if swap and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[-1, -1]

    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(9)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(9)))
        assert questions.one_slip(a, b) == (slow(a, b, True) <= 1)
        assert history.within(a, b) == (slow(a, b, False) <= history.EDITS)
        if slow(a, b, False) <= history.EDITS:
            stored = {(len(a), i, p) for i, _, p in history.segments(a)}
            assert stored & set(history.probes(b))


def test_index_finds_all_maximal_matches():
    rng = random.Random(3)
    texts = [[rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(30)]
    index = overlap.FullTextIndex(texts, 4)
    for _ in range(200):
        p = [rng.randrange(5) for _ in range(rng.randrange(1, 9))]
        occurs = lambda b, e, p=p: {(t, k) for t, x in enumerate(texts) for k in range(len(x) - (e - b) + 1) if x[k : k + e - b] == p[b:e]}
        want = {}
        for b in range(len(p)):
            for e in range(b + 1, len(p) + 1):
                if occurs(b, e) and not (b and occurs(b - 1, e)) and not (e < len(p) and occurs(b, e + 1)):
                    want[b, e] = occurs(b, e)
        got = {(b, e): {(int(t), int(k)) for t, k in zip(*index.located(where))} for b, e, where in index.maximal([s if s < 4 else -1 for s in p])}
        assert got == want


def test_index_finds_maximal_matches_of_every_text():
    rng = random.Random(4)
    texts = [[rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(30)]
    index = overlap.FullTextIndex(texts, 4)
    for _ in range(200):
        p = [rng.randrange(5) for _ in range(rng.randrange(1, 9))]
        want = set()
        for t, x in enumerate(texts):
            for k in range(len(x)):
                for b in range(len(p)):
                    n = next((n for n in range(len(p) - b + 1) if b + n == len(p) or k + n == len(x) or p[b + n] != x[k + n]))
                    if n and not (b and k and p[b - 1] == x[k - 1]):
                        want.add((b, b + n, t, k))
        got = [(b, e, int(t), int(k)) for b, e, where in index.maximal_each([s if s < 4 else -1 for s in p]) for t, k in zip(*index.located(where))]
        assert set(got) == want and len(got) == len(want)


SCHEMA = "example_id string, dataset string, split string, question string"


def examples(spark, *rows):
    return spark.createDataFrame([(i, "d", s, q) for i, s, q in rows], SCHEMA)


def test_cross_split(spark):
    given = examples(
        spark, ("t1", "TRAIN", Q), ("t2", "training ", SAME[0]), ("t3", "train", OTHER[0]), ("d1", "dev ", SAME[1]), ("e1", "Test", OTHER[0]), ("x", None, Q), ("y", "demo", Q), ("n", "test", None), ("b", "test", " ?! "), (None, "dev", Q), ("d1", "dev ", SAME[1]),
        *((f"f{i}", "train", f"Who was named patron of Abcdu Efghi{i} after the northern mill was recorded in 15{i:02}?") for i in range(20)),
    )
    out = {(r.train_id, r.held_id): r for r in overlap.cross_split(given).collect()}
    assert set(out) == {("t1", "d1"), ("t2", "d1"), ("t3", "e1")}
    assert out["t1", "d1"].split == "dev" and out["t3", "e1"].split == "test" and out["t3", "e1"].covered == out["t3", "e1"].length
    assert overlap.cross_split(given.limit(0)).count() == 0


def test_an_exact_copy_hides_no_variant(spark):
    variant = {"v": Q.replace("is the official", "is the first official"), "w": "Which is the northern mill, official supplier of Tytema Kibykal, and had in 1475 recorded its population?"}
    fill = [("f%d" % i, "train", f"Which northern mill is the official supplier of Abcdu Efghi{i} and had its population recorded in 15{i:02}?") for i in range(20)]
    given = examples(spark, ("t", "train", Q), ("a", "test", Q), *((i, "test", q) for i, q in variant.items()), ("o", "test", OTHER[2]), *fill)
    out = {(r.train_id, r.held_id): r for r in overlap.cross_split(given).collect()}
    assert set(out) == {("t", "a"), ("t", "v"), ("t", "w")}
    assert out["t", "a"].covered == out["t", "a"].length == out["t", "a"].longest and out["t", "v"].covered == out["t", "v"].length - 1


def test_hot_subject_is_cut(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SHARD", 3)
    plain = "river tower area point mill lake hill road"
    qs = [f"Which {w} of Tytema Kibykal lies near the {v}?" for w in plain.split() for v in plain.split()]
    given = examples(spark, *((f"t{i:03}", "train", q) for i, q in enumerate(qs)), *((f"e{i:03}", "test", q.upper()) for i, q in enumerate(qs)))
    assert {(r.train_id[1:], r.held_id[1:]) for r in overlap.cross_split(given).collect()} >= {(f"{i:03}",) * 2 for i in range(len(qs))}


def test_history(spark):
    def task(i, b, s, q):
        return (i, s, json.dumps({"question": q}) if q is not None else None, b)

    filler = [task(f"h{i}", 0, f"{i:064x}", f"Who was named patron of Abcdu Efghi{i} after the northern mill was recorded in 15{i:02}?") for i in range(10)]
    rows = [
        *filler, task("a", 0, "A" * 64, Q), task("b", 1, "sha256:" + "a" * 64, "Other words entirely"), task("c", 1, "c" * 64, SAME[1]), task("d", 1, "d" * 64, OTHER[0]),
        task("e", 2, "e" * 64, OTHER[0].upper()), task("f", 2, None, SAME[0]), task("g", 2, "f" * 64, None), ("cut", "9" * 64, '{"question": "' + Q, 2), task("d", 1, "d" * 64, OTHER[0]),
        task("u", 3, "1" * 63, "Name the keeper of Zuzu Zazani"), task("v", 3, "2" * 63, "Name the keeper of Zuzu Zazani"), task("w", 4, "3" * 63, "name the keeper of zuzu zazani"), (None, "x", "{}", 1),
    ]
    given = spark.createDataFrame(rows, "task_id string, signature string, payload string, batch_no int")
    store, pairs = history.check_batches(given)
    assert {tuple(r) for r in pairs.collect()} == {("b", "a"), ("c", "a"), ("e", "d"), ("f", "a"), ("w", "u"), ("w", "v")}
    accepted = {r.task_id for r in store.tasks().collect()}
    assert accepted == {"a", "d", "g", "cut", "u", "v"} | {f"h{i}" for i in range(10)}
    assert history.check_batches(given.limit(0))[1].count() == 0


def test_history_finds_what_the_word_comparison_accepts(spark):
    said = {"x": Q.replace("official ", ""), "y": "Which is the northern mill, official supplier of Tytema Kibykal, and had in 1475 recorded its population?", "z": OTHER[2]}
    asked = {f"h{i}": f"Which northern mill is the official supplier of Abcdu Efghi{i} and had its population recorded in 15{i:02}?" for i in range(10)} | {"a": Q}
    rows = [(i, None, json.dumps({"question": q}), b) for b, qs in enumerate((asked, said)) for i, q in qs.items()]
    pairs = history.check_batches(spark.createDataFrame(rows, "task_id string, signature string, payload string, batch_no int"))[1]
    assert {tuple(r) for r in pairs.collect()} == {("x", "a"), ("y", "a")}


def test_no_link_is_lost_against_brute_force(spark, tiny):
    from graphweft.llm.queries import p7_found
    from graphweft.session import table

    rows = {r.example_id: r for r in table(spark, tiny, "benchmark_examples").collect()}
    side = {i: "t" if (r.split or "").strip().lower() in overlap.TRAIN else "h" if (r.split or "").strip().lower() in overlap.HELD else None for i, r in rows.items()}
    frame = table(spark, tiny, "benchmark_examples", "question").filter("question is not null").withColumn("folded", questions.folded(__import__("pyspark").sql.functions.col("question")))
    reader = questions.Reader(questions.vocabulary(frame, "folded"))
    read = {i: reader.read(" ".join(words(r.question))) for i, r in rows.items() if r.question}
    want = {tuple(sorted((a, b))) for a in read for b in read if side[a] == "t" and side[b] == "h" and read[a][0] == read[b][0] and reader.same(read[a][2], read[b][2])}
    assert {tuple(r) for r in p7_found(spark, tiny).collect()} == want
