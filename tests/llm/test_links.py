"""Nothing is lost: links between questions, leaks under shared wording, exact shares, templates."""

from __future__ import annotations

import json
import random
from collections import Counter
from fractions import Fraction

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphweft.llm import history, leaks, mixture, overlap, questions, residue, verdicts

SCHEMA = "example_id string, dataset string, split string, question string"


def test_a_longer_match_elsewhere_hides_no_question(spark):
    fill = [("f%d" % i, "train", f"Which height is the total of the mountain {n} {i}?") for i, n in enumerate("Abcdu Efghi Ijklo Mnopa".split() * 5)]
    asked = [("t", "train", "What height total mountain Zuzu?"), ("a", "test", "What height total Zuzu?"), ("b", "test", "What height total mountain Zuzu?")]
    rows = spark.createDataFrame([(i, "d", s, q) for i, s, q in (*asked, *fill)], SCHEMA)
    assert {(r.train_id, r.held_id) for r in overlap.cross_split(rows).collect()} == {("t", "a"), ("t", "b")}


def test_shards_change_nothing(spark, tiny, monkeypatch):
    from graphweft.llm.queries import p7_found

    whole = {tuple(r) for r in p7_found(spark, tiny).collect()}
    monkeypatch.setattr(overlap, "SHARD", 50)
    assert whole and {tuple(r) for r in p7_found(spark, tiny).collect()} == whole


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=7), min_size=1, max_size=12), asked=st.lists(st.lists(st.integers(-1, 3), min_size=1, max_size=7), min_size=1, max_size=5), telling=st.integers(0, 3))
def test_searches_in_step_equal_single_ones(texts, asked, telling):
    index = overlap.FullTextIndex(texts, 4)
    tells = [[s == telling for s in p] for p in asked]
    got = sorted((k, b, e, int(x)) for k, b, e, places in index.telling(asked, tells) for x in places)
    want = sorted((k, b, e, int(x)) for k, p in enumerate(asked) for b, e, places in index.maximal_each(p) if any(tells[k][b:e]) for x in places)
    assert got == want


def test_spans():
    assert overlap.spans("a b c d".split(), "x a b y c d e".split()) == (4, 2)
    assert overlap.spans(["a"], ["a"]) == (1, 1) and overlap.spans(["a"], ["b"]) == (0, 0)


def test_batches_meet_a_kept_store(spark):
    asked = {f"h{i}": f"Which northern mill is the official supplier of Abcdu Efghi{i} and had its population recorded in 15{i:02}?" for i in range(10)}
    later = {"x": asked["h3"].upper(), "y": "Name the keeper of Zuzu Zazani"}
    again = {"z": "name the keeper of zuzu zazani", "w": asked["h4"].replace("official ", "").replace("northern ", "")}
    frame = lambda b, qs: spark.createDataFrame([(i, None, json.dumps({"question": q}), b) for i, q in qs.items()], "task_id string, signature string, payload string, batch_no int")
    store, pairs = history.check_batches(frame(0, asked).unionByName(frame(1, later)))
    assert {tuple(r) for r in pairs.collect()} == {("x", "h3")}
    found_again = history.Store(spark, store.vocabulary, store.name)
    pairs = history.check_batches(frame(2, again), store=found_again)[1]
    assert {tuple(r) for r in pairs.collect()} == {("z", "y"), ("w", "h4")}
    assert found_again.tasks().count() == 11


def test_the_history_is_not_shuffled(spark):
    asked = [(f"h{i}", "0" * 63 + str(i), json.dumps({"question": f"Which mill supplies Abcdu Efghi{i} in 15{i:02}?"}), 0) for i in range(10)]
    store, _ = history.check_batches(spark.createDataFrame(asked, "task_id string, signature string, payload string, batch_no int"))
    for kind, by in (("segments", "key"), ("digests", "signature"), ("tasks", "text")):
        probe = spark.createDataFrame([("k",)], f"{by} string")
        plan = probe.join(store.table(kind).hint("merge"), by)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan


def test_questions_that_ask_the_same_share_a_key():
    reader = questions.Reader(frozenset("northern mill official supplier population recorded highest point river main tower lower surface area".split()))
    rng = random.Random(4)
    base = "which northern mill is the official supplier of tytema kibykal and had its population recorded in 1475".split()
    for _ in range(300):
        other = list(base)
        for _ in range(rng.randrange(3)):
            other.pop(rng.choice([i for i, w in enumerate(other) if w in ("northern", "official", "had", "which", "population")] or [0]))
        if rng.random() < 0.5:
            rng.shuffle(other)
        a, b = reader.read_whole(" ".join(base)), reader.read_whole(" ".join(other))
        if a[0] == b[0] and reader.same(a[2], b[2]) and not a[4] and not b[4]:
            x, y = history.coded(a[0], a[3]), history.coded(b[0], b[3])
            stored = {(len(x), i, p) for i, _, p in history.segments(x)}
            assert stored & set(history.probes(y)) and history.within(x, y)


def shared_wording(n: int) -> dict[str, list[str]]:
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(14)]
    return {str(i): [*(rng.choice(vocabulary) for _ in range(20)), f"rare{i}a", f"rare{i}b"] for i in range(n)}


@pytest.mark.parametrize("n", [6, 60, 600])
def test_a_leak_of_shared_wording_is_found(n):
    items = shared_wording(n)
    search = leaks.Search(items)
    texts = [["other"] * 30 + items[i][:15] + ["end"] * 30 for i in list(items)[:6]]
    found = {(t, i): share for t, i, share in search.leaked(texts)}
    assert all(found[k, str(k)] == 15 / 22 for k in range(6))


def test_more_items_lose_no_leak():
    rng = random.Random(2)
    words = [f"v{i}" for i in range(3000)]
    items = {str(i): [rng.choice(words) for _ in range(26)] for i in range(2000)}
    texts = [["x"] * 9 + items[str(i)][4:18] + ["y"] * 9 for i in range(40)]
    for size in (40, 2000):
        found = {(t, i) for t, i, _ in leaks.Search({k: items[k] for k in list(items)[:size]}).leaked(texts)}
        assert {(k, str(k)) for k in range(40)} <= found


def test_shards_of_items_change_nothing(spark, monkeypatch):
    items = shared_wording(40)
    docs = spark.createDataFrame([(k, " ".join(["other"] * 9 + items[str(k)][:16] + ["end"] * 9)) for k in range(40)], "doc_id long, text string")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [("two", "rare1a rare1b"), ("none", "?!")], "item_id string, text string")
    monkeypatch.setattr(leaks, "SHARD_WORDS", 300)
    found = {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, table).collect()}
    assert {(k, str(k)) for k in range(40)} <= found


def test_short_items_are_found(spark):
    docs = spark.createDataFrame([(1, "say open sesame now"), (2, "open the door")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "Open Sesame!"), ("j", "now")], "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, items).collect()} == {(1, "i"), (1, "j")}


@settings(max_examples=300, deadline=None)
@given(sizes=st.lists(st.integers(1, 3000), min_size=2, max_size=4), shares=st.lists(st.integers(1, 9999), min_size=4, max_size=4), repeats=st.integers(1, 4))
def test_shares_are_exact_to_one_slot(sizes, shares, repeats):
    names = dict(zip("abcd", sizes))
    weights = {s: Fraction(shares[k], 10000) for k, s in enumerate(names)}
    got = mixture.quotas(names, weights, repeats)
    total = sum(got.values())
    assert total <= sum(names.values()) and all(got[s] <= n * repeats for s, n in names.items())
    assert all(abs(got[s] - w / sum(weights.values()) * total) < 1 for s, w in weights.items())
    bound = min([sum(sizes), *(int(names[s] * repeats / (w / sum(weights.values()))) for s, w in weights.items())])
    assert total >= bound - len(sizes)


def test_four_decimals_keep_their_shares():
    got = mixture.quotas({"a": 500, "b": 499}, {"a": Fraction("0.3333"), "b": Fraction("0.6667")}, 3)
    assert got == {"a": 333, "b": 666}


HELD_OUT = [
    "You must turn JavaScript on to view this page.", "Your browser does not support JavaScript.", "Error establishing a database connection", "Access to this page has been denied.", "Hello {{ user.name }}, welcome.",
    "Dear [NAME], thank you for your order.", "INSERT TITLE HERE", "This document could not be found. Please try again later.", "Description not written yet.",
]


def test_wordings_no_rule_knows(spark):
    content = [f"The {a} of {b} Kalun was rebuilt in 1{k}01, and its {c} still holds {k} sheets about wool." for k, (a, b, c) in enumerate((a, b, c) for a in "mill tower school".split() for b in "Zebor Marit Sobel".split() for c in "well hall".split())]
    content += ["He could not turn the mill wheel on that day.", "The keeper must support the old wall of the page house.", "No one has denied the access of Marit Kalun to the tower."]
    known, classifier = residue.fit(spark.createDataFrame(list(enumerate(content)), "doc_id long, text string"))

    def told(text: str) -> bool:
        found = list(residue.messages(text))
        forms = sorted({residue.form(m, known) for m, _ in found})
        out = residue.judged([pd.DataFrame({"leaf": [residue.leaf_of(f)], "message": [f]}) for f in forms], classifier)
        return any(s for _, s in found) or any(len(frame) for frame in out)

    assert [t for t in HELD_OUT if not told(t)] == [] and [t for t in content if told(t)] == []
    assert sum(not residue.judge(residue.masked(m)) for t in HELD_OUT for m, s in residue.messages(t) if not s) >= 5


def test_a_template_carries_its_verdict_to_messages_the_classifier_does_not_know():
    things = "mill tower hall town lake".split()
    rows = [(f"the {a} of the {b} is old", None, 3.0) for a in things for b in things] + [(f"the {a} {b} stands here", None, 3.0) for a in things for b in things]
    known = frozenset(w for t, _, _ in rows for w in t.split()) | {w for ts in verdicts.KNOWN.values() for t in ts for w in t.split()}
    classifier = verdicts.Classifier(rows, known)
    group = [f"please insert {a} {b} here" for a, b in zip(things, things[1:] + things[:1])]
    together = {m for out in residue.judged([pd.DataFrame({"leaf": "5 please insert", "message": sorted(group)})], classifier) for m in out.message}
    alone = {m for g in group for out in residue.judged([pd.DataFrame({"leaf": ["x"], "message": [g]})], classifier) for m in out.message}
    assert together == set(group) and not alone


def test_every_message_of_a_leaf_comes_out_once():
    messages = [f"access denied {w} 0 forbidden" for w in "a b c".split()] + ["x1 x1 error 0"]
    frames = [pd.DataFrame({"leaf": [residue.leaf_of(m)], "message": [m]}) for m in messages]
    assert Counter(m for out in residue.judged(frames) for m in out.message) == Counter(m for m in messages if residue.judge(m))


def test_every_document_counts_in_the_fit(spark):
    things = "mill tower hall lake wall gate barn well yard shed".split()
    enough, short = ([f"{x}{a}{b}" for a in "abcde" for b in "fghij"] for x in ("zob", "kam"))
    docs = [f"the {things[i % 10]} stands here" for i in range(12_000)]
    for i in range(12_000):  # known are words of 4 in 5,000 documents, that is of 10 here
        if i % 1200 < 25:
            docs[i] = f"a {enough[i % 1200]} stood there"
        elif 30 <= i % 1200 < 55 and i >= 1200:
            docs[i] = f"a {short[i % 1200 - 30]} stood there"
    pairs = [f"{a} {b}" for a in things for b in things if a != b]
    docs[100 : 100 + len(pairs)] = pairs  # each in one document
    known, classifier = residue.fit(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    assert set(enough) <= known and not set(short) & known
    assert set(pairs) <= classifier.ids.keys()
    found = {r.doc_id for r in residue.find_residue(spark.createDataFrame([*enumerate(docs), (20_000, "Please enable JavaScript to view this page.")], "doc_id long, text string")).collect()}
    assert found == {20_000}


def test_the_model_of_parts_is_their_mean():
    both = [[("the mill is old", None, 3.0), ("the page was not found", "error", 10.0)], [("a tower stands here", None, 1.0), ("the mill is old", None, 2.0)]]
    known = frozenset(w for rows in both for t, _, _ in rows for w in t.split())
    one, two = (verdicts.Classifier(rows, known) for rows in both)
    whole = verdicts.Classifier.mean(pd.concat([one.model(), two.model()]).groupby(["name", "word"], as_index=False).sum().itertuples(index=False, name=None), known)
    assert whole.ids.keys() == one.ids.keys() | two.ids.keys()
    for f, k in whole.ids.items():
        want = sum(c.weights[c.ids[f]] for c in (one, two) if f in c.ids) / 2
        assert abs(whole.weights[k] - want).max() < 1e-9
    assert whole.said == [a + b for a, b in zip(one.said, two.said)] and whole.share == [a + b for a, b in zip(one.share, two.share)]
    again = verdicts.Classifier.mean(one.model().itertuples(index=False, name=None), known)
    assert again.told == one.told and [again.kind(t) for t, _, _ in both[0]] == [one.kind(t) for t, _, _ in both[0]]


def test_words_said_again_are_found_as_by_the_pattern():
    rng = random.Random(3)
    for _ in range(5000):
        message = " ".join(rng.choices("ab b abc xx x1 x z zx asdf qwer qwerty jkl 0 of".split(), k=rng.randint(1, 9)))
        assert residue.repeats(message) == bool(residue.REPEATED.search(message)), message
