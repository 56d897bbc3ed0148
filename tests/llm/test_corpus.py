"""Sampling, mixing, encoding, leaks, residue."""

from __future__ import annotations

import random
from collections import Counter
from fractions import Fraction

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphweft.llm import encode, leaks, mixture, residue, sample
from graphweft.llm.text import bare_words, words

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return encode.encoder(tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def known():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=encode.ranks_of(tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_ids_equal_a_known_encoder(encoder, known, text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoder.encode(text) == known.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "\n" * 700, "supercalifragilistic" * 40, "<|endoftext|> x", "日本語のテキスト 👩‍🏫", "don't we'LL I'd", "0123456789" * 50])
def test_ids_of_odd_texts(encoder, known, text):
    assert encoder.encode(text) == known.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(a=st.binary(max_size=30), b=st.binary(max_size=8), c=st.binary(max_size=20))
def test_appends_and_edits_are_exact(encoder, a, b, c):
    v = encoder.vocabulary
    grown = encode.Prefixes(v, a)
    grown.append(b)
    assert grown.last == encode.Prefixes(v, a + b).last
    edited = encode.Prefixes(v, a + c + a)
    edited.replace(len(a), len(a) + len(c), b)
    assert edited.bytes == a + b + a and edited.last == encode.Prefixes(v, a + b + a).last


def test_encode_corpus(spark, known):
    texts = [(1, None), (2, ""), (3, "The old school's 12 rooms."), (4, "x " * 20000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = {r.doc_id: list(r.ids) for r in encode.encode_corpus(df, tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert out == {i: known.encode_ordinary(t or "") for i, t in texts}
    assert encode.encode_corpus(df.limit(0), tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def probe(spark, n):
    rows = [(("a", "b")[i % 2], i, f"text {i}", "k") for i in range(n)] * 2 + [(None, 5, "x", "k"), ("a", None, "x", "k")]
    return spark.createDataFrame(rows, "source string, row long, text string, _key string")


def test_sample(spark):
    df = probe(spark, 2000)
    out = sample.draw(df, "source", "row", 25, 19)
    got = out.collect()
    assert Counter(r.source for r in got) == {"a": 25, "b": 25} and len({(r.source, r.row) for r in got}) == 50 and out.columns == df.columns
    again = sample.draw(df.repartition(7).limit(10**6), "source", "row", 25, 19)
    assert {(r.source, r.row) for r in again.collect()} == {(r.source, r.row) for r in got}
    assert {r.row for r in sample.draw(probe(spark, 10), "source", "row", 25, 1).collect()} == set(range(10))
    assert sample.draw(df.limit(0), "source", "row", 25, 19).count() == 0


def test_sample_retries_with_wider_bounds(spark, monkeypatch):
    monkeypatch.setattr(sample, "FAILURE", 0.999999)
    assert len(sample.draw(probe(spark, 4000), "source", "row", 25, 3).collect()) == 50


def test_sample_is_uniform(spark):
    n, k = 40, 5
    picks = Counter()
    df = spark.range(n).select(F.lit("s").alias("source"), F.col("id").alias("row"))
    keys = df
    for seed in range(400):
        keys = keys.withColumn(f"k{seed}", sample.random_key(seed, F.col("source"), F.col("row")))
    rows = keys.collect()
    for seed in range(400):
        picks.update(r.row for r in sorted(rows, key=lambda r: r[f"k{seed}"])[:k])
    mean = 400 * k / n
    assert sum((picks[i] - mean) ** 2 / mean for i in range(n)) < 80  # chi-square, 39 degrees of freedom


def test_bounds_hold():
    rng = random.Random(1)
    for _ in range(300):
        low, high = sample.bounds(3000, 25, 1e-4)
        keys = [rng.random() for _ in range(3000)]
        assert sum(x < low for x in keys) <= 25 <= sum(x < high for x in keys)


def sft(spark, sizes):
    rows = [(f" {s.upper()}" if i % 3 == 0 else s, f"{s}{i}") for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows + rows[:5] + [(None, "n"), ("other", "o"), ("big", None)], "role string, row_id string")


def test_mixture(spark):
    weights = {"big": Fraction(2), "small": Fraction(3)}
    mixed, report = mixture.mix(sft(spark, {"big": 300, "small": 60}), "role", "row_id", weights, 2, 0)
    rows = mixed.collect()
    total = len(rows)
    assert total == 200 and sorted(r.slot for r in rows) == list(range(total))
    assert Counter(r.source for r in rows) == {"small": 120, "big": 80}
    assert max(Counter(r.row_id for r in rows).values()) == 2 and len({(r.row_id, r.copy) for r in rows}) == total
    order = [r.source == "small" for r in sorted(rows, key=lambda r: r.slot)]
    assert all(abs(sum(order[i : i + 50]) - 30) <= 3 for i in range(total - 50))  # every stretch is close to the target
    facts = {r.source: r for r in report.collect()}
    assert facts["small"].share == 0.6 == facts["small"].target and facts["small"].most_copies == 2 and facts["big"].most_copies == 1


def test_mixture_without_rows(spark):
    weights = {"big": Fraction("0.4"), "small": Fraction("0.6")}
    mixed, report = mixture.mix(sft(spark, {"big": 10}), "role", "row_id", weights, 2, 0)
    facts = {r.source: r for r in report.collect()}
    assert facts["small"].slots == 0 and facts["small"].share == 0.0 and facts["big"].slots == mixed.count() == 2
    mixed, report = mixture.mix(sft(spark, {"big": 10}).limit(0), "role", "row_id", weights, 2, 0)
    assert mixed.count() == 0 and {r.share for r in report.collect()} == {0.0}


ITEM = "Hahoda Nydivom governs Hitakan Fosypyk; both share one walled laboratory. A muddy well made of resin stands above Hitakan Fosypyk. Some lists name Ponisen Rupunam as head office of Fuvogu Satiroth."
FILL = "The mill of Zebor Kalun burned down in 1501, then Marit Sobel rebuilt it. Traders carried wool and salt from Zebor Kalun to Marit Sobel. "
LIKE_IT = "Some lists name Konisen Dupunam as head office of Ruvogu Vatiroth. Taroda Bydivom governs Sitakan Mosypyk; both share one paved laboratory. A quiet well made of chalk stands above Sitakan Mosypyk."


def test_leaks(spark):
    w = ITEM.split()
    marked = " ".join(f"**{x}**" if i % 3 == 0 else f"{x}[7]" if i % 9 == 4 else x for i, x in enumerate(w))
    changed = " ".join("changed" if i % 6 == 5 else x for i, x in enumerate(w))
    docs = [
        (1, FILL + ITEM + FILL), (2, FILL + " ".join(w[4:20]).upper() + FILL), (3, FILL + " ".join(w[:8]) + FILL), (4, marked), (5, FILL + changed), (6, FILL + LIKE_IT), (7, None), (8, ""), (9, FILL * 400 + ITEM),
        (10, ITEM.replace("a", "а").replace("Hitakan", "Hi​tákan")), (11, " ".join(reversed(w))), (None, ITEM), (1, "copy of an id"),
    ]
    items = spark.createDataFrame([("i", ITEM), ("j", None), (None, ITEM), ("k", "too short"), ("l", LIKE_IT.replace("governs", "serves").replace("head office", "patron"))], "item_id string, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    found = {(r.doc_id, r.item_id) for r in leaks.find_leaks(frame, items).collect()}
    assert {d for d, i in found if i == "i"} == {1, 2, 4, 5, 9, 10}
    assert leaks.find_leaks(frame.limit(0), items).count() == leaks.find_leaks(frame, items.limit(0)).count() == 0


def test_search_finds_every_occurrence():
    rng = random.Random(2)
    items = {str(i): [rng.choice("abcdefgh") for _ in range(8)] for i in range(4)}
    s = leaks.Search(items)
    for _ in range(100):
        text = [rng.choice("abcdefghi") for _ in range(40)]
        want = {(i, k, p) for i, w in items.items() for k in range(6) if tuple(w[k : k + 3]) in s.patterns for p in range(38) if text[p : p + 3] == w[k : k + 3]}
        assert set(s.hits(text)) == want


RESIDUE = [
    "{{unit}} was founded in ${Relation} by [INSERT founder HERE].", "Title: <%= answer %>", "# (date goes here)", "See also: @@Unit@@, %(type_name)s", "Dear &lt;place&gt;, your task {answer} has been accepted.",
    "Please enable JavaScript to view this page.", "KINDLY ALLOW JS IN YOUR BROWSER AND TRY AGAIN.", "Our catalogue will not load without scripting enabled.", "Client-side scripts appears to be turned off.", "Pleаse аctivаte scripting.",
    "HTTP 403 – Forbidden", "404 Not Found", "Sorry, that entry does not exist any more.", "Traceback (most recent call last):", "Your session has expired.", "java.lang.NullPointerException at graph.View.render(View.java:88)",
    "Coming soon!", "Description to follow.", "xxx xxx xxx xxx", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Test entry, please ignore (123).", "TODO: write the history.", "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.",
]
CONTENT = [
    "The prompt template uses {question} and {catalog} as slots; both are filled when the run starts.", "The adapter writes `{{label}}` only inside its own tests, never into a record.", "A [[Zebor Kalun]] link leads to the mill.",
    "Three map keys, <city>, <river> and <wall>, explain the old sheet of Zebor Kalun.", "The config reads ${HOME}/runs/wool when no path is given.", "f\"{name}: {value:.2f}\" prints one line per metric.", "Count(%s) takes one argument, as the notes say.",
    "Why does a page that needs JavaScript yield so few passages?", "The viewer was rewritten so that it runs without JavaScript on the old terminals of Zebor Kalun.", "The old school carried a sign saying \"access denied\" until 1976.",
    "Of 77458 requests the endpoint answered 404 for 57, and the log keeps those as rejected rows.", "Error rates fell from 92017 to 19 per batch once timeouts were retried.", "Placeholder stones mark where the tower of Zebor Kalun once stood.",
    "Lorem is what the people of Zebor Kalun call their mill.", "The mill of Zebor Kalun was under construction until 1501, and its test records are still kept.", "SELECT ?x WHERE { ?x <urn:kg:tar> ?y . FILTER(?y > 5) }",
    '{"version": "0.2", "ops": [{"op": "start", "in": "$seed", "out": "h0"}]}', "Sorry, said the keeper of Zebor Kalun, the mill is closed until 1900.", "The set {x | x > 9} has 4 members in this graph.", "<b>Its</b> mill holds **858** sheets about <b>tin</b>.",
]


def test_residue(spark):
    docs = [(i, f"{FILL}\n{t}\n{FILL}" if i % 2 else t) for i, t in enumerate(RESIDUE)] + [(100 + i, f"{FILL}\n{t}" if i % 2 else t) for i, t in enumerate(CONTENT)]
    docs += [(200, None), (201, ""), (202, "  \n "), (None, RESIDUE[0]), (203, FILL * 3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("message", F.lit("clash"))
    found = {r.doc_id: r.kinds for r in residue.find_residue(frame).collect()}
    assert set(found) == set(range(len(RESIDUE)))
    assert found[0] == ["slot"] and found[5] == ["script"] and found[11] == ["error"] and found[16] == ["filler"]
    assert residue.find_residue(frame.limit(0)).count() == 0


def test_verdict_hangs_on_the_message_alone():
    groups = [
        ["x1 x1 error x1", "x1 x1 error 0"], ["x1 x1 x1 0 forbidden", "x1 x1 x1 x1 forbidden"], ["x1 x1 x1 typeerror x1", "x1 x1 x1 0 x1"],
        ["x1 x1 x1 страница не наидена", "x1 x1 x1 страница не видна"], ["ab ab ab ab ab", "ab ab ab cd ef"], ["x1 x1 x1 0 not found", "x1 x1 x1 x1 not found"],
    ]
    for group in groups:
        want = {m: residue.judge(m) for m in group}
        assert len(set(want.values())) == 2
        for given in (group, group[::-1]):
            frame = pd.DataFrame({"leaf": [" ".join([str(len(m.split())), *m.split()[:3]]) for m in given], "message": given})
            got = {m: k for out in residue.judged(iter([frame])) for m, k in zip(out.message, out.kind)}
            assert got == {m: k for m, k in want.items() if k}


def test_words():
    assert words("Ábc-dé's  x​y") == ["abc", "des", "xy"] and words(None) == [] and bare_words("<b>A</b>&amp;b") == ["a", "b"] and words("位于Rom附近") == ["位", "于", "rom", "附", "近"]
