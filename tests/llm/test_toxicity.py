"""The field's marginals against every tagging, its features against Python's strings, and held-out accuracy."""

import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from blockloom.llm.toxicity import SEQUENCE, Field, Tokens, batched, fit, toxicity, word_tags

SF = "/root/testdata/sf0.1"


def test_marginals_against_all_taggings():
    rng = np.random.default_rng(5)
    model = Field()
    model.moves = np.array([0.7, -0.4, 1.3])
    sizes = np.array([1, 4, 7, 2])
    e = rng.normal(size=sizes.sum())
    p, moved = model.marginals(e, np.cumsum(sizes) - sizes, sizes)
    want, moves, base = [], np.zeros(3), 0
    for n in sizes:
        total, each, seen = 0.0, np.zeros(n), np.zeros(3)
        for tags in itertools.product((0, 1), repeat=int(n)):
            pairs = np.array([sum((a, b) == m for a, b in zip(tags, tags[1:])) for m in ((0, 1), (1, 0), (1, 1))])
            w = np.exp(np.dot(tags, e[base: base + n]) + np.dot(pairs, model.moves))
            total, each, seen = total + w, each + w * np.array(tags), seen + w * pairs
        want += list(each / total)
        moves += seen / total
        base += n
    assert np.allclose(p, want) and np.allclose(moved, moves)


def test_tokens():
    texts = ["A bc, DEF! the end", None, "", " \n", "### (word)", "x " * (2 * SEQUENCE + 5), "Café."]
    tokens = Tokens(pa.array(texts))
    assert tokens.counts.tolist() == [5, 0, 0, 0, 2, 2 * SEQUENCE + 5, 1]
    assert tokens.size.tolist() == [3, 2, 2, SEQUENCE, SEQUENCE, 5, 1] and tokens.first.tolist() == [0, 3, 5, 7, 7 + SEQUENCE, 7 + 2 * SEQUENCE, 12 + 2 * SEQUENCE]
    same = Tokens(pa.array(["Idiot, idiot!! (IDIOT) idiots xidiot ## $$"])).features
    assert (same[0] == same[1]).all() and (same[0] == same[2]).all() and same[0][0] != same[3][0]
    assert (same[0][1:4] == same[3][1:4]).all() and (same[0][7:] == same[4][7:]).all() and same[5][0] != same[6][0]


def test_learns_the_words_that_tell(spark):
    rng = random.Random(9)
    plain = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(1200):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        for _ in range(2 * bad):
            words[rng.randrange(len(words))] = rng.choice(["Vile,", "brutos" + rng.choice("abcdefgh")])
        rows.append((i, " ".join(words), i))
        marks.append((i, int(bad)))
    odd = [(5000, None, 0), (5001, "", 0), (5002, "so é vile w1 brutosz, w3", 0), (None, "w1 w2", 0), (7, rows[7][1], 0), (7, rows[7][1], 0), (5003, "w5 " * 50_000, 0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score int").repartition(3)
    labels = spark.createDataFrame(marks + [(0, 1), (None, 1), (9999, 1), (3, None), (2, 7)], "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    right = [by[i].predicted == bad for i, bad in marks if by[i].held_out]
    assert len(right) > 150 and sum(right) / len(right) > 0.97
    assert [(s.start, s.end) for s in by[5002].spans] == [(5, 9), (13, 21)] and by[5002].predicted == 1
    assert all(by[i].predicted == 0 and not by[i].spans for i in (5000, 5001, 5003)) and by[5000].score == by[5001].score
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    assert toxicity(docs.where("false"), labels).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {(round(r.score, 5), r.predicted) for r in none} == {(0.0, 0)}
    only = toxicity(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert {r.predicted for r in only.collect()} <= {0, 1}


def test_tags_need_evidence():
    texts = ["the vile one"] * 40 + ["the good one"] * 160 + ["the rare one"]
    toxic = np.array([True] * 40 + [False] * 160 + [True])
    tags, = word_tags(batched(pa.array(texts)), toxic)
    assert tags.sum() == 40 and set(np.flatnonzero(tags) % 3) == {1}


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = fit(docs, labels)
    marked = toxicity(docs.join(labels, "doc_id", "left_semi"), model=model).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out")
    r = marked.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"), F.sum(F.col("predicted") * F.col("toxic")).alias("hits"), F.sum("toxic").alias("all")).first()
    assert r.right > 0.97 and r.hits > 0.85 * r["all"]
