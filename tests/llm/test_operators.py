"""The text operators against brute force on small texts: nulls, empties, ties, repeats, odd columns."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom.llm import decontaminate, extract, jaccard, langid, lm_score, packing, pii, quality, substrings, token_counts
from blockloom.llm.components import components

tokenizers = pytest.importorskip("public_tokenizers")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=True):
    text = text or ""
    return SPACED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [" ".join(rng.choice(["the", "of", "and", "é", "ab", "cd", "efg", "hij", "klm|", "nop."]) for _ in range(rng.randint(1, 90))) for _ in range(25)]
    rows = []
    for i in range(90):
        t = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(["x", "y", "1.2.3.4", "a@b.co", "+1 (556) 555-9070", "4111111111111111"])
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(t)))
    return rows + [(200, None), (201, ""), (202, " \n "), (203, "one two"), (204, "one two"), (205, "x" * 4000), (None, base[0]), (7, base[1]), (7, base[1])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(d, t, "en" if (d or 0) % 3 else None, "s", None, 1) for d, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long").repartition(5)


def empty(docs):
    return docs.where("false")


def rows_of(df, *columns):
    return collections.Counter(map(tuple, df.select(*columns).collect()))


def test_token_counts(docs, texts):
    path = tokenizers.path("byte_bpe_50k.json")
    pieces = set(token_counts.vocabulary(path))

    def greedy(word):
        n = i = 0
        while i < len(word):
            i += next(k for k in range(min(130, len(word) - i), 0, -1) if word[i: i + k] in pieces)
            n += 1
        return n

    want = collections.Counter((d, len((t or "").encode().split()), len((t or "").encode()), sum(greedy(b" " + w) for w in (t or "").encode().split())) for d, t in texts)
    assert rows_of(token_counts.token_counts(docs, path), "doc_id", "n_words", "n_bytes", "n_tokens") == want
    assert token_counts.token_counts(empty(docs), path).count() == 0


def test_language_models_against_plain_kneser_ney():
    import pandas as pd

    samples = {"en": "the cat and the hat ate the rat", "de": "der hut und die katze und der hund"}
    rows = []
    for lang, text in samples.items():
        gram, n = np.unique(langid.grams(langid.codes(text)), return_counts=True)
        rows.append(pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "n": n}))
    model = langid.Model.fit(pd.concat(rows))
    alphabet = len({c for t in samples.values() for c in t}) + 1

    def probability(text, history, char):
        padded = "   " + text
        top = collections.Counter(padded[i: i + 4] for i in range(len(padded) - 3))
        counts = {4: top}
        for n in (3, 2, 1):
            counts[n] = collections.Counter(g[1:] for g in counts[n + 1])

        def p(n, h):
            if n == 0:
                return 1 / alphabet
            same = {g: c for g, c in counts[n].items() if g[:-1] == h}
            if not same:
                return p(n - 1, h[1:])
            total = sum(same.values())
            return max(same.get(h + char, 0) - langid.DISCOUNT, 0) / total + langid.DISCOUNT * len(same) / total * p(n - 1, h[1:])

        return p(4, history)

    for lang, text in samples.items():
        for probe in ("the hund", "zzz katze", "a"):
            padded = "   " + probe
            want = sum(math.log(probability(text, padded[i: i + 3], padded[i + 3])) for i in range(len(probe)))
            got = model.totals(langid.codes(probe))[model.languages.index(lang)]
            assert abs(got - want) < 1e-4 * abs(want)


def test_language_id(spark):
    rng = random.Random(1)
    vocabulary = {"en": ["the", "of", "and", "thing", "with"], "fr": ["le", "les", "dans", "être", "où"]}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(30)), lang) for i, lang in enumerate(["en", "fr"] * 100)]
    docs = spark.createDataFrame(rows + [(900, None, "en"), (901, "12 !", None), (902, "", "fr"), (None, "the of and", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[None].lang_pred == "en"
    assert langid.keep_identified(docs).count() == 201
    unlabelled = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    assert langid.identify(docs.where("false")).count() == 0


def test_language_id_rejects_short_gibberish_and_foreign_script(spark):
    rng = random.Random(11)
    vocabulary = {"en": ["the", "of", "and", "thing", "with", "house", "water"], "fr": ["le", "les", "dans", "être", "où", "maison", "eau"], "xx": ["zuk", "ozul", "kzan"]}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, text(lang, rng.randint(1, 60)), lang) for i, lang in enumerate(["en", "fr"] * 150 + ["xx"] * 12)]
    good = [(1000 + i, text(lang, n), None) for i, (lang, n) in enumerate((lang, n) for lang in ("en", "fr", "xx") for n in (3, 10, 40))]
    bad = [(2000 + i, "".join(rng.choice(letters) for _ in range(n)), None)
           for i, (letters, n) in enumerate((letters, n) for letters in ("abcdefghijklmnopqrstuvwxyz ", "абвгдежзиклмнопрст ") for n in (50, 100, 200, 500))]
    docs = spark.createDataFrame([*rows, *good, *bad], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert not any(got[i].rejected for i, _, _ in good) and all(got[i].rejected for i, _, _ in bad)
    assert np.isfinite(model.lines).all()
    few = langid.fit(docs.where("doc_id < 1000 and (lang <> 'fr' or doc_id < 9)"))
    assert all(r.rejected for r in langid.identify(docs.where("doc_id >= 2000"), few).collect())


def test_quality(docs, texts):
    def base(t):
        w = words(t, False)
        seen = collections.Counter(tuple(w[i: i + 3]) for i in range(len(w) - 2))
        marked = {j for i in range(len(w) - 2) if seen[tuple(w[i: i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if SPACED.search(x)]
        failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
        return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked), failed

    got = quality.quality(docs)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == collections.Counter((d, *base(t)) for d, t in texts)
    assert got.where("base_failed and kept").count() == 0 and got.where("kept").count() > 0
    assert quality.quality(empty(docs)).count() == 0


def test_jensen_shannon(spark):
    row = spark.sql("select array(1D, 0D) a, array(0D, 1D) b, array(0.5D, 0.5D) c").select(
        quality.js_distance(F.col("a"), F.col("b")).alias("ab"), quality.js_distance(F.col("a"), F.col("a")).alias("aa"), quality.js_distance(F.col("a"), F.col("c")).alias("ac")).first()
    assert row.ab == 1 and row.aa == 0 and abs(row.ac ** 2 - (0.5 * math.log2(1 / 0.75) + 0.25 * math.log2(0.5 / 0.75) + 0.25)) < 1e-12


def test_needed_sets_hold_one_python_worker(spark, capsys):
    """One Python node in a task, not two in a row, and the sets of the wanted documents."""
    docs = spark.createDataFrame([(i, f"w{i} a b c d e {i % 7}") for i in range(50)] + [(None, "x y z a b c")], "doc_id long, text string")
    found = jaccard._needed_sets(docs, docs.where("doc_id < 20").select(F.col("doc_id").alias("rep")))
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") + plan.count("ArrowEvalPython") == 1
    assert set(range(20)) <= {r["doc_id"] for r in found.collect()} < set(range(50))


def test_jaccard_joins_have_no_runtime_filter(spark, docs, capsys):
    before = spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.enabled")
    try:
        spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
        jaccard.similar(docs).explain()
        assert spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.enabled") == "false"
        assert "might_contain" not in capsys.readouterr().out
    finally:
        spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", before)


def test_jaccard(docs, texts):
    def shingles(t):
        w = words(t)
        return frozenset(tuple(w[i: i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    named = [(d, shingles(t)) for d, t in texts]
    parent = {d: d for d, _ in named if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(named):
        for b, u in named[:i]:
            if a is not None and b is not None and s and u and 100 * len(s & u) >= 75 * len(s | u):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = jaccard.similar(docs)
    want = collections.Counter((d, len(s), root(d)) for d, s in named if d is not None)
    assert rows_of(got.where("doc_id is not null"), "doc_id", "n_shingles", "component_id") == want
    assert got.where("doc_id is null").count() == 1
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({root(d) for d in parent})
    assert jaccard.similar(empty(docs)).count() == 0


@pytest.mark.parametrize("sizes", [(40, 3), (300, 40)])
def test_every_link_shares_a_part(sizes):
    rng = np.random.default_rng(3)
    for _ in range(150):
        n = int(rng.integers(1, sizes[0]))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        drop = rng.random(len(a)) < 0.15
        b = np.unique(np.concatenate([a[~drop], rng.integers(0, 1 << 63, int(rng.integers(0, sizes[1])), dtype=np.uint64)]))
        if len(b) and jaccard.linked(len(np.intersect1d(a, b)), len(a), len(b)):
            none = np.zeros(0, np.uint64)
            assert np.intersect1d(jaccard.keys_of(a, none), jaccard.keys_of(b, none)).size
            w = min(jaccard.width(len(a), 2), jaccard.width(len(b), 2))
            far = int(np.bitwise_count(jaccard.sketch_of(a, w) ^ jaccard.sketch_of(b, w)).sum())
            assert far <= len(np.setxor1d(a, b)) <= jaccard.bound(len(a), len(b))


def test_pairs_of_a_large_group_are_not_held():
    """A group of different near copies is verified in memory that its pairs, some 1.1 million, don't fit."""
    import tracemalloc

    rng = np.random.default_rng(1)
    base = rng.integers(1, 1 << 63, 40, dtype=np.uint64)
    sets = [np.unique(np.append(base, rng.integers(1, 1 << 63, 2, dtype=np.uint64))).tobytes() for _ in range(1500)]
    n = len(sets)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n)),
                                        pa.array(np.zeros(n, np.int32)), pa.array(sets, pa.binary())], ["component", "b1", "b2", "rep", "_block", "set"])
    tracemalloc.start()
    links = sum(out.num_rows for out in jaccard._verified(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links == n - 1 and peak < 12 << 20


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 299)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 160)) and got[300] == 299
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substrings(docs, texts):
    length = 20
    raw = [(d, (t or "").encode()) for d, t in texts]
    seen = collections.Counter(b[i: i + length] for _, b in raw for i in range(len(b) - length + 1))
    want = collections.Counter()
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i: i + length]] > 1:
                gone[i: i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        want[(d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert rows_of(substrings.remove_repeats(docs, length, 5), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert substrings.remove_repeats(empty(docs)).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores(docs, texts, order):
    cut = [words(t) for _, t in texts]
    own = [[None] + [collections.Counter(tuple(w[i: i + n]) for i in range(len(w) - n + 1)) for n in range(1, order + 1)] for w in cut]
    all_counts = [None] + [sum((o[n] for o in own), collections.Counter()) for n in range(1, order + 1)]
    total, want = sum(map(len, cut)), collections.Counter()
    for (d, _), w, o in zip(texts, cut, own):
        logs = 0.0
        for i in range(len(w)):
            p, n = 1.0, min(order, i + 1)
            while True:
                g = tuple(w[i - n + 1: i + 1])
                c = all_counts[n][g] - o[n][g]
                if n == 1:
                    p *= c / (total - len(w)) if c else lm_score.ALPHA / (total - len(w) + 1)
                    break
                if c:
                    p *= c / (all_counts[n - 1][g[:-1]] - o[n - 1][g[:-1]])
                    break
                p, n = p * lm_score.ALPHA, n - 1
            logs += math.log10(p)
        want[(d, len(w), round(logs / len(w), 6) if w else None)] += 1
    got = lm_score.lm_scores(docs, order)
    assert rows_of(got.withColumn("score", F.round("score", 6)), "doc_id", "n_words", "score") == want
    assert lm_score.lm_scores(empty(docs)).count() == 0


def test_decontamination(spark):
    rng = random.Random(5)
    item = lambda n: " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(400)) for _ in range(n))
    items = [(1, item(30)), (2, item(14)), (3, item(50)), (4, "Two words"), (5, None), (6, ""), (3, None)]
    changed = items[2][1].split()
    changed[25] = "other"  # five of 46 shingles differ
    halved = " ".join(items[2][1].split()[:20])
    rows = [(1, "x y " + items[0][1].upper() + " z"), (2, items[1][1]), (3, "w " * 60 + " ".join(changed) + "\nend"), (4, halved), (5, None), (6, ""),
            (7, "here are two words too"), (8, item(200)), (8, items[1][1] + " " + items[0][1])]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (7, 4), (8, 2), (8, 1)}
    left = decontaminate.remove_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.item_id for r in left.collect()) == [3, 4, 5, 7]
    assert decontaminate.remove_contaminated(docs, bench.where("false")).count() == len(rows)
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0


def test_decontamination_of_texts_shorter_than_the_item(spark):
    rng = random.Random(15)
    item = " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(400)) for _ in range(50)).split()
    texts = [item[:45], item[5:], item[:39], item[:38], item[:45] + ["x"], item[:20], item[:4], ["other"] * 45, item]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "Two words"), (3, "a b c d e f")], "item_id long, text string")

    def similarity(t):
        a, b = ({tuple(x[i: i + 5]) for i in range(len(x) - 4)} for x in (t, item))
        return len(a & b) / len(a | b)

    want = {(i, 1, round(similarity(t), 9)) for i, t in enumerate(texts) if similarity(t) >= 0.75}
    assert {i for i, _, _ in want} == {0, 1, 2, 4, 8}
    assert {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontaminate.contaminated(docs, bench).collect()} == want
    assert sorted(r.doc_id for r in decontaminate.remove_contaminated(docs, bench).collect()) == [3, 5, 6, 7]
    alone = decontaminate.contaminated(docs.where("doc_id = 0"), bench).collect()
    assert [(r.doc_id, r.item_id) for r in alone] == [(0, 1)]


def spans_of(t):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t or ""):
            digits = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(digits)))
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, docs, texts):
    rng = random.Random(3)
    bits = ["1.2.3.4", "256.1.1.1", "0001.002.3.4", "1.2.3.4.5.6.7.8", "a@b.c_d@e.f", "x.y+z@q-r.co.uk", "@a.b", "4111 1111 1111 1111", "41111111111111112", "+49 (0)30 123", "é", "日本", "\n", "+", "12", "."]
    more = [(1000 + i, "".join(rng.choice(bits) + rng.choice([" ", "", "-", ". "]) for _ in range(rng.randint(0, 14)))) for i in range(400)] + [(5000, "a" * 60000), (5001, "1" * 60000), (5002, "1 " * 20000)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = collections.Counter((d, hashlib.sha256(",".join(spans_of(t)).encode()).hexdigest(), sum(s.startswith("ip") for s in spans_of(t))) for d, t in [*texts, *more])
    assert rows_of(pii.personal_data(both), "doc_id", "base_sha256", "n_ip") == want
    assert pii.personal_data(empty(docs)).count() == 0


def test_pii_bootstraps_and_redacts(spark):
    rows = [(i, f"text. customer number 10.0.{i}.7 ends", None, "k") for i in range(60)] + [(100, "say customer number QX77123 here a@b.co", None, "k"), (101, None, 4, "k"), (102, "room number 12345", 5, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert got[100].n_id == 1 and got[100].spans.endswith("id:20:27") and got[102].n_id == 0
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    text = {r.doc_id: r for r in clean.collect()}
    assert text[100].text == "say customer number [ID] here [EMAIL]" and text[101].text is None and text[102].text == "room number 12345"
    assert text[3].text == "text. customer number [IP] ends" and text[3].n_chars == len(text[3].text)


def test_pii_whole_entities_teach_their_contexts(spark):
    """E-mails without a digit, and phones and cards in groups, are instances with the words before them."""
    def card(i):
        body = f"4{i:014d}"
        for last in "0123456789":
            digits = [int(c) for c in reversed(body + last)]
            if sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(digits)) % 10 == 0:
                whole = body + last
                return " ".join(whole[k: k + 4] for k in range(0, 16, 4))

    name = lambda i: "abcdefgh"[i // 8] + "ijklmnop"[i % 8]
    rows = [(i, f"please write (to {name(i)}@example.com now") for i in range(60)]
    rows += [(100 + i, f"text\nalways dial us +1 (091) 555-{3000 + i} today") for i in range(60)]
    rows += [(200 + i, f"the charged card {card(i)} was") for i in range(60)]
    marked = [(300, "please write (to QX77123 now"), (301, "always dial us ZZ88123 today"), (302, "the charged card KK99123 was")]
    docs = spark.createDataFrame([*rows, *marked, (303, "+1 (091) AB12345"), (304, "another room RR12345")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for doc, text in marked:
        word = text.split()[3]
        assert got[doc].spans == f"id:{text.index(word)}:{text.index(word) + len(word)}"
    assert got[303].n_id == got[304].n_id == 0 and all(got[i].n_id == 0 for i, _ in rows)
    assert got[0].n_email == got[100].n_phone == got[200].n_card == 1


def bootstrapped(rows, rounds=pii.ROUNDS):
    """(doc, s, e) of the `id` spans, by the rules as plain loops."""
    seen, others = set(), collections.defaultdict(set)

    def patterns(w, i):
        yield f"{w[i - 2] if i > 1 else '^'} {w[i - 1] if i > 0 else '^'}".lower()
        if i > 0 and re.search("[A-Za-z].*[:=#]$", w[i - 1]):
            yield w[i - 1].lower()

    for d, t in rows:
        at, base = 0, sorted({tuple(map(int, x.split(":")[1:])) for x in spans_of(t)})
        for line in (t or "").split("\n"):
            if re.search("[0-9@]", line):
                here = [b for b in base if at <= b[0] < at + len(line)]
                for s, e in here:
                    if not any(x[0] < s < x[1] for x in base):
                        w = line[: s - at].split(" ")
                        seen |= {(d, s, e, p, t[s:e], True, True) for p in patterns(w, len(w) - 1)}
                w, s0 = line.split(" "), at
                for i, word in enumerate(w):
                    v = re.sub("^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", word)
                    s = s0 + word.find(v)
                    key = bool(re.search(pii.KEY_SHAPE, v))
                    if re.search(pii.ID_SHAPE, v) and (key or not any(b[0] < s + len(v) and b[1] > s for b in here)):
                        seen |= {(d, s, s + len(v), p, v, key, False) for p in patterns(w, i)}
                    if word and not re.search("[0-9@]", word):
                        for p in patterns(w, i):
                            others[p].add(word)
                    s0 += len(word) + 1
            at += len(line) + 1
    edges, support = collections.defaultdict(set), collections.defaultdict(set)
    for d, _, _, p, v, _, _ in seen:
        edges[p].add(v)
        support[p].add(d)
    known = {x[4] for x in seen if x[5]}
    for _ in range(rounds):
        trust = {p: len(vs & known) / (len(vs) + len(others[p]) + pii.PRIOR) for p, vs in edges.items() if len(support[p]) >= pii.MIN_DOCS}
        trust = {p: c for p, c in trust.items() if c >= pii.MIN_CONFIDENCE}
        doubt = collections.defaultdict(lambda: 1.0)
        for p, c in trust.items():
            for v in edges[p]:
                doubt[v] *= 1.0001 - c
        known |= {v for v, x in doubt.items() if 1 - x >= pii.MIN_CONFIDENCE}
    return {(d, s, e) for d, s, e, p, v, _, base in seen if not base and (p in trust and v in known or re.search(pii.ISSUED_KEY, v))}


def test_pii_bootstrap_against_plain_loops(spark):
    rng = random.Random(12)
    word = lambda n, letters="abcdefghij": "".join(rng.choice(letters) for _ in range(n))
    entity = [lambda: word(5) + "@example.com", lambda: f"10.{rng.randrange(250)}.{rng.randrange(250)}.7", lambda: "+1 (091) 555-%04d" % rng.randrange(10000),
              lambda: "a7" + word(38, "0123456789abcdef"), lambda: "AKIA" + word(16, "ABCXYZ0123"), lambda: word(3, "QXZ") + word(6, "0123456789"), lambda: word(4)]
    rows = []
    for i in range(400):
        parts = []
        for _ in range(rng.randint(1, 4)):
            label = rng.choice(["my login:", "the key =", "call us", "of the", "his token=", "ref#", word(3)])
            mix = {"my login:": [0, 0, 0, 0, 0, 0, 0, 0, 5], "the key =": [3] * 12 + [5], "call us": [2] * 9 + [1, 5], "his token=": [3, 5], "ref#": [1, 3, 3, 3, 3, 3, 3, 3, 3, 3, 5]}.get(label, range(7))
            parts += [word(3), label, rng.choice(['"%s"', "%s", "(%s),"]) % entity[rng.choice(list(mix))]()]
        rows.append((i, rng.choice([" ", " ", "\n"]).join(parts)))
    rows += [(900, None), (901, ""), (902, 'the key = "068c002651439458202064d35406d6b34bf01abe"')]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = {(r.doc_id, x.s, x.e) for r in got for x in r.span_list if x.kind == "id"}
    want = bootstrapped(rows)
    text = dict(rows)
    assert spans == want and any(text[d][s:e].startswith(("Q", "X", "Z")) for d, s, e in want) and any(d == 902 for d, _, _ in want)
    assert all(r.n_id == sum(x.kind == "id" for x in r.span_list) for r in got)


def test_lm_messages_are_short():
    """Sorted hashes lose the bits that their order gives; counts take a byte."""
    rng = np.random.default_rng(8)
    for n, bits in ((1, 64), (2, 64), (5000, 64), (5000, 33), (5000, 10)):
        grams = np.sort(rng.integers(0, 1 << bits, n, np.uint64, endpoint=False) if bits < 64 else rng.integers(0, (1 << 64) - 1, n, np.uint64))
        raw = lm_score.packed(grams)
        assert (lm_score.unpacked(raw) == grams).all()
        assert len(raw) <= 17 + n * (max(bits - math.log2(n), 0) + 2.5) / 8 + 10
        counts = rng.integers(0, 400, n)
        assert (lm_score.unsmall(lm_score.small(counts), n) == counts).all()


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    odd = [(300, "a   b\n\n  c\t d ' s 's"), (301, "\0 nul"), (302, "word " * 5000), (303, "<|endoftext|> x")]
    both = docs.select("doc_id", "text", "lang").unionByName(docs.sparkSession.createDataFrame(odd, "doc_id long, text string").withColumn("lang", F.lit("en")))
    got = packing.pack(both, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).toPandas()
    ids = {}
    for d, t in [*texts, *odd]:
        ids.setdefault(d, []).append(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    for d, group in got.groupby("doc_id", dropna=False):
        own = ids[None if d != d else int(d)]
        assert sorted(group.length)[0] > 0 and group.length.sum() == sum(map(len, own))
        for r in group.itertuples():
            assert any(zlib.crc32(x[r.start: r.start + r.length].tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in own)
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    size = ordered.groupby("sequence_id").length.sum()
    assert all(n <= packing.WINDOW and n & (n - 1) == 0 for n in size)
    assert packing.pack(empty(docs), tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_parts_of_the_packing_come_with_the_places(docs):
    """Even parts in the order of kind, place, twin and h, dealt without a second look at the texts."""
    from blockloom.llm import shards

    plan = packing.pack(docs, tokenizers.path("byte_bpe_50k.json"))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    rng = random.Random(4)
    rows = sorted((rng.choice(["", "en"]), rng.randrange(3), rng.choice([7, 7, 7, rng.randrange(99)]), rng.getrandbits(64) - (1 << 63), 100) for _ in range(4000))
    for parts in (1, 13, 1200):
        places = shards.Places([], [], {})
        places.cut(rows, parts)
        got = [places.part(*row[:-1]) for row in rows]
        assert max(collections.Counter(got).values()) <= 4000 / parts * 1.2 + 15 and 0 <= min(got) and max(got) < parts
        assert parts == 1200 or got == sorted(got)


def test_bm25_ranks_shared_rare_terms_first():
    docs = [np.array(x, np.uint16) for x in ([1, 2, 3, 9], [9, 9, 8], [1, 2, 3, 3], [7, 7])]
    assert packing.Index(docs).neighbours(0)[:2].tolist() == [0, 2]


def test_bm25_scores_all_shared_terms_over_a_whole_shard():
    rng = np.random.default_rng(2)
    docs = [np.minimum(rng.geometric(0.01, rng.integers(60, 300)), 900).astype(np.uint16) for _ in range(400)]
    index = packing.Index(docs)
    bags = [collections.Counter(d.tolist()) for d in docs]
    df = collections.Counter(t for b in bags for t in b)
    mean = sum(map(len, docs)) / len(docs)

    def bm25(a, b):
        return sum(math.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for t in a if t in b)

    want = np.array([bm25(bags[7], b) for b in bags])
    assert np.allclose(index.scores(7), want, rtol=1e-4)
    unused = rng.random(len(docs)) < 0.4
    index.drop(unused)
    assert index.alive.tolist() == np.flatnonzero(unused).tolist() and np.allclose(index.scores(7), want[unused], rtol=1e-4)


def test_packing_finds_neighbours_across_a_whole_shard():
    """Twins that lie hundreds of documents apart share a window."""
    rng = np.random.default_rng(6)
    texts = [np.append(rng.integers(10, 60_000, 1000), 1).astype(np.uint16) for _ in range(500)]
    packer = packing.Packer(0)
    for i in range(1000):
        packer.add(i, texts[i % 500])
    packer.finish()
    windows = collections.defaultdict(set)
    for doc, *_, sequence, _offset in packer.rows:
        windows[sequence].add(doc % 500 if doc >= 500 else doc + 1000)
    together = sum(any(i in w and i + 1000 in w for w in windows.values()) for i in range(500))
    assert together >= 450


def test_places_bring_documents_of_a_topic_together():
    from blockloom.llm import shards

    rng = random.Random(9)
    topics = [[f"w{k}x{j}" for j in range(60)] for k in range(4)]
    texts = [" ".join(rng.choice(topics[i % 4]) if rng.random() < 0.5 else f"common{rng.randrange(40)}" for _ in range(80)) for i in range(400)]
    found = list(shards.bags(pa.array([*texts, "", None])))
    assert len(found) == 402 and len(found[400]) == len(found[401]) == 0
    places = shards.Places(["en"] * 400, found[:400], {"en": 8})
    got = [places.place("en", b)[0] for b in found[:400]]
    most = sum(max(collections.Counter(i % 4 for i in range(400) if got[i] == p).values()) for p in set(got))
    assert most >= 380 and len(set(got)) > 1
    assert places.place("en", found[400]) == (places.place("en", found[401])) and places.place("xx", found[0])[0] == 0


def test_extract(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies.</div><main><article><header><h1>T &amp; U</h1></header><p>One para<br>graph, <a href=x>a link</a>.<p>Short.
<div class="ad">Buy now, it is good.</div><ul><li>first<li>second</ul><form><p>Subscribe to the letter.</p></form><script>if(a<b){"</p>"}</script></article>
<section class="comments"><article class="comment"><p>Nice post, I liked it a lot.</p></article></section></main><aside><p>Related stuff.</p></aside><footer>&copy; 2020</footer>"""
    pages = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (3, "u", "<p " * 3000, "x"), (4, "u", "plain", "x")], "page_id long, url string, html string, text string")
    got = extract.extract(pages)
    rows = {(r.page_id, r.text): r.n_chars for r in got.collect()}
    text = "T & U\n\nOne para graph, a link.\n\nShort.\n\nfirst\n\nsecond"
    assert rows[(1, text)] == len(text) and rows[(2, "")] == 0 and rows[(3, "")] == 0
    assert extract.extract(pages.where("false")).count() == 0


PROSE = "<p>The first sentence is here and it has some length.</p><p>Let <math><mi>x</mi> = 3</math> be <noscript>given</noscript>.</p>"


@pytest.mark.parametrize("opened, kept", [
    ("article", True), ('article class="post-12 post category-search tag-social"', True), ('article id="post-cookie-recipes"', True),
    ('main class="content content-sidebar-wrap"', True), ('div class="post tag-social"', True), ('article class="comment"', False),
    ('article class="post comment-7 comment"', False), ('div class="article-footer"', False), ('div class="post sidebar"', False), ('div id="cookie-notice"', False)])
def test_names_of_articles_and_of_boilerplate(opened, kept):
    page = f"<body><nav><a>Home</a></nav><main><{opened}>{PROSE}</{opened.split()[0]}></main><footer>Site</footer>"
    assert extract.main_text(page) == ("The first sentence is here and it has some length.\n\nLet x = 3 be given." if kept else "")


@pytest.mark.parametrize("part, n, close", [("<p ", 330_000, ""), ("<p ", 330_000, ">"), ("<p ", 330_000, "\" >"), ("<p \">x", 160_000, ""), ("<!--", 250_000, ""),
                                            ("</script ", 100_000, ""), ("<div>", 100_000, "x" + "</nav>" * 100_000),
                                            ("<article><p>A sentence of the article that is long.</p></article><nav><a>Menu</a></nav>", 10_000, "")])
def test_bad_and_long_pages_take_linear_time(part, n, close):
    start = time.process_time()
    extract.main_text(part * n + close)
    assert time.process_time() - start < 10  # about a second; hours where time is quadratic


def test_labels_of_small_pages_are_the_cheapest():
    rng = random.Random(6)
    for _ in range(80):
        parts = [rng.choice(["<div>", "</div>", "<article>", "</article>", "<nav>", "</nav>", '<div class="post">', '<p class="share">', "<p>One more sentence of it.",
                             "<p>Word", "<h2>Title</h2>", "<a href=x>link</a>", "<li>entry"]) for _ in range(rng.randint(1, 14))]
        found = extract.blocks("".join(parts))
        if found:
            node, capacity = extract.graph(found)
            n = len(capacity) - 2
            cost = lambda side: sum(c for u in side for v, c in capacity[u].items() if v not in side)
            kept = {k for k, yes in zip(node, extract.label(found)) if yes}
            assert abs(cost({n} | kept) - min(cost({n} | {i for i in range(n) if m >> i & 1}) for m in range(1 << n))) < 1e-6


def test_minimum_cut_is_least():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 6)
        capacity = [{} for _ in range(n + 2)]
        edges = []
        for u, v in [(n, i) for i in range(n)] + [(i, n + 1) for i in range(n)] + [(i, j) for i in range(n) for j in range(n) if i != j]:
            c = rng.choice([0, 0, rng.randint(1, 9)])
            edges.append((u, v, c))
            capacity[u][v] = float(c)
        cost = lambda side: sum(c for u, v, c in edges if u in side and v not in side)
        got = extract.source_side([dict(x) for x in capacity], n, n + 1)
        assert cost(got) == min(cost({n} | {i for i in range(n) if m >> i & 1}) for m in range(1 << n))


@pytest.mark.parametrize("held", [30, 500_000])
def test_neighbours_in_small_batches(monkeypatch, held):
    """Every repeated string is known or passed on, however a bucket is cut into batches."""
    monkeypatch.setattr(substrings, "HELD", held)
    rng = random.Random(8)
    parts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(5, 60))) for _ in range(9)]
    raw = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 8))).encode() for _ in range(80)]
    raw += [raw[0][3:] + b"zz"] * 90
    length, head = 20, 5
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    text, low, high, key, cover = substrings.sampled(np.frombuffer(b"".join(raw), np.uint8), offsets, length, head)
    order = np.lexsort((low, text, cover.view(np.int64), key.view(np.int64)))
    bucket = pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (key.view(np.int64), cover.view(np.int64), text, low.astype(np.int32), high.astype(np.int32))], ["key", "cover", "id", "low", "high"])
    found = pa.Table.from_batches(list(substrings._neighbours(bucket.slice(i, 17) for i in range(0, bucket.num_rows, 17)))).to_pandas()
    known = found[found.kind == substrings.REPEATS]
    passed = found[found.kind != substrings.REPEATS]
    docs = pa.table({"id": np.arange(len(raw)), "text": [r.decode() for r in raw]})
    strings = substrings._strings(length)(None, docs, pa.Table.from_pandas(passed, preserve_index=False)).to_pandas().sort_values(["string", "id", "low"])
    late = pa.Table.from_batches(list(substrings._repeated(iter(pa.Table.from_pandas(strings, preserve_index=False).to_batches(13))))).to_pandas()
    got = {(i, s) for f in (known, late) for i, a, b in f[["id", "low", "high"]].to_numpy() for s in range(a, b + 1)}
    seen = collections.Counter(r[s: s + length] for r in raw for s in range(len(r) - length + 1))
    assert got == {(i, s) for i, r in enumerate(raw) for s in range(len(r) - length + 1) if seen[r[s: s + length]] > 1}
