"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels say which documents are toxic, not which words.  Words are labelled first: in a toxic document a word is
toxic where one of its features (the word, its beginnings and endings) stands in toxic documents far more often
than in clean ones; every other word is clean.  The field has two tags, hashed features of each word, and weights
for passing from tag to tag; it is fitted by maximum likelihood on these tokens.  Forward-backward marginals then
give each word its probability of being toxic; words at 0.5 or more make up the offending spans, and a document's
score comes from the chance that no word of it is toxic, calibrated on labelled documents that the field hasn't seen.

A sequence is a sentence, or 64 words of a longer one.  Whole texts are scored; there is no shuffle of texts.  The
fit uses at most `DOCS_PER_LABEL` labelled rows of each label of at most `FIT_CHARS` characters, drawn by a hash of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.words import LOWER, Words, mix, slices, span_hashes, utf8

DOCS_PER_LABEL = 3_000
FIT_CHARS = 20_000
BITS = 20  # log2 of the number of weights
BEGINNINGS, ENDINGS = (3, 4, 5, 6, 7, 8), (3, 4, 5)  # bytes
SEQUENCE = 64  # words
EPOCHS, STEPS, BATCH_BYTES, RATE, DECAY = 4, 150, 1 << 18, 0.3, 1e-6  # at least so many passes and so many steps
SHOWN = 0.5  # part of a word's features that a step sees, so that words never seen whole are known by what is left
EVIDENCE, PRECISION = 4.5, 0.8  # standard deviations, and share in toxic documents where both labels weigh the same
SUSPECT, FLOOR = 0.2, 0.05  # marginals from here on count one by one in a score; differences far below the floor do not
CALIBRATION = 4  # one in so many labelled rows calibrates the score

_CORE = np.zeros(256, bool)
_CORE[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_KINDS = np.arange(64, dtype=np.uint64) * _STEP


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h + _KINDS[kind]) >> np.uint64(64 - BITS)).astype(np.int32)


class Tokens:
    """Words of many texts with the features of each, and the sequences they form."""

    def __init__(self, column: pa.Array):
        raw, offsets = utf8(column)
        self.data = data = LOWER[raw]
        self.words = w = Words(data, offsets, lower=False)
        n = len(w.start)
        self.offsets, self.text, self.counts = offsets, w.text, w.counts
        if not n:
            self.features = np.zeros((0, 1 + len(BEGINNINGS) + len(ENDINGS)), np.int32)
            self.first = self.size = np.zeros(0, np.int64)
            return
        core, at = _CORE[data], np.arange(len(data), dtype=np.int32)
        ahead = np.minimum.accumulate(np.where(core, at, np.int32(2**31 - 1))[::-1])[::-1]
        behind = np.maximum.accumulate(np.where(core, at, np.int32(-1)))
        begin, end = ahead[w.start].astype(np.int64), behind[w.end - 1].astype(np.int64) + 1
        bare = (begin >= w.end) | (end <= w.start)  # nothing but signs: stays as it is
        begin, end = np.where(bare, w.start, begin), np.where(bare, w.end, end)
        length, columns = end - begin, []
        for kind, sizes, move in ((1, BEGINNINGS, 1), (2, ENDINGS, -1)):
            h = np.zeros(n, np.uint64)
            for k in range(max(sizes)):
                byte = data[np.minimum(begin + k, end - 1) if move > 0 else np.maximum(end - 1 - k, begin)]
                h = np.where(k < length, h * _STEP + byte + np.uint64(1), h)
                if k + 1 in sizes:
                    columns.append(_bucket(np.where(k < length, h, np.uint64(0)), 16 * kind + k))
        columns.insert(0, _bucket(span_hashes(data, begin, end), 0))
        self.features = np.stack(columns, 1)
        stop = np.ones(n, bool)
        stop[:-1] = _STOPS[data[w.end - 1]][:-1] | (w.text[1:] != w.text[:-1])
        sentence = np.concatenate([[0], np.flatnonzero(stop)[:-1] + 1])
        size = np.diff(np.append(sentence, n))
        parts = -(-size // SEQUENCE)
        part = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        self.first = np.repeat(sentence, parts) + SEQUENCE * part
        self.size = np.minimum(np.repeat(size, parts) - SEQUENCE * part, SEQUENCE)


class Field:
    """Tag scores relative to clean: `weights` by feature, `bias`, and `moves` clean-to-toxic, toxic-to-clean, toxic-to-toxic."""

    def __init__(self):
        self.weights = np.zeros(1 << BITS, np.float32)
        self.bias = -4.0
        self.moves = np.zeros(3)
        self.slope, self.level = 1.0, 0.0  # of the document score
        self.prior = 0.0

    def emissions(self, features: np.ndarray, shown: np.ndarray | None = None) -> np.ndarray:
        w = self.weights[features] if shown is None else self.weights[features] * shown
        return np.clip(self.bias + w.sum(1, dtype=np.float64), -30, 30)

    def marginals(self, e: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of the toxic tag by word, sums over all words of the probabilities of the three moves)."""
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        live = np.searchsorted(-size, -np.arange(1, SEQUENCE + 2), side="right")  # sequences with so many words
        w, (ct, tc, tt) = np.exp(e), np.exp(self.moves)
        clean, toxic, scale = np.empty(len(e)), np.empty(len(e)), np.ones(len(e))
        a = b = None
        for t in range(SEQUENCE):
            at = first[: live[t]] + t
            if not len(at):
                break
            if t:
                a, b = a[: len(at)], b[: len(at)]
                a, b = a + b * tc, (a * ct + b * tt) * w[at]
            else:
                a, b = np.ones(len(at)), w[at]
            z = a + b
            a, b = a / z, b / z
            clean[at], toxic[at], scale[at] = a, b, z
        p, moved = np.empty(len(e)), np.zeros(3)
        back_a = back_b = np.ones(0)
        for t in range(SEQUENCE - 1, -1, -1):
            at = first[: live[t]] + t
            if not len(at):
                continue
            ahead = first[: live[t + 1]] + t + 1
            a, b = np.ones(len(at)), np.ones(len(at))
            if len(ahead):
                here, z = ahead - 1, scale[ahead]
                on_a, on_b = back_a / z, back_b * w[ahead] / z
                moved += [float((clean[here] * ct * on_b).sum()), float((toxic[here] * tc * on_a).sum()), float((toxic[here] * tt * on_b).sum())]
                a[: len(ahead)], b[: len(ahead)] = on_a + ct * on_b, tc * on_a + tt * on_b
            back_a, back_b = a, b
            p[at] = toxic[at] * b
        return np.clip(p, 0.0, 1.0), moved

    def trained(self, batches: list[Tokens], tags: list[np.ndarray], rng: np.random.Generator) -> None:
        """Maximum likelihood of the tags by steps in the direction of each batch's gradient, scaled by past ones."""
        past, past_moves, past_bias = np.full(1 << BITS, 1e-3, np.float32), np.full(3, 1e-3), 1e-3
        for _ in range(max(EPOCHS, -(-STEPS // max(1, len(batches))))):
            for k in rng.permutation(len(batches)):
                tokens, y = batches[k], tags[k]
                features = tokens.features
                shown = (rng.random(features.shape, np.float32) < SHOWN).astype(np.float32) / np.float32(SHOWN)
                p, moved = self.marginals(self.emissions(features, shown), tokens.first, tokens.size)
                gap = (y - p).astype(np.float32)
                inner = np.ones(len(y), bool)
                inner[tokens.first] = False
                before, after = y[:-1][inner[1:]], y[1:][inner[1:]]
                seen = np.array([((1 - before) * after).sum(), (before * (1 - after)).sum(), (before * after).sum()], float)
                step = np.bincount(features.ravel(), (gap[:, None] * shown).ravel(), 1 << BITS).astype(np.float32) - DECAY * len(y) * self.weights
                past += step * step
                self.weights += RATE * step / np.sqrt(past)
                move = seen - moved
                past_moves += move * move
                self.moves = np.clip(self.moves + RATE * move / np.sqrt(past_moves), -8, 8)
                past_bias += float(gap.sum()) ** 2
                self.bias += RATE * float(gap.sum()) / past_bias**0.5

    def suspicion(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The chance of each word, and for each text minus the logarithm of the chance that none of its suspect words
        is toxic, plus that of a mean other word; so a text's length is no evidence."""
        p, _ = self.marginals(self.emissions(tokens.features), tokens.first, tokens.size)
        clean, suspect, n = -np.log1p(-np.minimum(p, 1 - 1e-12)), p >= SUSPECT, len(tokens.counts)
        others = np.bincount(tokens.text[~suspect], clean[~suspect], n) / np.maximum(1, np.bincount(tokens.text[~suspect], minlength=n))
        return p, np.bincount(tokens.text[suspect], clean[suspect], n) + others

    def scores(self, suspicion: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.level + self.slope * np.log(suspicion + FLOOR), -30, 30)))


def batched(texts: pa.Array) -> list[tuple[int, int, Tokens]]:
    """The texts as batches of some BATCH_BYTES bytes, with their row ranges; batches without words are left out."""
    out = [(a, b, Tokens(texts.slice(a, b - a))) for a, b in slices(texts, BATCH_BYTES)]
    return [x for x in out if len(x[2].features)]


def word_tags(batches: list[tuple[int, int, Tokens]], toxic: np.ndarray) -> list[np.ndarray]:
    """1 for words of toxic texts with a feature that tells, else 0, by batch; `toxic` by text."""
    a, b = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for first, last, tokens in batches:
        marks = toxic[first:last]
        pairs = np.unique(tokens.features.astype(np.int64) * len(marks) + tokens.text[:, None])
        feature, text = pairs // len(marks), pairs % len(marks)
        a += np.bincount(feature[marks[text]], minlength=1 << BITS)
        b += np.bincount(feature[~marks[text]], minlength=1 << BITS)
    n_a, n_b = max(1, toxic.sum()), max(1, (~toxic).sum())
    share, n = n_a / (n_a + n_b), np.maximum(a + b, 1)
    part = np.clip(a / n, 1e-9, 1 - 1e-9)
    z = np.sqrt(np.maximum(0, 2 * n * (part * np.log(part / share) + (1 - part) * np.log((1 - part) / (1 - share)))))
    tells = (part > share) & (z >= EVIDENCE) & (a / n_a >= PRECISION * (a / n_a + b / n_b)) & (a > 0)
    return [(tells[tokens.features].any(1) & toxic[first:last][tokens.text]).astype(np.int64) for first, last, tokens in batches]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[pa.Table, dict[int, float]]:
    """(text, toxic, part) of the drawn labelled rows, one of each group of near copies, and the rows each label stands for."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # of several labels the worse
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_000))
    share = F.when(F.col("toxic") == 1, F.lit(sizes.get(1, 0))).otherwise(F.lit(sizes.get(0, 0)))
    drawn = F.broadcast(marks.where(place * share < 1_000_000 * DOCS_PER_LABEL))  # at most about two times DOCS_PER_LABEL rows
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") <= FIT_CHARS)
    rows = texts.join(drawn, "doc_id").select("text", "toxic", "doc_id", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(CALIBRATION)).alias("part"))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(*utf8(batch.column(0)))
            text, hashed = words.shingles()
            least = np.full(batch.num_rows, 2**64 - 1, np.uint64)
            np.minimum.at(least, text, hashed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least.view(np.int64))], names=["text", "toxic", "doc_id", "part", "least"])

    table = rows.mapInArrow(reduced, "text string, toxic int, doc_id long, part long, least long").toArrow()
    frame = table.select(["doc_id", "least", "toxic"]).to_pandas()
    keep = frame.sort_values(["doc_id", "toxic", "least"]).drop_duplicates(["least", "toxic"]).index.to_numpy()
    return table.select(["text", "toxic", "part"]).take(pa.array(keep)), {k: float(v) for k, v in sizes.items()}


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """The field and its calibration; without labelled rows of both labels, one that scores the share of toxic rows."""
    table, sizes = sample(docs, labels)
    model = Field()
    model.prior = sizes.get(1, 0.0) / max(1.0, sum(sizes.values()))
    toxic, part = table.column("toxic").to_numpy() == 1, table.column("part").to_numpy()
    model.slope, model.level = 0.0, float(np.log((model.prior or 1e-6) / max(1 - model.prior, 1e-6)))
    if toxic.all() or not toxic.any():
        return model
    learn = part != 0
    if toxic[learn].any() and not toxic[learn].all():
        batches = batched(table.column("text").filter(pa.array(learn)).combine_chunks())
        model.trained([x[2] for x in batches], word_tags(batches, toxic[learn]), np.random.default_rng(11))
        del batches
    unseen = ~learn if toxic[~learn].sum() >= 5 and (~toxic[~learn]).sum() >= 5 else np.ones(len(part), bool)
    texts = table.column("text").filter(pa.array(unseen)).combine_chunks()
    suspicion = np.concatenate([model.suspicion(Tokens(texts.slice(a, b - a)))[1] for a, b in slices(texts, BATCH_BYTES)])
    x, y = np.log(suspicion + FLOOR), toxic[unseen].astype(float)
    weight = np.where(y == 1, sizes[1] / max(1, y.sum()), sizes[0] / max(1, (1 - y).sum()))
    weight *= len(y) / weight.sum()
    model.slope, model.level = 1.0, 0.0
    for _ in range(30):  # logistic regression by Newton's steps
        p = 1 / (1 + np.exp(-np.clip(model.level + model.slope * x, -30, 30)))
        curve = weight * p * (1 - p)
        gradient = np.array([(weight * (y - p)).sum() - 1e-3 * model.level, (weight * (y - p) * x).sum() - 1e-3 * (model.slope - 1)])
        matrix = np.array([[curve.sum() + 1e-3, (curve * x).sum()], [(curve * x).sum(), (curve * x * x).sum() + 1e-3]])
        level, slope = np.linalg.solve(matrix, gradient)
        model.level, model.slope = model.level + float(np.clip(level, -2, 2)), model.slope + float(np.clip(slope, -1, 1))
    return model


def _spans(tokens: Tokens, p: np.ndarray) -> list[list[tuple[int, int]]]:
    """Offsets (code points, end exclusive) of stretches of toxic words, by text."""
    out: list[list[tuple[int, int]]] = [[] for _ in tokens.counts]
    hit = np.flatnonzero(p >= 0.5)
    if not len(hit):
        return out
    letters = np.concatenate([[0], np.cumsum((tokens.data & 0xC0) != 0x80)])
    joined = np.zeros(len(hit), bool)
    joined[1:] = (np.diff(hit) == 1) & (np.diff(tokens.text[hit]) == 0)
    opens = np.flatnonzero(~joined)
    closes = np.append(opens[1:], len(hit)) - 1
    text = tokens.text[hit[opens]]
    base = letters[tokens.offsets[text]]
    for t, s, e in zip(text.tolist(), (letters[tokens.words.start[hit[opens]]] - base).tolist(), (letters[tokens.words.end[hit[closes]]] - base).tolist()):
        out[t].append((s, e))
    return out


def toxicity(docs: DataFrame, labels: DataFrame | None = None, model: Field | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start, end in code points); fitted on `labels` if no model is given.

    Null and empty texts have no spans and the score of a text without a suspicious word; equal texts score alike;
    without labels of both kinds every text scores the share of toxic labels.  Columns besides doc_id and text aren't read.
    """
    model = model or fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights of four bytes

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for first, last in slices(batch.column(1)):
                tokens = Tokens(batch.column(1).slice(first, last - first))
                p, suspicion = m.suspicion(tokens)
                s = m.scores(suspicion)
                spans = [[{"start": a, "end": b} for a, b in x] for x in _spans(tokens, p)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(spans, span)],
                                                 names=["doc_id", "score", "predicted", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(score, f"doc_id {kind}, score double, predicted int, spans array<struct<start: long, end: long>>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")
