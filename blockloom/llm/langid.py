"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of order 4 over letters (lower case; every run of other characters is one
space).  The models of all languages lie together in sorted arrays of 64-bit n-gram keys: a row
holds the log-probability in every language, so one binary search serves them all.  A text gets
the language with the lowest cross-entropy per character, and is rejected where that is above what
nearly all pieces of its length, cut from texts of the language, show.  A language with few such
pieces takes the distance from its median to that line from the others; one without any rejects what
is no more likely than letters drawn at random.

A null text, or one without letters, is `und` with score 0, and rejected.  Without any labelled row
every text is `und`.  Rows repeat as they come; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 4
DISCOUNT = 0.75
DOCS_PER_LANGUAGE = 1500  # bound of the fitting sample, drawn by a hash of doc_id
LANGUAGES = 500           # the most frequent labels are learned
COUNTED_AT_ONCE = 1 << 20  # n-grams a task holds while it counts
CALIBRATION = 5           # one sampled row in so many measures the rejection line and isn't counted
PIECES = (3, 6, 12, 25, 50, 100, 200, 400, 800, 1600, 3200)  # letters of the pieces that it is measured on
REJECT_QUANTILE = 0.995   # of a language's pieces of one length, its own texts' cross-entropy
REJECT_SLACK = 0.7        # nats per character on top
ENOUGH_PIECES = 20        # for a quantile of a language's own
SCORE_CHARS = 50          # characters' worth of evidence that the score may show
SPACE = 1


def _letters() -> np.ndarray:
    table = np.full(1 << 16, SPACE, np.uint16)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


def codes(text: str | None) -> np.ndarray:
    """The text's letters and single spaces as 16-bit codes, ORDER - 1 spaces first; empty if it has no letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    if not text:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(raw) and raw.max() >= 1 << 16:
        far = np.array([ord("?") if not chr(c).isalpha() else 0xFFFF for c in raw[raw >= 1 << 16]], np.uint32)
        raw = raw.copy()
        raw[raw >= 1 << 16] = far
        c = _TABLE[0][raw]
        c[raw == 0xFFFF] = 2
    else:
        c = _TABLE[0][raw]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != SPACE) | (c[:-1] != SPACE)
    c = c[keep]
    if not (c != SPACE).any():
        return np.zeros(0, np.uint64)
    return np.concatenate([np.full(ORDER - 1, SPACE, np.uint16), c]).astype(np.uint64)


def grams(c: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Keys of the n-grams that end at each character after the leading spaces."""
    n = len(c) - (ORDER - 1)
    key = np.zeros(max(n, 0), np.uint64)
    for j in range(order):
        at = ORDER - order + j
        key = (key << np.uint64(16)) | c[at: at + n]
    return key


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


class _Language:
    """One language's counts, as probabilities and back-off weights by order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int):
        self.alphabet, self.levels = alphabet, []
        levels = []
        for order in range(ORDER, 0, -1):
            levels.append((order, keys, counts))
            lower, counts = np.unique(keys & np.uint64((1 << 16 * (order - 1)) - 1), return_counts=True)
            keys = lower  # below the top, an n-gram counts once for each character seen before it
        for order, keys, counts in reversed(levels):
            contexts, inverse = np.unique(keys >> np.uint64(16), return_inverse=True)
            total = np.bincount(inverse, weights=counts)
            weight = DISCOUNT * np.bincount(inverse) / total
            p = (counts - DISCOUNT) / total[inverse] + weight[inverse] * self.lower(order, keys)
            self.levels.append((keys, p, contexts, weight))

    def lower(self, order: int, keys: np.ndarray) -> np.ndarray:
        if order == 1:
            return np.full(len(keys), 1.0 / self.alphabet)
        return self.probability(order - 1, keys & np.uint64((1 << 16 * (order - 1)) - 1))

    def weight(self, order: int, contexts: np.ndarray) -> np.ndarray:
        at, hit = _find(self.levels[order - 1][2], contexts)
        return np.where(hit, self.levels[order - 1][3][at], 1.0)

    def probability(self, order: int, keys: np.ndarray) -> np.ndarray:
        at, hit = _find(self.levels[order - 1][0], keys)
        out = self.levels[order - 1][1][at]
        if not hit.all():
            miss = keys[~hit]
            out = out.copy()
            out[~hit] = self.weight(order, miss >> np.uint64(16)) * self.lower(order, miss)
        return out


@dataclass
class Model:
    """languages, and by order: sorted keys, log-probabilities, sorted contexts, log back-off weights."""

    languages: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: float
    lines: np.ndarray  # a row for each language: highest cross-entropy that isn't rejected, by length as in PIECES

    @staticmethod
    def fit(counts: pd.DataFrame) -> "Model":
        """From rows lang, gram (int64 view of the key), n."""
        languages = sorted(counts["lang"].unique())
        everything = counts["gram"].to_numpy(np.int64).view(np.uint64)
        alphabet = len(np.unique(everything & np.uint64(0xFFFF))) + 1
        each = []
        for lang in languages:
            own = counts[counts["lang"] == lang]
            keys = own["gram"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(keys)
            each.append(_Language(keys[order], own["n"].to_numpy(np.float64)[order], alphabet))
        keys, logs, contexts, weights = [], [], [], []
        for order in range(1, ORDER + 1):
            k = np.unique(np.concatenate([m.levels[order - 1][0] for m in each])) if each else np.zeros(0, np.uint64)
            c = np.unique(np.concatenate([m.levels[order - 1][2] for m in each])) if each else np.zeros(0, np.uint64)
            keys.append(k)
            contexts.append(c)
            logs.append(np.stack([np.log(m.probability(order, k)) for m in each], axis=1).astype(np.float32) if each else np.zeros((0, 0), np.float32))
            weights.append(np.stack([np.log(m.weight(order, c)) for m in each], axis=1).astype(np.float32) if each else np.zeros((0, 0), np.float32))
        n = len(languages)
        return Model(languages, keys, logs, contexts, weights, -np.log(alphabet), np.full((n, len(PIECES)), np.log(alphabet)))

    def totals(self, c: np.ndarray, block: int = 1 << 18) -> np.ndarray:
        """Summed log-probability of a text in each language; long texts go block by block."""
        out = np.zeros(len(self.languages))
        for start in range(0, len(c) - (ORDER - 1), block):
            out += self._sum(ORDER, grams(c[start: start + block + ORDER - 1]))
        return out

    def _sum(self, order: int, wanted: np.ndarray) -> np.ndarray:
        if order == 0:
            return np.full(len(self.languages), len(wanted) * self.floor)
        at, hit = _find(self.keys[order - 1], wanted)
        out = self.logs[order - 1][at[hit]].sum(axis=0, dtype=np.float64)
        if not hit.all():
            miss = wanted[~hit]
            at, known = _find(self.contexts[order - 1], miss >> np.uint64(16))
            out = out + self.weights[order - 1][at[known]].sum(axis=0, dtype=np.float64)
            out = out + self._sum(order - 1, miss & np.uint64((1 << 16 * (order - 1)) - 1))
        return out

    def predict(self, text: str | None) -> tuple[str, float, float | None, int, bool]:
        """(language, score, cross-entropy in nats a character, characters, rejected)."""
        c = codes(text)
        n = len(c) - (ORDER - 1)
        if n <= 0 or not self.languages:
            return "und", 0.0, None, max(n, 0), True
        entropy = -self.totals(c) / n
        best = int(np.argmin(entropy))
        score = 1.0 / float(np.exp(-(entropy - entropy[best]) * min(n, SCORE_CHARS)).sum())
        line = np.interp(np.log(n), np.log(PIECES), self.lines[best])
        return self.languages[best], score, float(entropy[best]), n, bool(entropy[best] > line)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """lang, text, part of about `per_language` labelled rows of each language, drawn by a hash of doc_id."""
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return known.select("lang", "text", F.lit(0).alias("part")).limit(0)
    size = F.create_map(*[F.lit(x) for row in sizes for x in (row["lang"], row["count"])])[F.col("lang")]
    drawn = known.withColumn("count", size)  # null, so not drawn, for rarer languages
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    return drawn.where(place * F.col("count") < F.lit(1_000_000 * per_language)).select(
        "lang", "text", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(CALIBRATION)).alias("part"))


def fit(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Learn from labelled rows that aren't held out.  What reaches the driver is the sample's distinct
    n-grams: bounded by `per_language`, not by the corpus."""
    drawn = sample(docs, per_language)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                found: list[np.ndarray] = []
                held = 0
                for k, c in enumerate(map(codes, texts)):
                    if len(c):
                        found.append(grams(c))
                        held += len(found[-1])
                    if found and (held > COUNTED_AT_ONCE or k == len(texts) - 1):
                        gram, n = np.unique(np.concatenate(found), return_counts=True)
                        found, held = [], 0
                        yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "n": n.astype(np.int64)})

    counts = drawn.where(F.col("part") != 0).mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model = Model.fit(counts.toPandas())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            rows = []
            for lang, c in zip(batch["lang"], map(codes, batch["text"])):
                for length, piece in pieces(c):
                    entropy = -m.totals(piece) / length
                    best = int(np.argmin(entropy))
                    if m.languages[best] == lang:
                        rows.append((lang, length, entropy[best]))
            yield pd.DataFrame(rows, columns=["lang", "length", "entropy"])

    if model.languages:
        found = drawn.where(F.col("part") == 0).select("lang", "text").mapInPandas(measure, "lang string, length long, entropy double")
        model.lines = _lines(model, found.groupBy("lang", "length").agg(
            F.percentile_approx("entropy", [0.5, REJECT_QUANTILE]).alias("q"), F.count("*").alias("n")).toPandas())
    return model


def pieces(c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, codes) of up to three pieces of each length, from words' starts near the text's start, middle and end."""
    c = c[ORDER - 1:]
    opens = np.flatnonzero((c != SPACE) & np.concatenate([[True], c[:-1] == SPACE])) if len(c) else c
    for length in PIECES:
        last = np.searchsorted(opens, len(c) - length, side="right") - 1
        if last >= 0:
            for k in sorted({0, last // 2, last}):
                yield length, np.concatenate([np.full(ORDER - 1, SPACE, np.uint64), c[opens[k]: opens[k] + length]])


def _lines(model: Model, measured: pd.DataFrame) -> np.ndarray:
    """By language and length; `measured` has rows lang, length, q (median and quantile), n."""
    shape = len(model.languages), len(PIECES)
    middle, spread = np.full(shape, np.nan), np.full(shape, np.nan)
    for r in measured.itertuples():
        at = model.languages.index(r.lang), PIECES.index(r.length)
        middle[at] = r.q[0]
        if r.n >= ENOUGH_PIECES:
            spread[at] = r.q[1] - r.q[0]
    for j in range(shape[1]):
        known = spread[:, j][~np.isnan(spread[:, j])]
        pooled = known.mean() if len(known) else (spread[:, j - 1].mean() if j else np.nan)
        spread[:, j] = np.where(np.isnan(spread[:, j]), pooled, spread[:, j])
    lines = middle + spread + REJECT_SLACK
    for j in range(shape[1]):  # where texts of a length lack, as shorter ones
        before = lines[:, j - 1] if j else np.full(shape[0], -model.floor)
        lines[:, j] = np.where(np.isnan(lines[:, j]), before, lines[:, j])
    return lines


def _predicted(model: Model, column: str) -> Column:
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, cross_entropy double, n_letters long, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score", "cross_entropy", "n_letters", "rejected"])

    return predict(F.col(column).cast("string"))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, n_letters, rejected; the model is fitted on `docs` if not given."""
    model = model or fit(docs)
    return docs.select("doc_id", _predicted(model, "text").alias("p")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.*")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose language isn't rejected."""
    model = model or fit(docs)
    return docs.where(~_predicted(model, "text")["rejected"])
