"""Quality rules: text statistics, and distance of a document's histograms from its language's.

All of it is built-in functions: one pass over the texts, no shuffle of texts; the counts of each
document are written once to the checkpoint folder.  The language
references are sums over all documents of the language, a row per language.

Empty and null texts have no words and fail the base rule.  A null language, or one with too few
characters for a reference, is compared with the reference of all documents together.  Rows repeat
as they come, and extra columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.session import materialise

GAP = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50            # base rule
MAX_REPEAT_PERCENT = 50   # base rule
REFERENCE_CHARS = 10_000  # a language with fewer characters has no reference of its own
CLASS_MIN_CHARS = 200     # shorter texts aren't judged by their characters
WORDS_MIN_COUNT = 150     # texts with fewer words aren't judged by their common words
CLASS_LIMIT = 0.30        # Jensen-Shannon distance (base 2) beyond which a text is dropped
WORDS_LIMIT = 0.75
PLACE_BITS = 26           # of a word's position in its text
PLACES = (1 << PLACE_BITS) - 1

#: Very frequent words of four languages.
COMMON = ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with",
          "der", "die", "und", "den", "ist", "nicht", "ein", "zu", "von", "mit",
          "le", "les", "des", "est", "que", "une", "dans", "pour", "pas", "sur", "et",
          "el", "los", "las", "por", "una", "con", "su", "del", "se", "y"]
CLASSES = ["ascii_letter", "other_letter", "digit", "stop", "symbol", "other"]


def _left(text: Column, dropped: str) -> Column:
    return F.regexp_replace(text, dropped, "")


def class_counts(rest: Column, total: Column) -> Column:
    """Code points by class, white space left out, from `rest`: the text without ASCII letters and spaces."""
    count = {
        "digit": F.length(_left(rest, r"[^0-9]+")),
        "symbol": F.length(_left(rest, r"[^#*$%&|<>]+")),
        "stop": F.length(_left(rest, r"[^.,;:!?'\"()-]+")),
        "other_letter": F.length(_left(rest, r"[\p{ASCII}\P{L}]+")),
    }
    count["ascii_letter"] = total - F.length(rest)
    count["other"] = F.length(rest) - count["digit"] - count["symbol"] - count["stop"] - count["other_letter"]
    return F.array(*[count[c].cast("long") for c in CLASSES])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, and the two histograms `classes` and `common` (arrays of long).

    Repeated windows are found by sorting numbers: 38 bits of a window's hash above its position.
    Neighbours that agree in those bits are candidates, and only they are compared as strings.
    """
    d = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.select(
        "doc_id", "lang",
        F.array_remove(F.split("text", GAP), "").alias("words"),
        _left(F.col("text"), r"[A-Za-z\x20\x09-\x0D]+").alias("rest"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.select(
        "doc_id", "lang", "words", "rest",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"""CASE WHEN size(words) < 3 THEN array() ELSE sort_array(transform(sequence(0, size(words) - 3),
            i -> (shiftleft(shiftright(xxhash64(words[i], words[i + 1], words[i + 2]), {PLACE_BITS}), {PLACE_BITS}) + i))) END""").alias("packed"))
    d = d.select(
        "doc_id", "lang", "words", "n_words", "word_chars", "n_dup_lines", "packed",
        class_counts(F.col("rest"), F.col("word_chars")).alias("classes"),
        _common_counts(F.col("words")).alias("common"))
    d = d.withColumn("n_symbols", F.col("classes")[CLASSES.index("symbol")])
    # neighbours that agree give both positions
    d = d.withColumn("near", F.expr(f"""CASE WHEN size(packed) < 2 THEN array() ELSE flatten(transform(
        arrays_zip(slice(packed, 1, size(packed) - 1), slice(packed, 2, size(packed) - 1)),
        x -> CASE WHEN shiftright(x.`0`, {PLACE_BITS}) = shiftright(x.`1`, {PLACE_BITS})
                  THEN array(CAST(x.`0` & {PLACES} AS INT), CAST(x.`1` & {PLACES} AS INT)) ELSE array() END)) END"""))
    # the same text in a group of equal hashes: order candidates by their words, then look at neighbours again
    d = d.withColumn("found", F.expr("""CASE WHEN size(near) = 0 THEN array() ELSE sort_array(transform(
        array_distinct(near),
        i -> struct(concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS w, i AS i))) END"""))
    d = d.withColumn("twice", F.expr("""CASE WHEN size(found) < 2 THEN array() ELSE
        flatten(transform(arrays_zip(slice(found, 1, size(found) - 1), slice(found, 2, size(found) - 1)),
            x -> CASE WHEN x.`0`.w = x.`1`.w THEN array(x.`0`.i, x.`1`.i) ELSE array() END)) END"""))
    return d.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "classes",
        F.expr("""CASE WHEN size(twice) = 0 THEN 0L ELSE
            size(array_distinct(flatten(transform(twice, i -> array(i, i + 1, i + 2))))) END""").cast("long").alias("n_repeat_words"),
        _common_counts(F.col("words")).alias("common"))


def _common_counts(words: Column) -> Column:
    """How often each common word occurs, in whatever case."""
    joined = F.lower(F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")))
    return F.array(*[((F.length(joined) - F.length(F.replace(joined, F.lit(f" {w} "), F.lit("")))) / F.lit(len(w) + 2)).cast("long") for w in COMMON])


def references(stats: DataFrame) -> DataFrame:
    """A row per language with the shares of the summed histograms, and one row with a null language for all together."""
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + \
           [F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(len(COMMON))]
    each = stats.groupBy("lang").agg(*sums)
    rows = each.where(F.col("lang").isNotNull()).unionByName(
        each.agg(*[F.sum(c).alias(c) for c in each.columns if c != "lang"]).withColumn("lang", F.lit(None).cast("string")))
    total = sum((F.col(f"c{i}") for i in range(len(CLASSES))), F.lit(0))
    return rows.where(F.col("lang").isNull() | (total >= REFERENCE_CHARS)).select(
        F.col("lang").alias("ref_lang"),
        shares(F.array(*[F.col(f"c{i}") for i in range(len(CLASSES))])).alias("ref_classes"),
        shares(F.array(*[F.col(f"w{i}") for i in range(len(COMMON))])).alias("ref_common"))


def shares(counts: Column) -> Column:
    """A histogram as shares of its total; null where it is empty."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def js_distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares; null where either is null."""
    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(p * 2 / (p + q)) / 2).otherwise(0.0)

    terms = F.zip_with(left, right, lambda p, q: part(p, q) + part(q, p))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(total.isNotNull(), F.sqrt(F.greatest(total, F.lit(0.0))))  # rounding may go below 0


def quality(docs: DataFrame) -> DataFrame:
    """Per document: the base counts, base_failed, the two distances (null where too short), kept."""
    stats = materialise(statistics(docs))  # numbers only; both uses then read the texts once
    refs = materialise(references(stats))  # a row per language
    own = refs.where(F.col("ref_lang").isNotNull())
    pooled = refs.where(F.col("ref_lang").isNull()).select(F.struct("ref_classes", "ref_common").alias("pooled"))
    pooled_row = pooled.scalar()  # one row of sums
    d = stats.join(own, F.col("lang") == F.col("ref_lang"), "left")
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        shares(F.col("classes")).alias("p_classes"), shares(F.col("common")).alias("p_common"),
        F.coalesce(F.col("ref_classes"), pooled_row["ref_classes"]).alias("q_classes"),
        F.coalesce(F.col("ref_common"), pooled_row["ref_common"]).alias("q_common"),
        (chars >= CLASS_MIN_CHARS).alias("long_enough"))
    d = d.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.when(F.col("long_enough"), js_distance(F.col("p_classes"), F.col("q_classes"))).alias("class_distance"),
        F.when(F.col("n_words") >= WORDS_MIN_COUNT, js_distance(F.col("p_common"), F.col("q_common"))).alias("word_distance"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    d = d.withColumn("base_failed", failed)
    return d.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("class_distance"), F.lit(0.0)) <= CLASS_LIMIT)
                        & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= WORDS_LIMIT))
