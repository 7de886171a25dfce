"""Personal data: four fixed patterns, and contextual extraction bootstrapped from what they find.

Built-in functions only.  A pattern's matches and the text between them (`regexp_extract_all`,
`split`) give all positions by running sums of lengths, in code points.

Bootstrapping.  A word's lexical patterns are the two words before it and, where the word before it is
a label (`key:`, `key=`), that label alone.  The first instances are the fixed-pattern entities, whole
spans with the words before their start, and words that are keys by their form (`KEY_SHAPE`).  A
pattern's confidence is the share of known instances among all different words that follow it in lines
with a digit or an @, so words of plain prose are no pattern; an instance's, one minus the product of
its patterns' doubts.  Confident patterns make new instances
known, round by round, and in the end those outside base spans become spans of kind `id`.  A key of
hex digits alone may be a mere checksum: without a confident pattern it stays unmarked; one that opens
with its issuer's mark (`ISSUED_KEY`) is marked anywhere.  Patterns and instances are counted by partial sums before any shuffle, so a frequent pattern
or value is a row per task.  Null and empty texts have no spans; rows repeat as they come; other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.session import materialise

#: Matching with possessive repeats and a start that isn't inside a failed run: the same matches as
#: the plain patterns, in time linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
ROUNDS = 3
MIN_DOCS = 5             # documents that a pattern must be seen in
MIN_CONFIDENCE = 0.8     # of a pattern and of an instance
PRIOR = 2.0              # unknown instances assumed for each pattern besides its own
#: Published forms of access keys that open with a mark of who issued them.
ISSUED_KEY = r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[0-9A-Za-z-]{10,56})$"
#: The same, and keys of 128, 160 or 256 bits in lower-case hex with a letter and a digit.
KEY_SHAPE = ISSUED_KEY + r"|^(?=.*[0-9])(?=.*[a-f])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
ID_SHAPE = r"^(?=.*[0-9])[A-Za-z0-9][A-Za-z0-9_./:@+-]{4,62}[A-Za-z0-9]$"


def _spans(text: Column, kind: str) -> Column:
    """array<struct<s,e,v>> of one fixed pattern's matches, before their values are checked."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)").alias("out"))

    def step(acc, x):
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["v"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("v")))
    some = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(PATTERNS[kind]), some).otherwise(F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)"))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.reverse(_digits(v))
    at = F.sequence(F.lit(1), F.length(d))
    doubled = F.transform(at, lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(F.transform(doubled, lambda x: F.when(x > 9, x - 9).otherwise(x)), F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(v: Column) -> Column:
    """Every part at most 255, however many digits it is written with."""
    def small(part):
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.concat(F.lit("0"), F.substring(bare, 1, 3)).cast("int") <= 255)

    return F.forall(F.split(v, r"\."), small)


KEEP = {
    "email": lambda v: F.lit(True),
    "ip": _octets,
    "card": lambda v: F.length(_digits(v)).between(13, 19) & _luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def base_spans(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, text, columns in `also`, and `base`: array<struct<kind,s,e,v>> by kind as listed, then start."""
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *also)
    # one look for a digit or an @ spares most texts all four patterns
    d = d.withColumn("maybe", F.col("text").rlike("[0-9@]"))
    for kind in PATTERNS:
        has = F.col("maybe") & (F.instr("text", NEEDS[kind]) > 0) if NEEDS[kind] else F.col("maybe")
        d = d.withColumn(f"raw_{kind}", F.when(has, _spans(F.col("text"), kind)).otherwise(F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)")))
    kept = [_checked(kind) for kind in PATTERNS]
    return d.select("doc_id", "text", *also, F.concat(*kept).alias("base"))


def _checked(kind: str) -> Column:
    passing = F.filter(F.col(f"raw_{kind}"), lambda x: KEEP[kind](x["v"]))
    return F.transform(passing, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _lines(found: DataFrame) -> DataFrame:
    """The lines that may hold a span or an identifier, with their place in the text and their base spans."""
    lines = found.where(F.col("text").rlike("[0-9@]")).select(
        "doc_id", "text_hash", "base", F.split("text", "\n").alias("lines"))
    starts = F.expr("transform(lines, (l, i) -> struct(l AS line, i AS i))")
    one = lines.select("doc_id", "text_hash", "base", "lines", F.explode(F.filter(starts, lambda x: x["line"].rlike("[0-9@]"))).alias("x"))
    one = one.select("doc_id", "text_hash", "base", F.col("x.line").alias("line"),
                     F.expr("aggregate(slice(lines, 1, x.i), 0, (a, l) -> a + length(l) + 1)").alias("at"))
    return one.withColumn("base", F.expr("filter(base, b -> b.s >= at AND b.s < at + length(line))"))


#: The patterns of word i of w: the two words before it, with a space between them, and a label without one.
BEFORE = """filter(array(lower(concat_ws(' ', CASE WHEN i > 1 THEN w[i - 2] ELSE '^' END, CASE WHEN i > 0 THEN w[i - 1] ELSE '^' END)),
    CASE WHEN i > 0 AND w[i - 1] rlike '[A-Za-z].*[:=#]$' THEN lower(w[i - 1]) END), p -> p IS NOT NULL)"""


def _entities(lines: DataFrame) -> DataFrame:
    """Each base span with the patterns before its start; of those that overlap, the one that starts first."""
    own = F.expr("filter(base, b -> NOT exists(base, x -> x.s < b.s AND x.e > b.s))")
    cut = lines.select("doc_id", "text_hash", "line", "at", F.explode(own).alias("b"))
    cut = cut.withColumn("w", F.split(F.expr("substring(line, 1, b.s - at)"), " ", -1)).withColumn("i", F.size("w") - 1)
    return cut.select("doc_id", "text_hash", F.col("b.v").alias("v"), F.expr(BEFORE).alias("patterns"), F.col("b.s").alias("s"), F.col("b.e").alias("e"),
                      F.lit(True).alias("seed"), F.lit(True).alias("base"))


def _words(lines: DataFrame) -> DataFrame:
    """Each identifier-like word of the lines outside base spans, with its span in the text and its patterns."""
    cut = lines.withColumn("w", F.split("line", " ", -1))
    cut = cut.withColumn("i", F.explode(F.expr("filter(sequence(0, size(w) - 1), i -> w[i] rlike '[0-9]')")))
    bare = F.regexp_replace(F.expr("w[i]"), r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    cut = cut.select("doc_id", "text_hash", "base", bare.alias("v"),
                     F.expr("at + length(array_join(slice(w, 1, i), ' ')) + (CASE WHEN i > 0 THEN 1 ELSE 0 END)").alias("s0"),
                     F.expr("w[i]").alias("whole"), F.expr(BEFORE).alias("patterns"))
    cut = cut.where(F.col("v").rlike(ID_SHAPE))
    s = F.col("s0") + F.expr("locate(v, whole) - 1")
    # digits of a key may look like a card
    free = ~F.exists("base", lambda b: (b["s"] < s + F.length("v")) & (b["e"] > s)) | F.col("v").rlike(KEY_SHAPE)
    return cut.where(free).select("doc_id", "text_hash", "v", "patterns", s.alias("s"), (s + F.length("v")).alias("e"),
                                  F.col("v").rlike(KEY_SHAPE).alias("seed"), F.lit(False).alias("base"))


def _plain(lines: DataFrame) -> DataFrame:
    """Each pattern with the number of different words without a digit or @ that follow it in the lines."""
    cut = lines.select(F.split("line", " ", -1).alias("w"))
    follow = F.expr("transform(filter(sequence(0, size(w) - 1), i -> w[i] <> '' AND NOT w[i] rlike '[0-9@]'), "
                    f"i -> struct(xxhash64(w[i]) AS v, {BEFORE} AS patterns))")
    pairs = cut.select(F.explode(follow).alias("x")).select("x.v", F.explode("x.patterns").alias("pattern"))
    return pairs.distinct().groupBy("pattern").agg(F.count("*").alias("others"))


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, text_hash, s, e of words outside base spans that confident patterns and instances mark."""
    lines = _lines(found)
    words = _words(lines).unionByName(_entities(lines)).withColumn("pattern", F.explode("patterns")).drop("patterns")
    seen = materialise(words.dropDuplicates(["doc_id", "text_hash", "s", "e", "pattern"]))
    known = seen.where("seed").select("v").distinct()
    graph = seen.groupBy("pattern", "v").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    support = seen.select("pattern", "doc_id").distinct().groupBy("pattern").agg(F.count("doc_id").alias("docs")).where(F.col("docs") >= MIN_DOCS).select("pattern")
    supported = materialise(support.join(_plain(lines), "pattern", "left").fillna(0, ["others"]))
    edges = materialise(graph.join(supported, "pattern"))
    for _ in range(rounds):
        marked = edges.join(known.withColumn("known", F.lit(1)), "v", "left")
        trusted = marked.groupBy("pattern").agg((F.sum(F.coalesce("known", F.lit(0))) / (F.count("*") + F.max("others") + F.lit(PRIOR))).alias("confidence")) \
            .where(F.col("confidence") >= MIN_CONFIDENCE)
        doubt = edges.join(trusted, "pattern").groupBy("v").agg(F.sum(F.log(F.lit(1.0001) - F.col("confidence"))).alias("doubt"))
        found_now = doubt.where(F.lit(1.0) - F.exp("doubt") >= MIN_CONFIDENCE).select("v")
        known = materialise(known.unionByName(found_now).distinct())
    good = edges.join(trusted.select("pattern"), "pattern").select("pattern", "v").join(known, "v")
    inside = seen.where(~F.col("base"))
    marked = inside.join(good, ["pattern", "v"]).unionByName(inside.where(F.col("v").rlike(ISSUED_KEY)))
    return marked.select("doc_id", "text_hash", "s", "e").distinct()


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, text_hash, n_email, n_ip, n_card, n_phone, n_id, base_sha256, spans (text), span_list."""
    found = base_spans(docs).withColumn("text_hash", F.xxhash64("text"))
    extra = bootstrap(found, rounds).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("ids"))
    base = found.select("doc_id", "text_hash", "base", *map(_count, PATTERNS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"))
    left = base.join(extra.withColumnRenamed("doc_id", "d").withColumnRenamed("text_hash", "h"),
                     F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    ids = F.transform(F.coalesce("ids", F.expr("cast(array() as array<struct<s:int,e:int>>)")),
                      lambda x: F.struct(F.lit("id").alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    plain = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    out = left.withColumn("span_list", F.concat(plain, ids))
    return out.select("doc_id", "text_hash", *[f"n_{k}" for k in PATTERNS], F.size(F.coalesce("ids", F.expr("cast(array() as array<struct<s:int,e:int>>)"))).cast("long").alias("n_id"),
                      "base_sha256", joined(F.col("span_list")).alias("spans"), "span_list")


def redact(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """`docs` with each personal span of `text` replaced by its kind in brackets; a null text stays null.

    Overlapping spans are replaced as one, under the kind of the first.  `n_chars`, where it is a
    column, follows the new text; all other columns stay.
    """
    found = base_spans(docs.select("doc_id", "text")).withColumn("text_hash", F.xxhash64("text"))
    extra = bootstrap(found, rounds).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("s", "e")).alias("ids")) \
        .select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "ids")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    spanned = base_spans(row, "row").withColumn("text_hash", F.xxhash64("text")).join(
        extra, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left")
    ids = F.transform(F.coalesce("ids", F.expr("cast(array() as array<struct<s:int,e:int>>)")),
                      lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("ID").alias("kind")))
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.upper(x["kind"]).alias("kind")))
    spanned = spanned.withColumn("spans", F.sort_array(F.concat(base, ids)))

    def step(acc, x):
        fresh = x["s"] >= acc["at"]
        before = F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], before, F.lit("["), x["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.aggregate(
        "spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))))
    done = spanned.select("row", F.when(F.col("row.text").isNotNull(), clean).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("clean").isNotNull(), F.length("clean")).cast("long")}
    return done.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
