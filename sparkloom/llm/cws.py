"""Document fingerprints by consistent weighted sampling.

Terms are a text's lower-cased words between white space, weights their counts. For each of ``SAMPLES`` positions
every term draws r and c from Gamma(2, 1) and b from the uniform distribution, all three fixed by a hash of the term and
the position (Ioffe 2010): t = floor(ln w / r + b), and the term with the least ln c - r (t + 1 - b) is the sample
(term, t). Two texts agree in a position with a probability equal to their generalised Jaccard similarity, the sum of least
weights over the sum of greatest.

DataFrame functions only. A Gamma(2, 1) draw is the sum of two exponential draws. Value and sample are packed in one long, so a signature is a set of minimum aggregates; texts are
dealt once, by ranges of ids, and all later steps keep that partitioning.

Defined cases: a null text is empty; a text without terms has an all-zero fingerprint and likeness 1 to another such
text; the next document is the one with the next smaller id (null ids last, equal ids in order of their texts), after the
last the first; a single document is its own next; repeated rows are kept; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 64
#: Samples of one row of generated code; twice as many make a method that the JVM does not compile.
AT_ONCE = 4
#: Bits of a sample that stand in the fingerprint: two samples are mistaken for equal once in 65,536.
SAMPLE_BITS = 16
#: Ranges of ids at most; their first rows are read by the driver (ids alone).
RANGES = 4096
#: -ln(1 - v / 2) / v for v from 0 to 1 as a polynomial, highest power first; its relative error is below 2e-6.
_LOG = np.polynomial.Chebyshev.interpolate(lambda v: -np.log1p(-v / 2) / v, 6, [0, 1]).convert(kind=np.polynomial.Polynomial).coef[::-1]


def coins(x: str, places: int, width: int) -> list:
    """(halvings, v, v) from the lowest ``places + 2 * width`` bits of a long, for ``gamma``.

    The zeros below the second one of ``places`` fair bits, as two ones above the field end a run of zeros; two uniform numbers from 0 to 1.
    """
    bits = F.col(x).bitwiseAND(F.lit((1 << places) - 1)).bitwiseOR(F.lit(3 << places))
    second = bits.bitwiseAND(bits - F.lit(1))
    halvings = F.bit_count((second - F.lit(1)).bitwiseAND(F.bitwise_not(second))) - F.lit(1)
    parts = [F.shiftrightunsigned(x, s).bitwiseAND(F.lit((1 << width) - 1)) for s in (places, places + width)]
    return [halvings.cast("double"), *[(v.cast("double") + F.lit(0.5)) * F.lit(1 / (1 << width)) for v in parts]]


def gamma(halvings: str, *parts: str):
    """A Gamma(2, 1) draw: the sum of two exponential draws -ln(u).

    Each u is a number 1 - v / 2, halved as often as a fair coin falls on one side before the other; a polynomial gives the logarithm of the
    number, for Spark's own is a call out of generated code.
    """
    total = F.col(halvings) * F.lit(math.log(2))
    for v in map(F.col, parts):
        log = F.lit(float(_LOG[0]))
        for c in _LOG[1:]:
            log = log * v + F.lit(float(c))
        total = total + log * v
    return total


def signatures(terms: DataFrame, keys: list[str], kinds: int) -> DataFrame:
    """(keys, sig_0, sig_1, ... array<long>) of (keys, kind int, term): the signatures of ``kinds`` texts of each key.

    One row for each occurrence; no exchange if the rows of a key lie together. A term that several texts of a key share
    is drawn for once, only its weights differ. A row with a null term stands for a text without terms; its signature
    is all zeros. A row of kind -1 is a note on its key, at most one with white space in it: it goes with the terms, so that the many rows
    between need no more columns, and comes back as ``note``. The samples are taken in sets of ``AT_ONCE // kinds`` and each draw is a column of its own projection:
    generated code that is short enough for the JVM to compile, with one logarithm a draw.
    """
    step = max(1, AT_ONCE // kinds)
    each, texts = range(step), range(kinds)
    counted = terms.groupBy(*keys, "term").agg(*[F.count_if(F.col("kind") == k).alias(f"w{k}") for k in (*texts, -1)])
    # a text without the term (and the null term, which xxhash64 would pass over) has no logarithm, no sample and no part in the minimum
    weights = [F.when(F.col("term").isNotNull() & (F.col(f"w{k}") > 0), F.ln(f"w{k}")).alias(f"lw{k}") for k in texts]
    hashed = counted.select(*keys, F.when(F.col("w-1") > 0, F.col("term")).alias("note"), F.when(F.col("term").isNotNull(), F.xxhash64("term")).alias("h"), *weights)
    kept = [*keys, "note", "h", *[f"lw{k}" for k in texts], "first"]
    firsts = F.when(F.col("note").isNull(), F.array(*[F.lit(i) for i in range(0, SAMPLES, step)])).otherwise(F.array(F.lit(-1)))
    sets = hashed.select(*kept[:-1], F.explode(firsts).alias("first"))

    x = sets.select(*kept, *[c for j in each for c in (F.xxhash64("h", F.col("first") + F.lit(j)).alias(f"x{j}"), F.xxhash64("h", F.col("first") + F.lit(SAMPLES + j)).alias(f"y{j}"))])
    named = lambda of, j: [f"{of}{j}_{i}" for i in range(3)]
    uniform = (F.shiftrightunsigned(f"x{j}", 52).cast("double") * F.lit(1 / 4096) for j in each)
    tossed = x.select(*kept, *[c.alias(n) for j in each for of, bits in (("x", (16, 12)), ("y", (20, 22))) for c, n in zip(coins(f"{of}{j}", *bits), named(of, j))], *[c.alias(f"b{j}") for j, c in zip(each, uniform)])
    drawn = tossed.select(*kept, *[c for j in each for c in (gamma(*named("x", j)).alias(f"r{j}"), F.ln(gamma(*named("y", j))).alias(f"c{j}"), f"b{j}")])
    timed = drawn.select(*keys, "note", "h", "first", *[c for j in each for c in (f"r{j}", f"c{j}", f"b{j}", *[F.floor(F.col(f"lw{k}") / F.col(f"r{j}") + F.col(f"b{j}")).alias(f"t{j}_{k}") for k in texts])])

    def packed(j: int, k: int):
        value = F.col(f"c{j}") - F.col(f"r{j}") * (F.col(f"t{j}_{k}").cast("double") + F.lit(1.0) - F.col(f"b{j}"))
        # a positive fixed-point number, then the sample's name: bits of the term's hash, which no draw uses, and the step
        name = F.shiftrightunsigned("h", 40).bitwiseXOR(F.col(f"t{j}_{k}").bitwiseAND(F.lit((1 << 24) - 1)))
        return F.shiftleft(((value + F.lit(2048.0)) * F.lit(float(1 << 26))).cast("long"), 24).bitwiseOR(name)

    mins = timed.groupBy(*keys, "first", "note").agg(*[F.min(packed(j, k)).alias(f"m{j}_{k}") for k in texts for j in each])
    low = F.lit((1 << SAMPLE_BITS) - 1)
    part = [F.array(*[F.coalesce(F.col(f"m{j}_{k}").bitwiseAND(low), F.lit(0).cast("long")) for j in each]).alias(f"p{k}") for k in texts]
    parts = mins.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("first", "note", *part))).alias("parts"))
    none = F.array_repeat(F.lit(0).cast("long"), SAMPLES)
    drawn_for = F.filter("parts", lambda x: x["first"] >= 0)
    note = F.get(F.filter("parts", lambda x: x["first"] < 0), F.lit(0))["note"].alias("note")
    return parts.select(*keys, note, *[F.when(F.size(drawn_for) > 0, F.flatten(drawn_for[f"p{k}"])).otherwise(none).alias(f"sig_{k}") for k in texts])


def signature(terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sig array<long>) of (keys, term): one text of each key, see ``signatures``."""
    return signatures(terms.withColumn("kind", F.lit(0)), keys, 1).withColumnRenamed("sig_0", "sig").drop("note")


def likeness(a: str, b: str):
    """Share of positions in which two signatures agree."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return same.cast("double") / F.lit(float(SAMPLES))


def as_hex(sig: str):
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), SAMPLE_BITS // 4, "0"))), "")


#: The white space that parts words.
WHITE = " \t\n\x0b\f\r"


def words_of(text: str):
    """The parts of a text between single white-space characters, empty ones among them; a plain split is far cheaper than a pattern."""
    return F.split(F.translate(F.lower(F.col(text)), WHITE, " " * len(WHITE)), " ")


def terms_of(text: str):
    """The words of a text; one null if there is none."""
    return F.explode_outer(F.filter(words_of(text), lambda w: w != ""))


def in_descending_order(docs: DataFrame) -> DataFrame:
    """(part, lead_row, doc_id, text): rows dealt by ranges of ids, highest first, each range ending with a copy of the
    first row of the next one (lead_row false), the last with that of the first."""
    spark = docs.sparkSession
    parts = min(RANGES, max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) * 16))
    # descending order as an ascending one, null ids last; the complement, for the negative of the least long is none
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    at = [i / parts for i in range(1, parts)]
    bounds = docs.agg(F.percentile_approx(order, at, parts * 20).alias("p")).first()["p"] or []
    bounds = sorted(set(bounds))
    lows = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    part = F.lit(len(bounds)) - F.size(F.filter(lows, lambda b: b < order))
    placed = docs.select(part.alias("part"), "doc_id", "text")
    # the first row of each range, by id and then by a digest of its text: as many rows as ranges
    heads = placed.groupBy("part").agg(F.min(F.struct(F.bitwise_not(order).alias("o"), F.xxhash64("text").alias("x"))).alias("first")).orderBy("part").collect()
    first = [r["part"] for r in heads]
    before = {p: first[i - 1] for i, p in enumerate(first)}
    # a range's head is copied to the range before it, the first range's to the last
    head = F.create_map(*[F.lit(x) for r in heads for x in (r["part"], before[r["part"]])]) if heads else F.lit(None).cast("map<int,int>")
    mark = F.create_map(*[y for r in heads for y in (F.lit(r["part"]), F.struct(F.lit(r["first"]["o"]).cast("long").alias("o"), F.lit(r["first"]["x"]).cast("long").alias("x")))]) if heads else None
    if mark is None:
        return placed.select("part", F.lit(True).alias("lead_row"), "doc_id", "text")
    is_head = F.struct(F.bitwise_not(order).alias("o"), F.xxhash64("text").alias("x")) == F.try_element_at(mark, F.col("part"))
    copies = F.when(is_head, F.array(F.struct(F.col("part"), F.lit(True).alias("lead_row")), F.struct(F.try_element_at(head, F.col("part")).alias("part"), F.lit(False).alias("lead_row")))).otherwise(F.array(F.struct(F.col("part"), F.lit(True).alias("lead_row"))))
    return placed.select(F.explode(copies).alias("c"), "doc_id", "text").select("c.part", "c.lead_row", "doc_id", "text")


def fingerprint_with_next(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last floor(n_chars / 2) code points replaced by as many (or all) of the next document's first.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # partitions small enough that the words of one fit in memory without a spill
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) * 8)
    dealt = in_descending_order(docs).repartition(parts, "part")
    # the copies stand last in their range whatever their id
    line = Window.partitionBy("part").orderBy(F.desc("lead_row"), F.desc_nulls_last("doc_id"), "tie")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = dealt.withColumn("tie", F.xxhash64("text")).withColumns({"nth": F.row_number().over(line), "next_text": F.lead("text").over(line)})
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    # the digest is taken before the words are spread, or it would be taken for each word
    sha = F.when(F.col("lead_row"), F.sha2(F.col("edited").cast("binary"), 256)).otherwise(F.lit(""))
    note = F.concat_ws(" ", F.col("lead_row").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), n.cast("string"), sha)
    own, other = (F.struct(F.lit(k).alias("kind"), F.col(body).alias("body")) for k, body in enumerate(("text", "edited")))
    about = F.struct(F.lit(-1).alias("kind"), F.col("note").alias("body"))
    bodies = F.when(F.col("lead_row"), F.array(own, other, about)).otherwise(F.array(own, about))
    keys = ["part", "nth"]
    made = rows.select(*keys, "lead_row", "doc_id", "text", edited.alias("edited")).withColumn("note", note)
    both = made.select(*keys, F.explode(bodies).alias("b"))
    # the note stands for the texts without words
    words = F.explode(F.when(F.col("b.kind") >= 0, words_of("b.body")).otherwise(F.array("b.body")))
    signed = signatures(both.select(*keys, "b.kind", words.alias("term")).where("term <> ''"), keys, 2)
    about = F.split("note", " ")
    pair = signed.select(
        *keys, (about[0] == "true").alias("lead_row"), F.expr("nullif(split(note, ' ')[1], '')").cast("long").alias("doc_id"), about[2].cast("long").alias("n_chars"), about[3].alias("edited_sha256"), F.col("sig_0").alias("sig"), F.col("sig_1").alias("edited")
    )
    ahead = pair.withColumn("next_sig", F.lead("sig").over(Window.partitionBy("part").orderBy("nth"))).where("lead_row")
    return ahead.select(
        F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", as_hex("sig").alias("fingerprint"), as_hex("edited").alias("edited_fingerprint"), likeness("sig", "edited").alias("near_edited"), likeness("sig", "next_sig").alias("near_next")
    )
