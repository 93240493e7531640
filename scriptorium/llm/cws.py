"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text's terms are its lower-case words between spaces, tabs, line breaks and form feeds; a term's weight w is its
count. For sample j a hash of the term gives r and c, both Gamma(2, 1), and b, uniform
on [0, 1): t = floor(ln w / r + b), and the term's value is a = c exp(-r (t - b + 1)). The
sample is the term of least value with its t. Two texts agree in a sample with a
probability equal to the generalised Jaccard similarity of their weights.

The numbers are drawn by their parts. A Gamma(2, 1) value times an independent uniform one
and the rest of it are independent exponential values: c = x + y and r = s + q with
s = r b, and x = c exp(-q) gives q = ln(1 + y / x). So three exponential values x, y, s make
r, c and b, t = floor((ln w + s) / r) and a = x exp(-r t). A term that occurs once has t = 0
and a = x, which is least where a hash is least: it needs no logarithm. t is more than 0
only where y <= (w - 1) x. A sample is kept as one 64-bit integer, 1 - exp(-a) in 32 bits
above 32 bits that identify term and t, so a minimum of integers finds it. In a text of n
words, about n in 2**32 samples have two terms of equal value; the lower 32 bits decide.

Each document is compared with the next in descending order of id and with its edited
text, whose second half is the start of that next document. The documents are dealt to
ranges of ids of about ``RANGE`` rows; each range also gets a copy of the first document
of the range below (the lowest gets that of the highest), so windows within ranges see
each next document. After this one shuffle of the texts, terms are counted and sampled
within the partitions.

Defined results. A null or empty text has no terms and a fingerprint of zeros; it is
like another text without terms (1.0) and unlike any other (0.0). Equal texts have
equal fingerprints. Null ids come last in the order (the least 64-bit
integer stands for them, so it is no id). Rows that repeat an id are each
given a row, ordered by text. A single document is its own next document. An empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scriptorium.plans.workspace import Workspace

#: Samples of a fingerprint, and those that one row of a term takes part in.
SAMPLES, LANE = 64, 4
#: Rows in a range, about; bounds of ranges on the driver at most; partitions of the texts per configured shuffle partition.
RANGE, BOUNDS, SPLIT = 256, 512, 4
NULL_KEY = -(2**63)
#: The bits of a sample that identify its term and t; those above are its value.
MARK = 2**32 - 1


def _uniform(h: Column, shift: int) -> Column:
    """A number between 0 and 1 from 32 bits of a hash."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(MARK).cast("double") + 0.5) * 2.0**-32


def _least(h: Column) -> Column:
    """A number between 0 and 1 from the upper 32 bits of a hash, in the order of signed hashes."""
    return (F.shiftright(h, 32).cast("double") + (2.0**31 + 0.5)) * 2.0**-32


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    k = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY))
    return docs.select(k.alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _bucket(k: Column, bounds: list[int], parts: int) -> Column:
    """Number of the range of a key: its bin among the bounds, and its part of the bin."""
    b = F.array(*(F.lit(int(x)) for x in bounds))
    bin_ = F.size(F.filter(b, lambda x: x <= k))
    low, high = F.get(b, bin_ - 1).cast("double"), F.get(b, bin_).cast("double")
    part = F.when((bin_ > 0) & (bin_ < len(bounds)) & (high > low), F.floor((k.cast("double") - low) / (high - low) * parts)).otherwise(F.lit(0))
    return bin_.cast("long") * 2**31 + part.cast("long")


def with_next(ws: Workspace, docs: DataFrame, id_col: str, text_col: str, rows: int = RANGE) -> DataFrame:
    """(bucket, rn, ghost, k, text, next): k is the id or NULL_KEY; ghosts are the copies at the ends of ranges, to be left out."""
    keyed = _keyed(docs, id_col, text_col)
    n = docs.count()
    bins = max(1, min(BOUNDS, math.ceil(n / rows)))
    quantiles = keyed.agg(F.percentile_approx("k", [i / bins for i in range(1, bins)] or [0.5], 10000)).first()[0] or [0]
    bounds = sorted(set(quantiles))
    # never null, so that a join adds no filter to one of the branches that share the shuffle
    d = keyed.withColumn("bucket", F.coalesce(_bucket(F.col("k"), bounds, max(1, math.ceil(n / rows / bins))), F.lit(0)))
    # one row per range, ids only: the range below is in the same bin, or the last one of the bin below
    heads = d.groupBy("bucket").agg(F.max("k").alias("k")).withColumn("bin", F.floor(F.col("bucket") / 2**31))
    tops = heads.groupBy("bin").agg(F.max("k").alias("top"))  # a row per bin, BOUNDS + 1 at most
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select("bin", F.coalesce(F.lag("top").over(Window.orderBy("bin")), F.max("top").over(every)).alias("before"))
    heads = heads.withColumn("below", F.lag("k").over(Window.partitionBy("bin").orderBy("bucket"))).join(tops, "bin")
    heads = ws.save(heads.select(F.col("bucket").alias("into"), F.coalesce("below", "before").alias("k")), "heads")
    ghosts = d.join(heads, "k").select(F.coalesce("into", F.lit(0)).alias("bucket"), F.lit(True).alias("ghost"), "k", "text")
    parts = SPLIT * int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    x = d.select("bucket", F.lit(False).alias("ghost"), "k", "text").union(ghosts).repartition(parts, "bucket")
    w = Window.partitionBy("bucket").orderBy("ghost", F.desc("k"), "text")
    return x.select("bucket", "ghost", "k", "text", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("next"))


def _edited(text: Column, after: Column) -> Column:
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(F.coalesce(after, F.lit("")), F.lit(1), half))


def terms(text: Column) -> Column:
    return F.split(F.translate(F.lower(text), "\n\t\r\f", "    "), " ")


def samples(counted: DataFrame, keys: list[str], weights: dict[str, str], k: int = SAMPLES) -> DataFrame:
    """counted: (keys, term long, a count, so a whole number, per weight column). One row per keys: for each name in weights an array of k samples (null without terms).

    The term's random numbers are drawn once for all weight columns, and those of t only where t can be more
    than 0. Each term is taken once for each ``LANE`` samples: aggregates of more columns make code that the JVM
    leaves interpreted.
    """
    lanes = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(k / LANE) - 1))).alias("lane")
    x = counted.select(*keys, "term", *(F.col(w).alias(f"w_{name}") for name, w in weights.items()), F.greatest(*weights.values(), F.lit(0)).alias("most"), lanes)
    of = lambda f: {f"{v}{i}": e for i in range(LANE) for v, e in f(i, F.col("lane") * LANE + i).items()}
    x = x.withColumns(of(lambda i, j: {"h": F.xxhash64("term", j), "g": F.when(F.col("most") > 1, F.xxhash64("term", -1 - j))}))
    x = x.withColumns(of(lambda i, j: {"x": F.when(F.col("most") > 1, -F.log1p(-_least(F.col(f"h{i}")))), "y": -F.log(_uniform(F.col(f"g{i}"), 0))}))
    x = x.withColumns(of(lambda i, j: {"s": F.when(F.col(f"y{i}") <= (F.col("most") - 1) * F.col(f"x{i}"), -F.log(_uniform(F.col(f"g{i}"), 32)))}))
    x = x.withColumns(of(lambda i, j: {"r": F.col(f"s{i}") + F.log1p(F.col(f"y{i}") / F.col(f"x{i}"))}))
    for name in weights:
        w = F.col(f"w_{name}")
        x = x.withColumns(of(lambda i, j, w=w, name=name: {f"t_{name}": F.when((w > 1) & F.col(f"r{i}").isNotNull(), F.floor((F.log(w.cast("double")) + F.col(f"s{i}")) / F.col(f"r{i}")))}))
    aggs = []
    for name in weights:
        for i in range(LANE):
            t = F.col(f"t_{name}{i}")
            once = F.col(f"h{i}").bitwiseAND(~MARK).bitwiseOR(F.col("term").bitwiseAND(MARK))
            value = F.floor(-F.expm1(-F.col(f"x{i}") * F.exp(-F.col(f"r{i}") * t)) * 2.0**32) - 2**31
            # an odd factor: a term's values of t have different marks
            mark = F.col("term").bitwiseXOR(t.bitwiseAND(2**31 - 1) * F.lit(0x9E3779B1)).bitwiseAND(MARK)
            more = F.shiftleft(value, 32).bitwiseOR(mark)
            aggs.append(F.min(F.when(F.col(f"w_{name}") > 0, F.when(t > 0, more).otherwise(once))).alias(f"{name}{i}"))
    each = x.groupBy(*keys, "lane").agg(*aggs)
    parts = F.struct("lane", *(F.array(*(F.col(f"{name}{i}") for i in range(LANE))).alias(name) for name in weights))
    out = each.groupBy(*keys).agg(F.array_sort(F.collect_list(parts)).alias("s"))
    return out.select(*keys, *(F.when(F.get(F.get(f"s.{name}", F.lit(0)), F.lit(0)).isNotNull(), F.slice(F.flatten(f"s.{name}"), 1, k)).alias(name) for name in weights))


def likeness(a: Column, b: Column, k: int = SAMPLES) -> Column:
    """The share of equal samples; 1.0 for two texts without terms, 0.0 for one."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(k))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def hexed(sample: Column, k: int = SAMPLES) -> Column:
    """The fingerprint as text: 8 hexadecimal digits per sample."""
    return F.coalesce(F.lower(F.array_join(F.transform(sample, lambda x: F.lpad(F.hex(x.bitwiseAND(2**32 - 1)), 8, "0")), "")), F.lit("0" * 8 * k))


def fingerprints(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    ws = Workspace(spark, "cws")
    rows = with_next(ws, docs, id_col, text_col)
    edited = _edited(F.col("text"), F.col("next"))
    # both branches read the same columns of the same shuffle, which so is written once
    about = rows.select("bucket", "rn", "ghost", "k", F.length("text").cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"))
    changed = F.when(~F.col("ghost"), edited)
    both = rows.select("bucket", "rn", F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), changed.alias("t")))).alias("x"))
    words = both.select("bucket", "rn", F.col("x.v").alias("v"), F.explode(terms(F.col("x.t"))).alias("word"))
    words = words.where("word <> ''").select("bucket", "rn", "v", F.xxhash64("word").alias("term"))
    counted = words.groupBy("bucket", "rn", "term").agg(F.sum(F.when(F.col("v") == 0, 1).otherwise(0)).alias("own"), F.sum(F.when(F.col("v") == 1, 1).otherwise(0)).alias("changed"))
    sampled = samples(counted, ["bucket", "rn"], {"a": "own", "e": "changed"}, k)

    x = about.join(sampled, ["bucket", "rn"], "left")
    x = x.withColumn("n", F.lead("a").over(Window.partitionBy("bucket").orderBy("rn")))
    x = x.where(~F.col("ghost"))
    return x.select(F.when(F.col("k") != NULL_KEY, F.col("k")).alias("doc_id"), "n_chars", "edited_sha256", hexed(F.col("a"), k).alias("fingerprint"), hexed(F.col("e"), k).alias("edited_fingerprint"), likeness(F.col("a"), F.col("e"), k).alias("near_edited"), likeness(F.col("a"), F.col("n"), k).alias("near_next"))
