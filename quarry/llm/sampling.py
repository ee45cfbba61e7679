"""Document fingerprints (operator 4): consistent weighted sampling, in DataFrame functions only.

Terms are five-word shingles weighted by how often they occur (texts of one to four words are one term). For
each of SAMPLES coordinates and each term of weight S, hashes give r and c, gamma distributed with
shape 2, and b, uniform on (0, 1). With t = floor(ln S / r + b) the term's value is
c exp(-r (t - b + 1)); the coordinate's sample is the term and t of the smallest value. Two texts
agree in a coordinate with the probability of their generalised Jaccard similarity, the sum of the smaller
weights over the sum of the larger ones.

Hashing and sampling run inside generated code: terms are exploded and each coordinate is a MIN over
one long that has the value's high bits above a hash of (term, t). One wide shuffle puts
neighbours in id order into one partition; the samples themselves are aggregated without another.

Edge cases: null and empty texts and texts without words have the empty fingerprint; two empty
fingerprints have a likeness of 1, an empty and another one 0; equal ids follow each other in the
order of their texts, null ids come first; a single document is its own next one; texts are taken whole, whatever their
length; of equal smallest values the hash of (term, t) decides; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .licenses import SEPARATOR
from .shared import saved, table

SAMPLES, SHINGLE, NAME_BITS = 16, 5, 24


def shingle_hashes(text: Column) -> Column:
    """Sorted hashes of the shingles of a text, one per occurrence; marks at either end of a text count as a word of no letters."""
    words = F.split(F.lower(text), SEPARATOR, -1)
    at = lambda a: F.sequence(F.lit(0), F.greatest(F.size(a) - SHINGLE, F.lit(0)))
    many = lambda a: F.sort_array(F.transform(at(a), lambda i: F.xxhash64(*(F.get(a, i + j) for j in range(SHINGLE)))))
    return F.when(text.rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.transform(F.array(words), many)[0])


def sample(h: Column, log_w: Column, k: int) -> Column:
    """Coordinate k of a term: the high bits of its value above NAME_BITS that name (term, t)."""
    seed = (0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 63)
    x, y = F.xxhash64(h.bitwiseXOR(F.lit(seed))), F.xxhash64(h.bitwiseXOR(F.lit(seed ^ 0x5555555555555555)))
    unit = lambda v, shift: (F.shiftrightunsigned(v, shift).bitwiseAND(F.lit((1 << 21) - 1)) + F.lit(0.5)) * F.lit(2.0**-21)
    r = -F.log(unit(x, 0) * unit(x, 21))
    b = unit(y, 21)
    t = F.when(log_w == 0.0, F.lit(0).cast("long")).otherwise(F.floor(log_w / r + b).cast("long"))
    value = F.log(-F.log(unit(x, 42) * unit(y, 0))) - r * (t - b + F.lit(1.0))  # ln(c) - r (t - b + 1)
    high = ((value + F.lit(1000.0)) * F.lit(float(1 << 28))).cast("long")
    name = F.xxhash64(h, t).bitwiseAND(F.lit((1 << NAME_BITS) - 1))
    return F.shiftleft(high, NAME_BITS).bitwiseOR(name)


def fingerprints(texts: DataFrame, keys: list[str], *, carry: list[str] | None = None, samples: int = SAMPLES) -> DataFrame:
    """(keys, carry, s): the samples of each row's ``text`` as array<bigint>, null without terms. The keys name a row.

    Columns to carry along go through the aggregation as maxima; with numbers it stays a hash aggregation.
    """
    carry = carry or []
    runs = texts.select(*keys, *carry, shingle_hashes(F.col("text")).alias("xs"))
    last = F.coalesce(F.size("xs"), F.lit(1)) - 1
    rows = runs.select(*keys, *carry, "xs", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).alias("i"))
    h = F.get("xs", F.col("i"))
    ends = rows.where(F.col("xs").isNull() | (F.col("i") == F.size("xs") - 1) | (h != F.get("xs", F.col("i") + 1)))  # the last of equal hashes
    weight = F.when((F.col("i") == 0) | (h != F.get("xs", F.col("i") - 1)), F.lit(1).cast("long")).otherwise(F.col("i") + 2 - F.array_position("xs", h))
    weighed = ends.select(*keys, *carry, h.alias("h"), weight.alias("w"))
    log_w = F.when(F.col("w") == 1, F.lit(0.0)).otherwise(F.log(F.col("w").cast("double")))
    ready = weighed.select(*keys, *carry, "h", log_w.alias("log_w"))
    best = ready.groupBy(*keys).agg(*[F.max(c).alias(c) for c in carry], *[F.min(F.when(F.col("h").isNotNull(), sample(F.col("h"), F.col("log_w"), k))).alias(f"s{k}") for k in range(samples)])
    mask = F.lit((1 << NAME_BITS) - 1)
    return best.select(*keys, *carry, F.when(F.col("s0").isNotNull(), F.array(*[F.col(f"s{k}").bitwiseAND(mask) for k in range(samples)])).alias("s"))


def likeness(a: Column, b: Column) -> Column:
    """The share of coordinates in which two fingerprints (array or null) agree."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(same / F.size(a))


def as_text(s: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), NAME_BITS // 4, "0")), ""), F.lit(""))


def in_order(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(part, place, id, text, next_part, next_place, next_text): each row and the next in ascending order of (id, text), cyclic.

    Parts are ranges of ids between approximate quantiles, at most ``parts`` (by default six
    per shuffle partition, so that hashing parts to partitions evens out), and one exchange brings neighbours together. The row after the last of a
    part comes from a table with one row a part.
    """
    parts = parts or 6 * max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    row = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = row.select(F.percentile_approx(F.col("id"), [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.when(F.col("id").isNull(), 0).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("id")))) if cuts else F.lit(0)
    row = row.select(part.alias("part"), "id", "text")
    heads = saved(row.groupBy("part").agg(F.min(F.struct("id", "text"))["text"].alias("head")), "heads")
    ring = Window.orderBy("part")
    order = heads.select("part", F.lead("part").over(ring).alias("next"), F.min("part").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("least"))
    ahead = order.select("part", F.coalesce("next", "least").alias("ahead")).join(heads.select(F.col("part").alias("ahead"), "head"), "ahead")
    w = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), F.col("text"))
    placed = row.select("part", "id", "text", F.row_number().over(w).alias("place"), F.lead("text").over(w).alias("after"))
    joined = placed.join(ahead, "part")
    last = F.col("after").isNull()
    return joined.select(
        "part", "place", "id", "text", F.when(last, F.col("ahead")).otherwise(F.col("part")).alias("next_part"), F.when(last, F.lit(1)).otherwise(F.col("place") + 1).alias("next_place"),
        F.coalesce("after", "head").alias("next_text"),
    )


def with_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and their likenesses; see ``op4_fingerprints``."""
    n, half = F.length("text"), (F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = in_order(docs, id_col=id_col, text_col=text_col).withColumn("edited", edited).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256))
    digest = [F.conv(F.substring("sha", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"d{i}") for i in range(8)]  # as numbers
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), "text"), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("x")
    known = ["id", "n_chars", "next_part", "next_place", *(f"d{i}" for i in range(8))]
    both = rows.select("part", "place", "id", "n_chars", "next_part", "next_place", *digest, sides).select("part", "place", *known, "x.side", "x.text")
    prints = saved(fingerprints(both, ["part", "place", "side"], carry=known, samples=samples), "fingerprints")
    sha = F.concat(*[F.lpad(F.lower(F.hex(f"d{i}")), 8, "0") for i in range(8)])
    own = prints.where("side = 0").select("part", "place", "id", "n_chars", "next_part", "next_place", sha.alias("edited_sha256"), F.col("s").alias("a"))
    other = prints.where("side = 1").select("part", "place", F.col("s").alias("b"))
    following = prints.where("side = 0").select(F.col("part").alias("next_part"), F.col("place").alias("next_place"), F.col("s").alias("c"))
    out = own.join(other, ["part", "place"], "left").join(following, ["next_part", "next_place"], "left")
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_neighbours(table(spark, sf_dir, "documents"))
