"""What the operators on set-valued records share: feature sets, classes of equal sets, and exact verification.

Features are held as 64-bit hashes. A pair's counts are those of its features unless two of the few features in that one pair
collide (odds of about 1e-16 a pair, whatever the corpus); classes of equal sets carry 128 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.lineage import cut


def word_runs(text: Column) -> Column:
    """The maximal runs of a-z and 0-9 in the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def hashed_runs(words: Column, n: int) -> Column:
    """The distinct runs of ``n`` consecutive words, hashed, in order of the hashes."""
    if n == 1:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
    else:
        # n shifted slices side by side: looking each word up within a lambda would read the text anew for every run
        many = F.greatest(F.size(words) - n + 1, F.lit(0))
        shifted = F.arrays_zip(*(F.slice(words, k + 1, many).alias(f"w{k}") for k in range(n)))
        hashes = F.transform(shifted, lambda r: F.xxhash64(*(r[f"w{k}"] for k in range(n))))
    return F.sort_array(F.array_distinct(hashes))


def classes(records: DataFrame, key: str, text: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Equal sets of word runs become one class: (id, class_id, hashes) and (class_id, key). Records without features leave.

    Texts are read once and never shuffled; both tables are materialised, so the ids stay what they are.
    """
    rows = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), word_runs(F.col(text)).alias("words")).select("key", hashed_runs(F.col("words"), n).alias("hashes")).where(F.size("hashes") > 0)
    rows = cut(rows.withColumn("class_id", F.struct(F.xxhash64("hashes").alias("h0"), F.xxhash64(F.lit(n), F.reverse("hashes")).alias("h1"))))
    found = rows.groupBy("class_id").agg(F.first("hashes").alias("hashes"))
    return cut(found.select(F.monotonically_increasing_id().alias("id"), "class_id", "hashes")), rows.select("class_id", "key").distinct()


def verified(candidates: DataFrame, sets: DataFrame, a: str, b: str, num: int, den: int) -> DataFrame:
    """(a, b, ca, cb) of those pairs with den * common >= num * all, counted on the full sets; ca and cb are their classes."""
    left = sets.select(F.col("id").alias(a), F.col("hashes").alias("_fa"), F.col("class_id").alias("ca"))
    right = sets.select(F.col("id").alias(b), F.col("hashes").alias("_fb"), F.col("class_id").alias("cb"))
    return (
        candidates.join(left, a)
        .join(right, b)
        .withColumn("_common", F.size(F.array_intersect("_fa", "_fb")))
        .where(F.col("_common") * den >= num * (F.size("_fa") + F.size("_fb") - F.col("_common")))
        .select(a, b, "ca", "cb")
    )


def expand(pairs: DataFrame, members: DataFrame, *shared: str) -> DataFrame:
    """(key_a, key_b), smaller first: every pair of different keys within a class or across a pair of classes (ca, cb).

    ``members`` has class_id, key and, where given, values that the two must share.
    """
    left = members.select(F.col("class_id").alias("ca"), F.col("key").alias("x"), *shared)
    right = members.select(F.col("class_id").alias("cb"), F.col("key").alias("y"), *shared)
    across = pairs.select("ca", "cb").join(left, "ca").join(right, ["cb", *shared]).select("x", "y")
    within = left.withColumnRenamed("ca", "cb").join(right, ["cb", *shared]).where("x < y").select("x", "y")
    both = within.unionByName(across).where("x <> y")
    return both.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()
