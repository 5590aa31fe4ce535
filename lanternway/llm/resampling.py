"""Target-distribution importance resampling: rows that look like a target are drawn more often.

Position tables: words are exploded with their places; for order n, ``lead()`` per document brings the n - 1
words that follow, and a run of n words is a feature. A feature's bucket is a hash of it. Over all documents
and all target texts the features of each bucket are counted, which gives the bucket's *gain*, a smoothed log
ratio; a document weighs the sum of the gains of its features. Added noise of a Gumbel distribution, taken
from a hash of the id, turns the highest scores into a weighted draw without replacement.

All of it is DataFrame code. Counts are combined before the shuffle: by bucket for the gains, by row for the
weights, so no word travels for order 1; a higher order shuffles the words of a row once, for ``lead()``.
Gains are a table of `buckets` rows, which bounds the broadcast. Ranks come from one range partitioning and
the number of rows before each range, so no task sees all scores; rows of equal score and id are told apart
by their place, so they do not meet in one task either.

Defined results: null text has no words; documents without features weigh 0; a null id hashes as the empty
string and comes first among equal scores; rows that share an id each count. Without target texts all gains
follow the documents alone. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternway.llm.common import pick, written

ORDERS, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
#: What parts words, fixed: ASCII other than digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def features(rows: DataFrame, orders: int = ORDERS) -> DataFrame:
    """`rows` (``row, text`` and others) without the text, a row per feature: all runs of 1 to `orders` words.

    Also ``n_words``. A document without words keeps one row, whose feature is null.
    """
    others = [c for c in rows.columns if c != "text"]
    listed = rows.select(*others, words(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    placed = listed.select(*others, "n_words", F.posexplode_outer("words").alias("place", "word"))
    if orders == 1:
        return placed.select(*others, "n_words", F.col("word").alias("feature"))
    following = Window.partitionBy("row").orderBy("place")
    ahead = placed.select("*", *[F.lead("word", k).over(following).alias(f"word{k}") for k in range(1, orders)])
    runs, joined = [F.col("word")], F.col("word")
    for k in range(1, orders):
        joined = F.concat(joined, F.lit(" "), F.col(f"word{k}"))  # null where a word is missing
        runs.append(joined)
    each = ahead.select(*others, "n_words", F.filter(F.array(*runs), lambda f: f.isNotNull()).alias("runs"))
    return each.select(*others, "n_words", F.explode_outer("runs").alias("feature"))


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return F.crc32(feature) % buckets


def counted(rows: DataFrame, orders: int, buckets: int, into: str) -> DataFrame:
    """Features per bucket over all rows."""
    found = features(rows, orders).where(F.col("feature").isNotNull())
    return found.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias(into))


def gains(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` of all buckets: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets))))."""
    own, want = counted(docs, orders, buckets, "s"), counted(target, orders, buckets, "t")
    both = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(own, "bucket", "left").join(want, "bucket", "left").fillna(0, ["s", "t"])
    both = written(both, "bucket-counts")
    whole = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = ((d("t") + 1) * (d("all_s") + buckets)) / ((d("s") + 1) * (d("all_t") + buckets))
    return both.crossJoin(F.broadcast(whole)).select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain"))  # one row beside each


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, by the first 32 bits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """One row per document: ``doc_id, n_features, weight, score, rank`` (null: not drawn).

    Of the documents with `least_words` words the `percent` hundredths of highest score are drawn.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())
    aims = pick(target, text=target_col).withColumn("row", F.monotonically_increasing_id())
    table = F.broadcast(gains(rows.drop("doc_id"), aims, orders, buckets))
    each = features(rows, orders).withColumn("bucket", bucket(F.col("feature"), buckets)).join(table, "bucket", "left")
    weighed = each.groupBy("row", "doc_id", "n_words").agg(F.count("feature").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    scored = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("able"), "row")
    placed = in_order(scored, F.desc("able"), F.desc("score"), F.asc("doc_id"), F.asc("row"))
    able = placed.where("able").count()
    drawn = F.col("able") & (F.col("place") <= percent * able // 100)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("place")).alias("rank"))


def in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """`rows`, written, with ``place`` (from 1) in the whole table's order.

    A range partitioning gives each task one stretch; places within it are numbered as the table is written,
    and rows before a stretch are a table of one row per task.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    kept = written(sorted_, "in-order")
    task = F.shiftright("at", 33)
    sizes = kept.groupBy(task.alias("task")).agg(F.count("*").alias("n"))
    before = sizes.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    return kept.withColumn("task", task).join(F.broadcast(before), "task").select(*rows.columns, (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("place"))
