"""Exact deduplication by deterministic block naming, in DataFrame operations only.

1. White space of each text is normalised, and its bytes are cut into blocks of fixed
   size. Blocks are dealt by hash into buckets and sorted there: a block's name is its
   bucket and its rank among the bucket's distinct blocks. Equal blocks get equal
   names and different ones different names; nothing rests on a hash.
2. Adjacent names are paired, and the distinct pairs, sorted, get integer names in
   turn, until each text has a single name. Rounds grow with the logarithm of
   the longest text. The round in which a text ends is part of its identity.
3. Rows of one identity are one group.

Text crosses the network once. A block that occurs over ``HOT`` times is dealt out
further, row by row, and its few local names are merged by content afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ordered_names

BLOCK = 1024
#: Occurrences of one block that may meet in one task; blocks of one bucket.
HOT, PER_BUCKET = 20_000, 3_000
#: White space that isn't a lone space already.
_UNEVEN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _UNEVEN, " ")


def _cut(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """A row for each block: row_id, doc_id, n (blocks of the text), no, content, and
    for the first block the text's sha256."""
    # The outer forms of explode keep Spark from working out their input twice (once for a
    # filter on it); neither array is ever empty.
    body = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"),
                       F.explode_outer(F.array(normalised(F.col(text_col)).cast("binary"))).alias("body"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / F.lit(block))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("body"), i * block + 1, F.lit(block)))
    return (body.select("row_id", "doc_id", n.alias("n"), F.sha2("body", 256).alias("sha"),
                        F.posexplode_outer(parts).alias("no", "content"))
            .withColumn("sha", F.when(F.col("no") == 0, F.col("sha"))))


def _name_blocks(cut: DataFrame, hot: int) -> DataFrame:
    """``cut`` with an integer ``name`` in place of ``content``."""
    hashed = cut.withColumn("hash", F.xxhash64("content"))
    counts = materialize(hashed.groupBy("hash").count(), "block-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    buckets = max(1, -(-total // PER_BUCKET))
    often = materialize(counts.where(F.col("count") > hot)
                        .select("hash", F.ceil(F.col("count") / hot).cast("int").alias("salts")), "hot-blocks")
    placed = (hashed.join(often, "hash", "left")
              .withColumn("bucket", F.pmod("hash", F.lit(buckets)))
              .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row_id", "no"), F.col("salts")), F.lit(0)).cast("int")))
    rank = F.dense_rank().over(Window.partitionBy("bucket", "salt").orderBy("content"))
    named = materialize(
        placed.withColumn("rank", rank)
        .select("row_id", "doc_id", "n", "sha", "no", "bucket", "salt", "rank",
                F.when(F.col("salts").isNotNull(), F.col("content")).alias("content")), "block-names")
    # Local names of the salted blocks, a few each, are merged by content.
    local = named.where("content is not null").select("bucket", "salt", "rank", "content").distinct()
    first = F.min(F.struct("salt", "rank")).over(Window.partitionBy("bucket", "content"))
    merged = materialize(local.withColumn("first", first)
                         .select("bucket", "salt", "rank", F.col("first.salt").alias("to_salt"),
                                 F.col("first.rank").alias("to_rank")), "merged-names")
    # (bucket, salt, rank) as one number of three digits in a mixed base.
    top = named.agg(F.max("salt"), F.max("rank")).first()
    salts, ranks = (top[0] or 0) + 1, (top[1] or 0) + 1
    name = ((F.col("bucket") * salts + F.coalesce("to_salt", "salt")) * ranks + F.coalesce("to_rank", "rank"))
    return (named.join(merged, ["bucket", "salt", "rank"], "left")
            .select("row_id", "doc_id", "n", "sha", "no", name.cast("long").alias("name")))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK,
               hot: int = HOT) -> DataFrame:
    """One row per input row: ``row_id`` (unique), ``doc_id``, ``sha`` (sha256 of the
    normalised text), and the identity ``level``, ``name``: equal for rows whose
    normalised texts are equal, and for no others."""
    names = materialize(_name_blocks(_cut(docs, id_col, text_col, block), hot), "names-0")
    heads = names.where("no = 0").select("row_id", "doc_id", "sha")
    longest = names.agg(F.max("n")).first()[0] or 1
    done = names.where("n = 1").select("row_id", F.lit(0).alias("level"), "name")
    level, left = 0, names.where("n > 1").select("row_id", "n", "no", "name")
    while longest > 1:
        level, longest = level + 1, -(-longest // 2)
        odd = F.col("no") % 2 == 1
        pairs = materialize(
            left.groupBy("row_id", F.floor(F.col("no") / 2).cast("int").alias("no"))
            .agg(F.ceil(F.max("n") / 2).cast("int").alias("n"), F.max(F.when(~odd, F.col("name"))).alias("a"),
                 F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("b")), "pairs")
        known = ordered_names(pairs.select("a", "b").distinct(), "a", "b")
        named = materialize(pairs.join(known, ["a", "b"]).select("row_id", "n", "no", "name"), "names")
        done = done.union(named.where("n = 1").select("row_id", F.lit(level).alias("level"), "name"))
        left = named.where("n > 1")
    return heads.join(done, "row_id")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK,
                     hot: int = HOT) -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``.

    Texts are equal if they are so after each run of ASCII white space became one
    space; null counts as empty. The row with the smallest doc_id stays (null ids
    last; of repeated rows with that id exactly one). An empty table gives no rows;
    other columns are not read."""
    rows = materialize(identities(docs, id_col, text_col, block, hot), "identities")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")
    groups = rows.groupBy("level", "name").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    # Written first: Spark splits a hot key only where both sides of the join are plain exchanges.
    return (rows.join(materialize(groups, "groups"), ["level", "name"])
            .select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
                    (F.col("row_id") == F.col("first.row_id")).alias("kept"), F.col("sha").alias("text_sha256")))
