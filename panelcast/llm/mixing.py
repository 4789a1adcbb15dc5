"""Mixing sources to target weights, in DataFrame operations only.

The size of a row is its number of words.  Sources, by code point and null last, weigh 5, 2, 1, 5, 2,
1, ...; together they get *share* percent of all sizes, and none gets more than *most* times its own
size: what is above goes to the others by weight until none is above.  That is one level of water:
with the caps in the order of cap over weight, the level follows from running sums.

Within a source rows get a hash-random key.  Leading bits of the key range-partition the source into
parts of bounded size, a source of any size into as many as it needs; sums of parts are added up
along each source and rows within their part, so each row knows how many words stand before it.  A
source gives its whole words as often as the target allows and the rest from the start of the key
order, cut inside the row at the exact word.

Nulls: a null text has size 0; null is a source like others; a null doc_id is ordered by its text.
Equal rows get adjacent keys and are interchangeable.  A source without words gets and gives 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
SHARE_PERCENT, MOST = 150, 2
#: Rows of one source that one task orders.
PART_ROWS = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """*sizes* (source, source_size, n) with each source's target, a double.

    One row per source goes through two ordered windows; rows of documents never do.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (pick + 1).cast("int")).cast("long")
    w = sizes.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    # below the level go the sources whose cap is reached first
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    left = SHARE_PERCENT * total - 100 * F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left / (100 * F.sum("weight").over(after))
    full = F.col("level") * F.col("weight") >= F.col("cap")
    w = w.withColumn("level", level)
    # the first source that the water does not fill sets the level for all after it
    first = F.min(F.when(~full, F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(everything)
    ratio = F.col("cap") / F.col("weight")
    set_level = first.getField("level")
    filled = set_level.isNull() | (ratio <= set_level)
    return w.withColumn("target", F.when(filled, F.col("cap").cast("double")).otherwise(set_level * F.col("weight"))).drop("level", "cap", "weight")


def mixture(docs: DataFrame, seed: str = "mix", part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row.

    Texts are read for their number of words and their part of the key, by each pass that needs them;
    what is shuffled are numbers.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5(text))))
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"))
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # parts per source: a power of two, so a part is a range of keys
    parts = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("n") / F.lit(part_rows))).cast("double")))
    per_source = targets(per_source).withColumn("parts", parts.cast("long"))
    lead = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = (
        rows.alias("r")
        .join(per_source.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
        .select("doc_id", "r.source", "size", "source_size", "target", "key", F.shiftright(lead * F.col("parts"), 32).alias("part"))
    )
    along = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    sums = sums.select("source", "part", F.coalesce(F.sum("part_size").over(along), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    met = ranked.alias("r").join(
        sums.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.part") == F.col("s.part"))
    )
    budget = F.bround("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("offset") - F.col("ahead")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return met.select("doc_id", "r.source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """*docs* as the mix takes them: a row for each full epoch, and the cut row with its first words only.

    Rows that the mix does not take go.  A row is known by doc_id, source and number of words; rows
    that agree in these share what is taken evenly.  Rows without words have nothing to take.  n_chars
    follows the text.  Further columns may have any names.
    """
    taken = mixture(docs, seed).where("taken > 0")
    size, copies, part, epoch, doc, of = _free(docs.columns, 6)
    per_id = taken.groupBy(F.col("doc_id").alias(doc), F.col("source").alias(of), F.col("size").alias(size)).agg(
        F.sum("taken").alias(part), F.count("*").alias(copies)
    )
    words = f"{size}_own"
    met = docs.withColumn(words, n_words(F.col("text"))).join(
        per_id, F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(of)) & (F.col(words) == F.col(size))
    )
    share = F.ceil(F.col(part) / F.col(copies))
    out = met.withColumn(part, share).withColumn(epoch, F.explode(F.sequence(F.lit(0), (F.ceil(F.col(part) / F.col(size)) - 1).cast("int"))))
    left = (F.col(part) - F.col(epoch) * F.col(size)).cast("int")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")), 1, F.greatest(left, F.lit(1))), " ")
    out = out.withColumn("text", F.when(left >= F.col(size), F.col("text")).otherwise(first))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(docs.columns)


def _free(columns: list[str], n: int) -> list[str]:
    """*n* column names that differ from all *columns*, whatever their case."""
    longest = max((len(c) for c in columns), default=0)
    return [f"mix{'_' * longest}{i}" for i in range(n)]


SQL = f"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS k
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT *, 2 * source_size AS cap,
         [5, 2, 1][1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3] AS weight FROM per),
run AS (
  SELECT *, cap / weight AS r,
    ({SHARE_PERCENT} * sum(source_size) OVER () - 100 * coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
      / (100 * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)),
water AS (
  SELECT (SELECT level FROM run WHERE level * weight < cap ORDER BY r, source ASC NULLS LAST LIMIT 1) AS level),
goal AS (
  SELECT source, source_size, CASE WHEN w.level IS NULL OR r <= w.level THEN cap::DOUBLE ELSE w.level * weight END AS target
  FROM run, water w),
ahead AS (
  SELECT b.*, source_size, target, round_even(target, 0)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY b.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM base b JOIN goal g ON b.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
   + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM ahead
"""
