"""Distinct counts that add up: sets of numbers as bitmaps.

The distinct items of a group in one period are a few bitmaps, one for each
range of 32,768 numbers. Bitmaps of several periods join to those of any longer
one, so months, years and totals come from one stored table without reading the
rows again. Items are whole numbers; dense ones need little space.

A bitmap takes 4 KB however few numbers it holds. Where a group has few in each
range, as a person has photos in a month, words of 64 numbers take their place:
a long each, at most one per item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def item_bitmaps(rows: DataFrame, keys: dict[str, Column], item: str) -> DataFrame:
    """``keys`` with bucket and bits: the distinct ``item`` numbers of each group; null items count for nothing."""
    known = rows.where(F.col(item).isNotNull())
    return known.groupBy(*(c.alias(k) for k, c in keys.items()), F.bitmap_bucket_number(item).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(item))).alias("bits"))


def joined(bitmaps: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Bitmaps of coarser groups."""
    return bitmaps.groupBy(*(c.alias(k) for k, c in keys.items()), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_items(bitmaps: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per ``keys`` the number of distinct items."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))


#: Numbers that ``part`` of ``item_words`` keeps together, as a power of two.
PART = 22
ROWS = 250_000


def item_words(rows: DataFrame, group: str, period: Column, item: str) -> DataFrame:
    """``group``, part, period, word and bits: the distinct ``item`` numbers of
    each group and period. Null items count for nothing, but their group stays.

    Rows are shuffled once, by group and part (a range of 4,194,304 numbers);
    words of longer periods and counts come from where they then lie. A task
    gets about ``ROWS`` of them, however many there are.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
    part, word, bit = F.shiftright(item, PART), F.shiftright(item, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.col(item).bitwiseAND(63).cast("int"))
    dealt = rows.select(group, period.alias("period"), part.alias("part"), F.col(item).cast("long").alias(item)).repartition(tasks, group, "part")
    return dealt.groupBy(group, "part", "period", word.alias("word")).agg(F.bit_or(F.coalesce(bit, F.lit(0).cast("long"))).alias("bits"))


def joined_words(words: DataFrame, group: str, period: Column) -> DataFrame:
    """Words of longer periods."""
    return words.groupBy(group, "part", period.alias("period"), "word").agg(F.bit_or("bits").alias("bits"))


def counted_words(words: DataFrame, group: str, name: str) -> DataFrame:
    """Per ``group`` and period the number of distinct items."""
    return words.groupBy(group, "period").agg(F.sum(F.bit_count("bits")).alias(name))


def items(bitmaps: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The numbers in each bitmap, a row each."""
    digits = F.hex("bits")
    byte = lambda at: F.substr(digits, 2 * at + 1, F.lit(2))

    def of_byte(at):
        value = F.conv(byte(at), 16, 10).cast("int")
        return F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.getbit(value, b) == 1), lambda b: (8 * at + b).cast("long"))

    full = F.filter(F.sequence(F.lit(0), F.octet_length("bits") - 1), lambda at: byte(at) != "00")
    places = F.flatten(F.transform(full, of_byte))
    # ranges start behind a multiple of 32,768; 0 and numbers below it count down
    number = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + F.col("_at") + 1).otherwise(F.col("bucket") * 32768 - F.col("_at"))
    return bitmaps.select(*keys, F.explode(places).alias("_at"), "bucket").select(*keys, number.alias(name))
