"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then the full hash.

Rows whose length, or whose length and prefix hash, occur once are done. The counts are pre-aggregated where the rows
lie, so a hot length or group sends a few rows. The others' texts are hashed in full and only they are grouped. Which
those are is told by a bitmap of a fixed size, so that no text is shuffled to find out; what it lets through by chance
drops out by the keys themselves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import cut, in_row, join_sized, keyed

#: Texts are equal when they are identical after each run of [\x20\x09-\x0D] becomes one space: the runs that aren't one already.
SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
PREFIX_CHARS = 256
#: Bits of the bitmap of open lengths and prefixes: 512 KB, whatever the input.
BITMAP_BITS = 1 << 22


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def digest_of(text: Column) -> Column:
    return F.sha2(text, 256)


@dataclass
class Refined:
    """keys: every row's file, at, doc_id, n, prefix (and sha, if it was asked for); groups: n, prefix, sha, group_size,
    keep_id and first (the row that stays) of each text that occurs twice or more; members: keys and sha of the rows that
    the first two steps left open; total: how many rows there are."""

    keys: DataFrame
    members: DataFrame
    groups: DataFrame
    total: int


def slot_of_key(on: tuple[str, str]) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(BITMAP_BITS)) + 1


def maybe_open(rows: DataFrame, open_keys: DataFrame, on: tuple[str, str] = ("n", "prefix")) -> DataFrame:
    """The rows whose slot in the bitmap is set: all that are open, and maybe others."""
    slot = slot_of_key(on)
    bits = open_keys.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    bit = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("getbit", byte, F.pmod(bit, F.lit(8)).cast("int")) == 1
    return rows.withColumn("bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "bucket").where(is_set).drop("bucket", "bits")  # 128 rows of 4 KB


def refine(rows: DataFrame, digest_all: bool = False, prefix_chars: int = PREFIX_CHARS) -> Refined:
    """rows: as keyed() gives them."""
    rows = rows.select("file", "at", in_row("doc_id").alias("doc_id"), normalised(in_row("text")).alias("text"))
    rows = rows.select("*", F.length("text").alias("n"), F.xxhash64(F.substring("text", 1, prefix_chars)).alias("prefix"))
    whole = [digest_of(F.col("text")).alias("sha")]
    keys = cut(rows.select("file", "at", "doc_id", "n", "prefix", *(whole if digest_all else [])))
    total = keys.count()
    by_prefix = keys.groupBy("n", "prefix").agg(F.count("*").alias("size"))
    by_length = by_prefix.groupBy("n").agg(F.sum("size").alias("of_length")).where("of_length > 1")
    open_keys = cut(by_prefix.join(by_length, "n", "left_semi").where("size > 1"))
    hashed = keys if digest_all else cut(maybe_open(rows, open_keys).select("file", "at", "doc_id", "n", "prefix", *whole))
    members = join_sized(hashed, open_keys, ["n", "prefix"], "left_semi", "size", total)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "at"))
    groups = cut(members.groupBy("n", "prefix", "sha").agg(F.count("*").alias("group_size"), first.alias("first")).where("group_size > 1"))
    return Refined(keys, members, groups, total)


def exact_groups(docs: DataFrame, digest_all: bool = False, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    text_sha256 is null for rows that fell out early, unless digest_all asks for every digest: then all are taken in the
    first scan, but groups are still made of the rows only that length and prefix leave open.

    Null texts count as empty, and all empty texts are one group. Null ids: such rows are grouped like others,
    but stay only where no equal text has an id. Rows that repeat a doc_id are one document: each such row comes
    back, counts in group_size and gets the same decision. Columns other than doc_id and text play no part. An empty
    table gives no rows."""
    found = refine(keyed(docs), digest_all, prefix_chars)
    on, groups = ["n", "prefix", "sha"], found.groups.select("n", "prefix", "sha", "group_size", F.col("first.doc_id").alias("keep_id"))
    if digest_all:
        rows = join_sized(found.keys, groups, on, "left", "group_size", found.total)
    else:
        grouped = join_sized(found.members, groups, on, "left", "group_size", found.total).select("file", "at", "sha", "group_size", "keep_id")
        rows = found.keys.join(grouped, ["file", "at"], "left")
    keep_id = F.coalesce("keep_id", "doc_id")
    return rows.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """Of the rows of each text one, with all its columns: that with the smallest doc_id; of several with this id any one.

    Rows are dropped, not ids: a text that only a row with a repeated or null id has stays. A row without an id stays if
    no equal text has one. Null texts count as empty. Columns may have any names. An empty table gives no rows."""
    rows = keyed(docs)
    found = refine(rows)
    members = join_sized(found.members, found.groups, ["n", "prefix", "sha"], "inner", "group_size", found.total)
    gone = members.where("file <> first.file OR at <> first.at").select("file", "at")
    return rows.join(gone, ["file", "at"], "left_anti").select("row.*")
