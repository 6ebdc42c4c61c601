"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only.

Each source's documents, in the order of a hash of their ids, form blocks. A source's weight is w of the `total` units
of all sources. Its block k is released at floor(k total / w) and due at ceil((k + 1) total / w). Earliest deadline first
meets all of these, so while no source has run out, each has had its share of any number of slots to within less than
one block. There is no period: the schedule goes on for as long as the sources do. When a source runs out its slots
stay empty and the others go on in their proportions. No document is dropped or repeated.

The schedule is worked out in segments, each by itself. Which blocks are done when a segment begins follows from the
blocks released before it in the length of the longest window: run alone, earliest deadline first does the same blocks
of these as in the whole schedule, but for blocks due later, of which only the most urgent have room. How many is
known, since the slots so far are as many as the blocks done."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import cut

#: Units that the weights of all sources make up. A weight is a whole number of them, one at least.
UNITS = 1 << 28
#: Slots of a segment, if no window is longer.
SEGMENT = 2048
BLOCK_DOCS = 8
#: Default weights: shares of documents to this power.
TEMPERATURE = 0.5
#: Ranks within a source are counted in parts of about so many rows.
PART_ROWS = 5000
#: Slots times sources that a task schedules.
TASK_STEPS = 2_000_000
#: What has been done is put aside after so many blocks.
ASIDE = 256


def source_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["source"].cast("string"), F.lit(""))


def weighed(counts: DataFrame, weights: dict[str, float] | None, block_docs: int) -> DataFrame:
    """One row: sources (an array in the order of their names: source, w, blocks), total. counts: source, n."""
    spark = counts.sparkSession
    if weights is None:
        raw = counts.select("source", "n", F.round(F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE)) * 1_000_000).cast("decimal(28,0)").alias("raw"))
    else:
        if any(not 0 < w < math.inf for w in weights.values()):
            raise ValueError("weights must be positive")
        most = max(weights.values(), default=1)
        given = spark.createDataFrame([(s, round(w / most * (1 << 50)) or 1) for s, w in weights.items()], "source string, raw long")
        if missing := counts.join(given, "source", "left_anti").limit(5).collect():
            raise ValueError(f"no weights for {[r['source'] for r in missing]}")
        raw = counts.join(given, "source").select("source", "n", F.col("raw").cast("decimal(28,0)").alias("raw"))
    all_of = raw.agg(F.sum("raw").cast("decimal(28,0)").alias("of"))
    units = raw.join(F.broadcast(all_of)).select(  # one row
        "source", F.greatest(F.lit(1).cast("long"), F.expr(f"cast(raw * {UNITS} AS decimal(38,0)) DIV of")).alias("w"), F.expr(f"(n + {block_docs - 1}) DIV {block_docs}").alias("blocks")
    )
    return units.agg(F.sort_array(F.collect_list(F.struct("source", "w", "blocks"))).alias("sources"), F.sum("w").alias("total"))


#: A block in a schedule is one number, so that sorting is by deadline, ties by source: due times 2^20, and the source's index.
SOURCE_BITS = 20
DONE = "struct<key:long,slot:long>"


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def due_of(key: Column) -> Column:
    return F.shiftright(key, SOURCE_BITS)


def source_index(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << SOURCE_BITS) - 1).cast("long")).cast("int")


def blocks_released(begin: Column, end: Column) -> Column:
    """All blocks released from begin on and before end, in this order: release, key. Needs the columns of weighed()."""
    total = F.col("total")
    first = lambda s, at: div(at * s["w"] + total - 1, total)

    def of_source(s: Column, idx: Column) -> Column:
        a, b = first(s, begin), first(s, end) - 1
        due = lambda k: div((k + 1) * total + s["w"] - 1, s["w"])
        job = lambda k: F.struct(div(k * total, s["w"]).alias("release"), F.shiftleft(due(k), SOURCE_BITS).bitwiseOR(idx.cast("long")).alias("key"))
        return F.when(b >= a, F.transform(F.sequence(a, b), job)).otherwise(F.array().cast("array<struct<release:long,key:long>>"))

    return F.sort_array(F.flatten(F.transform("sources", of_source)))


def earliest_deadline_first(begin: Column, end: Column, waiting: Column, jobs: Column) -> Column:
    """Struct waiting, done (with slots). waiting: sorted keys of blocks that are there at the beginning; jobs: by release."""

    def ran(state: Column, until: Column) -> tuple[Column, Column]:
        n = F.least(until - state["at"], F.size(state["waiting"]).cast("long")).cast("int")
        now = F.transform(F.slice(state["waiting"], F.lit(1), n), lambda key, i: F.struct(key.alias("key"), (state["at"] + i).alias("slot")))
        return F.concat(state["now"], now), F.slice(state["waiting"], n + 1, F.size(state["waiting"]))

    def step(state: Column, job: Column) -> Column:
        now, rest = ran(state, job["release"])
        full = F.size(state["now"]) >= ASIDE
        return F.struct(
            job["release"].alias("at"),
            F.sort_array(F.concat(rest, F.array(job["key"]))).alias("waiting"),
            F.when(full, F.slice(now, F.size(state["now"]) + 1, F.size(now))).otherwise(now).alias("now"),
            F.when(full, F.concat(state["done"], F.array(state["now"]))).otherwise(state["done"]).alias("done"),
        )

    def finish(state: Column) -> Column:
        now, rest = ran(state, end)
        return F.struct(rest.alias("waiting"), F.concat(F.flatten(state["done"]), now).alias("done"))

    start = F.struct(begin.alias("at"), waiting.alias("waiting"), F.array().cast(f"array<{DONE}>").alias("now"), F.array().cast(f"array<array<{DONE}>>").alias("done"))
    return F.aggregate(jobs, start, step, finish)


def schedule(plan: DataFrame, slots: int, longest: int, segment: int = SEGMENT, tasks: int = 1) -> DataFrame:
    """source, k, slot, release, due of every block that there is. plan: as weighed() gives it; slots: how many are
    scheduled; longest: the longest window."""
    segment = max(segment, longest)
    segments = -(-slots // segment)
    rows = plan.sparkSession.range(0, segments, 1, max(1, min(segments, tasks))).join(F.broadcast(plan))  # one row
    begin, end = F.col("id") * segment, (F.col("id") + 1) * segment
    early = F.greatest(begin - longest, F.lit(0).cast("long"))
    none = F.array().cast("array<long>")
    rows = rows.withColumn("before", earliest_deadline_first(early, begin, none, blocks_released(early, begin)))
    ahead = F.sort_array(F.transform(F.filter("before.done", lambda j: due_of(j["key"]) > begin), lambda j: j["key"]))
    room = begin - F.aggregate("sources", F.lit(0).cast("long"), lambda a, s: a + div(begin * s["w"], F.col("total")))
    waiting = F.sort_array(F.concat("before.waiting", F.slice(ahead, room.cast("int") + 1, F.size(ahead) + 1)))
    rows = rows.select("id", "sources", "total", waiting.alias("waiting"))
    done = earliest_deadline_first(begin, end, F.col("waiting"), blocks_released(begin, end))["done"]
    found = rows.select("sources", "total", F.explode(done).alias("j"))
    found = found.select("total", "j.slot", due_of(F.col("j.key")).alias("due"), F.get("sources", source_index(F.col("j.key"))).alias("own"))
    found = found.withColumn("k", div(F.col("due") * F.col("own.w"), F.col("total")) - 1)  # the one block that is due then
    return found.where("k < own.blocks").select("own.source", "k", "slot", div(F.col("k") * F.col("total"), F.col("own.w")).alias("release"), "due")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, with_row: bool = False, segment: int = SEGMENT) -> DataFrame:
    """Per row of docs: doc_id, source, block (of its source, from 0), slot, release, deadline, position (and row, all its columns).

    Reading by position gives the mixture. weights: by source; sources that it lacks are refused. Without it they are the
    numbers of documents to the power TEMPERATURE. Null and empty sources are one. A null doc_id is ordered as an empty
    one; repeated rows follow each other; other columns, whatever their names, play no part. An empty table gives no rows.

    Weights are whole units of 2^-28 of the mixture; slots go up to 2^34. The work grows with the number of slots up to
    the last block, and with the sources; segments are as long as the longest window, that of the least weight. Three
    numbers come to the driver. Ranks are counted within parts of a source, so a hot one is dealt out."""
    whole = [F.struct("*").alias("row")] if with_row else []
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), source_of(docs).alias("source"), *whole).withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    number = docs.count()
    parts = 1 << max(0, math.ceil(math.log2(max(1, number / PART_ROWS))))
    part = F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * parts / F.lit(1 << 32)
    rows = rows.withColumn("part", F.floor(part).cast("long"))
    sizes = cut(rows.groupBy("source", "part").agg(F.count("*").alias("n")))
    plan = cut(weighed(sizes.groupBy("source").agg(F.sum("n").alias("n")), weights, block_docs))
    ends = F.transform("sources", lambda s: div(s["blocks"] * F.col("total") + s["w"] - 1, s["w"]))
    windows = F.transform("sources", lambda s: div(F.col("total") + s["w"] - 1, s["w"]))
    slots, longest, sources = plan.select(F.coalesce(F.array_max(ends), F.lit(0)), F.coalesce(F.array_max(windows), F.lit(0)), F.size("sources")).first()
    planned = cut(schedule(plan, slots, longest + 1, segment, -(-slots * (20 + sources) // TASK_STEPS)))
    # each part of a source gets the list of its blocks
    placed = sizes.select("source", "part", "n", (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("before"))
    first, last = F.expr(f"before DIV {block_docs}"), F.expr(f"(before + n - 1) DIV {block_docs}")
    of_part = placed.select("source", "part", "before", F.explode(F.sequence(first, last)).alias("k")).join(planned, ["source", "k"])
    of_part = of_part.groupBy("source", "part", "before").agg(F.sort_array(F.collect_list(F.struct("k", "slot", "release", "due"))).alias("places"))
    in_part = F.row_number().over(Window.partitionBy("source", "part").orderBy("order", "doc_id"))
    ranked = rows.withColumn("in_part", in_part).join(of_part, ["source", "part"]).withColumn("rank", F.col("before") + F.col("in_part") - 1)
    block = F.expr(f"rank DIV {block_docs}")
    ranked = ranked.withColumn("at", F.get("places", (block - F.expr(f"before DIV {block_docs}")).cast("int")))
    return ranked.select(
        "doc_id",
        "source",
        F.col("at.k").alias("block"),
        F.col("at.slot").alias("slot"),
        F.col("at.release").alias("release"),
        F.col("at.due").alias("deadline"),
        (F.col("at.slot") * block_docs + F.pmod(F.col("rank"), F.lit(block_docs))).cast("long").alias("position"),
        *(["row"] if with_row else []),
    )


def mixed(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs, with all columns, in the order of the mixture. Whatever the columns are called, null and
    repeated ids and repeated rows included, every row comes back once."""
    return mix(docs, weights, with_row=True).orderBy("position").select("row.*")
