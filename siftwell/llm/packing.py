"""Best-fit packing of token sequences by hierarchical residual packing.

Pieces are dealt to nodes of bounded size and packed best-fit there, longest first. Bins that are nearly full are
emitted; the others become items of the next level, where a few nodes' bins meet in one and are packed again, up to a
single node. A level gets as many nodes as keep each within its bound, so no task's share grows with the input. Where
so many bins are left that nodes can't meet, they are dealt anew and packed again, until that makes hardly fewer.

Where documents have an order, a node gets a stretch of it, and sequences are numbered by their first piece there."""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import cut, ids_and_texts, sliced, text_of
from siftwell.llm.token_counts import byte_alphabet

CAPACITY = 1024
END_ID = 2
#: Items that one node packs.
NODE_ITEMS = 4000
#: Nodes that meet in one.
MEETING = 8
#: A level that leaves more than this share of the bins of the last one is the end, if nodes can't meet.
STUCK = 0.99
#: Bins that lack so few tokens are emitted.
SLACK = 4
#: A text has fewer pieces than this power of two.
PIECE_BITS = 21
#: Fixed value: the split pattern of this vocabulary's byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoder(file: str) -> tiktoken.Encoding:
    """The vocabulary of a byte-level BPE .json in a faster library; its ids are the ranks of its merges, as is checked."""
    with open(file, encoding="utf-8") as f:
        data = json.load(f)
    byte = byte_alphabet()
    special = {a["content"]: a["id"] for a in data["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): k for t, k in data["model"]["vocab"].items() if t not in special}
    merges = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
    vocab = data["model"]["vocab"]
    if any(vocab[a + b] != 256 + k for k, (a, b) in enumerate(merges)):
        raise ValueError("the ids of this vocabulary don't follow its merges")
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(encoding: tiktoken.Encoding, text: str) -> list[int]:
    if any(s in text for s in encoding.special_tokens_set):
        return encoding.encode(text, allowed_special="all")
    return encoding.encode_ordinary(text)


def pieces(docs: DataFrame, file: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, position: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (, ids) (, position, from the column of that name) of the pieces of every row: its tokens and the end id, cut,
    if they are more than the capacity, into pieces of the capacity; the first takes what is over.

    Null and empty texts have one piece, of the end id. Repeated rows and null ids each give their pieces."""
    texts = ids_and_texts(docs)
    if position:
        texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), docs[position].alias("position"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(file)
        for batch in sliced(batches, 1):
            rows = []
            for doc_id, text, *at in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.array([*token_ids(encoding, text), end_id], "<u4")
                first = len(ids) % capacity or capacity
                stops = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(stops, stops[1:])):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b]] if with_ids else []), *at))
            columns = list(zip(*rows)) or [()] * (5 + with_ids + bool(position))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int64())] if with_ids else []), *([pa.int64()] if position else [])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), *(["position"] if position else [])]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids + ", position long" * bool(position)
    return texts.mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin of each item, its offset there, and the fill of each bin. Longest first, each into the fullest bin
    that has room; ties by the order given."""
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    rooms = 0  # bit r is set if with_room[r] has bins
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bin_of[k], offset[k] = b, fill[b]
        fill[b] += n
        with_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bin_of, offset, np.array(fill, np.int64)


STATE = T.StructType([T.StructField(n, T.LongType()) for n in ("row", "length", "bin", "offset", "fill", "node")])


def pack_node(level: int, capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        node = int(rows["node"].iloc[0])
        rows = rows.sort_values(["bin", "offset", "row"], kind="stable")
        units = rows.groupby("bin", sort=True)["length"].sum()
        bin_of, base, fill = best_fit(units.to_numpy(np.int64), capacity)
        at = units.index.get_indexer(rows["bin"])
        new = bin_of[at]
        return pd.DataFrame({"row": rows["row"], "length": rows["length"], "bin": (level << 56) + (node << 32) + new, "offset": rows["offset"] + base[at], "fill": fill[new], "node": node})

    return run


def place(items: DataFrame, capacity: int = CAPACITY, node_items: int = NODE_ITEMS, slack: int = SLACK) -> DataFrame:
    """items: row (distinct longs from 0), length (1 to capacity), and maybe order (distinct longs). Adds sequence_id and
    offset to row. With an order, nodes pack stretches of it, neighbours meet, and a sequence's id is the least order in it."""
    ordered = "order" in items.columns
    full = items.where(F.col("length") == capacity).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < capacity)
    count, done = rest.count(), [full]
    nodes = math.ceil(count / node_items)
    node = F.pmod(F.xxhash64("row"), F.lit(max(1, nodes)))
    if ordered:
        ends = rest.select(F.percentile_approx("order", [k / nodes for k in range(1, nodes)], 100 * nodes)).first()[0] if nodes > 1 else []
        node = F.size(F.filter(F.lit(ends).cast("array<long>"), lambda x: x < F.col("order"))).cast("long") if ends else F.lit(0).cast("long")
    state = rest.select("row", "length", F.col("row").alias("bin"), F.lit(0).cast("long").alias("offset"), node.alias("node"))
    level, before = 1, math.inf
    while count:
        packed = cut(state.groupBy("node").applyInPandas(pack_node(level, capacity), STATE))
        left = packed.where(F.col("fill") < capacity - slack)
        bins = left.select("bin").distinct().count() if nodes > 1 else 0
        fewer = max(math.ceil(bins / node_items), math.ceil(nodes / MEETING))
        if not bins or fewer >= nodes and bins > STUCK * before:
            done.append(packed.select("row", F.col("bin").alias("sequence_id"), "offset"))
            break
        done.append(packed.where(F.col("fill") >= capacity - slack).select("row", F.col("bin").alias("sequence_id"), "offset"))
        if fewer >= nodes:  # dealt by the bins, since nodes can't meet
            fewer, meets = nodes, F.pmod(F.xxhash64("bin"), F.lit(nodes))
        else:
            meets = F.expr(f"(node * {fewer}L) DIV {nodes}L") if ordered else F.pmod(F.col("node"), F.lit(fewer))
        state, nodes, level, before = left.withColumn("node", meets), fewer, level + 1, bins
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    if not ordered:
        return out
    out = out.join(items.select("row", "order"), "row")
    first = out.groupBy("sequence_id").agg(F.min("order").alias("first"))
    return out.join(first, "sequence_id").select("row", F.col("first").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, file: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, position: str | None = None, node_items: int = NODE_ITEMS) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.
    Offsets in a sequence are gapless from 0. An empty table gives no rows; see pieces() for nulls and repeats.

    position: a column of docs, distinct longs from 0 to 2^42. Documents near each other there are packed together, and
    sequences read by their id follow the first positions in them."""
    found = pieces(docs, file, capacity, end_id, with_ids, position).withColumn("row", F.monotonically_increasing_id())
    order = [F.expr(f"position * {1 << PIECE_BITS}L + piece").alias("order")] if position else []
    found = cut(found.select("*", *order).drop("position"))
    placed = place(found.select("row", "length", *(["order"] if position else [])), capacity, node_items)
    return found.join(placed, "row").drop("row", "order")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of each packed sequence, from pack_documents(with_ids=True)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
