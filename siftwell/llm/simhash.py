"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Fingerprints are 64 majority bits over the hashed word shingles. For the search a fingerprint is cut into three
segments. With at most two differing bits, one segment agrees and any other differs in two bits at most. A segment's
fuzzy keys are the codewords of the perfect (23, 12) Golay code to which the vectors within one bit of it decode:
one or six keys, of which two segments within two bits share at least one (the vector between them decodes to it).
So fingerprints that link share a bucket (agreeing segment, fuzzy key of the next segment); they are verified there.

Buckets with more fingerprints than a bound are not paired. Their fingerprints are linked by the same idea applied to
the whole fingerprint: two are within two bits if and only if some vector is within one bit of both. Such a vector's
group has 65 members at most, whatever the data, and linking each to the smallest keeps all components.

Two bits of 64 stand for a cosine of 0.995. For a similarity of 0.8 (similar_groups() and drop_near_duplicates()) the
fingerprints are wider: a text's distinct shingles vote on as many bits as TABLES pieces have. A piece has a segment whose
fuzzy keys are taken as above, and a few bits that must agree; texts that share a key of any piece are compared by all
their bits, and those that seem similar by their shingle sets, whose cosine alone makes a link. This finds most links, and
most components.

Links between components that it leaves out are found exactly (missed_pairs()). Sets with a cosine of c or more have sizes
within c * c of each other and share at least c * c of the larger one, so that the first 1 - c * c of each, in any order
that is the same for all texts, have a shingle in common. Frequent shingles come last in this order, so that few texts
share one by chance. How many of the first shingles two texts share bounds how many they share at all; where that is enough
for c, the sets themselves are compared."""

from __future__ import annotations

import gc
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import cut, ids_and_texts, in_row, join_sized, keyed, sliced, texts
from siftwell.llm.exact_dedup import maybe_open

SHINGLE_WORDS = 3
MAX_BITS = 2  # what the fuzzy keys guarantee
SEED = 42
#: Buckets with more distinct fingerprints are linked by the vectors between them.
PAIR_BOUND = 32
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: a generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101

#: For similar texts: words of a shingle, the least cosine of their sets, and that from which one stands for the other.
SIMILAR_WORDS, SIMILARITY, SAME = 5, 0.8, 0.95
#: Pieces of a wide fingerprint, bits of each for the Golay code, and bits that must agree.
TABLES, CODED, EXACT = 36, 23, 14
WIDE = -(-TABLES * (CODED + EXACT) // 64)
#: Pieces are looked up in rounds, up to these, each of some three times as many; what is found to be the same as another
#: text doesn't go on.
ROUNDS = (1, 4, 12, TABLES)
#: Shingles whose bits are counted together.
COUNTED = 4096
#: Of a node's pairs that the bits find, so many are compared by their shingles; the exact search finds what this leaves out.
NEAREST = 3
#: Which shingles are frequent is told by one document in SAMPLED, and by fewer from SAMPLE_ROWS on: one that FREQUENT of them
#: have is, and each fourfold is a level more. It settles the order of shingles only; no link depends on it.
SAMPLED, SAMPLE_ROWS, FREQUENT = 4, 1_000_000, 3
#: Levels are kept by the first bits of a shingle's hash: 16 MB, whatever the input. Work is dealt out by the first of these.
LEVEL_BITS, DEALT_BITS = 24, 8
#: Share of a set that is looked up beyond what an exact search needs: shared shingles then rule out more pairs.
MARGIN = 0.05
#: Nodes with a crowded shingle that are compared with as many others in one group.
BLOCK = 256
#: Rows of an edge or pair, about, for which a partition is worth its files.
PART_ROWS = 20_000
#: Entries (shingle, node) that a Python worker holds at once, and that are dealt to one group, about.
HELD, GROUPED = 1 << 20, 1 << 19

LONG = lambda *names: T.StructType([T.StructField(n, T.LongType()) for n in names])


def shingle_hashes(text: bytes, shingle_words: int) -> list[int]:
    """A hash for each shingle, repeats included; of all words together where they are too few; none without words."""
    words = text.lower().split()  # bytes: only A-Z and the six ASCII blanks
    line = b" ".join(words)
    if len(words) <= shingle_words:
        return [xxhash.xxh64_intdigest(line, SEED)] if words else []
    digest = xxhash.xxh64_intdigest
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    begins = np.concatenate([[0], stops[:-1] + 1])[: len(words) - shingle_words + 1].tolist()
    return [digest(line[a:b], SEED) for a, b in zip(begins, stops[shingle_words - 1 :].tolist())]


def fingerprint_batch(batch_texts: list[bytes], shingle_words: int) -> np.ndarray:
    """One unsigned fingerprint for each text: bit set if it is set in over half of the shingles' hashes; 0 without words."""
    hashes, ends = [], []
    for text in batch_texts:
        hashes += shingle_hashes(text, shingle_words)
        ends.append(len(hashes))
    flat, out = np.array(hashes, "<u8"), np.zeros(len(batch_texts), np.uint64)
    at = 0
    for k, end in enumerate(ends):
        if end > at:
            ones = np.zeros(64, np.int64)
            for a in range(at, end, 1 << 16):
                bits = np.unpackbits(flat[a : min(end, a + (1 << 16))].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(0, dtype=np.int64)
            out[k] = np.packbits(2 * ones > end - at, bitorder="little").view("<u8")[0]
        at = end
    return out


def fingerprints(rows: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """rows: longs, and text in the last column. fp (the fingerprint as a signed long) instead of the text; empty texts have fp 0."""
    names = [*rows.columns[:-1], "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, len(names) - 1):
            found = fingerprint_batch(texts(batch.column(len(names) - 1)), shingle_words).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names)

    return rows.mapInArrow(run, LONG(*names))


def widened(h: np.ndarray, word: int) -> np.ndarray:
    """Another 64 bits for each hash: the finisher of splitmix64 on the hash and the word's number."""
    h = h + np.uint64(0x9E3779B97F4A7C15 * (word + 1) & (1 << 64) - 1)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingle_set(text: bytes, shingle_words: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted."""
    return np.unique(np.array(shingle_hashes(text, shingle_words), np.uint64))


def set_id(h: np.ndarray) -> int:
    """The same signed long for the same shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.astype("<u8").tobytes(), SEED)).view(np.int64))


def wide_fingerprint(text: bytes, shingle_words: int) -> np.ndarray:
    """WIDE signed longs: bits set in over half of the distinct shingles' widened hashes; zeros without words."""
    return wide_bits(shingle_set(text, shingle_words))


def wide_bits(h: np.ndarray) -> np.ndarray:
    ones = np.zeros(64 * WIDE, np.int64)
    for a in range(0, len(h), COUNTED):
        part = np.stack([widened(h[a : a + COUNTED], k) for k in range(WIDE)], axis=1)
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<i8")


def wide_fingerprints(rows: DataFrame, shingle_words: int = SIMILAR_WORDS) -> DataFrame:
    """rows: longs, and text in the last column. Instead of the text fp (a long that names its shingle set), n (the set's
    size) and wide, an array of WIDE longs."""
    names = [*rows.columns[:-1], "fp", "n", "wide"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, len(names) - 3):
            sets = [shingle_set(t, shingle_words) for t in texts(batch.column(len(names) - 3))]
            own = [pa.array([set_id(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array([wide_bits(h) for h in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names)

    return rows.mapInArrow(run, T.StructType([*LONG(*names[:-1]).fields, T.StructField("wide", T.ArrayType(T.LongType()))]))


@lru_cache(1)
def decoder() -> np.ndarray:
    """For every 23-bit vector the index of the one codeword within three bits."""
    words = np.zeros(4096, np.int64)
    for k in range(12):
        words ^= ((np.arange(4096) >> k) & 1) * (GENERATOR << k)
    flips = [0, *(1 << a for a in range(23))]
    flips += [1 << a | 1 << b for a in range(23) for b in range(a)]
    flips += [1 << a | 1 << b | 1 << c for a in range(23) for b in range(a) for c in range(b)]
    table = np.full(1 << 23, -1, np.int16)
    for flip in flips:
        table[words ^ flip] = np.arange(4096)
    assert (table >= 0).all()
    return table


def fuzzy_keys(values: np.ndarray) -> np.ndarray:
    """24 columns: the codewords that the vectors within one bit decode to."""
    table = decoder()
    return np.stack([table[values], *(table[values ^ (1 << k)] for k in range(23))], axis=1)


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row number and a bucket's key."""
    fp = fp.view(np.uint64)
    part = [((fp >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    rows, keys = [], []
    for k in range(3):
        fuzzy = np.sort(fuzzy_keys(part[(k + 1) % 3]), axis=1).astype(np.int64)
        new = np.ones(fuzzy.shape, bool)
        new[:, 1:] = fuzzy[:, 1:] != fuzzy[:, :-1]
        r, c = np.nonzero(new)
        rows.append(r)
        keys.append(k << 60 | part[k][r] << 12 | fuzzy[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def golay_keys(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            rows, keys = bucket_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])

    return distinct.select("fp").mapInArrow(run, LONG("key", "fp"))


def links(distinct: DataFrame, pair_bound: int = PAIR_BOUND) -> DataFrame:
    """Edges a < b between distinct fingerprints whose components are those of all links at MAX_BITS or fewer bits."""
    keys = cut(golay_keys(distinct))
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(keys.join(sizes, "key"))
    cold = shared.where(F.col("size") <= pair_bound)
    pairs = (
        cold.select("key", F.col("fp").alias("a"))
        .join(cold.select("key", F.col("fp").alias("b")), "key")
        .where("a < b AND bit_count(a ^ b) <= 2")
        .select("a", "b")
    )
    hot = shared.where(F.col("size") > pair_bound).select("fp").distinct()
    near = F.array(F.lit(0).cast("long"), *(F.lit(v - (1 << 64) if v >> 63 else v).cast("long") for v in (1 << k for k in range(64))))
    between = hot.select("fp", F.explode(near).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    stars = (
        between.groupBy("middle").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    )
    return pairs.union(stars).distinct()


def few(df: DataFrame, rows: int) -> DataFrame:
    """A table of so many small rows in no more partitions than they need: each task's shuffle files take disk, empty or not."""
    return df.coalesce(max(1, -(-rows // PART_ROWS)))


def release(df: DataFrame) -> None:
    """Let go of the shuffle files and checkpoints of finished steps now: Spark deletes them when the driver's garbage is collected."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the smallest node it is connected with) of every node of the edges a, b.

    Alternating large and small stars: a round moves edges to smaller neighbours and makes no more of them. Each
    round is cut by a checkpoint; only the number of edges and a checksum come to the driver. A node with many
    neighbours gets their least from partial sums, and its edges stay where they are."""
    edges = cut(edges.select("a", "b"))
    total, before = edges.count(), None
    edges = few(edges, total)
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("size"))
        large = join_sized(both, least, ["a"], "inner", "size", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # now a > b: to the smallest of a's neighbours go a and its other smaller neighbours
        large = cut(few(large, 2 * total))
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("size"))
        moved = join_sized(large, least, ["a"], "inner", "size", total)
        small = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = cut(few(small, 2 * total))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        total, before = now[0], now
    else:
        raise RuntimeError("the components have not settled")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def piece_keys(nodes: DataFrame, first: int, last: int) -> DataFrame:
    """key, node: the fuzzy keys of the pieces from first on and before last. nodes: node, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 512) for k in range(0, whole.num_rows, 512)):
                node = batch.column(0).to_numpy(zero_copy_only=False)
                bits = np.unpackbits(np.array(batch.column(1).to_pylist(), "<i8").view(np.uint8).reshape(len(node), -1), axis=1, bitorder="little").astype(np.int64)
                for t in range(first, last):
                    own = bits[:, t * (CODED + EXACT) : (t + 1) * (CODED + EXACT)]
                    fuzzy = np.sort(fuzzy_keys(own[:, :CODED] @ (1 << np.arange(CODED))), axis=1).astype(np.int64)
                    new = np.ones(fuzzy.shape, bool)
                    new[:, 1:] = fuzzy[:, 1:] != fuzzy[:, :-1]
                    r, c = np.nonzero(new)
                    key = (t << EXACT | own[:, CODED:] @ (1 << np.arange(EXACT)))[r] << 12 | fuzzy[r, c]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[r])], ["key", "node"])

    return nodes.select("node", "fp").mapInArrow(run, LONG("key", "node"))


def most_bits(cosine: float) -> int:
    """How many bits of wide fingerprints differ, expectedly, between texts whose shingle sets have this cosine."""
    return int(64 * WIDE * math.acos(cosine) / math.pi)


def similar_links(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs a, b of nodes (node, fp) that share a key and whose bits tell of the similarity, and in how many bits they differ.
    They are not all that are similar, and not surely so: similar_roots() compares their sets and finds the rest.

    In a bucket a node is compared with the first and with the one before it, so that a bucket gives two pairs for each
    of its nodes however large it is. Nodes that are the same as an earlier one but for little (SAME) are left out of
    the following rounds: large groups shrink to a few before most pieces are looked up."""
    links, live = None, nodes.select("node", "fp")
    for first, last in zip((0, *ROUNDS), ROUNDS):
        ordered = Window.partitionBy("key").orderBy("node")
        near = piece_keys(live, first, last).select("node", F.first("node").over(ordered).alias("least"), F.lag("node").over(ordered).alias("before")).where("before IS NOT NULL")
        others = F.array_union(F.collect_set("least"), F.collect_set("before"))  # two for each of a node's keys at most
        pairs = near.groupBy("node").agg(others.alias("others")).select("node", F.explode("others").alias("other"))
        pairs = pairs.join(live.select("node", "fp"), "node").join(live.select(F.col("node").alias("other"), F.col("fp").alias("other_fp")), "other")
        differ = F.aggregate(F.zip_with("fp", "other_fp", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
        found = cut(pairs.select("other", "node", differ.alias("differ")).where(F.col("differ") <= most_bits(similarity)))
        own = found.select(F.col("other").alias("a"), F.col("node").alias("b"), "differ")
        links = own if links is None else links.union(own)
        if last < TABLES:
            live = cut(live.join(found.where(F.col("differ") <= most_bits(SAME)).select("node").distinct(), "node", "left_anti"))
    return links.distinct()


def similar_sets(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """The pairs a, b whose shingle sets have the similarity. Only the texts of their nodes (fp, file, at: a row that has
    this set) are read from the rows (file, at, text)."""
    pairs = cut(pairs.select("a", "b"))
    size = pairs.count()
    pairs = few(pairs, size)
    wanted = cut(few(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), 2 * size).join(nodes.select("fp", "file", "at"), "fp"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            sets = [shingle_set(t, shingle_words).tobytes() for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "own"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3))
            same = [len(np.intersect1d(x, y, assume_unique=True)) >= similarity * math.sqrt(len(x) * len(y)) - 1e-6 for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    texts_of = maybe_open(rows.select("file", "at", "text"), wanted, ("file", "at")).join(wanted, ["file", "at"]).select("fp", "text")
    sets = cut(texts_of.mapInArrow(read, T.StructType([*LONG("node").fields, T.StructField("own", T.BinaryType())])))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("left")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("right")), "b")
    return cut(both.select("a", "b", "left", "right").mapInArrow(compare, LONG("a", "b")))


DEALT = T.StructType([T.StructField("part", T.LongType()), T.StructField("entries", T.BinaryType())])


def dealt(held: list[np.ndarray], part: np.ndarray) -> pa.RecordBatch:
    """The arrays' rows by their part, as the bytes of each array's share one after the other."""
    order = np.argsort(part, kind="stable")
    parts, at = np.unique(part[order], return_index=True)
    stops = [*at[1:].tolist(), len(part)]
    held = [x[order] for x in held]
    blobs = [b"".join(x[a:b].tobytes() for x in held) for a, b in zip(at.tolist(), stops)]
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int64)), pa.array(blobs, pa.binary())], ["part", "entries"])


def shingle_levels(rows: DataFrame, total: int, shingle_words: int) -> bytes:
    """For every value of a hash's first LEVEL_BITS how frequent the most frequent shingle with it is (0: not), compressed.
    rows: file, at, text; total: how many there are."""
    width = 1 << LEVEL_BITS - DEALT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            h = np.concatenate(held)
            return dealt([(h >> np.uint64(32 - DEALT_BITS)).astype(np.uint32)], (h >> np.uint64(64 - DEALT_BITS)).astype(np.int64))

        held, size = [], 0
        for batch in sliced(batches, 0):
            for text in texts(batch.column(0)):
                held.append(shingle_set(text, shingle_words))
                size += len(held[-1])
                if size > HELD:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def level(group: pa.Table) -> pa.Table:
        shingles, sizes = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in group["entries"].to_pylist()]), return_counts=True)
        often = sizes >= FREQUENT
        own = np.zeros(width, np.uint8)
        np.maximum.at(own, shingles[often] >> np.uint32(32 - LEVEL_BITS + DEALT_BITS), (1 + np.log2(sizes[often] / FREQUENT) // 2).astype(np.uint8))
        return pa.table({"part": group["part"][:1], "entries": pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())})

    of = max(SAMPLED, -(-total // SAMPLE_ROWS))
    sample = rows.where(F.pmod(F.xxhash64("file", "at"), F.lit(of)) == 0).select("text")
    found = np.zeros((1 << DEALT_BITS, width), np.uint8)
    for part, own in sample.mapInArrow(count, DEALT).groupBy("part").applyInArrow(level, DEALT).collect():  # 64 KB each, before they are compressed
        found[part] = np.frombuffer(zlib.decompress(own), np.uint8)
    return zlib.compress(found.tobytes(), 1)


def looked_up(n: int, similarity: float) -> int:
    """How many shingles of a set of n are looked up, frequent ones last."""
    return min(n, n - math.ceil(similarity * similarity * n - 1e-6) + 1 + math.ceil(MARGIN * n))


def first_shingles(rows: DataFrame, levels: bytes, parts: int, shingle_words: int, similarity: float) -> DataFrame:
    """key, node: the shingles that are looked up and that two or more nodes share. rows: text."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            key = np.concatenate(held)
            node = np.repeat(np.array(nodes, np.int64), [len(x) for x in held])
            return dealt([key.view(np.int64), node], (key % np.uint64(parts)).astype(np.int64))

        of, held, nodes, size = np.frombuffer(zlib.decompress(levels), np.uint8), [], [], 0
        for batch in sliced(batches, 0):
            for text in texts(batch.column(0)):
                h = shingle_set(text, shingle_words)
                if len(h):
                    own = of[(h >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)]
                    held.append(h[np.argsort(own, kind="stable")[: looked_up(len(h), similarity)]])
                    nodes.append(set_id(h))
                    size += len(held[-1])
                if size > HELD:
                    yield out()
                    held, nodes, size = [], [], 0
        if size:
            yield out()

    def share(group: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, np.int64) for x in group["entries"].to_pylist()]
        key, node = (np.concatenate([x[k * len(x) // 2 : (k + 1) * len(x) // 2] for x in blobs]) for k in (0, 1))
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])  # rows with the same shingles are one node
        key, node = key[new], node[new]
        again = np.zeros(len(key), bool)
        again[1:] = key[1:] == key[:-1]
        again[:-1] |= again[1:]
        return pa.table({"key": key[again], "node": node[again]})

    return rows.select("text").mapInArrow(deal, DEALT).groupBy("part").applyInArrow(share, LONG("key", "node"))


def missed_pairs(rows: DataFrame, total: int, known: DataFrame, shingle_words: int, similarity: float, pair_bound: int = PAIR_BOUND) -> DataFrame:
    """Pairs a < b of nodes of different components, among them all that are similar.
    rows: file, at, text; known: node, n (the size of its set), root (its component).

    Shingles that more nodes than pair_bound share aren't paired by rows: see crowded_pairs(). What shares one of them is
    counted there, the others' shared shingles are all among those paired here."""
    entries = known.agg(F.sum("n")).first()[0] or 0
    levels = shingle_levels(rows, total, shingle_words)
    shared = first_shingles(rows, levels, max(8, entries // GROUPED), shingle_words, similarity)
    shared = cut(shared.join(known, "node"))
    between = shared.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size")).where("least < most")
    open_keys = cut(join_sized(shared, cut(between.select("key", "size")), ["key"], "inner", "size", shared.count()))
    cold = open_keys.where(F.col("size") <= pair_bound)
    left, right = (cold.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "root"))) for side in "ab")
    near = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (similarity * similarity) - 1e-6
    pairs = left.join(right, "key").where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & near)
    pairs = pairs.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b").agg(F.count("*").alias("common"))
    rest = [n - F.least(n, n - F.ceil(n * (similarity * similarity) - 1e-6) + 1 + F.ceil(n * MARGIN)) for n in (F.col("n_a"), F.col("n_b"))]
    pairs = pairs.where(F.col("common") + F.greatest(*rest) >= F.lit(similarity) * F.sqrt(F.col("n_a") * F.col("n_b")) - 1e-6).select("a", "b")
    return pairs.union(crowded_pairs(open_keys, pair_bound, similarity)).distinct()


def crowded_pairs(open_keys: DataFrame, pair_bound: int, similarity: float) -> DataFrame:
    """Pairs a < b of nodes of different components that share a key of more than pair_bound nodes, and enough keys to be
    similar. open_keys: key, size, node, n, root.

    Keys get a label, alike for many that the same nodes have, and nodes are gathered by the labels of such keys, in blocks
    of BLOCK: for any two blocks of a label one product of matrices counts what keys each two nodes share."""
    hot = open_keys.where(F.col("size") > pair_bound).select("key", "node").withColumn("label", F.col("key"))
    total = hot.count()
    for _ in range(2):  # any labels do; with fewer of them less is counted twice
        of_node = hot.groupBy("node").agg(F.min("label").alias("label"))
        of_key = hot.select("key", "node").join(of_node, "node").groupBy("key").agg(F.min("label").alias("label"), F.count("*").alias("size"))
        hot = cut(join_sized(hot.select("key", "node"), cut(of_key), ["key"], "inner", "size", total).select("key", "node", "label"))
    members = cut(hot.select("label", "node").distinct())
    keys = open_keys.join(members.select("node").distinct(), "node").groupBy("node", "n", "root").agg(F.collect_list("key").alias("keys"))
    sizes = cut(members.groupBy("label").agg(F.count("*").alias("size")))
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    dealt_to = join_sized(members, sizes, ["label"], "inner", "size", members.count()).withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    dealt_to = dealt_to.select("label", "node", "block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other")).join(keys, "node")
    dealt_to = dealt_to.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "root", "keys")

    def count(group: pa.Table) -> pa.Table:
        node, n, root, block, i, j = (group[c].to_numpy() for c in ("node", "n", "root", "block", "i", "j"))
        own = [np.array(x, np.int64) for x in group["keys"].to_pylist()]
        _, key, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        who, often = np.repeat(np.arange(len(own)), [len(x) for x in own]), times[key] > 1
        key, who = (np.cumsum(times > 1) - 1)[key[often]], who[often]
        order = np.argsort(key, kind="stable")
        key, who = key[order], who[order]
        common = np.zeros((len(own), len(own)), np.float32)  # whole numbers below 2^24
        for at in range(0, int(key[-1]) + 1 if len(key) else 0, COUNTED):
            a, b = np.searchsorted(key, [at, at + COUNTED])
            has = np.zeros((len(own), COUNTED), np.float32)
            has[who[a:b], key[a:b] - at] = 1
            common += has @ has.T
        rest = n - np.array([looked_up(x, similarity) for x in n.tolist()])
        least, most = np.minimum.outer(n, n), np.maximum.outer(n, n)
        fits = (common + np.maximum.outer(rest, rest) >= similarity * np.sqrt(least * most) - 1e-6) & (least >= similarity * similarity * most - 1e-6)
        fits &= (common > 0) & np.not_equal.outer(root, root) & np.less.outer(node, node)
        if i[0] != j[0]:
            fits &= np.not_equal.outer(block, block)
        x, y = np.nonzero(fits)
        return pa.table({"a": node[x], "b": node[y]})

    return dealt_to.groupBy("label", "i", "j").applyInArrow(count, LONG("a", "b"))


def similar_roots(rows: DataFrame, found: DataFrame, shingle_words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """rows: file, at, doc_id, text; found: their wide fingerprints. fp, size (rows with it) and root (the node that names
    its component: all that are reachable over links, which are all pairs of sets that have the similarity)."""
    of_set = F.first(F.struct("file", "at", "n", "wide")).alias("of_set")
    nodes = cut(found.groupBy("fp").agg(F.count("*").alias("size"), of_set).select("fp", "size", "of_set.*"))
    wordy = nodes.where("n > 0")
    told = similar_links(wordy.select(F.col("fp").alias("node"), F.col("wide").alias("fp")), similarity)
    told = cut(told)
    release(nodes)
    nearest = told.withColumn("nearest", F.row_number().over(Window.partitionBy("b").orderBy("differ", "a"))).where(F.col("nearest") <= NEAREST)
    links = similar_sets(nearest, nodes, rows, shingle_words, similarity)
    linked = components(links)
    known = cut(wordy.join(linked, wordy["fp"] == linked["node"], "left").select(F.col("fp").alias("node"), "n", F.coalesce("root", "fp").alias("root")))
    release(nodes)
    missed = cut(missed_pairs(rows, found.count(), known, shingle_words, similarity))
    release(nodes)
    missed = similar_sets(missed, nodes, rows, shingle_words, similarity)
    linked = components(links.union(missed))
    return cut(nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "size", F.coalesce("root", "fp").alias("root")))


def placed(docs: DataFrame) -> DataFrame:
    """file, at, doc_id, text of docs as keyed() gives them."""
    return docs.select("file", "at", in_row("doc_id").alias("doc_id"), in_row("text").alias("text"))


def rooted(found: DataFrame, pair_bound: int = PAIR_BOUND) -> DataFrame:
    """found: rows with fp. fp, size (rows with it) and root (the fingerprint that names its component)."""
    nodes = cut(found.groupBy("fp").agg(F.count("*").alias("size")))
    of_links = components(links(nodes, pair_bound))
    return cut(nodes.join(of_links, nodes["fp"] == of_links["node"], "left").select("fp", "size", F.coalesce("root", "fp").alias("root")))


def near_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, pair_bound: int = PAIR_BOUND) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 lowercase hex digits), component_id.

    Documents link when their fingerprints differ in two or fewer bits; component_id is the smallest doc_id that is
    reachable over links, the document's own included. Copies share a fingerprint and take part in the search once.
    Null and empty texts, and texts of blanks only, have fingerprint zero and link like any other. Rows without an id
    get the component's id but never give it. Repeated rows each come back. Columns other than doc_id and text play no
    part. An empty table gives no rows."""
    found = cut(fingerprints(ids_and_texts(docs), shingle_words))
    named = with_least(found, F.col("doc_id"), rooted(found, pair_bound))
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def with_least(found: DataFrame, value: Column, roots: DataFrame) -> DataFrame:
    """found with least, the smallest of the values in a row's component. Fingerprints of many rows, and components of
    many fingerprints, are summed up where they lie."""
    total = found.count()
    of_print = found.groupBy("fp").agg(F.min(value).alias("value")).join(roots, "fp")
    of_root = of_print.groupBy("root").agg(F.min("value").alias("least"), F.count("*").alias("prints"))
    named = cut(join_sized(roots, of_root, ["root"], "inner", "prints", total).select("fp", "size", "least"))
    return join_sized(found, named, ["fp"], "inner", "size", total)


def similar_groups(docs: DataFrame, shingle_words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of docs: doc_id, component_id, of documents whose sets of shingles have a cosine of `similarity` or more:
    all such pairs link, and no others. Shingles, and sets of them, are told apart by hashes of 64 bits. Texts without words
    are one component. Nulls, empty texts, repeats and empty tables as in near_groups()."""
    rows = placed(keyed(docs))
    found = cut(wide_fingerprints(rows, shingle_words))
    return with_least(found, F.col("doc_id"), similar_roots(rows, found, shingle_words, similarity)).select("doc_id", F.col("least").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Of the rows of each component of similar documents one, with all its columns: that with the smallest doc_id; of
    several with this id any one. See similar_groups().

    Rows are dropped, not ids. A row without an id stays if no row of its component has one. Null texts count as empty,
    and texts without words are one component. Columns may have any names. An empty table gives no rows."""
    rows = keyed(docs)
    found = cut(wide_fingerprints(placed(rows), shingle_words))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "at")
    gone = with_least(found, place, similar_roots(placed(rows), found, shingle_words, similarity)).where("file <> least.file OR at <> least.at").select("file", "at")
    return rows.join(gone, ["file", "at"], "left_anti").select("row.*")
