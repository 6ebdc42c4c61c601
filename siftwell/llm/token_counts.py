"""Exact token counts of byte-level BPE by a compiled finite-state transducer.

A text is split by a local automaton over character classes (whether a piece begins at a character depends on at
most three neighbours), and a deterministic transducer reads the bytes of each piece. Its state says, for every
suffix of the bytes read that may still grow into a token, which token ended before that suffix and how many
tokens ago. A transition is annotated with the change of the token count; the sum over a piece is the number of
its tokens. Transitions are compiled when first met and kept in a dense table.

Texts are cut into chunks of equal length that are all read at once. A chunk's map from entry state to exit state
is constant behind the first piece boundary in it, so chunks are read from there, and what stands before it is read
from the exit state of the chunk before. Chunks without a boundary have real maps: from each state in which the chunk
before may end to an exit state and a number of tokens. They are built for all such chunks at once, beginning with one
guess, until every exit has its place in the next map, and a parallel prefix scan composes them by doubling. Since maps
soon forget where they began, or go round, few states are tried; were that not so, each chunk would be read once for
each state, which bounds the work by the square of the chunks of one piece."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siftwell.llm.common import ids_and_texts, sliced, utf8

CHUNK = 1024
#: Beyond so many states the table is compiled anew: it bounds a worker's memory, not what is counted.
MAX_STATES = 200_000
SPACE, BLANK, LETTER, NUMBER, OTHER, EDGE = range(6)
ROOT, UNKNOWN = 0, 1
#: Unicode White_Space but for the space itself.
BLANKS = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8)
    out[BLANKS], out[32] = BLANK, SPACE
    return out


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the others come from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Transducer:
    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            data = json.load(f)
        byte = byte_alphabet()
        as_bytes = lambda token: bytes(byte[c] for c in token)
        self.specials = [a["content"].encode() for a in data["added_tokens"]]
        special_ids = {a["id"] for a in data["added_tokens"]}
        self.tokens = {as_bytes(t): k for t, k in data["model"]["vocab"].items() if k not in special_ids}
        self.spelled = {k: t for t, k in self.tokens.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
        self.rank = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(pairs)}
        self.next: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for spelled, k in self.tokens.items():
            node = 0
            for b in spelled:
                if b not in self.next[node]:
                    self.next[node][b] = len(self.next)
                    self.next.append({})
                    self.token_at.append(-1)
                node = self.next[node][b]
            self.token_at[node] = k
        self.adjoin: dict[tuple[int, int], bool] = {}
        self.restart()

    def restart(self) -> None:
        self.states = [((0, -1, 0),), ()]
        self.known = {s: k for k, s in enumerate(self.states)}
        self.columns = np.full(256, -1, np.int32)
        self.used: list[int] = []
        self.table = np.full((4096, 96), -1, np.int32)
        self.table[UNKNOWN] = UNKNOWN << 4 | 8

    def merged(self, word: bytes) -> list[bytes]:
        """The tokens of one piece by repeated merging, lowest rank first."""
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > 1:
            rank, k = min((self.rank.get((parts[k], parts[k + 1]), 1 << 30), k) for k in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def may_follow(self, before: int, token: int) -> bool:
        """Whether the two tokens (before: -1 at the start) stand side by side in the tokens of their joint bytes."""
        if (before, token) not in self.adjoin:
            if len(self.adjoin) > 2_000_000:
                self.adjoin.clear()
            pair = [self.spelled[k] for k in (before, token) if k >= 0]
            self.adjoin[before, token] = self.merged(b"".join(pair)) == pair
        return self.adjoin[before, token]

    def compile(self, state: int, byte: int) -> int:
        """The transition's entry: the next state above, the change of the count plus 8 in the lowest four bits."""
        grown, last = [], None
        for node, before, ago in self.states[state]:
            child = self.next[node].get(byte)
            if child is not None:
                token = self.token_at[child]
                if last is None and token >= 0 and self.may_follow(before, token):
                    last = (token, 1 - ago)
                if self.next[child]:
                    grown.append((child, before, ago))
        token, change = last
        new = (*((child, before, ago + change) for child, before, ago in grown), (0, token, 0))
        if new not in self.known:
            self.known[new] = len(self.states)
            self.states.append(new)
            if len(self.states) > len(self.table):
                self.table = np.concatenate([self.table, np.full((len(self.table) // 4, self.table.shape[1]), -1, np.int32)])
        return self.known[new] << 4 | change + 8

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        entry = self.table[state, column]
        if (entry < 0).any():
            for s, c in {*zip(state[entry < 0].tolist(), column[entry < 0].tolist())}:
                self.table[s, c] = self.compile(s, self.used[c])  # compile may move the table
            entry = self.table[state, column]
        return entry

    def columns_of(self, raw: np.ndarray) -> np.ndarray:
        for b in np.flatnonzero(np.bincount(raw, minlength=256)):
            if self.columns[b] < 0:
                self.columns[b] = len(self.used)
                self.used.append(int(b))
                if len(self.used) > self.table.shape[1]:
                    self.table = np.concatenate([self.table, np.full((len(self.table), 16), -1, np.int32)], axis=1)
                self.table[UNKNOWN] = UNKNOWN << 4 | 8
        return self.columns[raw]

    def compose(self, columns: np.ndarray, whole: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and changes of the count of the chunks in `whole`, which have no boundary. state: exits of the others."""
        inner = np.isin(whole - 1, whole)  # the chunk before has none, either
        lanes, entries = [whole], [np.where(inner, ROOT, state[whole - 1])]
        exits, totals = [], []
        known = {pair: k for k, pair in enumerate(zip(whole.tolist(), entries[0].tolist()))}
        follows = set(whole[inner].tolist())
        while len(lanes) > len(exits):
            at, lane = entries[-1].astype(np.int32), lanes[-1]
            total = np.zeros(len(lane), np.int64)
            for k in range(CHUNK):
                entry = self.step(at, columns[k, lane])
                total += (entry & 15) - 8
                at = entry >> 4
            exits.append(at)
            totals.append(total)
            new = {(c + 1, e): None for c, e in zip(lane.tolist(), at.tolist()) if c + 1 in follows and (c + 1, e) not in known}
            if new:
                known |= {pair: len(known) + k for k, pair in enumerate(new)}
                lanes.append(np.array([c for c, _ in new]))
                entries.append(np.array([e for _, e in new]))
        exit_of, total_of, lane_of = np.concatenate(exits), np.concatenate(totals), np.concatenate(lanes)
        jump = np.array([known.get((c + 1, e), k) for k, (c, e) in enumerate(zip(lane_of.tolist(), exit_of.tolist()))])
        first = np.flatnonzero(~inner)
        back = np.arange(len(whole)) - np.repeat(first, np.diff(np.append(first, len(whole))))  # chunks since the known entry
        taken = np.arange(len(whole)) - back
        while back.any():  # a map of 1, 2, 4, ... chunks where the distance has that bit
            taken = np.where(back & 1, jump[taken], taken)
            jump, back = jump[jump], back >> 1
        return exit_of[taken], total_of[taken]

    def changes(self, raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The change of the count at each byte; in a chunk without a boundary all of it stands at the first."""
        if len(self.states) > MAX_STATES:
            self.restart()
        lanes = -(-len(raw) // CHUNK)
        columns = np.zeros(lanes * CHUNK, np.int32)
        columns[: len(raw)] = self.columns_of(raw)
        starts = np.ones(lanes * CHUNK, bool)  # what fills up the last chunk is pieces that are not read
        starts[: len(raw)] = begins
        columns, starts = columns.reshape(lanes, CHUNK).T.copy(), starts.reshape(lanes, CHUNK).T.copy()
        out = np.zeros((CHUNK, lanes), np.int16)
        state = np.full(lanes, UNKNOWN, np.int32)
        for k in range(CHUNK):
            state[starts[k]] = ROOT
            entry = self.step(state, columns[k])
            out[k] = (entry & 15) - 8
            state = entry >> 4
        head = np.where(starts.any(0), starts.argmax(0), CHUNK)
        whole = np.flatnonzero(head == CHUNK)
        if len(whole):
            state[whole], out[0, whole] = self.compose(columns, whole, state)
        part = np.flatnonzero((head > 0) & (head < CHUNK))
        inner = state[part - 1]
        for k in range(int(head[part].max(initial=0))):
            live = head[part] > k
            entry = self.step(inner[live], columns[k, part[live]])
            out[k, part[live]] = (entry & 15) - 8
            inner[live] = entry >> 4
        return out.T.reshape(-1)[: len(raw)]

    def counts(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tokens of each text; at: where the texts begin in raw, and the end."""
        if not len(raw):
            return np.zeros(len(at) - 1, np.int64)
        begins, special, extra = piece_starts(raw, at, self.specials)
        change = self.changes(raw, begins).astype(np.int64)
        change[special] = 0
        change[extra] = 1
        sums = np.concatenate([[0], np.cumsum(change)])
        return sums[at[1:]] - sums[at[:-1]]


def piece_starts(raw: np.ndarray, at: np.ndarray, specials: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At which bytes a piece begins; which bytes belong to special strings; where those begin."""
    whole = raw.tobytes()
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    points = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes()[points]
    special, extra = np.zeros(len(raw), bool), []
    for s in specials:
        place = whole.find(s)
        while place >= 0:
            if np.searchsorted(at, place, "right") == np.searchsorted(at, place + len(s) - 1, "right"):  # not across two texts
                special[place : place + len(s)] = True
                extra.append(place)
                place = whole.find(s, place + len(s))
            else:
                place = whole.find(s, place + 1)
    if extra:
        kind = np.where(special[first], EDGE, kind)
    text_start = np.zeros(len(raw) + 1, bool)
    text_start[at] = True
    head = text_start[:-1][first]
    tail = np.append(head[1:], True)
    before = np.concatenate([[EDGE], kind[:-1]])
    before[head] = EDGE
    after = np.append(kind[1:], EDGE)
    after[tail] = EDGE
    blank, was_blank = kind <= BLANK, before <= BLANK
    ends_blanks = (after > BLANK) & (after != EDGE)
    begin = (before == EDGE) | (kind == EDGE) | np.where(blank, ~was_blank | ends_blanks, np.where(was_blank, before == BLANK, kind != before))
    mark = np.flatnonzero((points == 39) & ((before == LETTER) | (before == NUMBER) | (before == BLANK) | (before == EDGE)) & (kind != EDGE))
    if len(mark):
        ended = np.cumsum(head)
        padded = np.append(points, [0, 0, 0])
        text = np.append(ended, [-1, -1, -1])
        one, two = padded[mark + 1], padded[mark + 2]
        short = np.isin(one, [ord(c) for c in "stmd"]) & (text[mark + 1] == text[mark])
        pair = one.astype(np.int64) << 32 | two
        long = np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")]) & (text[mark + 2] == text[mark])
        begin = np.append(begin, [True, True, True])
        begin[mark[short] + 1] = False
        begin[mark[short] + 2] = True
        begin[mark[long] + 1] = begin[mark[long] + 2] = False
        begin[mark[long] + 3] = True
        begin = begin[: len(points)]
    out = np.zeros(len(raw), bool)
    out[first[begin]] = True
    return out, special, np.array(extra, np.int64)


@lru_cache(2)
def transducer(file: str) -> Transducer:
    return Transducer(file)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])


def count_tokens(docs: DataFrame, file: str, limit: int = 512) -> DataFrame:
    """Per row of docs: doc_id, n_bytes (UTF-8), n_tokens as the library gives them for this vocabulary (a byte-level
    BPE .json), over_limit (n_tokens > limit). file must be readable at the same path on every executor.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids each give a row. Texts are read whole,
    however long; a batch is cut into chunks wherever its texts begin. An empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(file)
        for batch in sliced(batches, 1):
            raw, at = utf8(batch.column(1))
            n = machine.counts(raw, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return ids_and_texts(docs).mapInArrow(run, SCHEMA)
