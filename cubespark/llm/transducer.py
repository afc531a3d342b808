"""Token counts by a deterministic transducer, compiled on demand.

Reading a text character by character, the transducer is in one of finitely
many states; every transition carries the number of tokens that it adds to (or,
where a longer piece replaces shorter ones, takes from) the count of the text
read so far.  The sum of the annotations is the count at any point, so no token
is ever written out.

A state has two parts.

* What pre-token the text is in: a run of letters, digits, signs or white
  space, the last white-space character being held back (it may belong to what
  follows), or an apostrophe that may begin a contraction.
* Where merging stands in that pre-token.  In rank-ordered merging a sequence
  of pieces is the encoding of its bytes exactly if every two neighbours are
  what merging makes of the two together, so the last piece of each prefix is
  unique.  The state keeps each start from which the bytes read are still the
  beginning of some piece: the place in the tree of pieces, the last piece
  before that start, and the count there relative to now.

States are made when first entered and remembered (as lazily determinised
automata do); beyond ``remember`` of them the table starts anew.

Some characters are *resets*: white space behind another kind of character, and a number or
sign behind a letter.  Behind them every state is the same one, whatever was before, so a text
falls into segments that count alike wherever they stand.  A block of texts is cut at its
resets by array operations, and each distinct segment runs through the transducer once.

Texts of more than ``chunk`` characters are cut in chunks, which are dealt out to tasks as rows
of their own.  A chunk's *state map* says where each entry state leads: it is the characters up
to the chunk's first reset (its head), the count behind that and the exit state.  Maps compose
associatively; a prefix scan by halves over a text's maps, which are few and small, gives the
map of every prefix, and the last one's value at the initial state is the count.  A chunk
without a reset is all head: such texts are read in the task that composes them.

Null texts count as empty: no bytes, no tokens.  Repeated rows repeat their counts; null
doc_ids stay; very long texts are counted in full; empty tables give empty tables; extra columns
stay out.
"""

from __future__ import annotations

import bisect
import functools
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, as_rows, blocks_of, renamed, stored
from .pretokens import LETTER, LONG, NUMBER, OTHER, SHORT, SPACE, ByteBpe, byte_bpe, byte_classes, class_table, special_edges

COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
COUNTS_DDL = "doc_id bigint, n_bytes bigint, n_tokens bigint"
#: A document that is counted (row is null), or a chunk of a long one; n_tokens of a chunk: special strings before it.
CUT = pa.schema([*COUNTS, ("row", pa.int64()), ("segment", pa.int64()), ("part", pa.int64()), ("piece", pa.string())])
CUT_DDL = f"{COUNTS_DDL}, row bigint, segment bigint, part bigint, piece string"
MAPS = pa.schema([*list(CUT)[:6], ("head", pa.string()), ("added", pa.int64()), ("out", pa.binary())])
MAPS_DDL = f"{COUNTS_DDL}, row bigint, segment bigint, part bigint, head string, added bigint, out binary"
#: Characters of a chunk; texts up to one chunk are counted where they are read.
CHUNK = 1 << 16
#: Nodes with at most so many pieces below them look through those for what tells left neighbours apart.
NARROW = 40


class MergeAutomaton:
    """Counts the pieces of a pre-token's prefixes; its states are tuples (node, last piece before, count relative to now)."""

    def __init__(self, bpe: ByteBpe):
        self.children: list[dict[int, int]] = [{}]
        self.piece: list[int] = [-1]
        for word, i in bpe.ids.items():
            node = 0
            for b in word:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][b] = nxt
                    self.children.append({})
                    self.piece.append(-1)
                node = nxt
            self.piece[node] = i
        ids = bpe.ids
        self.piece_ids = range(1 + max(ids.values()))
        #: ranks of merges by left and right piece; the two parts by the piece; a piece's rank (-1: a single byte).
        self.merges: dict[int, dict[int, int]] = {}
        for r, (a, b) in enumerate(bpe.merges):
            self.merges.setdefault(ids[a], {})[ids[b]] = r
        self.parts = {ids[a + b]: (ids[a], ids[b]) for a, b in bpe.merges}
        self.born = {ids[a + b]: r for r, (a, b) in enumerate(bpe.merges)}
        self.apart: dict[tuple[int, int], bool] = {}
        self.lefts, self.rights, self.lower = {}, {}, {}
        self.under = [0] * len(self.children)  # how many pieces stand below a node
        for node in range(len(self.children) - 1, -1, -1):  # children have greater numbers
            self.under[node] = sum(self.under[c] + (self.piece[c] >= 0) for c in self.children[node].values())
        self.alike = self._classes()
        self.narrow: dict[tuple[int, int], int] = {}
        self.named: dict[tuple, int] = {}

    def _classes(self) -> dict[int, int]:
        """Of pieces that stay apart from the same right neighbours, one for all of them.

        What a left neighbour can do is told by the merges that each piece at its right end can
        still be the left part of; pieces with the same such merges are alike.
        """
        merges = {a: sorted(some.values()) for a, some in self.merges.items()}
        first, out = {}, {}
        for piece in self.piece_ids:
            able = tuple((a, n) for a, end in self._edge(piece, 1) if (n := bisect.bisect_left(merges.get(a, []), end)))
            out[piece] = first.setdefault(able, piece)
        return out

    def _below(self, node: int) -> list[int]:
        """The pieces below a node that has few of them."""
        found = self.lower.get(node)
        if found is None:
            found, todo = [], list(self.children[node].values())
            while todo:
                n = todo.pop()
                if self.piece[n] >= 0:
                    found.append(self.piece[n])
                todo += self.children[n].values()
            self.lower[node] = found
        return found

    def _narrowed(self, node: int, last: int) -> int:
        """One for all pieces that the pieces below ``node`` tell apart from ``last`` in no way; -2 if none below can follow it."""
        found = self.narrow.get((node, last))
        if found is None:
            able = tuple(p for p in self._below(node) if last < 0 or self.stays_apart(last, p))
            found = self.named.setdefault((node, able), last) if able else -2
            if len(self.narrow) > 300_000:
                self.narrow.clear()
                self.named.clear()
            self.narrow[node, last] = found
        return found

    def _edge(self, piece: int, side: int) -> list[tuple[int, float]]:
        """The pieces that stand at one end of ``piece`` while it is built, each with the rank of the merge that ends it."""
        out, until = [(piece, float("inf"))], None
        while piece in self.parts:
            until = self.born[piece]
            piece = self.parts[piece][side]
            out.append((piece, until))
        return out

    def _lefts(self, piece: int) -> list[tuple[dict[int, int], float, int]]:
        """Of each piece at the right end of ``piece``: its merges by the right part, the rank that ends it and the one that began it."""
        found = self.lefts.get(piece)
        if found is None:
            found = self.lefts[piece] = [(self.merges[a], end, self.born.get(a, -1)) for a, end in self._edge(piece, 1) if a in self.merges]
        return found

    def _rights(self, piece: int) -> list[tuple[int, float, int]]:
        found = self.rights.get(piece)
        if found is None:
            found = self.rights[piece] = [(b, end, self.born.get(b, -1)) for b, end in self._edge(piece, 0)]
        return found

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both pieces together gives these two pieces again."""
        known = self.apart.get((left, right))
        if known is None:
            known, rights = True, self._rights(right)
            for merges, a_end, a_born in self._lefts(left):
                for b, b_end, b_born in rights:
                    r = merges.get(b)
                    # Both stand at the border when rank r is merged; of equal ranks the left one goes first.
                    if r is not None and a_born < r < a_end and b_born < r <= b_end:
                        known = False
                        break
                if not known:
                    break
            if len(self.apart) > 500_000:
                self.apart.clear()
            self.apart[left, right] = known
        return known

    START = ((0, -1, 0),)

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """(next state, tokens added)."""
        live, found = [], None
        for node, last, count in state:
            nxt = self.children[node].get(byte)
            if nxt is None:
                continue
            live.append((nxt, last, count))
            piece = self.piece[nxt]
            if piece >= 0 and found is None and (last < 0 or self.stays_apart(last, piece)):
                found = (piece, count + 1)
        piece, added = found
        out = []
        for node, last, count in live:
            if self.under[node]:
                if self.under[node] <= NARROW:
                    last = self._narrowed(node, last)
                    if last == -2:
                        continue
                out.append((node, last, count - added))
        out.append((0, self.alike[piece], 0))
        return tuple(out), added

    def feed(self, state: tuple, text: str) -> tuple[tuple, int]:
        total = 0
        for byte in text.encode():
            state, added = self.step(state, byte)
            total += added
        return state, total


#: What the text stands in.  RUN: a run of a class; BLANK: white space whose last character is held back;
#: QUOTE: an apostrophe that starts a token; QUOTE2: an apostrophe and the first letter of a longer contraction; FRESH: a token's end.
FRESH, RUN, BLANK, QUOTE, QUOTE2 = range(5)


class State(dict):
    """Transitions by character: (next state, tokens added)."""

    __slots__ = ("owner", "key")

    def __missing__(self, char):
        nxt, added = self.owner.move(self.key, char)
        found = self[char] = (self.owner.state(nxt), added)
        return found


class CountTransducer:
    """key of a state: (what, class, merge state, tokens of the open part as counted so far beyond the merge state, held text)."""

    def __init__(self, bpe: ByteBpe, remember: int = 120_000):
        self.merging = MergeAutomaton(bpe)
        self.special = {k.decode(): v for k, v in bpe.special.items()}
        self.special_bytes = tuple(bpe.special)
        self.remember, self.states, self.known = remember, {}, {}  # of segments three times as many are known
        self.initial = (FRESH, 0, (), "")
        self.kinds = class_table()

    def state(self, key: tuple) -> State:
        found = self.states.get(key)
        if found is None:
            if len(self.states) >= self.remember:
                for s in self.states.values():  # lets go of the links between them
                    s.clear()
                self.states.clear()
            found = self.states[key] = State()
            found.owner, found.key = self, key
        return found

    def _open(self, before: str, char: str) -> tuple[tuple, int]:
        """A token that starts with ``before`` (a space or nothing) and char; (key, its tokens)."""
        kind = int(self.kinds[ord(char)])
        merge, n = self.merging.feed(MergeAutomaton.START, before + char)
        if char == "'" and not before:
            return (QUOTE, kind, merge, ""), n
        return (RUN, kind, merge, ""), n

    def _blank(self, closed: tuple, held: str) -> int:
        """Tokens of a run of white space, closed without its last character ``held``, if it ended here."""
        return self.merging.feed(closed, held)[1]

    def move(self, key: tuple, char: str) -> tuple[tuple, int]:
        what, kind, merge, held = key
        feed, start = self.merging.feed, MergeAutomaton.START
        new = int(self.kinds[ord(char)])
        if what == QUOTE2:  # an apostrophe (counted) and the letter ``held`` (counted as a token of its own)
            if (held + char).encode() in LONG:
                one = feed(start, "'" + held + char)[1]
                return (FRESH, 0, (), ""), one - feed(start, "'")[1] - feed(start, held)[1]
            what, kind = RUN, LETTER
        if what == QUOTE:
            if new == LETTER and char.encode() in [bytes([c]) for c in SHORT]:
                return (FRESH, 0, (), ""), feed(start, "'" + char)[1] - feed(start, "'")[1]
            if new == LETTER and char in {x[:1].decode() for x in LONG}:
                letters, n = feed(start, char)
                return (QUOTE2, LETTER, letters, char), n
            what = RUN
        if what == RUN and new == kind:
            merge, added = feed(merge, char)
            return (RUN, kind, merge, ""), added
        if new == SPACE:
            if what == BLANK:
                before = self._blank(merge, held)
                closed, n = feed(merge, held)
                # Tokens of the closed part are counted; the merge state goes on as if the run ended with char.
                return (BLANK, SPACE, closed, char), n + self._blank(closed, char) - before
            return (BLANK, SPACE, start, char), self._blank(start, char)
        if what == BLANK:
            before = self._blank(merge, held)
            if held == " ":
                nxt, n = self._open(held, char)
                return nxt, n - before
            nxt, n = self._open("", char)
            return nxt, feed(start, held)[1] + n - before
        return self._open("", char)

    def run(self, key: tuple, text: str) -> tuple[int, tuple]:
        """(tokens added, exit state's key)."""
        state, total = self.state(key), 0
        for char in text:
            state, added = state[char]
            total += added
        return total, state.key

    def of_segment(self, segment: bytes) -> int:
        """Tokens of a segment (or of a special string)."""
        found = self.known.get(segment)
        if found is None:
            if len(self.known) >= 3 * self.remember:
                self.known.clear()
            found = self.known[segment] = 1 if segment in self.special_bytes else self.run(self.initial, segment.decode())[0]
        return found

    def block_counts(self, block: Block) -> np.ndarray:
        """Tokens of every row of a block: each distinct segment is run once."""
        edges, inner = special_edges(block, self.special_bytes)
        starts = segment_starts(block.data, edges)
        if inner is not None:
            starts = starts[~np.isin(starts, inner)]
        bounds = np.append(starts, len(block.data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(block.data))]).dictionary_encode()
        tokens = np.fromiter(map(self.of_segment, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        total = np.concatenate([[0], np.cumsum(tokens[words.indices.to_numpy()])])
        at = np.searchsorted(starts, block.offsets)
        return total[at[1:]] - total[at[:-1]]

    def parts(self, text: str) -> list[str]:
        """The text between special strings."""
        rest = [text]
        for s in self.special:
            rest = [x for p in rest for x in p.split(s)]
        return rest

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text by the maps of its chunks; special strings in it are one token each and end what stands before."""
        parts = self.parts(text)
        return len(parts) - 1 + sum(self.value(self.scan([self.chunk_map(p[i : i + chunk]) for i in range(0, len(p), chunk)])[-1]) for p in parts if p)

    def chunk_map(self, text: str) -> ChunkMap:
        """The state map of a chunk without special strings."""
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        starts = segment_starts(data, np.array([0, len(raw)]))[1:].tolist()
        if not starts:
            return ChunkMap(text, 0, None)
        segments = [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)])]
        char = segments[0].decode()[0]  # the reset is read with the head, whatever the entry state
        counted = sum(map(self.of_segment, segments[:-1]))
        added, out = self.run(self.initial, segments[-1].decode())
        return ChunkMap(raw[: starts[0]].decode() + char, counted + added - self.move(self.initial, char)[1], out)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First a, then b."""
        if a.out is None:
            return ChunkMap(a.head + b.head, b.added, b.out)
        added, out = self.run(a.out, b.head)
        return ChunkMap(a.head, a.added + added + b.added, b.out or out)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """The composition of every prefix: neighbours are composed, the scan of the pairs gives every second prefix, one step more the others."""
        if len(maps) < 2:
            return maps
        pairs = self.scan([self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])])
        return [maps[0], *(pairs[i // 2] if i % 2 else self.compose(pairs[i // 2 - 1], maps[i]) for i in range(1, len(maps)))]

    def value(self, m: ChunkMap) -> int:
        return self.run(self.initial, m.head)[0] + m.added


@dataclass(frozen=True)
class ChunkMap:
    """Where entry states lead: they read ``head``, and then all take ``added`` tokens to the state ``out`` (None: the head is all)."""

    head: str
    added: int
    out: tuple | None


@functools.cache
def transducer(path: str) -> CountTransducer:
    return CountTransducer(byte_bpe(path))


def segment_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Byte offsets of resets and of the starts of texts; edges: where texts start, in order, and the end of the last."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(data)
    starts = np.zeros(n + 1, bool)
    before, now = kind[:-1], kind[1:]
    starts[1:n] = (now == SPACE) & (before != SPACE) | (before == LETTER) & ((now == NUMBER) | (now == OTHER))
    starts[edges] = True
    return np.flatnonzero(starts[:n])


def _cut(batches, path: str, chunk: int):
    """Short texts with their counts; of long ones the chunks."""
    machine, number = transducer(path), TaskContext.get().partitionId() << 32
    for batch in batches:
        doc_ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
        long = pc.greater(pc.utf8_length(texts), chunk).to_numpy(zero_copy_only=False)
        short = pa.array(np.flatnonzero(~long))
        ids = doc_ids.take(short)
        for block in blocks_of(texts.take(short)):
            n = block.rows
            none = pa.nulls(n, pa.int64())
            yield as_rows(CUT, doc_id=ids.slice(block.first, n), n_bytes=np.diff(block.offsets), n_tokens=machine.block_counts(block), row=none, segment=none, part=none, piece=pa.nulls(n, pa.string()))
        for i in np.flatnonzero(long).tolist():
            text, number = texts[i].as_py(), number + 1
            parts = machine.parts(text)
            size, said = len(text.encode()), len(parts) - 1
            places = [(k, at) for k, p in enumerate(parts) for at in range(0, len(p), chunk)] or [(0, 0)]
            for lo in range(0, len(places), 64):
                some = places[lo : lo + 64]
                yield as_rows(CUT, doc_id=[doc_ids[i].as_py()] * len(some), n_bytes=[size] * len(some), n_tokens=[said if lo + j == 0 else 0 for j in range(len(some))], row=[number] * len(some), segment=[k for k, _ in some], part=[at for _, at in some], piece=[parts[k][at : at + chunk] for k, at in some])


def _mapped(batches, path: str):
    machine = transducer(path)
    for batch in batches:
        found = [machine.chunk_map(piece) for piece in batch.column("piece").to_pylist()]
        same = {n: batch.column(n) for n in MAPS.names[:6]}
        yield as_rows(MAPS, **same, head=[m.head for m in found], added=[m.added for m in found], out=[None if m.out is None else pickle.dumps(m.out) for m in found])


def _composed(table: pa.Table, path: str) -> pa.Table:
    """The count of one text from the maps of its chunks."""
    machine, rows = transducer(path), table.sort_by([("segment", "ascending"), ("part", "ascending")]).to_pylist()
    total, by = sum(r["n_tokens"] for r in rows), {}
    for r in rows:
        by.setdefault(r["segment"], []).append(ChunkMap(r["head"], r["added"], None if r["out"] is None else pickle.loads(r["out"])))
    total += sum(machine.value(machine.scan(maps)[-1]) for maps in by.values())
    return pa.table({"doc_id": pa.array([rows[0]["doc_id"]], pa.int64()), "n_bytes": pa.array([rows[0]["n_bytes"]], pa.int64()), "n_tokens": pa.array([total], pa.int64())})


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, as the byte-level BPE file counts them."""
    source = renamed(docs, doc_id, text).select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    # Written once: the counts of short texts, and the chunks of long ones to be dealt out.
    cut = stored(source.mapInArrow(functools.partial(_cut, path=path, chunk=chunk), CUT_DDL), "token-counts")
    dealt = cut.filter("row is not null").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row", "segment", "part")
    composed = dealt.mapInArrow(functools.partial(_mapped, path=path), MAPS_DDL).groupBy("row").applyInArrow(lambda table: _composed(table, path), COUNTS_DDL)
    return cut.filter("row is null").select(*COUNTS.names).unionByName(composed)
