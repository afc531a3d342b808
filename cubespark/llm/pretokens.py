"""Byte-level BPE: pre-tokens by array operations, and ids by a table of distinct words.

The split is that of the pattern ``public_tokenizers.PATTERN`` (English
contractions; letters, digits or other signs, each with one space before them;
white space).  Its outcome depends only on maximal runs of one class of
characters and on the character at either end of a run, so that it needs no
regular-expression engine: a few comparisons of neighbouring bytes find all
boundaries of a block at once.
"""

from __future__ import annotations

import functools
import json
import struct

import numpy as np
import pyarrow as pa
import regex

from .blocks import Block, ragged

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: What follows an apostrophe in a contraction (fixed by the pattern).
SHORT, LONG = b"stmd", (b"re", b"ve", b"ll")


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, points):
            a, b = (x + 0x800 * (x >= 0xD800) for x in m.span())
            table[a:b] = kind
    return table


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte of UTF-8 belongs to."""
    table = class_table()
    kind = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        point = first & np.array([0x1F, 0x0F, 0x07])[size - 2]
        for k in (1, 2, 3):
            more = size > k
            point = np.where(more, point << 6 | (padded[lead + k] & 0x3F), point)
        found = table[point]
        kind[lead] = found
        for k in (1, 2, 3):
            more = size > k
            kind[lead[more] + k] = found[more]
    return kind


def pretoken_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Byte offsets at which pre-tokens start; edges: where texts start, in order, and the end of the last."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(data)
    begins = np.zeros(n + 1, bool)
    begins[edges] = True  # a text's start, or one past the end
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= begins[:n]
    space = kind == SPACE
    # A run of white space: its first character starts a token, and its last one if the text goes on.
    run_after = new & ~space & ~begins[:n]
    at = np.flatnonzero(run_after)
    at = at[space[at - 1]]  # runs that stand behind white space
    last = at - 1
    while (more := (data[last] & 0xC0) == 0x80).any():
        last = last - more
    starts = new.copy()
    starts[last] = True
    starts[at[data[at - 1] == 32]] = False  # the space belongs to the run
    # Contractions: an apostrophe that starts a token and stands alone before letters.
    quote = np.flatnonzero((data == 39) & starts)
    quote = quote[quote + 1 < n]
    quote = quote[~begins[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, np.frombuffer(SHORT, np.uint8))
        long = np.zeros(len(quote), bool)
        for a, b in LONG:
            long |= (one == a) & (two == b)
        long &= ~begins[np.minimum(quote + 2, n)]
        for found, size in ((quote[short], 2), (quote[long], 3)):
            starts[found + 1] = False
            nxt = found + size
            starts[nxt[nxt < n]] = True
    return np.flatnonzero(starts)


class ByteBpe:
    """The vocabulary of a byte-level BPE file, with the ids of single words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        self.units = byte_units()
        back = {u: bytes([i]) for i, u in enumerate(self.units)}
        self.ids = {b"".join(back[c] for c in piece): i for piece, i in model["vocab"].items()}
        self.merges = [tuple(b"".join(back[c] for c in x) for x in (m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        self.size = 1 + max([*self.ids.values(), *self.special.values()])
        self.pieces: list[bytes] = [b""] * self.size
        for piece, i in [*self.ids.items(), *self.special.items()]:
            self.pieces[i] = piece
        # Rank-ordered merging of any pair that spells a piece gives the listed merges' result if
        # ids follow the order of the merges; the quicker encoder is taken only where they do.
        ranks = [self.ids[a + b] for a, b in self.merges]
        if ranks == sorted(set(ranks)) and all(self.ids[bytes([b])] < ranks[0] for b in range(256)):
            import tiktoken

            self.encode = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=self.ids, special_tokens={})._core_bpe.encode_single_piece
        else:
            tokenize, alphabet = Tokenizer.from_file(path).model.tokenize, str.maketrans({chr(i): u for i, u in enumerate(self.units)})
            self.encode = lambda word: [t.id for t in tokenize(word.decode("latin-1").translate(alphabet))]

    def word_ids(self, word: bytes) -> list[int]:
        """Ids of one pre-token, or of a special string."""
        found = self.special.get(word)
        if found is not None:
            return [found]
        found = self.ids.get(word)
        return self.encode(word) if found is None else [found]


def byte_units() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def special_edges(block: Block, special: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray | None]:
    """(where texts and special strings start and end, in order; the bytes inside special strings, or None)."""
    edges, inner, raw = [block.offsets], [], None
    for s in special:
        raw = block.data.tobytes() if raw is None else raw
        at, found = raw.find(s), []
        while at >= 0:
            row = np.searchsorted(block.offsets, at, side="right")
            if at + len(s) <= block.offsets[row]:
                found.append(at)
                at = raw.find(s, at + len(s))
            else:  # across two texts
                at = raw.find(s, at + 1)
        if found:
            spans = np.array(found)[:, None] + np.arange(len(s))
            inner.append(spans[:, 1:].ravel())
            edges += [spans[:, 0], spans[:, -1] + 1]
    return np.unique(np.concatenate(edges)), np.concatenate(inner) if inner else None


def split_block(block: Block, special: tuple[bytes, ...]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pre-tokens of a block as a dictionary-coded array, and how many each row has.

    Special strings are words of their own, as the tokenizers library takes them by default.
    """
    edges, inner = special_edges(block, special)
    starts = pretoken_starts(block.data, edges)
    if inner is not None:
        starts = starts[~np.isin(starts, inner)]
    bounds = np.append(starts, len(block.data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(block.data))])
    return words.dictionary_encode(), np.diff(np.searchsorted(starts, block.offsets))


class WordIds:
    """Ids of whole blocks: each distinct word is looked up once a block, and encoded once while it is remembered."""

    def __init__(self, path: str, remember: int = 400_000):
        self.bpe, self.remember, self.known = byte_bpe(path), remember, {}

    def packed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of the words, one after the other."""
        known, encode = self.known, self.bpe.word_ids
        if len(known) > self.remember:
            known.clear()
        found = list(map(known.get, words))
        for i, ids in enumerate(found):
            if ids is None:
                w = words[i]
                found[i] = known[w] = struct.pack(f"<{len(e := encode(w))}I", *e)
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) >> 2

    def block_ids(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after the other, how many each row has)."""
        words, counts = split_block(block, tuple(self.bpe.special))
        ids, sizes = self.packed(words.dictionary.to_pylist())
        return place_ids(ids, sizes, words.indices.to_numpy(), counts)


def place_ids(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids by position: word codes[i] has sizes[code] ids in ``ids``; rows have counts words."""
    first = np.cumsum(sizes) - sizes
    lengths = sizes[codes]
    total = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.cumsum(counts)
    return ragged(ids, first[codes], lengths), total[ends] - total[ends - counts]
