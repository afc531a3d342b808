"""Lossless WebP (VP8L): a decoder for the whole format, and an encoder of 8-bit samples.

The decoder reads simple and normal prefix codes, meta prefix codes, literals,
back-references and the colour cache, and inverts the predictor, cross-colour,
subtract-green and colour-indexing transforms.  Images whose pixels differ in
one channel only and that use no cache - as the encoder writes them - take a
table that yields several literals a look-up, and copy references byte by byte
string; the table is kept by the code lengths that the stream states.

The encoder puts bytes in the green channel of an image 64 samples wide (wider
where the height would pass 16384).  Payloads of few kinds of bytes become a palette
with packed indices.  Others are literals and, where that takes fewer bits, references
to what came before; of a few fixed prefix codes, each for a kind of script, the one
that takes the fewest bits is stated.  So equal bytes give equal files.  Bits are
packed some at a time, so that a long payload is held a few times and not once a bit.
Payloads over 2**28 bytes raise.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np

#: Fixed values of the format: order of the code-length codes; distance codes as (x, y) offsets; alphabet sizes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
LENGTH_CODES, DISTANCES, BLACK = 24, 40, 0xFF000000
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, INDEXING = range(4)
SAMPLES, TALLEST = 64, 1 << 14


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        a = self.at >> 3
        return int.from_bytes(self.data[a : a + 6], "little") >> (self.at & 7) & (1 << n) - 1

    def look(self, at: int, n: int) -> int:
        """Any number of bits from a place on."""
        return int.from_bytes(self.data[at >> 3 : at + n + 7 >> 3], "little") >> (at & 7) & (1 << n) - 1

    def read(self, n: int) -> int:
        found = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return found


def canonical(lengths: tuple[int, ...]) -> dict[int, str]:
    """symbol -> its code as a string of bits in stream order; a single symbol takes no bits."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return {used[0]: ""}
    out, code, before = {}, 0, 0
    for n, s in sorted((lengths[s], s) for s in used):
        code <<= n - before
        before = n
        out[s] = format(code, f"0{n}b")
        code += 1
    if used and code != 1 << before:
        raise ValueError("the code lengths make no complete prefix code")
    return out


@functools.lru_cache(256)
def lookup(lengths: tuple[int, ...]) -> tuple[dict[int, int], int]:
    """(table, width): by the next ``width`` bits, symbol * 16 + the bits that it takes."""
    codes = canonical(lengths)
    if not codes:
        raise ValueError("a prefix code without symbols")
    width = max(len(c) for c in codes.values())
    table = [0] * (1 << width)
    for s, c in codes.items():
        low = int(c[::-1] or "0", 2)
        for high in range(1 << width - len(c)):
            table[low | high << len(c)] = s * 16 + len(c)
    return table, width


class Code:
    def __init__(self, lengths: tuple[int, ...]):
        self.lengths = lengths
        self.table, self.width = lookup(lengths)

    def read(self, bits: Bits) -> int:
        found = self.table[bits.peek(self.width)]
        bits.at += found & 15
        return found >> 4

    def single(self) -> int | None:
        return self.table[0] >> 4 if self.width == 0 else None


def _read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(tuple(lengths))
    inner = [0] * 19
    for i in range(4 + bits.read(4)):
        inner[LENGTH_ORDER[i]] = bits.read(3)
    code = Code(tuple(inner))
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and most:
        most -= 1
        n = code.read(bits)
        if n < 16:
            lengths[at] = n
            before = n or before
            at += 1
            continue
        value, again = (before, 3 + bits.read(2)) if n == 16 else (0, 3 + bits.read(3)) if n == 17 else (0, 11 + bits.read(7))
        if at + again > size:
            raise ValueError("too many code lengths")
        lengths[at : at + again] = [value] * again
        at += again
    return Code(tuple(lengths))


#: Groups of codes that were read lately, by the alphabet sizes and the first bits that state them: (bits, their number, the codes).
_LATELY: dict[tuple, tuple[int, int, list[Code]]] = {}


def _read_codes(bits: Bits, sizes: tuple[int, ...]) -> list[Code]:
    """The five codes of a group; one that is stated by the very bits of a group read before is that group."""
    key = (sizes, bits.peek(32))
    found = _LATELY.get(key)
    if found is not None:
        stated, n, codes = found
        if bits.look(bits.at, n) == stated:
            bits.at += n
            return codes
    start = bits.at
    codes = [_read_code(bits, s) for s in sizes]
    if len(_LATELY) > 256:
        _LATELY.clear()
    n = bits.at - start
    _LATELY[key] = bits.look(start, n), n, codes
    return codes


def _value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = prefix - 2 >> 1
    return (2 + (prefix & 1) << extra) + bits.read(extra) + 1


@functools.lru_cache(64)
def _runs(lengths: tuple[int, ...]) -> tuple[list[bytes], list[int]]:
    """By the next 16 bits: the literals that they hold in full, up to the first other symbol, and the bits that those take."""
    table, width = lookup(lengths)
    single = np.array(table, np.int64)
    v = np.arange(1 << 16)
    used, text = np.zeros(1 << 16, np.int64), np.zeros((1 << 16, 8), np.uint8)
    count = np.zeros(1 << 16, np.int64)
    for k in range(8):
        found = single[(v >> used) & (1 << width) - 1]
        fits = (used + (found & 15) <= 16) & (count == k) & (found < 256 << 4)
        text[fits, k] = found[fits] >> 4
        used[fits] += found[fits] & 15
        count[fits] += 1
    raw = text.tobytes()
    return [raw[8 * i : 8 * i + n] for i, n in enumerate(count.tolist())], used.tolist()


#: Bytes of a stream whose 16-bit windows are held at a time; smaller images are read symbol by symbol, without a table.
WINDOWS, FEW = 1 << 15, 512


def _copied(out: bytearray, back: int, length: int) -> None:
    """Appends ``length`` bytes from ``back`` before the end; a reference may reach into what it writes."""
    start = len(out) - back
    if start < 0:
        raise ValueError("a reference outside the image")
    some = out[start : start + length]
    out += some if back >= length else (some * (length // back + 1))[:length]


def _greens(bits: Bits, code: Code, distance: Code, width: int, n: int) -> np.ndarray:
    """n samples of an image that has one channel: literals and references."""
    texts, used = _runs(code.lengths)
    out, some, have, at, end = bytearray(), [], 0, bits.at, 8 * len(bits.data)
    while have < n:
        low = at >> 3
        b = np.frombuffer(bits.data[low : low + WINDOWS + 2] + bytes(4), np.uint8).astype(np.uint32)
        windows = (b[:-2] | b[1:-1] << 8 | b[2:] << 16).tolist()
        at -= 8 * low
        stop = 8 * min(WINDOWS, len(windows))
        while have < n and at < stop:
            v = windows[at >> 3] >> (at & 7) & 0xFFFF
            t = texts[v]
            if t:
                some.append(t)
                have += len(t)
                at += used[v]
                continue
            bits.at = 8 * low + at
            symbol = code.read(bits)
            if symbol < 256 or symbol >= 256 + LENGTH_CODES:
                raise ValueError("a symbol outside the alphabet")
            length = _value(bits, symbol - 256)
            back = _distance(_value(bits, distance.read(bits)), width)
            if have + length > n:
                raise ValueError("a reference outside the image")
            out += b"".join(some)
            some = []
            _copied(out, back, length)
            have += length
            at = bits.at - 8 * low
        at += 8 * low
        if at >= end + 16 and have < n:
            raise ValueError("the stream ends early")
    out += b"".join(some)
    for s in out[n:]:  # the last look-up may have gone beyond the image
        at -= code.lengths[s]
    if at > end:
        raise ValueError("the stream ends early")
    bits.at = at
    return np.frombuffer(out, np.uint8, n)


def _distance(code: int, width: int) -> int:
    """How many pixels a distance code reaches back."""
    if code > len(NEAR):
        return code - len(NEAR)
    dx, dy = NEAR[code - 1]
    return max(1, dx + dy * width)


def _read_pixels(bits: Bits, width: int, height: int, main: bool, green_only: bool = False) -> np.ndarray:
    """An entropy-coded image: width * height pixels 0xAARRGGBB; green_only: where they differ in that channel alone, its bytes."""
    n = width * height
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, block, tiles = 1, 0, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        tiles = (_read_pixels(bits, across, -(-height >> block), False) >> 8 & 0xFFFF).astype(np.int64)
        groups = int(tiles.max()) + 1
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [_read_codes(bits, sizes) for _ in range(groups)]
    green, red, blue, alpha, _ = codes[0]
    if groups == 1 and not cache_bits and None not in (green.single(), red.single(), blue.single(), alpha.single()) and green.single() < 256:
        one = np.uint32(alpha.single() << 24 | red.single() << 16 | green.single() << 8 | blue.single())
        return np.full(n, green.single(), np.uint8) if green_only else np.full(n, one)
    if groups == 1 and not cache_bits and green.width and n >= FEW and None not in (red.single(), blue.single(), alpha.single()):
        found = _greens(bits, green, codes[0][4], width, n)
        return found if green_only else found.astype(np.uint32) << np.uint32(8) | np.uint32(alpha.single() << 24 | red.single() << 16 | blue.single())
    out = [0] * n
    cache = [0] * (1 << cache_bits)
    shift = 32 - cache_bits
    at, kept = 0, 0
    while at < n:
        if tiles is not None:
            y, x = divmod(at, width)
            green, red, blue, alpha, distance = codes[tiles[(y >> block) * across + (x >> block)]]
        else:
            distance = codes[0][4]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 256 + LENGTH_CODES:
            length = _value(bits, s - 256)
            back = _distance(_value(bits, distance.read(bits)), width)
            if back > at or at + length > n:
                raise ValueError("a reference outside the image")
            for _ in range(length):
                out[at] = out[at - back]
                at += 1
        else:
            while kept < at:  # what was decoded since the last use
                cache[0x1E35A7BD * out[kept] % (1 << 32) >> shift] = out[kept]
                kept += 1
            out[at] = cache[s - 256 - LENGTH_CODES]
            at += 1
        if bits.at > 8 * len(bits.data):
            raise ValueError("the stream ends early")
    return np.array(out, np.uint32)


def _channels(x: int) -> tuple[int, int, int, int]:
    return x >> 24, x >> 16 & 255, x >> 8 & 255, x & 255


def _join(c) -> int:
    a, r, g, b = c
    return a << 24 | r << 16 | g << 8 | b


def _mean(a: int, b: int) -> int:
    return ((a ^ b) & 0xFEFEFEFE) // 2 + (a & b)


def predict(mode: int, left: int, top: int, corner: int, right: int) -> int:
    """The prediction of a pixel by its neighbours: left, above, above left, above right."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _mean(_mean(left, right), top)
    if mode == 6:
        return _mean(left, corner)
    if mode == 7:
        return _mean(left, top)
    if mode == 8:
        return _mean(corner, top)
    if mode == 9:
        return _mean(top, right)
    if mode == 10:
        return _mean(_mean(left, corner), _mean(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(_channels(top), _channels(corner)))
        to_top = sum(abs(x - c) for x, c in zip(_channels(left), _channels(corner)))
        return left if to_left < to_top else top
    if mode == 12:
        return _join(min(max(x + t - c, 0), 255) for x, t, c in zip(_channels(left), _channels(top), _channels(corner)))
    if mode == 13:
        return _join(min(max(m + int((m - c) / 2), 0), 255) for m, c in zip(_channels(_mean(left, top)), _channels(corner)))
    return BLACK


def _add(a: int, b: int) -> int:
    return (a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00 | (a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF


def _undo_predictor(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, block: int) -> np.ndarray:
    out, across = pixels.tolist(), -(-width >> block)
    kind = (modes >> 8 & 15).tolist()
    for at in range(len(out)):
        y, x = divmod(at, width)
        if y == 0:
            guess = out[at - 1] if x else BLACK
        elif x == 0:
            guess = out[at - width]
        else:
            guess = predict(kind[(y >> block) * across + (x >> block)], out[at - 1], out[at - width], out[at - width - 1], out[at - width + 1])
        out[at] = _add(out[at], guess)
    return np.array(out, np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 255).astype(np.uint8).view(np.int8).astype(np.int64)


def _undo_cross_colour(pixels: np.ndarray, width: int, height: int, tiles: np.ndarray, block: int) -> np.ndarray:
    y, x = np.divmod(np.arange(width * height), width)
    t = tiles[(y >> block) * -(-width >> block) + (x >> block)]
    green = _signed(pixels >> 8)
    red = (pixels >> 16).astype(np.int64) + (_signed(t) * green >> 5) & 255
    blue = pixels.astype(np.int64) + (_signed(t >> 8) * green >> 5) + (_signed(t >> 16) * _signed(red) >> 5) & 255
    return pixels & np.uint32(0xFF00FF00) | (red << 16 | blue).astype(np.uint32)


def _undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> 8 & 255
    return pixels & np.uint32(0xFF00FF00) | (pixels & np.uint32(0x00FF00FF)) + (green << 16 | green) & np.uint32(0x00FF00FF)


def _undo_indexing(pixels: np.ndarray, width: int, height: int, table: np.ndarray, packed: int) -> np.ndarray:
    colours = np.zeros(256, np.uint32)
    colours[: len(table)] = table
    index = (pixels >> 8 & 255).reshape(height, -1)
    if packed:
        each = 8 >> packed
        x = np.arange(width)
        index = index[:, x >> packed] >> ((x & (1 << packed) - 1) * each).astype(np.uint32) & (1 << each) - 1
    return colours[index].ravel()


def _opened(data: bytes) -> tuple[Bits, int, int]:
    """(bits behind the image header, width, height) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[20 : 20 + int.from_bytes(data[16:20], "little")])
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    return bits, width, height


def size_of(data: bytes) -> tuple[int, int]:
    return _opened(data[:64])[1:]


def _transforms(bits: Bits, width: int, height: int) -> tuple[list, int]:
    """(what undoes each transform, the width of the coded image)."""
    undo, inner, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform stands twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            tiles = _read_pixels(bits, -(-inner >> block), -(-height >> block), False)
            f = _undo_predictor if kind == PREDICTOR else _undo_cross_colour
            undo.append(functools.partial(f, width=inner, height=height, **{"modes" if kind == PREDICTOR else "tiles": tiles}, block=block))
        elif kind == SUBTRACT_GREEN:
            undo.append(_undo_subtract_green)
        else:
            size = bits.read(8) + 1
            table = _read_pixels(bits, size, 1, False).view(np.uint8).reshape(-1, 4)
            table = np.cumsum(table, axis=0, dtype=np.uint8).view("<u4").ravel()
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append(functools.partial(_undo_indexing, width=inner, height=height, table=table, packed=packed))
            inner = -(-inner >> packed)
    return undo, inner


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width) as 0xAARRGGBB of a lossless WebP file."""
    bits, width, height = _opened(data)
    undo, inner = _transforms(bits, width, height)
    pixels = _read_pixels(bits, inner, height, True)
    for f in reversed(undo):
        pixels = f(pixels)
    return pixels.reshape(height, width)


def samples(data: bytes) -> bytes:
    """The green channel of a file, row by row."""
    bits, width, height = _opened(data)
    undo, inner = _transforms(bits, width, height)
    found = _read_pixels(bits, inner, height, True, not undo)
    for f in reversed(undo):
        found = f(found)
    return found.tobytes() if found.dtype == np.uint8 else (found >> 8 & 255).astype(np.uint8).tobytes()


def huffman(weights: list[int]) -> tuple[int, ...]:
    """Code lengths of a Huffman code; ties are broken by symbol."""
    heap = [(w, i, (i,)) for i, w in enumerate(weights) if w]
    lengths = [0] * len(weights)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            lengths[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    if max(lengths) > 15:
        raise ValueError("a code of over 15 bits")
    return tuple(lengths)


def _weights(*some) -> list[int]:
    weights = [1] * 256
    for kinds, w in some:
        for k in kinds:
            weights[k] = w
    return weights


#: Assumed weights of bytes by kind of text, every byte with one (fixed values of this encoder): prose in Latin letters, in scripts
#: of two and of three bytes a letter, signs and numbers, and anything.
_LATIN = ((range(128, 192), 6), (range(33, 127), 8), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 12), (b"bcdfghjklmnpqrstuvwxyz", 160), (b"aeioutnrs", 420), (b" ", 900), (b".,\n", 60), (b"\0", 20), (b"\xc3", 60))
KINDS = (
    _weights(*_LATIN),
    _weights((range(33, 127), 4), (range(128, 192), 60), (range(0xCE, 0xDB), 120), (b"\xd0\xd1", 900), (b"\xb0\xb5\xb8\xbd\xbe\x80\x81\x82", 240), (b" ", 400), (b".,\n", 30)),
    _weights((range(33, 127), 4), (range(128, 192), 64), (range(0xE0, 0xF0), 120), (b"\xe4\xe5\xe6\xe7\xe3", 500), (b" \n", 30)),
    _weights((range(32, 127), 20), (b"0123456789", 60), (b" \n\t.,", 60), (range(97, 123), 30)),
    _weights((range(256), 1)),
)
#: Weight of a length symbol and of a distance symbol by its number, where references are used.
LENGTHS, DISTANCE = [14] * LENGTH_CODES, [1] * 8 + [3] * 4 + [12] * 12 + [6] * 16


@functools.cache
def kind_lengths(kind: int, references: bool) -> tuple[int, ...]:
    """Code lengths of the green alphabet for a kind of text; weights are scaled so that a length symbol takes some 7 bits."""
    bytes_ = [w * 16 for w in KINDS[kind]]
    each = sum(bytes_) // 1500 + 1
    return huffman(bytes_ + [each * w // 14 for w in LENGTHS]) if references else (*huffman(bytes_), *[0] * LENGTH_CODES)


@functools.cache
def text_code() -> tuple[int, ...]:
    """Code lengths for bytes of prose in Latin scripts."""
    return kind_lengths(0, False)[:256]


def _number(value: int, n: int) -> str:
    return format(value, f"0{n}b")[::-1] if n else ""


def _runs_of(lengths: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """Code lengths as (symbol, extra value, extra bits): runs of zeros and of one length are told by their number."""
    out, at, before = [], 0, 8
    while at < len(lengths):
        n, again = lengths[at], 1
        while at + again < len(lengths) and lengths[at + again] == n:
            again += 1
        at += again
        if not n:
            while again > 10:
                k = min(again, 138)
                out.append((18, k - 11, 7))
                again -= k
            if again > 2:
                out.append((17, again - 3, 3))
                again = 0
            out += [(0, 0, 0)] * again
            continue
        if n != before:
            out.append((n, 0, 0))
            before, again = n, again - 1
        while again > 2:
            k = min(again, 6)
            out.append((16, k - 3, 2))
            again -= k
        out += [(n, 0, 0)] * again
    return out


def write_code(lengths: tuple[int, ...]) -> str:
    """Bits that state a prefix code: simple where at most two symbols are used, else code lengths."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        first = used[0] if used else 0
        return "1" + _number(len(used) > 1, 1) + "1" + _number(first, 8) + (_number(used[1], 8) if len(used) > 1 else "")
    told = _runs_of(lengths)
    often = np.bincount([s for s, *_ in told], minlength=19)
    inner = huffman(often.tolist())
    while max(inner) > 7:  # code lengths' own codes have at most 7 bits
        often = often + 1 >> 1
        inner = huffman(often.tolist())
    codes = canonical(inner)
    count = max(4, max(i for i, s in enumerate(LENGTH_ORDER) if inner[s]) + 1)
    return "0" + _number(count - 4, 4) + "".join(_number(inner[s], 3) for s in LENGTH_ORDER[:count]) + "0" + "".join(codes[s] + _number(value, n) for s, value, n in told)


def _single(symbol: int) -> str:
    return write_code(tuple(int(i == symbol) for i in range(256)))


def _numbers(lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, least significant bit first; their lengths) by symbol."""
    codes = canonical(lengths)
    return np.array([int(codes.get(s, "")[::-1] or "0", 2) for s in range(len(lengths))], np.uint32), np.array([len(codes.get(s, "")) for s in range(len(lengths))], np.int64)


@functools.cache
def _plan(kind: int, references: bool) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bits before the pixels, codes and lengths of the green alphabet, codes and lengths of distances)."""
    green, distance = kind_lengths(kind, references), huffman(DISTANCE) if references else (1, *[0] * (DISTANCES - 1))
    head = "0" + "0" + write_code(green) + _single(0) + _single(0) + _single(255) + write_code(distance)
    return (head, *_numbers(green), *_numbers(distance))


def prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix symbol, extra bits' value, how many) of lengths or distance codes, from 1 on."""
    v = value - 1
    top = np.maximum(np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1, 1)  # the highest bit
    small = v < 4
    extra = np.where(small, 0, top - 1)
    return np.where(small, v, 2 * top + (v >> extra & 1)), np.where(small, 0, v & (1 << extra) - 1), extra


#: References: least length, greatest length and reach that the format allows; bytes that have to be alike for a place to be looked at.
LEAST, LONGEST, FAR, WORD, LONG_WORD = 12, 4096, (1 << 20) - 120, 8, 32
NONE = np.zeros(0, np.int64)
#: Bytes of a payload that are looked through for repeats, and packed, at a time: references do not cross them.
SLAB = 1 << 20


def _repeats(payload: bytes, word: int, taken: np.ndarray | None) -> list[tuple[int, int, int]]:
    """(start, length, distance) of runs of places that each repeat ``word`` bytes of the last place with the same ones; none touches what is taken.

    At most ``SLAB`` bytes: places are sorted by a hash of their bytes and their number in one 64-bit key.
    """
    n = len(payload) - word + 1
    if n < LEAST:
        return []
    words = np.ndarray((len(payload) - 7,), "<u8", payload, 0, (1,))
    parts = [words[k : k + n] for k in range(0, word, 8)]
    key = np.zeros(n, np.uint64)
    for part in parts:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    key &= np.uint64(~(SLAB - 1) & (1 << 64) - 1)
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    place = (key & np.uint64(SLAB - 1)).astype(np.int64)
    key >>= np.uint64(20)
    same = np.flatnonzero(key[1:] == key[:-1])
    if not len(same):
        return []
    a, b = place[same], place[same + 1]
    alike = np.ones(len(a), bool)
    for part in parts:
        alike &= part[a] == part[b]
    back = np.zeros(n, np.int64)
    back[b[alike]] = (b - a)[alike]
    back[back > FAR] = 0
    if taken is not None:
        upto = np.concatenate([[0], np.cumsum(taken, dtype=np.int64)])
        back[upto[word : word + n] > upto[:n]] = 0
    edge = np.concatenate([[0], np.flatnonzero(back[1:] != back[:-1]) + 1, [n]])
    far = back[edge[:-1]]
    lengths = edge[1:] - edge[:-1] + (word - 1)
    some = (far > 0) & (lengths >= LEAST)
    out, done = [], 0
    for a, length, d in zip(edge[:-1][some].tolist(), lengths[some].tolist(), far[some].tolist()):
        stop, a = a + length, max(a, done)
        while stop - a >= LEAST:
            k = min(stop - a, LONGEST)
            out.append((a, k, d))
            a += k
            done = a
    return out


def references(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of repeats, in order and apart; where a third of the payload repeats, long ones come first and short ones go between them."""
    out = _repeats(payload, WORD, None)
    if 3 * sum(k for _, k, _ in out) > len(payload) and (long := _repeats(payload, LONG_WORD, None)):
        taken = np.zeros(len(payload), bool)
        for a, k, _ in long:
            taken[a : a + k] = True
        out = sorted(long + _repeats(payload, WORD, taken))
    return tuple(np.array(out, np.int64).T) if out else (NONE, NONE, NONE)


class Packer:
    """Bytes of numbers of bits, least significant first; what is over eight bits waits for the next."""

    def __init__(self, bits: str):
        self.parts, self.over, self.n = [], 0, 0
        whole = len(bits) // 8 * 8
        if whole:
            self.parts.append(int(bits[:whole][::-1], 2).to_bytes(whole // 8, "little"))
        self.over, self.n = int(bits[whole:][::-1] or "0", 2), len(bits) - whole

    def put(self, values: np.ndarray, lengths: np.ndarray) -> None:
        """Numbers of at most 64 bits."""
        for lo in range(0, len(values), 1 << 17):
            v, n = values[lo : lo + (1 << 17)].astype(np.uint64), lengths[lo : lo + (1 << 17)]
            if self.n:
                v, n = np.concatenate([[np.uint64(self.over)], v]), np.concatenate([[self.n], n])
            ends = np.cumsum(n)
            place = np.arange(ends[-1], dtype=np.uint64) - np.repeat((ends - n).astype(np.uint64), n)
            bits = (np.repeat(v, n) >> place).astype(np.uint8) & 1
            whole = len(bits) // 8 * 8
            self.parts.append(np.packbits(bits[:whole], bitorder="little").tobytes())
            rest = bits[whole:].tolist()
            self.over, self.n = sum(x << i for i, x in enumerate(rest)), len(rest)

    def bytes(self) -> bytes:
        return b"".join(self.parts) + (bytes([self.over]) if self.n else b"")


def _file(width: int, height: int, packer: Packer) -> bytes:
    body = packer.bytes()
    padded = body + bytes(len(body) % 2)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + padded


def _header(width: int, height: int) -> str:
    return _number(0x2F, 8) + _number(width - 1, 14) + _number(height - 1, 14) + "0" + "000"


def container(width: int, height: int, stream: str) -> bytes:
    """A file of a stream of bits behind the image header."""
    return _file(width, height, Packer(_header(width, height) + stream))


@functools.cache
def _costs(refer: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By kind: the bits before the pixels, and those of each green and each distance symbol."""
    plans = [_plan(k, refer) for k in range(len(KINDS))]
    return np.array([len(p[0]) for p in plans]), np.stack([p[2] for p in plans]), np.stack([p[4] for p in plans])


class Slab:
    """A part of a payload with its references: what they would take, and the numbers that write it."""

    def __init__(self, data: np.ndarray, payload: bytes):
        self.data = data
        self.start, length, back = references(payload)
        self.symbol, self.value, self.bits = prefixed(length)
        self.far, self.d_value, self.d_bits = prefixed(back + len(NEAR))
        mark = np.zeros(len(data) + 1, np.int8)
        mark[self.start] = 1
        np.subtract.at(mark, self.start + length, 1)
        self.literal = np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int8) == 0) if len(self.start) else None

    def counts(self) -> tuple[np.ndarray, np.ndarray, int]:
        """(green symbols, distance symbols, extra bits) where references are used."""
        green = np.concatenate([np.bincount(self.data if self.literal is None else self.data[self.literal], minlength=256), np.bincount(self.symbol, minlength=LENGTH_CODES)])
        return green, np.bincount(self.far, minlength=DISTANCES), int(self.bits.sum() + self.d_bits.sum())

    def write(self, packer: Packer, kind: int, refer: bool) -> None:
        _, codes, lengths, d_codes, d_lengths = _plan(kind, refer)
        if not refer or self.literal is None:
            packer.put(codes[self.data], lengths[self.data])
            return
        values, sizes = np.empty(len(self.data), np.uint64), np.zeros(len(self.data), np.int64)
        some = self.data[self.literal]
        values[self.literal], sizes[self.literal] = codes[some], lengths[some]
        number, size = codes[self.symbol + 256].astype(np.uint64), lengths[self.symbol + 256].copy()
        for v, n in ((self.value, self.bits), (d_codes[self.far], d_lengths[self.far]), (self.d_value, self.d_bits)):
            number |= v.astype(np.uint64) << size.astype(np.uint64)
            size += n
        values[self.start], sizes[self.start] = number, size
        put = sizes > 0
        packer.put(values[put], sizes[put])


def _with_palette(payload: np.ndarray, colours: np.ndarray, width: int, height: int) -> bytes:
    """Few kinds of bytes: a palette, and rows of indices packed 8, 4 or 2 to a sample, in a code made for them."""
    packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
    each, many = 8 >> packed, 1 << packed
    index = np.searchsorted(colours, payload).reshape(height, width)
    index = np.pad(index, ((0, 0), (0, -width % many))).reshape(height, -1, many)
    bytes_ = (index << np.arange(many) * each).sum(axis=2).ravel()
    deltas = np.diff(colours.astype(np.int64), prepend=0) % 256
    kinds = np.bincount(deltas, minlength=256)
    code = lambda often, size: huffman(often.tolist() + [0] * (size - len(often))) if (often > 0).sum() > 1 else tuple(int(i == int(often.argmax())) for i in range(size))
    steps, alpha = code(kinds, 256 + LENGTH_CODES), code(np.bincount([255] + [0] * (len(colours) - 1), minlength=256), 256)
    none = write_code((1, *[0] * (DISTANCES - 1)))
    a_codes, s_codes = canonical(alpha), canonical(steps)
    table = "0" + write_code(steps) + _single(0) + _single(0) + write_code(alpha) + none
    table += "".join(s_codes[d] + a_codes[255 if i == 0 else 0] for i, d in enumerate(deltas.tolist()))
    green = code(np.bincount(bytes_, minlength=256), 256 + LENGTH_CODES)
    head = "1" + _number(INDEXING, 2) + _number(len(colours) - 1, 8) + table + "0" + "0" + "0" + write_code(green) + _single(0) + _single(0) + _single(255) + none
    packer = Packer(_header(width, height) + head)
    values, lengths = _numbers(green)
    packer.put(values[bytes_], lengths[bytes_])
    return _file(width, height, packer)


def encode_samples(payload: bytes) -> bytes:
    """A file whose green channel is the payload, a positive multiple of 64 bytes."""
    if not payload or len(payload) % SAMPLES:
        raise ValueError("a payload has a positive multiple of 64 bytes")
    width = SAMPLES
    while len(payload) > width * TALLEST:
        width *= 2
    if width > TALLEST:
        raise ValueError("over 2**28 bytes")
    payload = payload.ljust(-(-len(payload) // width) * width, b"\0")
    height = len(payload) // width
    data = np.frombuffer(payload, np.uint8)
    often = np.bincount(data, minlength=256)
    if (often > 0).sum() <= 16:
        return _with_palette(data, np.flatnonzero(often), width, height)
    parts = [(data[lo : lo + SLAB], payload[lo : lo + SLAB]) for lo in range(0, len(payload), SLAB)]
    slabs = [Slab(*parts[0])] if len(parts) == 1 else None  # of a long payload one at a time, made twice
    head, green, _ = _costs(False)
    costs = [(c, k, False) for k, c in enumerate((head + green[:, :256] @ often).tolist())]
    symbols, distances, extra = np.zeros(256 + LENGTH_CODES, np.int64), np.zeros(DISTANCES, np.int64), 0
    for slab in slabs or (Slab(*p) for p in parts):
        g, d, e = slab.counts()
        symbols, distances, extra = symbols + g, distances + d, extra + e
    if distances.any():
        head, green, far = _costs(True)
        costs += [(c + extra, k, True) for k, c in enumerate((head + green @ symbols + far @ distances).tolist())]
    _, kind, refer = min(costs)
    packer = Packer(_header(width, height) + "0" + _plan(kind, refer)[0])
    for slab in slabs or (Slab(*p) for p in parts):
        slab.write(packer, kind, refer)
    return _file(width, height, packer)
