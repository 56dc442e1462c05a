"""Media columns: animated GIF as a lossless store of 8-bit samples.

``encode_gif`` writes frames of palette indices: each frame's changed rectangle,
with unchanged samples transparent where that hides much, as an LZW code stream.
``read_frames`` walks the blocks of any GIF89a or GIF87a, decodes the code
streams and gives the stored indices with palettes, places, times, transparency
and disposal; ``compose`` plays them on the canvas and yields the RGBA pictures.
What is read back, and all features, come from those pictures.

Frames are written, read and played one after the other, so memory doesn't grow
with a text but for its own bytes and the file's.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from millrace.llm.arrow import id_and_bytes, map_docs

#: A stored frame is SIDE x SIDE samples.
SIDE = 24
FRAME = SIDE * SIDE
#: Hundredths of a second between frames.
DELAY = 4
#: The most bits of a code and the codes there are.
MOST_BITS, MOST_CODES = 12, 4096
#: A frame is written by its changes if at least one in so many samples is as before.
SAME_PART = 4
#: Frames whose codes are packed at once, and codes unpacked at once.
PACKED, UNPACKED = 256, 1024
#: Bins of a channel's histogram.
BINS = 16
_NONE = np.zeros(0, np.uint8)
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frame_times array<long>, red array<long>, green array<long>, blue array<long>"
_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frame_times", "red", "green", "blue"]


def ramp() -> np.ndarray:
    """The writer's palette: red is the index, green its Gray code, blue its complement."""
    index = np.arange(256, dtype=np.uint8)
    return np.stack([index, index ^ (index >> 1), 255 - index], axis=1)


@dataclass
class Frame:
    """One frame: place and size on the canvas, stored indices, palette (n x 3), and how it is shown."""

    left: int
    top: int
    width: int
    height: int
    indices: np.ndarray
    palette: np.ndarray
    delay: int = 0
    transparent: int | None = None
    disposal: int = 0
    time: int = 0


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame] = field(default_factory=list)
    background: int = 0


@lru_cache(maxsize=8)
def code_widths(bits: int) -> np.ndarray:
    """The bits of a code by its place after the last clear code (place 0: the first code of a stream, a clear code)."""
    place = np.arange(MOST_CODES + UNPACKED)
    steps = [((1 << w) - (1 << bits) - 1) for w in range(bits + 1, MOST_BITS)]  # the last place of each width
    return bits + 1 + np.searchsorted(steps, place)


def lzw_codes(data: bytes, bits: int = 8) -> list[int]:
    """The LZW codes of some indices: a clear code, codes of the longest strings in the table, and an end code.

    The table is a list by the code of a string: which index after it makes which longer string's code.
    """
    clear = 1 << bits
    codes, size = [clear], clear + 2
    add = codes.append
    longer: list[dict[int, int] | None] = [None] * min(MOST_CODES + 1, size + len(data))
    prefix, after = data[0], None
    for b in data[1:]:
        if after is not None:
            if b in after:
                prefix = after[b]
                after = longer[prefix]
                continue
            after[b] = size
        else:
            longer[prefix] = {b: size}
        add(prefix)
        size += 1
        if size > MOST_CODES:
            add(clear)
            size = clear + 2
            longer = [None] * (MOST_CODES + 1)
        prefix = b
        after = longer[b]
    return [*codes, prefix, clear + 1]


def pack_codes(streams: list[list[int]], bits: int = 8) -> list[bytes]:
    """Each stream's codes at the widths of their places, low bits first."""
    codes = np.concatenate([np.array([*s, 0], np.uint16) for s in streams])  # with a code of zeros that fills the last byte
    last = np.cumsum([len(s) + 1 for s in streams]) - 1
    place, first = np.arange(len(codes)), np.concatenate(([0], last[:-1] + 1))
    starts = np.where(codes == 1 << bits, place, 0)
    starts[last] = 0
    starts = np.maximum.accumulate(starts)
    before = np.concatenate(([0], starts[:-1]))
    before[first] = first
    widths = code_widths(bits)[place - before]
    widths[last] = 0
    sizes = np.add.reduceat(widths, first)
    widths[last] = -sizes % 8
    spread = (codes[:, None] >> np.arange(MOST_BITS, dtype=np.uint16)).astype(np.uint8) & 1
    packed = np.packbits(spread[np.arange(MOST_BITS) < widths[:, None]], bitorder="little").tobytes()
    ends = np.cumsum((sizes + 7) // 8).tolist()
    return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _image(delay: int, transparent: int | None, box: tuple[int, int, int, int]) -> bytes:
    """A graphic control block (keep the picture) and an image descriptor."""
    control = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2 | (transparent is not None), delay, transparent or 0, 0)
    return control + struct.pack("<BHHHHBB", 0x2C, *box, 0, 8)


def changes(now: np.ndarray, before: np.ndarray, transparent: int) -> tuple[tuple[int, int, int, int], np.ndarray] | None:
    """The changed rectangle (left, top, width, height) and its indices, unchanged ones transparent; None if too little is as before."""
    differs = now != before
    if np.count_nonzero(differs) * SAME_PART > differs.size * (SAME_PART - 1):
        return None
    rows, columns = np.flatnonzero(differs.any(axis=1)), np.flatnonzero(differs.any(axis=0))
    top, low, left, right = (rows[0], rows[-1], columns[0], columns[-1]) if len(rows) else (0, 0, 0, 0)
    part = np.s_[top : low + 1, left : right + 1]
    return (int(left), int(top), int(right - left + 1), int(low - top + 1)), np.where(differs[part], now[part], np.uint8(transparent))


def encode_gif(samples: bytes, side: int = SIDE, delay: int = DELAY) -> bytes:
    """A GIF89a animation whose pictures of side x side show ``samples`` (a positive multiple of side * side), by the palette ``ramp``."""
    frame = side * side
    if not samples or len(samples) % frame:
        raise ValueError(f"the samples must be a positive multiple of {frame}")
    unused = np.flatnonzero(np.bincount(np.frombuffer(samples, np.uint8), minlength=256) == 0)
    transparent = int(unused[0]) if len(unused) else None
    out = [b"GIF89a", struct.pack("<HHBBB", side, side, 0xF7, 0, 0), ramp().tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    waiting: list[tuple[bytes, list[int]]] = []

    def flush() -> None:
        for (head, _), body in zip(waiting, pack_codes([codes for _, codes in waiting]), strict=True):
            out.append(head)
            out.extend(bytes([min(255, len(body) - i)]) + body[i : i + 255] for i in range(0, len(body), 255))
            out.append(b"\0")
        waiting.clear()

    before = None
    for at in range(0, len(samples), frame):
        now = np.frombuffer(samples, np.uint8, frame, at).reshape(side, side)
        less = None if before is None or transparent is None else changes(now, before, transparent)
        if less is None:
            waiting.append((_image(delay, None, (0, 0, side, side)), lzw_codes(samples[at : at + frame])))
        else:
            waiting.append((_image(delay, transparent, less[0]), lzw_codes(less[1].tobytes())))
        before = now
        if len(waiting) == PACKED:
            flush()
    if waiting:
        flush()
    return b"".join([*out, b"\x3b"])


def _codes_at(raw: np.ndarray, first: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The codes that begin at these bits."""
    word = first >> 3
    return ((raw[word] | raw[word + 1] << 8 | raw[word + 2] << 16) >> (first & 7).astype(np.uint32)) & ((1 << widths) - 1).astype(np.uint32)


def _bytes_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)


def lzw_decode(data: bytes, bits: int, wanted: int) -> np.ndarray:
    """The indices in an LZW code stream with minimum code size ``bits``: at most ``wanted`` of them, code by code.

    A stream that ends early gives what it has; a code that isn't defined yet raises ValueError.
    """
    raw, clear, total, held = _bytes_of(data), 1 << bits, 8 * len(data), 0
    fresh = [*(bytes([i]) for i in range(clear)), b"", b""]
    strings, last, out = list(fresh), b"", []
    at, place = 0, 1  # the next code's first bit, and its place after a clear code
    while held < wanted:
        # codes as wide as they are if no clear code comes; what follows one is unpacked again
        widths = code_widths(bits)[min(place, MOST_CODES) : min(place, MOST_CODES) + UNPACKED]
        ends = at + np.cumsum(widths)
        n = int(np.searchsorted(ends, total, side="right"))
        if not n:
            break
        codes = _codes_at(raw, ends[:n] - widths[:n], widths[:n])
        special = np.flatnonzero((codes | 1) == clear + 1)
        for code in (codes[: special[0]] if len(special) else codes).tolist():
            if code < len(strings):
                now = strings[code]
            elif last and code == len(strings):
                now = last + last[:1]
            else:
                raise ValueError("the code stream names a string that isn't in the table")
            if last and len(strings) < MOST_CODES:
                strings.append(last + now[:1])
            out.append(now)
            held += len(now)
            last = now
        if not len(special):
            at, place = int(ends[n - 1]), place + n
        elif codes[special[0]] == clear:
            at, place, strings, last = int(ends[special[0]]), 1, list(fresh), b""
        else:
            break
    return np.frombuffer(b"".join(out)[:wanted], np.uint8)


def lzw_strings(codes: np.ndarray, first: np.ndarray, clear: int) -> tuple[np.ndarray, np.ndarray]:
    """The indices that codes stand for, and how many each; ``first``: where the codes that share a code's table begin.

    The table's entry e is the string of its e-th code and one index more, the
    first of the code after that; so a code names an earlier code, whose string it
    repeats and lengthens by one.  Following those names, all codes at once, gives
    the lengths, the first indices and then the strings from their ends.
    """
    every = np.arange(len(codes))
    literal = codes < clear
    names = np.where(literal, every, first + codes.astype(np.int64) - (clear + 2))
    if (~literal & ((names >= every) | (names < first))).any():
        raise ValueError("the code stream names a string that isn't in the table")
    root, more = names, (~literal).astype(np.int64)
    while not literal[root].all():
        more = more + more[root]
        root = root[root]
    lengths = more + 1
    final = np.where(literal, codes, codes[root[np.minimum(names + 1, len(codes) - 1)]]).astype(np.uint8)
    out = np.empty(int(lengths.sum()), np.uint8)
    at, place = every, np.cumsum(lengths) - 1
    while len(at):
        out[place] = final[at]
        longer = ~literal[at]
        at, place = names[at[longer]], place[longer] - 1
    return out, lengths


def lzw_decode_all(streams: list[tuple[bytes, int, int]]) -> list[np.ndarray]:
    """lzw_decode of many streams: those with one table each together, others one by one."""
    found: list[np.ndarray | None] = [None] * len(streams)
    for bits in {s[1] for s in streams}:
        own = [i for i, s in enumerate(streams) if s[1] == bits and len(s[0]) > 1]
        if not own:
            continue
        clear, data = 1 << bits, [streams[i][0] for i in own]
        raw = _bytes_of(b"".join(data))
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        widths = code_widths(bits)
        ends = np.cumsum(widths)
        n = np.searchsorted(ends, 8 * sizes, side="right")
        starts = np.cumsum(n) - n
        which, place = np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(starts, n)
        codes = _codes_at(raw, 8 * (np.cumsum(sizes) - sizes)[which] + (ends - widths)[place], widths[place])
        # up to the first end code; a stream with another table, or none cleared at its start, goes the other way
        special = np.flatnonzero((codes | 1) == clear + 1)
        stops = starts + n
        later = special[place[special] > 0]
        np.minimum.at(stops, which[later], later)
        simple = (codes[starts] == clear) & (stops < starts + n)
        simple[simple] &= codes[stops[simple]] == clear + 1
        simple &= stops > starts + 1
        kept = simple[which] & (place > 0) & (np.arange(len(codes)) < stops[which])
        if not kept.any():
            continue
        owner = which[kept]
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        out, lengths = lzw_strings(codes[kept], np.repeat(first, np.diff(np.append(first, len(owner)))), clear)
        totals = np.add.reduceat(lengths, first)
        for k, end, total in zip(owner[first].tolist(), np.cumsum(totals).tolist(), totals.tolist(), strict=True):
            found[own[k]] = out[end - total : end][: streams[own[k]][2]]
    return [lzw_decode(*s) if x is None else x for s, x in zip(streams, found, strict=True)]


def read_frames(data: bytes, gif: Gif) -> Iterator[Frame]:
    """The frames of a GIF in their order; sets the size and background of ``gif``."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    gif.width, gif.height, flags, gif.background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, None

    def palette(flags: int) -> np.ndarray:
        nonlocal at
        n = 3 << ((flags & 7) + 1)
        at += n
        return np.frombuffer(data, np.uint8, n, at - n).reshape(-1, 3)

    def sub_blocks() -> bytes:
        nonlocal at
        parts = []
        while (n := data[at]) != 0:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    if flags & 0x80:
        common = palette(flags)
    waiting: list[tuple[Frame, bytes, int, bool]] = []

    def decoded() -> Iterator[Frame]:
        found = lzw_decode_all([(body, bits, f.width * f.height) for f, body, bits, _ in waiting])
        for (f, _, _, interlaced), indices in zip(waiting, found, strict=True):
            missing = f.width * f.height - len(indices)
            f.indices = (np.concatenate([indices, np.zeros(missing, np.uint8)]) if missing else indices).reshape(f.height, f.width)
            if interlaced:
                order = np.concatenate([np.arange(a, f.height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                plain = np.empty_like(f.indices)
                plain[order] = f.indices
                f.indices = plain
            yield f
        waiting.clear()

    time, shown = 0, (0, None, 0)
    while at < len(data) and (kind := data[at]) != 0x3B:
        at += 1
        if kind == 0x21:
            label = data[at]
            at += 1
            body = sub_blocks()
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", body)
                shown = delay, index if packed & 1 else None, (packed >> 2) & 7
        elif kind == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
            at += 9
            own = palette(flags) if flags & 0x80 else common
            bits = data[at]
            at += 1
            frame = Frame(left, top, w, h, _NONE, own if own is not None else np.zeros((256, 3), np.uint8), shown[0], shown[1], shown[2], time)
            waiting.append((frame, sub_blocks(), bits, bool(flags & 0x40)))
            time, shown = time + shown[0], (0, None, 0)
            if len(waiting) == PACKED:
                yield from decoded()
        else:
            raise ValueError(f"unknown block {kind:#x}")
    yield from decoded()


def decode_gif(data: bytes) -> Gif:
    """Parse a GIF: its frames with stored indices, palettes and times."""
    gif = Gif(0, 0)
    gif.frames = list(read_frames(data, gif))
    return gif


def compose(gif: Gif, frames: Iterable[Frame] | None = None) -> Iterator[tuple[Frame, np.ndarray]]:
    """Each frame with the RGBA picture shown at it, by transparency and disposal (1 keep, 2 clear, 3 restore).

    The picture is the canvas itself until the next one is asked for.
    """
    canvas: np.ndarray | None = None
    known: np.ndarray | None = None
    for f in gif.frames if frames is None else frames:
        if canvas is None:
            canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
        before = canvas.copy() if f.disposal == 3 else None
        h, w = max(0, min(f.height, gif.height - f.top)), max(0, min(f.width, gif.width - f.left))
        part, indices = canvas[f.top : f.top + h, f.left : f.left + w], f.indices[:h, :w]
        if f.palette is not known:
            known, colours = f.palette, np.full((256, 4), 255, np.uint8)
            colours[:, :3] = 0
            colours[: len(known), :3] = known
        if f.transparent is None:
            part[:] = colours[indices]
        else:
            seen = indices != f.transparent
            part[seen] = colours[indices[seen]]
        yield f, canvas
        if f.disposal == 2:
            part[:] = 0
        elif f.disposal == 3:
            canvas = before


class Summary:
    """What is read off the pictures, one after the other: samples, times, colour histograms, mean brightness and change."""

    def __init__(self) -> None:
        self.sha, self.tail, self.bytes = hashlib.sha256(), b"", 0
        self.times: list[int] = []
        self.end = self.moved = 0
        self.counts = np.zeros((3, 256), np.int64)
        self._before: np.ndarray | None = None

    def add(self, frame: Frame, picture: np.ndarray) -> None:
        red = np.ascontiguousarray(picture[..., 0])
        back = red.tobytes()
        self.sha.update(back)
        self.tail = back[-32:]
        self.bytes += len(back)
        self.times.append(frame.time)
        self.end = frame.time + frame.delay
        for c in range(3):
            self.counts[c] += np.bincount(picture[..., c].reshape(-1), minlength=256)
        values = red.astype(np.int16)
        if self._before is not None:
            self.moved += int(np.abs(values - self._before).sum())
        self._before = values

    def histograms(self) -> list[list[int]]:
        """The bins of red, green and blue."""
        return self.counts.reshape(3, BINS, -1).sum(axis=2).tolist()

    def feature(self) -> str:
        """Frames, seconds, mean of the red channel, mean change from picture to picture, and shares of its bins in thousandths."""
        n = len(self.times)
        change = self.moved / (self.bytes - self.bytes // n) if n > 1 else 0.0
        shares = ",".join(str(int(1000 * v / self.bytes + 0.5)) for v in self.histograms()[0])
        mean = int(self.counts[0] @ np.arange(256)) / self.bytes
        return f"frames={n};s={self.end / 100:.2f};mean={mean:.3f};change={change:.3f};hist={shares}"


def payload_of(body: bytes) -> bytes:
    """The bytes padded with 255 to a positive multiple of a frame."""
    return body + b"\xff" * (max(FRAME, -(-len(body) // FRAME) * FRAME) - len(body))


def gif_frames(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media binary, times array<long>, histograms array<array<long>>): each text stored as a GIF, with its pictures' times and colour histograms.

    A histogram is 16 bins of red, then green, then blue.  Null and empty texts
    are one frame of 255s; null identifiers stay null; repeated rows give
    repeated results; an empty table gives none.  Other columns are never read.
    """

    def row(doc_id: int | None, body: bytes) -> tuple:
        media, gif = encode_gif(payload_of(body)), Gif(0, 0)
        times, histograms = [], []
        for frame, picture in compose(gif, read_frames(media, gif)):
            times.append(frame.time)
            histograms.append([n for c in range(3) for n in np.bincount((picture[..., c] >> 4).reshape(-1), minlength=BINS).tolist()])
        return doc_id, media, times, histograms

    return map_docs(id_and_bytes(docs, id_col, text_col), row, "doc_id long, media binary, times array<long>, histograms array<array<long>>", ["doc_id", "media", "times", "histograms"])


def gif_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a GIF, read back: sizes, digests, times of the frames, and features of the composed pictures.

    Null and empty texts are one frame of 255s; texts of any length are stored
    whole; null identifiers stay null.  Equal texts give equal rows but for the
    identifier; one pass without a shuffle.  An empty table gives no rows; other
    columns are never read, so none can clash.
    """

    def row(doc_id: int | None, body: bytes) -> tuple:
        media, gif, seen = encode_gif(payload_of(body)), Gif(0, 0), Summary()
        for frame, picture in compose(gif, read_frames(media, gif)):
            seen.add(frame, picture)
        return doc_id, len(body), seen.bytes, seen.sha.hexdigest(), zlib.crc32(seen.tail), len(media), hashlib.sha256(media).hexdigest(), seen.feature(), seen.times, *seen.histograms()

    return map_docs(id_and_bytes(docs, id_col, text_col), row, SCHEMA, _NAMES)
