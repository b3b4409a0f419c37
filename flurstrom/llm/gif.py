"""GIF media columns: write texts as GIF frames, decode GIFs into timed frames.

The decoder follows GIF89a: LZW code streams of growing width with clear and end
codes, global and local palettes, interlacing, sub-rectangles, transparency and
the disposal methods keep, background and previous. Its frames carry their time
and a colour histogram.

Defined cases: null text or media is empty bytes; an empty text is stored as one
block of 255; media that is no GIF, or broken, gives no frames and an ``error``;
repeated rows give repeated results; an empty table gives no rows; columns other
than those named are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

BLOCK = 576
WIDTH = 24
#: A frame holds so many blocks at most; longer payloads take more frames.
BLOCKS_PER_FRAME = 16
DELAY_MS = 40
BINS = 8
FRAMES = "id long, frame int, start_ms long, delay_ms long, width int, height int, rgb binary, hist_r array<long>, hist_g array<long>, hist_b array<long>, error string"
DIGEST = "doc_id long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def widths(n: int, least: int) -> np.ndarray:
    """Bits of each of n codes that follow a clear code: a decoder has one entry more after each code but the first."""
    entries = (1 << least) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.ceil(np.log2(entries + 1)).astype(np.int64), least + 1, 12)


#: For 8-bit samples: bits of the codes that follow a clear code, and where they begin.
AHEAD = 1 << 13
WIDTHS_8 = widths(AHEAD, 8)
BEGINS_8 = np.concatenate([[0], np.cumsum(WIDTHS_8)])


def lzw_encode(samples: bytes) -> bytes:
    """The code stream of 8-bit samples; a full table is cleared."""
    runs, codes = [], []
    add = codes.append
    table: dict[int, int] = {}
    get = table.get
    fresh = 258 << 8
    rest = iter(samples)
    prefix = next(rest, -1) << 8  # codes are kept shifted, ready for the next sample
    for b in rest:
        longer = get(prefix | b)
        if longer is not None:
            prefix = longer
            continue
        add(prefix)
        table[prefix | b] = fresh
        fresh += 256
        prefix = b << 8
        if fresh == 4096 << 8:
            runs.append(codes + [256 << 8])
            table.clear()
            codes = []
            add, fresh = codes.append, 258 << 8
    runs.append(codes + ([prefix] if prefix >= 0 else []) + [257 << 8])
    code = np.concatenate([np.array(x, np.uint32) for x in ([256 << 8], *runs)]) >> np.uint32(8)
    size = np.concatenate([[9], *(WIDTHS_8[: len(x)] for x in runs)])
    begins = np.cumsum(size) - size
    value, byte = code << (begins & 7).astype(np.uint32), begins >> 3
    n = int(byte[-1]) + 3
    # the bits of different codes never meet, so sums are unions
    out = sum(np.bincount(byte + k, (value >> np.uint32(8 * k)) & 255, n) for k in range(3))
    return out[: -(-int(begins[-1] + size[-1]) // 8)].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, least: int, most: int) -> bytes:
    """At most ``most`` samples; a full table stays as it is until the next clear code."""
    clear = 1 << least
    end = clear + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    bits = len(data) * 8
    start = [bytes([k]) for k in range(clear)] + [b"", b""]
    out: list[bytes] = []
    put = out.append
    at, ahead = 0, AHEAD
    while at < bits:
        ahead = min(ahead, (bits - at) // (least + 1) + 1)
        if least == 8 and ahead <= AHEAD:
            size, begins = WIDTHS_8[:ahead], at + BEGINS_8[:ahead]
        else:
            size = widths(ahead, least)
            begins = at + np.cumsum(size) - size
        n = int(np.searchsorted(begins + size, bits, "right"))
        size, begins = size[:n], begins[:n]
        byte = begins >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (begins & 7).astype(np.uint32) & ((1 << size) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stop) and n == ahead and n < (bits - at) // (least + 1):  # no clear code in sight: look further
            ahead *= 4
            continue
        n = int(stop[0]) if len(stop) else n
        table = start.copy()
        grow = table.append
        last = b""
        for c in codes[:n].tolist():
            try:
                own = table[c]
            except IndexError:
                own = last + last[:1]
                if c != len(table) or not last:
                    raise ValueError("a code beyond the table") from None
            if last and len(table) < 4096:
                grow(last + own[:1])
            put(own)
            last = own
        if n == len(codes) or codes[n] == end:
            break
        at = int(begins[n] + size[n])
        ahead = AHEAD
    return b"".join(out)[:most]


GREYS = bytes(x for k in range(256) for x in (k, k, k))


def sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p)]) + p for k in range(0, len(data), 255) if (p := data[k : k + 255])) + b"\0"


def encode(payload: bytes) -> bytes:
    """A GIF of grey frames whose samples, frame by frame, are the payload (a multiple of BLOCK)."""
    rows = min(len(payload) // BLOCK, BLOCKS_PER_FRAME) * BLOCK // WIDTH
    parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, rows, 0xF7, 0, 0), GREYS]
    for k in range(0, len(payload), BLOCK * BLOCKS_PER_FRAME):
        own = payload[k : k + BLOCK * BLOCKS_PER_FRAME]
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY_MS // 10, 0, 0))
        parts.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(own) // WIDTH, 0) + b"\x08" + sub_blocks(lzw_encode(own)))
    return b"".join([*parts, b"\x3b"])


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    box: tuple[int, int, int, int]  #: left, top, width, height of what this frame drew
    rgba: np.ndarray  #: the whole canvas as shown, height x width x 4


def interlaced(height: int) -> np.ndarray:
    return np.concatenate([np.arange(0, height, 8), np.arange(4, height, 8), np.arange(2, height, 4), np.arange(1, height, 2)])


def decode(data: bytes) -> Iterator[Frame]:
    """Frames as shown, in order. Raises ValueError where the data is no whole GIF."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    try:
        yield from drawn(data)
    except (IndexError, struct.error) as e:
        raise ValueError(f"the data ends early: {e}") from e


def drawn(data: bytes) -> Iterator[Frame]:
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13
    shared = None

    def palette(bits: int) -> np.ndarray:
        nonlocal at
        n = 2 << bits
        if at + 3 * n > len(data):
            raise ValueError("the data ends in a palette")
        own = np.zeros((256, 4), np.uint8)
        own[:n, :3] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        own[:n, 3] = 255
        at += 3 * n
        return own

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            if at + n >= len(data):
                raise ValueError("the data ends in a block")
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(parts)

    if flags & 0x80:
        shared = palette(flags & 7)
    canvas = np.zeros((height, width, 4), np.uint8)
    clock, delay, disposal, clear_index = 0, 0, 0, None
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                disposal = body[0] >> 2 & 7
                delay = struct.unpack_from("<H", body, 1)[0] * 10
                clear_index = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind}")
        left, top, w, h, own_flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        colours = palette(own_flags & 7) if own_flags & 0x80 else shared
        if colours is None:
            raise ValueError("no palette")
        least = data[at]
        at += 1
        if not 1 <= least <= 8:
            raise ValueError("a code size out of range")
        samples = np.frombuffer(lzw_decode(blocks(), least, w * h), np.uint8)
        if len(samples) < w * h:
            raise ValueError("a frame lacks samples")
        index = samples.reshape(h, w)
        if own_flags & 0x40:
            straight = np.empty_like(index)
            straight[interlaced(h)] = index
            index = straight
        before = canvas.copy() if disposal == 3 else None
        seen = index[: max(0, height - top), : max(0, width - left)]
        region = canvas[top : top + h, left : left + w]
        drawn_now = colours[seen]
        region[...] = drawn_now if clear_index is None else np.where((seen == clear_index)[..., None], region, drawn_now)
        yield Frame(clock, delay, (left, top, w, h), canvas.copy())
        clock += delay
        if disposal == 2:
            region[...] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear_index = 0, 0, None


def histogram(channel: np.ndarray, bins: int = BINS) -> np.ndarray:
    return np.bincount(channel.ravel() // (256 // bins), minlength=bins)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the document as a GIF: its UTF-8 bytes, filled with 255 to whole blocks."""

    def of(batches):
        for batch in batches:
            for k in range(0, len(batch), 500):
                rows = batch.iloc[k : k + 500]
                payloads = [(t or "").encode() for t in rows["text"]]
                media = [encode(p + b"\xff" * (BLOCK - len(p) if not p else -len(p) % BLOCK)) for p in payloads]
                yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "n_bytes": [len(p) for p in payloads], "media": media})

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(of, "doc_id long, n_bytes long, media binary")


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame of each GIF: time, delay, size, the shown RGB samples and a histogram of each colour.

    A GIF that can't be read gives one row with its error and no samples."""

    def of(batches):
        for batch in batches:
            for i, data in zip(batch["id"], batch["media"]):
                out = []
                try:
                    for k, f in enumerate(decode(bytes(data or b""))):
                        h, w = f.rgba.shape[:2]
                        out.append((i, k, f.start_ms, f.delay_ms, w, h, f.rgba[..., :3].tobytes(), *(histogram(f.rgba[..., c]) for c in range(3)), None))
                        if len(out) == 64:
                            yield pd.DataFrame(out, columns=columns).astype({"id": "Int64"})
                            out = []
                except ValueError as e:
                    out.append((i, *[None] * 9, str(e)))
                if out:
                    yield pd.DataFrame(out, columns=columns).astype({"id": "Int64"} | {c: "Int64" for c in columns[1:6]})

    columns = [x.split()[0] for x in FRAMES.split(", ")]
    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInPandas(of, FRAMES)


def read_back(media: DataFrame) -> DataFrame:
    """Digest of what the frames of to_media() hold: the payload in their drawn boxes, and their grey histogram."""

    def of(batches):
        for batch in batches:
            out = []
            for doc, data in zip(batch["doc_id"], batch["media"]):
                data = bytes(data)
                whole, size, tail, hist, n, ms = hashlib.sha256(), 0, b"", np.zeros(BINS, np.int64), 0, 0
                for f in decode(data):
                    left, top, w, h = f.box
                    grey = f.rgba[top : top + h, left : left + w, 0]
                    own = grey.tobytes()
                    whole.update(own)
                    size, tail, n, ms = size + len(own), own[-32:], n + 1, ms + f.delay_ms
                    hist += histogram(grey)
                out.append((doc, size, whole.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), f"frames={n};ms={ms};grey=" + ",".join(map(str, hist))))
            frame = pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})
            yield frame.assign(n_bytes=batch["n_bytes"].to_numpy())

    columns = [x.split()[0] for x in DIGEST.split(", ")]
    return media.select("doc_id", "n_bytes", "media").mapInPandas(of, DIGEST + ", n_bytes long")
