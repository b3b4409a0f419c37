"""GIF decoding by hand-made files, and the round trip of texts."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from flurstrom.llm import gif

RED, GREEN, BLUE, BLACK = (255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0)


def stream(samples, least=2):
    """A code stream of single samples, cleared before the codes would widen."""
    clear, end = 1 << least, (1 << least) + 1
    codes = []
    for k, s in enumerate(samples):
        if k % ((1 << least) - 2) == 0:
            codes.append(clear)
        codes.append(s)
    bits = "".join(format(c, f"0{least + 1}b")[::-1] for c in [*codes, end])
    return bytes([least]) + gif.sub_blocks(bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8)))


def file(frames, size=(4, 4), palette=(BLACK, RED, GREEN, BLUE)):
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + bytes(c for p in palette for c in p)
    for box, samples, disposal, clear, flags in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), 5, clear or 0, 0)
        out += b"\x2c" + struct.pack("<HHHHB", *box, flags) + stream(samples)
    return out + b"\x3b"


def shown(frame):
    return frame.rgba[..., :3].tolist()


def test_disposal_and_transparency():
    frames = [((0, 0, 4, 4), [1] * 16, 1, None, 0), ((1, 1, 2, 2), [2, 0, 0, 2], 2, 0, 0), ((0, 0, 1, 1), [3], 3, None, 0), ((3, 3, 1, 1), [3], 0, None, 0)]
    got = list(gif.decode(file(frames)))
    assert [f.start_ms for f in got] == [0, 50, 100, 150]
    assert shown(got[1])[1][1:3] == [list(GREEN), list(RED)] and shown(got[1])[0][0] == list(RED)
    assert shown(got[2])[1][1] == list(BLACK) and got[2].rgba[1, 1, 3] == 0 and shown(got[2])[0][0] == list(BLUE)
    assert shown(got[3])[0][0] == list(RED) and shown(got[3])[3][3] == list(BLUE)


def test_interlaced_rows():
    rows = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, 10, step)]
    samples = [r % 4 for r in rows for _ in range(2)]
    got = next(gif.decode(file([((0, 0, 2, 10), samples, 0, None, 0x40)], size=(2, 10))))
    palette = [BLACK, RED, GREEN, BLUE]
    assert [tuple(row[0]) for row in shown(got)] == [palette[r % 4] for r in range(10)]


@pytest.mark.parametrize("payload", [bytes(576), b"\xff" * 576 * 40, bytes(random.Random(1).randrange(256) for _ in range(576 * 17)), b"abcab" * 576 * 8])
def test_payload_round_trip(payload):
    boxes = [f.rgba[f.box[1] : f.box[1] + f.box[3], :, 0].tobytes() for f in gif.decode(gif.encode(payload))]
    assert b"".join(boxes) == payload


def test_broken_files():
    whole = gif.encode(b"x" * 576)
    for bad in (b"", b"GIF", b"PNG89a" + whole[6:], whole[:50], whole[:-40], whole[:789] + b"\x99" + whole[790:]):
        with pytest.raises(ValueError):
            list(gif.decode(bad))


def test_columns(spark):
    rows = [(1, "ab", 1), (2, None, 1), (3, "", 1), (4, "é" * 30_000, 1), (1, "ab", 1), (None, "ab", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media_bytes int")
    got = gif.read_back(gif.to_media(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (2, 3, 4):
            body = {2: b"", 3: b"", 4: ("é" * 30_000).encode()}[r["doc_id"]]
            payload = body + b"\xff" * (-len(body) % 576 if body else 576)
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] in (1, None)}) == 1
    assert gif.read_back(gif.to_media(docs.limit(0))).count() == 0


def test_frames_have_times_and_histograms(spark):
    good = file([((0, 0, 4, 4), [1] * 16, 1, None, 0), ((0, 0, 2, 2), [2] * 4, 1, None, 0)])
    media = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"no")), (3, None)], "doc_id long, media binary")
    got = {(r["id"], r["frame"]): r for r in gif.frames(media).collect()}
    assert got[1, 1]["start_ms"] == 50 and got[1, 1]["delay_ms"] == 50
    assert got[1, 0]["hist_r"] == [0] * 7 + [16] and got[1, 1]["hist_g"] == [12] + [0] * 6 + [4]
    assert len(got[1, 0]["rgb"]) == 48 and got[2, None]["error"] and got[3, None]["error"]
    assert np.frombuffer(got[1, 0]["rgb"], np.uint8)[:3].tolist() == list(RED)
