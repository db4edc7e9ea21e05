import hashlib
import random
import zlib

import numpy as np
import pytest

from terracell.llm import flac


def samples_of(stream):
    return b"".join(x.tobytes() for _, _, _, x in flac.pcm([stream]))


def payloads():
    rng = random.Random(0)
    rnd = np.random.default_rng(0)
    out = [bytes(64), b"a" * 64, b"\0", b"ab", b"abc" * 40, bytes(range(256)) * 9, b"plain words and words again " * 300]
    out += [rnd.integers(0, 256, n).astype(np.uint8).tobytes() for n in (1, 63, 1024, 1025, 5000)]
    out += [(b"\0" * 900 + b"\xff") * 3, bytes(int(128 + 100 * np.sin(i / 9)) for i in range(4000))]
    out += ["".join(rng.choices("abc é日\n", k=rng.randint(1, 3000))).encode() for _ in range(40)]
    return out


def test_round_trip():
    data = payloads()
    for p, s in zip(data, flac.encode(data), strict=True):
        assert s[:4] == b"fLaC" and flac.decode(s) == p


@pytest.mark.parametrize("block", [16, 200])
def test_fast_reader_equals_plain_reader(block):
    data = payloads()
    for p, s in zip(data, flac.encode(data, block), strict=True):
        info = flac.Stream(s)
        for first, offset, n in info.frames:
            got, _ = flac.decode_frame(s, info.start + offset)
            assert bytes(x + 128 for x in got) == p[first : first + n]


def test_seek_offsets():
    data = [b"seek to a place in this text. " * 400]
    for i, at, byte, x in flac.pcm(flac.encode(data)):
        assert data[i][at : at + len(x)] == x.tobytes() and byte > 0


def test_stream_without_seek_table():
    p = b"no table here, so frames are read one by one " * 90
    s = flac.encode([p])[0]
    info = flac.Stream(s)
    head = 4 + 4 + 34
    bare = s[:4] + b"\x80" + s[5:head] + s[info.start :]
    assert flac.Stream(bare).frames is None and flac.decode(bare) == p


def test_damage_is_found():
    p = b"some text that gets damaged " * 100
    s = flac.encode([p])[0]
    start = flac.Stream(s).start
    for at in (0, start, start + 3, start + 40, len(s) - 1):
        bad = bytearray(s)
        bad[at] ^= 0x10
        with pytest.raises(ValueError):
            flac.decode(bytes(bad))
    with pytest.raises((ValueError, IndexError)):
        flac.decode(s[:-20])


def test_partitioned_and_escaped_residuals():
    """A frame that the encoder never writes: fixed order 1, two partitions, one of them escaped."""
    samples = [3, 5, 4, 9, -7, -8, 0, 1]
    bits = "0" + f"{9:06b}" + "0" + f"{samples[0] & 255:08b}" + "00" + f"{1:04b}"
    diffs = [b - a for a, b in zip(samples, samples[1:], strict=False)]
    bits += f"{2:04b}"
    for d in diffs[:3]:
        u = 2 * d if d >= 0 else -2 * d - 1
        bits += "0" * (u >> 2) + "1" + f"{u & 3:02b}"
    bits += "1111" + f"{6:05b}" + "".join(f"{d & 63:06b}" for d in diffs[3:])
    bits += "0" * (-len(bits) % 8)
    body = flac._header(0, 8) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    crc = int(flac.crc16(np.frombuffer(body, np.uint8).astype(np.int64), np.array([0]), np.array([len(body)]))[0])
    assert flac.decode_frame(body + crc.to_bytes(2, "big"), 0)[0] == samples


def test_documents(docs):
    rows = [(1, "text"), (2, None), (3, ""), (4, "é" * 32), (5, "text"), (5, "text"), (None, "x"), (6, "long words " * 30_000)]
    got = flac.media_digests(docs(rows, extra=["media", "n_bytes", "feature"])).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for d, t in rows:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        r = by[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert by[1][1:] == by[5][1:] and by[2][1:] == by[3][1:]
    blocks = flac.blocks(flac.store(docs(rows[:1]))).collect()
    assert b"".join(b["pcm"] for b in blocks)[:4] == b"text"
    assert flac.media_digests(docs([])).count() == 0
