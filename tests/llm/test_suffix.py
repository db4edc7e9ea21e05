import hashlib
import random

import numpy as np
import pytest

from terracell.llm import suffix


def brute(rows, length):
    """doc_id -> (n_removed, n_spans, kept), by a table of all windows."""
    owner = {}
    order = lambda d: suffix.LAST if d is None else d
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            owner[w] = min(owner.get(w, suffix.LAST), order(d))
    out = []
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if owner[t[i : i + length]] < order(d):
                gone[i : i + length] = [True] * length
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def collected(frame):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in frame.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(docs, seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abcd é", k=rng.randint(8, 60))) for _ in range(12)]
    rows = [(i, "".join(rng.choice([rng.choice(passages), rng.choice(passages)[3:], "".join(rng.choices("abcdefgh", k=20)), "a" * 30]) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, rows[5][1]), (72, rows[5][1]), (3, rows[9][1]), (None, rows[7][1])]
    rows += [(100 + i, rows[11][1] + "tail") for i in range(40)]
    for length in (8, 12):
        got = suffix.digests(docs(rows, extra=["batch", "bucket", "spans"]), length)
        assert collected(got) == brute(rows, length)


def test_long_text_is_chunked(docs, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 512)
    monkeypatch.setattr(suffix, "SORT_BYTES", 128)
    rng = random.Random(5)
    long = "".join(rng.choices("abcdefghij ", k=6000))
    rows = [(1, long), (2, long[1000:2500] + "other" + long[100:400]), (3, long[::-1]), (4, long[1300:1800])]
    assert collected(suffix.digests(docs(rows), 50)) == brute(rows, 50)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_is_sorted(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 97 + 1 + seed % 3, 400).astype(np.uint8)
    depth = 12
    got = suffix.suffix_array(text, depth)
    raw = text.tobytes()
    keys = [raw[i : i + depth] for i in got.tolist()]
    assert sorted(got.tolist()) == list(range(len(text)))
    assert keys == sorted(keys)


def test_empty(docs):
    assert suffix.digests(docs([])).count() == 0
    assert collected(suffix.digests(docs([(1, None)]))) == brute([(1, None)], 50)


def test_nothing_is_shared(docs):
    rows = [(i, f"{i} " * 3) for i in range(8)] + [(20, "".join(chr(97 + (i * i + 7 * i) % 26) for i in range(90)))]
    assert collected(suffix.digests(docs(rows))) == brute(rows, 50)
