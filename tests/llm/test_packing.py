import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest

from terracell.llm import packing


def best_fit_decreasing(lengths, capacity):
    """The number of bins of the textbook algorithm."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, left in enumerate(bins) if left >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_textbook(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 64])
    lengths = [rng.choice([rng.randint(1, capacity), capacity // 3 + 1, 1]) for _ in range(rng.randint(0, 400))]
    counts = Counter(lengths)
    free = defaultdict(lambda: capacity)
    ranks = defaultdict(set)
    for length, low, high, first, each, base in packing.plan_runs(counts, capacity):
        for r in range(low, high):
            assert r not in ranks[length]
            ranks[length].add(r)
            b, k = first + (r - low) // each, (r - low) % each
            assert capacity - free[b] == base + k * length, "pieces are gapless in the order of placing"
            free[b] -= length
            assert free[b] >= 0
    assert {n: len(r) for n, r in ranks.items()} == dict(counts)
    assert sorted(free.values()) == best_fit_decreasing(lengths, capacity)


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    path = packing.public_tokenizer()
    library, own = Tokenizer.from_file(path), packing.Encoder(path)
    rng = random.Random(3)
    alphabet = ["a", "Word", " ", "  ", "\n", "\t", "é", "日本", "'s", "123", "!?", " ", "<|endoftext|>", " ", "it's", "🙂", "\r\n"]
    texts = ["", " ", "\n", "a b", "  a", "a  b ", "x\n\ny"] + ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(400)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own(t) == struct.pack(f"<{len(ids)}I", *ids), t


def test_documents(docs):
    path = packing.public_tokenizer()
    rows = [(i, "word " * (i % 50)) for i in range(200)] + [(900, None), (901, ""), (901, ""), (902, "long text " * 6000), (None, "no id")]
    got = packing.best_fit_pack(docs(rows, extra=["salt", "length", "rank", "runs"]), path).collect()
    encode = packing.Encoder(path)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(by_doc[901]) == 2 and all(r["length"] == 1 and r["piece"] == 0 for r in by_doc[901])
    ids = encode("long text " * 6000) + struct.pack("<I", 0)
    pieces = sorted(by_doc[902], key=lambda r: r["piece"])
    assert sum(r["length"] for r in pieces) == len(ids) // 4 and len(pieces) > 2
    assert all(r["length"] == packing.CAPACITY for r in pieces[1:])
    for r in pieces:
        assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])])
    lengths = [r["length"] for r in got]
    assert len(by_sequence) == len(best_fit_decreasing(lengths, packing.CAPACITY))


def test_hot_length_is_salted(docs, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 10)
    got = packing.best_fit_pack(docs([(i, "same words here") for i in range(300)]), packing.public_tokenizer(), 64).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 300
    n = got[0]["length"]
    assert len({r["sequence_id"] for r in got}) == -(-300 // (64 // n))


def test_empty(docs):
    assert packing.best_fit_pack(docs([]), packing.public_tokenizer()).count() == 0
