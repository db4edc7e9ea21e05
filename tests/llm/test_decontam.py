import hashlib
import random
import re

import pytest

from terracell.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, size=8):
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for i, u in items:
            v = words(u)
            for k in range(max(1, len(v) - size + 1)) if v and i is not None else ():
                win = v[k : k + size]
                for at in range(len(w) - len(win) + 1):
                    if w[at : at + len(win)] == win:
                        hit.update(range(at, at + len(win)))
                        found.add(i)
        ids = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_equals_brute_force(docs, spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    rng = random.Random(0)
    vocabulary = ["the", "of", "Éa", "x1", "Word", "rare", "ab-cd", "日本", "q"]
    passage = lambda k: " ".join(rng.choices(vocabulary, k=k))
    items = [(i, passage(rng.choice([1, 3, 8, 12, 20]))) for i in range(25)] + [(30, None), (31, ""), (32, "?!"), (None, "the of"), (5, passage(9)), (10, "x1 x1 x1 x1 x1 x1 x1 x1 x1")]
    rows = [(i, " ".join(rng.choice([passage(6), rng.choice(items)[1] or "", rng.choice(items[:20])[1][4:]]) for _ in range(4))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "..."), (203, "x1 " * 30), (203, "x1 " * 30), (None, items[2][1])]
    item_frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as n", "'x' as word")
    got = decontam.decontaminate(docs(rows, extra=["n_words", "hits", "_n", "items"]), item_frame).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, items)


def test_empty_sides(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs([]), none).count() == 0
    got = decontam.decontaminate(docs([(1, "some words")]), none).first()
    assert (got["n_words"], got["n_hit"], got["n_items"], got["contaminated"]) == (2, 0, 0, False)
