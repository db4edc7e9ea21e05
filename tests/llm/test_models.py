"""Quality ranking and language-model scores."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.llm import lm, quality

DATA = "/root/testdata/sf0.01"


def labelled(docs, spark, n=300, seed=0):
    rng = random.Random(seed)
    words = "a river runs below the quiet hills and people tell of it at night when lamps are lit".split()
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = " ".join(rng.choices(words, k=40)).capitalize() + "." if good else " ".join(rng.choice(["BUY NOW!!!", "click | here", "$$$ 999"]) for _ in range(20))
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_ranking_on_held_out_rows(docs, spark):
    rows, labels = labelled(docs, spark)
    rows += [(900, None), (901, ""), (None, "no id"), (902, "word " * 50_000), (5, rows[5][1])]
    got = quality.classify(docs(rows, extra=["score", "predicted", "quality", "x"]), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[900] == by[901]


def test_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs([(1, "a"), (2, None)]), none).collect()
    assert [r["score"] for r in got] == [0.5, 0.5]
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 7, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs([(1, "a"), (2, "b"), (3, "c")]), odd).count() == 3
    assert quality.classify(docs([]), odd).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_held_out_accuracy_on_the_test_table(spark):
    docs_, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.classify(docs_, labels).where("held_out").join(labels, "doc_id").toPandas()
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    auc = np.mean(good[:, None] > bad[None, :]) + np.mean(good[:, None] == bad[None, :]) / 2
    accuracy = (got.predicted == got.quality).mean()
    assert auc > 0.9 and accuracy > 0.9, (auc, accuracy)


def losses(rows, target):
    """(target loss, background loss) of each text by counters, its own counts left out."""
    pairs = lambda t: [*zip(w := ["", *(t or "").lower().split()], [*w[1:], ""], strict=True)]
    flags = [d in target for d, _ in rows]
    sides = [Counter(p for (_, t), f in zip(rows, flags, strict=True) if f == side for p in pairs(t)) for side in (True, False)]
    size = len({w for c in sides for p in c for w in p})
    totals = [c.total() for c in sides]
    scales = [1.0, totals[0] / totals[1] if all(totals) else 1.0]
    s = lm.SMOOTHING
    out = []
    for (d, t), flag in zip(rows, flags, strict=True):
        own, means = Counter(pairs(t)), []
        for side, (c, by) in enumerate(zip(sides, scales, strict=True)):
            left = c - own if flag == (side == 0) else c
            word = Counter()
            for (a, _), n in left.items():
                word[a] += n * by
            p = lambda b: (word[b] + 1) / (left.total() * by + size)
            means.append(np.mean([math.log((word[a] + s) / (left[a, b] * by + s * p(b))) for a, b in pairs(t)]))
        out.append((d, len(pairs(t)), *means))
    return out


ROWS = [(i, "ab cd ab cd") for i in range(4)] + [(10 + i, "cd ab  cd AB") for i in range(4)] + [(20, None), (21, ""), (10, "cd ab  cd AB"), (22, "ef gh " * 50), (None, "ab")]


@pytest.mark.parametrize("chunk", [1, 7, 1_500_000])
def test_losses_equal_counters(docs, spark, chunk):
    """Whatever the chunks; a model of spelling alone couldn't tell the two sides apart."""
    ids = spark.createDataFrame([(0,), (1,), (2,), (2,), (3,), (None,), (77,)], "doc_id long")
    frame = docs(ROWS, extra=["is_target", "code", "score", "chunk"])
    got = lm.cross_entropy_difference(frame, ids, chunk=chunk).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(losses(ROWS, {0, 1, 2, 3}), key=key)
    assert len(got) == len(want)
    for r, w in zip(sorted(got, key=key), want, strict=True):
        assert (r["doc_id"], r["n_tokens"]) == w[:2]
        assert (r["target_loss"], r["background_loss"]) == pytest.approx(w[2:])
        assert r["score"] == pytest.approx(w[2] - w[3])
    assert max(r["score"] for r in got if r["doc_id"] in (0, 1, 2, 3)) < min(r["score"] for r in got if r["doc_id"] in (10, 11, 12, 13))


def test_one_sided_and_empty(docs, spark):
    none = spark.createDataFrame([], "doc_id long")
    got = lm.cross_entropy_difference(docs([(1, "a"), (2, None), (2, None)]), none).collect()
    assert len(got) == 3 and all(math.isfinite(r["score"]) for r in got)
    assert lm.cross_entropy_difference(docs([]), none).count() == 0
    large = lm.cross_entropy_difference(docs([(1, "word " * 20_000), (2, "a")]).withColumn("n", F.lit(1)), none)
    assert large.count() == 2


def test_query(docs, spark, tmp_path):
    from terracell.llm.queries import QUERIES

    docs(ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(4)] + [(10, 0, 0), (11, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op10_lm_cross_entropy"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in got) == sorted((d or -1, round(t - b, 9)) for d, _, t, b in losses(ROWS, {0, 1, 2, 3}))
