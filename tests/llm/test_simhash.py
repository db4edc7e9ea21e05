import random
import time

import numpy as np
import pytest
import xxhash

from terracell.llm import neardup, simhash
from terracell.plans import iterate


def fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(items, linked):
    """item -> its component's least item number, by plain union."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def expected(rows):
    fps = [fingerprint(t) for _, t in rows]
    roots = reachable(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for r, (d, _) in zip(roots, rows, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, roots, strict=True)), key=str)


@pytest.mark.parametrize("bucket", [512, 1])
def test_equals_brute_force(docs, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(40):
        own = rng.choices(words, k=rng.randint(1, 120))
        rows.append((i, " ".join(own)))
        own[rng.randrange(len(own))] = "Edit"
        rows.append((500 + i, " ".join(own)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "A b"), (204, "a B"), (None, "a b"), (None, "alone here"), (203, "A b"), (900, rows[0][1].upper())]
    got = simhash.simhash_groups(docs(rows, extra=["fp", "key", "node", "root", "bit"])).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == expected(rows)


@pytest.mark.parametrize("bucket", [512, 2])
def test_links_at_two_bits(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 3))))
    fps = sorted(int(x) for x in np.array(sorted(fps), np.uint64).view(np.int64))
    got = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    mask = (1 << 64) - 1
    wanted = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & mask).bit_count() <= 2}
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in got]
    assert set(pairs) == wanted


def test_empty(docs):
    assert simhash.simhash_groups(docs([])).count() == 0
    assert neardup.keep_one(docs([])).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b)


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_near_duplicates_are_found_and_others_stay(docs):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(3000)]
    rows, number = [], 0
    for _ in range(30):
        own = rng.choices(words, k=rng.randint(60, 300))
        for copy in range(4):
            now = list(own)
            if copy:
                now[rng.randrange(len(now))] = f"edit{number}"
            rows.append((number, " ".join(now)))
            number += 1
    rows += [(number, rows[0][1]), (number + 1, rows[0][1].upper()), (number + 2, None), (number + 3, ""), (number + 4, "just three words"), (number + 5, "just three words")]
    frame = docs(rows, extra=["node", "copy", "key", "root"])
    got = neardup.keep_one(frame)
    assert got.columns == frame.columns
    kept = {r["doc_id"] for r in got.collect()}
    sets = [shingles(t) for _, t in rows]
    roots = reachable(sets, lambda a, b: a == b or (bool(a | b) and jaccard(a, b) >= 0.8))
    groups = {}
    for r, (d, _) in zip(roots, rows, strict=True):
        groups.setdefault(r, []).append(d)
    assert kept == {min(g) for g in groups.values()}


def test_repeated_rows_keep_one(docs):
    kept = neardup.keep_one(docs([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "h i j k l m")])).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2]


def varied(rng, own, number, n=5):
    """The words with some replaced, far from each other."""
    now = list(own)
    for k in rng.sample(range(5, len(now) - 5, 6), n):
        now[k] = f"edit{number}x{k}"
    return now


def kept_by_brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    roots = reachable(sets, lambda a, b: a == b or (bool(a | b) and jaccard(a, b) >= 0.8))
    return {min(d for (d, _), x in zip(rows, roots, strict=True) if x == r) for r in set(roots)}


def test_star_of_variants_and_a_crowded_bucket(docs):
    """Variants are similar to their base, which isn't first of its buckets, and not to each other."""
    rng = random.Random(7)
    words = [f"word{i}" for i in range(3000)]
    rows = []
    base = rng.choices(words, k=250)
    rows += [(1000 + i, " ".join(varied(rng, base, i))) for i in range(300)] + [(5000, " ".join(base))]
    few = [f"few{i}" for i in range(60)]  # unrelated texts of the same words, and near copies among them
    for i in range(60):
        own = rng.sample(few, k=60)
        rows += [(2000 + i, " ".join(own)), (3000 + i, " ".join([*own, "end"]))]
    assert max(jaccard(shingles(rows[0][1]), shingles(t)) for _, t in rows[1:300]) < 0.8
    kept = {r["doc_id"] for r in neardup.keep_one(docs(rows)).collect()}
    assert kept == kept_by_brute_force(rows) == {1000, *range(2000, 2060)}


@pytest.mark.parametrize("frequent", [200_000, 3])
def test_whole_passages_appended_or_replaced(docs, monkeypatch, frequent):
    """Distinct words change as much as shingles here, so that word fingerprints miss about half."""
    monkeypatch.setattr(neardup, "FREQUENT", frequent)
    rng = random.Random(8)
    rows = []
    for i in range(100):
        words = [f"t{i}w{k}" for k in range(rng.randint(80, 400))]
        n = round(len(words) * rng.uniform(0.08, 0.24 if i % 2 else 0.11))
        new = [f"t{i}new{k}" for k in range(n)]
        at = rng.randrange(len(words) - n)
        rows += [(i, " ".join(words)), (1000 + i, " ".join([*words, *new] if i % 2 else [*words[:at], *new, *words[at + n :]]))]
    alike = sum(jaccard(shingles(rows[2 * i][1]), shingles(rows[2 * i + 1][1])) >= 0.8 for i in range(100))
    assert 60 < alike < 100
    assert {r["doc_id"] for r in neardup.keep_one(docs(rows)).collect()} == kept_by_brute_force(rows)


def join_rows(spark, first):
    """The most rows that a join has made since the execution ``first``."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for i in range(runs.size()):
        number = runs.apply(i).executionId()
        if number < first:
            continue
        nodes, values = store.planGraph(number).allNodes(), store.executionMetrics(number)
        for k in range(nodes.size()):
            metrics = nodes.apply(k).metrics() if "Join" in nodes.apply(k).name() else None
            for j in range(metrics.size() if metrics else 0):
                value = values.get(metrics.apply(j).accumulatorId()) if metrics.apply(j).name() == "number of output rows" else None
                most = max(most, int(value.get().replace(",", "")) if value is not None and value.isDefined() else 0)
    return most


def crowd(rng, n):
    """Texts that share a passage and little else, near copies of one, and near copies of the others."""
    passage = [f"p{i}" for i in range(34)]
    rows = [(i, " ".join([*passage, *(f"own{i}x{k}" for k in range(rng.choice((5, 6, 6, 7))))])) for i in range(n)]
    rows += [(10_000 + i, f"{rows[i][1]} more{i}") for i in range(0, n, 3)]
    base = [*passage, *(f"base{k}" for k in range(8))]
    for i in range(n // 4):
        now = list(base)
        for k in rng.sample(range(len(now)), rng.choice((1, 1, 2))):
            now[k] = f"edit{i}x{k}"
        rows.append((20_000 + i, " ".join(now)))
    return rows


def test_a_crowd_that_shares_a_passage_is_not_compared_pair_by_pair(spark, docs):
    rows = crowd(random.Random(11), 400)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    first = runs.apply(runs.size() - 1).executionId() + 1 if runs.size() else 0
    kept = {r["doc_id"] for r in neardup.keep_one(docs(rows)).collect()}
    assert kept == kept_by_brute_force(rows)
    assert 0 < join_rows(spark, first) < 100 * len(rows)


@pytest.mark.parametrize("size", [2, 9])
def test_crowds_of_any_size_find_all_links(docs, monkeypatch, size):
    monkeypatch.setattr(neardup, "CROWD", size)
    rng = random.Random(12 + size)
    rows = crowd(rng, 40)
    few = [f"few{i}" for i in range(12)]
    rows += [(30_000 + i, " ".join(rng.choices(few, k=rng.randint(5, 9)))) for i in range(40)]
    own = [f"w{i}" for i in range(60)]
    for i in range(25):  # each is similar to the last, ends are not
        own = [*own[2:], f"chain{i}a", f"chain{i}b"]
        rows.append((40_000 - i, " ".join(own)))
    assert {r["doc_id"] for r in neardup.keep_one(docs(rows)).collect()} == kept_by_brute_force(rows)


def test_ids_beyond_the_broadcast_do_not_shuffle_texts(spark, monkeypatch, tmp_path):
    """Of many texts a bit each goes to the rows, in words that several share; the result stays what it is."""
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 3)
    rng = random.Random(13)
    rows = [(i, " ".join(f"{rng.getrandbits(256):x}" for _ in range(300))) for i in range(120)]
    rows += [(500 + i, f"{rows[i][1]} more") for i in range(10)] + [(600 + i, rows[i][1]) for i in range(50)] + rows[:5] + [(None, rows[7][1]), (None, "none else")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    plans = []
    monkeypatch.setattr(neardup.common, "arrow_map", lambda df, *a, f=neardup.common.arrow_map: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df, *a))
    kept = [r["doc_id"] for r in neardup.keep_one(spark.read.parquet(f"{tmp_path}/documents")).collect()]
    assert sorted(kept, key=str) == sorted([*range(120), None], key=str)
    # texts are worked on where they are read
    assert len(plans) > 2 and all("FileScan parquet" in p and "hashpartitioning" not in p for p in plans)


def test_files_that_nothing_needs_go(spark, docs, monkeypatch):
    monkeypatch.setattr(iterate, "TIDY_S", 0.0)
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before, seen = files(), []
    monkeypatch.setattr(neardup, "_alike", lambda *a, f=neardup._alike: seen.append(files()) or f(*a))
    neardup.keep_one(docs(crowd(random.Random(14), 60))).count()
    time.sleep(1)
    assert len(seen) > 2 and files() - before < max(seen) - before  # they only grew before
