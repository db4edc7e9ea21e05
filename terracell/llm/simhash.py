"""SimHash near-duplicates by deletion-variant signatures (operator 8).

Fingerprints are made in one map over the documents.  Distinct fingerprints are cut into two halves,
indexed by every variant of a half with one bit cleared, joined on equal variants, verified on
all bits, and grouped by connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .components import components

SEED = 42


def shingle_hashes(text: str, shingle: int, seed: int = SEED) -> np.ndarray:
    """Unsigned XXH64 of each word shingle, repeats included; fewer words: the whole sequence."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: n - shingle])]
    pieces = map(joined.__getitem__, map(slice, starts, ends[shingle - 1 :]))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, n - shingle + 1)


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """Of each list of hashes the 64 bits that are set in over half of them; none: zero."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for k, h in enumerate(hashes):
        if not sizes[k]:
            continue
        counts = np.zeros(64, np.int64)
        for i in range(0, len(h), 65536):
            part = h[i : i + 65536]
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = weights[2 * counts > sizes[k]].sum(dtype=np.uint64)
    return out


def fingerprinted(shingle: int, seeds: tuple[int, ...] = (SEED,), column: str = "text"):
    """A mapInArrow function: documents to (doc_id, fp), fp being one 64-bit fingerprint per seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.texts(batch, column)
            fps = [fingerprints([shingle_hashes(t, shingle, seed) for t in texts]).view(np.int64) for seed in seeds]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in fps)], names=["doc_id", *(f"fp{i}" if i else "fp" for i in range(len(seeds)))])

    return run


def variants(fps: DataFrame) -> DataFrame:
    """64 rows a fingerprint: either half with one of its bits cleared, as (key, fp)."""
    half = F.expr("if(bit < 32, fp & 4294967295L, shiftrightunsigned(fp, 32))")
    key = F.expr("shiftleft(cast(bit as bigint), 32) | (half & ~shiftleft(1L, bit % 32))")
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).select("fp", "bit", half.alias("half")).select("fp", key.alias("key"))


#: One row of a pair, whatever the number of variants that both have: found by the first half if that
#: differs in at most one bit, at the bit that differs or else at bit 0.
_PAIR = """
    a.fp < b.fp and bit_count(a.fp ^ b.fp) <= {most} and
    case when a.key < 137438953472 then
        (((a.fp ^ b.fp) & 4294967295L) = shiftleft(1L, cast(shiftright(a.key, 32) as int) % 32))
        or (((a.fp ^ b.fp) & 4294967295L) = 0 and shiftright(a.key, 32) = 0)
    else bit_count((a.fp ^ b.fp) & 4294967295L) >= 2 and (
        shiftrightunsigned(a.fp ^ b.fp, 32) = shiftleft(1L, cast(shiftright(a.key, 32) as int) % 32)
        or (shiftrightunsigned(a.fp ^ b.fp, 32) = 0 and shiftright(a.key, 32) = 32)) end
"""
#: Members of a variant's bucket beyond which the bucket is cut further.
BUCKET = 512


def links(fps: DataFrame, most: int = 2) -> DataFrame:
    """Pairs (a, b) of different fingerprints that differ in at most ``most`` bits; most is 1 or 2.

    ``fps`` has distinct fingerprints ``fp``.  Of two that differ in at most two bits, one half differs
    in at most one bit, so both share a variant of that half with that bit cleared: an equality join
    finds the pair and the whole fingerprint verifies it.  Buckets of more than ``BUCKET`` members are
    cut by the other half: of its three parts one must be equal, so (variant, part, value) joins
    them without comparing all members with each other.
    """
    if most not in (1, 2):
        raise ValueError("most must be 1 or 2")
    indexed = variants(fps)
    pair = F.expr(_PAIR.format(most=most))
    large = common.cut(indexed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("key"))
    if large.isEmpty():
        return indexed.alias("a").join(indexed.alias("b"), (F.col("a.key") == F.col("b.key")) & pair).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    rest = indexed.join(large, "key", "left_anti")
    other = F.expr("if(key < 137438953472, shiftrightunsigned(fp, 32), fp & 4294967295L)")
    parts = F.array(*[F.struct(F.lit(i).alias("part"), F.expr(e).alias("value")) for i, e in enumerate(("other & 2047", "shiftright(other, 11) & 2047", "shiftright(other, 22)"))])
    cut = indexed.join(large, "key", "left_semi").withColumn("other", other).select("fp", "key", F.explode(parts).alias("p")).select("fp", "key", "p.part", "p.value")
    found = rest.alias("a").join(rest.alias("b"), (F.col("a.key") == F.col("b.key")) & pair).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "part", "value")]
    more = cut.alias("a").join(cut.alias("b"), same[0] & same[1] & same[2] & pair).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    return found.union(more.distinct())


def simhash_groups(docs: DataFrame, shingle: int = 3, most: int = 2) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Copies collapse to one fingerprint before anything is joined, so a group of copies of any size
    costs one row.  Defined results: null, empty and wordless texts have fingerprint zero and link like
    others; repeated rows give repeated results; null doc_ids keep their row and never name a
    component that has another member with an id; an empty table gives no rows.
    """
    marked = common.cut(common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fingerprinted(shingle), "doc_id long, fp long"))
    fps = common.cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(links(fps.select("fp"), most))
    rooted = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
