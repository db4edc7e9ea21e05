"""Best-fit packing of token sequences (operator 1).

Documents become token ids on the executors; only (doc_id, piece, start, length, crc32) rows
leave that step.  Best-fit decreasing depends on nothing but how many pieces there are of each
length, so the driver plans over a histogram of at most ``capacity`` counts: a segment tree over
remaining capacities finds the tightest open bins for a length in logarithmic time, and a whole
run of equal bins is filled in one step.  The plan - runs of ranks per length - is joined back to
the pieces by (length, salt), where a salt holds some thousands of pieces, so that a length that
a third of all pieces share is spread over many tasks.

Defined results: a null or empty text is the single end id; repeated rows and repeated doc_ids are
packed as separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from . import common

CAPACITY = 2048
END_ID = 0
SALT_ROWS = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """Token ids of a byte-level BPE file of the tokenizers library, as little-endian 32-bit bytes.

    The same merges are run by a faster engine built from the file's own vocabulary; words between
    single spaces are independent of each other under the file's pre-tokenizer, so their ids are kept
    in bounded caches.  Texts with the file's special tokens, which that engine would not treat
    the same, go through the tokenizers library itself.
    """

    CACHE = 200_000
    #: White space other than the space and the line feed.
    ODD_SPACE = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x3001) if chr(c).isspace() and c not in (10, 32)) + "]")

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(letters)]
        to_byte = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(others)}
        skip = set(self.special)
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in skip}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.slow = None
        self.first: dict[str, bytes] = _Ids("", self.fast, self.CACHE)
        self.rest: dict[str, bytes] = _Ids(" ", self.fast, self.CACHE)
        self.newline = array("I", self.fast("\n")).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()
        if self.ODD_SPACE.search(text):
            return array("I", self.fast(text)).tobytes()
        parts: list[bytes] = []
        for i, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if "" in words:  # spaces in a row, at an end, or an empty line: white space then joins
                return array("I", self.fast(text)).tobytes()
            if i:
                parts.append(self.newline)
            parts.append(self.first[words[0]])
            parts.extend(map(self.rest.__getitem__, words[1:]))
        self.first.trim()
        self.rest.trim()
        return b"".join(parts)


class _Ids(dict):
    def __init__(self, lead: str, encode, most: int):
        super().__init__()
        self.lead, self.encode, self.most = lead, encode, most

    def __missing__(self, word: str) -> bytes:
        out = array("I", self.encode(self.lead + word)).tobytes()
        if len(word) < 64:
            self[word] = out
        return out

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


def tokenized(tokenizer_path: str, capacity: int, column: str = "text"):
    """A mapInArrow function: documents to pieces; the first piece of a long document takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer_path)
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch, column), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                at, piece = 0, 0
                size = n % capacity or min(n, capacity)
                while at < n:
                    for col, v in zip(out, (doc_id, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])), strict=True):
                        col.append(v)
                    at, piece, size = at + size, piece + 1, capacity
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class OpenCapacities:
    """Segment tree over remaining capacities 0..capacity: the smallest one >= x that has open bins."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.tree = bytearray(2 * self.size)

    def set(self, at: int, on: bool) -> None:
        i = at + self.size
        self.tree[i] = on
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]

    def at_least(self, x: int) -> int | None:
        i = x + self.size
        if i >= 2 * self.size:
            return None
        if self.tree[i]:
            return x
        while i > 1:  # up to the first right sibling that has an open bin, then down its left edge
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Gives runs (length, rank_from, rank_to, first_bin, per_bin, offset): the pieces of that length
    with those ranks (end exclusive) go ``per_bin`` to a bin, from ``first_bin`` on, at ``offset``.
    Equal bins are kept as groups [first_bin, n].  A bin that takes one piece of a length and
    still has room stays the tightest one, so each bin takes as many as fit before the next.
    """
    tree = OpenCapacities(capacity)
    groups: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def put(left: int, first: int, n: int) -> None:
        if n and left > 0:
            groups.setdefault(left, []).append((first, n))
            tree.set(left, True)

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = tree.at_least(length)
            if left is None:
                left, first, n = capacity, bins, -(-todo // (capacity // length))
                bins += n
            else:
                first, n = groups[left].pop()
                if not groups[left]:
                    tree.set(left, False)
            each = left // length
            whole = min(n, todo // each)
            if whole:
                runs.append((length, rank, rank + whole * each, first, each, capacity - left))
                put(left - each * length, first, whole)
                rank, todo = rank + whole * each, todo - whole * each
                first, n = first + whole, n - whole
            if n and todo:  # fewer than a bin takes
                runs.append((length, rank, rank + todo, first, todo, capacity - left))
                put(left - todo * length, first, 1)
                rank, todo, first, n = rank + todo, 0, first + 1, n - 1
            put(left, first, n)
    return runs


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and length (1..capacity)."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs = spark.createDataFrame(plan_runs(counts, capacity), "length long, rank_from long, rank_to long, first_bin long, per_bin long, base long")
    salts = F.create_map(*[x for k, n in sorted(counts.items()) if n > SALT_ROWS for x in (F.lit(k), F.lit(-(-n // SALT_ROWS)))]) if any(n > SALT_ROWS for n in counts.values()) else None
    n_salts = F.lit(1) if salts is None else F.coalesce(F.try_element_at(salts, F.col("length")), F.lit(1))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), n_salts))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # counts per salt are thousands of times fewer than the pieces
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    spans = sizes.withColumn("low", F.coalesce(before, F.lit(0))).join(runs, "length").where("low < rank_to and rank_from < low + n")
    spans = spans.groupBy("length", "salt").agg(F.first("low").alias("low"), F.sort_array(F.collect_list(F.struct("rank_from", "rank_to", "first_bin", "per_bin", "base"))).alias("runs"))
    ranked = salted.withColumn("at", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    placed = ranked.join(spans, ["length", "salt"]).withColumn("rank", F.col("low") + F.col("at"))
    run = F.filter("runs", lambda r: (r["rank_from"] <= F.col("rank")) & (F.col("rank") < r["rank_to"]))[0]
    placed = placed.withColumn("run", run).withColumn("within", F.col("rank") - F.col("run.rank_from"))
    return placed.select(
        *pieces.columns,
        (F.col("run.first_bin") + F.floor(F.col("within") / F.col("run.per_bin"))).cast("long").alias("sequence_id"),
        (F.col("run.base") + F.col("within") % F.col("run.per_bin") * F.col("length")).cast("long").alias("offset"),
    )


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """All documents packed into sequences of at most ``capacity`` tokens, one row per piece.

    ``docs`` needs doc_id and text.  The token pieces are checkpointed, as they are counted, ranked
    and placed: recomputing them would tokenize the corpus again.
    """
    pieces = common.cut(common.arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), tokenized(tokenizer_path, capacity), PIECES))
    return pack(pieces, capacity)
