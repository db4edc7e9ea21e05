"""Benchmark decontamination by a prefix-filtered set join (operator 7).

Benchmark items are cut into windows of ``window`` consecutive words (an item of fewer words is one
window).  Words are ordered by how many documents have them; as a window must be contained whole,
its necessary prefix is its one rarest word.  A document's words are met with those prefix words
only; each meeting fixes where the window would start, so windows that would begin before the
document or end after it fall to the positional and length bounds, and the rest are verified word by
word.  Documents are only mapped over: nothing of theirs is shuffled but counts of benchmark words.

The query side is taken in blocks of at most ``BLOCK_WORDS`` words, so what is sent to executors has
a fixed bound whatever the size of the benchmark: a larger one takes more maps over the documents.

Defined results: null or wordless texts have no words and no hits; null or wordless items, and items
without an id, match nothing; repeated item ids are one item with all their texts' windows; repeated
rows are judged one by one; empty tables give empty or unmarked results; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

WINDOW = 8
MIN_ITEMS = 2
BLOCK_WORDS = 1_000_000
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def windows_of(words: list[bytes], window: int) -> Iterator[tuple[bytes, ...]]:
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield tuple(words[i : i + window])


def _blocks(items: DataFrame, window: int) -> Iterator[dict[tuple[bytes, ...], set[int]]]:
    """The windows of the items with their item ids, in blocks of bounded size."""
    block: dict[tuple[bytes, ...], set[int]] = {}
    size = 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").toLocalIterator():
        for w in windows_of(words_of(row["text"]), window):
            block.setdefault(w, set()).add(row["item_id"])
            size += len(w)
            if size >= BLOCK_WORDS:
                yield block
                block, size = {}, 0
    if block:
        yield block


def _frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the vocabulary occurs; counted on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for batch in batches:
            for text in common.texts(batch):
                n.update(vocabulary.intersection(words_of(text)))
        yield pa.record_batch([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    counted = common.arrow_map(docs.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}  # at most the block's words


def _matcher(block: dict[tuple[bytes, ...], set[int]], frequency: dict[bytes, int]):
    """prefix word -> {(its place in the window, the window's length): {window: items}}"""
    index: dict[bytes, dict[tuple[int, int], dict[tuple[bytes, ...], list[int]]]] = {}
    for w, items in block.items():
        rarest = min(w, key=lambda x: (frequency.get(x, 0), x))
        index.setdefault(rarest, {}).setdefault((w.index(rarest), len(w)), {})[w] = sorted(items)
    return index


def _mark(index, words: list[bytes], hits: list[tuple[int, int]], items: set[int]) -> None:
    if index.keys().isdisjoint(words):
        return
    n = len(words)
    for at, word in enumerate(words):
        if word in index:
            for (place, length), windows in index[word].items():
                start = at - place
                if start >= 0 and start + length <= n and (found := windows.get(tuple(words[start : start + length]))):
                    hits.append((start, start + length))
                    items.update(found)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each document with its words' count, merged hit spans (in words, end exclusive) and the items found.

    ``keep`` names further columns of ``docs`` to carry through.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(f"_keep_{c}") for c in keep])
    carried = base.withColumns({"_n": F.lit(0).cast("long"), "_hits": F.lit(None).cast("array<struct<start:int,end:int>>"), "_items": F.lit(None).cast("array<long>")})
    blocks = 0
    for block in _blocks(items, window):
        index = _matcher(block, _frequencies(base, frozenset(x for w in block for x in w)))
        carried = common.arrow_map(carried, _step(index), carried.schema)
        blocks += 1
    if not blocks:
        carried = common.arrow_map(carried, _step({}), carried.schema)
    return carried.select("doc_id", F.col("_n").alias("n_words"), F.col("_hits").alias("hits"), F.col("_items").alias("items"), "text", *[F.col(f"_keep_{c}").alias(c) for c in keep])


def _step(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, all_hits, all_items = [], [], []
            old_hits, old_items = batch.column("_hits").to_pylist(), batch.column("_items").to_pylist()
            for text, h, i in zip(common.texts(batch), old_hits, old_items, strict=True):
                words = words_of(text)
                hits = [(x["start"], x["end"]) for x in h or ()]
                items = set(i or ())
                _mark(index, words, hits, items)
                counts.append(len(words))
                all_hits.append([{"start": a, "end": b} for a, b in _merged(hits)])
                all_items.append(sorted(items))
            new = {"_n": counts, "_hits": all_hits, "_items": all_items}
            yield pa.record_batch([pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name) for f in batch.schema], schema=batch.schema)

    return run


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 (ids sorted as strings, comma-joined), contaminated."""
    found = find(docs, items, window)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
    )
