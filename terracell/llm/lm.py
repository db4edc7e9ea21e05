"""Language-model scoring by cross-entropy difference (operator 10).

Two word bigram models, of the target documents and of all others, share one vocabulary: the corpus's
words, A-Z lower-cased, and an edge that stands before and after each text; so no text has unknown words.
Counts are matched: the background's are scaled to the target's number of words, so that both models
are smoothed alike.  With counts c of one side, N its words, V the vocabulary and s the smoothing,

    p(b) = (c(b) + 1) / (N + V)        p(b | a) = (c(ab) + s p(b)) / (c(a) + s)

A document's score is the mean over its words and end of target loss minus background loss: lower is
closer to the target.  A document's own counts are left out of the side that it belongs to (leave one
out), so no document is scored by a model that counted it; a copy of it still counts.

Counts cover all documents and grow with them; they are never in one place.  Documents are taken in
chunks of ``CHUNK`` words.  A chunk sends each of its different words and bigrams once, with its
counts, to the bucket that the code falls in; buckets sum, and answer each chunk in the order that it
asked; the chunk's documents, sent on as word numbers, are scored with the answers.  So a word pair that
every document has costs one number a chunk and no task gets more of it.  The driver gets three sums.

Defined results: null and empty texts are one token, the edge; repeated rows count and score each time;
null doc_ids are background and keep their rows; a corpus without target documents, or without others,
has models of smoothing alone on that side; empty tables give no rows; other columns are ignored.  A very
long text is one chunk by itself: a text must fit in a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common

SMOOTHING = 32.0  # weight, in words, of the shorter context
BROADCAST_IDS = 1_000_000  # target ids up to this number are broadcast; beyond it, documents are shuffled to them
CHUNK = 2_000_000  # words that are counted and scored together
BUCKET = 2_000_000  # words of the corpus for each bucket of codes, at least

_ASKED = "bucket int, chunk long, codes binary, target binary, background binary, ids array<long>, sizes binary, flags binary, words binary, hashes binary"
_U = np.uint64


def pack(values: np.ndarray) -> bytes:
    """An array's bytes by place and compressed: the high ones of small numbers cost next to nothing."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One even code for each pair of word hashes."""
    x = a * _U(0x9E3779B97F4A7C15) ^ (b << _U(31) | b >> _U(33))
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return (x ^ x >> _U(31)) & ~_U(1)


class _Chunk:
    """Documents as numbers of words: ``words`` has each text's edge (0) and words, ``sizes`` their number."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}
        self.ids: list = []
        self.flags: list[bool] = []
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, doc_id: int | None, flag: bool, text: str) -> None:
        known = self.known
        words = text.encode("utf-8", "surrogatepass").lower().split()
        own = np.zeros(len(words) + 1, np.uint32)
        own[1:] = [known.setdefault(w, len(known)) for w in words]
        self.ids.append(doc_id)
        self.flags.append(flag)
        self.parts.append(own)
        self.n += len(own)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """words, sizes, flags, hashes by number."""
        import xxhash

        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.known), np.uint64, len(self.known))
        return np.concatenate(self.parts), np.array([len(p) for p in self.parts], np.uint32), np.array(self.flags, np.uint8), hashes


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[_Chunk]:
    chunk = _Chunk()
    for batch in batches:
        for doc_id, flag, text in zip(batch.column("doc_id").to_pylist(), batch.column("is_target").to_pylist(), common.texts(batch), strict=True):
            chunk.add(doc_id, flag, text)
            if chunk.n >= size:
                yield chunk
                chunk = _Chunk()
    if chunk.n:
        yield chunk


def _coded(words: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All different codes, sorted; the places in them of words by number, and of each token's bigram.

    Word codes are odd, bigram codes even.  Each token is the first of one bigram: an edge follows the last.
    """
    bigrams = _mixed(hashes[words], hashes[np.append(words[1:], np.uint32(0))])
    alone = hashes | _U(1)
    codes, place = np.unique(np.concatenate([alone, bigrams]), return_inverse=True)
    return codes, place[: len(alone)], place[len(alone) :]


def _ask(buckets: int, size: int):
    """Each chunk's codes with their counts to the buckets, and the chunk itself to one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("codes", "target", "background")), ("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("sizes", "flags", "words", "hashes"))])
        part = TaskContext.get().partitionId()
        for k, chunk in enumerate(_chunks(batches, size)):
            name = part << 32 | k
            words, sizes, flags, hashes = chunk.arrays()
            codes, alone, bigrams = _coded(words, hashes)
            side = np.repeat(flags, sizes).astype(bool)
            counts = [np.bincount(np.concatenate([alone[words[s]], bigrams[s]]), minlength=len(codes)).astype(np.uint32) for s in (side, ~side)]
            own = {"bucket": (part * 7919 + k * 104_729) % buckets, "chunk": name, "ids": chunk.ids, "sizes": pack(sizes), "flags": pack(flags), "words": pack(words), "hashes": pack(hashes)}
            yield pa.RecordBatch.from_pylist([own], schema=schema)
            home = ((codes >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
            ends = np.searchsorted(home, np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(ends)):
                own_codes = codes[ends[b] : ends[b + 1]]
                rows.append({"bucket": int(b), "chunk": name, "codes": pack(np.diff(own_codes, prepend=_U(0))), "target": pack(counts[0][ends[b] : ends[b + 1]]), "background": pack(counts[1][ends[b] : ends[b + 1]])})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """The sums of a bucket's codes for each chunk that asked, in its order; chunks pass through."""
    asked = [i for i, c in enumerate(table.column("codes").is_valid().to_pylist()) if c]
    target, background = table.column("target").to_pylist(), table.column("background").to_pylist()
    if asked:
        parts = [np.cumsum(unpack(table.column("codes")[i].as_py(), np.uint64)) for i in asked]
        ends = np.cumsum([len(p) for p in parts])
        _, place = np.unique(np.concatenate(parts), return_inverse=True)
        for column in (target, background):
            sums = np.bincount(place, np.concatenate([unpack(column[i], np.uint32) for i in asked])).astype(np.uint64)[place]
            for i, own in zip(asked, np.split(sums, ends[:-1]), strict=True):
                column[i] = pack(own)
    out = table.set_column(table.schema.get_field_index("target"), "target", pa.array(target, pa.binary()))
    return out.set_column(out.schema.get_field_index("background"), "background", pa.array(background, pa.binary())).drop_columns(["codes"])


def _own(docs: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How often each token's item occurs in the token's document."""
    _, inverse, n = np.unique(docs * (int(place.max(initial=0)) + 1) + place, return_inverse=True, return_counts=True)
    return n[inverse].astype(float)


def _score(size: int, totals: tuple[float, float], smoothing: float):
    """Scores a chunk's documents; size is the vocabulary's, totals are the sides' words."""
    scales = (1.0, totals[0] / totals[1] if totals[0] and totals[1] else 1.0)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        (body,) = (r for r in range(table.num_rows) if table.column("words")[r].is_valid)
        got = {c: table.column(c)[body].as_py() for c in ("ids", "sizes", "flags", "words", "hashes")}
        words, sizes, flags, hashes = (unpack(got[c], t) for c, t in (("words", np.uint32), ("sizes", np.uint32), ("flags", np.uint8), ("hashes", np.uint64)))
        _, alone, bigram = _coded(words, hashes)
        place = alone[words]
        docs = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        own_word, own_bigram = _own(docs, place), _own(docs, bigram)
        after = np.arange(1, len(words) + 1)
        after[starts + sizes - 1] = starts  # the edge after a text is the one before it
        means = []
        for column, scale, total, mine in zip(("target", "background"), scales, totals, (flags == 1, flags == 0), strict=True):
            sums = np.concatenate([unpack(x, np.uint64) for r, x in enumerate(table.column(column).to_pylist()) if r != body]).astype(float)
            mine = np.repeat(mine, sizes)
            word = scale * (sums[place] - own_word * mine)
            both = scale * (sums[bigram] - own_bigram * mine)
            rest = scale * (total - sizes[docs] * mine)
            p = (word[after] + 1) / (rest + size)
            loss = np.log((word + smoothing) / (both + smoothing * p))
            means.append(np.add.reduceat(loss, starts) / sizes)
        t, b = means
        return pa.table([pa.array(got["ids"], pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(t), pa.array(b), pa.array(t - b)], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return run


def _vocabulary(size: int):
    """Each chunk's different words, its number of words by side in the row of the edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, size):
            _, sizes, flags, hashes = chunk.arrays()
            target, background = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
            target[0], background[0] = sizes[flags == 1].sum(), sizes[flags == 0].sum()
            yield pa.record_batch([pa.array((hashes | _U(1)).view(np.int64)), pa.array(target), pa.array(background)], names=["code", "target", "background"])

    return run


def _flagged(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    ids = common.cut(target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("is_target", F.lit(True)))
    n = ids.count()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, smoothing: float = SMOOTHING, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (nats a token) and score, their difference, of every row.

    The target are the documents of ``target_ids`` (column doc_id), the background all others.
    """
    flagged = _flagged(docs, target_ids)
    counted = common.arrow_map(flagged, _vocabulary(chunk), "code long, target long, background long")
    words = counted.groupBy("code").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    size, target, background = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("target"), F.lit(0)), F.coalesce(F.sum("background"), F.lit(0))).first()
    buckets = max(common.shuffle_parts(docs.sparkSession), -(-(target + background) // BUCKET))
    asked = common.arrow_map(flagged, _ask(buckets, chunk), _ASKED)
    answered = asked.groupBy("bucket").applyInArrow(_answer, _ASKED.replace("codes binary, ", ""))
    return answered.groupBy("chunk").applyInArrow(_score(size, (float(target), float(background)), smoothing), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
