"""Exact-substring deduplication with suffix arrays built by two-stage sorting (operator 4).

A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller id.
One suffix array of the corpus has no place on one machine, so the work is cut by content:

1. Every ``length``-byte window has an anchor, the k-gram of least hash in it (leftmost on ties), so
   equal windows have equal anchors.  Batches of documents send the distinct hashes of their anchors,
   sorted and compressed, to buckets of hashes; buckets answer which hashes several batches have.
2. Of anchors that several documents have, a batch cuts the snippet that holds all windows of that
   anchor.  Copies of a snippet within the batch collapse to the smallest document's; the rest are
   removed right there.  One snippet a batch goes to the bucket of its anchor.
3. Buckets collapse equal snippets again.  Snippets that share an anchor but differ (where a repeated
   passage begins or ends) get a suffix array: suffixes smaller than their successors are sorted
   directly, the rest are induced by scans over the buckets of first bytes, and adjacent common
   prefixes of ``length`` bytes or more group equal windows, whose smallest document keeps them.
4. Removed runs return to the batches, which cut the texts.

Whole texts are shuffled once, by batch, and that exchange is reused by steps 1, 2 and 4.  A group of
copies costs one snippet a batch, whatever its size.

Defined results: null is the empty text; texts shorter than ``length`` stay whole; documents without an
id come last and, like repeated ids, never take from each other; empty tables give no rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

LENGTH = 50
CHUNK = 2 << 20  # bytes that are hashed at once
SORT_BYTES = 8 << 20  # bytes of snippets in one suffix array
HASH_BITS = 48
LAST = np.iinfo(np.int64).max

_MULT = np.uint64(0x9E3779B97F4A7C15)


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays, compressed; each as deltas if sorted, in as few bytes as its values need."""
    import zstandard

    parts = []
    for a in arrays:
        a = np.asarray(a)
        if a.dtype == np.uint8:
            kind, body = 0, a.tobytes()
        else:
            a = a.astype(np.int64)
            kind = 1 if len(a) and (a[1:] >= a[:-1]).all() and a[0] >= 0 else 2
            v = (np.diff(a, prepend=0) if kind == 1 else (a << 1) ^ (a >> 63)).view(np.uint64)
            width = max(1, (int(v.max(initial=0)).bit_length() + 7) // 8)
            kind |= width << 2
            body = v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
        parts.append(struct.pack("<BQ", kind, len(a)) + body)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        kind, n = struct.unpack_from("<BQ", data, at)
        at += 9
        if kind == 0:
            out.append(np.frombuffer(data, np.uint8, n, at))
            at += n
            continue
        width = kind >> 2
        v = np.zeros((n, 8), np.uint8)
        v[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        v = v.view("<u8").reshape(n)
        out.append(np.cumsum(v.view(np.int64)) if kind & 3 == 1 else (v >> np.uint64(1)).view(np.int64) ^ -(v & np.uint64(1)).view(np.int64))
    return out


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit hashes of all k-grams, by doubling."""
    size = 1
    have = data.astype(np.uint64) + np.uint64(1)
    out, out_size = None, 0
    while True:
        if k & size:
            if out is None:
                out, out_size = have, size
            else:  # the larger part stands first
                n = len(data) - out_size - size + 1
                out = have[:n] * _power(out_size) + out[size : size + n]
                out_size += size
        if 2 * size > k:
            break
        n = len(data) - 2 * size + 1
        have = have[:n] * _power(size) + have[size : size + n]
        size *= 2
    out = out ^ (out >> np.uint64(32))
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_MULT), n, 1 << 64))


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first window, last window, hash) of each anchor of the texts joined in ``data``.

    ``ends`` are the texts' ends; windows are positions in ``data``.
    """
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    k = length // 2 + 1
    span = length - k + 1  # k-grams in a window
    h = _gram_hashes(data, k)
    n = len(data) - length + 1
    key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64) & np.uint64(0xFFFFFF)
    low, size = key, 1
    while 2 * size <= span:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[:n], low[span - size : span - size + n])
    place = (low[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.searchsorted(ends, np.arange(n), side="right")
    fits = np.arange(n) + length <= ends[np.minimum(text, len(ends) - 1)]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~fits[:-1]
    first = np.flatnonzero(new & fits)
    if not len(first):
        return none, none, none, none
    # a run of windows ends before the next one, or where windows no longer fit
    edge = np.flatnonzero(new | ~fits)
    nxt = np.searchsorted(edge, first, side="right")
    last = np.where(nxt < len(edge), edge[np.minimum(nxt, len(edge) - 1)], n) - 1
    value = (h[place[first]] >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    return text[first], first, last, value


class Batch:
    """The texts of a batch in a fixed order, and their anchors."""

    def __init__(self, table: pa.Table, length: int):
        rows = sorted(((LAST if d is None else d, (t or "").encode("utf-8", "surrogatepass"), d) for d, t in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True)), key=lambda r: r[:2])
        self.ids = [r[2] for r in rows]
        self.order = np.array([r[0] for r in rows], np.int64)
        self.texts = [r[1] for r in rows]
        self.length = length

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, first window, last window, hash); windows are positions in the row's text."""
        found = []
        step = CHUNK - self.length
        chunk: list[tuple[int, int, bytes]] = []
        size = 0
        for row, text in enumerate(self.texts):
            for at in range(0, max(1, len(text) - self.length + 1), step):
                piece = text[at : at + step + self.length - 1]
                chunk.append((row, at, piece))
                size += len(piece)
                if size >= CHUNK:
                    found.append(self._hashed(chunk))
                    chunk, size = [], 0
        if chunk:
            found.append(self._hashed(chunk))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 4

    def _hashed(self, chunk):
        sizes = np.array([len(p) for _, _, p in chunk], np.int64)
        ends = np.cumsum(sizes)
        text, first, last, value = anchors(np.frombuffer(b"".join(p for _, _, p in chunk), np.uint8), ends, self.length)
        shift = np.array([a for _, a, _ in chunk], np.int64) - (ends - sizes)
        rows = np.array([r for r, _, _ in chunk], np.int64)
        return rows[text], first + shift[text], last + shift[text], value


def _runs(values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)


def _stretches(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(start, end) of each run; none where there are no values."""
    return list(zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True)) if len(starts) else []


def _send(length: int, buckets: int):
    def run(key, table):
        _, _, _, value = Batch(table, length).anchors()
        value = np.unique(value)
        bucket = value % buckets
        order = np.argsort(bucket, kind="stable")
        bucket, value = bucket[order], value[order]
        starts = _runs(bucket)
        parts = [_pack(value[a:b]) for a, b in _stretches(starts, len(value))]
        return pa.table({"bucket": pa.array(bucket[starts], pa.int32()), "sender": pa.array([key[0].as_py()] * len(starts), pa.int32()), "blob": pa.array(parts, pa.binary())})

    return run


def _answer(key, table):
    senders = np.array(table.column("sender").to_pylist(), np.int64)
    lists = [_unpack(b)[0] for b in table.column("blob").to_pylist()]
    value = np.concatenate(lists)
    sender = np.repeat(senders, [len(x) for x in lists])
    order = np.argsort(value, kind="stable")
    value, sender = value[order], sender[order]
    starts = _runs(value)
    many = np.repeat(np.diff(np.append(starts, len(value))) > 1, np.diff(np.append(starts, len(value))))
    value, sender = value[many], sender[many]
    order = np.lexsort([value, sender])
    value, sender = value[order], sender[order]
    starts = _runs(sender)
    parts = [_pack(value[a:b]) for a, b in _stretches(starts, len(value))]
    return pa.table({"batch": pa.array(sender[starts], pa.int32()), "blob": pa.array(parts, pa.binary())})


_SNIPPETS = "bucket int, sender int, local boolean, blob binary"


def _cut_snippets(length: int, buckets: int):
    def run(key, docs, answers):
        rows_out: list[tuple] = []
        if docs.num_rows:
            batch, sender = Batch(docs, length), key[0].as_py()
            row, first, last, value = batch.anchors()
            known = np.unique(np.concatenate([_unpack(b)[0] for b in answers.column("blob").to_pylist()])) if answers.num_rows else np.empty(0, np.int64)
            shared = np.isin(value, known, kind="sort") if len(known) else np.zeros(len(value), bool)
            order = np.argsort(value, kind="stable")
            v, d = value[order], batch.order[row[order]]
            starts = _runs(v)
            if len(starts):
                differ = np.maximum.reduceat(d, starts) > np.minimum.reduceat(d, starts)
                shared[order] |= np.repeat(differ, np.diff(np.append(starts, len(v))))
            row, first, last, value = row[shared], first[shared], last[shared], value[shared]
            # rows are in the order of documents, so the first holder of a snippet is the smallest one
            holder: dict[bytes, int] = {}
            places: list[tuple[bytes, int, int, list[tuple[int, int]]]] = []
            gone: list[tuple[int, int, int]] = []
            for r, a, b, h in zip(row.tolist(), first.tolist(), last.tolist(), value.tolist(), strict=True):
                snippet = batch.texts[r][a : b + length]
                at = holder.get(snippet)
                if at is None:
                    holder[snippet] = len(places)
                    places.append((snippet, h, int(batch.order[r]), [(r, a)]))
                elif places[at][2] == batch.order[r]:
                    places[at][3].append((r, a))
                else:
                    gone.append((r, a, b + length))
            hashes = np.array([p[1] for p in places], np.int64)
            bucket = hashes % buckets
            order = np.lexsort([hashes, bucket])
            starts = _runs(bucket[order])
            for a, b in _stretches(starts, len(order)):
                own = [places[i] for i in order[a:b].tolist()]
                text = np.frombuffer(b"".join(p[0] for p in own), np.uint8)
                spots = [s for p in own for s in p[3]]
                blob = _pack(np.array([p[1] for p in own]), np.array([len(p[0]) for p in own]), np.array([p[2] for p in own]), np.array([len(p[3]) for p in own]), np.array([s[0] for s in spots]), np.array([s[1] for s in spots]), text)
                rows_out.append((int(bucket[order[a]]), sender, False, blob))
            if gone:
                rows_out.append((sender % buckets, sender, True, _pack(*_merge(*(np.array(c, np.int64) for c in zip(*gone, strict=True))))))
        cols = list(zip(*rows_out, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["bucket", "sender", "local", "blob"])

    return run


def _merge(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of a row joined."""
    if not len(row):
        return row, start, end
    order = np.lexsort([start, row])
    row, start, end = row[order], start[order], end[order]
    far = int(end.max()) + 2
    reach = np.maximum.accumulate(end + row * far)
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] + row[1:] * far > reach[:-1])])
    at = np.flatnonzero(new)
    return row[at], start[at], np.maximum.reduceat(end, at)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``text`` (uint8) in the order of their first ``depth`` bytes, by two-stage sorting.

    A suffix smaller than its successor is sorted directly.  Each other one begins with a byte not
    less than its successor's, so a scan over the buckets of first bytes, in order, meets the
    successor first and puts the suffix at the next free place of its bucket.
    """
    n = len(text)
    t = text.astype(np.int16)
    step = np.sign(np.diff(t, append=-1))  # the end of the text is smaller than any byte
    source = np.where(step != 0, np.arange(n), n)
    small = step[np.minimum.accumulate(source[::-1])[::-1]] > 0
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", buffer=padded.tobytes(), strides=(1,)).astype(np.uint64)
    direct = np.flatnonzero(small)
    direct = direct[np.lexsort([words[direct + o] for o in range(8 * ((depth - 1) // 8), -1, -8)])]
    cuts = np.searchsorted(t[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        induced[t[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        own = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        induced[c] = []
        parts, now = [own], own
        while len(now):  # runs of the byte c induce within their own bucket
            now = now[now > 0] - 1
            now = now[(t[now] == c) & ~small[now]]
            parts.append(now)
        bucket = np.concatenate([*parts, direct[cuts[c] : cuts[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~small[before] & (t[before] > c)]
        if len(before):
            before = before[np.argsort(t[before], kind="stable")]
            starts = _runs(t[before])
            for a, b in _stretches(starts, len(before)):
                induced[t[before[a]]].append(before[a:b])
    return np.concatenate(out) if out else np.empty(0, np.int64)


def common_prefix_groups(text: np.ndarray, suffixes: np.ndarray, length: int) -> np.ndarray:
    """Starts of the groups of adjacent suffixes whose common prefix has ``length`` bytes."""
    if not len(suffixes):
        return suffixes
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", buffer=padded.tobytes(), strides=(1,)).astype(np.uint64)
    same = np.ones(len(suffixes) - 1, bool)
    for o in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length >= 8 else [])]:
        w = words[suffixes + o]
        same &= w[1:] == w[:-1]
    if length < 8:
        w = words[suffixes] >> np.uint64(64 - 8 * length)
        same &= w[1:] == w[:-1]
    return np.flatnonzero(np.concatenate([[True], ~same]))


def _sort_bucket(length: int):
    def run(key, table):
        replies: list[tuple[int, bytes]] = []
        hashes, sizes, docs, spots, rows, starts, texts, senders = [], [], [], [], [], [], [], []
        for sender, local, blob in zip(table.column("sender").to_pylist(), table.column("local").to_pylist(), table.column("blob").to_pylist(), strict=True):
            if local:
                replies.append((sender, blob))
                continue
            h, s, d, p, r, a, t = _unpack(blob)
            for to, x in zip((hashes, sizes, docs, spots, rows, starts, texts), (h, s, d, p, r, a, t), strict=True):
                to.append(x)
            senders.append(np.full(len(h), sender, np.int64))
        if hashes:
            hash_, size, doc, spot, row, start, sender = (np.concatenate(x) for x in (hashes, sizes, docs, spots, rows, starts, senders))
            data = b"".join(x.tobytes() for x in texts)
            begin = np.cumsum(size) - size
            spot_begin = np.cumsum(spot) - spot
            order = np.argsort(hash_, kind="stable")
            out: list[tuple[np.ndarray, ...]] = []
            groups = _runs(hash_[order])
            at = 0
            bounds = np.append(groups, len(order))
            while at < len(groups):  # whole anchors, about SORT_BYTES at once
                to = at + 1
                used = int(size[order[bounds[at] : bounds[to]]].sum())
                while to < len(groups) and used < SORT_BYTES:
                    used += int(size[order[bounds[to] : bounds[to + 1]]].sum())
                    to += 1
                out.append(_removed(order[bounds[at] : bounds[to]], hash_, size, doc, begin, data, length))
                at = to
            item, low, high = (np.concatenate(c) for c in zip(*out, strict=True))
            # every place of the snippet loses what the snippet loses
            times = spot[item]
            which = np.repeat(spot_begin[item] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            back = np.repeat(np.arange(len(item)), times)
            who, r, a, b = sender[item[back]], row[which], start[which] + low[back], start[which] + high[back]
            by = np.argsort(who, kind="stable")
            who, r, a, b = who[by], r[by], a[by], b[by]
            cuts = _runs(who)
            for x, y in _stretches(cuts, len(who)):
                replies.append((int(who[x]), _pack(*_merge(r[x:y], a[x:y], b[x:y]))))
        return pa.table({"batch": pa.array([r[0] for r in replies], pa.int32()), "blob": pa.array([r[1] for r in replies], pa.binary())})

    return run


def _removed(items: np.ndarray, hash_, size, doc, begin, data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(snippet, from, to) of what goes of some whole anchors' snippets; positions in the snippet."""
    number: dict[bytes, int] = {}
    content = np.array([number.setdefault(data[b : b + s], len(number)) for b, s in zip(begin[items].tolist(), size[items].tolist(), strict=True)], np.int64)
    least = np.full(len(number), LAST, np.int64)
    np.minimum.at(least, content, doc[items])
    later = doc[items] > least[content]
    gone = [(items[later], np.zeros(int(later.sum()), np.int64), size[items[later]])]
    # contents that share an anchor with another content
    anchor = np.empty(len(number), np.int64)
    anchor[content] = hash_[items]
    order = np.argsort(anchor, kind="stable")
    starts = _runs(anchor[order])
    counts = np.diff(np.append(starts, len(order)))
    several = order[np.repeat(counts > 1, counts)]
    if len(several):
        names = list(number)
        pieces = [names[i] for i in several.tolist()]
        lengths = np.array([len(p) for p in pieces], np.int64)
        text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        first = np.cumsum(lengths + 1) - (lengths + 1)
        piece = np.repeat(np.arange(len(pieces)), lengths + 1)
        fits = np.arange(len(text)) - first[piece] + length <= lengths[piece]
        sa = suffix_array(text, length)
        sa = sa[fits[sa]]
        groups = common_prefix_groups(text, sa, length)
        owner = least[several][piece[sa]]
        low = np.repeat(np.minimum.reduceat(owner, groups), np.diff(np.append(groups, len(sa))))
        lost = np.zeros(len(text), bool)
        lost[sa[owner > low]] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], lost, [False]]).astype(np.int8)))
        a, b = edges[::2], edges[1::2]  # runs of lost windows never leave a piece, whose last bytes begin none
        own = piece[a]
        # back from contents to the snippets of the document that is their least
        keepers = np.flatnonzero(~later)
        keepers = keepers[np.argsort(content[keepers], kind="stable")]
        c = several[own]
        left, right = np.searchsorted(content[keepers], c, "left"), np.searchsorted(content[keepers], c, "right")
        times = right - left
        back = np.repeat(np.arange(len(c)), times)
        which = np.repeat(left - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        gone.append((items[keepers[which]], (a - first[own])[back], (b - first[own] + length - 1)[back]))
    return tuple(np.concatenate(c) for c in zip(*gone, strict=True))


def _cut_texts(length: int):
    def run(key, docs, blobs):
        batch = Batch(docs, length)
        row = start = end = np.empty(0, np.int64)
        if blobs.num_rows:
            got = [_unpack(b) for b in blobs.column("blob").to_pylist()]
            row, start, end = _merge(*(np.concatenate(c) for c in zip(*got, strict=True)))
        bounds = np.searchsorted(row, np.arange(len(batch.texts) + 1))
        spans, kept = [], []
        for i, text in enumerate(batch.texts):
            own = list(zip(start[bounds[i] : bounds[i + 1]].tolist(), end[bounds[i] : bounds[i + 1]].tolist(), strict=True))
            spans.append([{"start": a, "end": b} for a, b in own])
            at, parts = 0, []
            for a, b in own:
                parts.append(text[at:a])
                at = b
            kept.append(b"".join([*parts, text[at:]]))
        return pa.table({"doc_id": pa.array(batch.ids, pa.int64()), "n_bytes": pa.array([len(t) for t in batch.texts], pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())})

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, the removed spans (bytes, end exclusive, maximal) and the kept bytes."""
    parts = common.shuffle_parts(common.ship(docs.sparkSession))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = own.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    batches = own.groupBy("batch")
    sent = batches.applyInArrow(_send(length, parts), "bucket int, sender int, blob binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "batch int, blob binary")
    snippets = batches.cogroup(answers.groupBy("batch")).applyInArrow(_cut_snippets(length, parts), _SNIPPETS)
    removed = snippets.groupBy("bucket").applyInArrow(_sort_bucket(length), "batch int, blob binary")
    return batches.cogroup(removed.groupBy("batch")).applyInArrow(_cut_texts(length), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    cut = remove_repeats(docs, length)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

