"""Near-duplicate groups by similarity of word shingles: SimHash variants first, then a lossless join (operator 8).

``simhash.simhash_groups`` links fingerprints by their bits alone.  Here the bits only propose: texts
are grouped when the sets of their five-word shingles have a Jaccard similarity of 0.8 or more,
which a single 64-bit fingerprint of shingles can't tell from less.

Texts may be similar only if their prefixes share a shingle: a global order of shingles puts frequent
ones last; of two sets at 0.8 or more, the first ``size - ceil(0.8 size) + 1`` shingles of both, their
prefixes, must share one.  Texts that share none are done.  Of the rest, groups are found in three steps:

1. Fingerprints of the texts' distinct words meet by the operator's one-bit-deleted variants.  A text
   meets one partner; verified pairs are joined to components.
2. Rounds of stars, until one finds few links: in each bucket of a prefix's shingle, members meet the
   most central one if it is in another component: the one whose shingles are the most frequent, of a
   base and its variants the base.  A text meets the hub that it shares most buckets with.
3. All other pairs: of every two members of a bucket in different components the shared buckets are
   counted, and pairs are verified unless sizes, places or that count rule them out.  Members of a
   bucket of more than ``CROWD`` aren't all compared: they meet by how they differ from what most of the
   crowd has, which finds the same pairs (``_crowds``).  Nothing is capped, so groups are those of comparing
   all texts, whatever the first two steps found.

The counts that order shingles are a bounded table; they change what is compared, never what is found.

Exact copies collapse before anything else.  Defined results: null and empty texts are copies of each
other; documents of fewer than five words have their whole sequence as the one shingle; of repeated
rows one stays; rows without an id may stay for their group only if no row with an id does; other
columns are kept as they are; a text must fit in a task's memory, as its set of shingles does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..plans.iterate import tidy
from . import common, simhash
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
BROADCAST_IDS = 500_000  # rows of two numbers that are broadcast at most, about 30 MB
FREQUENT = 200_000  # shingles whose counts order the others, at any size of the input
ROUND = 20  # stars go on while a round links one in so many texts
CHUNK = 4 << 20  # shingles that are counted at once
CROWD = 64  # members of a bucket beyond which they are told apart by how they differ from the crowd


def _short(copy: str, doc_id: str) -> Column:
    """A hash of a row's text key and id."""
    return F.xxhash64(F.lit(-1), copy, F.col(doc_id).cast("long"))


def _split(rows: DataFrame, short: Column, shorts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash may be among those of ``shorts``, and the rows whose isn't.

    Of each hash one bit is broadcast, in words of 64; there are at most ``BROADCAST_IDS`` words, so rows aren't shuffled
    for being looked at.  More hashes only let more rows through; the caller's join tells them apart.
    """
    where = lambda h: F.pmod(F.shiftright(h, 6), F.lit(BROADCAST_IDS))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    words = common.cut(shorts.groupBy(where(F.col("short")).alias("_word")).agg(F.bit_or(bit(F.col("short"))).alias("_bits")))
    met = rows.join(F.broadcast(words), where(short) == F.col("_word"), "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(bit(short)) != 0, F.lit(False))
    return tuple(met.where(h).select(*[F.col(f"`{c}`") for c in rows.columns]) for h in (hit, ~hit))


class _Texts:
    """One text of each node, worked on where its row is read: ids go to the rows, texts aren't shuffled.

    Two numbers a text are broadcast while few enough; beyond, a bit a text is, and results meet their nodes by the whole key.
    """

    def __init__(self, keyed: DataFrame, chosen: DataFrame):
        self.keyed, self.chosen = keyed, chosen

    def _few(self, chosen: DataFrame) -> DataFrame | None:
        """node and text, if ids are few; texts of one id whose short keys collide would be mixed up, so they go by the whole key."""
        short = chosen.select("w_id", F.xxhash64(F.lit(-1), "copy").alias("w_copy"), "node")
        if chosen.count() > BROADCAST_IDS or not short.groupBy("w_id", "w_copy").count().where("count > 1").isEmpty():
            return None
        met = (F.xxhash64(F.lit(-1), "copy") == F.col("w_copy")) & F.col("doc_id").eqNullSafe(F.col("w_id"))
        return self.keyed.join(F.broadcast(short), met).select("node", "text")

    def _many(self, chosen: DataFrame) -> DataFrame:
        rows, _ = _split(self.keyed, _short("copy", "doc_id"), chosen.select(_short("copy", "w_id").alias("short")))
        return rows.select(self._name("copy", "doc_id"), "text")

    def _name(self, copy: str, doc_id: str) -> Column:
        return F.concat(copy, F.coalesce(F.col(doc_id).cast("string"), F.lit("-"))).alias("node")

    def counted(self, fn, schema: str) -> DataFrame:
        """``fn`` of the texts; beyond the bound, of a few copies, too."""
        few = self._few(self.chosen)
        return common.arrow_map((self._many(self.chosen) if few is None else few).select("text"), fn, schema)

    def mapped(self, fn, schema: str, wanted: DataFrame | None = None) -> DataFrame:
        """``fn`` of node and text, which returns node and the columns of ``schema``; of the wanted nodes or all."""
        chosen = self.chosen if wanted is None else common.cut(self.chosen.join(wanted, "node", "left_semi"))
        few = self._few(chosen)
        if few is not None:
            return common.arrow_map(few, fn, f"node long, {schema}")
        found = common.arrow_map(self._many(chosen), fn, f"node string, {schema}")
        own = chosen.select(self._name("copy", "w_id").alias("_name"), F.col("node").alias("_node"))
        return found.join(own, F.col("node") == F.col("_name")).select(F.col("_node").alias("node"), *[c.split()[0] for c in schema.split(", ")])


def _repeats(shingle: int):
    """Shingles that two or more texts of a chunk have, with their number of texts."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(codes[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in common.texts(batch):
                held.append(np.unique(simhash.shingle_hashes(text, shingle)))
                size += len(held[-1])
                if size >= CHUNK:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return run


def _frequent(texts: _Texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counts; any such table gives a valid order."""
    counts = texts.counted(_repeats(shingle), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = common.cut(counts.withColumn("step", F.floor(4 * F.log2("n")).cast("int")))
    least, total = 1 << 30, 0
    for step, n in sorted((tuple(r) for r in counts.groupBy("step").count().collect()), reverse=True):  # some 200 rows at most
        total += n
        if total > FREQUENT:
            break
        least = step
    top = counts.where(F.col("step") >= least).select("code", "n").toArrow()
    codes, n = top.column("code").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(codes)
    return codes[order], n[order]


def _prefix(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, float]:
    """The first shingles of a set in the global order, and how frequent the set's shingles are on average."""
    codes, counts = frequent
    n = np.zeros(len(hashes), np.int64)
    if len(codes) and len(hashes):
        at = np.minimum(np.searchsorted(codes, hashes), len(codes) - 1)
        n = np.where(codes[at] == hashes, counts[at], 0)
    need = math.ceil(similarity * len(hashes) - 1e-9)
    order = np.lexsort((hashes, n))[: len(hashes) - need + 1]
    return hashes[order], float(np.log1p(n).mean()) if len(n) else 0.0


def _marks(shingle: int, similarity: float, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        frequent = shared.value
        for batch in batches:
            words, sizes, central, prefixes = [], [], [], []
            for text in common.texts(batch):
                own = set(text.encode("utf-8", "surrogatepass").lower().split())
                words.append(np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own)))
                own = np.unique(simhash.shingle_hashes(text, shingle))
                prefix, mean = _prefix(own, frequent, similarity)
                sizes.append(len(own))
                central.append(mean)
                prefixes.append(prefix.view(np.int64))
            fps = simhash.fingerprints(words).view(np.int64)
            columns = [batch.column("node"), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(central, pa.float32()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["node", "fp", "size", "central", "prefix"])

    return run


def _shingle_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(simhash.shingle_hashes(t, shingle)).view(np.int64) for t in common.texts(batch)]
            yield pa.record_batch([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return run


def _proposed(marked: DataFrame) -> DataFrame:
    """Pairs (a, b): at most one partner b for each node a, by equal fingerprints or a shared variant.

    A variant's hub is its least fingerprint; a fingerprint meets the hubs of its variants.
    """
    nodes = marked.select("node", "fp")
    fps = common.cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    variants = simhash.variants(fps.select("fp"))
    hubs = variants.groupBy("key").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub")))
    met = variants.join(hubs, "key").where("fp <> hub").groupBy("fp").agg(F.min(F.struct(near.alias("bits"), "hub")).alias("best"))
    met = met.select("fp", F.col("best.hub").alias("hub")).join(fps, "fp").join(fps.select(F.col("fp").alias("hub"), F.col("first").alias("b")), "hub")
    same = nodes.join(fps, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return met.select(F.col("first").alias("a"), "b").union(same)


def _buckets(marked: DataFrame) -> DataFrame:
    """key, node, size, left, central: the prefixes' shingles that two or more texts have, by 48 of their bits.

    ``left`` is the number of the text's shingles after its prefix.
    """
    keyed = marked.select("node", F.explode(F.array_distinct(F.transform("prefix", lambda x: x.bitwiseAND(F.lit((1 << 48) - 1))))).alias("key"))
    common_keys = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    shared = keyed.join(common_keys, "key", "left_semi")
    return shared.join(marked.select("node", "size", (F.col("size") - F.size("prefix")).alias("left"), "central"), "node")


def _star(rooted: DataFrame) -> DataFrame:
    """Pairs (a, b): a member of a bucket with its most central one b if of another component; of several, the one most met."""
    hubs = rooted.groupBy("key").agg(F.max(F.struct("central", "node", "root")).alias("hub"), F.min("root").alias("low"), F.max("root").alias("high"))
    hubs = hubs.where("low <> high").select("key", F.col("hub.node").alias("b"), F.col("hub.root").alias("other"))
    met = rooted.select("key", F.col("node").alias("a"), "root").join(hubs, "key").where("root <> other")
    counted = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("a").agg(F.max(F.struct("n", "b")).alias("best")).select("a", F.col("best.b").alias("b"))


def _need(a: str, b: str, similarity: float) -> Column:
    """Buckets that two sets must share: what comes after the prefix that ends first in the global order is at most that
    prefix's ``left``, and what comes before is in shared buckets, so the larger ``left`` bounds the rest of the overlap."""
    least = similarity / (1 + similarity)
    return F.expr(f"{least} * ({a}.size + {b}.size) - greatest({a}.left, {b}.left) - 1e-6")


def _like_sizes(a: str, b: str, similarity: float) -> Column:
    return F.expr(f"{a}.size >= {similarity} * {b}.size - 1e-6 and {b}.size >= {similarity} * {a}.size - 1e-6")


def _mixed(rooted: DataFrame) -> DataFrame:
    """The buckets that hold several roots, with each one's number of members and the root of its most central one, its crowd's name."""
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members"), F.max(F.struct("central", "node", "root")).alias("hub"))
    mixed = mixed.where("low <> high").select("key", "members", F.col("hub.root").alias("g"))
    return common.cut(rooted.drop("central").join(mixed, "key"))


def _rest(members: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of a bucket of at most ``CROWD`` members that have different roots and may reach the similarity."""
    crowded = members.where(F.col("members") > CROWD).groupBy("node").agg(F.count(F.lit(1)).alias("more"))
    few = members.where(F.col("members") <= CROWD).join(crowded, "node", "left").withColumn("more", F.coalesce("more", F.lit(0)))
    few = common.cut(few.drop("members", "g"))
    a, b = few.alias("a"), few.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") < F.col("b.root")) & _like_sizes("a", "b", similarity))
    # of the crowded buckets of two texts as many as either has may be shared
    need = F.max(_need("a", "b", similarity) - F.expr("least(a.more, b.more)")).alias("need")
    counted = met.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b")).agg(F.count(F.lit(1)).alias("n"), need)
    return counted.where("n >= need").select("a", "b")


def _crowds(members: DataFrame, texts: _Texts, shingle: int, similarity: float) -> Iterator[DataFrame]:
    """Pairs (a, b) of different roots that meet in a bucket of more than ``CROWD`` members, without comparing all of them.

    Two sets x and y are similar if their difference, x ^ y, has at most r (size x + size y) members, where
    r = (1 - similarity) / (1 + similarity).  For any set h the difference is that of x ^ h and y ^ h.  Let w be
    the size of x ^ h less r times that of x, and m the text of least w.  If w(x) + w(y) <= 0, x and y are similar, and so
    are both to m: stars around m link them all.  Otherwise similar x ^ h and y ^ h share (w(x) + w(y)) / 2 members or
    more, so their prefixes meet in a bucket.  h is what over half of a crowd's sets hold, so such a bucket has at
    most half of the crowd; those still crowded are crowds of the next round.
    """
    r = (1 - similarity) / (1 + similarity)
    crowd = common.cut(members.where(F.col("members") > CROWD).select("g", "node", "root", "size").distinct())
    if crowd.isEmpty():
        return
    sets = texts.mapped(_shingle_sets(shingle), "set array<long>", common.cut(crowd.select("node").distinct()))
    crowd = common.cut(crowd.join(sets.dropDuplicates(["node"]), "node"))
    while not crowd.isEmpty():
        tidy(crowd.sparkSession)
        n = crowd.groupBy("g").agg(F.count(F.lit(1)).alias("members"))
        held = common.cut(crowd.select("g", F.explode("set").alias("key")).groupBy("g", "key").agg(F.count(F.lit(1)).alias("n")).join(n, "g"))
        core = held.where("2 * n > members").groupBy("g").agg(F.collect_list("key").alias("core"))
        moved = crowd.join(core, "g", "left").withColumn("core", F.coalesce("core", F.array().cast("array<long>")))
        moved = moved.withColumn("set", F.concat(F.array_except("set", "core"), F.array_except("core", "set"))).drop("core")
        moved = common.cut(moved.withColumn("w", F.size("set") - r * F.col("size")))
        mid = moved.groupBy("g").agg(F.min(F.struct("w", "node", "root")).alias("mid"))
        around = moved.join(mid, "g").withColumn("near", F.col("w") + F.col("mid.w") <= -1e-6)
        yield around.where("near and root <> mid.root").select(F.col("node").alias("a"), F.col("mid.node").alias("b"))
        # what is linked so has one root
        linked = around.where("near").select("g", "root", F.col("mid.root").alias("top")).distinct()
        now = around.join(linked, ["g", "root"], "left").withColumn("root", F.coalesce("top", "root")).drop("top", "near")
        least = F.greatest(F.lit(1), F.ceil((F.col("w") + F.col("mid.w")) / 2 - 1e-6))
        now = common.cut(now.select("g", "node", "root", "size", "w", "set", (F.size("set") - least + 1).alias("first")))
        times = held.select("g", "key", F.when(F.expr("2 * n > members"), F.col("members") - F.col("n")).otherwise(F.col("n")).alias("n"))
        keyed = now.where("first > 0").select("g", "node", "root", "size", "w", "first", F.explode("set").alias("key")).join(times.where("n > 1"), ["g", "key"], "left")
        place = F.row_number().over(W.partitionBy("g", "node").orderBy(F.coalesce("n", F.lit(1)), "key"))
        keyed = keyed.withColumn("place", place).where("place <= first and n is not null")
        mixed = keyed.groupBy("g", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members")).where("low <> high")
        met = common.cut(keyed.join(mixed.select("g", "key", "members"), ["g", "key"]).select("g", "key", "node", "root", "size", "w", "place", "members"))
        few = met.where(F.col("members") <= 4 * CROWD)  # places rule out most of these
        a, b = few.alias("a"), few.alias("b")
        # what two share from the first place on where they meet must be enough: w + r size is the number of places
        after = [f"{x}.w + {r} * {x}.size - {x}.place" for x in ("a", "b")]
        enough = F.expr(f"a.w + b.w > -1e-5 and 1 + least({after[0]}, {after[1]}) >= (a.w + b.w) / 2 - 1e-5")
        same = (F.col("a.g") == F.col("b.g")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.root") < F.col("b.root"))
        pairs = a.join(b, same & _like_sizes("a", "b", similarity) & enough).select("a.g", F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
        ends = [now.select("g", F.col("node").alias(x), F.col("set").alias(f"s{x}"), F.col("w").alias(f"w{x}")) for x in ("a", "b")]
        both = pairs.join(ends[0], ["g", "a"]).join(ends[1], ["g", "b"])
        yield both.where(F.size(F.array_intersect("sa", "sb")) >= F.expr("(wa + wb) / 2 - 1e-5")).select("a", "b").distinct()
        more = met.where(F.col("members") > 4 * CROWD)
        numbers = common.cut(more.select("g", "key").distinct().withColumn("next", F.monotonically_increasing_id()))
        crowd = common.cut(more.join(numbers, ["g", "key"]).select("next", "g", "node").join(now.select("g", "node", "root", "size", "set"), ["g", "node"]).select(F.col("next").alias("g"), "node", "root", "size", "set"))


def _bounded(pairs: DataFrame, buckets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shared buckets leave the similarity possible."""
    few = pairs.count() <= BROADCAST_IDS
    side = F.broadcast(pairs) if few else pairs
    own = buckets.select("key", "node", "size", "left")
    ends = [own.join(side, F.col("node") == F.col(c)).select("a", "b", "key", F.struct("size", "left").alias(f"own_{c}")) for c in ("a", "b")]
    met = ends[0].join(ends[1], ["a", "b", "key"])
    sizes = F.expr(f"own_a.size >= {similarity} * own_b.size - 1e-6 and own_b.size >= {similarity} * own_a.size - 1e-6")
    counted = met.where(sizes).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max(_need("own_a", "own_b", similarity)).alias("need"))
    return counted.where("n >= need").select("a", "b")


def _alike(pairs: DataFrame, texts: _Texts, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs whose shingles are similar enough."""
    asked = common.cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    sets = common.cut(texts.mapped(_shingle_sets(shingle), "set array<long>", asked))
    side = F.broadcast(pairs) if pairs.count() <= BROADCAST_IDS else pairs
    ends = [sets.join(side, F.col("node") == F.col(c)).select("a", "b", F.col("set").alias(f"s{c}")) for c in ("a", "b")]
    both = ends[0].join(ends[1], ["a", "b"])
    both = both.where((F.size("sa") >= similarity * F.size("sb") - 1e-6) & (F.size("sb") >= similarity * F.size("sa") - 1e-6))
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where((shared >= similarity * (F.size("sa") + F.size("sb") - shared) - 1e-6) & (F.size("sa") > 0)).select("a", "b").distinct()


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after the linked nodes' components are one."""
    ends = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
    tops = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    return common.cut(roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, stays): one row per distinct document row, with whether it is the one that stays of its group."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = own.withColumn("copy", F.sha2("text", 256))
    # a node is a distinct text; its key tells rows of a repeated id apart
    rows = common.cut(keyed.groupBy("doc_id", "copy").agg(F.count(F.lit(1)).alias("times")))
    # numbers are written once, so they stay what they are
    nodes = common.cut(rows.groupBy("copy").agg(F.min("doc_id").alias("first_id")).withColumn("node", F.monotonically_increasing_id()))
    texts = _Texts(keyed, nodes.select(F.col("first_id").alias("w_id"), "copy", "node"))
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(texts, shingle))
    marks = texts.mapped(_marks(shingle, similarity, shared), "fp long, size int, central float, prefix array<long>")
    # a repeated row has its text more than once
    marked = common.cut(marks if rows.where("times > 1").isEmpty() else marks.dropDuplicates(["node"]))
    buckets = common.cut(_buckets(marked))
    maybe = common.cut(buckets.select("node").distinct())
    roots = common.cut(maybe.select("node", F.col("node").alias("root")))

    def verified(pairs: DataFrame) -> DataFrame:
        found = common.cut(_alike(pairs, texts, shingle, similarity))
        tidy(docs.sparkSession)
        return found

    done = common.cut(_bounded(common.cut(_proposed(marked.join(maybe, "node", "left_semi"))), buckets, similarity))
    links = verified(done)
    n = last = maybe.count()
    while True:
        roots = _joined(roots, links)
        rooted = common.cut(buckets.join(roots, "node"))
        tidy(docs.sparkSession)
        if not last or last * ROUND < n:
            break
        pairs = common.cut(_bounded(common.cut(_star(rooted)), buckets, similarity).join(done, ["a", "b"], "left_anti"))
        links, done = verified(pairs), common.cut(done.union(pairs))
        last = links.count()
    members = _mixed(rooted)
    found = [common.cut(pairs) for pairs in (_rest(members, similarity), *_crowds(members, texts, shingle, similarity))]
    pairs = common.cut(reduce(DataFrame.union, found).distinct().join(done, ["a", "b"], "left_anti"))
    roots = _joined(roots, verified(common.cut(_bounded(pairs, buckets, similarity))))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "node")).alias("least"))
    stays = rooted.join(least, "root").select("copy", (F.col("least.node") == F.col("node")).alias("kept"), "first_id")
    return rows.join(stays, "copy").select("doc_id", F.col("copy").alias("text_key"), (F.col("kept") & F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("stays"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without all but one of each near-duplicate group; columns stay as they are."""
    decided = common.cut(groups(docs, **options))
    tidy(docs.sparkSession)
    gone = common.cut(decided.where(~F.col("stays")).select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key")))
    key, name = F.sha2(F.coalesce(docs["text"], F.lit("")), 256), "_key"
    while name in docs.columns:
        name += "_"
    keyed, id_ = docs.withColumn(name, key), F.col("doc_id").cast("long")

    def left(rows: DataFrame, right: DataFrame) -> DataFrame:
        return rows.join(right, (F.col(name) == F.col("g_key")) & id_.eqNullSafe(F.col("g_id")), "left_anti")

    if gone.count() <= BROADCAST_IDS // 3:  # a number and a digest
        kept = left(keyed, F.broadcast(gone))
    else:
        maybe, others = _split(keyed, _short(name, "doc_id"), gone.select(_short("g_key", "g_id").alias("short")))
        kept = left(maybe, gone).union(others)
    if decided.count() < docs.count():  # repeated rows: one of each stays
        twice = keyed.groupBy(id_.alias("g_id"), F.col(name).alias("g_key")).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
        maybe, others = _split(kept, _short(name, "doc_id"), twice.select(_short("g_key", "g_id").alias("short")))
        kept = maybe.dropDuplicates(["doc_id", name]).union(others)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
