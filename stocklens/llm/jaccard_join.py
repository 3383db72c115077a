"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its components.

A document's set is its distinct shingles of ``shingle`` words (A-Z lower-cased;
fewer words: the whole sequence). Two documents link at a Jaccard similarity of
``threshold`` percent. The query op8 is on 3 words and 90; the pipeline's stage
on 5 words and 80.

1. A count-min sketch of all documents' shingles orders them, rare ones first;
   any order is right, this one keeps common passages out of the prefixes.
2. Documents with equal sets are one node from here on.
3. A node's prefix of level l is its first ``n - need + l`` shingles, ``need``
   being the least overlap a partner must have. Partners share at least l
   shingles of their level-l prefixes, so each node takes the l for which
   its estimated candidate cost is least: a longer prefix is read, and more
   shared shingles are asked for before a pair is compared.
4. Nodes that share a prefix shingle are first compared with one node of that
   shingle, the one with the fewest shingles of its own: star-shaped groups
   of near copies join here without their pairs being listed.
5. The exact pass: of the shingles still shared by different components, all
   pairs across components with enough shared prefix shingles are compared
   on their full sets. What links there joins components; no other pair can.

Before either comparison fetches texts, bitmaps of the two sets (each shingle
flips a bit) are compared: sets differ by at least as many shingles as their
bitmaps differ by bits, so pairs whose bitmaps differ too much cannot link.
The exact pass tests a folded bitmap of 128 bits where entries meet, and lists a
pair on few of the entries that it shares, so that groups of documents that
are alike but do not link list few pairs; shared entries are counted from the
two nodes' own lists.

Sketches grow with the number of keys up to a fixed size and only order or prefilter. Which prefix shingles
several nodes have is counted over all of them, so what is listed does not grow as a sketch fills. Hot shingles:
counts and minima are aggregated in part, joins are split by AQE.

Null and empty texts have an empty set and link with nothing. Ids that are
null are never a component's id unless it has no other. Repeated rows have
equal sets. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stocklens.llm import hashing
from stocklens.llm.components import components
from stocklens.session import in_few, materialize

SHINGLE = 3  # words, of op8
THRESHOLD = 90  # percent, of op8
LEVELS = 4
BEFORE = 6  # entries before an entry that it carries, by which pairs are not listed again
HUB_ENTRIES, HUB_SHARED = 6, 2  # entries of a node that look for a hub; as many as it must share with one
COMPARE_COST = 8  # of comparing a pair, in prefix entries read
LEAST_FILES, DOCS_A_FILE = 12, 4000  # of the tables between the steps, where a session shuffles to more partitions
IN_BITMAP = 1 << 21  # shared tokens that a bitmap thins the lists by; more are joined
FREQUENCY_BITS, PART_BITS = 21, 17
PARITY_BITS = 8  # binary logarithm of a bitmap's least size
FOLDED = ["fold0", "fold1"]  # two longs
_LAST = (1 << 63) - 1
_SET = ["sid", "check", "n"]


def shingles(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of ``size`` words."""
    words = hashing.word_hashes(text.lower().split())
    if not len(words):
        return words
    return np.unique(hashing.run_hashes(words, min(size, len(words))))


def need(n, threshold: int):
    """The least overlap of a partner: shingles that a set of n must share."""
    return (threshold * n + 99) // 100


def parity(own: np.ndarray) -> np.ndarray:
    """A bitmap of a set, in which each shingle flips a bit: a power of two of bits, about one for two shingles."""
    bits = 1 << max(PARITY_BITS, len(own).bit_length() - 1)
    cells = (hashing.mix(own) >> np.uint64(32)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(cells.astype(np.int64), minlength=bits) & 1)


def fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set in ``size`` bytes."""
    while len(bitmap) > size:
        bitmap = bitmap[: len(bitmap) // 2] ^ bitmap[len(bitmap) // 2 :]
    return bitmap


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """Of two sets' bitmaps: a number of shingles by which the sets differ at least. The longer one is folded."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(fold(a, size) ^ fold(b, size)).sum())


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column)


def _cells(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << FREQUENCY_BITS) - 1)
    return (keys & mask).astype(np.int64), (hashing.mix(keys) & mask).astype(np.int64) + (1 << FREQUENCY_BITS)


def frequencies(docs: DataFrame, shingle: int) -> np.ndarray:
    """Count-min sketch of the number of documents with a shingle, two rows, as the counts' binary logarithms (4 MB)."""
    size, part = 2 << FREQUENCY_BITS, 1 << PART_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for b in batches:
            counts = np.zeros(size, np.uint32) if counts is None else counts
            held, n = [], 0
            for text in _texts(b.column(0)):
                held.append(shingles(text, shingle))
                n += len(held[-1])
                if n > hashing.FLUSH:
                    counts += np.bincount(np.concatenate(_cells(np.concatenate(held))), minlength=size).astype(np.uint32)
                    held, n = [], 0
            if n:
                counts += np.bincount(np.concatenate(_cells(np.concatenate(held))), minlength=size).astype(np.uint32)
        for k in range(size // part) if counts is not None else ():
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "counts": [hashing.pack(counts[k * part : (k + 1) * part])]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums.setdefault(k, np.zeros(part, np.uint64))[:] += hashing.unpack(raw)
        for k, v in sums.items():
            logs = np.floor(np.log2(np.maximum(v, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "counts": [logs.tobytes()]})

    out = np.zeros(size, np.uint8)
    for r in docs.select("text").mapInArrow(count, "part int, counts binary").repartition("part").mapInArrow(merge, "part int, counts binary").collect():
        out[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(r["counts"], np.uint8)
    return out


def prefix(own: np.ndarray, logs: np.ndarray, threshold: int) -> tuple[np.ndarray, int]:
    """The longest prefix of a set in the common order, and the level that the set asks for."""
    first, second = _cells(own)
    log = np.minimum(logs[first], logs[second])
    n = len(own)
    least = need(n, threshold)
    levels = min(LEVELS, least)
    length = n - least + levels
    order = np.lexsort((own, log))[:length]
    cost = np.cumsum(2.0 ** log[order].astype(np.float64))
    by_level = [cost[n - least + k - 1] * (1 + COMPARE_COST / k) for k in range(1, levels + 1)]
    return own[order], 1 + int(np.argmin(by_level))


def _sets(docs: DataFrame, logs: np.ndarray, shingle: int, threshold: int) -> DataFrame:
    """doc_id, key, n, sid, check, level, parity, prefix of every document; the two hashes stand for the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in _texts(b.column(2)):
                own = shingles(text, shingle)
                if len(own):
                    sid, check = hashing.mix(own).sum(dtype=np.uint64), hashing.mix(own * np.uint64(3) + np.uint64(1)).sum(dtype=np.uint64)
                    rows.append((len(own), int(sid.astype(np.int64)), int(check.astype(np.int64)), parity(own).tobytes(), *prefix(own, logs, threshold)))
                else:
                    rows.append((0, None, None, None, np.zeros(0, np.uint64), 0))
            n, sid, check, bits, first, level = zip(*rows, strict=True) if rows else ((), (), (), (), (), ())
            flat = np.concatenate(first or [np.zeros(0, np.uint64)]).astype(np.int64)
            lists = pa.ListArray.from_arrays(np.cumsum([0] + [len(x) for x in first]).astype(np.int32), pa.array(flat))
            columns = [pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(check, pa.int64()), pa.array(level, pa.int32()), pa.array(bits, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "key", "n", "sid", "check", "level", "parity", "prefix"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, n long, sid long, check long, level int, parity binary, prefix array<long>")


def size_class(n: np.ndarray, threshold: int) -> np.ndarray:
    """Classes of sizes: two sets whose sizes allow the similarity are in the same one or in neighbouring ones."""
    width = max(np.log(100 / threshold), 1e-6) * (1 + 1e-9)  # a little more, for rounding
    return np.floor(np.log(n) / width).astype(np.uint64)


def _shared_tokens(nodes: DataFrame, threshold: int) -> DataFrame:
    """The tokens that stand in the prefixes of two nodes of fitting sizes, counted over all prefixes.

    A token's nodes are marked by size class, classes 64 apart alike: more nodes than marks, or neighbouring marks, and two may fit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = np.uint64(1) << (size_class(np.asarray(b.column(0)), threshold) & np.uint64(63))
            each = np.repeat(marks.view(np.int64), np.asarray(b.column(1).value_lengths()))
            yield pa.RecordBatch.from_arrays([b.column(1).flatten(), pa.array(each)], ["token", "mark"])

    entries = nodes.select("n", "prefix").mapInArrow(run, "token long, mark long")
    tokens = entries.groupBy("token").agg(F.count(F.lit(1)).alias("nodes"), F.bit_or("mark").alias("marks"))
    next_to = F.shiftleft("marks", 1).bitwiseOR(F.shiftrightunsigned("marks", 63))
    return tokens.filter((F.col("nodes") > F.bit_count("marks")) | (F.col("marks").bitwiseAND(next_to) != 0)).select("token")


def _files(docs: DataFrame) -> int:
    """The most files that a table between the steps needs: it grows with the documents, however many partitions the session shuffles to."""
    return max(LEAST_FILES, docs.count() // DOCS_A_FILE)


def _postings(nodes: DataFrame, threshold: int, files: int = LEAST_FILES) -> DataFrame:
    """sid, n, level, alone, tokens, places and the folded bitmap: a node's prefix entries that another node of a fitting size may have too, with their places in the node's order.

    A node with fewer of these than its level asks for has no partner. A bitmap of the shared tokens thins the lists where
    they are; what it holds by chance only makes work. More than ``IN_BITMAP`` tokens would fill it, and are joined.
    """
    shared = materialize(in_few(_shared_tokens(nodes, threshold), files), "shared-tokens")
    count = shared.count()
    lists = nodes.select("sid", "n", "level", F.size("prefix").alias("length"), "parity", "prefix")
    bitmap = None
    if count <= IN_BITMAP:
        bits = min(hashing.SKETCH_BITS, hashing.bits_for(count) + 2)
        bitmap = hashing.seen_twice(shared, lambda b: iter([np.asarray(b.column(0)).astype(np.uint64)]), least=1, bits=bits)
    else:
        met = nodes.select("sid", F.posexplode("prefix").alias("place", "token")).join(shared, "token")
        entries = met.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("e"))
        lists = lists.drop("prefix").join(entries, "sid").select("sid", "n", "level", "length", "parity", "e.token", "e.place")

    def thin(prefix: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
        lengths, tokens = np.asarray(prefix.value_lengths()), np.asarray(prefix.flatten())
        starts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        held = hashing.maybe_twice(bitmap, tokens.astype(np.uint64))
        ends = np.concatenate(([0], np.cumsum(held)))[starts].astype(np.int32)
        places = (np.arange(len(tokens)) - np.repeat(starts[:-1], lengths)).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(tokens[held])), pa.ListArray.from_arrays(ends, pa.array(places[held]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, places = thin(b.column(5)) if bitmap is not None else b.columns[5:]
            held = np.asarray(tokens.value_lengths())
            alone = (np.asarray(b.column(3)) - held).astype(np.int32)
            folds = np.array([fold(np.frombuffer(x.as_buffer(), np.uint8), 16).view(np.int64) for x in b.column(4)], np.int64).reshape(-1, 2)
            enough = pa.array(held >= np.asarray(b.column(2)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(alone), tokens, places, *(pa.array(x) for x in folds.T), b.column(4)], ["sid", "n", "level", "alone", "tokens", "places", *FOLDED, "parity"]).filter(enough)

    schema = "sid long, n long, level int, alone int, tokens array<long>, places array<int>, fold0 long, fold1 long, parity binary"
    return lists.mapInArrow(run, schema)


def _near(a: str, b: str, threshold: int):
    """Sizes that allow the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * threshold


def _texts_of(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, files: int) -> DataFrame:
    """sid, text of the nodes in ``pairs``. A bitmap of their texts' keys thins the documents before they are joined."""
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = nodes.join(wanted, "sid").select("sid", F.coalesce("rep", F.lit(_LAST)).alias("r"), F.col("key").alias("k"))
    wanted = materialize(in_few(wanted, files), "wanted-nodes")
    bitmap = hashing.seen_twice(wanted.select("k"), lambda b: iter([np.asarray(b.column(0)).astype(np.uint64)]), least=1, bits=hashing.bits_for(wanted.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(hashing.maybe_twice(bitmap, np.asarray(b.column(1)).astype(np.uint64))))

    few = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("r"), F.col("key").alias("k"), "text").mapInArrow(run, "r long, k long, text string")
    return materialize(in_few(few.join(wanted, ["r", "k"]).select("sid", "text").dropDuplicates(["sid"]), files), "node-texts")


def _spare(both: int, threshold: int) -> int:
    """The most shingles by which two similar sets, of so many shingles together, differ: they share at least both * t / (100 + t)."""
    return both - 2 * ((threshold * both + 99 + threshold) // (100 + threshold))


def _bitmaps_near(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps do not rule the similarity out."""
    marks = nodes.select("sid", "n", "parity")
    both = pairs.join(marks.withColumnsRenamed({"sid": "b", "n": "nb", "parity": "pb"}), "b").join(marks.withColumnsRenamed({"sid": "a", "n": "na", "parity": "pa"}), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, sizes, a, b = batch.columns
            bits = zip(sizes.to_pylist(), a, b, strict=True)
            keep = [least_difference(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) <= _spare(n, threshold) for n, x, y in bits]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "pa", "pb").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, threshold: int, files: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    pairs = materialize(in_few(_bitmaps_near(pairs, nodes, threshold), files, dealt=True), "node-pairs")
    texts = _texts_of(pairs, nodes, docs, files)
    both = pairs.join(texts.withColumnsRenamed({"sid": "b", "text": "tb"}), "b").join(texts.withColumnsRenamed({"sid": "a", "text": "ta"}), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, own = [], None, None
            for a, ta, tb in zip(batch.column(0).to_pylist(), _texts(batch.column(2)), _texts(batch.column(3)), strict=True):
                if a != last:
                    last, own = a, shingles(ta, shingle)
                other = shingles(tb, shingle)
                shared = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * shared >= threshold * (len(own) + len(other) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return materialize(in_few(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), files, dealt=True), "node-links")


def _hub_pairs(postings: DataFrame, threshold: int) -> DataFrame:
    """Each node with one hub: of the hubs of some of its entries the one it shares most of these with.

    The entries are the ones with the smallest tokens, which near copies mostly have in common. This pass only spares the
    exact one work: what it misses is found there.
    """
    size = F.floor(F.log(F.col("n")) * 4)
    few = postings.drop(*FOLDED, "places", "parity").withColumn("tokens", F.slice(F.array_sort("tokens"), 1, HUB_ENTRIES))
    p = few.select("sid", "n", "level", F.explode("tokens").alias("token"), size.alias("size"), (F.col("alone") * F.lit(1 << 32) + F.pmod(F.xxhash64("sid"), F.lit(1 << 32))).alias("rank"))
    hubs = p.groupBy("token", "size").agg(
        F.min_by("sid", "rank").alias("hub"), F.min_by("n", "rank").alias("m"), F.count(F.lit(1)).alias("nodes")
    )
    met = p.drop("rank").join(hubs.filter("nodes > 1").drop("nodes"), ["token", "size"]).filter((F.col("sid") != F.col("hub")) & _near("n", "m", threshold))
    most = met.groupBy("sid", "hub").agg(F.count(F.lit(1)).alias("k"), F.max("level").alias("level"))
    most = most.filter(F.col("k") >= F.least("level", F.lit(HUB_SHARED))).groupBy("sid").agg(F.max_by("hub", "k").alias("hub"))
    return most.select(F.col("sid").alias("b"), F.col("hub").alias("a"))


def _mixed(postings: DataFrame, roots: DataFrame, files: int) -> DataFrame:
    """sid, n, level, folds, root, tokens and places: of a node's entries those whose token stands in several components, in the node's order.

    A bitmap of these tokens thins the lists where they are, so they are not taken apart and put together again; a token that
    it holds by chance only makes work.
    """
    rooted = postings.drop("alone").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    tokens = rooted.select("root", F.explode("tokens").alias("token"))
    mixed = tokens.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("token")
    mixed = materialize(in_few(mixed, files), "mixed-tokens")
    bitmap = hashing.seen_twice(mixed, lambda b: iter([np.asarray(b.column(0)).astype(np.uint64)]), least=1, bits=hashing.bits_for(mixed.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, places = b.column(0), b.column(1)
            flat = np.asarray(tokens.flatten())
            held = hashing.maybe_twice(bitmap, flat.astype(np.uint64))
            starts = np.concatenate(([0], np.cumsum(np.asarray(tokens.value_lengths())))).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(held)))[starts].astype(np.int32)
            columns = [pa.ListArray.from_arrays(ends, pa.array(x[held])) for x in (flat, np.asarray(places.flatten()))]
            enough = np.diff(ends) >= np.asarray(b.column(4))
            yield pa.RecordBatch.from_arrays([*columns, *b.columns[2:]], b.schema.names).filter(pa.array(enough))

    kept = ["sid", "n", "level", "root", *FOLDED, "parity"]
    thinned = rooted.select("tokens", "places", *kept).mapInArrow(run, "tokens array<long>, places array<int>, sid long, n long, level int, root long, fold0 long, fold1 long, parity binary")
    return materialize(thinned, "mixed-postings")


def _met(lists: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) across components of nodes that meet on an entry, of sizes and folded bitmaps that allow the similarity.

    A pair that shares many entries would meet on each. An entry carries the ``BEFORE`` ones before it; where two nodes
    share one of these, they have met on that one already and are not listed again.
    """
    each = lists.select("sid", "n", "level", "root", *FOLDED, "tokens", F.posexplode(F.arrays_zip("tokens", "places")).alias("i", "e"))
    packed = F.shiftleft(F.col("n"), 32) + F.shiftleft(F.col("e.places").cast("long"), 8) + F.col("level")  # in one long
    p = each.select(
        "sid", "root", *FOLDED, F.col("e.tokens").alias("token"), packed.alias("of"),
        F.slice("tokens", F.greatest(F.col("i") - BEFORE, F.lit(0)) + 1, F.least("i", F.lit(BEFORE))).alias("before"),
    )
    x, y = p.alias("x"), p.alias("y")  # of the same columns, so that entries are dealt once
    n, at, level = [], [], []
    for side in "xy":
        own = F.shiftrightunsigned(f"{side}.of", 32)
        place = F.shiftrightunsigned(f"{side}.of", 8).bitwiseAND((1 << 24) - 1)
        n.append(own)
        level.append(F.col(f"{side}.of").bitwiseAND(255))
        at.append(place + 1 - own + F.floor((own * threshold + 99) / 100))  # the level with which the entry comes into the prefix
    larger = (n[0] > n[1]) | ((n[0] == n[1]) & (F.col("x.sid") > F.col("y.sid")))
    sizes = F.least(*n) * 100 >= F.greatest(*n) * threshold
    differ = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in FOLDED), F.lit(0))
    both = n[0] + n[1]
    spare = both - 2 * F.floor((threshold * both + 99 + threshold) / (100 + threshold))  # as _spare
    fits = larger & sizes & (F.col("x.root") != F.col("y.root")) & (F.greatest(*at) <= F.greatest(*level)) & (differ <= spare)
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & fits & ~F.arrays_overlap("x.before", "y.before"))
    return met.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()


def _enough(a: tuple, b: tuple, threshold: int) -> bool:
    """Whether two nodes, each (n, level, tokens, places), share as many prefix entries as the higher level asks for.

    Of either node's entries up to the last shared one, those not shared are not in the other's set at all; with more of
    them than the similarity allows the pair cannot link.
    """
    level = max(a[1], b[1])
    _, i, j = np.intersect1d(a[2], b[2], assume_unique=True, return_indices=True)
    i, j = a[3][i], b[3][j]
    inside = (i < a[0] - need(a[0], threshold) + level) & (j < b[0] - need(b[0], threshold) + level)
    k = int(inside.sum())
    return k >= level and int(i[inside].max() + j[inside].max()) + 2 - 2 * k <= _spare(a[0] + b[0], threshold)


def _open_pairs(postings: DataFrame, roots: DataFrame, threshold: int, files: int) -> DataFrame:
    """All pairs (a, b) across components that share as many prefix entries as the higher of the two levels asks for, and whose bitmaps allow the similarity."""
    lists = _mixed(postings, roots, files)
    pairs = materialize(in_few(_met(lists, threshold), files), "met-pairs")
    own = lists.select("sid", "n", "level", "tokens", "places", "parity")
    sides = [own.select(F.col("sid").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in own.columns[1:]]) for c in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [
                [
                    (n, level, np.asarray(tokens.values), np.asarray(places.values))
                    for n, level, tokens, places in zip(*(batch.column(k).to_pylist() for k in at[:2]), *(batch.column(k) for k in at[2:]), strict=True)
                ]
                for at in ((2, 3, 4, 5), (7, 8, 9, 10))
            ]
            bits = [[np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(k)] for k in (6, 11)]
            keep = [least_difference(p, q) <= _spare(a[0] + b[0], threshold) and _enough(a, b, threshold) for a, b, p, q in zip(*nodes, *bits, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", *[f"{x}_{c}" for c in "ab" for x in own.columns[1:]])
    return both.mapInArrow(run, "a long, b long")


def _nodes(sets: DataFrame, files: int) -> DataFrame:
    """sid, check, n, rep, key, level, parity, prefix of every distinct set; ``rep`` is the smallest id that has it.

    A bitmap tells which sets may occur twice. Only these are dealt by set; all others are nodes where they are read.
    """
    some = sets.filter("n > 0")
    twice = hashing.seen_twice(some.select("sid"), lambda b: iter([np.asarray(b.column(0)).astype(np.uint64)]), bits=hashing.bits_for(some.count()))
    row = some.select(*_SET, F.col("doc_id").alias("rep"), "key", "level", "parity", "prefix")

    def held(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(hashing.maybe_twice(twice, np.asarray(b.column(0)).astype(np.uint64)) == wanted))

        return row.mapInArrow(run, row.schema)

    order = F.coalesce("rep", F.lit(_LAST))
    each = [F.min("rep").alias("rep"), F.min_by("key", order).alias("key"), *[F.first(c).alias(c) for c in ("level", "parity", "prefix")]]
    return held(False).unionByName(in_few(held(True).groupBy(*_SET).agg(*each), files))


def join(docs: DataFrame, *, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, key, n, sid, root, component_id of every document; ``key`` is a hash of its text, ``root`` one of its component."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    sets = materialize(_sets(d, frequencies(d, shingle), shingle, threshold), "shingle-sets")
    files = _files(sets)
    nodes = materialize(_nodes(sets, files), "shingle-nodes")
    postings = materialize(_postings(nodes, threshold, files), "shingle-postings")
    links = _linked(_hub_pairs(postings, threshold), nodes, d, shingle, threshold, files)
    more = _linked(_open_pairs(postings, components(links), threshold, files), nodes, d, shingle, threshold, files)
    roots = components(links.union(more)).withColumnRenamed("node", "sid")
    rooted = nodes.select(*_SET, "rep").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    rooted = materialize(in_few(rooted, files), "rooted-nodes")
    ids = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    named = rooted.join(ids, "root").select(*_SET, "root", "component")
    out = sets.select("doc_id", "key", *_SET).join(named, _SET, "left")
    return out.select("doc_id", "key", "n", "sid", "root", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    """op8: one row per document."""
    return join(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, *, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each component the row whose id names it, and every row without shingles.

    Few rows go. A bitmap of their keys lets all others pass where they are read; only rows that it holds are joined.
    """
    rows = join(docs, shingle=shingle, threshold=threshold)
    first = F.row_number().over(Window.partitionBy("root").orderBy("key", "sid"))
    named = rows.filter((F.col("n") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = named.withColumn("place", first).filter("place = 1").select(F.col("doc_id").alias("i"), F.col("key").alias("j"))
    every = rows.filter("n > 0").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("rows"))
    judged = every.join(stay, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("j")), "left")
    special = judged.filter("j is null or rows > 1").select("doc_id", "key", F.col("j").isNotNull().alias("stays"))
    special = materialize(in_few(special, _files(docs)), "rows-that-go")
    bits = hashing.bits_for(special.count())
    bitmap = hashing.seen_twice(special.select(F.xxhash64("doc_id", "key")), lambda b: iter([np.asarray(b.column(0)).astype(np.uint64)]), least=1, bits=bits)

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    packed = packed.withColumns({"d": F.col("row.doc_id").cast("long"), "k": F.xxhash64("row.text")}).withColumn("x", F.xxhash64("d", "k"))

    def held(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(hashing.maybe_twice(bitmap, np.asarray(b.column(3)).astype(np.uint64)) == wanted))

        return packed.mapInArrow(run, packed.schema)

    met = held(True).join(special, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key")), "left")
    twin = F.row_number().over(Window.partitionBy("d", "k").orderBy(F.lit(0)))
    kept = met.withColumn("twin", twin).filter(F.col("stays").isNull() | (F.col("stays") & (F.col("twin") == 1)))
    return held(False).select("row").union(kept.select("row")).select("row.*")
