"""Similarity join on word n-grams by chosen paths.

Each text is the set of its five-word shingles (A-Z in lower case; a shorter
text is one shingle of all its words). Equal sets form one class, and
classes are joined: a run sends every class down a path of sampled tokens
(minhash coordinates), on which similar sets stay together with a probability
of their similarity. Buckets that are still large are split again on three more
sampled tokens each, which the path has not used yet, unless their sets are alike: how
often two of them agree on a token is their mean similarity, and is counted on
``PROBES`` unused tokens of some ``PROBED`` sets (this only chooses between two ways
to the same links). Such dense buckets, like all small ones, are compared by brute
force, exactly, in blocks of a bounded number of sets and of shingles. Runs repeat until a pair at the threshold is met with the target
recall. A pair that meets in several buckets is counted in the least of them only.

Most sets of most buckets have met by chance. Before shingles are read and sent, the
sets of a bucket are compared by their marks, a byte of each minhash; only sets stay that agree with a
partner on so many of them that a pair at the threshold agrees on fewer with a probability below
``MISSED``, which adds to what the target recall leaves out.

Pairs never leave the task that compares them: it returns, for each set, how many
links it has and one edge of a spanning forest. Star contraction turns these
edges into groups, in rounds that are written to the shared folder.

Defined cases: null and wordless texts have empty sets, which are equal to each
other and similar to nothing else; repeated rows are copies; rows that repeat
an id with another text are documents of their own; a null id is a document
whose group has the smallest id that is not null, or null; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import batch_of, keyed_only, rows_of, small_batches, spare, written

WORDS = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
#: Minhash coordinates of a set; paths sample from these.
COORDINATES = 64
#: Buckets up to this size are compared at once; larger ones are split, or compared in blocks.
BUCKET = 1024
BLOCK = 512
#: Shingles in a block, if its sets are large (8 bytes each; a task holds two blocks).
BLOCK_SHINGLES = 2_000_000
#: Values (of shingles or paths) that a comparison numbers at once, at some 70 bytes each.
NUMBERED = 500_000
MAX_DEPTH = 8
#: Sets whose mean similarity is at least this are not split; by so many tokens, of so many sets.
DENSE = 0.55
PROBES, PROBED = 16, 64
#: Tokens on which a large bucket is split, each into buckets of its own.
SPLITS = 3
#: Probability that a pair at the threshold agrees on too few minhashes to be compared.
MISSED = 1e-9

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PLACES = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(WORDS)], np.uint64)
_FACTORS = np.array([pow(0x2545F491, 2 * i + 1, 1 << 32) | 1 for i in range(COORDINATES)], np.uint32)[:, None]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = _mixed(np.fromiter(map(crc32, words), np.uint64, len(words)) + np.fromiter(map(len, words), np.uint64, len(words)) * np.uint64(0x1F123BB5159A55E5))
    k = min(size, len(words))
    n = len(words) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += hashes[i : i + n] * _PLACES[i]
    return np.unique(_mixed(total))


def minhashes(found: np.ndarray) -> bytes:
    """The least value of each coordinate's hash, as little-endian 32-bit numbers."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        x = low[at : at + 4096] * _FACTORS
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        best = np.minimum(best, x.min(axis=1))
    return best.astype("<u4").tobytes()


def signature(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.astype("<u8").tobytes(), digest_size=16).digest()


SKETCH = "doc_id long, sig binary, size int, minhashes binary, marks binary"
_SKETCH = pa.schema([("doc_id", pa.int64()), ("sig", pa.binary()), ("size", pa.int32()), ("minhashes", pa.binary()), ("marks", pa.binary())])
MEMBER = "path long, low int, high int, side int, sig binary, n_copies long"
_MEMBER = pa.schema([("path", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("side", pa.int32()), ("sig", pa.binary()), ("n_copies", pa.int64())])
SET = "sig binary, members binary"
_SET = pa.schema([("sig", pa.binary()), ("members", pa.binary())])
LINKED = "sig binary, other binary, n_texts long, n_docs long"
_LINKED = pa.schema([("sig", pa.binary()), ("other", pa.binary()), ("n_texts", pa.int64()), ("n_docs", pa.int64())])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    small_batches(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, "doc_id", "text"):
            sets = (shingles(t, size) for t in texts)
            hashed = ((i, s, minhashes(s)) for i, s in zip(ids, sets, strict=True))
            yield batch_of([(i, signature(s), len(s), h, h[::4]) for i, s, h in hashed], _SKETCH)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(sketch, SKETCH)


def runs_for(threshold: float, recall: float, splits: int = 3) -> int:
    """Runs after which a pair at the threshold has met with this probability, through so many levels of splits."""
    met = threshold * (1 - (1 - threshold) ** SPLITS) ** splits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def _sized(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` (path, ...) of paths that hold two rows or more, with their ``n`` and the ``shingles`` of all their sets."""
    rows = written(rows, label)
    sizes = written(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("long")).alias("shingles")).filter("n > 1"), f"{label}-sizes")
    return rows.join(sizes, "path")


def _bit(coordinate: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), coordinate.cast("int"))


def _fresh_coordinates(used: Column, wanted: int) -> Column:
    """Different coordinates that ``used`` (a bit for each one) lacks, drawn by the path's hash."""
    unused = F.filter(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda c: used.bitwiseAND(_bit(c)) == 0)
    drawn = F.array_sort(F.transform(unused, lambda c: F.struct(F.xxhash64("path", c).alias("h"), c.alias("c"))))
    return F.transform(F.slice(drawn, 1, wanted), lambda x: x["c"])


def _value(coordinate: Column) -> Column:
    return F.substring(F.col("minhashes"), 4 * coordinate + 1, F.lit(4))


def _buckets(classes: DataFrame, runs: range) -> tuple[DataFrame, int]:
    """Buckets ``path, sig, size, n_copies, n, shingles`` of these runs, and how often the most split of them were split."""
    starts = F.inline(F.array(*(F.struct(F.xxhash64(F.lit(r), _value(F.lit(r % COORDINATES))).alias("path"), _bit(F.lit(r % COORDINATES)).alias("used")) for r in runs)))
    level = written(_sized(classes.select(starts, "sig", "size", "n_copies"), "paths"), "level")
    leaf = ("path", "sig", "size", "n_copies", "n", "shingles")
    done, splits_done, pool = [], 0, classes.select("sig", "minhashes")
    for depth in range(1, MAX_DEPTH):
        large = level.filter(F.col("n") > BUCKET)
        if large.isEmpty():
            break
        done.append(level.filter(F.col("n") <= BUCKET).select(*leaf))
        # few classes are in large buckets: only their minhashes are read from here on
        own = written(large.select("sig").distinct(), "large-classes")
        pool = written(pool.join(keyed_only(own), "sig", "left_semi"), "pool")
        drawn = large.join(pool, "sig").withColumn("drawn", _fresh_coordinates(F.col("used"), max(PROBES, SPLITS)))
        probed = drawn.filter(F.pmod(F.xxhash64("path", "sig"), F.col("n")) < PROBED)
        probes = probed.select("path", F.inline(F.transform(F.slice("drawn", 1, PROBES), lambda c: F.struct(c.alias("c"), _value(c).alias("v")))))
        tokens = probes.groupBy("path", "c", "v").agg(F.count(F.lit(1)).alias("m")).groupBy("path", "c").agg(F.sum(F.col("m") * (F.col("m") - 1)).alias("agree"), F.sum("m").alias("m"))
        alike = tokens.groupBy("path").agg(F.avg(F.col("agree") / F.nullif(F.col("m") * (F.col("m") - 1), F.lit(0))).alias("mean"))
        dense = written(alike.filter(F.col("mean") >= DENSE).select("path"), "dense")
        done.append(large.join(keyed_only(dense), "path", "left_semi").select(*leaf))
        child = lambda c: F.struct(F.xxhash64("path", c, _value(c)).alias("child"), F.col("used").bitwiseOR(_bit(c)).alias("child_used"))
        split = drawn.join(keyed_only(dense), "path", "left_anti").select(F.inline(F.transform(F.slice("drawn", 1, SPLITS), child)), "sig", "size", "n_copies")
        level = written(_sized(split.toDF("path", "used", "sig", "size", "n_copies"), "split"), "level")
        if level.isEmpty():
            break
        splits_done = depth
    level = level.select(*leaf)
    for more in done:
        level = level.unionByName(more)
    return level, splits_done


def leaves(classes: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """Buckets ``path, sig, size, n_copies, n, shingles`` in which sets are to be compared; each membership once.

    Where buckets were split more often than the runs made so far allow for, more runs follow.
    """
    level, made, depth = None, 0, 3
    while made < (wanted := runs_for(threshold, recall, depth)):
        more, splits = _buckets(classes, range(made, wanted))
        level = more if level is None else level.unionByName(more)
        made, depth = wanted, max(depth, splits)
    level = written(level, "buckets")
    # runs often agree on a bucket: of those with the same members, the least path stays
    same = level.groupBy("path", "n").agg(F.sum(F.xxhash64("sig").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64("sig", F.lit(1)).cast("decimal(38,0)")).alias("b")).groupBy("n", "a", "b").agg(F.min("path").alias("path"))
    return written(level.join(written(same.select("path"), "distinct-buckets"), "path"), "leaves")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets, by products of blocks of columns.

    The values are hashes: equal ranges hold about as many each, and are taken one after another.
    """
    n = len(sets)
    out = np.zeros((n, n), np.float64)
    parts = -(-sum(map(len, sets)) // NUMBERED)
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    cuts = [[0, *np.searchsorted(s, edges).tolist(), len(s)] for s in sets]
    width = 4096
    block = np.zeros((n, width), np.float32)
    for part in range(parts):
        pieces = [s[cut[part] : cut[part + 1]] for s, cut in zip(sets, cuts, strict=True)]
        owner = np.repeat(np.arange(n), [len(s) for s in pieces])
        _, column, count = np.unique(np.concatenate(pieces), return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        keep = count[column] > 1
        owner, column = owner[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [start, start + width])
            block[:] = 0
            block[owner[a:b], column[a:b] - start] = 1
            out += block @ block.T
    return out


def compared(path: int, sides: list[int], wanted: tuple[int, int], sets: list[np.ndarray], copies: list[int], paths: list[list[int]], threshold: float) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Links of one bucket or block pair: texts and documents linked to each set, and each set's root."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    if n == 2:
        shared = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))]] * 2, np.float64)
    else:
        shared = _intersections(sets)
    linked = np.triu(shared * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-6, 1)
    if wanted[0] != wanted[1]:
        side = np.array(sides)
        linked = (linked | linked.T) & (side[:, None] == wanted[0]) & (side[None, :] == wanted[1])
    first, second = np.nonzero(linked)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    texts, docs = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(first):
        lower = [[p for p in own if p < path] for own in paths]
        weight = np.array(copies, np.int64)
        if n > 64:
            fresh = _intersections([np.sort(np.array(own, np.int64).view(np.uint64)) for own in lower])[first, second] == 0
        else:
            names = [frozenset(own) for own in lower]
            fresh = np.array([names[i].isdisjoint(names[j]) for i, j in zip(first.tolist(), second.tolist(), strict=True)])
        np.add.at(texts, first[fresh], 1)
        np.add.at(texts, second[fresh], 1)
        np.add.at(docs, first[fresh], weight[second[fresh]])
        np.add.at(docs, second[fresh], weight[first[fresh]])
        for i, j in zip(first.tolist(), second.tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return texts, docs, [find(i) for i in range(n)]


def _compare(threshold: float):
    """Compares the groups of a partition that is sorted by group."""

    def judge(group: list[tuple]) -> list[tuple]:
        if len(group) < 2:
            return []
        path, low, high = group[0][:3]
        sigs = [r[4] for r in group]
        texts, docs, root = compared(path, [r[3] for r in group], (low, high), [np.frombuffer(r[7], np.uint64) for r in group], [r[5] for r in group], [r[6] for r in group], threshold)
        return [(s, sigs[r] if r != i else None, int(t), int(d)) for i, (s, r, t, d) in enumerate(zip(sigs, root, texts, docs, strict=True)) if t or r != i]

    return _by_group(judge, ("path", "low", "high", "side", "sig", "n_copies", "paths", "members"), _LINKED)


def least_agreeing(threshold: float, missed: float = MISSED) -> int:
    """Of all coordinates, as many as a pair at the threshold agrees on but for this probability."""
    below, k = 0.0, 0
    while k < COORDINATES:
        below += math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k)
        if below > missed:
            break
        k += 1
    return k


def with_partners(sides: list[int], wanted: tuple[int, int], marks: list[bytes], least: int) -> np.ndarray:
    """Which sets of one bucket or block pair agree on so many marks with another one (of the other block, if there are two)."""
    m = np.frombuffer(b"".join(marks), np.uint8).reshape(len(marks), COORDINATES)
    side, two = np.array(sides), wanted[0] != wanted[1]
    first, second = (np.flatnonzero(side == w) for w in wanted) if two else (np.arange(len(m)),) * 2
    kept = np.zeros(len(m), bool)
    columns = np.ascontiguousarray(m[second].T)
    for at in range(0, len(first), 256):
        rows = first[at : at + 256]
        agree = np.zeros((len(rows), len(second)), np.uint8)
        for c in range(COORDINATES):
            agree += m[rows, c][:, None] == columns[c]
        if not two:
            agree[np.arange(len(rows)), rows] = 0
        met = agree >= least
        kept[rows] |= met.any(axis=1)
        kept[second] |= met.any(axis=0)
    return kept


def _partnered(least: int):
    """Sets of the groups of a partition, sorted by group, that have a partner there."""

    def judge(group: list[tuple]) -> list[tuple]:
        if len(group) < 2:
            return []
        kept = with_partners([r[3] for r in group], group[0][1:3], [r[6] for r in group], least)
        return [r[:6] for r, keep in zip(group, kept.tolist(), strict=True) if keep]

    return _by_group(judge, ("path", "low", "high", "side", "sig", "n_copies", "marks"), _MEMBER)


def _by_group(judge, names: tuple[str, ...], schema: pa.Schema):
    """``judge`` over the groups (the first three columns) of a partition that is sorted by these."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for rows in rows_of(batches, *names):
            out = []
            for row in zip(*rows, strict=True):
                if group and group[0][:3] != row[:3]:
                    out += judge(group)
                    group = []
                group.append(row)
            yield batch_of(out, schema)
        yield batch_of(judge(group), schema)

    return walk


def _dealt(rows: DataFrame) -> DataFrame:
    """Block pairs to partitions: those of one bucket one after another, so that a large bucket's pairs are spread evenly."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pair = F.col("high").cast("long") * (F.col("high") + 1) / 2 + F.col("low")
    return rows.repartitionById(partitions, F.pmod(F.xxhash64("path") % partitions + pair.cast("long"), F.lit(partitions)).cast("int")).sortWithinPartitions("path", "low", "high", "sig")


def _sets_of(docs: DataFrame, classes: DataFrame, needed: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """The shingles of the needed classes, read from the text of each one's first document."""
    first = written(classes.join(needed, "sig", "left_semi").select(F.col("first_id").alias("of_id"), F.col("sig").alias("of_sig")), "needed")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(keyed_only(first), F.col("doc_id").eqNullSafe(F.col("of_id")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts_, sigs in rows_of(batches, "text", "of_sig"):
            sets = ((sig, shingles(t, size)) for t, sig in zip(texts_, sigs, strict=True))
            # another text under the same id is not the class's
            yield batch_of([(sig, s.tobytes()) for sig, s in sets if signature(s) == sig], _SET)

    return texts.select("text", "of_sig").mapInArrow(build, SET).groupBy("sig").agg(F.first("members").alias("members"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that has an edge (``a, b``): large and small stars in turns until nothing changes."""
    sorted_ = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    stars = written(sorted_(edges), "edges")
    seen = mark(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # every node keeps its own least neighbour, so that no edge is lost
        large = written(sorted_(large.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))), "large-stars")
        lowest = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(lowest, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = written(sorted_(small.unionByName(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))), "small-stars")
        now = mark(stars)
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """Per row of ``docs``: its group and its number of links.

    Columns: ``doc_id``; ``class_id``, the smallest doc_id of all that links
    connect with it; ``copy_id``, the smallest with an equal set; ``n_links``,
    other documents with similar or equal sets; ``n_texts``, other sets that
    are similar; ``is_first``, whether this row stays if one of a group is kept.
    """
    sketched = written(sketches(docs, id_col, text_col, size), "sketches")
    classes = written(sketched.groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"), F.first("size").alias("size"), F.first("minhashes").alias("minhashes"), F.first("marks").alias("marks")), "classes")
    met = leaves(classes.filter("size > 0"), threshold, recall)
    one = (F.col("n") <= 2 * BLOCK) & (F.col("shingles") <= 2 * BLOCK_SHINGLES)
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    sided = met.withColumn("blocks", F.when(one, F.lit(1)).otherwise(F.least(blocks, F.col("n"))).cast("int")).withColumn("side", F.pmod(F.xxhash64("sig", "path"), F.col("blocks")).cast("int"))
    # marks and shingles meet a set once, with all its buckets; a set has a bucket for each run and split at most
    of_set = sided.groupBy("sig").agg(F.first("n_copies").alias("n_copies"), F.collect_list(F.struct("path", "blocks", "side")).alias("buckets"))
    marked = of_set.join(classes.select("sig", "marks"), "sig").select("sig", "n_copies", "marks", F.inline("buckets"))
    paired = marked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("path", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "sig", "n_copies", "marks")
    partnered = written(_dealt(paired).mapInArrow(_partnered(least_agreeing(threshold)), MEMBER), "partnered")
    own = written(partnered.groupBy("sig").agg(F.first("n_copies").alias("n_copies"), F.collect_list(F.struct("path", "low", "high", "side")).alias("buckets")), "buckets-of")
    sets = _sets_of(docs, classes, own.select("sig"), id_col, text_col, size)
    paths = F.array_distinct(F.transform("buckets", lambda b: b["path"])).alias("paths")
    full = own.join(sets, "sig").select("sig", "n_copies", paths, "members", F.inline("buckets")).select("path", "low", "high", "side", "sig", "n_copies", "paths", "members")
    linked = written(_dealt(full).mapInArrow(_compare(threshold), LINKED), "linked")
    groups = components(linked.filter("other is not null").select(F.col("sig").alias("a"), F.col("other").alias("b")))
    links = linked.groupBy("sig").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    ids = classes.select("sig", "first_id", "n_copies")
    grouped = written(ids.join(groups.withColumnRenamed("node", "sig"), "sig"), "groups")
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), F.col("first_id"), F.col("sig"))).alias("least")).select("root", F.col("least.first_id").alias("class_id"), F.col("least.sig").alias("class_sig"))
    known = grouped.join(first, "root").join(links, "sig", "left").select("sig", "class_id", "class_sig", "first_id", "n_copies", "n_texts", "n_docs")
    copied = ids.filter("n_copies > 1").join(grouped.select("sig"), "sig", "left_anti").select("sig", F.col("first_id").alias("class_id"), F.col("sig").alias("class_sig"), "first_id", "n_copies", F.lit(0).cast("long").alias("n_texts"), F.lit(0).cast("long").alias("n_docs"))
    notable = written(known.unionByName(copied), "notable")
    rows = sketched.select("doc_id", "sig").join(notable, "sig", "left")
    alone = F.col("n_copies").isNull()
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("copy_id"),
        F.when(alone, zero).otherwise(F.col("n_copies") - 1 + F.coalesce("n_docs", zero)).alias("n_links"),
        F.coalesce("n_texts", zero).alias("n_texts"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("sig") == F.col("class_sig")))).alias("is_first"),
        "sig",
    )


def one_of_each(docs: DataFrame, joined: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """``docs`` without the rows that are not first of their group; ``joined`` is from ``ngram_join``.

    Ids that occur once, as all should, are dropped by id. Rows that share an
    id, or have none, are told apart by their sets.
    """
    shared_id, dropped, own, other, of = (spare(docs, n) for n in ("shared_id", "dropped_id", "own_sig", "first_id_of", "first_sig"))
    judged = written(joined.select("doc_id", "sig", "is_first"), "judged")
    shared = judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").select(F.col("doc_id").alias(shared_id))
    shared = written(shared, "shared-ids")
    rest = written(judged.filter("not is_first and doc_id is not null").select(F.col("doc_id").alias(dropped)).distinct(), "dropped-ids")
    if shared.isEmpty():
        return docs.join(keyed_only(rest), F.col(id_col) == F.col(dropped), "left_anti")
    marked = keyed_only(shared)
    single = docs.join(marked, F.col(id_col).eqNullSafe(F.col(shared_id)), "left_anti").join(keyed_only(rest), F.col(id_col) == F.col(dropped), "left_anti")
    double = docs.join(marked, F.col(id_col).eqNullSafe(F.col(shared_id)), "left_semi")
    sig = F.pandas_udf(lambda texts: texts.map(lambda t: signature(shingles(t, size))), "binary")
    first = judged.filter("is_first").select(F.col("doc_id").alias(other), F.col("sig").alias(of)).distinct()
    chosen = double.withColumn(own, sig(F.coalesce(F.col(text_col), F.lit("")))).join(first, F.col(id_col).eqNullSafe(F.col(other)) & (F.col(own) == F.col(of)), "left_semi")
    return single.unionByName(chosen.dropDuplicates([id_col, own]).drop(own))
