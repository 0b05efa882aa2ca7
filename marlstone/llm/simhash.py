"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart have a common variant within half
the radius of both. Every distinct fingerprint therefore goes to all variants of
its leading bits within half the radius; the task that holds a prefix expands the
rest of the variants there, so the shuffle carries tens or hundreds of rows a
fingerprint and not the thousands of the whole ball. The prefix is as long as the
counted fingerprints need, so that no prefix has more than LOAD of them, however
many there are and however close together. Fingerprints that collide
on a variant are linked to the smallest among them, never pairwise; a link is
verified by its distance. Links make components by alternating large-star and
small-star steps over tables in the shared folder.

Defined results: null and empty texts have no words and fingerprint zero, linked
like any other; a null doc_id is kept and never is a component's smallest, a
component of such rows alone has a null component; repeated rows are repeated;
an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, drop_cut, packed, partitions, rows_of, ship, unpacked
from marlstone.session import temporary

#: Bits of a fingerprint; bits of the shortest and longest prefixes, and the
#: fingerprints of a prefix beyond which it takes STEP bits more. Beyond DEEPEST a
#: prefix is expanded part by part in its task.
BITS, PREFIX, STEP, DEEPEST, LOAD = 64, 12, 4, 40, 1 << 16
#: Variants that a task holds at a time; a prefix with more is split further.
VARIANTS = 1 << 20
#: Shingle hashes whose bits are counted at a time.
_COUNT = 1 << 14


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the text's word shingles: a bit is set if over half have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    stops = ends[shingle - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(line[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _COUNT):
        part = hashes[i : i + _COUNT].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, tie: str | None = None) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long); with ``tie`` also
    the text's hash under that name."""
    more = [tie] if tie else []

    def run(batches):
        for batch in batches:
            for part in rows_of(batch):
                fps = np.array([fingerprint(t, shingle, seed) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64)), *[part.column(c) for c in more]], ["doc_id", "fp", *more])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.xxhash64("text").alias(c) for c in more])
    ship(docs.sparkSession)
    return rows.mapInArrow(run, "doc_id long, fp long" + "".join(f", {c} long" for c in more))


def _masks(first: int, last: int, flips: int) -> np.ndarray:
    """All masks of exactly ``flips`` bits from bit first (of the top) to last."""
    return np.array([sum(1 << (BITS - 1 - b) for b in c) for c in combinations(range(first, last), flips)], np.uint64)


def collisions(fps: np.ndarray, index: np.ndarray, budget: np.ndarray, depth: int):
    """(index, index) links among fingerprints that share a variant, where all
    variants agree on the leading ``depth`` bits and each fingerprint may still
    flip ``budget`` of the others."""
    rest = BITS - depth
    each = np.array([sum(len(_MASKS(depth, BITS, k)) for k in range(f + 1)) for f in range(int(budget.max()) + 1)])
    if len(fps) > 1 << depth or (each[budget].sum() > VARIANTS and rest > 8):
        width = min(6, rest)
        shift = np.uint64(rest - width)
        parts = []
        for flips in range(int(budget.max()) + 1):
            own = budget >= flips
            for mask in _MASKS(depth, depth + width, flips):
                parts.append((fps[own] ^ mask, index[own], budget[own] - flips))
        f, i, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        where = (f >> shift) & np.uint64((1 << width) - 1)
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange((1 << width) + 1, dtype=np.uint64))
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if z - a > 1:
                take = order[a:z]
                yield from collisions(f[take], i[take], b[take], depth + width)
        return
    low = np.uint64((1 << rest) - 1) if rest < BITS else np.uint64(0xFFFFFFFFFFFFFFFF)
    found = []
    place = np.arange(len(fps), dtype=np.uint64)
    for left in range(int(budget.max()) + 1):
        own = budget == left
        if own.any():
            base, slot = fps[own] & low, place[own]
            for flips in range(left + 1):
                masks = _MASKS(depth, BITS, flips)
                found.append((((base[:, None] ^ masks) << np.uint64(depth)) | slot[:, None]).ravel())
    keys = np.sort(np.concatenate(found))
    variant, slot = keys >> np.uint64(depth), (keys & np.uint64((1 << depth) - 1)).astype(np.int64)
    new = np.ones(len(keys), bool)
    new[1:] = variant[1:] != variant[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    other = ~new
    a, b = slot[other], slot[head[other]]
    if len(a):
        pair = np.unique(np.stack([index[a], index[b]]), axis=1)
        yield pair[:, pair[0] != pair[1]]


_MASK_CACHE: dict[tuple[int, int, int], np.ndarray] = {}


def _MASKS(first: int, last: int, flips: int) -> np.ndarray:  # noqa: N802
    key = (first, last, flips)
    if key not in _MASK_CACHE:
        if len(_MASK_CACHE) > 256:
            _MASK_CACHE.clear()
        _MASK_CACHE[key] = _masks(first, last, flips)
    return _MASK_CACHE[key]


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each of n nodes' component, by hooking and jumping."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, least)
        while True:
            up = new[new]
            if np.array_equal(up, new):
                break
            new = up
        if np.array_equal(new, label):
            return label
        label = new


def _spread(fps: DataFrame, bits: int, half: int) -> DataFrame:
    """prefix and fp: each fingerprint under all variants of its leading bits."""
    masks = np.concatenate([_masks(0, bits, k) for k in range(min(half, bits) + 1)]) >> np.uint64(BITS - bits)
    spread = fps.select("fp", F.explode(F.array(*[F.lit(int(m)) for m in masks])).alias("_m"))
    return spread.select(F.shiftrightunsigned("fp", BITS - bits).bitwiseXOR(F.col("_m")).alias("prefix"), "fp")


def prefix_bits(fps: DataFrame, half: int) -> int:
    """Bits of the shortest prefix that no more than LOAD fingerprints share, with
    their variants; counted with partial sums, so only the largest is known here."""
    return _prefixes(fps, half)[0]


def _prefixes(fps: DataFrame, half: int) -> tuple[int, int]:
    """``prefix_bits``, and the number of fingerprints."""
    bits, n = PREFIX, 0
    while bits < DEEPEST:
        sizes = _spread(fps, bits, half).groupBy("prefix").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        n = (sizes["all"] or 0) // sum(len(_masks(0, bits, k)) for k in range(min(half, bits) + 1))
        if (sizes.most or 0) <= LOAD:
            break
        bits += STEP
    return bits, n


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a > b) that join all distinct fingerprints at most ``radius`` bits
    apart, directly or over others: a star for each prefix and component."""
    half, spark = radius // 2, fps.sparkSession
    if radius % 2:
        raise ValueError("the radius must be even")
    bits, n = _prefixes(fps, half)
    dealt = _spread(fps, bits, half).repartition(partitions(spark), "prefix").sortWithinPartitions("prefix")

    def group(prefix: int, found: np.ndarray):
        found = np.unique(found.view(np.uint64))
        flips = np.bitwise_count((found >> np.uint64(BITS - bits)) ^ np.uint64(prefix)).astype(np.int64)
        if len(found) < 2:
            return None
        pairs = [p for p in collisions(found, np.arange(len(found)), half - flips, bits) if p.size]
        if not pairs:
            return None
        a, b = np.concatenate(pairs, axis=1)
        near = np.bitwise_count(found[a] ^ found[b]) <= radius
        label = local_components(len(found), a[near], b[near])
        own = np.flatnonzero(label != np.arange(len(found)))
        return found[own].view(np.int64), found[label[own]].view(np.int64)

    def run(batches):
        held, now = [], None

        def close():
            stars = group(now, np.concatenate(held)) if held else None
            if stars is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(*stars)), pa.array(np.minimum(*stars))], ["a", "b"])

        for batch in batches:
            prefix, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("prefix", "fp"))
            edge = np.flatnonzero(np.diff(prefix)) + 1
            for part, first in zip(np.split(fp, edge), [0, *edge], strict=True):
                if not len(part):
                    continue
                if prefix[first] != now:
                    yield from close()
                    held, now = [], int(prefix[first])
                held.append(part.astype(np.int64))
        yield from close()

    ship(spark)
    # As many links as fingerprints at most.
    return dealt.mapInArrow(run, "a long, b long").distinct().coalesce(-(-n // FILE_ROWS) or 1)


#: Links that a file of a round holds about.
FILE_ROWS = 1 << 20


def connected(edges: DataFrame) -> DataFrame:
    """Stars (node, root): every node of the graph of links (a > b) but the
    smallest of its component, which is the root.

    Each round writes its links to the shared folder and deletes the round
    before; it ends when a round changes nothing.
    """
    now = cut(edges.select("a", "b"), "links")
    mark = None
    while True:
        count = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (count.n, count.h) == mark or not count.n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (count.n, count.h)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        # A round's links are about as many as the last one's: few rows, few files.
        after = cut(small.distinct().coalesce(-(-count.n // FILE_ROWS)), "links")
        drop_cut(now)
        now = after


#: Copies of what is known of a component, so that its fingerprints meet it in as
#: many tasks.
SALT = 32


def _components(own: DataFrame, radius: int, value: str) -> DataFrame:
    """fp and the least ``value`` of its component; ``own`` has a row per distinct
    fp. Fingerprints without a link keep their own; the others' roots meet them
    salted, as one component may hold a third of all fingerprints."""
    with temporary(own.sparkSession) as keep:
        stars = connected(links(own.select("fp"), radius))
        ends = stars.select(F.col("node").alias("fp"), "root").unionByName(stars.select(F.col("root").alias("fp"), "root").distinct())
        linked = keep(cut(own.join(ends, "fp", "left").select("fp", value, "root"), "components"))
    some = linked.filter("root IS NOT NULL")
    least = some.groupBy("root").agg(F.min(value).alias(value)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = some.select("fp", "root", F.pmod(F.xxhash64("fp"), F.lit(SALT)).cast("int").alias("_salt"))
    return salted.join(least, ["root", "_salt"]).select("fp", value).unionByName(linked.filter("root IS NULL").select("fp", value))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id: the smallest doc_id that
    links of at most ``radius`` differing bits reach."""
    rows = cut(fingerprints(docs, shingle, seed), "fingerprints")
    of = _components(rows.groupBy("fp").agg(F.min("doc_id").alias("component_id")), radius, "component_id")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: of each component
    the one with the smallest doc_id, then text hash; a null id comes last, and
    of fully repeated rows one stays."""
    rows = cut(fingerprints(docs, shingle, seed, "_tie"), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_tie")
    of = _components(rows.groupBy("fp").agg(F.min(place).alias("least")), radius, "least")
    # Each component's least, by the fingerprints that have it.
    stay = of.select(F.col("least.doc_id").alias("_doc"), F.col("least._tie").alias("_of")).distinct()
    own = packed(docs).withColumn("_tie", F.xxhash64("text"))
    met = own.join(stay, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_tie") == F.col("_of")))
    return unpacked(met.dropDuplicates(["_doc", "_of"]), docs)
