"""Exact top-k inner products by MaxScore over sharded postings.

A vector's components are its terms. A shard keeps a posting list for each
term, with the least and the largest component in it. For a query the lists are
ordered by how far their contributions can spread; a suffix of them whose
bounds together can't lift a vector over the threshold is non-essential. The
essential lists are traversed for all vectors, and the others are probed one by
one only for those whose bound still competes. Shards are merged by rank.

Vectors come in shards and queries in blocks, both of bounded size. First each
query searches one shard, and each shard tells the bounds of its lists. The k-th
score found is the threshold that the query begins with elsewhere, and it only
goes to shards whose bounds together reach it; vectors only go to blocks that ask
for their shard.

Defined results: vectors that are null, empty or hold a null or a component that
is not finite take no part, nor do rows without an id; a repeated row is a
candidate as often as it occurs, and a query once; of vectors of different
lengths the components that both have count; all rows with the query's id are
its own; an empty table gives no rows. Components are clamped to the range of a
long, and so are scores, which are whole numbers of any size until then. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import cut, ship

#: Vectors of a shard and queries of a block.
SHARD_ROWS, BLOCK_ROWS = 8192, 2048
#: Bytes of all shards' bounds up to which they are broadcast; beyond it every
#: shard is asked, with the threshold alone.
BOUND_BYTES = 32 << 20
#: Largest whole number up to which sums of doubles are exact.
_EXACT = 1 << 53
#: Queries that traverse their essential lists together, and the share of vectors
#: that compete below which they are probed one by one.
GROUP, PROBE = 64, 0.05


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component as long."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    good = (
        F.col("embedding").isNotNull()
        & F.col("vec_id").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    )
    return vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(vectors: list[np.ndarray]) -> np.ndarray:
    """Terms by vectors; a shorter vector has no postings for the other terms."""
    width = max(len(v) for v in vectors)
    out = np.zeros((width, len(vectors)), np.int64)
    for i, v in enumerate(vectors):
        out[: len(v), i] = v
    return out


_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class Shard:
    """Postings of up to SHARD_ROWS vectors."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        order = np.argsort(ids, kind="stable")  # ties go to the smaller id
        self.ids = ids[order]
        self.lists = _matrix([vectors[i] for i in order])
        self.low, self.high = self.lists.min(1), self.lists.max(1)
        # Whole numbers in doubles, exact up to _EXACT: by term, and by vector to probe.
        self.exact = self.lists.astype(float)
        self.vectors = np.ascontiguousarray(self.exact.T)

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """(score, id) of the k best vectors but those with id ``own``; of those
        below ``floor`` some may be left out."""
        return self.search_all([query], [own], k, [floor])[0]

    def search_all(self, queries: list[np.ndarray], owns: list[int], k: int, floors: list[int | None]) -> list[list[tuple[int, int]]]:
        out = []
        for i in range(0, len(queries), GROUP):
            out += self._search(queries[i : i + GROUP], np.array(owns[i : i + GROUP], np.int64), k, floors[i : i + GROUP])
        return out

    def _search(self, queries: list[np.ndarray], owns: np.ndarray, k: int, floors: list[int | None]) -> list[list[tuple[int, int]]]:
        """A group of queries: each has its own essential terms and threshold."""
        terms, n = self.exact.shape
        q = np.zeros((len(queries), terms))
        for i, v in enumerate(queries):
            q[i, : min(terms, len(v))] = v[:terms]
        beyond = np.abs(q) @ np.maximum(np.abs(self.low.astype(float)), np.abs(self.high.astype(float))) >= _EXACT
        q[beyond] = 0
        first, last = np.searchsorted(self.ids, owns, "left"), np.searchsorted(self.ids, owns, "right")
        least, most = np.minimum(q * self.low, q * self.high), np.maximum(q * self.low, q * self.high)
        order = np.argsort(least - most, axis=1, kind="stable")
        place = np.argsort(order, axis=1, kind="stable")
        least, most = np.take_along_axis(least, order, 1), np.take_along_axis(most, order, 1)
        rest = np.append(np.cumsum(most[:, ::-1], 1)[:, ::-1], np.zeros((len(q), 1)), 1)  # most that the terms from here on add
        tail = np.append(np.cumsum(least[:, ::-1], 1)[:, ::-1], np.zeros((len(q), 1)), 1)  # and least

        def without_own(score: np.ndarray) -> np.ndarray:
            for i, (a, b) in enumerate(zip(first, last, strict=True)):
                score[i, a:b] = -np.inf
            return score

        def kth(score: np.ndarray) -> np.ndarray:
            return np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(q), -np.inf)

        # The first candidates' whole scores give a threshold to begin with.
        floor = np.array([-np.inf if f is None else float(f) for f in floors])
        threshold = np.maximum(floor, kth(without_own(q @ self.exact[:, : 4 * k])))
        # Non-essential: a vector least in all essential terms can't get there.
        enough = np.cumsum(least, 1) + rest[:, 1:] < threshold[:, None]
        done = np.where(enough.any(1), enough.argmax(1) + 1, terms)
        score = without_own((q * (place < done[:, None])) @ self.exact)
        row = np.arange(len(q))
        # The essential lists first, then half of the others where many still compete.
        for _ in range(2):
            threshold = np.maximum(threshold, kth(score) + tail[row, done])
            keep = score >= (threshold - rest[row, done])[:, None]
            if keep.mean() < PROBE or (done == terms).all():
                break
            after = done + -(-(terms - done) // 2)
            score += (q * ((place >= done[:, None]) & (place < after[:, None]))) @ self.exact
            done = after
        else:
            threshold = np.maximum(threshold, kth(score) + tail[row, done])
            keep = score >= (threshold - rest[row, done])[:, None]
        out = []
        for i in row:
            if beyond[i]:
                out.append(self._plain(queries[i], int(owns[i]), k))
                continue
            alive = np.flatnonzero(keep[i])
            alive = alive[(alive < first[i]) | (alive >= last[i])]
            whole = score[i, alive]
            if done[i] < terms and len(alive):
                whole = whole + self.vectors[alive] @ (q[i] * (place[i] >= done[i]))
            out.append(self._rank(alive, whole, k))
        return out

    def _rank(self, alive: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, int]]:
        best = np.lexsort((self.ids[alive], -score))[:k]
        return [(int(score[i]), int(self.ids[alive[i]])) for i in best]

    def _plain(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """For components too large for doubles: whole numbers of any size."""
        terms = min(len(query), len(self.lists))
        q = [int(x) for x in query[:terms]]
        found = []
        for i in np.flatnonzero(self.ids != own):
            score = sum(a * int(b) for a, b in zip(q, self.lists[:terms, i], strict=True))
            found.append((-max(_LEAST, min(_MOST, score)), int(self.ids[i])))
        return [(-s, i) for s, i in sorted(found)[:k]]


_FOUND = "_q long, query_id long, vec_id long, score long"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _widths(low: list, high: list) -> tuple[np.ndarray, np.ndarray]:
    """Shards by terms; a shard has no postings, so no score, for terms it lacks."""
    width = max(len(x) for x in low)
    out = np.zeros((2, len(low), width))
    for i, (a, b) in enumerate(zip(low, high, strict=True)):
        out[0, i, : len(a)], out[1, i, : len(b)] = a, b
    return out[0], out[1]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best vectors; both sides
    have vec_id and v (see ``quantised``)."""
    spark = vectors.sparkSession
    ship(spark)
    queries = queries.distinct().withColumn("_q", F.xxhash64("vec_id", "v"))
    sides = vectors.select(F.lit(0).alias("side"), F.size("v").alias("n")).unionByName(queries.select(F.lit(1).alias("side"), F.size("v").alias("n")))
    counted = {r.side: r for r in sides.groupBy("side").agg(F.count("*").alias("n"), F.max("n").alias("width")).collect()}
    if len(counted) < 2:
        return queries.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    shards, blocks = (max(1, -(-counted[i].n // size)) for i, size in ((0, SHARD_ROWS), (1, BLOCK_ROWS)))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)))
    home = F.pmod(F.xxhash64("_q", F.lit(2)), F.lit(shards))

    def begin(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame([], columns=[*_NAMES, "shard", "low", "high"])
        shard = Shard(mine.vec_id.to_numpy(), list(mine.v))
        out = [(None, None, None, None, mine.shard.iloc[0], shard.low, shard.high)]
        hits = shard.search_all(list(asked._v), asked._own.tolist(), k, [None] * len(asked))
        for q, own, best in zip(asked._q, asked._own, hits, strict=True):
            out += [(q, own, i, s, None, None, None) for s, i in best]
        # Whole numbers beside nulls would become doubles.
        return pd.DataFrame(out, columns=[*_NAMES, "shard", "low", "high"], dtype=object).astype(dict.fromkeys([*_NAMES, "shard"], "Int64"))

    asked = queries.select("_q", F.col("vec_id").alias("_own"), F.col("v").alias("_v"), home.alias("_shard"))
    first = dealt.groupBy("shard").cogroup(asked.groupBy("_shard"))
    first = cut(first.applyInPandas(begin, f"{_FOUND}, shard long, low array<long>, high array<long>"), "first")
    found = first.filter("shard IS NULL").select(*_NAMES)
    if shards > 1:
        found = found.unionByName(_others(dealt, queries, first, home, shards, blocks, max(r.width for r in counted.values()), k))
    best = Window.partitionBy("_q", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _others(dealt: DataFrame, queries: DataFrame, first: DataFrame, home, shards: int, blocks: int, width: int, k: int) -> DataFrame:
    """What the queries find in the shards that they haven't searched yet."""
    spark = dealt.sparkSession
    # A query has at most k scores here.
    scores = first.filter("shard IS NULL").groupBy("_q").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("_q", F.get("s", F.lit(k - 1)).alias("floor"))
    known = queries.select("_q", "v", home.alias("home")).join(scores, "_q", "left")
    if shards * width * 16 <= BOUND_BYTES:
        bounds = first.filter("shard IS NOT NULL").select("shard", "low", "high").orderBy("shard").toPandas()
        held = spark.sparkContext.broadcast((bounds.shard.to_numpy(np.int64), *_widths(list(bounds.low), list(bounds.high))))

        def reach(batches):
            ids, low, high = held.value
            for batch in batches:
                rows, to = [], []
                for i, (v, at, floor) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("v", "home", "floor")), strict=True)):
                    q = np.array(v[: low.shape[1]], float)
                    most = np.maximum(q * low[:, : len(q)], q * high[:, : len(q)]).sum(1)
                    # Doubles are off by a few units in the last place at most.
                    good = (ids != at) & (most + 1e-9 * np.abs(most) + 1 >= (-np.inf if floor is None else floor))
                    to.append(ids[good])
                    rows.append(np.full(int(good.sum()), i))
                take = pa.array(np.concatenate(rows) if rows else [], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("_q").take(take), batch.column("floor").take(take), pa.array(np.concatenate(to) if to else [], pa.int64())], ["_q", "floor", "shard"])

        asked = known.mapInArrow(reach, "_q long, floor long, shard long")
    else:
        every = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
        asked = known.select("_q", "floor", "home", F.explode(every).alias("shard")).filter("shard <> home").drop("home")
    asked = cut(asked.withColumn("block", F.pmod(F.xxhash64("_q", F.lit(3)), F.lit(blocks))), "asked")
    left = dealt.join(asked.select("shard", "block").distinct(), "shard")
    # Both sides come from one table, so their columns are named apart.
    own = queries.select("_q", F.col("vec_id").alias("_own"), F.col("v").alias("_v"))
    right = asked.select("_q", "floor", F.col("shard").alias("_shard"), F.col("block").alias("_block")).join(own, "_q")

    def search(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine):
            shard = Shard(mine.vec_id.to_numpy(), list(mine.v))
            floors = [None if pd.isna(f) else int(f) for f in asked.floor.astype("Int64")]
            for q, own, best in zip(asked._q, asked._own, shard.search_all(list(asked._v), asked._own.tolist(), k, floors), strict=True):
                out += [(q, own, i, s) for s, i in best]
        return pd.DataFrame(out, columns=_NAMES)

    return left.groupBy("shard", "block").cogroup(right.groupBy("_shard", "_block")).applyInPandas(search, _FOUND)
