"""Near-duplicate documents: MinHash signatures in an LSH forest.

A document's set is its distinct word shingles. Documents with equal sets form one class, found by
an aggregate on a 128-bit digest. Class representatives go into several sorted signature orders
(trees). In each order, a region is a run of rows that share a prefix; its depth is the smallest
at which the run has at most `bucket` rows, so crowded regions are looked at deeper. Pairs of a
region that may reach the threshold are confirmed on the full sets, and links give components.
What is left of larger runs of equal keys is compared on the full sets without an estimate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, only_ids, range_parts, release, text_batches, tidy
from ..operators.components import connected_components

_M64 = (1 << 64) - 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return _mix(x)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Standard deviations by which an estimate from signatures may fall short of the threshold: by exact
#: binomial tails, a pair right at it is left out with a chance of 2e-8 to 5e-8.
DEVIATIONS = 6.0

_BYTES = _splitmix(256, 17)
_BASE = 0x9E3779B97F4A7C15 | 1
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=1)
def _short_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << 16)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of the whole text.

    A-Z are lower-cased; words are runs without U+0009 to U+000D and U+0020. With fewer words than
    width, all words are one shingle; without words, the set is empty.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    blank = np.ones(len(raw) + 2, dtype=bool)
    blank[1:-1] = _BLANK[raw]
    turn = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = turn[::2], turn[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = _short_powers() if len(raw) < 1 << 16 else _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * up[: len(raw)], out=total[1:])
    words = _mix((total[end] - total[start]) * down[start])
    n = max(1, len(words) - width + 1)
    size = min(width, len(words))
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return np.unique(_mix(out))


def signature(found: np.ndarray, hashes: int, seed: int) -> np.ndarray:
    """Minima of `hashes` random orders of the set, 32 bits each."""
    rnd = _splitmix(2 * hashes, seed)
    mul, add = (rnd[:hashes] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (rnd[hashes:] >> np.uint64(32)).astype(np.uint32)
    x, low = (found >> np.uint64(32)).astype(np.uint32), np.full(hashes, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(low, (mul[:, None] * x[None, k : k + 4096] + add[:, None]).min(axis=1), out=low)
    return low


def forest_pairs(tree: np.ndarray, key: np.ndarray, bits: np.ndarray, size: np.ndarray, comp: np.ndarray, window: int, num: int, den: int, adaptive: bool, deviations: float = DEVIATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (positions i < j) among rows sorted by tree and key.

    adaptive False: neighbours at distance up to window with a common prefix. True: a row's depth
    is the smallest at which its run of equal prefixes has at most window rows (else the full
    depth), and its partners are those of its run within window. Pairs of one component, pairs
    whose set sizes exclude the threshold, and pairs whose signatures agree so rarely that the
    threshold is over `deviations` standard deviations away are left out.
    """
    n, depth = key.shape
    same = (key[1:] == key[:-1]) & (tree[1:] == tree[:-1])[:, None]
    common = np.zeros(n, dtype=np.int64)
    common[1:] = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    run = np.cumsum(common < 1)
    if adaptive:
        level, done = np.full(n, depth), np.zeros(n, dtype=bool)
        for d in range(1, depth + 1):
            ids = np.cumsum(common < d) - 1
            fits = (np.bincount(ids)[ids] <= window) & ~done
            level[fits], done = d, done | fits
        run = np.full(n, -1, dtype=np.int64)
        for d in range(1, depth + 1):
            ids = np.cumsum(common < d)
            run[level == d] = ids[level == d] * (depth + 1) + d
    share = num / den
    least = share - deviations * np.sqrt(share * (1 - share) / bits.shape[1])
    left, right = [], []
    for gap in range(1, min(window, n - 1) + 1):
        i = np.flatnonzero((run[gap:] == run[:-gap]) & (comp[gap:] != comp[:-gap]))
        if not len(i):
            continue
        j = i + gap
        lo, hi = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        ok = den * lo >= num * hi
        i, j = i[ok], j[ok]
        ok = (bits[i] == bits[j]).mean(axis=1) >= least
        left.append(i[ok])
        right.append(j[ok])
    if not left:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(left), np.concatenate(right)


def meetings(held: list[tuple[int, int]], window: int) -> list[tuple[int, int, int]]:
    """(part, side, border): which ends of the ranges meet at each border, from (part, rows up to window) in order.

    Border k lies before the k-th range. Ranges on either side (0 before it, 1 from it) are taken
    until they hold a window of rows.
    """
    out = []
    for border in range(1, len(held)):
        for side, order in ((0, range(border - 1, -1, -1)), (1, range(border, len(held)))):
            got = 0
            for k in order:
                if got >= window:
                    break
                out.append((held[k][0], side, border))
                got += held[k][1]
    return out


def _unpack(pdf: pd.DataFrame, hashes: int) -> tuple[np.ndarray, ...]:
    n = len(pdf)
    key = np.frombuffer(b"".join(pdf["key"]), dtype=">u4").reshape(n, -1).astype(np.uint32)
    bits = np.frombuffer(b"".join(pdf["bits"]), dtype=np.uint8).reshape(n, hashes)
    return pdf["tree"].to_numpy(), key, bits, pdf["n"].to_numpy(), pdf["comp"].to_numpy()


class NearDuplicates:
    """Components of documents whose shingle sets have a Jaccard similarity of num/den or more.

    width: words of a shingle; trees and depth: sorted orders and hash values of each;
    bucket: rows up to which a region is not looked at deeper; compared: hash values, 8 bits of
    each, by which a pair's similarity is estimated before texts are fetched; salted: rows of a
    large run that are compared in one place; shingles: of these rows, beyond which they are dealt out.
    """

    def __init__(self, width: int = 5, num: int = 80, den: int = 100, trees: int = 16, depth: int = 14, bucket: int = 32, compared: int = 96, seed: int = 1, salted: int = 1024, shingles: int = 4 << 20):
        self.width, self.num, self.den, self.trees, self.depth, self.bucket, self.compared, self.seed, self.salted, self.shingles = width, num, den, trees, depth, bucket, min(compared, trees * depth), seed, salted, shingles

    def sketch(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        width, hashes, compared, seed = self.width, self.trees * self.depth, self.compared, self.seed

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                sizes, digests, sigs, bits = [], [], [], []
                for text in pdf["text"]:
                    found = shingle_set(text, width)
                    sizes.append(len(found))
                    if len(found):
                        low = signature(found, hashes, seed)
                        digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                        sigs.append(low.astype(">u4").tobytes())
                        bits.append(low[:compared].astype(np.uint8).tobytes())
                    else:
                        digests.append(None)
                        sigs.append(None)
                        bits.append(None)
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": pd.array(sizes, dtype="int64"), "digest": digests, "sig": sigs, "bits": bits})

        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        return source.mapInPandas(tidy(run), "doc_id long, n long, digest binary, sig binary, bits binary")

    def _rows(self, classes: DataFrame, trees: int) -> DataFrame:
        step = 4 * self.depth
        return classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).select(
            "tree", F.expr(f"substring(sig, tree * {step} + 1, {step})").alias("key"), "bits", "n", "doc_id", "comp"
        )

    def candidates(self, classes: DataFrame, count: int, trees: int, adaptive: bool) -> DataFrame:
        """Pairs (a, b) of class ids. Rows near the border of two ranges are compared in a second step,
        for which a range shorter than the window is filled up from those beyond it."""
        window, num, den, hashes = (self.bucket if adaptive else 1), self.num, self.den, self.compared
        rows = self._rows(classes, trees)
        parts = range_parts(rows.sparkSession, count * trees)
        dealt = rows.repartitionByRange(parts, "tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id")
        fields = "a long, b long, part int, side int, tree int, key binary, bits binary, n long, comp long"

        def pairs(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            return forest_pairs(*_unpack(pdf, hashes), window, num, den, adaptive)

        def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = [x for x in batches if len(x)]
            if not got:
                return
            pdf = pd.concat(got, ignore_index=True)
            i, j = pairs(pdf)
            ids = pdf["doc_id"].to_numpy()
            yield pd.DataFrame({"a": ids[i], "b": ids[j]}).assign(part=None, side=None, tree=None, key=None, bits=None, n=None, comp=None)
            part = TaskContext.get().partitionId()
            for rows, side in ((pdf.head(window), 1), (pdf.tail(window), 0)):
                yield pd.DataFrame({"a": rows["doc_id"], "b": None, "part": part, "side": side, "tree": rows["tree"], "key": rows["key"], "bits": rows["bits"], "n": rows["n"], "comp": rows["comp"]})

        found = materialize(dealt.mapInPandas(tidy(within), fields))

        def across(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["tree", "key", "side", "a"], ignore_index=True)
            i, j = pairs(pdf)
            side, ids = pdf["side"].to_numpy(), pdf["a"].to_numpy()
            i, j = i[side[i] != side[j]], j[side[i] != side[j]]
            return pd.DataFrame({"a": ids[i], "b": ids[j]})

        # A row per range, of which there are at most as many as shuffle partitions.
        edges = found.where("part IS NOT NULL")
        held = [(r["part"], r["rows"]) for r in edges.where("side = 1").groupBy("part").agg(F.count("*").alias("rows")).orderBy("part").collect()]
        near = rows.sparkSession.createDataFrame(meetings(held, window), "part int, side int, border int")
        seams = edges.join(F.broadcast(near), ["part", "side"]).groupBy("border").applyInPandas(across, "a long, b long")
        every = found.where("part IS NULL").select("a", "b").unionByName(seams)
        out = materialize(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        release(found)
        return out

    def confirmed(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Those pairs whose full sets reach the threshold."""
        ids = pairs.select(F.col("a").alias("doc_id")).distinct().unionByName(pairs.select(F.col("b").alias("doc_id")).distinct()).distinct()
        needed = materialize(only_ids(texts, ids, "doc_id"))
        width, num, den = self.width, self.num, self.den

        def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                known: dict[str, np.ndarray] = {}
                keep = np.zeros(len(pdf), dtype=bool)
                for k, (x, y) in enumerate(zip(pdf["ta"], pdf["tb"], strict=True)):
                    for text in (x, y):
                        if text not in known:
                            known[text] = shingle_set(text, width)
                    both = len(np.intersect1d(known[x], known[y], assume_unique=True))
                    keep[k] = both > 0 and den * both >= num * (len(known[x]) + len(known[y]) - both)
                yield pdf.loc[keep, ["a", "b"]]

        first = pairs.join(needed.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
        both = first.join(needed.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        out = materialize(both.select("a", "b", "ta", "tb").mapInPandas(tidy(check), "a long, b long"))
        release(needed)
        return out

    def stragglers(self, classes: DataFrame, texts: DataFrame) -> DataFrame:
        """Links left over in runs of equal full keys that are larger than a bucket.

        There a row has met its neighbours only. Rows outside the run's largest component are
        compared on their full sets with all rows of other components, in groups of so many rows
        of both sides that a task can hold; a run that is one component costs nothing.
        """
        run, width, num, den = ["tree", "key"], self.width, self.num, self.den
        rows = self._rows(classes, self.trees).drop("bits")
        large = rows.groupBy(*run).agg(F.count("*").alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(f"rows > {self.bucket} AND lo <> hi")
        mixed = rows.join(large.select(*run), run)
        main = mixed.groupBy(*run, "comp").count().groupBy(*run).agg(F.max(F.struct("count", F.col("comp").alias("id")))["id"].alias("main"))
        mixed = mixed.join(main, run).withColumn("rare", F.col("comp") != F.col("main"))
        groups = lambda on: F.ceil(F.greatest(F.count(F.when(on, 1)) / self.salted, F.sum(F.when(on, F.col("n"))) / self.shingles)).cast("int")
        mixed = materialize(mixed.join(mixed.groupBy(*run).agg(groups(F.lit(True)).alias("salts"), groups(F.col("rare")).alias("rare_salts")), run).drop("main"))
        needed = materialize(only_ids(texts, mixed.select("doc_id").distinct(), "doc_id"))
        own = lambda salts: F.pmod(F.xxhash64("doc_id"), F.col(salts)).cast("int")
        every = lambda salts: F.explode(F.sequence(F.lit(0), F.col(salts) - 1))
        few = mixed.where("rare").withColumn("x", own("rare_salts")).withColumn("y", every("salts"))
        many = mixed.withColumn("y", own("salts")).withColumn("x", every("rare_salts"))
        place, shown = [*run, "x", "y"], ["rare", "doc_id", "comp"]
        both_sides = few.select(*place, *shown).unionByName(many.select(*place, F.lit(False).alias("rare"), *shown[1:])).join(needed, "doc_id")

        def check(pdf: pd.DataFrame) -> pd.DataFrame:
            few, many = pdf[pdf["rare"]], pdf[~pdf["rare"]]
            a, b = [], []
            if len(few) and len(many):
                sets = [shingle_set(text, width) for text in many["text"]]
                sizes, values = np.array([len(x) for x in sets]), np.concatenate(sets)
                starts, ids, comps = np.cumsum(sizes) - sizes, many["doc_id"].to_numpy(), many["comp"].to_numpy()
                for one, comp, text in zip(few["doc_id"], few["comp"], few["text"], strict=True):
                    found = shingle_set(text, width)
                    near = (comps != comp) & (den * np.minimum(sizes, len(found)) >= num * np.maximum(sizes, len(found))) & (sizes > 0)
                    if not near.any():
                        continue
                    hits = np.zeros(len(values) + 1, dtype=np.int64)
                    np.cumsum(found[np.minimum(np.searchsorted(found, values), len(found) - 1)] == values, out=hits[1:])
                    both = hits[starts + sizes] - hits[starts]
                    near &= (both > 0) & (den * both >= num * (sizes + len(found) - both))
                    b.append(ids[near])
                    a.append(np.full(len(b[-1]), one, dtype=np.int64))
            none = [np.zeros(0, dtype=np.int64)]
            return pd.DataFrame({"a": np.concatenate(a or none), "b": np.concatenate(b or none)})

        links = both_sides.groupBy(*place).applyInPandas(check, "a long, b long")
        out = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        release(mixed)
        release(needed)
        return out

    def transform(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_shingles, component_id, kept), one row per input row; other columns don't matter.

        component_id is the smallest doc_id reachable over links. Documents with an empty set
        (null, empty or blank text) have no links and keep themselves. Rows that repeat a doc_id
        are one node of the graph. A null doc_id never names a component, unless nothing else
        has its text. An empty table gives an empty result.
        """
        text_batches(docs.sparkSession)
        sketches = materialize(self.sketch(docs, id_col, text_col))
        some = sketches.where("digest IS NOT NULL AND doc_id IS NOT NULL")
        classes = materialize(some.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bits").alias("bits")))
        count = classes.count()
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

        alone = classes.withColumn("comp", F.col("doc_id"))
        first = self.candidates(alone, count, min(4, self.trees), adaptive=False)
        links = self.confirmed(first, texts)
        release(first)
        labels = connected_components(links)

        grouped = self._labelled(classes, labels)
        second = self.candidates(grouped, count, self.trees, adaptive=True)
        more = self.confirmed(second, texts)
        release(second)
        links = links.unionByName(more)
        if not more.isEmpty():
            labels = connected_components(links)
        rest = self.stragglers(self._labelled(classes, labels), texts)
        if not rest.isEmpty():
            labels = connected_components(links.unionByName(rest))
        named = self._labelled(classes, labels).select("digest", "comp")
        out = sketches.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left")
        out = out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))
        return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

    @staticmethod
    def _labelled(classes: DataFrame, labels: DataFrame) -> DataFrame:
        joined = classes.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        return joined.withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
