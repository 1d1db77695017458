"""Groups of near-duplicate texts by an exact similarity join with token-combination prefixes.

The tokens of a text are its distinct runs of four words. All texts order their tokens alike, seldom ones first; the order is
by a count sketch of the whole corpus (2**BITS counters, so its size is bound whatever the corpus). Two texts of the asked
similarity share at least `o` tokens, and so at least `l` of the first n - o + l of either: the extended prefix.

Single tokens of the prefix are indexed where they are rare (a counter of at most `most`). Where a prefix reaches into
the frequent tokens, combinations of two of them are indexed: `l` is made larger, the frequent tokens fall into l - 1 classes by
hash, and as two similar texts share l of them, they share two of one class; so only pairs within a class are needed and their
number stays in proportion to the text. Pairs of texts that share too few signatures are dropped, the others verified exactly.

Groups of more than `most` texts with one signature, a number that no corpus changes, aren't expanded into pairs. They give a
star around a text drawn by hash, and the list of their texts. Once the components of all verified links are known, only groups whose
texts are in several components can still hide a link; their texts, and no others, are indexed again by `fine` signatures: a
new order by the counts among these texts alone, where what only one of them has is no token at all, and prefixes by the
sizes of both texts of a pair, which are much shorter. Texts that merely share a licence's words have none of these in their prefixes and
never meet. What is left of large groups in several components after that is texts that share most of what similar ones must
share; there texts of different components are compared, in blocks spread by salt. So no link between different
components is lost, and a large group of near-duplicates costs a few links a text. Texts that are equal are one text throughout.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.operators.components import components
from corpusweave.runtime import free, spread, written

#: log2 of the sketch's counters; the sketch that tasks get has a byte for each.
BITS = 24
#: Words in a run, and bytes that are kept of a run's hash.
RUN, BYTES = 4, 6
#: Orders by which the centres of stars are drawn.
ORDERS = 4
#: Shared signatures asked of two texts whose prefixes are all rare.
SHARED = 4
#: Odd multipliers (fixed values, primes).
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: The bits of a hash that are kept.
LOW = np.uint64((1 << 64) - (1 << 8 * (8 - BYTES)))
#: Tokens up to which a text takes part in the lowest level of combinations.
LOWEST = 90
#: Texts of a group that are compared pair by pair; a token counted no more often is rare.
MOST = 48
#: Ratio of the size classes of fine signatures, and tokens for each class by hash.
STEP, WIDTH = 1.15, 16
#: The side of a text in signatures that compare every text with every other.
BOTH = 2
#: Texts of a block where large groups are compared at last.
BLOCK = 512


class _Words(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * M2
    return h ^ (h >> np.uint64(29))


def shingles(words: list[str], known: _Words, run: int = RUN) -> np.ndarray:
    """Sorted hashes of the distinct runs of words: the upper BYTES of 64 bits, the others are zero."""
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(w) - run + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(run):
        h = h * M1 + w[j : j + n]
    return np.unique(mixed(h) & LOW)


def packed(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // BYTES, 8), np.uint8)
    out[:, 8 - BYTES :] = np.frombuffer(raw, np.uint8).reshape(-1, BYTES)
    return out.view("<u8").ravel()


def _log(counts: np.ndarray) -> np.ndarray:
    """A byte that grows with the count: exact below 32, eight steps an octave above."""
    return np.where(counts < 32, counts, np.minimum(255, 32 + np.floor(8 * np.log2(np.maximum(counts, 32) / 32)))).astype(np.uint8)


def sketch(tokens: DataFrame) -> np.ndarray:
    """Log counts by token hash, over all texts (tokens binary).

    A task adds up its own counters and sends the compressed ones; they are added up by range of counters, and what the
    driver gets is 2**BITS bytes whatever the corpus.
    """
    ranges = 1 << (BITS - 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.uint8)  # saturating; beyond 255 a task's tokens are all frequent
        for b in batches:
            if b.num_rows:
                at, n = np.unique(unpacked(b"".join(b.column(0).to_pylist())) >> np.uint64(64 - BITS), return_counts=True)
                counts[at] = np.minimum(counts[at] + n, 255)
        parts = [(r, counts[r << 16 : (r + 1) << 16]) for r in range(ranges)]
        parts = [(r, zlib.compress(x.tobytes(), 1)) for r, x in parts if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["range", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[r] = sums.get(r, 0) + np.frombuffer(zlib.decompress(x), np.uint8).astype(np.int64)
        for r, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([zlib.compress(_log(x).tobytes(), 1)], pa.binary())], names=["range", "logs"])

    parts = tokens.select("tokens").mapInArrow(count, "range int, counts binary").repartition("range")
    logs = np.zeros(1 << BITS, np.uint8)
    for r, x in parts.mapInArrow(add, "range int, logs binary").collect():  # 2**(BITS - 16) rows
        logs[r << 16 : (r + 1) << 16] = np.frombuffer(zlib.decompress(x), np.uint8)
    return logs


def signatures(h: np.ndarray, logs: np.ndarray, rare: int, t: Fraction) -> tuple[np.ndarray, bool]:
    """(signatures of a text with the tokens h, does its prefix reach into the frequent ones)."""
    n = len(h)
    if not n:
        return h, False  # fewer words than a run has
    c = logs[h >> np.uint64(64 - BITS)]
    order = np.lexsort((h, c))
    h, c = h[order], c[order]
    skip = n - -(-n * t.numerator // t.denominator)  # n - o
    k = min(n, skip + SHARED)
    if c[k - 1] <= rare:
        return h[:k][c[:k] > 1], False  # a counter of 1: no other text has it
    out, longest = [], k
    base, level = 0, 0
    while True:  # levels by the size of the larger text of a pair, each for sizes from base to twice it
        top = LOWEST if not level else 2 * base
        if n < t * base:
            break
        if n <= top:
            need = 2 if not level else max(2, int(Fraction(6, 10) * t * base))
            k = min(n, skip + need)
            longest = max(longest, k)
            f = np.sort(h[:k][c[:k] > rare])
            kind = (f >> np.uint64(17)) % np.uint64(need - 1)
            order = np.lexsort((f, kind))
            f, kind = f[order], kind[order]
            for step in range(1, len(f)):
                same = kind[step:] == kind[:-step]
                if not same.any():
                    break
                out.append(mixed(f[:-step][same] * M1 + mixed(f[step:][same] + np.uint64(level + 1))))
        base, level = top, level + 1
    single = h[:longest][(c[:longest] <= rare) & (c[:longest] > 1)]
    if n * t <= 1:  # a single token is all there is to share
        out.append(h)
    return np.unique(np.concatenate([single, *out])), True


def fine_signatures(h: np.ndarray, logs: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, sides) by the size classes of both texts of a pair: pairs of tokens of one class by hash, from the shortest prefixes.

    A signature is for one pair of size classes; the side says which of the two the text is of (0 the lower, 1 the upper, BOTH if they are
    the same), as only texts of unlike sides are compared by it.
    """
    n = len(h)
    if not n:
        return h, np.empty(0, np.int32)
    c = logs[h >> np.uint64(64 - BITS)]
    order = np.lexsort((h, c))
    h, c = h[order], c[order]
    share = t / (1 + t)
    mine = int(math.log(n) / math.log(STEP) + 1e-9)
    out = []
    for other in range(max(0, int(math.log(max(1.0, float(t * n))) / math.log(STEP)) - 1), int(math.log(float(n / t)) / math.log(STEP)) + 2):
        least = max(math.ceil(STEP**other - 1e-6), math.ceil(t * n))  # tokens of the other text
        if least > n / t or STEP ** (other + 1) + 1 < t * n:
            continue
        lower = math.ceil(STEP ** min(mine, other) - 1e-6)
        o = min(n, max(math.ceil(share * (n + least)), 1))
        kinds = max(1, lower // WIDTH)
        side = BOTH if mine == other else int(mine > other)
        salt = mixed(np.array([min(mine, other) * 4096 + max(mine, other) + 1], np.uint64) * M3)[0]
        if kinds + 1 > math.ceil(2 * share * lower):  # so small that one shared token may be all there is
            f = h[: n - o + 1]
            out.append((mixed(f * M1 + salt), side))
            continue
        k = min(n, n - o + kinds + 1)
        f = np.sort(h[:k][c[:k] > 1])  # a counter of 1: no other of these texts has it
        kind = (f >> np.uint64(19)) % np.uint64(kinds)
        order = np.lexsort((f, kind))
        f, kind = f[order], kind[order]
        for step in range(1, len(f)):
            same = kind[step:] == kind[:-step]
            if not same.any():
                break
            out.append((mixed(f[:-step][same] * M1 + mixed(f[step:][same] + salt)), side))
    if not out:
        return h[:0], np.empty(0, np.int32)
    found, at = np.unique(np.concatenate([x for x, _ in out]), return_index=True)
    return found, np.repeat([x for _, x in out], [len(x) for x, _ in out]).astype(np.int32)[at]


def _postings(logs, rare: int, t: Fraction, fine: bool):
    """(sig, doc, size, side): of each text its signatures; the lowest bit of size says that its prefix reaches into the frequent tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zlib.decompress(logs.value), np.uint8)
        for b in batches:
            sigs, ids, sizes, sides = [], [], [], []
            for kind, doc, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                h = unpacked(tokens)
                if fine:
                    (s, side), frequent = fine_signatures(h, table, t), True
                else:
                    s, frequent = signatures(h, table, rare, t)
                    side = np.full(len(s), BOTH, np.int32)
                sides.append(side)
                sigs.append(s ^ np.uint64(hash_kind(kind)))
                ids.append(np.full(len(s), doc, np.int64))
                sizes.append(np.full(len(s), 2 * len(h) + frequent, np.int32))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(sides))], names=["sig", "doc", "size", "side"])

    return run


@functools.lru_cache(maxsize=1024)
def hash_kind(kind: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(kind.encode())


def _pairs(most: int, t: Fraction):
    """Over postings sorted by signature: all pairs of groups of up to `most`; of larger ones the star around the first.

    A star's rows are marked `over`; they hold the first text (a) with every text (b) of the group, itself and those of no fitting size or side too.
    """
    ratio = float(t) * (1 - 1e-9)

    def emit(sig, doc, size, side, lo, hi):
        """All pairs of the groups [lo, hi), which all are small."""
        length = hi - lo
        for n in np.unique(length):
            if n < 2:
                continue
            first = lo[length == n]
            i, j = np.triu_indices(n, 1)
            a, b = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
            for s in range(0, len(a), 1_000_000):
                yield from pairs(sig, doc, size, side, a[s : s + 1_000_000], b[s : s + 1_000_000])

    def rows(sig, doc, size, side, a, b, over):
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[a]), pa.array(doc[b]), pa.array(size[a]), pa.array(size[b]), pa.array(sig[a] if over else np.zeros(len(a), np.int64), mask=np.full(len(a), not over)), pa.array(side[b])], names=["a", "b", "size_a", "size_b", "over", "side"]
        )

    def pairs(sig, doc, size, side, a, b):
        na, nb = size[a] >> 1, size[b] >> 1
        good = (np.minimum(na, nb) >= ratio * np.maximum(na, nb)) & (doc[a] != doc[b]) & ((side[a] == BOTH) | (side[a] != side[b]))
        a, b = a[good], b[good]
        if len(a):
            swap = doc[a] > doc[b]
            yield rows(sig, doc, size, side, np.where(swap, b, a), np.where(swap, a, b), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)]
        star = None  # (sig, doc, size, side) of a group that has more rows than `most`, whose rows stream by
        for b in batches:
            if not b.num_rows:
                continue
            sig, doc, size, side = (np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, b.columns))
            if star:
                n = int(np.searchsorted(sig != star[0], True)) if (sig != star[0]).any() else len(sig)
                if n:
                    s, d, z, w = (np.concatenate([[x], y[:n]]).astype(y.dtype) for x, y in zip(star, (sig, doc, size, side)))
                    yield rows(s, d, z, w, np.zeros(n, np.int64), np.arange(1, n + 1), True)
                    sig, doc, size, side = sig[n:], doc[n:], size[n:], side[n:]
                if not len(sig):
                    rest = [sig, doc, size, side]
                    continue
                star = None
            lo = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            hi = np.concatenate([lo[1:], [len(sig)]])
            if hi[-1] - lo[-1] <= most:  # the last group may go on in the next batch
                rest = [x[lo[-1] :] for x in (sig, doc, size, side)]
                lo, hi = lo[:-1], hi[:-1]
            else:
                rest = [x[:0] for x in (sig, doc, size, side)]
                star = (sig[lo[-1]], doc[lo[-1]], size[lo[-1]], side[lo[-1]])
            small = hi - lo <= most
            yield from emit(sig, doc, size, side, lo[small], hi[small])
            for x, y in zip(lo[~small], hi[~small]):
                if star and sig[x] == star[0] or side[x] == BOTH or (side[x:y] != side[x]).any():  # else there's no one to compare with
                    yield rows(sig, doc, size, side, np.full(y - x, x), np.arange(x, y), True)
        sig, doc, size, side = rest
        if len(sig):
            yield from emit(sig, doc, size, side, np.array([0]), np.array([len(sig)]))

    return run


def _verify(t: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
            keep, was, x = [], None, None
            for i, (p, q) in enumerate(zip(left, right)):
                if p != was:
                    was, x = p, unpacked(p)
                y = unpacked(q)
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                if common * t.denominator >= t.numerator * (len(x) + len(y) - common):
                    keep.append(i)
            got = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1)], names=["a", "b"])

    return run


def _links(pairs: DataFrame, tokens: DataFrame, t: Fraction) -> DataFrame:
    """Those of the pairs (a, b) whose texts have the similarity. Both joins read one shuffle of the tokens."""
    x, y = (tokens.select(F.col("doc").alias(k), F.col("tokens").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.select("a", "b").join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(_verify(t), "a long, b long")


def _round(tokens: DataFrame, most: int, t: Fraction, fine: bool) -> tuple[DataFrame, DataFrame]:
    """(candidates (a, b), texts of large groups as (sig, doc, size, side)) of one index over (kind, doc, tokens)."""
    logs = sketch(tokens)
    rare = int(_log(np.array([most]))[0])
    shared = tokens.sparkSession.sparkContext.broadcast(zlib.compress(logs.tobytes(), 1))
    postings = tokens.select("kind", "doc", "tokens").mapInArrow(_postings(shared, rare, t, fine), "sig long, doc long, size int, side int")
    # a few orders in all: then the stars of a large group of near-duplicates have few centres, and a text few links to verify
    ordered = postings.repartition("sig").sortWithinPartitions("sig", F.xxhash64("doc", F.pmod("sig", F.lit(ORDERS))), "doc")
    pairs = written(ordered.mapInArrow(_pairs(most, t), "a long, b long, size_a int, size_b int, over long, side int"), "dup-pairs")
    na, nb = F.shiftright("size_a", 1), F.shiftright("size_b", 1)
    need = F.ceil((na + nb) * t.numerator / F.lit(t.numerator + t.denominator))
    both_frequent = F.shiftleft(F.col("size_a"), 31).bitwiseAND(F.shiftleft(F.col("size_b"), 31)) != 0
    enough = F.when(both_frequent, 1).otherwise(F.least(F.lit(SHARED), need))
    fits = F.col("over").isNull() | ((F.col("a") != F.col("b")) & (F.least(na, nb) >= float(t) * (1 - 1e-9) * F.greatest(na, nb)))
    sized = pairs.where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (na + nb).alias("n"), enough.alias("enough"), F.col("over").isNotNull().alias("star"))
    # of a star's pairs some signatures may be in other stars, so they are verified whatever they share
    found = sized.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("enough").alias("enough"), F.max("star").alias("star")).where("star or shared >= enough")
    return found.select("a", "b"), pairs.where("over is not null").select(F.col("over").alias("sig"), F.col("b").alias("doc"), F.col("size_b").alias("size"), "side")


def _open(large: DataFrame, named: DataFrame) -> DataFrame:
    """(sig, doc, size, side, component) of the large groups whose texts are in several components and on both sides."""
    of = large.join(named.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    several = of.groupBy("sig").agg(F.min("component").alias("first"), F.max("component").alias("last"), F.min("side").alias("low"), F.max("side").alias("high")).where(f"first <> last and (low <> high or low = {BOTH})")
    return of.join(several.select("sig"), "sig", "left_semi").select("sig", "doc", "size", "side", "component")


def _across(large: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (a, b) of texts of fitting sizes and different components in one large group, without those of its main component alone.

    A group is cut into blocks of about BLOCK texts; a text meets block by block, so no key has more than a block's rows on one side.
    """
    sizes = large.groupBy("sig", "component").count().groupBy("sig").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.sum("count").alias("n"))
    large = large.join(sizes, "sig").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    out = large.where("component <> main").select("sig", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "doc", F.shiftright("size", 1).alias("s"), F.col("side").alias("z"), F.col("component").alias("c"))
    rest = large.select("sig", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"), F.col("doc").alias("other"), F.shiftright("size", 1).alias("size"), "side", "component")
    both = out.join(rest, ["sig", "block"]).where(f"c <> component and (side <> z or side = {BOTH})").where(F.least("s", "size") + 1e-6 >= float(t) * F.greatest("s", "size"))
    return both.select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct()


def groups(records: DataFrame, threshold: float = 0.6, least_words: int = 20, most: int = MOST) -> DataFrame:
    """(kind, id, class_id): the group of each record, named by the least id in it; unlike kinds are never in one group.

    records (kind string, id long, text string), (kind, id) unique. Words are what blanks separate; null texts and those of
    fewer than least_words words are left out. A record like no other is a group of its own. Repeated rows count once. most: texts
    with one signature that are compared pair by pair. It changes the work, not the result.
    """
    t = Fraction(str(threshold)).limit_denominator(1000)
    if not 0 < t <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    words = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    records = spread(records.select("kind", "id", "text").where("kind is not null and id is not null and text is not null")).where(words >= max(least_words, 1))
    # equal texts are one text, which goes by a number of its own
    digest = F.struct(F.xxhash64("kind", "text").alias("x"), F.xxhash64(F.lit(7), "text", "kind").alias("y"))
    every = written(records.select("kind", "id", digest.alias("digest")).distinct(), "dup-records")
    ones = every.groupBy("kind", "digest").agg(F.min("id").alias("one"))
    number = F.xxhash64("kind", F.col("one")).alias("doc")
    members = written(every.join(ones, ["kind", "digest"]).select("kind", "id", "one", number), "dup-members")
    free(every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in batches:
            tokens = pa.array([packed(shingles(x.split(), known)) for x in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), tokens], names=["kind", "doc", "tokens"])

    # what three passes need of the texts is made once
    texts = records.join(members.where("id = one").select("kind", "id", "doc").hint("merge"), ["kind", "id"]).select("kind", "doc", "text")
    tokens = written(texts.mapInArrow(run, "kind string, doc long, tokens binary"), "dup-tokens")

    found, large = _round(tokens, most, t, False)
    named = components(written(_links(found, tokens, t), "dup-links"))
    if not large.isEmpty():
        named = written(named, "dup-components")
        again = written(_open(large, named).select("doc").distinct(), "dup-open")
        if not again.isEmpty():
            several = written(tokens.join(again, "doc", "left_semi").select("kind", "doc", "tokens"), "dup-open-tokens")
            found, large = _round(several, most, t, True)
            named = components(written(_links(found, several, t), "dup-links"), named)
            if not large.isEmpty():
                named = written(named, "dup-components")
                large = written(_open(large, named), "dup-large")
                if not large.isEmpty():
                    named = components(written(_links(_across(large, t), several, t), "dup-links"), named)

    of = members.join(named.withColumnRenamed("node", "doc"), "doc", "left").select("kind", "id", F.coalesce("component", "doc").alias("component"))
    of = written(of, "dup-of")
    free(members, tokens)
    names = of.groupBy("kind", "component").agg(F.min("id").alias("class_id"))
    return of.join(names, ["kind", "component"]).select("kind", "id", "class_id")


def group_pairs(grouped: DataFrame) -> DataFrame:
    """(kind, id_a, id_b): each pair within a group; the result's form is fixed, so it grows with the groups' squares."""
    a = grouped.select("kind", "class_id", F.col("id").alias("id_a"))
    b = grouped.select("kind", "class_id", F.col("id").alias("id_b"))
    return a.join(b, ["kind", "class_id"]).where("id_a < id_b").select("kind", "id_a", "id_b")
