"""Near-duplicate groups by b-bit MinHash.

Each text's set of word shingles gives 384 minima.  The first 72 make 24 bands of three: texts
with a Jaccard similarity of 0.8 miss each other in all bands with a chance below 4e-8.
Two low bits of every minimum are packed into 768 bits; inside a band bucket the similarity
is estimated from equal bits, corrected for bits that agree by chance, and pairs whose
estimate lies more than 5 standard errors below the threshold (a chance below 3e-7) are left.
What remains is confirmed on the full sets.

Texts with equal sets are one class (its smallest doc_id stands for it).  Only links that can
join different components are looked for.  The first bands give links of every member of a
bucket with its most typical member; what they confirm is joined, and of the next bands only
buckets take part whose members are still of several components.  Then every text outside a
bucket's largest component is linked with its likeliest partners.  At last all pairs of a bucket
that lie in different components are compared where the bucket is, on the full sets that the
members of such pairs (by their estimate) bring along; a pair that meets in several bands is taken in the first of them, and only
links that join two components leave the task, fewer than members.  So a group of thousands of
near copies, and one of texts just below the threshold, gives about one row per member, and no
link between different texts is lost.

Components only grow, so the members of the buckets still to be looked at are taken from those
found before.  Texts, sets and signatures go through a shuffle only where a pair needs them: a bit
map of what is wanted tells rows to leave out before the shuffle (``partnered``).

Null or empty texts have an empty set and are linked with nothing; texts shorter than a
shingle have their whole word sequence as the one shingle; rows of one doc_id count as one
document; rows with a null doc_id are linked with nothing (component null, kept); an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.llm.common import U64, Words, bit_maps, buckets_for, column, first_of_equal, in_maps, is_in, mix, prefix_hash, remembered, span_hash, stored, text_chunks
from stockspark.llm.components import connected_components

BANDS, ROWS, BITS = 24, 3, 2
#: Minima per text: the first BANDS * ROWS make the bands, all of them the estimate.
HASHES = 384
#: Standard errors that an estimate may lie below the threshold.
SLACK = 5
#: Text bytes whose shingles are hashed together (they fit a core's cache).
SET_BYTES = 1 << 20
#: Members of a hot centre that one verification bucket takes.
FAN = 256
#: Partners of a text that are tried before all that are still apart.
LIKELIEST = 2
#: Bands of each linking step.
STEPS = ((0, 4), (4, BANDS))
#: Rows (24 bytes each at most) that are broadcast to find their partners; beyond that those with a partner are shuffled.
BROADCAST_ROWS = 1 << 16
#: Bits of a bit map per wanted row (about one unwanted row in eight is taken along), and bits at most (32 MB).
WANTED_BITS, MOST_BITS = 8, 1 << 28
_MULTIPLY = np.random.default_rng(97).integers(1, 1 << 63, HASHES, dtype=np.uint64) * U64(2) + U64(1)
_ODD = U64(0x5555555555555555)
_PRINTS = (U64(0), U64(0xC2B2AE3D27D4EB4F))


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, bounds per text); A-Z count as a-z."""
    w = Words(texts, lower=True)
    first = w.first
    size = np.where(w.count >= words, w.count - words + 1, np.minimum(w.count, 1))
    owner = np.repeat(np.arange(len(size)), size)
    start = first[:-1][owner] + np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
    end = np.minimum(start + words, first[1:][owner])
    prefix = prefix_hash(w.hash)
    shingle = span_hash(prefix, start, end)
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    once = first_of_equal(owner, shingle)
    owner, shingle = owner[once], shingle[once]
    return shingle, np.searchsorted(owner, np.arange(len(size) + 1))


def signatures(shingle: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, HASHES) minima; every text must have a shingle."""
    out = np.empty((len(bounds) - 1, HASHES), dtype=np.uint64)
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat(shingle * _MULTIPLY[i], bounds[:-1])
    return out


def packed_bits(minima: np.ndarray) -> np.ndarray:
    """(texts, 3) words that hold two low bits (above the multiplier's weakest ones) of every minimum."""
    low = (minima >> U64(20)) & U64((1 << BITS) - 1)
    out = np.zeros((len(minima), -(-HASHES * BITS // 64)), dtype=np.uint64)
    for i in range(HASHES):
        out[:, i * BITS // 64] |= low[:, i] << U64(i * BITS % 64)
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed bits, corrected for values that agree by chance."""
    x = a ^ b
    differ = np.bitwise_count((x | (x >> U64(1))) & _ODD).sum(axis=-1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return ((HASHES - differ) / HASHES - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    chance = 1 / (1 << BITS)
    p = threshold + (1 - threshold) * chance
    return threshold - SLACK * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def _typical(bits: np.ndarray) -> int:
    """The member that agrees with the others in most positions."""
    score = np.zeros(len(bits), dtype=np.int64)
    for i in range(HASHES):
        value = (bits[:, i * BITS // 64] >> U64(i * BITS % 64)) & U64(3)
        score += np.bincount(value.astype(np.int64), minlength=4)[value.astype(np.int64)]
    return int(score.argmax())


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept (doc_id is its component's smallest), class_id, n_links.

    class_id stands for the documents with the same set; n_links counts the confirmed links
    of the class that were needed to build the component.
    """
    rows = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), column(docs, text).alias("text"))
    buckets = buckets_for(rows)
    floor = least_estimate(threshold)

    def sets(batches):
        remembered("near dedup")  # what other operators learned in this worker is given up
        for part, texts in text_chunks(batches, limit=SET_BYTES):
            shingle, bounds = shingle_sets(texts, words)
            prints = []
            for odd in _PRINTS:  # 128 bits of the set, by two sums
                total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(shingle ^ odd))))
                prints.append(mix(total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
            size = np.diff(bounds)
            use = np.flatnonzero(size)
            keys, bits = [None] * len(size), [None] * len(size)
            if len(use):
                minima = signatures(shingle, np.append(bounds[:-1][use], len(shingle)))
                band = np.stack([mix(mix(minima[:, b * ROWS : (b + 1) * ROWS] @ np.array([3, 5, 7], dtype=np.uint64)) + U64(b)) for b in range(BANDS)], axis=1)
                for i, k, x in zip(use.tolist(), band.view(np.int64), packed_bits(minima)):
                    keys[i], bits[i] = k, x.tobytes()
            yield pa.record_batch([part.column("doc_id"), pa.array(size, pa.int64()), *(pa.array(x, pa.int64(), mask=size == 0) for x in prints), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["doc_id", "n_shingles", "print", "print_two", "keys", "bits"])

    def _bits(table: pa.Table) -> tuple[np.ndarray, ...]:
        key, doc = table.column("key").to_numpy(), table.column("doc").to_numpy()
        order = np.lexsort((doc, key))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype=np.uint64).reshape(len(key), -1)
        return key[order], doc[order], bits[order], table.column("component").to_numpy()[order], order

    def stars(table: pa.Table) -> pa.Table:
        """(typical member, member, estimate) of every bucket, for members of other components than the typical one's."""
        key, doc, bits, component, _ = _bits(table)
        start = first_of_equal(key)
        one, two, like = [], [], []
        for s, e in zip(start.tolist(), [*start[1:].tolist(), len(key)]):
            c = s + _typical(bits[s:e]) if e - s > 2 else s
            value = estimate(bits[s:e], bits[c])
            hit = np.flatnonzero((value >= floor) & (component[s:e] != component[c]))
            one.append(np.full(len(hit), doc[c]))
            two.append(doc[s + hit])
            like.append(value[hit])
        out = _pairs(one, two)
        return out.append_column("like", pa.array(np.concatenate(like) if like else np.zeros(0), pa.float64()))

    def likeliest(table: pa.Table) -> pa.Table:
        """The LIKELIEST pairs with other components, of every text outside the largest component, whose estimate may reach the threshold."""
        key, doc, bits, component, _ = _bits(table)
        start = first_of_equal(key)
        one, two = [], []
        for s, e in zip(start.tolist(), [*start[1:].tolist(), len(key)]):
            _, inverse, count = np.unique(component[s:e], return_inverse=True, return_counts=True)
            for i in (s + np.flatnonzero(inverse != count.argmax())).tolist():
                at = s + np.flatnonzero(component[s:e] != component[i])
                value = estimate(bits[at], bits[i])
                at, value = at[value >= floor], value[value >= floor]
                if len(at) > LIKELIEST:
                    at = at[np.argpartition(-value, LIKELIEST)[:LIKELIEST]]
                one.append(np.full(len(at), doc[i]))
                two.append(doc[at])
        return _pairs(one, two)

    def _apart(i, s, e, key, doc, bits, now, was, largest, bands) -> tuple[np.ndarray, np.ndarray]:
        """Members of a bucket that i has to be compared with, and their estimates."""
        # between two of the smaller components a pair is taken once
        at = np.flatnonzero((now != now[i]) & (was != was[i]) & ((was == largest) | (doc[s:e] > doc[s + i])))
        value = estimate(bits[s + at], bits[s + i])
        at, value = at[value >= floor], value[value >= floor]
        if len(at):  # the first band that the two share gives the pair
            same = bands[s + at] == bands[s + i]
            first = bands[s + i][same.argmax(axis=1)] == key[s]
            at, value = at[first], value[first]
        return at, value

    def _bands(table: pa.Table, order: np.ndarray) -> np.ndarray:
        return table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order]

    def unsettled(table: pa.Table) -> pa.Table:
        """The members that ``joining`` has to compare; main: of the bucket's largest component."""
        key, doc, bits, component, order = _bits(table)
        bands = _bands(table, order)
        start = first_of_equal(key)
        take, main = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
        for s, e in zip(start.tolist(), [*start[1:].tolist(), len(key)]):
            _, was, count = np.unique(component[s:e], return_inverse=True, return_counts=True)
            largest = count.argmax()
            main[s:e] = was == largest
            for i in np.flatnonzero(was != largest).tolist():
                at, _ = _apart(i, s, e, key, doc, bits, was, was, largest, bands)
                if len(at):
                    take[s + i] = True
                    take[s + at] = True
        return pa.table([pa.array(x[take]) for x in (key, doc, component, main)], names=["key", "doc", "component", "main"])

    def joining(table: pa.Table) -> pa.Table:
        """Links of different components, confirmed on the full sets; components joined in a bucket count as one for its further pairs."""
        key, doc, bits, component, order = _bits(table)
        bands = _bands(table, order)
        main = table.column("main").to_numpy()[order]
        cells = table.column("shingles").combine_chunks()
        start = first_of_equal(key)
        one, two = [], []
        for s, e in zip(start.tolist(), [*start[1:].tolist(), len(key)]):
            sets = [np.frombuffer(cells[i].as_py(), dtype=np.uint64) for i in order[s:e].tolist()]
            size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            _, was = np.unique(component[s:e], return_inverse=True)
            now, largest = was.copy(), was[main[s:e].argmax()] if main[s:e].any() else -1
            for i in np.flatnonzero(was != largest).tolist():
                at, value = _apart(i, s, e, key, doc, bits, now, was, largest, bands)
                at = at[np.argsort(-value, kind="stable")]
                while len(at):
                    part, at = at[:FAN], at[FAN:]
                    hits = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(is_in(np.concatenate([sets[j] for j in part]), sets[i]))))
                    ends = np.cumsum(size[part])
                    both = hits[ends] - hits[ends - size[part]]
                    for j in part[(both > 0) & (both >= threshold * (size[i] + size[part] - both) - 1e-9)].tolist():
                        if now[j] != now[i]:
                            one.append(doc[s + i : s + i + 1])
                            two.append(doc[s + j : s + j + 1])
                            now[now == now[j]] = now[i]
                    at = at[now[at] != now[i]]
        return _pairs(one, two)

    def shingles(batches):
        for part, texts in text_chunks(batches, limit=SET_BYTES):
            shingle, bounds = shingle_sets(texts, words)
            yield pa.record_batch([part.column("doc"), pa.array([shingle[s:e].tobytes() for s, e in zip(bounds, bounds[1:])], pa.binary())], names=["doc", "shingles"])

    def verify(table: pa.Table) -> pa.Table:
        """Confirm (centre, doc) rows on full sets; a centre's own row has doc = centre."""
        centre, doc = table.column("centre").to_numpy(), table.column("doc").to_numpy()
        order = np.lexsort((doc != centre, centre))
        centre, doc = centre[order], doc[order]
        one, two = [], []
        texts = table.column("text")
        start = first_of_equal(centre)
        for s, e in zip(start.tolist(), [*start[1:].tolist(), len(centre)]):
            own = None
            at = s
            while at < e:
                stop = min(e, at + FAN)
                shingle, bounds = shingle_sets([(texts[int(i)].as_py() or "").encode() for i in order[at:stop]], words)
                if own is None:
                    own = shingle[: bounds[1]]
                common = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(is_in(shingle, own))))
                both = common[bounds[1:]] - common[bounds[:-1]]
                union = len(own) + np.diff(bounds) - both
                yes = (both > 0) & (both >= threshold * union - 1e-9) & (doc[at:stop] != centre[at:stop])
                one.append(centre[at:stop][yes])
                two.append(doc[at:stop][yes])
                at = stop
        return _pairs(one, two)

    def partnered(all_rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
        """all_rows joined with the rows of ``wanted`` (stored), by a whole number; of all_rows hardly more than those with a partner are shuffled."""
        count = wanted.count()
        if count <= BROADCAST_ROWS:
            return all_rows.join(F.broadcast(wanted), key)
        last = min(1 << (WANTED_BITS * count - 1).bit_length(), MOST_BITS) - 1
        maps = bit_maps(wanted.select(F.xxhash64(key).bitwiseAND(last).alias("number")))
        return wanted.hint("merge").join(in_maps(all_rows, F.xxhash64(all_rows[key]).bitwiseAND(last), maps), key)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The (a, b) pairs whose sets reach the threshold; pairs of one centre spread over buckets of FAN members."""
        # stored: they are read for both degrees and for the pairs
        pairs = stored(pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct(), "candidates")
        both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
        degree = both.groupBy("x").count()
        pairs = pairs.join(degree.select("x", F.col("count").alias("dx")), "x").join(degree.select(F.col("x").alias("y"), F.col("count").alias("dy")), "y")
        # the end with more pairs is the centre: its text is sent once for many others
        centre, doc = F.when(F.col("dx") >= F.col("dy"), F.col("x")).otherwise(F.col("y")), F.when(F.col("dx") >= F.col("dy"), F.col("y")).otherwise(F.col("x"))
        pairs = pairs.select(centre.alias("centre"), doc.alias("doc"), F.greatest("dx", "dy").alias("d"))
        salt = F.pmod(F.xxhash64("doc"), F.ceil(F.col("d") / FAN))
        pairs = pairs.select("centre", "doc", F.pmod(F.xxhash64("centre", salt), F.lit(buckets)).cast("int").alias("bucket"))
        wanted = stored(pairs.unionByName(pairs.select("centre", F.col("centre").alias("doc"), "bucket").distinct()), "pairs")
        full = partnered(rows.withColumnRenamed("doc_id", "doc"), wanted, "doc")
        return stored(full.groupBy("bucket").applyInArrow(verify, "a long, b long"), "confirmed")

    same_set = ["print", "print_two", "n_shingles"]
    known = stored(rows.mapInArrow(sets, "doc_id long, n_shingles long, print long, print_two long, keys array<long>, bits binary"), "sets")
    classes = known.where("print is not null").groupBy(*same_set).agg(F.min("doc_id").alias("class_id"))
    heads = known.join(classes, same_set).where("doc_id = class_id").select(F.col("doc_id").alias("doc"), "keys", "bits").dropDuplicates(["doc"])
    heads = stored(heads, "heads")
    by_bucket = lambda df: df.withColumn("bucket", F.pmod("key", F.lit(buckets))).groupBy("bucket")

    def members(band: DataFrame, part: DataFrame) -> DataFrame:
        """(key, doc, component) of the buckets whose members are of several components."""
        band = band.join(part, F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
        mixed = band.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        return stored(partnered(band, stored(mixed, "mixed"), "key").select("key", "doc", "component"), "members")

    def signed(found: DataFrame) -> DataFrame:
        """Members with their signatures."""
        return partnered(heads, found, "doc")

    links = docs.sparkSession.createDataFrame([], "a long, b long")
    part = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = None
    for first, last in STEPS:
        step = members(heads.select("doc", F.explode(F.slice("keys", first + 1, last - first)).alias("key")), part)
        found = step if found is None else found.unionByName(step)
        star = by_bucket(signed(step).drop("keys")).applyInArrow(stars, "a long, b long, like double").distinct()
        # a text meets one typical member a band; its three likeliest come first, the others only if components stay apart
        star = star.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("like", "a")), asc=False), 1, 3).alias("best"))
        links = stored(links.unionByName(confirmed(star.select(F.explode("best.a").alias("a"), "b"))).distinct(), "links")
        part = connected_components(links)
    # the likeliest pairs join most of what belongs together; then every pair that is still apart
    found = members(found.select("doc", "key"), part)
    pairs = by_bucket(signed(found).drop("keys")).applyInArrow(likeliest, "a long, b long")
    links = stored(links.unionByName(confirmed(pairs)).distinct(), "links")
    found = members(found.select("doc", "key"), connected_components(links))
    apart = stored(by_bucket(signed(found)).applyInArrow(unsettled, "key long, doc long, component long, main boolean"), "apart")
    asked = stored(apart.select("doc").distinct(), "asked")
    wanted = partnered(rows.withColumnRenamed("doc_id", "doc"), asked, "doc").select("doc", "text").dropDuplicates(["doc"])
    sets_of = stored(wanted.mapInArrow(shingles, "doc long, shingles binary"), "shingles")
    pairs = by_bucket(signed(apart).join(sets_of, "doc")).applyInArrow(joining, "a long, b long")
    links = stored(links.unionByName(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "links")
    part = connected_components(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    out = known.join(classes, same_set, "left").join(part.withColumnRenamed("node", "class_id"), "class_id", "left").join(ends, "class_id", "left")
    own = F.coalesce("component", "class_id", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _pairs(one: list[np.ndarray], two: list[np.ndarray]) -> pa.Table:
    a, b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64) for x in (one, two))
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
