"""Substring dedup by recompression.

Every text becomes a string of word names.  In rounds, runs of one name and then pairs
(left half of the names, right half) are replaced by a new name that is a hash of what it
replaces, so the same content gets the same name in every document without a shared
dictionary.  For each name the words that decided it (its context) are tracked: where a
context lies inside a window, every other occurrence of that window has the same name at
the same place.  Each window takes the context of one such name, of the highest level it
has, and the hash of that context's words (at most half a window) is its anchor.  Spark
groups the anchors of all documents; only windows whose anchor occurs in several documents
are verified by the hash of all their words.

The rounds run inside one Python call per batch of texts and only choose where the anchors
are: the names themselves are not kept, sent or compared, and there are no naming rounds in
Spark.  Those would send every text through a shuffle per round to agree on names that the
hashes give alike everywhere, and the windows would still be verified word by word.

Jobs: anchors of every text -> by anchor: shared ones -> by document: windows at shared
anchors -> by window: those that an earlier document has -> by document: words to remove.
Copies of a whole text are found by the name of the whole text and give no windows.

Rows with a null text have no words; with a null doc_id they remove nothing and nothing is
removed from them; texts shorter than a window stay whole; repeated rows of one doc_id are
no earlier document to each other; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.llm.common import PACKED, U64, Words, buckets_for, column, first_of_equal, int64, is_in, mix, pack, prefix_hash, span_hash, text_chunks, unpack

#: Rounds of recompression.
ROUNDS = 5
#: What a row of shared names holds: anchors, or names of whole texts that an earlier document has.
ANCHORS, COPIES = 0, 1
NO_ID = np.iinfo(np.int64).min
_SEED = [U64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377, 0xBE5466CF34E90C6C, 0xC0AC29B7C97C50DD, 0x3F84D5B5B5470917)]


def levels(names: np.ndarray, owner: np.ndarray, first: np.ndarray, rounds: int = ROUNDS):
    """Yield (lo, hi) per level: the contexts, as word ranges, of the names of that level.

    A context that reaches over an end of its text begins before or ends after the text.
    """
    n = len(names)
    at = np.arange(n)
    lo, hi, own = at, at + 1, owner
    before, after = first[:-1] - 1, first[1:] + 1
    yield lo, hi
    for r in range(rounds):
        if len(names) < 2:
            return
        # runs of one name become one name; where a run ends is decided by its neighbours
        joined = (names[1:] == names[:-1]) & (own[1:] == own[:-1])
        start = np.flatnonzero(np.concatenate(([True], ~joined)))
        stop = np.append(start[1:], len(names)) - 1
        length = stop - start + 1
        left, right = np.maximum(start - 1, 0), np.minimum(stop + 1, len(names) - 1)
        o = own[start]
        new_lo = np.where((start > 0) & (own[left] == o), np.minimum(lo[left], lo[start]), before[o])
        new_hi = np.where((stop + 1 < len(names)) & (own[right] == o), np.maximum(hi[right], hi[stop]), after[o])
        names = np.where(length > 1, mix(names[start] + _SEED[r] * length.astype(np.uint64)), names[start])
        lo, hi, own = new_lo, new_hi, o
        if len(names) < 2:
            return
        # pairs of a left and a right name become one name
        is_left = (mix(names ^ _SEED[r]) >> U64(63)) == 0
        same = own[1:] == own[:-1]
        pair = np.append(is_left[:-1] & ~is_left[1:] & same, False)
        second = np.concatenate(([False], pair[:-1]))
        nxt_hi = np.append(np.where(same, hi[1:], after[own[:-1]]), after[own[-1]])
        prev_lo = np.concatenate(([before[own[0]]], np.where(same, lo[:-1], before[own[1:]])))
        new_hi = np.where(is_left, np.maximum(hi, nxt_hi), hi)
        new_lo = np.where(~is_left, np.minimum(lo, prev_lo), lo)
        merged = mix(names * U64(3) + np.append(names[1:], U64(0)) * U64(0x9E3779B97F4A7C15) + _SEED[r])
        keep = ~second
        names, lo, hi, own = np.where(pair, merged, names)[keep], new_lo[keep], new_hi[keep], own[keep]
        yield lo, hi


def window_anchors(words: Words, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor per word position, valid window starts, prefix hash).  Equal windows have equal anchors."""
    n = len(words.hash)
    prefix = prefix_hash(words.hash)
    owner = words.owner()
    end = words.first[1:][owner] if n else np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.arange(n) + window <= end)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, prefix
    widest = (window + 1) // 2
    anchor = np.empty(n, dtype=np.uint64)
    for level, (lo, hi) in enumerate(levels(words.hash, owner, words.first, rounds)):
        ok = hi - lo <= widest
        ok &= (lo >= words.first[:-1][owner[np.clip(lo, 0, n - 1)]]) & (lo >= 0) & (hi <= n)
        lo, hi = lo[ok], hi[ok]
        ok = owner[lo] == owner[hi - 1]
        lo, hi = lo[ok], hi[ok]
        anchor[lo] = (span_hash(prefix, lo, hi) >> U64(4)) | U64((15 - level) << 60)
    # least anchor among the positions from which a context of any width stays inside the window
    reach, step = window - widest + 1, 1
    least = anchor
    while step * 2 <= reach:
        least = np.minimum(least, np.append(least[step:], least[-step:]))
        step *= 2
    if step < reach:
        shift = reach - step
        least = np.minimum(least, np.append(least[shift:], least[-shift:]))
    return least, starts, prefix


def _spread(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys) % U64(buckets)).astype(np.int32)


def substring_dedup(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None, with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by one space; null without with_text)."""
    rows = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), column(docs, text).alias("text"))
    buckets = buckets or buckets_for(rows)
    # one exchange of the texts, used by both passes over them
    shards = rows.withColumn("shard", F.coalesce(F.pmod("doc_id", F.lit(buckets)), F.lit(0)).cast("int")).groupBy("shard")

    def whole_name(words: Words, prefix: np.ndarray) -> np.ndarray:
        return span_hash(prefix, words.first[:-1], words.first[1:]) | U64(1)

    def anchors(batches):
        for part, texts in text_chunks(batches):
            ids = int64(part, "doc_id")
            words = Words(texts)
            anchor, starts, prefix = window_anchors(words, window)
            owner = np.repeat(np.arange(len(ids)), words.count)[starts]
            picked = anchor[starts] & ~U64(1)
            change = first_of_equal(picked, owner)
            long_enough = np.flatnonzero(words.count >= window)
            key = np.concatenate((picked[change], whole_name(words, prefix)[long_enough]))
            doc = ids[np.concatenate((owner[change], long_enough))]
            key, doc = key[doc != NO_ID], doc[doc != NO_ID]
            order = np.lexsort((doc, key))
            once = order[first_of_equal(key[order], doc[order])]
            yield pack(_spread(key[once], buckets), [key[once], doc[once]])

    def shared(table: pa.Table) -> pa.Table:
        key, doc = unpack(table.column("data").to_pylist(), ["u8", "i8"])
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        once = first_of_equal(key, doc)
        key, doc = key[once], doc[once]
        start = first_of_equal(key)
        size = np.diff(np.append(start, len(key)))
        several = np.repeat(size > 1, size)
        earliest = np.repeat(doc[start], size) == doc if len(start) else several
        whole = key & U64(1) == 1
        out = []
        for kind, keep in ((ANCHORS, several & ~whole), (COPIES, several & whole & ~earliest)):
            out.append(pack((doc[keep] % buckets).astype(np.int32), [doc[keep], key[keep]], origin=kind))
        return pa.Table.from_batches(out)

    def flagged(table: pa.Table) -> dict[int, np.ndarray]:
        doc, key = unpack(table.column("data").to_pylist(), ["i8", "u8"])
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        start = first_of_equal(doc)
        return dict(zip(doc[start].tolist(), np.split(key, start[1:])))

    def windows(_, left: pa.Table, right: pa.Table) -> pa.Table:
        known, out = flagged(right), []
        for part, texts in text_chunks(left.to_batches()) if known else ():
            ids = int64(part, "doc_id")
            use = [i for i, d in enumerate(ids.tolist()) if d in known]
            if not use:
                continue
            words = Words([texts[i] for i in use])
            anchor, starts, prefix = window_anchors(words, window)
            whole = whole_name(words, prefix)
            at, doc = [], []
            bounds = np.searchsorted(starts, words.first)
            for j, i in enumerate(use):
                have, d = known[int(ids[i])], ids[i]
                if words.count[j] < window or is_in(whole[j : j + 1], have)[0]:
                    continue
                s = starts[bounds[j] : bounds[j + 1]]
                s = s[is_in(anchor[s] & ~U64(1), have)]
                at.append(s)
                doc.append(np.full(len(s), d))
            if at:
                at, doc = np.concatenate(at), np.concatenate(doc)
                one = span_hash(prefix, at, at + window)
                out.append((one, _second_hash(words, at, window), doc))
        if not out:
            return pa.Table.from_batches([pack(np.zeros(0, np.int32), [])])
        one, two, doc = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((doc, two, one))
        once = order[first_of_equal(one[order], two[order], doc[order])]
        return pa.Table.from_batches([pack(_spread(one[once], buckets), [one[once], two[once], doc[once]])])

    def repeated(table: pa.Table) -> pa.Table:
        one, two, doc = unpack(table.column("data").to_pylist(), ["u8", "u4", "i8"])
        order = np.lexsort((doc, two, one))
        one, two, doc = one[order], two[order], doc[order]
        start = first_of_equal(one, two)
        size = np.diff(np.append(start, len(one)))
        keep = doc > np.repeat(doc[start], size) if len(start) else np.zeros(0, dtype=bool)
        return pa.Table.from_batches([pack((doc[keep] % buckets).astype(np.int32), [doc[keep], one[keep]])])

    def removal(_, left: pa.Table, right: pa.Table) -> pa.Table:
        known = flagged(right)
        ids, total, gone, sha, kept = [], [], [], [], []
        for part, texts in text_chunks(left.to_batches()):
            for d, body, null in zip(int64(part, "doc_id").tolist(), texts, part.column("doc_id").is_null().to_pylist()):
                split = body.split()
                left_over = split
                if d in known and len(split) >= window:
                    words = Words([body])
                    prefix = prefix_hash(words.hash)
                    if is_in(whole_name(words, prefix), known[d])[0]:
                        left_over = []
                    else:
                        at = np.arange(len(split) - window + 1)
                        hit = at[is_in(span_hash(prefix, at, at + window), known[d])]
                        cover = np.zeros(len(split) + 1, dtype=np.int64)
                        np.add.at(cover, hit, 1)
                        np.add.at(cover, hit + window, -1)
                        left_over = list(compress(split, (np.cumsum(cover)[:-1] == 0).tolist()))
                text_left = b" ".join(left_over)
                ids.append(None if null else d)
                total.append(len(split))
                gone.append(len(split) - len(left_over))
                sha.append(hashlib.sha256(text_left).hexdigest())
                kept.append(text_left.decode("utf-8", "replace") if with_text else None)
        return pa.table([pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    to_docs = rows.mapInArrow(anchors, PACKED).groupBy("bucket").applyInArrow(shared, PACKED)
    found = shards.cogroup(to_docs.groupBy("bucket")).applyInArrow(windows, PACKED).groupBy("bucket").applyInArrow(repeated, PACKED)
    # whole copies keep their names beside the repeated windows: both are looked up in the last pass
    marks = to_docs.where(F.col("origin") == COPIES).unionByName(found)
    return shards.cogroup(marks.groupBy("bucket")).applyInArrow(removal, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def _second_hash(words: Words, at: np.ndarray, window: int) -> np.ndarray:
    """32 more bits for a window, from other word hashes than the first 64."""
    return (span_hash(prefix_hash(mix(words.hash + U64(0x5851F42D4C957F2D))), at, at + window) >> U64(32)).astype(np.uint32)
