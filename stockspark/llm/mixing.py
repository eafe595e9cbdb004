"""Mixing sources to target weights by the cube method.

Sources share the total size by their weights; no source gets more than ``most`` times what
it has, and the excess is shared again.  A document's expected copies are its source's
target over its size: the whole part is taken as it is, the fraction is rounded by the cube
method: the flight moves the fractions of three documents at a time along the direction that
keeps both the token total and the document total, until each is 0 or 1.  Blocks of a source
fly on their own; the few fractions they leave fly together in the next round, the largest
documents first, so what the landing rounds at last are few documents; then pairs of
decisions are swapped, which keeps the document total, while that brings the token total nearer
to what was meant.

Texts that are null or empty have size 0; a source without words has target 0 and takes
nothing; a null source is a source of its own, last in the order; repeated rows (equal id,
source and text) share one decision; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.llm.common import WORD_SPLIT, column, stored

#: Documents of one flight block.
BLOCK = 2_000
_EPS = 1e-12


def word_count(text):
    """Words of a text column, white space being \\x20 and \\x09-\\x0D."""
    return F.coalesce(F.size(F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=(5.0, 2.0, 1.0), share: float = 1.0, most: float = 3.0) -> dict[str | None, float]:
    """Target per source: sources by code point, null last, with repeating weights; excess over ``most`` times the size is reshared."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    left = {name: (weights[i % len(weights)], size) for i, (name, size) in enumerate(order)}
    rest, out = share * sum(size for _, size in order), {}
    while left:
        total = sum(w for w, _ in left.values())
        full = {name: most * size for name, (w, size) in left.items() if rest * w / total > most * size}
        if not full:
            out.update({name: rest * w / total for name, (w, _) in left.items()})
            break
        out.update(full)
        rest -= sum(full.values())
        left = {name: x for name, x in left.items() if name not in full}
    return out


def flight(p: np.ndarray, size: np.ndarray, order: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Round p to 0 or 1 but for two entries at most, keeping sum(p) and sum(p * size)."""
    p = p.copy()
    held: list[int] = []
    for i in order.tolist():
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = round(p[i])
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        # null direction of the rows (1, 1, 1) and (size a, size b, size c)
        u = np.array([size[b] - size[c], size[c] - size[a], size[a] - size[b]], dtype=float)
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        x = p[held]
        with np.errstate(divide="ignore"):
            up = np.min(np.where(u > 0, (1 - x) / np.where(u == 0, 1, u), np.where(u < 0, -x / np.where(u == 0, 1, u), np.inf)))
            down = np.min(np.where(u > 0, x / np.where(u == 0, 1, u), np.where(u < 0, (x - 1) / np.where(u == 0, 1, u), np.inf)))
        x = x + up * u if draw[i] * (up + down) < down else x - down * u
        x = np.where(x < 1e-9, 0.0, np.where(x > 1 - 1e-9, 1.0, x))
        p[held] = x
        held = [j for j, v in zip(held, x) if 0 < v < 1]
    return p


def _swap(p: np.ndarray, size: np.ndarray, meant: float) -> None:
    """Swap a taken for a left document while that brings p @ size nearer to ``meant``; the sum of p stays."""
    while True:
        missed = meant - float(p @ size)
        taken, left = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
        if not len(taken) or not len(left):
            return
        left = left[np.argsort(size[left], kind="stable")]
        # for every taken document the left ones whose size is next to the wanted one
        at = np.searchsorted(size[left], size[taken] + missed)
        best = None
        for near in (np.maximum(at - 1, 0), np.minimum(at, len(left) - 1)):
            off = np.abs(missed - (size[left[near]] - size[taken]))
            i = int(off.argmin())
            if best is None or off[i] < best[0]:
                best = (float(off[i]), taken[i], left[near[i]])
        if best[0] >= abs(missed) - 1e-9:
            return
        p[best[1]], p[best[2]] = 0.0, 1.0


def mix_sources(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.0, most: float = 3.0, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs with size, source_size, target, copies and taken (size * copies) added.

    Clashing columns of docs are replaced.  Decisions depend on ids, sources, texts and the
    seed only, so reruns agree.
    """
    own = docs.select(*(column(docs, c) for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken", "mix_key")))
    # xxhash64 passes over nulls: a flag per column tells which ones are null
    given = [x for c in (doc_id, source, text) for x in (column(own, c).isNull(), column(own, c))]
    own = own.withColumn("size", word_count(column(own, text))).withColumn("mix_key", F.xxhash64(F.lit(seed), *given))
    units = own.groupBy(column(own, source).alias("src"), "mix_key").agg(F.max("size").alias("doc_size"), F.count("*").alias("n"), F.min(column(own, doc_id)).alias("id"))
    units = stored(units, "units")
    # one row per source, as many as the source column has values
    per_source = units.groupBy("src").agg(F.sum(F.col("doc_size") * F.col("n")).alias("source_size"), F.count("*").alias("docs")).collect()
    goal = targets([(r["src"], r["source_size"]) for r in per_source], weights, share, most)
    plan = docs.sparkSession.createDataFrame([(r["src"], r["source_size"], float(goal[r["src"]]), goal[r["src"]] / r["source_size"] if r["source_size"] else 0.0, max(1, -(-r["docs"] // BLOCK))) for r in per_source], f"name {dict(units.dtypes)['src']}, source_size long, target double, expected double, blocks long")
    left = units.join(plan, F.col("src").eqNullSafe(F.col("name")))
    left = left.select("src", "mix_key", (F.col("doc_size") * F.col("n")).alias("size"), F.floor("expected").alias("whole"), (F.col("expected") - F.floor("expected")).alias("p"), F.pmod(F.col("mix_key"), F.col("blocks")).alias("block"), "blocks", "source_size", "target")

    def fly(last: bool):
        def run(table: pa.Table) -> pa.Table:
            key, size = table.column("mix_key").to_numpy(), table.column("size").to_numpy().astype(float)
            p = table.column("p").to_numpy()
            draw = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) / 2.0**53
            order = np.lexsort((key, -size))
            meant = float(p @ size)
            p = flight(p, size, order, draw)
            if last:  # landing: at most two fractions, the constraints dropped one after another
                open_ = [i for i in order.tolist() if 0 < p[i] < 1]
                if len(open_) == 2:
                    a, b = open_
                    total = p[a] + p[b]
                    up = min(1 - p[a], p[b])
                    down = min(p[a], 1 - p[b])
                    p[a] = p[a] + up if draw[a] * (up + down) < down else p[a] - down
                    p[b] = total - p[a]
                for i in open_:
                    p[i] = float(draw[i] < p[i]) if 1e-9 < p[i] < 1 - 1e-9 else float(round(p[i]))
                _swap(p, size, meant)
            return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))

        return run

    schema, done = left.schema, None
    blocks = max([1, *(-(-r["docs"] // BLOCK) for r in per_source)])
    while True:
        flown = stored(left.groupBy("src", "block").applyInArrow(fly(blocks == 1), schema), "flown")
        fixed = flown.where("p = 0 or p = 1")
        done = fixed if done is None else done.unionByName(fixed)
        if blocks == 1:
            break
        # fractions of up to BLOCK / 4 blocks meet in the next round
        blocks = -(-blocks // (BLOCK // 4))
        left = flown.where("p > 0 and p < 1").withColumn("block", F.pmod("block", F.lit(blocks)))
    picks = done.select("mix_key", (F.col("whole") + F.col("p")).cast("long").alias("copies"), "source_size", "target")
    return own.join(picks, "mix_key").withColumn("taken", F.col("size") * F.col("copies")).drop("mix_key")
