"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary.  Every language has a probability per
piece; a word's probability is the sum over all its segmentations into pieces, taken by the
forward algorithm, and the probabilities are fitted by expectation maximisation (forward and
backward sums).  Words of one length are scored together as arrays.

The fit uses about FIT_DOCS labelled texts of every language (chosen by a hash of their id and
text; all texts of a language that has no more); every text is scored whole.  A text that is null or has no letter is ``und`` with score 0, as is every
text if nothing could be learned; ties go to the smaller language code; repeated rows are
scored each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.llm.common import U64, column, mix, remembered, stored, text_chunks

#: Labelled texts of each language that the fit uses, and its rounds.
FIT_DOCS, ROUNDS = 4_000, 2
#: Tasks of one round; each sends one table of pieces x languages numbers.
FIT_TASKS = 12
#: Words that one worker remembers, and the letters after which a long word is cut.
REMEMBERED, LONGEST = 300_000, 100
_LOW = U64((1 << 20) - 1)
_BASE, _UNKNOWN = U64(0x9E3779B97F4A7C15), 1e-7
#: Probabilities are scaled by this per letter, so that products stay in range.
_SCALE = 100.0


def _class(wanted) -> str:
    """A character class of all characters whose category is wanted, as ranges."""
    codes = [c for c in range(sys.maxunicode + 1) if wanted(unicodedata.category(chr(c)))]
    runs = np.split(np.array(codes), np.flatnonzero(np.diff(codes) != 1) + 1)
    return "".join(f"{re.escape(chr(r[0]))}-{re.escape(chr(r[-1]))}" for r in runs)


#: Letters (categories L*), and marks (M*) inside a word.
_LETTERS = "[" + _class(lambda c: c[0] == "L") + "]+"
_WORD = re.compile(f"{_LETTERS}(?:[{_class(lambda c: c[0] == 'M')}]+(?:{_LETTERS})?)*")


@lru_cache(maxsize=1)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _memory(model: str, languages: int) -> dict:
    """What a worker remembers of one model: the place of each word and its values."""
    memory = remembered("language ID")
    if model not in memory:
        memory.clear()
        memory[model] = {"place": {}, "logs": np.zeros((0, languages))}
    return memory[model]


class Pieces:
    """The vocabulary as hashes of pieces; pieces for bytes and controls are left out."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        names = sorted({model.id_to_piece(i).lower() for i in usable})
        self.longest = max(map(len, names))
        keys = np.array([self._key(n) for n in names], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.size = keys[order], order, len(names)
        # one byte per low part of a hash: most spans are no piece and need no search
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[keys & _LOW] = True

    @staticmethod
    def _key(name: str) -> int:
        h = 0
        for value in mix(np.frombuffer(name.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)).tolist():
            h = (h * int(_BASE) + value) & 0xFFFFFFFFFFFFFFFF
        return h

    def lattice(self, letters: np.ndarray):
        """(start, end, words, their piece) for every span that is a piece of some word, by end; a letter that is no piece has piece -1."""
        n, length = letters.shape
        value = mix(letters.astype(np.uint64))
        for end in range(1, length + 1):
            h, power = np.zeros(n, dtype=np.uint64), U64(1)
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                h = h + value[:, start] * power
                with np.errstate(over="ignore"):
                    power = power * _BASE
                rows = np.flatnonzero(self.maybe[h & _LOW])
                at = np.minimum(np.searchsorted(self.keys, h[rows]), self.size - 1)
                hit = self.keys[at] == h[rows]
                rows, piece = rows[hit], self.ids[at[hit]]
                if start == end - 1:
                    single = np.full(n, -1)
                    single[rows] = piece
                    yield start, end, np.arange(n), single
                elif len(rows):
                    yield start, end, rows, piece


def _by_length(words: list[str]):
    """(positions, letters) for words of one length; a word is preceded by the mark of a word's begin."""
    lengths: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        lengths.setdefault(len(w), []).append(i)
    for length, at in lengths.items():
        text = "".join("▁" + words[i] for i in at)
        yield np.array(at), np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).reshape(len(at), length + 1)


def forward(pieces: Pieces, letters: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, list]:
    """Forward sums (words, places, languages), scaled, and the lattice; prob is (pieces + 1, languages), its last row for unknown letters."""
    n, length = letters.shape
    alpha = np.zeros((length + 1, n, prob.shape[1]))
    alpha[0] = 1
    spans = []
    for start, end, rows, piece in pieces.lattice(letters):
        p = prob[piece] * _SCALE ** (end - start)
        alpha[end, rows] += alpha[start, rows] * p
        spans.append((start, end, rows, piece, p))
    return alpha, spans


def word_logs(pieces: Pieces, words: list[str], prob: np.ndarray) -> np.ndarray:
    """log P(word) per word and language."""
    out = np.empty((len(words), prob.shape[1]))
    for at, letters in _by_length(words):
        for i in range(0, len(at), 4096):
            alpha, _ = forward(pieces, letters[i : i + 4096], prob)
            out[at[i : i + 4096]] = np.log(np.maximum(alpha[-1], 1e-300)) - letters.shape[1] * np.log(_SCALE)
    return out


def expected(pieces: Pieces, words: list[str], count: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in the words, by language; count is (words, languages)."""
    out = np.zeros_like(prob)
    for at, letters in _by_length(words):
        for i in range(0, len(at), 4096):
            alpha, spans = forward(pieces, letters[i : i + 4096], prob)
            beta = np.zeros_like(alpha)
            beta[-1] = 1
            weight = count[at[i : i + 4096]] / np.maximum(alpha[-1], 1e-300)
            found, uses = [], []
            for start, end, rows, piece, p in reversed(spans):
                after = p * beta[end, rows]
                found.append(piece)
                uses.append(alpha[start, rows] * after * weight[rows])
                beta[start, rows] += after
            piece, used = np.concatenate(found) % len(out), np.concatenate(uses)
            for k in range(prob.shape[1]):
                out[:, k] += np.bincount(piece, weights=used[:, k], minlength=len(out))
    out[-1] = 0  # unknown letters keep their probability
    return out


def words_of(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    return found if len(text) < LONGEST or max(map(len, found), default=0) <= LONGEST else [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]


def _normal(uses: np.ndarray) -> np.ndarray:
    p = uses[:-1] + 0.05
    return np.concatenate((p / p.sum(axis=0), np.full((1, uses.shape[1]), _UNKNOWN)))


def _drawn():
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))


def fit_sample(labelled: DataFrame, sizes: list, fit_docs: int) -> DataFrame:
    """About fit_docs texts of every language, at least one; all where there are no more. sizes: (lang, n, least draw)."""
    below = [(r["lang"], max(int((1 << 40) * min(1.0, fit_docs / r["n"])), r["least"] + 1)) for r in sizes]
    most = labelled.sparkSession.createDataFrame(below, "lang string, below long")
    return labelled.join(F.broadcast(most), "lang").where(_drawn() < F.col("below")).select(labelled.columns)


def fit(labelled: DataFrame, path: str, fit_docs: int = FIT_DOCS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, piece probabilities) from (doc_id, text, lang) rows."""
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min(_drawn()).alias("least")).collect()
    per_lang = sorted((r["lang"], r["n"]) for r in sizes)
    langs, total = [x for x, _ in per_lang], sum(n for _, n in per_lang)
    pieces = Pieces(path) if langs else None
    if not langs:
        return [], np.zeros(0), np.zeros((1, 0))
    sample = fit_sample(labelled, sizes, fit_docs)
    place = {x: i for i, x in enumerate(langs)}

    def split(batches):
        for batch in batches:
            seen: Counter = Counter()
            for text, lang in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), batch.column(batch.schema.get_field_index("lang")).to_pylist()):
                seen.update((place[lang], w) for w in words_of(text or ""))
            yield pa.record_batch([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    counts = sample.mapInArrow(split, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = stored(counts, "words")
    prob = _normal(np.ones((pieces.size + 1, len(langs))))
    for _ in range(rounds):
        shared = labelled.sparkSession.sparkContext.broadcast(prob)

        def step(batches, shared=shared):
            lattice, uses = _pieces(path), None
            for batch in batches:
                words = batch.column(1).to_pylist()
                n = np.zeros((len(words), len(langs)))
                n[np.arange(len(words)), batch.column(0).to_numpy()] = batch.column(2).to_numpy()
                part = expected(lattice, words, n, shared.value)
                uses = part if uses is None else uses + part
            if uses is not None:
                yield pa.record_batch([pa.array([uses.tobytes()], pa.binary())], names=["uses"])

        # pieces x languages numbers from each of at most FIT_TASKS tasks, which run side by side
        flat = [np.frombuffer(r["uses"]).reshape(prob.shape) for r in counts.coalesce(FIT_TASKS).mapInArrow(step, "uses binary").collect()]
        prob = _normal(np.sum(flat, axis=0)) if flat else prob
    return langs, np.log([n / total for _, n in per_lang]), prob


def identify_languages(docs: DataFrame, path: str, trained, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", carry: bool = False, **options) -> DataFrame:
    """doc_id, lang_pred, score of every row; the model is learned from the rows where ``trained`` holds and lang is not null.

    With ``carry`` all columns of docs stay, but for its own lang_pred and score.
    """
    rows = docs.select(*(column(docs, c) for c in ([c for c in docs.columns if c not in ("lang_pred", "score")] if carry else [doc_id, text])))
    out_names = rows.columns if carry else [doc_id]
    out = rows.select(*(column(rows, c) for c in out_names)).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    labelled = docs.where(F.coalesce(trained, F.lit(False))).select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"), column(docs, lang).cast("string").alias("lang")).where("lang is not null")
    langs, prior, prob = fit(labelled, path, **options)
    shared, model = docs.sparkSession.sparkContext.broadcast(prob), uuid.uuid4().hex

    def predict(batches):
        pieces = _pieces(path) if langs else None
        memory = _memory(model, len(langs))
        for part, texts in text_chunks(batches, text):
            found = [words_of(t.decode()) if langs else [] for t in texts]
            place, logs = memory["place"], memory["logs"]
            new = [w for w in dict.fromkeys(w for ws in found for w in ws) if w not in place]
            if new and len(place) + len(new) > REMEMBERED:
                place.clear()
                logs = logs[:0]
                new = list(dict.fromkeys(w for ws in found for w in ws))
            if new:
                place.update(zip(new, range(len(logs), len(logs) + len(new))))
                logs = memory["logs"] = np.concatenate((logs, word_logs(pieces, new, shared.value)))
            names, scores = [], []
            for ws in found:
                if not ws:
                    names.append("und")
                    scores.append(0.0)
                    continue
                value = prior + logs[[place[w] for w in ws]].sum(axis=0)
                best = int(value.argmax())
                names.append(langs[best])
                scores.append(float(1 / np.exp(value - value[best]).sum()))
            kept = [part.column(part.schema.get_field_index(c)) for c in out_names]
            yield pa.record_batch([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*out_names, "lang_pred", "score"])

    return rows.mapInArrow(predict, out)
