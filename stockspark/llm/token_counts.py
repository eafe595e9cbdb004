"""Token counts by the whole-token shortcut.

Offline, prove_whole_tokens runs every vocabulary string that could be a pre-token through
the library and keeps those that come out as exactly one token.  While counting, a text's
pre-tokens that are proven count one each; only the others are merged by the library, once
per worker.  Texts with special strings or rare characters are encoded whole.

A null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.llm.common import column, remembered, text_chunks
from stockspark.llm.encoders import REMEMBERED, load, specials

#: Pre-tokens of the word vocabulary on text of the plain range (letters there are A-Z, a-z and U+00AA..U+024F).
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGIT = "0-9²³¹¼-¾"
_PRE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\s{_LETTER}{_DIGIT}]+")
_KINDS = [re.compile(f"[{c}]*") for c in (_LETTER, _DIGIT, rf"^\s{_LETTER}{_DIGIT}")]


def _stays(c: str) -> bool:
    """Whether the character's lower case, composed, is of the character's kind."""
    kind = next((k for k in _KINDS if k.fullmatch(c)), None)
    return kind is not None and bool(kind.fullmatch(unicodedata.normalize("NFC", c).lower()))


#: Characters for which the shortcut is used; others (among them capitals whose lower case lies outside the letters above) go through the library.
_PLAIN = re.compile(r"[\x09-\x0d\x20" + "".join(re.escape(chr(c)) for c in (*range(0x21, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028)) if _stays(chr(c))) + "]*")


def prove_whole_tokens(path: str) -> set[str]:
    """Vocabulary strings (word end taken off) that the library encodes alone as one token."""
    tokenizer = load(path)
    ends = [t[:-4] for t in tokenizer.get_vocab() if t.endswith("</w>")]
    ends = [t for t in ends if t and _PLAIN.fullmatch(t) and _PRE.fullmatch(t) and t == unicodedata.normalize("NFC", t).lower()]
    return {t for t, code in zip(ends, tokenizer.encode_batch(ends, add_special_tokens=False)) if len(code.ids) == 1}


class Counter:
    """count(text): tokens as the library counts them, without added special tokens."""

    def __init__(self, path: str, proven: frozenset[str]):
        self.tokenizer = load(path)
        self.special = specials(self.tokenizer)
        self.proven = proven
        self.merged: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = text.split()
        rest = [w for w in words if w not in self.proven]
        n = len(words) - len(rest)
        merged = self.merged
        new = [w for w in dict.fromkeys(rest) if w not in merged]
        if new:
            if len(merged) > REMEMBERED:
                merged = self.merged = dict(islice(merged.items(), REMEMBERED // 4))
                new = [w for w in dict.fromkeys(rest) if w not in merged]
            self._merge(new)
        return n + sum(map(merged.__getitem__, rest))

    def _merge(self, words: list[str]) -> None:
        """Words that white space separates: proven pre-tokens count one, the others are merged by the library."""
        for word in words:
            parts = _PRE.findall(unicodedata.normalize("NFC", word).lower())
            hard = [p for p in parts if p not in self.proven]
            n = len(parts) - len(hard)
            if hard:
                n += sum(len(c.ids) for c in self.tokenizer.encode_batch_fast(hard, add_special_tokens=False))
            self.merged[word] = n


def _counter(path: str, proven: frozenset[str]) -> Counter:
    """The worker's counter: what it remembers serves all tasks of the worker."""
    memory = remembered("token counts")
    if path not in memory:
        memory[path] = Counter(path, proven)
    return memory[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    rows = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    # bounded by the vocabulary
    proven = docs.sparkSession.sparkContext.broadcast(frozenset(prove_whole_tokens(path)))

    def count(batches):
        counter = _counter(path, proven.value)
        for part, texts in text_chunks(batches):
            tokens = [counter.count(t.decode()) for t in texts]
            yield pa.record_batch([part.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
