"""Token counts of whole texts, without shuffling pre-tokens.

Two tiers on the map side: a broadcast table of the lengths of frequent pre-tokens,
and on a miss a bounded cache in each worker, filled by encoding the pre-token.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, pieces

#: Fixed value: how byte-level BPE cuts text before its merges.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of the broadcast table, and rows it is learned from. They bound memory and time, never the result.
TABLE_SIZE, TABLE_ROWS = 65_536, 2_000
#: Entries of a worker's cache, and the longest pre-token that either keeps.
CACHE_SIZE, KEPT_LENGTH = 400_000, 64
#: Below this byte no UTF-8 text holds a code point on which Unicode versions differ (the first is U+0558).
_SETTLED = 0xD5


def _unsettled() -> re.Pattern:
    """Code points that this Python and the regex module sort into different classes:
    Unicode versions differ on them, so the tokenizer decides."""
    own, other = set(), set()
    letters = regex.compile(r"[\p{L}\p{N}]")
    for at in range(0x540, 0x110000, 0x1000):
        part = [chr(c) for c in range(at, min(at + 0x1000, 0x110000)) if not 0xD800 <= c < 0xE000]
        own |= {c for c in part if unicodedata.category(c)[0] in "LN"}
        other |= set(letters.findall("".join(part)))
    return re.compile("[" + "".join(sorted(own ^ other)) + "]") if own ^ other else re.compile(r"(?!)")


class TokenCounter:
    """Counts tokens of texts as the tokenizer's library does."""

    def __init__(self, path: str, table: dict[str, int] | None = None):
        self.table, self.cache, self.unsettled = table or {}, {}, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode, self.split = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], None
            return
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.encode = lambda texts: [len(library.encode(x, add_special_tokens=False).ids) for x in texts]
        conf = json.loads(library.to_str())
        added = conf.get("added_tokens", [])
        plain = (
            conf.get("normalizer") is None
            and conf.get("pre_tokenizer") == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            and not any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added)
        )
        self.split = regex.compile(PRE_TOKEN) if plain else None  # otherwise the library counts whole texts
        names = sorted((x["content"] for x in added), key=len, reverse=True)
        self.added, self.names = re.compile("|".join(map(re.escape, names)) or r"(?!)"), names

    def _missed(self, word: str) -> int:
        n = self.cache.get(word)
        if n is None:
            n = self.encode([word])[0]
            if len(word) <= KEPT_LENGTH:
                if len(self.cache) >= CACHE_SIZE:
                    self.cache.clear()
                self.cache[word] = n
        return n

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without added tokens."""
        return self.split.findall(text)

    def count(self, raw: bytes) -> int:
        if not raw:
            return 0
        text = raw.decode("utf-8")
        if self.split is None:
            return self.encode([text])[0]
        if np.frombuffer(raw, dtype=np.uint8).max() >= _SETTLED:
            self.unsettled = self.unsettled or _unsettled()
            if self.unsettled.search(text):
                return self.encode([text])[0]
        total, parts = 0, [text]
        if any(x in text for x in self.names):
            parts = self.added.split(text)
            total = len(parts) - 1
        get = self.table.get
        for part in parts:
            words = self.split.findall(part)
            known = list(map(get, words))
            if None in known:
                known = [self._missed(w) if n is None else n for w, n in zip(words, known, strict=True)]
            total += sum(known)
        return total


def frequent(docs: DataFrame, key: list[str], path: str, rows: int = TABLE_ROWS, size: int = TABLE_SIZE) -> dict[str, int]:
    """Lengths of the ``size`` most frequent pre-tokens of about ``rows`` texts (those
    whose key has the smallest hash). The table only saves time: a pre-token outside
    it is encoded."""
    if path.endswith(".model"):
        return {}
    own = docs.select(F.col("text").alias("t"), F.xxhash64(*key).alias("h"))
    edge = own.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if edge is None:
        return {}
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        found: Counter = Counter()
        for batch in pieces(batches):
            if counter.split is not None:
                for raw in as_bytes(batch.column(0)):
                    found.update(counter.split.findall(raw.decode("utf-8")))
        words = [w for w in found if len(w) <= KEPT_LENGTH]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([found[w] for w in words], pa.int64())], names=["w", "n"])

    top = own.where(F.col("h") <= F.lit(edge)).select("t").mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(size)
    words = [r["w"] for r in top.select("w").collect()]
    return dict(zip(words, TokenCounter(path).encode(words), strict=True)) if words else {}


def count_tokens(docs: DataFrame, carry: list[str], path: str, over: int = 1024) -> DataFrame:
    """``carry``, n_bytes, n_tokens and over_limit (more than ``over`` tokens), one row for each row.

    Counts are the library's, without begin, end or padding tokens and without
    truncation; the strings of special tokens inside a text count as the library's
    default has it. A null text counts as empty: 0 bytes, 0 tokens. Texts are taken
    whole; repeated rows are counted each; an empty table gives an empty result;
    only ``carry`` and text are read, so other columns cannot clash.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, carry, path))  # at most TABLE_SIZE entries of KEPT_LENGTH characters
    fields = docs.select(*carry).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path, table.value)
        for batch in pieces(batches):
            texts = as_bytes(batch.column(len(carry)))
            size, n = np.array([len(x) for x in texts], dtype=np.int64), np.array([counter.count(x) for x in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(size), pa.array(n), pa.array(n > over)], names=[*carry, "n_bytes", "n_tokens", "over_limit"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*carry, F.col("text").alias("_text")).mapInArrow(run, f"{kept}, n_bytes long, n_tokens long, over_limit boolean")
