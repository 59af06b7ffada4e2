"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of their bytes says so, so that copies of a
passage fall into the same chunks wherever they stand. A chunk is encoded once, as it
is, and kept by its digest. A cut through a word leaves two wrong encodings beside it:
the library encodes a window around the join anew, and the window grows until its
outermost words have the same ids as in the chunks on both sides.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Kept, as_bytes, pieces

#: Bytes that the rolling hash sees, and the mean length of a chunk (a power of two).
ROLLING, MEAN_CHUNK = 16, 2048
#: Bounds of the caches: chunks, the longest that is kept (bytes), words, and the longest word that is kept.
CHUNK_CACHE, KEPT_CHUNK, WORD_CACHE, KEPT_WORD = 4_096, 16_384, 500_000, 64
_RNG = np.random.default_rng(20240607)
#: A value for each byte, for the rolling hash.
_GEAR = _RNG.integers(0, 1 << 32, 256, dtype=np.uint64)


def cuts(data: bytes, mean: int = MEAN_CHUNK) -> list[int]:
    """Ends of the chunks of UTF-8 ``data``; a cut depends on the ROLLING bytes before it
    only, and is put off to the end of a code point that it would split."""
    if len(data) <= ROLLING:
        return [len(data)] if data else []
    gear = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    h = np.zeros(len(data) - ROLLING + 1, dtype=np.uint64)
    for k in range(ROLLING):
        h += gear[k : k + len(h)] << np.uint64(ROLLING - 1 - k)
    at = np.flatnonzero((h >> np.uint64(8)) % np.uint64(mean) == 0) + ROLLING
    more = (np.frombuffer(data, dtype=np.uint8) & 0xC0) == 0x80
    for _ in range(3):
        at = at[at < len(data)]
        at = at + more[at]
    return [*dict.fromkeys(at[at < len(data)].tolist()), len(data)]


class Encoder:
    """Encodes and decodes texts as the tokenizer's library does, by chunks.

    Ids belong to words if no token, normalisation or special token of the tokenizer
    spans ASCII white space; `safe` says whether that holds. If not, whole texts go to
    the library, as does a text in which a join finds no agreement.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        conf = json.loads(self.library.to_str())
        self.safe = self._splits_at_space(conf) and not conf.get("post_processor") and not conf.get("decoder")
        self.words = Kept(WORD_CACHE)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.digits = [str(i).encode() for i in range(size)]
        self.names = [(self.library.id_to_token(i) or "").encode() for i in range(size)]
        self.chunks = Kept(CHUNK_CACHE)
        #: Bytes of all texts, of chunks that were encoded, and of windows around joins.
        self.seen, self.encoded, self.repaired = 0, 0, 0

    @staticmethod
    def _splits_at_space(conf: dict) -> bool:
        first = conf.get("pre_tokenizer") or {}
        first = first["pretokenizers"][0] if first.get("type") == "Sequence" else first
        drops = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and r"[^\s" in first["pattern"].get("Regex", "")
        norm = conf.get("normalizer") or {}
        parts = norm.get("normalizers", [norm] if norm else [])
        known = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in parts)
        plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or any(c.isspace() for c in x["content"]) for x in conf.get("added_tokens", []))
        return bool(drops and known and plain)

    def _whole(self, text: str) -> tuple[int, bytes, bytes]:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return len(ids), " ".join(map(str, ids)).encode(), self.library.decode(ids, skip_special_tokens=False).encode()

    def _library(self, words: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """Encodings of words that follow each other, by one call."""
        texts = [w.decode("utf-8") for w in words]
        got = self.library.encode(" ".join(texts), add_special_tokens=False)
        ids, first = got.ids, [a for a, _ in got.offsets]
        ends = np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts])).tolist()
        out, at = [], 0
        for to in ends:
            own = ids[at:to]
            out.append((len(own), b" ".join([self.digits[i] for i in own]), b" ".join([self.names[i] for i in own])))
            at = to
        return out

    def _words(self, words: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """Encodings of words, of those that are not kept by one call."""
        got = list(map(self.words.young.get, words))
        if None in got:
            got = [self.words.get(w) if x is None else x for w, x in zip(words, got, strict=True)]
            missing = list(dict.fromkeys(w for w, x in zip(words, got, strict=True) if x is None))
            if missing:
                new = dict(zip(missing, self._library(missing), strict=True))
                for w, x in new.items():
                    if len(w) <= KEPT_WORD:
                        self.words.put(w, x)
                got = [new[w] if x is None else x for w, x in zip(words, got, strict=True)]
        return got

    def _chunk(self, data: bytes) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
        """The words of a chunk, cut ones at its ends as they are, and their encodings."""
        key = hashlib.blake2b(data, digest_size=16).digest()
        got = self.chunks.get(key)
        if got is None:
            words = data.split()
            got = words, self._words(words)
            self.encoded += len(data)
            if len(data) <= KEPT_CHUNK:
                self.chunks.put(key, got)
        return got

    def _repair(self, before: tuple[list, list], word: bytes, after: tuple[list, list]) -> bool:
        """Encodes ``word``, which a join cut, and the words around it anew, and puts what
        comes out into ``before``; False if no window agrees with both sides."""
        (words, parts), (next_words, next_parts) = before, after
        reach = 1
        while True:
            lo, hi = max(0, len(words) - reach), min(reach, len(next_words))
            window = [*words[lo:], word, *next_words[:hi]]
            got = self._library(window)
            self.repaired += sum(map(len, window))
            # at the beginning of the text there is nothing to agree with
            if (lo == 0 or got[0] == parts[lo]) and (not hi or got[-1] == next_parts[hi - 1]):
                k = len(words) - lo
                parts[lo:] = got[: k + 1]
                words.append(word)
                next_parts[:hi] = got[k + 1 :]
                return True
            if lo == 0 and hi == len(next_words):
                return False
            reach *= 2

    def encode(self, data: bytes) -> tuple[int, bytes, bytes]:
        """Tokens, their decimal ids joined by one space, and the decoded text."""
        if not self.safe:
            return self._whole(data.decode("utf-8"))
        self.seen += len(data)
        words, parts, cut_word, at = [], [], [], 0  # cut_word: pieces of a word that joins go through
        ends = cuts(data)
        for to in ends:
            new = self._chunk(data[at:to])
            new_words, new_parts = list(new[0]), list(new[1])
            if at and not SPACE[data[at - 1]] and not SPACE[data[at]]:
                if not cut_word:
                    cut_word.append(words.pop())
                    parts.pop()
                cut_word.append(new_words.pop(0))
                new_parts.pop(0)
            at = to
            goes_on = not new_words and to < len(data) and not SPACE[data[to - 1]] and not SPACE[data[to]]
            if cut_word and not goes_on:
                if not self._repair((words, parts), b"".join(cut_word), (new_words, new_parts)):
                    return self._whole(data.decode("utf-8"))
                cut_word = []
            words += new_words
            parts += new_parts
        parts = [x for x in parts if x[0]]
        return sum([x[0] for x in parts]), b" ".join([x[1] for x in parts]), b" ".join([x[2] for x in parts])


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder: tasks that follow each other share its caches."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_texts(docs: DataFrame, carry: list[str], path: str, ids: bool = True) -> DataFrame:
    """``carry``, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, the ids and the
    decoded text, one row for each row.

    As the library encodes with ``add_special_tokens=False``, without truncation or
    padding, and decodes with ``skip_special_tokens=False``. A null text counts as
    empty: no ids, and the digests of nothing. Texts are taken whole, repeated rows
    are encoded each, an empty table gives an empty result, and only ``carry`` and
    text are read, so other columns cannot clash.
    """
    fields = docs.select(*carry).schema
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in pieces(batches):
            got = [encoder.encode(x) for x in as_bytes(batch.column(len(carry)))]
            out = [pa.array([x[0] for x in got], pa.int64()), *(pa.array([hashlib.sha256(x[k]).hexdigest() for x in got], pa.string()) for k in (1, 2))]
            if ids:
                out += [pa.array([list(map(int, x[1].split())) for x in got], pa.list_(pa.int32())), pa.array([x[2].decode("utf-8") for x in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *out], names=[*carry, *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    more = ", ids array<int>, decoded string" if ids else ""
    return docs.select(*carry, F.col("text").alias("_text")).mapInArrow(run, f"{kept}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
