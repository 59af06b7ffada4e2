"""Language identification by words first, then by ever shorter character n-grams.

A known word scores by its log frequency in each language. A word that training has
not seen scores by its longest n-grams that training has seen: those of LONGEST
characters, else of one less, down to single characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, pieces

#: The classifier is fitted on about so many labelled texts of each language.
FIT_ROWS = 5_000
#: Longest n-gram; entries of the model for each language: words, and n-grams of each length.
LONGEST, WORDS, GRAMS = 5, 20_000, 8_000
#: Entries of a worker's cache of scores.
CACHE = 300_000
_LETTERS = re.compile(r"[^\W\d_]+")
#: Words of texts in the JVM, close enough to _LETTERS to learn from.
_LETTERS_JVM = r"\p{L}+"


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """crc32 of the id as text, mod ``folds``, is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def sample(train: DataFrame, key: str, lang: str, rows: int = FIT_ROWS) -> DataFrame:
    """About ``rows`` rows of each language that has more, else all: those whose key
    has a hash below the share that is wanted."""
    share = train.groupBy(F.col(lang).alias("l")).agg(F.least(F.lit(1.0), rows / F.count(F.lit(1))).alias("share"))
    spot = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    return train.join(F.broadcast(share), F.col(lang) == F.col("l")).where(spot < F.col("share")).drop("l", "share")  # a row for each language


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> dict:
    """The model: languages, and log frequencies of words and of n-grams by language.

    The counts are over all rows of ``train``; the model keeps the WORDS most frequent
    words of two occurrences or more and the GRAMS most frequent n-grams of each
    length for each language (ties by text), and so is bounded.
    """
    from pyspark.sql import Window

    words = train.select(F.col(lang).alias("l"), F.explode(F.expr(f"regexp_extract_all(lower({text}), '{_LETTERS_JVM.replace(chr(92), chr(92) * 2)}', 0)")).alias("w"))
    words = words.groupBy("l", "w").agg(F.count(F.lit(1)).alias("n"))
    # a long run of letters has n-grams as other words have, once for each of its places
    marked = words.select("l", "n", F.concat(F.lit("^"), "w", F.lit("$")).alias("w"))
    sizes = F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("k")
    grams = marked.select("l", "n", "w", sizes).where(F.length("w") >= F.col("k"))
    grams = grams.select("l", "n", "k", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - F.col("k") + 1), lambda i: F.substring("w", i, F.col("k")))).alias("w"))
    grams = grams.where(~F.col("w").isin("^", "$")).groupBy("l", "k", "w").agg(F.sum("n").alias("n"))

    def kept(df: DataFrame, most: int, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("n"), "w")
        total = df.groupBy(*by).agg(F.sum("n").alias("total"))
        top = df.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")
        return top.join(F.broadcast(total), list(by))  # a row for each language and length

    rows = kept(words.where("n >= 2").withColumn("k", F.lit(0)), WORDS, "l", "k").select("l", "k", "w", "n", "total")
    rows = rows.unionByName(kept(grams, GRAMS, "l", "k").select("l", "k", "w", "n", "total")).toPandas()
    langs = sorted(set(rows["l"]))
    model: dict = {"langs": langs, "index": [], "scores": []}
    place = {x: i for i, x in enumerate(langs)}
    for k in range(LONGEST + 1):
        own = rows[rows["k"] == k]
        names = {w: i for i, w in enumerate(dict.fromkeys(own["w"]))}
        totals = np.ones(len(langs))
        totals[own["l"].map(place)] = own["total"]
        smooth = totals + 0.5 * max(1, len(names))
        scores = np.tile(np.log(0.5 / smooth), (len(names), 1))
        at = own["l"].map(place).to_numpy(dtype=int)
        scores[own["w"].map(names).to_numpy(dtype=int), at] = np.log((own["n"].to_numpy(dtype=float) + 0.5) / smooth[at])
        model["index"].append(names)
        model["scores"].append(scores)
    return model


class Scorer:
    """Scores texts with a fitted model."""

    def __init__(self, model: dict):
        self.langs, self.index, self.scores = model["langs"], model["index"], model["scores"]
        self.cache: dict[str, np.ndarray] = {}
        self.none = np.zeros(len(self.langs))

    def unseen(self, w: str) -> np.ndarray:
        got = self.cache.get(w)
        if got is None:
            got = self.backed_off(w)
            if len(w) <= 40:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[w] = got
        return got

    def backed_off(self, w: str) -> np.ndarray:
        """The mean of the log frequencies of the longest known n-grams, over all of that length."""
        marked = f"^{w}$"
        for k in range(min(LONGEST, len(marked)), 0, -1):
            index = self.index[k]
            found = [x for i in range(len(marked) - k + 1) if (x := index.get(marked[i : i + k])) is not None]
            if found:
                return self.scores[k][found].mean(axis=0)
        return self.none

    def text(self, text: str) -> tuple[str, float]:
        words = Counter(_LETTERS.findall(text.lower()))
        words = {w: n for w, n in words.items() if w.isalpha() or any(map(str.isalpha, w))}  # not those of numerals alone
        if not words or not self.langs:
            return "und", 0.0
        at = list(map(self.index[0].get, words))
        known = [(i, n) for i, n in zip(at, words.values(), strict=True) if i is not None]
        total = np.zeros(len(self.langs))
        if known:
            rows, counts = zip(*known, strict=True)
            total += np.array(counts, dtype=float) @ self.scores[0][list(rows)]
        if len(known) < len(at):
            total += np.sum([n * self.unseen(w) for i, (w, n) in zip(at, words.items(), strict=True) if i is None], axis=0)
        best = int(np.argmax(total))  # ties: the first language by name
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, carry: list[str], model: dict, text: str = "text") -> DataFrame:
    """``carry``, lang_pred and score (the posterior of lang_pred under equal priors).

    `und` with score 0 for a null text, one without letters, or a model that has seen
    no language. Ties go to the language first by name. Texts are taken whole, repeated
    rows are judged each; only ``carry`` and the text are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS and GRAMS
    fields = docs.select(*carry).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in pieces(batches):
            got = [scorer.text(x.decode("utf-8")) for x in as_bytes(batch.column(len(carry)))]
            out = [pa.array([x[k] for x in got], t) for k, t in ((0, pa.string()), (1, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *out], names=[*carry, "lang_pred", "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*carry, F.col(text).alias("_text")).mapInArrow(run, f"{kept}, lang_pred string, score double")
