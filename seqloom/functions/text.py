"""Tokens, parsing, formatting, string search and suffix structures."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import BLOCK, neighbours, positions
from ..storage import cut

#: Fixed value: white space of tokens.
SPACES = r"[ \f\n\r\t\x0B]+"


def tokens(text: Column | str) -> Column:
    """Array of the maximal runs of non-space."""
    return F.filter(F.split(text, SPACES), lambda x: x != "")


def map_tokens(text: Column | str, f) -> Column:
    return F.transform(tokens(text), f)


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): a-z runs of the lower-cased texts, all other characters being spaces.

    Only A-Z are lower-cased, so that results do not hang on Unicode tables.
    """
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = df.select(F.explode(F.split(low, "[^a-z]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def line_word_byte_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: lines (line feeds), words and bytes of all texts."""
    return df.agg(
        F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))).alias("lines"), F.sum(F.size(tokens(text)).cast("long")).alias("words"), F.sum(F.octet_length(text).cast("long")).alias("bytes")
    )


def to_integer(text: Column | str, signed: bool = True) -> Column:
    """The integer at the start of a text: an optional sign and digits; null without digits or beyond 64 bits."""
    return F.regexp_extract(text, r"^([+-]?\d+)" if signed else r"^(\d+)", 1).try_cast("bigint")


def to_float(text: Column | str) -> Column:
    """The number at the start of a text; `.` and `,` are decimal points."""
    return F.regexp_extract(F.replace(F.col(text) if isinstance(text, str) else text, F.lit(","), F.lit(".")), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def format_value(c: Column, kind: str) -> Column:
    """Text of a value: booleans 1/0, doubles with 11 digits after the point, arrays in brackets, pairs in parentheses."""
    if kind == "boolean":
        return F.when(c, "1").otherwise("0")
    if kind in ("double", "float"):
        return F.format_string("%.11e", c.cast("double"))
    if kind.startswith("array"):
        return F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))
    if kind.startswith("struct"):
        inner = c.cast("string")
        return F.concat(F.lit("("), F.substring(inner, F.lit(2), F.length(inner) - 2), F.lit(")"))
    return c.cast("string")


def find_all(text: Column, pattern: str) -> Column:
    """Array of the offsets (from 0) of every occurrence, overlaps included; of an empty pattern, none.

    The text is cut before every occurrence; the lengths of the pieces add up to the offsets.
    """
    none = F.array().cast("array<int>")
    if not pattern:
        return none
    sizes = F.transform(F.split(text, f"(?=\\Q{pattern}\\E)", -1), lambda x: F.length(x))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    ends = F.aggregate(sizes, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out")))["out"]
    inner = F.slice(ends, F.lit(1), F.size(ends) - 1)
    return F.when(F.startswith(text, F.lit(pattern)), F.concat(F.array(F.lit(0)), inner)).otherwise(inner)


def edit_distance(a: Column, b: Column) -> Column:
    """Insertions and deletions (no substitutions) that turn ``a`` into ``b``."""
    return _indel(a, b)


@F.pandas_udf(T.IntegerType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str | None, y: str | None) -> int | None:
        if x is None or y is None:
            return None
        # bits of `row` are the positions of y where the longest common subsequence does not grow
        at: dict[str, int] = {}
        for i, c in enumerate(y):
            at[c] = at.get(c, 0) | 1 << i
        full = (1 << len(y)) - 1
        row = full
        for c in x:
            hit = row & at.get(c, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(x) + len(y) - 2 * (len(y) - row.bit_count())

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def suffix_array(seq: DataFrame) -> DataFrame:
    """(rank, pos): the suffixes of a sequence (pos, val) in order, by prefix doubling.

    A round ranks positions by the pair of ranks of the two halves; it takes log2 of
    the longest repeat in rounds, less those that packed values save (see `_levels`).
    """
    return _levels(seq)[0][-1][1].select("rank", "pos")


def _levels(seq: DataFrame) -> tuple[list[tuple[int, DataFrame]], DataFrame | None, int, int]:
    """The rounds of prefix doubling, as (size, (pos, rank) by the next ``size`` values), the last with all
    ranks different; packed words (pos, hi, lo), the bits of a value in them and the values of each.

    With few different values the first round packs a power of two of them into each of two words.
    Where two positions of a level have one rank, as many values follow both: what ends before has a
    length, so a rank, of its own.
    """
    n, state, step = seq.count(), cut(dense_rank(seq.select("pos", F.struct("val").alias("key"))), "ranks"), 1
    top = lambda df: (df.agg(F.max("rank")).first()[0] or 0) + 1
    found = top(state)
    bits = found.bit_length()
    width, words = 1 << (62 // bits).bit_length() - 1, None
    if width > 1 and n > 1:
        words, step = cut(_words(state, bits, width), "words"), 2 * width
        state = cut(dense_rank(words.select("pos", F.struct("hi", "lo").alias("key"))), "ranks")
        found = top(state)
    levels = [(step, state)]
    while found < n:
        right = state.select((F.col("pos") - step).alias("pos"), F.col("rank").alias("r2"))
        pairs = state.join(right, "pos", "left").select("pos", F.struct("rank", F.coalesce("r2", F.lit(-1)).alias("r2")).alias("key"))
        state, step = cut(dense_rank(pairs), "ranks"), step * 2
        found = top(state)
        levels.append((step, state))
    return levels, words, bits, width


def _words(ranked: DataFrame, bits: int, width: int) -> DataFrame:
    """(pos, hi, lo): the next ``width`` ranks (each and one) and as many after them, packed; 0 after the end.

    Blocks of positions are packed by themselves, with the values that follow them.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(pdf["block"].iloc[0]) * BLOCK
        code = np.zeros(BLOCK + 2 * width, dtype=np.int64)
        at = pdf["pos"].to_numpy() - base
        code[at] = pdf["rank"].to_numpy() + 1
        word = np.zeros(BLOCK + width, dtype=np.int64)
        for k in range(width):
            word = (word << bits) | code[k : k + BLOCK + width]
        at = np.sort(at[at < BLOCK])
        return pd.DataFrame({"pos": at + base, "hi": word[at], "lo": word[at + width]})

    block = F.floor(F.col("pos") / BLOCK)
    near = F.array(block, F.floor((F.col("pos") - 2 * width + 1) / BLOCK))  # the block before needs a block's first values
    rows = ranked.select("pos", "rank", F.explode(F.array_distinct(near)).alias("block")).where("block >= 0")
    return rows.groupBy("block").applyInPandas(run, "pos long, hi long, lo long")


def dense_rank(keyed: DataFrame) -> DataFrame:
    """(pos, rank): the number of smaller different keys, without a window over all rows."""
    ranks = positions(keyed.select("key").distinct(), "key").select("key", F.col("pos").alias("rank"))
    return keyed.join(ranks, "key").select("pos", "rank")


def lcp(seq: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """(rank, pos, prev, lcp): for each suffix but the first, the length it shares with the one before.

    The rounds of prefix doubling have ranks of blocks, and equal ranks mean equal blocks;
    from the longest blocks down a pair takes those that agree, and the rest of it from packed words.
    ``suffixes`` (rank, pos) are those of the last round, if not given.
    """
    levels, words, bits, width = _levels(seq)
    own = neighbours((levels[-1][1] if suffixes is None else suffixes).select(F.col("rank").alias("pos"), F.col("pos").alias("val")), "val").where("prev_val is not null")
    pairs = cut(own.select(F.col("pos").alias("rank"), F.col("val").alias("a"), F.col("prev_val").alias("b"), F.lit(0).cast("long").alias("lcp")), "lcp")

    def grown(x: DataFrame, more) -> DataFrame:
        cols = [c for c in x.columns if c != "pos"]
        left, right = (x.select(F.col("pos").alias(f"p{e}"), *(F.col(c).alias(f"{e}_{c}") for c in cols)) for e in ("a", "b"))
        got = pairs.withColumns({"pa": F.col("a") + F.col("lcp"), "pb": F.col("b") + F.col("lcp")}).join(left, "pa", "left").join(right, "pb", "left")
        return cut(got.select("rank", "a", "b", (F.col("lcp") + F.coalesce(more, F.lit(0))).alias("lcp")), "lcp")

    for size, ranks in levels[-2::-1]:
        pairs = grown(ranks, F.when(F.col("a_rank") == F.col("b_rank"), size))
    if words is not None:
        same = lambda c: width - F.ceil(F.length(F.bin(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}")))) / bits)
        rest = F.when(F.col("a_hi") != F.col("b_hi"), same("hi")).when(F.col("a_lo") != F.col("b_lo"), width + same("lo"))
        pairs = grown(words, rest)
    return pairs.select("rank", F.col("a").alias("pos"), F.col("b").alias("prev"), "lcp")


def longest_repeat(seq: DataFrame) -> DataFrame:
    """One row: length, and the two starts, of the longest repeated run of elements (of
    several the first in suffix order)."""
    shared = lcp(seq)
    return shared.agg(F.max_by(F.struct("lcp", "prev", "pos"), F.struct("lcp", -F.col("rank"))).alias("m")).select(F.col("m.lcp").alias("length"), F.least("m.prev", "m.pos").alias("first"), F.greatest("m.prev", "m.pos").alias("second"))


def contains(seq: DataFrame, pattern: DataFrame) -> DataFrame:
    """One row: the first position of the pattern in the suffix tree's sequence, -1 if absent."""
    from ..operators.ordered import occurrences

    return occurrences(seq, pattern).agg(F.coalesce(F.min("pos"), F.lit(-1)).alias("pos"))


def suffix_tree(seq: DataFrame) -> DataFrame:
    """(node, parent, depth) of the inner nodes of the suffix tree, by the Cartesian tree
    of the lengths that neighbours share; nodes with their parent's depth are one."""
    shared = lcp(seq).select(F.col("rank").alias("pos"), F.col("lcp").alias("val"))
    return cartesian_tree(shared).select(F.col("pos").alias("node"), "parent", F.col("val").alias("depth"))


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's nearest smaller elements within it (on the left: or equal), and which of its elements are
    minima of all before them, or of all after them: other blocks can find only those."""
    pdf = pdf.sort_values("pos")
    pos, val = pdf["pos"].tolist(), pdf["val"].tolist()
    left, right, stack = [-1] * len(pos), [-1] * len(pos), []
    for i, v in enumerate(val):
        while stack and val[stack[-1]] > v:
            right[stack.pop()] = i
        left[i] = stack[-1] if stack else -1
        stack.append(i)
    pos, val, left, right = pdf["pos"].to_numpy(), pdf["val"].to_numpy(), np.array(left), np.array(right)
    last = np.ones(len(pos), dtype=bool)
    last[:-1] = val[:-1] < np.minimum.accumulate(val[::-1])[::-1][1:]
    out = pd.DataFrame({"block": pdf["block"].to_numpy(), "pos": pos, "val": val})
    for side, at in (("l", left), ("r", right)):
        out[side], out[f"{side}val"] = pd.array(np.where(at < 0, 0, pos[at]), dtype="Int64"), pd.array(np.where(at < 0, 0, val[at]), dtype="Int64")
        out.loc[at < 0, [side, f"{side}val"]] = pd.NA
    out["first"], out["last"] = left < 0, last
    # an equal element on the left is the parent, whatever is on the right
    out["asks"] = (left < 0) | ((right < 0) & (val[left] < val))
    return out


def _nearest(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """For the elements that ask a block on one side, the nearest of its minima that is smaller."""
    if not len(own) or not len(found):
        return pd.DataFrame({"pos": [], "side": [], "at": [], "atval": []})
    found = found.sort_values("pos")
    val, v = found["val"].to_numpy(), own["val"].to_numpy()
    k = np.searchsorted(-val, -v, side="right") if own["side"].iloc[0] == "r" else np.searchsorted(val, v, side="right") - 1
    return pd.DataFrame({"pos": own["pos"].to_numpy(), "side": own["side"].to_numpy(), "at": found["pos"].to_numpy()[k], "atval": val[k]})


def cartesian_tree(seq: DataFrame) -> DataFrame:
    """(pos, val, parent): the tree with its minimum on top; the root is its own parent.

    The parent is the larger of the nearest values on both sides that are smaller (on
    the left: or equal); on ties the right one. Blocks of consecutive positions are walked with a
    stack, each by itself. An element without a smaller one in its block finds the next block with
    one by the blocks' minima (a row for each block), and asks there; no task holds more than a
    block and as many elements that ask it.
    """
    own = seq.select(F.floor(F.col("pos") / BLOCK).alias("block"), F.col("pos").cast("long").alias("pos"), F.col("val").cast("long").alias("val"))
    schema = "block long, pos long, val long, l long, lval long, r long, rval long, first boolean, last boolean, asks boolean"
    walked = cut(own.groupBy("block").applyInPandas(_walk, schema), "walked")
    rows = walked.groupBy("block").agg(F.min("val").alias("m")).orderBy("block").collect()
    blocks, least = np.array([r["block"] for r in rows], dtype=np.int64), np.array([r["m"] for r in rows], dtype=np.int64)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b, part in pdf.groupby("block"):
                i = int(np.searchsorted(blocks, b))
                for side, mins, names in (("l", least[:i][::-1], blocks[:i][::-1]), ("r", least[i + 1 :], blocks[i + 1 :])):
                    open_ = part[part[side].isna()]
                    v = open_["val"].to_numpy()
                    k = np.searchsorted(-np.minimum.accumulate(mins), -v, side="left" if side == "l" else "right") if len(mins) else np.zeros(len(v), dtype=int)
                    hit = k < len(mins)
                    yield pd.DataFrame({"block": names[k[hit]] if len(mins) else [], "side": side, "pos": open_["pos"].to_numpy()[hit], "val": v[hit]})

    asked = cut(walked.where("asks").select("block", "pos", "val", "l", "r").mapInPandas(ask, "block long, side string, pos long, val long"), "asked")
    groups = asked.groupBy("block", "side").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("groups"))
    asked = asked.join(groups, ["block", "side"]).withColumn("group", F.pmod(F.xxhash64("pos"), F.col("groups"))).drop("groups")
    minima = walked.where("first or last").select("block", "pos", "val", F.explode(F.array(F.when(F.col("last"), "l"), F.when(F.col("first"), "r"))).alias("side")).where("side is not null")
    minima = minima.join(groups, ["block", "side"]).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")
    key = ["block", "side", "group"]
    found = asked.groupBy(key).cogroup(minima.groupBy(key)).applyInPandas(_nearest, "pos long, side string, at long, atval long")
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    found = found.groupBy("pos").agg(side("l", "at").alias("fl"), side("l", "atval").alias("flval"), side("r", "at").alias("fr"), side("r", "atval").alias("frval"))
    joined = walked.where("asks").join(found, "pos", "left").select("pos", "val", *(F.coalesce(c, f"f{c}").alias(c) for c in ("l", "lval", "r", "rval")))
    whole = walked.where("not asks").select(joined.columns).unionByName(joined)
    right = F.col("r").isNotNull() & (F.col("l").isNull() | (F.col("rval") >= F.col("lval")))
    return whole.select("pos", "val", F.when(right, F.col("r")).otherwise(F.coalesce("l", "pos")).alias("parent"))


def huffman_lengths(weights: DataFrame) -> DataFrame:
    """(symbol, length): code lengths of an optimal prefix code for (symbol, weight).

    An alphabet is merged in one task; ties go to the earlier symbol.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches) or [pd.DataFrame({"symbol": [], "weight": []})]).sort_values("symbol")
        depth = dict.fromkeys(pdf["symbol"], 0)
        queue = [(w, i, [s]) for i, (s, w) in enumerate(zip(pdf["symbol"], pdf["weight"], strict=True))]
        heapq.heapify(queue)
        n = len(queue)
        while len(queue) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(queue), heapq.heappop(queue)
            for s in x + y:
                depth[s] += 1
            heapq.heappush(queue, (a + b, n, x + y))
            n += 1
        yield pd.DataFrame({"symbol": list(depth), "length": list(depth.values())}, columns=["symbol", "length"])

    return weights.select("symbol", F.col("weight").cast("double").alias("weight")).coalesce(1).mapInPandas(run, "symbol string, length int")
