"""Quality rules judged by document and by host.

Each document's text is measured once (`measure`); rule failures are summed by
host, the hosts' failure rates of each rule are shrunk with a beta prior fitted to all
hosts, and the hosts' verdicts are joined back: a host that mostly fails goes whole,
and a rule that a document fails rejects it where its host is worse than others by
that rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, as_bytes, cut, groups, mix, pieces, word_hashes

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
WINDOW = 5
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of flags over the ranges between consecutive ``first``."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def _repeats(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By text: words that lie in a window of WINDOW words that its text has twice or more."""
    out = np.zeros(len(counts), dtype=np.int64)
    if len(h) < WINDOW:
        return out
    text = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    whole = text[: len(h) - WINDOW + 1] == text[WINDOW - 1 :]
    w = text[: len(whole)].astype(np.uint64)
    for k in range(WINDOW):
        w = mix(w * np.uint64(0x100000001B3) + h[k : k + len(whole)])
    at = np.flatnonzero(whole)
    order = at[np.argsort(w[at], kind="stable")]
    same = w[order][1:] == w[order][:-1]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    step = np.zeros(len(h) + 1, dtype=np.int64)
    step[order[twice]] += 1
    np.subtract.at(step, order[twice] + WINDOW, 1)
    first = np.concatenate(([0], np.cumsum(counts)))
    return _per_text(np.cumsum(step[:-1]) > 0, first)


def _duplicate_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measure_texts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of UTF-8 texts."""
    out: dict[str, list[np.ndarray]] = {k.split()[0]: [np.empty(0, dtype=np.int64)] for k in FEATURES.split(", ")}
    for a, b in groups(texts):
        own = texts[a:b]
        first = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64)
        buf = np.frombuffer(b"".join(own), dtype=np.uint8)
        h, counts = word_hashes(own, fold=False)
        out["n_words"].append(counts)
        out["word_chars"].append(_per_text(~SPACE[buf] & ((buf & 0xC0) != 0x80), first))
        out["n_symbols"].append(_per_text(_SYMBOL[buf], first))
        out["n_dup_lines"].append(np.array([_duplicate_lines(x) for x in own], dtype=np.int64))
        out["n_repeat_words"].append(_repeats(h, counts))
    return {k: np.concatenate(v) for k, v in out.items()}


def measure(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """``carry`` and the measures of every whole text, one row for each row.

    A null text has the measures of an empty one, all 0. Words are
    ``[^\\x20\\x09-\\x0D]+``; code points count in word_chars; a line equals an
    earlier one byte for byte; repeated words lie in windows of five words that the same
    text has twice or more, compared as they stand.
    """
    fields = docs.select(*carry).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            got = measure_texts(as_bytes(batch.column(len(carry))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *(pa.array(v) for v in got.values())], names=[*carry, *got])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*carry, F.col(text)).mapInArrow(run, f"{kept}, {FEATURES}")


def base_failed(min_words: int = 10, repeat_percent: int = 20) -> Column:
    """The rule on a document alone: too few words, or too many repeated ones."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def rules() -> dict[str, Column]:
    """The rules whose failures count against a host. Those after the first reject a
    document only where its host fails them more than others do."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "base": base_failed(),
        "symbols": 100 * F.col("n_symbols") > 10 * n,
        "lines": 10 * F.col("n_dup_lines") > n,
        "length": (F.col("word_chars") > 20 * n) | (F.col("word_chars") < 2 * n),
    }


#: The standard normal quantile of the probability that a host must be worse with: 0.8.
CERTAIN_Z = 0.8416212335729143
#: A host goes as a whole if more than this share of its documents fail any rule.
MOST_FAILED = 0.5


def host_verdicts(measured: DataFrame, host: str, certain_z: float = CERTAIN_Z, most_failed: float = MOST_FAILED) -> DataFrame:
    """By host (null is a host of its own): host_docs, host_rate (of documents that fail
    any rule, shrunk), worse_<rule> for each rule but the first, and host_kept.

    For each rule, and for all together, the prior is the beta distribution with the
    mean and variance of the hosts' rates (method of moments, each host counted once);
    where the hosts differ little beyond chance, it weighs as all documents of an
    average host. A host is worse by a rule if its posterior rate exceeds the prior's
    mean with the probability of ``certain_z`` (0.8; by the normal approximation), and
    is not kept if its rate of any failure so exceeds ``most_failed``.
    """
    flags = {k: v.cast("long") for k, v in rules().items()}
    flags["any"] = F.greatest(*flags.values())
    hosts = measured.groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), *(F.sum(v).alias(f"n_{k}") for k, v in flags.items()))
    fits = [F.avg("host_docs").alias("typical")]
    for k in flags:
        rate = F.col(f"n_{k}") / F.col("host_docs")
        noise = F.avg(rate * (1 - rate) / F.col("host_docs"))
        fits += [F.avg(rate).alias(f"m_{k}"), (F.coalesce(F.var_pop(rate), F.lit(0.0)) - noise).alias(f"s_{k}")]
    out = hosts.crossJoin(F.broadcast(hosts.agg(*fits)))  # the priors are one row
    for k in flags:
        m, spread = F.col(f"m_{k}"), F.col(f"s_{k}")
        weight = F.when(spread > 1e-9, F.least(m * (1 - m) / spread - 1, F.col("typical"))).otherwise(F.col("typical"))
        out = out.withColumn(f"w_{k}", F.greatest(weight, F.lit(1.0)))
        out = out.withColumn(f"r_{k}", (F.col(f"n_{k}") + m * F.col(f"w_{k}")) / (F.col("host_docs") + F.col(f"w_{k}")))
        out = out.withColumn(f"e_{k}", F.sqrt(F.col(f"r_{k}") * (1 - F.col(f"r_{k}")) / (F.col("host_docs") + F.col(f"w_{k}") + 1)))
    worse = [(F.col(f"r_{k}") - F.col(f"m_{k}") > certain_z * F.col(f"e_{k}")).alias(f"worse_{k}") for k in list(rules())[1:]]
    kept = F.col("r_any") - most_failed <= certain_z * F.col("e_any")
    return out.select(host, "host_docs", F.col("r_any").alias("host_rate"), *worse, kept.alias("host_kept"))


def judge(docs: DataFrame, carry: list[str], host: str = "source", text: str = "text", certain_z: float = CERTAIN_Z, most_failed: float = MOST_FAILED) -> DataFrame:
    """``carry`` with the measures, base_failed, host_rate and kept, one row for each row.

    kept is false if the document fails the base rule; else if its host is not kept; else
    if it fails a rule by which its host is worse (`host_verdicts`). Nulls: a null text
    fails (no words); a null host is a host of its own. Texts are measured whole, however
    long. Repeated rows are judged and counted each. An empty table gives an empty
    result. Only ``carry``, the host and the text are read, so other columns cannot clash.
    """
    own = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)), F.col(host).alias("_host"), F.col(text).alias("_text"))
    names = [f"_c{i}" for i in range(len(carry))]
    measured = cut(measure(own, [*names, "_host"], "_text"), "quality")
    hosts = host_verdicts(measured, "_host", certain_z, most_failed).withColumnRenamed("_host", "_h")
    joined = measured.join(hosts, F.col("_host").eqNullSafe(F.col("_h")), "left")
    confirmed = F.lit(False)
    for k, fails in list(rules().items())[1:]:
        confirmed = confirmed | (fails & F.col(f"worse_{k}"))
    return joined.select(
        *(F.col(n).alias(c) for n, c in zip(names, carry, strict=True)), *(k.split()[0] for k in FEATURES.split(", ")), base_failed().alias("base_failed"),
        (~base_failed() & F.col("host_kept") & ~confirmed).alias("kept"), "host_rate",
    )


def sql(table: str = "documents") -> str:
    """The rows of ``judge`` by doc_id, without host_rate, as DuckDB SQL."""
    fail = {"symbols": "100 * n_symbols > 10 * n", "lines": "10 * n_dup_lines > n", "length": "word_chars > 20 * n OR word_chars < 2 * n", "base": "base_failed"}
    names = ["base", "symbols", "lines", "length"]  # those of `rules`, which needs a session
    flags = ", ".join(f"CAST({fail[k]} AS BIGINT) AS f_{k}" for k in names)
    every = [*names, "any"]
    sums = ", ".join(f"CAST(sum(f_{k}) AS BIGINT) AS c_{k}" for k in every)
    fits = ", ".join(f"avg(c_{k} / docs) AS m_{k}, var_pop(c_{k} / docs) - avg(c_{k} / docs * (1 - c_{k} / docs) / docs) AS s_{k}" for k in every)
    weights = ", ".join(f"greatest(CASE WHEN s_{k} > 1e-9 THEN least(m_{k} * (1 - m_{k}) / s_{k} - 1, typical) ELSE typical END, 1.0::DOUBLE) AS w_{k}" for k in every)
    rates = ", ".join(f"(c_{k} + m_{k} * w_{k}) / (docs + w_{k}) AS r_{k}" for k in every)
    errors = ", ".join(f"sqrt(r_{k} * (1 - r_{k}) / (docs + w_{k} + 1)) AS e_{k}" for k in every)
    confirmed = " OR ".join(f"(f_{k} = 1 AND r_{k} - m_{k} > {CERTAIN_Z}::DOUBLE * e_{k})" for k in names[1:])
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM {table}),
 w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
 g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS k FROM (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM w))),
 r AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM g, generate_series(0, {WINDOW - 1}) x(j) WHERE k > 1 GROUP BY 1),
 l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
 m AS (SELECT rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
 coalesce(n_repeat_words, 0) AS n_repeat_words FROM w JOIN l USING (rid) LEFT JOIN r USING (rid)),
 b AS (SELECT *, greatest(n_words, 1) AS n, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
 f0 AS (SELECT *, {flags} FROM b), f AS (SELECT *, greatest({", ".join("f_" + k for k in names)}) AS f_any FROM f0),
 h AS (SELECT source, CAST(count(*) AS DOUBLE) AS docs, {sums} FROM f GROUP BY 1), p AS (SELECT avg(docs) AS typical, {fits} FROM h),
 hw AS (SELECT *, {weights} FROM h, p), hr AS (SELECT *, {rates} FROM hw), he AS (SELECT *, {errors} FROM hr)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND r_any - {MOST_FAILED}::DOUBLE <= {CERTAIN_Z}::DOUBLE * e_any AND NOT ({confirmed}) AS kept FROM f JOIN he ON f.source IS NOT DISTINCT FROM he.source"""
