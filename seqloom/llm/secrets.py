"""Secret scans with multipart credential linking.

DataFrame functions only. Patterns find the parts of credentials in whole texts:
access identifiers, secrets and endpoints. Strong parts are reported as they are;
weak ones only if, by an interval join within the same document, the parts that
complete them stand within SCOPE code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Code points between the ends of two parts that may belong together.
SCOPE = 300
#: Kinds in order; the first three are strong. Pattern, role, and a text that every match holds.
KINDS: dict[str, tuple[str, str, str | None]] = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret", None),
    "access": (r"AKIA[A-Z0-9]{12,}", "ident", "AKIA"),
    "hex": (r"[0-9a-f]{32,}", "secret", None),
    "key": (r"(?<![A-Za-z0-9+/=_.-])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{24,}(?![A-Za-z0-9_.-])", "secret", None),
    "ident": (r"""(?i:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}""", "ident", None),
    "endpoint": (r"""[a-z][a-z0-9+]{1,9}://[A-Za-z0-9_.:@-]{4,}(?:/[A-Za-z0-9_./%-]*)?""", "endpoint", "://"),
}
STRONG = ("assign", "access", "hex")
_ORDER = {k: i for i, k in enumerate(KINDS)}
MIN_ASSIGNED = 8


def _parts(kind: str, text: str) -> Column:
    """The matches of a kind, leftmost and non-overlapping: kind, number, code points
    before it (since the match before), code points in it, and whether it counts."""
    pattern, _, needed = KINDS[kind]
    quoted = F.lit(pattern)
    found = F.col(f"_m_{kind}")
    gaps = F.split(F.col(text), pattern, -1)
    ok = F.regexp_extract_all(F.col(text), quoted, F.lit(2)) if kind == "assign" else found
    least = MIN_ASSIGNED if kind == "assign" else 0
    rows = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"), ok.alias("v")),
        lambda x, i: F.struct(F.lit(_ORDER[kind]).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), (F.length(x["v"]) >= least).alias("ok")),
    )
    return F.when(F.size(found) > 0, rows).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>"))


def _found(kind: str, text: str) -> Column:
    pattern, _, needed = KINDS[kind]
    all_ = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    return F.when(F.contains(F.col(text), F.lit(needed)), all_).otherwise(F.array().cast("array<string>")) if needed else all_


def _near(candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """The interval join: candidates (doc, kind, start, end) with near_<role> for each role:
    whether a part of that role has an end within SCOPE of one of the candidate's ends.

    Ends fall into buckets of SCOPE code points; of each bucket and role only the
    first and last end are kept, which decide the matter for the bucket itself and
    its neighbours, so that no pairs of parts are made.
    """
    ends = parts.select("doc", "key", "role", F.explode(F.array("start", "end")).alias("at"))
    bucket = F.floor(F.col("at") / SCOPE)
    bounds = ends.groupBy("doc", "key", bucket.alias("bucket"), "role").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    own = candidates.select("doc", "key", "kind", "start", "end", F.explode(F.array("start", "end")).alias("at"))
    own = own.select("*", F.explode(F.array(*(bucket + d for d in (-1, 0, 1)))).alias("bucket"))
    joined = own.join(bounds.withColumnsRenamed({"doc": "_d", "key": "_k", "bucket": "_b"}), F.col("doc").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")) & (F.col("bucket") == F.col("_b")))
    close = (F.abs(F.col("lo") - F.col("at")) <= SCOPE) | (F.abs(F.col("hi") - F.col("at")) <= SCOPE)
    roles = {r for _, r, _ in KINDS.values()}
    return joined.where(close).groupBy("doc", "key", "kind", "start", "end").agg(*(F.bool_or(F.col("role") == r).alias(f"near_{r}") for r in sorted(roles)))


def scan(docs: DataFrame, doc: str, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc`` and ``carry``, and spans: array of (start, kind, end), by start, then kind in
    the order of KINDS; one row for each row.

    A null text counts as empty and has no spans. Positions are code points, the end
    is exclusive. `key` is reported near an identifier or an endpoint, `ident` near a
    secret, `endpoint` near an identifier and a secret. Repeated rows get the same
    spans each; rows with the same id but other text are scanned apart; an empty table
    gives an empty result; other columns are not read.
    """
    base = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("_t"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    base = base.withColumns({f"_m_{k}": _found(k, "_t") for k in KINDS})
    parts = F.concat(*(_parts(k, "_t") for k in KINDS))
    base = cut(base.select("doc", F.xxhash64("_t").alias("key"), *(f"_c{i}" for i in range(len(carry))), parts.alias("parts")), "secrets")
    # identical rows have identical parts
    rows = base.where(F.size("parts") > 0).select("doc", "key", "parts").dropDuplicates(["doc", "key"]).select("doc", "key", F.inline("parts"))
    before = Window.partitionBy("doc", "key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("len")).over(before)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).where("ok").select("doc", "key", "kind", "start", "end")
    rows = cut(rows, "parts")
    role = F.array(*(F.lit(r) for _, r, _ in KINDS.values()))[F.col("kind")]
    strong = F.col("kind") < len(STRONG)
    kind = lambda k: F.col("kind") == _ORDER[k]
    weak = _near(rows.where(~strong), rows.withColumn("role", role)).where(
        kind("key") & (F.col("near_ident") | F.col("near_endpoint")) | kind("ident") & F.col("near_secret") | kind("endpoint") & F.col("near_ident") & F.col("near_secret")
    )
    kept = rows.where(strong).unionByName(weak.select(*rows.columns))
    name = F.array(*map(F.lit, KINDS))
    spans = kept.groupBy(F.col("doc").alias("_d"), F.col("key").alias("_k")).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))
    out = base.join(spans, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    none = F.array().cast("array<struct<start:bigint,kind:string,end:bigint>>")
    named = F.transform("s", lambda x: F.struct(x["start"].alias("start"), name[x["kind"]].alias("kind"), x["end"].alias("end")))
    return out.select(F.col("doc").alias(doc), *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)), F.col("key").alias("text_key"), F.coalesce(named, none).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def strong_only(spans: Column) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(*STRONG))


def redact(docs: DataFrame, doc: str, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; spans that overlap become one mark.

    Texts without spans and null texts stay as they are. Columns stay in number,
    order and name.
    """
    found = scan(docs, doc, text).where(F.size("spans") > 0)
    found = found.select(F.col(doc).alias("_d"), F.col("text_key").alias("_k"), F.col("spans").alias("_s")).dropDuplicates(["_d", "_k"])
    own = docs.join(found, docs[doc].eqNullSafe(F.col("_d")) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("_k")), "left")
    # merged spans: those that begin behind all ends before them
    ends = F.aggregate(
        "_s", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(docs[text], acc["at"].cast("int") + 1, (x["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
    )
    done = F.concat(ends["out"], F.substring(docs[text], ends["at"].cast("int") + 1, F.length(docs[text])))
    return own.select(*(F.when(F.col("_s").isNotNull(), done).otherwise(docs[text]).alias(c) if c == text else docs[c] for c in docs.columns))
