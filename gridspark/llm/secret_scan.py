"""Secret scans by multipart credential linking, with DataFrame functions only.

Base findings (assignments, access identifiers, long hexadecimal strings) always count. Weak candidates (identifiers, short or
opaque values, endpoints) are ordinary text by themselves; one is reported only if a complementary part starts within ``SCOPE``
code points of its own start: a secret for an identifier or an endpoint, an identifier or an endpoint for a secret.

The link is an interval join: starts fall into buckets as wide as the scope, an index holds the first and the last start of each
role per bucket, is copied to the neighbouring buckets, and meets the candidates in a semi-join on (text, bucket, role). Nothing
is paired with everything, and a text full of parts gives one index row per bucket and role.

Texts are keyed by two 64-bit hashes, so copies are linked once, and only texts with a finding pass a shuffle.

Defined results: a null or empty text has no findings. Spans count code points, the end excluded. Repeated rows get equal results.
Input columns named like an output are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small, table

#: Starts of complementary parts are no further apart than this.
SCOPE = 256
_ASSIGNED = r"""["']?\x20*[:=]\x20*["']?"""


@dataclass(frozen=True)
class Kind:
    """A kind of part: its pattern, what a match must also fulfil, a plain text one of which a text must hold to be searched."""

    name: str
    role: str  # secret or locator
    pattern: str
    base: bool = False
    value: int = 0  # least length of the first group, if any
    length: int = 0  # exact length, if any
    mixed: bool = False  # has upper-case and lower-case letters and digits
    holds: tuple[str, ...] = ()


#: In the order in which spans with the same start are listed.
KINDS = (
    Kind("assign", "secret", rf"(?i:password|passwd|secret|token|api_?key){_ASSIGNED}([A-Za-z0-9+/_.=-]+)", base=True, value=8),
    Kind("access", "locator", r"AKIA[A-Z0-9]{12,}", base=True, holds=("AKIA",)),
    Kind("hex", "secret", r"[0-9a-f]{32,}", base=True),
    Kind("id", "locator", rf"(?i:access_?key_?id|client_?id|user_?name|user|login){_ASSIGNED}([A-Za-z0-9+/_.@=-]+)", value=4, holds=("=", ":")),
    Kind("temporary", "locator", r"(?:ASIA|AIDA|AROA|AGPA)[A-Z0-9]{8,}", holds=("ASIA", "AIDA", "AROA", "AGPA")),
    Kind("value", "secret", rf"(?i:pass_?phrase|pass_?word|passwd|pass|pwd|private_?key|secret|token|api_?key|auth){_ASSIGNED}([A-Za-z0-9+/_.=-]+)", value=4, holds=("=", ":")),
    Kind("opaque", "secret", r"[A-Za-z0-9+/]{40,}", length=40, mixed=True),
    Kind("endpoint", "locator", r"""(?:https?|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp|s3|ftp)://[^\x20\x09-\x0D"'<>]+""", holds=("://",)),
    Kind("host", "locator", rf"(?i:host|end_?point|server){_ASSIGNED}([A-Za-z0-9_.:/-]+)", value=4, holds=("=", ":")),
)


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with _k1 and _k2, hashes of the text (null as empty)."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumns({"_k1": F.xxhash64(t), "_k2": F.xxhash64(F.lit(1), t)})


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _searched(kind: Kind, text: Column) -> Column:
    """Whether a text has matches; the cheap test for plain text comes first."""
    found = text.rlike(kind.pattern)
    return _any([F.contains(text, F.lit(x)) for x in kind.holds]) & found if kind.holds else found


def parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(_k1, _k2, kind, start, end, base, role)`` of every match that fulfils its kind, of each distinct text.

    A text is split at the matches: what lies between, with the matches' lengths, adds up to their places.
    """
    t = F.col("_text")
    found = [F.when(_searched(k, t), F.struct(F.lit(i).alias("kind"), F.transform(F.split(t, k.pattern, -1), F.length).alias("gaps"), F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0)).alias("hits"))) for i, k in enumerate(KINDS)]
    rows = docs.select("_k1", "_k2", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")).select("_k1", "_k2", F.array_compact(F.array(*found)).alias("found"))
    rows = rows.where(F.size("found") > 0).dropDuplicates(["_k1", "_k2"])
    each = rows.select("_k1", "_k2", F.explode("found").alias("f")).select("_k1", "_k2", F.col("f.kind").alias("kind"), F.posexplode(F.arrays_zip("f.gaps", "f.hits")).alias("at", "p"))
    each = each.select("_k1", "_k2", "kind", "at", F.col("p.gaps").alias("gap"), F.col("p.hits").alias("hit")).where("hit is not null")
    order = "partition by _k1, _k2, kind order by at rows unbounded preceding"
    each = each.withColumn("end", F.expr(f"sum(gap + length(hit)) over ({order})")).withColumn("start", F.col("end") - F.length("hit"))
    fits = F.lit(False)
    for i, k in enumerate(KINDS):
        ok = F.lit(True)
        if k.value:
            ok = ok & (F.length(F.regexp_extract("hit", k.pattern, 1)) >= k.value)
        if k.length:
            ok = ok & (F.length("hit") == k.length)
        if k.mixed:
            ok = ok & F.col("hit").rlike("[A-Z]") & F.col("hit").rlike("[a-z]") & F.col("hit").rlike("[0-9]")
        fits = F.when(F.col("kind") == i, ok).otherwise(fits)
    pick = lambda values: F.array(*map(F.lit, values))[F.col("kind")]
    return each.where(fits).select("_k1", "_k2", "kind", "start", "end", pick([k.base for k in KINDS]).alias("base"), pick([k.role for k in KINDS]).alias("role"))


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Base parts, and weak ones with a complementary part in scope."""
    bucket = F.floor(F.col("start") / scope)
    index = found.withColumn("bucket", bucket).groupBy("_k1", "_k2", "bucket", "role").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    index = index.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("b"), F.col("role").alias("r"), "low", "high")
    weak = found.where("not base").withColumn("bucket", bucket)
    near = (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")) & (F.col("bucket") == F.col("b")) & (F.when(F.col("role") == "secret", "locator").otherwise("secret") == F.col("r"))
    linked = weak.join(index, near & (F.col("high") >= F.col("start") - scope) & (F.col("low") <= F.col("start") + scope), "left_semi").drop("bucket")
    return found.where("base").union(linked)


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def find(spark: SparkSession, docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per distinct text with a finding: ``_k1, _k2`` and ``found``, its spans (start, kind, end) in order."""
    seen = Scratch(spark, "secrets").write(parts(keyed(docs, text), text), "parts")
    return link(seen, scope).groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))


def scan(spark: SparkSession, docs: DataFrame, text: str = "text", keep: list[str] | None = None, scope: int = SCOPE) -> DataFrame:
    """``keep`` columns with n_assign, n_access, n_hex, base_sha256 and spans."""
    added = {"n_assign", "n_access", "n_hex", "base_sha256", "spans", "_k1", "_k2", "found"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    rows = keyed(docs, text).select(*(F.col(f"`{c}`") for c in keep), "_k1", "_k2")
    out = rows.join(find(spark, docs, text, scope), ["_k1", "_k2"], "left").withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")))
    base = [i for i, k in enumerate(KINDS) if k.base]
    of = lambda i: F.size(F.filter("found", lambda s: s["kind"] == i)).cast("long")
    return out.select(*(F.col(f"`{c}`") for c in keep), *(of(i).alias(f"n_{KINDS[i].name}") for i in base), F.sha2(_listed(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def redact(spark: SparkSession, docs: DataFrame, text: str = "text", mark: str = "[SECRET]", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every found span, overlapping ones merged, replaced by ``mark``; ``length`` is then set to the new code points."""
    found = find(spark, docs, text).select("_k1", "_k2", F.explode("found").alias("s")).select("_k1", "_k2", "s.start", "s.end")
    order = "partition by _k1, _k2 order by start, end"
    found = found.withColumn("fresh", F.expr(f"start >= coalesce(max(end) over ({order} rows between unbounded preceding and 1 preceding), -1)").cast("int"))
    merged = found.withColumn("n", F.expr(f"sum(fresh) over ({order} rows unbounded preceding)")).groupBy("_k1", "_k2", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    before = F.expr("start - coalesce(lag(end) over (partition by _k1, _k2 order by start), 0)")
    merged = merged.withColumn("before", before).groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list(F.struct("start", "before", "end"))).alias("_cuts"))
    merged = Scratch(spark, "redact").write(merged, "cuts")
    n = merged.count()
    names, out = {c: f"_own_{c}" if c.lower() in {"_k1", "_k2", "_cuts"} else c for c in docs.columns}, docs
    out = keyed(docs.withColumnsRenamed(names), text).join(small(merged, n, 256), ["_k1", "_k2"], "left")
    t = F.col(f"`{text}`")
    # Each cut gives the text before it and the mark; what follows the last cut comes at the end.
    pieces = F.concat_ws("", F.transform("_cuts", lambda c: F.concat(t.substr(c["start"] - c["before"] + 1, c["before"]), F.lit(mark))), t.substr(F.element_at("_cuts", -1)["end"] + 1, F.length(t)))
    out = out.withColumn(text, F.when(F.col("_cuts").isNull(), t).otherwise(pieces))
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.col("_cuts").isNull(), F.col(length)).otherwise(F.length(t)).cast(docs.schema[length].dataType))
    return out.select(*(F.col(f"`{to}`").alias(c) for c, to in names.items()))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, table(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle() -> str:
    """DuckDB SQL of ``op1_secret_scan``."""
    matches = []
    for i, k in enumerate(KINDS):
        p, ok = _quoted(k.pattern), []
        if k.value:
            ok.append(f"length(regexp_extract(hit, {p}, 1)) >= {k.value}")
        if k.length:
            ok.append(f"length(hit) = {k.length}")
        if k.mixed:
            ok.append("regexp_matches(hit, '[A-Z]') and regexp_matches(hit, '[a-z]') and regexp_matches(hit, '[0-9]')")
        matches.append(f"select doc_id, {i} as kind, '{k.name}' as name, '{k.role}' as role, {str(k.base).lower()} as base, start, start + length(hit) as stop from (select doc_id, hits[i] as hit, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as start from (select doc_id, string_split_regex(text, {p}) as gaps, regexp_extract_all(text, {p}) as hits, unnest(range(1, len(regexp_extract_all(text, {p})) + 1)) as i from d)) where {' and '.join(ok) or 'true'}")
    listed = "string_agg(name || ':' || cast(cast(start as bigint) as varchar) || ':' || cast(cast(stop as bigint) as varchar), ',' order by start, kind, stop)"
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
parts as ({' union all '.join(matches)}),
spans as (select * from parts where base union all select * from parts w where not base and exists (select 1 from parts c where c.doc_id = w.doc_id and c.role <> w.role and abs(c.start - w.start) <= {SCOPE})),
found as (select doc_id, count(*) filter (where kind = 0) as n0, count(*) filter (where kind = 1) as n1, count(*) filter (where kind = 2) as n2, {listed} as spans, {listed} filter (where base) as base from spans group by doc_id)
select d.doc_id, cast(coalesce(n0, 0) as bigint) as n_assign, cast(coalesce(n1, 0) as bigint) as n_access, cast(coalesce(n2, 0) as bigint) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join found using (doc_id)"""
