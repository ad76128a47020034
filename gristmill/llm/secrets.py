"""Secret scan with multipart credential linking (DataFrame functions only).

Base formats are reported always. Weak candidates (short assigned values and bare tokens, account identifiers,
endpoints) are interval-joined and reported only when complementary parts co-occur, that is, no more than ``SCOPE`` code
points lie between the two spans: a weak secret needs an identifier, a weak identifier needs a secret, an endpoint needs both.

Regular expressions run where the text is; what is shuffled are the lengths of matches and of the gaps between
them, of which positions are running sums. The interval join is an equi-join on row and scope bucket (a part
looks into the buckets that it touches and the next ones), as a semi-join, so no pairs are emitted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

SCOPE = 300
# Kinds in the order of results; the first three are base formats.
KINDS = ("assign", "access", "hex", "weak_secret", "weak_id", "endpoint")
# Kind, pattern, the least length and the group it holds for.
PATTERNS = (
    (0, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    (1, r"AKIA[A-Z0-9]+", 16, 0),
    (2, r"[0-9a-f]{32,}", 32, 0),
    (3, r"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_.-])", 40, 0),
    (4, r"""(?i:\b(client_?id|access_?key_?id|account_?id|user_?name|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{4,}+)""", 4, 2),
    (5, r"""(?i:\b(https?|jdbc:[a-z]{2,12}|postgres(ql)?|mysql|mongodb(\+srv)?|redis|amqps?|s3|ftp)://)[^\s"'<>]{3,}+""", 3, 0),
)


def _found(text: Column, kind: int, pattern: str, least: int, group: int) -> Column:
    """Array of (kind, k, gap, size, ok) of the leftmost non-overlapping matches; gap is what lies before a match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("g"), matches.alias("m"), value.alias("v"))
    rows = F.transform(zipped, lambda z, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), F.length(z["g"]).cast("long").alias("gap"), F.length(z["m"]).cast("long").alias("size"), (F.length(z["v"]) >= least).alias("ok")))
    return F.when(text.rlike(pattern), rows)


def _within(parts: DataFrame, others: DataFrame) -> DataFrame:
    """The parts that have one of the others within the scope: the gap between the spans counts, however long they are."""
    buckets = lambda lo, hi: F.explode(F.sequence(F.expr(f"({lo}) div {SCOPE}"), F.expr(f"({hi}) div {SCOPE}")))
    a = parts.withColumn("at", buckets(f"greatest(start - {SCOPE}, 0)", f"end + {SCOPE}"))
    b = others.select(F.col("row").alias("row_b"), F.col("start").alias("start_b"), F.col("end").alias("end_b"), buckets("start", "end").alias("at_b"))
    near = (F.col("row") == F.col("row_b")) & (F.col("at") == F.col("at_b")) & (F.col("start_b") - F.col("end") <= SCOPE) & (F.col("start") - F.col("end_b") <= SCOPE)
    return a.join(b, near, "left_semi").drop("at").distinct()


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Counts and base_sha256 are of the base spans; spans lists these and the linked candidates, by start, then
    kind; positions are code points, ends exclusive. A null text counts as empty and has no span. Repeated rows are
    reported each; a null id stays null. Very long texts are searched whole, and spans of any length reported whole. Other columns are ignored; an
    empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<kind:int,k:int,gap:bigint,size:bigint,ok:boolean>>")
    every = F.concat(*[F.coalesce(_found(F.col("t"), *p), none) for p in PATTERNS])
    # Numbered once and written, so that a row keeps its number when tasks run again.
    rows = cut(docs.select(F.col(id_col).alias("id"), text.alias("t")).select("id", every.alias("parts")).withColumn("row", F.monotonically_increasing_id()))
    one = rows.select("row", F.inline("parts"))
    sums = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = one.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(sums)).withColumn("start", F.col("end") - F.col("size"))
    # A short assigned value is a weak secret.
    parts = parts.withColumn("kind", F.when((F.col("kind") == 0) & ~F.col("ok"), 3).otherwise(F.col("kind"))).where(F.col("ok") | (F.col("kind") == 3))
    ordered = Window.partitionBy("row").orderBy("start", "kind", "end")
    before = F.max(F.when(F.col("kind") <= 2, F.col("end"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(F.col("kind") <= 2, F.col("start")), ignorenulls=True).over(ordered.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.lit(1 << 60)) >= F.col("end"))
    parts = cut(parts.withColumn("free", free).where((F.col("kind") <= 2) | F.col("free")).select("row", "kind", "start", "end"))

    kind = lambda *k: parts.where(F.col("kind").isin(*k))
    linked = [_within(kind(3), kind(1, 4)), _within(kind(4), kind(0, 2, 3)), _within(_within(kind(5), kind(1, 4)), kind(0, 2, 3))]
    spans = reduce(DataFrame.unionByName, linked, kind(0, 1, 2))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    item = F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("s"))
    base = F.sort_array(F.collect_list(F.when(F.col("kind") <= 2, item)))
    count = lambda k: F.count_if(F.col("kind") == k)
    listed = lambda c: F.array_join(F.transform(c, lambda x: x["s"]), ",")
    per_row = spans.groupBy("row").agg(count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), listed(base).alias("base"), listed(F.sort_array(F.collect_list(item))).alias("spans"), F.count_if(F.col("kind") > 2).alias("n_linked"))
    out = rows.select("row", "id").join(per_row, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias(id_col), zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_linked"))
