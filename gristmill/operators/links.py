"""Links: extraction from pages, the edge table, degrees, PageRank and HITS.

Iterations are DataFrame joins over a fixed edge table, which is written once, partitioned by the end that a round joins on, so
that a round shuffles node state only. A node with very many edges is dealt to several partitions by a salt. Every step's
state is written to the shared folder, so plans do not grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import partitioned, written

ABSOLUTE = r"^([A-Za-z][A-Za-z0-9_+.-]*:)?//[^/?#]+"
ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def plain_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments dropped, tags to blanks, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def meta_keywords(html: Column) -> Column:
    raw = F.regexp_extract(html, r"""(?is)<meta\s[^>]*name\s*=\s*["']keywords["'][^>]*content\s*=\s*["']([^"']*)["']""", 1)
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(raw), ","), lambda w: F.trim(w)), lambda w: w != ""))


def meta_description(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?is)<meta\s[^>]*name\s*=\s*["']description["'][^>]*content\s*=\s*["']([^"']*)["']""", 1)


def is_absolute(href: Column) -> Column:
    return href.rlike(ABSOLUTE)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """Lower-case host without user, port 80 or 443."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1)), ":(80|443)?$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment or repeated slashes; an empty path is /."""
    p = F.regexp_replace(path(url), "/+", "/")
    q = query_string(url)
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(p == "", F.lit("/")).otherwise(p), F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link on a page: absolute, scheme-relative, site-relative, or relative to the page's folder."""
    root = F.concat(scheme(base), F.lit("://"), host(base))
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    return canonical(
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href).when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href)).when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )


def outlinks(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href, anchor): anchors in order, anchor text without tags, lower-cased and trimmed."""
    links = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2)).alias("anchor"))
    rows = pages.select("page_id", "url", F.posexplode(links).alias("pos", "l"))
    return rows.select("page_id", "url", (F.col("pos") + 1).alias("pos"), F.col("l.href").alias("href"), F.trim(F.lower(F.regexp_replace("l.anchor", "(?s)<[^>]*>", ""))).alias("anchor"))


def url_edges(links: DataFrame) -> DataFrame:
    """(src, dst) distinct: page to resolved target."""
    return links.select(canonical(F.col("url")).alias("src"), resolve(F.col("url"), F.col("href")).alias("dst")).distinct()


def collapse_unknown(edges: DataFrame, crawled: DataFrame) -> DataFrame:
    """Targets that were not crawled are replaced by their host; distinct."""
    known = crawled.select(F.col("url").alias("dst"), F.lit(True).alias("known")).distinct()
    return edges.join(known, "dst", "left").select("src", F.when(F.col("known"), F.col("dst")).otherwise(host(F.col("dst"))).alias("dst")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, line): the node and its sorted targets, tab-separated. A line holds one node's targets, which the text format needs together."""
    return edges.groupBy("src").agg(F.array_join(F.sort_array(F.collect_set("dst")), "\t").alias("dsts")).select("src", F.concat_ws("\t", "src", "dsts").alias("line"))


def parse_adjacency(lines: DataFrame, inlinks: bool = False) -> DataFrame:
    """(src, dst) of white-space separated lines; with ``inlinks`` a line lists the sources of its node."""
    parts = lines.select(F.split(F.trim("line"), r"\s+").alias("w"))
    pairs = parts.select(F.element_at("w", 1).alias("a"), F.explode(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0)))).alias("b"))
    return (pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")) if inlinks else pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, inlinks, outlinks) of every node."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").alias("inlinks"), F.sum("o").alias("outlinks"))


def sinks(edges: DataFrame) -> DataFrame:
    return vertices(edges).join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


#: Edges of a node in a partition; a node with more is dealt to several.
PART_EDGES = 200_000


def _by_end(edges: DataFrame, end: str, other: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(edges with the end's count, partitioned for joins on it; (id, parts) of the nodes at that end; columns to join on), both written.

    The columns are the end alone, or the end and salt where some node has more edges than ``PART_EDGES``.
    """
    counts = written(edges.groupBy(end).agg(F.count("*").alias("count")).withColumn("parts", F.ceil(F.col("count") / PART_EDGES).cast("int")))
    split = (counts.agg(F.max("parts")).first()[0] or 1) > 1
    joined = edges.join(counts, end)
    joined = joined.withColumn("salt", F.pmod(F.xxhash64(other), F.col("parts")).cast("int")) if split else joined
    on = [end, "salt"] if split else [end]
    return partitioned(joined.drop("parts"), *on), counts.select(F.col(end).alias("id"), "parts"), on


def _given(state: DataFrame, on: list[str]) -> DataFrame:
    """State (id, ..., parts) for a join with such edges: once for every part of the node's edges."""
    state = state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) if len(on) > 1 else state
    return state.drop("parts").withColumnRenamed("id", on[0])


def _graph(edges: DataFrame) -> tuple[DataFrame, DataFrame, int, list[str]]:
    """(edges by source, nodes (id, parts; null for nodes without out-links), their number, columns to join on)."""
    edges, sources, on = _by_end(written(edges.distinct()), "src", "dst")
    nodes = partitioned(vertices(edges).join(sources, "id", "left"), "id")
    return edges, nodes, nodes.count(), on


def pagerank_step(edges: DataFrame, nodes: DataFrame, ranks: DataFrame, n: int, on: list[str], d: float = 0.85) -> DataFrame:
    """(1 - d) / N + d S / N + d sum of rank / out-degree over in-links, S being the rank of nodes without out-links."""
    given = _given(ranks.where("parts IS NOT NULL"), on)
    gained = edges.join(given, on).groupBy("dst").agg(F.sum(F.col("rank") / F.col("count")).alias("gain"))
    sink = ranks.where("parts IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("sink"))
    both = nodes.join(gained, nodes.id == gained.dst, "left").crossJoin(F.broadcast(sink))
    return both.select("id", "parts", ((1 - d) / n + d * F.col("sink") / n + d * F.coalesce("gain", F.lit(0.0))).alias("rank"))


def perplexity(ranks: DataFrame) -> float:
    h = ranks.agg(F.sum(-F.col("rank") * F.log2("rank"))).first()[0]
    return 2.0 ** (h or 0.0)


def pagerank(edges: DataFrame, iterations: int | None = None, d: float = 0.85, most: int = 200) -> DataFrame:
    """(id, rank); a fixed number of iterations, or until four perplexities in a row agree in their whole part."""
    edges, nodes, n, on = _graph(edges)
    ranks = nodes.select("id", "parts", F.lit(1.0 / max(1, n)).alias("rank"))
    seen: list[int] = []
    for _ in range(most if iterations is None else iterations):
        if iterations is None:
            seen.append(int(perplexity(ranks)))
            if len(seen) >= 4 and len(set(seen[-4:])) == 1:
                break
        ranks = written(pagerank_step(edges, nodes, ranks, n, on, d))
    return ranks.select("id", "rank")


def _hits_side(edges: DataFrame, scores: DataFrame, parts: DataFrame, on: list[str], at: str, missing: float) -> DataFrame:
    """(id, score): for each page the sum over its neighbours of their score, or ``missing``; edges come by the other end."""
    given = _given(scores.join(parts, "id") if len(on) > 1 else scores, on)
    sums = edges.join(given, on, "left").groupBy(at).agg(F.sum(F.coalesce("score", F.lit(missing))).alias("score"))
    total = sums.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    return sums.crossJoin(F.broadcast(total)).select(F.col(at).alias("id"), F.when(F.col("norm") == 0, F.col("score")).otherwise(F.col("score") / F.col("norm")).alias("score"))


def entropy(scores: DataFrame) -> float:
    return scores.agg(F.sum(-F.col("score") * F.log2("score"))).first()[0] or 0.0


def hits(edges: DataFrame, base: DataFrame | None = None, iterations: int | None = None, missing: float = 1.0, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(authorities, hubs), each (id, score), both updated from the round before.

    Neighbours without a score count ``missing`` (1, as in the reference; 0 is the usual definition). Without a number of iterations it
    stops when both entropies have moved by at most 0.001 three times in a row.
    """
    edges = written(edges.distinct())
    # The pages of the base set only, once for both sides; edges by the end whose scores a side reads.
    within = lambda end: edges if base is None else edges.join(base.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    into, sources, by_src = _by_end(within("dst"), "src", "dst")
    out, targets, by_dst = _by_end(within("src"), "dst", "src")
    empty = edges.limit(0).select(F.col("src").alias("id"), F.lit(0.0).alias("score"))
    auth, hub, seen = empty, empty, [(0.0, 0.0)]
    for i in range(most if iterations is None else iterations):
        auth, hub = written(_hits_side(into, hub, sources, by_src, "dst", missing)), written(_hits_side(out, auth, targets, by_dst, "src", missing))
        if iterations is None:
            seen.append((entropy(auth), entropy(hub)))
            if len(seen) > 3 and all(abs(a[k] - b[k]) <= 0.001 for a, b in zip(seen[-4:], seen[-3:]) for k in (0, 1)):
                break
    return auth, hub


def text_root_set(run: DataFrame, pages: DataFrame, n: int = 1000, page_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id): the URLs of the n best documents of a run (query_id, doc_id, score, rank), the root set of a full-text query."""
    first = run.where(F.col("rank") <= n).select(F.col("doc_id").alias(page_col)).distinct()
    return pages.join(first, page_col, "left_semi").select(F.col(url_col).alias("id")).distinct()


def sampled_in_links(edges: DataFrame, root: DataFrame, draws: int = 200, seed: int = 0) -> DataFrame:
    """(dst, src): for each root page ``draws`` in-links drawn with replacement, by a hash of page and draw, so that runs agree."""
    own = edges.join(root.select(F.col("id").alias("dst")), "dst", "left_semi").distinct()
    order = Window.partitionBy("dst").orderBy("src")
    counted = own.withColumn("n", F.row_number().over(order) - 1)
    sizes = own.groupBy("dst").agg(F.count("*").alias("size"))
    drawn = sizes.select("dst", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"), "size").select("dst", F.pmod(F.xxhash64("dst", "draw", F.lit(seed)), F.col("size")).cast("int").alias("n"))
    return drawn.join(counted, ["dst", "n"]).select("dst", "src")


def base_set(edges: DataFrame, root: DataFrame, cap: int = 200) -> DataFrame:
    """(id): root pages, all they link to, and per page at most ``cap`` in-links, chosen by a hash so that runs agree."""
    out = edges.join(root.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    order = Window.partitionBy("dst").orderBy(F.md5("src"), "src")
    into = edges.join(root.select(F.col("id").alias("dst")), "dst", "left_semi").withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).select(F.col("src").alias("id"))
    return root.select("id").union(out).union(into).distinct()


def top_links(scores: DataFrame, k: int = 500, score: str = "rank") -> DataFrame:
    return scores.orderBy(F.desc(score), "id").limit(k)
