"""The SQL (DuckDB) that each registered query is held against, from named common table expressions."""

from __future__ import annotations

import re

from . import inputs as i

# Written here from the definitions, apart from the library's own.
TOKEN = r"((?:\p{Nd}|\.)+|(?:\p{L}|\p{N}|_)+)"
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split(" ")
CUTOFFS = [5, 10, 15, 20, 30, 100, 200, 500, 1000]
LEVELS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
FEATURES = ["okapi_bm25", "okapi_tf", "okapi_tf_idf", "unigram_lm_jm", "unigram_lm_laplace"]
ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
STOPS = ",".join(f"'{w}'" for w in STOP_WORDS)
WORDS = ",".join(f"'{w}'" for w in i.KEYWORDS)
ANCHOR_SQL = ANCHOR.replace("'", "''")
HOST = "regexp_replace(lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)', 1)), ':(80|443)?$', '')"
SCHEME = "lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
PATH = "regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1)"
QUERY = r"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"
PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


def part(f: str, u: str) -> str:
    return f.replace("{u}", u)


def canonical(u: str) -> str:
    p = f"regexp_replace({part(PATH, u)}, '/+', '/', 'g')"
    q = part(QUERY, u)
    return f"concat({part(SCHEME, u)}, '://', {part(HOST, u)}, CASE WHEN {p} = '' THEN '/' ELSE {p} END, CASE WHEN {q} = '' THEN '' ELSE concat('?', {q}) END)"


def resolved(u: str, h: str) -> str:
    root = f"concat({part(SCHEME, u)}, '://', {part(HOST, u)})"
    folder = f"regexp_extract({part(PATH, u)}, '^(.*/)', 1)"
    return f"""CASE WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {h} WHEN {h}[1:2] = '//' THEN concat({part(SCHEME, u)}, ':', {h})
        WHEN {h}[1:1] = '/' THEN concat({root}, {h}) ELSE concat({root}, CASE WHEN {folder} = '' THEN '/' ELSE {folder} END, {h}) END"""


def contains_any(c: str, parts) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{p}')" for p in parts) + ")"


TFPART = "tf / (tf + 0.5::double + 1.5::double * dl / avgdl)"
IDF = "ln((n + 0.5::double) / (df + 0.5::double))"
BM25 = f"{IDF} * (tf + 1.2::double * tf) / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl)) * (qtf + 500::double * qtf) / (qtf + 500::double)"
LUCENE = "ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))"
NONE = "ln(1.3::double + exp(-287::double))"


def expansions(scores: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) AS rank FROM
        (SELECT query_id, term, sum(tf) AS ttf, sum(df) AS df, round(sum(tf) * ln((SELECT n FROM st) / sum(df)), 6) AS weight
         FROM tf JOIN ({top(scores, 10)}) USING (doc_id) JOIN (SELECT term, df FROM terms) USING (term) GROUP BY query_id, term)) WHERE rank <= 10"""


def scores(name: str, q: str = "q", qw: str = "qw", m: str = "m") -> str:
    """A model's scores over queries (tokens, distinct terms, matches)."""
    parts = {"bm25": BM25, "okapi_tf": TFPART, "tfidf": f"{TFPART} * ln(n / df)"}
    return summed(parts[name], m) if name in parts else laplace(q, m) if name == "lm_laplace" else mercer(0.9, q, qw, m)


def expanded(name: str, more: str) -> str:
    """A model over the queries' tokens and the terms that ``more`` adds to them."""
    return f"""WITH qy AS (SELECT query_id, term FROM q UNION ALL SELECT query_id, term FROM ({more})), qx AS (SELECT query_id, term, count(*)::double AS qtf FROM qy GROUP BY ALL),
        mx AS (SELECT query_id, term, qtf, doc_id, tf, dl, ttf, df FROM tf JOIN qx USING (term) JOIN terms USING (term) JOIN dl USING (doc_id)) """ + RANKED.format(top(scores(name, "qy", "qx", "mx")))


def tokens_of(table: str, key: str) -> str:
    return f"SELECT {key} AS k, unnest(l) AS term, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT {key}, list_transform(regexp_extract_all(text, '{TOKEN}', 1), lambda x: lower(x)) AS l FROM {table})"


def summed(expr: str, source: str = "m") -> str:
    return f"SELECT query_id, doc_id, round(sum(qtf * ({expr})), 6) AS score FROM {source}, st GROUP BY query_id, doc_id"


def laplace(q: str = "q", m: str = "m") -> str:
    """By the definition: for every document and query the sum over query tokens of ln((tf + 1) / (dl + V))."""
    return f"SELECT query_id, doc_id, round(coalesce(gain, 0) - q * ln(dl + v), 6) AS score FROM dl CROSS JOIN (SELECT query_id, count(*)::double AS q FROM {q} GROUP BY query_id) CROSS JOIN st LEFT JOIN (SELECT query_id, doc_id, sum(qtf * ln(tf + 1)) AS gain FROM {m} GROUP BY ALL) USING (query_id, doc_id)"


def mercer(lam: float, q: str = "q", qw: str = "qw", m: str = "m") -> str:
    base = f"ln({1 - lam!r}::double * ttf / v)"
    return f"""SELECT query_id, doc_id, round(coalesce(base, 0) + coalesce(gain, 0), 6) AS score FROM dl CROSS JOIN (SELECT DISTINCT query_id FROM {q})
        LEFT JOIN (SELECT query_id, sum(qtf * {base}) AS base FROM {qw} JOIN terms USING (term), st GROUP BY query_id) USING (query_id)
        LEFT JOIN (SELECT query_id, doc_id, sum(qtf * (ln({lam!r}::double * tf / dl + {1 - lam!r}::double * ttf / v) - {base})) AS gain FROM {m}, st GROUP BY ALL) USING (query_id, doc_id)"""


def top(scores: str, k: int = 1000) -> str:
    return f"SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM ({scores})) WHERE rank <= {k}"


def _pagerank(edges: str, steps: int = 5) -> str:
    d = i.DAMPING
    out = [f"e AS MATERIALIZED ({edges})", "v AS MATERIALIZED (SELECT DISTINCT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e))", "o AS MATERIALIZED (SELECT src, count(*) AS out FROM e GROUP BY src)", "r0 AS (SELECT id, 1.0::double / (SELECT count(*) FROM v) AS rank FROM v)"]
    for k in range(steps):
        out.append(f"g{k} AS (SELECT dst, sum(rank / out) AS gain FROM e JOIN o USING (src) JOIN r{k} ON r{k}.id = e.src GROUP BY dst)")
        out.append(f"s{k} AS (SELECT coalesce(sum(rank), 0) AS sink FROM r{k} WHERE id NOT IN (SELECT src FROM o))")
        out.append(f"r{k + 1} AS MATERIALIZED (SELECT id, {1 - d!r}::double / (SELECT count(*) FROM v) + {d!r}::double * (SELECT sink FROM s{k}) / (SELECT count(*) FROM v) + {d!r}::double * coalesce(gain, 0) AS rank FROM v LEFT JOIN g{k} ON v.id = g{k}.dst)")
    return ", ".join(out)


def _hits(edges: str, missing: float, steps: int = 5) -> str:
    out = [f"e AS MATERIALIZED ({edges})", "a0 AS (SELECT src AS id, 0.0::double AS score FROM e WHERE false)", "h0 AS (SELECT * FROM a0)"]
    for k in range(steps):
        for new, old, at, other in (("a", "h", "dst", "src"), ("h", "a", "src", "dst")):
            out.append(f"{new}s{k} AS (SELECT {at} AS id, sum(coalesce(score, {missing!r}::double)) AS score FROM e LEFT JOIN {old}{k} ON {old}{k}.id = e.{other} GROUP BY {at})")
        for new in "ah":
            out.append(f"{new}{k + 1} AS MATERIALIZED (SELECT id, CASE WHEN norm = 0 THEN score ELSE score / norm END AS score FROM {new}s{k}, (SELECT sqrt(sum(score * score)) AS norm FROM {new}s{k}))")
    return ", ".join(out) + f" SELECT id, 'authority' AS side, round(score, 9) AS score FROM a{steps} UNION ALL SELECT id, 'hub', round(score, 9) FROM h{steps}"


E2 = f"SELECT DISTINCT url AS src, href AS dst FROM (SELECT url, unnest(regexp_extract_all(html, '{ANCHOR_SQL}', 1)) AS href FROM pages)"
E3 = "SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL"

CTE = {
    "tok": f"SELECT k AS doc_id, term, pos FROM ({tokens_of('documents', 'doc_id')})",
    "tf": "SELECT term, doc_id, count(*)::double AS tf, min(pos) AS first_pos, max(pos) AS last_pos, list_sort(list(pos)) AS positions FROM tok GROUP BY term, doc_id",
    "terms": "SELECT term, sum(tf) AS ttf, count(*)::double AS df FROM tf GROUP BY term",
    "dl": "SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id",
    "ddl": "SELECT doc_id, count(*)::double AS dl FROM tf GROUP BY doc_id",
    "st": "SELECT (SELECT count(*) FROM documents)::double AS n, (SELECT count(*) FROM terms)::double AS v, (SELECT sum(tf) FROM tf) / (SELECT count(*) FROM documents) AS avgdl",
    "q": f"SELECT k AS query_id, term, pos FROM ({tokens_of('benchmark', 'item_id')})",
    "qw": "SELECT query_id, term, count(*)::double AS qtf FROM q GROUP BY query_id, term",
    "m": "SELECT query_id, term, qtf, doc_id, tf, dl, ttf, df FROM tf JOIN qw USING (term) JOIN terms USING (term) JOIN dl USING (doc_id)",
    "dm": "SELECT query_id, term, qtf, doc_id, tf, dl, ttf, df FROM tf JOIN qw USING (term) JOIN terms USING (term) JOIN ddl USING (doc_id)",
    "run": top(summed(BM25)),
    "qrels": "SELECT doc_id % (SELECT count(*) FROM benchmark) AS query_id, doc_id, quality AS rel FROM labels",
    "num": "SELECT query_id, sum((rel >= 1)::int) AS num_rel FROM qrels GROUP BY query_id HAVING sum((rel >= 1)::int) > 0",
    "j0": "SELECT query_id, doc_id, score, coalesce(rel, 0) AS rel, num_rel, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS ix FROM run JOIN num USING (query_id) LEFT JOIN (SELECT query_id, doc_id, max((rel >= 1)::int) AS rel FROM qrels GROUP BY ALL) USING (query_id, doc_id)",
    "j": "SELECT *, sum(rel) OVER w AS hits, sum(rel) OVER w / ix::double AS prec FROM j0 WINDOW w AS (PARTITION BY query_id ORDER BY ix ROWS UNBOUNDED PRECEDING)",
    "bg": "SELECT * FROM (SELECT query_id, pos, term AS a, lead(term) OVER (PARTITION BY query_id ORDER BY pos) AS b FROM q) WHERE b IS NOT NULL",
    "spans": """SELECT query_id, pos, doc_id, CASE WHEN p1[1] >= p2[1] THEN 500 ELSE least(500, list_min(list_transform(p1, lambda x: list_min(list_transform(p2, lambda y: abs(x - y)))))) END AS span
        FROM (SELECT query_id, pos, x.doc_id, x.positions AS p1, y.positions AS p2 FROM bg JOIN tf x ON x.term = a JOIN tf y ON y.term = b AND y.doc_id = x.doc_id WHERE a <> b)""",
    "exp": expansions(summed(BM25)),
    "sig": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, term) AS rank FROM
        (SELECT token, term, round(CASE WHEN ln(n) - ln(least(fx, fy)) > 0 THEN exp(-(ln(greatest(fx, fy)) - ln(fxy)) / (ln(n) - ln(least(fx, fy)))) ELSE 0 END, 6) AS score FROM
            (SELECT token, b.term, count(*)::double AS fxy FROM (SELECT doc_id, term AS token FROM tf WHERE term IN (SELECT term FROM q)) a JOIN tf b USING (doc_id) WHERE b.term <> token GROUP BY ALL)
            JOIN (SELECT term, df AS fy FROM terms) USING (term) JOIN (SELECT term AS token, df AS fx FROM terms) USING (token), st)) WHERE rank <= 10""",
    "sigx": """SELECT query_id, pos, token, term, n AS rank FROM (SELECT query_id, q.pos, token, s.term, row_number() OVER (PARTITION BY query_id, q.pos ORDER BY s.rank) AS n
        FROM q JOIN sig s ON q.term = s.token WHERE s.score >= 0.7 AND NOT EXISTS (SELECT 1 FROM qw WHERE qw.query_id = q.query_id AND qw.term = s.term)) WHERE n <= 2""",
    "anchors": f"SELECT page_id, url, unnest(range(1, len(h) + 1)) AS pos, unnest(h) AS href, unnest(list_transform(a, lambda x: trim(lower(regexp_replace(x, '(?s)<[^>]*>', '', 'g'))))) AS anchor FROM (SELECT page_id, url, regexp_extract_all(html, '{ANCHOR_SQL}', 1) AS h, regexp_extract_all(html, '{ANCHOR_SQL}', 2) AS a FROM pages)",
    "res": f"SELECT page_id, pos, href, anchor, {canonical('url')} AS src, {resolved('url', 'href')} AS raw FROM anchors",
    "lk": f"SELECT *, {part(HOST, 'dst')} AS domain FROM (SELECT page_id, pos, href, anchor, src, {canonical('raw')} AS dst FROM res)",
    "crawled": f"SELECT DISTINCT {canonical('url')} AS url FROM pages",
    "e2": E2,
    "adj": "SELECT src, concat(src, chr(9), array_to_string(list_sort(list(DISTINCT dst)), chr(9))) AS line FROM e2 GROUP BY src",
    "dom": "SELECT domain, count(*) AS inlinks FROM lk GROUP BY domain",
    "ucount": "SELECT dst AS url, count(*) AS inlinks FROM lk GROUP BY dst",
    "ranks": f"SELECT domain, row_number() OVER (ORDER BY n DESC, domain) AS rank FROM (SELECT {part(HOST, 'url')} AS domain, count(*) AS n FROM pages GROUP BY ALL) WHERE n > 1",
    "batch": "SELECT dst AS url, domain, min(page_id % 5) AS wave, max(pos) >= 6 AS rate_limited FROM lk GROUP BY dst, domain",
    "sc": "SELECT doc_id, toxic AS label, score FROM (SELECT doc_id, round(length(text) / (1.0::double + len(list_distinct(list_transform(regexp_extract_all(text, '" + TOKEN + "', 1), lambda x: lower(x))))), 6) AS score FROM documents) JOIN labels USING (doc_id)",
    "clean": r"SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda w: regexp_replace(w, '[!-/:-@\[-`{-~]', '', 'g')), lambda w: regexp_full_match(w, '\p{L}+') AND w NOT IN (" + STOPS + ")) AS w FROM documents",
}


def jaccard(a: str, exact: bool) -> str:
    both = f"len(list_intersect(list_distinct({a}), [{WORDS}]))"
    return f"round({both} / (len(list_distinct({a})) + {len(i.KEYWORDS)} {'-' if exact else '+'} {both})::double, 6)"


def with_(sql: str, rename: dict[str, str] | None = None) -> str:
    """Puts before a query the common table expressions that it names, and those that these name."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if name not in need and re.search(rf"(\bFROM|\bJOIN|,)\s*\(?\s*{name}\b", text):
                visit(CTE[name])
                if name not in need:
                    need.append(name)

    visit(sql)
    if not need:
        return sql
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in need) + (", " + sql[5:] if sql.startswith("WITH ") else " " + sql)


RANKED = "SELECT query_id, doc_id, score, rank FROM ({})"
AT_N = "(SELECT query_id, count(*) AS n, max(num_rel) AS num_rel, sum(rel) AS total FROM j WHERE ix <= 1000 GROUP BY query_id)"
PREC_AT = "coalesce(prec, CASE WHEN k > n THEN total / (k - 1)::double END, 0)"
REC_AT = "coalesce(hits, total, 0) / num_rel::double"
AP = "round(sum(CASE WHEN ix <= 1000 AND rel > 0 THEN rel * prec ELSE 0 END) / max(num_rel), 6)"
RPREC = "round(sum(CASE WHEN ix <= num_rel AND ix <= 1000 THEN rel ELSE 0 END) / max(num_rel)::double, 6)"
NDCG = "sum((2.0::double ^ rel - 1) / log2(ix + 1))"
REF_IDEAL = "list_sum(list_transform(range(count(*)::bigint + 1, 2 * count(*)::bigint + 1), lambda x: 1 / log2(x + 1)))"
PERL = """jp0 AS (SELECT query_id, doc_id, score, coalesce(rel, 0) AS rel, num_rel, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS ix FROM run
    JOIN (SELECT query_id, sum(rel) AS num_rel FROM qrels GROUP BY 1 HAVING sum(rel) > 0) USING (query_id) LEFT JOIN (SELECT query_id, doc_id, max(rel) AS rel FROM qrels GROUP BY ALL) USING (query_id, doc_id)),
    jp AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY ix ROWS UNBOUNDED PRECEDING) / ix::double AS prec FROM jp0)"""
LTR_RUNS = " UNION ALL ".join(f"SELECT query_id, doc_id, '{n}' AS model, score FROM ({top(s)})" for n, s in zip(FEATURES, (summed(BM25), summed(TFPART), summed(f"{TFPART} * ln(n / df)"), mercer(0.9), laplace())))
FRONTIER = """SELECT url, round(url_in + CASE WHEN nd = 0 THEN domain_in ELSE domain_in / nd END + CASE WHEN nr = 0 THEN inverse ELSE inverse / nr END, 6) AS score FROM
    (SELECT *, sqrt(sum(domain_in * domain_in) OVER ()) AS nd, sqrt(sum(inverse * inverse) OVER ()) AS nr FROM
        (SELECT b.url, coalesce(u.inlinks, 0)::double AS url_in, coalesce(m.inlinks, 0)::double AS domain_in, 1.0::double / coalesce(r.rank, (SELECT max(rank) FROM ranks), 1) AS inverse
         FROM {} b LEFT JOIN ucount u ON b.url = u.url LEFT JOIN dom m ON b.domain = m.domain LEFT JOIN ranks r ON r.domain = b.domain))"""
SPACE = "length(text) - length(replace(text, ' ', ''))"
PR = _pagerank(E3)
GAP = f"date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) < {int(i.DELAY_SECONDS * 1_000_000) - 100}"
LIMIT = f"SELECT user_id AS key, event_id AS id, coalesce({GAP}, false) AS limited FROM events"

SQL = {
    "tokenize_stats": f"SELECT doc_id, len(l)::bigint AS n_tokens, len(list_distinct(l))::bigint AS n_distinct FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '{TOKEN}', 1), lambda x: lower(x)) AS l FROM documents)",
    "space_length": f"SELECT doc_id, {SPACE} AS length FROM documents",
    "average_space_length": f"SELECT round(avg({SPACE}), 6) AS avg_length FROM documents",
    "stopword_filter": f"SELECT doc_id, count(*) AS n_kept, max(p)::bigint AS last_pos, sum(p * length(term))::bigint AS weighted FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM tok WHERE term NOT IN ({STOPS})) GROUP BY doc_id",
    "standard_analyzer": f"SELECT doc_id, len(w)::bigint AS n_tokens, array_to_string(w[1:3], ' ') AS first_terms FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '([\\p{{L}}\\p{{N}}_]+)', 1), lambda x: lower(x)), lambda x: x NOT IN ({STOPS})) AS w FROM documents)",
    "postings": "SELECT term, doc_id, tf::bigint AS tf, first_pos, last_pos FROM tf",
    "term_stats": "SELECT term, ttf::bigint AS ttf, df::bigint AS df FROM terms",
    "index_doc_lengths": "SELECT doc_id, dl::bigint AS dl FROM dl",
    "distinct_doc_lengths": "SELECT doc_id, dl::bigint AS dl FROM ddl",
    "corpus_stats": "SELECT n::bigint AS n_docs, v::bigint AS vocabulary, round(avgdl, 6) AS avg_dl FROM st",
    "term_vector_json": "SELECT term, ttf::bigint AS ttf, doc_id, tf::bigint AS tf, tf::bigint AS n_pos FROM tf JOIN terms USING (term)",
    "index_round_trip": "SELECT term, doc_id, tf::bigint AS tf FROM tf WHERE term IN (SELECT term FROM q)",
    "okapi_tf_topk": RANKED.format(top(summed(TFPART))),
    "tfidf_topk": RANKED.format(top(summed(f"{TFPART} * ln(n / df)"))),
    "bm25_topk": RANKED.format(top(summed(BM25))),
    "bm25_distinct_dl_topk": RANKED.format(top(summed(BM25, "dm"))),
    "lucene_bm25_topk": RANKED.format(top(summed(LUCENE))),
    "lm_laplace_topk": RANKED.format(top(laplace())),
    "lm_jm_topk": RANKED.format(top(mercer(0.9))),
    "lm_jm_08_topk": RANKED.format(top(mercer(0.8))),
    "query_bigrams": "SELECT query_id, pos, a, b FROM bg",
    "min_span": "SELECT query_id, pos, doc_id, span::bigint AS span FROM spans",
    "proximity_topk": RANKED.format(top(f"""SELECT query_id, doc_id, round(s + c * {NONE} + coalesce(gain, 0), 6) AS score FROM (SELECT query_id, doc_id, sum(qtf * {TFPART} * ln(n / df)) AS s FROM m, st GROUP BY ALL)
        JOIN (SELECT query_id, count(*) - 1 AS c FROM q GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, doc_id, sum(ln(1.3::double + exp(-span::double)) - {NONE}) AS gain FROM spans GROUP BY ALL) USING (query_id, doc_id)""")),
    "prf_expansion": "SELECT query_id, term, ttf::bigint AS ttf, df::bigint AS df, weight, rank FROM exp",
    "gnd_significant_terms": "SELECT token, term, score, rank FROM sig",
    "gnd_expansion": "SELECT query_id, pos, token, term, rank FROM sigx",
    **{f"prf_{m}_topk": expanded(m, expansions(scores(m))) for m in ("bm25", "okapi_tf", "tfidf", "lm_laplace", "lm_jm")},
    **{f"gnd_{m}_topk": expanded(m, "SELECT query_id, term FROM sigx") for m in ("bm25", "okapi_tf", "tfidf", "lm_laplace", "lm_jm")},
    "ngram_spans": """WITH tri AS (SELECT * FROM (SELECT query_id, pos, term AS a, lead(term) OVER w AS b, lead(term, 2) OVER w AS c FROM q WINDOW w AS (PARTITION BY query_id ORDER BY pos)) WHERE c IS NOT NULL AND a <> b AND b <> c AND a <> c),
        occ AS (SELECT query_id, t.pos, doc_id, o.pos AS p, CASE WHEN o.term = a THEN 1 WHEN o.term = b THEN 2 ELSE 3 END AS k FROM tri t JOIN tok o ON o.term IN (a, b, c)),
        seen AS (SELECT query_id, pos, doc_id, p, max(CASE WHEN k = 1 THEN p END) OVER w AS x, max(CASE WHEN k = 2 THEN p END) OVER w AS y, max(CASE WHEN k = 3 THEN p END) OVER w AS z FROM occ WINDOW w AS (PARTITION BY query_id, pos, doc_id ORDER BY p ROWS UNBOUNDED PRECEDING))
        SELECT query_id, pos, doc_id, least(500, min(p - least(x, y, z)))::bigint AS span FROM seen WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY query_id, pos, doc_id""",
    "index_reload_bm25": RANKED.format(top(summed(BM25))),
    "eval_report": f"""WITH t AS (SELECT query_id, count(*) AS r, max(num_rel)::bigint AS n, sum(CASE WHEN ix <= 1000 THEN rel END)::bigint AS h, {AP} AS ap, {RPREC} AS rp FROM j GROUP BY query_id)
        SELECT query_id, unnest([printf('Queryid: %d', query_id), printf('Retrieved: %d', r), printf('Relevant: %d', n), printf('Rel_ret: %d', h), printf('Average precision: %.4f', ap + 1e-9), printf('R-Precision: %.4f', rp + 1e-9)]) AS line FROM t""",
    "batch_slices": "SELECT b AS batch, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // ((SELECT count(*) FROM documents) + 6) // 7) AS b FROM documents) GROUP BY b".replace("// ((SELECT", "// (((SELECT"),
    "run_file_lines": "SELECT concat_ws(' ', query_id::varchar, 'Q0', doc_id::varchar, rank::varchar, printf('%.6f', score), 'Exp') AS line FROM run",
    "eval_ap": f"SELECT query_id, count(*) AS num_ret, max(num_rel)::bigint AS num_rel, sum(CASE WHEN ix <= 1000 THEN rel END)::bigint AS num_rel_ret, {AP} AS ap FROM j GROUP BY query_id",
    "eval_cutoffs": f"SELECT query_id, k, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT query_id, k, {PREC_AT} AS p, {REC_AT} AS r FROM (SELECT * FROM {AT_N}, (SELECT unnest([{','.join(map(str, CUTOFFS))}])::bigint AS k)) LEFT JOIN (SELECT query_id, ix AS k, prec, hits FROM j WHERE ix <= 1000) USING (query_id, k))",
    "eval_rprec": f"SELECT query_id, {RPREC} AS r_prec FROM j GROUP BY query_id",
    "eval_interp11": f"SELECT query_id, level, round(coalesce(arg_min(best, ix) FILTER (WHERE recall >= level), 0), 6) AS precision FROM (SELECT query_id, ix, hits / num_rel::double AS recall, max(prec) OVER (PARTITION BY query_id ORDER BY ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM j WHERE ix <= 1000), (SELECT unnest([{','.join(map(repr, LEVELS))}])::double AS level) GROUP BY query_id, level",
    "eval_ndcg_ref": f"SELECT query_id, round({NDCG} / {REF_IDEAL}, 6) AS ndcg FROM j GROUP BY query_id",
    "eval_ndcg_std": f"SELECT query_id, round({NDCG} / list_sum(list_transform(range(1, max(num_rel)::bigint + 1), lambda x: 1 / log2(x + 1))), 6) AS ndcg FROM j GROUP BY query_id",
    "eval_summary": f"SELECT count(*) AS topics, sum(num_ret)::bigint AS num_ret, sum(num_rel)::bigint AS num_rel, sum(num_rel_ret)::bigint AS num_rel_ret, round(avg(ap), 6) AS map, round(avg(r_prec), 6) AS r_prec, round(avg(ndcg), 6) AS ndcg FROM (SELECT query_id, count(*) AS num_ret, max(num_rel) AS num_rel, sum(CASE WHEN ix <= 1000 THEN rel END) AS num_rel_ret, {AP} AS ap, {RPREC} AS r_prec, round({NDCG} / {REF_IDEAL}, 6) AS ndcg FROM j GROUP BY query_id)",
    "eval_perl_mode": f"WITH {PERL} SELECT query_id, count(*) AS num_ret, max(num_rel)::bigint AS num_rel, sum(CASE WHEN ix <= 1000 THEN rel END)::bigint AS num_rel_ret, {AP} AS ap, {RPREC} AS r_prec FROM jp GROUP BY query_id",
    "eval_pr_curve": "SELECT query_id, ix, round(hits / num_rel::double, 6) AS recall, round(prec, 6) AS precision, round(max(prec) OVER (PARTITION BY query_id ORDER BY ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS interpolated FROM j WHERE ix <= 1000",
    "page_titles": "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages",
    "page_text": f"SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, {PLAIN} AS t FROM pages)",
    "page_meta": """SELECT page_id, array_to_string(list_distinct(list_filter(list_transform(string_split(lower(regexp_extract(html, '(?is)<meta\\s[^>]*name\\s*=\\s*["'']keywords["''][^>]*content\\s*=\\s*["'']([^"'']*)["'']', 1)), ','), lambda x: trim(x)), lambda x: x <> '')), ',') AS keywords,
        regexp_extract(html, '(?is)<meta\\s[^>]*name\\s*=\\s*["'']description["''][^>]*content\\s*=\\s*["'']([^"'']*)["'']', 1) AS description FROM pages""",
    "page_outlinks": "SELECT page_id, pos, href, anchor FROM anchors",
    "url_parts": f"SELECT page_id, {part(SCHEME, 'url')} AS scheme, {part(HOST, 'url')} AS host, {part(PATH, 'url')} AS path, {part(QUERY, 'url')} AS query, {canonical('url')} AS canonical, regexp_matches(url, '^([A-Za-z][A-Za-z0-9_+.-]*:)?//[^/?#]+') AS absolute FROM pages",
    "md5_keys": f"SELECT page_id, md5({canonical('url')}) AS url_hash FROM pages",
    "url_edges": "SELECT DISTINCT src, dst FROM lk",
    "link_edges": "SELECT DISTINCT src, CASE WHEN dst IN (SELECT url FROM crawled) THEN dst ELSE domain END AS dst FROM lk",
    "adjacency_lists": "SELECT src, line FROM adj",
    "adjacency_parse": r"SELECT DISTINCT w[1] AS src, unnest(w[2:]) AS dst FROM (SELECT regexp_split_to_array(trim(line), '\s+') AS w FROM adj)",
    "adjacency_inlinks": r"SELECT DISTINCT unnest(w[2:]) AS src, w[1] AS dst FROM (SELECT regexp_split_to_array(trim(line), '\s+') AS w FROM adj)",
    "edge_table": "SELECT src, md5(src) AS src_hash, dst AS dest, md5(dst) AS dest_hash, 1::bigint AS is_active FROM lk",
    "edges_is_crawled": "SELECT dst IN (SELECT url FROM crawled) AS is_crawled, count(*) AS n FROM lk GROUP BY 1",
    "inlink_ranking": "SELECT dst AS url, count(*) AS inlinks FROM e2 GROUP BY dst",
    "duplicate_edges": "SELECT src, dst AS dest, count(*) AS n FROM lk GROUP BY src, dst HAVING count(*) > 1",
    "distinct_edge_count": "SELECT count(DISTINCT (src, dst)) AS n_edges, count(*) AS n_rows FROM lk",
    "uncrawled_antijoin": "SELECT DISTINCT dst AS url, md5(dst) AS url_hash, 1::bigint AS is_active FROM lk WHERE NOT EXISTS (SELECT 1 FROM crawled WHERE crawled.url = lk.dst)",
    "allocated_ids": "SELECT (SELECT count(*) FROM (SELECT url FROM crawled UNION SELECT dst FROM lk)) AS n_urls, (SELECT count(*) FROM (SELECT url FROM crawled UNION SELECT dst FROM lk)) AS n_ids, (SELECT count(*) FROM crawled) AS n_old",
    "xml_batch_parse": "SELECT page_id, src, dst, md5(dst) AS dest_hash FROM lk",
    "link_info": "SELECT page_id, coalesce(ni, 0)::bigint AS inlinks, coalesce(no, 0)::bigint AS outlinks FROM pages LEFT JOIN (SELECT dst AS url, count(*) AS ni FROM e2 GROUP BY 1) USING (url) LEFT JOIN (SELECT src AS url, count(*) AS no FROM e2 GROUP BY 1) USING (url)",
    "degrees": "SELECT id, sum(i)::bigint AS inlinks, sum(o)::bigint AS outlinks FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e2 UNION ALL SELECT dst, 1, 0 FROM e2) GROUP BY id",
    "sink_nodes": "SELECT DISTINCT dst AS id FROM e2 WHERE dst NOT IN (SELECT src FROM e2)",
    "top500_links": f"WITH {PR} SELECT id, round(rank, 9) AS rank, i.inlinks::bigint AS inlinks, out AS outlinks FROM (SELECT id, rank FROM r5) JOIN (SELECT dst, count(*) AS inlinks FROM e GROUP BY 1) i ON i.dst = id JOIN o ON o.src = id ORDER BY round(rank, 9) DESC, id LIMIT 500",
    "pagerank_5it": f"WITH {PR} SELECT id, round(rank, 9) AS rank FROM r5",
    "pagerank_sinks_5it": f"WITH {_pagerank(E2)} SELECT id, round(rank, 9) AS rank FROM r5",
    "hits_5it": f"WITH {_hits(E3, 1.0)}",
    "hits_sinks_5it": f"WITH {_hits(E2, 1.0)}",
    "hits_clean_5it": f"WITH {_hits(E3, 0.0)}",
    "hits_base_set": """SELECT id FROM (SELECT url AS id FROM pages WHERE contains(url, '/en/') UNION SELECT dst FROM e2 WHERE src IN (SELECT url FROM pages WHERE contains(url, '/en/'))
        UNION SELECT src FROM (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY md5(src), src) AS n FROM e2 WHERE dst IN (SELECT url FROM pages WHERE contains(url, '/en/'))) WHERE n <= 200)""",
    "domain_blacklist": f"SELECT page_id, pos, NOT {contains_any('domain', i.DOMAIN_BLACKLIST)} AS kept FROM lk",
    "keyword_blacklist": f"SELECT page_id, pos, NOT ({contains_any('anchor', i.KEYWORD_BLACKLIST)} OR {contains_any('dst', i.KEYWORD_BLACKLIST)}) AS kept FROM lk",
    "outlink_filter": f"SELECT page_id, pos, dst AS url FROM lk WHERE NOT {contains_any('domain', i.DOMAIN_BLACKLIST)} AND NOT ({contains_any('anchor', i.KEYWORD_BLACKLIST)} OR {contains_any('dst', i.KEYWORD_BLACKLIST)})",
    "keep_first_dedup": "SELECT page_id, pos, dst, row_number() OVER (PARTITION BY dst ORDER BY page_id, pos) = 1 AS kept FROM lk",
    "jaccard_anchor": f"SELECT page_id, pos, {jaccard('s', False)} AS compat, {jaccard('s', True)} AS exact FROM (SELECT page_id, pos, string_split(anchor, ' ') AS s FROM lk)",
    "jaccard_url": f"SELECT page_id, pos, {jaccard('s', False)} AS compat, {jaccard('s', True)} AS exact FROM (SELECT page_id, pos, regexp_split_to_array(lower(dst), '[^\\p{{L}}\\p{{N}}]') AS s FROM lk)",
    "domain_inlinks": "SELECT domain, inlinks FROM dom",
    "l2_normalize": "SELECT domain, round(CASE WHEN norm = 0 THEN inlinks ELSE inlinks / norm END, 6) AS share FROM dom, (SELECT sqrt(sum(inlinks::double * inlinks)) AS norm FROM dom)",
    "frontier_scores": FRONTIER.format("batch"),
    "frontier_cascade": "WITH un AS (SELECT batch.*, CASE WHEN wave <= 1 OR rate_limited THEN 'early' WHEN batch.url IN (SELECT dst FROM lk WHERE anchor[1:3] = 'the') THEN 'relevant' END AS reason FROM batch WHERE batch.url NOT IN (SELECT url FROM crawled)), rest AS (SELECT * FROM un WHERE reason IS NULL), best AS (SELECT url FROM (" + FRONTIER.format("rest") + ") ORDER BY score DESC, url DESC LIMIT 400) SELECT url, coalesce(reason, CASE WHEN url IN (SELECT url FROM best) THEN 'scored' ELSE 'requeue' END) AS reason FROM un",
    "queue_assignment": "SELECT page_id, pos, (pos - 1) % 10 AS queue FROM lk",
    "queue_sticky": "SELECT domain, 1::bigint AS n_queues FROM dom",
    "crawl_gates": f"""SELECT page_id, url FROM (SELECT page_id, {canonical('url')} AS url, {part(PATH, 'url')} AS p, html FROM pages) WHERE html[1:15] = '<!DOCTYPE html>' AND url NOT IN (SELECT {canonical('url')} FROM pages WHERE {part(PATH, 'url')}[1:3] = '/de')
        AND concat(url, CASE WHEN page_id % 7 = 0 THEN '' ELSE '&r' END) NOT IN (SELECT url FROM crawled)""",
    "rate_limit_lag": LIMIT,
    "stream_rate_limit": LIMIT,
    "stream_counts": "SELECT user_id, count(*) AS inlinks FROM events GROUP BY user_id",
    "stream_dedup": "SELECT DISTINCT user_id FROM events",
    "json_props": "SELECT event_id, event_type, user_id, json_extract_string(props, '$.k') AS k FROM events",
    "time_functions": """SELECT event_id, strftime(ts, '%d-%m-%Y-%H:%M:%S.%f') AS text, true AS same, printf('%d:%02d:%02d.%03d', floor(s)::bigint // 3600, floor(s)::bigint % 3600 // 60, floor(s)::bigint % 60, round((s - floor(s)) * 1000)::bigint) AS took,
        -1::bigint AS number FROM (SELECT event_id, ts, abs(round(value, 3)) AS s FROM events)""",
    "ltr_pivot": "SELECT query_id, doc_id, " + ", ".join(f"coalesce(max(score) FILTER (WHERE model = '{n}'), 0) AS {n}" for n in FEATURES) + f" FROM ({LTR_RUNS}) GROUP BY query_id, doc_id",
    "ltr_labels": "SELECT query_id, doc_id, max(CASE WHEN rel > 0 THEN 1 ELSE 0 END)::bigint AS label FROM qrels GROUP BY query_id, doc_id",
    "ltr_negative_fill": """WITH lab AS (SELECT query_id, doc_id, max(CASE WHEN rel > 0 THEN 1 ELSE 0 END)::bigint AS label FROM qrels GROUP BY query_id, doc_id), have AS (SELECT query_id, sum(1 - label) AS n FROM lab GROUP BY query_id)
        SELECT * FROM lab UNION SELECT query_id, doc_id, 0 AS label FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS ix FROM run WHERE NOT EXISTS (SELECT 1 FROM lab WHERE lab.query_id = run.query_id AND lab.doc_id = run.doc_id AND label = 1)) LEFT JOIN have USING (query_id) WHERE ix <= 1000 - coalesce(n, 0)""",
    "df_range_filter": "SELECT term, df::bigint AS df FROM terms, st WHERE df > floor(0.02 * n) AND df < floor(0.95 * n)",
    "text_clean": "SELECT doc_id, len(w)::bigint AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM clean",
    "vocabulary_filter": "SELECT doc_id, count(*) AS n FROM tok WHERE term IN ('the', 'free', 'money', 'idiot', 'token', 'license') GROUP BY doc_id",
    "auc_ranksum": "SELECT round((s - p * (p + 1) / 2) / (p * q), 6) AS auc FROM (SELECT sum(label * r) AS s, sum(label)::double AS p, (count(*) - sum(label))::double AS q FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::double AS r FROM sc))",
    "top10_by_prob": "SELECT doc_id, score, label::bigint AS label FROM sc ORDER BY score DESC, doc_id LIMIT 10",
    "url_relevance": "SELECT url, count(*) AS relevance FROM (SELECT src AS url, greatest({a}, {b}) AS best FROM (SELECT src, list_distinct(string_split(anchor, ' ')) AS a, list_distinct(regexp_split_to_array(lower(src), '[^\\p{{L}}\\p{{N}}]')) AS b FROM lk)) WHERE floor(best * 10) > 1 GROUP BY url".format(
        **{x: f"len(list_intersect({x}, [{w}])) / (len({x}) + {len(i.URL_TOPICS)} + len(list_intersect({x}, [{w}])))::double" for x in "ab" for w in [",".join(f"'{y}'" for y in i.URL_TOPICS)]}
    ),
}

SQL = {k: with_(v) for k, v in SQL.items()}
