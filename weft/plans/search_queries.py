"""Catalogue: full-text, vector and mixed search; line searches, reads and renames over texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import vectors
from weft.functions.text import search_pattern, search_tokens
from weft.operators import search as s

from .analogue import STEPS, steps, t

QUERY = "that the onen lytion"
NARROW = "the and"
LIMIT = 20


def _docs(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source")


def _index(spark, d, text="text"):
    return s.Bm25.build(_docs(spark, d), "id", text)


def _rounded(frame, *names):
    return frame.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in frame.columns])


def _bm25(alias: str, source: str, column: str, terms: list[str], weight: float = 1.0, least: int = 0) -> str:
    """Common table expressions ending in `alias`(id, score)."""
    listed = ", ".join(f"('{x}')" for x in terms)
    having = f" HAVING count(*) >= {least}" if least else ""
    return f"""{alias}_d AS (SELECT id, regexp_extract_all(lower(coalesce({column}, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {source}),
{alias}_c AS (SELECT count(*) AS n, avg(len(w)) AS average FROM {alias}_d),
{alias}_p AS (SELECT id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT id, len(w) AS length, unnest(w) AS term FROM {alias}_d) GROUP BY id, term),
{alias}_t AS (SELECT term, count(*) AS df FROM {alias}_p GROUP BY term),
{alias} AS (SELECT id, sum({weight} * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) AS score
  FROM {alias}_p JOIN {alias}_t USING (term) CROSS JOIN {alias}_c WHERE term IN (SELECT * FROM (VALUES {listed})) GROUP BY id{having})"""


_SRC = "src AS (SELECT doc_id AS id, text, source FROM documents)"
_RANK = "row_number() OVER (ORDER BY score DESC, {id}) AS rank"
_TERMS, _NARROW = QUERY.split(), NARROW.split()
_BM = _bm25("bm", "src", "text", _TERMS)
_TOP = f"bt AS (SELECT id, score, {_RANK.format(id='id')} FROM bm QUALIFY rank <= {LIMIT})"
_DOT = "list_dot_product(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) / (SELECT sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) FROM embeddings WHERE vec_id = 0)"
_KNN = f"ks AS (SELECT vec_id AS id, {_DOT} AS score FROM embeddings), kn AS (SELECT id, score, {_RANK.format(id='id')} FROM ks QUALIFY rank <= {LIMIT})"


def _knn(spark, d, k=LIMIT):
    rows = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    query = rows.where("id = 0").first()["embedding"]  # one row, by its key
    found = vectors.nearest(rows, query, k, "id", "embedding")
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def _fields(spark, d):
    return s.field_search({"text": (_index(spark, d), 1.0), "source": (_index(spark, d, "source"), 2.0)}, "web that the", LIMIT, None)


def _expanded(spark, d):
    return s.field_search({"text": (_index(spark, d), 1.0)}, "lyti thatt", LIMIT)


_EXPAND = "ex AS (SELECT term, max(w) AS w FROM (" + " UNION ALL ".join(
    f"""SELECT term, CASE WHEN term = '{q}' THEN 1.0 WHEN starts_with(term, '{q}') THEN 0.375 * length(term) / (length(term) + 0.3 * (length(term) - {len(q)}))
  WHEN abs(length(term) - {len(q)}) <= {round(0.2 * len(q))} AND levenshtein(term, '{q}') <= {round(0.2 * len(q))} THEN 0.45 * length(term) / (length(term) + levenshtein(term, '{q}')) END AS w FROM bm_t"""
    for q in ("lyti", "thatt")) + ") WHERE w IS NOT NULL GROUP BY term)"


def _rrf(spark, d, wa=0.4, wb=0.6, first=1):
    lists = {"bm25": (_index(spark, d).search(QUERY, LIMIT), wa), "semantic": (_knn(spark, d), wb)}
    out = s.rrf(lists, first_rank=first).fillna(0, ["bm25_rank", "semantic_rank"])  # 0: not in that list
    return _rounded(out, "score", "bm25_score", "semantic_score")


def _rrf_sql(wa, wb, first):
    part = "1.0 / (60 + rank - 1 + {f})".format(f=first)
    return f"""WITH {_SRC}, {_BM}, {_TOP}, {_KNN}, al AS (SELECT id, 'bm25' AS l, score, rank, {wa} * {part} AS r FROM bt UNION ALL SELECT id, 'semantic', score, rank, {wb} * {part} FROM kn),
f AS (SELECT id, sum(r) AS s, string_agg(l, ',' ORDER BY l) AS sources, round(coalesce(max(score) FILTER (l = 'bm25'), 0), 6) AS bm25_score, CAST(coalesce(max(rank) FILTER (l = 'bm25'), 0) AS INTEGER) AS bm25_rank,
  round(coalesce(max(score) FILTER (l = 'semantic'), 0), 6) AS semantic_score, CAST(coalesce(max(rank) FILTER (l = 'semantic'), 0) AS INTEGER) AS semantic_rank FROM al GROUP BY id)
SELECT id, round(s, 6) AS score, sources, bm25_score, bm25_rank, semantic_score, semantic_rank, CAST(row_number() OVER (ORDER BY s DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= {LIMIT}"""


def _members(spark, d):
    st = steps(spark, d).select((F.col("event_id") % 200).alias("id"), F.col("process"), "step")
    cohesion = t(spark, d, "documents").select(F.col("doc_id").alias("id"), ((F.col("doc_id") % 7) / 10).alias("cohesion"))
    return st, cohesion


def _grouped(spark, d, part):
    hits = s.rrf({"bm25": (_index(spark, d).search(QUERY, 50), 1.0), "semantic": (_knn(spark, d, 50), 1.0)}, first_rank=0, limit=50).select("id", "score")
    return _rounded(s.process_groups(hits, *_members(spark, d))[part], "priority", "score")


_HITS = f"""{_SRC}, {_BM}, b5 AS (SELECT id, {_RANK.format(id='id')} FROM bm QUALIFY rank <= 50), {_KNN.replace(f'<= {LIMIT}', '<= 50')}, {STEPS},
hi AS (SELECT id, sum(1.0 / (60 + rank - 1)) AS score FROM (SELECT id, rank FROM b5 UNION ALL SELECT id, rank FROM kn) GROUP BY id ORDER BY score DESC, id LIMIT 50),
sp AS (SELECT event_id % 200 AS id, process, step FROM st), co AS (SELECT doc_id AS id, max((doc_id % 7) / 10) AS cohesion FROM documents GROUP BY doc_id),
wi AS (SELECT hi.id, score, coalesce(cohesion, 0.0) AS cohesion, process, step FROM hi LEFT JOIN co USING (id) JOIN sp USING (id)),
be AS (SELECT process, sum(score) + 0.1 * max(cohesion) AS p, count(*) AS symbol_count FROM wi GROUP BY process ORDER BY p DESC, process LIMIT 5)"""
_OWN = """, nu AS (SELECT wi.*, p, row_number() OVER (PARTITION BY process ORDER BY score DESC, id, step) AS n FROM wi JOIN be USING (process) QUALIFY n <= 10)
SELECT process, id, round(score, 6) AS score, step FROM nu QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, process, n) = 1"""


def _files(spark, d):
    return t(spark, d, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


_FILES = "fi AS (SELECT concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, text AS content FROM documents)"
_LINES = f"{_FILES}, li AS (SELECT path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM fi WHERE content IS NOT NULL)"


def _pages(spark, d):
    return t(spark, d, "pages").select(F.col("url").alias("path"), F.col("html").alias("content"))


def _best_page(spark, d):
    return s.read_file(_pages(spark, d), "example.com/825", 300).select("path", F.length("content").alias("kept"), "truncated", F.col("lines").cast("long").alias("lines"))


def _rename(spark, d):
    files = _files(spark, d)
    refs = files.where(F.endswith("path", F.lit("5"))).where("content is not null").select("path")
    return s.rename_plan(files.where("content is not null"), "lytion", "renamed", ("nowhere", 1), refs).groupBy("source").agg(
        F.count("*").alias("edits"), F.countDistinct("path").alias("files"), F.sum(F.length("new_text")).alias("chars"))


_RE = "(^|[^A-Za-z0-9_])lytion($|[^A-Za-z0-9_])"
_TRIM = "trim({}, ' ')"

QUERIES = {
    "bm25_disjunctive": (lambda k, d: _rounded(_index(k, d).search(QUERY, LIMIT), "score"), f"WITH {_SRC}, {_BM} SELECT id, round(score, 6) AS score, CAST({_RANK.format(id='id').replace(' AS rank', '')} AS INTEGER) AS rank FROM bm QUALIFY rank <= {LIMIT}"),
    "bm25_conjunctive": (lambda k, d: _rounded(_index(k, d).search(NARROW, LIMIT, True), "score"),
        f"WITH {_SRC}, {_bm25('bm', 'src', 'text', _NARROW, least=len(_NARROW))} SELECT id, round(score, 6) AS score, CAST({_RANK.format(id='id').replace(' AS rank', '')} AS INTEGER) AS rank FROM bm QUALIFY rank <= {LIMIT}"),
    "bm25_multi_field_sum": (lambda k, d: _rounded(_fields(k, d), "score"),
        f"WITH {_SRC}, {_bm25('ba', 'src', 'text', ['web', 'that', 'the'])}, {_bm25('bb', 'src', 'source', ['web', 'that', 'the'], 2.0)}, s AS (SELECT id, sum(score) AS score FROM (SELECT * FROM ba UNION ALL SELECT * FROM bb) GROUP BY id) SELECT id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= {LIMIT}"),
    "bm25_prefix_fuzzy": (lambda k, d: _rounded(_expanded(k, d), "score"),
        f"WITH {_SRC}, {_BM}, {_EXPAND}, s AS (SELECT id, sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) AS score FROM bm_p JOIN bm_t USING (term) JOIN ex USING (term) CROSS JOIN bm_c GROUP BY id) SELECT id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= {LIMIT}"),
    "bm25_index_stats": (lambda k, d: (lambda i: i.vocabulary.agg(F.count("*").alias("terms"), F.sum("df").alias("postings")).withColumn("documents", F.lit(i.size[0]).cast("long")))(_index(k, d)),
        f"WITH {_SRC}, {_BM} SELECT (SELECT count(*) FROM bm_t) AS terms, (SELECT CAST(sum(df) AS BIGINT) FROM bm_t) AS postings, (SELECT n FROM bm_c) AS documents"),
    "knn_cosine_top20": (lambda k, d: _rounded(_knn(k, d), "score"), f"WITH {_KNN} SELECT id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM kn"),
    "knn_threshold": (lambda k, d: vectors.within(_knn(k, d), 0.6).select("id", F.round("distance", 6).alias("distance")), f"WITH {_KNN} SELECT id, round(1 - score, 6) AS distance FROM kn WHERE 1 - score < 0.6"),
    "rrf_weighted": (_rrf, _rrf_sql(0.4, 0.6, 1)),
    "rrf_file_level": (lambda k, d: _rrf(k, d, 1.0, 1.0, 1), _rrf_sql(1.0, 1.0, 1)),
    "rrf_symbol_level": (lambda k, d: _rrf(k, d, 1.0, 1.0, 0), _rrf_sql(1.0, 1.0, 0)),
    "process_grouped_search": (lambda k, d: _grouped(k, d, 0), f"WITH {_HITS} SELECT process, round(p, 3) AS priority, symbol_count FROM be"),
    "process_grouped_symbols": (lambda k, d: _grouped(k, d, 1), f"WITH {_HITS}{_OWN}"),
    "process_grouped_definitions": (lambda k, d: _grouped(k, d, 2), f"WITH {_HITS} SELECT id, round(score, 6) AS score FROM hi WHERE id NOT IN (SELECT id FROM sp) ORDER BY score DESC, id LIMIT 20"),
    "grep_lines": (lambda k, d: s.grep(_files(k, d), "lytion", width=40), f"WITH {_LINES} SELECT path, line, substring(trim(text, ' '), 1, 40) AS text FROM li WHERE regexp_matches(text, '(?i)lytion') ORDER BY path, line LIMIT 100"),
    "grep_path_filtered": (lambda k, d: s.grep(_files(k, d), "[0-9]{3}", "/en/", True, width=40),
        f"WITH {_LINES} SELECT path, line, substring(trim(text, ' '), 1, 40) AS text FROM li WHERE contains(lower(path), '/en/') AND regexp_matches(text, '[0-9]{{3}}') ORDER BY path, line LIMIT 100"),
    "read_best_path": (_best_page, """WITH c AS (SELECT url AS path, html AS content, string_split(lower(url), '/') AS p FROM pages),
a AS (SELECT *, list_min(list_filter(range(1, len(p) + 1), lambda i: contains(p[i], 'example.com'))) AS i1 FROM c),
b AS (SELECT *, list_min(list_filter(range(coalesce(i1, 0) + 1, len(p) + 1), lambda i: contains(p[i], '825'))) AS i2 FROM a),
s AS (SELECT *, CASE WHEN lower(path) = 'example.com/825' THEN 1000 WHEN ends_with(lower(path), 'example.com/825') THEN 300 - length(path)
  WHEN (i1 IS NOT NULL)::INT * 10 + (i2 IS NOT NULL)::INT * 10 >= 10 THEN (i1 IS NOT NULL)::INT * 10 + (i2 IS NOT NULL)::INT * 10 END AS score FROM b)
SELECT path, length(substring(content, 1, 300)) AS kept, length(content) > 300 AS truncated, CAST(len(string_split(content, chr(10))) AS BIGINT) AS lines FROM s WHERE score IS NOT NULL ORDER BY score DESC, path LIMIT 1"""),
    "path_suggestions": (lambda k, d: s.path_suggestions(_pages(k, d), "x/82"), "SELECT url AS path FROM pages WHERE contains(lower(url), '82') ORDER BY url LIMIT 5"),
    "rename_plan": (_rename, f"""WITH {_LINES}, k AS (SELECT path, line, text, 'graph' AS source FROM li WHERE ends_with(path, '5') AND contains(text, 'lytion') QUALIFY row_number() OVER (PARTITION BY path ORDER BY line) = 1
  UNION ALL SELECT path, line, text, 'text_search' FROM li WHERE NOT ends_with(path, '5') AND regexp_matches(text, '\\blytion\\b'))
SELECT source, count(*) AS edits, count(DISTINCT path) AS files, CAST(sum(length(trim(regexp_replace(text, '\\blytion\\b', 'renamed', 'g'), ' '))) AS BIGINT) AS chars FROM k GROUP BY source"""),
    "search_pattern_of_command": (lambda k, d: t(k, d, "documents").select("doc_id", search_pattern(F.concat(F.lit("rg -n '"), F.substring("text", 1, 12), F.lit("' src"))).alias("pattern")),
        """WITH c AS (SELECT doc_id, 'rg -n ''' || substring(text, 1, 12) || ''' src' AS c FROM documents), e AS (SELECT doc_id, regexp_extract(c, '(?:grep|rg|ag)\\s+(?:-[a-zA-Z]*\\s+)*["'']([^"'']+)["'']', 1) AS a, regexp_extract(c, '(?:grep|rg|ag)\\s+(?:-[a-zA-Z]*\\s+)*(\\S+)', 1) AS b FROM c)
SELECT doc_id, CASE WHEN a <> '' AND NOT regexp_matches(a, '^[/.\\-]') THEN a WHEN b <> '' AND NOT regexp_matches(b, '^[/.\\-]') THEN b END AS pattern FROM e"""),
    "search_token_counts": (lambda k, d: t(k, d, "pages").select("page_id", F.size(search_tokens(F.col("url"))).cast("long").alias("n")),
        """SELECT page_id, CAST(len(list_filter(regexp_split_to_array(lower(url), '[\\s\\-_./\\\\(){}\\[\\]<>:;,!?''"]+'), lambda x: length(x) > 1 AND x NOT IN ('const','let','var','function','return','if','else','for','while','class','new','this','import','export','from','default','async','await','try','catch','throw','typeof','instanceof','true','false','null','undefined','the','is','at','which','on','a','an','and','or','but','in','with','to','of','it','be','as','by','that','are','was','were'))) AS BIGINT) AS n FROM pages"""),
}
