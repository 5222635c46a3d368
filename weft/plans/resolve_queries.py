"""Catalogue: resolution of calls, parents, routes, imports and page links."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import resolve as r

from .analogue import CALLS, SYMBOLS, calls, symbols, t


def _symbols(s, d):
    return symbols(s, d).select("file_path", "name", F.col("id").alias("node_id"), "ord")


def _import_map(s, d):
    a = symbols(s, d).select(F.col("id").alias("k"), "file_path")
    b = symbols(s, d).select((F.col("id") - 1).alias("k"), F.col("file_path").alias("imported_path"))
    return a.join(b, "k").select("file_path", "imported_path").distinct()


def _refs(s, d):
    a = symbols(s, d).select(F.col("id").alias("src"), "file_path")
    b = symbols(s, d).select(F.col("id").alias("dst"), "name")
    return calls(s, d).join(a, "src").join(b, "dst").select("file_path", "name").distinct()


_IM = "im AS (SELECT DISTINCT a.file_path, b.file_path AS imported FROM sy a JOIN sy b ON b.id = a.id + 1)"
_REFS = "rf AS (SELECT DISTINCT a.file_path, b.name FROM ce JOIN sy a ON a.id = src JOIN sy b ON b.id = dst)"
_TIERS = """ow AS (SELECT file_path, name, max(id) AS id FROM sy GROUP BY ALL),
ip AS (SELECT r.file_path, r.name, min(s.id) AS id FROM rf r JOIN im USING (file_path) JOIN sy s ON s.file_path = im.imported AND s.name = r.name GROUP BY ALL),
an AS (SELECT name, min(id) AS id, count(*) AS n FROM sy GROUP BY name)"""
_TIERED = """SELECT r.file_path, r.name, coalesce(ow.id, ip.id, an.id) AS target,
  CASE WHEN ow.id IS NOT NULL THEN {same} WHEN ip.id IS NOT NULL THEN 0.9 WHEN an.n = 1 THEN 0.5 WHEN an.n > 1 THEN 0.3 END::DOUBLE AS confidence,
  CASE WHEN ow.id IS NOT NULL THEN 'same-file' WHEN ip.id IS NOT NULL THEN 'import-resolved' WHEN an.id IS NOT NULL THEN 'fuzzy-global' END AS reason
  FROM rf r LEFT JOIN ow USING (file_path, name) LEFT JOIN ip USING (file_path, name) LEFT JOIN an USING (name)"""


def _counts(s, d):
    refs = _refs(s, d).select("file_path", F.col("name").alias("called_name"), F.col("file_path").alias("source_id"))
    noise = symbols(s, d).where("name like 'red %'").select("name")
    return r.call_edges(refs, _symbols(s, d).withColumn("node_id", F.col("node_id").cast("string")), _import_map(s, d), noise)[1]


def _heritage(s, d):
    """A part extends the next brand's part of the same size class, by name."""
    a = symbols(s, d).select(F.col("id").alias("k"), "file_path", F.col("name").alias("class_name"))
    b = symbols(s, d).select((F.col("id") - 3).alias("k"), F.col("name").alias("parent_name"))
    return a.join(b, "k").select("file_path", "class_name", "parent_name", F.lit("extends").alias("kind")).distinct()


_HERITAGE = "he AS (SELECT DISTINCT a.file_path, a.name AS class_name, b.name AS parent_name FROM sy a JOIN sy b ON b.id = a.id + 3)"


def _routes(s, d):
    """A file routes to its neighbours' symbols: controller = name, method = name of the part after it."""
    a = symbols(s, d).select(F.col("id").alias("k"), "file_path", F.col("name").alias("controller_name"))
    b = symbols(s, d).select((F.col("id") - 1).alias("k"), F.col("name").alias("method_name"))
    return a.join(b, "k").select("file_path", "controller_name", "method_name").distinct()


def _links(s, d):
    """Pages link to others by ends of their addresses."""
    pages = t(s, d, "pages")
    files = pages.select(F.split("url", r"\?")[0].alias("path")).distinct()
    files = files.withColumn("ord", F.struct("path"))
    links = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("request"))
    ends = pages.select(F.upper(F.array_join(F.slice(F.split(F.split("url", r"\?")[0], "/"), -2, 2), "/")).alias("request"))
    wanted = links.union(ends).distinct()
    return r.by_suffix(wanted, r.suffix_index(files))


_EXT = "(VALUES " + ", ".join(f"({k}, '{e}')" for k, e in enumerate(r.EXTENSIONS)) + ") AS e(rank, ext)"
_LINKS = f"""WITH f AS (SELECT DISTINCT split_part(url, '?', 1) AS path FROM pages),
sx AS (SELECT path, array_to_string(string_split(path, '/')[k:], '/') AS suffix FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS k FROM f)),
fs AS (SELECT suffix, min(path) AS path FROM sx GROUP BY suffix),
rq AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS request FROM pages UNION SELECT upper(array_to_string(string_split(split_part(url, '?', 1), '/')[-2:], '/')) FROM pages),
tr AS (SELECT request, k, array_to_string(p[k:], '/') AS want FROM (SELECT request, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT request, list_filter(string_split(request, '/'), lambda x: x <> '') AS p FROM rq))),
h AS (SELECT request, k, rank, want || ext <> suffix AS inexact, fs.path FROM tr CROSS JOIN {_EXT} JOIN fs ON lower(fs.suffix) = lower(want || ext))
SELECT request, path FROM h QUALIFY row_number() OVER (PARTITION BY request ORDER BY k, rank, inexact, path) = 1"""


def _incremental(s, d):
    """Vectors without a label yet: those still to be done."""
    return t(s, d, "embeddings").select("vec_id").join(t(s, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")


QUERIES = {
    "call_resolution_3tier": (lambda s, d: r.resolve(_refs(s, d), _symbols(s, d), _import_map(s, d)),
        f"WITH {CALLS}, {SYMBOLS}, {_IM}, {_REFS}, {_TIERS} {_TIERED.format(same=0.85)}"),
    "call_resolution_counts": (_counts,
        f"WITH {CALLS}, {SYMBOLS}, {_REFS}, nz AS (SELECT DISTINCT name FROM sy WHERE name LIKE 'red %') SELECT count(*) FILTER (name NOT IN (SELECT name FROM nz)) AS resolved, CAST(0 AS BIGINT) AS unresolved, count(*) FILTER (name IN (SELECT name FROM nz)) AS skipped FROM rf"),
    "heritage_resolution": (lambda s, d: r.heritage_edges(_heritage(s, d), _symbols(s, d), _import_map(s, d)).select("src", "dst", "type", "confidence", "reason"),
        f"WITH {SYMBOLS}, {_IM}, {_HERITAGE}, rf AS (SELECT DISTINCT file_path, parent_name AS name FROM he), {_TIERS}, ti AS ({_TIERED.format(same=0.95)}) SELECT ow.id AS src, target AS dst, 'EXTENDS' AS type, confidence, reason FROM he JOIN ow ON ow.file_path = he.file_path AND ow.name = class_name JOIN ti ON ti.file_path = he.file_path AND ti.name = parent_name"),
    "heritage_open": (lambda s, d: r.heritage_edges_open(_heritage(s, d), _symbols(s, d).withColumn("node_id", F.col("node_id").cast("string"))).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("parents")),
        f"""WITH {SYMBOLS}, {_HERITAGE}, ow AS (SELECT file_path, name, max(id) AS id FROM sy GROUP BY ALL), an AS (SELECT name, min(id) AS id FROM sy GROUP BY name),
x AS (SELECT DISTINCT ow.id AS src, an.id AS dst FROM he JOIN ow ON ow.file_path = he.file_path AND ow.name = class_name JOIN an ON an.name = parent_name) SELECT 'EXTENDS' AS type, count(*) AS n, count(DISTINCT dst) AS parents FROM x WHERE src <> dst"""),
    "route_resolution": (lambda s, d: r.route_edges(_routes(s, d), _symbols(s, d).withColumn("node_id", F.col("node_id").cast("string")), _import_map(s, d)).select("src", "dst", F.round("confidence", 6).alias("confidence")),
        f"""WITH {SYMBOLS}, {_IM}, ro AS (SELECT DISTINCT a.file_path, a.name AS cn, b.name AS mn FROM sy a JOIN sy b ON b.id = a.id + 1), rf AS (SELECT DISTINCT file_path, cn AS name FROM ro), {_TIERS},
ni AS (SELECT r.file_path, r.name, arg_min(s.file_path, s.id) AS f FROM rf r JOIN im USING (file_path) JOIN sy s ON s.file_path = im.imported AND s.name = r.name GROUP BY ALL), af AS (SELECT name, arg_min(file_path, id) AS f, count(*) AS n FROM sy GROUP BY name),
c AS (SELECT ro.file_path, mn, CASE WHEN ni.f IS NOT NULL THEN 0.9 WHEN af.n = 1 THEN 0.7 ELSE 0.5 END::DOUBLE AS base, coalesce(ni.f, af.f) AS cf FROM ro JOIN af ON af.name = cn LEFT JOIN ni ON ni.file_path = ro.file_path AND ni.name = cn)
SELECT 'File:' || c.file_path AS src, coalesce(CAST(ow.id AS VARCHAR), 'Method:' || cf || ':' || mn) AS dst, round(CASE WHEN ow.id IS NOT NULL THEN base ELSE base * 0.8 END, 6) AS confidence FROM c LEFT JOIN ow ON ow.file_path = cf AND ow.name = mn"""),
    "symbol_lookup_in_file": (lambda s, d: r.lookup_in_file(_refs(s, d), _symbols(s, d)),
        f"WITH {CALLS}, {SYMBOLS}, {_REFS}, ow AS (SELECT file_path, name, max(id) AS id FROM sy GROUP BY ALL), an AS (SELECT name, min(id) AS id FROM sy GROUP BY name) SELECT rf.file_path, rf.name, coalesce(ow.id, an.id) AS node_id FROM rf LEFT JOIN ow USING (file_path, name) LEFT JOIN an USING (name)"),
    "symbol_table_stats": (lambda s, d: r.symbol_stats(_symbols(s, d)), f"WITH {SYMBOLS} SELECT count(DISTINCT file_path) AS files, count(DISTINCT name) AS names, count(*) AS symbols FROM sy"),
    "suffix_resolve_links": (_links, _LINKS),
    "incremental_skip": (_incremental, "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"),
}
