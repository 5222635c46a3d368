"""Catalogue: entry points, flows, traces and communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.text import name_tokens
from weft.operators import community as c
from weft.operators import flows as f
from weft.session import materialise

from .analogue import CALLS, STEPS, SYMBOLS, calls, steps, symbols, t


def _named(s, d):
    """Parts as functions: names in camel case, language by type, path from brand and type."""
    rows = symbols(s, d)
    camel = F.regexp_replace(F.initcap("name"), " ", "")
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("handle", "get", "on", "build", "")]), (F.col("id") % 5 + 1).cast("int")), camel)
    folder = F.element_at(F.array(*[F.lit(x) for x in ("src/pages/", "src/lib/", "app/routes/")]), (F.col("id") % 3 + 1).cast("int"))
    return rows.select("id", name.alias("name"), F.lit("Function").alias("label"), F.concat(folder, F.lower(F.regexp_replace("community", "#", "")), F.lit(".ts")).alias("file_path"),
                       F.lit("typescript").alias("language"), "is_exported", "community")


_NAMED = """na AS (SELECT id, ['handle', 'get', 'on', 'build', ''][id % 5 + 1] || upper(split_part(name, ' ', 1)[1]) || lower(split_part(name, ' ', 1)[2:]) || upper(split_part(name, ' ', 2)[1]) || lower(split_part(name, ' ', 2)[2:]) AS name,
  ['src/pages/', 'src/lib/', 'app/routes/'][id % 3 + 1] || lower(replace(community, '#', '')) || '.ts' AS file_path, is_exported, community FROM sy)"""
_SCORES = """de AS (SELECT id, count(*) FILTER (k = 'i') AS callers, count(*) FILTER (k = 'o') AS callees FROM (SELECT dst AS id, 'i' AS k FROM ce {w} UNION ALL SELECT src, 'o' FROM ce {w}) GROUP BY id),
sc AS (SELECT na.id, callees / (callers + 1) * CASE WHEN is_exported THEN 2.0 ELSE 1.0 END * CASE WHEN regexp_matches(name, '^get[A-Z]') THEN 0.3 WHEN regexp_matches(name, '^(handle|on)[A-Z]') THEN 1.5 ELSE 1.0 END
  * CASE id % 3 WHEN 0 THEN 3.0 WHEN 2 THEN 2.5 ELSE 1.0 END AS score FROM na JOIN de USING (id) WHERE callees > 0)"""


def _entries(s, d):
    return f.candidates(_named(s, d), calls(s, d))


_TOP = _SCORES.format(w="WHERE confidence >= 0.5") + ", en AS (SELECT id FROM sc ORDER BY score DESC, id LIMIT 200)"
_CALLS = f"{CALLS}, {SYMBOLS}, {_NAMED}, {_TOP}"
_BFS = """sf AS (SELECT src, dst FROM ce WHERE confidence >= 0.5),
bf(entry, node, step) USING KEY (entry, node) AS (SELECT id, id, 0 FROM en UNION
  SELECT x.entry, x.dst, min(x.step) FROM (SELECT entry, dst, step + 1 AS step FROM bf JOIN sf ON sf.src = bf.node) x
  LEFT JOIN recurring.bf r ON r.entry = x.entry AND r.node = x.dst WHERE r.node IS NULL GROUP BY ALL),
fl AS (SELECT entry, node, CAST(step AS INTEGER) AS step FROM bf)"""


def _flows(s, d):
    """Entries and the calls that are sure enough, which both are worked out from."""
    sure = materialise(calls(s, d).where(f"confidence >= {f.MIN_CONFIDENCE}"))
    return f.candidates(_named(s, d), sure), sure


def _membership(s, d):
    return symbols(s, d).select(F.col("id").alias("node"), "community")


def _flow_summary(s, d):
    out = f.level_summary(*_flows(s, d), _membership(s, d))
    return out.select("entry", "terminal", F.col("step_count").cast("long").alias("step_count"), "nodes", F.array_join("communities", ",").alias("communities"))


def _event_paths(s, d):
    rows = t(s, d, "events").select("user_id", F.date_trunc("day", "ts").alias("day"), F.struct("ts", "event_id", "event_type").alias("e"))
    grouped = rows.groupBy("user_id", "day").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return grouped.select(F.concat_ws("@", "user_id", F.date_format("day", "yyyy-MM-dd")).alias("key"), F.transform("e", lambda x: x["event_type"]).alias("path"))


_PATHS = """pa AS (SELECT CAST(user_id AS VARCHAR) || '@' || strftime(ts, '%Y-%m-%d') AS key, string_agg(event_type, chr(1) ORDER BY ts, event_id) AS path, count(*) AS n FROM events GROUP BY 1)"""
_FEW = "nc AS (SELECT min(a.key) AS key, a.path, any_value(a.n) AS n FROM pa a WHERE NOT EXISTS (SELECT 1 FROM pa b WHERE b.n > a.n AND contains(chr(1) || b.path || chr(1), chr(1) || a.path || chr(1))) GROUP BY a.path)"
_ENDS = "le AS (SELECT * FROM nc QUALIFY row_number() OVER (PARTITION BY split_part(path, chr(1), 1), split_part(path, chr(1), -1) ORDER BY n DESC, key) = 1)"


def _kept_paths(s, d):
    return f.longest_per_ends(f.drop_contained(_event_paths(s, d)))


def _text_path(frame):
    return frame.select("key", F.array_join("path", "\u0001").alias("path"))


def _processes(s, d):
    names = _event_paths(s, d).select(F.explode("path").alias("id")).distinct().withColumn("name", F.col("id"))
    groups = names.select(F.col("id").alias("node"), F.substring("id", 1, 1).alias("community"))
    return f.processes(f.longest(_kept_paths(s, d), 30), names, groups)


def _members(s, d):
    return symbols(s, d).select(F.col("id").alias("node"), F.col("community").alias("label"))


def _adj(s, d):
    e = calls(s, d)
    return e.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(e.select("dst", "src")).distinct()


_ADJ = "ad AS (SELECT DISTINCT src AS node, dst AS other FROM (SELECT src, dst FROM ce UNION ALL SELECT dst, src FROM ce))"


def _keywords(s, d):
    words = symbols(s, d).select(F.col("community").alias("label"), F.explode(name_tokens(F.col("name"))).alias("token")).groupBy("label", "token").agg(F.count("*").alias("n"))
    from weft.operators.graph import top_per_group

    return top_per_group(words, "label", [F.desc("n"), "token"], 5)


QUERIES = {
    "entry_point_scores": (lambda s, d: f.score_entries(_named(s, d), calls(s, d)).select("id", F.round("score", 6).alias("score")),
        f"WITH {CALLS}, {SYMBOLS}, {_NAMED}, {_SCORES.format(w='')} SELECT id, round(score, 6) AS score FROM sc"),
    "entry_candidates": (lambda s, d: f.candidates(_named(s, d), calls(s, d)).select("id", F.round("score", 6).alias("score")),
        f"WITH {CALLS}, {SYMBOLS}, {_NAMED}, {_SCORES.format(w='WHERE confidence >= 0.5')} SELECT id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, id LIMIT 200"),
    "bfs_flow_steps": (lambda s, d: f.bfs_steps(*_flows(s, d)), f"WITH RECURSIVE {_CALLS}, {_BFS} SELECT * FROM fl"),
    "flow_summary": (_flow_summary, f"""WITH RECURSIVE {_CALLS}, {_BFS} SELECT entry, arg_max(node, (step, node)) AS terminal, CAST(max(step) + 1 AS BIGINT) AS step_count, count(*) AS nodes,
  string_agg(DISTINCT community, ',' ORDER BY community) AS communities FROM fl JOIN sy ON sy.id = fl.node GROUP BY entry"""),
    "bounded_traces_depth4": (lambda s, d: f.traces(_entries(s, d), calls(s, d), depth=4).select("entry", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path")),
        f"""WITH RECURSIVE {_CALLS}, nx AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM ce QUALIFY k <= 4),
tr(entry, path, o) AS (SELECT id, [id], '' FROM en UNION ALL SELECT entry, list_append(path, dst), o || CAST(k AS VARCHAR) FROM tr JOIN nx ON nx.src = path[-1] WHERE len(path) < 4 AND NOT list_contains(path, dst)),
en2 AS (SELECT *, len(path) >= 4 OR NOT EXISTS (SELECT 1 FROM nx WHERE nx.src = path[-1] AND NOT list_contains(path, nx.dst)) AS ended FROM tr)
SELECT entry, array_to_string(path, ',') AS path FROM en2 WHERE ended AND len(path) >= 3 QUALIFY row_number() OVER (PARTITION BY entry ORDER BY len(path), o) <= 12"""),
    "trace_subset_dedupe": (lambda s, d: _text_path(f.drop_contained(_event_paths(s, d))), f"WITH {_PATHS}, {_FEW} SELECT key, path FROM nc"),
    "endpoint_dedupe_longest": (lambda s, d: _text_path(_kept_paths(s, d)), f"WITH {_PATHS}, {_FEW}, {_ENDS} SELECT key, path FROM le"),
    "process_rows": (lambda s, d: _processes(s, d)[0].select("id", "label", "process_type", F.col("step_count").cast("long").alias("step_count"), "communities"),
        f"""WITH {_PATHS}, {_FEW}, {_ENDS}, l AS (SELECT *, row_number() OVER (ORDER BY n DESC, key) - 1 AS i, string_split(path, chr(1)) AS p FROM le ORDER BY n DESC, key LIMIT 30)
SELECT 'proc_' || i || '_' || lower(regexp_replace(p[1], '[^a-zA-Z0-9]', '_', 'g')[:20]) AS id, upper(p[1][1]) || p[1][2:] || ' → ' || upper(p[-1][1]) || p[-1][2:] AS label,
  CASE WHEN len(list_distinct(list_transform(p, lambda x: x[1]))) > 1 THEN 'cross_community' ELSE 'intra_community' END AS process_type, n AS step_count, CAST(len(list_distinct(list_transform(p, lambda x: x[1]))) AS BIGINT) AS communities FROM l"""),
    "process_steps": (lambda s, d: steps(s, d).select("process", "node", "step"), f"WITH {STEPS} SELECT process, node, step FROM st"),
    "critical_paths": (lambda s, d: steps(s, d).groupBy("process").agg(F.count("*").alias("steps")).orderBy(F.desc("steps"), "process").limit(10), f"WITH {STEPS} SELECT process, count(*) AS steps FROM st GROUP BY process ORDER BY steps DESC, process LIMIT 10"),
    "process_edges": (lambda s, d: f.process_edges(steps(s, d).select("process", (F.col("event_id") % 500).alias("node")), calls(s, d)),
        f"WITH {CALLS}, {STEPS}, m AS (SELECT DISTINCT process, event_id % 500 AS node FROM st) SELECT a.process, src, dst FROM ce JOIN m a ON a.node = src JOIN m b ON b.node = dst AND b.process = a.process WHERE src <> dst"),
    "membership_cohesion_density": (lambda s, d: c.density(_members(s, d), _adj(s, d)),
        f"WITH {CALLS}, {SYMBOLS}, {_ADJ}, z AS (SELECT community AS label, count(*) AS n FROM sy GROUP BY 1), m AS (SELECT a.community AS label, count(*) AS m FROM ad JOIN sy a ON a.id = node JOIN sy b ON b.id = other WHERE a.community = b.community AND node < other GROUP BY 1) SELECT label, CASE WHEN n <= 1 THEN 1.0 ELSE round(coalesce(m, 0) / (n * (n - 1) / 2), 4) END AS cohesion FROM z LEFT JOIN m USING (label)"),
    "membership_cohesion_fraction": (lambda s, d: c.inner_share(_members(s, d), _adj(s, d)).select("label", F.round("cohesion", 6).alias("cohesion")),
        f"WITH {CALLS}, {SYMBOLS}, {_ADJ}, p AS (SELECT id, community AS label FROM sy QUALIFY row_number() OVER (PARTITION BY community ORDER BY id) <= 50), q AS (SELECT p.label, count(*) FILTER (b.community = p.label) / count(*) AS r FROM p JOIN ad ON ad.node = p.id JOIN sy b ON b.id = other GROUP BY 1), z AS (SELECT community AS label, count(*) AS n FROM sy GROUP BY 1) SELECT label, round(CASE WHEN n <= 1 THEN 1.0 ELSE least(1.0, coalesce(r, 1.0)) END, 6) AS cohesion FROM z LEFT JOIN q USING (label)"),
    "community_keywords_top5": (_keywords, f"WITH {SYMBOLS}, w AS (SELECT community AS label, unnest(regexp_extract_all(lower(name), '[a-z]+')) AS token FROM sy) SELECT label, token, count(*) AS n FROM w WHERE length(token) >= 3 GROUP BY label, token QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, token) <= 5"),
    "modal_folder_label": (lambda s, d: c.folder_label(_members(s, d), symbols(s, d)),
        f"WITH {SYMBOLS}, n AS (SELECT community AS label, split_part(file_path, '/', 1) AS folder, count(*) AS n FROM sy GROUP BY ALL) SELECT label, arg_min(upper(folder[1]) || folder[2:], (-n, folder)) AS heuristic_label FROM n GROUP BY label"),
    "label_propagation": (lambda s, d: c.propagate(_adj(s, d), symbols(s, d).select(F.col("id").alias("node"))), None),
    "leiden_communities": (lambda s, d: c.communities(_adj(s, d), symbols(s, d).select(F.col("id").alias("node")), method="leiden"), None),
    "communities_in_turn": (lambda s, d: c.communities(_adj(s, d), symbols(s, d).select(F.col("id").alias("node"))), None),
}
