"""Catalogue: row-level functions over texts, addresses and names; groupings, changes and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import paths, text as x
from weft.functions.vectors import dot, normalise
from weft.operators import changes as ch

from .analogue import SYMBOLS, symbols, t


def _docs(s, d):
    return t(s, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))


_D = "d AS (SELECT doc_id, coalesce(text, '') AS text, source, lang, n_chars FROM documents)"
_URL = "u AS (SELECT page_id, '/' || lower(split_part(regexp_replace(url, '^[a-z]+://', ''), '?', 1)) AS p FROM pages)"


def _path(s, d):
    return t(s, d, "pages").select("page_id", F.split(F.regexp_replace("url", "^[a-z]+://", ""), r"\?")[0].alias("path"))


def _made_paths(s, d):
    """A source path for every part."""
    name = F.regexp_replace("name", " ", "_")
    tail = F.element_at(F.array(*[F.lit(v) for v in (".ts", "_test.py", ".spec.js", ".go", "Controller.java", ".min.js", ".rs")]), (F.col("id") % 7 + 1).cast("int"))
    folder = F.element_at(F.array(*[F.lit(v) for v in ("src/pages", "src/tests", "node_modules/x", "pkg/handlers", "app/utils")]), (F.col("id") % 5 + 1).cast("int"))
    return symbols(s, d).select("id", F.concat(folder, F.lit("/"), name, tail).alias("path"))


_MADE = f"{SYMBOLS}, mp AS (SELECT id, ['src/pages', 'src/tests', 'node_modules/x', 'pkg/handlers', 'app/utils'][id % 5 + 1] || '/' || replace(name, ' ', '_') || ['.ts', '_test.py', '.spec.js', '.go', 'Controller.java', '.min.js', '.rs'][id % 7 + 1] AS path FROM sy)"


def _hints(s, d):
    hint = paths.framework_of_path(F.col("path"))
    return _made_paths(s, d).select("id", hint["framework"].alias("framework"), hint["multiplier"].alias("multiplier"), paths.language(F.col("path")).alias("language"))


def _path_flags(s, d):
    p = F.col("path")
    return _made_paths(s, d).select("id", paths.is_test_file(p).alias("test"), paths.is_test_for_impact(p).alias("impact_test"), paths.is_utility_file(p).alias("utility"), paths.is_ignored(p).alias("ignored"))


def _snippets(s, d):
    body = x.snippet(F.col("text"), F.when(F.col("doc_id") % 2 == 0, "File").otherwise("Function"), F.col("doc_id") % 5, F.col("doc_id") % 5 + 3)
    return _docs(s, d).select("doc_id", F.md5(body).alias("digest"), F.length(body).alias("n"))


def _cleaned(s, d):
    c = F.col("text")
    return _docs(s, d).select("doc_id", F.md5(x.sanitize(c)).alias("sane"), x.is_binary_text(c).alias("binary"), x.estimate_tokens(c).alias("tokens"),
                              F.md5(x.truncate_words(c, 60)).alias("short"), F.md5(x.clean_content(c)).alias("clean"))


def _normalised(s, d):
    e = t(s, d, "embeddings")
    return e.select("vec_id", F.round(dot(normalise(F.col("embedding")), F.col("embedding")), 5).alias("norm"))


def _runs(s, d):
    """Each conversation as an evaluated task: its role is the mode."""
    c = t(s, d, "conversations")
    return c.select(F.concat(F.lit("model_"), F.element_at(F.array(F.lit("baseline"), F.lit("native"), F.lit("native_augment")), (F.col("conv_id") % 3 + 1).cast("int"))).alias("run_id"),
                    F.concat_ws("-", "conv_id", "turn").alias("instance_id"), F.when(F.col("turn") % 2 == 1, F.col("text")).otherwise("").alias("patch"),
                    (F.length("text") / 100).alias("cost"), F.col("turn").alias("api_calls"), (F.col("turn") % 3).alias("tool_calls"), (F.col("conv_id") % 2).alias("augment_hits"), F.lit(1).cast("long").alias("augment_calls"))


_RUNS = """ru AS (SELECT 'model_' || ['baseline', 'native', 'native_augment'][conv_id % 3 + 1] AS run_id, CASE WHEN turn % 2 = 1 THEN text ELSE '' END AS patch, length(text) / 100 AS cost, turn AS api_calls, turn % 3 AS tool_calls, conv_id % 2 AS ah FROM conversations),
me AS (SELECT run_id, count(*) AS n_instances, count(*) FILTER (regexp_matches(coalesce(patch, ''), '\\S')) AS n_with_patch, sum(coalesce(cost, 0)) AS total_cost, CAST(sum(api_calls) AS BIGINT) AS total_api_calls, CAST(sum(tool_calls) AS BIGINT) AS total_tool_calls, sum(ah) / count(*) AS hit FROM ru GROUP BY run_id)"""


def _metrics(s, d):
    m = ch.run_metrics(_runs(s, d))
    return m.select("run_id", "n_instances", "n_with_patch", *[F.round(c, 6).alias(c) for c in ("patch_rate", "total_cost", "avg_cost", "avg_api_calls", "augment_hit_rate")], "total_api_calls", "total_tool_calls")


def _deltas(s, d):
    out = ch.mode_deltas(ch.run_metrics(_runs(s, d)))
    return out.select("model", "mode", *[F.round(c, 6).alias(c) for c in ("patch_rate", "patch_rate_delta", "cost_delta_pct")])


def _pivot(s, d):
    return ch.mode_table(ch.run_metrics(_runs(s, d)), ("baseline", "native", "native_augment")).select(
        "model", *[F.round(c, 6).alias(c) for c in ("baseline", "native", "native_augment")])


def _files(s, d):
    return _docs(s, d).select(F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


_F = f"{_D}, f AS (SELECT concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), CAST(doc_id AS VARCHAR)) AS path, text FROM d)"


def _changed(s, d):
    return _files(s, d).where(F.endswith("path", F.lit("/7")) | F.endswith("path", F.lit("/11"))).select("path")


def _change_parts(s, d):
    nodes = symbols(s, d).select(F.col("id"), "name", "label", F.concat(F.lit("repo/"), "file_path").alias("file_path"))
    changed = symbols(s, d).where("id in (3, 5)").select(F.col("file_path").alias("path")).distinct()
    st = t(s, d, "events").select((F.col("event_id") % 997).alias("id"), F.col("user_id").alias("process"), F.col("event_id").alias("step"))
    return nodes, changed, st


_CHANGE = f"""{SYMBOLS}, cf AS (SELECT DISTINCT file_path AS path FROM sy WHERE id IN (3, 5)),
cs AS (SELECT path, id FROM cf JOIN sy ON contains('repo/' || sy.file_path, cf.path) QUALIFY row_number() OVER (PARTITION BY path ORDER BY id) <= 20),
ap AS (SELECT DISTINCT user_id AS process FROM events JOIN cs ON cs.id = event_id % 997)"""


def _affected(s, d):
    modules = _files(s, d).select(F.split("path", "/")[0].alias("module"), "path")
    some = modules.where(~F.endswith("path", F.lit("/11")))
    return ch.affected_modules(some, _changed(s, d))


QUERIES = {
    "sanitize_text": (_cleaned, f"""WITH {_D} SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS sane,
  length(text) > 0 AND length(regexp_replace(text[:1000], '[^\\x00-\\x08\\x0E-\\x1F\\x7F]', '', 'g')) * 10 >= length(text[:1000]) AS binary, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens,
  md5(CASE WHEN length(text) <= 60 THEN text WHEN contains(text[:60], ' ') AND 60 - instr(reverse(text[:60]), ' ') > 48 THEN text[:60 - instr(reverse(text[:60]), ' ')] || '...' ELSE text[:60] || '...' END) AS short,
  md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[\\t\\x0B\\f\\r ]+(\\n|$)', '\\1', 'g'), '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')) AS clean FROM d"""),
    "content_snippet": (_snippets, f"""WITH {_D}, l AS (SELECT doc_id, text, string_split(text, chr(10)) AS p, greatest(0, doc_id % 5 - 2) AS lo, least(len(string_split(text, chr(10))) - 1, doc_id % 5 + 5) AS hi FROM d),
b AS (SELECT doc_id, CASE WHEN text = '' THEN '' WHEN length(regexp_replace(text[:1000], '[^\\x00-\\x08\\x0E-\\x1F\\x7F]', '', 'g')) * 10 >= length(text[:1000]) THEN '[Binary file - content not stored]'
  WHEN doc_id % 2 = 0 THEN CASE WHEN length(text) <= 10000 THEN text ELSE text[:10000] || chr(10) || '... [truncated]' END
  ELSE CASE WHEN length(array_to_string(p[lo + 1:hi + 1], chr(10))) <= 5000 THEN array_to_string(p[lo + 1:hi + 1], chr(10)) ELSE array_to_string(p[lo + 1:hi + 1], chr(10))[:5000] || chr(10) || '... [truncated]' END END AS s FROM l)
SELECT doc_id, md5(s) AS digest, length(s) AS n FROM b"""),
    "node_ids": (lambda s, d: symbols(s, d).select("id", x.node_id(F.col("label"), F.concat_ws(":", "file_path", "name", "id")).alias("node_id")),
        f"WITH {SYMBOLS} SELECT id, lower(label) || '_' || sha256(file_path || ':' || name || ':' || id)[:16] AS node_id FROM sy"),
    "name_helpers": (lambda s, d: symbols(s, d).select("id", x.sanitize_id(F.col("name")).alias("sid"), x.slugify(F.col("file_path")).alias("slug"), x.capitalize(F.col("name")).alias("cap"), paths.short_path(F.concat(F.lit("a/b/"), "file_path")).alias("short")),
        f"WITH {SYMBOLS} SELECT id, lower(regexp_replace(name, '[^a-zA-Z0-9]', '_', 'g')[:20]) AS sid, regexp_replace(regexp_replace(lower(file_path), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')[:60] AS slug, upper(name[1]) || name[2:] AS cap, 'b/' || file_path AS short FROM sy"),
    "embedding_texts": (lambda s, d: symbols(s, d).select("id", x.embedding_text(F.col("label"), F.col("name"), F.col("file_path")).alias("text"), x.plain_embedding_text(F.col("label"), F.col("name"), F.col("file_path")).alias("plain")),
        f"WITH {SYMBOLS} SELECT id, label || ': ' || name || chr(10) || 'File: ' || split_part(file_path, '/', 2) || chr(10) || 'Directory: ' || split_part(file_path, '/', 1) AS text, label || ' ' || name || ' ' || file_path AS plain FROM sy"),
    "framework_hint": (_hints, f"""WITH {_MADE} SELECT id, CASE WHEN regexp_matches(path, '^src/pages/.*\\.(ts|js)$') THEN 'nextjs-pages' WHEN ends_with(path, 'Controller.java') THEN 'spring' WHEN path LIKE 'pkg/handlers/%.js' THEN 'handlers' WHEN path LIKE 'pkg/handlers/%.ts' THEN 'handlers' WHEN path LIKE 'pkg/handlers/%.go' THEN 'go-http' WHEN path LIKE 'pkg/handlers/%.rs' THEN 'rust-web' END AS framework,
  CASE WHEN regexp_matches(path, '^src/pages/.*\\.(ts|js)$') THEN 3.0 WHEN ends_with(path, 'Controller.java') THEN 3.0 WHEN regexp_matches(path, '^pkg/handlers/.*\\.(js|ts|go|rs)$') THEN 2.5 END::DOUBLE AS multiplier,
  CASE id % 7 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'javascript' WHEN 3 THEN 'go' WHEN 4 THEN 'java' WHEN 5 THEN 'javascript' ELSE 'rust' END AS language FROM mp"""),
    "path_flags": (_path_flags, f"""WITH {_MADE} SELECT id, ends_with(path, '_test.py') OR contains(path, '.spec.') OR contains(path, '/tests/') AS test, ends_with(path, '_test.py') OR contains(path, '.spec.') OR contains(path, '/tests/') AS impact_test,
  contains(path, '/utils/') AS utility, contains(path, 'node_modules/') OR ends_with(path, '.min.js') AS ignored FROM mp"""),
    "test_file_filter": (lambda s, d: _path(s, d).where(~paths.is_test_file(F.concat(F.lit("/"), "path"))).agg(F.count("*").alias("n")),
        f"WITH {_URL} SELECT count(*) FILTER (NOT (contains(p, '.test.') OR contains(p, '.spec.') OR contains(p, '/test/') OR contains(p, '/tests/') OR contains(p, '/test_') OR contains(p, '/testing/') OR contains(p, '__tests__/') OR contains(p, '__mocks__/') OR contains(p, 'uitests/') OR contains(p, '.tests/') OR contains(p, 'tests.cs') OR ends_with(p, '_test.py') OR ends_with(p, '_test.go') OR ends_with(p, 'tests.swift') OR ends_with(p, 'test.swift') OR ends_with(p, 'test.php') OR ends_with(p, 'spec.php'))) AS n FROM u"),
    "vector_normalise": (_normalised, "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm FROM embeddings"),
    "chunk_by_budget": (lambda s, d: ch.chunk_by_budget(t(s, d, "part").select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("ord"), F.col("p_size").cast("long").alias("size")), 200),
        """WITH RECURSIVE p AS (SELECT p_brand AS repo, p_partkey AS ord, p_size AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
w(repo, ord, k, chunk, filled) AS (SELECT repo, ord, k, 0, size FROM p WHERE k = 1 UNION ALL SELECT p.repo, p.ord, p.k, CASE WHEN w.filled + p.size > 200 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.filled + p.size > 200 THEN p.size ELSE w.filled + p.size END FROM w JOIN p ON p.repo = w.repo AND p.k = w.k + 1)
SELECT repo, ord, chunk FROM w"""),
    "module_token_totals": (lambda s, d: ch.module_tokens(_files(s, d).select(F.split("path", "/")[0].alias("module"), "path", "content")),
        f"WITH {_F} SELECT split_part(path, '/', 1) AS module, count(*) AS files, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS tokens, sum(ceil(length(text) / 4)) > 30000 AND count(*) > 3 AS split FROM f GROUP BY 1"),
    "module_split": (lambda s, d: ch.split_modules(_files(s, d).select(F.split("path", "/")[0].alias("module"), "path", "content")).groupBy("module", "part").agg(F.count("*").alias("files")),
        f"""WITH {_F}, m AS (SELECT split_part(path, '/', 1) AS module FROM f GROUP BY 1 HAVING sum(ceil(length(text) / 4)) > 30000 AND count(*) > 3)
SELECT split_part(path, '/', 1) AS module, CASE WHEN split_part(path, '/', 1) IN (SELECT module FROM m) THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS part, count(*) AS files FROM f GROUP BY ALL"""),
    "top_level_grouping": (lambda s, d: ch.by_top_folder(_files(s, d)).groupBy("module").agg(F.count("*").alias("files")), f"WITH {_F} SELECT split_part(path, '/', 1) AS module, count(*) AS files FROM f GROUP BY 1"),
    "affected_wiki_modules": (_affected, f"WITH {_F} SELECT module, full_run FROM (SELECT DISTINCT split_part(path, '/', 1) AS module FROM f WHERE ends_with(path, '/7') UNION SELECT 'Other' WHERE EXISTS (SELECT 1 FROM f WHERE ends_with(path, '/11'))) CROSS JOIN (SELECT count(*) > 5 AS full_run FROM f WHERE ends_with(path, '/11'))"),
    "detect_changes_risk": (lambda s, d: ch.change_summary(*_change_parts(s, d)),
        f"WITH {_CHANGE}, n AS (SELECT (SELECT count(*) FROM cs) AS changed_count, (SELECT count(*) FROM ap) AS affected_count, (SELECT count(*) FROM cf) AS changed_files) SELECT *, CASE WHEN changed_files = 0 THEN 'none' WHEN affected_count = 0 THEN 'low' WHEN affected_count <= 5 THEN 'medium' WHEN affected_count <= 15 THEN 'high' ELSE 'critical' END AS risk_level FROM n"),
    "detect_changes_processes": (lambda s, d: ch.affected_processes(*_change_parts(s, d)).select("process", "changed_steps"),
        f"WITH {_CHANGE} SELECT user_id AS process, count(*) AS changed_steps FROM events JOIN cs ON cs.id = event_id % 997 GROUP BY 1"),
    "delete_by_file": (lambda s, d: ch.without_files(symbols(s, d), symbols(s, d).where("id < 40").select(F.col("file_path").alias("path")).distinct()).select("id"),
        f"WITH {SYMBOLS} SELECT id FROM sy WHERE file_path NOT IN (SELECT file_path FROM sy WHERE id < 40)"),
    "upsert_rows": (lambda s, d: ch.upsert(symbols(s, d).select("id", "name"), symbols(s, d).where("id < 40").select((F.col("id") * 2).alias("id"), F.lit("new").alias("name"))),
        f"WITH {SYMBOLS}, n AS (SELECT id * 2 AS id, 'new' AS name FROM sy WHERE id < 40) SELECT id, name FROM sy WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n"),
    "eval_metrics": (_metrics, f"WITH {_RUNS} SELECT run_id, n_instances, n_with_patch, round(n_with_patch / greatest(n_instances, 1), 6) AS patch_rate, round(total_cost, 6) AS total_cost, round(total_cost / greatest(n_instances, 1), 6) AS avg_cost, round(total_api_calls / greatest(n_instances, 1), 6) AS avg_api_calls, round(hit, 6) AS augment_hit_rate, total_api_calls, total_tool_calls FROM me"),
    "eval_pivot": (_pivot, f"WITH {_RUNS} SELECT 'model' AS model, round(max(n_with_patch / n_instances) FILTER (run_id = 'model_baseline'), 6) AS baseline, round(max(n_with_patch / n_instances) FILTER (run_id = 'model_native'), 6) AS native, round(max(n_with_patch / n_instances) FILTER (run_id = 'model_native_augment'), 6) AS native_augment FROM me"),
    "eval_deltas": (_deltas, f"WITH {_RUNS}, b AS (SELECT n_with_patch / n_instances AS r, total_cost / n_instances AS c FROM me WHERE run_id = 'model_baseline') SELECT 'model' AS model, run_id[7:] AS mode, round(n_with_patch / n_instances, 6) AS patch_rate, round(n_with_patch / n_instances - r, 6) AS patch_rate_delta, round((total_cost / n_instances - c) / c * 100, 6) AS cost_delta_pct FROM me CROSS JOIN b"),
}
