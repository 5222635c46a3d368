"""Entry points and execution flows: scores, breadth-first reach, bounded traces and their clean-up."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.columns import let
from weft.functions.paths import framework_of_path, is_test_file
from weft.functions.text import capitalize, sanitize_id
from weft.session import materialise

EXPORTED, UTILITY, ENTRY = 2.0, 0.3, 1.5
CANDIDATES, MIN_CONFIDENCE = 200, 0.5
DEPTH, BRANCHES, TRACES, LEAST_STEPS = 10, 4, 12, 3
SEP = "\u0001"

# Names that look like entry points, for every language and by language.
ENTRY_NAMES = {
    "*": ("(?i)^(main|init|bootstrap|start|run|setup|configure)$", "^handle[A-Z]", "^on[A-Z]", "Handler$", "Controller$", "^process[A-Z]",
          "^execute[A-Z]", "^perform[A-Z]", "^dispatch[A-Z]", "^trigger[A-Z]", "^fire[A-Z]", "^emit[A-Z]"),
    "javascript": ("^use[A-Z]",),
    "typescript": ("^use[A-Z]",),
    "python": ("^app$", "(?i)^(get|post|put|delete|patch)_", "^api_", "^view_"),
    "java": ("^do[A-Z]", "^create[A-Z]", "^build[A-Z]", "Service$"),
    "csharp": ("^(Get|Post|Put|Delete)", "Action$", "^On[A-Z]", "Async$"),
    "go": ("Handler$", "^Serve", "^New[A-Z]", "^Make[A-Z]"),
    "rust": ("(?i)^(get|post|put|delete)_handler$", "^handle_", "^new$", "^run$", "^spawn"),
    "c": ("^main$", "^init_", "^start_", "^run_"),
    "cpp": ("^main$", "^init_", "^Create[A-Z]", "^Run$", "^Start$"),
    "swift": ("^viewDidLoad$", "^viewWillAppear$", "^viewDidAppear$", "^viewWillDisappear$", "^viewDidDisappear$", r"^application\(", r"^scene\(",
              "^body$", "Coordinator$", "^sceneDidBecomeActive$", "^sceneWillResignActive$", "^didFinishLaunchingWithOptions$", "ViewController$",
              "^configure[A-Z]", "^setup[A-Z]", "^makeBody$"),
    "php": ("Controller$", "^handle$", "^execute$", "^boot$", "^register$", "^__invoke$", "^(index|show|store|update|destroy|create|edit)$",
            "^(get|post|put|delete|patch)[A-Z]", "^run$", "^fire$", "^dispatch$", "Service$", "Repository$", "^find$", "^findAll$", "^save$", "^delete$"),
}
# Names of helpers.
UTILITY_NAMES = (
    "^(get|set|is|has|can|should|will|did)[A-Z]", "^_", "(?i)^(format|parse|validate|convert|transform)", "(?i)^(log|debug|error|warn|info)$",
    "^(to|from)[A-Z]", "(?i)^(encode|decode)", "(?i)^(serialize|deserialize)", "(?i)^(clone|copy|deep)", "(?i)^(merge|extend|assign)",
    "(?i)^(filter|map|reduce|sort|find)", "Helper$", "Util$", "Utils$", "(?i)^utils?$", "(?i)^helpers?$",
)


def _any(name: Column, shapes) -> Column:
    return reduce(or_, [name.rlike(s) for s in shapes])


def is_utility_name(name: Column) -> Column:
    return F.coalesce(_any(name, UTILITY_NAMES), F.lit(False))


def is_entry_name(name: Column, language: Column) -> Column:
    rules = [_any(name, ENTRY_NAMES["*"])] + [(language == lang) & _any(name, shapes) for lang, shapes in ENTRY_NAMES.items() if lang != "*"]
    return F.coalesce(reduce(or_, [F.coalesce(r, F.lit(False)) for r in rules]), F.lit(False))


def entry_score(name: Column, language: Column, callers: Column, callees: Column, exported: Column, path: Column,
                weight: Column | None = None, weight_reason: Column | None = None) -> Column:
    """struct(score, reasons): how much a function looks like an entry point.

    Callees over callers + 1, doubled if exported, 0.3 for helper names or else 1.5 for entry names, times the
    framework's weight by path (and by definition, if given and over 1). Without callees the score is 0.
    """
    known = F.struct(
        (callees / (callers + 1)).cast("double").alias("base"), F.coalesce(exported, F.lit(False)).alias("out"), (callees == 0).alias("none"),
        let(name, is_utility_name).alias("utility"), let(F.struct(name.alias("n"), language.alias("l")), lambda x: is_entry_name(x["n"], x["l"])).alias("entry"),
        framework_of_path(F.when(path != "", path)).alias("hint"),
        F.coalesce(weight, F.lit(1.0)).alias("weight") if weight is not None else F.lit(1.0).alias("weight"),
        F.coalesce(weight_reason, F.lit("decorator")).alias("why") if weight_reason is not None else F.lit("decorator").alias("why"))

    def result(k: Column) -> Column:
        entry, more = ~k["utility"] & k["entry"], k["weight"] > 1
        score = (k["base"] * F.when(k["out"], EXPORTED).otherwise(1.0) * F.when(k["utility"], UTILITY).when(entry, ENTRY).otherwise(1.0)
                 * F.coalesce(k["hint"]["multiplier"], F.lit(1.0)) * F.when(more, k["weight"]).otherwise(1.0))
        reasons = F.array_compact(F.array(
            F.concat(F.lit("base:"), F.format_string("%.2f", k["base"])), F.when(k["out"], "exported"), F.when(k["utility"], "utility-pattern").when(entry, "entry-pattern"),
            F.when(k["hint"].isNotNull(), F.concat(F.lit("framework:"), k["hint"]["reason"])), F.when(more, F.concat(F.lit("framework-ast:"), k["why"]))))
        none = F.struct(F.lit(0.0).alias("score"), F.array(F.lit("no-outgoing-calls")).alias("reasons"))
        return F.when(k["none"], none).otherwise(F.struct(score.alias("score"), reasons.alias("reasons")))

    return let(known, result)


def call_counts(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """id, callers, callees: numbers of CALLS edges in and out."""
    ends = edges.select("src", "dst").distinct() if distinct else edges.select("src", "dst")
    rows = ends.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(ends.select("src", F.lit(0), F.lit(1)))
    return rows.groupBy("id").agg(F.sum("i").alias("callers"), F.sum("o").alias("callees"))


def score_entries(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """id, name, file_path, score, reasons of every Function and Method outside test files with a score above 0."""
    some = nodes.where(F.col("label").isin("Function", "Method") & ~is_test_file(F.col("file_path")))
    rows = some.join(call_counts(calls), "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("callers", "callees")})
    extra = {}
    if "ast_fw_multiplier" in nodes.columns:
        extra = {"weight": F.col("ast_fw_multiplier"), "weight_reason": F.col("ast_fw_reason")}
    own = entry_score(F.col("name"), F.col("language"), F.col("callers"), F.col("callees"), F.col("is_exported"), F.col("file_path"), **extra)
    return rows.withColumn("_s", own).select("id", "name", "file_path", F.col("_s.score").alias("score"), F.array_join("_s.reasons", " x ").alias("reasons")).where("score > 0")


def candidates(nodes: DataFrame, calls: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The k best entries over calls that are sure enough; ties by id."""
    sure = calls.where(F.col("confidence").isNull() | (F.col("confidence") >= MIN_CONFIDENCE))
    return score_entries(nodes, sure).orderBy(F.desc("score"), "id").limit(k)


def bfs_flows(entries: DataFrame, calls: DataFrame) -> DataFrame:
    """entry, node, step, ord: all that each entry reaches, its distance, and the order in which a queue would meet it.

    entries: id. One join a level for all entries together; a level is cut from the plan when it is done. Without need of
    the order, `bfs_levels` has a row a node instead of a row an entry and node.
    """
    out = materialise(calls.select("src", "dst").distinct())  # the calls are worked out once, not at each level
    front = materialise(entries.select(F.col("id").alias("entry"), F.col("id").alias("node"), F.lit(0).alias("step"), F.lit(1).cast("long").alias("ord")).distinct())
    seen, step = front, 0
    while not front.isEmpty():
        step += 1
        reach = front.join(out, front.node == out.src).groupBy("entry", F.col("dst").alias("node")).agg(F.min("ord").alias("_from"))
        fresh = reach.join(seen.select("entry", "node"), ["entry", "node"], "left_anti")
        base = seen.groupBy("entry").agg(F.max("ord").alias("_base"))
        rank = F.row_number().over(Window.partitionBy("entry").orderBy("_from", "node"))
        front = materialise(fresh.join(base, "entry").select("entry", "node", F.lit(step).alias("step"), (F.col("_base") + rank).alias("ord")))
        seen = seen.union(front)
    return seen


WORDS, BITS = 4, 64
_MASKS = [f"_b{k}" for k in range(WORDS)]


def bfs_levels(entries: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What `bfs_flows` finds, as (levels, index): levels has block, node, step and a mask of the entries of the block that meet the node at that step.

    entries: id. index: block, word, bit, entry; a block is 256 entries. A level moves one mask along each call, for all
    entries of a block together, so rows grow with nodes and calls and not with entries times nodes.
    """
    at = F.row_number().over(Window.orderBy("entry")) - 1  # one row an entry
    index = entries.select(F.col("id").alias("entry")).distinct().withColumn("_at", at)
    index = materialise(index.select(F.expr(f"_at div {WORDS * BITS}").alias("block"), F.expr(f"_at % {WORDS * BITS} div {BITS}").alias("word"), F.expr(f"_at % {BITS}").alias("bit"), "entry"))
    out = materialise(calls.select("src", "dst").distinct())
    own = [F.when(F.col("word") == k, F.expr("shiftleft(1L, CAST(bit AS INT))")).otherwise(F.lit(0).cast("long")).alias(m) for k, m in enumerate(_MASKS)]
    front = materialise(index.select("block", F.col("entry").alias("node"), F.lit(0).alias("step"), *own))
    seen, step = front, 0
    either = [F.bit_or(m).alias(m) for m in _MASKS]
    while not front.isEmpty():
        step += 1
        reach = front.join(out, front.node == out.src).groupBy("block", F.col("dst").alias("node")).agg(*either)
        known = seen.groupBy("block", "node").agg(*[F.bit_or(m).alias(f"_k{m}") for m in _MASKS])
        fresh = reach.join(known, ["block", "node"], "left").select(
            "block", "node", F.lit(step).alias("step"), *[F.col(m).bitwiseAND(F.bitwise_not(F.coalesce(f"_k{m}", F.lit(0).cast("long")))).alias(m) for m in _MASKS])
        front = materialise(fresh.where(reduce(or_, [F.col(m) != 0 for m in _MASKS])))
        seen = seen.union(front)
    return seen, index


def _each_entry(rows: DataFrame, index: DataFrame, *keep: str, merge: list | None = None) -> DataFrame:
    """Masks as rows of an entry each; merge: aggregates over the rows of an entry and its `keep` columns, before its name is looked up."""
    words = rows.select("block", *keep, F.posexplode(F.array(*_MASKS)).alias("word", "_m")).where("_m != 0")
    bits = words.select("block", *keep, "word", "_m", F.explode(F.array(*[F.lit(k) for k in range(BITS)])).alias("bit")).where("shiftright(_m, bit) & 1 = 1").drop("_m")
    if merge:
        by = [c for c in keep if c != "node"]
        bits = bits.groupBy("block", "word", "bit", *by).agg(*merge)
    return bits.join(F.broadcast(index), ["block", "word", "bit"]).drop("block", "word", "bit")  # one row an entry


def bfs_steps(entries: DataFrame, calls: DataFrame) -> DataFrame:
    """entry, node, step of `bfs_flows`."""
    return _each_entry(*bfs_levels(entries, calls), "node", "step").select("entry", "node", "step")


def level_summary(entries: DataFrame, calls: DataFrame, membership: DataFrame) -> DataFrame:
    """`flow_summary` of `bfs_flows` without the id, which is of the order of nodes: entry, terminal, step_count, nodes, communities."""
    levels, index = bfs_levels(entries, calls)
    each = _each_entry(levels, index, "node", "step", merge=[F.max("node").alias("node"), F.count("*").alias("n")])
    own = each.groupBy("entry").agg(F.max_by("node", "step").alias("terminal"), (F.max("step") + 1).alias("step_count"), F.sum("n").alias("nodes"))
    masks = levels.join(membership, "node").groupBy("block", "community").agg(*[F.bit_or(m).alias(m) for m in _MASKS])
    groups = _each_entry(masks, index, "community").groupBy("entry").agg(F.sort_array(F.collect_set("community")).alias("communities"))
    empty = F.array().cast(f"array<{dict(membership.dtypes)['community']}>")
    return own.join(groups, "entry", "left").select("entry", "terminal", "step_count", "nodes", F.coalesce("communities", empty).alias("communities"))


def flow_summary(flows: DataFrame, membership: DataFrame) -> DataFrame:
    """entry, terminal, step_count, nodes, communities, id: one row a flow. membership: node, community."""
    own = flows.groupBy("entry").agg(
        F.max_by("node", F.struct("step", "node")).alias("terminal"), (F.max("step") + 1).alias("step_count"), F.count("*").alias("nodes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("node").cast("string").alias("node")))), lambda s: s["node"]), "|").alias("_order"))
    groups = flows.join(membership, "node").groupBy("entry").agg(F.sort_array(F.collect_set("community")).alias("communities"))
    key = F.concat(F.col("entry").cast("string"), F.lit("|"), "_order")
    empty = F.array().cast(f"array<{dict(membership.dtypes)['community']}>")
    return own.join(groups, "entry", "left").select(
        F.concat(F.lit("process_"), F.substring(F.sha2(key, 256), 1, 16)).alias("id"), "entry", "terminal", "step_count", "nodes", F.coalesce("communities", empty).alias("communities"))


def step_edges(flows: DataFrame, summary: DataFrame) -> DataFrame:
    return flows.join(summary.select("entry", "id"), "entry").select(
        F.col("node").alias("src"), F.col("id").alias("dst"), F.lit("STEP_IN_PROCESS").alias("type"), F.lit(1.0).alias("confidence"), F.lit("bfs").alias("reason"), "step")


def traces(entries: DataFrame, calls: DataFrame, depth: int = DEPTH, branches: int = BRANCHES, most: int = TRACES, least: int = LEAST_STEPS) -> DataFrame:
    """entry, path, ord: paths from each entry, breadth first, without repeats in a path.

    A path goes on to the first `branches` callees (by ord if the calls have one, else by id) and ends at a node without
    callees, at `depth` nodes or where only cycles go on; an entry stops at `most` paths of `least` nodes or more, which
    are the first in the order of a queue. Paths of an entry that has enough are not carried further.
    """
    calls = calls.withColumn("ord", F.col("dst")) if "ord" not in calls.columns else calls
    first = calls.groupBy("src", "dst").agg(F.min("ord").alias("_o"))
    out = first.withColumn("_k", F.row_number().over(Window.partitionBy("src").orderBy("_o", "dst"))).where(F.col("_k") <= branches)
    out = out.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "dst"))), lambda s: s["dst"]).alias("_next"))
    front = entries.select(F.col("id").alias("entry"), F.array("id").alias("path"), F.lit(1).cast("long").alias("ord")).distinct()
    done = None
    for level in range(1, depth + 1):
        rows = front.join(out, F.element_at("path", -1) == F.col("src"), "left").drop("src")
        fresh = F.filter("_next", lambda n: ~F.array_contains("path", n))
        rows = rows.withColumn("_fresh", F.when(F.lit(level < depth), F.coalesce(fresh, F.array().cast(dict(front.dtypes)["path"]))).otherwise(F.array().cast(dict(front.dtypes)["path"])))
        rows = materialise(rows)
        ended = rows.where(F.size("_fresh") == 0).where(F.size("path") >= least).select("entry", "path", F.lit(level).alias("level"), "ord")
        done = ended if done is None else done.union(ended)
        enough = done.groupBy("entry").agg(F.count("*").alias("n")).where(F.col("n") >= most)
        live = rows.where(F.size("_fresh") > 0).join(enough.select("entry"), "entry", "left_anti")
        grown = live.select("entry", "path", "ord", F.posexplode("_fresh").alias("_p", "_n"))
        rank = F.row_number().over(Window.partitionBy("entry").orderBy("ord", "_p"))
        front = materialise(grown.select("entry", F.concat("path", F.array("_n")).alias("path"), rank.cast("long").alias("ord")))
        if front.isEmpty():
            break
    order = F.row_number().over(Window.partitionBy("entry").orderBy("level", "ord"))
    return done.withColumn("ord", order).where(F.col("ord") <= most).select("entry", "path", "ord")


def drop_contained(paths: DataFrame) -> DataFrame:
    """Without paths that lie as one stretch inside another: of equal paths the first by `key` stays. paths: key, path.

    Every stretch of every path is a key to join on (at most n(n+1)/2 of n nodes), so paths are not held against each other.
    """
    n = F.size("path")
    whole = paths.select("key", "path", n.alias("n"), F.array_join(F.transform("path", lambda x: x.cast("string")), SEP).alias("text"))
    firsts = whole.groupBy("text").agg(F.min("key").alias("key"))
    whole = whole.join(firsts, ["text", "key"])
    starts = whole.select("key", "path", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    parts = starts.select("n", "path", "i", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("i") + 1)).alias("m")).where("m < n").select(
        F.array_join(F.transform(F.slice("path", F.col("i"), F.col("m")), lambda x: x.cast("string")), SEP).alias("text")).distinct()
    return whole.join(parts, "text", "left_anti").select("key", "path")


def longest_per_ends(paths: DataFrame) -> DataFrame:
    """Of the paths between the same first and last node the longest, ties by key."""
    ends = Window.partitionBy(F.col("path")[0], F.element_at("path", -1)).orderBy(F.desc(F.size("path")), "key")
    return paths.withColumn("_k", F.row_number().over(ends)).where("_k = 1").drop("_k")


def process_limit(symbols: int) -> int:
    return max(20, min(300, int(symbols / 10 + 0.5)))


def longest(paths: DataFrame, k: int) -> DataFrame:
    return paths.orderBy(F.desc(F.size("path")), "key").limit(k)


def processes(paths: DataFrame, names: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """paths: key, path. names: id, name. membership: node, community. Returns process rows and their steps (from 1)."""
    order = F.row_number().over(Window.orderBy(F.desc(F.size("path")), "key")) - 1  # one row a process
    rows = paths.withColumn("_i", order).select("_i", "path", F.col("path")[0].alias("entry"), F.element_at("path", -1).alias("terminal"), F.size("path").alias("step_count"))
    a = names.select(F.col("id").alias("entry"), F.col("name").alias("_a"))
    b = names.select(F.col("id").alias("terminal"), F.col("name").alias("_b"))
    rows = rows.join(a, "entry", "left").join(b, "terminal", "left").withColumns({"_a": F.coalesce("_a", F.lit("Unknown")), "_b": F.coalesce("_b", F.lit("Unknown"))})
    rows = rows.withColumn("id", F.concat(F.lit("proc_"), "_i", F.lit("_"), sanitize_id(F.col("_a")))).withColumn("label", F.concat(capitalize(F.col("_a")), F.lit(" → "), capitalize(F.col("_b"))))
    steps = rows.select(F.col("id").alias("process"), F.posexplode("path").alias("_p", "node")).select("process", "node", (F.col("_p") + 1).alias("step"))
    groups = steps.join(membership, "node").groupBy(F.col("process").alias("id")).agg(F.countDistinct("community").alias("communities"))
    kind = F.when(F.col("communities") > 1, "cross_community").otherwise("intra_community")
    out = rows.join(groups, "id", "left").select("id", "label", kind.alias("process_type"), "step_count", F.coalesce("communities", F.lit(0)).alias("communities"), "entry", "terminal")
    return out, steps


def process_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("processes"), F.count_if(F.col("process_type") == "cross_community").alias("cross_community"), F.round(F.avg("step_count"), 1).alias("avg_steps"))


def process_edges(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """process, src, dst: calls between two steps of one process, without self loops."""
    a = steps.select("process", F.col("node").alias("src")).distinct()
    b = steps.select("process", F.col("node").alias("dst")).distinct()
    pairs = calls.select("src", "dst").where("src != dst").distinct()
    return a.join(pairs, "src").join(b, ["process", "dst"]).select("process", "src", "dst")
