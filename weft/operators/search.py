"""Full-text, vector and mixed search, and line searches over file contents.

A query for known terms counts them in each document's list of terms and never makes postings of the others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weft.functions.text import stem, words

K1, B = 1.2, 0.75
RRF_K = 60
PREFIX_WEIGHT, FUZZY_WEIGHT = 0.375, 0.45


@F.pandas_udf(StringType())
def _stems(term: pd.Series) -> pd.Series:
    return term.map(stem)


def exact_sum(part: Column | str) -> Column:
    """Sum of doubles to 20 places, whatever their order: rows made of the same parts tie, and ids decide between them."""
    return F.sum(F.col(part).cast("decimal(38,20)") if isinstance(part, str) else part.cast("decimal(38,20)")).cast("double")


def stemmed(terms: DataFrame) -> DataFrame:
    """Adds the Porter stem to a table with one row a term."""
    return terms.withColumn("stem", _stems("term"))


@dataclass
class Bm25:
    """docs: id, w (the terms of each document, in order); stem: whether they are to be stemmed.

    Nothing is indexed ahead of a query: a search for known terms reads the documents twice, once for their number, mean
    length and the terms' document frequencies, once for the scores, and shuffles nothing but the best rows. Terms that
    are only known from the vocabulary (prefixes, near spellings) or stemmed go by postings.
    """

    docs: DataFrame
    stem: bool = False

    @staticmethod
    def build(docs: DataFrame, id_col: str = "id", text_col: str = "text", tokens=words, porter: bool = False) -> Bm25:
        """A null text is empty; documents without a term count in n and in the mean length."""
        return Bm25(docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("w")), porter)

    @cached_property
    def size(self) -> tuple[int, float]:
        """Number of documents and mean length."""
        n, average = self.docs.agg(F.count("*"), F.avg(F.size("w"))).first()
        return int(n), float(average or 0)

    @cached_property
    def postings(self) -> DataFrame:
        """id, term, tf, length."""
        rows = self.docs.select("id", F.size("w").alias("length"), F.explode("w").alias("term"))
        if self.stem:  # stems of different terms only, then joined back
            table = stemmed(rows.select("term").distinct())
            rows = rows.join(table, "term").select("id", "length", F.col("stem").alias("term"))
        return rows.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))

    @cached_property
    def vocabulary(self) -> DataFrame:
        """term, df."""
        if self.stem:
            return self.postings.groupBy("term").agg(F.count("*").alias("df"))
        return self.docs.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))

    def terms_of(self, query: str) -> list[str]:
        import re

        own = dict.fromkeys(re.findall(r"[^\W]+", query.lower()))
        return list(dict.fromkeys(stem(t) for t in own)) if self.stem else list(own)

    def score(self, weighted: DataFrame, conjunctive: int = 0, k1: float = K1, b: float = B) -> DataFrame:
        """id, score. weighted: term, weight; conjunctive: how many different terms a document must have."""
        n, average = self.size
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        terms = weighted.join(self.vocabulary, "term").select("term", (idf * F.col("weight")).alias("_w"))
        norm = k1 * (1 - b + b * F.col("length") / F.lit(average or 1.0))
        hit = self.postings.join(terms, "term").select("id", "term", (F.col("_w") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("s"))
        out = hit.groupBy("id").agg(exact_sum("s").alias("score"), F.count("*").alias("_terms"))
        return (out.where(F.col("_terms") >= conjunctive) if conjunctive else out).drop("_terms")

    def score_terms(self, weights: dict[str, float], conjunctive: int = 0, k1: float = K1, b: float = B) -> DataFrame:
        """id, score, for the few terms of a query: counts of each in every document, no postings."""
        found = self.docs.select("id", F.size("w").alias("length"), F.filter("w", lambda x: x.isin(*weights)).alias("_own"))
        times = lambda t: F.size(F.filter("_own", lambda x: x == t))
        counts = found.select("id", "length", *[times(t).alias(f"_{k}") for k, t in enumerate(weights)])
        n, average, *df = counts.agg(F.count("*"), F.avg("length"), *[F.count_if(F.col(f"_{k}") > 0) for k in range(len(weights))]).first()
        self.__dict__["size"] = int(n), float(average or 0)
        norm = k1 * (1 - b + b * F.col("length") / F.lit(float(average or 1.0)))
        parts = [F.when(F.col(f"_{k}") > 0, F.lit(math.log(1 + (n - d + 0.5) / (d + 0.5)) * w) * F.col(f"_{k}") * (k1 + 1) / (F.col(f"_{k}") + norm)).otherwise(0.0)
                 for k, (d, w) in enumerate(zip(df, weights.values(), strict=True))]
        least = reduce(add, [(F.col(f"_{k}") > 0).cast("int") for k in range(len(weights))])
        return counts.where(least >= max(1, conjunctive)).groupBy("id").agg(exact_sum(reduce(add, parts)).alias("score"))

    def search(self, query: str, limit: int = 20, conjunctive: bool = False) -> DataFrame:
        """id, score, rank; nothing for a blank query or a limit of 0."""
        own = self.terms_of(query) if limit > 0 else []
        spark = self.docs.sparkSession
        if not own:
            kind = dict(self.docs.dtypes)["id"]
            return spark.createDataFrame([], f"id {kind}, score double, rank int")
        if not self.stem:
            return ranked(self.score_terms(dict.fromkeys(own, 1.0), len(own) if conjunctive else 0), limit)
        terms = spark.createDataFrame([(t, 1.0) for t in own], "term string, weight double")
        return ranked(self.score(F.broadcast(terms), len(own) if conjunctive else 0), limit)

    def expand(self, query: str, fuzzy: float = 0.2) -> DataFrame:
        """term, weight: the query's terms, terms that begin with one, and terms within a share of its length of edits."""
        spark = self.docs.sparkSession
        out = None
        for t in self.terms_of(query):
            edits = round(fuzzy * len(t)) if fuzzy < 1 else int(fuzzy)
            far, beyond = F.levenshtein("term", F.lit(t)), F.length("term") - len(t)
            weight = (F.when(F.col("term") == t, 1.0).when(F.startswith("term", F.lit(t)), PREFIX_WEIGHT * F.length("term") / (F.length("term") + 0.3 * beyond))
                      .when((F.abs(beyond) <= edits) & (far <= edits), FUZZY_WEIGHT * F.length("term") / (F.length("term") + far)))
            one = self.vocabulary.select("term", weight.alias("weight")).where("weight is not null")
            out = one if out is None else out.union(one)
        if out is None:
            return spark.createDataFrame([], "term string, weight double")
        return out.groupBy("term").agg(F.max("weight").alias("weight"))


def ranked(scores: DataFrame, limit: int, id_col: str = "id") -> DataFrame:
    """The best by score, ties by id, with their ranks from 1."""
    top = scores.orderBy(F.desc("score"), id_col).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))  # at most `limit` rows


def field_search(fields: dict[str, tuple[Bm25, float]], query: str, limit: int = 20, fuzzy: float | None = 0.2) -> DataFrame:
    """Sum over fields of weight x score: id, score, rank. fuzzy=None takes the query's terms as they are."""
    out = None
    for index, weight in fields.values():
        own = index.terms_of(query)
        if fuzzy is None and own and not index.stem:
            one = index.score_terms(dict.fromkeys(own, 1.0))
        else:
            one = index.score(index.expand(query, fuzzy) if fuzzy is not None else index.docs.sparkSession.createDataFrame([(t, 1.0) for t in own], "term string, weight double"))
        one = one.withColumn("score", F.col("score") * weight)
        out = one if out is None else out.union(one)
    return ranked(out.groupBy("id").agg(exact_sum("score").alias("score")), limit)


def merge_tables(hits: DataFrame, limit: int, key: str = "file_path") -> DataFrame:
    """One score a file: the sum over the tables it was found in."""
    return ranked(hits.groupBy(key).agg(exact_sum("score").alias("score")), limit, key)


def rrf(lists: dict[str, tuple[DataFrame, float]], key: str = "id", k: int = RRF_K, first_rank: int = 1, limit: int | None = 20) -> DataFrame:
    """Reciprocal rank fusion: key, score, sources, for each list a score (0 where absent) and a rank (null where absent), rank.

    lists: name -> (rows of key, score, rank from 1; weight). first_rank: the rank that counts as 1 is counted as this.
    One union and one aggregation, whatever the number of lists.
    """
    rows = None
    for name, (frame, weight) in lists.items():
        one = frame.select(F.col(key), F.lit(name).alias("_list"), F.col("score").alias("_score"), F.col("rank").cast("int").alias("_rank"), F.lit(float(weight)).alias("_weight"))
        rows = one if rows is None else rows.union(one)
    own = [x for name in lists for x in (F.coalesce(F.max(F.when(F.col("_list") == name, F.col("_score"))), F.lit(0.0)).alias(f"{name}_score"),
                                         F.max(F.when(F.col("_list") == name, F.col("_rank"))).alias(f"{name}_rank"))]
    part = F.col("_weight") / (k + F.col("_rank") - 1 + first_rank)
    out = rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        exact_sum(part).alias("score"), F.array_join(F.array_sort(F.collect_set("_list")), ",").alias("sources"), *own)
    return ranked(out, limit, key) if limit else out


def process_groups(hits: DataFrame, steps: DataFrame, membership: DataFrame, processes: int = 5, symbols: int = 10, definitions: int = 20):
    """Search hits grouped by the processes they take part in.

    hits: id, score. steps: id, process, step. membership: id, cohesion. Returns three frames:
    processes (process, priority, symbol_count), their symbols (process, id, score, step) and hits in no process.
    """
    known = hits.join(membership.groupBy("id").agg(F.max("cohesion").alias("cohesion")), "id", "left")
    within_ = known.join(steps, "id")
    grouped = within_.groupBy("process").agg(exact_sum("score").alias("total"), F.max(F.coalesce("cohesion", F.lit(0.0))).alias("boost"), F.count("*").alias("symbol_count"))
    best = grouped.select("process", "symbol_count", (F.col("total") + 0.1 * F.col("boost")).alias("_p")).orderBy(F.desc("_p"), "process").limit(processes)
    order = Window.partitionBy("process").orderBy(F.desc("score"), "id", "step")
    own = within_.join(best.select("process", "_p"), "process").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= symbols)
    once = Window.partitionBy("id").orderBy(F.desc("_p"), "process", "_n")
    own = own.withColumn("_k", F.row_number().over(once)).where("_k = 1").select("process", "id", "score", "step")
    rest = hits.join(steps.select("id").distinct(), "id", "left_anti").orderBy(F.desc("score"), "id").limit(definitions)
    return best.select("process", F.round("_p", 3).alias("priority"), "symbol_count"), own, rest


def lines(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """path, line (from 1), text: every line of every file."""
    return files.select(F.col(path_col).alias("path"), F.posexplode(F.split(content_col, "\n", -1)).alias("_at", "text")).select(
        "path", (F.col("_at") + 1).alias("line"), "text")


def grep(files: DataFrame, pattern: str, path_filter: str | None = None, case_sensitive: bool = False, limit: int = 100, width: int = 150,
         path_col: str = "path", content_col: str = "content") -> DataFrame:
    """path, line, text of the first lines that match, by path and line; files without a match are not split."""
    shape = pattern if case_sensitive else f"(?i){pattern}"
    if path_filter:
        files = files.where(F.contains(F.lower(F.col(path_col)), F.lit(path_filter.lower())))
    some = files.where(F.col(content_col).rlike(f"(?m){shape}"))
    hit = lines(some, path_col, content_col).where(F.col("text").rlike(shape))
    return hit.select("path", "line", F.substring(F.trim("text"), 1, width).alias("text")).orderBy("path", "line").limit(limit)


def path_match(path: Column, request: str) -> Column:
    """How well a path fits a requested one: 1000 as it is (case aside), 300 less its length for a path that ends so, 10 for each
    requested segment found in order if that is at least half of them; else null."""
    low, want = F.lower(path), request.replace("\\", "/").lower()
    segments = [s for s in want.split("/") if s]
    own = F.split(low, "/")
    state = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("score"))

    def step(s: Column, seg: Column) -> Column:
        found = F.array_min(F.filter(F.transform(own, lambda p, i: F.when((i > s["at"]) & F.contains(p, seg), i)), lambda i: i.isNotNull()))
        return F.when(found.isNotNull(), F.struct(found.alias("at"), (s["score"] + 10).alias("score"))).otherwise(s)

    if segments:
        walked = F.aggregate(F.array(*[F.lit(s) for s in segments]), state, step)["score"]
    else:
        walked = F.lit(0)
    return F.when(low == want, 1000).when(F.endswith(low, F.lit(want)), 300 - F.length(path)).when(walked >= 5 * len(segments), walked)


def read_file(files: DataFrame, request: str, most: int = 50_000, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """The file that fits best: path, content (cut to `most` characters), truncated, lines. Ties by path."""
    scored = files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content"),
                          F.when(F.col(path_col) == request, 2000).otherwise(path_match(F.col(path_col), request)).alias("score"))
    best = scored.where("score is not null").orderBy(F.desc("score"), "path").limit(1)
    return best.select("path", F.substring("content", 1, most).alias("content"), (F.length("content") > most).alias("truncated"),
                       F.size(F.split("content", "\n", -1)).alias("lines"))


def path_suggestions(files: DataFrame, request: str, k: int = 5, path_col: str = "path") -> DataFrame:
    name = request.rsplit("/", 1)[-1].lower()
    return files.where(F.contains(F.lower(F.col(path_col)), F.lit(name))).select(F.col(path_col).alias("path")).orderBy("path").limit(k)


def word_shape(name: str) -> str:
    """A regular expression for the name as a whole word."""
    import re

    return rf"\b{re.escape(name)}\b"


def rename_plan(files: DataFrame, old: str, new: str, definition: tuple[str, int], references: DataFrame) -> DataFrame:
    """Edits of a rename: path, line, old_text, new_text, source (graph or text_search).

    definition: path and line of the symbol. references: path, the files that refer to it; they give their first
    line with the name. Every other file gives all lines that hold the name as a word.
    """
    shape = word_shape(old)
    some = lines(files.where(F.contains("content", F.lit(old)))).where(F.contains("text", F.lit(old)))
    graph = references.select("path").distinct()
    at = (F.col("path") == definition[0]) & (F.col("line") == definition[1])
    known = some.join(graph, "path", "left_semi")
    first = known.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("line"))).where("_n = 1").drop("_n")
    covered = graph.union(graph.sparkSession.createDataFrame([(definition[0],)], "path string")).distinct()
    rest = some.join(covered, "path", "left_anti").where(F.col("text").rlike(shape))
    both = some.where(at).union(first).distinct().withColumn("source", F.lit("graph")).union(rest.withColumn("source", F.lit("text_search")))
    new_text = F.regexp_replace("text", shape, new.replace("\\", "\\\\").replace("$", "\\$"))
    return both.select("path", "line", F.trim("text").alias("old_text"), F.trim(new_text).alias("new_text"), "source")


def apply_rename(files: DataFrame, plan: DataFrame, old: str, new: str) -> DataFrame:
    """The files of the plan with the name replaced everywhere: path, content."""
    own = files.join(plan.select("path").distinct(), "path", "left_semi")
    return own.withColumn("content", F.regexp_replace("content", word_shape(old), new.replace("\\", "\\\\").replace("$", "\\$")))


def neighbours_of(edges: DataFrame, names: DataFrame, hits: DataFrame, k: int = 3) -> DataFrame:
    """For each hit up to k names it is called by and k it calls: id, callers, callees."""
    def side(a: str, b: str, out: str) -> DataFrame:
        rows = edges.join(hits.select(F.col("id").alias(a)), a).join(names.select(F.col("id").alias(b), "name"), b)
        few = rows.withColumn("_n", F.row_number().over(Window.partitionBy(a).orderBy("name", b))).where(F.col("_n") <= k)
        return few.groupBy(F.col(a).alias("id")).agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias(out))

    return hits.join(side("dst", "src", "callers"), "id", "left").join(side("src", "dst", "callees"), "id", "left")


def augment(index: Bm25, nodes: DataFrame, edges: DataFrame, steps: DataFrame, membership: DataFrame, pattern: str,
            files: int = 10, top: int = 5, per_file: int = 3) -> DataFrame:
    """Context for a search pattern: name, file_path, callers, callees, processes, cohesion; best cohesion first.

    index: over files (id is the path). Symbols of the best files whose name holds the pattern's first word.
    """
    if not pattern or len(pattern) < 3:
        return nodes.limit(0).select("id", "name", "file_path").withColumns({c: F.lit(None).cast("string") for c in ("callers", "callees", "processes")}).withColumn("cohesion", F.lit(0.0))
    best = index.search(pattern, files).where(F.col("rank") <= top).select(F.col("id").alias("file_path"), "rank")
    word = pattern.split()[0]
    some = nodes.join(F.broadcast(best), "file_path").where(F.contains("name", F.lit(word)))
    some = some.withColumn("_n", F.row_number().over(Window.partitionBy("file_path").orderBy("id"))).where(F.col("_n") <= per_file)
    some = some.orderBy("rank", "_n").limit(top).select("id", "name", "file_path")
    flows = steps.join(some.select("id"), "id").groupBy("id").agg(F.array_join(F.sort_array(F.collect_set(F.col("process").cast("string"))), ", ").alias("processes"))
    cohesion = membership.groupBy("id").agg(F.max("cohesion").alias("cohesion"))
    out = neighbours_of(edges, nodes, some).join(flows, "id", "left").join(cohesion, "id", "left")
    return out.withColumn("cohesion", F.coalesce("cohesion", F.lit(0.0))).orderBy(F.desc("cohesion"), "id")
