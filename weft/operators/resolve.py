"""Resolution of names and imports: which definition a call, a parent class, a route or an import means.

Inputs carry `ord`, the order in which things were found, because "first" and "last" are part of the
meaning. Nothing joins references to all definitions of a name: each tier brings its definitions
down to one row a key first, so a name defined or used a million times costs one row on that side.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAME_FILE_CALL, SAME_FILE_PARENT, IMPORTED, UNIQUE, AMBIGUOUS = 0.85, 0.95, 0.9, 0.5, 0.3

# Endings that an import leaves out, in the order in which they are tried.
EXTENSIONS = (
    "", ".tsx", ".ts", ".jsx", ".js", "/index.tsx", "/index.ts", "/index.jsx", "/index.js", ".py", "/__init__.py", ".java", ".kt", ".kts", ".c",
    ".h", ".cpp", ".hpp", ".cc", ".cxx", ".hxx", ".hh", ".cs", ".go", ".rs", "/mod.rs", ".php", ".phtml", ".swift",
)
KOTLIN = (".kt", ".kts")


def last_definition(symbols: DataFrame) -> DataFrame:
    """file_path, name, node_id: a file's last definition of a name."""
    return symbols.groupBy("file_path", "name").agg(F.max_by("node_id", F.struct("ord", "node_id")).alias("node_id"))


def first_definition(symbols: DataFrame) -> DataFrame:
    """name, node_id, file_path, definitions: the first definition of a name anywhere, and how many there are."""
    best = F.min_by(F.struct("node_id", "file_path"), F.struct("ord", "node_id"))
    return symbols.groupBy("name").agg(best.alias("_d"), F.count("*").alias("definitions")).select("name", "_d.node_id", "_d.file_path", "definitions")


def lookup_in_file(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """wanted: file_path, name. Adds node_id: the file's last definition, else the first one anywhere."""
    exact = last_definition(symbols).withColumnRenamed("node_id", "_exact")
    anywhere = first_definition(symbols).select("name", F.col("node_id").alias("_any"))
    return wanted.join(exact, ["file_path", "name"], "left").join(anywhere, "name", "left").select(
        *wanted.columns, F.coalesce("_exact", "_any").alias("node_id"))


def symbol_stats(symbols: DataFrame) -> DataFrame:
    return symbols.agg(F.countDistinct("file_path").alias("files"), F.countDistinct("name").alias("names"), F.count("*").alias("symbols"))


def _imported(pairs: DataFrame, symbols: DataFrame, import_map: DataFrame) -> DataFrame:
    """For each (file_path, name) the first definition that lies in a file imported there: adds _imported, _imported_file."""
    reach = pairs.join(import_map.select("file_path", "imported_path").distinct(), "file_path")
    first = symbols.groupBy(F.col("file_path").alias("imported_path"), "name").agg(
        F.min_by("node_id", F.struct("ord", "node_id")).alias("node_id"), F.min(F.struct("ord", "node_id")).alias("at"))
    hit = reach.join(first, ["imported_path", "name"])
    return hit.groupBy("file_path", "name").agg(F.min_by(F.struct("node_id", "imported_path"), "at").alias("_i")).select(
        "file_path", "name", F.col("_i.node_id").alias("_imported"), F.col("_i.imported_path").alias("_imported_file"))


def resolve(refs: DataFrame, symbols: DataFrame, import_map: DataFrame, same_file: float = SAME_FILE_CALL) -> DataFrame:
    """refs: file_path, name and more. Adds target, confidence, reason; all null where nothing is defined by that name.

    Tried in this order: the file's own last definition; the first definition in a file that it imports; the first anywhere.
    """
    pairs = refs.select("file_path", "name").distinct()
    own = last_definition(symbols).withColumnRenamed("node_id", "_own")
    anywhere = first_definition(symbols).select("name", F.col("node_id").alias("_any"), "definitions")
    found = pairs.join(own, ["file_path", "name"], "left").join(_imported(pairs, symbols, import_map), ["file_path", "name"], "left").join(anywhere, "name", "left")
    tier = F.when(F.col("_own").isNotNull(), 1).when(F.col("_imported").isNotNull(), 2).when(F.col("_any").isNotNull(), 3)
    found = found.select(
        "file_path", "name", F.coalesce("_own", "_imported", "_any").alias("target"),
        F.when(tier == 1, same_file).when(tier == 2, IMPORTED).when(tier == 3, F.when(F.col("definitions") == 1, UNIQUE).otherwise(AMBIGUOUS)).alias("confidence"),
        F.when(tier == 1, "same-file").when(tier == 2, "import-resolved").when(tier == 3, "fuzzy-global").alias("reason"))
    return refs.join(found, ["file_path", "name"], "left")


def call_edges(calls: DataFrame, symbols: DataFrame, import_map: DataFrame, noise: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """calls: file_path, called_name, source_id. noise: name, calls not worth an edge. Returns CALLS edges and a row of counts."""
    refs = calls.withColumnRenamed("called_name", "name")
    if noise is not None:
        refs = refs.join(noise.select("name").distinct().withColumn("_noise", F.lit(True)), "name", "left")
    else:
        refs = refs.withColumn("_noise", F.lit(None).cast("boolean"))
    kept = resolve(refs.where("_noise is null"), symbols, import_map)
    edges = kept.where("target is not null").select(
        F.concat_ws("", F.lit("calls_"), F.substring(F.sha2(F.concat("source_id", F.lit(":"), "name", F.lit("->"), "target"), 256), 1, 16)).alias("id"),
        F.col("source_id").alias("src"), F.col("target").alias("dst"), F.lit("CALLS").alias("type"), "confidence", "reason")
    counts = kept.agg(F.count_if(F.col("target").isNotNull()).alias("resolved"), F.count_if(F.col("target").isNull()).alias("unresolved"))
    skipped = refs.agg(F.count_if(F.col("_noise").isNotNull()).alias("skipped"))
    return edges, counts.crossJoin(skipped)  # two one-row aggregates


def heritage_edges(heritage: DataFrame, symbols: DataFrame, import_map: DataFrame) -> DataFrame:
    """heritage: file_path, class_name, parent_name, kind. The child must be defined in its file; the parent goes by tiers."""
    child = last_definition(symbols).select("file_path", F.col("name").alias("class_name"), F.col("node_id").alias("src"))
    refs = heritage.join(child, ["file_path", "class_name"]).withColumnRenamed("parent_name", "name")
    hit = resolve(refs, symbols, import_map, SAME_FILE_PARENT).where("target is not null")
    return hit.select("src", F.col("target").alias("dst"), F.when(F.col("kind") == "extends", "EXTENDS").otherwise("IMPLEMENTS").alias("type"),
                      "confidence", "reason", F.col("kind").alias("heritage_kind"))


def heritage_edges_open(heritage: DataFrame, symbols: DataFrame) -> DataFrame:
    """The lenient form: child by file, else anywhere, else a made-up id; parent anywhere, else made up; nothing extends itself."""
    anywhere = first_definition(symbols).select("name", F.col("node_id").alias("_any"))
    own = last_definition(symbols).select("file_path", F.col("name").alias("class_name"), F.col("node_id").alias("_own"))
    rows = heritage.join(own, ["file_path", "class_name"], "left")
    rows = rows.join(anywhere.select(F.col("name").alias("class_name"), F.col("_any").alias("_child")), "class_name", "left")
    rows = rows.join(anywhere.select(F.col("name").alias("parent_name"), F.col("_any").alias("_parent")), "parent_name", "left")
    kind = F.when(F.col("kind") == "extends", "Class").otherwise("Interface")
    made = F.when(F.col("kind") == "trait-impl", "Struct").otherwise("Class")
    out = rows.select(
        F.coalesce("_own", "_child", F.concat(made, F.lit(":"), "file_path", F.lit(":"), "class_name")).alias("src"),
        F.coalesce("_parent", F.concat(kind, F.lit(":"), "parent_name")).alias("dst"),
        F.when(F.col("kind") == "extends", "EXTENDS").otherwise("IMPLEMENTS").alias("type"), F.lit(1.0).alias("confidence"), F.col("kind").alias("reason"))
    return out.where("type != 'EXTENDS' or src != dst").distinct()


def route_edges(routes: DataFrame, symbols: DataFrame, import_map: DataFrame) -> DataFrame:
    """routes: file_path, controller_name, method_name. CALLS from the route's file to the controller's method.

    The first controller in an imported file counts .9, a unique one .7, else the first .5; a method that is
    not there gets a guessed id at four fifths of that.
    """
    rows = routes.where("controller_name is not null and method_name is not null").withColumnRenamed("controller_name", "name")
    anywhere = first_definition(symbols).select("name", F.col("file_path").alias("_any_file"), "definitions")
    near = _imported(rows.select("file_path", "name").distinct(), symbols, import_map)
    rows = rows.join(anywhere, "name").join(near, ["file_path", "name"], "left")
    base = F.when(F.col("_imported").isNotNull(), 0.9).when(F.col("definitions") == 1, 0.7).otherwise(0.5)
    rows = rows.select("file_path", "method_name", base.alias("_base"), F.coalesce("_imported_file", "_any_file").alias("_controller"))
    methods = last_definition(symbols).select(F.col("file_path").alias("_controller"), F.col("name").alias("method_name"), "node_id")
    rows = rows.join(methods, ["_controller", "method_name"], "left")
    guess = F.concat(F.lit("Method:"), "_controller", F.lit(":"), "method_name")
    return rows.select(F.concat(F.lit("File:"), "file_path").alias("src"), F.coalesce("node_id", guess).alias("dst"), F.lit("CALLS").alias("type"),
                       F.when(F.col("node_id").isNotNull(), F.col("_base")).otherwise(F.col("_base") * 0.8).alias("confidence"), F.lit("laravel-route").alias("reason"))


# --- imports ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Config:
    """Project files that steer imports. All are small; they come from weft.sources.project."""

    aliases: tuple = ()  # (prefix, target) of TypeScript paths, in order
    base_url: str = "."
    go_module: str | None = None
    psr4: tuple = ()  # (namespace prefix, directory)
    swift_targets: tuple = ()  # (target, directory)
    noise: frozenset = field(default_factory=frozenset)


def _ending(ext: str) -> int:
    return len(ext)


def _stems(text: Column) -> Column:
    """Every (stem, rank) with stem + EXTENSIONS[rank] = text, letter case of the ending aside."""
    low = F.lower(text)
    fits = [F.when(F.endswith(low, F.lit(e)), F.struct(F.substring(text, F.lit(1), F.length(text) - _ending(e)).alias("stem"), F.lit(k).alias("rank")))
            for k, e in enumerate(EXTENSIONS)]
    return F.array_compact(F.array(*fits))


def suffixes(files: DataFrame) -> DataFrame:
    """path, ord, suffix: every run of last segments of every path."""
    parts = F.split(F.translate("path", "\\", "/"), "/")
    rows = files.select("path", "ord", parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"))
    return rows.select("path", "ord", F.array_join(F.slice("p", F.col("k"), F.size("p") - F.col("k") + 1), "/").alias("suffix"))


def suffix_index(files: DataFrame) -> DataFrame:
    """stem_low, rank, suffix, path, ord: what an import without its ending can mean; one row for each different suffix and ending."""
    first = suffixes(files).groupBy("suffix").agg(F.min_by("path", F.struct("ord", "path")).alias("path"), F.min("ord").alias("ord"))
    return first.select("suffix", "path", "ord", F.explode(_stems(F.col("suffix"))).alias("s")).select(
        F.lower("s.stem").alias("stem_low"), "s.rank", "suffix", "path", "ord")


def by_suffix(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """wanted: request, a path-like text. Returns request, path of those that resolve.

    The longest run of last segments counts first, then the order of endings, then letter case as written, then the first path.
    """
    requests = wanted.select("request").distinct()
    parts = F.filter(F.split("request", "/"), lambda p: p != "")
    tries = requests.select("request", parts.alias("p"), F.explode(F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts)))).alias("k")).select(
        "request", "k", F.array_join(F.slice("p", F.col("k"), F.size("p") - F.col("k") + 1), "/").alias("want"))
    endings = F.array(*[F.lit(e) for e in EXTENSIONS])
    hit = tries.join(index, F.lower("want") == F.col("stem_low"))
    exact = F.concat("want", F.element_at(endings, F.col("rank") + 1)) == F.col("suffix")
    return hit.groupBy("request").agg(F.min_by("path", F.struct("k", "rank", ~exact, "ord", "path")).alias("path"))


def by_extension(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted: request, a whole path without its ending. Returns request, path of the first ending that exists."""
    stems = files.select("path", F.explode(_stems(F.col("path"))).alias("s")).select("path", F.col("s.stem").alias("request"), F.col("s.rank").alias("rank"))
    endings = F.array(*[F.lit(e) for e in EXTENSIONS])
    hit = wanted.select("request").distinct().join(stems, "request").where(F.concat("request", F.element_at(endings, F.col("rank") + 1)) == F.col("path"))
    return hit.groupBy("request").agg(F.min_by("path", "rank").alias("path"))


def relative_base(current: Column, raw: Column) -> Column:
    """The path that a relative import means: . and .. worked off from the current file's directory."""
    start = F.split(F.regexp_extract(current, "^(.*)/[^/]*$", 1), "/")
    start = F.when(F.contains(current, F.lit("/")), start).otherwise(F.array().cast("array<string>"))

    def walk(at: Column, part: Column) -> Column:
        up = F.when(F.size(at) > 0, F.slice(at, 1, F.size(at) - 1)).otherwise(at)
        return F.when(part == ".", at).when(part == "..", up).otherwise(F.concat(at, F.array(part)))

    return F.array_join(F.aggregate(F.split(raw, "/"), start, walk), "/")


def _rust_bases(current: Column, raw: Column) -> Column:
    """Module paths of a Rust import, in the order in which they are tried."""
    tail = lambda n: F.replace(F.substring(raw, F.lit(n + 1), F.length(raw)), F.lit("::"), F.lit("/"))
    folder = F.regexp_extract(current, "^(.*)/[^/]*$", 1)
    above = F.when(F.contains(folder, F.lit("/")), F.concat(F.regexp_extract(folder, "^(.*)/[^/]*$", 1), F.lit("/"))).otherwise("")
    here = F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/")))
    return (F.when(F.startswith(raw, F.lit("crate::")), F.array(F.concat(F.lit("src/"), tail(7)), tail(7)))
            .when(F.startswith(raw, F.lit("super::")), F.array(F.concat(above, tail(7))))
            .when(F.startswith(raw, F.lit("self::")), F.array(F.concat(here, tail(6))))
            .when(F.contains(raw, F.lit("::")), F.array(F.replace(raw, F.lit("::"), F.lit("/")))).otherwise(F.array().cast("array<string>")))


def _rust(rows: DataFrame, files: DataFrame) -> DataFrame:
    """_imp, path: module file, mod.rs or lib.rs, else the parent's file or mod.rs."""
    bases = rows.select("_imp", F.posexplode(_rust_bases(F.col("file_path"), F.col("raw_import_path"))).alias("b", "base"))
    parent = F.regexp_extract("base", "^(.+)/[^/]*$", 1)
    tries = F.array_compact(F.array(
        *[F.concat("base", F.lit(e)) for e in (".rs", "/mod.rs", "/lib.rs")], *[F.when(parent != "", F.concat(parent, F.lit(e))) for e in (".rs", "/mod.rs")]))
    want = bases.select("_imp", "b", F.posexplode(tries).alias("t", "path"))
    return want.join(files.select("path"), "path").groupBy("_imp").agg(F.min_by("path", F.struct("b", "t")).alias("path"))


def _jvm_wildcard(rows: DataFrame, files: DataFrame, endings) -> DataFrame:
    """_imp, path: every file that lies right inside the package, whatever stands before it."""
    package = F.replace(F.regexp_replace("raw_import_path", r"\.\*$", ""), F.lit("."), F.lit("/"))
    folder = suffixes(files.where(F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$"))).select(
        "path", F.regexp_extract("suffix", "^(.*)/[^/]*$", 1).alias("package")).where("package != ''")
    return rows.select("_imp", package.alias("package")).join(folder, "package").select("_imp", "path").distinct()


def _go(rows: DataFrame, files: DataFrame, module: str) -> DataFrame:
    package = F.substring("raw_import_path", len(module) + 2, 1 << 20)
    folder = suffixes(files.where(F.endswith("path", F.lit(".go")) & ~F.endswith("path", F.lit("_test.go")))).select(
        "path", F.regexp_extract("suffix", "^(.*)/[^/]*$", 1).alias("package")).where("package != ''")
    own = rows.where(F.startswith("raw_import_path", F.lit(module))).select("_imp", package.alias("package")).where("package != ''")
    return own.join(folder, "package").select("_imp", "path").distinct()


def resolve_imports(imports: DataFrame, files: DataFrame, config: Config = Config()) -> DataFrame:
    """imports: file_path, raw_import_path, language. files: path. Returns file_path, imported_path, distinct.

    Rules by language come first (JVM packages and members, Go packages, PHP namespaces, Swift targets, TypeScript
    aliases, Rust modules), then relative paths, then suffixes; PHP and Swift go no further than their own rules.
    """
    from pyspark.sql import Window

    from weft.session import materialise

    files = files.select("path").distinct()
    files = files.withColumn("ord", F.struct("path"))  # files are in the order of their paths
    rows = materialise(imports.select("file_path", "raw_import_path", "language").distinct().withColumn(
        "_imp", F.xxhash64("file_path", "raw_import_path", "language")))
    index = materialise(suffix_index(files))
    lang, raw = F.col("language"), F.col("raw_import_path")
    dotted = F.when(F.contains(raw, F.lit("/")), raw).otherwise(F.replace(raw, F.lit("."), F.lit("/")))
    found: list[DataFrame] = []  # (_imp, path, step): the lowest step with a hit counts

    def add(frame: DataFrame, step: int) -> None:
        found.append(frame.select("_imp", "path", F.lit(step).alias("step")))

    def suffix_rule(some: DataFrame, request: Column, step: int) -> None:
        own = some.select("_imp", request.alias("request"))
        add(own.join(by_suffix(own, index), "request"), step)

    def extension_rule(some: DataFrame, request: Column, step: int) -> None:
        own = some.select("_imp", request.alias("request"))
        add(own.join(by_extension(own, files), "request"), step)

    jvm = rows.where(lang.isin("java", "kotlin"))
    star = F.endswith(raw, F.lit(".*"))
    add(_jvm_wildcard(jvm.where(star & (lang == "java")), files, (".java",)), 1)
    add(_jvm_wildcard(jvm.where(star & (lang == "kotlin")), files, KOTLIN), 1)
    add(_jvm_wildcard(jvm.where(star & (lang == "kotlin")), files, (".java",)), 2)
    tail = F.element_at(F.split(raw, r"\."), -1)
    member = jvm.where(~star & (F.size(F.split(raw, r"\.")) >= 3) & tail.rlike(r"^([a-z].*|[A-Z_]+|\*)$"))
    class_path = F.replace(F.regexp_replace(raw, r"\.[^.]*$", ""), F.lit("."), F.lit("/"))
    for step, (who, ending) in enumerate((("java", ".java"), ("kotlin", ".kt"), ("kotlin", ".kts"), ("kotlin", ".java")), 3):
        own = member.where(lang == who).select("_imp", F.concat(class_path, F.lit(ending)).alias("request"))
        exact = own.join(index.where("rank = 0"), F.lower("request") == F.col("stem_low"))
        add(exact.groupBy("_imp").agg(F.min_by("path", F.struct(F.col("suffix") != F.col("request"), "ord")).alias("path")), step)
    if config.go_module:
        add(_go(rows.where(lang == "go"), files, config.go_module), 1)
    php = rows.where(lang == "php")
    slashed = F.translate(raw, "\\", "/")
    for step, (prefix, folder) in enumerate(sorted(config.psr4, key=lambda p: -len(p[0])), 1):
        ns = prefix.replace("\\", "/").rstrip("/")
        own = php.where((slashed == ns) | F.startswith(slashed, F.lit(ns + "/")))
        rest = F.regexp_replace(F.substring(slashed, len(ns) + 1, 1 << 20), "^/", "")
        want = own.select("_imp", F.concat(F.lit(folder.rstrip("/")), F.when(rest != "", F.concat(F.lit("/"), rest)).otherwise(""), F.lit(".php")).alias("request"))
        exact = want.join(index.where("rank = 0"), F.lower("request") == F.col("stem_low"))
        add(exact.groupBy("_imp").agg(F.min_by("path", F.struct(F.col("path") != F.col("request"), F.col("suffix") != F.col("request"), "ord")).alias("path")), step)
    suffix_rule(php, slashed, 90)
    for target, folder in config.swift_targets:
        own = rows.where((lang == "swift") & (raw == target)).select("_imp")
        below = files.where(F.startswith("path", F.lit(folder.rstrip("/") + "/")) & F.endswith("path", F.lit(".swift"))).select("path")
        if below.isEmpty():
            continue
        add(own.withColumn("_t", F.lit(target)).join(below.withColumn("_t", F.lit(target)), "_t"), 1)
    plain = rows.where(~lang.isin("php", "swift") & ~(lang.isin("java", "kotlin") & star))
    script = plain.where(lang.isin("typescript", "javascript", "tsx") & ~F.startswith(raw, F.lit(".")))
    for k, (prefix, target) in enumerate(config.aliases):
        own = script.where(F.startswith(raw, F.lit(prefix)))
        base = target if config.base_url == "." else f"{config.base_url}/{target}"
        rewritten = F.concat(F.lit(base), F.substring(raw, len(prefix) + 1, 1 << 20))
        extension_rule(own, rewritten, 10 + 2 * k)
        suffix_rule(own, rewritten, 11 + 2 * k)
    add(_rust(plain.where(lang == "rust"), files), 70)
    relative = F.startswith(raw, F.lit("."))
    extension_rule(plain.where(relative), relative_base(F.col("file_path"), raw), 80)
    suffix_rule(plain.where(~relative & ~star), dotted, 90)
    out = found[0]
    for frame in found[1:]:
        out = out.union(frame)
    best = out.withColumn("_first", F.min("step").over(Window.partitionBy("_imp"))).where("step = _first")
    return rows.join(best.select("_imp", "path"), "_imp").select("file_path", F.col("path").alias("imported_path")).distinct()


def import_edges(import_map: DataFrame) -> DataFrame:
    file_id = lambda c: F.concat(F.lit("file_"), F.substring(F.sha2(c, 256), 1, 16))
    return import_map.select(file_id("file_path").alias("src"), file_id("imported_path").alias("dst"), F.lit("IMPORTS").alias("type"),
                             F.lit(1.0).alias("confidence"), F.lit("").alias("reason"))
