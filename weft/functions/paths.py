"""What a file path tells: language, whether to skip it, test or utility file, framework.

Every rule is a Column over built-in functions, so it runs inside a scan's filter or projection. A
null path gives null (language, framework) or false (predicates).
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

# File name endings and their languages.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".mjs": "javascript", ".cjs": "javascript", ".java": "java", ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "c",
    ".hpp": "cpp", ".cs": "csharp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin",
    ".kts": "kotlin", ".scala": "scala", ".r": "r", ".pl": "perl", ".pm": "perl", ".sh": "shell", ".bash": "shell", ".zsh": "shell",
    ".sql": "sql", ".html": "html", ".htm": "html", ".css": "css", ".scss": "scss", ".sass": "sass", ".less": "less", ".vue": "vue",
    ".svelte": "svelte", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".xml": "xml", ".md": "markdown",
}
SPECIAL_NAMES = {"Dockerfile": "dockerfile", "Makefile": "makefile"}
PARSEABLE = ("typescript", "javascript", "python", "java", "c", "go", "cpp", "csharp", "rust", "php", "kotlin", "swift")

# Folders, names and endings that are never analysed.
IGNORED_FOLDERS = (
    ".git", ".svn", ".hg", ".bzr", ".idea", ".vscode", ".vs", ".eclipse", ".settings", ".DS_Store", "Thumbs.db", "node_modules",
    "bower_components", "jspm_packages", "vendor", "venv", ".venv", "env", ".env", "__pycache__", ".pytest_cache", ".mypy_cache",
    "site-packages", ".tox", "eggs", ".eggs", "lib64", "parts", "sdist", "wheels", "dist", "build", "out", "output", "bin", "obj", "target",
    ".next", ".nuxt", ".output", ".vercel", ".netlify", ".serverless", "_build", ".parcel-cache", ".turbo", ".svelte-kit", "coverage",
    ".nyc_output", "htmlcov", ".coverage", "__tests__", "__mocks__", ".jest", "logs", "log", "tmp", "temp", "cache", ".cache", ".tmp", ".temp",
    ".generated", "generated", "auto-generated", ".terraform", ".husky", ".github", ".circleci", ".gitlab", "fixtures", "snapshots", "__snapshots__",
)
IGNORED_NAMES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "Gemfile.lock", "poetry.lock", "Cargo.lock", "go.sum", ".gitignore",
    ".gitattributes", ".npmrc", ".yarnrc", ".editorconfig", ".prettierrc", ".prettierignore", ".eslintignore", ".dockerignore", "Thumbs.db",
    ".DS_Store", "LICENSE", "LICENSE.md", "LICENSE.txt", "CHANGELOG.md", "CHANGELOG", "CONTRIBUTING.md", "CODE_OF_CONDUCT.md", "SECURITY.md",
    ".env", ".env.local", ".env.development", ".env.production", ".env.test", ".env.example",
)
IGNORED_ENDINGS = (
    "png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "bmp", "tiff", "tif", "psd", "ai", "sketch", "fig", "xd", "zip", "tar", "gz", "rar", "7z",
    "bz2", "xz", "tgz", "exe", "dll", "so", "dylib", "a", "lib", "o", "obj", "class", "jar", "war", "ear", "pyc", "pyo", "pyd", "beam", "wasm",
    "node", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "mp4", "mp3", "wav", "mov", "avi", "mkv", "flv", "wmv", "ogg",
    "webm", "flac", "aac", "m4a", "woff", "woff2", "ttf", "eot", "otf", "db", "sqlite", "sqlite3", "mdb", "accdb", "min.js", "min.css",
    "bundle.js", "chunk.js", "map", "lock", "pem", "key", "crt", "cer", "p12", "pfx", "csv", "tsv", "parquet", "avro", "feather", "npy", "npz",
    "pkl", "pickle", "h5", "hdf5", "bin", "dat", "data", "raw", "iso", "img", "dmg",
)
# Patterns that the walker always leaves out, in the notation of ignore files.
DEFAULT_PATTERNS = (
    ".git", ".svn", ".hg", ".bzr", ".vscode", ".idea", "*.swp", "*.swo", "*~", ".DS_Store", "Thumbs.db", "__pycache__", "*.pyc", "*.pyo",
    ".pytest_cache", ".ruff_cache", ".mypy_cache", "node_modules", "dist", "build", "*.egg-info", ".coverage", "htmlcov", ".venv", "venv", "env", "*.log",
)
# What marks a test file (in the lower-case path), by use.
TEST_PARTS = (".test.", ".spec.", "__tests__/", "__mocks__/", "/test/", "/tests/", "/testing/", "/test_", "uitests/", ".tests/", "tests.cs")
TEST_ENDINGS = ("_test.py", "_test.go", "tests.swift", "test.swift", "test.php", "spec.php")
IMPACT_TEST_PARTS = (".test.", ".spec.", "__tests__/", "__mocks__/", "/test/", "/tests/", "/testing/", "/fixtures/", "/test_", "/conftest.")
IMPACT_TEST_ENDINGS = ("_test.go", "_test.py")
UTILITY_PARTS = ("/utils/", "/util/", "/helpers/", "/helper/", "/common/", "/shared/", "/lib/")
UTILITY_ENDINGS = ("/utils.ts", "/utils.js", "/helpers.ts", "/helpers.js", "_utils.py", "_helpers.py")

# Framework, weight, reason and the shape of the lower-case path; the first that fits counts.
FRAMEWORKS = (
    ("nextjs-pages", 3.0, "nextjs-page", r"^(?!.*/_)(?!.*/api/).*/pages/.*\.(tsx|ts|jsx|js)$"),
    ("nextjs-app", 3.0, "nextjs-app-page", r"/app/.*page\.(tsx|ts|jsx|js)$"),
    ("nextjs-api", 3.0, "nextjs-api-route", r"/pages/api/|^(?=.*/app/)(?=.*/api/).*route\.ts$"),
    ("nextjs-app", 2.0, "nextjs-layout", r"/app/.*layout\.(tsx|ts)$"),
    ("express", 2.5, "routes-folder", r"/routes/.*\.(ts|js)$"),
    ("mvc", 2.5, "controllers-folder", r"/controllers/.*\.(ts|js)$"),
    ("handlers", 2.5, "handlers-folder", r"/handlers/.*\.(ts|js)$"),
    ("django", 3.0, "django-views", r"views\.py$"),
    ("django", 2.0, "django-urls", r"urls\.py$"),
    ("fastapi", 2.5, "api-routers", r"/(routers|endpoints|routes)/.*\.py$"),
    ("python-api", 2.0, "api-folder", r"^(?!.*__init__\.py$).*/api/.*\.py$"),
    ("spring", 3.0, "spring-controller", r"/controllers?/.*\.java$"),
    ("spring", 3.0, "spring-controller-file", r"controller\.java$"),
    ("java-service", 1.8, "java-service", r"/services?/.*\.java$"),
    ("spring-kotlin", 3.0, "spring-kotlin-controller", r"/controllers?/.*\.kt$"),
    ("spring-kotlin", 3.0, "spring-kotlin-controller-file", r"controller\.kt$"),
    ("ktor", 2.5, "ktor-routes", r"/routes/.*\.kt$"),
    ("ktor", 2.0, "ktor-plugin", r"/plugins/.*\.kt$"),
    ("ktor", 2.5, "ktor-routing-file", r"(routing|routes)\.kt$"),
    ("android-kotlin", 2.5, "android-ui", r"/(activity|ui)/.*\.kt$"),
    ("android-kotlin", 2.5, "android-component", r"(activity|fragment)\.kt$"),
    ("kotlin", 3.0, "kotlin-main", r"/main\.kt$"),
    ("kotlin", 2.5, "kotlin-application", r"/application\.kt$"),
    ("aspnet", 3.0, "aspnet-controller", r"/controllers/.*\.cs$"),
    ("aspnet", 3.0, "aspnet-controller-file", r"controller\.cs$"),
    ("blazor", 2.5, "blazor-page", r"/pages/.*\.razor$"),
    ("go-http", 2.5, "go-handlers", r"/handlers?/.*\.go$"),
    ("go-http", 2.5, "go-routes", r"/routes/.*\.go$"),
    ("go-mvc", 2.5, "go-controller", r"/controllers/.*\.go$"),
    ("go", 3.0, "go-main", r"/main\.go$|/cmd/.*\.go$"),
    ("rust-web", 2.5, "rust-handlers", r"/(handlers|routes)/.*\.rs$"),
    ("rust", 3.0, "rust-main", r"/main\.rs$"),
    ("rust", 2.5, "rust-bin", r"/bin/.*\.rs$"),
    ("c-cpp", 3.0, "c-main", r"/main\.(c|cpp|cc)$"),
    ("c-cpp", 2.5, "c-app", r"/src/(.*/)?app\.(c|cpp)$"),
    ("laravel", 3.0, "laravel-routes", r"/routes/.*\.php$"),
    ("laravel", 3.0, "laravel-controller", r"/controllers/.*\.php$"),
    ("laravel", 3.0, "laravel-controller-file", r"controller\.php$"),
    ("laravel", 2.5, "laravel-command", r"/commands/.*\.php$"),
    ("laravel", 2.5, "laravel-job", r"/jobs/.*\.php$"),
    ("laravel", 2.5, "laravel-listener", r"/listeners/.*\.php$"),
    ("laravel", 2.5, "laravel-middleware", r"/http/middleware/.*\.php$"),
    ("laravel", 1.8, "laravel-provider", r"/providers/.*\.php$"),
    ("laravel", 2.0, "laravel-policy", r"/policies/.*\.php$"),
    ("laravel", 1.5, "laravel-model", r"/models/.*\.php$"),
    ("laravel", 1.8, "laravel-service", r"/services/.*\.php$"),
    ("laravel", 1.5, "laravel-repository", r"/repositories/.*\.php$"),
    ("ios", 3.0, "ios-app-entry", r"/(appdelegate|scenedelegate|app)\.swift$"),
    ("swiftui", 3.0, "swiftui-app", r"/sources/.*app\.swift$"),
    ("uikit", 2.5, "uikit-viewcontroller", r"/(viewcontrollers|controllers|screens)/.*\.swift$"),
    ("uikit", 2.5, "uikit-viewcontroller-file", r"(viewcontroller|vc)\.swift$"),
    ("ios-coordinator", 2.5, "ios-coordinator", r"/coordinators/.*\.swift$"),
    ("ios-coordinator", 2.5, "ios-coordinator-file", r"coordinator\.swift$"),
    ("swiftui", 1.8, "swiftui-view", r"/(views|scenes)/.*\.swift$"),
    ("ios-service", 1.8, "ios-service", r"/services/.*\.swift$"),
    ("ios-router", 2.0, "ios-router", r"/router/.*\.swift$"),
    ("api", 1.8, "api-index", r"/api/(.*/)?(index\.ts|index\.js|__init__\.py)$"),
)
# React components are known by a capital first letter, so their rule reads the path as written; it comes after "handlers".
REACT = ("react", 1.5, "react-component", r"(?i:/(components|views)/)(.*/)?[A-Z][^/]*(?i:\.(tsx|jsx))$")

# Framework, weight, reason and the marks of it in a definition's text, by language; the first that fits counts.
_NEST = ("nestjs", 3.2, "nestjs-decorator", ("@Controller", "@Get", "@Post", "@Put", "@Delete", "@Patch"))
_SPRING = ("@RestController", "@Controller", "@GetMapping", "@PostMapping", "@RequestMapping")
_JAXRS = ("jaxrs", 3.0, "jaxrs-annotation", ("@Path", "@GET", "@POST", "@PUT", "@DELETE"))
DEFINITION_FRAMEWORKS = {
    "javascript": (_NEST,),
    "typescript": (_NEST,),
    "python": (
        ("fastapi", 3.0, "fastapi-decorator", ("@app.get", "@app.post", "@app.put", "@app.delete", "@router.get")),
        ("flask", 2.8, "flask-decorator", ("@app.route", "@blueprint.route")),
    ),
    "java": (("spring", 3.2, "spring-annotation", _SPRING), _JAXRS),
    "kotlin": (
        ("spring-kotlin", 3.2, "spring-kotlin-annotation", _SPRING),
        _JAXRS,
        ("ktor", 2.8, "ktor-routing", ("routing", "embeddedServer", "Application.module")),
        ("android-kotlin", 2.5, "android-annotation", ("@AndroidEntryPoint", "AppCompatActivity", "Fragment(")),
    ),
    "csharp": (("aspnet", 3.2, "aspnet-attribute", ("[ApiController]", "[HttpGet]", "[HttpPost]", "[Route]")),),
    "php": (("laravel", 3.0, "php-route-attribute",
             ("Route::get", "Route::post", "Route::put", "Route::delete", "Route::resource", "Route::apiResource", "#[Route(")),),
}

_HINT = "struct<framework:string,multiplier:double,reason:string>"


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_name(path: Column) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_extract(slashes(path), "^(.*)/[^/]*$", 1)


def short_path(path: Column, n: int = 3) -> Column:
    """The last n segments."""
    parts = F.split(slashes(path), "/")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - (n - 1)), n), "/")


def language(path: Column) -> Column:
    """Language by ending or special name; null for anything else."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    special = F.create_map(*[F.lit(x) for pair in SPECIAL_NAMES.items() for x in pair])
    name = file_name(path)
    return F.coalesce(F.element_at(known, F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))), F.element_at(special, name))


def is_parseable(path: Column) -> Column:
    return F.coalesce(language(path).isin(*PARSEABLE), F.lit(False))


def is_ignored(path: Column) -> Column:
    """Never analysed: a folder, name or ending of the fixed lists, or bundled, chunked, generated or declaration code."""
    p, name = slashes(path), file_name(path)
    low = F.lower(name)
    rule = F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(x) for x in IGNORED_FOLDERS])) | name.isin(*IGNORED_NAMES) | low.isin(*IGNORED_NAMES)
    ends = "|".join(re.escape(x) for x in IGNORED_ENDINGS)
    return F.coalesce(rule | low.rlike(rf"\.({ends})$") | low.rlike(r"\.(bundle|chunk|generated)\.|\.d\.ts$"), F.lit(False))


def ignore_regex(patterns) -> str:
    """One regular expression for a list of ignore-file patterns: it finds ignored paths and everything below them.

    Knows *, **, ?, [..], a leading or inner slash as an anchor and a trailing one for folders; comments and blanks are left
    out. Patterns that bring a path back (!) belong to `not_ignored`.
    """
    parts = []
    for line in patterns:
        line = line.strip()
        if not line or line[0] in "#!":
            continue
        folder, body = line.endswith("/"), line.strip("/")
        anchored = "/" in line.rstrip("/")
        out, i = "", 0
        while i < len(body):
            if body.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif body.startswith("**", i):
                out, i = out + ".*", i + 2
            elif body[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif body[i] == "?":
                out, i = out + "[^/]", i + 1
            elif body[i] == "[" and "]" in body[i + 1 :]:
                end = body.index("]", i + 1)
                inner = body[i + 1 : end]
                out, i = out + "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]", end + 1
            else:
                out, i = out + re.escape(body[i]), i + 1
        parts.append(("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)"))
    return "|".join(parts) or "(?!)"


def not_ignored(path: Column, patterns=DEFAULT_PATTERNS) -> Column:
    """Whether ignore-file patterns leave a relative path in; later patterns with ! bring paths back, in order."""
    p, out, group = slashes(path), F.lit(True), []
    for line in [*patterns, None]:
        if line is None or line.strip().startswith("!"):
            if group:
                out = out & ~p.rlike(ignore_regex(group))
                group = []
            if line is not None:
                out = out | p.rlike(ignore_regex([line.strip()[1:]]))
        else:
            group.append(line)
    return F.coalesce(out, F.lit(False))


def looks_like_glob(pattern: Column) -> Column:
    return F.coalesce(pattern.rlike(r"[*?\[]"), F.lit(False))


def _shape(path: Column, parts, endings) -> Column:
    p = F.lower(slashes(path))
    tests = [F.contains(p, F.lit(x)) for x in parts] + [F.endswith(p, F.lit(x)) for x in endings]
    return F.coalesce(reduce(or_, tests), F.lit(False))


def is_test_file(path: Column) -> Column:
    return _shape(path, TEST_PARTS, TEST_ENDINGS)


def is_test_for_impact(path: Column) -> Column:
    """The wider rule of impact analysis: fixtures and conftest count too."""
    return _shape(path, IMPACT_TEST_PARTS, IMPACT_TEST_ENDINGS)


def is_utility_file(path: Column) -> Column:
    return _shape(path, UTILITY_PARTS, UTILITY_ENDINGS)


def _hint(framework: str, weight: float, reason: str) -> Column:
    return F.struct(F.lit(framework).alias("framework"), F.lit(weight).alias("multiplier"), F.lit(reason).alias("reason"))


def framework_of_path(path: Column) -> Column:
    """struct(framework, multiplier, reason) of the first rule that fits; null if none does."""
    both = F.concat(F.lit("/"), F.regexp_replace(slashes(path), "^/", ""))

    def first(p: Column) -> Column:
        rules = [F.when(p["low"].rlike(shape), _hint(f, w, r)) for f, w, r, shape in FRAMEWORKS]
        at = [r[2] for r in FRAMEWORKS].index("handlers-folder") + 1
        rules.insert(at, F.when(p["whole"].rlike(REACT[3]), _hint(*REACT[:3])))
        return F.coalesce(*rules).cast(_HINT)

    return let(F.struct(both.alias("whole"), F.lower(both).alias("low")), first)


def framework_of_definition(lang: Column, text: Column) -> Column:
    """struct(framework, multiplier, reason) from marks in a definition's text; null if there are none."""
    def first(d: Column) -> Column:
        rules = [F.when((d["lang"] == name) & reduce(or_, [F.contains(d["text"], F.lit(m.lower())) for m in marks]), _hint(f, w, r))
                 for name, rows in DEFINITION_FRAMEWORKS.items() for f, w, r, marks in rows]
        return F.coalesce(*rules).cast(_HINT)

    return let(F.struct(F.lower(lang).alias("lang"), F.lower(text).alias("text")), first)
