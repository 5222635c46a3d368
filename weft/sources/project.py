"""Small files that describe a project: import aliases, module names, ignore lists, settings, version control.

They are read on the driver; each is one small file. What cannot be read counts as absent.
"""

from __future__ import annotations

import json
import re
import subprocess
import tomllib
from pathlib import Path

from weft.operators.resolve import Config


def _json(path: Path):
    try:
        raw = path.read_text(encoding="utf-8")
        return json.loads(re.sub(r"/\*[\s\S]*?\*/", "", re.sub(r"(?m)(^|[^:\"'])//.*$", r"\1", raw)))
    except (OSError, ValueError):
        return None


def typescript_paths(root: Path) -> tuple[tuple, str]:
    """((prefix, target), ...) and base folder of the first settings file that has import paths."""
    for name in ("tsconfig.json", "tsconfig.app.json", "tsconfig.base.json"):
        options = (_json(root / name) or {}).get("compilerOptions") or {}
        cut = lambda x: x[:-1] if x.endswith("/*") else x
        found = tuple((cut(k), cut(v[0])) for k, v in (options.get("paths") or {}).items() if isinstance(v, list) and v)
        if found:
            return found, options.get("baseUrl", ".")
    return (), "."


def go_module(root: Path) -> str | None:
    try:
        hit = re.search(r"(?m)^module\s+(\S+)", (root / "go.mod").read_text(encoding="utf-8"))
    except OSError:
        return None
    return hit[1] if hit else None


def php_namespaces(root: Path) -> tuple:
    """((prefix, folder), ...) of both autoload sections."""
    composer = _json(root / "composer.json") or {}
    both = {**((composer.get("autoload") or {}).get("psr-4") or {}), **((composer.get("autoload-dev") or {}).get("psr-4") or {})}
    one = lambda v: (v[0] if v else "") if isinstance(v, list) else v
    return tuple((k.rstrip("\\"), one(v).rstrip("/")) for k, v in both.items())


def swift_targets(root: Path) -> tuple:
    """((target, folder), ...): folders below the usual places for packages."""
    out = {}
    for top in ("Sources", "Package/Sources", "src"):
        folder = root / top
        if folder.is_dir():
            for p in sorted(folder.iterdir()):
                if p.is_dir():
                    out.setdefault(p.name, f"{top}/{p.name}")
    return tuple(out.items())


def config(root: str | Path) -> Config:
    root = Path(root)
    aliases, base = typescript_paths(root)
    return Config(aliases=aliases, base_url=base, go_module=go_module(root), psr4=php_namespaces(root), swift_targets=swift_targets(root))


def ignore_lines(root: str | Path, *names: str) -> list[str]:
    """Patterns of the ignore files, in order."""
    out = []
    for name in names or (".gitignore", ".weftignore"):
        try:
            out += [x for x in (Path(root) / name).read_text(encoding="utf-8", errors="ignore").splitlines() if x.strip() and not x.startswith("#")]
        except OSError:
            continue
    return out


def settings(root: str | Path, name: str = "weft.toml") -> dict:
    """The `analysis` section of the settings file."""
    try:
        return tomllib.loads((Path(root) / name).read_text(encoding="utf-8")).get("analysis", {})
    except (OSError, tomllib.TOMLDecodeError):
        return {}


def _git(root, *args: str) -> str | None:
    done = subprocess.run(["git", "-C", str(root), *args], capture_output=True, text=True, check=False)
    return done.stdout if done.returncode == 0 else None


def git_root(path: str | Path) -> str | None:
    out = _git(path, "rev-parse", "--show-toplevel")
    return out.strip() if out else None


def git_head(root) -> str | None:
    out = _git(root, "rev-parse", "HEAD")
    return out.strip() if out else None


def changed_files(root, scope: str = "unstaged", base: str | None = None) -> list[str]:
    """Paths by scope: unstaged, staged, all or compare (needs a base)."""
    if scope == "compare" and not base:
        raise ValueError("compare needs a base")
    args = {"staged": ["--staged"], "all": ["HEAD"], "compare": [base]}.get(scope, [])
    out = _git(root, "diff", *[a for a in args if a], "--name-only")
    if out is None:
        raise RuntimeError(f"git diff failed in {root}")
    return [x for x in out.split("\n") if x]


def commits_behind(root, indexed: str) -> int:
    """Commits between the indexed one and HEAD; 0 where that cannot be told."""
    out = _git(root, "rev-list", "--count", f"{indexed}..HEAD")
    return int(out) if out and out.strip().isdigit() else 0


def inside(root: str | Path, path: str) -> Path:
    """The path below root; one that leaves root is refused."""
    base = Path(root).resolve()
    full = (base / path).resolve()
    if full != base and base not in full.parents:
        raise ValueError(f"outside the project: {path}")
    return full
