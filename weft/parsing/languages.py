"""What defines, imports, calls and inherits in each language, as regular expressions over cleaned text.

Python goes through its own syntax tree (see extract). For the others a definition is a pattern with the
group n (the name); recall is lower than a full grammar's: what spans odd line breaks or hides in macros is missed.
"""

from __future__ import annotations

import builtins
import keyword
import re
from dataclasses import dataclass, field

_ID = r"[A-Za-z_$][\w$]*"


@dataclass(frozen=True)
class Language:
    definitions: tuple  # (label, pattern)
    imports: tuple = ()
    heritage: tuple = ()  # (kind, pattern with groups c and p); p may list several parents
    functions: frozenset = frozenset({"Function", "Method", "Constructor"})
    lifetimes: bool = False  # 'a is no string
    hashes: bool = False  # # begins a comment
    public: str | None = None  # word before a definition that makes it visible
    extra: dict = field(default_factory=dict)


def _p(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.MULTILINE)


_JS_FUNCTIONS = (
    ("Function", _p(rf"\bfunction\s*\*?\s*(?P<n>{_ID})\s*[<(]")),
    ("Function", _p(rf"\b(?:const|let|var)\s+(?P<n>{_ID})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=\n{{]+)?=>|{_ID}\s*=>)")),
    ("Method", _p(rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*(?P<n>#?{_ID})\s*(?:<[^>\n]*>)?\([^()\n]*\)\s*(?::[^{{;\n]+)?\{{")),
)
_JS_IMPORTS = (_p(r"\bimport\s+(?:[^'\";]*?\bfrom\s*)?['\"](?P<i>[^'\"\n]+)['\"]"), _p(r"\bexport\s+[^'\";]*?\bfrom\s*['\"](?P<i>[^'\"\n]+)['\"]"))
_CLASS = rf"\bclass\s+(?P<n>{_ID})"

LANGUAGES = {
    "javascript": Language((("Class", _p(_CLASS)), *_JS_FUNCTIONS), _JS_IMPORTS, (("extends", _p(rf"\bclass\s+(?P<c>{_ID})(?:<[^>\n]*>)?\s+extends\s+(?P<p>{_ID})")),), public="export"),
    "typescript": Language(
        (("Class", _p(_CLASS)), ("Interface", _p(rf"\binterface\s+(?P<n>{_ID})")), *_JS_FUNCTIONS), _JS_IMPORTS,
        (("extends", _p(rf"\bclass\s+(?P<c>{_ID})(?:<[^>\n]*>)?\s+extends\s+(?P<p>{_ID})")),
         ("implements", _p(rf"\bclass\s+(?P<c>{_ID})[^{{\n]*?\bimplements\s+(?P<p>[^{{\n]+)"))), public="export"),
    "java": Language(
        (("Class", _p(_CLASS)), ("Interface", _p(rf"(?<!@)\binterface\s+(?P<n>{_ID})")), ("Annotation", _p(rf"@interface\s+(?P<n>{_ID})")), ("Enum", _p(rf"\benum\s+(?P<n>{_ID})")),
         ("Method", _p(rf"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>\n]+>\s+)?{_ID}(?:<[^()\n]*>)?(?:\[\])*\s+(?P<n>{_ID})\s*\([^()]*\)\s*(?:throws\s+[\w., ]+)?[{{;]")),
         ("Constructor", _p(r"^[ \t]+(?:(?:public|private|protected)\s+)?(?P<n>[A-Z]\w*)\s*\([^()]*\)\s*(?:throws\s+[\w., ]+)?\{"))),
        (_p(r"^\s*import\s+(?:static\s+)?(?P<i>[\w.]+(?:\.\*)?)\s*;"),),
        (("extends", _p(rf"\bclass\s+(?P<c>{_ID})(?:<[^>\n]*>)?\s+extends\s+(?P<p>{_ID})")), ("implements", _p(rf"\bclass\s+(?P<c>{_ID})[^{{]*?\bimplements\s+(?P<p>[^{{]+)"))), public="public"),
    "c": Language(
        (("Function", _p(rf"^[A-Za-z_][\w \t*]*?[ \t*](?P<n>{_ID})\s*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)\s*\{{")), ("Struct", _p(rf"\bstruct\s+(?P<n>{_ID})\s*\{{")),
         ("Union", _p(rf"\bunion\s+(?P<n>{_ID})\s*\{{")), ("Enum", _p(rf"\benum\s+(?P<n>{_ID})\s*\{{")), ("Typedef", _p(rf"\btypedef\b[^;{{}}]*?\b(?P<n>{_ID})\s*;")),
         ("Macro", _p(rf"^[ \t]*#[ \t]*define[ \t]+(?P<n>{_ID})"))),
        (_p(r"^[ \t]*#[ \t]*include[ \t]*[<\"](?P<i>[^>\"\n]+)[>\"]"),)),
    "cpp": Language(
        (("Class", _p(rf"\bclass\s+(?P<n>{_ID})[^;(){{}}]*\{{")), ("Struct", _p(rf"\bstruct\s+(?P<n>{_ID})[^;(){{}}]*\{{")), ("Namespace", _p(rf"\bnamespace\s+(?P<n>{_ID})")),
         ("Enum", _p(rf"\benum\s+(?:class\s+)?(?P<n>{_ID})")), ("Function", _p(rf"^[A-Za-z_][\w:<>,&\s*~]*?[ \t*&:](?P<n>~?{_ID})\s*\([^;{{}}()]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?::[^;{{}}]*)?\{{"))),
        (_p(r"^[ \t]*#[ \t]*include[ \t]*[<\"](?P<i>[^>\"\n]+)[>\"]"),),
        (("extends", _p(rf"\b(?:class|struct)\s+(?P<c>{_ID})\s*(?:final\s*)?:\s*(?P<p>[^{{;]+)\{{")),)),
    "csharp": Language(
        (("Class", _p(_CLASS)), ("Interface", _p(rf"\binterface\s+(?P<n>{_ID})")), ("Struct", _p(rf"\bstruct\s+(?P<n>{_ID})")), ("Enum", _p(rf"\benum\s+(?P<n>{_ID})")),
         ("Record", _p(rf"\brecord\s+(?:class\s+|struct\s+)?(?P<n>{_ID})")), ("Delegate", _p(rf"\bdelegate\s+[\w<>\[\], ]+?\s+(?P<n>{_ID})\s*\(")), ("Namespace", _p(r"\bnamespace\s+(?P<n>[\w.]+)")),
         ("Method", _p(rf"^[ \t]+(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed|partial)\s+)*[\w<>\[\],.?]+\s+(?P<n>{_ID})\s*(?:<[^>\n]*>)?\([^()]*\)\s*(?:where[^{{\n]*)?(?:\{{|=>)")),
         ("Constructor", _p(r"^[ \t]+(?:public|private|protected|internal)\s+(?P<n>[A-Z]\w*)\s*\([^()]*\)\s*(?::\s*(?:base|this)\([^()]*\)\s*)?\{")),
         ("Property", _p(rf"^[ \t]+(?:(?:public|private|protected|internal|static|virtual|override)\s+)+[\w<>\[\],.?]+\s+(?P<n>{_ID})\s*\{{\s*(?:get|set)"))),
        (_p(r"^\s*using\s+(?:static\s+)?(?P<i>[\w.]+)\s*;"),), (("extends", _p(rf"\b(?:class|struct|record|interface)\s+(?P<c>{_ID})(?:<[^>\n]*>)?\s*:\s*(?P<p>[^{{\n]+)")),), public="public"),
    "go": Language(
        (("Function", _p(rf"^func\s+(?P<n>{_ID})\s*[\[(]")), ("Method", _p(rf"^func\s*\([^)]*\)\s*(?P<n>{_ID})\s*\(")), ("Struct", _p(rf"\btype\s+(?P<n>{_ID})\s+struct\b")),
         ("Interface", _p(rf"\btype\s+(?P<n>{_ID})\s+interface\b")), ("TypeAlias", _p(rf"^type\s+(?P<n>{_ID})\s+=?\s*(?!struct\b|interface\b)[\w\[\]*.]+"))),
        (_p(r"^\s*import\s+(?:[\w.]+\s+)?\"(?P<i>[^\"\n]+)\""),), extra={"grouped": _p(r"^\s*import\s*\((?P<b>[^)]*)\)")}),
    "rust": Language(
        (("Function", _p(rf"\bfn\s+(?P<n>{_ID})")), ("Struct", _p(rf"\bstruct\s+(?P<n>{_ID})")), ("Enum", _p(rf"\benum\s+(?P<n>{_ID})")), ("Trait", _p(rf"\btrait\s+(?P<n>{_ID})")),
         ("Impl", _p(rf"\bimpl(?:<[^>\n]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<n>{_ID})")), ("Module", _p(rf"\bmod\s+(?P<n>{_ID})")), ("TypeAlias", _p(rf"\btype\s+(?P<n>{_ID})")),
         ("Const", _p(rf"\bconst\s+(?P<n>{_ID})\s*:")), ("Static", _p(rf"\bstatic\s+(?:mut\s+)?(?P<n>{_ID})\s*:")), ("Macro", _p(rf"\bmacro_rules!\s*(?P<n>{_ID})"))),
        (_p(r"^\s*(?:pub\s+)?use\s+(?P<i>[\w:]+(?:::\w+)*)"),), (("trait-impl", _p(rf"\bimpl(?:<[^>\n]*>)?\s+(?P<p>{_ID})(?:<[^>\n]*>)?\s+for\s+(?P<c>{_ID})")),), lifetimes=True, public="pub"),
    "php": Language(
        (("Namespace", _p(r"^\s*namespace\s+(?P<n>[\w\\]+)")), ("Class", _p(_CLASS)), ("Interface", _p(rf"\binterface\s+(?P<n>{_ID})")), ("Trait", _p(rf"\btrait\s+(?P<n>{_ID})")),
         ("Enum", _p(rf"\benum\s+(?P<n>{_ID})")), ("Method", _p(rf"^[ \t]+(?:(?:public|private|protected|static|abstract|final)\s+)+function\s+&?(?P<n>{_ID})")),
         ("Function", _p(rf"^function\s+&?(?P<n>{_ID})")), ("Property", _p(r"^[ \t]+(?:(?:public|private|protected|static|readonly)\s+)+(?:\??[\w\\|]+\s+)?\$(?P<n>\w+)\s*[=;]"))),
        (_p(r"^use\s+(?:function\s+|const\s+)?(?P<i>[\w\\]+)"),),
        (("extends", _p(rf"\bclass\s+(?P<c>{_ID})\s+extends\s+(?P<p>[\w\\]+)")), ("implements", _p(rf"\bclass\s+(?P<c>{_ID})[^{{]*?\bimplements\s+(?P<p>[^{{]+)"))), hashes=True, public="public"),
    "kotlin": Language(
        (("Interface", _p(rf"\binterface\s+(?P<n>{_ID})")), ("Class", _p(rf"\b(?:class|object)\s+(?P<n>{_ID})")), ("Function", _p(rf"\bfun\s+(?:<[^>\n]*>\s*)?(?:{_ID}\.)?(?P<n>{_ID})\s*\(")),
         ("Property", _p(rf"^[ \t]*(?:(?:private|public|internal|protected|override|lateinit|const)\s+)*va[lr]\s+(?P<n>{_ID})")), ("TypeAlias", _p(rf"\btypealias\s+(?P<n>{_ID})"))),
        (_p(r"^\s*import\s+(?P<i>[\w.]+(?:\.\*)?)"),), (("extends", _p(rf"\b(?:class|object|interface)\s+(?P<c>{_ID})(?:<[^>\n]*>)?\s*(?:\([^()]*\))?\s*:\s*(?P<p>[^{{\n]+)")),)),
    "swift": Language(
        (("Class", _p(rf"\b(?:class|struct|enum|extension|actor)\s+(?!func\b|var\b)(?P<n>{_ID})")), ("Interface", _p(rf"\bprotocol\s+(?P<n>{_ID})")), ("TypeAlias", _p(rf"\btypealias\s+(?P<n>{_ID})")),
         ("Function", _p(rf"\bfunc\s+(?P<n>{_ID})")), ("Constructor", _p(r"\b(?P<n>init)\s*[?!]?\s*\(")), ("Property", _p(rf"^[ \t]+(?:(?:public|private|open|internal|static|lazy|weak|@\w+)\s+)*(?:var|let)\s+(?P<n>{_ID})"))),
        (_p(r"^\s*(?:@testable\s+)?import\s+(?:class\s+|struct\s+|func\s+)?(?P<i>[\w.]+)"),), (("extends", _p(rf"\b(?:class|struct|enum|extension|actor|protocol)\s+(?P<c>{_ID})\s*:\s*(?P<p>[^{{\n]+)")),), public="public|open"),
}
CALL = re.compile(rf"(?<![\w$])({_ID})\s*(?:<[\w, ]*>)?\(")
# Words that stand before a parenthesis without being called.
WORDS = frozenset(
    "if for while switch catch return function sizeof throw new typeof await match when guard else do elif with and or not in is as fn func fun def class "
    "case super this self init constructor synchronized using lock foreach unless until loop where let var const assert del lambda yield print".split())


def noise(more=()) -> frozenset:
    """Names of calls that say nothing: what Python's own types offer, words of the languages, and what is given."""
    own = set(dir(builtins)) | set(keyword.kwlist)
    for kind in (str, bytes, list, dict, set, tuple, int, float):
        own |= {n for n in dir(kind) if not n.startswith("_")}
    script = (
        "console log warn info debug setTimeout setInterval clearTimeout clearInterval parseInt parseFloat isNaN encodeURIComponent decodeURIComponent fetch require "
        "map filter reduce forEach find findIndex some every includes indexOf slice splice push pop shift unshift concat join split replace trim toLowerCase toUpperCase "
        "toString charAt substring startsWith endsWith padStart padEnd keys values entries then catch finally resolve reject all race stringify parse addEventListener "
        "removeEventListener querySelector createElement appendChild useState useEffect useCallback useMemo useRef useContext useReducer assign freeze hasOwnProperty").split()
    native = "printf fprintf sprintf snprintf malloc calloc realloc free memcpy memset strlen strcmp strcpy println panic make append len cap unwrap expect clone into Some Ok Err Vec vec format".split()
    return frozenset(own | set(script) | set(native) | WORDS | set(more))
