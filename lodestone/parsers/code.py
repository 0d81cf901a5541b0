"""Source code: sections by symbol, and the symbol graph of Python files.

Python is parsed with its own grammar. Other languages are scanned: strings and comments are blanked, declarations and the
members of classes, interfaces, traits and implementations are found by their heads, and braces say where they end. That is
approximate where a head spans lines in unusual ways.
"""

from __future__ import annotations

import ast
import re
import textwrap

from lodestone.parsers.markup import document, section

LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java"}
_WORDS = r"(?:(?:export|default|public|protected|private|abstract|final|static|async|sealed|declare|pub(?:\([^)]*\))?|unsafe|const|override|readonly|synchronized|get|set)\s+)*"
#: By language: heads of declarations, and heads of members; the first group that is set is the name.
_HEADS = {
    "javascript": (rf"{_WORDS}(?:function\b\s*\*?\s*|class\s+)([\w$]+)", rf"{_WORDS}\*?\s*(?!(?:if|for|while|switch|catch|return)\b)([\w$#]+)\s*\([^;]*\{{"),
    "typescript": (rf"{_WORDS}(?:(?:function\b\s*\*?\s*|class\s+|interface\s+|enum\s+|namespace\s+)([\w$]+)|type\s+([\w$]+)[^=]*=)", rf"{_WORDS}\*?\s*(?!(?:if|for|while|switch|catch|return)\b)([\w$#]+)\s*(?:<[^>]*>)?\([^;]*\{{"),
    "go": (r"func\s+(?:\([^)]*?\*?([A-Za-z_]\w*)(?:\[[^\]]*\])?\)\s*)?([A-Za-z_]\w*)|type\s+([A-Za-z_]\w*)", None),
    "rust": (rf"{_WORDS}(?:(?:fn|struct|enum|trait|mod|union)\s+(\w+)|impl\b(?:<[^{{]*?>)?\s*(?:[\w:]+(?:<[^{{]*?>)?\s+for\s+)?(?:\w+::)*(\w+))", rf"{_WORDS}fn\s+(\w+)"),
    "java": (rf"{_WORDS}(?:class|interface|enum|record|@interface)\s+(\w+)", rf"{_WORDS}(?:<[^>]*>\s*)?(?:[\w.]+(?:<[^(]*>)?(?:\[\])*\s+)?(?!(?:if|for|while|switch|catch|return|new|else)\b)(\w+)\s*\([^;]*\{{"),
}
#: What has members that are symbols.
_CONTAINER = re.compile(r"\b(?:class|interface|trait|impl|record|mod|namespace)\b")
_BLANK = {
    "rust": re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])\'', re.S),
    "go": re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|`[^`]*`', re.S),
    None: re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`', re.S),
}
MAX_DEPTH = 8
#: Names that make no call edges (fixed values).
KEYWORDS = {"def", "class", "return", "if", "elif", "while", "for", "with"}
BUILTINS = {
    "print", "len", "range", "int", "str", "float", "bool", "list", "dict", "set", "tuple", "type", "super", "isinstance", "issubclass", "hasattr",
    "getattr", "setattr", "delattr", "repr", "id", "hash", "abs", "min", "max", "sum", "zip", "map", "filter", "sorted", "enumerate", "iter", "next",
    "open", "input", "format", "round", "hex", "oct", "bin", "chr", "ord", "any", "all", "vars", "dir",
}


def _module(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] or "unknown"


def _scan(text: str, language: str) -> list[tuple[list[str], int, int]]:
    """(names, first line, last line) of declarations, and of members below those that have any, in order."""
    blank = _BLANK.get(language, _BLANK[None]).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    lines, found = blank.splitlines(), []
    depth, opened = 0, []  # what is open: (names, depth before it, place in found, may have members)
    heads = [re.compile(r"\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:" + h + ")") if h else None for h in _HEADS[language]]
    for i, line in enumerate(lines, 1):
        inside = next((o for o in reversed(opened) if o[3] and depth == o[1] + 1), None)
        head = None
        if line.strip() and (depth == 0 or inside and len(inside[0]) < MAX_DEPTH):
            both = line if "{" in line or ";" in line or line.lstrip().startswith("@") else line + " " + " ".join(lines[i : i + 8]).partition("{")[0].partition(";")[0] + " {"
            head = heads[0].match(line) or (heads[1].match(both) if inside and heads[1] else None)
        if head:
            names = [*(inside[0] if inside else []), *(g for g in head.groups() if g)]
            found.append([names, i, i])
            opened.append((names, depth, len(found) - 1, bool(_CONTAINER.search(line[: head.end()]))))
        before = depth
        depth = max(0, depth + line.count("{") - line.count("}"))
        while opened and depth <= opened[-1][1] and (before > opened[-1][1] or "}" in line or ";" in line or not _opens(lines, i)):
            found[opened.pop()[2]][2] = i
    for o in opened:
        found[o[2]][2] = len(lines)
    return [(names, first, last) for names, first, last in found]


def _opens(lines: list[str], i: int) -> bool:
    """Whether a head that ends on line ``i`` (from 1) goes on to a brace on the next lines."""
    rest = " ".join(lines[i - 1 : i + 8])
    brace, stop = rest.find("{"), rest.find(";")
    return brace >= 0 and (stop < 0 or brace < stop)


def parse(text: str, path: str) -> dict | None:
    """Sections by symbol; None where nothing is found. A file with a syntax error has a warning and no symbols."""
    language = LANGUAGES.get(path[path.rfind(".") :].lower())
    lines = text.splitlines()
    module = _module(path)
    found: dict[tuple[str, int, int], dict] = {}

    def add(names: list[str], first: int, last: int, **metadata) -> None:
        symbol = ".".join([module, *names])
        found.setdefault((symbol, first, last), section("\n".join(lines[first - 1 : last]), first, last, [module, *names], symbol, language=language, **metadata))

    warning = None
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError) as e:
            return document([section(text, 1, len(lines) or 1, [module], None, partial="true")], "text/x-source", language=language, warning=str(e))

        def visit(body: list, names: list[str]) -> None:
            for node in body if len(names) < MAX_DEPTH else ():
                if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                    first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                    add([*names, node.name], first, node.end_lineno or node.lineno, kind="class" if isinstance(node, ast.ClassDef) else "function")
                    if isinstance(node, ast.ClassDef):
                        visit(node.body, [*names, node.name])

        visit(tree.body, [])
    else:
        for names, first, last in _scan(text, language):
            add(names, first, last, kind="declaration")
    return document(list(found.values()), "text/x-source", language=language, **({"warning": warning} if warning else {})) if found else None


def imports(text: str) -> list[str]:
    """Modules that lines import alone (``import a.b`` or ``import a.b as c``), then those of ``from`` lines, as often as they occur."""
    alone, named = [], []
    for words in map(str.split, text.splitlines()):
        if len(words) == 2 and words[0] == "import" or len(words) == 4 and words[0] == "import" and words[2] == "as":
            alone.append(words[1])
        elif len(words) > 3 and words[0] == "from" and words[2] == "import":
            named.append(words[1])
    return [m for m in alone + named if all(p.isidentifier() or not p for p in m.split("."))]


def _tree(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError):
        return None


def bases(text: str) -> list[str]:
    """What the first class at the start of a line is derived from, keyword arguments included, without type parameters and ``object``."""
    tree = _tree(text)
    first = next((n for n in tree.body if isinstance(n, ast.ClassDef)), None) if tree else None
    if first is None:
        return []
    plain = [ast.unparse(b.value if isinstance(b, ast.Subscript) else b) for b in first.bases]
    return [b for b in plain if b != "object"] + [f"{k.arg}={ast.unparse(k.value)}" for k in first.keywords if k.arg]


def calls(text: str, own: str) -> list[str]:
    """Distinct names that are called below the first line, by place; of dotted ones the last part."""
    tree = _tree(textwrap.dedent(text))
    found = sorted((n for n in ast.walk(tree) if isinstance(n, ast.Call) and n.lineno > 1), key=lambda n: (n.lineno, n.col_offset)) if tree else []
    names = [n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id for n in found if isinstance(n.func, ast.Attribute | ast.Name)]
    return list(dict.fromkeys(n for n in names if n not in BUILTINS | KEYWORDS | {own}))


def symbol_graph(parsed: dict, source: str) -> tuple[list[dict], list[dict]]:
    """Entities (type, name, display) and edges (type, source, target name) of a Python document."""
    symbols = [s for s in parsed["sections"] if s["symbol"]]
    module = parsed["sections"][0]["heading_path"][0] if parsed["sections"] and parsed["sections"][0]["heading_path"] else "unknown"
    nodes = [{"type": "module", "name": module, "display": module}]
    edges = [{"type": "imports", "source": module, "target": t} for t in imports(source)]
    for s in symbols:
        name, is_class = s["symbol"], s["metadata"].get("kind") == "class"
        short = name.rsplit(".", 1)[-1]
        nodes.append({"type": "class" if is_class else "function", "name": name, "display": short})
        edges.append({"type": "defines", "source": module, "target": name})
        if is_class:
            edges += [{"type": "inherits", "source": name, "target": b} for b in bases(s["text"])]
        else:
            edges += [{"type": "calls", "source": name, "target": c} for c in calls(s["text"], short)]
    return nodes, edges
