"""Symbol spans of source files without grammars: each language is scanned by its brackets and headers.

Comments and literals are blanked first, so that only code counts.  What is left is read item by
item: an item ends at a semicolon or at the bracket that closes its body, and what stands before
the body (its header) says whether it is a function, a class, whose members follow, or a type,
which is taken whole.  Function bodies are never entered; other blocks are.  Script languages
are read by the places where a function or class begins, blocks that a word ends by that word.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache

import regex

Span = tuple[int, int, str, str]
Extent = tuple[int, int, str]

ANONYMOUS = "<anonymous>"

# ------------------------------------------------------------------ blanking

_STRING = r'"(?:\\.|[^"\\\n])*"'
_CHARS = r"'(?:\\.|[^'\\\n])*'"
_SLASHES = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_TICKED = r"`(?:\\.|[^`\\])*`"
_JS_REGEX = r"(?<=[(,=:\[!&|?{};\n]\s*)/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"

#: What counts as no code, by language.
LITERALS = {
    "javascript": f"{_SLASHES}|{_STRING}|{_CHARS}|{_TICKED}|{_JS_REGEX}",
    "go": f"{_SLASHES}|{_STRING}|`[^`]*`|{_CHARS}",
    "rust": rf'//[^\n]*|/\*.*?(?:\*/|\Z)|b?r(?P<h>#*)".*?"(?P=h)|"(?:\\.|[^"\\])*"|\'(?:\\[^\n]|[^\\\'\n])[^\'\n]{{0,8}}?\'(?!\w)',
    "java": rf'{_SLASHES}|""".*?"""|{_STRING}|{_CHARS}',
    "csharp": rf'{_SLASHES}|^[ \t]*\#[^\n]*|\$?@\$?"(?:""|[^"])*"|\$?{_STRING}|{_CHARS}',
    "c": rf'{_SLASHES}|^[ \t]*\#(?:\\\n|[^\n])*|R"(?P<d>[^(\s]*)\(.*?\)(?P=d)"|{_STRING}|{_CHARS}',
    "php": rf"//[^\n]*|\#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z)|<<<\s*['\"]?(?P<e>\w+)['\"]?\n.*?^\s*(?P=e)\b|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\?>.*?(?:<\?(?:php|=)|\Z)|\A.*?<\?(?:php|=)",
    "ruby": rf"\#[^\n]*|^=begin\b.*?^=end\b[^\n]*|<<[~-]?['\"]?(?P<e>[A-Z]\w*)['\"]?(?=[^\n]*\n).*?^\s*(?P=e)\b|{_STRING}|{_CHARS}|`[^`\n]*`|%[wiWI]\[[^\]]*\]|(?<=[(,=~!&|?{{;\n]\s*)/(?:\\.|[^/\\\n])+/[a-z]*",
}


@lru_cache(32)
def _pattern(text: str, flags: int = 0) -> regex.Pattern:
    return regex.compile(text, flags)


def blanked(text: str, literals: str) -> str:
    """The text with comments and literals as spaces; lines stay where they are."""
    return _pattern(LITERALS[literals], regex.S | regex.M).sub(lambda m: regex.sub(r"[^\n]", " ", m[0]), text)


class Source:
    """A file's code: matching brackets and rows of places."""

    def __init__(self, text: str, literals: str):
        self.code = blanked(text, literals)
        self.starts = [0, *(m.end() for m in regex.finditer("\n", text))]
        self.close: dict[int, int] = {}
        self.open: dict[int, int] = {}
        pairs, stack = {")": "(", "]": "[", "}": "{"}, []
        for m in regex.finditer(r"[(){}\[\]]", self.code):
            if m[0] in "([{":
                stack.append(m.start())
                continue
            while stack and self.code[stack[-1]] != pairs[m[0]]:  # a bracket that nothing closes
                if m[0] != "}":
                    break
                stack.pop()
            if stack and self.code[stack[-1]] == pairs[m[0]]:
                at = stack.pop()
                self.close[at], self.open[m.start()] = m.start(), at

    def row(self, place: int) -> int:
        return bisect_right(self.starts, place) - 1

    def end_of(self, bracket: int) -> int:
        """Where the bracket is closed, at the end of the file if nowhere."""
        return self.close.get(bracket, len(self.code) - 1)

    def flat(self, lo: int, hi: int) -> str:
        """Code from lo to hi with the contents of round and square brackets left out."""
        out, at = [], lo
        for m in regex.finditer(r"[(\[]", self.code, pos=lo, endpos=hi):
            if m.start() < at:
                continue
            end = min(self.end_of(m.start()), hi - 1)
            out += [self.code[at : m.start() + 1], self.code[end]]
            at = end + 1
        return "".join([*out, self.code[at:hi]])


class Found:
    """Spans and class extents, in the order in which they are found."""

    def __init__(self, source: Source):
        self.source, self.spans, self.extents = source, [], []

    def add(self, lo: int, hi: int, kind: str, name: str) -> None:
        self.spans.append((self.source.row(lo), self.source.row(hi), kind, name))

    def add_class(self, lo: int, hi: int, name: str, members: Callable[[], None]) -> None:
        """A class ends before its first member; the members are whatever ``members`` adds."""
        at = len(self.spans)
        members()
        first, last = self.source.row(lo), self.source.row(hi)
        head = min((s[0] for s in self.spans[at:]), default=last + 1) - 1
        self.spans.insert(at, (first, head, "class", name))
        self.extents.append((first, last, name))


# ------------------------------------------------------------------ languages of items

CONTROL = {"if", "for", "foreach", "while", "switch", "catch", "synchronized", "try", "else", "do", "return", "new", "throw", "using", "lock", "fixed", "when", "where", "sizeof", "await", "yield", "match", "elseif", "declare"}


def _java(flat: str, has_body: bool, inside: bool, code: str):
    if m := regex.search(r"(?:^|\s)(?:@interface|enum)\s+(\w+)", flat):
        return "type", m[1]
    if m := regex.search(r"(?:^|\s)(?:class|interface|record)\s+(\w+)", flat):
        return "class", m[1]
    m = regex.search(r"(\w+)\s*\(\)\s*(?:\[\]\s*)*(?:throws\b[^={}]*)?(?:default\b[^={}]*)?$", flat)
    if inside and m and m[1] not in CONTROL and "=" not in flat[: m.start()]:
        if has_body or regex.search(r"[\w>\]]\s+$", flat[: m.start()]):
            return "function", m[1]
    return None


def _csharp(flat: str, has_body: bool, inside: bool, code: str):
    if m := regex.search(r"(?:^|\s)enum\s+(\w+)", flat):
        return "type", m[1]
    if m := regex.search(r"(?:^|\s)delegate\s[^=]*?(\w+)\s*(?:<[^()]*>)?\s*\(\)", flat):
        return "type", m[1]
    if m := regex.search(r"(?:^|\s)(namespace|class|interface|struct|record(?:\s+(?:class|struct))?)\s+(?!where\b|new\b)([\w.]+)", flat):
        if m[1] != "namespace" or has_body:
            return "class", m[2]
        return None
    m = regex.search(r"(\w+)\s*(?:<[^()]*>)?\s*\(\)\s*(?:where\b.*?|:\s*(?:base|this)\s*\(\))?\s*(?:=>.*)?$", flat, regex.S)
    if inside and m and m[1] not in CONTROL and "=" not in flat[: m.start()]:
        if has_body and "=>" not in flat or regex.search(r"[\w>\]?]\s+(?:[\w.]+\.)?$", flat[: m.start()]):
            return "function", m[1]
    return None


def _go(flat: str, has_body: bool, inside: bool, code: str):
    if m := regex.match(r"func\s*(?:\(([^)]*)\)\s*)?(\w+)\s*[(\[]", code):
        receiver = regex.search(r"(\w+)\s*(?:\[[^\]]*\])?\s*$", (m[1] or "").strip())
        return "function", f"{receiver[1]}.{m[2]}" if receiver else m[2]
    if m := regex.match(r"type\s+(\w+)\s*(?:\[[^\]=]*\])?\s*(?!=)[^=\s]", code):
        return "type", m[1]
    if regex.match(r"type\s*\(", code) and (m := regex.search(r"[(;\n]\s*(\w+)[ \t]+(?!=)[^=\s]", code)):
        return "type", m[1]
    return None


_RUST_LEAD = r"(?:pub\s*(?:\(\))?\s+)?(?:(?:default|const|async|unsafe|auto|extern)\s+)*"


def _rust(flat: str, has_body: bool, inside: bool, code: str):
    if m := regex.match(_RUST_LEAD + r"fn\s+(\w+)", flat):
        return "function", m[1]
    if m := regex.match(_RUST_LEAD + r"(?:trait|mod)\s+(\w+)", flat):
        return "class", m[1]
    if m := regex.match(_RUST_LEAD + r"(?:struct|enum|union|type)\s+(\w+)", flat):
        return "type", m[1]
    if has_body and (m := regex.match(_RUST_LEAD + r"impl\b\s*", code)):
        rest = code[m.end() :]
        rest = regex.sub(r"^<(?:[^<>]|->|(?<n><(?:[^<>]|->|(?&n))*>))*>\s*", "", rest)
        rest = regex.split(r"\swhere\b", rest)[0]
        return "class", regex.split(r"\sfor\s+(?!<)", rest)[-1].strip() or ANONYMOUS
    return None


_C_NAME = r"(?:\w+(?:<[^()]*>)?::)*(?:~?\w+|operator\s*[^\s\w(]+|operator\s*\(\)(?=\s*\())"


def _c(flat: str, has_body: bool, inside: bool, code: str, plus: bool = False):
    flat = flat.strip()
    if m := regex.match(r"(?:template\s*<.*?>\s*)?typedef\b", flat, regex.S):
        name = regex.search(r"\(\s*\*\s*(\w+)\s*\)\s*\(", code) or regex.search(r"(\w+)\s*(?:\[\]\s*)*;?$", flat)
        return "typedef", name[1] if name else ANONYMOUS
    tail = r"\s*\(\)\s*(?:(?:const|volatile|noexcept|override|final|try|\w+\s*\(\)|&&?|->[^{}]*)\s*)*(?::(?!:)[^{}]*)?$" if plus else r"\s*\(\)\s*(?:\w+\s*(?:\(\))?\s*)*$"
    if has_body and (m := regex.search(f"({_C_NAME if plus else chr(92) + 'w+'}){tail}", flat, regex.S)) and m[1] not in CONTROL and "=" not in flat[: m.start()]:
        return "function", regex.sub(r"\s+", " ", m[1])
    lead = r"^(?:template\s*<.*?>\s*)?(?:[\w:]+\s+)*?" if plus else r"^(?:\w+\s+)*?"
    if has_body and (m := regex.search(lead + r"(?:struct|union|enum(?:\s+(?:class|struct))?)\b(?:\s*\[\[\]\])?(?:\s+(\w+(?:::\w+)*))?(?:\s+final)?\s*(?::[^:].*)?$", flat, regex.S)):
        return "type", m[1] or ANONYMOUS
    if plus and has_body and (m := regex.search(lead + r"class\b(?:\s+(\w+(?:::\w+)*))?(?:<.*>)?(?:\s+final)?\s*(?::[^:].*)?$", flat, regex.S)):
        return "class", m[1] or ANONYMOUS
    if plus and has_body and (m := regex.search(r"^(?:inline\s+)?namespace\b(?:\s+([\w:]+))?\s*$", flat)):
        return "class", m[1] or ANONYMOUS
    return None


def _cpp(flat: str, has_body: bool, inside: bool, code: str):
    return _c(flat, has_body, inside, code, plus=True)


def _php(flat: str, has_body: bool, inside: bool, code: str):
    if m := regex.search(r"(?:^|\s)enum\s+(\w+)", flat):
        return "type", m[1]
    if has_body and (m := regex.search(r"(?:^|\s)(?:class|trait|interface)\s+(\w+)", flat)) and not regex.search(r"[=(]", flat[: m.start()]):
        return "class", m[1]
    if (m := regex.search(r"(?:^|\s)function\s+&?\s*(\w+)\s*\(\)", flat)) and "=" not in flat[: m.start()]:
        return "function", m[1]
    return None


#: What an item may begin with that is none of it.
LEADS = {"rust": r"\#!?\[", "cpp": r"(?:public|private|protected)\s*:(?!:)|\[\[", "c": r"\[\["}


def _items(found: Found, language: str, judge: Callable, lo: int, hi: int, prefix: str, inside: bool) -> None:
    source, code = found.source, found.source.code
    start = at = lo
    stops = _pattern(r"[;{(\[]" + (r"|\n" if language == "go" else ""))
    lead = LEADS.get(language)

    def settle(begin: int, head: int, end: int, body: int | None) -> bool:
        """Adds the item if it is a symbol; says so."""
        got = judge(source.flat(begin, head).rstrip(), body is not None, inside, code[begin:head].rstrip())
        if got is None:
            return False
        kind, name = got[0], prefix + got[1]
        if kind == "class":
            members = (lambda: _items(found, language, judge, body + 1, end, name + ".", True)) if body is not None else (lambda: None)
            found.add_class(begin, end, name, members)
        else:
            found.add(begin, end, "type" if kind == "typedef" else kind, name)
        return True

    def uses(begin: int, end: int) -> None:
        """C names a structure by its keyword wherever it is used; in a declaration that is a symbol, too."""
        if language in ("c", "cpp"):
            kinds = "struct|union|enum" + ("|class" if language == "cpp" else "")
            for m in regex.finditer(rf"\b({kinds})\s+(\w+)", code, pos=begin, endpos=end):
                if m[1] == "class":
                    found.add_class(m.start(), m.end() - 1, prefix + m[2], lambda: None)
                else:
                    found.add(m.start(), m.end() - 1, "type", prefix + m[2])

    while at < hi:
        blank = _pattern(r"[\s;,}\])]*").match(code, at, hi)
        start = at = blank.end()
        if at >= hi:
            return
        if lead and (m := regex.match(lead, code[at : at + 80])):
            bracket = code.find("[", at, at + m.end()) if "[" in m[0] else -1
            at = source.end_of(bracket) + 1 if bracket >= 0 else at + m.end()
            continue
        while True:
            m = stops.search(code, at, hi)
            if m is None:
                if not settle(start, hi, hi - 1, None):
                    uses(start, hi)
                return
            place, what = m.start(), m[0]
            if what in "([":
                at = min(hi, source.end_of(place) + 1)
                continue
            if what == "\n" and code[start:place].rstrip()[-1:] in (",", "=", "+", "-", "*", "/", "&", "|", "<", ".", ":"):
                at = place + 1
                continue
            if what in ";\n":
                if not settle(start, place, place - 1 if what == "\n" else place, None):
                    uses(start, place)
                at = place + 1
                break
            end = min(hi, source.end_of(place))
            if regex.match(r"typedef\b", code[start : start + 8]) and language in ("c", "cpp"):
                at = end + 1
                continue
            if not settle(start, place, end, place):
                uses(start, place)
                if not (language == "rust" and regex.search(r"!\s*\w*\s*$", code[start:place])):
                    _items(found, language, judge, place + 1, end, prefix, False)
            at = end + 1
            break


# ------------------------------------------------------------------ scripts

_JS_BEGIN = (
    r"(?<![.\w$])(?:async\s+)?function\b\s*(?P<star>\*)?\s*(?P<fn>[\w$]+)?"
    r"|(?<![.\w$])(?:abstract\s+)?class\b(?:\s+(?P<cn>(?!(?:extends|implements)\b)[\w$]+))?(?=[^;=()]*\{)"
    r"|(?P<arrow>=>)"
    r"|(?<=[{};,\n]\s*)(?<mods>(?:(?:public|private|protected|static|async|get|set|override|readonly|accessor)\s+|\*\s*)*)(?P<mn>\#?[\w$]+|\[[^\]\n]*\])\s*(?:<[^()]*>)?\s*(?=\()"
)
_TS_TYPES = r"|(?<=(?:^|[;{}\n])[ \t]*(?:export\s+(?:default\s+)?)?(?:declare\s+)?)(?P<tkind>interface|(?:const\s+)?enum|type)\s+(?P<tn>[\w$]+)(?=[^;]*?[{=])"
_JS_WORDS = {"if", "for", "while", "switch", "catch", "function", "return", "with", "typeof", "await", "new", "super", "import", "do", "else", "void", "throw", "case", "yield", "delete"}
#: How far before an arrow its parameters' types may reach.
_JS_NEAR = 400
_JS_WRAP = r"(?:\bexport\s+(?:default\s+)?)?(?:\b(?:const|let|var)\s+(?P<v>[\w$]+)\s*(?::[^=;]+)?=\s*)?$"


def _js_expression_end(source: Source, at: int, hi: int) -> int:
    """The last place of an expression that begins at ``at``."""
    code = source.code
    while at < hi:
        m = _pattern(r"[(\[{)\]};,\n]").search(code, at, hi)
        if m is None:
            return hi - 1
        place, what = m.start(), m[0]
        if what in "([{":
            at = source.end_of(place) + 1
        elif what != "\n":
            return place if what == ";" else place - 1
        else:
            before, after = code[:place].rstrip()[-1:], code[place:hi].lstrip()[:1]
            if before and before not in "=+-*/&|?:,.<>(" and after not in list(".?:+-*/&|=)"):
                return place - 1
            at = place + 1
    return hi - 1


def _js(found: Found, typed: bool, lo: int, hi: int, prefix: str) -> None:
    source, code = found.source, found.source.code
    begin = _pattern(_JS_BEGIN + (_TS_TYPES if typed else ""), regex.M)

    def wrapped(place: int) -> tuple[int, str | None]:
        """Where the declaration around a definition starts, and the name that it gives."""
        edge = max(lo, *(code.rfind(c, lo, place) + 1 for c in ";{}(,"))
        m = regex.search(_JS_WRAP, code[edge:place])
        lead = m.start() + len(m[0]) - len(m[0].lstrip())
        return (edge + lead if m[0].strip() else place), m["v"]

    at = lo
    while (m := begin.search(code, at, hi)) is not None:
        at = m.end()
        if m["arrow"]:
            from_ = max(lo, m.start() - _JS_NEAR)
            before = code[from_ : m.start()].rstrip()
            close = regex.search(r"\)\s*(?::[^()=;]*)?$", before)
            if close:
                first = source.open.get(from_ + close.start(), from_ + close.start())
            elif name := regex.search(r"[\w$]+$", before):
                first = from_ + name.start()
            else:
                continue
            from_ = max(lo, first - _JS_NEAR)
            lead = regex.search(r"(?:\basync\s*)?(?:<[^()]*>)?\s*$", code[from_:first])
            if lead[0].strip():
                first = from_ + lead.start() + len(lead[0]) - len(lead[0].lstrip())
            start, name = wrapped(first)
            body = regex.match(r"\s*", code[at:hi]).end() + at
            end = source.end_of(body) if code[body : body + 1] == "{" else _js_expression_end(source, body, hi)
            if name and code[end + 1 : end + 2] == ";":
                end += 1
            found.add(start, end, "function", prefix + (name or ANONYMOUS))
        elif m.groupdict().get("tn"):
            start, _ = wrapped(m.start())
            brace = code.find("{", at, hi)
            end = _js_expression_end(source, at, hi) if m["tkind"] == "type" or brace < 0 else source.end_of(brace)
            found.add(start, end, "type", prefix + m["tn"])
        elif m["mn"]:
            opened = m.end()
            after = _pattern(r"\s*(?::\s*(?:\{[^{}]*\}|[^{};=])*)?\{").match(code, source.end_of(opened) + 1, hi)
            if m["mn"] in _JS_WORDS or after is None:
                at = opened + 1
                continue
            end = source.end_of(after.end() - 1)
            found.add(m.start() + len(m[0]) - len(m[0].lstrip()), end, "function", prefix + m["mn"])
        elif regex.match(r"(?:async\s+)?function\b", m[0]):
            opened = code.find("(", at, hi)
            if opened < 0 or code[at:opened].strip() and not regex.match(r"\s*<", code[at:opened]):
                continue
            after = _pattern(r"\s*(?::\s*(?:\{[^{}]*\}|[^{};=])*)?\{").match(code, source.end_of(opened) + 1, hi)
            if after is None:  # a signature only
                at = opened + 1
                continue
            start, name = wrapped(m.start())
            end = source.end_of(after.end() - 1)
            found.add(start, end, "function", prefix + (m["fn"] or name or ANONYMOUS))
        else:
            start, name = wrapped(m.start())
            brace = code.find("{", at, hi)
            end = source.end_of(brace)
            full = prefix + (m["cn"] or name or ANONYMOUS)
            found.add_class(start, end, full, lambda b=brace, e=end, f=full: _js(found, typed, b, e, f + "."))
        at = end + 1


_RUBY_OPEN = r"^\s*(?:(?:private|public|protected|module_function|private_class_method)\s+)?(?P<word>class|module|def|if|unless|while|until|case|for|begin)\b|=\s*(?P<value>if|unless|case|begin|while)\b|\bdo\b\s*(?:\|[^|\n]*\|)?\s*$"


def _ruby(found: Found) -> None:
    source = found.source
    stack: list[tuple[str, str, int, list[Span]]] = []
    rows = source.code.split("\n")
    out: list[Span] = []

    def owner() -> list[Span]:
        return next((s[3] for s in reversed(stack) if s[0] == "class"), out)

    def closed(row: int) -> None:
        kind, name, first, members = stack.pop()
        if any(s[0] == "def" for s in stack):
            return
        if kind == "def":
            owner().append((first, row, "function", name))
        elif kind == "class":
            head = min((s[0] for s in members), default=row + 1) - 1
            owner().extend([(first, head, "class", name), *members])
            found.extents.append((first, row, name))

    for row, text in enumerate(rows):
        for part in regex.split(r";", text):
            prefix = next((s[1] + "." for s in reversed(stack) if s[0] == "class"), "")
            m = regex.search(_RUBY_OPEN, part)
            word = m and (m["word"] or m["value"] or "do")
            if word in ("class", "module") and not m["value"]:
                name = regex.match(r"\s*([\w:]+)", part[m.end() :])
                stack.append(("class", prefix + (name[1] if name else ANONYMOUS), row, []))
            elif word == "def":
                name = regex.match(r"\s*(?:[\w:]+\.)?([\w]+[?!=]?(?!\w)|[^\s\w(]+)\s*(\([^)]*\))?\s*(=(?!=))?", part[m.end() :])
                if name and name[3] and name[2] is not None:
                    if not any(s[0] == "def" for s in stack):
                        owner().append((row, row, "function", prefix + name[1]))
                else:
                    stack.append(("def", prefix + (name[1] if name else ANONYMOUS), row, []))
            elif word:
                stack.append(("block", "", row, []))
            for _ in regex.finditer(r"(?<![.\w:@$])end\b(?!\s*[:=](?!=)|\?)", part):
                if stack:
                    closed(row)
    while stack:
        closed(len(rows) - 1)
    found.spans = out


# ------------------------------------------------------------------ all

#: Language: how its literals are written, and what reads it.
JUDGES = {"Java": ("java", _java), "C#": ("csharp", _csharp), "Go": ("go", _go), "Rust": ("rust", _rust), "C": ("c", _c), "C++": ("c", _cpp), "PHP": ("php", _php)}
SCRIPTS = {"JavaScript": False, "TypeScript": True, "TSX": True}
RULES = {"Java": "java", "C#": "csharp", "Go": "go", "Rust": "rust", "C": "c", "C++": "cpp", "PHP": "php"}


class UnknownLanguageError(LookupError):
    """Nothing here reads the language."""


def spans_of(text: str, language: str) -> tuple[list[Span], list[Extent]]:
    """(symbol spans, class extents) of a file: rows from 0, kind, qualified name."""
    if language in JUDGES:
        literals, judge = JUDGES[language]
        found = Found(Source(text, literals))
        _items(found, RULES[language], judge, 0, len(found.source.code), "", False)
    elif language in SCRIPTS:
        found = Found(Source(text, "javascript"))
        _js(found, SCRIPTS[language], 0, len(found.source.code), "")
    elif language == "Ruby":
        found = Found(Source(text, "ruby"))
        _ruby(found)
    else:
        raise UnknownLanguageError(language)
    return found.spans, found.extents
