"""Ignore rules of version control: patterns of a tree's ignore files, applied to paths."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache


@dataclass(frozen=True)
class Rule:
    """One pattern: the folder whose file holds it, its expression, whether it re-includes, whether it is for folders only."""

    folder: str
    expression: str
    keep: bool
    folders_only: bool


def _translated(pattern: str) -> str:
    """A pattern as a regular expression over a path below the rule's folder."""
    anchored = "/" in pattern.rstrip("/")[:-1] or pattern.startswith("/")
    body, out, i = pattern.strip("/"), [], 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if body.startswith("/**", i) and i + 3 == len(body):
            out.append("/.+")
            i += 3
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := body.find("]", i + 2)) > 0:
            inside = body[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inside[1:] if inside[:1] in "!^" else inside) + "]")
            i = end
        elif c == "\\" and i + 1 < len(body):
            i += 1
            out.append(re.escape(body[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return ("" if anchored else "(?:.*/)?") + "".join(out)


def parse_rules(folder: str, text: str) -> list[Rule]:
    """The rules of one ignore file that lies in ``folder`` (empty for the root)."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        pattern = line[1:] if keep else line.removeprefix("\\") if line[:2] in ("\\#", "\\!") else line
        if pattern.strip("/"):
            rules.append(Rule(folder.strip("/"), _translated(pattern), keep, pattern.endswith("/")))
    return rules


@lru_cache(100_000)
def _compiled(expression: str) -> re.Pattern | None:
    try:
        return re.compile(expression + r"\Z")
    except re.error:  # a range that is none: such a pattern matches nothing
        return None


class IgnoreRules:
    """All rules of a tree; the deeper file, and in a file the later rule, decides."""

    def __init__(self, files: Iterable[tuple[str, str]]):
        by_depth = sorted(files, key=lambda f: (f[0].strip("/").count("/") + bool(f[0].strip("/")), f[0]))
        self.rules = [r for folder, text in by_depth for r in parse_rules(folder, text)]
        self.folders: dict[str, bool] = {}

    def _decided(self, path: str, is_folder: bool) -> bool:
        verdict = False
        for rule in self.rules:
            if rule.folders_only and not is_folder or rule.folder and not path.startswith(rule.folder + "/"):
                continue
            expression = _compiled(rule.expression)
            if expression is not None and expression.match(path[len(rule.folder) + 1 if rule.folder else 0 :]):
                verdict = not rule.keep
        return verdict

    def folder_ignored(self, path: str) -> bool:
        """Nothing below an ignored folder can be included again."""
        if not path:
            return False
        if path not in self.folders:
            parent = path.rpartition("/")[0]
            self.folders[path] = self.folder_ignored(parent) or self._decided(path, True)
        return self.folders[path]

    def ignored(self, path: str) -> bool:
        return self.folder_ignored(path.rpartition("/")[0]) or self._decided(path, False)
