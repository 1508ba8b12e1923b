"""Ignore files in the manner of git: the rules of .gitignore and .ignore."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

IGNORE_FILES = (".gitignore", ".ignore")


def _expression(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out += "/.*"
            i += 3
        elif c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out += "[^/]*"
            i += 1
        elif c == "?":
            out += "[^/]"
            i += 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end + 1
        elif c == "\\" and i + 1 < len(glob):
            out += re.escape(glob[i + 1])
            i += 2
        else:
            out += re.escape(c)
            i += 1
    return out


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    keep: bool
    dirs_only: bool


def rules(text: str) -> list[Rule]:
    """The rules of an ignore file, in order."""
    out = []
    for line in text.splitlines():
        line = line.rstrip("\r\n")
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line
        dirs_only = line.endswith("/")
        line = line.rstrip("/") if dirs_only else line
        anchored = "/" in line
        line = line.lstrip("/")
        if line:
            out.append(Rule(re.compile(("" if anchored else "(?:.*/)?") + _expression(line) + r"\Z"), keep, dirs_only))
    return out


class Ignored:
    """Decides about the entries of a tree; directories are asked before what is in them."""

    def __init__(self, root: str):
        self.root = root
        self.by_dir: dict[str, list[Rule]] = {}

    def enter(self, directory: str) -> None:
        found: list[Rule] = []
        for name in IGNORE_FILES:
            path = os.path.join(directory, name)
            if os.path.isfile(path):
                with open(path, encoding="utf-8", errors="replace") as f:
                    found += rules(f.read())
        self.by_dir[directory] = found

    def drops(self, path: str, is_dir: bool) -> bool:
        """The last matching rule of the nearest directory that has one decides."""
        directory = os.path.dirname(path)
        while True:
            rel = os.path.relpath(path, directory)
            for rule in reversed(self.by_dir.get(directory, [])):
                if (is_dir or not rule.dirs_only) and rule.pattern.match(rel):
                    return not rule.keep
            if directory == self.root or len(directory) <= len(self.root):
                return False
            directory = os.path.dirname(directory)
