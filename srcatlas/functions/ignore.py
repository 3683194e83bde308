"""Compile gitignore-style patterns to regular expressions over repo-relative paths."""

from __future__ import annotations

import re

#: Fixed default exclusions; a tool that keeps state inside repositories adds its own folder as an extra.
DEFAULT_EXCLUDES = (
    ".git", ".git/", ".hg/", ".svn/", ".venv/", "venv/", "node_modules/", "__pycache__/",
    ".mypy_cache/", ".ruff_cache/", ".pytest_cache/", ".tox/", "dist/", "build/", "target/", ".next/", ".nuxt/",
    "*.pyc", "*.pyo", "*.so", "*.dll", "*.dylib", "*.class", "*.o", "*.a", "*.lock", "*.lockb", "*.min.js", "*.min.css",
)


def _glob(text: str) -> str:
    out, k = [], 0
    while k < len(text):
        c = text[k]
        if text.startswith("**/", k) and (k == 0 or text[k - 1] == "/"):
            out.append("(?:[^/]+/)*")
            k += 3
        elif text[k:] == "**" and (k == 0 or text[k - 1] == "/"):
            out.append(".+")
            k += 2
        elif c == "*":
            out.append("[^/]*")
            k += 1
        elif c == "?":
            out.append("[^/]")
            k += 1
        elif c == "[" and "]" in text[k + 2 :]:
            end = text.index("]", k + 2)
            inner = text[k + 1 : end]
            inner = ("^" + inner[1:]) if inner[0] in "!^" else inner
            out.append("[" + inner.replace("\\", "\\\\") + "]")
            k = end + 1
        elif c == "\\" and k + 1 < len(text):
            out.append(re.escape(text[k + 1]))
            k += 2
        else:
            out.append(re.escape(c))
            k += 1
    return "".join(out)


def compile_rule(line: str) -> tuple[str, bool, bool] | None:
    """(regex over a path without trailing slash, negate, directories only), or None for no rule."""
    text = line.rstrip("\n\r")
    text = re.sub(r"(?<!\\)\s+$", "", text)
    if not text or text.startswith("#"):
        return None
    negate = text.startswith("!")
    if negate:
        text = text[1:]
    dir_only = text.endswith("/")
    text = text.rstrip("/") if dir_only else text
    if not text:
        return None
    anchored = "/" in text
    body = _glob(text.lstrip("/"))
    return ("^" if anchored else "^(?:.*/)?") + body + "$", negate, dir_only


def rule_key(line: str) -> tuple[str, str]:
    """How paths meet a rule: by their `name`, whole `path` or the `suffix` of their name equal to a key, or by a `pattern`."""
    text = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n\r"))
    text = text[1:] if text.startswith("!") else text
    text = text.rstrip("/")
    if not re.search(r"[*?\[\\]", text):
        return ("path", text.lstrip("/")) if "/" in text else ("name", text)
    if re.fullmatch(r"\*\.[^*?\[\\/.]+", text):
        return "suffix", text[1:]
    return "pattern", ""


def keyed_rules(lines) -> list[tuple[int, str, str, str, bool, bool]]:
    """(seq, meets, key, regex, negate, directories only) of each rule, in order."""
    rules = [(line, compile_rule(line)) for line in lines]
    return [(k, *rule_key(line), *rule) for k, (line, rule) in enumerate((x for x in rules if x[1]))]


def compile_rules(lines) -> list[tuple[int, str, bool, bool]]:
    rules = (compile_rule(x) for x in lines)
    return [(k, *r) for k, r in enumerate(x for x in rules if x)]
