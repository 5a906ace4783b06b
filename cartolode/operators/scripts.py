"""Facts of one JavaScript or TypeScript file by patterns: functions, methods, exports and calls. An approximation: strings,
comments and templates are blanked first, and braces say where a body ends."""

from __future__ import annotations

import re

NAME = r"[A-Za-z_$][\w$]*"
_BLANK = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_FUNCTION = re.compile(rf"\bfunction\b\s*\*?\s*({NAME})\s*(?:<[^<>()]*>)?\s*\(")
_ARROW = re.compile(rf"\b(?:const|let|var)\s+({NAME})\s*(?::[^=;\n]+)?=\s*(?:async\s*)?(?:function\b|(?:<[^<>()]*>)?\([^()]*\)\s*(?::[^=;\n]+)?=>|{NAME}\s*=>)")
_CLASS = re.compile(rf"\bclass\s+({NAME})[^{{;]*\{{")
_METHOD = re.compile(rf"(?:^|[\n;{{}}])\s*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?\s*(#?{NAME})\s*(?:<[^<>()]*>)?\([^;{{}}]*\)\s*(?::[^;{{}}]+)?\{{")
_CALL = re.compile(rf"(?<![\w$])({NAME})\s*(?:<[^<>()]*>)?\(")
_DECISION = re.compile(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.?:])")
_EXPORT = re.compile(rf"\bexport\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?|class|const|let|var|interface|type|enum)\s+({NAME})")
_EXPORT_LIST = re.compile(r"\bexport\s+(?:type\s+)?\{([^{}]*)\}")
_EXPORT_DEFAULT = re.compile(r"\bexport\s+default\b")
#: Words that a bracket may follow without a call.
KEYWORDS = frozenset("if for while switch catch function return typeof await new delete void in of do else case throw super import constructor".split())


def blanked(text: str) -> str:
    """text with the inside of comments, strings and templates as blanks; lines stay."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _closing(text: str) -> dict[int, int]:
    """For each opening brace the place after the one that closes it."""
    out, open_ = {}, []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.end()
    return out


def _calls(body: str) -> list[str]:
    return sorted({m[1] for m in _CALL.finditer(body)} - KEYWORDS)


def exports(code: str) -> list[str]:
    names = {m[1] for m in _EXPORT.finditer(code)}
    for m in _EXPORT_LIST.finditer(code):
        names |= {re.split(r"\s+as\s+", part.strip())[-1].removeprefix("type ").strip() for part in m[1].split(",") if part.strip()}
    return sorted(names | ({"default"} if _EXPORT_DEFAULT.search(code) else set()))


def script_facts(path: str, content: str) -> list[tuple]:
    """(path, kind, name, line, end_line, cc, callees, parse_ok): the file, its functions and methods, and its exports. A file
    whose braces do not match has parse_ok false and no functions."""
    code = blanked(content or "")
    line = lambda at: code.count("\n", 0, at) + 1
    closing = _closing(code)
    whole = code.count("{") == code.count("}") == len(closing)
    rows = [(path, "file", path, 1, code.count("\n") + 1, len(_DECISION.findall(code)) + 1, _calls(code), whole)]
    if not whole:
        return rows
    found: dict[int, tuple[str, int]] = {}
    for m in _FUNCTION.finditer(code):
        found[m.start()] = (m[1], m.end())
    for m in _ARROW.finditer(code):
        found[m.start()] = (m[1], m.end())
    for c in _CLASS.finditer(code):
        end = closing[c.end() - 1]
        for m in _METHOD.finditer(code, c.end() - 1, end):
            if m[1] == "constructor" or m[1] not in KEYWORDS:
                found[m.start(1)] = (f"{c[1]}.{m[1]}", m.end() - 1)
    for at, (name, after) in sorted(found.items()):
        stop = code.find("\n", after)
        stop = len(code) if stop < 0 else stop
        brace = code.find("{", after)
        # An arrow without braces ends with its line.
        arrow = code.startswith("=>", after - 2)
        end = closing[brace] if brace >= 0 and (not arrow or not code[after:brace].strip()) else stop
        body = code[after:end]
        rows.append((path, "function", name, line(at), line(end), len(_DECISION.findall(body)) + 1, _calls(body), True))
    return rows + [(path, "export", name, None, None, None, [], True) for name in exports(code)]
