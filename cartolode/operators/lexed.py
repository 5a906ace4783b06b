"""Facts of files in nine languages from one lexer and a table of what the languages write differently.

A text becomes a tree: tokens, and groups of them between brackets, or between a word and `end`. Functions, types, exports,
calls and decisions are read from the statements of that tree. It is an approximation: what needs types, macros or overload
resolution is not seen.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

SLASHES = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/"
QUOTES = r'"(?:\\.|[^"\\\n])*"' + r"|'(?:\\.|[^'\\\n])*'"


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Words that a bracket may follow without a call, in some language.
NO_CALL = _words(
    "if elsif elseif else for foreach while until switch select case when match catch rescue return throw yield new delete sizeof typeof "
    "func fun fn function def class struct interface enum and or not in is as guard repeat do try defer using lock fixed super "
    "default where unless await async let var val const mut move loop use namespace import package pub then"
)


@dataclass(frozen=True)
class Grammar:
    """What one language writes differently; words are those that begin or mark a thing."""

    extensions: tuple[str, ...]
    decisions: frozenset[str]
    types: frozenset[str]
    function: frozenset[str] = frozenset()  # none: a function is a name with parameters and a body
    operators: frozenset[str] = _words("&& ||")
    comments: str = SLASHES
    strings: str = QUOTES
    name: str = r"[A-Za-z_]\w*"
    lines: bool = False  # a line end may close a statement
    ends: bool = False  # blocks are closed by `end`
    ternary: bool = False
    cases: frozenset[str] = frozenset()  # each `case` below these counts
    sections: bool = False  # cases that follow each other at once count as one
    arms: tuple[str, str, str] = ("", "", "")  # the word above arms, what ends a pattern, the pattern that counts nothing
    bare: bool = False  # a function may lack a body
    spaces: frozenset[str] = _words("namespace")
    no_call: frozenset[str] = frozenset()  # besides NO_CALL
    values: frozenset[str] = frozenset()  # words that begin exported variables and types
    trailing: bool = False  # a block after a name is a call with a lambda
    exported: Callable[[str, frozenset[str], bool], bool] = field(default=lambda name, marks, top: top)  # name, words before it, at the top


TYPES = "class struct interface enum record"
GRAMMARS: dict[str, Grammar] = {
    "go": Grammar(
        (".go",), _words("if for"), _words(""), _words("func"), strings=QUOTES + r"|`[^`]*`", lines=True, cases=_words("switch select"), no_call=_words("go range"),
        spaces=frozenset(), values=_words("type var const"), exported=lambda name, marks, top: top and name[:1].isupper(),
    ),
    "java": Grammar(
        (".java",), _words("if for while catch"), _words(TYPES), strings=r'"""(?:\\.|[^\\])*?"""|' + QUOTES, ternary=True, cases=_words("switch"), bare=True,
        spaces=frozenset(), exported=lambda name, marks, top: top and "public" in marks and "class" not in marks - _words(TYPES),
    ),
    "kotlin": Grammar(
        (".kt", ".kts"), _words("if for while try catch"), _words("class interface object"), _words("fun"), strings=r'"""(?:[^"]|"(?!""))*"""|' + QUOTES, lines=True,
        arms=("when", "->", "else"), bare=True, spaces=frozenset(), values=_words("val var typealias"), trailing=True,
        exported=lambda name, marks, top: top and not marks & _words("private internal"),
    ),
    "rust": Grammar(
        (".rs",), _words("if for while loop"), _words("impl trait"), _words("fn"), strings=r'r(?P<hash>#*)".*?"(?P=hash)|"(?:\\.|[^"\\])*"' + r"|'(?:\\.[^']*|[^'\\\n])'|'[a-z_]\w*\b(?!')",
        arms=("match", "=>", "_"), bare=True, spaces=_words("mod"), values=_words("struct union enum type const static mod trait"),
        exported=lambda name, marks, top: "pub" in marks,
    ),
    "ruby": Grammar(
        (".rb", ".rake"), _words("elsif when rescue"), _words("class module"), _words("def"), operators=_words("&& || and or"), comments=r"#[^\n]*|(?m:^=begin)[\s\S]*?(?m:^=end)",
        name=r"[@$]{0,2}[A-Za-z_]\w*[?!]?", lines=True, ends=True, ternary=True, spaces=frozenset(),
    ),
    "php": Grammar(
        (".php",), _words("if elseif for foreach while catch"), _words("class interface trait enum"), _words("function"), operators=_words("&& || ?? and or"),
        comments=SLASHES + r"|#(?!\[)[^\n]*|\?>[\s\S]*?(?:<\?php|<\?=|\Z)|\A[\s\S]*?<\?(?:php\b|=)", strings=r'"(?:\\.|[^"\\])*"' + r"|'(?:\\.|[^'\\])*'", name=r"\$?[A-Za-z_\x80-￿][\w\x80-￿]*",
        ternary=True, cases=_words("switch"), arms=("match", "=>", "default"), bare=True, no_call=_words("echo print array list isset unset empty exit die include require"),
    ),
    "csharp": Grammar(
        (".cs",), _words("if for foreach while catch"), _words(TYPES), operators=_words("&& || ??"), comments=SLASHES + r"|(?m:^[ \t]*\#[^\n]*)", strings=r'@\$?"(?:""|[^"])*"|\$?' + QUOTES,
        ternary=True, cases=_words("switch"), sections=True, arms=("switch", "=>", "_"), bare=True, exported=lambda name, marks, top: top and "public" in marks,
    ),
    "swift": Grammar(
        (".swift",), _words("if guard for while do catch"), _words("class struct enum actor protocol extension"), _words("func init deinit subscript"),
        strings=r'"""(?:[^"]|"(?!""))*"""|' + QUOTES, lines=True, cases=_words("switch"), spaces=frozenset(), values=_words("let var typealias"), trailing=True,
        exported=lambda name, marks, top: top and not marks & _words("private fileprivate"),
    ),
    "cpp": Grammar(
        (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".h"), _words("if for while try catch"), _words("class struct union enum"), comments=SLASHES + r"|(?m:^[ \t]*\#(?:[^\n\\]|\\[\s\S])*)",
        strings=r'R"\(.*?\)"|' + QUOTES, name=r"~?[A-Za-z_]\w*", ternary=True, cases=_words("switch"), spaces=_words("namespace extern"), values=_words("using typedef"),
    ),
}
CLOSE = {"(": ")", "[": "]", "{": "}"}
#: Words of Ruby that open a block wherever they stand, and those that do so only at the start of a statement.
OPENS, OPENS_FIRST = _words("def class module begin case do"), _words("if unless while until for")


class Item:
    """A token, or a group with its items; kind is name, text, op, line, or the word or bracket that opens a group."""

    __slots__ = ("kind", "text", "line", "last", "items")

    def __init__(self, kind: str, text: str, line: int, items: list[Item] | None = None):
        self.kind, self.text, self.line, self.last, self.items = kind, text, line, line, items

    def is_op(self, *texts: str) -> bool:
        return self.kind == "op" and self.text in texts


class Unbalanced(ValueError):
    pass


@lru_cache
def _lexer(language: str) -> re.Pattern:
    g = GRAMMARS[language]
    ops = r"&&|\|\||\?\?|\?->|\?\.|::|->|=>|==|!=|<=|>=|\.\.\.?|[^\s\w]"
    return re.compile(f"(?P<skip>{g.comments})|(?P<text>{g.strings})|(?P<name>{g.name})|(?P<number>\\d[\\w.]*)|(?P<op>{ops})|(?P<line>\\n)", re.S)


def _first(before: Item | None) -> bool:
    """Whether a statement of Ruby begins after this token."""
    return before is None or before.kind == "line" or before.kind == "op" and before.text in "=([{,;|&&||!" or before.kind == "name" and before.text in NO_CALL | _words("then begin")


def _endless(header: list[Item]) -> bool:
    """Whether a definition of Ruby is one of the form `def name(...) = value`; `def name=(value)` is not."""
    at = next((k for k, i in enumerate(header) if i.is_op("=")), None)
    return at is not None and all(i.kind in ("name", "(") or i.is_op(".") for i in header[:at]) and not (at + 2 == len(header) and header[-1].kind == "(")


def parsed(language: str, text: str) -> Item:
    """The tree of a text; raises Unbalanced where brackets or blocks do not match."""
    g, line = GRAMMARS[language], 1
    root = Item("file", "", 1, [])
    open_, last = [root], None
    for m in _lexer(language).finditer(text):
        kind, word = m.lastgroup if m.lastgroup != "hash" else "text", m[0]
        if kind == "skip":
            line += word.count("\n")
            continue
        item, top = Item("text" if kind == "number" else kind, word, line), open_[-1]
        line += word.count("\n")
        opens = kind == "op" and word in "([{"
        if g.ends and kind == "name" and not (last is not None and last.is_op(".", "::", "?.")):
            waits = top.kind in ("while", "until", "for") and not any(i.kind == "line" for i in top.items)
            opens = word in OPENS and not (word == "do" and waits) or word in OPENS_FIRST and _first(last)
            opens &= not (last is not None and last.is_op(":") and word != "do")
            if word == "end":
                if top.kind in CLOSE or len(open_) == 1:
                    raise Unbalanced(f"line {line}")
                top.last, last = line, item
                open_.pop()
                continue
        if opens:
            group = Item(word, word, line, [])
            top.items.append(group)
            open_.append(group)
        elif kind == "op" and word in ")]}":
            if CLOSE.get(top.kind) != word:
                raise Unbalanced(f"line {line}")
            top.last = line
            open_.pop()
        else:
            top.items.append(item)
            if kind == "line" and top.kind == "def" and _endless(top.items[:-1]):
                top.last = item.line
                open_.pop()
        last = item
    if len(open_) > 1:
        raise Unbalanced(f"line {line}")
    root.last = line
    return root


def _ends(g: Grammar, items: list[Item], k: int) -> bool:
    """Whether a statement ends with the item at k."""
    i = items[k]
    if i.is_op(";"):
        return True
    if i.kind != "line" or not g.lines:
        return False
    back = next((x for x in items[:k][::-1] if x.kind != "line"), None)
    ahead = next((x for x in items[k + 1 :] if x.kind != "line"), None)
    goes_on = back is not None and back.kind == "op" and back.text not in (")", "]", "}", "?", "!", ">")
    return not goes_on and not (ahead is not None and (ahead.is_op(".", "?.", "&&", "||", "?", ":", "->") or ahead.kind == "{" and not g.ends))


def statements(g: Grammar, items: list[Item]) -> Iterator[list[Item]]:
    """The statements of a group; a block in braces ends one unless what follows belongs to it."""
    head: list[Item] = []
    for k, i in enumerate(items):
        if _ends(g, items, k):
            if head:
                yield head
            head = []
            continue
        if i.kind != "line":
            head.append(i)
        ahead = next((x for x in items[k + 1 :] if x.kind != "line"), None)
        if i.kind == "{" and not (ahead is not None and (ahead.kind == "op" and ahead.text in ".,?.=>;" or ahead.kind in "([" or ahead.kind == "name" and ahead.text in ("else", "catch", "finally", "while"))):
            yield head
            head = []
    if head:
        yield head


def _names(head: list[Item]) -> list[str]:
    return [i.text for i in head if i.kind == "name"]


def _before_body(head: list[Item]) -> list[Item]:
    return head[: next((k for k, i in enumerate(head) if i.kind == "{" or i.is_op("=", "=>")), len(head))]


def _type(g: Grammar, head: list[Item]) -> str | None:
    """The name of the type that a statement declares."""
    early = _before_body(head)
    at = next((k for k, i in enumerate(early) if i.kind == "name" and i.text in g.types), None)
    if at is None or any(i.kind == "(" for i in early[:at] if not early[0].is_op("@")) or any(i.text in g.function for i in early[:at] if i.kind == "name" and i.text != "fun"):
        return None
    rest = early[at + 1 :]
    if early[at].text == "impl":
        by = max((k for k, i in enumerate(rest) if i.kind == "name" and i.text == "for"), default=-1)
        depth, start = 0, by + 1
        if by < 0 and rest and rest[0].is_op("<"):
            for k, i in enumerate(rest):
                depth += i.is_op("<") - i.is_op(">")
                if not depth:
                    start = k + 1
                    break
        stop = next((k for k, i in enumerate(rest) if i.kind == "name" and i.text == "where"), len(rest))
        return "".join(i.text for i in rest[start:stop] if not i.items) or None
    return next((i.text for i in rest if i.kind == "name" and i.text not in g.types), "" if early[at].text == "object" else None)


def _function(g: Grammar, language: str, head: list[Item], owner: str | None, member: bool) -> tuple[str, list[Item]] | None:
    """The name and the body of the function that a statement declares; no body is empty."""
    body = [i for i in head if i.kind == "{"][-1:]
    if g.function:
        at = next((k for k, i in enumerate(head) if i.kind == "name" and i.text in g.function), None)
        if at is None or any(i.is_op("=") or i.kind == "{" for i in head[:at]) or any(i.kind == "(" and not head[0].is_op("@", "#") and not (k and head[k - 1].text in ("pub", "public", "internal", "private")) for k, i in enumerate(head[:at])):
            return None
        rest, word = head[at + 1 :], head[at].text
        until = next((k for k, i in enumerate(rest) if i.kind == "{" or i.is_op("=", "->")), len(rest))
        name = word if word in ("init", "deinit", "subscript") else None
        if name and (at and head[at - 1].is_op(".") or not body):
            return None
        if language == "go" and rest and rest[0].kind == "(":
            inner = [i.text for i in rest[0].items if i.kind == "name"]
            owner = inner[-1] if inner else None
            rest, until = rest[1:], until - 1
        if name is None:
            stop = next((k for k, i in enumerate(rest[:until]) if i.kind == "("), None)
            if stop is None:
                return None
            known = [i.text for i in rest[:stop] if i.kind == "name"]
            if not known:
                return None
            name = known[0] if language in ("go", "rust", "php", "swift") else known[-1]
        after = next((k for k, i in enumerate(head) if i.is_op("=") and k > at and any(x.kind == "(" for x in head[at:k])), None)
        if language == "kotlin" and after is not None:
            body = head[after + 1 :]
        if not body and not g.bare:
            return None
        return (f"{owner}.{name}" if owner and (language != "php" or member) else name), body
    for k, i in enumerate(head):
        if i.is_op("=") and not (language == "cpp" and k and head[k - 1].text == "operator"):
            return None
        if i.kind == "(" and k and not (k > 1 and head[k - 2].is_op("@")):
            name = head[k - 1]
            if language == "cpp" and name.kind == "op" and (at := max((j for j in range(k) if head[j].text == "operator"), default=-1)) >= 0:
                label, first = "operator" + "".join(x.text for x in head[at + 1 : k]), at
            elif name.kind == "name" and name.text not in NO_CALL:
                label, first = name.text, k - 1
            else:
                return None
            if first and head[first - 1].is_op(".", "->", "?."):
                return None
            while language == "cpp" and first > 1 and head[first - 1].is_op("::"):
                label, first = f"{head[first - 2].text}.{label}", first - 2
            arrow = next((j for j in range(k, len(head)) if head[j].is_op("=>")), None)
            body = head[arrow + 1 :] if arrow is not None and language == "csharp" else body
            typed = any(x.kind == "name" and x.text not in ("public", "private", "protected", "internal", "static", "return", "throw", "new", "await", "yield") for x in head[:first])
            own = label.removeprefix("~") == owner
            if not body and not (g.bare and member and typed) or not (typed or own or "." in label or language == "cpp") or any(x.text in NO_CALL - _words("async default delete") for x in head[:first] if x.kind == "name"):
                return None
            label = "<init>" if language == "java" and own else label
            return (f"{owner}.{label}" if owner and "." not in label else label), body
    return None


def _lambda(g: Grammar, language: str, head: list[Item], k: int) -> bool:
    """Whether the group at k is the body of a function without a name."""
    before = head[k - 1] if k else None
    words = [i.text for i in head[:k] if i.kind == "name"]
    if language == "go":
        at = max((j for j, i in enumerate(head[:k]) if i.kind == "name" and i.text == "func"), default=-1)
        return at >= 0 and at + 1 < k and head[at + 1].kind == "("
    if language == "php":
        return any(w in ("function", "fn") for w in words)
    if language == "cpp":
        at = max((j for j, i in enumerate(head[:k]) if i.kind == "["), default=-1)
        return at >= 0 and (at + 1 == k or head[at + 1].kind == "(") and not (at and (head[at - 1].kind in ("name", "(", "[")))
    if language == "rust":
        return before is not None and before.is_op("|", "||")
    if language in ("java", "csharp"):
        return before is not None and before.is_op("->" if language == "java" else "=>") and not (words and words[0] in ("case", "default"))
    control = g.decisions | _words("else try do finally when switch repeat defer object init get set willSet didSet")
    return before is not None and not before.is_op("->") and not any(w in control for w in words)


def count(g: Grammar, language: str, items: list[Item], skip: bool, above: str = "") -> int:
    """Decisions in the items; with skip, without those of functions inside. above is the word that the group belongs to."""
    n, arms = 0, above == g.arms[0] and g.arms[1]
    if arms:
        pattern: list[Item] = []
        for i in items:
            if i.is_op(arms):
                n += "".join(x.text for x in pattern) != g.arms[2]
                pattern = []
            elif i.is_op(",") and arms == "=>" or i.kind == "{" or i.kind == "line" and arms == "->":
                pattern = []
            elif i.kind != "line":
                pattern.append(i)
    labels = False
    for head in statements(g, items):
        first, asks, colons = head[0], 0, 0
        if first.kind == "name" and first.text == "case" and above in g.cases and g.cases:
            n += not (labels and g.sections)
        labels = g.sections and len(head) > 1 and head[-1].is_op(":") and first.text in ("case", "default")
        outer = "impl" in _names(head)
        for k, i in enumerate(head):
            if g.sections and k and i.kind == "name" and i.text == "case" and above in g.cases and not head[k - 1].is_op(":"):
                n += 1
            elif k and not g.sections and i.kind == "name" and i.text == "case" and head[k - 1].is_op(":") and above in g.cases:
                n += 1
            elif i.kind == "name" and i.text in g.decisions and not (k and head[k - 1].is_op(".", "::", "->", "?.")) and not (outer and i.text == "for"):
                n += not (g.ends and i.text == "rescue" and k)
            elif i.text in g.operators and not i.items and i.kind in ("op", "name"):
                n += 1
            elif language == "rust" and i.is_op("?", "?."):
                n += 1
            asks, colons = asks + i.is_op("?"), colons + i.is_op(":")
            if i.items is not None:
                n += g.ends and i.kind in OPENS_FIRST
                words = [x.text for x in head[:k] if x.kind == "name"]
                word = next((w for w in words[::-1] if w in g.cases or w == g.arms[0]), "") if i.kind == "{" else ""
                hidden = i.kind == "{" and (_lambda(g, language, head, k) or _function(g, language, head[: k + 1], None, False) is not None)
                hidden |= g.ends and i.kind in ("do", "def", "class", "module", "{")
                if not (skip and hidden):
                    n += count(g, language, i.items, skip, word)
        if g.ternary:
            n += min(asks, colons)
    return n


def calls(g: Grammar, language: str, items: list[Item], skip: bool) -> set[str]:
    """Bare names of what the items call; with skip, without what functions inside call."""
    found: set[str] = set()
    for head in statements(g, items):
        made = None if g.ends else _function(g, language, head, None, not skip)
        own = made[0].rpartition(".")[2] if made else None  # its first mention is no call
        for k, i in enumerate(head):
            before, follows = head[k - 1] if k else None, head[k + 1] if k + 1 < len(head) else None
            new = before is not None and before.kind == "name" and before.text == "new"
            if follows is not None and follows.is_op("<"):  # type arguments
                depth = 0
                for x in head[k + 1 :]:
                    depth += x.is_op("<") - x.is_op(">")
                    if depth == 0 and not x.is_op(">"):
                        follows = x
                        break
                    if x.kind not in ("name", "op", "["):
                        break
            named = i.kind == "name" and i.text not in NO_CALL | g.no_call | g.decisions and not (new and skip)
            declared = i.text == own
            own = None if declared else own
            if named and not declared and follows is not None and (follows.kind == "(" and follows.line == i.line or g.trailing and follows.kind == "{" and not _control(g, head[:k])):
                found.add(i.text.lstrip("$"))
            elif named and g.ends and not declared:
                dotted = before is not None and before.is_op(".", "?.", "::")
                command = before is None and follows is not None and follows.line == i.line and follows.kind in ("text", "name", "[") and follows.text not in g.operators | OPENS_FIRST | NO_CALL
                if dotted and not (follows is not None and follows.is_op("=")) or command:
                    found.add(i.text)
            if i.items is not None:
                hidden = i.kind == "{" and (_lambda(g, language, head, k) or _function(g, language, head[: k + 1], None, False) is not None)
                hidden |= g.ends and i.kind in ("do", "def", "class", "module", "{")
                if not (skip and hidden):
                    found |= calls(g, language, _definition(i)[2] if i.kind == "def" else i.items, skip)
    return found


def _definition(group: Item) -> tuple[str, bool, list[Item]]:
    """Of a definition of Ruby: its name, whether it stands on an object, and what follows its first line or its parameters."""
    line_end = next((k for k, x in enumerate(group.items) if x.kind == "line" or x.is_op(";")), len(group.items))
    names = _names(group.items[:line_end]) or [""]
    dotted = len(group.items) > 1 and group.items[1].is_op(".")
    params = next((k for k, x in enumerate(group.items[:line_end]) if x.kind == "("), line_end - 1)
    return names[1] if dotted and len(names) > 1 else names[0], dotted, group.items[params + 1 :] if line_end == len(group.items) else group.items[line_end:]


def _control(g: Grammar, head: list[Item]) -> bool:
    return any(w in g.decisions | g.types | g.function | _words("else do when switch repeat get set") for w in _names(head))


def _declared(g: Grammar, head: list[Item]) -> Iterator[str]:
    """Names of the variables and types that a statement declares by one of the values' words."""
    at = next((k for k, i in enumerate(head) if i.kind == "name" and i.text in g.values), None)
    if at is None or any(i.kind in ("(", "{") or i.is_op("=") for i in head[:at]):
        return
    rest = head[at + 1 :]
    if rest and rest[0].kind == "(":
        for inner in statements(g, rest[0].items):
            if inner[0].kind == "name":
                yield inner[0].text
        return
    if head[at].text == "typedef":
        yield from [i.text for i in rest if i.kind == "name"][-1:]
    elif not (head[at].text == "using" and not any(i.is_op("=") for i in rest)):
        yield from [i.text for i in rest if i.kind == "name" and i.text not in g.values | _words("mut unsafe extern")][:1]


def lexed_facts(language: str, path: str, content: str) -> list[tuple]:
    """(path, kind, name, line, end_line, cc, callees, parse_ok): the file, its functions and its exports. A file whose
    brackets or blocks do not match, or are nested too deeply, has parse_ok false and no functions."""
    try:
        return _facts(language, path, parsed(language, content or ""))
    except (Unbalanced, RecursionError):
        return [(path, "file", path, 1, (content or "").count("\n") + 1, None, [], False)]


def _facts(language: str, path: str, tree: Item) -> list[tuple]:
    g = GRAMMARS[language]
    rows = [(path, "file", path, 1, tree.last, count(g, language, tree.items, False) + 1, sorted(calls(g, language, tree.items, False)), True)]
    exports: set[str] = set()

    def export(name: str | None, head: list[Item], top: bool) -> None:
        if name and g.exported(name, frozenset(_names(_before_body(head))), top):
            exports.add(name)

    def function(name: str, line: int, last: int, body: list[Item]) -> None:
        inner = body[0].items if len(body) == 1 and body[0].kind == "{" else body
        cc, called = (count(g, language, inner, True) + 1, sorted(calls(g, language, inner, True))) if inner else (1, [])
        rows.append((path, "function", name, line, last, cc, called, True))

    def blocks(items: list[Item], owner: str | None, top: bool) -> None:
        for head in statements(g, items):
            for i in head:
                names = [x.text for x in (i.items or ()) if x.kind == "name"]
                if i.kind == "def" and names:
                    name, dotted, inner = _definition(i)
                    rows.append((path, "function", f"{owner}.{name}" if owner else name, i.line, i.last, count(g, language, inner, True) + 1, sorted(calls(g, language, inner, True)), True))
                    if top and not dotted:
                        exports.add(name)
                elif i.kind in g.types and names:
                    if top:
                        exports.add(names[0])
                    blocks(i.items[1:], names[0], False)
                elif i.items is not None:
                    blocks(i.items, owner, False)

    def braces(items: list[Item], owner: str | None, top: bool, member: bool) -> None:
        for head in statements(g, items):
            body, words = next((i for i in head if i.kind == "{"), None), _names(_before_body(head))
            marks = [w for w in words if w not in g.types]
            if words and (words[0] in g.spaces or len(words) > 1 and words[1] in g.spaces):
                export(next((w for w in words if w not in g.spaces and w != "pub"), None) if language == "rust" else None, head, False)
                if body:
                    braces(body.items, owner, top, False)
            elif (kind := _type(g, head)) is not None:
                if language != "rust" or "impl" not in words:
                    export(kind, head, top)
                if body:
                    braces(body.items, kind or owner, False, True)
            elif (made := _function(g, language, head, owner, member)) is not None:
                name, inner = made
                function(name, head[0].line, head[-1].last, inner)
                export(name.rpartition(".")[2], head, top)
                if language == "rust" and inner:
                    braces(inner[0].items or [], None, False, False)
            else:
                for name in _declared(g, head):
                    export(name, head, top)
                if language == "cpp" and top and not body and any(i.is_op("=") for i in head) and len(marks) > 1:
                    export(marks[-1], head, top)
                for i in head:
                    if i.items is not None and i.kind == "{":
                        braces(i.items, owner, False, False)

    (blocks if g.ends else partial(braces, member=False))(tree.items, None, True)
    return rows + [(path, "export", name, None, None, None, [], True) for name in sorted(exports)]
