"""Rust, TypeScript and Java sources: a table-driven tokenizer, matched brackets, and rules over tokens and their scopes."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

Row = tuple[str, str, list[str] | None, int, int | None, str | None, str | None]

_NUMBER = r"\d\w*(?:\.\d\w*)?"
_DOUBLE = r'"(?:\\.|[^"\\])*"'
#: What the tokens of each language look like, first match first. `open`: a comment or template whose end no pattern tells.
TOKENS: dict[str, list[tuple[str, str]]] = {
    "rust": [
        ("skip", r"//[^\n]*"), ("open", r"/\*"),
        ("text", r'(?:br|cr|r)(?P<hash>#*)"(?:.|\n)*?"(?P=hash)'), ("text", r"[bc]?" + _DOUBLE), ("text", r"b?'(?:\\(?:[^u]|u\{[^}]*\}|x..)|[^'\\\n])'"),
        ("mark", r"'[A-Za-z_]\w*"), ("word", r"r#[A-Za-z_]\w*|[^\W\d]\w*"), ("number", _NUMBER),
        ("mark", r"::|=>|->|\.\.=?|==|<=|>=|!=|&&|\|\||[^\s\w]"),
    ],
    "typescript": [
        ("skip", r"//[^\n]*"), ("skip", r"/\*(?:.|\n)*?\*/"), ("open", r"/\*|`"),
        ("text", r'"(?:\\(?:.|\n)|[^"\\\n])*"|' + r"'(?:\\(?:.|\n)|[^'\\\n])*'"),
        ("word", r"[^\W\d][\w$]*|[$#][\w$]*"), ("number", _NUMBER),
        ("mark", r"=>|===?|!==?|<=|>=|&&|\|\||\?\?|\?\.|\.\.\.|[^\s\w]"),
    ],
    "java": [
        ("skip", r"//[^\n]*"), ("skip", r"/\*(?:.|\n)*?\*/"), ("open", r"/\*"),
        ("text", r'"""(?:\\.|(?!""").|\n)*"""'), ("text", r'"(?:\\.|[^"\\\n])*"'), ("text", r"'(?:\\.[^'\n]*|[^'\\\n])'"),
        ("word", r"[^\W\d][\w$]*|\$[\w$]*"), ("number", _NUMBER),
        ("mark", r"->|::|==|<=|>=|!=|&&|\|\||\.\.\.|[^\s\w]"),
    ],
}
_TABLES = {lang: (re.compile("|".join(f"(?P<k{i}>{p})" for i, (_, p) in enumerate(rules))), [kind for kind, _ in rules]) for lang, rules in TOKENS.items()}
_CLOSES = {"}": "{", ")": "(", "]": "["}
#: Words before an opening parenthesis that make no call.
_NO_CALL = {
    "rust": frozenset("as async await box break const continue crate dyn else enum extern fn for if impl in let loop macro match mod move mut pub ref return self Self static struct super trait type unsafe use where while yield Fn FnMut FnOnce".split()),
    "typescript": frozenset("async await case catch delete do else export extends for function if import in instanceof new of return super switch this throw typeof void while with yield constructor".split()),
    "java": frozenset("assert case catch do else for if instanceof new return super switch synchronized this throw throws try while yield".split()),
}
_MODIFIERS = {
    "rust": frozenset("pub async const unsafe extern default".split()),
    "typescript": frozenset("export default declare abstract async".split()),
    "java": frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split()),
}
#: A regular expression, not a division, follows one of these (or nothing).
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; => && || ?? == === != !== + - * % < > return typeof case in of void throw".split())
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    pair: int = -1  # the bracket that closes or opens this one
    scope: int = -1  # the bracket around it


def _comment_end(source: str, at: int) -> int | None:
    """Where the nested comment that opens at `at` ends; None if it does not."""
    depth = 0
    for m in re.finditer(r"/\*|\*/", source[at:]):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return at + m.end()
    return None


#: The text of a template up to its end or to the next hole.
_TEMPLATE = re.compile(r"(?:\\(?:.|\n)|\$(?!\{)|[^`\\$])*(`|\$\{)")


class Source:
    """The tokens of a text, each with its bracket's partner and the bracket around it, and what is wrong with them."""

    def __init__(self, text: str, language: str):
        self.text, self.language, self.tokens, self.errors = text, language, [], []
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self._tokenize()
        self._match()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def _tokenize(self) -> None:
        table, kinds = _TABLES[self.language]
        at, depth, holes = 0, 0, []  # holes of templates: the depth of braces that each closes at
        while m := table.search(self.text, at):
            kind, text, at = kinds[int(m.lastgroup[1:])] if m.lastgroup.startswith("k") else "text", m[0], m.end()
            if kind == "skip":
                continue
            template = text == "`" or text == "}" and kind == "mark" and bool(holes) and holes[-1] == depth
            if template:
                if text == "}":
                    self.tokens.append(Token("mark", "}", m.start(), at))
                    holes.pop()
                held = _TEMPLATE.match(self.text, at)
                end = held.end() if held else None
            else:
                end = _comment_end(self.text, m.start()) if kind == "open" and self.language == "rust" else None if kind == "open" else at
            if end is None:
                self.errors.append((m.start(), "a template does not end" if template else "a comment does not end"))
                break
            if template:
                self.tokens.append(Token("text", "`", at, end))
                if held[1] == "${":
                    self.tokens.append(Token("mark", "{", end - 1, end))
                    holes.append(depth)
            elif kind != "open":
                if text == "/" and self.language == "typescript" and (not self.tokens or self.tokens[-1].text in _BEFORE_REGEX) and (r := _REGEX.match(self.text, m.start())):
                    kind, end = "text", r.end()
                elif kind == "mark" and (text == '"' or text == "'" and self.language != "typescript"):  # in markup an apostrophe stands alone
                    self.errors.append((m.start(), "a text does not end"))
                depth += {"{": 1, "}": -1}.get(text, 0) if kind == "mark" else 0
                self.tokens.append(Token(kind, text, m.start(), end))
            at = end
        if holes:
            self.errors.append((len(self.text), "a template does not end"))

    def _match(self) -> None:
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            t.scope = stack[-1] if stack else -1
            if t.kind == "mark" and t.text in "{([":
                stack.append(i)
            elif t.kind == "mark" and t.text in _CLOSES:
                if stack and self.tokens[stack[-1]].text == _CLOSES[t.text]:
                    t.pair = stack.pop()
                    self.tokens[t.pair].pair, t.scope = i, self.tokens[t.pair].scope
                else:
                    self.errors.append((t.start, f"{t.text} without {_CLOSES[t.text]}"))
        self.errors += [(self.tokens[i].start, f"{self.tokens[i].text} is not closed") for i in stack]

    def at(self, i: int) -> str:
        """The text of a token that is code; empty outside and for texts."""
        return self.tokens[i].text if 0 <= i < len(self.tokens) and self.tokens[i].kind != "text" else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word"

    def past(self, i: int) -> int:
        """The token after i, or after the bracket that opens at i."""
        pair = self.tokens[i].pair
        return pair + 1 if pair > i else i + 1

    def seek(self, i: int, *stops: str) -> int:
        """The first of the stops from i on that lies in no bracket of its own; the end of the scope else."""
        while i < len(self.tokens) and self.at(i) not in stops and self.at(i) not in _CLOSES:
            i = self.past(i)
        return i

    def past_generics(self, i: int) -> int:
        """The token after the angle brackets that open at i, if they do."""
        if self.at(i) != "<":
            return i
        depth = 0
        while i < len(self.tokens):
            depth += {"<": 1, ">": -1}.get(self.at(i), 0)
            i = self.past(i)
            if not depth or self.at(i) in (";", "}"):
                return i
        return i

    def lead(self, i: int) -> int:
        """The first modifier before token i."""
        while i > 0:
            before = i - 1
            if self.at(before) == ")" and self.at(self.tokens[before].pair - 1) == "pub":
                i = self.tokens[before].pair - 1
            elif self.at(before) in _MODIFIERS[self.language] or (self.tokens[before].kind == "text" and self.at(before - 1) == "extern"):
                i = before
            else:
                return i
        return i

    def symbol(self, first: int, name: int, head: int, last: int, kind: str) -> Row:
        """head: the token that ends the signature; last: the last token of the definition."""
        start, last = self.tokens[first].start, min(last, len(self.tokens) - 1)
        signature = " ".join(self.text[start : self.tokens[head].start if head < len(self.tokens) else self.tokens[last].end].split())
        return "symbol", self.at(name).removeprefix("r#"), None, self.line(start), self.line(self.tokens[last].end - 1), signature, kind

    def call(self, i: int) -> Row:
        return "reference", self.at(i).removeprefix("r#"), None, self.line(self.tokens[i].start), None, None, "call"

    def imported(self, i: int, name: str, names: list[str] | None) -> Row:
        return "import", name, names, self.line(self.tokens[i].start), None, None, "direct"


_RUST_ITEMS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "mod": "module", "type": "type", "const": "constant", "static": "constant"}


def use_tree(s: Source, i: int, end: int, prefix: str = "") -> list[tuple[str, list[str]]]:
    """(path, names) of the tokens i ... end - 1 of a use tree; an inner tree is an import of its own path."""
    flat, out, names = "", [], []
    while i < end:
        if s.at(i) == "{":
            inside, close = i + 1, s.tokens[i].pair
            while inside < close:
                stop = min(s.seek(inside, ","), close)
                if stop > inside:
                    deep = any(s.at(k) in ("::", "{") for k in range(inside, stop))
                    if deep:
                        out += use_tree(s, inside, stop, prefix + flat)
                    else:
                        names.append(" ".join(s.at(k).removeprefix("r#") for k in range(inside, stop)))
                inside = stop + 1
            return [((prefix + flat).removesuffix("::"), names), *out] if names else out
        flat += f" {s.at(i)} " if s.at(i) == "as" else s.at(i).removeprefix("r#")
        i += 1
    head, _, last = (prefix + flat).rpartition("::")
    return [(head, [last])] if head else [(last, [])]


def rust(text: str) -> Iterator[Row]:
    """Items, use trees and calls. Attributes and the arguments of macros are no code of the file, as they have no syntax of their own."""
    s, i = Source(text, "rust"), 0
    yield from errors(s)
    quiet, guard = -1, -1  # calls up to here are patterns, types or variants; are conditions of a pattern
    while i < len(s.tokens):
        t = s.at(i)
        if t == "#" and (s.at(i + 1) == "[" or s.at(i + 1) == "!" and s.at(i + 2) == "["):
            i = s.past(i + 1 if s.at(i + 1) == "[" else i + 2)
            continue
        if s.word(i) and s.at(i + 1) == "!" and (s.at(i + 2) in ("{", "(", "[") or s.word(i + 2) and s.at(i + 3) in ("{", "(", "[")):
            i = s.past(i + 2 if not s.word(i + 2) else i + 3)
            continue
        if t == "use" and s.at(i - 1) != "+":  # no use<..> bound
            end = s.seek(i + 1, ";")
            for name, names in use_tree(s, i + 1, end):
                yield s.imported(s.lead(i), name, names or None)
            i = end
        elif t == "if" and s.at(stop := s.seek(i + 1, "=>", "{", ";")) == "=>":
            guard = stop
        elif t in _RUST_ITEMS and s.at(i + 1) not in _RUST_ITEMS and s.at(i + 1) not in _MODIFIERS["rust"] and s.at(i - 1) not in ("*", "<", ",", "::", ".") and (s.word(i + 1) or s.at(i + 1) == "mut" and s.word(i + 2)):
            name = i + 2 if s.at(i + 1) == "mut" else i + 1
            head = s.seek(name, "{", ";", "=")
            if t in ("const", "static"):
                whole = s.seek(name, ";")
                if s.at(name) != "_":
                    yield s.symbol(s.lead(i), name, s.seek(name, "=", ";"), whole, "constant")
            elif t == "type":
                if s.at(head) == "=":
                    yield s.symbol(s.lead(i), name, head, s.seek(name, ";"), "type")
            elif s.at(head) == "{" or t not in ("fn", "trait", "enum"):  # a signature without a body is no item
                yield s.symbol(s.lead(i), name, head, s.tokens[head].pair if s.at(head) == "{" and s.tokens[head].pair > 0 else head, _RUST_ITEMS[t])
            if t in ("struct", "enum"):
                quiet = max(quiet, s.past(head) - 1 if head < len(s.tokens) else head)
            if t == "fn":
                quiet = max(quiet, head)
            i = name
        elif s.word(i) and s.at(i + 1) == "(" and i > quiet and t not in _NO_CALL["rust"]:
            after = s.past(i + 1)
            if i > guard and (s.at(after) in ("=>", "=", "|") or s.at(after) == "if" and s.at(s.seek(after, "=>", ";", "{")) == "=>"):
                quiet = after - 1  # a pattern
            else:
                yield s.call(i)
        i += 1


def typescript(text: str) -> Iterator[Row]:
    """Functions, classes, interfaces, aliases, enums and constants that hold an arrow function; imports; calls."""
    s = Source(text, "typescript")
    yield from errors(s)
    quiet = -1
    for i in range(len(s.tokens)):
        t, before = s.at(i), s.at(i - 1)
        free = before in ("", ";", "{", "}", ")", "=>", ":") or before in _MODIFIERS["typescript"] or s.line(s.tokens[i].start) > s.line(s.tokens[i - 1].start) and before not in ("=", "(", ",", "return")
        if t == "import" and s.at(i + 1) not in ("(", ".") and s.tokens[i].scope < 0:
            k = i + 1
            while k < len(s.tokens) and s.tokens[k].kind != "text" and s.at(k) != ";" and not (s.at(k) == "import" and k > i + 1):
                k = s.past(k)
            if k < len(s.tokens) and s.tokens[k].kind == "text" and s.text[s.tokens[k].start] in "'\"":
                yield s.imported(i, s.text[s.tokens[k].start + 1 : s.tokens[k].end - 1], None)
        elif t == "function" and free:
            name = i + 2 if s.at(i + 1) == "*" else i + 1
            body = _body(s, s.past_generics(name + 1)) if s.word(name) else None
            if body is not None:
                yield s.symbol(s.lead(i), name, body, s.tokens[body].pair, "function")
        elif t in ("class", "interface", "enum") and (free or before == "const") and s.word(i + 1):
            body = s.seek(s.past_generics(i + 2), "{", ";")
            if s.at(body) == "{":
                yield s.symbol(s.lead(i), i + 1, body, s.tokens[body].pair, t)
                if t != "class":
                    quiet = max(quiet, s.tokens[body].pair)
        elif t == "type" and free and s.word(i + 1) and s.at(s.past_generics(i + 2)) == "=":
            head = s.past_generics(i + 2)
            last = _expression_end(s, head + 1)
            yield s.symbol(s.lead(i), i + 1, head, last, "type")
            quiet = max(quiet, last)
        elif t in ("const", "let") and s.word(i + 1) and s.at(i + 1) != "enum":
            yield from _arrows(s, i)
        elif s.word(i) and i > quiet and t not in _NO_CALL["typescript"] and s.at(s.past_generics(i + 1) if s.at(i + 1) == "<" and _closes_call(s, i + 1) else i + 1) == "(":
            chain = i
            while s.at(chain - 1) in (".", "?.") and s.word(chain - 2):
                chain -= 2
            opens = s.past_generics(i + 1) if s.at(i + 1) == "<" else i + 1
            after = s.past(opens)
            member = s.at(s.tokens[i].scope) == "{" and (s.at(after) == "{" or s.at(after) == ":" and _body(s, opens) is not None and before not in ("?", "return"))
            if before not in ("function", "class", "*") and s.at(chain - 1) != "new" and not (member and before not in (".", "?.")):
                yield s.call(i)


def _closes_call(s: Source, i: int) -> bool:
    """Whether the angle bracket at i opens type arguments: only names, marks of types and brackets up to the one that closes it."""
    end = s.past_generics(i)
    return s.at(end - 1) == ">" and s.at(end) == "(" and all(s.word(k) or s.tokens[k].kind == "text" or s.at(k) in "<>,.[]{}|&:;?" for k in range(i, end))


def _body(s: Source, i: int) -> int | None:
    """The brace that opens the body of a function whose parameters open at i; None for a signature alone."""
    if s.at(i) != "(":
        return None
    k = s.past(i)
    if s.at(k) == ":":
        k += 1
        while k < len(s.tokens) and not (s.at(k) == "{" and s.at(k - 1) not in (":", "|", "&", "=>", "<", ",", "?", "is", "extends")):
            if s.at(k) in (";", "=") or s.at(k) in _CLOSES:
                return None
            k = s.past(k)
    return k if s.at(k) == "{" and s.tokens[k].pair > 0 else None


def _arrows(s: Source, i: int) -> Iterator[Row]:
    """The declared names from the const or let at i on whose value is an arrow function."""
    name = i + 1
    while s.word(name):
        value = s.seek(name + 1, "=", ";", ",")
        if s.at(value) != "=":
            return
        k = value + 2 if s.at(value + 1) == "async" and s.at(value + 2) != "=>" else value + 1
        k = s.past_generics(k)
        arrow = s.past(k) if s.at(k) == "(" else k + 1 if s.word(k) else k
        if s.at(k) == "(" and s.at(arrow) == ":":
            arrow = s.seek(arrow + 1, "=>", ";", "=")
        last = _expression_end(s, (arrow if s.at(arrow) == "=>" else value) + 1)
        if s.at(arrow) == "=>":
            yield s.symbol(s.lead(i), name, arrow, last, "function")
        if s.at(last + 1) != ",":
            return
        name = last + 2


def _expression_end(s: Source, i: int) -> int:
    """The last token of an expression or type that starts at i: before a semicolon, comma or closing bracket, or where a line ends it."""
    first = i
    while i < len(s.tokens) and s.at(i) not in (";", ",") and s.at(i) not in _CLOSES:
        if i > first and s.line(s.tokens[i].start) > s.line(s.tokens[i - 1].start) and s.at(i - 1) not in _BEFORE_REGEX - {"}"} and s.at(i) not in (".", "?.", "?", ":", "|", "&", "&&", "||", "??", "=>", "+", "-", "*", "/", "="):
            break
        i = s.past(i)
    return i if s.at(i) == ";" else i - 1


_JAVA_KINDS = {"class": "class", "interface": "interface", "enum": "enum", "record": "class"}


def java(text: str) -> Iterator[Row]:
    """Types, methods and constructors; imports; calls and created classes. Annotations and enum constants are no calls."""
    s = Source(text, "java")
    yield from errors(s)
    bodies: dict[int, str] = {}  # the brace of a type's body, and its name
    quiet = -1
    for i in range(len(s.tokens)):
        t, before = s.at(i), s.at(i - 1)
        if t == "import" and s.tokens[i].scope < 0:
            end = s.seek(i + 1, ";")
            path = "".join(s.at(k) for k in range(i + 2 if s.at(i + 1) == "static" else i + 1, end))
            head, _, last = path.rpartition(".")
            yield s.imported(i, head or path, [last] if head and last != "*" else None)
        elif t == "interface" and before == "@":
            quiet = s.past(s.seek(i + 2, "{", ";")) - 1  # an annotation's type has no methods
        elif t in _JAVA_KINDS and s.word(i + 1) and before != "." and (t != "record" or s.at(s.past_generics(i + 2)) == "("):
            body = s.seek(i + 2, "{", ";")
            if s.at(body) == "{":
                bodies[body] = s.at(i + 1)
                yield s.symbol(s.lead(i), i + 1, body, s.tokens[body].pair, _JAVA_KINDS[t])
        elif s.word(i) and s.at(i + 1) == "(" and t not in _NO_CALL["java"] and before not in ("@", "record") and i > quiet:
            scope, after = s.tokens[i].scope, s.past(i + 1)
            if scope in bodies:
                typed = s.word(i - 1) and before not in _NO_CALL["java"] and before not in _MODIFIERS["java"] or before in (">", "]")
                if typed or t == bodies[scope]:
                    after = s.seek(after, "{", ";")
                    first = i
                    while first - 1 > scope and s.at(first - 1) not in ("{", "}", ";") and not (s.at(first - 1) == ")" and s.at(s.tokens[first - 1].pair - 2) == "@"):
                        first -= 1
                    yield s.symbol(first, i, after, s.tokens[after].pair if s.at(after) == "{" and after < len(s.tokens) else after, "method")
                    continue
                if before in ("{", ",", ")"):  # a constant of an enum
                    bodies[after] = ""
                    continue
            chain = i
            while s.at(chain - 1) == "." and s.word(chain - 2):
                chain -= 2
            if s.at(chain - 1) == "new" and s.at(after) == "{":
                bodies[after] = ""  # a class without a name
            if chain == i or s.at(chain - 1) != "new":
                yield s.call(i)
        elif s.word(i) and before == "new" and s.at(i + 1) == "<" and s.at(opens := s.past_generics(i + 1)) == "(":
            if s.at(s.past(opens)) == "{":
                bodies[s.past(opens)] = ""
            yield s.call(i)


def errors(s: Source) -> Iterator[Row]:
    """An error row for each text, comment or bracket that does not end, by line."""
    for at, message in sorted(s.errors):
        yield "error", "syntax", None, s.line(at), None, None, message


GRAMMARS = {"rust": rust, "typescript": typescript, "java": java}
