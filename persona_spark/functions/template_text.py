"""Chat templates given as text, in the form that tokenizers carry, compiled to Columns.

Understood are: text; `{{ expression }}`; `{% for m in messages %}` (also over `messages[1:]`) with loop.first, loop.last,
loop.index and loop.index0; `{% if %}`, `{% elif %}`, `{% else %}`; comments. Expressions: strings, whole numbers, true, false;
names given as variables; add_generation_prompt; fields of a message; `+` and `~`; `==`, `!=`; `and`, `or`, `not`; brackets;
`| trim`, `| length`, `| upper`, `| lower`; raise_exception('...'). Anything else is an error when the template is compiled.
White space is trimmed as tokenizer libraries do: a block takes the blanks before it on its line and the newline behind it.
"""

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from persona_spark.functions.text import strip

_TAG = re.compile(r"\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>-?\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[+~|.()\[\]:]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


class TemplateSyntaxError(ValueError):
    """A template that uses what is not understood."""


@dataclass(frozen=True)
class Scope:
    """What names stand for at a place: Columns, and lists of messages by (Column of the array)."""

    names: Mapping[str, Column]
    messages: Column
    loop: Mapping[str, Column] | None = None
    current: str | None = None


Part = Callable[[Scope], Column]


class _Expression:
    """One expression, read from left to right; each method gives back what makes the Column in a scope."""

    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        while source[at:].strip():
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateSyntaxError(f"not understood: {source[at:].strip()!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def peek(self) -> tuple[str | None, str | None]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("sign", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateSyntaxError(f"{value!r} expected in {self.source!r}")

    def whole(self) -> Part:
        part = self.either()
        if self.at < len(self.tokens):
            raise TemplateSyntaxError(f"not understood: {self.peek()[1]!r} in {self.source!r}")
        return part

    def either(self) -> Part:
        part = self.both()
        while self.take("or"):
            part = (lambda a, b: lambda s: _true(a(s)) | _true(b(s)))(part, self.both())
        return part

    def both(self) -> Part:
        part = self.negated()
        while self.take("and"):
            part = (lambda a, b: lambda s: _true(a(s)) & _true(b(s)))(part, self.negated())
        return part

    def negated(self) -> Part:
        if self.take("not"):
            part = self.negated()
            return lambda s: ~_true(part(s))
        return self.compared()

    def compared(self) -> Part:
        left = self.joined()
        sign = self.take("==", "!=")
        if not sign:
            return left
        right = self.joined()
        return (lambda s: left(s).eqNullSafe(right(s))) if sign == "==" else (lambda s: ~left(s).eqNullSafe(right(s)))

    def joined(self) -> Part:
        parts = [self.filtered()]
        while self.take("+", "~"):
            parts.append(self.filtered())
        return parts[0] if len(parts) == 1 else lambda s: F.concat(*[_text(p(s)) for p in parts])

    def filtered(self) -> Part:
        part, is_list = self.value()
        while self.take("|"):
            name = self.peek()[1]
            known = {"trim": lambda c: strip(_text(c)), "upper": lambda c: F.upper(_text(c)), "lower": lambda c: F.lower(_text(c)), "length": F.size if is_list else lambda c: F.length(_text(c))}
            if name not in known:
                raise TemplateSyntaxError(f"no filter {name!r} in {self.source!r}")
            self.at += 1
            part, is_list = (lambda f, p: lambda s: f(p(s)))(known[name], part), False
        if is_list:
            raise TemplateSyntaxError(f"a list stands where a text is needed in {self.source!r}")
        return part

    def value(self) -> tuple[Part, bool]:
        kind, value = self.peek()
        self.at += 1
        if kind == "text":
            text = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S)
            return lambda s: F.lit(text), False
        if kind == "number":
            return lambda s: F.lit(int(value)), False
        if value == "(":
            part = self.either()
            self.need(")")
            return part, False
        if kind != "name":
            raise TemplateSyntaxError(f"not understood: {self.source!r}")
        if value in ("true", "True", "false", "False"):
            return lambda s: F.lit(value.lower() == "true"), False
        if value == "raise_exception":
            self.need("(")
            message = self.either()
            self.need(")")
            return lambda s: F.raise_error(message(s)).cast("string"), False
        if value == "messages":
            return self.of_messages()
        if value == "loop":
            self.need(".")
            name = self.peek()[1]
            self.at += 1
            if name not in ("first", "last", "index", "index0"):
                raise TemplateSyntaxError(f"no loop.{name}")
            return lambda s: _found(s.loop or {}, name, "loop."), False
        name = value
        if self.peek()[1] in ("[", "."):
            field = self.field()
            return lambda s: _message(s, name)[field], False
        return lambda s: _found(s.names, name), False

    def of_messages(self) -> tuple[Part, bool]:
        if not self.take("["):
            return lambda s: s.messages, True
        kind, number = self.peek()
        if kind != "number":
            raise TemplateSyntaxError(f"a number is needed in {self.source!r}")
        self.at += 1
        number = int(number)
        if self.take(":"):
            self.need("]")
            if number < 0:
                raise TemplateSyntaxError(f"no slices from the end: {self.source!r}")
            return lambda s: F.slice(s.messages, F.lit(number + 1), F.greatest(F.size(s.messages) - number, F.lit(0))), True
        self.need("]")
        field = self.field()
        at = number + 1 if number >= 0 else number
        return lambda s: F.try_element_at(s.messages, F.lit(at))[field], False

    def field(self) -> str:
        if self.take("."):
            kind, name = self.peek()
            self.at += 1
        else:
            self.need("[")
            kind, name = self.peek()
            self.at += 1
            self.need("]")
            name = name[1:-1] if kind == "text" else None
        if name not in ("role", "content"):
            raise TemplateSyntaxError(f"messages have a role and a content: {self.source!r}")
        return name


def _found(names: Mapping[str, Column], name: str, prefix: str = "") -> Column:
    if name not in names:
        raise TemplateSyntaxError(f"unknown name {prefix}{name}")
    return names[name]


def _message(scope: Scope, name: str) -> Column:
    if scope.current != name:
        raise TemplateSyntaxError(f"{name} is no message here")
    return scope.names[name]


def _text(c: Column) -> Column:
    """A missing text counts as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def _true(c: Column) -> Column:
    """Texts are true unless empty or missing. Truth values pass through their text form."""
    shown = c.cast("string")
    return F.coalesce((shown != "") & (shown != "false"), F.lit(False))


def _pieces(source: str) -> list[tuple[str, str]]:
    """(kind, content) of texts, outputs and blocks, with white space trimmed."""
    out: list[tuple[str, str]] = []
    at = 0

    def add_text(text: str, tag: str) -> None:
        if tag.startswith(("{%-", "{{-")):
            text = text.rstrip()
        elif tag.startswith(("{%", "{#")):
            text = re.sub(r"(^|\n)[ \t]*$", r"\1", text) if at == 0 or "\n" in text else text
        out.append(("text", text))

    for found in _TAG.finditer(source):
        add_text(source[at : found.start()], found[0])
        tag, at = found[0], found.end()
        if tag.endswith(("-%}", "-}}")):
            at += len(source[at:]) - len(source[at:].lstrip())
        elif tag.startswith(("{%", "{#")) and source.startswith("\n", at):
            at += 1
        if tag.startswith("{#"):
            continue
        out.append(("output" if tag.startswith("{{") else "block", tag[2:-2].strip("-").strip()))
    out.append(("text", source[at:]))
    if any("{%" in t or "{{" in t for kind, t in out if kind == "text"):
        raise TemplateSyntaxError("a tag is not closed")
    return out


def _body(pieces: list[tuple[str, str]], ends: tuple[str, ...] = ()) -> tuple[Part, str]:
    """What stands up to one of the blocks `ends`, which are consumed."""
    parts: list[Part] = []
    while pieces:
        kind, content = pieces.pop(0)
        if kind == "text":
            if content:
                parts.append((lambda t: lambda s: F.lit(t))(content))
        elif kind == "output":
            parts.append((lambda e: lambda s: _text(e(s)))(_Expression(content).whole()))
        elif content.split(" ")[0] in ends:
            return _together(parts), content
        elif found := re.fullmatch(r"for (\w+) in (messages.*)", content):
            parts.append(_loop(found[1], found[2], _body(pieces, ("endfor",))[0]))
        elif content.startswith("if "):
            parts.append(_branches(content[3:], pieces))
        else:
            raise TemplateSyntaxError(f"no such block: {content!r}")
    if ends:
        raise TemplateSyntaxError(f"{ends[-1]} is missing")
    return _together(parts), ""


def _together(parts: list[Part]) -> Part:
    return lambda s: F.concat(F.lit(""), *[p(s) for p in parts])


def _loop(name: str, over: str, body: Part) -> Part:
    expression = _Expression(over)
    messages, is_list = expression.value()
    if not is_list or expression.peek()[0]:
        raise TemplateSyntaxError(f"a loop goes over messages: {over!r}")

    def make(s: Scope) -> Column:
        rows = messages(s)

        def turn(m: Column, i: Column) -> Column:
            loop = {"first": i == 0, "last": i == F.size(rows) - 1, "index": i + 1, "index0": i}
            return body(Scope({**s.names, name: m}, s.messages, loop, name))

        return F.array_join(F.transform(rows, turn), "")

    return make


def _branches(condition: str, pieces: list[tuple[str, str]]) -> Part:
    cases, otherwise = [], _together([])
    while True:
        body, end = _body(pieces, ("elif", "else", "endif"))
        cases.append((_Expression(condition).whole(), body))
        if end.startswith("elif "):
            condition = end[5:]
            continue
        if end == "else":
            otherwise, end = _body(pieces, ("endif",))
        break

    def make(s: Scope) -> Column:
        out = otherwise(s)
        for test, body in reversed(cases):
            out = F.when(_true(test(s)), body(s)).otherwise(out)
        return out

    return make


class TextTemplate:
    """A compiled template. `variables` are what it may name besides the messages, such as bos_token and eos_token."""

    def __init__(self, source: str, **variables: str | bool):
        self._body, _ = _body(_pieces(source))
        self._variables = variables
        self.render(F.col("messages"))  # names are checked as well

    def render(self, messages: Column, add_generation_prompt: bool = False) -> Column:
        names = {"add_generation_prompt": add_generation_prompt, **self._variables}
        return self._body(Scope({k: F.lit(v) for k, v in names.items()}, messages))
