"""Chat formatting: a small sandboxed template language, compiled to Python closures."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import batch_of, map_batches, text_or_empty

START, END = "<|im_start|>", "<|im_end|>"

#: Marks turns; the text of assistant turns is what a model is to generate.
CHAT = (
    "{% for m in messages %}"
    "{{ '<|im_' + 'start|>' }}{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|im_' + 'end|>' }}\n"
    "{% endfor %}"
)


def escape(text: str) -> str:
    """No control string is left: each starts with ``<|``, which becomes ``<\\|``; a backslash is doubled."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


#: All a template may call. Values are strings, numbers, truth values, lists and the named fields of messages.
FILTERS: dict[str, Callable] = {
    "escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len,
}


class TemplateError(ValueError):
    """The template doesn't follow the language."""


# -- syntax tree ---------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    base: object
    name: str


@dataclass(frozen=True)
class Filter:
    base: object
    name: str


@dataclass(frozen=True)
class Op:
    sign: str
    parts: tuple


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class For:
    name: str
    values: object
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    body: tuple
    other: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


# -- parsing -------------------------------------------------------------------------------------------------------
_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z]\w*)"
                    r"|(?P<sign>==|!=|[-+~|.\[\]()]))")
_SIGNS = {"n": "\n", "t": "\t"}


class _Parser:
    def __init__(self, source: str) -> None:
        self.parts = [p for p in _PARTS.split(source) if p]
        self.at = 0

    def body(self, *ends: str) -> tuple[tuple, str]:
        """Nodes up to a block tag among ``ends``, and that tag; up to the end of the source without any."""
        nodes = []
        while self.at < len(self.parts):
            part = self.parts[self.at]
            self.at += 1
            if part.startswith("{{"):
                nodes.append(Emit(self.whole(part)))
            elif part.startswith("{%"):
                tag = part[2:-2].strip()
                word = tag.split(None, 1)[0] if tag else ""
                if word in ends:
                    return tuple(nodes), tag
                nodes.append(self.block(word, tag[len(word):]))
            elif not part.startswith("{#"):
                nodes.append(Emit(Const(part)))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return tuple(nodes), ""

    def whole(self, part: str):
        return self.expression(part[2:-2])

    def block(self, word: str, rest: str):
        if word == "for":
            found = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
            if not found:
                raise TemplateError(f"for{rest}")
            body, _ = self.body("endfor")
            return For(found[1], self.expression(found[2]), body)
        if word == "if":
            return self.branch(rest)
        if word == "set":
            found = re.fullmatch(r"\s*([A-Za-z]\w*)\s*=(.+)", rest, re.S)
            if not found:
                raise TemplateError(f"set{rest}")
            return Set(found[1], self.expression(found[2]))
        if word == "generation":
            return Generation(self.body("endgeneration")[0])
        raise TemplateError(f"unknown tag {word!r}")

    def branch(self, test: str):
        body, tag = self.body("elif", "else", "endif")
        if tag.startswith("elif"):
            return If(self.expression(test), body, (self.branch(tag[4:]),))
        other = self.body("endif")[0] if tag == "else" else ()
        return If(self.expression(test), body, other)

    def expression(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"can't read {source[at:at + 20]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.tokens.append(("end", ""))
        node = self.either()
        if self.tokens[0][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return node

    def take(self, *values: str) -> str:
        kind, value = self.tokens[0]
        if kind in ("sign", "name") and value in values:
            self.tokens.pop(0)
            return value
        return ""

    def either(self):
        node = self.both()
        while self.take("or"):
            node = Op("or", (node, self.both()))
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = Op("and", (node, self.negated()))
        return node

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        node = self.summed()
        sign = self.take("==", "!=")
        return Op(sign, (node, self.summed())) if sign else node

    def summed(self):
        node = self.filtered()
        while sign := self.take("+", "-", "~"):
            node = Op(sign, (node, self.filtered()))
        return node

    def filtered(self):
        node = self.value()
        while self.take("|"):
            _, name = self.tokens.pop(0)
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            node = Filter(node, name)
        return node

    def value(self):
        kind, value = self.tokens.pop(0)
        if kind == "text":
            node = Const(re.sub(r"\\(.)", lambda m: _SIGNS.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "number":
            node = Const(int(value))
        elif kind == "name":
            node = Const({"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else Name(value)
        elif value == "(":
            node = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while sign := self.take(".", "["):
            kind, name = self.tokens.pop(0)
            node = Field(node, name if sign == "." else name[1:-1])
            if kind != ("name" if sign == "." else "text") or sign == "[" and not self.take("]"):
                raise TemplateError("fields are .name or ['name']")
        return node


def parse(source: str) -> tuple:
    return _Parser(source).body()[0]


# -- constant folding ----------------------------------------------------------------------------------------------
_OPERATIONS: dict[str, Callable] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "~": lambda a, b: _shown(a) + _shown(b),
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "not": lambda a: not a,
}


def _shown(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold(node):
    """The same tree with operations on constants done, settled branches chosen and neighbouring texts joined."""
    if isinstance(node, tuple):
        folded: list = []
        for part in (fold(n) for n in node):
            for one in part if isinstance(part, tuple) else (part,):
                if isinstance(one, Emit) and isinstance(one.value, Const):
                    one = Emit(Const(_shown(one.value.value)))
                    if folded and isinstance(folded[-1], Emit) and isinstance(folded[-1].value, Const):
                        one = Emit(Const(folded.pop().value.value + one.value.value))
                folded.append(one)
        return tuple(folded)
    if isinstance(node, Emit):
        return Emit(fold(node.value))
    if isinstance(node, Filter):
        base = fold(node.base)
        return Const(FILTERS[node.name](base.value)) if isinstance(base, Const) else Filter(base, node.name)
    if isinstance(node, Field):
        return Field(fold(node.base), node.name)
    if isinstance(node, Op):
        parts = tuple(fold(p) for p in node.parts)
        if node.sign in ("and", "or"):
            if isinstance(parts[0], Const):
                return parts[1] if bool(parts[0].value) == (node.sign == "and") else parts[0]
        elif all(isinstance(p, Const) for p in parts):
            return Const(_OPERATIONS[node.sign](*[p.value for p in parts]))
        return Op(node.sign, parts)
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.body if test.value else node.other)
        return If(test, fold(node.body), fold(node.other))
    if isinstance(node, For):
        return For(node.name, fold(node.values), fold(node.body))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


# -- closures ------------------------------------------------------------------------------------------------------
def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda names, value=node.value: value
    if isinstance(node, Name):
        def look_up(names, name=node.name):
            if name not in names:
                raise TemplateError(f"unknown name {name!r}")
            return names[name]
        return look_up
    if isinstance(node, Field):
        base = _value(node.base)

        def field(names, name=node.name):
            owner = base(names)
            if not isinstance(owner, dict) or name not in owner:  # never an attribute of a Python object
                raise TemplateError(f"no field {name!r}")
            return owner[name]
        return field
    if isinstance(node, Filter):
        base, apply = _value(node.base), FILTERS[node.name]
        return lambda names: apply(base(names))
    parts = [_value(p) for p in node.parts]
    if node.sign == "and":
        return lambda names: parts[0](names) and parts[1](names)
    if node.sign == "or":
        return lambda names: parts[0](names) or parts[1](names)
    operation = _OPERATIONS[node.sign]
    return lambda names: operation(*[p(names) for p in parts])


class _Output:
    def __init__(self) -> None:
        self.pieces, self.length, self.spans = [], 0, []

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def _writer(node) -> Callable[[dict, _Output], None]:
    if isinstance(node, tuple):
        writers = [_writer(n) for n in node]

        def every(names, out):
            for write in writers:
                write(names, out)
        return every
    if isinstance(node, Emit):
        if isinstance(node.value, Const):
            return lambda names, out, text=node.value.value: out.write(text)
        value = _value(node.value)
        return lambda names, out: out.write(_shown(value(names)))
    if isinstance(node, If):
        test, body, other = _value(node.test), _writer(node.body), _writer(node.other)
        return lambda names, out: body(names, out) if test(names) else other(names, out)
    if isinstance(node, For):
        values, body = _value(node.values), _writer(node.body)

        def loop(names, out, name=node.name):
            rows = values(names)
            for i, row in enumerate(rows):
                place = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(rows) - 1}
                body({**names, name: row, "loop": place}, out)
        return loop
    if isinstance(node, Set):
        value = _value(node.value)

        def assign(names, out, name=node.name):
            names[name] = value(names)
        return assign
    body = _writer(node.body)

    def generation(names, out):
        start = out.length
        body(names, out)
        out.spans.append((start, out.length))
    return generation


def compile_template(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """``messages -> (text, spans)``; spans are the code points, end exclusive, of what stands in generation marks."""
    write = _writer(fold(parse(source)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        write({"messages": messages}, out)
        return "".join(out.pieces), out.spans

    return render


def read_turns(text: str) -> Iterable[tuple[str, str]]:
    """(role, text) of each turn of a text that CHAT rendered."""
    at = 0
    while at < len(text):
        line = text.index("\n", at)
        end = text.index(END, line)
        yield unescape(text[at + len(START):line]), unescape(text[line + 1:end])
        at = end + len(END) + 1


# -- Spark ---------------------------------------------------------------------------------------------------------
def format_conversations(rows: DataFrame, template: str = CHAT, key: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """(key, n_turns, text, spans) of each conversation: the rendered text and the spans to be learned.

    Rows are taken by turn, then role, then text; repeated rows are turns too.
    A null role or text is empty, null turns come first, rows with a null key
    are one conversation. Rows are dealt out by key and sorted on disk where
    need be; a task holds one conversation at a time, which is one output row.
    """
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_turns bigint, text string, spans array<struct<start:bigint,end:bigint>>"
    tidy = rows.select(F.col(key).alias("k"), F.col(turn).alias("n"), text_or_empty(role).alias("r"), text_or_empty(text).alias("t"))
    ordered = tidy.repartition("k").sortWithinPartitions("k", "n", "r", "t")

    def each(batches, names):
        render, held, messages = compile_template(template), None, []

        def done(key, messages):
            whole, spans = render(messages)
            return key, len(messages), whole, [{"start": s, "end": e} for s, e in spans]

        for batch in batches:
            out = []
            for k, r, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if messages and k != held:
                    out.append(done(held, messages))
                    messages = []
                held = k
                messages.append({"role": r, "text": t})
            if out:
                yield batch_of(names, list(zip(*out)))
        if messages:
            yield batch_of(names, list(zip(done(held, messages))))

    return map_batches(ordered, ["k", "r", "t"], each, schema)


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the rendered texts and spans alone."""
    kind = formatted.schema[key].dataType.simpleString()
    schema = (f"{key} {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint")

    def each(batches, names):
        for batch in batches:
            out = []
            for k, whole, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                turns, loss, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, words in read_turns(whole):
                    turns.update(f"{role}\n{words}\n".encode())
                    n += 1
                for span in spans:
                    learned = unescape(whole[span["start"]:span["end"]])
                    loss.update(learned.encode())
                    chars += len(learned)
                out.append((k, n, turns.hexdigest(), chars, loss.hexdigest(), len(whole)))
            if out:
                yield batch_of(names, list(zip(*out)))

    return map_batches(formatted, [key, "text", "spans"], each, schema)
