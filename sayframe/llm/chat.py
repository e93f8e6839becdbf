"""Conversations as training text: a compiler for chat templates, formatting with a loss mask, and reading back.

A template is text with {{ expression }}, {% if %}/{% elif %}/{% else %}/{% endif %}, {% for m in messages %}/{% endfor %},
{% set name = expression %}, {% generation %}/{% endgeneration %} around what a model is to learn, and {# remarks #}; a
hyphen inside a mark (as in {%- if x -%}) takes away the white space on its side. Expressions have literals, names,
fields (m.role, m['role']), the filters trim, upper, lower and escape, ~ and +, == != in, not, and, or, and `a if b else c`.
Nothing else can be reached: fields are keys of mappings, and there are no calls.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from .words import slices

PART_CHARS = 1 << 20
OPEN, CLOSE = object(), object()
_ESCAPE = "\\"


class TemplateError(ValueError):
    """A template that is not well formed, or asks for what it is not given."""


class Controls:
    """Control strings, and a reversible way to keep them out of texts: a backslash behind the first character of each,
    and another behind each backslash of the text."""

    def __init__(self, strings: Iterable[str]):
        self.strings = tuple(strings)
        if any(len(s) < 2 or _ESCAPE in s or s[0] in s[1:] for s in self.strings):
            raise ValueError("a control string has two characters at least, no backslash, and its first character once")
        self.any_of = re.compile("|".join(map(re.escape, sorted(self.strings, key=len, reverse=True))) or "(?!)")

    def escape(self, text: str) -> str:
        return self.any_of.sub(lambda m: m[0][0] + _ESCAPE + m[0][1:], text.replace(_ESCAPE, _ESCAPE * 2))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text) if _ESCAPE in text else text


# --- syntax tree ---------------------------------------------------------------------------------------------------------


@dataclass
class Node:
    """kind: const, name, field, filter, not, and, or, pick and the operators of expressions; text, show, if, for, set and
    generation of templates. Children are expressions (args), then bodies."""

    kind: str
    value: Any = None
    args: list[Node] = field(default_factory=list)
    bodies: list[list[Node]] = field(default_factory=list)


_MARK = re.compile(r"(\{\{|\{%|\{#)(-?)(.*?)(-?)(\}\}|%\}|#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[-~+|.()\[\],]))""", re.S)
_CLOSERS = {"{{": "}}", "{%": "%}", "{#": "#}"}
_WORDS = {"true": True, "false": False, "none": None}
_STRING_ESCAPES = {"n": "\n", "t": "\t"}
FILTERS = ("trim", "upper", "lower", "escape")


class _Expression:
    """A recursive-descent reader of one expression."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        return text if kind in ("op", "name") else f"<{kind}>"

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing before {self.peek()!r}")

    def whole(self) -> Node:
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()!r}")
        return out

    def choice(self) -> Node:
        out = self.chain("or", lambda: self.chain("and", self.negation))
        if self.take("if"):
            test = self.chain("or", lambda: self.chain("and", self.negation))
            self.need("else")
            return Node("pick", args=[test, out, self.choice()])
        return out

    def chain(self, word: str, below: Callable[[], Node]) -> Node:
        out = below()
        while self.take(word):
            out = Node(word, args=[out, below()])
        return out

    def negation(self) -> Node:
        return Node("not", args=[self.negation()]) if self.take("not") else self.comparison()

    def comparison(self) -> Node:
        out = self.joined()
        op = self.take("==", "!=", "in") or (self.peek() == "not" and "not")
        if op == "not":
            self.at += 1
            self.need("in")
            return Node("not", args=[Node("in", args=[out, self.joined()])])
        return Node(op, args=[out, self.joined()]) if op else out

    def joined(self) -> Node:
        out = self.filtered()
        while op := self.take("~", "+"):
            out = Node(op, args=[out, self.filtered()])
        return out

    def filtered(self) -> Node:
        out = self.single()
        while self.take("|"):
            name = self.peek()
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            self.at += 1
            out = Node("filter", name, [out])
        return out

    def single(self) -> Node:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        self.at += 1
        if kind == "str":
            return self.fields(Node("const", re.sub(r"\\(.)", lambda m: _STRING_ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)))
        if kind == "int":
            return Node("const", int(text))
        if kind == "name" and text.lower() in _WORDS:
            return Node("const", _WORDS[text.lower()])
        if kind == "name" and text not in ("if", "else", "in", "not", "and", "or"):
            return self.fields(Node("name", text))
        if text == "(":
            out = self.choice()
            self.need(")")
            return self.fields(out)
        raise TemplateError(f"an expression is missing before {text or 'the end'!r}")

    def fields(self, out: Node) -> Node:
        while op := self.take(".", "["):
            if op == ".":
                kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
                if kind != "name":
                    raise TemplateError("a field's name is missing")
                self.at += 1
                out = Node("field", args=[out, Node("const", text)])
            else:
                out = Node("field", args=[out, self.choice()])
                self.need("]")
        return out


def parse(source: str) -> list[Node]:
    """The syntax tree of a template."""
    pieces, at, strip = [], 0, False
    for m in _MARK.finditer(source):
        if _CLOSERS[m[1]] != m[5]:
            raise TemplateError(f"{m[1]} is closed by {m[5]}")
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        pieces.append(("text", text.rstrip() if m[2] else text))
        pieces.append((m[1], m[3].strip()))
        at, strip = m.end(), bool(m[4])
    pieces.append(("text", source[at:].lstrip() if strip else source[at:]))
    rest = iter(pieces)

    def body(*ends: str) -> tuple[list[Node], str, str]:
        out: list[Node] = []
        for kind, text in rest:
            word, _, tail = text.partition(" ")
            if kind == "text":
                if "{%" in text or "{{" in text:
                    raise TemplateError("a mark is not closed")
                out.append(Node("text", text))
            elif kind == "{{":
                out.append(Node("show", args=[_Expression(text).whole()]))
            elif kind == "{%" and word in ends:
                return out, word, tail
            elif kind == "{%" and word == "if":
                tests, bodies, end = [_Expression(tail).whole()], [], ""
                while end != "endif":
                    inner, end, tail = body("elif", "else", "endif") if end != "else" else body("endif")
                    bodies.append(inner)
                    tests += [_Expression(tail).whole()] if end == "elif" else []
                out.append(Node("if", args=tests, bodies=bodies))
            elif kind == "{%" and word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", tail, re.S)
                if not m:
                    raise TemplateError("a loop has the form: for name in expression")
                out.append(Node("for", m[1], [_Expression(m[2]).whole()], [body("endfor")[0]]))
            elif kind == "{%" and word == "set":
                name, sign, value = tail.partition("=")
                if not sign or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                    raise TemplateError("an assignment has the form: set name = expression")
                out.append(Node("set", name.strip(), [_Expression(value).whole()]))
            elif kind == "{%" and word == "generation":
                out.append(Node("generation", bodies=[body("endgeneration")[0]]))
            elif kind == "{%":
                raise TemplateError(f"unexpected {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, "", ""

    return body()[0]


# --- folding ---------------------------------------------------------------------------------------------------------------


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _field(of: Any, name: Any) -> Any:
    return of.get(name) if isinstance(of, dict) else None


_OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: _text(a) in _text(b), "~": lambda a, b: _text(a) + _text(b), "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b), "field": _field,
}


def _filter(name: str, controls: Controls) -> Callable[[Any], str]:
    made = {"trim": str.strip, "upper": str.upper, "lower": str.lower, "escape": controls.escape}[name]
    return lambda value: made(_text(value))


def assigned(nodes: list[Node]) -> set[str]:
    """Names that a template binds itself."""
    own = {n.value for n in nodes if n.kind in ("for", "set")} | {"loop" for n in nodes if n.kind == "for"}
    return own.union(*(assigned(b) for n in nodes for b in n.bodies))


def _fold_expression(node: Node, constants: dict[str, Any], controls: Controls) -> Node:
    if node.kind == "name":
        return Node("const", constants[node.value]) if node.value in constants else node
    args = [_fold_expression(a, constants, controls) for a in node.args]
    fixed = bool(args) and all(a.kind == "const" for a in args)
    if node.kind in ("and", "or", "pick") and args[0].kind == "const":
        if node.kind == "pick":
            return args[1] if args[0].value else args[2]
        return args[1] if bool(args[0].value) == (node.kind == "and") else args[0]
    if fixed and node.kind == "filter":
        return Node("const", _filter(node.value, controls)(args[0].value))
    if fixed and node.kind == "not":
        return Node("const", not args[0].value)
    if fixed and node.kind in _OPERATORS:
        return Node("const", _OPERATORS[node.kind](args[0].value, args[1].value))
    return Node(node.kind, node.value, args)


def fold(nodes: list[Node], constants: dict[str, Any], controls: Controls) -> list[Node]:
    """The tree with constant expressions worked out, choices on constants made, and neighbouring texts joined."""
    out: list[Node] = []

    def add(node: Node) -> None:
        if node.kind == "text" and out and out[-1].kind == "text":
            out[-1] = Node("text", out[-1].value + node.value)
        elif node.kind != "text" or node.value:
            out.append(node)

    for node in nodes:
        args = [_fold_expression(a, constants, controls) for a in node.args]
        if node.kind == "show" and args[0].kind == "const":
            add(Node("text", _text(args[0].value)))
        elif node.kind == "if":
            bodies, tests = [fold(b, constants, controls) for b in node.bodies], []
            kept: list[list[Node]] = []
            for k, b in enumerate(bodies):
                test = args[k] if k < len(args) else Node("const", True)
                if test.kind == "const" and not test.value:
                    continue
                kept.append(b)
                if test.kind == "const":
                    break
                tests.append(test)
            if tests:
                add(Node("if", args=tests, bodies=kept))
            else:
                for n in kept[0] if kept else []:
                    add(n)
        else:
            add(Node(node.kind, node.value, args, [fold(b, constants, controls) for b in node.bodies]))
    return out


# --- closures --------------------------------------------------------------------------------------------------------------

Env = dict[str, Any]


def _evaluate(node: Node, known: set[str], controls: Controls) -> Callable[[Env], Any]:
    if node.kind == "const":
        value = node.value
        return lambda env: value
    if node.kind == "name":
        name = node.value
        if name not in known:
            raise TemplateError(f"unknown name {name!r}")
        return lambda env: env.get(name)
    args = [_evaluate(a, known, controls) for a in node.args]
    a, b = args[0], args[-1]
    if node.kind == "filter":
        apply = _filter(node.value, controls)
        return lambda env: apply(a(env))
    if node.kind == "not":
        return lambda env: not a(env)
    if node.kind == "and":
        return lambda env: a(env) and b(env)
    if node.kind == "or":
        return lambda env: a(env) or b(env)
    if node.kind == "pick":
        c = args[1]
        return lambda env: c(env) if a(env) else b(env)
    op = _OPERATORS[node.kind]
    return lambda env: op(a(env), b(env))


def _render(nodes: list[Node], known: set[str], controls: Controls) -> Callable[[Env], Iterator[Any]]:
    steps = []
    for node in nodes:
        args = [_evaluate(a, known, controls) for a in node.args]
        bodies = [_render(b, known, controls) for b in node.bodies]
        steps.append(_STEPS[node.kind](node, args, bodies))

    def run(env: Env) -> Iterator[Any]:
        for step in steps:
            yield from step(env)

    return run


def _show(node, args, bodies):
    def run(env):
        yield _text(args[0](env))

    return run


def _if(node, args, bodies):
    def run(env):
        for test, inner in zip(args, bodies):
            if test(env):
                return inner(env)
        return bodies[-1](env) if len(bodies) > len(args) else ()

    return run


def _for(node, args, bodies):
    name, inner = node.value, bodies[0]

    def run(env):
        items, k = iter(args[0](env) or ()), 0
        held, more = next(items, None), True
        while held is not None:
            following = next(items, None)
            env |= {name: held, "loop": {"index0": k, "index": k + 1, "first": not k, "last": following is None}}
            yield from inner(env)
            held, k = following, k + 1

    return run


def _set(node, args, bodies):
    def run(env):
        env[node.value] = args[0](env)
        return ()

    return run


def _generation(node, args, bodies):
    def run(env):
        yield OPEN
        yield from bodies[0](env)
        yield CLOSE

    return run


_STEPS = {"text": lambda node, args, bodies: lambda env: (node.value,), "show": _show, "if": _if, "for": _for, "set": _set, "generation": _generation}


def _loops(nodes: list[Node], depth: int = 0) -> Iterator[int]:
    """At which depth of loops `messages` is read; anywhere but as a loop's list it is an error."""
    for n in nodes:
        over = n.kind == "for" and n.args[0].kind == "name" and n.args[0].value == "messages"
        if over:
            yield depth
        elif any(_reads(a) for a in n.args):
            raise TemplateError("messages can only be looped over")
        for b in n.bodies:
            yield from _loops(b, depth + (n.kind == "for"))


def _reads(node: Node) -> bool:
    return (node.kind == "name" and node.value == "messages") or any(map(_reads, node.args))


def compile_template(source: str, constants: dict[str, Any] | None = None, controls: Iterable[str] = ()) -> Callable[[Iterable[dict]], Iterator[Any]]:
    """A function that gives the pieces of a conversation's text one by one, with OPEN and CLOSE around generated ones.

    Its messages are mappings and may come from any iterator, of which it holds two at a time; so a template loops over
    them once, and not inside of another loop. `constants` are names with fixed values, worked out beforehand unless the
    template binds the same name. TemplateError for anything unknown or misplaced.
    """
    tree, own = parse(source), Controls(controls)
    bound = assigned(tree)
    tree = fold(tree, {k: v for k, v in (constants or {}).items() if k not in bound}, own)
    if list(_loops(tree)) not in ([], [0]):
        raise TemplateError("messages are looped over once, and not inside of another loop")
    run = _render(tree, bound | {"messages", *(constants or {})}, own)
    return lambda messages: run({**(constants or {}), "messages": messages})


# --- conversations ---------------------------------------------------------------------------------------------------------

#: Control strings of the default template; in roles and texts they are escaped.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = (
    "{{ bos }}{% for m in messages %}{{ opening }}{{ m.role | escape }}{{ closing }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}{{ eos }}{% endfor %}"
)
CONSTANTS = dict(zip(("bos", "eos", "opening", "closing"), CONTROLS))


def _rows(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[dict]:
    for batch in batches:
        for b in slices(batch, text):
            yield from b.to_pylist()


def _batches(rows: Iterable[tuple], schema: pa.Schema, weight: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, str))
        if size >= weight:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _parts(pieces: Iterator[Any], limit: int) -> Iterator[tuple[int, str, list[dict]]]:
    """(number, text, loss) of stretches of about `limit` characters; loss: places in the whole text, half open."""
    number, held, size, begin, opened, spans = 0, [], 0, 0, None, []
    for piece in pieces:
        if piece is OPEN:
            opened = begin + size
        elif piece is CLOSE:
            if begin + size > opened:
                spans.append({"start": opened, "end": begin + size})
            opened = None
        else:
            held.append(piece)
            size += len(piece)
            if size >= limit:
                if opened is not None and begin + size > opened:
                    spans.append({"start": opened, "end": begin + size})
                    opened = begin + size
                yield number, "".join(held), spans
                number, held, size, begin, spans = number + 1, [], 0, begin + size, []
    if held or not number:
        yield number, "".join(held), spans


def format_conversations(df: DataFrame, template: str = TEMPLATE, constants: dict[str, Any] | None = None, controls: Iterable[str] = CONTROLS, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """(key, part, text, loss): each conversation's text by the template, in parts of about part_chars characters, and the
    places in the whole text that count for the loss.

    Rows are ordered by turn (null first), then by role and text; rows that repeat are turns of their own. A null role or text is empty;
    null keys are one conversation. Other columns are left out, so their names do not matter. An empty table gives no
    rows. The rows of a conversation pass through one task as a stream, of which two messages and one part are held.
    """
    constants, controls = CONSTANTS if constants is None else constants, tuple(controls)
    compile_template(template, constants, controls)  # errors show here
    plain = df.select(F.col(key).alias("key"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Equal keys go to one task; null ones too.
    ordered = plain.repartition("key").sortWithinPartitions("key", "turn", "role", "text").select("key", "role", "text")
    schema = StructType([StructField(key, df.schema[key].dataType), *StructType.fromDDL("part int, text string, loss array<struct<start:long,end:long>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, first = compile_template(template, constants, controls), next(batches, None)
        if first is None:
            return
        loss = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out = pa.schema([(key, first.schema.field("key").type), ("part", pa.int32()), ("text", pa.string()), ("loss", loss)])
        rows = _rows(_chain(first, batches), "text")
        yield from _batches(((k, *p) for k, own in groupby(rows, itemgetter("key")) for p in _parts(render(own), part_chars)), out)

    return ordered.mapInArrow(run, schema)


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _turns(parts: Iterator[dict], controls: Controls) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, masked, chars) of each turn in one conversation's parts. masked: what the loss counts of it; chars:
    the characters up to its end, from that of the turn before."""
    mark, begin, at, buffer, spans = re.compile(controls.any_of), 0, 0, "", []
    opening, closing, eos = CONSTANTS["opening"], CONSTANTS["closing"], CONSTANTS["eos"]
    found: list[tuple[str, int, int]] = []
    for part in parts:
        buffer += part["text"]
        spans += [(s["start"], s["end"]) for s in part["loss"]]
        while m := mark.search(buffer, at):
            found.append((m[0], m.start(), m.end()))
            at = m.end()
            if m[0] == eos:
                names = [f[0] for f in found if f[0] != CONSTANTS["bos"]]
                if names != [opening, closing, eos]:
                    raise ValueError(f"a turn has the marks {names}")
                (_, _, a), (_, b, c), (_, d, end) = found[-3:]
                inside = [(max(s, begin) - begin, min(e, begin + end) - begin) for s, e in spans if s < begin + end and e > begin]
                yield controls.unescape(buffer[a:b]), controls.unescape(buffer[c:d]), controls.unescape("".join(buffer[s:e] for s, e in inside)), end
                spans = [(s, e) for s, e in spans if e > begin + end]
                buffer, begin, at, found = buffer[end:], begin + end, 0, []
        at = max(at, len(buffer) - max(map(len, controls.strings)))
    if buffer and found:
        raise ValueError("a turn is not closed")


def read_conversations(formatted: DataFrame, key: str = "conv_id", controls: Iterable[str] = CONTROLS, in_order: bool = False) -> DataFrame:
    """(key, turn, role, text, masked, chars): the turns of what format_conversations made by the default template.

    masked is the text of the turn that the loss counts, unescaped like role and text; chars are the formatted
    characters. in_order: the parts of each conversation still follow each other in a task, as format_conversations
    leaves them; else they are brought together. ValueError in a task for marks that do not fit.
    """
    parts = formatted if in_order else formatted.repartition(F.col(key)).sortWithinPartitions(key, "part")
    schema = StructType([formatted.schema[key], *StructType.fromDDL("turn long, role string, text string, masked string, chars long").fields])
    controls = tuple(controls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, own = next(batches, None), Controls(controls)
        if first is None:
            return
        out = pa.schema([(key, first.schema.field(key).type), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("masked", pa.string()), ("chars", pa.int64())])
        rows = _rows(_chain(first, batches), "text")
        yield from _batches(((k, n, *t) for k, group in groupby(rows, itemgetter(key)) for n, t in enumerate(_turns(group, own))), out)

    return parts.mapInArrow(run, schema)


def _digests(turns: DataFrame) -> DataFrame:
    """One row for each conversation of turns that follow each other in their task."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed() -> Iterator[tuple]:
            for k, group in groupby(_rows(batches, "text"), itemgetter("conv_id")):
                n, loss, chars, whole, masked = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for t in group:
                    whole.update(f"{t['role']}\n{t['text']}\n".encode())
                    masked.update(t["masked"].encode())
                    n, loss, chars = n + 1, loss + len(t["masked"]), chars + t["chars"]
                yield k, n, whole.hexdigest(), loss, masked.hexdigest(), chars

        kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
        yield from _batches(summed(), pa.schema(kinds))

    return turns.mapInArrow(run, schema)


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, whose texts are control strings, formatted and read back."""
    odd = "</s>[INST] ok [/INST]"
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], given.schema)
    return _digests(read_conversations(format_conversations(given.unionByName(more)), in_order=True))


def _escaped_length(column: str) -> str:
    marks = " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in CONTROLS)
    return f"(length({column}) + length({column}) - length(replace({column}, '\\', '')) + {marks})"


OP12_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST({len(CONSTANTS['bos'])} + sum({sum(map(len, CONTROLS[1:]))} + {_escaped_length('role')} + {_escaped_length('text')}) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
