"""Chat formatting by a template compiler.

A sandboxed template language is parsed into a syntax tree, constants are folded, and the tree is
turned into Python closures that yield the pieces of a rendered conversation one by one:

    {{ expression }}   {# remark #}
    {% for m in messages %} ... {% endfor %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = e %}
    {% generation %} ... {% endgeneration %}      marks what a model learns to write

Expressions have literals, names, `m.field`, `==`, `!=`, `and`, `or`, `not`, `+`, parentheses
and `| filter`. Names resolve only to the variables given and set; there are no calls,
attributes, imports or loops but over `messages`, so a template can reach nothing else and ends.

Control strings inside texts are escaped: behind their first character a backslash is added, in
front of any that already stand there. So no text holds a control string verbatim, and removing
one backslash restores it.

Results for odd input: a null text or role is empty; turns are taken in order of turn (null
first), then role, then text; repeated rows are repeated turns; an empty table gives no rows;
other columns are not read. A conversation streams through in parts, so its length is not bound
by memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings with which formats of this kind mark turns.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>")

CHATML = (
    "{% for m in messages %}{{ '<|im_start|>' + (m.role | name) + '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|im_end|>' + '\\n' }}{% endfor %}"
)

_ESCAPE = re.compile("|".join(f"({re.escape(c[0])})(\\\\*)(?={re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile("|".join(f"({re.escape(c[0])})\\\\(\\\\*)(?={re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    """The text with every control string in it broken."""
    return _ESCAPE.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    """What escape() was given."""
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


def escape_name(role: str) -> str:
    """A role on one line: line ends and backslashes are written out, control strings broken."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_name(name: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(name))


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "name": escape_name, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template is not of the language."""


# --- syntax tree -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    id: str


@dataclass(frozen=True)
class Field:
    of: object
    field: str


@dataclass(frozen=True)
class Op:
    sign: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    of: object
    name: str


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class If:
    arms: tuple  # (condition, body)
    rest: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKENS = re.compile(r"\s*(?:('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+|().]))")
_WRITTEN = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class _Expression:
    """Recursive descent: or, and, not, comparison, +, filter, field, atom."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append(next((i, g) for i, g in enumerate(m.groups()) if g is not None))
            at = m.end()
        self.at = 0

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] >= 2 and self.tokens[self.at][1] in wanted

    def take(self):
        if self.at == len(self.tokens):
            raise TemplateError("the expression ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        e = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return e

    def _chain(self, below, *signs):
        e = below()
        while self.peek(*signs):
            e = Op(self.take()[1], (e, below()))
        return e

    def either(self):
        return self._chain(self.both, "or")

    def both(self):
        return self._chain(self.negated, "and")

    def negated(self):
        if self.peek("not"):
            self.take()
            return Op("not", (self.negated(),))
        return self._chain(self.sum, "==", "!=")

    def sum(self):
        return self._chain(self.filtered, "+")

    def filtered(self):
        e = self.atom()
        while self.peek("|", "."):
            sign, (kind, word) = self.take()[1], self.take()
            if kind != 2 or sign == "|" and word not in FILTERS or word.startswith("_"):
                raise TemplateError(f"no such filter or field: {word}")
            e = Filter(e, word) if sign == "|" else Field(e, word)
        return e

    def atom(self):
        kind, word = self.take()
        if kind == 0:
            return Const(re.sub(r"\\(.)", lambda m: _WRITTEN.get(m[1], m[0]), word[1:-1]))
        if kind == 1:
            return Const(int(word))
        if word == "(":
            e = self.either()
            if self.take()[1] != ")":
                raise TemplateError("a bracket stays open")
            return e
        if kind != 2 or word in ("and", "or", "not"):
            raise TemplateError(f"unexpected {word!r}")
        return Const(word == "true") if word in ("true", "false") else Name(word)


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces, at = [], 0
    for m in _TAGS.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()]))
        if m[1] is not None:
            pieces.append(("out", m[1]))
        elif m[2] is not None:
            pieces.append(("tag", m[2].strip().strip("-").strip()))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    body, end, at = _body(pieces, 0)
    if end:
        raise TemplateError(f"unexpected {end}")
    return body


def _body(pieces: list, at: int) -> tuple[tuple, str, int]:
    nodes: list = []
    while at < len(pieces):
        kind, text = pieces[at]
        at += 1
        word, _, rest = text.partition(" ") if kind == "tag" else ("", "", "")
        if kind == "text":
            nodes.append(Out(Const(text)))
        elif kind == "out":
            nodes.append(Out(_Expression(text).whole()))
        elif word in ("endfor", "endif", "elif", "else", "endgeneration"):
            return tuple(nodes), text, at
        elif word == "for":
            m = re.fullmatch(r"([A-Za-z]\w*) in messages", rest.strip())
            if not m:
                raise TemplateError("loops run over messages only")
            body, end, at = _body(pieces, at)
            _must(end, "endfor")
            nodes.append(For(m[1], body))
        elif word == "generation":
            body, end, at = _body(pieces, at)
            _must(end, "endgeneration")
            nodes.append(Generation(body))
        elif word == "set":
            name, _, value = rest.partition("=")
            if not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                raise TemplateError(f"can't set {name!r}")
            nodes.append(Set(name.strip(), _Expression(value).whole()))
        elif word == "if":
            arms, rest_body, condition = [], (), rest
            while True:
                body, end, at = _body(pieces, at)
                arms.append((_Expression(condition).whole(), body))
                if end.startswith("elif "):
                    condition = end[5:]
                    continue
                if end == "else":
                    rest_body, end, at = _body(pieces, at)
                _must(end, "endif")
                break
            nodes.append(If(tuple(arms), rest_body))
        else:
            raise TemplateError(f"unknown tag {text!r}")
    return tuple(nodes), "", at


def _must(end: str, wanted: str) -> None:
    if end != wanted:
        raise TemplateError(f"expected {wanted}, found {end or 'the end'}")


_OPS: dict[str, Callable] = {"+": lambda a, b: a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a}


def fold(node):
    """The tree with constant expressions evaluated, decided branches taken and adjacent text joined."""
    if isinstance(node, tuple):
        out: list = []
        for n in map(fold, node):
            for x in n if isinstance(n, tuple) else (n,):
                if out and isinstance(x, Out) and isinstance(x.value, Const) and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                    out[-1] = Out(Const(f"{out[-1].value.value}{x.value.value}"))
                else:
                    out.append(x)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        return Const(_OPS[node.sign](*(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Op(node.sign, args)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](str(of.value))) if isinstance(of, Const) else Filter(of, node.name)
    if isinstance(node, Field):
        return Field(fold(node.of), node.field)
    if isinstance(node, Out):
        return Out(fold(node.value))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        arms, rest = [], fold(node.rest)
        for condition, body in node.arms:
            c = fold(condition)
            if isinstance(c, Const):
                if c.value:
                    rest = fold(body)
                    break
                continue
            arms.append((c, fold(body)))
        return If(tuple(arms), rest) if arms else rest
    return node


# --- closures ----------------------------------------------------------------------------------

Piece = tuple[str, bool]


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):

        def name(scope, key=node.id):
            if key not in scope:
                raise TemplateError(f"{key} is not defined")
            return scope[key]

        return name
    if isinstance(node, Field):
        of = _value(node.of)

        def field(scope, key=node.field):
            v = of(scope)
            if not isinstance(v, dict) or key not in v:
                raise TemplateError(f"no field {key}")
            return v[key]

        return field
    if isinstance(node, Filter):
        of, apply = _value(node.of), FILTERS[node.name]
        return lambda scope: apply(str(of(scope)))
    args, op = [_value(a) for a in node.args], _OPS[node.sign]
    if node.sign in ("and", "or"):
        a, b = args
        return (lambda scope: a(scope) and b(scope)) if node.sign == "and" else (lambda scope: a(scope) or b(scope))
    return lambda scope: op(*(a(scope) for a in args))


def _emit(node) -> Callable[[dict, bool], Iterator[Piece]]:
    if isinstance(node, tuple):
        parts = [_emit(n) for n in node]

        def block(scope, learnt):
            for p in parts:
                yield from p(scope, learnt)

        return block
    if isinstance(node, Out):
        value = _value(node.value)

        def out(scope, learnt):
            yield str(value(scope)), learnt

        return out
    if isinstance(node, Set):
        value = _value(node.value)

        def put(scope, learnt, name=node.name):
            scope[name] = value(scope)
            yield from ()

        return put
    if isinstance(node, For):
        body = _emit(node.body)

        def loop(scope, learnt, name=node.name):
            for m in scope["messages"]:
                scope[name] = m
                yield from body(scope, learnt)

        return loop
    if isinstance(node, Generation):
        body = _emit(node.body)
        return lambda scope, learnt: body(scope, True)
    arms, rest = [(_value(c), _emit(b)) for c, b in node.arms], _emit(node.rest)

    def choose(scope, learnt):
        yield from next((b for c, b in arms if c(scope)), rest)(scope, learnt)

    return choose


def compile_template(source: str) -> Callable[..., Iterator[Piece]]:
    """render(messages, **variables): pieces (text, learnt). messages may be any iterable of dicts, read once."""
    run = _emit(fold(parse(source)))
    return lambda messages, **variables: run({**variables, "messages": messages}, False)


# --- DataFrame operator ------------------------------------------------------------------------

#: Characters after which a part of a formatted conversation is closed, at the next piece's end.
PART_CHARS = 1 << 20


def format_conversations(turns: DataFrame, template: str = CHATML) -> DataFrame:
    """Rows (conv_id, part, text, spans): formatted conversations, cut into parts of about PART_CHARS.

    spans holds [start, end) within text of what a model learns to write. The parts of one
    conversation lie one after the other in one partition.
    """
    compile_template(template)  # complains early
    work = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = work.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches):
        render = compile_template(template)
        rows = _Rows(batches)
        held: list[dict] = []
        size = 0
        for conv_id in rows.groups():
            for part, (text, spans) in enumerate(_parts(render(rows.of(conv_id)))):
                held.append({"conv_id": conv_id, "part": part, "text": text, "spans": [{"start": a, "end": b} for a, b in spans]})
                size += len(text)
                if size > PART_CHARS or len(held) >= 1000:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return dealt.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, part long, text string, spans array<struct<start:int,end:int>>")


class _Rows:
    """Sorted rows of record batches as one stream, read conversation by conversation."""

    def __init__(self, batches: Iterable[pa.RecordBatch]):
        self.stream = (r for b in batches for at in range(0, b.num_rows, 512) for r in b.slice(at, 512).to_pylist())
        self.next = next(self.stream, None)

    def groups(self):
        while self.next is not None:
            conv_id = self.next["conv_id"]
            yield conv_id
            while self.next is not None and self.next["conv_id"] == conv_id:  # a template may read only some
                self.next = next(self.stream, None)

    def of(self, conv_id):
        while self.next is not None and self.next["conv_id"] == conv_id:
            row = self.next
            self.next = next(self.stream, None)
            yield row


def _parts(pieces: Iterable[Piece]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    texts: list[str] = []
    spans: list[tuple[int, int]] = []
    size, any_yet = 0, False
    for text, learnt in pieces:
        if learnt and text:
            if spans and spans[-1][1] == size:
                spans[-1] = spans[-1][0], size + len(text)
            else:
                spans.append((size, size + len(text)))
        texts.append(text)
        size += len(text)
        if size >= PART_CHARS:
            yield "".join(texts), spans
            texts, spans, size, any_yet = [], [], 0, True
    if texts or not any_yet:
        yield "".join(texts), spans


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation, from parts of the CHATML template alone: turns and learnt text, unescaped, as digests.

    Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars). Streams: only
    the open turn and open span are held.
    """

    def run(batches):
        state = None
        out: list[dict] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if row["part"] == 0:
                        if state:
                            out.append(state.row())
                        state = _Reader(row["conv_id"])
                    state.feed(row["text"], row["spans"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_READ)
                out = []
        if state:
            yield pa.RecordBatch.from_pylist([state.row()], schema=_READ)

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


class _Reader:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss = conv_id, 0, 0, 0
        self.open = ""
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, spans: list[dict]) -> None:
        self.chars += len(text)
        for s in spans:
            learnt = unescape(text[s["start"] : s["end"]])
            self.loss += len(learnt)
            self.loss_sha.update(learnt.encode("utf-8", "surrogatepass"))
        self.open, end = self.open + text, 0
        for m in _TURN.finditer(self.open):
            if m.start() != end:
                raise ValueError(f"conversation {self.conv_id} holds text outside its turns")
            self.turns += 1
            self.turns_sha.update(f"{unescape_name(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            end = m.end()
        self.open = self.open[end:]

    def row(self) -> dict:
        if self.open:
            raise ValueError(f"conversation {self.conv_id} ends within a turn")
        return {"conv_id": self.conv_id, "n_turns": self.turns, "turns_sha256": self.turns_sha.hexdigest(), "loss_chars": self.loss, "loss_sha256": self.loss_sha.hexdigest(), "formatted_chars": self.chars}
