"""Chat templates: parsed, folded, compiled to Python closures.

Language (a sandboxed subset of the usual template syntax): text, `{{ expr }}`, `{# note #}`, `{% if %}/{% elif %}/{% else %}/
{% endif %}`, `{% for x in expr %}/{% endfor %}` with `loop.index0`, `loop.index`, `loop.first`, `loop.last`, `{% set x = expr %}`
and `{% generation %}/{% endgeneration %}`, which marks what the loss covers. A `-` inside a delimiter strips white space on its
side. Expressions: strings, whole numbers, true, false, none, names, `x.key`, `x['key']`, `+`, `~`, `%`, `==`, `!=`, `<`, `>`,
`<=`, `>=`, `in`, `and`, `or`, `not`, parentheses and filters `x | f`. Names reach only the conversation's own values; keys only
look into dictionaries and lists; there are no calls besides FILTERS, so a template can't reach Python. Constant
subexpressions and conditions are folded while compiling.

`format_conversations` renders each conversation's rows ordered by turn, nulls first (ties by role, then text). Null texts and
roles are empty. Each conversation id, null included, is one conversation; repeated rows are turns of their own. An empty table
gives an empty result; other columns are ignored. Rows stream through a task in sorted order; it holds one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

#: Strings that mark turns; inside texts they are escaped.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
ESCAPE = "\\"
TEMPLATE = """<s>
{%- for m in messages -%}
    {%- if m.role == 'user' -%}
        {{ '[INST] ' + (m.text | escape) + ' [/INST]' }}
    {%- elif m.role == 'assistant' -%}
        {{ ' ' }}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '</s>' }}
    {%- else -%}
        {{ '[ROLE]' ~ (m.role | escape) ~ '[/ROLE]' ~ (m.text | escape) ~ '</s>' }}
    {%- endif -%}
{%- endfor -%}
"""
_SPECIAL = re.compile("|".join(re.escape(x) for x in (ESCAPE, *CONTROL)))
_ESCAPED = re.compile(re.escape(ESCAPE) + "(" + "|".join(re.escape(x) for x in (ESCAPE, *CONTROL)) + ")")


class TemplateError(ValueError):
    """A template that doesn't parse, or reaches beyond its sandbox."""


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


FILTERS: dict[str, Callable[[Any], Any]] = {"escape": lambda x: escape(str(x)), "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len, "string": str}
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~%<>|.()\[\]]))")
_BLOCK = re.compile(r"\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\}", re.S)
_ESC = {"n": "\n", "t": "\t", "r": "\r"}
_CONST = {"true": True, "false": False, "none": None}
_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "%": lambda a, b: a % b, "~": lambda a, b: _text(a) + _text(b),
}


def _text(x: Any) -> str:
    return "" if x is None else str(x)


# Syntax tree: ("const", v) ("name", n) ("key", tree, tree) ("bin", op, a, b) ("and"/"or", a, b) ("not", a) ("filter", f, a)
def expression(source: str) -> tuple:
    tokens, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:][:30]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    pos = 0

    def peek(*values: str) -> bool:
        return tokens[pos][0] in ("op", "name") and tokens[pos][1] in values

    def take() -> str:
        nonlocal pos
        pos += 1
        return tokens[pos - 1][1]

    def need(value: str) -> None:
        if take() != value:
            raise TemplateError(f"{value!r} is missing in {source!r}")

    def either() -> tuple:
        a = both()
        while peek("or"):
            take()
            a = ("or", a, both())
        return a

    def both() -> tuple:
        a = negated()
        while peek("and"):
            take()
            a = ("and", a, negated())
        return a

    def negated() -> tuple:
        if peek("not"):
            take()
            return ("not", negated())
        a = added()
        while peek("==", "!=", "<", ">", "<=", ">=", "in"):
            a = ("bin", take(), a, added())
        return a

    def added() -> tuple:
        a = modulo()
        while peek("+", "~"):
            a = ("bin", take(), a, modulo())
        return a

    def modulo() -> tuple:
        a = primary()
        while peek("%"):
            take()
            a = ("bin", "%", a, primary())
        return a

    def primary() -> tuple:
        kind, value = tokens[pos]
        if kind == "end":
            raise TemplateError(f"{source!r} ends too early")
        take()
        if kind == "str":
            a = ("const", re.sub(r"\\(.)", lambda m: _ESC.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "int":
            a = ("const", int(value))
        elif kind == "name":
            a = ("const", _CONST[value]) if value in _CONST else ("name", value)
        elif value == "(":
            a = either()
            need(")")
        else:
            raise TemplateError(f"{value!r} isn't expected in {source!r}")
        while peek(".", "[", "|"):
            op = take()
            if op == ".":
                a = ("key", a, ("const", take()))
            elif op == "[":
                a = ("key", a, either())
                need("]")
            else:
                name = take()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                a = ("filter", name, a)
        if peek("("):
            raise TemplateError(f"calls aren't allowed: {source!r}")
        return a

    tree = either()
    if tokens[pos][0] != "end":
        raise TemplateError(f"{tokens[pos][1]!r} isn't expected in {source!r}")
    return tree


def fold(t: tuple) -> tuple:
    """The tree with its constant parts evaluated."""
    kind, *args = t
    args = [fold(x) if isinstance(x, tuple) else x for x in args]
    parts = [x for x in args if isinstance(x, tuple)]
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if kind != "const" and kind != "name" and all(x[0] == "const" for x in parts):
        try:
            return ("const", evaluator((kind, *args))({}))
        except Exception as e:
            raise TemplateError(f"{e} in a constant expression") from e
    return (kind, *args)


def _key(a: Any, k: Any) -> Any:
    if isinstance(a, dict):
        return a.get(k)
    if isinstance(a, (list, str)) and isinstance(k, int):
        return a[k] if -len(a) <= k < len(a) else None
    raise TemplateError(f"{k!r} isn't a key of a value of the conversation")


def evaluator(t: tuple) -> Callable[[dict], Any]:
    kind, *args = t
    if kind == "const":
        return lambda scope, v=args[0]: v
    if kind == "name":
        return lambda scope, n=args[0]: scope.get(n)
    parts = [evaluator(x) for x in args if isinstance(x, tuple)]
    if kind == "not":
        return lambda scope, a=parts[0]: not a(scope)
    if kind == "filter":
        return lambda scope, f=FILTERS[args[0]], a=parts[0]: f(a(scope))
    a, b = parts
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    if kind == "key":
        return lambda scope: _key(a(scope), b(scope))
    return lambda scope, f=_BINARY[args[0]]: f(a(scope), b(scope))


# Statements: ("text", s) ("out", tree) ("if", [(tree, body)], body) ("for", name, tree, body) ("set", name, tree) ("gen", body)
def parse(source: str) -> list[tuple]:
    pieces: list[tuple[str, str]] = []
    at = 0
    for m in _BLOCK.finditer(source):
        pieces += [("text", source[at : m.start()]), (m[0][:2], m[0])]
        at = m.end()
    pieces.append(("text", source[at:]))
    for i in range(1, len(pieces), 2):
        tag = pieces[i][1]
        if tag[2] == "-":
            pieces[i - 1] = ("text", pieces[i - 1][1].rstrip())
        if tag[-3] == "-":
            pieces[i + 1] = ("text", pieces[i + 1][1].lstrip())
    pos = 0

    def body(*ends: str) -> tuple[list[tuple], str, str]:
        nonlocal pos
        out: list[tuple] = []
        while pos < len(pieces):
            kind, raw = pieces[pos]
            pos += 1
            inner = raw[2:-2].strip("-").strip() if kind != "text" else ""
            if kind == "text":
                if "{%" in raw or "{{" in raw:
                    raise TemplateError(f"a tag isn't closed: {raw[:40]!r}")
                if raw:
                    out.append(("text", raw))
            elif kind == "{{":
                tree = fold(expression(inner))
                out.append(("text", _text(tree[1])) if tree[0] == "const" else ("out", tree))
            elif kind == "{%":
                word, _, rest = inner.partition(" ")
                if word in ends:
                    return out, word, rest
                out += statement(word, rest)
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, "", ""

    def statement(word: str, rest: str) -> list[tuple]:
        if word == "if":
            arms, other, end = [], [], "elif"
            while end == "elif":
                test = fold(expression(rest))
                inside, end, rest = body("elif", "else", "endif")
                arms.append((test, inside))
            if end == "else":
                other, _, _ = body("endif")
            live = []
            for test, inside in arms:  # arms that can't be taken go
                if test[0] == "const" and test[1]:
                    other = inside
                    break
                if test[0] != "const":
                    live.append((test, inside))
            return [("if", live, other)] if live else other
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"for {rest}")
            inside, _, _ = body("endfor")
            return [("for", m[1], fold(expression(m[2])), inside)]
        if word == "set":
            name, _, value = rest.partition("=")
            return [("set", name.strip(), fold(expression(value)))]
        if word == "generation":
            inside, _, _ = body("endgeneration")
            return [("gen", inside)]
        raise TemplateError(f"no statement {word!r}")

    out, _, _ = body()
    merged: list[tuple] = []
    for s in out:
        if s[0] == "text" and merged and merged[-1][0] == "text":
            s = ("text", merged.pop()[1] + s[1])
        merged.append(s)
    return merged


class Sink:
    """Rendered text, and the spans of it that were generated."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, s: str) -> None:
        self.parts.append(s)
        self.size += len(s)


def runner(body: list[tuple]) -> Callable[[dict, Sink], None]:
    steps = [_step(s) for s in body]

    def run(scope: dict, sink: Sink) -> None:
        for s in steps:
            s(scope, sink)

    return run


def _step(s: tuple) -> Callable[[dict, Sink], None]:
    kind, *args = s
    if kind == "text":
        return lambda scope, sink: sink.put(args[0])
    if kind == "out":
        value = evaluator(args[0])
        return lambda scope, sink: sink.put(_text(value(scope)))
    if kind == "set":
        value = evaluator(args[1])
        return lambda scope, sink: scope.__setitem__(args[0], value(scope))
    if kind == "gen":
        inside = runner(args[0])

        def generation(scope: dict, sink: Sink) -> None:
            start = sink.size
            inside(scope, sink)
            sink.spans.append((start, sink.size))

        return generation
    if kind == "if":
        arms, other = [(evaluator(t), runner(b)) for t, b in args[0]], runner(args[1])

        def branch(scope: dict, sink: Sink) -> None:
            for test, inside in arms:
                if test(scope):
                    return inside(scope, sink)
            return other(scope, sink)

        return branch
    name, items, inside = args[0], evaluator(args[1]), runner(args[2])

    def loop(scope: dict, sink: Sink) -> None:
        rows = items(scope) or []
        if not isinstance(rows, list):
            raise TemplateError("for goes over lists only")
        inner = dict(scope)
        for i, x in enumerate(rows):
            inner[name] = x
            inner["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(rows) - 1}
            inside(inner, sink)

    return loop


def compiled(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages to (formatted text, spans under the loss mask, in code points)."""
    run = runner(parse(source))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        sink = Sink()
        run({"messages": messages}, sink)
        return "".join(sink.parts), sink.spans

    return render


FORMATTED = "conv_id long, formatted string, spans array<struct<start: long, end: long>>"


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, spans: one row per conversation."""
    compiled(template)  # fails here, not on an executor
    in_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        turns = (t for b in batches for t in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            ids, texts, spans = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], kind)], ["conv_id", "formatted", "spans"])

        for conv, group in groupby(turns, key=lambda t: t[0]):
            text, spans = render([{"role": r, "text": t, "turn": n} for _, n, r, t in group])
            out.append((conv, text, spans))
            size += len(text)
            if size > 4_000_000:
                yield batch()
                out, size = [], 0
        yield batch()

    df = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


_MARK = _SPECIAL


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from what TEMPLATE gave."""
    marks, at = [], 0
    while m := _MARK.search(formatted, at):
        if m[0] == ESCAPE:  # the escaped string after it is text
            n = _ESCAPED.match(formatted, m.start())
            at = n.end() if n else m.end()
        else:
            marks.append((m[0], m.start(), m.end()))
            at = m.end()
    if not marks or marks[0][:2] != ("<s>", 0):
        raise TemplateError("the text doesn't start with <s>")
    out, at, k = [], marks[0][2], 1
    while k < len(marks):
        mark, start, end = marks[k]
        if mark == "[INST]" and start == at:
            role, a, (closing, b, stop) = "user", end + 1, marks[k + 1]
            b, k = b - 1, k + 2
        elif mark == "</s>":
            role, a, closing, b, stop, k = "assistant", at + 1, "[/INST]", start, end, k + 1
        elif mark == "[ROLE]" and start == at:
            (_, b, a), (_, c, stop) = marks[k + 1 : k + 3]
            role, b, closing, k = unescape(formatted[end:b]), c, "[/INST]", k + 3
        else:
            raise TemplateError(f"{mark} isn't expected at {start}")
        if closing != "[/INST]":
            raise TemplateError(f"{closing} isn't expected")
        out.append((role, unescape(formatted[a:b])))
        at = stop
    if at != len(formatted):
        raise TemplateError("text after the last turn")
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation: counts and digests of the turns and of the text under the loss mask, from the output alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = turns_of(text)
                h = hashlib.sha256()
                for role, said in turns:
                    h.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), h.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
