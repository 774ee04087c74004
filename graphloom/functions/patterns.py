"""Named path patterns: `*`, `**`, `**/`, `?`, `[...]`, `[!...]` and `${*name}`, which captures and must repeat itself.

Patterns become Java regular expressions with one positional group per name, so that matching and captures run in the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_WILD = re.compile(r"(?P<deep>\*\*/?)|(?P<star>\*)|(?P<one>\?)|\$\{\*(?P<name>[^}]*)\}|\[(?P<set>[^\[\]]|[^\]$][^\]]*|\[)\]")


@dataclass
class Piece:
    """A literal or wildcard of a pattern; `single` matches within one path component and may stretch."""

    kind: str  # text, one, set, star, deep, folders, name, again
    text: str = ""
    sub: str = ""
    single: bool = False


@dataclass
class Pattern:
    source: str
    subs: dict[str, str] = field(default_factory=dict)
    pieces: list[Piece] = field(init=False)
    names: list[str] = field(init=False)

    def __post_init__(self) -> None:
        if not self.source:
            raise ValueError("a pattern can't be empty")
        self.pieces, self.names = [], []
        at = 0
        for m in _WILD.finditer(self.source):
            self._literal(self.source[at : m.start()])
            self._wild(m)
            at = m.end()
        self._literal(self.source[at:])

    def _literal(self, text: str) -> None:
        if text:
            self.pieces.append(Piece("text", text))

    def _wild(self, m: re.Match) -> None:
        name, last = m["name"], self.pieces[-1] if self.pieces else Piece("")
        if name is not None:
            if not re.fullmatch(r"\w+", name):
                raise ValueError(f"bad name in {self.source!r}")
            if name in self.names:
                self.pieces.append(Piece("again", name))
                return
            sub = self.subs.get(name, "*")
            if "${*" in sub:
                raise ValueError("names can't be nested")
            self.names.append(name)
            self.pieces.append(Piece("name", name, sub, sub == "*"))
            return
        if m["one"]:
            self.pieces.append(Piece("one"))
        elif m["set"]:
            self.pieces.append(Piece("set", m["set"]))
        elif m["star"]:
            if last.kind not in ("star", "deep"):
                self.pieces.append(Piece("star", single=True))
        else:
            kind = "folders" if m["deep"].endswith("/") else "deep"
            if last.kind == kind:
                return
            # a longer wildcard swallows the shorter one before it
            if last.kind == "star" or (kind == "folders" and last.kind == "deep"):
                self.pieces.pop()
            self.pieces.append(Piece(kind))

    def _bare(self) -> str:
        return "".join(self._emit(p, False) for p in self.pieces)

    def _emit(self, p: Piece, full: bool) -> str:
        many = "+" if full else "*"
        if p.kind == "text":
            return re.sub(r"([^\w/])", r"\\\1", p.text)
        if p.kind == "one":
            return "[^/]"
        if p.kind == "set":
            negated, inner = p.text.startswith("!"), p.text.removeprefix("!")
            return "[" + "^" * negated + re.sub(r"([\[\]&^\\])", r"\\\1", inner) + "]"
        if p.kind == "star":
            return f"[^/]{many}"
        if p.kind == "deep":
            return f".{many}"
        if p.kind == "folders":
            return "(?:.*/|)"
        if p.kind == "name":
            return f"([^/]{many})" if p.single else f"({Pattern(p.sub)._bare()})"
        return f"\\{self.names.index(p.text) + 1}"

    def regex(self) -> str:
        """A component made of one wildcard isn't empty; a last wildcard also matches a folder's closing slash."""
        out = []
        for k, p in enumerate(self.pieces):
            after_slash = k > 0 and self.pieces[k - 1].kind in ("text",) and self.pieces[k - 1].text.endswith("/")
            before_slash = k + 1 < len(self.pieces) and self.pieces[k + 1].kind == "text" and self.pieces[k + 1].text.startswith("/")
            last = k == len(self.pieces) - 1
            stretch = p.single or p.kind == "deep"
            full = after_slash and stretch and (before_slash or (last and p.single))
            out.append(self._emit(p, full) + ("/?" if last and p.single else ""))
        return "\\A(?:" + "".join(out) + ")\\z"

    def glob(self) -> str:
        """The plain glob that finds all candidates: names become their substitutes, runs of wildcards one `*`; `**` only
        stays where it is a whole component."""
        text = ""
        for k, p in enumerate(self.pieces):
            whole = not text or text.endswith("/")
            sub = self.subs.get(p.text, "*") if p.kind in ("name", "again") else "*"
            if p.kind in ("star", "deep", "name", "again"):
                if text.endswith("*"):
                    text = text.rstrip("*") + "*" + sub.lstrip("*")
                else:
                    text += "**" if p.kind == "deep" and whole and k == len(self.pieces) - 1 else sub
            elif p.kind == "folders":
                text = text + "**/" if whole else text.rstrip("*") + "*/"
            else:
                text += {"one": "?", "set": f"[{p.text}]"}.get(p.kind, p.text)
        return text

    def base(self) -> str:
        """The folder below which all matches lie."""
        head = self.pieces[0].text if self.pieces[0].kind == "text" else ""
        return head[: head.rfind("/") + 1] or "./"

    def matches(self, path: Column) -> Column:
        return path.rlike(self.regex())

    def captures(self, path: Column) -> Column:
        return F.array(*(F.regexp_extract(path, self.regex(), k + 1) for k in range(len(self.names)))).cast("array<string>")


def has_wildcard(text: Column) -> Column:
    return text.rlike(r"\*|\?|\[.+\]")


def wildcard_names(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$\{\*(\w+)\}"), F.lit(1))))


def has_anonymous(text: Column) -> Column:
    """Whether wildcards are left once the named ones are gone."""
    return has_wildcard(F.regexp_replace(text, r"\$\{\*\w+\}", ""))


def ends_recursive(text: Column) -> Column:
    """Whether the last component is `**`."""
    return text.rlike(r"(^|/)\*\*$")
