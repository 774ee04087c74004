"""Scalar functions: paths, resources, digests, text."""

from __future__ import annotations

import re
import shlex

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType


def resources(spec: Column) -> Column:
    """`cpu:4,gpu` as a map of whole numbers: 1 where no number is given, the last of equal names. An empty name, a number that
    isn't whole and a negative one are errors."""
    items = F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.transform(items, lambda x: F.struct(x.alias("item"), F.trim(F.split(x, ":", 2)[0]).alias("name"), F.trim(F.coalesce(F.try_element_at(F.split(x, ":", 2), F.lit(2)), F.lit(""))).alias("value")))
    last = F.filter(parts, lambda x, i: ~F.exists(F.slice(parts, i + 2, F.size(parts)), lambda y: y["name"] == x["name"]))

    def units(x: Column) -> Column:
        bad = F.when(x["name"] == "", "a resource has no name: ").when(~x["value"].rlike(r"^([+-]?[0-9]+)?$"), "not a whole number: ").when(x["value"].startswith("-") & ~x["value"].rlike("^-0+$"), "a negative number: ")
        return F.when(bad.isNotNull(), F.raise_error(F.concat(bad, x["item"])).cast("int")).otherwise(F.when(x["value"] == "", 1).otherwise(F.try_to_number(F.regexp_replace(x["value"], "^[+]", ""), F.lit("S9999999999")).cast("int")))

    # checked before equal names are dropped
    checked = F.transform(parts, units)
    return F.when(F.size(checked) >= 0, F.map_from_arrays(F.transform(last, lambda x: x["name"]), F.transform(last, units)))


def merged_resources(base: Column, override: Column) -> Column:
    """Both specifications as one text, by name; the second one wins."""
    a, b = (resources(F.coalesce(x, F.lit(""))) for x in (base, override))
    old = F.transform(F.map_keys(a), lambda k: F.concat(k, F.lit(":"), F.coalesce(F.try_element_at(b, k), a[k]).cast("string")))
    new = F.transform(F.filter(F.map_keys(b), lambda k: ~F.array_contains(F.map_keys(a), k)), lambda k: F.concat(k, F.lit(":"), b[k].cast("string")))
    return F.array_join(F.concat(old, new), ",")


def to_bool(text: Column) -> Column:
    """True or false, letters in either case; anything else is an error, null stays."""
    low = F.lower(text)
    wrong = F.raise_error(F.concat(F.lit("neither true nor false: "), text)).cast("boolean")
    return F.when(low.isin("1", "true", "yes", "y", "t"), True).when(low.isin("0", "false", "no", "n", "f"), False).when(text.isNotNull(), wrong)


def affixes(text: Column) -> tuple[Column, Column]:
    """'./' at the front and '/' at the end, each kept or ''."""
    return F.when(text.startswith("./"), "./").otherwise(""), F.when(text.endswith("/"), "/").otherwise("")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(100.0 * part / whole)


def step_digest(words: Column) -> Column:
    """A digest of ordered words that can't be confused by where one ends: each goes with its length."""
    return F.sha2(F.array_join(F.transform(words, lambda w: F.concat(F.length(w).cast("string"), F.lit(":"), w)), ""), 256)


_VARIABLE = re.compile(r"\$(?:(?P<escape>\$)|\{(?P<braced>\*?[A-Za-z_][A-Za-z_0-9]*)\}|(?P<bare>\*?[A-Za-z_][A-Za-z_0-9]*)|(?P<wrong>))")


def substituted(values: dict[str, str]) -> Column:
    """A pandas function: `$NAME` and `${NAME}` replaced by their values in one pass; `${*name}` stays, `$$` is a dollar. A name
    without a value, or a dollar without a name, is an error."""

    def one(m: re.Match) -> str:
        name = m["braced"] or m["bare"] or ""
        if m["escape"] or name.startswith("*"):
            return "$" if m["escape"] else "${" + name + "}"
        if name not in values:
            raise ValueError(f"no value for: {name}" if name else "a dollar without a name")
        return values[name]

    @F.pandas_udf(StringType())
    def replaced(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _VARIABLE.sub(one, t), na_action="ignore")

    return replaced


def names_used(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.replace(text, F.lit("$$"), F.lit("")), F.lit(r"\$\{?([A-Za-z_][A-Za-z_0-9]*)"), F.lit(1))))


# The control characters that have a letter of their own in the shell's $'...' quoting.
CONTROL = {"\a": "\\a", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\v": "\\v", "\f": "\\f", "\r": "\\r", "\x1b": "\\e"}
_MARKS = re.compile(r"[\x00-\x1f\x7f\\'\"]")


def shell_line(text: str) -> str:
    """A command on one line: control characters as $'...' escapes, between which the quotes around them close and open again."""
    out, done, quote, protected = [], 0, "", -1
    for m in _MARKS.finditer(text):
        c, at = m[0], m.start()
        if c in "'\"\\":
            if at == protected:
                continue
            if c == "\\":
                protected = at + 1 if quote != "'" else -1
            elif quote in ("", c):
                quote = c if not quote else ""
            continue
        out += [text[done:at], quote, "$'", CONTROL.get(c) or f"\\x{ord(c):02x}", "'", quote]
        done = at + 1
    return "".join([*out, text[done:]])


@F.pandas_udf(StringType())
def printable(s: pd.Series) -> pd.Series:
    """`shell_line` of each command."""
    return s.map(shell_line, na_action="ignore")


# A leading NAME=value of a command; the value is bare or in either kind of quotes.
_ASSIGNMENT = re.compile(r"""\s*([A-Za-z_][A-Za-z_0-9]*)=('[^']*'|"(?:[^"\\]|\\.)*"|[^'"\s]*)(?!\S)""")


def leading_variables(command: str) -> tuple[dict[str, str], str]:
    """The variables set in front of a command, and the command without them."""
    found, at = {}, 0
    while m := _ASSIGNMENT.match(command, at):
        try:
            words = shlex.split(m[2])
        except ValueError:
            break
        found[m[1]] = "".join(words[:1])
        at = m.end()
    return found, command[at:].lstrip()


@F.pandas_udf(StructType([StructField("env", MapType(StringType(), StringType())), StructField("command", StringType())]))
def split_variables(s: pd.Series) -> pd.DataFrame:
    """`leading_variables` of each command; env is null where there are none."""
    rows = [leading_variables(c) if c is not None else ({}, None) for c in s]
    return pd.DataFrame({"env": [e or None for e, _ in rows], "command": [c for _, c in rows]})


def short_digest(digest: Column) -> Column:
    """The first eight hexadecimal digits; (unset) for null, UNKNOWN for what couldn't be read ('u')."""
    return F.when(digest.isNull(), "(unset)").when(digest == "u", "UNKNOWN").otherwise(F.substring(digest, 1, 8))


def full_digest(digest: Column) -> Column:
    """Sixty-four hexadecimal digits in eight words."""
    return F.rtrim(F.regexp_replace(digest, "(.{8})", "$1 "))


def shown_value(value: Column) -> Column:
    """A variable's value for display."""
    return F.when(value.isNull(), "(unset)").otherwise(F.concat(F.lit("='"), value, F.lit("'")))


def shown_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def with_affixes(path: Column, leading: Column, trailing: Column) -> Column:
    """The path with './' in front or '/' behind, if given; one that has it already, or another affix, is an error."""
    wrong = (
        F.when(~leading.isin("", "./"), "the leading affix must be '' or './': ").when((leading != "") & path.rlike(r"^(/|\./)"), "a leading slash is there: ")
        .when(~trailing.isin("", "/"), "the trailing affix must be '' or '/': ").when((trailing != "") & path.endswith("/"), "a trailing slash is there: ")
    )
    return F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, path)).cast("string")).otherwise(F.concat(leading, path, trailing))


def translated(path: Column, workdir: Column) -> Column:
    """A path relative to a working directory as one relative to the root, normalised; absolute ones are only normalised."""
    return normal_path(F.when(path.startswith("/"), path).otherwise(F.concat(workdir, F.lit("/"), path)))


def out_path(path: Column, dest: Column, ext: str | None, others: tuple[str, ...] = ()) -> Column:
    """Where the product of a path goes: beside it (dest null), into a folder (dest ends in '/') or to dest itself, with the
    extension `ext`. The path itself, or another extension, is an error."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")
    new = name if ext is None else F.concat(stem, F.lit(ext))
    folder = F.when(dest.isNull(), F.regexp_extract(path, "^(.*/)", 1)).when(dest == "./", "").when(dest.endswith("/"), dest)
    out = F.when(folder.isNotNull(), F.concat(folder, new)).otherwise(dest)
    wrong = F.when(out == path, "the product would be the path itself: ")
    if ext is not None:
        wrong = wrong.when(~F.regexp_extract(out, r"(?<=[^./])(\.[^./]*)$", 1).isin(ext, *others), "another extension: ")
    return F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, out)).cast("string")).otherwise(out)


def truncated(limit: int, mark: str = "\n[truncated]") -> Column:
    """A pandas function: text cut to `limit` UTF-8 bytes at a character, with a mark."""

    @F.pandas_udf(StringType())
    def cut(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            b = t.encode() if t is not None else b""
            return t if len(b) <= limit else b[:limit].decode(errors="ignore") + mark

        return s.map(one, na_action="ignore")

    return cut


@F.pandas_udf(StringType())
def normal_path(s: pd.Series) -> pd.Series:
    """Paths without '.', '..' and repeated slashes; a closing slash is kept."""
    import posixpath

    return s.map(lambda p: posixpath.normpath(p) + ("/" if p.endswith("/") and posixpath.normpath(p) != "/" else ""), na_action="ignore")
