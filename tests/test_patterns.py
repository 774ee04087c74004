import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions.patterns import Pattern, wildcard_names
from graphloom.operators.relational import glob_regex


@pytest.mark.parametrize(
    ("pattern", "subs", "yes", "no"),
    [
        ("*.txt", {}, ["a.txt", ".txt"], ["a.pdf", "d/a.txt"]),
        ("data/*/x", {}, ["data/a/x"], ["data//x", "data/a/b/x"]),
        ("data/${*n}/x", {}, ["data/a/x"], ["data//x"]),
        ("data/*", {}, ["data/a", "data/a/"], ["data/", "data/a/b"]),
        ("a/**", {}, ["a/", "a/b/c"], ["b"]),
        ("**/x.md", {}, ["x.md", "a/b/x.md"], ["ax.md"]),
        ("d/**/${*n}.txt", {}, ["d/q.txt", "d/e/f/q.txt"], ["dq.txt"]),
        ("${*n}/${*n}.c", {}, ["ab/ab.c"], ["ab/ac.c"]),
        ("${*_1}-${*_1}", {"_1": "[ab]?"}, ["ax-ax", "b1-b1"], ["ax-ay", "cx-cx"]),
        ("x[!0-9].y", {}, ["xa.y"], ["x1.y", "xay"]),
        ("x[?]y", {}, ["x?y"], ["xay"]),
        ("a+b(c)$", {}, ["a+b(c)$"], ["aab(c)$"]),
    ],
)
def test_patterns_match(spark, pattern, subs, yes, no):
    p = Pattern(pattern, subs)
    df = spark.createDataFrame([(x,) for x in yes + no], "path string")
    assert sorted(r.path for r in df.filter(p.matches(F.col("path"))).collect()) == sorted(yes)


def test_captures(spark):
    p = Pattern("src/${*a}/${*b}-${*a}.o")
    df = spark.createDataFrame([("src/x/y-x.o",)], "path string")
    assert df.select(p.captures(F.col("path"))).first()[0] == ["x", "y"]
    assert df.select(wildcard_names(F.lit(p.source))).first()[0] == ["a", "b"]
    assert p.base() == "src/" and Pattern("*.c").base() == "./"


@pytest.mark.parametrize(
    ("pattern", "glob"),
    [
        ("in/${*part}.csv", "in/*.csv"),  # a name is a star
        ("${*a}${*b}/x", "*/x"),  # neighbours merge
        ("log?.${*day}", "log?.*"),
        ("**/${*stem}[ab].h", "**/*[ab].h"),  # folders stay recursive where they are a component
        ("lib**/z", "lib*/z"),  # and else become a star
        ("top/**", "top/**"),
        ("plain.txt", "plain.txt"),
    ],
)
def test_globs(pattern, glob):
    assert Pattern(pattern).glob() == glob


def test_a_glob_finds_all_that_its_pattern_matches(spark):
    """The glob may find more, never less."""
    paths = ["in/a.csv", "in/.csv", "in/b/c.csv", "in/b/cb.h", "cb.h", "lib/z", "libs/z", "top/", "top/a/b", "log1.mon", "log.mon"]
    df = spark.createDataFrame([(x,) for x in paths], "path string")
    for pattern in ("in/${*part}.csv", "log?.${*day}", "lib*/z", "top/**"):
        p = Pattern(pattern)
        exact = {r.path for r in df.filter(p.matches(F.col("path"))).collect()}
        assert exact <= {r.path for r in df.filter(F.col("path").rlike(glob_regex(p.glob()))).collect()} and exact


@pytest.mark.parametrize("bad", ["", "${*}", "${*a b}"])
def test_bad_patterns(bad):
    with pytest.raises(ValueError):
        Pattern(bad)


def test_search_globs(spark):
    df = spark.createDataFrame([("ab.c",), ("a/b[x",), ("aXb",)], "s string")
    match = lambda g: [r.s for r in df.filter(F.col("s").rlike(glob_regex(g))).collect()]
    assert match("a*") == ["ab.c", "a/b[x", "aXb"] and match("a?b") == ["aXb"] and match("*[[]x") == ["a/b[x"] and match("a[^/]*") == ["ab.c", "aXb"]


def test_wildcard_kinds(spark):
    from graphloom.functions.patterns import ends_recursive, has_anonymous

    df = spark.createDataFrame([(x,) for x in ("a/**", "**", "**/a", "a/b**", "${*x}", "${*x}/*", "x[ab]", "plain")], "s string")
    got = {r.s: (r.anonymous, r.recursive) for r in df.select("s", has_anonymous(F.col("s")).alias("anonymous"), ends_recursive(F.col("s")).alias("recursive")).collect()}
    assert got == {"a/**": (True, True), "**": (True, True), "**/a": (True, False), "a/b**": (True, False), "${*x}": (False, False), "${*x}/*": (True, False), "x[ab]": (True, False), "plain": (False, False)}


def first(spark, column):
    return spark.range(1).select(column).first()[0]


def test_resources(spark):
    assert first(spark, T.resources(F.lit("cpu:4, gpu"))) == {"cpu": 4, "gpu": 1}
    assert first(spark, T.resources(F.lit(" cpu: 2 ,,mem:,cpu:+3,"))) == {"mem": 1, "cpu": 3}
    assert first(spark, T.resources(F.lit(""))) == {}
    for bad in (":4", "cpu:-1", "cpu:x", "cpu:1.5", "a:b:c", "cpu:-1,cpu:2"):
        with pytest.raises(Exception, match="resource|number"):
            first(spark, T.resources(F.lit(bad)))
    assert first(spark, T.merged_resources(F.lit("a:1,b:2"), F.lit("c,b:5"))) == "a:1,b:5,c:1"
    assert first(spark, T.merged_resources(F.lit(None).cast("string"), F.lit("c"))) == "c:1"


def test_booleans(spark):
    assert [first(spark, T.to_bool(F.lit(x))) for x in ("Yes", "0", "T", "fALSE")] == [True, False, True, False]
    assert first(spark, T.to_bool(F.lit(None).cast("string"))) is None
    for bad in ("maybe", "", " yes", "on", "off"):
        with pytest.raises(Exception, match="neither true nor false"):
            first(spark, T.to_bool(F.lit(bad)))


def test_commands_on_one_line():
    assert T.shell_line("a\tb") == "a$'\\t'b"
    assert T.shell_line("echo 'x\ny'") == "echo 'x'$'\\n''y'"
    assert T.shell_line('echo "x\x07y"') == 'echo "x"$\'\\a\'"y"'
    assert T.shell_line("a\\\\b") == "a\\\\b"  # backslashes stay
    assert T.shell_line("\x01\x7f\x1b") == "$'\\x01'$'\\x7f'$'\\e'"
    # a protected quote opens nothing, neither does one within the other kind
    assert T.shell_line("\\'\n") == "\\'$'\\n'" and T.shell_line("\"'\n\"") == "\"'\"$'\\n'\"\""
    assert T.shell_line("") == "" and T.shell_line("plain 'é'") == "plain 'é'"


@pytest.mark.parametrize("text", ["a\nb", "'q\tr' s", '"d\x01e\\"f\x7f"', "x\\\n y"])
def test_a_line_means_the_same_in_a_shell(text):
    """A shell reads from the line the words that it reads from the text, but for white space outside quotes."""
    import subprocess

    run = lambda t: subprocess.run(["bash", "-c", f"printf '%s|' {t}"], capture_output=True).stdout
    if "'q" in text or '"d' in text:
        assert run(T.shell_line(text)) == run(text)
    assert "\n" not in T.shell_line(text) and "\x01" not in T.shell_line(text)


def test_leading_variables(spark):
    assert T.leading_variables("A=1 B='x y' C=\"p \\\"q\" run D=2") == ({"A": "1", "B": "x y", "C": 'p "q'}, "run D=2")
    assert T.leading_variables("./run A=1") == ({}, "./run A=1")
    assert T.leading_variables("  E=  run") == ({"E": ""}, "run") and T.leading_variables("A='x'y run") == ({}, "A='x'y run")
    df = spark.createDataFrame([("A=1 x",), ("x",), (None,)], "c string").select(T.split_variables("c").alias("r")).select("r.*")
    assert [tuple(r) for r in df.collect()] == [({"A": "1"}, "x"), (None, "x"), (None, None)]


def test_variables_in_paths(spark):
    one = lambda t, v: first(spark, T.substituted(v)(F.lit(t)))
    assert one("${A}/${*b}/$C.x/$$", {"A": "x", "C": "${A}"}) == "x/${*b}/${A}.x/$"
    for bad in ("${Z}", "$Z", "${1}", "$"):
        with pytest.raises(Exception, match="no value for|without a name"):
            one(bad, {"A": "x"})
    assert first(spark, T.names_used(F.lit("${A}/${*b}/$C/${A}/$$D"))) == ["A", "C"]


def test_text(spark):
    get = lambda c: first(spark, c)
    assert get(T.truncated(4, "~")(F.lit("aéé"))) == "aé~" and get(T.truncated(9, "~")(F.lit("aéé"))) == "aéé"
    assert get(T.normal_path(F.lit("a/./b/../c//d/"))) == "a/c/d/"
    assert get(T.step_digest(F.array(F.lit("ab"), F.lit("c")))) != get(T.step_digest(F.array(F.lit("a"), F.lit("bc"))))
    assert get(T.printable(F.lit("a\n\t"))) == "a$'\\n'$'\\t'"
    digest = "0123456789abcdef" * 4
    assert get(T.short_digest(F.lit(digest))) == "01234567" and get(T.short_digest(F.lit("u"))) == "UNKNOWN" and get(T.short_digest(F.lit(None).cast("string"))) == "(unset)"
    assert get(T.full_digest(F.lit(digest))) == " ".join(["01234567", "89abcdef"] * 4)
    assert get(T.shown_value(F.lit("x"))) == "='x'" and get(T.shown_value(F.lit(None).cast("string"))) == "(unset)"
    assert get(T.shown_time(F.lit(0))) == "1970-01-01 00:00:00"


def test_paths(spark):
    get = lambda c: first(spark, c)
    assert get(T.with_affixes(F.lit("a/b"), F.lit("./"), F.lit("/"))) == "./a/b/" and get(T.with_affixes(F.lit("/a"), F.lit(""), F.lit(""))) == "/a"
    for path, lead, trail in (("./a", "./", ""), ("/a", "./", ""), ("a/", "", "/"), ("a", "x", ""), ("a", "", "//")):
        with pytest.raises(Exception, match="affix|slash"):
            get(T.with_affixes(F.lit(path), F.lit(lead), F.lit(trail)))
    assert get(T.translated(F.lit("../x/y/"), F.lit("sub/dir"))) == "sub/x/y/" and get(T.translated(F.lit("/abs/./x"), F.lit("sub"))) == "/abs/x"
    none = F.lit(None).cast("string")
    assert get(T.out_path(F.lit("d/a.md"), none, ".pdf")) == "d/a.pdf" and get(T.out_path(F.lit("d/a.md"), F.lit("o/"), ".pdf")) == "o/a.pdf"
    assert get(T.out_path(F.lit("d/a.md"), F.lit("o/"), None)) == "o/a.md" and get(T.out_path(F.lit("a.md"), F.lit("b.svg"), ".pdf", (".svg",))) == "b.svg"
    for path, dest, ext in (("a.md", None, ".md"), ("a.md", "b.png", ".pdf"), ("a.md", "a.md", None)):
        with pytest.raises(Exception, match="itself|extension"):
            get(T.out_path(F.lit(path), F.lit(dest).cast("string"), ext))
