"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Every whole text is searched once for the base kinds (assign, access, hex) and for further credential shapes (EXTRA).
Occurrences are counted, by a hash of the secret, over the distinct repositories and owners that hold it: a secret that more
than MAX_OWNERS owners hold is a widely copied example, one held by fewer and at most MAX_REPOS repositories is specific to its
owner and looks live. Base spans are always reported; an EXTRA span only if its secret is specific to an owner.

Positions are code points, from the lengths of the matches and of the text between them. Owner and repository are columns or
expressions; null counts as an owner of its own. Null texts are empty. Null ids and repeated rows are reported row by row. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_known, written

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, group that holds the secret, its least length. Kinds in the order that breaks ties.
BASE = (("assign", ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]{12,}", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32))
EXTRA = (
    ("github", "gh[opsu]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", "xox[abpr]-[A-Za-z0-9-]{20,}", 0, 25),
    ("stripe", "[sr]k_live_[A-Za-z0-9]{16,}", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 36),
    ("url", "[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._%-]{1,64}:([A-Za-z0-9._%~!$&*+=-]{8,})@", 1, 8),
)
#: A string that every match of the kind holds, so that most texts are passed over without a regular expression.
HINTS = {"assign": ("=", ":"), "access": ("AKIA",), "github": ("gh",), "slack": ("xox",), "stripe": ("k_live_",), "jwt": ("eyJ",), "url": ("://",)}
ORDER = tuple(k for k, *_ in (*BASE, *EXTRA))
MAX_OWNERS = 3
MAX_REPOS = 6
SPAN = "array<struct<start: int, kind: int, end: int, secret: string>>"
PLACE = "array<struct<start: int, kind: int, end: int>>"


def _hinted(text: Column, kind: str) -> Column:
    found = [F.contains(text, F.lit(h)) for h in HINTS.get(kind, ())]
    return functools.reduce(Column.__or__, found) if found else F.lit(True)


def _matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Arrays of the whole matches, secrets and texts between, or null where nothing matches."""
    p = F.lit(pattern)
    arrays = F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("whole"), F.regexp_extract_all(text, p, F.lit(group)).alias("secret"), F.split(text, pattern, -1).alias("between"))
    return F.when(_hinted(text, kind) & F.rlike(text, p), arrays)


#: Rows of a running total that are added one by one; totals of whole runs come before them.
RUN = 128
#: Code points of the blocks that a text is cut into before pieces are taken from it.
TEXT_BLOCK = 1024


def _running(values: str, start: str, fold: str, body: str) -> str:
    """SQL for body, where {before} is the fold of what stands before i in the array `values` (v in body). Work grows with the
    array's length times RUN, not with its square."""
    before = f"aggregate(slice(v, i - i % {RUN} + 1, i % {RUN}), heads[cast(i div {RUN} as int)], {fold})"
    return f"""transform(array({values}), v ->
        transform(array(transform(sequence(0, cast(size(v) div {RUN} as int)), b -> aggregate(slice(v, b * {RUN} + 1, {RUN}), {start}, {fold}))), sums ->
            transform(array(transform(sequence(0, cast(size(v) div {RUN} as int)), b -> aggregate(slice(sums, 1, b), {start}, {fold}))), heads ->
                {body.replace("{before}", before)})[0])[0])[0]"""


def _spans(m: str, kind: str, least: int) -> Column:
    """Spans of the matches whose secret is long enough; each start follows from the lengths before it."""
    each = f"""transform(filter(sequence(0, size(v) - 1), i -> length({m}.secret[i]) >= {least}), i ->
        transform(array({{before}} + length({m}.between[i])), at ->
            named_struct('start', at, 'kind', {ORDER.index(kind)}, 'end', at + length({m}.whole[i]), 'secret', {m}.secret[i]))[0])"""
    lengths = f"transform(sequence(0, size({m}.whole) - 1), i -> length({m}.between[i]) + length({m}.whole[i]))"
    return F.expr(f"coalesce({_running(lengths, '0', '(a, x) -> a + x', each)}, cast(array() as {SPAN}))")


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, and the arrays of base and further spans of the column text."""
    cols = [F.col(f"`{c}`") for c in keep]
    text = F.col("_gl_text")
    kinds = (*BASE, *EXTRA)
    df = docs.select(*cols, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_gl_text"))
    df = df.select(*cols, *(_matches(text, k, p, g).alias(f"_gl_m_{k}") for k, p, g, _ in kinds))
    spans = {k: _spans(f"_gl_m_{k}", k, n) for k, _, _, n in kinds}
    both = [F.array_sort(F.concat(*(spans[k] for k, *_ in part))) for part in (BASE, EXTRA)]
    return df.select(*cols, both[0].alias("_gl_base"), both[1].alias("_gl_extra"))


def ownership(found: DataFrame) -> DataFrame:
    """secret_hash, n_docs (occurrences), n_owners, n_repos, example of every secret; found has secret_hash, owner, repo.

    Occurrences are summed per (secret, repository, owner) before any shuffle, so a secret in a third of all rows is a few rows.
    """
    pairs = found.groupBy("secret_hash", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("secret_hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    out = owners.groupBy("secret_hash").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))
    return out.withColumn("example", (F.col("n_owners") > MAX_OWNERS) | (F.col("n_repos") > MAX_REPOS))


def occurrences(hits: DataFrame) -> DataFrame:
    """row, owner, repo, secret_hash, kind, span of every span of scanned rows."""
    each = hits.filter("size(_gl_base) + size(_gl_extra) > 0").select("row", "owner", "repo", F.explode(F.concat("_gl_base", "_gl_extra")).alias("s"))
    return each.select("row", "owner", "repo", F.sha2("s.secret", 256).alias("secret_hash"), F.col("s.kind").alias("kind"), F.struct("s.start", "s.kind", "s.end").alias("span"))


def _judged(each: DataFrame, some: Column) -> DataFrame:
    """Some occurrences with whether their secret is an example, as all decide; a secret of any number of rows is spread."""
    owned = written(ownership(each).select("secret_hash", "n_docs", "example"), "owned")
    return join_known(each.filter(some), owned, ["secret_hash"], "n_docs", F.col("row"))


def _holders(owner: Column | None, repo: Column | None) -> tuple[Column, Column]:
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.col("source"), F.col("lang")) if repo is None else repo
    return owner.cast("string"), repo.cast("string")


def _places(spans: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def _names(spans: Column) -> Column:
    kinds = "array(" + ", ".join(f"'{k}'" for k in ORDER) + ")"
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.expr(kinds), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, owner: Column | None = None, repo: Column | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live and n_example of every document."""
    owner, repo = _holders(owner, repo)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), owner.alias("owner"), repo.alias("repo"))
    # one pass over the texts; what follows reads the spans only, and row ids are fixed once they are written
    hits = written(scanned(src, ["doc_id", "owner", "repo"]).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = occurrences(hits)
    judged = _judged(each, F.lit(True))
    live = ~F.col("example")
    per_row = judged.groupBy("row").agg(F.collect_list(F.when(live & (F.col("kind") >= len(BASE)), F.col("span"))).alias("added"), F.sum(live.cast("int")).cast("long").alias("n_live"), F.sum(F.col("example").cast("int")).cast("long").alias("n_example"))
    df = hits.select("row", "doc_id", _places("_gl_base").alias("base")).join(per_row, "row", "left")
    n = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as long)").alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)]
    every = F.array_sort(F.concat("base", F.coalesce("added", F.expr(f"cast(array() as {PLACE})"))))
    return df.select("doc_id", *n, F.sha2(_names(F.col("base")), 256).alias("base_sha256"), _names(every).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", owner: Column | None = None, repo: Column | None = None) -> DataFrame:
    """docs with `mark` in place of the spans that secret_spans reports, and n_chars to match; other columns stay.

    So examples of the further kinds stay in the texts. Only rows with further spans are shuffled with their texts; overlapping
    spans are replaced as one.
    """
    cols = docs.columns
    owner, repo = _holders(owner, repo)
    found = written(scanned(docs.withColumn("_gl_owner", owner).withColumn("_gl_repo", repo), [*cols, "_gl_owner", "_gl_repo"]).withColumn("_gl_row", F.monotonically_increasing_id()), "scanned")
    each = occurrences(found.select(F.col("_gl_row").alias("row"), F.col("_gl_owner").alias("owner"), F.col("_gl_repo").alias("repo"), "_gl_base", "_gl_extra"))
    live = _judged(each, F.col("kind") >= len(BASE)).filter("NOT example")
    added = live.groupBy(F.col("row").alias("_gl_row")).agg(F.collect_list("span").alias("_gl_added"))
    none = F.expr(f"cast(array() as {PLACE})")
    further = F.size("_gl_extra") > 0
    df = found.filter(further).join(added, "_gl_row", "left").withColumn("_gl_added", F.coalesce("_gl_added", none))
    df = df.unionByName(found.filter(~further).withColumn("_gl_added", none)).withColumn("_gl_spans", F.array_sort(F.concat(_places("_gl_base"), F.col("_gl_added"))))
    piece = f"""array_join(transform(if({{b}} > {{a}}, sequence(cast({{a}} div {TEXT_BLOCK} as int), cast(({{b}} - 1) div {TEXT_BLOCK} as int)), cast(array() as array<int>)), k ->
        substring(_gl_blocks[k], greatest({{a}} - k * {TEXT_BLOCK}, 0) + 1, least({{b}} - k * {TEXT_BLOCK}, {TEXT_BLOCK}) - greatest({{a}} - k * {TEXT_BLOCK}, 0))), '')"""
    # a span that begins within those before it adds no mark, and the text goes on where the furthest of them ends
    each = "transform(sequence(0, size(v)), i -> transform(array({before}), done -> " + f"""
        case when i = size(v) then {piece.format(a="done", b="length(text)")}
            when _gl_spans[i].start < done then ''
            else concat({piece.format(a="done", b="_gl_spans[i].start")}, '{mark.replace("'", "''")}') end)[0])"""
    df = df.withColumn("_gl_blocks", F.when(F.size("_gl_spans") > 0, F.expr(f"regexp_extract_all(text, '(?s).{{1,{TEXT_BLOCK}}}', 0)")))
    rebuilt = F.expr(f"array_join({_running('transform(_gl_spans, x -> x.end)', '0', '(a, x) -> greatest(a, x)', each)}, '')")
    hit = F.size("_gl_spans") > 0
    df = df.withColumn("_gl_new", F.when(hit, rebuilt).otherwise(F.col("text")))
    out = {c: F.col(f"`{c}`") for c in cols} | {"text": F.col("_gl_new")}
    if "n_chars" in cols:
        out["n_chars"] = F.when(hit, F.length("_gl_new").cast("long")).otherwise(F.col("n_chars"))
    return df.select(*(c.alias(k) for k, c in out.items()))
