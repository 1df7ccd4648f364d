"""Unified diffs to files, added lines and removals, with column expressions and windows.

A hunk consumes exactly the counts in its header, so text that looks like a header inside a hunk
is content. Reading a diff is therefore a fold over its lines, but one whose state composes:

1. Running counts of old lines, new lines and hunk-shaped lines are sums.
2. The counts tell on which line every hunk-shaped line would end, and so which hunk-shaped line
   comes next if it is a hunk. Those pointers are followed inside blocks by doubling; what is left
   of a block is where each way leaves it, and one walk over these exits finds the true ways in.
3. The open hunk, the header state and the number of files so far are last values and sums again.

Lines are cut into chunks by position. Each step works inside chunks, summarises a chunk in one row,
combines the summaries of a diff and hands every chunk its entry state. One huge diff is thus read
by many tasks; only its chunk summaries (one row for ``LINES`` lines) and block exits (a few for
``HEADS`` hunks) meet. Keys must not be null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.functions.text import after
from findlake.session import materialize

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
#: Positions of a chunk, hunk-shaped lines of a block.
LINES, HEADS = 1 << 16, 1 << 12
_END = (1 << 63) - 1


@dataclass(frozen=True)
class Diff:
    files: DataFrame
    added: DataFrame
    removed: DataFrame


def unquote(text: Column) -> Column:
    """Git's C-style quoting: escapes and octal bytes, through percent-encoding."""
    inner = after(text, 1)
    inner = F.regexp_replace(inner, r'"\z', "")
    tokens = F.regexp_extract_all(inner, F.lit(r"(?s)(\\[0-3][0-7]{0,2}|\\.|[^\\]+|\\\z)"), F.lit(1))

    def encoded(token: Column) -> Column:
        byte = F.concat(F.lit("%"), F.lpad(F.conv(F.substring(token, 2, 3), 8, 16), 2, "0"))
        return (
            F.when(token.rlike(r"^\\[0-3]"), byte)
            .when(token == "\\n", "%0A")
            .when(token == "\\t", "%09")
            .when(token.startswith("\\") & (F.length(token) > 1), F.url_encode(F.substring(token, 2, 10)))
            .otherwise(F.url_encode(token))
        )

    decoded = F.try_url_decode(F.array_join(F.transform(tokens, encoded), ""))
    return F.when(text.rlike(r'(?s)^".*"\z') & (F.length(text) > 1), decoded).otherwise(text)


def header_path(rest: Column) -> Column:
    return unquote(F.regexp_replace(F.element_at(F.split(rest, "\t"), 1), r"\s+\z", ""))


def git_header_path(rest: Column) -> Column:
    """The new path of ``a/x b/x``; a header with equal halves splits in the middle, spaces or not."""
    half = F.floor(F.length(rest) / 2).cast("int")
    a = F.substring(rest, F.lit(1), half)
    b = F.substring(rest, half + 2, F.length(rest))
    same = (F.length(rest) % 2 == 1) & a.startswith("a/") & b.startswith("b/") & (after(a, 2) == after(b, 2))
    quoted = F.regexp_replace(unquote(F.regexp_extract(rest, r'^"(?:[^"\\]|\\.)*"\s*(.*)\z', 1)), r"^b/", "")
    return (
        F.when(rest.startswith('"'), quoted).when(same, after(b, 2)).otherwise(F.regexp_extract(rest, r"^.* b/(.*)\z", 1))
    )


def _before(keys: list[str]):
    """Over chunk summaries: the chunks of a diff ahead of this one. Entry states meet their lines in
    merge joins, which keep the lines by chunk; a broadcast of few lines would put them where the
    summaries of the diff are."""
    return Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)


def _counted(lines: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Every line with its chunk and the running counts up to it. Written, as all later steps start here."""
    mark = F.substring("raw", 1, 1)
    flags = {
        "old_seen": F.when(mark.isin("+", "\\"), 0).otherwise(1),
        "new_seen": F.when(mark.isin("-", "\\"), 0).otherwise(1),
        "heads_seen": F.when(_plain("raw").rlike(HUNK), 1).otherwise(0),
    }
    rows = lines.select(*keys, F.col("pos").cast("bigint").alias("pos"), "raw").withColumn("chunk", F.expr(f"pos div {width}"))
    at = [*keys, "chunk"]
    upto = Window.partitionBy(*at).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy(*at).agg(*[F.sum(flag).alias(name) for name, flag in flags.items()])
    carry = sums.select(*at, *[F.coalesce(F.sum(name).over(_before(keys)), F.lit(0)).alias(f"{name}_in") for name in flags])
    local = rows.select(*at, "pos", "raw", *[F.sum(flag).over(upto).alias(name) for name, flag in flags.items()])
    out = local.join(carry.hint("merge"), at).select(*at, "pos", "raw", *[(F.col(name) + F.col(f"{name}_in")).alias(name) for name in flags])
    return materialize(out, "diff-lines")


def _plain(raw: str) -> Column:
    return F.regexp_replace(raw, r"\r\z", "")


def _spans(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Every hunk-shaped line, numbered from 1, with the line its counts end on and the number of
    the first one behind that line. Counts that never end run to the end of the diff."""
    text = _plain("raw")
    width = lambda i: F.coalesce(F.regexp_extract(text, HUNK, i).try_cast("bigint"), F.lit(1))
    found = lines.where(text.rlike(HUNK)).select(
        *keys,
        F.col("heads_seen").alias("idx"),
        "pos",
        F.regexp_extract(text, HUNK, 3).try_cast("int").alias("new_start"),
        (F.col("old_seen") + width(2)).alias("old_end"),
        (F.col("new_seen") + width(4)).alias("new_end"),
        F.col("new_seen").alias("new_base"),
    )

    def ends(side: str) -> DataFrame:
        return lines.groupBy(*keys, F.col(f"{side}_seen").alias(f"{side}_end")).agg(
            F.min("pos").alias(f"{side}_pos"), F.min("heads_seen").alias(f"{side}_heads")
        )

    joined = found.join(ends("old"), [*keys, "old_end"], "left").join(ends("new"), [*keys, "new_end"], "left")
    ended = F.col("old_pos").isNotNull() & F.col("new_pos").isNotNull()
    return joined.select(
        *keys,
        "idx",
        F.when(ended, F.greatest("old_heads", "new_heads", "idx") + 1).otherwise(_END).alias("next"),
        "pos",
        F.when(ended, F.greatest("old_pos", "new_pos", "pos")).otherwise(_END).alias("last"),
        "new_start",
        "new_base",
    )


def _true_heads(spans: DataFrame, keys: list[str], block: int) -> DataFrame:
    """The hunks among ``spans``: the first, and from each the next one behind its end."""
    at = [*keys, "block"]
    numbered = spans.withColumn("block", F.expr(f"(idx - 1) div {block}"))
    span = F.struct("idx", "next", "pos", "last", "new_start", "new_base")
    listed = numbered.groupBy(*at).agg(F.sort_array(F.collect_list(span)).alias("spans"))
    base = F.col("block") * block
    last = base + F.size("spans")
    hops = F.sequence(F.lit(1), F.lit(max(1, (block - 1).bit_length())))
    exits = F.aggregate(
        hops,
        F.transform("spans", lambda s: s["next"]),
        lambda to, _: F.transform(to, lambda x: F.when(x <= last, F.element_at(to, (x - base).cast("int"))).otherwise(x)),
    )
    blocks = materialize(listed.withColumn("exits", exits), "diff-blocks")
    ways = blocks.select(*keys, F.col("block"), F.posexplode("exits").alias("at", "exit")).select(*keys, (F.col("block") * block + F.col("at") + 1).alias("idx"), "exit")
    doors = blocks.select(*keys, F.explode(F.array_distinct("exits")).alias("idx")).where(F.col("idx") < _END)
    first = blocks.where("block = 0").select(*keys, F.lit(1).cast("bigint").alias("idx"))
    entered = ways.join(doors.unionByName(first).distinct(), [*keys, "idx"], "left_semi")

    def follow(steps: Column, start: Column, step_to: str) -> Column:
        begin = F.struct(start.alias("want"), F.array().cast("array<bigint>").alias("path"))
        return F.aggregate(
            steps,
            begin,
            lambda state, s: F.struct(
                F.when(s["idx"] == state["want"], s[step_to]).otherwise(state["want"]).alias("want"),
                F.when(s["idx"] == state["want"], F.array_append(state["path"], s["idx"])).otherwise(state["path"]).alias("path"),
            ),
            lambda state: state["path"],
        )

    one = F.lit(1).cast("bigint")
    walked = entered.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "exit"))).alias("ways"))
    entries = walked.select(*keys, F.explode(follow(F.col("ways"), one, "exit")).alias("entry")).withColumn("block", F.expr(f"(entry - 1) div {block}"))
    kept = blocks.join(entries, at).select(*keys, "block", "spans", F.explode(follow(F.col("spans"), F.col("entry"), "next")).alias("idx"))
    picked = kept.select(*keys, F.element_at("spans", (F.col("idx") - base).cast("int")).alias("s"))
    return materialize(picked.select(*keys, F.col("s.pos").alias("pos"), F.col("s.last").alias("last"), F.col("s.new_start").alias("new_start"), F.col("s.new_base").alias("new_base")), "diff-heads")


def _in_hunks(lines: DataFrame, heads: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Every line with the hunk that was opened last, and whether it lies in it."""
    at = [*keys, "chunk"]
    upto = Window.partitionBy(*at).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = heads.select(*keys, F.expr(f"pos div {width}").alias("chunk"), "pos", F.struct(F.col("pos").alias("head"), "last", "new_start", "new_base").alias("opens"))
    latest = marked.groupBy(*at).agg(F.max_by("opens", "pos").alias("latest"))
    chunks = lines.select(*at).distinct().join(latest, at, "left")
    carry = chunks.select(*at, F.last("latest", ignorenulls=True).over(_before(keys)).alias("open_in"))
    placed = lines.join(marked, [*at, "pos"], "left").withColumn("local", F.last("opens", ignorenulls=True).over(upto))
    placed = placed.join(carry.hint("merge"), at).withColumn("hunk", F.coalesce("local", "open_in"))
    inside = (F.col("pos") > F.col("hunk.head")) & (F.col("pos") <= F.col("hunk.last"))
    return placed.select(
        *at,
        "pos",
        _plain("raw").alias("text"),
        F.substring("raw", 1, 1).alias("mark"),
        F.col("opens").isNotNull().alias("is_head"),
        F.coalesce(inside, F.lit(False)).alias("in_hunk"),
        (F.col("hunk.new_start") + F.col("new_seen") - F.col("hunk.new_base")).cast("int").alias("new_line"),
    )


def _in_files(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Every line of a file section with the number of its file and the header state before it.

    A chunk's first event may be a ``---`` line that opens a file only if no header is open; whether
    one is comes with the entry state, so the chunk reports that line apart from its other openings.
    """
    at = [*keys, "chunk"]
    upto = Window.partitionBy(*at).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*at).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    outside = ~F.col("in_hunk")
    line = F.col("text")
    rows = placed.withColumns({"git": outside & line.startswith("diff --git "), "minus": outside & line.startswith("--- ")})
    event = F.when(F.col("git") | F.col("minus"), True).when(F.col("is_head") | (outside & line.startswith("@@@")), False)
    rows = rows.withColumn("event", event).withColumn("state", F.last("event", ignorenulls=True).over(ahead))
    summary = rows.groupBy(*at).agg(
        F.max_by("event", F.when(F.col("event").isNotNull(), F.col("pos"))).alias("event"),
        F.count_if(F.col("git") | (F.col("minus") & ~F.col("state"))).alias("opened"),
        F.bool_or(F.col("minus") & F.col("state").isNull()).alias("maybe"),
        F.min(F.when(F.col("is_head"), F.col("pos"))).alias("head"),
        F.min(F.when(F.col("git") | F.col("minus"), F.col("pos"))).alias("named"),
    )
    whole = Window.partitionBy(*keys)
    state_in = F.coalesce(F.last("event", ignorenulls=True).over(_before(keys)), F.lit(False))
    carry = summary.select(*at, "opened", "maybe", state_in.alias("state_in"), F.min("head").over(whole).alias("head"), F.min("named").over(whole).alias("named"))
    more = F.col("opened") + (F.col("maybe") & ~F.col("state_in")).cast("int")
    headless = F.when(F.col("head") < F.coalesce("named", F.lit(_END)), F.col("head"))
    carry = carry.select(*at, "state_in", F.coalesce(F.sum(more).over(_before(keys)), F.lit(0)).alias("opened_in"), headless.alias("headless"))
    rows = rows.join(carry.hint("merge"), at).withColumn("in_header", F.coalesce("state", "state_in"))
    opens = F.col("git") | (F.col("minus") & ~F.col("in_header"))
    unnamed = F.coalesce(F.col("pos") >= F.col("headless"), F.lit(False)).cast("int")
    return rows.withColumn("file_no", F.col("opened_in") + F.sum(opens.cast("int")).over(upto) + unnamed).where("file_no > 0")


def parse(diffs: DataFrame, keys: list[str], text: str = "diff") -> Diff:
    """``diffs``: ``keys`` plus the diff text, one row per diff. Combined (merge) diffs carry one
    marker per parent and are skipped. A null text has no files."""
    return parse_lines(diffs.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "raw")), keys)


def parse_lines(lines: DataFrame, keys: list[str], width: int = LINES, block: int = HEADS) -> Diff:
    """``lines``: ``keys``, ``pos`` (a number, ascending and distinct within a diff, gaps allowed) and
    ``raw``, for diffs of any length. ``width`` positions make a chunk."""
    counted = _counted(lines, keys, width)
    heads = _true_heads(_spans(counted, keys), keys, block)
    placed = _in_files(_in_hunks(counted, heads, keys, width), keys)
    outside = ~F.col("in_hunk")
    line = F.col("text")
    git, minus = F.col("git"), F.col("minus")
    plus = outside & line.startswith("+++ ")
    rest = lambda n: after(line, n)
    in_file = Window.partitionBy(*keys, "file_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = placed.where(outside & (F.col("in_header") | git | minus | plus | F.col("is_head")))
    marks = marks.withColumn("old_name", F.last(F.when(minus, header_path(rest(4))), ignorenulls=True).over(in_file))
    header = F.col("in_header") & ~git & ~minus & ~plus & ~F.col("is_head")
    old_name, new_name = F.coalesce("old_name", F.lit("")), header_path(rest(4))
    null = "/dev/null"
    path = (
        F.when(git, git_header_path(rest(11)))
        .when(plus & (old_name == null) & (new_name == null), F.lit(None).cast("string"))
        .when(plus & (new_name == null), F.regexp_replace(old_name, "^a/", ""))
        .when(plus, F.regexp_replace(new_name, "^b/", ""))
        .when(header & line.startswith("rename to "), unquote(rest(10)))
    )
    kind = (
        F.when(plus & (old_name == null) & (new_name != null), "added")
        .when(plus & (new_name == null) & (old_name != null), "deleted")
        .when(header & (line.startswith("rename from ") | line.startswith("rename to ")), "renamed")
        .when(header & line.startswith("new file mode"), "added")
        .when(header & line.startswith("deleted file mode"), "deleted")
    )
    old_path = F.when(header & line.startswith("rename from "), unquote(rest(12)))
    binary = header & (line.startswith("Binary files ") | line.startswith("GIT binary patch"))
    inside = placed.where("in_hunk")
    added = inside.where("mark = '+'").select(*keys, "file_no", (F.col("new_line") - 1).alias("line"), after(F.col("text"), 1).alias("text"))
    removed = inside.where("mark = '-'").select(*keys, "file_no", F.greatest("new_line", F.lit(1)).alias("before"))
    grouped = marks.groupBy(*keys, "file_no").agg(
        F.max_by(path, F.when(path.isNotNull(), F.col("pos"))).alias("path"),
        F.max_by(kind, F.when(kind.isNotNull(), F.col("pos"))).alias("kind"),
        F.max_by(old_path, F.when(old_path.isNotNull(), F.col("pos"))).alias("old_path"),
        F.bool_or(binary).alias("binary"),
    )
    counts = inside.groupBy(*keys, "file_no").agg(F.count_if(F.col("mark") == "+").alias("added_lines"), F.count_if(F.col("mark") == "-").alias("removed_lines"))
    files = (
        grouped.join(counts, [*keys, "file_no"], "left")
        .select(
            *keys,
            "file_no",
            F.coalesce("path", F.lit("")).alias("path"),
            "old_path",
            F.coalesce("kind", F.lit("modified")).alias("kind"),
            "binary",
            F.coalesce("added_lines", F.lit(0)).alias("added_lines"),
            F.coalesce("removed_lines", F.lit(0)).alias("removed_lines"),
        )
        .where("path <> '' OR added_lines > 0")
    )
    return Diff(files, added, removed)


def touched_lines(diff: Diff, keys: list[str]) -> DataFrame:
    """Lines of the new file a change touches: added ones, and the line after each removal."""
    named = diff.files.select(*keys, "file_no", "path")
    lines = diff.added.select(*keys, "file_no", "line").unionByName(diff.removed.select(*keys, "file_no", F.col("before").alias("line")))
    return lines.join(named, [*keys, "file_no"]).select(*keys, F.col("path").alias("file"), "line").distinct()
