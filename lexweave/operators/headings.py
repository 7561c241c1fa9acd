"""Heading detection and section paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.patterns import CONTENTS_LINE, PAGE_LINE, SECTION
from lexweave.functions.sections import found
from lexweave.functions.text import fix_spacing, normalize_block, strip
from lexweave.session import reused

#: Shapes of heading lines.
LEGAL = rf"(?i)^(?:Section|Article|Schedule|Rule)\s+({SECTION})\s*[.\)\-—]?\s*(.+\S)?"
LABELLED = r"(?i)^(chapter|part|schedule)\b[:\s-]*(.+\S)?$"
NUMERIC = rf"^({SECTION})[\).:;\-—]?\s+(.+\S)"
LETTER = r"(?i)^([a-z])[\).:-]?\s+(.+\S)"
ROMAN = r"(?i)^([ivxlcdm]+)[\).:-]?\s+(.+\S)"
WRAPPERS = r"^[\[\]“”‘’\"'\x{FFFD} ]+"
DEEPEST = 12
#: Where Python ends lines.
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"
#: Parts of a document in a block, and how many lines of its neighbours a block sees.
PARTS, HALO = 768, 4


def running_text(after: Column) -> Column:
    """What follows a number reads on as a sentence: no delimiter, then a lower-case letter."""
    return ~after.rlike(r"^\s*[.\):;\-—]") & after.rlike(r"^\s*,?\s*\p{Ll}")


def title_like(t: Column) -> Column:
    words = F.filter(F.split(t, r"\s+"), lambda w: w.rlike(r"\p{L}"))
    n = F.size(words)
    share = lambda f: F.size(F.filter(words, f)) / F.greatest(n, F.lit(1))
    shouted = share(lambda w: (F.upper(w) == w) & (F.lower(w) != w))
    capital = share(lambda w: w.rlike(r"^\p{Lu}"))
    return F.length(t).between(4, 90) & ~t.rlike(r"[.;,\-—–]$") & (F.size(F.split(t, r"\s+")) <= 12) & (n > 0) & ((shouted >= 0.7) | (capital >= 0.85))


def bare(line: Column) -> Column:
    """A line without blanks, brackets and quotes around it."""
    return strip(F.regexp_replace(strip(line), WRAPPERS, ""))


def heading(line: Column) -> Column:
    """struct(level, title) of a heading line, else null."""
    return heading_of(bare(line))


def heading_of(t: Column) -> Column:
    """heading of a bare line; the first rule that fits decides."""
    mark = lambda level, title: F.struct(level.cast("int").alias("level"), title.alias("title"))
    depth = lambda num: F.length(num) - F.length(F.replace(num, F.lit("."), F.lit(""))) + 2
    none = F.lit(None).cast("struct<level:int,title:string>")

    legal = found(t, LEGAL)
    rest = F.substr(t, F.length(F.regexp_extract(t, r"(?i)^((?:Section|Article|Schedule|Rule)\s+)", 1)) + F.length(legal) + 1)
    low = F.lower(t)
    label = F.when(low.startswith("article"), "Article").when(low.startswith("rule"), "Rule").when(low.startswith("schedule"), "Schedule").otherwise("Section")
    legal_title = F.concat_ws(" ", label, legal, found(t, LEGAL, 2))

    num = found(t, NUMERIC)
    return (
        F.when((t == "") | t.rlike(CONTENTS_LINE) | t.rlike(PAGE_LINE), none)
        .when(legal.isNotNull(), F.when(running_text(rest), none).otherwise(mark(depth(legal), legal_title)))
        .when(t.rlike(LABELLED), mark(F.lit(1), strip(F.coalesce(found(t, LABELLED, 2), found(t, LABELLED)))))
        .when(num.isNotNull(), F.when(running_text(F.substr(t, F.length(num) + 1)), none).otherwise(mark(depth(num), F.concat_ws(" ", num, found(t, NUMERIC, 2)))))
        .when(t.rlike(LETTER), mark(F.lit(4), strip(F.regexp_extract(t, LETTER, 2))))
        .when(F.length(F.regexp_extract(t, ROMAN, 1)).between(1, 6), mark(F.lit(5), strip(F.regexp_extract(t, ROMAN, 2))))
        .when(title_like(t), mark(F.lit(1), t))
        .otherwise(none)
    )


def lines(docs: DataFrame, run_ons: bool = True, ends: str = LINE_ENDS) -> DataFrame:
    """(document_id, block, line_no, line, own) of every line of the cleaned texts.

    docs: (document_id, text), or parts of documents with their order as part_no: a document's text is then that of
    its parts, joined by line ends. No text of a whole document is ever in one row. A block is a run of parts; it
    also holds the HALO lines before and after it, which are not its own. A document without text has no line.
    """
    part = F.col("part_no") if "part_no" in docs.columns else F.lit(0)
    raw, blanks = F.coalesce("text", F.lit("")), F.lit(" \t\x0b\f\r")
    clean = fix_spacing(normalize_block(F.col("_raw")), run_ons)
    dealt = docs.select("document_id", part.cast("bigint").alias("part_no"), raw.alias("_raw")).select(
        "document_id",
        F.floor(F.col("part_no") / PARTS).alias("block"),
        "part_no",
        F.filter(F.array(clean), lambda t: t != "").alias("_clean"),
        F.ltrim("_raw", blanks).startswith("\n").alias("_lead"),
        F.rtrim("_raw", blanks).endswith("\n").alias("_trail"),
    )
    dealt = dealt.repartition("document_id", "block")
    w = Window.partitionBy("document_id", "block").orderBy("part_no")
    near, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("document_id", "block")

    none = F.array().cast("array<string>")
    # Parts in their block. A blank line stands before a part if either side of the joint, or a blank part, has one.
    full = F.size("_clean") > 0
    empty = (~full).cast("int")
    seen = F.last(F.when(full, F.struct("_trail", "_void")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    local = dealt.withColumns({"_void": F.sum(empty).over(near), "_voids": F.sum(empty).over(whole), "k": F.sum(full.cast("int")).over(near), "_count": F.sum(full.cast("int")).over(whole)}).withColumn("_prev", seen)
    gap = F.when(F.col("_prev").isNotNull(), F.col("_lead") | F.col("_prev._trail") | (F.col("_prev._void") < F.col("_void"))).otherwise(F.lit(False))
    local = local.withColumn("ls", F.when(full, F.concat(F.when(gap, F.array(F.lit(""))).otherwise(none), F.split(F.col("_clean")[0], ends, -1))).otherwise(none))
    local = local.withColumn("_before", F.sum(F.size("ls")).over(near) - F.size("ls"))

    # Blocks in their document, in the same way: only their sizes and the lines at their ends.
    first, last = full & (F.col("k") == 1), full & (F.col("k") == F.col("_count"))
    ends_of = lambda cond, piece: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("part_no", piece.alias("x"))))), lambda p: p["x"]))
    tail_of = lambda c: F.when(F.size(c) > HALO, F.slice(c, -HALO, HALO)).otherwise(c)
    blocks = local.groupBy("document_id", "block").agg(
        F.sum(F.size("ls")).alias("_n"),
        F.max(first & (F.col("_lead") | (F.col("_void") > 0))).alias("_opens"),
        F.max(last & (F.col("_trail") | (F.col("_void") < F.col("_voids")))).alias("_closes"),
        ends_of(full & (F.col("k") <= HALO), F.slice("ls", 1, HALO)).alias("_head"),
        ends_of(full & (F.col("k") > F.col("_count") - HALO), tail_of(F.col("ls"))).alias("_tail"),
    )
    d = Window.partitionBy("document_id").orderBy("block")
    blocks = blocks.withColumn("_void", F.count(F.when(F.col("_n") == 0, 1)).over(d.rowsBetween(Window.unboundedPreceding, 0))).where("_n > 0")
    blocks = blocks.withColumn("_prev", F.lag(F.struct("_closes", "_void")).over(d)).withColumn("gap", F.when(F.col("_prev").isNotNull(), F.col("_opens") | F.col("_prev._closes") | (F.col("_prev._void") < F.col("_void"))).otherwise(F.lit(False)))
    blank = F.when(F.col("gap"), F.array(F.lit(""))).otherwise(none)
    blocks = blocks.withColumns({"_n": F.col("_n") + F.size(blank), "_head": F.slice(F.concat(blank, "_head"), 1, HALO), "_tail": tail_of(F.concat(blank, "_tail"))})
    blocks = blocks.select(
        "document_id",
        "block",
        "gap",
        (F.sum("_n").over(d.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("first"),
        F.col("_n").alias("n"),
        tail_of(F.flatten(F.collect_list("_tail").over(d.rowsBetween(-HALO, -1)))).alias("before"),
        F.slice(F.flatten(F.collect_list("_head").over(d.rowsBetween(1, HALO))), 1, HALO).alias("after"),
    )

    rows = local.where(full).join(blocks, ["document_id", "block"])
    opens = F.when(first, F.concat("before", F.when(F.col("gap"), F.array(F.lit(""))).otherwise(none))).otherwise(none)
    start = F.col("first") + F.when(first, -F.size("before")).otherwise(F.col("_before") + F.col("gap").cast("int"))
    rows = rows.select("document_id", "block", "first", "n", start.alias("_start"), F.posexplode(F.concat(opens, "ls", F.when(last, F.col("after")).otherwise(none))).alias("_i", "line"))
    at = F.col("_start") + F.col("_i")
    return rows.select("document_id", "block", at.alias("line_no"), "line", at.between(F.col("first"), F.col("first") + F.col("n") - 1).alias("own"))


def merge_numbers(rows: DataFrame) -> DataFrame:
    """Join a section number that stands alone with the line that continues it: (document_id, block, line_no, line).

    rows: of ``lines``. First a number ending in a hyphen with a suffix line (``337-`` / ``A. Hurt``), then a lone
    number with a title line that is no heading itself. A continuation can't be a number line, so
    merges never overlap, one window per pass decides them all, and none depends on a line further off than HALO.
    """
    w = Window.partitionBy("document_id", "block").orderBy("line_no")
    cur, nxt = strip(F.col("line")), strip(F.lead("line").over(w))
    suffix = r"^([A-Za-z]{1,3})([.\):])\s*(.*)$"
    joins = F.coalesce(cur.rlike(r"^\d+(?:\.\d+)*-$") & nxt.rlike(suffix), F.lit(False))
    glued = F.rtrim(F.concat(F.regexp_extract(cur, r"^(\d+(?:\.\d+)*)-$", 1), F.lit("-"), F.upper(F.regexp_extract(nxt, suffix, 1)), F.lit(". "), strip(F.regexp_extract(nxt, suffix, 3))))
    one = rows.withColumns({"joins": joins, "glued": F.when(joins, glued)}).withColumn("gone", F.coalesce(F.lag("joins").over(w), F.lit(False))).where("NOT gone")
    one = one.select("document_id", "block", "line_no", "own", F.when(F.col("joins"), F.col("glued")).otherwise(F.col("line")).alias("line"))
    alone = rf"^({SECTION})\s*[\.\)\:\-—]?\s*$"
    joins = F.coalesce(cur.rlike(alone) & (F.length(nxt) >= 6) & ~nxt.rlike(alone) & nxt.rlike(r"^[A-Za-z(\"“]") & heading(nxt).isNull(), F.lit(False))
    two = one.withColumns({"joins": joins, "glued": F.when(joins, F.concat(F.regexp_extract(cur, alone, 1), F.lit(". "), nxt))}).withColumn("gone", F.coalesce(F.lag("joins").over(w), F.lit(False))).where("NOT gone AND own")
    return two.select("document_id", "block", "line_no", F.when(F.col("joins"), F.col("glued")).otherwise(F.col("line")).alias("line"))


def headed(rows: DataFrame) -> DataFrame:
    """rows with their heading, null on other lines."""
    return rows.withColumn("_bare", bare(F.col("line"))).withColumn("heading", heading_of(F.col("_bare"))).drop("_bare")


def opened(heads: DataFrame) -> DataFrame:
    """Heading lines with path, the titles of the open headings, and group, their number in the document.

    A heading closes those of its level and below. So the open heading of a level is the last one
    of that level, if no heading of a higher level came later: running windows over headings alone.
    """
    w = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = {k: F.last(F.when(F.col("heading.level") == k, F.struct("line_no", "heading.title")), ignorenulls=True).over(w) for k in range(1, DEEPEST + 1)}
    rows = heads.select("document_id", "line_no", "heading").withColumns({"group": F.count("heading").over(w)} | {f"_l{k}": c for k, c in last.items()})
    opened = []
    for k in range(1, DEEPEST + 1):
        above = [F.coalesce(F.col(f"_l{j}.line_no"), F.lit(-1)) for j in range(1, k)]
        top = F.greatest(*above) if len(above) > 1 else above[0] if above else F.lit(-1)
        opened.append(F.when(F.col(f"_l{k}.line_no") > top, F.col(f"_l{k}.title")))
    path = F.filter(F.array(*opened), lambda t: t.isNotNull())
    return rows.withColumn("path", path).drop(*(f"_l{k}" for k in last))


def grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with heading, group (headings so far) and some (their document has a line of text that is no heading); heading lines of ``opened``.

    Lines are counted in their blocks; blocks in their document.
    """
    rows = rows if "block" in rows.columns else rows.withColumn("block", F.lit(0))
    w = Window.partitionBy("document_id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = reused(headed(rows).withColumn("_k", F.count("heading").over(w)))
    d = Window.partitionBy("document_id")
    blocks = rows.groupBy("document_id", "block").agg(F.count("heading").alias("_n"), F.max(F.col("heading").isNull() & (F.trim("line") != "")).alias("some"))
    blocks = reused(blocks.select("document_id", "block", F.max("some").over(d).alias("some"), (F.sum("_n").over(d.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_base")))
    counted = rows.join(blocks, ["document_id", "block"]).withColumn("group", F.col("_base") + F.col("_k"))
    return counted.select("document_id", "line_no", "line", "heading", "group", "some"), opened(rows.where("heading IS NOT NULL"))


def with_paths(rows: DataFrame) -> DataFrame:
    """Lines with heading, group and path."""
    lines, heads = grouped(rows)
    out = lines.drop("some").join(heads.select("document_id", "group", "path"), ["document_id", "group"], "left")
    return out.withColumn("path", F.coalesce("path", F.array().cast("array<string>")))


def path_label(path: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(path, " > "), F.lit("")), F.lit("Document"))


def section_bodies(rows: DataFrame) -> DataFrame:
    """(document_id, group, path, body): the non-heading lines between headings, blocks normalized; empty ones go.

    A document that has heading lines only gives all of them as one body without a path.
    """
    return bodies_of(*grouped(rows))


def body_lines(lines: DataFrame) -> DataFrame:
    """(document_id, group, line_no, line) of lines that belong to bodies."""
    group = F.when(F.col("some"), F.col("group")).otherwise(F.lit(-1))
    return lines.where(F.col("heading").isNull() | ~F.col("some")).select("document_id", group.alias("group"), "line_no", "line")


def bodies_of(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """section_bodies of what ``grouped`` gives. Paths join the bodies, so no line carries one."""
    body = body_lines(lines).groupBy("document_id", "group").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    body = body.select("document_id", "group", normalize_block(F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("body")).where("body <> ''")
    out = body.join(heads.select("document_id", "group", "path"), ["document_id", "group"], "left")
    return out.select("document_id", "group", F.coalesce("path", F.array().cast("array<string>")).alias("path"), "body")
