"""Line dedup by a suffix array over line-id sequences.

A document is the sequence of its non-blank lines; a line's id is two 64-bit hashes.
Prefix doubling ranks the suffixes that repeat: after round k, two positions have the
same rank if and only if their next 2^k lines are the same, and ranks are ordered as
those lines' ids are. The positions of one rank are the LCP interval of depth 2^k of
the suffix array: a line run of that length that repeats, its first position in
(doc_id, line) order being the copy that stays. A position leaves when its interval
has one member, so later rounds hold only what repeats over longer runs.

A run of ``min_lines`` lines or more, or one line of ``min_words`` words or more, is
deleted wherever it is a later copy. A length between two powers of two is read from two
overlapping runs: the next n lines are the same if and only if the 2^k lines at their start
and the 2^k lines at their end are. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.shared import Scratch

MIN_LINES, MIN_WORDS = 2, 20


def line_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, key, o, h1, h2, words): the o-th non-blank line of each document; key is the text's hash."""
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda x: F.trim(x) != "")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("key"), F.posexplode(lines).alias("o", "line"))
    words = F.size(F.split(F.trim("line"), r"\s+"))
    return rows.select("doc", "key", "o", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), words.alias("words"))


def repeated(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> list[DataFrame]:
    """For each round k, stored: (doc, key, o, words, rank, later) of the positions whose next 2^k lines repeat.

    later: an earlier position has the same lines. Counts and first positions are combined before
    they are shuffled; positions are joined to them by plain equi-joins, so a line that makes a third of
    all rows is split by adaptive execution. Ranks are ids of range-sorted distinct pairs.
    """
    lines = line_rows(docs, doc_id, text)
    position = F.struct("doc", "key", "o")
    often = lines.groupBy("h1", "h2").agg(F.min(position).alias("first"), F.max(position).alias("last")).where("first <> last").select("h1", "h2", "first")
    classes = scratch.store(often.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2").withColumn("rank", F.monotonically_increasing_id()), "lines-class-0")
    rows = lines.join(classes, ["h1", "h2"]).select("doc", "key", "o", "words", "rank", (position != F.col("first")).alias("later")).distinct()
    rounds = [scratch.store(rows, "lines-0")]
    while not rounds[-1].isEmpty():
        k = len(rounds)
        step = 1 << (k - 1)
        pairs = scratch.store(_following(rounds[-1], step), f"lines-pairs-{k}")
        often = pairs.groupBy("rank", "next").agg(F.min(position).alias("first"), F.max(position).alias("last")).where("first <> last").select("rank", "next", "first")
        classes = scratch.store(often.repartitionByRange("rank", "next").sortWithinPartitions("rank", "next").withColumn("new", F.monotonically_increasing_id()), f"lines-class-{k}")
        rounds.append(scratch.store(pairs.join(classes, ["rank", "next"]).select("doc", "key", "o", "words", F.col("new").alias("rank"), (position != F.col("first")).alias("later")), f"lines-{k}"))
        scratch.drop(pairs)
    return rounds[:-1]


def _following(rows: DataFrame, step: int) -> DataFrame:
    """Rows whose position step lines on is there too, with its rank as next."""
    w = Window.partitionBy("doc", "key").orderBy("o").rangeBetween(step, step)
    return rows.withColumn("next", F.first("rank").over(w)).where("next IS NOT NULL").drop("later")


def later_runs(rounds: list[DataFrame], length: int) -> DataFrame | None:
    """(doc, key, o): positions whose next length lines are a later copy; none if no such run repeats."""
    k = length.bit_length() - 1
    if k >= len(rounds):
        return None
    if length == 1 << k:
        return rounds[k].where("later").select("doc", "key", "o")
    position = F.struct("doc", "key", "o")
    pairs = _following(rounds[k], length - (1 << k))
    first = pairs.groupBy("rank", "next").agg(F.min(position).alias("first"), F.max(position).alias("last")).where("first <> last").select("rank", "next", "first")
    return pairs.join(first, ["rank", "next"]).where(position != F.col("first")).select("doc", "key", "o")


def deleted_lines(rounds: list[DataFrame], min_words: int = MIN_WORDS, min_lines: int = MIN_LINES) -> DataFrame | None:
    """(doc, key, lines, depth): for each document with later copies, the non-blank lines to delete, and the longest power of two of lines in one of them.

    A later copy of more than min_lines lines is covered by those of min_lines. Copies that overlap in
    one document leave what precedes the first later one: of a line repeated over and over, one stays.
    """
    if min_lines < 1:
        raise ValueError("a run has at least one line")
    if not rounds:
        return None
    hits = rounds[0].where(F.col("later") & (F.col("words") >= min_words)).select("doc", "key", "o", F.lit(1).alias("run"))
    runs = later_runs(rounds, min_lines)
    if runs is not None:
        whole = F.explode(F.array(*(F.col("o") + i for i in range(min_lines))))
        hits = hits.union(runs.select("doc", "key", whole.alias("o"), F.lit(1 << min_lines.bit_length() - 1).alias("run")))
    for k in range((min_lines - 1).bit_length(), len(rounds)):
        if 1 << k > min_lines:
            hits = hits.union(rounds[k].where("later").select("doc", "key", "o", F.lit(1 << k).alias("run")))
    return hits.groupBy("doc", "key").agg(F.collect_set("o").alias("lines"), F.max("run").cast("bigint").alias("depth"))


def dedup(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """docs with text cleaned, and n_lines (non-blank), n_deleted and depth: the longest power of two of lines in a deleted copy, 0 if none.

    Blank lines (empty, or of spaces alone) are not part of runs and stay, unless no other line does: then the text is empty. A
    null text stays null with zero counts. Rows that repeat both doc_id and text are one document and
    get the same result; a null doc_id sorts first. Input columns of the added names are replaced.
    """
    cols = [c for c in docs.columns if c not in ("n_lines", "n_deleted", "depth")]
    blank = lambda x: F.trim(x) == ""
    base = docs.select(*cols, F.xxhash64(text).alias("_key"), F.split(F.col(text), "\n", -1).alias("_lines")).withColumn("_n", F.size(F.filter("_lines", lambda x: ~blank(x))))
    found = deleted_lines(repeated(docs, scratch, doc_id, text), min_words, min_lines)
    if found is None:
        return base.select(*cols, F.when(F.col(text).isNull(), 0).otherwise(F.col("_n")).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_deleted"), F.lit(0).cast("bigint").alias("depth"))
    out = base.join(found.select(F.col("doc").alias("_doc"), F.col("key").alias("_k"), "lines", "depth"), F.col(doc_id).eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_k")), "left")
    at = F.expr("filter(sequence(0, size(_lines) - 1), i -> trim(_lines[i]) <> '')")
    gone = F.expr("transform(lines, o -> _at[o])")
    kept = F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), _gone), i -> _lines[i]), '\n')")
    out = out.withColumn("_at", F.when(F.col("lines").isNotNull(), at)).withColumn("_gone", F.when(F.col("lines").isNotNull(), gone))
    clean = F.when(F.col("lines").isNull(), F.col(text)).when(F.size("lines") == F.col("_n"), F.lit("")).otherwise(kept)
    rest = [clean.alias(c) if c == text else F.col(c) for c in cols]
    return out.select(*rest, F.when(F.col(text).isNull(), 0).otherwise(F.col("_n")).cast("bigint").alias("n_lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_deleted"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"))
