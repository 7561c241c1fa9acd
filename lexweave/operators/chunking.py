"""Section-aware chunks with metadata."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import sections
from lexweave.functions.text import strip
from lexweave.operators import headings

MAX_CHARS, OVERLAP = 2000, 250


def split_words(text: str, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Windows of words of up to limit characters; each begins with as many of the last words as overlap holds.

    The next word always joins that beginning, so a window can be longer than the limit by the overlap.
    """
    out: list[str] = []
    held: list[str] = []
    size = -1  # of held, joined
    fresh = False
    for word in text.split():
        if held and size + 1 + len(word) > limit:
            out.append(" ".join(held))
            keep, room = len(held), overlap + 1
            while keep and room >= len(held[keep - 1]) + 1:
                keep -= 1
                room -= len(held[keep]) + 1
            held = held[keep:] if overlap > 0 else []
            size = sum(map(len, held)) + len(held) - 1
        held.append(word)
        size += 1 + len(word)
        fresh = True
    return out + [" ".join(held)] if held and fresh else out


def _pack(parts: list[str], joint: str, limit: int, overlap: int, smaller) -> list[str]:
    """Join parts while they fit; parts that are too long by themselves are taken apart by smaller."""
    out: list[str] = []
    held: list[str] = []
    for p in parts:
        if held and (len(p) > limit or sum(map(len, held)) + len(joint) * len(held) + len(p) > limit):
            out.append(joint.join(held))
            held = []
        if len(p) > limit:
            out += smaller(p, limit, overlap)
        else:
            held.append(p)
    return out + [joint.join(held)] if held else out


def _split_sentences(text: str, limit: int, overlap: int) -> list[str]:
    parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    return _pack(parts, " ", limit, overlap, split_words)


def split_text(text: str, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs, packed; of long ones, sentences, packed; of long ones, windows of words. No text is lost."""
    if len(text) <= limit:
        return [text] if text else []
    parts = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    return _pack(parts, "\n\n", limit, overlap, _split_sentences)


def pieces(body: Column, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """array of pieces of a body. Packing is sequential, so bodies over the limit go through Arrow; the others don't."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, limit, overlap) if t else None)

    return F.when(F.length(body) <= limit, F.array(body)).otherwise(cut(F.when(F.length(body) > limit, body)))


def chunk(docs: DataFrame, run_ons: bool = True, limit: int = MAX_CHARS, overlap: int = OVERLAP, split: bool = True, ends: str = headings.LINE_ENDS) -> DataFrame:
    """Chunks of docs (document_id, title, text), or of parts of documents with their order as part_no.

    Lines, paths and bodies come from blocks of lines (``headings.lines``); chunks are numbered by the sizes of
    the groups before theirs. A document all of whose lines are headings gives its whole text, without a path.
    """
    lines, heads = headings.grouped(headings.merge_numbers(headings.lines(docs, run_ons, ends)))
    bodies = headings.bodies_of(lines, heads)
    cut = pieces(F.col("body"), limit, overlap) if split else F.array("body")
    bodies = bodies.withColumn("_pieces", cut)
    w = Window.partitionBy("document_id").orderBy("group").rowsBetween(Window.unboundedPreceding, 0)
    titles = docs.groupBy("document_id").agg(F.max("title").alias("title"))
    # unsplit, a body is one piece, and which groups have one shows without their texts
    sizes = bodies.select("document_id", "group", F.size("_pieces").alias("_n")) if split else headings.body_lines(lines).where(strip(F.col("line")) != "").groupBy("document_id", "group").agg(F.lit(1).alias("_n"))
    before = sizes.withColumn("_first", F.sum("_n").over(w) - F.col("_n")).drop("_n").join(titles, "document_id")
    found = bodies.join(before, ["document_id", "group"]).select("document_id", "group", "title", "path", "body", "_first", F.posexplode("_pieces").alias("piece_no", "piece"))
    own = sections.of_path(F.col("path"))
    amended = sections.amendments(F.col("body"))
    nested = F.size("path") > 1
    out = found.withColumns({"chunk_index": (F.col("_first") + F.col("piece_no")).cast("int"), "_own": own, "amendments": amended})
    label = headings.path_label(F.col("path"))
    return out.select(
        F.concat("document_id", F.lit("::"), F.lpad(F.col("chunk_index").cast("string"), 5, "0")).alias("chunk_id"),
        "document_id",
        "title",
        F.when(F.size("path") > 0, F.concat(F.lit("SECTION: "), label, F.lit("\n\n"), F.col("piece"))).otherwise(F.col("piece")).alias("text"),
        F.col("path").alias("section_path"),
        "chunk_index",
        F.lit(0).alias("start_char"),
        F.length("piece").alias("end_char"),
        label.alias("section_label"),
        F.col("_own.number").alias("section_number"),
        sections.normalize(F.col("_own.number")).alias("section_number_norm"),
        F.when(nested, F.col("path")[0]).alias("parent_section"),
        F.when(nested, F.col("path")).alias("section_hierarchy"),
        F.when(nested, F.length("_own.heading") - F.length(F.replace(F.col("_own.heading"), F.lit("("), F.lit("")))).alias("subsection_depth"),
        (F.size("amendments") > 0).alias("amendments_detected"),
        "amendments",
        F.transform("amendments", lambda a: a["section"]).alias("amendment_references"),
    )
