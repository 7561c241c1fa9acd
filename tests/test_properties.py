"""Rewrites against plain models, and invariants."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.functions.text import fix_spacing, normalize_block
from lexweave.operators import chunking, headings
from lexweave.operators import retrieval as R

words = st.text(alphabet="ab .!?\n", max_size=400)


@settings(max_examples=200, deadline=None)
@given(words, st.integers(5, 60), st.integers(0, 20))
def test_no_word_is_lost(text, limit, overlap):
    """All words come out in order when windows do not overlap, and no piece of several words is too long."""
    pieces = chunking.split_text(text.strip(), limit, 0)
    assert " ".join(pieces).split() == text.split()
    for p in chunking.split_words(text, limit, overlap):
        assert len(p) <= max(limit, max(map(len, p.split()))) + overlap + 1  # the seed of a window is not counted against it


def test_overlap_is_the_longest_suffix():
    assert chunking.split_words("aa bb cc dd ee", 8, 5) == ["aa bb cc", "bb cc dd", "cc dd ee"]
    assert chunking.split_words("", 8, 5) == []
    assert chunking.split_words("x" * 20 + " y", 8, 3) == ["x" * 20, "y"]


def test_short_sentences_before_a_long_one_stay():
    long = "word " * 30
    pieces = chunking.split_text("One. Two. " + long + "end. Last.", 60, 0)
    assert pieces[0].startswith("One. Two.")


def test_paths_equal_a_fold(spark):
    """Window paths equal the stack that pops headings of the same or a lower rank."""
    rng = random.Random(3)
    shapes = {1: "CHAPTER X{}", 2: "{}. Title", 3: "{}.1 Title", 4: "b) item {}", 5: "iv) item {}"}
    rows, want = [], {}
    for d in range(40):
        stack = []
        for i in range(rng.randint(1, 30)):
            level = rng.choice([0, 0, 1, 2, 3, 4, 5])
            line = "and some running words ." if not level else shapes[level].format(i + 3)
            rows.append((f"d{d}", i, line))
            if level:
                title = {1: f"X{i + 3}", 2: f"{i + 3} Title", 3: f"{i + 3}.1 Title", 4: f"item {i + 3}", 5: f"item {i + 3}"}[level]
                stack = [s for s in stack if s[0] < level] + [(level, title)]
            want[f"d{d}", i] = [s[1] for s in stack]
    out = headings.with_paths(spark.createDataFrame(rows, "document_id string, line_no int, line string")).collect()
    assert {(r["document_id"], r["line_no"]): list(r["path"]) for r in out} == want


def test_coverage_equals_two_passes(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for q in range(60):
        cand = [(q, f"d{rng.randint(0, 5)}", f"c{i:03d}", rng.random() ** 3) for i in range(rng.randint(1, 30))]
        rows += cand
        ordered = sorted(cand, key=lambda c: (-c[3], c[2]))
        best = {}
        for c in ordered:
            best.setdefault(c[1], c)
        first = [c for c in best.values() if c[3] >= 0.45 * ordered[0][3]] if len(best) > 1 else []
        rest = [c for c in ordered if c not in first]
        picked = (first + rest)[: max(10, 0)] if len(first) < 10 else sorted(first, key=lambda c: (-c[3], c[2]))[:10]
        want[q] = {c[2] for c in picked}
    out = R.coverage(spark.createDataFrame(rows, "query_id int, document_id string, chunk_id string, fused_score double")).collect()
    got = {}
    for r in out:
        got.setdefault(r["query_id"], set()).add(r["chunk_id"])
    assert got == want


def test_fusion_does_not_depend_on_order(spark):
    hits = [(1, f"c{i}", float(i), i + 1) for i in range(10)]
    a = spark.createDataFrame(hits, "query_id int, chunk_id string, score double, rank int")
    b = spark.createDataFrame(list(reversed(hits)), a.schema)
    key = lambda df: sorted((r["chunk_id"], r["fused_score"]) for r in df.collect())
    assert key(R.fuse(a, a)) == key(R.fuse(b, b))


def test_parts_equal_whole_texts(spark, monkeypatch):
    """Lines, merged numbers and chunks of documents in parts equal those of their joined texts, wherever blocks end."""
    rng = random.Random(5)
    shapes = ["337-", "A. Hurt", "B) ", "12", "7.", "Punishment of theft", "12 Title", "", " \t", "running words ,and:more", "thecourtshall sit", "(a) clause", "x\x1cy \x85", "CHAPTER II"]
    parts, whole = [], []
    for d in range(60):
        texts = ["\n".join(rng.choice(shapes) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 12))]
        places = sorted(rng.sample(range(30), len(texts)))
        parts += [(f"d{d}", "T", p, t) for p, t in zip(places, texts, strict=True)]
        whole.append((f"d{d}", "T", "\n".join(texts)))
    a = spark.createDataFrame(parts, "document_id string, title string, part_no long, text string")
    b = spark.createDataFrame(whole, "document_id string, title string, text string")
    rows = lambda df, *cols: sorted(tuple(r[c] for c in cols) for r in df.collect())
    want = rows(headings.lines(b).where("own"), "document_id", "line_no", "line")
    plain = fix_spacing(normalize_block(F.col("text")))
    assert want == rows(b.select("document_id", plain.alias("t")).where("t <> ''").select("document_id", F.posexplode(F.split("t", headings.LINE_ENDS, -1)).alias("line_no", "line")), "document_id", "line_no", "line")
    merged = rows(headings.merge_numbers(headings.lines(b)), "document_id", "line_no", "line")
    chunks = rows(chunking.chunk(b), "chunk_id", "section_label", "text", "title")
    for size in (1, 3, 768):
        monkeypatch.setattr(headings, "PARTS", size)
        lines = headings.lines(a).cache()
        assert rows(lines.where("own"), "document_id", "line_no", "line") == want
        assert rows(headings.merge_numbers(lines), "document_id", "line_no", "line") == merged
        assert rows(chunking.chunk(a), "chunk_id", "section_label", "text", "title") == chunks
