"""Values that define the operators."""

import pytest
from pyspark.sql import functions as F

from lexweave.functions import sections as N
from lexweave.functions import text as T
from lexweave.operators import catalog as C
from lexweave.operators import chatlog as L
from lexweave.operators import context as X
from lexweave.operators import headings as H
from lexweave.plans import query_plan as Q


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_section_numbers(spark):
    cases = {"35A": "35A", "35-A": "35A", "35a": "35A", "35 a": "35A", "35_a": "35A", "337 II": "337-II", "337-iii": "337-III", "337I": "337I", "161": "161", "3.1.4": "3.1.4", "45(1)(a)": "45(1)(a)"}
    assert apply(spark, N.normalize, list(cases)) == list(cases.values())
    assert apply(spark, lambda c: N.normalize(N.normalize(c)), list(cases)) == list(cases.values())
    assert apply(spark, N.normalize, [None, ""]) == [None, ""]


def test_variants(spark):
    cases = {"9C": ["9C", "9(c)", "9"], "9(c)": ["9(c)", "9C", "9"], "14(1)(a)": ["14(1)(a)", "14(1)", "14"], "161": ["161"]}
    assert apply(spark, N.variants, list(cases)) == list(cases.values())


def test_query_sections(spark):
    cases = {
        "what is 20B": "20B", "411 -A": "411A", "339-A of crpc": "339A", "section o 14(1)(a)": "14(1)(a)", "register no 19": None, "46 days": None, "12 kg": None,
        "rule 1975": None, "section 4 days": None, "u/s 302": "302", "§ 12": "12", "sections 5, article 7 and u/s 8": "8", "section 2": None, "": None,
    }
    assert apply(spark, N.of_query, list(cases)) == list(cases.values())


def test_title_numbers(spark):
    cases = {"13. Punishment for contravention of Section 7": "13", "Section 5. Title": "5", "Preamble to Article 4A": "4A", "none": None}
    assert apply(spark, N.of_title, list(cases)) == list(cases.values())


def test_headings(spark):
    cases = {
        "492 , and includes any person": None, "Section 30 , may pass any sentence": None, "402-B , the Provincial": None,
        "265-N , Place of holding sittings": (2, "265-N , Place of holding sittings"), "3 | Page": None, "10 | P a g e": None, "Page 12": None,
        "79. Proof of execution ........ 35": None, "Shall---": None, "CHAPTER II": (1, "II"), "Part": (1, "Part"), "A person who": (4, "person who"),
        "iv) second": (5, "second"), "Article 20B Rights": (2, "Article 20B Rights"), "[93-A. Sending of summons": (2, "93-A Sending of summons"),
        "12.14 Stores": (3, "12.14 Stores"), "(a) a clause": None, "PRELIMINARY": (1, "PRELIMINARY"), "": None, "running text goes on": None,
    }
    got = [tuple(x) if x else None for x in apply(spark, H.heading, list(cases))]
    assert got == list(cases.values())


def test_spacing(spark):
    assert apply(spark, T.fix_spacing, ["9, and (a);b CrPC"]) == ["9 , and (a) ; b Cr PC"]
    assert apply(spark, T.fix_spacing, ["thecourtshall sit", "magistrates", "(thecourtshall)", "xthecourtshall"]) == ["the court shall sit", "magistrates", "(the court shall)", "xthecourtshall"]
    assert apply(spark, T.tokens, ["The Act, 1997 " + "ABCDEFGHIJKLMNOPQRSTUVwx"]) == [["the", "act", ",", "1997", "abcdefghijklmnopqrstuv", "wx"]]


@pytest.mark.parametrize("text", ["a,b;c", "  x  ,,y\n z ", "Camel CaseWord", ",;:"])
def test_spacing_is_idempotent(spark, text):
    once, twice = apply(spark, T.fix_spacing, [text]), apply(spark, lambda c: T.fix_spacing(T.fix_spacing(c)), [text])
    assert once == twice


def test_catalog_values(spark):
    none = F.lit(None).cast("string")
    names = ["Control of Narcotic Substances Act 1997", "Control of Narcotic Substances (First Amendment) Act 2020", "Control-of-Narcotic-Substances-Amendment-Act-2022"]
    assert apply(spark, lambda c: C.group_id(c, none), names) == ["control-narcotic-substances"] * 3
    assert set(apply(spark, C.acronyms, names)[0]) == {"cns", "cnsa"}
    assert "anf" in apply(spark, C.query_acronyms, ["anti narcotics force"])[0]
    near = C.similar_tokens(spark.createDataFrame([("qanuan", "qanun"), ("qanoon", "qanun"), ("abc", "abd"), ("court", "court"), ("lagoon", "granite")], "q string, t string"))
    assert {r["q"] for r in near.collect()} == {"qanuan", "court"}  # qanoon has a ratio of 0.73 only


def test_intents(spark):
    cases = {"What is Section 9?": "simple_lookup", "Compare bail provisions in X vs Y": "comparison", "What is the punishment for theft?": "penalty", "How to file an appeal": "procedural", "explain bail": "explanation", "hello": "simple_lookup", "": "simple_lookup"}
    assert apply(spark, Q.intent, list(cases)) == list(cases.values())
    assert apply(spark, lambda c: Q.effort(Q.intent(c), c), ["What is Section 9?", "explain bail", "compare a vs b"]) == ["minimal", "low", "medium"]


def test_language(spark):
    assert apply(spark, Q.detect_language, ["what is bail", "قانون کیا ہے", "", "12", None]) == ["en", "ur", "en", "en", "en"]
    asked = spark.createDataFrame([("urdu", "x"), ("EN", "قانون"), (None, "قانون"), ("auto", "x")], "a string, t string")
    assert [r[0] for r in asked.select(Q.resolve_language(F.col("a"), F.col("t"))).collect()] == ["ur", "en", "ur", "en"]
    assert apply(spark, lambda c: L.right_to_left(F.lit(None).cast("string"), c), ["قانون", "law"]) == [True, False]


def test_reflow_and_markdown(spark):
    assert apply(spark, T.reflow, ["a line\nwraps\n(a) clause\ngoes on\n\n\nnext"]) == ["a line wraps\n(a) clause goes on\n\nnext"]
    assert apply(spark, T.clean_markdown, ["## Head\n**b** and *i*\n\n\n\nend"]) == ["Head\nb and i\n\nend"]
    assert apply(spark, T.humanize, ["anti-narcotics_force-act"]) == ["Anti Narcotics Force Act"]


def test_ratings(spark):
    rated = spark.createDataFrame([(1, 5), (2, 4), (3, 4), (4, None)], "id long, rating int")
    assert L.rating_stats(rated).collect() == [(3, 4.33)]
    assert [tuple(r) for r in L.rating_histogram(rated).orderBy("rating").collect()] == [(1, 0), (2, 0), (3, 0), (4, 2), (5, 1)]
    assert L.rating_stats(rated.where("false")).collect() == [(0, None)]


def test_prompt_and_answers(spark):
    q = spark.createDataFrame([(1, "why?", "penalty")], "query_id long, query_text string, intent string")
    ctx = spark.createDataFrame([(1, "body")], "query_id long, context string")
    refs = spark.createDataFrame([(1, "one")], "query_id long, summary string")
    prompt = X.prompts(q, ctx, refs)
    assert "why?" in prompt.first()["prompt"] and "body" in prompt.first()["prompt"]
    assert X.answers(prompt).first()["answer"] is None
    assert X.answers(prompt, lambda p: p[:5]).first()["answer"] == "State"


def test_events(spark):
    rows = [(1, 1, "thinking", "t"), (1, 2, "answer", "a"), (1, 3, "answer", "b"), (1, 4, "sections", "[]"), (2, 1, "answer", " ")]
    out = L.fold_events(spark.createDataFrame(rows, "conversation_id long, seq long, type string, content string")).collect()
    assert [tuple(r) for r in out] == [(1, "ab", "t", "[]")]
    raw = spark.createDataFrame([('data: {"type": "answer", "content": "x"}\n\n',), ("data: {bad\n\n",), ("other",)], "raw string")
    assert [r[0] and r[0]["type"] for r in raw.select(L.sse_decode(F.col("raw"))).collect()] == ["answer", None, None]


def test_message_tables(spark):
    old = spark.createDataFrame([(1, 7, "user", "hi")], "id bigint, conversation_id bigint, role string, content string")
    new = spark.createDataFrame([(7, "assistant", "b", "2020-01-02"), (7, "user", "a", "2020-01-01")], "conversation_id bigint, role string, content string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    out = L.added(old, new).orderBy("id").collect()
    assert [(r["id"], r["content"], r["rating"]) for r in out] == [(1, "hi", None), (2, "a", None), (3, "b", None)]
    conv = spark.createDataFrame([(7, 1, "old"), (8, 2, "other")], "id bigint, user_id bigint, title string")
    assert [r["title"] for r in L.renamed(conv, 7, 1, "new").orderBy("id").collect()] == ["new", "other"]
    assert [r["title"] for r in L.renamed(conv, 8, 1, "new").orderBy("id").collect()] == ["old", "other"]


def test_section_boost(spark):
    from lexweave.plans.search import rerank, section_boost

    rows = [("9", None, None, "9", "x shall y"), ("9", None, None, "9", "stub"), ("9(1)", None, None, "9", "stub"), (None, ["9"], None, "9", "stub"), (None, None, ["9"], "9", "may"), ("8", None, None, "9", "stub")]
    df = spark.createDataFrame(rows, "section_number string, amendment_target_sections array<string>, amendment_sections array<string>, section string, text string")
    none = F.lit(None)
    c = {x: F.col(x) for x in df.columns} | {"parent_section": none.cast("string"), "section_hierarchy": none.cast("array<string>"), "amendments_detected": none.cast("boolean"), "amendment_references": none.cast("array<string>")}
    assert [round(r[0], 6) for r in df.select(section_boost(c)).collect()] == [4.2, 3.0, 1.5, 3.0, 3.5, 1.0]
    results = spark.createDataFrame([(1, "c", "q")], "query_id bigint, chunk_id string, query_text string")
    chunks = spark.createDataFrame([("c", "text")], "chunk_id string, text string")
    assert rerank(results, chunks).first()["rerank_score"] is None
    assert rerank(results, chunks, lambda q, t: [len(x) for x in t]).first()["rerank_score"] == 4.0


def test_documents_of_headings_only(spark):
    from lexweave.operators import chunking

    docs = spark.createDataFrame([("a", "T", "CHAPTER I\nPRELIMINARY"), ("b", "T", "1. One\nsome running body ."), ("c", "T", "")], "document_id string, title string, text string")
    got = {r["chunk_id"]: r for r in chunking.chunk(docs).collect()}
    assert set(got) == {"a::00000", "b::00000"}
    assert got["a::00000"]["text"] == "CHAPTER I\nPRELIMINARY" and got["a::00000"]["section_path"] == [] and got["a::00000"]["section_label"] == "Document"
    assert got["b::00000"]["section_number"] == "1" and got["b::00000"]["text"].startswith("SECTION: 1 One")
