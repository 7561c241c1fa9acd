"""Document metadata, the catalog of documents, and resolving documents named in questions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import patterns as P
from lexweave.functions.text import doc_blob, humanize, words


def among(c: Column, values: list[str]) -> Column:
    return c.isin(values)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def document_type(path: Column, title: Column, given: Column) -> Column:
    """Given, or by folder, or by words of the title (as substrings)."""
    p, t = F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), F.lower(title)
    out = F.when(F.coalesce(given, F.lit("")) != "", given)
    for folder, kind in P.TYPE_OF_FOLDER:
        out = out.when(p.contains(f"/{folder}/") | p.startswith(f"{folder}/"), kind)
    out = out.when(t.rlike("(?i)" + P.AMENDMENT_TITLE), "amendment").when(t.contains("rules"), "rules").when(t.contains("policy"), "policy")
    return out.when(t.contains("act") | t.contains("code") | t.contains("ordinance"), "base_act").otherwise("unknown")


def group_id(name: Column, given: Column) -> Column:
    """The subject that a base act, its amendments and its volumes share."""
    letters = F.regexp_replace(F.regexp_replace(name, r"\([^)]*\)", " "), r"[^a-zA-Z]+", " ")
    core = F.filter(F.split(F.lower(letters), " "), lambda w: (F.length(w) > 1) & ~among(w, P.GROUP_NOISE) & ~w.rlike(P.ROMAN))
    key = F.nullif(F.array_join(core, "-"), F.lit(""))
    plain = F.lower(F.regexp_replace(F.regexp_replace(name, r"[-_\s]+", "-"), "^-+|-+$", ""))
    return F.when(F.coalesce(given, F.lit("")) != "", F.lower(F.trim(given))).otherwise(F.coalesce(key, plain))


def acronyms(text: Column) -> Column:
    """Initials of the significant words of a title, with and without words for kinds of instruments; 3 to 8 letters."""
    w = F.filter(words(text, "[a-z]+"), lambda x: (F.length(x) > 1) & ~among(x, P.DOC_NOISE) & ~x.rlike(P.ROMAN))
    initials = lambda ws: F.array_join(F.transform(ws, lambda x: F.substring(x, 1, 1)), "")
    kind = lambda x: among(x, P.INSTRUMENT_WORDS)
    plain = F.filter(w, lambda x: ~kind(x) & ~among(x, P.STOPWORDS))
    full = F.filter(w, lambda x: kind(x) | ~among(x, P.STOPWORDS))
    return F.array_distinct(F.filter(F.array(initials(plain), initials(full)), lambda a: F.length(a).between(3, 8)))


def aliases(title: Column, name: Column, given_title: Column, short_names: Column) -> Column:
    """All names of a document, longest first, then in order of the alphabet."""
    human = humanize(name)
    short = F.transform(acronyms(F.when(human != "", human).otherwise(title)), F.upper)
    every = F.concat(F.array(given_title, title, human), F.coalesce(short_names, F.array().cast("array<string>")), short)
    own = F.array_distinct(F.filter(every, lambda a: a.isNotNull() & (a != "")))
    order = F.array_sort(F.transform(own, lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a"))))
    return F.transform(order, lambda s: s["a"])


def amends(name: Column, kind: Column, given: Column) -> Column:
    """The group that a document amends: given, or for an amendment the group of what its name amends."""
    base = F.regexp_replace(F.regexp_replace(name, r"(?i)(?:first\s+)?amendment.*", ""), r"^[-_ ]+|[-_ ]+$", "")
    return F.when(F.coalesce(given, F.lit("")) != "", given).when((kind == "amendment") & (base != ""), group_id(base, F.lit(None).cast("string")))


def distinctive(text: Column) -> Column:
    """Words of a title or question that tell documents apart."""
    w = words(doc_blob(text))
    return F.array_distinct(F.filter(w, lambda t: (F.length(t) > 2) & ~among(t, P.STOPWORDS) & ~among(t, P.DOC_NOISE) & ~t.rlike(r"^\d+$")))


def query_acronyms(q: Column) -> Column:
    """Initials of every run of two to five significant words."""
    w = F.filter(words(doc_blob(q), "[a-z]+"), lambda x: ~among(x, P.STOPWORDS) & (F.length(x) > 1))
    runs = lambda k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.array_join(F.transform(F.slice(w, i, k), lambda x: F.substring(x, 1, 1)), ""))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(runs(k) for k in range(2, 6))))


def describe(files: DataFrame) -> DataFrame:
    """Metadata of source files: path, and the fields of a sidecar (given_title, short_names, given_type, given_group, given_amends), null if it has none."""
    s = stem(F.col("path"))
    out = files.withColumn("stem", s).withColumn("title", F.coalesce(F.nullif("given_title", F.lit("")), humanize(F.col("stem"))))
    out = out.withColumn("document_type", document_type(F.col("path"), F.col("title"), F.col("given_type")))
    return out.withColumns({"document_group_id": group_id(F.col("stem"), F.col("given_group")), "amends_group_id": amends(F.col("stem"), F.col("document_type"), F.col("given_amends")), "aliases": aliases(F.col("title"), F.col("stem"), F.col("given_title"), F.col("short_names"))})


def catalog(chunks: DataFrame) -> DataFrame:
    """One row per document of chunks (document_id, title, source_path, chunk_index and, if there, document_type, document_group_id, amends_group_id, search_aliases).

    The last chunk that has a value decides; names and paths are united. Aggregation combines
    before its shuffle; sets hold a document's distinct names only.
    """
    have = set(chunks.columns)
    col = lambda c, t="string": F.col(c) if c in have else F.lit(None).cast(t)
    last = lambda c: F.max_by(c, F.when(c.isNotNull() & (c != ""), F.col("chunk_index")))
    per = chunks.groupBy("document_id").agg(
        F.max_by("title", "chunk_index").alias("title"),
        F.coalesce(last(col("document_type")), F.lit("unknown")).alias("document_type"),
        F.coalesce(last(col("document_group_id")), F.col("document_id")).alias("document_group_id"),
        last(col("amends_group_id")).alias("amends_group_id"),
        F.array_sort(F.collect_set("source_path")).alias("source_paths"),
        F.collect_set("title").alias("titles"),
        F.collect_set(F.to_json(F.struct(col("search_aliases", "array<string>").alias("a")))).alias("given"),
    )
    given = F.flatten(F.transform("given", lambda j: F.coalesce(F.from_json(j, "a array<string>")["a"], F.array().cast("array<string>"))))
    stems = F.transform("source_paths", stem)
    own = F.array_distinct(F.filter(F.concat("titles", F.transform(stems, humanize), given), lambda a: a.isNotNull() & (a != "")))
    per = per.withColumn("aliases", F.transform(F.array_sort(F.transform(own, lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a")))), lambda s: s["a"]))
    tokens = F.array_distinct(F.flatten(F.transform("aliases", distinctive)))
    short = F.array_distinct(F.flatten(F.concat(F.transform("aliases", acronyms), F.transform(stems, lambda s: acronyms(humanize(s))))))
    return per.drop("titles", "given").withColumns({"title_tokens": distinctive(F.col("title")), "tokens": tokens, "acronyms": short})


def token_counts(cat: DataFrame) -> DataFrame:
    """(token, n_documents)."""
    return cat.select("document_id", F.explode("tokens").alias("token")).groupBy("token").agg(F.count_distinct("document_id").alias("n_documents"))


def related(cat: DataFrame) -> DataFrame:
    """(document_id, related_id): the same group, or linked by an amendment; three equi-joins."""
    a = cat.select("document_id", F.col("document_group_id").alias("g"), F.col("amends_group_id").alias("m"))
    b = a.select(F.col("document_id").alias("related_id"), F.col("g").alias("rg"), F.col("m").alias("rm"))
    links = [a.join(b, F.col(x) == F.col(y)).select("document_id", "related_id") for x, y in (("g", "rg"), ("m", "rg"), ("g", "rm"))]
    return links[0].union(links[1]).union(links[2]).where("document_id <> related_id").distinct()


def keywords(title: Column) -> Column:
    return F.filter(words(doc_blob(title)), lambda w: F.length(w) > 2)


def name_matches(title: Column, blob: Column) -> Column:
    """At least two thirds (and two) of the title's words are in the blob, as substrings."""
    k = keywords(title)
    hits = F.size(F.filter(k, lambda w: F.contains(blob, w)))
    return (F.size(k) > 0) & (hits >= F.greatest(F.lit(2), F.floor((2 * F.size(k) + 2) / 3)))


def blob(cat: DataFrame) -> Column:
    """All names of a document in one searchable string."""
    path = F.col("source_paths")[0]
    return doc_blob(F.concat_ws(" ", "title", F.array_join("aliases", " "), F.element_at(F.split(path, "/"), -1), stem(path)))


def near_pairs(asked: DataFrame, titles: DataFrame) -> DataFrame:
    """Pairs (q, t) of distinct words whose lengths are within three: an equi-join on length."""
    wide = asked.select("q").distinct().withColumn("n", F.explode(F.sequence(F.length("q") - 3, F.length("q") + 3)))
    return wide.join(titles.select("t").distinct().withColumn("n", F.length("t")), "n").select("q", "t")


def similar_tokens(pairs: DataFrame, q: str = "q", t: str = "t", least: float = 0.78) -> DataFrame:
    """Pairs (q, t) of words that are equal or near in spelling.

    Words of four letters or more and lengths within three go to the matching-blocks ratio, which
    no built-in has: an Arrow function over the few distinct pairs that are left.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    same = pairs.where(F.col(q) == F.col(t))
    near = pairs.where((F.col(q) != F.col(t)) & (F.length(q) >= 4) & (F.length(t) >= 4) & (F.abs(F.length(q) - F.length(t)) <= 3))
    return same.union(near.where(ratio(q, t) >= least))


def abbreviation_matches(queries: DataFrame, cat: DataFrame) -> DataFrame:
    """(query_id, document_id) by short form: an acronym of the document, or a known one whose words the document has; the base act first, then the shorter title."""
    q = queries.select("query_id", F.explode(F.array_distinct(F.filter(words(F.replace("query_text", F.lit("."), F.lit("")), "[a-z]+"), lambda w: F.length(w).between(3, 8)))).alias("word"))
    by_acronym = q.join(cat.select("document_id", F.explode("acronyms").alias("word")), "word").select("query_id", "document_id")
    known = F.map_from_arrays(F.array(*map(F.lit, P.ABBREVIATIONS)), F.array(*(F.array(*map(F.lit, v)) for v in P.ABBREVIATIONS.values())))
    asked = q.withColumn("need", F.try_element_at(known, F.col("word"))).where("need IS NOT NULL")
    hits = asked.select("query_id", "word", F.size("need").alias("n"), F.explode("need").alias("token")).join(cat.select("document_id", F.explode("tokens").alias("token")), "token")
    by_known = hits.groupBy("query_id", "word", "document_id", "n").agg(F.count_distinct("token").alias("c")).where("c = n").select("query_id", "document_id")
    every = by_acronym.union(by_known).distinct().join(cat.select("document_id", "title", "document_type"), "document_id")
    w = Window.partitionBy("query_id").orderBy((F.col("document_type") != "base_act").cast("int"), F.length("title"), "title", "document_id")
    return every.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("query_id", "document_id", "title")


def match(queries: DataFrame, cat: DataFrame) -> DataFrame:
    """(query_id, document_id, title, stage): the document that a question names, if it names one.

    1: the longest alias that the question contains (short ones as whole words); 2: short forms;
    3: overlap of distinctive words, near spellings included; 4: initials of words in the question.
    Each stage is a join whose best row per question is kept, and the first stage that has one wins.
    """
    q = queries.select("query_id", "query_text", doc_blob(F.col("query_text")).alias("qn"))
    names = cat.select("document_id", "title", F.explode("aliases").alias("alias")).select("document_id", "title", F.lower("alias").alias("alias")).where("length(alias) >= 3").withColumn("an", doc_blob(F.col("alias")))
    quoted = F.concat(F.lit(r"\b"), F.regexp_replace("an", r"([^a-z0-9 ])", r"\\$1"), F.lit(r"\b"))
    inside = F.when(F.length("an") <= 8, F.rlike("qn", quoted)).otherwise(F.contains("qn", F.col("an")))
    first = Window.partitionBy("query_id")
    one = q.join(names, inside).withColumn("r", F.row_number().over(first.orderBy(F.desc(F.length("alias")), "alias", "document_id"))).where("r = 1").select("query_id", "document_id", "title", F.lit(1).alias("stage"))
    two = abbreviation_matches(queries, cat).select("query_id", "document_id", "title", F.lit(2).alias("stage"))

    asked = q.select("query_id", F.explode(distinctive(F.col("query_text"))).alias("q"))
    docs = cat.select("document_id", F.explode("title_tokens").alias("t"))
    covered = asked.join(similar_tokens(near_pairs(asked, docs)), "q").join(docs, "t").select("query_id", "document_id", "t").distinct()
    covered = covered.join(token_counts(cat).select(F.col("token").alias("t"), "n_documents"), "t", "left")
    sole = (F.length("t") >= 5) & (F.col("n_documents") == 1) & ~among(F.col("t"), P.GENERIC_TITLE_WORDS)
    per = covered.groupBy("query_id", "document_id").agg(F.count("*").alias("c"), F.max(F.length("t")).alias("longest"), F.max(sole).alias("sole"))
    per = per.join(cat.select("document_id", "title", "document_type", F.size("title_tokens").alias("n")), "document_id").withColumn("score", F.col("c") / F.col("n"))
    fit = per.where("(c = n AND longest >= 3) OR (c >= 2 AND score >= 0.6) OR sole")
    rank = [F.desc(F.col("c") + F.col("sole").cast("int")), F.desc("score"), F.desc((F.col("document_type") == "base_act").cast("int")), "document_id"]
    three = fit.withColumn("r", F.row_number().over(first.orderBy(*rank))).where("r = 1").select("query_id", "document_id", "title", F.lit(3).alias("stage"))

    initials = q.select("query_id", F.explode(query_acronyms(F.col("query_text"))).alias("token"))
    four = initials.join(cat.select("document_id", "title", F.explode("tokens").alias("token")).where("length(token) BETWEEN 2 AND 6"), "token")
    four = four.withColumn("r", F.row_number().over(first.orderBy("document_id", "token"))).where("r = 1").select("query_id", "document_id", "title", F.lit(4).alias("stage"))
    every = one.union(two).union(three).union(four)
    return every.withColumn("r", F.row_number().over(first.orderBy("stage"))).where("r = 1").drop("r")


def listing(chunks: DataFrame) -> DataFrame:
    """(source_path, title, n_chunks, total_documents, total_chunks) by title; each row has the totals."""
    per = chunks.groupBy("source_path").agg(F.max("title").alias("title"), F.count("*").alias("n_chunks"))
    totals = per.agg(F.count("*").alias("total_documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("total_chunks"))  # one row
    return per.crossJoin(F.broadcast(totals)).orderBy(F.lower("title"), "source_path")
