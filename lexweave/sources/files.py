"""Files: discovery, loading, sidecars, and the chunk store."""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.patterns import EXTENSIONS
from lexweave.functions.text import normalize_text
from lexweave.operators import catalog

SIDECAR = "title string, short_names array<string>, document_type string, document_group_id string, amends string, amends_group_id string"


def extensions(csv: str | None) -> list[str]:
    """A comma-separated setting as extensions; none: the default."""
    own = [e.strip().lower() for e in (csv or "").split(",") if e.strip()]
    return [e if e.startswith(".") else f".{e}" for e in own] or [".pdf", ".txt", ".md"]


def collection_name(model: str, override: str | None = None) -> str:
    """The name of a store for an embedding model."""
    return override or ("rag_" + re.sub(r"[\W_]+", "_", model.lower()).strip("_"))[:100]


def discover(spark: SparkSession, roots: list[str], allowed: list[str] = EXTENSIONS, fallback: list[str] | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of files below the roots whose extension is allowed, in any case; no sidecars.

    Roots that are missing, or lie below another one, are skipped; fallback roots are used if nothing
    is found. Content is read only where a later step selects it.
    """
    every = None
    for root in dict.fromkeys(r.rstrip("/") for r in roots):
        if any(root.startswith(f"{r.rstrip('/')}/") for r in roots):
            continue
        try:
            df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        except AnalysisException:
            continue
        every = df if every is None else every.unionByName(df)
    if every is None:
        every = spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    low = F.lower("path")
    out = every.where(F.regexp_extract(low, r"(\.[^./]+)$", 1).isin(allowed) & ~low.endswith(".meta.json"))
    return discover(spark, fallback, allowed) if fallback and out.select("path").isEmpty() else out


def read_texts(files: DataFrame) -> DataFrame:
    """(path, pages) of discovered files: one page of text, or the pages of a PDF if a reader library is there.

    Bytes that are not UTF-8 are left out. Files without a reader give no pages.
    """

    @F.pandas_udf("array<string>")
    def pages(path: pd.Series, content: pd.Series) -> pd.Series:
        def one(p: str, b: bytes) -> list[str]:
            if not p.lower().endswith(".pdf"):
                return [bytes(b).decode("utf-8", "ignore")]
            try:
                import io

                from pypdf import PdfReader
            except ImportError:
                return []
            return [x.extract_text() or "" for x in PdfReader(io.BytesIO(b)).pages]

        return pd.Series([one(p, b) for p, b in zip(path, content, strict=True)])

    return files.select("path", pages("path", "content").alias("pages"))


def sidecars(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(sidecar, fields) of all ``.meta.json`` files below the roots that are there; malformed ones have null fields."""
    out = spark.createDataFrame([], "sidecar string, value string")
    for root in dict.fromkeys(roots):
        try:
            raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").text(root)
        except AnalysisException:
            continue
        out = out.union(raw.select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/"), "value"))
    return out.select("sidecar", F.from_json("value", SIDECAR).alias("fields")).dropDuplicates(["sidecar"])


def with_sidecars(files: DataFrame, side: DataFrame) -> DataFrame:
    """files with the fields of ``<name>.meta.json``, else of ``<stem>.meta.json``, as given_* columns."""
    bare = F.regexp_replace("path", r"\.[^./]+$", "")
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    f = files.withColumns({"_a": same(F.concat("path", F.lit(".meta.json"))), "_b": same(F.concat(bare, F.lit(".meta.json")))})
    a, b = (side.select(F.col("sidecar").alias(k), F.col("fields").alias(f"{k}f")) for k in ("_a", "_b"))
    f = f.join(a, "_a", "left").join(b, "_b", "left").withColumn("_s", F.coalesce("_af", "_bf"))
    s = F.col("_s")
    names = {"given_title": s["title"], "short_names": s["short_names"], "given_type": s["document_type"], "given_group": s["document_group_id"], "given_amends": F.coalesce(F.nullif(s["amends"], F.lit("")), s["amends_group_id"])}
    return f.withColumns(names).drop("_a", "_b", "_af", "_bf", "_s")


def assemble(pages: DataFrame, run_ons: bool = True) -> DataFrame:
    """Documents of files (path, pages, given_*): pages that are not blank, joined; metadata from path and sidecar."""
    clean = F.filter(F.transform("pages", lambda p: normalize_text(p, run_ons)), lambda p: F.trim(p) != "")
    docs = catalog.describe(pages.withColumn("pages", clean))
    name = F.element_at(F.split("path", "/"), -1)
    return docs.select(F.col("path").alias("document_id"), F.col("path").alias("source_path"), "title", "pages", F.array_join("pages", "\n\n").alias("text"), F.size("pages").alias("page_count"), name.alias("file_name"), F.col("title").alias("display_title"), "document_type", "document_group_id", F.col("aliases").alias("search_aliases"), "amends_group_id")


def point_id(chunk_id: str) -> str:
    """The stable id of a chunk in a store."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, chunk_id))


class ChunkStore:
    """Chunks as a Parquet table; every change writes a new version and then names it as current."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.base = spark, f"{root.rstrip('/')}/{name}"

    def _versions(self) -> list[int]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        names = [s.getPath() for s in fs.listStatus(fs_path)]
        done = [p.getName() for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n[1:]) for n in done if re.fullmatch(r"v\d+", n))

    def scan(self, schema: str | None = None) -> DataFrame:
        """All chunks; none if the store is empty."""
        v = self._versions()
        return self.spark.read.parquet(f"{self.base}/v{v[-1]}") if v else self.spark.createDataFrame([], schema or "chunk_id string")

    def reset(self, chunks: DataFrame) -> None:
        """Replace everything."""
        v = self._versions()
        chunks.write.mode("overwrite").parquet(f"{self.base}/v{v[-1] + 1 if v else 0}")

    def upsert(self, chunks: DataFrame) -> None:
        """Replace chunks by chunk_id and add new ones."""
        self.reset(upserted(self.scan(), chunks) if self._versions() else chunks)


def upserted(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def not_indexed(files: DataFrame, chunks: DataFrame, path: str = "path", source: str = "source_path") -> DataFrame:
    """files whose path no chunk has."""
    return files.join(chunks.select(F.col(source).alias(path)).distinct(), path, "left_anti")
