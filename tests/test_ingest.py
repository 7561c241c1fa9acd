"""Files to a searchable store, in batch and as a stream."""

import json

from lexweave.operators import retrieval as R
from lexweave.sources import files as S
from lexweave.sources import ingest
from lexweave.streaming import ingest as stream


def _write(root):
    (root / "acts").mkdir()
    (root / "acts" / "trade-act-1997.txt").write_bytes(b"1. Title\nThis \xff Act applies to trade.\n2. Scope\nAll ports and depots.\nas amended by Act 12")
    (root / "acts" / "trade-act-1997.meta.json").write_text(json.dumps({"short_names": ["TA"]}))
    (root / "note.MD").write_text("plain words only , and lower case .")


def test_batch(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    _write(root)
    store = S.ChunkStore(spark, str(tmp_path / "store"), S.collection_name("Hash/64"))
    first = ingest.run(spark, [str(root), str(tmp_path / "missing")], store).collect()
    assert first[0]["document_count"] == 2
    chunks = store.scan()
    assert {r["section_number"] for r in chunks.collect()} == {"1", "2", None}
    assert chunks.where("section_number = '2'").first()["amendments_detected"]
    assert "TA" in chunks.where("section_number = '1'").first()["search_aliases"]
    assert ingest.run(spark, [str(root)], store).collect()[0]["document_count"] == 0
    (root / "more.txt").write_text("3. More\nnew text here")
    assert ingest.run(spark, [str(root)], store).collect()[0]["document_count"] == 1
    assert store.scan().select("document_id").distinct().count() == 3
    assert ingest.run(spark, [str(root)], store, force=True).collect()[0]["document_count"] == 3


def test_stream(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    _write(root)
    store = S.ChunkStore(spark, str(tmp_path / "store"), "s")
    for _ in range(2):  # the second run has nothing new
        q = stream.ingest_stream(spark, str(root), store, str(tmp_path / "ck"))
        q.awaitTermination(120)
    n = store.scan().count()
    assert n > 0 and store.scan().select("chunk_id").distinct().count() == n


def test_helpers(spark):
    assert S.extensions(" .PDF, txt ,") == [".pdf", ".txt"] and S.extensions(None) == [".pdf", ".txt", ".md"]
    assert S.collection_name("BAAI/bge-base_en v1.5") == "rag_baai_bge_base_en_v1_5"
    assert S.point_id("a::00000") == S.point_id("a::00000")


def test_models_are_pluggable(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id int, text string")

    def encode(texts):
        if len(texts) > 1:
            raise MemoryError
        return [[float(len(t)), 1.0] for t in texts]

    assert [list(r["embedding"]) for r in R.embed_with(df, "text", encode).orderBy("id").collect()] == [[2.0, 1.0], [0.0, 1.0]]
