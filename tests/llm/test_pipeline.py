"""The pipeline's stages on a small corpus, stage by stage and as a whole."""

import gc
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
import __spark_entry__ as E
from chemscore.llm import bpe, bytebpe

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for i in range(200):
        text = say(60)
        if i % 4 == 0:
            text = f"{say(20)} idiot {say(20)} moron {say(10)} scum {say(5)}"
        docs.append([i, text])
        labels.append((i, 1, int(i % 4 == 0)))
    item = say(30)
    docs += [[300, docs[1][1]], [301, docs[1][1].upper()], [302, docs[1][1] + " end"],        # copies of 1
             [310, f"{say(10)} {item} {say(10)}"],                                            # a benchmark passage
             [320, "password=abcdefgh12 " + say(50)],                                          # a secret
             [330, None], [331, ""], [None, say(30)], [340, say(40)], [340, docs[199][1]]]
    docs += [[341, "same " + say(30)]] * 2
    return [(i, t, "en", "s", len(t or "")) for i, t in docs], labels, [(7, item), (8, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels, items = corpus()
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, step in P.STAGES[:-1]:
        assert step(spark, docs.withColumn("__doc", F.lit(1)).withColumn("words", F.lit("w")), folder).columns == docs.columns, name


def test_whole_pipeline(spark, folder, bpe_file):
    docs, _, _ = corpus()
    got = P.run(spark, folder).collect()
    kept = {r.doc_id: bytes(r.ids) for r in got}
    gone = {i for i in range(0, 200, 4)} | {300, 301, 302, 310}
    assert set(kept) == {d[0] for d in docs} - gone
    assert len(got) == len(kept)                # of repeated rows one stays; of 340's texts the copy of 199 goes
    tok = bytebpe.library(bpe_file)
    ids = lambda t: b"".join(i.to_bytes(4, "little") for i in tok.encode(t or "", add_special_tokens=False).ids)
    by_id = {d[0]: d[1] for d in docs}
    assert kept[320] == ids(by_id[320].replace("password=abcdefgh12", "[assign]"))
    assert all(kept[i] == ids(by_id[i]) for i in (1, 2, 330, 331, None))


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", COLUMNS), ("labels", "doc_id long, quality int, toxic int"),
                         ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_all_queries_are_registered():
    names = list(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(E.oracle_sql()) <= set(names)
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "bpe"]


def test_encode_leaves_no_codes_in_idle_workers(spark, bpe_file):
    """A worker outlives the stage: what it keeps counts against the stages that follow."""
    r = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(str(r.random()) for _ in range(50))) for i in range(200)], "doc_id long, text string")
    assert bpe.encode(docs.repartition(4), bpe_file).count() == 200

    def kept(batches):
        for batch in batches:
            held = [o for o in gc.get_objects() if isinstance(o, (bytebpe.CachedCoder, bpe.TreeBPE))]
            codes = [len(d) for o in held for k in ("known", "plain", "spaced", "old_plain", "old_spaced")
                     if (d := getattr(o, k, None)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([len(held)]), pa.array([sum(codes)])], names=["held", "codes"])

    got = spark.range(64).repartition(16).mapInArrow(kept, "held long, codes long").collect()
    assert any(g.held for g in got) and all(g.codes == 0 for g in got)
