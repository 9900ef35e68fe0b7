import ctypes
import random
import re
from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.compute as pc

import corpus_pipeline
from paperloom.llm import minhash, packing, pii, quality, toxicity


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "near_dedup", "pii_surrogates", "packing"]


def test_run_equals_plain_version(spark, sf):
    """Every stage over what its predecessor kept, worked out with the operators' plain parts on the driver."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = toxicity.fit(spark, docs, labels)
    rows = [(k, t) for k, t in rows if model.score(t) < toxicity.THRESHOLD]
    left = spark.createDataFrame(rows, "doc_id long, text string")
    q = quality.fit(spark, left, labels)
    rows = [(k, t) for k, t in rows if q.scores([t])[0] >= quality.THRESHOLD]
    from .test_minhash import classes_of

    rows.sort()
    first = sorted(set(classes_of([t for _, t in rows])))
    rows = [rows[k] for k in first]
    own = pii.Replacer(pii.KEY)
    coder = packing.coder(__import__("public_tokenizers").path("word_bpe_49k.json"))
    want = {k: coder.encode(own.text(t)[0]) + b"\1\0\0\0" for k, t in rows}
    got = {}
    for r in sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: (r["doc_id"], r["start"])):
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["ids"])
    assert got == want
    assert 0.5 < len(want) / docs.count() < 1


def test_stages_keep_columns_and_stand_odd_rows(spark, sf):
    base = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (10**12, "", "en", "s", 0), (10**12, "", "en", "s", 0)], base.schema)
    docs = base.unionByName(odd).selectExpr("*", "1 AS score", "'x' AS node", "2 AS y")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0
    assert minhash.keep_one(docs).where("doc_id = 1000000000000").count() <= 1


def kept_mb():
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_packing_task_gives_its_memory_back(spark, monkeypatch):
    """a worker that has packed keeps no memory that it has freed; it stays while other stages need the executor's memory."""
    path = __import__("public_tokenizers").path("word_bpe_49k.json")
    tasks = []

    class Docs:
        select = lambda self, *columns: self
        mapInArrow = lambda self, batches, schema: tasks.append(batches)

    packing.pack(Docs(), path, forget=True)
    monkeypatch.setattr(packing.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))

    def task(n):
        for at in range(0, n, 50):
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + 50)), pa.array([" ".join(word() for _ in range(50)) for _ in range(50)])], ["doc_id", "text"])

    assert sum(x.num_rows for x in tasks[0](task(50))) >= 50  # loads the tokenizers
    assert sum(pc.sum(x.column("length")).as_py() for x in tasks[0](task(6000))) > 6000 * 50
    before = kept_mb()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    assert before - kept_mb() < 8  # nothing is left to give back


def test_word_coder_that_forgets_gives_the_same_ids():
    coder = packing.WordCoder(__import__("public_tokenizers").path("word_bpe_49k.json"))
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["it's", "end.", "a,b", "Ünder", "12x"]) + str(rng.randrange(40)) * rng.randrange(2) for _ in range(30)) for _ in range(200)]
    whole = [coder.whole(t).tobytes() for t in texts]
    for coder.most in (0, 7, 60, 10**6):
        coder.known.clear()
        assert [coder.encode(t) for t in texts] == whole
