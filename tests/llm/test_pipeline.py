"""The pipeline's stages against plain versions of each, one after the other."""

import random

import numpy as np
import pyarrow as pa

import __spark_entry__ as entry
import corpus_pipeline
from rowguard.llm import mixing, simhash, toxicity
from tests.llm.conftest import documents, prose
from tests.llm.test_copies import plain_components, plain_fingerprint
from tests.llm.test_models import insults
from tests.llm.test_texts import checked


def test_every_stage_works_on_all_its_predecessor_kept(spark, awkward, tmp_path):
    rng = random.Random(12)
    rows = [(i, insults(rng, rng.randint(3, 60)) if i % 5 == 0 else prose(rng, rng.randint(6, 200)), rng.choice(["en", "fr"]), "hot" if i % 3 else "s") for i in range(100, 400)]
    rows += [(400 + k, rows[k][1], "en", "hot") for k in range(0, 60, 2)]  # exact copies
    rows += [(500 + k, rows[k][1] + " end", "en", "s") for k in range(0, 60, 3)]  # near copies
    docs = documents(spark, rows).unionByName(awkward)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(100, 400)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]

    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    outs = [read]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, outs[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        outs.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(o.columns == read.columns for o in outs[1:5])
    held = [sorted(((r.doc_id, r.text) for r in o.collect()), key=str) for o in outs[:5]]

    model = toxicity.fit(read, labels)
    scores = toxicity.score_texts(model, pa.array([t for _, t in held[0]], pa.string()))
    assert held[1] == [r for r, s in zip(held[0], scores) if s < 0.3] and len(held[1]) < len(held[0])

    largest = {}
    for i, t in held[1]:
        largest[t or ""] = max(largest.get(t or "", -1), -1 if i is None else i)
    assert {t or "": -1 if i is None else i for i, t in held[2]} == largest and len(held[2]) == len(largest)

    order = sorted(held[2], key=lambda r: (r[0] is None, r[0] or 0))
    tops = plain_components([plain_fingerprint(t) for _, t in order])
    assert held[3] == sorted({order[t] for t in tops}, key=str) and len(held[3]) < len(held[2])

    rated = mixing.rated_documents(outs[3])
    drawn = rated.filter(mixing.draw(rated["_in_0"], rated["_in_1"]) < rated["probability"]).count()
    assert len(held[4]) == drawn and set(held[4]) <= set(held[3])

    checked(outs[5].withColumnRenamed("doc_id", "id").collect(), held[4], 1024)
    whole = entry.queries()["pipeline"](spark, str(tmp_path))
    rows = [sorted(map(str, o.select("doc_id", "piece", "ids_crc32").collect())) for o in (whole, outs[5])]
    assert rows[0] == rows[1]


def test_all_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names


def test_fingerprints_of_long_batches_do_not_depend_on_cuts():
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 3000)) for _ in range(120)]
    whole = simhash.text_fingerprints(pa.array(texts))
    parts = np.concatenate([simhash.text_fingerprints(pa.array(texts[i : i + 7])) for i in range(0, 120, 7)])
    assert whole.tolist() == parts.tolist()
