"""Every stage of the corpus pipeline on its own input, against plain versions; then the whole run."""

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from tabflow.llm.tokens import tokenizer_path
from tabflow.session import materialize
from tests.llm import corpus


def test_stages_and_run(spark, write_tables):
    rows = corpus.documents(seed=11, repeated=False)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 70, 4)], "doc_id long, quality int")
    folder = write_tables(documents=spark.createDataFrame(rows, corpus.SCHEMA).repartition(3), labels=labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, plain = docs.columns, rows
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near duplicates", "mix", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), "stage")
        found = docs.collect()
        if name == "packing":
            break
        assert docs.columns == columns
        if name == "language":
            left = {r.doc_id for r in found}
            plain = [r for r in rows if r[0] in left]
            gone = [r[1] for r in rows if r[0] not in left]
            assert all(not any(c.isalpha() for c in t or "") or len(corpus.words(t)) <= 8 or t.startswith("aaa") for t in gone)
        elif name == "lines":
            plain = [(r[0], t, *r[2:]) for r, t in zip(plain, corpus.recurring_lines(plain), strict=True)]
        elif name == "near duplicates":
            known = corpus.jaccard_components(plain)
            plain = [r for r in plain if known[r[0]] == r[0]]
        else:
            quality = {i: i % 2 for i in range(0, 70, 4)}
            plain = [r for r, n in zip(plain, corpus.mixed(plain, quality), strict=True) for _ in range(n)]
        assert sorted((r.doc_id, r.text) for r in found) == sorted((r[0], r[1]) for r in plain)
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {r[1]: [*tokenizer.encode(r[1], add_special_tokens=False).ids, 1] for r in plain}
    want = sorted((r[0], k, corpus.crc(ids[r[1]][k : k + 4096])) for r in plain for k in range(0, len(ids[r[1]]), 4096))
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in found) == want
    again = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.start, r.ids_crc32, r.sequence_id, r.offset) for r in again.collect()) == sorted((r.doc_id, r.start, r.ids_crc32, r.sequence_id, r.offset) for r in found)
    held = np.bincount([r.sequence_id for r in found], [r.length for r in found])
    assert held.max() <= 4096
