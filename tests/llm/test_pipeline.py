import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import neardup, secrets
from barloom.llm.common import byte_words, documents

from .test_operators import SF, TOKEN, brute_leaks


def test_stages_against_a_plain_version(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r["doc_id"]: r["text"] for r in documents(spark, SF).collect() if any(c.isalpha() for c in r["text"] or "")}
    w = {d: byte_words(t.encode()) for d, t in left.items()}
    root = {d: d for d in left}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i in sorted(left):
        for j in sorted(left):
            if j < i and (left[i] == left[j] or (w[i] and w[j] and neardup.edit_similarity(w[i], w[j]) >= 0.8)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    left = {d: t for d, t in left.items() if find(d) == d}
    leaked = {r[0] for r in brute_leaks(left.items(), items) if r[-1]}
    left = {d: TOKEN.sub(lambda m: m.group(0).replace(m.group(1), secrets.MASK), t) for d, t in left.items() if d not in leaked}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, got = corpus_pipeline.run(spark, SF).collect(), {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        got.setdefault(p["doc_id"], []).extend(np.frombuffer(p["ids"], "<u4").tolist())
    assert set(got) == set(left)
    assert all(got[d] == [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for d, t in left.items())


def test_stages_keep_the_columns_of_documents(spark):
    docs = documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
