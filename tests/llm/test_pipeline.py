import random
import struct
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm.queries import tokenizer_file

from . import test_copies, test_mixing, test_substrings, test_toxicity
from .test_toxicity import corpus
from .texts import AWKWARD, SCHEMA


def test_every_stage_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts, labels = corpus(rng, 240)
    passage = " ".join(f"p{k}" for k in range(70))
    own = lambda n: [f"o{rng.randrange(10**6)}" for _ in range(n)]  # noqa: E731  so much that the texts are no near copies
    texts += [t + " end" for t in texts[:6]] + texts[6:12] + [" ".join([*own(40), passage, *own(40)]) for _ in range(5)] + AWKWARD
    rows = [(k, t, "en", [None, "a", "b", "c"][k % 4], 7) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    scores = test_toxicity.brute_scores(rows, labels, test_toxicity.digests(docs))
    got = stages["toxicity"](spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    left = sorted(got.collect())
    assert left == sorted(tuple(r) for r in rows if scores[r[0]] < 0.5) and len(left) < len(rows)

    docs = spark.createDataFrame(left, SCHEMA)
    got = sorted(stages["near_duplicates"](spark, docs.union(docs.limit(3)), str(tmp_path)).collect())
    assert got == [left[i] for i in sorted(test_copies.brute([r.text for r in left]))] and len(got) < len(left)

    left, docs = got, spark.createDataFrame(got, SCHEMA)
    got = sorted(stages["repeated_passages"](spark, docs, str(tmp_path)).collect())
    want = test_substrings.brute([(r.doc_id, r.text) for r in left], 50)
    assert [r.doc_id for r in got] == [r.doc_id for r in left] and any(w[1] for w in want.values())
    for before, after in zip(left, got, strict=True):
        n, gone, _ = want[before.doc_id, before.text]
        assert len((after.text or "").encode().split()) == n - gone and after.n_chars == (None if after.text is None else len(after.text))
        if not gone:
            assert after.text == before.text

    left, docs = got, spark.createDataFrame(got, SCHEMA)
    got = stages["mixing"](spark, docs, str(tmp_path)).collect()
    size = {r.doc_id: len((r.text or "").encode().split()) for r in left}
    of, took = Counter(), Counter()
    for r in left:
        of[r.source] += size[r.doc_id]
    for r in got:
        took[r.source] += len(r.text.encode().split())
    target = test_mixing.fill(of, (5, 2, 1))
    assert {s: n for s, n in took.items() if n} == {s: int(t + 1e-6) for s, t in target.items() if int(t + 1e-6)}
    whole = {r.doc_id: r for r in left}
    cut = [r for r in got if r.text != whole[r.doc_id].text]
    assert len(cut) <= len(of) and all(whole[r.doc_id].text.split()[: len(r.text.split())] == r.text.split() for r in cut)
    assert all(n <= 3 for n in Counter(r.doc_id for r in got if r not in cut).values())

    tokenizer = Tokenizer.from_file(tokenizer_file())
    pieces = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.sequence_id & (1 << 58) - 1))
    whole_ids = Counter((r.doc_id, struct.pack(f"<{len(i)}I", *i)) for r in got for i in [[*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]])
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(d for (d, _), n in whole_ids.items() for _ in range(n))
    assert sum(len(p.ids) for p in pieces) == sum(len(b) * n for (_, b), n in whole_ids.items())
    streams = {}
    for d, ids in whole_ids:
        streams.setdefault(d, []).append(ids)
    assert all(any(s[4 * p.start : 4 * (p.start + p.length)] == p.ids for s in streams[p.doc_id]) for p in pieces)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
