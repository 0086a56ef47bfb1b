"""The pipeline and the registered queries of the subpackage."""

import importlib

import pytest
from oracle import compare, connect

from sqlbranch.llm import queries as registered

pytest.importorskip("public_tokenizers")


def test_pipeline(spark, sf):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, before = docs.columns, docs
    counts = [docs.count()]
    for name, stage in pipeline.STAGES:
        after = pipeline.stored(stage(spark, before, sf), "test-stage")
        counts.append(after.count())
        if name != pipeline.STAGES[-1][0]:
            assert after.columns == names and after.join(before, "doc_id", "left_anti").count() == 0
            assert after.groupBy("doc_id").count().filter("count > 1").count() == 0
            if name != "substring dedup":
                assert after.exceptAll(before).count() == 0
        before = after
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2
    assert sorted(map(str, pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect())) == sorted(map(str, before.select("doc_id", "ids_sha256").collect()))


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(spark, sf, name):
    sql = registered.oracle_sql().get(name)
    if sql:
        assert compare(spark, connect(sf), registered.queries()[name], sql, sf) == ""
    else:
        table = "pages" if name.startswith(("op6", "op10")) else "documents"
        assert registered.queries()[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_stages_on_odd_rows(spark, sf, odd, nothing):
    pipeline = importlib.import_module("corpus_pipeline")
    for docs in (odd, nothing):
        for _, stage in pipeline.STAGES:
            docs = pipeline.stored(stage(spark, docs, sf), "test-odd")
        assert docs.count() == (6 if docs.columns and docs.limit(1).count() else 0)


def plain_pipeline(docs, models, items, library):
    """The stages one after another over a list of (doc_id, text), comparing everything with everything."""
    from test_operators import plain_hits

    from sqlbranch.llm import simhash, substring
    docs = sorted((k, t) for k, t in docs if models.score(t.encode()) < 0.7)
    prints = {k: simhash.fingerprint(t.encode()) for k, t in docs}
    first = {}
    for k, _ in docs:  # in order of doc_id, so each group is known by its first document
        near = {first[j] for j in first if (prints[k] ^ prints[j]).bit_count() <= 3}
        first[k] = min(near, default=k)
        for j in first:
            if first[j] in near:
                first[j] = first[k]
    docs = [(k, t) for k, t in docs if first[k] == k]
    kept = []
    shingles = {k: substring.shingles_of(t.encode()) for k, t in docs}
    for n, (k, t) in enumerate(docs):
        spans = sorted((p, q + substring.SHINGLE) for j, _ in docs[:n] for p, q, _, _ in substring.common_passages(shingles[k], shingles[j]))
        text = substring.without_words(t, [{"lo": p, "hi": q} for p, q in spans])
        if not spans or text.split():
            kept.append((k, text))
    kept = [(k, t) for k, t in kept if plain_hits(t, items)[1] == 0]
    return {k: library.encode_ordinary(t) for k, t in kept}


def test_pipeline_as_a_plain_one(spark, prose, tmp_path):
    import base64
    import random
    import struct

    import public_tokenizers
    import tiktoken

    from sqlbranch.llm import toxicity

    rng, pipeline = random.Random(11), importlib.import_module("corpus_pipeline")
    shared, item, long = prose(70), prose(30), prose(3000)
    texts = [prose(rng.randint(60, 160)) for _ in range(60)]
    texts += [texts[3], texts[5], long, long + " tail", "start " + long, prose(50) + " " + shared, shared + " " + prose(40), shared, prose(30) + "\n" + item + "\n" + prose(30), "", " ", "one two"]
    texts += [" ".join(w if k % 12 else "vilgar" for k, w in enumerate(prose(80).split())) for _ in range(60)]
    labels = [(k, int("vilgar" in t)) for k, t in enumerate(texts) if k % 2]
    items = [(1, item), (2, prose(20)), (3, "")]
    spark.createDataFrame([(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held, docs = toxicity.held_out(), spark.read.parquet(f"{tmp_path}/documents.parquet")
    models = toxicity.train(docs.filter(~held), spark.read.parquet(f"{tmp_path}/labels.parquet").filter(~held))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = plain_pipeline(list(enumerate(texts)), models, items, library)
    got = {r.doc_id: bytes(r.ids) for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {k: struct.pack(f"<{len(ids)}I", *ids) for k, ids in wanted.items()}
    assert not {60, 61, 63, 64, 67, 68} & got.keys() and {62, 65, 66, 71} <= got.keys() and all("vilgar" not in texts[k] for k in got)
