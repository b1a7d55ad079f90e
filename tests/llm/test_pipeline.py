"""The pipeline's stages against plain versions, each on its predecessor's rows."""

import numpy as np

import corpus_pipeline
from scopeloom.llm import near_dedup
from scopeloom.llm.common import stored, words

from .test_operators import brute_decontamination


def make(tmp_path, spark):
    rng = np.random.default_rng(8)
    parts = ["th", "er", "on", "an", "re", "he", "in"]
    plain = lambda n=60: ["".join(rng.choice(parts, 3)) for _ in range(n)]
    texts, labels = [], []
    for i in range(300):
        w = plain()
        if i % 5 == 0:
            w[7] = w[30] = "nasty"
        texts.append(" ".join(w))
        labels.append((i, 1, int(i % 5 == 0)))
    passage = plain(30)
    texts += [texts[1], texts[1], texts[2].upper(), None, "", " ".join([*passage[2:16], *plain(40)])]
    for source in (3, 4):
        w = texts[source].split()
        w[20] = "changed"
        texts.append(" ".join(w))
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(passage)), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, [(1, " ".join(passage)), (2, None)]


def test_stages(spark, tmp_path):
    folder, texts, items = make(tmp_path, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, set(range(len(texts)))
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, folder))
        if name == "toxicity":
            left -= {i for i in range(300) if i % 5 == 0}
        elif name == "exact_dedup":
            last = {}
            for i in sorted(left):
                last[texts[i] or ""] = i
            left = set(last.values())
        elif name == "near_dedup":
            order = sorted(left)
            codes = {i: near_dedup.word_codes(words(texts[i])) for i in order}
            dropped = {b for b in order for a in order if a < b and len(codes[a]) and len(codes[b]) and near_dedup.similarity(codes[a], codes[b]) > 0}
            assert len(dropped) >= 3
            left -= dropped
        elif name == "decontamination":
            left -= {i for i in left if brute_decontamination([texts[i]], items)[0][4]}
        else:
            tokens = {r.doc_id: r.n for r in out.groupBy("doc_id").sum("length").withColumnRenamed("sum(length)", "n").collect()}
            assert tokens.keys() == left and all(tokens[i] == 1 for i in left if not texts[i])
            continue
        assert out.columns == columns and {r.doc_id for r in out.collect()} == left, name
        docs = out
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == left


def test_no_documents(spark, tmp_path):
    folder, _, _ = make(tmp_path, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder))
        assert docs.count() == 0, name


def test_rows_are_told_apart(spark, tmp_path):
    """Null and repeated ids, repeated rows and other columns named like the operators' own."""
    folder, texts, items = make(tmp_path, spark)
    words_of = [t for t in texts[1:60] if t and "nasty" not in t]
    leak = items[0][1]
    rows = [
        (3, words_of[0], "a"), (3, words_of[1], "b"), (4, words_of[1], "c"),  # 3 with a text of its own stays, the copy under 3 goes
        (None, words_of[2], "d"), (8, words_of[2], "e"), (None, words_of[3], "f"), (None, words_of[3], "g"), (None, leak, "h"), (9, leak + " " + words_of[4], "i"),
        (5, words_of[5], "j"), (5, words_of[5], "k"), (6, None, "l"), (7, "", "m"), (None, words_of[6].replace("th", "th", 1) + " end", "n"), (10, words_of[6], "o"),
    ]
    schema = "doc_id bigint, text string, lang string, row_key string, kept string, spans string, id string, count bigint"
    docs = spark.createDataFrame([(*r, "k", "k", "s", "i", 1) for r in rows], schema)
    stages = dict(corpus_pipeline.STAGES)
    exact = stored(stages["exact_dedup"](spark, docs.drop("row_key"), folder))
    assert sorted(r.lang for r in exact.collect()) == ["a", "c", "e", "f", "h", "i", "j", "m", "n", "o"]
    near = stored(stages["near_dedup"](spark, exact, folder))
    assert sorted(r.lang for r in near.collect()) == ["a", "c", "e", "f", "h", "i", "j", "m", "o"]
    clean = stored(stages["decontamination"](spark, near, folder))
    assert sorted(r.lang for r in clean.collect()) == ["a", "c", "e", "f", "j", "m", "o"]
    assert clean.columns == exact.columns == docs.drop("row_key").columns
