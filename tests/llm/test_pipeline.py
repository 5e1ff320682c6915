"""The pipeline on a small folder of tables, against what was planted and the tokenizer's library."""

import hashlib
import random

import public_tokenizers
import sentencepiece

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rnd = random.Random(11)
    prose = lambda n: " ".join(rnd.choice(WORDS) + str(rnd.randrange(60)) for _ in range(n))
    docs, labels, gone = [], [], {s: set() for s in ("toxic", "copy", "near", "leak")}
    for i in range(400):
        w = prose(80).split()
        if i % 8 == 0:
            w[rnd.randrange(80)] = rnd.choice(["scumbag", "moronic", "trashy"])
            gone["toxic"].add(i)
        docs.append((i, " ".join(w)))
        labels.append((i, 0, int(i % 8 == 0)))
    items = [(k, prose(25)) for k in range(5)]
    for k, (i, t) in enumerate([d for d in docs if d[0] not in gone["toxic"]][:40]):
        new = 1000 + i
        kind = ("copy", "near", "leak")[k % 3]
        w = t.split()
        w[40] = "other"
        docs.append((new, {"copy": t.replace(" ", "\n"), "near": " ".join(w), "leak": prose(30) + ". " + items[k % 5][1] + " " + prose(20)}[kind]))
        gone[kind].add(new)
    docs.append((5000, None))
    sf = f"{tmp_path}/sf"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    left, before = table, {i for i, _ in docs}
    for (name, stage), kind in zip(P.STAGES[:-1], ("toxic", "copy", "near", "leak"), strict=True):
        out = stage(spark, left, sf)
        assert out.columns == table.columns, name
        out.write.parquet(f"{tmp_path}/{kind}")
        left = spark.read.parquet(f"{tmp_path}/{kind}")
        now = {r.doc_id for r in left.select("doc_id").collect()}
        assert before - now == gone[kind], name
        before = now
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(docs)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in P.run(spark, sf).collect()}
    want = {i: lib.encode(texts[i] or "") for i in before}
    assert got == {i: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in want.items()}
