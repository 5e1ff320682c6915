"""Null ids, repeated rows, long texts and clashing names through every operator; brute force for those that SQL cannot express."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

WORDS = "river stone market evening window garden letter morning story people water summer company report travel music history city".split()
#: Columns that operators use inside, as columns of the input.
CLASH = ("id", "k", "h", "fp", "keys", "first", "last", "doc", "tag", "marks", "n", "score", "x", "y", "norm", "bucket", "salt", "__id", "c", "best", "root", "key", "part", "value")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(3)
    long = " ".join(rnd.choice(WORDS) for _ in range(15000))
    body = " ".join(rnd.choice(WORDS) for _ in range(60))
    rows = [(None, body), (None, body), (None, None), (4, body), (4, body), (5, body + "\nand one line more"), (6, "and one line more"), (7, long), (8, ""), (9, None), (4, "another text of the same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return rows, df.select("doc_id", "text", *(F.lit(i).alias(c) for i, c in enumerate(CLASH)))


def rows_of(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_line_dedup_edges(odd):
    from graphloom.llm.line_dedup import dedup_lines, line_keys

    rows, df = odd
    holds = {}
    for i, t in rows:
        for key in line_keys(t or ""):
            holds.setdefault(key, set()).add(float("inf") if i is None else i)
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        drop = [len(k.decode()) >= 10 and len(holds[k]) > 1 and min(holds[k]) < (float("inf") if i is None else i) for k in line_keys(t or "")]
        want[i, len(lines), sum(drop), sha("\n".join(x for x, d in zip(lines, drop, strict=True) if not d))] += 1
    assert rows_of(dedup_lines(df), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want


def test_simhash_edges(odd):
    from graphloom.llm.simhash import near_duplicates, shingle_hashes, simhash, simhash_components, without_near_duplicates

    rows, df = odd
    fp = {t: f"{simhash(shingle_hashes(t or '', 3)):016x}" for _, t in rows}
    got = simhash_components(df).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, fp[t]) for i, t in rows)
    assert {r.component_id for r in got if r.fingerprint == fp[rows[3][1]]} == {4} and {r.component_id for r in got if r.fingerprint == "0" * 16} == {8}
    assert {r.doc_id: r.keep_id for r in near_duplicates(df).collect() if r.doc_id != r.keep_id} == {9: 8, 5: 4}  # null ids take no part
    assert without_near_duplicates(df).columns == df.columns and {r.doc_id for r in without_near_duplicates(df).collect()} == {None, 4, 6, 7, 8}


def test_tokenizers_edges(odd):
    import sentencepiece
    from tokenizers import Tokenizer

    from graphloom.llm.pieces import encode_decode
    from graphloom.llm.tokens import token_counts

    rows, df = odd
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    want = Counter((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert rows_of(token_counts(df, path), "doc_id", "n_bytes", "n_tokens") == want
    assert any(len(t or "") > 1 << 16 for _, t in rows)  # the long text goes through chunks
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = {t: sp.encode(t or "") for _, t in rows}
    want = Counter((i, len(ids[t]), sha(",".join(map(str, ids[t]))), sha(sp.decode(ids[t]))) for i, t in rows)
    assert rows_of(encode_decode(df, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_token_chunks_of_any_cut():
    from graphloom.llm import tokens as T

    c = T.counter(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcsltmrevd'!<|>日本한각가ㅏᅡᆨ́é 12\n") for _ in range(400)) + "<|endoftext|>" * 3 + "z" * 300
    whole = c.whole(text)
    for chunk in (1, 2, 7, 50, 399):
        at = [(0, "end"), *c.cuts(text, chunk), (len(text), "end")]
        maps = [c.chunk(text[i:j], before, after) for (i, before), (j, after) in zip(at, at[1:], strict=False)]
        left, right = maps[0], maps[-1]  # composition is associative: from the left, from the right, and pairwise
        for m in maps[1:]:
            left = c.compose(left, m)
        for m in maps[-2::-1]:
            right = c.compose(m, right)
        assert {m.inside + c.transducer.close(m.tail) for m in (left, right, c.scan(maps))} == {whole}


def test_token_states_are_bounded(monkeypatch):
    from graphloom.llm import tokens as T

    monkeypatch.setattr(T, "STATES", 500)
    c = T.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(2)
    word = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20000))
    assert c.count(word, chunk=400) == T.counter(public_tokenizers.path("word_bpe_49k.json")).count(word) and len(c.transducer.keys) <= 500 + 401


def test_suffix_dedup_edges(odd):
    from graphloom.llm.suffix_dedup import dedup_substrings

    rows, df = odd
    # equal rows are one document; rows that share an id come by a hash of the text
    import xxhash

    order = lambda r: (r[0] is None, r[0] or 0, xxhash.xxh3_64_intdigest((r[1] or "").encode()))
    seen, want = set(), {}
    for i, t in sorted(set(rows), key=order):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        want[i, t] = (i, len(raw), int(gone.sum()), sha(bytes(np.frombuffer(raw, np.uint8)[~gone])))
    assert rows_of(dedup_substrings(df), "doc_id", "n_bytes", "n_removed", "kept_sha256") == Counter(want[r] for r in rows)


def test_suffix_dedup_of_cut_texts(spark, monkeypatch):
    from graphloom.llm import suffix_dedup as S

    rnd = random.Random(4)
    base = "".join(rnd.choice("abc ") for _ in range(3000))
    long = "".join(rnd.choice("xyz ") for _ in range(40)).join([base, base[500:2500], base])
    blocks = list(S.text_blocks(iter([(1, 2, long.encode())]), 100, 32))
    assert len(blocks) == 1
    monkeypatch.setattr(S, "BLOCK", 512)
    parts = list(S.text_blocks(iter([(1, 2, long.encode())]), 100, 32))
    assert len(parts) > 10
    found = set()
    for _, texts, shift in parts:  # every window of the text lies in one anchor's context of some part, with the same key
        of, a, lo, hi, h, context, _, _ = S.anchors(texts, 100, 32)
        found |= {(int(x) + shift) for l, u in zip(lo, hi, strict=True) for x in range(l, u + 1)}
    assert found == set(range(len(long) - 99))


def test_suffix_sort_compares_bytes_once(monkeypatch):
    from graphloom.llm import suffix_dedup as S

    def hashed(*_):
        raise AssertionError("a window's comparison hashes its prefixes again")

    monkeypatch.setattr(S.PrefixHashes, "of", hashed)
    rnd = random.Random(5)
    base = bytes(rnd.choice(b"\0\1a\xff") for _ in range(160))
    contexts = [base[:90] + bytes(rnd.choice(b"\0a\xff") for _ in range(2)) + base[92:] for _ in range(40)] + [base[:-5] + bytes(5), bytes(160), base]
    c = S.Contexts(contexts, 100)
    segment = np.repeat(np.arange(61) * 3, len(contexts))
    who = np.tile(np.arange(len(contexts)), 61)
    at = c.begin[who] + segment // 3
    windows = [(int(s), contexts[w][s // 3 : s // 3 + 100]) for s, w in zip(segment, who, strict=True)]
    assert [windows[i] for i in c.sort(at, segment)] == sorted(windows)
    rank = np.array([rnd.randrange(1000) for _ in windows])
    least = {}
    for x, r in zip(windows, rank, strict=True):
        least[x] = min(r, least.get(x, r))
    assert c.repeats(at, segment, rank).tolist() == [r > least[x] for x, r in zip(windows, rank, strict=True)]
    none = np.zeros(0, np.int64)
    assert len(c.sort(none, none)) == len(c.repeats(none, none, none)) == 0


def test_removal_of_marks():
    from graphloom.llm.suffix_dedup import removal

    rnd = random.Random(6)
    for length in (1, 7, 100):
        for _ in range(60):
            raw = rnd.randbytes(rnd.randrange(length, length + 200))
            first = np.array([rnd.randrange(len(raw) - length + 1) for _ in range(rnd.randrange(6))], np.int64)
            last = np.array([rnd.randrange(f, len(raw) - length + 1) for f in first], np.int64)
            starts = [[rnd.random() < 0.3 for _ in range(f, e + 1)] if rnd.random() < 0.5 else None for f, e in zip(first, last, strict=True)]
            gone = np.zeros(len(raw), bool)
            for f, e, some in zip(first, last, starts, strict=True):
                for p in range(f, e + 1):
                    if some is None or some[p - f]:
                        gone[p : p + length] = True
            kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
            masks = {i: np.packbits(some).tobytes() for i, some in enumerate(starts) if some is not None}
            assert removal(raw, first, last, masks, length) == (int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), sha(kept))


def test_suffix_dedup_past_the_blocks(spark):
    from graphloom.llm import suffix_dedup as S

    rnd = random.Random(7)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(4 * S.BLOCK + 500))
    at = S.BLOCK  # where the long text is cut
    rows = [(1, long), (2, long[at - 300 : at + 300]), (3, "y" * 50 + long[at - 90 : at + 30] + "z"), (4, long[: 2 * at] + "Q" + long[2 * at :]), (5, long[3 * at - 99 : 3 * at] + "!")]
    seen, want = set(), set()
    for i, t in rows:
        raw, gone = t.encode(), np.zeros(len(t), bool)
        for p in range(len(raw) - 99):
            w = hashlib.blake2b(raw[p : p + 100], digest_size=16).digest()
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        want.add((i, len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), sha(bytes(np.frombuffer(raw, np.uint8)[~gone]))))
    assert set(map(tuple, S.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == want


def test_suffix_dedup_frees_what_is_done(spark, monkeypatch):
    import time

    from graphloom.llm import suffix_dedup as S

    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    there, left, paths, stored = shuffles(), {}, {}, S.stored

    def watched(df, label):
        end = time.time() + 30
        while label == "substring-marks" and shuffles() - there and time.time() < end:  # Spark deletes them beside the job
            time.sleep(0.2)
        left[label] = shuffles() - there
        out = stored(df, label)
        paths[label] = out._graphloom_path.removeprefix("file://")
        if label == "substring-marks":
            left["tables"] = sorted(x for x, at in paths.items() if os.path.exists(at))
        return out

    monkeypatch.setattr(S, "stored", watched)
    rnd = random.Random(8)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    rows = [(i, base[: 300 + i] + "x" * i + base[i:]) for i in range(6)]
    S.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert left["substring-marks"] == set()
    assert left["tables"] == ["substring-anchors", "substring-firsts", "substring-marks"]


def brute_found(items, text, width=5, similarity=0.8):
    """Items found in a text: every window against every window, by the definition."""
    from graphloom.llm.decontaminate import SLOTS, canonical, lowered

    def windows(template, values, w):
        out = []
        for i in range(len(template) - w + 1):
            t = tuple(template[i : i + w])
            out.append((t, tuple(lowered(v) for v in values[i : i + w]) if all(x in SLOTS for x in t) else ()))
        return out

    best = {}
    for starts in (False, True):
        theirs_t, theirs = canonical(text, starts)
        for item, own_text in items:
            t, own = canonical(own_text, starts)
            if not t or starts and len(t) < width:
                continue
            w = min(width, len(t))
            mine, other = windows(t, own, w), windows(theirs_t, theirs, w)
            pairs = sorted(((i, p) for i, a in enumerate(mine) for p, b in enumerate(other) if a == b), key=lambda x: (x[1] - x[0], x[1]))
            total, run = len(set(mine)), []
            for pair in [*pairs, None]:
                if run and (pair is None or (pair[1] - pair[0]) - (run[-1][1] - run[-1][0]) > max(3, len(t) // 5)):
                    slots, seen = {}, set()
                    for i, p in sorted(run):
                        if all(slots.setdefault(own[i + j], theirs[p + j]) == theirs[p + j] for j in range(w) if own[i + j]):
                            seen.add(mine[i])
                    if len(seen) / total >= similarity:
                        best[item] = max(best.get(item, 0), len(seen) / total)
                    run = []
                if pair:
                    run.append(pair)
    return best


def test_decontamination_against_brute_force(spark):
    from graphloom.llm.decontaminate import contamination

    rnd = random.Random(6)
    names = ["Anna", "Berta", "Carl", "Dora", "Emil"]

    def question():
        a, b = rnd.sample(names, 2)
        return " ".join(rnd.choice([f"{a} has {rnd.randrange(90)} {rnd.choice(WORDS)} and {rnd.randrange(9)} kg of {rnd.choice(WORDS)}.", f"{b} gives {a} {rnd.randrange(9)} dollars for the {rnd.choice(WORDS)} in the {rnd.choice(WORDS)}.", f"How many {rnd.choice(WORDS)} does {a} keep?"]) for _ in range(rnd.randrange(1, 4)))

    items = [(i, question()) for i in range(25)] + [(90, "1 2 3 4 5 6 7 8"), (91, "city"), (92, ""), (93, " ".join(rnd.choice(WORDS) for _ in range(30)))]
    texts = []
    for i in range(120):
        t = rnd.choice(items)[1]
        if i % 3 == 0:
            for n in names:
                t = t.replace(n, rnd.choice(names))
        if i % 4 == 0:
            t = "".join(str(rnd.randrange(9)) if c.isdigit() and rnd.random() < 0.5 else c for c in t)
        if i % 5 == 0:
            w = t.split()
            del w[len(w) // 2 : len(w) // 2 + 1 + i % 3]
            t = " ".join(w)
        texts.append((i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(20))) + rnd.choice([". ", " "]) + t + rnd.choice(["", " " + t, ". " + question()])))
    texts += [(500, "9 8 7 6 5 4 3 2 1 2 3 4 5 6 7 8 9"), (501, " ".join(map(str, range(300)))), (None, items[0][1]), (None, items[0][1]), (502, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_items", F.lit("clash")).withColumn("similarity", F.lit(0))
    got = rows_of(contamination(df, spark.createDataFrame(items + [(3, None)], "item_id long, text string").where("item_id <> 3 OR text IS NOT NULL")), "doc_id", "n_items", "item_id", "similarity")
    want = Counter()
    for i, t in texts:
        found = brute_found(items, t or "")
        item = min(found, key=lambda x: (-found[x], x)) if found else None
        want[i, len(found), item, found.get(item, 0.0)] += 1
    assert got == want and sum(n for (_, k, _, _), n in want.items() if k) > 40


def page(rnd, kind):
    """A page without article or main element: every block is a plain div of no telling name."""
    sentence = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."
    want, body = [sentence(5)], []
    body.append(f"<h1>{want[0]}</h1>")
    for k in range(rnd.randrange(4, 10)):
        if kind == "headings" and k % 3 == 2:
            want.append(sentence(3))
            body.append(f"<h2>{want[-1]}</h2>")
        if kind == "list" and k == 2:
            points = [sentence(rnd.randrange(4, 9)) for _ in range(4)]
            want += points
            body.append("<ul>" + "".join(f"<li>{x}</li>" for x in points) + "</ul>")
        want.append(" ".join(sentence(rnd.randrange(6, 16)) for _ in range(rnd.randrange(2, 5))))
        body.append(f"<p>{want[-1]}</p>")
        if kind == "short" and k % 2:
            want.append(sentence(4))
            body.append(f"<p>{want[-1]}</p>")
    links = "".join(f'<li><a href="/{i}">{sentence(2)}</a></li>' for i in range(8))
    side = "".join(f'<div><a href="/s{i}">{sentence(4)}</a></div>' for i in range(6))
    html = f'<html><body><div class="x0"><a href=/>{sentence(2)}</a></div><ul class="x1">{links}</ul><div class="x2"><div class="x3">{"".join(body)}</div><div class="x4">{side}</div></div><div class="x5"><p>{sentence(6)}</p><a href=/c>{sentence(2)}</a></div></body></html>'
    return html, "\n".join(want)


@pytest.mark.parametrize("kind", ["plain", "headings", "list", "short"])
def test_html_without_markup_that_tells(kind):
    from graphloom.llm.html_text import main_text

    rnd = random.Random(8)
    pages = [page(rnd, kind) for _ in range(40)]
    assert sum(main_text(h) == w for h, w in pages) >= 38


def test_html_threshold_decides(monkeypatch):
    import graphloom.llm.html_text as H

    rnd = random.Random(9)
    pages = [page(rnd, "plain") for _ in range(20)]
    assert all(H.main_text(h) == w for h, w in pages)
    monkeypatch.setattr(H, "threshold", lambda values: -1.0)  # every line above it
    assert not any(H.main_text(h) == w for h, w in pages)


def test_toxicity_features_against_brute_force(spark):
    from graphloom.llm import toxicity as T

    def grams(text):
        raw, out, mask = T._WHITE.sub(b" ", b" " + text.lower().encode() + b" "), set(), (1 << 64) - 1
        for n in T.SIZES:
            for i in range(len(raw) - n + 1):
                h = raw[i] + 1
                for b in raw[i + 1 : i + n]:
                    h = (h * int(T._STEP) + b + 1) & mask
                x = ((h ^ (h >> 29) ^ n) * 0xBF58476D1CE4E5B9) & mask
                out.add(x >> (64 - T.BITS))
        return out

    for text in ["", "a", "Hello  World\n", "é" * 50, "xyz " * 80]:
        assert set(T.present(text).tolist()) == grams(text)
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(WORDS) for _ in range(12)) + (" scumbag" if i % 4 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows + [(None, "scumbag"), (None, "scumbag"), (3, rows[3][1])], "doc_id long, text string").withColumn("y", F.lit(1)).withColumn("score", F.lit(2))
    model = T.train(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(8, 0)], "doc_id long, toxic int"))
    got = T.toxicity_scores(docs, model).collect()
    for r, t in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted([*rows, (3, rows[3][1])]) + [(None, "scumbag")] * 2, strict=True):
        z = model.bias + sum(float(model.weights[g]) for g in grams(t[1]))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-5 and r.predicted == int(r.score >= 0.3)
    assert [r.held_out for r in got if r.doc_id is None] == [False, False] and T.without_toxic(docs, model).columns == docs.columns


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline as P

    rnd = random.Random(2)
    text = lambda: " ".join(rnd.choice(WORDS) + str(rnd.randrange(50)) for _ in range(40))
    rows = [(i, text() + (" scumbag" if i % 5 == 0 else "")) for i in range(60)] + [(None, text()), (None, None), (70, None), (71, ""), (72, text() * 200)]
    sf = f"{tmp_path}/sf"
    cols = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    cols.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, text())], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("__id", F.lit(1)).withColumn("id", F.lit(2))
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.where("false"), sf).count() == 0
    left = {r.doc_id for r in P.run(spark, sf).collect()}
    assert left == {None, 70, 72} | {i for i in range(60) if i % 5}  # of the empty texts one stays, whatever its id
