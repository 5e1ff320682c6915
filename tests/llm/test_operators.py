"""Each operator against brute force, a library or an exact round trip, with the odd cases of its docstring."""

import bisect
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    texts = [None, "", " ", "a", "a  ", "x" * 3000, "é ü\n\nß\n"] + [prose(rnd, rnd.randrange(1, 90)) for _ in range(60)]
    texts += [texts[20], texts[20] + " ", texts[21].upper(), texts[22] + "\n" + texts[23], texts[23] + "\nlast line here", texts[23] + "\nlast line here"]
    return [(i, t, "en") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    from graphloom.llm.common import ship

    ship(spark)
    # extra columns whose names the operators use inside
    return spark.createDataFrame([(*r, 1, "z") for r in corpus], DOCS + ", h int, sha string")


@pytest.fixture(scope="module")
def empty(spark, docs):
    return docs.where("false")


def test_exact_dedup(docs, empty, corpus, spark):
    from graphloom.llm.exact_dedup import exact_duplicates, grow, slots, without_duplicates

    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t, _ in corpus}
    groups = defaultdict(list)
    for i, t, _ in corpus:
        groups[norm[i]].append((-len(t or ""), i))
    want = {(i, min(groups[n])[1], len(groups[n]), min(groups[n])[1] == i, sha(n)) for i, n in norm.items()}
    assert set(map(tuple, exact_duplicates(docs).collect())) == want
    assert set(map(tuple, exact_duplicates(docs, capacity=3).collect())) == want
    assert {r.doc_id for r in without_duplicates(docs).collect()} == {w[0] for w in want if w[3]}
    assert exact_duplicates(empty).count() == 0
    nulls = spark.createDataFrame([(None, "q"), (3, "q"), (None, "r")], "doc_id long, text string")
    assert sorted(map(str, (tuple(r)[:4] for r in exact_duplicates(nulls).collect()))) == sorted(map(str, [(None, 3, 2, False), (3, 3, 2, True), (None, None, 1, True)]))
    clash = docs.select("*", F.lit(1).alias("__id"), F.lit(2).alias("dropped_id"), F.lit(3).alias("norm"))
    assert {r.doc_id for r in without_duplicates(clash).collect()} == {w[0] for w in want if w[3]} and without_duplicates(clash).columns == clash.columns
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "ab"), (2, "ab ")], "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in exact_duplicates(twice).collect()) == [(1, 1, 4, True)] * 3 + [(2, 1, 4, False)]

    rnd = random.Random(1)
    for n, capacity in ((0, 3), (1, 3), (5, 1), (3000, 3)):
        hashes = [rnd.getrandbits(64) for _ in range(n)] + [7] * (n // 500)
        count = lambda depth, below: Counter(h >> (64 - depth) for h in hashes if any(h >> (64 - bits) == p for p, bits in below))
        leaves = grow(count, capacity)
        assert sum(1 << (64 - bits) for _, bits in leaves) == 1 << 64  # the ranges cover all keys
        starts = [p << (64 - bits) for p, bits in leaves]
        held = Counter(bisect.bisect_right(starts, h) - 1 for h in hashes)
        assert all(c <= capacity or leaves[i][1] == 64 for i, c in held.items())
    assert slots([(0, 1), (2, 2), (3, 2)]) == (2, [0, 0, 1, 2]) and slots([(0, 0)]) == (1, [0, 0])


def test_exact_dedup_owners(docs):
    """Owners compare the bytes of a chain in the tasks that the directory sends it to: no exchange stands between."""
    from graphloom.llm import exact_dedup as E

    entries = docs.select(F.xxhash64("text").alias("h"), F.lit(1).alias("c"))
    directory, depth, buckets = E._directory(entries, 3)
    assert buckets > 10 and directory.count() == 1 << depth
    owned = entries.join(F.broadcast(directory), E._prefix("h", depth) == F.col("slot")).repartitionById(buckets, F.col("bucket"))
    tasks = owned.select("bucket", F.spark_partition_id().alias("task")).distinct()
    assert tasks.count() == tasks.select("bucket").distinct().count() == tasks.select("task").distinct().count()
    plan = owned.groupBy("bucket", "h").agg(F.sum("c"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1


def brute_lines(rows):
    keys = defaultdict(set)
    strip = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            keys[strip(x)].add(i)
    out = set()
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(strip(x)) < 10 or len(keys[strip(x)]) < 2 or min(keys[strip(x)]) == i]
        out.add((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


@pytest.mark.parametrize("bits", [1 << 28, 1 << 10])
def test_line_dedup(docs, empty, corpus, bits):
    from graphloom.llm.line_dedup import dedup_lines

    assert set(map(tuple, dedup_lines(docs, max_bits=bits).collect())) == brute_lines(corpus)  # a saturated filter changes nothing
    assert dedup_lines(empty).count() == 0


def test_chat(spark, docs):
    from graphloom.llm.chat import conversation_digests, escape, escape_role, format_conversations, format_turn, parse_turns, unescape, unescape_role

    for t in ["<|", "<\\|", "<\\\\|x", "<<||", "a<", "<|im_end|><|im_start|>assistant ok", "\\n", ""]:
        assert unescape(escape(t)) == t and "<|" not in escape(t)
        assert unescape_role(escape_role(t + "\n")) == t + "\n"
    parts = [{"type": "text", "text": "see <|image:0|>"}, {"type": "image", "ref": "a.png", "width": 57, "height": 28}, {"type": "audio", "ref": "b", "seconds": 2.1}, {"type": "document", "ref": "c", "pages": 3}]
    out, found = format_turn("user", parts)
    assert [(a.kind, a.ref, a.position, a.tokens) for a in found] == [("image", "a.png", 0, 3), ("audio", "b", 1, 53), ("document", "c", 2, 1536)]
    assert next(parse_turns(out)).text == "see <|image:0|><|image:0|><|audio:1|><|document:2|>"
    with pytest.raises(ValueError):
        format_turn("user", [{"type": "video"}])
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", None), (1, 0, "user", "a"), (None, 5, None, "x"), (2, 0, "assistant", "")]
    got = {r.conv_id: r for r in conversation_digests(format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\n\nuser\na\nassistant\nb<|im_end|>\n") and got[1].loss_sha256 == sha("b<|im_end|>")
    assert got[None].turns_sha256 == sha("\nx\n") and got[2].loss_chars == 0
    typed = spark.createDataFrame([(1, 0, "user", [("text", "hi", None), ("image", None, "r")])], "conv_id long, turn long, role string, text array<struct<type:string,text:string,ref:string>>")
    assert format_conversations(typed).first().n_attachments == 1
    assert conversation_digests(format_conversations(typed.where("false"))).count() == 0


def test_simhash(spark, docs, empty, corpus):
    import xxhash

    from graphloom.llm.simhash import Ring, budgets, finest_ring, fingerprint_links, ring_for, ring_ok, simhash_components, spanning_links, viable

    def fp(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))

    rnd = random.Random(2)
    extra = [(1000 + i, prose(rnd, 400), "en") for i in range(5)]
    near = [(2000 + i * 10 + j, t.replace(t.split()[7 * j + 3], "changed", 1), "en") for i, (_, t, _) in enumerate(extra) for j in range(3)]
    rows = corpus + extra + near
    fps = {i: fp(t) for i, t, _ in rows}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: (f"{fps[i]:016x}", find(i)) for i in fps}
    assert simhash_components(empty).count() == 0
    x = np.array([sum(1 << b for b in rnd.sample(range(64), rnd.randrange(4))) for _ in range(500)], np.uint64)
    for m in range(4, 10):  # no pair within the budget is lost, whatever ring and chain, and it shares a key of a viable chain
        for length in range(1, m):
            assert ring_ok(x, m, 3, length).all()
            ring = Ring(m, length, 3)
            shared = [((x & np.uint64(fixed)) == 0) & viable(x, np.array(prefix, np.uint64), budgets(m, length, 3), 3) for fixed, prefix in ring.chains]
            assert np.any(shared, axis=0).all(), ring
    far = np.array([sum(1 << b for b in rnd.sample(range(64), rnd.randrange(4, 9))) for _ in range(5000)], np.uint64)
    assert ring_ok(far, 5, 3, 3).mean() < 0.9 and ring_ok(far, 9, 3, 8).mean() < 0.2  # and most others go before the full check
    assert ring_for(100).bits < ring_for(10**9).bits <= finest_ring().bits
    base = rnd.getrandbits(64)
    dense = np.unique(np.array([base ^ (1 << a) ^ (1 << b) for a in range(20, 40) for b in range(40, 60)], np.uint64))
    frame = spark.createDataFrame([(int(v.view(np.int64)),) for v in dense], "fp long")
    for hot in (1 << 14, 50, 8):  # crowded groups go on to the finest ring, and no link is lost
        links = fingerprint_links(frame, len(dense), hot=hot).collect()
        assert len(links) < 120 * len(dense)
        parent = {int(v.view(np.int64)): int(v.view(np.int64)) for v in dense}

        def top(v, parent=parent):
            while parent[v] != v:
                v = parent[v]
            return v

        for r in links:
            assert ((r.a ^ r.b) % (1 << 64)).bit_count() <= 3
            parent[top(r.a)] = top(r.b)
        assert len({top(v) for v in parent}) == 1, hot
    ring = Ring(5, 3, 3)
    near = np.array([0, 1, 3, 1 << 40, 7 << 40], np.uint64)  # a chain's budgets cut the last links off, though all are within three bits of another one
    start = next(i for i, (fixed, prefix) in enumerate(ring.chains) if prefix[0] & 1)
    assert len(spanning_links(near[:3], ring.prefixes()[start] & np.uint64(0), budgets(5, 3, 3), 3)) == 2
    assert viable(near, ring.prefixes()[start], budgets(5, 3, 3), 3).tolist() == [True, False, False, *viable(near[3:], ring.prefixes()[start], budgets(5, 3, 3), 3).tolist()]


def test_near_duplicates(spark):
    from graphloom.llm.simhash import near_duplicates, without_near_duplicates

    rnd = random.Random(9)
    rows, want = [], set()
    for i in range(40):
        t = prose(rnd, rnd.choice([60, 200, 900]))
        w = t.split()
        rows.append((i * 10, t))
        if i % 2:
            w[len(w) // 2] = "other"
            rows.append((i * 10 + 1, " ".join(w)))
            want.add(i * 10 + 1)
    rows += [(5000, "one two"), (5001, "one two"), (5002, "one two three"), (None, "one two"), (5003, None), (5004, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in near_duplicates(df).collect()}
    assert {i for i in got if got[i] != i} == want | {5001, 5004}
    assert without_near_duplicates(df).count() == len(rows) - len(want) - 2
    assert near_duplicates(df.where("false")).count() == 0


def brute_components(rows, similarity=0.8, width=5):
    """Smallest id of each text's component over all pairs of whole shingle sets."""
    sets = {i: {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} for i, t in rows if (w := t.lower().split())}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def near_components(spark, rows):
    from graphloom.llm.simhash import near_duplicates

    got = {r.doc_id: r.keep_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return {i: got.get(i, i) for i, _ in rows}


def test_near_duplicates_without_original(spark, monkeypatch):
    import graphloom.llm.simhash as S

    monkeypatch.setattr(S, "BLOCK_ROWS", 64, raising=False)
    rnd, base = random.Random(3), prose(random.Random(2), 100).split()
    rows = []
    for i in range(200):
        w = list(base)
        for k in rnd.sample(range(100), rnd.choice([1, 2])):
            w[k] = f"new{i}x{k}"
        rows.append((i, " ".join(w)))
    want = brute_components(rows)
    assert len(set(want.values())) < 20
    assert near_components(spark, rows) == want


def test_near_duplicates_of_short_texts(spark):
    rnd, rows, pairs = random.Random(4), [], []
    for size, shared in [(8, 8), (9, 9)] * 10 + [(12, 12), (13, 12), (14, 13), (20, 20), (22, 20), (40, 37), (110, 98), (111, 100)] * 6:
        w = [f"w{rnd.randrange(10**9)}" for _ in range(size)]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join([*w[:shared], f"end{len(rows)}"]))]
        pairs.append(len(rows) - 2)
    want = brute_components(rows)
    assert sum(want[i + 1] == i for i in pairs) > 40
    assert near_components(spark, rows) == want


def test_near_duplicates_of_long_texts(spark):
    rnd, rows, want = random.Random(6), [], {}
    for k, size in enumerate([4500, 5000, 9000, 20000] * 3):
        w = [f"w{rnd.randrange(10**9)}" for _ in range(size + 4)]
        # of ``size`` shingles each the last ``other`` differ; similar from a ninth on
        other = size // 9 + k % 2
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:-other] + [f"end{i}" for i in range(other)]))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k if (size - other) >= 0.8 * (size + other) else 2 * k + 1}
    assert sum(want[i] != i for i in want) == 6
    assert near_components(spark, rows) == want


def test_near_duplicates_with_repeats(spark):
    rnd, rows = random.Random(8), []
    for i in range(0, 80, 2):
        words = [f"w{rnd.randrange(10**9)}" for _ in range(450)]
        rows += [(i, " ".join(words)), (i + 1, " ".join(words[:400] + words[400:] * 100))]
    assert near_components(spark, rows) == {i: i - i % 2 for i, _ in rows}


ODD = ["", "   ", "it's we're 'sam 'LL '' x    12³½ é́ İSTANBUL ΣΑΣ <|startoftext|>x<|endoftext|>", "a" * 3000, "ab" * 800 + " " * 100 + "x▁▁", "日本語🎉\x00\x85", "\n\n\t\t  code", "!!!???—''“”", "   a   b  "]


def odd_texts():
    rnd = random.Random(1)
    return ODD + ["".join(rnd.choice("abcdeft ▁'é\n<|>1２߀s.,") for _ in range(rnd.randint(1, 60))) for _ in range(500)]


def test_token_counts(docs, empty, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    from graphloom.llm.tokens import counter, token_counts

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), counter(path)
    for t in odd_texts():
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert own.count(t) == n and own.count(t, chunk=5) == n, t
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, path).collect()}
    for i, t, _ in corpus:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048)
    assert token_counts(empty, path).count() == 0


def test_pieces(docs, empty, corpus):
    import public_tokenizers
    import sentencepiece

    from graphloom.llm.pieces import codec, encode_decode

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), codec(path)
    for t in odd_texts():
        ids = lib.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids), t
    got = {r.doc_id: tuple(r)[1:] for r in encode_decode(docs, path).collect()}
    for i, t, _ in corpus:
        ids = lib.encode(t or "")
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
    assert encode_decode(empty, path).count() == 0


def brute_substrings(rows, length):
    seen, out = set(), set()
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(raw[p : p + length])
        spans = sum(1 for j in range(len(gone)) if gone[j] and (not j or not gone[j - 1]))
        out.add((i, len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone) if not g))))
    return out


def substring_rows():
    rnd = random.Random(3)
    rows = [(1, None), (2, ""), (3, "a" * 500), (4, "ab" * 300), (5, "a" * 500), (6, "x" * 99), (7, "x" * 99), (8, "x" * 100), (9, "x" * 100)]
    base = "".join(rnd.choice("abcd ") for _ in range(2000))
    for i in range(10, 70):
        a, t = rnd.randrange(1500), "".join(rnd.choice("é xyz") for _ in range(rnd.randrange(150)))
        t += base[a : a + rnd.randrange(50, 700)]
        rows.append((i, t[: len(t) // 2] + "Q" + t[len(t) // 2 :] if i % 3 == 0 else t + t if i % 7 == 0 else t))
    return rows


def test_suffix_dedup(spark, empty):
    from graphloom.llm import suffix_dedup as S

    rows = substring_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for together in (S.CONTEXTS, 3):  # the windows of crowded anchors are dealt to several tasks
        assert set(map(tuple, S.dedup_substrings(df, contexts_together=together).collect())) == brute_substrings(rows, 100)
    assert S.dedup_substrings(empty).count() == 0


def test_suffix_sort_and_blocks(monkeypatch):
    from graphloom.llm import suffix_dedup as S

    rnd = random.Random(4)
    contexts = ["".join(rnd.choice("ab") for _ in range(20)).encode() for _ in range(30)]
    c = S.Contexts(contexts, 8)
    at, seg = c.begin[:-1].astype(np.int64), np.sort(np.array([rnd.randrange(4) for _ in contexts]))
    order = c.sort(at, seg)
    assert [(int(seg[i]), contexts[i][:8]) for i in order] == sorted((int(s), x[:8]) for s, x in zip(seg, contexts, strict=True))
    text = ("".join(rnd.choice("abc") for _ in range(3000))).encode()
    monkeypatch.setattr(S, "BLOCK", 256)
    parts = list(S.text_blocks(iter([(1, 2, text)]), 100, 32))
    assert len(parts) > 5 and all(len(p[1][0]) <= 355 for p in parts)


def test_decontamination(spark, docs, empty):
    from graphloom.llm.decontaminate import Templates, canonical, contamination, without_contaminated

    item = "Anna bought 12 apples for 5 dollars and gave 3 of them to Berta on Monday morning."
    bench = spark.createDataFrame([(1, item), (2, "one two three"), (3, None), (4, "!!")], "item_id long, text string")
    texts = [
        (1, "Some words. " + item + " More."), (2, "Today Carl bought 7 apples for 9 dollars and gave 2 of them to Dora on Friday morning."),
        (3, "we bought apples and gave them to people in the morning"), (4, item.upper()), (5, None), (6, ""), (7, "say one two three now"), (8, "one two"),
        (None, item), (9, " ".join(item.split()[:6])),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_items, r.item_id) for r in contamination(df, bench).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, None), 4: got[4], 5: (0, None), 6: (0, None), 7: (1, 2), 8: (0, None), None: (1, 1), 9: (0, None)}
    assert without_contaminated(df, bench).count() == sum(1 for r in contamination(df, bench).collect() if not r.contaminated)
    assert contamination(empty, bench).count() == 0 and contamination(df, bench.where("false")).where("contaminated").count() == 0
    # inconsistent slots: the same number of the item stands for two numbers of the text
    same = Templates([(1, "take 4 red cups and 4 red plates and 4 red forks and 4 red spoons home")], 5, 0.8)
    assert same.found_in(["take 7 red cups and 7 red plates and 7 red forks and 7 red spoons home"])[0]
    assert not same.found_in(["take 1 red cups and 2 red plates and 3 red forks and 5 red spoons home"])[0]
    # the vectorised reading of a text is that of canonical()
    t = Templates([(1, "The price of 3 kg is 5.25 for John's mother. It was Late\nthen")], 5, 0.8)
    for text in ["The price of 9 kg is 7.50 for Mary's mother. It was Late\nthen", "Ünder 3,5 KM ÉT Été a_b x1 1x ² of.The", ""]:
        of, ids = t.template_ids([text, text])
        want = [t.words.get(x, 0) for x in canonical(text)[0]]
        assert ids.tolist() == want + want and of.tolist() == [0] * len(want) + [1] * len(want)


def test_decontamination_of_names_at_sentence_starts():
    from graphloom.llm.decontaminate import Templates, canonical

    item = "Tom has 5 apples in his bag. Tom buys 7 more apples at the shop. Tom gives 3 apples to Anna. How many apples does Tom have now?"
    t = Templates([(1, item)], 5, 0.8)
    assert t.found_in([item, item.replace("Tom", "Peter"), item.replace("Tom", "Peter").replace("5", "8"), item.lower()])[:3] == [[(1, 1.0)]] * 3
    assert t.found_in(["we know that " + item.replace("Tom", "Peter"), "First " + item]) == [[(1, 1.0)]] * 2
    assert t.found_in([item.replace("Tom has", "Peter has").replace("Tom buys", "Clara buys").replace("Tom gives", "Emma gives")]) == [[]]
    assert Templates([(1, "Paris")], 5, 0.8).found_in(["We saw Anna. Rome", "in paris"]) == [[], [(1, 1.0)]]
    for text in [item, "Über 3 Days. Days 5. Days after. The 5 kg. Été a_b x1\nMary's"]:
        assert t.template_ids([text], True)[1].tolist() == [t.words.get(x, 0) for x in canonical(text, True)[0]]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><a href="/">Site</a></header>
<nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><div class="cookie-notice">We use cookies on this site to make it better for all.</div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>
 paragraph&nbsp;here, which is long enough to count.<br>Next<p>Second one.</p><aside>Related things</aside></article><div id=comments><p>Nice post, I liked it very much, thank you all.</p></div>
<form><label>Mail</label><input></form><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    from graphloom.llm.html_text import extract_pages, gaussian, main_text, threshold

    assert main_text(PAGE) == "Title & more\nFirst bold paragraph here, which is long enough to count. Next\nSecond one."
    plain = "<div id=menu><a href=x>one</a> <a href=y>two</a></div><div id=story><h2>Head</h2><p>" + "Long text of the story. " * 20 + "</p><p>" + "More of the story text. " * 15 + "</p></div><div class=footer>foot</div>"
    assert main_text(plain).startswith("Head\nLong text") and "foot" not in main_text(plain) and "one" not in main_text(plain)
    assert main_text("") == "" and main_text("<nav>only menu</nav>") == "" and main_text("just <i>text</i> &lt;here") == "just text <here"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id == 2] == [""]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert threshold([1, 1, 9, 9]) == 5 and threshold([2, 2]) < 2 and abs(sum(gaussian([0, 0, 3, 0, 0, 0, 0], 0.5)) - 3) < 0.01


def test_html_regions():
    from graphloom.llm.html_text import main_text

    story = "<div id=story><h2>Head</h2><p>" + "Long text of the story. " * 20 + "</p><p>" + "More of the story text. " * 15 + "</p></div>"
    teaser = "<article><h3>Next</h3><p>Read on</p></article>"
    page = f"<body><div><a href=x>one</a> <a href=y>two</a></div>{story}<p><a href=z>more</a></p><p>x</p><p>y</p>{teaser}</body>"
    assert main_text(page).startswith("Head\nLong text") and "More of the story" in main_text(page) and "Read on" not in main_text(page)
    assert main_text(page.replace("Read on", "A second story. " * 30)).count("story") == 65


def test_html_without_end_tags():
    from graphloom.llm.html_text import main_text

    story = "<p>" + "Long text of the story. " * 9 + "</p>"
    want = main_text(f"<body>{story}</body>")
    assert want.startswith("Long text")
    for head in ("<head>", "<head><title>T</title>", "<head><meta charset=utf-8><script>var a = '<p>';</script><style>p{}</style>", "<head><noscript><img src=x>", "<head><title>T</title></head>"):
        assert main_text(f"<html>{head}<body>{story}</body></html>") == want, head
    assert main_text(f"<html><head><title>T</title>{story}") == want == main_text("<head><title>T</title>" + story[3:-4])
    for raw in ("<button>Go", "<select><option>a<option>b", "<svg><path d=x>", "<noscript><div>no</div>"):
        assert main_text(f"<body><div>{raw}</div>{story}</body>") == want, raw
        assert main_text(f"<body><div>{raw}</{raw[1:].split('>')[0]}></div>{story}</body>") == want, raw
    assert main_text(f"<body><div><svg><foreignObject><div>in</div> it</foreignObject></svg></div>{story}</body>") == want


def test_toxicity(spark):
    from graphloom.llm.toxicity import held_out, toxicity_scores, train, without_toxic

    rnd = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = prose(rnd, 40).split()
        if bad:
            w[rnd.randrange(40)] = rnd.choice(["scumbag", "moronic", "trashy"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(None, None), (9999, "")], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = train(docs, lab, sample=400, features=3000)
    got = toxicity_scores(docs, model).collect()
    fold = [r for r in got if r.held_out and r.doc_id in dict(labels)]
    right = sum(r.predicted == dict(labels)[r.doc_id] for r in fold)
    assert len(fold) > 100 and right / len(fold) > 0.97 and all(0 <= r.score <= 1 for r in got) and len(got) == 602
    assert without_toxic(docs, model).count() == sum(1 - r.predicted for r in got)
    assert toxicity_scores(docs.where("false"), train(docs, lab.where("false"))).count() == 0
    import zlib

    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect())


def test_components(spark):
    from graphloom.llm.common import connected_components

    pairs = [(1, 2), (2, 3), (10, 11), (12, 11), (5, 5)] + [(100, 100 + i) for i in range(1, 30)] + [(i, i + 1) for i in range(200, 230)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10} | {i: 100 for i in range(100, 130)} | {i: 200 for i in range(200, 231)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
