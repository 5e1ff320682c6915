"""Operator 7, SentencePiece encoding and decoding by vectorised merge rounds.

Distinct words of a batch form one flat array of symbols. In a round every word finds the smallest rank of
its adjacent pairs (a segmented minimum), merges all places of that rank from the left at once, and the
array is compacted; words without a pair leave. A word in which a merge makes a pair that would
come before the places still to be merged is encoded again, one merge at a time, so the ids
are those of strictly sequential merging.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import few_tasks, in_blocks, kept, releasing, slices, table

SPACE = "▁"
_NONE = np.int64(1 << 40)
#: Distinct words kept with their encoding; beyond it the memory starts anew.
MEMO = 100_000
#: Words that are encoded together.
TOGETHER = 20_000


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size = n
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError(f"{path}: a piece crosses a word boundary")
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = {i: p.replace(SPACE, " ").encode() for p, i in self.id.items()} | {i: bytes([b]) for b, i in enumerate(self.byte_id)}
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        self.char = {p: i for p, i in self.id.items() if len(p) == 1}
        pairs = {}
        for p, i in self.id.items():
            for cut in range(1, len(p)):
                a, b = self._symbol(p[:cut]), self._symbol(p[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (order[sp.get_score(i)], i)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self.keys = keys[by]
        self.ranks = np.array([r for r, _ in pairs.values()], np.int64)[by]
        self.merged = np.array([i for _, i in pairs.values()], np.int64)[by]
        self.text = [str(i) for i in range(n)]
        self.words = re.compile(self._word_pattern())
        #: (number of ids, the ids, what they decode to where that is not the word itself) of a word
        self.memo: dict[str, tuple[int, str, bytes | None]] = {}

    def _word_pattern(self) -> str:
        """Words are cut before a space mark, and before a punctuation mark where no piece holds it
        after the same character: no merge reaches across, and fewer distinct words are left."""
        marks = ".,;:!?\n"
        before = {m: {a for p in self.id for a, b in zip(p, p[1:], strict=False) if b == m and a != SPACE} for m in marks}
        goes_on = "".join(f"|(?<=[{''.join(map(re.escape, sorted(x)))}]){re.escape(m)}" for m, x in before.items() if x)
        return f"{SPACE}*[^{SPACE}](?:[^{SPACE}{re.escape(marks)}]+{goes_on})*|{SPACE}+"

    def _symbol(self, text: str) -> int | None:
        """A piece's id; characters outside the vocabulary come after the pieces."""
        i = self.id.get(text)
        return self.size + ord(text) if i is None and len(text) == 1 else i

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def sequential(self, word: str) -> list[int]:
        """One merge at a time, best rank first, leftmost on ties."""
        sym = [self._symbol(c) for c in word]
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap = []

        def offer(i):
            j = after[i]
            if j < len(sym):
                key = sym[i] << 32 | sym[j]
                at = int(np.searchsorted(self.keys, key))
                if at < len(self.keys) and self.keys[at] == key:
                    heapq.heappush(heap, (int(self.ranks[at]), i, sym[i], sym[j], int(self.merged[at])))

        for i in range(len(sym) - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if sym[i] == a else len(sym)
            if j >= len(sym) or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = made, -1, after[j]
            if after[j] < len(sym):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s in sym if s >= 0]

    def rounds(self, words: list[str]) -> list[list[int]]:
        """Symbols of each word after all merges."""
        out: list[list[int] | None] = [None] * len(words)
        cp = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        kinds, where = np.unique(cp, return_inverse=True)
        sym = np.array([self._symbol(chr(c)) for c in kinds], np.int64)[where]
        w = np.repeat(np.arange(len(words)), [len(x) for x in words])
        inner = np.r_[w[1:] == w[:-1], False]
        rank, made = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        rank[:-1], made[:-1] = self._lookup(sym[:-1], sym[1:])
        rank[~inner] = _NONE
        redo: set[int] = set()
        while len(sym):
            start = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            size = np.diff(np.r_[start, len(sym)])
            least = np.minimum.reduceat(rank, start)
            done = least == _NONE
            if done.any():
                for s, n in zip(start[done], size[done], strict=True):
                    out[w[s]] = sym[s : s + n].tolist()
                live = np.repeat(~done, size)
                sym, w, rank, made, least = sym[live], w[live], rank[live], made[live], least[~done]
                if not len(sym):
                    break
                size = size[~done]
            floor = np.repeat(least, size)
            sel = rank == floor
            i = np.arange(len(sym))
            first = np.maximum.accumulate(np.where(sel & ~np.r_[False, sel[:-1]], i, 0))
            sel &= (i - first) % 2 == 0  # of overlapping places every other one, from the left
            at = np.flatnonzero(sel)
            sym[at] = made[at]
            gone = at + 1
            keep = np.ones(len(sym), bool)
            keep[gone] = False
            several = np.bincount(w[at], minlength=len(words)) > 1
            place = np.cumsum(keep) - 1
            sym, w, rank, made, floor = sym[keep], w[keep], rank[keep], made[keep], floor[keep]
            at = place[at]
            flag = np.zeros(len(sym) + 1, bool)
            flag[at] = flag[at - 1] = True  # -1 is the spare last place
            touched = np.flatnonzero(flag[:-1])
            last = touched == len(sym) - 1
            nxt = np.where(last, touched, touched + 1)
            r, m = self._lookup(sym[touched], sym[nxt])
            r[last | (w[touched] != w[nxt])] = _NONE
            rank[touched], made[touched] = r, m
            early = (r <= floor[touched]) & (r < _NONE) & several[w[touched]] & (r != _NONE)
            if early.any():
                redo.update(w[touched[early]].tolist())
        for x in redo:
            out[x] = self.sequential(words[x])
        return out

    def learn(self, words: list[str]) -> None:
        text, raw = self.text.__getitem__, self.bytes.__getitem__
        for word, ids in zip(words, self.rounds(words), strict=True):
            if max(ids) >= self.size:
                ids = [i for s in ids for i in ([s] if s < self.size else [self.byte_id[b] for b in chr(s - self.size).encode()])]
            decoded = b"".join(map(raw, ids))
            self.memo[word] = (len(ids), ",".join(map(text, ids)), None if decoded == word.replace(SPACE, " ").encode() else decoded)

    def split(self, text: str) -> list[str]:
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def prepare(self, texts: list[list[str]]) -> None:
        """Encode the words of some texts that are not known yet, together."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        fresh = list({x for words in texts for x in words} - self.memo.keys())
        for at in range(0, len(fresh), TOGETHER):
            self.learn(fresh[at : at + TOGETHER])

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        self.prepare([words])
        return [int(i) for x in words for i in self.memo[x][1].split(",")]

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.bytes.__getitem__, ids)).decode(errors="replace")
        return out[1:] if out.startswith(" ") else out


@kept("pieces")
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, without a shuffle.

    Null and empty texts have no ids and decode to the empty text. Repeated rows, null ids
    and empty tables are passed through row by row; other columns are ignored.
    """

    @releasing(keep="pieces")
    def run(batches):
        c = codec(path)
        c.memo.clear()
        for b in slices(batches):
            rows = []
            for block in in_blocks([t or "" for t in b.column(1).to_pylist()], 1 << 18):
                split = [c.split(t) for t in block]
                c.prepare(split)
                for words in split:
                    known = [c.memo[x] for x in words]
                    if all(k[2] is None for k in known):
                        decoded = "".join(words).replace(SPACE, " ").encode()
                    else:
                        decoded = b"".join(x.replace(SPACE, " ").encode() if k[2] is None else k[2] for x, k in zip(words, known, strict=True))
                    rows.append((
                        sum(k[0] for k in known),
                        hashlib.sha256(",".join(k[1] for k in known).encode()).hexdigest(),
                        hashlib.sha256(decoded.removeprefix(b" ")).hexdigest(),
                    ))
            yield pa.record_batch([b.column(0), *map(list, zip(*rows, strict=True))] if rows else [b.column(0), [], [], []], schema=_OUT)
        c.memo.clear()  # the worker may run another operator next

    return few_tasks(docs).select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
