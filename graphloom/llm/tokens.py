"""Operator 5, token counts: a BPE vocabulary compiled to a deterministic transducer.

``CountTransducer`` reads the bytes of a word. Its states are determinised on first use: a state is the
longest suffix read that can still grow into a vocabulary token, with the last token and the token count of the
encoding at each place inside it. Every transition is annotated with the number of tokens by which the
count changes, so a word's count is the sum along its path; no merge is ever run on a text.

A long text is cut into chunks, at any place where no normalisation, contraction or special string reaches across:
between two letters of a word, too. A chunk's state map takes the state that the transducer is in before it to the
state after it and the tokens emitted between: what continues the open word is still to be run, what follows is
known. ``ChunkMap`` composes associatively, by running the open state of one chunk over the head of the next, and
``scan`` composes all chunks of a text pairwise, as a parallel prefix scan does; no text is joined again.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import few_tasks, kept, releasing, slices, table

LIMIT = 2048
CHUNK = 1 << 16
#: Words whose path sums are remembered; beyond it the memory starts anew.
MEMO = 300_000
#: States that are kept; beyond it they are compiled anew as they are needed. A run adds one a byte at most.
STATES = 100_000


def byte_chars() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class OpenWord:
    """Where the transducer stands inside a word: its state (None: at the start) and the tokens counted before the last
    byte, which is held back because the byte that ends a word is another symbol."""

    state: tuple | None = None
    count: int = 0
    held: int | None = None


class CountTransducer:
    """Counts the tokens that byte-pair merging gives for a word. Symbols are 0-255 for bytes and
    256-511 for a byte that ends the word; tokens are strings of such symbols."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str):
        code = byte_chars()

        def symbols(token: str) -> str:
            end = bool(suffix) and token.endswith(suffix)
            out = [code[c] for c in (token[: -len(suffix)] if end else token)]
            if end:
                out[-1] += 256
            return "".join(map(chr, out))

        self.end = 256 if suffix else 0
        self.rank = {}
        for i, (a, b) in enumerate(merges):
            self.rank.setdefault((symbols(a), symbols(b)), i)
        self.tokens = {chr(i) for i in range(512)} | {a + b for a, b in self.rank}
        self.prefixes = {t[:i] for t in self.tokens for i in range(len(t) + 1)}
        self.fits = lru_cache(1 << 17)(self._fits)
        self.valid = lru_cache(1 << 17)(lambda t: self.merge(t) == [t])
        self._forget()

    def _forget(self) -> None:
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.next: list[dict[int, tuple[int, int]]] = []
        self._state(("", (None,), (0,)))

    def _state(self, key: tuple) -> int:
        at = self.states.get(key)
        if at is None:
            at = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
        return at

    def merge(self, text: str) -> list[str]:
        """Plain byte-pair merging, used to compile transitions only."""
        parts = list(text)
        while len(parts) > 1:
            r, i = min((self.rank.get((parts[i], parts[i + 1]), 1 << 30), i) for i in range(len(parts) - 1))
            if r == 1 << 30:
                break
            a, b = parts[i], parts[i + 1]
            out, j = [], 0
            while j < len(parts):
                if j + 1 < len(parts) and parts[j] == a and parts[j + 1] == b:
                    out.append(a + b)
                    j += 2
                else:
                    out.append(parts[j])
                    j += 1
            parts = out
        return parts

    def _fits(self, a: str, b: str) -> bool:
        return self.merge(a + b) == [a, b]

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        seen, last, count = self.keys[state]
        text = seen + chr(symbol)
        token = base = None
        for i in range(len(text)):  # the one token that ends here and fits what stands before it
            t = text[i:]
            if t in self.tokens and self.valid(t) and (last[i] is None or self.fits(last[i], t)):
                token, base = t, count[i] + 1
                break
        if token is None:
            raise ValueError("the vocabulary does not encode by merges alone")
        delta = base - count[-1]
        keep = 0
        while text[keep:] not in self.prefixes:
            keep += 1
        counts = [*count[keep:], base]
        low = counts[-1]
        out = self.next[state][symbol] = (self._state((text[keep:], (*last[keep:], token), tuple(c - low for c in counts))), delta)
        return out

    def run(self, word: OpenWord, more: bytes) -> OpenWord:
        """The open word after some more bytes."""
        if len(self.keys) > STATES:
            self._forget()
        state, total, held = self._state(word.state) if word.state else 0, word.count, word.held
        for b in more:
            if held is not None:
                state, delta = self.next[state].get(held) or self._compile(state, held)
                total += delta
            held = b
        return OpenWord(self.keys[state], total, held)

    def close(self, word: OpenWord) -> int:
        """Tokens of an open word that ends here."""
        if word.held is None:
            return 0
        state, b = self._state(word.state) if word.state else 0, word.held + self.end
        return word.count + (self.next[state].get(b) or self._compile(state, b))[1]

    def count(self, word: bytes) -> int:
        if len(self.keys) > STATES:
            self._forget()
        state = total = 0
        for b in word[:-1]:
            state, delta = self.next[state].get(b) or self._compile(state, b)
            total += delta
        b = word[-1] + self.end
        return total + (self.next[state].get(b) or self._compile(state, b))[1]


class _Memo(dict):
    def __init__(self, transducer: CountTransducer):
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        n = self.transducer.count(word.encode())
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to the open word before it: runs it over the pieces of ``head``. If it ``closes`` the word,
    ``inside`` tokens follow, and ``tail`` is the word that it leaves open."""

    head: tuple[bytes, ...] = ()
    closes: bool = True
    inside: int = 0
    tail: OpenWord = OpenWord()


#: What a run of characters may go on with, by the kind of the character before a cut.
_GOES_ON = {"letter": regex.compile(r"\p{L}+"), "mark": regex.compile(r"[^\s\p{L}\p{N}]+")}
_ENDS = regex.compile(r"[\s\p{N}]")


@lru_cache(1)
def joining() -> frozenset[str]:
    """Characters that may combine with what stands before them."""
    pairs = (unicodedata.decomposition(chr(i)).split() for i in range(0x30000))
    return frozenset(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<") | frozenset(map(chr, range(0x1161, 0x11C3)))


def settled(c: str) -> bool:
    """Neither normalisation nor lower case joins the character to another one or makes several of it."""
    return c.isascii() or not (unicodedata.combining(c) or c in joining()) and unicodedata.is_normalized("NFC", c) and len(c.lower()) == 1


def cut_kind(text: str, at: int, special: list[str]) -> str | None:
    """How a text may be cut at a place: inside a run of letters ("letter") or marks ("mark"), between words ("end"), or not (None)."""
    a, b = text[at - 1], text[at]
    if not (settled(a) and settled(b)):
        return None
    if any(x in text[max(0, at - len(x) + 1) : at + len(x) - 1] for x in special):
        return None
    if _ENDS.match(a) or _ENDS.match(b):
        return "end"
    letters = [bool(_GOES_ON["letter"].match(c)) for c in (a, b)]
    if all(letters):
        return None if "'" in text[max(0, at - 3) : at] else "letter"
    return "mark" if not any(letters) and a != "'" else None


class TokenCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        if model["type"] != "BPE" or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: not a lower-casing byte-level BPE vocabulary")
        merges = [tuple(m if isinstance(m, list) else m.split(" ", 1)) for m in model["merges"]]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.transducer = CountTransducer(merges, model["end_of_word_suffix"] or "")
        self.memo = _Memo(self.transducer)

    def plain(self, text: str) -> int:
        """Tokens of a text whose both ends are word boundaries, without special strings."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # final sigma has no rule of its own here
        return sum(map(self.memo.__getitem__, self.pattern.findall(text.lower())))

    def whole(self, text: str) -> int:
        if "<|" not in text:
            return self.plain(text)
        return len(self.split.findall(text)) + sum(map(self.plain, self.split.split(text)))

    def cuts(self, text: str, chunk: int) -> list[tuple[int, str]]:
        """(place, kind) of cuts that are ``chunk`` characters apart, or the first after it where a text may be cut."""
        out, at = [], chunk
        while at < len(text):
            kind = cut_kind(text, at, self.special)
            if kind:
                out.append((at, kind))
                at += chunk
            else:
                at += 1
        return out

    def chunk(self, text: str, before: str, after: str) -> ChunkMap:
        """The state map of a part of a text between two cuts of some kinds."""
        parts = self.split.split(text) if "<|" in text else [text]
        parts = [unicodedata.normalize("NFC", p).replace("Σ", "σ").lower() if not p.isascii() else p.lower() for p in parts]
        inside, head = len(parts) - 1, ()
        if before != "end":
            found = _GOES_ON[before].match(parts[0])
            first = found[0] if found else ""
            head = (first.encode(),)
            parts[0] = parts[0][len(first) :]
            if len(parts) == 1 and not parts[0] and after != "end":
                return ChunkMap(head, False)
        words = [self.pattern.findall(p) for p in parts]
        tail = OpenWord()
        if after != "end" and words[-1]:
            tail = self.transducer.run(tail, words[-1].pop().encode())
        return ChunkMap(head, True, inside + sum(map(self.memo.__getitem__, chain.from_iterable(words))), tail)

    def run(self, word: OpenWord, pieces: tuple[bytes, ...]) -> OpenWord:
        for piece in pieces:
            word = self.transducer.run(word, piece)
        return word

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if not a.closes:
            return ChunkMap(a.head + b.head, b.closes, b.inside, b.tail)
        open_ = self.run(a.tail, b.head)
        if not b.closes:
            return ChunkMap(a.head, True, a.inside, open_)
        return ChunkMap(a.head, True, a.inside + self.transducer.close(open_) + b.inside, b.tail)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        while len(maps) > 1:
            paired = [self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)]
            maps = paired + maps[len(paired) * 2 :]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if len(text) <= chunk:
            return self.whole(text)
        at = [(0, "end"), *self.cuts(text, chunk), (len(text), "end")]
        m = self.scan([self.chunk(text[i:j], before, after) for (i, before), (j, after) in zip(at, at[1:], strict=False)])
        return m.inside + self.transducer.close(m.tail)


@kept("tokens")
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every row, without a shuffle.

    Null and empty texts have no token. Special strings inside a text count as the one token that
    the vocabulary gives them. Repeated rows, null ids and empty tables are passed through row by row;
    other columns are ignored. ``path``: the vocabulary file, present on every executor.
    """

    @releasing(keep="tokens")
    def run(batches):
        c = counter(path)
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [c.count(t) for t in texts]
            yield pa.record_batch([b.column(0), [len(t.encode()) for t in texts], n, [x > limit for x in n]], schema=_OUT)

    return few_tasks(docs).select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
