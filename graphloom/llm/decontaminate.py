"""Operator 8, benchmark decontamination by template windows.

Texts and benchmark items are canonicalised: numbers, units and names become typed placeholders, whose values are
kept as slots. A capitalised word that starts a sentence may be a name or not: texts and items are read both
ways. Windows of five template tokens are hash-joined with those of the items; a window of placeholders alone tells
nothing and keeps its values. An item is
found in a text when at least 0.8 of its distinct windows occur there and the slots agree: one slot
value of the item always stands for one value of the text, so a question with other numbers is caught
while a coincidence of placeholders is not.

Only the rarest windows of an item are indexed: so many that a text without any of them cannot hold 0.8 of all. Items
that a text shares one with are compared as sets of windows first, and window by window only if that share is reached.

The benchmark is a query set. It is taken in blocks of bounded size, each of which is broadcast as a hash
table; texts are scanned once per block and never shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import few_tasks, in_blocks, kept, releasing, slices, table

WIDTH = 5
SIMILARITY = 0.8
#: Benchmark characters that one broadcast hash table is made of.
BLOCK_CHARS = 4 << 20
#: Characters that are read together; a longer text is read as a whole.
TOGETHER = 1 << 17

NUM, UNIT, NAME = SLOTS = "<num>", "<unit>", "<name>"
_TOKEN = re.compile(r"\w+(?:(?:['’]|(?<=\d)[.,:/](?=\d))\w+)*|[.!?\n]")
_UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr hour hours minute minutes second seconds day days week weeks "
    "month months year years dollar dollars euro euros pound pounds cent cents mile miles meter meters metre metres kilometer "
    "kilometers inch inches foot feet gram grams kilogram kilograms liter liters litre litres percent degree degrees".split()
)
#: Words that are no name where they start a sentence (English, Spanish, German, French).
_COMMON = frozenset(
    "a about after all also although an and another any are as at because before both but by can could did do does during each every few first for from given had has have he her here his "
    "how however i if in into is it its just last let many more most much my next no not now of on once one only or other our she should since so some such than that the their then there these they "
    "this those to today under until was we were what when where which while who whom whose why will with would yes yet you your "
    "al como cuando cuántas cuántos cuál cuánto de del después dos e el ella ellos en entonces es esta este hay la las le lo los más no para pero por porque qué quién se si sin su sus también un una unos y ya "
    "aber alle als am an auch auf aus bei bis da dann das dass dem den der des die dies diese dieser ein eine einem einen einer er es für hat ihr im in ist ja jede jeder man mit nach nicht noch nun nur ob oder "
    "sein sich sie sind so über um und von vor wann warum was welche welcher wenn wer wie wieviel wir wird wo zu zum zur "
    "au aux avec ce ces cette chaque combien comme dans des donc du elle elles est et il ils je l'on leur leurs lorsque mais ne nous on ou où par pas pour pourquoi quand que quel quelle qui sa ses si son sont sur tous tout une vous".split()
)


def lowered(t: str) -> str:
    """Lower case, character by character."""
    return t.lower() if t.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)


def canonical(text: str, starts: bool = False) -> tuple[list[str], list[str]]:
    """Template tokens and the value behind each ('' for plain words).

    A token that starts with a digit is ``<num>``, a unit right after one ``<unit>``, a capitalised word
    inside a sentence ``<name>``. A capitalised word without a small letter is plain; one that starts a sentence
    is, too, unless ``starts`` and it is no common word.
    """
    template, values = [], []
    start = True
    for t in _TOKEN.findall(text):
        c = t[0]
        if c in ".!?\n":
            start = True
            continue
        low = lowered(t)
        if c.isdecimal():
            template.append(NUM)
            values.append(t)
        elif low in _UNITS and template and template[-1] == NUM:
            template.append(UNIT)
            values.append(low)
        elif c.isupper() and any(map(str.islower, t)) and (not start or starts and low not in _COMMON):
            template.append(NAME)
            values.append(low)
        else:
            template.append(low)
            values.append("")
        start = False
    return template, values


_WORD, _DIGIT, _UPPER, _LOWER, _MARK, _QUOTE, _SEP = (1 << i for i in range(7))
_P = 0x9E3779B97F4A7C15


@kept("characters")
def character_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class bits and lower case of every code point."""
    kind, low = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        kind[i] = _WORD * (c.isalnum() or c == "_") | _DIGIT * c.isdecimal() | _UPPER * c.isupper() | _LOWER * c.islower() | _MARK * (c in ".!?\n") | _QUOTE * (c in "'’") | _SEP * (c in ".,:/")
        if len(c.lower()) == 1:
            low[i] = ord(c.lower())
    return kind, low


@kept("powers")
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (_P, pow(_P, -1, 1 << 64)))


def word_hash(word: str) -> int:
    return sum((ord(c) + 1) * pow(_P, i, 1 << 64) for i, c in enumerate(word)) % (1 << 64)


def block_tokens(texts: list[str]):
    """(text number, hash of the lower-cased token, class) of all template tokens of some texts, as arrays.
    Tokens are those of ``canonical``; class: 1 starts with a digit, 2 capitalised
    inside a sentence, 4 at its start."""
    kind, low = character_tables()
    cp = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    k = kind[cp]
    word = (k & _WORD) > 0
    digit = (k & _DIGIT) > 0
    joint = np.zeros(len(cp), bool)
    joint[1:-1] = ((k[1:-1] & _QUOTE) > 0) & word[:-2] & word[2:] | ((k[1:-1] & _SEP) > 0) & digit[:-2] & digit[2:]
    mark = ((k & _MARK) > 0) & ~joint
    word |= joint
    first = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    last = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    forth, back = powers(1 << max(16, int(len(cp)).bit_length()))
    total = np.cumsum(np.r_[np.uint64(0), (low[cp].astype(np.uint64) + np.uint64(1)) * forth[: len(cp)]], dtype=np.uint64)
    h = (total[last] - total[first]) * back[first]
    small = np.cumsum(np.r_[0, (k & _LOWER) > 0])
    marks = np.cumsum(mark)
    begins = np.r_[True, marks[first[1:]] > marks[first[:-1]]] if len(first) else np.zeros(0, bool)
    capital = ((k[first] & _UPPER) > 0) & (small[last] > small[first])
    ends = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return np.searchsorted(ends, first, "right") - 1, h, digit[first] * 1 | (capital & ~begins) * 2 | (capital & begins) * 4


_MULT = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(64)], np.uint64)


def _mixed(tokens: np.ndarray, at: np.ndarray, width: int, seed: int) -> np.ndarray:
    out = np.full(len(at), seed, np.uint64)
    for i in range(width):
        x = tokens[at + i].astype(np.uint64) * _MULT[i]
        out = (out ^ (x ^ (x >> np.uint64(31)))) * np.uint64(0xBF58476D1CE4E5B9)
    return out


def windows(ids: np.ndarray, values: np.ndarray, slots: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` template tokens that starts at ``at``: of their ids, or, where all of them are ``slots``, of
    the hashes of their values."""
    out = _mixed(ids, at, width, width)
    run = np.cumsum(np.r_[0, slots])
    bare = np.flatnonzero(run[at + width] - run[at] == width)
    out[bare] = _mixed(values, at[bare], width, ~width & 0xFFFF)
    return out


class Templates:
    """Hash table of the template windows of some items."""

    def __init__(self, items: list[tuple[int, str]], width: int, similarity: float):
        self.width, self.similarity = width, similarity
        self.words: dict[str, int] = {}
        self.items = []
        for item_id, text in items:
            readings = []
            for starts in (False, True):
                template, values = canonical(text, starts)
                if not template:
                    break
                ids = np.array([self.words.setdefault(t, len(self.words) + 1) for t in template])
                seen = np.array([word_hash(lowered(v)) for v in values], np.uint64)
                w = min(width, len(ids))
                h = windows(ids, seen, np.array([t in SLOTS for t in template]), np.arange(len(ids) - w + 1), w)
                # of an item shorter than a window, little but a name would be left
                readings.append((h.tolist() if len(ids) >= width or not starts else [], template, values))
            if readings:
                self.items.append((item_id, readings))
        #: by reading (sentence starts as plain words, and as names): the items that a rare window is looked up for
        self.rare: list[dict[int, list[int]]] = [defaultdict(list), defaultdict(list)]
        self.sets = [[frozenset(r[starts][0]) for _, r in self.items] for starts in (0, 1)]
        for starts, rare in enumerate(self.rare):
            often = Counter(x for s in self.sets[starts] for x in s)
            for where, s in enumerate(self.sets[starts]):
                for x in sorted(s, key=lambda x: (often[x], x))[: len(s) - math.ceil(len(s) * similarity - 1e-9) + 1]:
                    rare[x].append(where)
        plain = [w for w in self.words if w[0] != "<"]
        known = np.array([word_hash(w) for w in plain], np.uint64)
        by = np.argsort(known)
        self.word_hashes, self.word_ids = known[by], np.array([self.words[w] for w in plain], np.int64)[by]
        self.unit_hashes = np.sort(np.array([word_hash(w) for w in _UNITS], np.uint64))
        self.common_hashes = np.sort(np.array([word_hash(w) for w in _COMMON], np.uint64))
        self.hashes = [np.array(sorted(set().union(*x)), np.uint64) for x in self.sets]
        self.short = sorted({len(r[0][1]) for _, r in self.items if len(r[0][1]) < width})

    def template_ids(self, texts: list[str], starts: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(text number, id) of the template tokens of some texts; id 0: in no item."""
        tokens = block_tokens(texts)
        return tokens[0], self._ids(*tokens, starts)

    def _ids(self, of: np.ndarray, h: np.ndarray, kind: np.ndarray, starts: bool) -> np.ndarray:
        number, name = (kind & 1) > 0, (kind & 2) > 0
        if starts:
            first = np.flatnonzero(kind & 4)
            name[first[~np.isin(h[first], self.common_hashes)]] = True
        ids = np.zeros(len(h), np.int64)
        if len(self.word_hashes):
            spot = np.minimum(np.searchsorted(self.word_hashes, h), len(self.word_hashes) - 1)
            ids = np.where(self.word_hashes[spot] == h, self.word_ids[spot], 0)
        ids[name] = self.words.get(NAME, 0)
        after = np.r_[False, number[:-1] & (of[1:] == of[:-1])] if len(h) else number
        if after.any():
            unit = np.flatnonzero(after & ~number)
            unit = unit[np.isin(h[unit], self.unit_hashes)]
            ids[unit] = self.words.get(UNIT, 0)
        ids[number] = self.words.get(NUM, 0)
        return ids

    def found_in(self, texts: list[str]) -> list[list[tuple[int, float]]]:
        """For each text (item id, share of its windows) of the items that it holds."""
        best: list[dict[int, float]] = [{} for _ in texts]
        if self.items:
            tokens = block_tokens(texts)
            for starts in (False, True):
                self._read(texts, *tokens[:2], self._ids(*tokens, starts), starts, best)
        return [[(self.items[item][0], share) for item, share in found.items()] for found in best]

    def _read(self, texts: list[str], of: np.ndarray, values: np.ndarray, ids: np.ndarray, starts: bool, best: list[dict[int, float]]) -> None:
        """Put the items found in one reading of the texts, and their shares, into ``best``. ``values``: hashes of the tokens."""
        hashes, rare, sets = self.hashes[starts], self.rare[starts], self.sets[starts]
        if not len(hashes):
            return
        begin = np.searchsorted(of, np.arange(len(texts) + 1))
        slots = np.isin(ids, [self.words.get(x, -1) for x in SLOTS])
        places: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for width in [*self.short, self.width]:
            if len(ids) < width:
                continue
            # a window that holds an unknown token or the end of a text cannot match
            run = np.cumsum(np.r_[0, ids > 0])
            at = np.flatnonzero((run[width:] - run[:-width] == width) & (of[width - 1 :] == of[: len(of) - width + 1]))
            if not len(at):
                continue
            h = windows(ids, values, slots, at, width)
            spot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            match = hashes[spot] == h
            for p, x in zip(at[match].tolist(), h[match].tolist(), strict=True):
                places[int(of[p])][x].append(p - int(begin[of[p]]))
        for number, held in places.items():
            likely = sorted({item for x in held if x in rare for item in rare[x]})
            likely = [item for item in likely if len(held.keys() & sets[item]) >= self.similarity * len(sets[item]) - 1e-9]
            if not likely:
                continue
            template, theirs = canonical(texts[number], starts)
            for item in likely:
                own, t, v = self.items[item][1][starts]
                width = min(self.width, len(t))
                pairs = [(i, p) for i, x in enumerate(own) for p in held.get(x, ()) if template[p : p + width] == t[i : i + width]]
                share = self._consistent(pairs, len(sets[item]), t, v, theirs) if pairs else 0.0
                if share >= self.similarity:
                    best[number][item] = max(share, best[number].get(item, 0.0))

    def _consistent(self, pairs, total: int, template: list[str], own: list[str], theirs: list[str]) -> float:
        """Largest share of the item's windows that one passage of the text covers with agreeing slots.
        A passage: places of the text in which the item fits at about one offset."""
        pairs.sort(key=lambda x: (x[1] - x[0], x[1]))
        best, run = 0.0, []
        for pair in [*pairs, None]:
            if run and (pair is None or (pair[1] - pair[0]) - (run[-1][1] - run[-1][0]) > max(3, len(template) // 5)):
                slots: dict[str, str] = {}
                seen = set()
                for i, p in sorted(run):
                    w = range(min(self.width, len(template) - i))
                    bare = all(template[i + j] in SLOTS for j in w)
                    if bare and any(own[i + j] != theirs[p + j] for j in w):
                        continue
                    if all(slots.setdefault(own[i + j], theirs[p + j]) == theirs[p + j] for j in w if own[i + j]):
                        seen.add((*template[i : i + self.width], *(own[i : i + self.width] if bare else ())))
                best, run = max(best, len(seen) / total), []
            if pair:
                run.append(pair)
        return best


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int = BLOCK_CHARS):
    """The items in blocks of about ``most`` characters, streamed to the driver one block at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).distinct()
    for r in rows.sortWithinPartitions("i").toLocalIterator():
        if block and size + len(r["t"]) > most:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    yield block


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """doc_id, n_items (items found), item_id (the most similar, then the smallest), similarity, contaminated.

    Null and empty texts hold no item; items without a word are found nowhere; an item shorter than
    a window must be there as a whole. Repeated rows and null ids give a row each; without items
    nothing is contaminated; an empty table gives an empty result. Other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    carried = ["n_items", "item_id", "similarity"]
    out = few_tasks(docs).select(*cols, F.lit(0).cast("long").alias("n_items"), F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"))
    for block in item_blocks(benchmark, item_col, item_text_col):
        known = sc.broadcast(Templates(block, width, similarity))

        @releasing(keep="characters")
        def run(batches, known=known):
            for b in slices(batches):
                texts = b.column("text").to_pylist()
                n, best, share = (b.column(c).to_pylist() for c in carried)
                found = [f for block in in_blocks([t or "" for t in texts], TOGETHER) for f in known.value.found_in(block)]
                for at, items in enumerate(found):
                    for item, s in items:
                        n[at] += 1
                        if (-s, item) < (-share[at], best[at] if best[at] is not None else item + 1):
                            best[at], share[at] = item, s
                yield pa.record_batch([b.column("doc_id"), b.column("text"), pa.array(n, pa.int64()), pa.array(best, pa.int64()), pa.array(share, pa.float64())], names=["doc_id", "text", *carried])

        out = out.mapInArrow(run, "doc_id long, text string, n_items long, item_id long, similarity double")
    out = out.drop("text")
    return out.withColumn("contaminated", F.col("n_items") > 0)


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows in which no item is found, with all columns and without a shuffle."""
    sc = docs.sparkSession.sparkContext
    at = docs.columns.index(text_col)
    docs = few_tasks(docs)
    for block in item_blocks(benchmark, item_col, item_text_col):
        known = sc.broadcast(Templates(block, width, similarity))

        @releasing(keep="characters")
        def run(batches, known=known):
            for b in slices(batches):
                texts = [t or "" for t in b.column(at).to_pylist()]
                keep = [not f for part in in_blocks(texts, TOGETHER) for f in known.value.found_in(part)]
                yield b.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
