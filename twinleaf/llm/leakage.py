"""Problem 7: passages of held-out test items inside corpus documents.

The test items form a BM25 inverted index whose postings lie in blocks with block maxima. Its terms are winnowed grams
of the text without blanks, so lost and added blanks change nothing and scripts without blanks need no word breaks.
Every passage of every document is a query: block-max WAND - cursors in item order, pivot, block check, skip - returns
all items whose score reaches the threshold, and each is verified by exact overlap of consecutive words. The cursors of
many passages move together, as arrays.

The threshold loses nothing: an item's weights are divided by the least weight that the terms of any ``run``
consecutive words of it are sure to have, so a passage that holds such a run scores at least 1.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinleaf.llm.normalizing import consistent
from twinleaf.sources.tables import shuffle_width, spread
from twinleaf.sources.work import written

K1, B = 1.2, 0.75
#: Characters of a gram, and grams of which the least by hash is a term: GRAM + WINDOW - 1 equal characters, which any 12
#: words have, share a term.
GRAM, WINDOW = 8, 5
SURE = GRAM + WINDOW - 1
#: Characters by which the least weight of a run is reckoned. Passages are twice as long, so each such stretch lies in one.
STRETCH = 96
#: Postings of a block.
BLOCK = 64
#: Postings of one shard of the index. Shards lie side by side; the corpus is read once for all of them.
SHARD = 2_500_000
#: Characters of the documents that one task compares with one shard.
TASK_CHARS = 32_000_000
#: Bits of the filter for each term, and at most in all.
FILTER_BITS, FILTER_MOST = 64, 1 << 28
#: Characters hashed at once.
SLICE = 1 << 20
NONE = np.iinfo(np.int64).max
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)

_LINE_CUT = re.compile(r"[-‐‑¬­]\s*\n\s*")
_GLUED = re.compile(r"(?<=[^\W\d_])[.!?;:](?=[^\W\d_])")
_REFERENCE = re.compile(r"\[\d{1,3}\]")
_MARKS = re.compile(r"[^\w\s]|_")
_NO_LETTERS = re.compile(r"[\W_]+")
#: Letters of scripts that don't part words; two of them count as a word.
_UNPARTED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿𠀀-𯿿]{1,2}")


def words_of(text: str) -> list[str]:
    """Words of ``text`` without case, marks and spacing; look-alike characters as the letters they imitate."""
    t = _REFERENCE.sub(" ", _LINE_CUT.sub("", consistent(text).casefold()))
    t = _MARKS.sub("", _GLUED.sub(" ", t))
    return _UNPARTED.sub(r" \g<0> ", t).split()


def squeezed(text: str) -> str:
    """``text`` as its words without anything between them."""
    return _NO_LETTERS.sub("", _REFERENCE.sub(" ", consistent(text).casefold()))


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A mixed hash of the gram that begins at each of the ``codes``."""
    n = len(codes) - GRAM + 1
    h = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(GRAM):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[k : k + len(h)]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _least_of_window(h: np.ndarray) -> np.ndarray:
    n = max(len(h) - WINDOW + 1, 0)
    least = h[:n].copy()
    for k in range(1, WINDOW):
        np.minimum(least, h[k : k + n], out=least)
    return least


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every term of the squeezed ``texts``: number of its text, place in it, hash."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    found_at, found = [], []
    for a in range(0, max(len(codes), 1), SLICE):
        h = _hashes(codes[a : a + SLICE + SURE])
        if not len(h):
            continue
        # Grams that reach into the next text are none.
        inner = ends[(ends > a) & (ends < a + len(h) + GRAM - 1)] - a
        for e in inner.tolist():
            h[max(e - GRAM + 1, 0) : e] = _LAST
        least = _least_of_window(h)
        chosen = np.zeros(len(h), dtype=bool)
        for k in range(WINDOW):
            chosen[k : k + len(least)] |= h[k : k + len(least)] == least
        at = np.flatnonzero(chosen & (h != _LAST))
        found_at.append(at + a)
        found.append(h[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, hashes = np.concatenate(found_at), np.concatenate(found)
    if len(codes) > SLICE:  # slices overlap
        at, first = np.unique(at, return_index=True)
        hashes = hashes[first]
    text = np.searchsorted(ends, at, side="right")
    return text, at - (ends - sizes)[text], hashes


class Item:
    """A test item: its words, and by window of grams the term that the window is sure to give."""

    def __init__(self, text: str, run: int):
        self.words = words_of(text)
        self.run = run
        lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        codes = np.frombuffer("".join(self.words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        self.sure = _least_of_window(_hashes(codes))

    @property
    def usable(self) -> bool:
        """Whether it has ``run`` words, each run of which gives a term."""
        return len(self.words) >= self.run and len(self.sure) > 0

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """The first and last window of every run of words."""
        n = len(self.words) - self.run + 1
        first = self.starts[:n]
        end = np.minimum(self.ends[self.run - 1 :], first + STRETCH)
        return first, np.maximum(end - SURE, first)

    def least(self, weight: np.ndarray) -> float:
        """The least sum of the ``weight`` of windows over the distinct terms of a run."""
        first, last = self.runs()
        same = np.full(len(self.sure), -1, dtype=np.int64)
        order = np.argsort(self.sure, kind="stable")
        equal = self.sure[order][1:] == self.sure[order][:-1]
        same[order[1:][equal]] = order[:-1][equal]  # the window before with the same term
        best, a, step = np.inf, 0, 256
        while a < len(first):
            f, e = first[a : a + step, None], last[a : a + step, None]
            span = int(e[-1, 0] - f[0, 0]) + 1
            if len(f) > 1 and span * len(f) > 4_000_000:
                step = max(1, step // 2)
                continue
            at = np.arange(f[0, 0], f[0, 0] + span)[None, :]
            counted = (at >= f) & (at <= e) & (same[at] < f)
            best = min(best, float((counted * weight[at]).sum(axis=1).min()))
            a += len(f)
        return best


def weights(items: Iterable[Item], df: Iterable[dict[int, int]], n: int, average: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The terms of each item and their BM25 weights over the least weight of a run."""
    for item, counts in zip(items, df):
        terms, back, tf = np.unique(item.sure, return_inverse=True, return_counts=True)
        held = np.array([counts[int(t)] for t in terms.view(np.int64)], dtype=np.float64)
        norm = K1 * (1 - B + B * len(item.words) / average)
        raw = np.log(1 + (n - held + 0.5) / (held + 0.5)) * tf * (K1 + 1) / (tf + norm)
        yield terms, raw / item.least(raw[back])


class ItemIndex:
    """Inverted index of one shard of items: postings in blocks, and the items' words for verification."""

    def __init__(self, ids: list[int], words: list[list[str]], terms: list[np.ndarray], weight: list[np.ndarray], run: int = 12):
        # Items of like beginnings get numbers side by side, which makes the block maxima sharper.
        order = sorted(range(len(ids)), key=lambda k: words[k])
        self.ids, self.words, self.run = [ids[k] for k in order], [words[k] for k in order], run
        self.size = max(len(ids), 1)
        number = np.repeat(np.arange(len(order)), [len(terms[k]) for k in order])
        hashes = np.concatenate([terms[k] for k in order]) if order else np.zeros(0, np.uint64)
        value = np.concatenate([weight[k] for k in order]) if order else np.zeros(0)
        by = np.lexsort((number, hashes))
        hashes, self.item, self.weight = hashes[by], number[by], value[by]
        self.term, self.start, count = np.unique(hashes, return_index=True, return_counts=True)
        self.stop = self.start + count
        #: Postings in one order over all terms, to find the first one of a term at or behind an item.
        self.key = np.repeat(np.arange(len(self.term)), count) * self.size + self.item
        blocks = -(-count // BLOCK)
        self.first_block = np.cumsum(blocks) - blocks
        begins = np.repeat(self.start, blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(self.first_block, blocks))
        ends = np.minimum(begins + BLOCK, np.repeat(self.stop, blocks))
        if len(begins):
            self.block_max = np.maximum.reduceat(self.weight, begins)
            self.block_last = self.item[ends - 1]
            self.top = np.maximum.reduceat(self.weight, self.start)
        else:
            self.block_max, self.block_last, self.top = np.zeros(0), np.zeros(0, np.int64), np.zeros(0)
        self._windows = functools.lru_cache(maxsize=4096)(self._joined)

    def candidates(self, passage: np.ndarray, term: np.ndarray, threshold: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(passage, item, score)`` of all items that score ``threshold`` or more: block-max WAND over all passages.

        ``passage`` and ``term`` name the terms of the passages, once each, ordered by passage.
        """
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        goal = threshold - 1e-6
        bound = np.bincount(passage, weights=self.top[term]) if len(passage) else np.zeros(0)
        alive = bound[passage] >= goal if len(passage) else np.zeros(0, bool)
        passage, term = passage[alive], term[alive]
        names, first, count = np.unique(passage, return_index=True, return_counts=True)
        by_count = np.argsort(count, kind="stable")  # passages of like numbers of cursors go together
        at = 0
        while at < len(names):
            rows = by_count[at : at + 2048]
            while len(rows) > 1 and count[rows[-1]] * len(rows) > 400_000:
                rows = rows[: len(rows) // 2]
            at += len(rows)
            width = int(count[rows[-1]])
            column = np.arange(width)[None, :]
            used = column < count[rows][:, None]
            terms = np.where(used, term[np.minimum(first[rows][:, None] + column, len(term) - 1)], -1)
            found += self._together(names[rows], terms, goal)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found))

    def _seek(self, term: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The first posting of each term at or behind the item."""
        return np.searchsorted(self.key, term * self.size + item)

    def _together(self, names: np.ndarray, term: np.ndarray, goal: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Moves the cursors of the passages ``names``; ``term`` has a row of them for each passage, -1 where it has fewer."""
        at = np.where(term >= 0, self.start[term], 0)
        item = np.where(term >= 0, self.item[at], NONE)
        while len(names):
            # The pivot: the first item, in cursor order, at which the term maxima can reach the goal together.
            order = np.argsort(item, axis=1, kind="stable")
            term, item = np.take_along_axis(term, order, 1), np.take_along_axis(item, order, 1)
            live = item < NONE
            reach = np.cumsum(np.where(live, self.top[term], 0.0), axis=1)
            place = np.argmax(reach >= goal, axis=1)
            rows = np.arange(len(names))
            going = (reach[rows, place] >= goal) & live[rows, place]
            if not going.all():
                names, term, item, live, place = names[going], term[going], item[going], live[going], place[going]
                rows = np.arange(len(names))
                if not len(names):
                    return
            pivot = item[rows, place][:, None]
            ahead = live & (item <= pivot)
            # The blocks in which the cursors would stand at the pivot.
            at = np.where(ahead, self._seek(np.where(ahead, term, 0), np.where(ahead, pivot, 0)), 0)
            inside = ahead & (at < self.stop[term])
            safe = np.where(inside, at, 0)
            block = np.where(inside, self.first_block[term] + (safe - self.start[term]) // BLOCK, 0)
            block_bound = np.where(inside, self.block_max[block], 0.0).sum(axis=1)
            scored = block_bound >= goal
            exact = inside & (self.item[safe] == pivot) & scored[:, None]
            score = np.where(exact, self.weight[safe], 0.0).sum(axis=1)
            hit = scored & (score >= goal)
            if hit.any():
                yield names[hit], pivot[hit, 0], score[hit]
            # Behind the pivot where it was scored, else behind the first of its blocks to end.
            block_end = np.where(inside, self.block_last[block], NONE - 1).min(axis=1)
            beyond = np.where(ahead, NONE, item).min(axis=1)
            goes_to = np.where(scored, pivot[:, 0] + 1, np.maximum(np.minimum(block_end + 1, beyond), pivot[:, 0] + 1))[:, None]
            # No item has a number as high as the size of the index.
            moved = self._seek(np.where(ahead, term, 0), np.where(ahead, np.minimum(goes_to, self.size), 0))
            ended = moved >= self.stop[term]
            item = np.where(ahead, np.where(ended, NONE, self.item[np.where(ended, 0, moved)]), item)

    def _joined(self, item: int) -> tuple[list[str], list[str]]:
        ws, run = self.words[item], self.run
        half = max(1, run // 2)
        # Every run of ``run`` words covers one of these anchors whole.
        anchors = ["".join(ws[k : k + half]) for k in range(0, len(ws) - half + 1, half)]
        return anchors, ["".join(ws[k : k + run]) for k in range(len(ws) - run + 1)]

    def longest(self, item: int, text: str) -> int:
        """Words of the longest run of the item that the squeezed ``text`` holds, 0 below ``run``."""
        ws, run = self.words[item], self.run
        anchors, windows = self._windows(item)
        if not any(x in text for x in anchors):
            return 0
        best = length = 0
        for k, window in enumerate(windows):
            if window not in text:
                length = 0
            elif length and "".join(ws[k - length : k + run]) in text:
                length += 1
            else:
                length = 1
            best = max(best, length)
        return best + run - 1 if best else 0

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, float]]:
        """``(number of the text, item id, words of the longest run, best passage score)`` for squeezed ``texts``."""
        text, place, hashes = terms_of(texts)
        known = np.minimum(np.searchsorted(self.term, hashes), max(len(self.term) - 1, 0))
        held = self.term[known] == hashes if len(self.term) else np.zeros(len(hashes), bool)
        text, place, term = text[held], place[held], known[held]
        if not len(text):
            return
        # Passage k of a text has the characters from k stretches on, two stretches long.
        most = int(place.max()) // STRETCH + 2
        behind = text * most + place // STRETCH + 1
        key = np.unique(np.concatenate([behind, behind - 1]) * len(self.term) + np.tile(term, 2))
        passages, passage = np.unique(key // len(self.term), return_inverse=True)
        names, items, score = self.candidates(passage, key % len(self.term))
        best: dict[tuple[int, int], float] = {}
        for t, d, s in zip((passages[names] // most).tolist(), items.tolist(), score.tolist()):
            best[t, d] = max(best.get((t, d), 0.0), s)
        for (t, d), s in sorted(best.items()):
            if n := self.longest(d, texts[t]):
                yield t, self.ids[d], n, s


def _groups(texts: Iterable[str]) -> Iterator[tuple[int, list[str]]]:
    """The texts in groups of about ``SLICE`` characters, with the number of the first one."""
    start, group, size = 0, [], 0
    for k, t in enumerate(texts):
        group.append(t)
        size += len(t)
        if size >= SLICE:
            yield start, group
            start, group, size = k + 1, [], 0
    if group:
        yield start, group


def _prepared(items: DataFrame, run: int) -> DataFrame:
    """The usable items with their terms and weights: ``item_id``, ``words``, ``terms``, ``weights``, ``fewest``.

    ``fewest``: terms that any run of the item is sure to have at least. All counts are over all items.
    """
    held = items.select("item_id", "text").where("item_id is not null and text is not null").dropDuplicates(["item_id"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, t in zip(batch["item_id"], batch["text"]):
                item = Item(t, run)
                if item.usable:
                    distinct = np.unique(item.sure).view(np.int64)
                    out.append((i, t, len(item.words), distinct, int(round(item.least(np.ones(len(item.sure)))))))
            yield pd.DataFrame(out, columns=["item_id", "text", "size", "terms", "fewest"])

    counted = written(held.mapInPandas(count, "item_id long, text string, size long, terms array<long>, fewest int"), "items")
    n, average = counted.agg(F.count(F.lit(1)), F.avg("size")).first()
    each = counted.select("item_id", F.explode("terms").alias("term"))
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    with_df = each.join(df, "term").groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [Item(t, run) for t in batch["text"]]
            pairs = weights(own, [dict(x) for x in batch["df"]], n, average)
            out = [(i, x.words, t.view(np.int64), w, f) for i, x, f, (t, w) in zip(batch["item_id"], own, batch["fewest"], pairs)]
            yield pd.DataFrame(out, columns=["item_id", "words", "terms", "weights", "fewest"])

    schema = "item_id long, words array<string>, terms array<long>, weights array<double>, fewest int"
    return written(counted.join(with_df, "item_id").mapInPandas(weigh, schema), "index")


def _filter(prepared: DataFrame, bits: int) -> np.ndarray:
    """A bit for every term: whether it may be in the index. Its size is bounded by ``FILTER_MOST``."""
    place = F.col("term").bitwiseAND(F.lit(bits - 1))
    set_ = prepared.select(F.explode("terms").alias("term")).select(F.shiftright(place, 6).alias("cell"), F.pmod(place, F.lit(64)).cast("int").alias("bit"))
    cells = set_.groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("held")).toArrow()
    out = np.zeros(max(bits // 64, 1), dtype=np.int64)
    out[cells["cell"].to_numpy()] = cells["held"].to_numpy()
    return out.view(np.uint64)


def leaked_items(docs: DataFrame, items: DataFrame, run: int = 12, shard: int = SHARD, task_chars: int = TASK_CHARS) -> DataFrame:
    """Every pair of a document and a test item of which it holds ``run`` or more consecutive words.

    Columns ``doc_id``, ``item_id``, ``run_words`` (longest run), ``score`` (best BM25 score of a passage, 1 being the
    least score of ``run`` words). Null ids and texts, empty texts and items of fewer words give no rows; rows sent twice and
    repeated texts give one row per pair of ids. Extra columns are ignored. Reference marks such as ``[12]`` are no words;
    in scripts without blanks two letters count as a word.

    The corpus is read once: documents with too few terms of any item in every passage end there, by a filter of bounded
    size; the others go to every shard of the index, each to one task among several, so no task holds more than a shard and
    ``task_chars`` characters. Items are never brought to the driver.
    """
    spark = docs.sparkSession
    index = _prepared(items, run)
    fewest, postings = index.agg(F.min("fewest"), F.sum(F.size("terms"))).first()
    postings = postings or 0
    bits = min(1 << max(postings * FILTER_BITS, 1 << 12).bit_length(), FILTER_MOST)
    sent = spark.sparkContext.broadcast((_filter(index, bits), np.uint64(bits - 1), fewest or 1))

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, mask, least = sent.value
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for start, group in _groups(squeezed(t) for t in batch["text"]):
                text, place, hashes = terms_of(group)
                at = hashes & mask
                maybe = (held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
                text, place = text[maybe], place[maybe] // STRETCH
                if not len(text):
                    continue
                most = int(place.max()) + 2
                n = np.bincount(text * most + place, minlength=(int(text.max()) + 1) * most)
                n[1:] += n[:-1].copy()
                good = np.unique(np.flatnonzero(n >= least) // most)
                good = good[good < len(group)]
                yield pd.DataFrame({"doc_id": ids[start + good], "text": pd.Series([group[k] for k in good.tolist()], dtype=object)})

    rows = spread(docs.select("doc_id", "text").where("doc_id is not null and text is not null"), "doc_id")
    queries = written(rows.mapInPandas(kept, "doc_id long, text string"), "queries")
    chars = queries.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-postings // shard))
    salts = max(1, -(-shuffle_width(spark) // shards), -(-chars // task_chars))
    salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(salts)).cast("int")
    asked = queries.select("doc_id", "text", salt.alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    number = F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int")
    lying = index.select("item_id", "words", "terms", "weights", number.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            terms = [np.asarray(x, dtype=np.int64).view(np.uint64) for x in right["terms"]]
            own = ItemIndex(right["item_id"].tolist(), [list(w) for w in right["words"]], terms, right["weights"].tolist(), run)
            ids = left["doc_id"].tolist()
            for start, group in _groups(left["text"]):
                out += [(ids[start + t], i, n, s) for t, i, n, s in own.search(group)]
        return pd.DataFrame(out, columns=["doc_id", "item_id", "run_words", "score"])

    found = asked.groupBy("shard", "salt").cogroup(lying.groupBy("shard", "salt")).applyInPandas(
        search, "doc_id long, item_id long, run_words int, score double"
    )
    return found.groupBy("doc_id", "item_id").agg(F.max("run_words").alias("run_words"), F.max("score").alias("score"))
