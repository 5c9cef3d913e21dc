"""Operator 1: benchmark decontamination by a BM25 inverted index of the test items with block-max WAND.

The index holds, for each term, the items it is in, in their order, with its BM25 impact as a share of the item's score
against its own text, so one threshold holds for all items.  Postings are in blocks of items, and the index has each
term's largest impact in all items and in each block.  Every passage of every document is a query: windows of twice the
longest item's words, which begin every that many words, so each run of words as long as an item lies whole in one.
As in WAND a passage is left as soon as the sum of its terms' largest impacts is below the threshold, and as in block-max
WAND a block of items is skipped if the sum of their largest impacts in the block is; what remains is scored in full.
The bounds of all passages of a batch are taken at once: cursors that move passage by passage find the same items and
were measured at five times the time in Python.  All items at or above the threshold are retrieved, none cut off by a
count.

An item is found in a passage if at least half of its question's words and half of its answer's words lie in runs of
three words that the passage has too, so a few edits or a missing end don't hide it.  An answer of under three words
counts with the question.  Items of one text are one question without answer.  Words are runs of letters and digits of
any script, without regard to case; all other characters only part them.  Of several passages of a document the one of
the highest score is reported.

Document frequencies, mean length and the longest item are those of all items.  Items come in shards of a bounded number
of bytes; each shard is broadcast and meets all documents, and how many there are changes no result.  Items without
words and null texts find nothing.  Items of under three words need the whole item as a run.  Rows that repeat a
doc_id give one result, rows without doc_id none; items that repeat an item_id, too.  An empty table gives no row.
Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .words import LOWER, Block, U, as_long, blocks, span_hashes, windows

K1, B = 1.2, 0.75
RUN, BLOCK_ITEMS = 3, 16
_WORDS = np.zeros(256, bool)
_WORDS[48:58] = _WORDS[65:91] = _WORDS[97:123] = _WORDS[128:] = True
_WORD = re.compile(r"[^\W_]+")


def _spelled(b: Block) -> Block:
    """The block with all documents that are not ASCII written as their words, case folded, with blanks between."""
    high = np.append(0, np.cumsum(b.data >= 128))
    odd = np.flatnonzero(high[b.offsets[1:]] > high[b.offsets[:-1]])
    if not len(odd):
        return b
    parts, at = [], 0
    sizes = np.diff(b.offsets)
    for d in odd.tolist():
        parts.append(b.data[at : b.offsets[d]])
        at = b.offsets[d + 1]
        text = b.data[b.offsets[d] : at].tobytes().decode("utf-8", "replace").casefold()
        parts.append(np.frombuffer(" ".join(_WORD.findall(text)).encode(), np.uint8))
        sizes[d] = len(parts[-1])
    return Block(b.first, np.concatenate([*parts, b.data[at:]]), np.append(0, np.cumsum(sizes)))


def plain_words(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(names of the runs of letters and digits, without case, and offsets by document)."""
    b = _spelled(b)
    data = b.data
    if not len(data):
        return np.zeros(0, U), np.zeros(b.n + 1, np.int64)
    inside = _WORDS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[b.offsets] = edge[0] = edge[-1] = True
    change = edge.copy()
    change[1:-1] |= inside[1:] != inside[:-1]
    at = np.flatnonzero(change)
    words = inside[at[:-1]]
    starts, ends = at[:-1][words], at[1:][words]
    return span_hashes(LOWER[data], starts, ends), np.searchsorted(starts, b.offsets)


def runs_of(names: np.ndarray, k: int) -> np.ndarray:
    return windows(names, np.array([0, len(names)]), k)[0]


@dataclass
class Item:
    item_id: int
    names: np.ndarray
    n_question: int  # the words from there on are the answer's
    k: int
    runs: np.ndarray

    def overlaps(self, passage: np.ndarray) -> tuple[float, float]:
        """Shares of the question's and the answer's words in runs that the passage has; without answer, 1."""
        have = np.isin(self.runs, runs_of(passage, self.k))
        mark = np.zeros(len(self.names) + 1, np.int64)
        np.add.at(mark, np.flatnonzero(have), 1)
        np.add.at(mark, np.flatnonzero(have) + self.k, -1)
        inside = np.cumsum(mark[:-1]) > 0
        q, a = inside[: self.n_question], inside[self.n_question :]
        return (float(q.mean()) if len(q) else 1.0), (float(a.mean()) if len(a) else 1.0)


def make_item(item_id: int, question: str, answer: str | None) -> Item | None:
    sides = [plain_words(b)[0] for t in (question or "", answer or "") for b in blocks(pa.array([t]))]
    names = np.concatenate(sides)
    if not len(names):
        return None
    k = min(RUN, len(names))
    return Item(item_id, names, len(sides[0]) if len(sides[1]) >= RUN else len(names), k, runs_of(names, k))


class Index:
    """Postings of a shard of items, term by term, with the largest impacts by term and by term and block.

    total: number and mean length of all items, and their document frequencies as sorted terms and counts; if None, the
    shard is all there is.
    """

    def __init__(self, items: list[Item], total: tuple[int, float, np.ndarray, np.ndarray] | None = None):
        self.items = items
        n, lengths = len(items), np.array([len(i.names) for i in items], np.int64)
        names = np.concatenate([i.names for i in items]) if n else np.zeros(0, U)
        self.terms, which = np.unique(names, return_inverse=True)
        pair, tf = np.unique(which * np.int64(max(n, 1)) + np.repeat(np.arange(n), lengths), return_counts=True)
        term, self.item = pair // max(n, 1), pair % max(n, 1)
        many, mean, df = n, lengths.mean() if n else 1.0, np.bincount(term, minlength=len(self.terms))
        if total:
            many, mean, df = total[0], total[1], total[3][np.searchsorted(total[2], self.terms)]
        idf = np.log(1 + (many - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.item] / max(mean, 1)))
        whole = np.bincount(self.item, weights=impact, minlength=n)
        self.impact = impact / whole[self.item] if n else impact
        self.at = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.impact, self.at[:-1]) if len(term) else np.zeros(0)
        code = term * np.int64(n + 1) + self.item // BLOCK_ITEMS
        new = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
        self.block, self.block_most = (self.item // BLOCK_ITEMS)[new], np.maximum.reduceat(self.impact, new) if len(new) else np.zeros(0)
        self.block_at = np.searchsorted(term[new], np.arange(len(self.terms) + 1))

    @property
    def longest(self) -> int:
        return max((len(i.names) for i in self.items), default=0)

    @staticmethod
    def _spread(which: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the term in ``which``, place of the posting) for all postings of terms."""
        n = at[which + 1] - at[which]
        return np.repeat(np.arange(len(which)), n), np.arange(int(n.sum())) + np.repeat(at[which] - (np.cumsum(n) - n), n)

    def retrieve(self, names: np.ndarray, first: np.ndarray, last: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all with score >= least; passages are names[first:last]."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if not len(self.terms) or not len(first):
            return none
        slack = 1e-9
        at = np.minimum(np.searchsorted(self.terms, names), len(self.terms) - 1)
        hit = self.terms[at] == names
        bound = np.zeros(len(names) + 1)
        np.cumsum(np.where(hit, self.most[at], 0.0), out=bound[1:])
        alive = np.flatnonzero(bound[last] - bound[first] >= least - slack)  # repeated terms only raise the bound
        if not len(alive):
            return none
        n = last[alive] - first[alive]
        place = np.arange(int(n.sum())) + np.repeat(first[alive] - (np.cumsum(n) - n), n)
        p = np.repeat(alive, n)[hit[place]]
        pair = np.unique(p * np.int64(len(self.terms)) + at[place[hit[place]]])
        p, t = pair // len(self.terms), pair % len(self.terms)
        total = np.bincount(p, weights=self.most[t], minlength=len(first))
        keep = total[p] >= least - slack
        p, t = p[keep], t[keep]
        if not len(p):
            return none
        n_blocks = -(-len(self.items) // BLOCK_ITEMS)
        i, j = self._spread(t, self.block_at)
        code, which = np.unique(p[i] * np.int64(n_blocks) + self.block[j], return_inverse=True)
        code = code[np.bincount(which, weights=self.block_most[j]) >= least - slack]
        if not len(code):
            return none
        some = np.isin(p, code // n_blocks)
        p, t = p[some], t[some]
        i, j = self._spread(t, self.at)
        keep = np.isin(p[i] * np.int64(n_blocks) + self.item[j] // BLOCK_ITEMS, code)
        i, j = i[keep], j[keep]
        code, which = np.unique(p[i] * np.int64(len(self.items)) + self.item[j], return_inverse=True)
        score = np.bincount(which, weights=self.impact[j])
        good = score >= least - slack
        return code[good] // len(self.items), code[good] % len(self.items), score[good]


def passages(to: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last word) of the windows of each document."""
    n = np.diff(to)
    step = max(1, longest)
    count = np.where(n > 0, np.maximum(1, -(-(n - step) // step)), 0)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    first = np.repeat(to[:-1], count) + nth * step
    return first, np.minimum(first + 2 * step, np.repeat(to[1:], count))


def item_terms(items: DataFrame) -> DataFrame:
    """(term, n, words, longest): in how many items a term is; under a null term, the items, their words and the
    longest one's."""

    def run(batches):
        for batch in batches:
            terms, sizes = [], []
            for q, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                item = make_item(0, q, a)
                if item:
                    terms.append(np.unique(item.names))
                    sizes.append(len(item.names))
            if sizes:
                names = np.concatenate(terms)
                one = pa.array(np.append(np.ones(len(names), np.int64), len(sizes)))
                last = lambda x, n=len(names): pa.array(np.append(np.zeros(n, np.int64), x))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([as_long(names), pa.nulls(1, pa.int64())]), one, last(sum(sizes)), last(max(sizes))], ["term", "n", "words", "longest"])

    rows = items.select("question", "answer").mapInArrow(run, "term long, n long, words long, longest long")
    return rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("longest").alias("longest"))


def contaminated(docs: DataFrame, items: DataFrame, least_score: float = 0.5, least_overlap: float = 0.5, shard_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of all items found in documents.

    items: item_id, question, answer (null: none).
    """
    spark = docs.sparkSession
    items = items.where("item_id is not null").select(F.col("item_id").cast("long"), "question", "answer").dropDuplicates(["item_id"])
    size = items.agg(F.sum(F.octet_length(F.coalesce("question", F.lit(""))) + F.octet_length(F.coalesce("answer", F.lit(""))))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    counts = store.written(item_terms(items), store.scratch(spark, "item-terms"))
    whole = counts.where("term IS NULL").first()
    n, words, longest = (whole["n"], whole["words"], whole["longest"]) if whole else (0, 0, 0)
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    out = None
    for shard in range(shards):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard).orderBy("item_id").collect()  # about shard_bytes
        made = [x for r in mine if (x := make_item(r["item_id"], r["question"], r["answer"]))]
        have = np.unique(np.concatenate([x.names for x in made])) if made else np.zeros(0, U)
        if shards == 1:
            df = counts.where("term IS NOT NULL").select("term", "n").toArrow()
        else:  # of the shard's terms, which are no more than its words
            some = spark.createDataFrame(pa.table({"term": as_long(have)}))
            df = counts.join(some, "term").select("term", "n").toArrow()
        terms = np.asarray(df["term"]).astype(np.int64).view(U)
        order = np.argsort(terms)
        index = spark.sparkContext.broadcast(Index(made, (n, words / max(n, 1), terms[order], np.asarray(df["n"])[order])))

        def run(batches, index=index):
            for batch in batches:
                for b in blocks(batch.column(1)):
                    names, to = plain_words(b)
                    first, last = passages(to, longest)
                    p, k, score = index.value.retrieve(names, first, last, least_score)
                    found = []
                    for i, item, s in zip(p.tolist(), k.tolist(), score.tolist(), strict=True):
                        q, a = index.value.items[item].overlaps(names[first[i] : last[i]])
                        if q >= least_overlap and a >= least_overlap:
                            found.append((int(np.searchsorted(to, first[i], side="right")) - 1, index.value.items[item].item_id, s, q, a))
                    if found:
                        d, it, *rest = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.n).take(pa.array(d)), pa.array(it, pa.int64()), *[pa.array(x, pa.float64()) for x in rest]], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("b"))
    return best.select("doc_id", "item_id", "b.*")


def as_items(benchmark: DataFrame) -> DataFrame:
    """Items of one text, which are all question."""
    return benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("question"), F.lit(None).cast("string").alias("answer"))



def op1_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    store.light_batches(spark)
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, as_items(benchmark))
