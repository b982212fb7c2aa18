"""Language-model scores by a gated recurrent network with a class-factored softmax (``recurrent``).

Tokens are words with A-Z lower-cased and one end for each text. Training rows are those with crc32(doc_id) mod 5
other than 1.

1. Spark counts the tokens of all training rows. The most frequent words, whole classes of equal counts of at most ``LOOKUP``
   words, are broadcast; the counts of all others stay a table.
2. The network knows the ``MODEL`` most frequent of those, the end, and one id for every other word, whose share
   within that id is that of its count, (c + 1/2) / (n + (v + 1) / 2), where n and v count the training tokens and
   words outside the network, so the model gives every known word and one unknown word a probability, and all of them sum to 1.
   It starts from the counts of all training tokens.
3. Every row is put into ids once, whole, and kept.
4. ``ROUNDS`` times, every partition trains the network on its own share of the texts, by truncated backpropagation with the
   state carried on, and Spark averages the weights by tokens, parameter block by parameter block. All training rows are
   trained on, each in one round, which a hash of the row gives.
5. Every text is scored whole, the state carried from window to window. Words outside the broadcast ones go to the
   table of counts by a join, and their logarithms come back as sums by row.

Null texts are empty ones, which have one token, the end. Rows with a null id are learned from. Repeated rows count
each; ties in count go to the lesser word. Without training rows both scores are 0. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import recurrent
from textloom.llm.common import cut
from textloom.operators.numbering import stored

LOOKUP, MODEL, HIDDEN, SEED = 1 << 18, 4096, 16, 7
#: One text of so many is trained on: all of them.
EVERY = 1
ROUNDS = 2
#: Words that a task counts before it hands them on, bytes of text that it counts or puts into ids at once, tokens that it
#: scores or trains on at once, weights in a block.
COUNTED, BYTES, TOKENS, BLOCK = 1 << 20, 1 << 23, 1 << 21, 1 << 13
END = ""
ENCODED = "row long, doc_id {id}, held_out boolean, round int, n_tokens long, n_known long, base double, inside double, ids array<int>, rare array<string>, times array<long>"
SCORED = "row long, doc_id {id}, held_out boolean, n_tokens long, n_known long, base double, score double, others long"


def learned(doc_id: Column) -> Column:
    """Whether a row is one to learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 1, F.lit(True))


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all ``texts`` end to end, and how many each text has."""
    # Arrow's ASCII functions know only ASCII letters and white space.
    held = pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null("")))
    lists = pc.ascii_split_whitespace(held)
    found, n = lists.flatten().cast(pa.string()), lists.value_lengths().to_numpy().astype(np.int64)
    blank = pc.equal(held, "").to_numpy(zero_copy_only=False)
    if blank.any():
        # Such a text is split into one empty word.
        found, n[blank] = found.filter(pc.not_equal(found, "")), 0
    return found, n


def pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of up to ``most`` bytes of ``text``, one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def word_counts(texts: DataFrame) -> DataFrame:
    """``word``, ``n`` over all rows of ``texts`` (``text``); the end of a text is the empty word."""
    most = BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, ends = [], 0, 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for b in batches:
            for part in pieces(b, most):
                counted = word_lists(part.column("text"))[0].value_counts()
                held.append(pa.table({"word": counted.field(0), "n": counted.field(1)}))
                ends += len(part)
                rows += len(counted)
                if rows > 2 * COUNTED:
                    held = [summed()]
                    if len(held[0]) > COUNTED:
                        yield from held[0].to_batches()
                        held = []
                    rows = sum(map(len, held))
        if held:
            yield from summed().to_batches()
        yield pa.record_batch({"word": pa.array([END], pa.string()), "n": pa.array([ends], pa.int64())})
        # Workers go on to other tasks.
        held.clear()
        pa.default_memory_pool().release_unused()

    return cut(texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"))


@dataclass
class Vocabulary:
    """The most frequent words with their counts, falling, the first of which are the network's; totals of all words."""

    words: list[bytes]
    counts: np.ndarray
    end: int
    tokens: int
    distinct: int
    known: int

    @property
    def ids(self) -> tuple[np.ndarray, np.ndarray, int, int]:
        """The network's id of each word and of one outside, the counts by id, the ids of the end and of other words."""
        inside = self.counts[: self.known]
        other = self.tokens - self.end - int(inside.sum())
        counts = np.concatenate([inside, [self.end, other]])
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order))
        of = np.full(len(self.words) + 1, place[-1], dtype=np.int32)
        of[: self.known] = place[: self.known]
        return of, counts[order], int(place[-2]), int(place[-1])


def vocabulary(counts: DataFrame, lookup: int = LOOKUP, model: int = MODEL) -> tuple[Vocabulary, int]:
    """The vocabulary of ``word_counts`` and the least count of its words; rarer ones stay in the table."""
    # A row for each octave's eighth, a few hundred at the most.
    step = F.floor(F.log2("n") * 8).cast("int")
    rows = counts.filter(F.col("word") != END).groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens"), F.min("n").alias("least")).collect()
    end = counts.filter(F.col("word") == END).agg(F.sum("n")).first()[0] or 0
    least, held = 1 << 62, 0
    for r in sorted(rows, key=lambda r: -r.step):
        if held + r.words > lookup:
            break
        least, held = r.least, held + r.words
    # At most ``lookup`` rows.
    top = counts.filter((F.col("n") >= least) & (F.col("word") != END)).toArrow()
    n = np.asarray(top["n"], dtype=np.int64)
    listed = top["word"].cast(pa.binary()).to_pylist()
    order = sorted(range(len(listed)), key=lambda i: (-n[i], listed[i]))
    total = sum(r.tokens for r in rows) + end
    distinct = sum(r.words for r in rows) + (end > 0)
    return Vocabulary([listed[i] for i in order], n[order], end, total, distinct, min(model, len(order))), least


def trained(net: recurrent.Network, texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> recurrent.Network:
    """``net`` after ``rounds`` of training on the ``encoded`` ``texts``, each in its round, a copy for each partition, averaged after each."""
    spark, end = texts.sparkSession, vocab.ids[2]
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value.filled(sent.value.flat())
            held = recurrent.fresh(own)
            seen, docs, size = 0, [], 0

            def step() -> None:
                recurrent.train(own, docs, end, held)

            for b in batches:
                for x in listed(b.column("ids")):
                    docs.append(x)
                    size += len(x)
                    if size >= TOKENS:
                        step()
                        seen, docs, size = seen + size, [], 0
            if docs:
                step()
                seen += size
            flat = own.flat().astype(np.float64) * seen
            blocks = range(0, len(flat) if seen else 0, BLOCK)
            for at in blocks:
                yield pa.record_batch({"block": pa.array([at // BLOCK], pa.int32()), "weights": pa.array([flat[at : at + BLOCK]], pa.list_(pa.float64())), "tokens": pa.array([seen], pa.int64())})

        def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            totals: dict[int, list] = {}
            for b in batches:
                for block, weights, tokens in zip(b["block"], b["weights"], b["tokens"], strict=True):
                    own = totals.setdefault(block, [np.zeros(len(weights)), 0])
                    own[0] += weights
                    own[1] += tokens
            if totals:
                yield pd.DataFrame({"block": list(totals), "weights": [w for w, _ in totals.values()], "tokens": [t for _, t in totals.values()]})

        kind = "block int, weights array<double>, tokens long"
        found = texts.filter(F.col("round") == k).select("ids").mapInArrow(run, kind).repartition("block").mapInPandas(summed, kind).collect()
        if found:
            blocks = sorted(found, key=lambda r: r.block)
            net = net.filled(np.concatenate([np.asarray(r.weights) / r.tokens for r in blocks]))
    return net


def listed(lists: pa.ListArray) -> list[np.ndarray]:
    """The numbers of each list; there are no nulls."""
    flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
    return np.split(flat, ends[:-1]) if len(ends) else []


def encoded(docs: DataFrame, vocab: Vocabulary, every: int = EVERY, rounds: int = ROUNDS) -> DataFrame:
    """What a task knows of each row before there is a network, kept: the network's ids, sums over the words in the vocabulary, and the others with how often they occur.

    ``round``: that in which it is trained on, or -1. Of the rows to learn from, one of ``every`` is; all of them if that is 1.
    """
    sent, most = docs.sparkSession.sparkContext.broadcast(vocab), BYTES
    kind = docs.schema["doc_id"].dataType.simpleString()
    pick = F.pmod(F.xxhash64("doc_id", "text"), F.lit(every * rounds))
    turn = F.when(learned(F.col("doc_id")) & (pick < rounds), pick).otherwise(-1).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = sent.value
        of, by_id, end, other = vocab.ids
        place = pa.array(vocab.words, pa.binary()).cast(pa.string())
        whole = np.log10(vocab.tokens + 0.5 * (vocab.distinct + 1))
        outside = np.log10(by_id[other] + 0.5 * (vocab.distinct - vocab.known - (vocab.end > 0) + 1))
        end_log = np.log10(vocab.end + 0.5)
        # By place, with that of no place, -1, at the end.
        logs = np.append(np.log10(vocab.counts + 0.5), 0.0)
        # Words that the network has no id of their own for share one.
        shares = logs - outside
        shares[: vocab.known] = 0.0

        def answer(part: pa.RecordBatch) -> pa.RecordBatch:
            (found, n), rows = word_lists(part.column("text")), len(part)
            at = pc.index_in(found, place).fill_null(-1).to_numpy()
            row = np.repeat(np.arange(rows), n)
            base, inside = (np.bincount(row, weights=by[at], minlength=rows) for by in (logs, shares))
            base += end_log - (n + 1) * whole
            ends = np.cumsum(n + 1)
            last = np.zeros(ends[-1], dtype=bool)
            last[ends - 1] = True
            ids = np.full(len(last), end, dtype=np.int32)
            ids[~last] = of[at]
            far = np.flatnonzero(at < 0)
            coded = found.take(pa.array(far)).dictionary_encode()
            each = max(1, len(coded.dictionary))
            held, times = np.unique(row[far] * each + coded.indices.to_numpy(), return_counts=True)
            starts = lambda ends: pa.array(np.append(0, ends), pa.int32())
            rare_ends = starts(np.cumsum(np.bincount(held // each, minlength=rows)))
            n_known = n - np.bincount(row[far], minlength=rows) + (vocab.end > 0)
            made = [pa.array(n + 1), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(inside, pa.float64()), pa.ListArray.from_arrays(starts(ends), pa.array(ids))]
            rare = [pa.ListArray.from_arrays(rare_ends, coded.dictionary.take(pa.array(held % each))), pa.ListArray.from_arrays(rare_ends, pa.array(times, pa.int64()))]
            given = [part.column(c) for c in ("row", "doc_id", "held_out", "round")]
            return pa.record_batch(given + made + rare, names=["row", "doc_id", "held_out", "round", "n_tokens", "n_known", "base", "inside", "ids", "rare", "times"])

        for b in batches:
            for part in pieces(b, most):
                yield answer(part)
        pa.default_memory_pool().release_unused()

    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    return stored(numbered.select("row", "doc_id", (~learned(F.col("doc_id"))).alias("held_out"), turn.alias("round"), "text").mapInArrow(run, ENCODED.format(id=kind)), "lm-rows")


def scored(texts: DataFrame, net: recurrent.Network, vocab: Vocabulary) -> DataFrame:
    """The rows of ``encoded`` with the network's ``score`` but for the ``others``, which are the words outside the vocabulary, with repeats."""
    sent, end, most = texts.sparkSession.sparkContext.broadcast(net), vocab.ids[2], TOKENS
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        ids: list[np.ndarray] = []
        size = 0

        def answer() -> Iterator[pa.RecordBatch]:
            model, at = recurrent.score(sent.value, ids, end) / np.log(10), 0
            for b in held:
                score = b.column("inside").to_numpy() + model[at : at + len(b)]
                at += len(b)
                columns = [b.column(n) for n in ("row", "doc_id", "held_out", "n_tokens", "n_known", "base")]
                yield pa.record_batch([*columns, pa.array(score), b.column("others")], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "others"])

        for whole in batches:
            ends = np.cumsum(whole.column("n_tokens").to_numpy())
            at = 0
            while at < len(whole):
                # Rows up to that many tokens with those that are held, one at least.
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most - size, side="right")))
                part = whole.slice(at, stop - at)
                held.append(part)
                ids.extend(listed(part.column("ids")))
                size += sum(map(len, ids[-len(part) :]))
                at = stop
                if size >= most or at < len(whole):
                    yield from answer()
                    held, ids, size = [], [], 0
        if held:
            yield from answer()

    others = F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x).alias("others")
    return texts.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "ids", others).mapInArrow(run, SCORED.format(id=kind))


def score_documents(docs: DataFrame, lookup: int = LOOKUP, model: int = MODEL, hidden: int = HIDDEN, every: int = EVERY, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of each row; logarithms to base 10."""
    if min(lookup, model, hidden, every, rounds) < 1:
        raise ValueError("lookup, model, hidden, every and rounds are 1 at least")
    rows = docs.select("doc_id", "text")
    learn = rows.filter(learned(F.col("doc_id")))
    counts = word_counts(learn)
    vocab, least = vocabulary(counts, lookup, model)
    total = F.lit(vocab.tokens).cast("long").alias("train_tokens")
    if not vocab.tokens:
        size = F.lit(1.0) * 0
        n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), 1)) + 1
        return rows.select("doc_id", (~learned(F.col("doc_id"))).alias("held_out"), n.cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), total, size.alias("base_score"), size.alias("score"))
    net = recurrent.Network.new(vocab.ids[1], hidden, SEED)
    texts = encoded(rows, vocab, every, rounds)
    net = trained(net, texts, vocab, rounds)
    found = scored(texts, net, vocab)
    # The words that no task knows: their counts are looked up by word, and their sums come back by row.
    rare = texts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    # Only those that the training rows have; the others' counts are 0.
    known = rare.join(counts.filter((F.col("n") < least) & (F.col("word") != END)), "word")
    none = float(np.log10(0.5))
    sums = known.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - none)).alias("logs"))
    out = found.join(sums, "row", "left")
    missed = F.col("others") * none + F.coalesce("logs", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), total, (F.col("base") + missed).alias("base_score"), (F.col("score") + missed).alias("score"))
