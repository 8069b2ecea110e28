"""Periodic runs of words by an online sparse diagonal DP.

Every word looks at its earlier occurrences; the distance to one is a lag, and a lag that also held at the word before
goes on: its match length grows by one, a diagonal of the matrix of equal words.  A diagonal that ends after enough
words is a run and is emitted at once.

Only occurrences that can belong to a run's smallest period count.  In a run of smallest period q that is at least 2 q
long behind some word, the b words that begin there (b the power of two with b/2 < q <= b) were last seen exactly q words
before, because the q words of a period are equal to none of their own rotations.  So with the numbers of all blocks of
b words, made by doubling from those of b/2, each word has at most one lag in (b/2, b]: at most one active diagonal per
power of two instead of one per equal word, n log n steps for a text of n words, also where all words are equal.
Conversely a diagonal of such lags has no smaller period, else the block would have been seen later.  Blocks seen once are
left out of all longer ones, so a text without repeats ends after two or three doublings.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORTEST = 6
EXPONENT = 4
TOGETHER = 200_000  # words whose texts share the array operations; a longer text is on its own
RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def find_runs(numbers: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, periods) of all runs in a list of word numbers, sorted by start, then period.

    ``exponent`` is at least 4: shorter runs need not hold a block twice.  Lists that share no number can stand one after
    the other, no run crosses from one to the next.
    """
    if exponent < 4:
        raise ValueError("exponent must be at least 4")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, name, block, dense = np.arange(len(numbers)), np.asarray(numbers, np.int64), 1, np.empty(len(numbers), np.int64)
    while len(at):
        order = np.argsort(name, kind="stable")  # equal blocks together, by position
        again = np.concatenate([[False], name[order[1:]] == name[order[:-1]]])
        lag = np.zeros(len(at), np.int64)
        lag[order[1:]] = np.where(again[1:], at[order[1:]] - at[order[:-1]], 0)
        active = np.nonzero((lag > block // 2) & (lag <= block))[0]
        if len(active):
            word, step = at[active], lag[active]
            first = np.nonzero(np.concatenate([[True], (word[1:] != word[:-1] + 1) | (step[1:] != step[:-1])]))[0]
            last = np.append(first[1:], len(word)) - 1
            matched, period = word[last] - word[first] + block, step[first]  # the diagonal's match length, in words
            long = matched + period >= np.maximum(shortest, exponent * period)
            found.append((word[first][long] - period[long], matched[long] + period[long], period[long]))
        twice = np.zeros(len(at), bool)
        twice[order] = again | np.append(again[1:], False)
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(~again)
        dense.fill(-1)
        dense[at[twice]] = number[twice]
        at = at[twice]
        at = at[at + block < len(numbers)]
        after = dense[at + block]
        at, after = at[after >= 0], after[after >= 0]
        name = dense[at] * (len(numbers) + 1) + after
        block *= 2
    starts, lengths, periods = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((),) * 3))
    order = np.lexsort((periods, starts))
    return starts[order], lengths[order], periods[order]


def _texts(column: pa.Array) -> Iterator[list[list[bytes]]]:
    """Lists of texts as words, about ``TOGETHER`` words a list.  bytes.split() parts at exactly the six white-space bytes."""
    texts, words = [], 0
    for text in column:
        texts.append((text.as_py() or b"").split())
        words += len(texts[-1])
        if words >= TOGETHER:
            yield texts
            texts, words = [], 0
    yield texts


def _judge(texts: list[list[bytes]], shortest: int, exponent: int) -> Iterator[tuple[list, bytes]]:
    """(runs, collapsed text) of each text."""
    known: dict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    sizes = np.array([len(t) for t in texts], np.int64)
    numbers = np.fromiter((k for t in texts for k in map(known.__getitem__, t)), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts, lengths, periods = find_runs(owner * (len(known) + 1) + numbers, shortest, exponent)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    border = np.searchsorted(starts, begin)
    for t, words in enumerate(texts):
        mine = slice(border[t], border[t + 1])
        if mine.start == mine.stop:
            yield [], b" ".join(words)
            continue
        runs = list(zip((starts[mine] - begin[t]).tolist(), lengths[mine].tolist(), periods[mine].tolist()))
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        keep = np.cumsum(edge[:-1]) == 0
        yield [{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join([w for w, k in zip(words, keep) if k])


def periodic_runs(
    docs: DataFrame, shortest: int = SHORTEST, exponent: int = EXPONENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): one row per row of docs, in one pass without a shuffle.

    Words are what stands between the six ASCII white-space characters, numbered from 0.  ``runs`` holds every maximal
    stretch of smallest period q and at least max(shortest, exponent * q) words, by start, then period.  ``collapsed`` is
    the words joined by one space without those that a run holds after its first q.  A null or empty text, or one of white
    space only, has no words, no runs and an empty collapsed text.  Repeated rows stay repeated; ids may be null; other
    columns are not read.  A word is compared byte by byte.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            done = 0
            for texts in _texts(batch.column("text")):
                judged = list(_judge(texts, shortest, exponent))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(done, len(texts)), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([r for r, _ in judged], run_type), pa.array([c for _, c in judged], pa.binary()),
                ], ["doc_id", "n_words", "runs", "collapsed"])
                done += len(texts)

    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUN}, collapsed binary").withColumn(
        "collapsed", F.col("collapsed").cast("string"))


def loop_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of about every tenth document the words from some word on are replaced by a repeating period.

    With h the crc32 of the decimal id and g = floor(h / 10), documents with h % 10 = 0 and n > 0 words repeat, from word
    a = g % n on, the p = 1 + floor((n - a) / (3 + g % 8)) words that stand there.  A row with a null id stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    counted = docs.select("doc_id", "text", F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("w"), F.floor(h / 10).alias("g"))
    placed = counted.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    tail = F.col("n") - F.col("a")
    loops = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, p), F.ceil(tail / p).cast("int")))
    words = F.concat(F.slice("w", 1, F.col("a")), F.slice(loops, 1, tail))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))
