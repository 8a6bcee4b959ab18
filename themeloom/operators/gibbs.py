"""Latent topics of bags of words by Gibbs sampling: every sweep takes every token once.

A token's topic is redrawn by two Metropolis-Hastings proposals, a topic of its doc and one of its word, so a step's cost doesn't grow with the number of topics; counts leave the token itself out. The
priors of a doc's topics and of a topic's words are 1 / topics, the defaults of the library's LDA.

The tokens lie in blocks of whole docs. Within a block docs are sampled side by side, the tokens of a doc one after the other. A single block is one task's work from the first sweep to the last.
Several blocks sample side by side, as the threads of a sampler on one machine do, each on its own counts as they are and on the others' as they were when the round of sweeps began. Between rounds the
counts are added up by ranges of words, through files in the shared folder, and a block gets those of its own words only; the driver holds none.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, materialise, ship

BLOCK, GROUP = 1_000_000, 8192  # tokens of a block and docs of a group, about
EARLY, ROUND = 50, 5  # blocks exchange counts after each of the early sweeps, while topics form, then once in a round
_ONE = {"i": np.int32(1), "h": np.int16(1)}


class Block:
    """Docs and the topics of their tokens. The docs lie in groups, by falling length in each. Of a group, the tokens are ordered by their position in the doc, so the tokens at a position are a slice, and
    token p of the group's doc d lies at ``off[p] + d``."""

    def __init__(self, lengths: np.ndarray, words: np.ndarray, topics: int, vocabulary: int, seed: list[int]):
        self.k, self.vocabulary, self.seed = topics, vocabulary, seed
        rng = np.random.default_rng([*seed, 0])
        self.names, words = np.unique(words, return_inverse=True)
        n, starts = len(words), np.cumsum(lengths) - lengths
        words = words[np.lexsort((rng.random(n), np.repeat(starts, lengths)))]  # a doc's tokens in any order
        self.word, self.row, self.doc, self.pos = (np.empty(n, np.int64) for _ in range(4))
        self.rest = np.empty(n, np.int32)
        self.slices, self.off, base = [], [], 0
        for low in range(0, len(lengths), GROUP):
            docs = low + np.argsort(-lengths[low : low + GROUP], kind="stable")
            size = lengths[docs]
            count, m = np.repeat(size, size), int(size.sum())
            pos = np.arange(m) - np.repeat(np.cumsum(size) - size, size)
            at = np.cumsum(np.bincount(pos))
            off = base + np.concatenate([[0], at[:-1]])
            doc = np.repeat(np.arange(len(docs)), size)
            place = off[pos] + doc
            self.word[place], self.doc[place], self.pos[place], self.rest[place] = words[np.repeat(starts[docs], size) + pos], doc, pos, count - 1
            cut = 0
            for end in at.tolist():
                if end - cut >= m // 64 or end == m:  # long docs have several tokens in a slice
                    self.slices.append((base + cut, base + end, len(self.off)))
                    cut = end
            self.off.append(off)
            base += m
        self.row = self.word * topics
        size = np.bincount(self.word)
        self.first, self.others = (np.cumsum(size) - size)[self.word], size[self.word] - 1
        self.by_word = np.empty(n, np.int64)  # a token's place where they lie word by word
        self.by_word[np.argsort(self.word, kind="stable")] = np.arange(n)
        self.topic = rng.integers(0, topics, n).astype(np.int16 if topics < 1 << 15 else np.int32)

    def counted(self) -> np.ndarray:
        """By word and topic."""
        return np.bincount(self.row + self.topic, minlength=len(self.names) * self.k).astype(np.int32)

    def sample(self, sweeps: range, total: np.ndarray | None = None, sums: np.ndarray | None = None) -> np.ndarray:
        """The given sweeps, and `counted` after them. With several blocks, `total` has the counts of its words over all of them and is changed, `sums` those of all words by topic."""
        k, prior, z = self.k, 1 / self.k, self.topic
        of_word = np.empty_like(z)  # the topics once more, word by word
        of_word[self.by_word] = z
        local = self.counted()
        several, total = total is not None, local if total is None else total
        of_topic = (np.bincount(z, minlength=k) if sums is None else sums) + self.vocabulary * prior

        def drawn(others: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Which of the `others` tokens gives its topic; all priors together weigh as much as one token, and where they are drawn none does. What the draw leaves over is another draw."""
            u = rng.random(len(others))
            u *= others + 1
            r = u.astype(np.int64)
            u -= r
            none = np.flatnonzero(r == others)
            r += r >= own
            r[none] = 0
            return r, none, u

        for sweep in sweeps:
            rng = np.random.default_rng([*self.seed, sweep + 1])
            group = -1
            for a, b, g in self.slices:
                if g != group:
                    group, off = g, self.off[g]
                    low, high = off[0], self.off[g + 1][0] if g + 1 < len(self.off) else len(z)
                    cells = (int(self.doc[low:high].max()) + 1) * k
                    of_doc = np.bincount(self.doc[low:high] * k + z[low:high], minlength=cells).astype(np.int16 if self.rest[low:high].max() < 32767 else np.int32)
                old = z[a:b].copy()
                row, doc = self.row[a:b], self.doc[a:b]
                r, none, u = drawn(self.rest[a:b], self.pos[a:b])
                r = off[r]
                r += doc
                to = z[r]
                to[none] = rng.integers(0, k, len(none))
                i = np.flatnonzero(to != old)
                t, o = to[i].astype(np.int64), old[i].astype(np.int64)
                w = row[i]
                up = (total[w + t] + prior) * (of_topic[o] - 1)
                down = (total[w + o] + (prior - 1)) * of_topic[t]
                down *= u[i]
                yes = np.flatnonzero(down < up)
                new = old.copy()
                new[i[yes]] = t[yes]

                first = self.first[a:b]
                r, none, u = drawn(self.others[a:b], self.by_word[a:b] - first)
                r += first
                to = of_word[r]
                to[none] = rng.integers(0, k, len(none))
                i = np.flatnonzero(to != new)
                t, n, o = to[i].astype(np.int64), new[i].astype(np.int64), old[i].astype(np.int64)
                d, self_t, self_n = doc[i] * k, t == o, n == o
                up = (of_doc[d + t] + (prior - self_t)) * (of_topic[n] - self_n)
                down = (of_doc[d + n] + (prior - self_n)) * (of_topic[t] - self_t)
                if several:  # the proposal knows the block's tokens only
                    w = row[i]
                    up *= (total[w + t] + (prior - self_t)) * (local[w + n] + (prior - self_n))
                    down *= (total[w + n] + (prior - self_n)) * (local[w + t] + (prior - self_t))
                down *= u[i]
                yes = np.flatnonzero(down < up)
                new[i[yes]] = t[yes]
                z[a:b] = new

                i = np.flatnonzero(new != old)
                o, n, w, d = old[i].astype(np.int64), new[i].astype(np.int64), row[i], doc[i] * k
                of_word[self.by_word[a:b][i]] = n
                for counts, of in ((total, w), (local, w), (of_doc, d)) if several else ((total, w), (of_doc, d)):
                    np.subtract.at(counts, of + o, _ONE[counts.dtype.char])
                    np.add.at(counts, of + n, _ONE[counts.dtype.char])
                of_topic += np.bincount(n, minlength=k) - np.bincount(o, minlength=k)
        return local


def _block(batches: Iterator[pa.RecordBatch], topics: int, vocabulary: int, seed: list[int]) -> Block | None:
    """A block of all rows ``(words, counts)``."""
    words, lengths = [], []
    for batch in batches:
        size = batch.column(0).value_lengths().to_numpy()
        n = batch.column(1).flatten().to_numpy().astype(np.int64)
        words.append(np.repeat(batch.column(0).flatten().to_numpy(), n))
        lengths.append(np.bincount(np.repeat(np.arange(len(size)), size), weights=n, minlength=len(size)).astype(np.int64))
    lengths = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
    return Block(lengths[lengths > 0], np.concatenate(words), topics, vocabulary, seed) if lengths.any() else None


def _rows(words: np.ndarray, counts: np.ndarray, k: int) -> pa.RecordBatch:
    at = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(words[at // k].astype(np.int32)), pa.array((at % k).astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["word", "topic", "n"])


def _save(folder: str, name: str, value: object) -> None:
    """A file is there as a whole or not at all; a task that runs again writes the same."""
    files, path = fs.FileSystem.from_uri(folder)
    part = f"{path}/{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(pickle.dumps(value, protocol=5))
    files.move(part, f"{path}/{name}")


def _load(folder: str, name: str):
    files, path = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{path}/{name}") as source:
        return pickle.loads(source.read())


def topic_counts(bags: DataFrame, vocabulary: int, topics: int, sweeps: int, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """``(word, topic, n)``: how many tokens of each word are in each topic after the sweeps, no row where none is.

    `bags(words array<int>, counts)` has a row a doc, words below `vocabulary`. `bags` should be materialised.
    """
    spark = bags.sparkSession
    ship(spark)
    schema = "word int, topic int, n bigint"
    tokens = bags.agg(F.sum(F.aggregate("counts", F.lit(0.0), lambda s, x: s + x))).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    parts = 1 if tokens <= block else cores * -(-int(tokens) // (cores * block))
    rows = bags.select("words", "counts")

    if parts == 1:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if b := _block(batches, topics, vocabulary, [seed, 0]):
                yield _rows(b.names, b.sample(range(sweeps)), topics)

        return materialise(rows.coalesce(1).mapInArrow(whole, schema))

    folder = f"{checkpoint_dir(spark)}/gibbs-{uuid.uuid4().hex}"
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path)

    def send(at: str, number: int, b: Block, counts: np.ndarray) -> None:
        """A block's words and counts, to the tasks that add them up by ranges."""
        for r in range(parts):
            mine = b.names % parts == r
            own = counts.reshape(-1, topics)[mine].ravel()
            cells = np.flatnonzero(own)
            _save(at, f"from-{number}-to-{r}", (b.names[mine] // parts, cells, own[cells]))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        if b := _block(batches, topics, vocabulary, [seed, number]):
            _save(f"{folder}/blocks", str(number), b)
            _save(f"{folder}/0", f"topics-{number}", b.topic)
            send(f"{folder}/0", number, b, b.counted())
            yield pa.RecordBatch.from_arrays([pa.array([number])], names=["block"])

    def added(at: str, r: int, numbers: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
        total, known = np.zeros((-(-vocabulary // parts), topics), np.int32), []
        for number in numbers:
            words, cells, n = _load(at, f"from-{number}-to-{r}")
            total.ravel()[words[cells // topics] * topics + cells % topics] += n  # each once
            known.append(words)
        return total, known

    def each(numbers: list[int], work: Callable[[int], Iterator[pa.RecordBatch]], schema: str = "done int") -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    yield from work(numbers[i])

        return spark.range(0, len(numbers), 1, len(numbers)).mapInArrow(run, schema)

    for name in ("blocks", "0"):
        files.create_dir(f"{path}/{name}")
    numbers = sorted(r.block for r in rows.repartition(parts).mapInArrow(begin, "block bigint").collect())
    starts = [*range(min(EARLY, sweeps)), *range(EARLY, sweeps, ROUND), sweeps]
    for low, high in zip(starts, starts[1:]):
        now, after = f"{folder}/{low}", f"{folder}/{high}"
        files.create_dir(f"{path}/{high}")

        def add(r: int) -> Iterator[pa.RecordBatch]:
            total, known = added(now, r, numbers)
            _save(now, f"sums-{r}", total.sum(axis=0, dtype=np.int64))
            for number, words in zip(numbers, known):
                own = total[words].ravel()
                cells = np.flatnonzero(own)
                _save(now, f"for-{number}-by-{r}", (cells, own[cells]))
            yield from ()

        def sweep(number: int) -> Iterator[pa.RecordBatch]:
            b = _load(f"{folder}/blocks", str(number))
            b.topic = _load(now, f"topics-{number}")
            total = np.zeros((len(b.names), topics), np.int32)
            for r in range(parts):
                cells, n = _load(now, f"for-{number}-by-{r}")
                total.ravel()[np.flatnonzero(b.names % parts == r)[cells // topics] * topics + cells % topics] = n
            counts = b.sample(range(low, high), total.ravel(), sum(_load(now, f"sums-{r}") for r in range(parts)))
            _save(after, f"topics-{number}", b.topic)
            send(after, number, b, counts)
            yield from ()

        each(list(range(parts)), add).collect()
        each(numbers, sweep).collect()
        files.delete_dir(f"{path}/{low}")

    def rest(r: int) -> Iterator[pa.RecordBatch]:
        total, _ = added(f"{folder}/{sweeps}", r, numbers)
        yield _rows(np.arange(len(total)) * parts + r, total.ravel(), topics)

    found = materialise(each(list(range(parts)), rest, schema))
    files.delete_dir(path)
    return found


def words(counts: DataFrame, vocabulary: int, topics: int, n: int) -> DataFrame:
    """``(topic, place, i, score)``: the `n` words of the largest probability in each topic, ties by the lower number; words that a topic has no token of have their prior's."""
    spark = counts.sparkSession
    prior = 1 / topics
    none = spark.range(topics).crossJoin(spark.range(min(n, vocabulary)).withColumnRenamed("id", "i")).select(F.col("id").cast("int").alias("topic"), F.col("i").cast("int").alias("i"), F.lit(0).cast("bigint").alias("n"))
    all_ = counts.select("topic", F.col("word").alias("i"), "n").unionAll(none).groupBy("topic", "i").agg(F.max("n").alias("n"))
    sums = counts.groupBy("topic").agg(F.sum("n").alias("sum"))  # a row per topic
    top = all_.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "i"))).where(F.col("place") <= n)
    score = (F.col("n") + prior) / (F.coalesce("sum", F.lit(0)) + prior * vocabulary)
    return top.join(sums, "topic", "left").select("topic", "place", "i", score.alias("score"))
