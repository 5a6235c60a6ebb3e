"""Operator 6: an interpolated modified Kneser-Ney model of bigrams or trigrams, counted and kept in shards.

Words and one end per text are tokens, with starts before them; the open
vocabulary has one more class for unknown tokens.  Nothing about the corpus is
gathered in one place:

1. Texts become chunks of about ``CHUNK_BYTES``: the sorted hashes of the words
   a chunk uses, and its tokens as indices into them.  The table is written in
   buckets by chunk, so that joining answers to it moves only the answers.
2. Each chunk asks the shard of each of its longest windows' hashes for the count
   in the training texts.  A shard merges the blocks it gets into one sorted hash array and
   searches it for every block's answer.  One chunk of those that hold a window is
   told that it owns it.
3. Owners turn their windows' counts into the statistics of windows shorter by a
   word (as context: tokens and numbers of followers seen once, twice and more; as
   end: the number of words before it), which the shards of those merge and answer
   in the same way, down to single words.
4. With all answers a chunk scores its own texts.

A shard is about ``SHARD`` windows, whatever the corpus, and its arrays are in the memory
of one task.  No file is memory-mapped: a map needs a path that each worker has
mounted, which the shared folder of a cluster needn't be.  With ``keep_model`` the
arrays are also stored as rows of a table.

Hashes have ``KEY_BITS`` bits; equal hashes are taken to be equal words.

Edge cases: null and empty texts have the end token only; with no training text
every token is unknown; repeated rows are each scored; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored, stored_in_buckets
from .textkit import U64, Chunk, as_bytes, chunks, fold, mix, table

CHUNK_BYTES = 6 << 20
KEY_BITS = 56
MASK = U64((1 << KEY_BITS) - 1)
START, END = U64(1), U64(2)
FOLLOW = U64(0x9E3779B97F4A7C15)
#: Bigrams of a shard, about.
SHARD = 1 << 20
PAIR_STATS = ("tokens", "ones", "twos", "more", "contexts")
STATS = (*PAIR_STATS, "count")


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T
    body = np.ascontiguousarray(planes).tobytes()
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    body = pa.decompress(data[9:], decompressed_size=width * n, codec="zstd", asbytes=True)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(U64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return packed(np.diff(keys, prepend=U64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=U64)


def make_chunks(docs: DataFrame) -> DataFrame:
    """Rows (chunk, ids, train, sizes, words, stream, pairs); ``docs`` has __id, __train and __text."""
    kind = docs.schema["__id"].dataType.simpleString()

    def run(batches):
        part = TaskContext.get().partitionId()
        for k, (batch, texts) in enumerate(gathered(batches)):
            c = Chunk(texts, lower=True)
            stream = np.insert(c.hash & MASK, c.first + c.count, END)
            words, index = np.unique(stream, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part}-{k}"]),
                    pa.array([batch.column("__id").to_pylist()], pa.list_(batch.schema.field("__id").type)),
                    pa.array([batch.column("__train").to_pylist()], pa.list_(pa.bool_())),
                    pa.array([packed(c.count + 1)], pa.binary()),
                    pa.array([packed_keys(words)], pa.binary()),
                    pa.array([packed(index)], pa.binary()),
                    pa.array([len(stream)], pa.int64()),
                ],
                ["chunk", "ids", "train", "sizes", "words", "stream", "tokens"],
            )

    return docs.mapInArrow(run, f"chunk string, ids array<{kind}>, train array<boolean>, sizes binary, words binary, stream binary, tokens long")


def gathered(batches):
    """Batches joined until they hold about CHUNK_BYTES of text."""
    held, size = [], 0
    for batch, texts in chunks(batches, "__text", CHUNK_BYTES):
        held.append((batch, texts))
        size += sum(map(len, texts))
        if size >= CHUNK_BYTES:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def joined(held):
    whole = pa.Table.from_batches([b for b, _ in held]).combine_chunks().to_batches()
    return whole[0], [x for _, t in held for x in t]


class Pairs:
    """The bigrams of a chunk row, in the order of their hashes."""

    def __init__(self, row: dict):
        self.words = unpacked_keys(row["words"])
        stream = unpacked(row["stream"]).astype(np.int64)
        self.sizes = unpacked(row["sizes"]).astype(np.int64)
        self.train = np.repeat(np.array(row["train"], bool), self.sizes)
        self.stream = stream
        n = len(self.words)
        before = np.empty_like(stream)
        before[1:] = stream[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = n  # n stands for the start
        self.names = np.append(self.words, START)
        code, self.where = np.unique(before * (n + 1) + stream, return_inverse=True)
        self.first, self.second = code // (n + 1), code % (n + 1)
        self.pair_names = mix(self.names[self.first] * FOLLOW + self.names[self.second]) & MASK
        self.order = np.argsort(self.pair_names)
        self.keys = self.pair_names[self.order]
        self.n = np.bincount(self.where[self.train], minlength=len(code))[self.order]


class Triples(Pairs):
    """The trigrams of a chunk row, in the order of their hashes, and its bigrams with the one of two starts (the last of ``pair_names``)."""

    def __init__(self, row: dict):
        super().__init__(row)
        n = len(self.pair_names)
        self.pair_names = np.append(self.pair_names, mix(np.array([START * FOLLOW + START])) & MASK)
        before = np.empty_like(self.where)
        before[1:] = self.where[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = n
        code, self.where3 = np.unique(before * n + self.where, return_inverse=True)
        self.context, self.tail = code // n, code % n
        keys = mix(self.pair_names[self.context] * FOLLOW + self.names[self.second[self.tail]]) & MASK
        self.pair_order, self.order = np.argsort(self.pair_names), np.argsort(keys)
        self.keys = keys[self.order]
        self.n = np.bincount(self.where3[self.train], minlength=len(code))[self.order]


GRAMS = {2: Pairs, 3: Triples}


def bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the parts of sorted keys for each shard begin and end; shards are equal ranges of hashes."""
    cuts = np.array([(i << KEY_BITS) // shards for i in range(1, shards)], U64)
    return np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])


def ask_grams(table_: DataFrame, shards: int, order: int) -> DataFrame:
    """Rows (shard, chunk, keys, values): the windows of ``order`` words of each chunk and their counts in its training texts."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                p = GRAMS[order](row)
                edge = bounds(p.keys, shards)
                some = np.flatnonzero(np.diff(edge))
                cut = [(edge[s], edge[s + 1]) for s in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int32()),
                        pa.array([row["chunk"]] * len(some)),
                        pa.array([packed_keys(p.keys[a:b]) for a, b in cut], pa.binary()),
                        pa.array([packed(p.n[a:b]) for a, b in cut], pa.binary()),
                    ],
                    ["shard", "chunk", "keys", "values"],
                )

    return table_.select("chunk", "train", "sizes", "words", "stream").mapInArrow(run, "shard int, chunk string, keys binary, values binary")


def answer(width: int, keep_model: bool):
    """Merges a shard's blocks into one sorted array and answers each block; rows (kind, shard, chunk, data, summary)."""

    def run(rows: pa.Table) -> pa.Table:
        chunk, shard = rows["chunk"].to_pylist(), rows["shard"][0].as_py()
        keys = [unpacked_keys(x) for x in rows["keys"].to_pylist()]
        values = [unpacked(x).reshape(-1, width) for x in rows["values"].to_pylist()]
        all_keys, all_values = np.concatenate(keys), np.concatenate(values)
        distinct, where = np.unique(all_keys, return_inverse=True)
        total = np.stack([np.bincount(where, all_values[:, i], len(distinct)) for i in range(width)], 1).astype(U64)
        out = []
        owner = np.zeros(len(all_keys), bool)
        counts = 0 if width == 1 else 4
        if width <= len(PAIR_STATS):
            has = np.flatnonzero(all_values[:, counts] > 0)
            owner[has[np.unique(where[has], return_index=True)[1]]] = True
        at = 0
        for name, k in zip(chunk, keys, strict=True):
            found = total[np.searchsorted(distinct, k)]
            if width <= len(PAIR_STATS):
                found[:, counts] = found[:, counts] * U64(2) + owner[at : at + len(k)].astype(U64)
            out.append(("answer", name, packed(found.T.reshape(-1))))
            at += len(k)
        known = total.any(axis=1) if width == len(PAIR_STATS) else total[:, 0 if width == 1 else -1] > 0
        out.append(("model", "", packed_keys(distinct[known]) if keep_model and known.any() else b""))
        if keep_model:
            out.append(("values", "", packed(total[known].reshape(-1))))
        c = total[:, counts]
        summary = [int((c == i).sum()) for i in (1, 2, 3, 4)] + [int(c.sum()), int(known.sum()), int(total[:, -1].sum())]
        return pa.table(
            {
                "kind": pa.array([x[0] for x in out]),
                "shard": pa.array([shard] * len(out), pa.int32()),
                "chunk": pa.array([x[1] for x in out]),
                "data": pa.array([x[2] for x in out], pa.binary()),
                "summary": pa.array([summary if x[0] == "model" else None for x in out], pa.list_(pa.int64())),
            }
        )

    return run


ANSWER = "kind string, shard int, chunk string, data binary, summary array<long>"


def statistics(first: np.ndarray, second: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """PAIR_STATS of n shorter windows from the counts of longer ones, which begin with ``first`` and end with ``second``."""
    stat = np.zeros((n, len(PAIR_STATS)), np.int64)
    stat[:, 0] = np.bincount(first, c, n)
    stat[:, 1], stat[:, 2], stat[:, 3] = (np.bincount(first[x], minlength=n) for x in (c == 1, c == 2, c > 2))
    stat[:, 4] = np.bincount(second, minlength=n)
    return stat


def pair_answers(p: Pairs, rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Count of each bigram (with trigrams, of the words before it), whether the chunk owns it, and with trigrams the statistics of bigrams as contexts."""
    n = len(p.first)
    if not isinstance(p, Triples):
        got = np.empty(n, U64)
        got[p.order] = unpacked_parts(rows, "pair", 1)[:, 0]
        return got >> U64(1), (got & U64(1)) > 0, None
    stat = np.empty((n + 1, len(PAIR_STATS)), U64)
    stat[p.pair_order] = unpacked_parts(rows, "pair", len(PAIR_STATS))
    return stat[:n, 4] >> U64(1), (stat[:n, 4] & U64(1)) > 0, stat


def ask_shorter(shards: int, order: int, level: int):
    """From a chunk and the answers to its windows of ``level`` + 1 words: what those it owns say about its windows of ``level`` words, a block per shard."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"shard": [], "chunk": [], "keys": [], "values": []}
        answers = by_chunk(right)
        for row in left.to_pylist():
            p = GRAMS[order](row)
            if level == 2:
                got = unpacked_parts(answers[row["chunk"]], "triple", 1)[:, 0]
                owned = p.order[(got & U64(1)) > 0]
                stat = statistics(p.context[owned], p.tail[owned], (got >> U64(1))[(got & U64(1)) > 0], len(p.pair_names))
                keys, stat = p.pair_names[p.pair_order], stat[p.pair_order]
            else:
                count, owned, _ = pair_answers(p, answers[row["chunk"]])
                n = len(p.names)
                stat = np.zeros((n, len(STATS)), np.int64)
                stat[:, :5] = statistics(p.first[owned], p.second[owned], count[owned], n)
                stat[: n - 1, 5] = np.bincount(p.stream[p.train], minlength=n - 1)
                by_key = np.argsort(p.names)
                keys, stat = p.names[by_key], stat[by_key]
            edge = bounds(keys, shards)
            for s in np.flatnonzero(np.diff(edge)):
                a, b = edge[s], edge[s + 1]
                out["shard"].append(int(s))
                out["chunk"].append(row["chunk"])
                out["keys"].append(packed_keys(keys[a:b]))
                out["values"].append(packed(stat[a:b].reshape(-1)))
        return pa.table({"shard": pa.array(out["shard"], pa.int32()), "chunk": pa.array(out["chunk"], pa.string()), "keys": pa.array(out["keys"], pa.binary()), "values": pa.array(out["values"], pa.binary())})

    return run


def by_chunk(answers: pa.Table) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for row in answers.to_pylist():
        out.setdefault(row["chunk"], []).append(row)
    return out


def unpacked_parts(rows: list[dict], level: str, width: int) -> np.ndarray:
    """The answers of one level, in the order of the keys asked for."""
    parts = sorted((r["shard"], r["data"]) for r in rows if r["level"] == level)
    return np.concatenate([unpacked(d).reshape(width, -1).T for _, d in parts])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the numbers of counts 1 to 4."""
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    clip = lambda x, most: min(max(x, 0.05), most)
    return clip(1 - 2 * y * n2 / n1, 0.95), clip(2 - 3 * y * n3 / n2, 1.95), clip(3 - 4 * y * n4 / max(n3, 1), 2.95)


def interpolated(count: np.ndarray, context: np.ndarray, d: tuple, shorter: np.ndarray) -> np.ndarray:
    """Probabilities of windows from their counts, their contexts' PAIR_STATS and the probabilities under the shorter context."""
    seen = context[:, 0] > 0
    total = np.where(seen, context[:, 0], 1.0)
    gamma = np.where(seen, (context[:, 1] * d[0] + context[:, 2] * d[1] + context[:, 3] * d[2]) / total, 1.0)
    less = np.select([count >= 3, count == 2, count == 1], [d[2], d[1], d[0]], 0.0)
    return np.where(seen, (count - less) / total, 0.0) + gamma * shorter


def score_chunk(order: int, d3: tuple, d2: tuple, d1: tuple, tokens: int, vocabulary: int, contexts: int, unigrams: tuple):
    """Scores the documents of chunks; rows of (id, train, n_tokens, n_known, base_score, score)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = by_chunk(right)
        columns: list[list] = [[], [], [], [], [], []]
        for row in left.to_pylist():
            p = GRAMS[order](row)
            own = answers[row["chunk"]]
            count, _, contexts2 = pair_answers(p, own)
            stat = np.empty((len(p.names), len(STATS)))
            stat[np.argsort(p.names)] = unpacked_parts(own, "word", len(STATS))
            # unigrams: continuation counts, discounted and interpolated with the uniform distribution
            k = stat[:, 4]
            less = np.select([k >= 3, k == 2, k == 1], [d1[2], d1[1], d1[0]], 0.0)
            uniform = 1.0 / (vocabulary + 1)
            free = (d1[0] * unigrams[0] + d1[1] * unigrams[1] + d1[2] * unigrams[2]) / contexts if contexts else 1.0
            one = (k - less) / max(contexts, 1) + free * uniform
            prob = interpolated(count.astype(float), stat[p.first], d2, one[p.second])
            where = p.where
            if order == 3:
                count = np.empty(len(p.keys))
                count[p.order] = unpacked_parts(own, "triple", 1)[:, 0] >> U64(1)
                prob = interpolated(count, contexts2[p.context].astype(float), d3, prob[p.tail])
                where = p.where3
            logs = np.log10(prob)[where]
            c = stat[:-1, 5]
            base = np.log10((c + 0.1) / (tokens + 0.1 * (vocabulary + 1)))[p.stream]
            start = np.cumsum(p.sizes) - p.sizes
            columns[0] += row["ids"]
            columns[1] += row["train"]
            columns[2] += p.sizes.tolist()
            columns[3] += np.add.reduceat((c > 0)[p.stream].astype(np.int64), start).tolist()
            columns[4] += np.add.reduceat(base, start).tolist()
            columns[5] += np.add.reduceat(logs, start).tolist()
        return pa.table(
            [pa.array(columns[0], left.schema.field("ids").type.value_type), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.float64()), pa.array(columns[5], pa.float64())],
            names=["id", "train", "n_tokens", "n_known", "base_score", "score"],
        )

    return run


def score(docs: DataFrame, train, text: str = "text", id_col: str = "doc_id", order: int = 2, keep_model: bool = True) -> tuple[DataFrame, DataFrame]:
    """Scores of all documents under the model of order 2 or 3 of those where ``train`` holds, and the model.

    The scores have id, train, n_tokens, n_known, train_tokens, base_score and
    score (log10 probabilities of the text); the model's rows are the sorted
    hash arrays of trigrams, bigrams and words, a few per shard (empty arrays
    without ``keep_model``; the scores don't read them).
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.col(id_col).alias("__id"), F.coalesce(train, F.lit(False)).alias("__train"), as_bytes(text).alias("__text"))
    held = stored_in_buckets(make_chunks(given), "chunks", parts, "chunk")
    asked = held.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shards = max(16, parts, -(-asked // SHARD))
    if order not in GRAMS:
        raise ValueError("the order is 2 or 3")
    block = "shard int, chunk string, keys binary, values binary"
    level = lambda df, name: df.where("kind = 'answer'").select("chunk", "shard", "data", F.lit(name).alias("level"))
    body = held.select("chunk", "ids", "train", "sizes", "words", "stream")
    levels = {}
    for n, name, width in [(3, "triple", 1), (2, "pair", 1 if order == 2 else len(PAIR_STATS)), (1, "word", len(STATS))][3 - order :]:
        if n == order:
            blocks = ask_grams(held, shards, order)
        else:
            blocks = body.drop("ids").groupBy("chunk").cogroup(level(*longer).groupBy("chunk")).applyInArrow(ask_shorter(shards, order, n), block)
        levels[name] = stored(blocks.groupBy("shard").applyInArrow(answer(width, keep_model), ANSWER), f"{name}s")
        longer = levels[name], name
    pairs, words = levels["pair"], levels["word"]
    total = lambda df: [int(x or 0) for x in df.where("kind = 'model'").agg(*[F.sum(F.col("summary")[i]) for i in range(7)]).first()]
    two, one = total(pairs), total(words)
    tokens, vocabulary, contexts = one[6], one[5], one[4]
    more = max(0, counted(words) - one[0] - one[1])
    d3 = discounts(*total(levels["triple"])[:4]) if order == 3 else ()
    scorer = score_chunk(order, d3, discounts(*two[:4]), discounts(*one[:4]), tokens, vocabulary, contexts, (one[0], one[1], more))
    answers = reduce(DataFrame.unionByName, [level(df, name) for name, df in levels.items()])
    kind = docs.schema[id_col].dataType.simpleString()
    scored = body.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scorer, f"id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    model = reduce(DataFrame.unionByName, levels.values()).where("kind != 'answer'")
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long")), model


def counted(words: DataFrame) -> int:
    """Words that follow some context in training: all known ones."""
    return int(words.where("kind = 'model'").agg(F.sum(F.col("summary")[5])).first()[0] or 0)


def perplexity(scored: DataFrame) -> DataFrame:
    """Adds the perplexity per token."""
    return scored.withColumn("perplexity", F.exp(-F.col("score") * log(10) / F.col("n_tokens")))


def op6_lm_scores(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored, _ = score(docs, fold("doc_id", 10) != 0, order=3, keep_model=False)
    gain = (F.col("score") - F.col("base_score")) / F.col("n_tokens")
    out = perplexity(scored).withColumn("gain_per_token", gain)
    return out.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity", "gain_per_token")
