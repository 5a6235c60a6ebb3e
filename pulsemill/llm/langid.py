"""Operator 5: language identification by character language models.

One interpolated Kneser-Ney model of order 4 over letters and word gaps is
learned per language.  The counting runs in Spark; the resulting tables are
kept as sorted 64-bit hash arrays with one log probability per language.  A text
gets the language with the lowest cross-entropy per character.  A text whose
cross-entropy lies above a limit calibrated on texts of that language left out of
learning (each fifth one) is marked ``rejected``, and its score falls with the
excess.

Learning takes at most about ``max_docs`` labelled documents a language, by a hash
of the id (a documented bound); all their windows count, and every document is
predicted.

Edge cases: null text, or a text without any letter, gives ``und`` with score 0
and is rejected; without any labelled document every text is ``und``.  Ties go
to the first language in alphabetical order.  Repeated rows are each predicted.
Extra columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import CHUNK, U64, HashArray, as_bytes, chunks, fold, mix, table

ORDER = 4
GAP = 32
#: Cross-entropy that all models give to an unseen character.
FLOOR = 1.0 / (1 << 16)
#: Keeps the hashes of windows of different lengths apart.
OFFSET = [U64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(ORDER + 1)]

_tables: list[np.ndarray] = []


def alphabet() -> np.ndarray:
    """For each code point: its lower-case letter folded to 16 bits, or GAP."""
    if not _tables:
        out = np.full(0x110000, GAP, np.uint32)
        for i in np.flatnonzero(np.strings.isalpha(np.arange(0x110000, dtype=np.uint32).view("U1"))):
            low = chr(i).lower()
            j = ord(low) if len(low) == 1 else i
            out[i] = j if j < 0x10000 else 0x8000 | (j & 0x7FFF)
        _tables.append(out)
    return _tables[0]


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the texts with single gaps around words; start of each text, and its letters."""
    joined = "\n\n\n".join(x.decode("utf-8", "replace") for x in texts)
    sizes = np.fromiter((len(x.decode("utf-8", "replace")) for x in texts), np.int64, len(texts))
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.concatenate([[0], np.cumsum(sizes + 3)[:-1]])
    code = alphabet()[points]
    letter = code != GAP
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    before = np.concatenate([[0], np.cumsum(keep)])
    total = np.concatenate([[0], np.cumsum(letter)])
    return code[keep], before[start], total[start + sizes] - total[start]


def grams(code: np.ndarray) -> np.ndarray:
    """Packed windows of ORDER symbols that end at each symbol; gaps stand before the first."""
    padded = np.concatenate([np.full(ORDER - 1, GAP, U64), code.astype(U64)])
    out = np.zeros(len(code), U64)
    for i in range(ORDER):
        out = (out << U64(16)) | padded[i : i + len(code)]
    return out


def count_grams(batches):
    """Rows (lang, gram, n) for the windows of each language in the batches."""
    for batch, texts in chunks(batches, "__text", CHUNK):
        langs = np.array([x or "" for x in batch.column("__lang").to_pylist()], object)
        for lang in dict.fromkeys(langs):
            code, _, _ = symbols([t for t, own in zip(texts, langs, strict=True) if own == lang])
            gram, n = np.unique(grams(code), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
            )


class Model:
    """Per order k a HashArray of interpolated log probabilities, and one of back-off weights for contexts of k symbols."""

    def __init__(self, langs: list[str], per_lang: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        orders = [[self._counts(gram, n, k) for gram, n in per_lang] for k in range(1, ORDER + 1)]
        self.prob: list[HashArray] = []
        self.weight: list[HashArray] = []
        lower = None
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([g for g, _ in orders[k - 1]]))
            contexts = np.unique(keys >> U64(16))
            prob = np.empty((len(keys), len(langs)), np.float64)
            weight = np.ones((len(contexts), len(langs)), np.float64)
            base = self._lower(lower, keys, k)
            at = np.searchsorted(contexts, keys >> U64(16))
            for j, (gram, n) in enumerate(orders[k - 1]):
                n1, n2 = (n == 1).sum(), (n == 2).sum()
                discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
                own = np.searchsorted(contexts, gram >> U64(16))
                total = np.bincount(own, n, len(contexts))
                types = np.bincount(own, minlength=len(contexts))
                seen = total > 0
                weight[seen, j] = discount * types[seen] / total[seen]
                count = np.zeros(len(keys))
                count[np.searchsorted(keys, gram)] = n
                main = np.zeros(len(keys))
                has = seen[at]
                main[has] = np.maximum(count[has] - discount, 0) / total[at[has]]
                prob[:, j] = main + weight[at, j] * base[:, j]
            lower = (keys, prob, contexts, weight)
            self.prob.append(self._hashed(keys, np.log(prob), k))
            self.weight.append(self._hashed(contexts, np.log(weight), k - 1))

    @staticmethod
    def _counts(gram: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts at the highest order; below it, the number of distinct symbols seen before a suffix."""
        if k == ORDER:
            return gram, n
        longer = np.unique(gram & U64((1 << (16 * (k + 1))) - 1))
        return np.unique(longer & U64((1 << (16 * k)) - 1), return_counts=True)

    def _lower(self, lower, keys: np.ndarray, k: int) -> np.ndarray:
        """Probability of each key's suffix one symbol shorter; every suffix of a key is a key of that order."""
        if lower is None:
            return np.full((len(keys), len(self.langs)), FLOOR)
        short, prob, _, _ = lower
        return prob[np.searchsorted(short, keys & U64((1 << (16 * (k - 1))) - 1))]

    @staticmethod
    def _hashed(keys: np.ndarray, values: np.ndarray, k: int) -> HashArray:
        hashed = mix(keys + OFFSET[k])
        order = np.argsort(hashed)
        return HashArray(hashed[order], values[order].astype(np.float32))

    @staticmethod
    def _query(packed: np.ndarray, k: int) -> np.ndarray:
        return mix((packed & U64((1 << (16 * k)) - 1)) + OFFSET[k])

    def log_prob(self, gram: np.ndarray) -> np.ndarray:
        """Natural log probability of each window's last symbol, a column per language."""
        row = self.prob[ORDER - 1].find(self._query(gram, ORDER))
        out = self.prob[ORDER - 1].values[row]
        left = np.flatnonzero(row < 0)
        extra = np.zeros((len(left), len(self.langs)), np.float32)
        for k in range(ORDER, 0, -1):
            if not len(left):
                return out
            context = self.weight[k - 1].find(self._query(gram[left] >> U64(16), k - 1))
            has = context >= 0
            extra[has] += self.weight[k - 1].values[context[has]]
            if k == 1:
                out[left] = extra + np.float32(np.log(FLOOR))
                return out
            row = self.prob[k - 2].find(self._query(gram[left], k - 1))
            hit = row >= 0
            out[left[hit]] = extra[hit] + self.prob[k - 2].values[row[hit]]
            left, extra = left[~hit], extra[~hit]
        return out

    def entropy(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol of each text under each language, and its letters."""
        code, start, letters = symbols(texts)
        size = np.diff(np.append(start, len(code)))
        out = np.zeros((len(texts), len(self.langs)))
        if len(code):
            logs = self.log_prob(grams(code))
            some = np.flatnonzero(size)
            out[some] = -np.add.reduceat(logs, start[some], axis=0, dtype=np.float64) / size[some, None]
        return out, letters


def fit(train: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", max_docs: int = 5_000) -> Model | None:
    """Learn from labelled documents, at most about ``max_docs`` a language."""
    some = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    share = {r[0]: min(1.0, max_docs / r[1]) for r in some.groupBy(lang).count().collect()}
    if not share:
        return None
    part = F.element_at(F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * (1 << 20)))]), F.col(lang))
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20))
    bound = some.where(place < part)
    left_out = place % 5 == 0
    counts = (
        bound.where(~left_out).select(F.col(lang).alias("__lang"), as_bytes(text).alias("__text"))
        .mapInArrow(count_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    rows = counts.toPandas()  # of the bounded sample
    langs = sorted(rows.lang.unique())
    if not langs:
        return None
    per_lang = []
    for x in langs:
        own = rows[rows.lang == x]
        gram = own.gram.to_numpy().view(U64)
        order = np.argsort(gram)
        per_lang.append((gram[order], own.n.to_numpy()[order]))
    model = Model(langs, per_lang)
    model.limit = calibrate(bound.where(left_out), model, text, lang)
    return model


def calibrate(train: DataFrame, model: Model, text: str, lang: str) -> np.ndarray:
    """For each language the highest accepted cross-entropy: median plus nine interquartile ranges (1.5 nats at least) over texts it didn't learn from; short texts get ten nats divided by their letters more."""
    spark = train.sparkSession
    held = spark.sparkContext.broadcast(model)

    def measure(batches):
        m = held.value
        column = {x: i for i, x in enumerate(m.langs)}
        for batch, texts in chunks(batches, "__text"):
            nats, letters = m.entropy(texts)
            own = batch.column("__lang").to_pylist()
            rows = [(x, float(nats[i, column[x]])) for i, x in enumerate(own) if x in column and letters[i] >= 20]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["lang", "nats"])

    stats = {
        r.lang: r
        for r in train.select(F.col(lang).alias("__lang"), as_bytes(text).alias("__text")).mapInArrow(measure, "lang string, nats double").groupBy("lang").agg(F.percentile("nats", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).collect()
    }
    return np.array([stats[x].q[1] + max(9 * (stats[x].q[2] - stats[x].q[0]), 1.5) if x in stats else 12.0 for x in model.langs])


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` with lang_pred, score, nats, n_letters and rejected."""
    keep = keep or [c for c in docs.columns if c != text]
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("nats"), F.lit(0).cast("long").alias("n_letters"), F.lit(True).alias("rejected"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(*keep, as_bytes(text).alias("__text"))

    def run(batches):
        m = held.value
        for batch, texts in chunks(batches, "__text"):
            nats, letters = m.entropy(texts)
            best = nats.argmin(axis=1)
            low = nats[np.arange(len(best)), best]
            tempered = np.exp(-(nats - low[:, None]) * np.minimum(letters, 64)[:, None])
            none = letters == 0
            limit = m.limit[best] + 10.0 / np.maximum(letters, 1)
            score = np.where(none, 0.0, np.exp(-np.maximum(low - limit, 0)) / tempered.sum(axis=1))
            names = ["und" if x else m.langs[i] for x, i in zip(none, best, strict=True)]
            columns = [batch.column(c) for c in keep] + [pa.array(names, pa.string()), pa.array(score), pa.array(np.where(none, 0.0, low)), pa.array(letters.astype(np.int64)), pa.array(none | (low > limit))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score", "nats", "n_letters", "rejected"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("nats", "double").add("n_letters", "long").add("rejected", "boolean")
    return chosen.mapInArrow(run, schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    model = fit(docs.where(~held_out))
    out = predict(docs.select("doc_id", "text", held_out.alias("held_out")), model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "nats", "n_letters", "rejected")
