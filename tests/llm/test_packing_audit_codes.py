"""Best-fit packing, the audit of sources and vector codes against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulsemill.llm import binpacking, divergence, veccodes

FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
SCHEMA = "doc_id long, text string, lang string, source string, rank int, length string, term string"


def rows_of(seed=3):
    """Null, empty, blank, very long and repeated texts, null groups, one source with a third of the rows, and columns with clashing names."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randint(1, 120)) for _ in range(80)] + [None, "", " \n ", "12 34", "A-B a_b [x]{y} Été ÉTÉ\x00z", "日本語 " * 50, prose(20_000), "x" * 9000]
    out = [(i, t, rng.choice(("en", "fr", None)), "hot" if i % 3 == 0 else rng.choice(("s1", "s2", "", None)), 1, "l", "t") for i, t in enumerate(texts)]
    out += [(500, "12 34", "xx", "s1", 1, "l", "t"), (501, None, "xx", "s2", 1, "l", "t"), (None, "no id", "en", "s1", 1, "l", "t"), (600, "alone", "yy", "s1", 1, "l", "t")]
    return out + out[:2] + out[:1]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- best-fit packing ----------------------------------------------------------------


def expanded(plan, lengths):
    """Each sequence's (offset, length) from the runs of a plan."""
    runs, bins = sorted(plan.runs), defaultdict(list)
    for i, (length, rank, first, each, offset) in enumerate(runs):
        end = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == length else lengths[length]
        for k in range(end - rank):
            bins[first + k // each].append((offset + k % each * length, length))
    return bins


def one_by_one(lengths, room):
    """The same method item by item: greedy pairs of large ones, then the best fit for each smaller one."""
    items = sorted((x for x, n in lengths.items() for _ in range(n)), reverse=True)
    large, gaps = [x for x in items if 3 * x > room], []
    while large:
        left = room - large.pop(0)
        fit = next((x for x in large if x <= left), None)
        if fit:
            large.remove(fit)
            left -= fit
        gaps.append(left)
    for x in (x for x in items if 3 * x <= room):
        best = min((g for g in gaps if g >= x), default=None)
        if best is not None:
            gaps.remove(best)
        gaps.append((room if best is None else best) - x)
    return len(gaps)


def test_plans_hold_all_pieces_and_equal_the_method_item_by_item():
    rng = random.Random(0)
    for _ in range(200):
        room = rng.choice((10, 64, 1024))
        lengths = {rng.randint(1, room): rng.randint(1, 30) for _ in range(rng.randint(0, 25))}
        plan = binpacking.planned(lengths, room)
        bins = expanded(plan, lengths)
        assert set(bins) == set(range(plan.sequences)) and sum(map(len, bins.values())) == sum(lengths.values())
        for held in bins.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= room and sum(3 * n > room for _, n in held) <= 2
        assert plan.sequences == one_by_one(lengths, room)


def test_as_few_sequences_for_large_items_as_can_be():
    def least(items, room):
        if not items:
            return 0
        rest = items[1:]
        return 1 + min([least(rest, room)] + [least(rest[:i] + rest[i + 1 :], room) for i in range(len(rest)) if items[0] + rest[i] <= room])

    rng = random.Random(1)
    for _ in range(40):
        items = [rng.randint(35, 100) for _ in range(7)]
        assert binpacking.planned(dict(Counter(items)), 100).sequences == least(items, 100)


def test_plans_stay_small():
    plan = binpacking.planned({n: 10**12 // n for n in range(1, 1025)}, 1024)
    assert len(plan.runs) < 5 * 1024 and plan.sequences <= sum(10**12 // n * n for n in range(1, 1025)) / 1024 * 1.0001 + 1


def test_ids_are_those_of_the_vocabulary_file():
    slow, rng = Tokenizer.from_file(FILES[0]), random.Random(2)
    texts = ["", " ", "a<|endoftext|>b", " " * 200_000 + "a", "\n" * 6000 + "x", "it's we'll I'M  two   spaces   x\n\n y", "x" * 20_000, "日本語のテキスト 😀😀 ÀÉ", "\x00\x01\x7f"]
    texts += ["".join(chr(rng.choice((rng.randint(32, 126), rng.randint(160, 0x2FF), rng.randint(0x3040, 0x30FF), rng.randint(0x1F600, 0x1F640), 10, 32))) for _ in range(300)) for _ in range(60)]
    for text in texts:
        assert binpacking.token_ids(text, *FILES) == slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("room", [1024, 50])
def test_every_token_has_its_place(docs, none, room):
    out = binpacking.best_fit(docs, *FILES, room=room).collect()
    slow = Tokenizer.from_file(FILES[0])
    wanted = Counter()
    for doc_id, text, *_ in rows_of():
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % room or room
        for piece, at in enumerate([0, *range(first, len(ids), room)]):
            part = ids[at : first if piece == 0 else at + room]
            wanted[doc_id, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == wanted
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        ends = [0]
        for offset, length in sorted(spans):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= room
    assert len(held) == one_by_one(Counter(r.length for r in out), room)
    assert binpacking.best_fit(none, *FILES, room=room).count() == 0


# ---- audit of sources --------------------------------------------------------------


def brute_audit(rows, least_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    count, total, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        own = term.findall((text or "").translate(low))
        count[lang, source].update(own)
        total[lang].update(own)
        df[lang].update(set(own))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= least_docs]
        weigh = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: B023,E731
        of = {s: weigh(count[lang, s]) for x, s in groups if x == lang}
        whole = weigh(total[lang])
        for s, p in of.items():
            pairs = [(-sum(f(p[t], q[t]) for t in kept), o.encode(), o) for o, q in of.items() if o != s]
            terms = [(-f(p[t], whole[t]), t.encode(), t) for t in kept if count[lang, s][t] and p[t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -value, i + 1) for i, (value, _, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("least_docs, top", [(10, 10), (1, 3), (10**6, 10)])
def test_audit_against_brute_force(docs, none, least_docs, top):
    out = [tuple(r) for r in divergence.audit(docs, least_docs=least_docs, top=top).collect()]
    assert len(out) == len(set(out)) and set(out) == brute_audit(rows_of(), least_docs, top)
    assert divergence.audit(none).count() == 0


def test_chunks_and_merges_of_counts_change_nothing(monkeypatch):
    rows = rows_of(7)
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "" for r in rows], "source": [r[3] or "" for r in rows], "text": [(r[1] or "").encode() for r in rows]})

    def kept():
        counted = list(divergence.chunk_counts([batch]))
        return sorted(tuple(r.values()) for b in divergence.kept_terms(3)(counted * 2) for r in b.to_pylist())

    wanted = kept()
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 500)
    monkeypatch.setattr(divergence, "gathered", lambda batches: (pa.Table.from_batches([b.slice(i, 7)]) for b in batches for i in range(0, len(b), 7)))
    monkeypatch.setattr(divergence, "CHUNK_ROWS", 20)
    assert wanted and kept() == wanted


def test_weights_of_very_large_counts_are_exact():
    n, size = 3 * 10**14, 10**15
    table = {"lang": ["x"] * 2, "source": ["a", "b"], "term": ["t"] * 2, "n": [n, 5], "total": [n + 5] * 2, "size": [size, 50], "terms": [7] * 2, "whole": [size + 50] * 2}
    rows = [r for b in divergence.shard_parts(10)([pa.RecordBatch.from_pydict(table)]) for r in b.to_pylist()]
    p, p0, q, q0 = 1 + 10**9 * (n + 2) // (size + 14), 1 + 2 * 10**9 // (size + 14), 1 + 10**9 * 7 // 64, 1 + 2 * 10**9 // 64
    f = lambda a, b: (a - b) ** 2 // (a + b)
    assert [r["value"] for r in rows if r["part"] == "pair"] == [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]
    assert sorted(r["weight"] for r in rows if r["part"] == "bar") == sorted([p, q])


# ---- vector codes --------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds, scale):
    """Plain Lloyd on Python integers."""
    good = [r for r in rows if r[1] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    ints = [[math.floor(x * scale) for x in r[1]] for r in good]
    width = len(ints[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, book: min((far(v, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = defaultdict(list)
            for v in cut:
                own[near(v[p], book)[1]].append(v[p])
            for k, held in own.items():
                book[k] = [sum(x) // len(held) for x in zip(*held, strict=True)]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    return Counter((r[0], r[2], "".join(f"{k:02x}" for _, k in x), sum(d for d, _ in x)) for r, x in zip(good, found, strict=True)), books


def vectors_of(seed, n=300, dim=8, size=1.0, grid=None):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, size, (12, dim))
    v = centres[rng.integers(0, 12, n)] + rng.normal(0, size / 6, (n, dim))
    v = np.round(v * grid) / grid if grid else v
    rows = [(int(i), [float(np.float32(x)) for x in v[i]], int(i % 3) if i % 5 else None, "clash") for i in rng.permutation(n)]
    odd = [(1000, None, 1, ""), (1001, [float("nan")] * dim, 1, ""), (1002, [0.0] * (dim - 1) + [None], 1, ""), (1003, [float("-inf")] * dim, None, ""), (1004, [], 2, ""), (1005, [1.0] * (dim + 4), 2, "")]
    return rows + odd + [(None, rows[0][1], None, ""), (None, rows[1][1], 7, ""), rows[5], rows[6]]


VECTORS = "vec_id long, embedding array<float>, label int, slot string"


@pytest.mark.parametrize("seed, n, size, grid", [(0, 300, 1.0, None), (1, 300, 1.0, 2), (2, 9, 1.0, None), (3, 200, 1e5, None), (4, 200, 0.0, None)])
def test_codes_against_plain_lloyd(spark, seed, n, size, grid):
    rows = vectors_of(seed, n, size=size, grid=grid)
    scale = 1024 if not grid else 2
    coded, books = veccodes.compress(spark.createDataFrame(rows, VECTORS).repartition(3), parts=2, entries=16, rounds=4, scale=scale)
    wanted, brute = brute_codes(rows, 2, 16, 4, scale)
    assert Counter((r.id, r.label, r.code, r.error) for r in coded.collect()) == wanted
    assert [[[int(x) for x in e] for e in b] for b in books] == brute
    text = ",".join(str(x) for b in brute for e in b for x in e)
    assert veccodes.digest(books) == hashlib.sha256(text.encode()).hexdigest()


def test_codes_of_no_vectors(spark):
    for rows in ([], [(1, None, 1, "")]):
        coded, books = veccodes.compress(spark.createDataFrame(rows, VECTORS))
        assert coded.count() == 0 and books == [] and coded.columns == ["id", "label", "code", "error"]
    with pytest.raises(ValueError):
        veccodes.compress(spark.createDataFrame([(1, [1.0] * 6, 1, "")], VECTORS))


def test_ids_that_are_never_null(spark):
    df = spark.range(40).select(F.col("id").alias("vec_id"), F.array(*[(F.col("id") * k % 7).cast("double") for k in range(1, 5)]).alias("embedding"), F.lit(1).alias("label"))
    coded, _ = veccodes.compress(df, entries=8)
    assert sorted(r.id for r in coded.collect()) == list(range(40))


def test_heaps_give_the_parts_whose_slack_is_used_up():
    rng = np.random.default_rng(0)
    codes, slacks = rng.integers(0, 5, 200), rng.random(200)
    heaps = veccodes.Heaps(codes, slacks)
    drift = np.array([0.0, 0.3, 0.5, 2.0, 0.1])
    assert sorted(heaps.violated(drift)) == np.flatnonzero(slacks <= drift[codes]).tolist()
    assert heaps.violated(drift).size == 0
    heaps.push(np.array([3, 7]), np.array([1, 4]), np.array([0.2, 0.9]))
    assert heaps.violated(drift).tolist() == [3] and heaps.codes[7] == 4


def test_bounds_never_hide_a_nearer_entry_and_save_work():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 6))
    x = (centres[rng.integers(0, 16, 4000)] + rng.integers(-200, 200, (4000, 6))).astype(float)
    book, drift = x[:16].copy(), np.zeros(16)
    heaps, looked = None, []
    for _ in range(8):
        if heaps is None:
            codes, slacks = veccodes.nearest(x, book)
            heaps = veccodes.Heaps(codes, slacks)
        else:
            rows = heaps.violated(drift)
            looked.append(len(rows))
            found, slack = veccodes.nearest(x[rows], book)
            heaps.push(rows, found, slack + drift[found])
        assert (heaps.codes == veccodes.squares(x, book).argmin(1)).all()
        new = np.array([np.floor(x[heaps.codes == k].mean(0)) if (heaps.codes == k).any() else book[k] for k in range(16)])
        drift = drift + veccodes.movement(book, new)
        book = new
    assert looked[-1] < 400


def test_equal_labels_share_their_error(spark, tmp_path):
    rows = [(i, [float((i * 7 + j) % 11) / 10 for j in range(64)], None if i % 4 == 0 else i % 2, "") for i in range(400)]
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = veccodes.op13_vector_codes(spark, str(tmp_path)).join(spark.createDataFrame(rows, VECTORS).select("vec_id", F.coalesce("label", F.lit(9)).alias("l")), "vec_id").collect()
    total = Counter()
    for r in out:
        total[r.l] += r.error
    assert len(out) == 400 and all(r.label_error == total[r.l] for r in out) and all(len(r.code) == 8 for r in out)
    assert len(set(combinations(sorted({r.codebooks_sha256 for r in out}), 2))) == 0
