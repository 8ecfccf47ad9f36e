"""Each operator against brute force on a small fixture with nulls, empty and repeated texts, ties and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import common, embedding_dedup, exact_dedup, lm_score, minhash_dedup, mixing, packing, quality, substring_dedup, suffix_dedup, toxicity
from folioscope.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(common.UPPER, common.LOWER)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, block int, kept boolean, id long"


def make_texts(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "Über", "naïve", "Ox", "a", "of", "lamp", "stone", "字", "run"] + [f"w{i}" for i in range(150)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = [say(60), say(110)]
    texts = [say(rng.choice([3, 12, 40, 90, 200])) for _ in range(n)]
    for i in range(0, n, 5):
        texts[i] = say(5) + " " + rng.choice(shared) + "\n" + say(rng.randint(0, 20))
    for i in range(1, 12):  # near copies
        words = texts[7].split() if len(texts[7].split()) > 60 else shared[1].split()
        words[rng.randrange(len(words))] = f"edit{i}"
        texts.append(" ".join(words))
    texts += [texts[3], texts[3].upper(), "", None, " ", "one", "a b c", "x " * 700, "ab" * 900, "tail\x00\x0b end", "a  b   c ", say(4000)]
    return texts


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 9 == 0 else "en", None if i % 7 == 0 else f"s{i % 4}", 1, 2, 3, True, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_exact_dedup(docs, none, texts, spark):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    got = rows_by_id(exact_dedup.decide(docs))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        low = (t or "").translate(LOWER)
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(groups[low]), len(groups[low]), i == max(groups[low]), hashlib.sha256(low.encode()).hexdigest())
    assert exact_dedup.decide(none).count() == 0
    kept = exact_dedup.dedup(docs.unionByName(docs.filter("doc_id < 5")))  # limit() may pick other rows each time it runs
    assert kept.count() == len(groups) and kept.columns == docs.columns


def test_digest_index_grows(docs, spark, texts):
    index = exact_dedup.DigestIndex(spark)
    first = exact_dedup.decide(docs.filter("doc_id < 30"), index).filter("kept").count()
    again = exact_dedup.decide(docs, index)
    assert first == len({(t or "").translate(LOWER) for t in texts[:30]})
    assert again.filter("kept").count() == len({(t or "").translate(LOWER) for t in texts}) - first
    assert exact_dedup.decide(docs, index).filter("kept").count() == 0


def test_digest_index_reopens_and_reruns(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, buckets=3)
    want = sorted(map(tuple, exact_dedup.decide(rows, index, "one").collect()))
    again = exact_dedup.DigestIndex(spark, index.name, buckets=7)  # a session with other settings
    assert sorted(map(tuple, exact_dedup.decide(rows, again, "one").collect())) == want  # the result of a lost batch
    new = spark.createDataFrame([(8, "B"), (9, "b"), (7, "c")], "doc_id long, text string")
    assert sorted(r[:4] for r in map(tuple, exact_dedup.decide(new, again, "two").collect())) == [(7, 7, 1, True), (8, 3, 3, False), (9, 3, 3, False)]
    again.compact()
    assert again.buckets == 3 and again.read().count() == 3
    tables = len(spark.catalog.listTables())
    assert exact_dedup.decide(rows).count() == 3 and len(spark.catalog.listTables()) == tables
    again.drop()


def test_rows_without_id(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text_sha256"][:2]) for r in exact_dedup.decide(rows).filter("kept and doc_id is not null").collect()) == [(1, hashlib.sha256(b"a").hexdigest()[:2])]
    assert minhash_dedup.decide(rows).count() == 4 and substring_dedup.dedup_substrings(rows).count() == 4 and suffix_dedup.dedup_substrings(rows).count() == 4
    assert lm_score.score(rows).count() == 4 and packing.pack(rows).count() == 4 and mixing.mix(rows.withColumn("source", F.lit("s"))).count() == 4


def test_substring_dedup(docs, none, texts):
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        want[i] = (len(w), sum(gone), " ".join(x for x, d in zip(w, gone) if not d))
    for size in (1 << 9, 1 << 23):  # many blocks, and few
        got = rows_by_id(substring_dedup.dedup_substrings(docs, size))
        assert {i: (r["n_words"], r["n_removed"], r["kept_text"]) for i, r in got.items()} == want
    assert substring_dedup.dedup_substrings(none).count() == 0


def test_substring_dedup_of_repeated_ids(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [(5, " ".join(words)), (5, " ".join(words + ["x"])), (None, " ".join(words)), (None, " ".join(words)), (7, " ".join(words[5:])), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block_bytes, part_bytes in ((50, 50), (50, 1 << 20), (1 << 20, 50)):
        got = substring_dedup.dedup_substrings(docs, block_bytes, part_bytes).collect()
        assert sorted((r["doc_id"] or 0, r["n_words"] - r["n_removed"]) for r in got if r["n_words"] != 1) in ([(0, 0), (0, 0), (5, 0), (5, 31), (7, 0)], [(0, 0), (0, 0), (5, 1), (5, 30), (7, 0)])


def test_cover_reaches_every_pair():
    for a in range(substring_dedup.PERIOD):
        for b in range(substring_dedup.PERIOD):
            assert any((a + d) % 13 in substring_dedup.COVER and (b + d) % 13 in substring_dedup.COVER for d in range(13))


def repeated_runs(raw):
    """For each text the maximal runs of bytes in strings of 400 bytes that start anywhere else too."""
    count = Counter(t[k : k + 400] for t in raw for k in range(len(t) - 399))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 2, np.int8)
        for k in range(len(t) - 399):
            if count[t[k : k + 400]] > 1:
                gone[k + 1 : k + 401] = 1
        out.append([(int(a), int(b)) for a, b in np.flatnonzero(np.diff(gone)).reshape(-1, 2)])
    return out


def check_suffixes(docs, raw, bucket_bytes):
    got = rows_by_id(suffix_dedup.dedup_substrings(docs, bucket_bytes))
    for i, (t, runs) in enumerate(zip(raw, repeated_runs(raw))):
        kept = b"".join(t[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(t)]))
        r = got[i]
        assert ([(s["start"], s["end"]) for s in r["spans"]], r["n_bytes"], r["n_removed"], bytes(r["kept"])) == (runs, len(t), len(t) - len(kept), kept)


@pytest.mark.parametrize(("crowd", "piece"), [(4096, 1 << 19), (1, 1 << 10)])
def test_suffix_dedup(docs, none, texts, crowd, piece, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)  # long texts are cut
    check_suffixes(docs, [(t or "").encode() for t in texts], 1 << 11)
    assert suffix_dedup.dedup_substrings(none).count() == 0


def test_suffixes_of_one_lead_meet_across_borders(spark):
    rng = random.Random(7)
    say = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    core, tails = say(330), [say(60) for _ in range(6)]
    raw = [(say(100 + i % 5) + say(3) + core + tails[i % 6] + say(150)).encode() for i in range(40)] + [b"", b"x" * 900]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(raw)], "doc_id long, text string")
    assert any(repeated_runs(raw))
    for bucket_bytes in (700, 1 << 24):  # one suffix a bucket, and few buckets
        check_suffixes(docs, raw, bucket_bytes)


def test_suffixes_of_repeated_rows(spark):
    rng = random.Random(8)
    say = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    one, two = say(700), say(700)
    docs = spark.createDataFrame([(1, one), (1, one), (1, two), (None, two[100:600]), (None, say(500)), (2, "\u00fc" * 150 + two[:410])], "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"], len(r["spans"])) for r in suffix_dedup.dedup_substrings(docs, 700).collect())
    assert got == [(500, 0, 0), (500, 500, 1), (700, 600, 1), (700, 700, 1), (700, 700, 1), (710, 410, 1)]


def test_multikey_quicksort():
    for seed, high in ((1, 3), (2, 1), (3, 2**63)):
        tokens = np.random.default_rng(seed).integers(0, high, (500, 3)).astype(np.uint64)
        assert (tokens[suffix_dedup.multikey_quicksort(tokens)] == tokens[np.lexsort(tokens.T[::-1])]).all()
    assert not len(suffix_dedup.multikey_quicksort(np.zeros((0, 2), np.uint64)))


def shingles(t):
    w = WORDS.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def union_find(n, links):
    label = list(range(n))
    for a, b in links:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_minhash_dedup(docs, none, texts):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    label = union_find(len(sets), links)
    got = rows_by_id(minhash_dedup.decide(docs))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in range(len(sets))}
    assert minhash_dedup.decide(none).count() == 0
    kept = minhash_dedup.dedup(docs)
    assert kept.count() == len(set(label)) and kept.columns == docs.columns


def test_minhash_of_repeated_ids(spark):
    one = [f"a{i}" for i in range(40)]
    two = [f"b{i}" for i in range(40)]
    rows = [(1, " ".join(one)), (3, " ".join(one[1:])), (3, " ".join(two)), (4, " ".join(two[1:])), (9, "z"), (None, " ".join(one))]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in minhash_dedup.decide(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 1), (3, 1), (3, 1), (4, 1), (9, 9)]


def test_large_groups_are_dealt_in_chunks(docs, texts, monkeypatch):
    whole = {i: r["component_id"] for i, r in rows_by_id(minhash_dedup.decide(docs)).items()}
    monkeypatch.setattr(minhash_dedup, "GROUP", 3)
    assert {i: r["component_id"] for i, r in rows_by_id(minhash_dedup.decide(docs)).items()} == whole


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, **{i: 100 for i in range(101, 130)}}
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(links, "a long, b long"), 1)


def test_lm_score(docs, none, texts):
    tokens = [WORDS.findall((t or "").translate(LOWER)) + [None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    counts = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    total, distinct = sum(counts.values()), len(counts)
    got = rows_by_id(lm_score.score(docs, 1 << 10))
    for i, t in enumerate(tokens):
        r = got[i]
        base = sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(counts[w] > 0 for w in t), total)
        assert r["base_score"] == pytest.approx(base) and r["score"] <= 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    few = rows_by_id(lm_score.score(docs))
    assert all(few[i]["score"] == pytest.approx(got[i]["score"]) for i in got)
    assert lm_score.score(none).count() == 0


def test_packing(docs, none, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    got = packing.pack(docs).toPandas().sort_values(["doc_id", "start"])
    for i, t in enumerate(texts):
        want = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        mine = got[got.doc_id == i]
        assert b"".join(mine.ids) == want.tobytes() and (mine.doc_tokens == len(want)).all()
        assert list(mine.start) == [0, *np.cumsum(mine.length)[:-1]]
    assert all(zlib.crc32(x) == c for x, c in zip(got.ids, got.ids_crc32))
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length
    assert by.sum().max() <= 2048 and (by.cumsum() - by.obj == got.sort_values(["sequence_id", "offset"]).offset).all()
    assert packing.pack(none).count() == 0


def test_encoder_on_awkward_texts():
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(packing.default_vocabulary()), packing.Encoder.at(packing.default_vocabulary())
    odd = ["", " ", "a  b", " lead", "tail ", "x\n y", "a <|endoftext|> b", "it's 3.14 Ünï 字 b", "a b", "\n\n", "don't  'll", "a\tb c"]
    assert [x.tolist() for x in own.many(odd)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in odd]


def test_plan_places_every_tail():
    rng = np.random.default_rng(2)
    histogram = dict(Counter(rng.integers(1, 2048, 3000).tolist() + [100] * 5000))
    slots, stream, sequences, cut = packing.plan(histogram)
    used = Counter()
    for n, a, b, *_ in slots:
        assert a == used[n]
        used[n] = b
    assert all(used[n] == a for n, a, _ in stream) and cut == sum((histogram[n] - used[n]) * n for n in histogram)
    assert (sum(used[n] * n for n in used) / (sequences * 2048)) > 0.99


def test_mixing(docs, none, texts):
    got = rows_by_id(mixing.mix(docs))
    size = [len(WORDS.findall(t or "")) for t in texts]
    source = [None if i % 7 == 0 else f"s{i % 4}" for i in range(len(texts))]
    names = sorted({s for s in source if s}) + [None]
    total = {s: sum(z for z, x in zip(size, source) if x == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 3 * total[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * total[s]
            free.discard(s)
            left -= target[s]
    taken = Counter()
    for i in range(len(texts)):
        r = got[i]
        assert r["__size"] == size[i] and r["__total"] == total[source[i]] and r["__target"] == pytest.approx(target[source[i]]) and 0 <= r["__copies"] <= 3
        taken[source[i]] += r["__copies"] * size[i]
    assert all(abs(taken[s] - target[s]) <= max(size) for s in names)
    assert {i: r["__copies"] for i, r in rows_by_id(mixing.mix(docs.repartition(5))).items()} == {i: r["__copies"] for i, r in got.items()}
    assert mixing.mix(none).count() == 0
    many = mixing.mixed_documents(docs)
    assert many.columns == docs.columns and many.count() == sum(r["__copies"] for r in got.values())


def test_embedding_dedup(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16))
    rows = [base[i % 40] + rng.normal(size=16) * (0.05 if i % 3 else 0.12) for i in range(150)]
    rows += [rows[0], rows[0] * 2]
    ids = list(range(len(rows)))
    data = [(i, [float(x) for x in v], 1) for i, v in zip(ids, rows)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [], 1), (905, [1.0], 1)]
    got = rows_by_id(embedding_dedup.decide(spark.createDataFrame(data, "vec_id long, embedding array<double>, size int")), "vec_id")
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    label = union_find(len(rows), zip(*np.nonzero(linked)))
    found = sum(got[i]["n_links"] for i in ids)
    assert 0.9 * linked.sum() <= found <= linked.sum()
    assert sum(got[i]["component_id"] != label[i] for i in ids) <= 0.05 * len(ids)
    assert all(got[i]["n_links"] <= linked[i].sum() for i in ids) and sum(got[i]["n_links"] != linked[i].sum() for i in ids) <= 0.1 * len(ids)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 906))
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert embedding_dedup.decide(empty).count() == 0


def test_embeddings_at_the_extremes(spark):
    data = [(1, [1.0, 2.0]), (2, [1e200, 2e200]), (3, [1e-200, 2e-200]), (4, [5e-324, 1e-323]), (5, [2.0, 0.1]), (6, [1.0, 2.0, 0.0]), (7, [2.0, 4.0, -0.0]), (8, [0.0, 0.0, 1.0])]
    got = rows_by_id(embedding_dedup.decide(spark.createDataFrame(data, "vec_id long, embedding array<double>")), "vec_id")
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (0, 8)}


def test_embeddings_with_a_common_direction(spark, monkeypatch):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(700, 24))
    base /= np.linalg.norm(base, axis=1)[:, None]
    base = np.concatenate([base * 0.5, np.full((700, 1), np.sqrt(0.75))], 1)
    near = base[:200] + rng.normal(size=(200, 25)) * 0.04
    rows = np.concatenate([base, near])
    compared = []
    real = embedding_dedup.choose_shape
    monkeypatch.setattr(embedding_dedup, "choose_shape", lambda x, pivots, mean: compared.append((len(pivots), real(x, pivots, mean))) or compared[-1][1])
    got = rows_by_id(embedding_dedup.decide(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")), "vec_id")
    x = rows / np.linalg.norm(rows, axis=1)[:, None]
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    found = sum(r["n_links"] for r in got.values())
    assert linked.sum() > 200 and 0.9 * linked.sum() <= found <= linked.sum()
    assert compared[0][0] == embedding_dedup.PIVOTS  # the index does not fall back to one list


def test_large_lists_are_dealt_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(30, 5))
    rows = [base[i % 30] + rng.normal(size=5) * 0.05 for i in range(60)]  # few pivots, so that lists hold many vectors and few links
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    whole = {i: (r["n_links"], r["component_id"]) for i, r in rows_by_id(embedding_dedup.decide(vectors), "vec_id").items()}
    monkeypatch.setattr(embedding_dedup, "LIST", 3)
    assert {i: (r["n_links"], r["component_id"]) for i, r in rows_by_id(embedding_dedup.decide(vectors), "vec_id").items()} == whole
    assert any(n for n, _ in whole.values())


def labelled(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioustnr") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(400):
        toxic, good = int(i % 4 == 0), int(i % 5 != 0)
        w = [word() for _ in range(rng.randint(10, 60))]
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["Scoundrel", "vilexa", "vilexo", "vilexen"])
        rows.append((i, " ".join(w) if good else " | ".join(x + "%%" for x in w)))
        if i % 10 != 9:
            labels.append((i, good, toxic))
    labels += [(3, None, None), (None, 1, 1)]
    rows += [(1000, ""), (1001, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers(spark):
    docs, labels = labelled(spark)
    for module, name, fold, held in ((toxicity, "toxic", 5, 0), (quality, "quality", 3, 1)):
        got = rows_by_id(module.classify(docs, labels))
        assert len(got) == 402 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
        assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % fold == held) for i, r in got.items())
        truth = {r["doc_id"]: r[name] for r in labels.collect() if r[name] is not None and r["doc_id"] is not None}
        out = [i for i in truth if got[i]["held_out"]]
        assert sum(got[i]["predicted"] == truth[i] for i in out) >= 0.95 * len(out)
        bare = rows_by_id(module.classify(docs, labels.limit(0)))
        assert len({r["score"] for r in bare.values()}) == 1
        assert module.classify(docs.limit(0), labels).count() == 0
    spans = rows_by_id(toxicity.classify(docs, labels))[4]["spans"]
    assert spans and all(s["end"] > s["start"] for s in spans)


def test_quality_learns_from_all_rows(spark, monkeypatch):
    """Edges, weights and threshold against plain counts over every training row, of which the good ones are more than 6000."""
    rng = random.Random(12)
    rows, label = [], {}
    for i in range(11_000):
        label[i] = int(rng.random() < 0.9)
        odd = 0.25 if label[i] else 0.4  # the classes overlap
        rows.append((i, " ".join(rng.choice(["lamp", "stone", "a", "running"]) + (rng.choice("%#.,") * 2 if rng.random() < odd else "") for _ in range(rng.randint(4, 30)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(list(label.items()), "doc_id long, quality int")
    own = [i for i in label if zlib.crc32(str(i).encode()) % 3 != 1]
    y = np.array([label[i] for i in own])
    bad = int((y == 0).sum())
    monkeypatch.setattr(quality, "BLOCK_ROWS", 1000, raising=False)
    got = rows_by_id(quality.classify(docs, labels))
    score = np.sort([got[i]["score"] for i in own])
    assert (y == 1).sum() > 6000 and score[bad - 1] <= 0.5 <= score[bad]
    ranker = quality.train(docs, labels, common.fold_of(F.col("__id"), 3) != 1)
    texts = [rows[i][1].encode() for i in own]
    x = quality.features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for c, edges in zip(x.T, ranker.edges):
        assert edges.tolist() == np.unique(np.quantile(c, np.arange(1, quality.BINS) / quality.BINS, method="inverted_cdf")).tolist()
    on = np.zeros((len(x), ranker.begin[-1]))
    np.put_along_axis(on, np.stack([np.searchsorted(e, c, "right") + k for e, c, k in zip(ranker.edges, x.T, ranker.begin)], 1), 1, 1)
    scale = on[y == 1].mean(0) + on[y == 0].mean(0) + 50 / 60_000

    def slope(w):  # over all pairs, one by one
        s = on @ w
        wrong = 1 / (1 + np.exp(s[y == 1][:, None] - s[y == 0]))
        return (wrong.mean(0) @ on[y == 0] / bad) - (wrong.mean(1) @ on[y == 1] / (y == 1).sum()) + 2 * quality.RIDGE * scale * w

    size = [np.sqrt((g * g / scale).sum()) for g in (slope(ranker.weights), slope(0 * ranker.weights))]
    assert size[0] <= 1.01 * quality.CLOSE * size[1]
    s = np.sort((on @ ranker.weights).astype(np.float32).astype(float))
    assert abs(ranker.threshold - (s[bad - 1] + s[bad]) / 2) < 1e-6 and abs(ranker.width - s.std() / 4) < 1e-6


def test_quality_scores_at_places(spark):
    """The radix search against a plain sort, with negative scores, ties and counts."""
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (300, quality.WIDTH)).astype(np.float32)
    y, n = rng.integers(0, 2, 300), rng.integers(1, 4, 300)
    rows = spark.createDataFrame([(int(a), r.tobytes(), int(k)) for a, r, k in zip(y, x, n)], "label int, x binary, n long")
    edges = quality.bin_edges(rows, int(n.sum()))
    every = np.repeat(x, n, axis=0)
    assert all(e.tolist() == np.unique(np.quantile(c, np.arange(1, quality.BINS) / quality.BINS, method="inverted_cdf")).tolist() for c, e in zip(every.T, edges))
    ranker = quality.Ranker(0.5, edges)
    ranker.weights = rng.normal(size=ranker.begin[-1]).round(1)
    s = np.sort(ranker.raw(every))
    pairs = quality.Pairs(quality.blocks_of(rows, ranker, 300), ranker, int(n[y == 0].sum()), int(n[y == 1].sum()))
    for k in (0, 1, 7, len(s) // 2, len(s) - 2):
        assert pairs.ranked(ranker.weights, [k, k + 1]) == s[k : k + 2].tolist()


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark)
    full = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    full.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = full
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == full.columns
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert pieces.count() > 0
    empty = full.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
