"""Each operator against its SQL or a brute-force version, with nulls, empties, ties and clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from array import array
from itertools import accumulate, chain, combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.oracle import SF, bag, expected
from tidewell.llm import ann, bpe, components, exact_dedup, language_id, packing, pii, registry, sharding, simhash, similar, substring_dedup, url_filter

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, mark string, size long"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def frame(spark, texts):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", 1) for i, t in texts], COLUMNS)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "été", "ß", "x1", "the", "the"]
    texts = [" ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(rng.choice([0, 1, 5, 14, 40, 120]))) for _ in range(n)]
    shared = " ".join(f"s{k}" for k in range(30))
    texts += [texts[40] + " " + shared, shared + " end", shared, shared.replace(" ", "\n"), "", None, "ha " * 60, "ha " * 45 + "x"]
    texts += [texts[50], texts[50], " " + texts[51].upper()]
    return list(enumerate(texts))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    found, wanted = registry.queries()[name](spark, SF).toPandas(), expected(registry.oracle_sql()[name])
    assert bag(found) == bag(wanted)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.exact_groups(none).count() == exact_dedup.exact_dedup(none).count() == 0
    assert sharding.shard(none).count() == simhash.near_groups(none).count() == similar.similar_groups(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == pii.find(none).count() == pii.redact(none).count() == 0
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert packing.pack(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert language_id.identify(none, language_id.fit_sample(none)).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, spark.createDataFrame([], "page_id long, good int"), registry.URL_RULES).count() == 0


def test_exact_dedup(spark):
    texts = corpus() + [(None, "once"), (7, corpus()[7][1]), (200, "o n c e")]
    norm = {k: re.sub("[\x20\x09-\x0d]", "", t or "") for k, (_, t) in enumerate(texts)}
    best = {}
    for k, (i, t) in enumerate(texts):
        rank = (len(t or ""), i is not None, -(i or 0), -k)
        best.setdefault(norm[k], []).append((rank, i))
    for digest in (exact_dedup.sha256_digest, lambda c: F.encode(F.substring(c, 1, 1), "UTF-8")):
        rows = exact_dedup.exact_groups(frame(spark, texts), digest).collect()
        found = sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in rows)
        assert found == sorted((str(i), str(max(best[norm[k]])[1]), len(best[norm[k]])) for k, (i, _) in enumerate(texts))
        assert sum(r.kept for r in rows) == len(best)
    kept = exact_dedup.exact_dedup(frame(spark, texts))
    assert kept.count() == len(best) and kept.columns == frame(spark, []).columns


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda c: F.encode(F.substring(c, 1, 1), "UTF-8")])
def test_exact_dedup_goes_on_from_its_state(spark, tmp_path, digest):
    """Three batches, the last by another object on the same folder, decide as one does; settings stay."""
    keys = [*exact_dedup.SETTINGS, "fs.file.impl", "spark.sql.streaming.stateStore.unloadOnCommit"]
    before = [spark.conf.get(k, None) for k in keys]
    texts = corpus()
    seen = exact_dedup.SeenTexts(spark, str(tmp_path), digest)
    seen.add(frame(spark, texts[:30])).add(frame(spark, texts[30:60]))
    again = exact_dedup.SeenTexts(spark, str(tmp_path), digest).add(frame(spark, texts[60:]))
    whole = exact_dedup.exact_groups(frame(spark, texts), digest)
    found = again.groups().drop("uid", "batch")
    assert sorted(map(tuple, found.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert again.kept().count() == whole.where("kept").count()
    assert [spark.conf.get(k, None) for k in keys] == before


def test_sharding(spark):
    texts = corpus() + [(3, "again"), (3, "again"), (None, None)]
    rows = sharding.shard(frame(spark, texts)).collect()
    assert sorted(r.permuted for r in rows) == list(range(len(texts)))
    assert sorted((r.shard, r.slot) for r in rows) == sorted((k % 8, k // 8) for k in range(len(texts)))
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, crc(t)) for i, t in texts)
    assert {tuple(r) for r in rows} == {tuple(r) for r in sharding.shard(frame(spark, texts).repartition(5)).collect()}
    n, a = 51, 8
    want = []
    for x in range(n):
        y = sharding.feistel(x, a)
        while y >= n:
            y = sharding.feistel(y, a)
        want.append(y)
    assert [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()] == want


def brute_repeats(texts, window=13):
    words = {i: (t or "").encode().split() for i, t in texts}
    low = {}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            low[key] = min(low.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = {p for k in range(len(w) - window + 1) if low[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        out[i] = (len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode())
    return out


def test_substring_dedup(spark):
    texts = corpus(3) + [(90 + k, " ".join(random.Random(k).choice("ab") for _ in range(200))) for k in range(4)]
    rows = substring_dedup.remove_repeats(frame(spark, [*texts, (None, texts[40][1])])).collect()
    found = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in rows}
    assert found.pop(None)[1] == 0
    assert found == brute_repeats(texts)


def thue_morse(n, a, b):
    return [a if k.bit_count() % 2 == 0 else b for k in range(n)]


def test_substring_dedup_of_crafted_words(spark):
    """Words and texts whose polynomial hashes modulo 2**64 are equal for every odd base differ all the same."""
    x, y = ("".join(thue_morse(4096, *ab)) for ab in (("a", "b"), ("b", "a")))
    head = [f"h{k}" for k in range(12)]
    texts = [(1, " ".join([*head, x])), (2, " ".join([*head, y])), (3, " ".join(thue_morse(4096, "p", "q"))), (4, " ".join(thue_morse(4096, "q", "p"))), (5, " ".join([*head, y, "z"]))]
    rows = substring_dedup.remove_repeats(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in rows} == brute_repeats(texts)


@pytest.mark.parametrize("bits", [3, 10])
def test_substring_dedup_when_words_share_names(spark, monkeypatch, bits):
    """Seeds under which many words have one name give false repeats; these are found out and another seed is taken."""

    def name(word, seed):
        import xxhash

        whole = xxhash.xxh64_intdigest(word, seed)
        return whole if seed > 1 else whole % (1 << bits) + 1

    seeds, real = [], substring_dedup._repeats
    monkeypatch.setattr(substring_dedup, "_repeats", lambda rows, window, seed, *more: seeds.append(seed) or real(rows, window, seed, *more))
    texts = corpus(3) + [(90 + k, " ".join(random.Random(k).choice("ab") for _ in range(200))) for k in range(4)]
    rows = substring_dedup.remove_repeats(frame(spark, texts), name=name).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in rows} == brute_repeats(texts)
    assert seeds == ([0, 1, 2] if bits == 3 else [0])


def test_substring_dedup_of_repeated_ids_and_long_copies(spark):
    """Rows with one id are one document, which never repeats itself; long repeats with edits inside."""
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(6000)]
    texts = [(1, " ".join(base[:900])), (1, " ".join(base[:900])), (1, " ".join(base[100:300])), (9, " ".join(base[:900]))]
    for k in range(2, 6):
        copy = [f"e{k}x{j}" if rng.random() < 0.01 else w for j, w in enumerate(base)]
        texts.append((k, " ".join(copy[rng.randint(0, 500) :])))
    texts += [(7, " ".join(["run"] * 700)), (8, " ".join(["run"] * 300)), (10, "\u00a0".join(base[:50])), (11, None)]
    words = [(i, (t or "").encode().split()) for i, t in texts]
    low = {}
    for i, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            low[key] = min(low.get(key, i), i)
    wanted = []
    for i, w in words:
        gone = {p for k in range(len(w) - 12) if low[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        wanted.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    rows = substring_dedup.remove_repeats(frame(spark, texts)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in rows) == sorted(wanted)


def test_words_named_at_once(monkeypatch):
    """All words are named in one go: one name a word, as `split` has them, and none shared."""
    from tidewell.llm import words

    rng = random.Random(17)
    bits = [b" ", b"\t", b"\x0b", b"\x1c", b"\x00", b"a", b"bc", "é".encode(), "\x85".encode(), b"x" * 9, b"y" * 33]
    texts = [None, b"", b"  ", b"a", b" a b\tc\n", *(b"".join(rng.choices(bits, k=rng.randint(0, 80))) for _ in range(300)), None, b"end"]
    split = [(t or b"").split() for t in texts]
    long = []
    real = words.xxhash.xxh64_intdigest
    monkeypatch.setattr(words.xxhash, "xxh64_intdigest", lambda w, seed: long.append(w) or real(w, seed))
    for some, parts in ((texts, split), ([], []), ([None], [[]])):
        names, bounds = words.named(some, 3)
        assert bounds.tolist() == [0, *accumulate(map(len, parts))] and len(names) == bounds[-1]
        of = dict(zip(chain(*parts), names.tolist(), strict=True))
        assert [of[w] for w in chain(*parts)] == names.tolist() and len(set(of.values())) == len(of)
    assert len(long) > 50 and sorted(long) == sorted(w for w in chain(*split) if len(w) > words.SHORT)
    assert not set(words.named(texts, 3)[0].tolist()) & set(words.named(texts, 4)[0].tolist())


@pytest.mark.parametrize("low", [1, 2, 4])
def test_marks_are_the_same_in_every_copy_of_a_window(monkeypatch, low):
    from tidewell.llm.words import named

    monkeypatch.setattr(substring_dedup, "LOW", low)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(300)) for _ in range(3)] + ["a " * 50]
    names, bounds = named([t.encode() for t in texts], 0)
    seen = {}
    for t, at, mark in zip(*substring_dedup.marks(names, bounds), strict=True):
        assert seen.setdefault(tuple(texts[t].split()[at : at + 13]), mark) == mark


def brute_fingerprint(text, size=3):
    import xxhash

    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, distance=2):
    label = dict(enumerate(range(len(fps))))
    for a, b in combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= distance and label[a] != label[b]:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {k: new if v == old else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("hot", [64, 3])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(2)
    fps = [0, (1 << 64) - 1]
    for _ in range(25):
        fps.append(rng.getrandbits(64))
        for _ in range(6):
            fps.append(fps[-1] ^ sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 3, 4]))) & (1 << 64) - 1)
    fps = sorted({f & (1 << 64) - 1 for f in fps})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(rows)).collect()}
    label = brute_groups(fps)
    found = {}
    for k, f in enumerate(signed):
        found.setdefault(roots.get(f, f), set()).add(k)
    want = {}
    for k, v in label.items():
        want.setdefault(v, set()).add(k)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("limit", [0, 2 << 20])
def test_similar_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(similar, "BROADCAST_BYTES", limit)
    rng = random.Random(4)
    texts = corpus()
    for base in range(6):
        words = [f"w{rng.randint(0, 999)}" for _ in range(rng.choice([60, 200, 500]))]
        for _ in range(6):
            copy = [f"v{rng.randint(0, 99)}" if rng.random() < rng.choice([0.005, 0.02, 0.05]) else w for w in words]
            texts.append((len(texts), " ".join(copy)))
    texts += [(None, texts[-1][1]), (None, "all alone"), (len(texts), texts[-1][1].upper())]
    sets = [frozenset(simhash.shingle_hashes(t or "", 5).tolist()) for _, t in texts]
    root = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
            root = [root[a] if r == root[b] else r for r in root]
    least = {r: min((i for (i, _), q in zip(texts, root, strict=True) if q == r and i is not None), default=None) for r in root}
    wanted = sorted(((i, least[r]) for (i, _), r in zip(texts, root, strict=True)), key=str)
    found = similar.similar_groups(frame(spark, texts)).collect()
    assert sorted((tuple(r) for r in found), key=str) == wanted


def test_language_of_long_texts(spark):
    """A language whose labelled texts are all long is learned as well."""
    rows = [(k, f"un deux trois quatre {k} cinq six", "fr") for k in range(40)]
    rows += [(100 + k, "eins zwei drei vier " * 1100, "de") for k in range(8)]
    model = language_id.fit_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "fr"]
    assert [model.predict(t)[0] for t in ("eins zwei drei vier", "un deux trois quatre cinq")] == ["de", "fr"]


def test_similar_star(spark):
    """Copies like an original in the middle of the rows, but not like each other."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for k in range(300):
        own = rng.sample(range(400), 7)
        texts.append(" ".join(f"c{k}x{j}" if j in own else w for j, w in enumerate(words)))
    texts.insert(150, " ".join(words))
    assert min(similar.jaccard(t, texts[150], 5) for t in texts) >= 0.8
    found = similar.similar_groups(frame(spark, list(enumerate(texts)))).collect()
    assert sorted(tuple(r) for r in found) == [(k, 0) for k in range(301)]


def alike(texts, least=0.8):
    """Smallest index that links of similarity at least `least` reach, by all pairs."""
    sets = [frozenset(simhash.shingle_hashes(t or "", 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    return root


def around(rng, core, n, own):
    """Texts of a common core of words with runs of own words put in at places of their own."""
    texts = []
    for k in range(n):
        words = list(core)
        for at in sorted(rng.sample(range(len(core)), own), reverse=True):
            words.insert(at, f"o{k}x{at}")
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize(("block", "tried"), [(4096, 32), (7, 1)])
@pytest.mark.parametrize("frequent", [4, 10**9])
def test_similar_shared_passages(spark, monkeypatch, block, tried, frequent):
    """Large buckets of texts that are mostly unlike, with chains of near copies inside; in every order of shingles."""
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "TRIED", tried)
    monkeypatch.setattr(similar, "GROWTH", 2)
    monkeypatch.setattr(similar, "FREQUENT", frequent)
    monkeypatch.setattr(similar, "SPLIT", 3)
    rng = random.Random(8)
    core = [f"c{k}" for k in range(120)]
    texts = [t for own in (2, 3, 4, 5, 6) for t in around(rng, core, 12, own)]
    for k in range(12):  # chains: each is like the next, its ends are not
        words = [*core[:100], *(f"p{k}w{j}" for j in range(100))]
        for step in range(5):
            texts.append(" ".join(words))
            words = [w if j not in (100 + 20 * step, 110 + 20 * step) else f"q{k}s{step}j{j}" for j, w in enumerate(words)]
    wanted = [(k, r) for k, r in enumerate(alike(texts))]
    found = similar.similar_groups(frame(spark, list(enumerate(texts)))).collect()
    assert sorted(tuple(r) for r in found) == wanted
    assert 5 < len({r for _, r in wanted}) < len(texts)


def test_similar_passages_of_many_texts_make_no_pairs(spark, monkeypatch):
    """Passages that no chunk shows to be frequent, in long texts that are else unlike and have near copies."""
    monkeypatch.setattr(similar, "FREQUENT", 10**9)
    rng = random.Random(9)
    texts = []
    for k in range(60):
        own = [f"t{k}w{j}" for j in range(300)]
        at = rng.randint(0, 300)
        words = [*own[:at], *(f"p{k % 2}w{j}" for j in range(60)), *own[at:]]
        texts.append(" ".join(words))
        if k % 10 == 0:
            texts.append(" ".join([*words[:-4], "end"]))
    made, written = [], similar.scratch.written

    def counted(df, name, *more):
        out = written(df, name, *more)
        if name in ("near-meetings", "near-tried"):
            made.append(out.count())
        return out

    monkeypatch.setattr(similar.scratch, "written", counted)
    found = similar.similar_groups(frame(spark, list(enumerate(texts)))).collect()
    assert sorted(tuple(r) for r in found) == list(enumerate(alike(texts)))
    assert sum(made) <= len(texts)


def test_raised_order_moves_no_shingle_forward():
    """Sets without a raised shingle among their first ones keep these; counts never fall."""
    rng = np.random.default_rng(3)
    names = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    old = similar.Order(names[::3].view(np.int64), rng.integers(1, 9, len(names[::3])))
    raised = rng.choice(names, 40, replace=False)
    new = old.raised(raised.view(np.int64), np.full(40, 5))
    assert (new.counted(names) == np.maximum(old.counted(names), np.where(np.isin(names, raised), 5, 0))).all()
    same = 0
    for _ in range(300):
        own = np.sort(rng.choice(names, 30, replace=False))
        before = old.head(own, 0.8)
        if not np.isin(before, raised).any():
            same += 1
            assert (new.head(own, 0.8) == before).all()
    assert same > 20


def test_buckets_with_equal_members_are_tried_once(spark):
    """Of these the first in the global order, whose pairs have the most room; buckets with other members stay."""
    members = {10: {1: 4, 2: 5, 3: 6}, 11: {1: 2, 2: 4, 3: 1}, 12: {1: 7, 2: 9, 3: 8}, 13: {1: 3, 2: 3, 4: 3}, 14: {1: 0, 2: 0}, 15: {1: 9, 2: 9, 3: 9, 4: 9}}
    met = spark.createDataFrame([(t, k, 40, p) for t, own in members.items() for k, p in own.items()], "token long, node long, n int, pos int")
    heads = met.groupBy("token").agg(F.count(F.lit(1)).alias("members"))
    assert sorted(r.token for r in similar._distinct_buckets(met, heads).collect()) == [11, 13, 15]


def test_stages_begin_and_end_with_executors_that_gave_back_heap(spark, monkeypatch):
    """In local mode the driver's JVM is the executor's: it collects all garbage though the driver's own release is off."""
    import corpus_pipeline

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(corpus_pipeline.scratch, "release", lambda spark: None)
    before = full()
    with corpus_pipeline._tables(spark):
        begun = full()
        assert begun > before
    assert full() > begun


def test_near_dedup_keeps_one_row_of_each_group(spark):
    words = [f"w{k}" for k in range(100)]
    near = " ".join([*words[:-1], "end"])
    texts = [(5, " ".join(words)), (3, near), (3, near), (None, near), (None, "alone"), (None, "alone"), (3, "other"), (9, None), (8, "")]
    rows = similar.near_dedup(frame(spark, texts))
    assert rows.columns == frame(spark, []).columns
    assert sorted(((r.doc_id, r.text) for r in rows.collect()), key=str) == sorted([(3, near), (None, "alone"), (3, "other"), (8, "")], key=str)
    assert similar.near_dedup(frame(spark, [])).count() == 0


def test_similar_documents(spark):
    """Against all pairs of a whole table."""
    docs = expected("SELECT doc_id, text FROM documents ORDER BY doc_id", SF)
    own = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r.component_id for r in similar.similar_groups(own).collect()}
    assert [found[i] for i in docs.doc_id] == [docs.doc_id[r] for r in alike(list(docs.text))]


def test_simhash(spark):
    texts = corpus()
    rows = {r.doc_id: r for r in simhash.near_groups(frame(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for _, t in texts]
    label = brute_groups(fps)
    for k, (i, _) in enumerate(texts):
        assert rows[i].fp & (1 << 64) - 1 == fps[k]
        assert rows[i].component_id == min(texts[j][0] for j in label if label[j] == label[k])


def test_long_chain(spark):
    rows = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    assert {tuple(r) for r in components.components(rows).collect()} == {(k, 0) for k in range(201)}


def brute_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda w: re.sub("[^0-9]", "", w)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda w: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda w: all(int(x) < 256 for x in w.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda w: 12 <= len(digits(w)) <= 19 and luhn(digits(w))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda w: 9 <= len(digits(w)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m.group()))


def test_pii(spark):
    rng = random.Random(4)
    parts = ["a.b@c.de", "x@y", "a@b.c_d@e.f.g", "+1 (988) 555-2485", "4041894974608795", "4111 1111-1111 1111", "1.2.3.4.5.6.7.8", "256.1.1.1", "010.0.0.255", " ", "é😀", "\n", "word", "7", "-", "+", "@", "."]
    texts = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for k in range(150)] + [(500, None), (501, ""), (502, "1" * 20000)]
    for r in pii.find(frame(spark, texts)).collect():
        text = dict(texts)[r.doc_id] or ""
        assert [tuple(s) for s in r.base] == brute_spans(text), text
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}


def test_pii_contexts_and_redaction(spark):
    """Seeds' contexts and shapes find a card that fails Luhn, an address out of range and keys; the like elsewhere is left alone."""
    rng = random.Random(9)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    keys = [key() for _ in range(12)]
    texts = [(k, f"my card number 4111111111111111 please, mail{k}@host.org") for k in range(12)]
    texts += [(20 + k, f"word{k} server at 10.0.0.{100 + k} now") for k in range(12)]
    texts += [(40 + k, f"so TOKEN = \"{x}\"### end") for k, x in enumerate(keys)]
    texts += [(100, "my card number 4111111111111112 please"), (101, "the server at 10.0.0.300 now 7"), (102, f"token = '{keys[0]}'"), (103, f"é commit {key()} of line 2"), (104, "version 2.0.300.1 at 4111111111111113 or"), (105, None)]
    rows = frame(spark, texts)
    found = {r.doc_id: [tuple(s) for s in r.spans if s not in r.base] for r in pii.find(rows).collect()}
    assert found[100] == [(15, 2, 31)] and found[101] == [(14, 1, 24)] and found[102] == [(9, 4, 49)]
    assert all(found[40 + k] == [(12, 4, 52)] for k in range(12))
    assert not any(found[i] for i in (*range(12), *range(20, 32), 103, 104, 105))
    assert "secret:9:49" in [r.s for r in pii.find(rows).select(pii.shown(F.col("spans")).alias("s")).collect()]
    clean = pii.redact(rows)
    assert clean.columns == rows.columns
    clean = {r.doc_id: r.text for r in clean.collect()}
    assert clean[3] == "my card number [CARD] please, [EMAIL]" and clean[40] == "so TOKEN = \"[SECRET]\"### end" and clean[101] == "the server at [IP] now 7"
    assert clean[103] == texts[-3][1] and clean[104] == texts[-2][1] and clean[105] is None


def test_pii_of_long_texts(spark):
    """Time grows with the text, not with its square."""
    import time

    rng = random.Random(3)
    text = " ".join(rng.choice(["mail%d@x.org", "1.2.3.%d", "é%d", "+1 (98%d) 555-2485"]) % rng.randint(0, 300) for _ in range(100_000))
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = pii.find(rows).first()
    assert [tuple(s) for s in row.base] == brute_spans(text)
    clean = pii.redact(rows).first().text
    assert time.time() - began < 120 and clean.count("[EMAIL]") == sum(s.kind == 0 for s in row.base)


def test_replaced_spans_may_overlap(spark):
    from tidewell.llm.arrays import replaced

    rng = random.Random(2)
    texts = ["".join(rng.choice("abcé😀 ") for _ in range(rng.choice([0, 5, 3000]))) for _ in range(40)]
    spans = [sorted((a, a + rng.randint(1, 30)) for a in rng.sample(range(len(t)), min(len(t), rng.randint(0, 200))) if a + 30 < len(t)) for t in texts]
    rows = spark.createDataFrame(list(zip(texts, spans, strict=True)), "text string, spans array<struct<start:int,end:int>>")
    found = [r[0] for r in rows.select(replaced(F.col("text"), F.col("spans"), lambda x: F.lit("<>"))).collect()]
    for t, own, f in zip(texts, spans, found, strict=True):
        out, at = "", 0
        for a, b in own:
            if a >= at:
                out += t[at:a] + "<>"
            at = max(at, b)
        assert f == out + t[at:]


def test_prefix_bpe(spark):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    alphabets = ["ab ", "abcdeinortsh ", "aAbB01  \n\t.,!'\"éüñß ", [chr(k) for k in range(32, 0x2100)]]
    texts = corpus() + [(1000 + k, "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 60)))) for k in range(300)] + [(2000, "z" * 5000)]
    for r in bpe.encode(frame(spark, texts), RANKS, public_tokenizers.PATTERN, decoded=True).collect():
        text = dict(texts)[r.doc_id] or ""
        assert list(array("I", bytes(r.ids))) == own.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    own_coder = bpe.Coder(RANKS, public_tokenizers.PATTERN, limit=500)
    long = [(3000 + k, "".join(rng.choice("日本語漢字ABCabc0") for _ in range(3000))) for k in range(30)]
    for _, text in [*long, *texts]:
        assert list(array("I", own_coder.encode(text or ""))) == own.encode_ordinary(text or "")
        for kept in (own_coder.words, own_coder.parts):
            assert all(len(k) <= own_coder.longest for k in kept)
    vocabulary = bpe.coder(RANKS, public_tokenizers.PATTERN).vocabulary
    table = bpe.Prefixes(vocabulary, b" international")
    assert table.append(b"isation").tokens() == bpe.Prefixes(vocabulary, b" internationalisation").tokens()
    assert table.edit(6, 2, b"XY").tokens() == bpe.Prefixes(vocabulary, b" interXYtionalisation"[:6] + b"XY" + b" internationalisation"[8:]).tokens()


def test_prefix_bpe_of_many_at_once(monkeypatch):
    """New short pre-tokens are coded together, as each by itself; what is met again is kept when tables change."""
    rng, vocabulary = random.Random(16), bpe.coder(RANKS, public_tokenizers.PATTERN).vocabulary
    alphabets = ["abeinorst", "aeéüñßçö", "ab'0 ", [chr(k) for k in range(32, 0x2100)] + ["\U0001f600", "漢"]]
    words = list({"".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 40))) for _ in range(3000)})
    raws = [w.encode() for w in words]
    alone = [array("I", bpe.Prefixes(vocabulary, r).tokens()).tobytes() for r in raws]
    assert bpe.Batch(vocabulary).tokens(raws) == alone
    few = bpe.Vocabulary({b"a": 0, b"b": 1, b"ab": 2, b"aba": 3})  # ab, ab before aba: the last is met by no merge of abab
    assert bpe.Batch(few).tokens([b"abab", b"a", b"abaab"]) == [array("I", bpe.Prefixes(few, r).tokens()).tobytes() for r in (b"abab", b"a", b"abaab")]
    for lacking in ([b"a", b"abc"], [b"abcab"]):
        with pytest.raises(ValueError, match="lacks byte 99"):
            bpe.Batch(few).tokens(lacking)
    monkeypatch.setattr(bpe, "AT_ONCE", 100)
    own, learned = bpe.Coder(RANKS, public_tokenizers.PATTERN, limit=400), []
    learn = own.learn
    monkeypatch.setattr(own, "learn", lambda w: learned.extend(w := list(w)) or learn(w))
    monkeypatch.setattr(bpe.Prefixes, "become", lambda *_: pytest.fail("a short pre-token coded by itself"))
    for k in range(40):
        own.encode("often oftener " + " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j % 26)}zq{chr(97 + j // 26)}" for j in range(60)))
    assert learned.count(" oftener") == 1 and max(len(own.words), len(own.parts)) <= 400
    assert own.encode("a  b\t c  \n 'd e ") == bpe.coder(RANKS, public_tokenizers.PATTERN).encode("a  b\t c  \n 'd e ")
    blanks = bpe.Coder(RANKS, r"\w+")  # a pattern that skips text
    assert blanks.encode("ab cd, ef") == b"".join(map(blanks.encode, ("ab", "cd", "ef")))


@pytest.mark.parametrize("cell", [1 << 14, 3])
def test_packing(spark, monkeypatch, cell):
    monkeypatch.setattr(packing, "CELL", cell)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = corpus() + [(77, "日本語 text " * 900), (78, "ab " * 4000), (79, "hello <|endoftext|> world"), (80, "a  <|endoftext|>  <|endoftext|><|endof"), (None, "é"), (81, "<|endoftext|>日本")]
    assert tokenizer.encode(texts[-4][1], add_special_tokens=False).ids == [31373, 220, 50256, 995]
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts}
    rows = packing.pack(frame(spark, texts), path, capacity=128).collect()
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(array("I", own).tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 128
    assert sum(ends.values()) > 0.95 * 128 * (len(ends) - 1)  # little padding
    whole = {r.sequence_id: r for r in packing.sequences(frame(spark, texts), path, capacity=128).collect()}
    assert all(len(whole[s].ids) == 4 * n for s, n in ends.items())


def test_cutting_stock_is_near_its_bound():
    demand = {k: 1000 + 7 * k for k in range(1, 65)}
    plan = packing.cutting_stock(demand, 64)
    made = {}
    for times, pattern in plan:
        assert sum(s * n for s, n in pattern.items()) <= 64
        for s, n in pattern.items():
            made[s] = made.get(s, 0) + times * n
    assert made == demand
    least = max(sum(s * n for s, n in demand.items()) / 64, sum(n for s, n in demand.items() if s > 32))
    assert sum(t for t, _ in plan) <= 1.03 * least + 64


def test_language_id(spark):
    rows = registry.op8_language_id(spark, SF).toPandas().set_index("doc_id")
    true = expected("SELECT doc_id, lang FROM documents").set_index("doc_id")
    held = rows[rows.held_out]
    assert {int(i) for i in held.index} == {int(i) for i in true.index if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (held.lang_pred == true.lang[held.index]).mean() > 0.97
    model = language_id.fit(["der die das und"] * 9 + ["the and of to"] * 9, ["de"] * 9 + ["en"] * 9)
    odd = frame(spark, [(1, None), (2, ""), (3, "12 + 3"), (None, "the of and")])
    found = [(r.doc_id, r.lang_pred, r.score > 0.5) for r in language_id.identify(odd, model).collect()]
    assert found == [(1, "und", False), (2, "und", False), (3, "und", False), (None, "en", True)]


def plain_model(texts, languages, epochs=3, l1=1e-4, l2=1e-4, alpha=0.5, beta=1.0, seed=1):
    """The classifier once more, with dictionaries and dense loops; returns a function from texts to probabilities."""
    def grams(text):
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        line, counts = " " + " ".join(letters.split()) + " ", {}
        for n in (1, 2, 3):
            for k in range(len(line) - n + 1):
                g = 0
                for c in line[k : k + n]:
                    g = (g * 0x01000193 + ord(c) + 1) % 2**32
                name = g * 0x9E3779B1 % 2**32 >> 17
                counts[name] = counts.get(name, 0) + 1
        total = sum(counts.values())
        return {g: c / total for g, c in counts.items()}

    names = sorted(set(languages))
    bags = [grams(t) for t in texts]
    df = {}
    for b in bags:
        for g in b:
            df[g] = df.get(g, 0) + 1
    idf = lambda g: math.log((1 + len(bags)) / (1 + df.get(g, 0))) + 1

    def vector(bag):
        x = {g: f * idf(g) for g, f in bag.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {g: v / size for g, v in x.items()} | {"bias": 1.0}

    def probabilities(z):
        e = [math.exp(v - max(z)) for v in z]
        return [v / sum(e) for v in e]

    z, n, w = {}, {}, {}
    logits = lambda x: [sum(v * w.get((g, k), 0.0) for g, v in x.items()) for k in range(len(names))]
    seen, train, held = {}, [], []
    for b, y in zip(bags, languages, strict=True):
        (held if seen.get(y, 0) % 5 == 4 else train).append((vector(b), names.index(y)))
        seen[y] = seen.get(y, 0) + 1
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            x, y = train[i]
            p = probabilities(logits(x))
            for g, v in x.items():
                for k in range(len(names)):
                    d = v * (p[k] - (k == y))
                    at = (g, k)
                    s = (math.sqrt(n.get(at, 0) + d * d) - math.sqrt(n.get(at, 0))) / alpha
                    z[at] = z.get(at, 0) + d - s * w.get(at, 0)
                    n[at] = n.get(at, 0) + d * d
                    w[at] = 0.0 if abs(z[at]) <= l1 else -(z[at] - math.copysign(l1, z[at])) / ((beta + math.sqrt(n[at])) / alpha + l2)
    if held:
        loss = lambda t: -sum(math.log(max(probabilities([v / t for v in logits(x)])[y], 1e-12)) for x, y in held)
        heat = min(np.geomspace(0.2, 20, 61), key=loss)
    else:
        heat = 1.0
    return lambda t: dict(zip(names, probabilities([v / heat for v in logits(vector(grams(t)))]), strict=True))


def test_language_id_equals_a_plain_version(monkeypatch):
    rng = random.Random(1)
    words = {"a": "der die das und ist", "b": "the and of to is", "c": "le la les et est"}
    pairs = [(" ".join(rng.choice(words[y].split()) for _ in range(rng.randint(2, 12))) + rng.choice(["", " 12!", ". É"]), y) for y in "abc" * 7]
    pairs.append(("odd one", "d"))
    texts, languages = map(list, zip(*pairs, strict=True))
    plain = plain_model(texts, languages)
    for chunk in (1 << 20, 7):
        monkeypatch.setattr(language_id, "CHUNK", chunk)
        model = language_id.fit(texts, languages)
        for t in [*texts[:6], "the der", "zzz", "odd", "Is  it,THE end", "x" * 50]:
            p = plain(t)
            best = max(sorted(p), key=p.get)
            assert model.predict(t) == (best, pytest.approx(p[best], abs=1e-9))


def test_language_id_sample_and_clashing_columns(spark):
    """Any number of languages, with few or long texts, can be predicted; columns of the result's names are replaced."""
    rows = [(k, f"word{chr(97 + k % 26) * 5} {chr(97 + k // 26) * 7} " * (3000 if k == 5 else 3), f"l{k}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "lang_pred": F.lit(1)})
    model = language_id.fit_sample(docs)
    learned = {f"l{k}" for k in range(600) if zlib.crc32(str(k).encode()) % 4 != 2}
    assert set(model.languages) == learned and model.weights.size <= language_id.CELLS + len(learned)
    out = language_id.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and out.schema["score"].dataType.typeName() == "double"
    # Equal probabilities: the first by name.
    same = language_id.Model(["x", "y"], np.ones(1 << 15), np.zeros(((1 << 15) + 1, 2)))
    assert same.predict("any") == ("x", 0.5)


def brute_nearest(rows, every=100, k=10):
    out = []
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    asked = {}
    for i, v in good:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v, key=lambda x: (x.tolist(), len(x)))
    for q, v in asked.items():
        near = sorted((float(ann.lengths(w[None], v[None])[0]), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("cells", [(1 << 15, 1 << 10, 1 << 13), (150, 3, 40)])
def test_nearest_equals_brute_force(spark, monkeypatch, cells):
    """With the largest possible error every neighbour is found: odd and repeated vectors, ties, few candidates, several lengths."""
    for name, value in zip(("CODES", "QUERIES", "FULL"), cells, strict=True):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(1)
    rows = [(k, rng.standard_normal(16).tolist()) for k in range(900)]
    rows += [(1000 + k, rng.standard_normal(70).tolist()) for k in range(250)] + [(2000 + 50 * k, [float(k + 1)]) for k in range(5)]
    rows += [(3000, [1.0, 2.0, 3.0]), (500, None), (600, [0.0] * 16), (700, [float("nan")] * 16), (800, [None] * 16), (None, rows[1][1])]
    rows += [(901, rows[100][1]), (902, rows[100][1]), (902, rows[100][1]), (200, rows[3][1]), (100, rows[100][1])]
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"uid": F.lit(1), "d": F.lit(2), "code": F.lit("x")})
    found = ann.nearest(frame_, exact=True).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute_nearest(rows)
    wanted = {(q, i) for q, _, i, _ in brute_nearest(rows)}
    usual = {(r.query_id, r.vec_id) for r in ann.nearest(frame_).collect()}
    assert len(usual & wanted) >= 0.9 * len(wanted)


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(2)
    rows, queries = rng.standard_normal((500, 64)), rng.standard_normal((40, 64))
    codes, norm, fit = ann.coded(rows)
    assert codes.shape == (500, 1) and np.allclose(norm, np.sqrt((rows**2).sum(axis=1)))
    true = ((rows[:, None] - queries[None]) ** 2).sum(axis=2)
    asked = ann.Asked(queries)
    about, error = asked.distances(codes, norm, fit, exact=True)
    assert (np.abs(about - true) <= error).all()
    about, error = asked.distances(codes, norm, fit, exact=False)
    assert (about - error <= true).mean() > 0.995


def test_urls(spark):
    urls = [None, "", "x", "http://A.Example.COM", "http://example.com/en/x?y", "http://www.example.com/en/", "ftp://a.net/es/1#q", "http://net/fr/", "http://com?x=://y", "http://xcom/", "://h/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: r for r in url_filter.judge(pages, spark.createDataFrame([(0, None), (3, 1)], "page_id long, good int"), registry.URL_RULES).collect()}
    assert [rows[k].rule for k in range(11)] == [None, None, None, None, "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, None]
    assert [rows[k].host for k in range(11)] == ["", "", "", "a.example.com", "example.com", "www.example.com", "a.net", "net", "com", "xcom", "h"]
    assert [r[0] for r in spark.createDataFrame([(h,) for h in ("u:p@a.b.co.uk:80", "co.uk", "x.co.uk", "127.0.0.1:8", "a.b.c.de", "", "x", "a.com")], "h string").select(url_filter.site_of(F.col("h")).alias("s")).withColumn("x", url_filter.suffix_of(F.col("s"))).select(F.concat_ws(" ", "x", url_filter.domain_of(F.col("s"), F.col("x")))).collect()] == ["co.uk b.co.uk", "uk co.uk", "co.uk x.co.uk", "127.0.0.1 127.0.0.1", "de c.de", " ", "x x", "com a.com"]
    twice = pages.unionAll(pages).withColumns({"host": F.lit("h"), "site": F.lit("s"), "n": F.lit(1), "verdict": F.lit(None)})
    again = url_filter.judge(twice, spark.createDataFrame([(0, None), (3, 1), (3, 1)], "page_id long, good int"), registry.URL_RULES)
    assert again.count() == 22 and {(r.page_id, r.verdict) for r in again.collect()} == {(r.page_id, r.verdict) for r in rows.values()}
    assert rows[10].path == "/p" and all(r.verdict == "allow" for k, r in rows.items() if r.rule is None)


def redacted(text, spans):
    out, at = "", 0
    for a, kind, b in spans:
        if a >= at:
            out += text[at:a] + f"[{pii.ALL[kind].upper()}]"
        at = max(at, b)
    return out + text[at:]


def test_pipeline(spark):
    """Against plain versions of its stages, one after the other, over a whole table."""
    import corpus_pipeline

    source = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit_sample(source)
    docs = []
    for i, text in expected("SELECT doc_id, text FROM documents ORDER BY doc_id").itertuples(index=False):
        language, score = model.predict(text)
        if language != "und" and score >= corpus_pipeline.LEAST_SCORE:
            docs.append((int(i), text or ""))
    best = {}
    for i, t in docs:
        key = re.sub("[\x20\x09-\x0d]", "", t)
        best[key] = max(best.get(key, (-1, 0)), (len(t), -i))
    stay = {-i for _, i in best.values()}
    docs = [(i, t) for i, t in docs if i in stay]
    root = alike([t for _, t in docs])
    docs = [d for k, d in enumerate(docs) if root[k] == k]
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = []
    for i, t in docs:
        ids = tokenizer.encode(redacted(t, spans[i]), add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), 1024):
            own = ids[at : at + 1024]
            wanted.append((i, at, len(own), zlib.crc32(array("I", own).tobytes()), len(ids)))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == sorted(wanted)
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (s, at, n), (t, next_at, _) in zip(places, places[1:], strict=False):
        assert next_at == (at + n if s == t else 0)
    assert max(at + n for _, at, n in places) <= 1024


def test_pipeline_stages_take_odd_rows(spark):
    """Nulls, empty texts, repeated rows and columns with names that the stages use themselves."""
    import corpus_pipeline

    texts = [*corpus(), (None, "the and of to " * 9), (None, "the and of to " * 9), (3, "again"), (None, None)]
    names = ["__gone", "__id", "doc", "row", "set", "uid", "batch", "digest", "spans", "base", "score", "lang_pred"]
    odd = frame(spark, texts).withColumns({n: F.lit("x") for n in names}).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns, name
                assert out.count() <= docs.count()
            path = f"{corpus_pipeline.scratch.new_path(spark, 'odd')}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
