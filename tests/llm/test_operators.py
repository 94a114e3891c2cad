"""Each operator against a plain version, on odd rows and on none."""

import random
import time
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from odd import EDGE
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tamarix.llm import common, exact_dedup, language_id, line_dedup, mixing, ngram_join, packing, quality_rules, sharding, substring_dedup, toxicity

PAIRS = [(r[0], r[1]) for r in EDGE]
last = lambda x: tuple((v is None, v) for v in x)


def same(got, want):
    assert sorted(map(tuple, got), key=last) == sorted(map(tuple, want), key=last)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aé \n\t\x0b\x1f\U0001f600Z", max_size=30)), max_size=8))
def test_words(texts):
    w = common.Words(pa.array(texts, pa.string()))
    got = [x.decode() for x in w.array.to_pylist()]
    assert [got[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)] == [brute.words(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 13))
def test_run_ranks_tell_runs_apart(codes, k):
    got = common.run_ranks(np.array(codes, np.int64), k).tolist()
    want = [tuple(codes[i : i + k]) for i in range(len(codes) - k + 1)]
    assert len(got) == len(want) and [got.index(x) for x in got] == [want.index(x) for x in want]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=20).filter(lambda b: not set(b) & {9, 10, 11, 12, 13, 32}), min_size=1, max_size=20))
def test_word_hashes_tell_words_apart(words):
    w = common.Words(pa.array([b" ".join(words), b"zzz " + b"  ".join(words[::-1])], pa.large_binary()))
    for order in (0, 1):
        got = common.word_hashes(w, order).tolist()
        assert got[: len(words)] == got[len(words) + 1 :][::-1] and len(set(got)) == len({*words, b"zzz"})


def thue_morse():
    """Two different words that any polynomial hash modulo 2^64 takes for equal."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_no_two_words_are_taken_for_equal(spark):
    x, y = thue_morse()
    w = common.Words(pa.array([x, y]))
    assert len(set(common.word_hashes(w).tolist())) == 2
    kinds = "doc_id long, text string, lang string, source string"
    lines = spark.createDataFrame([(1, f"{x}\n{y}\n{x}", "en", "a")], kinds)
    assert [(r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.judge(lines).collect()] == [(1, 0)]
    sets = spark.createDataFrame([(1, f"p q r s {x}", "en", "a"), (2, f"p q r s {y}", "en", "a"), (3, x, "en", "a"), (4, y, "en", "a")], kinds)
    assert {r["component"] for r in ngram_join.NgramJaccardJoin(sets).components().collect()} == {1, 2, 3, 4}
    twelve = " ".join("abcdefghijkl")
    windows = spark.createDataFrame([(1, f"{twelve} {x}", "en", "a"), (2, f"{twelve} {y}", "en", "a"), (3, f"{twelve} {x}", "en", "a")], kinds)
    assert {r["document_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(windows).collect()} == {1: 0, 2: 0, 3: 13}


def test_landed_tables_can_be_removed(spark):
    mark = common.marked()
    one = common.landed(spark.range(3).toDF("x"), "test-one")
    two = common.landed_alone(one.filter("x > 0"), "test-two", mark)
    assert two.count() == 2 and common.marked() == mark + 1
    common.discard(two, None, spark.range(1))
    assert common.marked() == mark


def test_a_cluster_needs_a_shared_folder():
    class Unset:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_path(Unset, "x")


# --- exact dedup ---


def test_exact_dedup(edge, spark):
    rows = exact_dedup.ExactDedup(edge, files_per_batch=1).rows().collect()
    same([(r["document_id"], r["keep_id"], r["group_size"]) for r in rows], brute.exact(PAIRS))
    assert Counter(r["digest"] for r in rows if r["kept"]) == Counter({r["digest"] for r in rows})


def test_exact_dedup_checks_full_bytes(edge):
    """With a digest of two values all texts collide."""
    weak = lambda norm: F.lpad(F.hex(F.length(norm) % 2), 2, "0")
    rows = exact_dedup.ExactDedup(edge, digest=weak).rows().collect()
    same([(r["document_id"], r["keep_id"], r["group_size"]) for r in rows], brute.exact(PAIRS))


def test_exact_dedup_of_hot_groups(spark, monkeypatch):
    """Hot groups, one of them of two texts with one digest, take the other way."""
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 20)
    monkeypatch.setattr(exact_dedup, "HOT", 4)
    rows = [(i, f"text {'a' if i % 2 else 'b  '}") for i in range(60)] + [(100 + i, f"own {i}") for i in range(30)] + [(200 + i, "pair") for i in range(2)]
    weak = lambda norm: F.when(F.startswith(norm, F.lit("text")), F.lpad(F.lit("7"), 64, "0")).otherwise(F.sha2(norm, 256))
    for digest in (exact_dedup.sha256, weak):
        got = exact_dedup.ExactDedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=digest).rows().collect()
        same([(r["document_id"], r["keep_id"], r["group_size"]) for r in got], brute.exact(rows))
        assert sum(r["kept"] for r in got) == 33


def test_exact_dedup_keeps_columns(edge, empty):
    kept = exact_dedup.ExactDedup(edge).kept_documents()
    assert kept.columns == edge.columns and kept.count() == len({brute.re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in PAIRS})
    assert exact_dedup.ExactDedup(empty).kept_documents().count() == 0


# --- n-gram join ---


def test_join_of_words_made_to_collide(spark):
    """Words of 16 bytes that a mix with public constants takes for equal: sizes,
    and a link at exactly 0.8, are those of the words."""
    alike = ["o--8dc-\"'.@_hbl!", "h5s(61q9j0w6zjj5"]
    base = [f"w{i}" for i in range(268)]
    one = base[:216]
    two = base[:216] + base[216:]
    extra = " ".join(f"{a} x{i}" for i, a in enumerate(alike * 10))
    rows = [(1, " ".join(one)), (2, " ".join(one + ["z"] * 0 + base[216:265])), (3, extra), (4, extra.replace(alike[0], alike[1])), (5, " ".join(two)), (6, " ".join(f"{alike[i % 2]} p{i % 7}" for i in range(60)))]
    got = ngram_join.NgramJaccardJoin(spark.createDataFrame(rows, "doc_id long, text string")).components().collect()
    same(got, brute.components(rows))
    assert brute.components(rows)[1][2] == 1  # 212 of 261 shingles


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "o--8dc-\"'.@_hbl!", "h5s(61q9j0w6zjj5", "b", "a" * 17]), max_size=40), st.binary(min_size=1, max_size=64))
def test_sets_are_those_of_the_words(words, key):
    text = " ".join(words)
    sets, sizes, _, _ = ngram_join.shingle_sets(pa.array([text, None, text]), 5, key)
    want = len(brute.shingles(text))
    assert sizes == [want, 0, want] and [len(x) for x in sets] == sizes


def test_sizes_are_exact_where_hashes_meet(monkeypatch):
    """With one hash for many words, the size is still that of the words."""
    def weak(words, key):
        codes = words.coded()[0].astype(np.uint64)
        return codes % np.uint64(3), codes

    monkeypatch.setattr(common, "keyed_hashes", weak)
    text = " ".join(f"w{i % 50}" for i in range(300)) + " a b c d e f g"
    _, sizes, _, _ = ngram_join.shingle_sets(pa.array([text, "one two"]), 5, b"k")
    assert sizes == [len(brute.shingles(text)), 1]


def test_join_on_odd_rows(edge, empty):
    got = ngram_join.NgramJaccardJoin(edge).components().collect()
    same(got, brute.components(PAIRS))
    assert ngram_join.NgramJaccardJoin(empty).components().count() == 0


def family(rng, n, edits):
    base = [f"v{rng.randrange(500)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_join_on_families(spark, seed):
    """Near copies around the limit, and a passage that many documents share."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = family(rng, 60, 6) + family(rng, 20, 3) + [passage + " " + " ".join(f"u{rng.randrange(9999)}" for _ in range(rng.randrange(2, 60))) for _ in range(50)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = ngram_join.NgramJaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=3000).components().collect()
    same(got, brute.components(rows))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(*[st.lists(st.sampled_from(["a", "b", "cc", "d"]), min_size=1, max_size=14)] * 2), min_size=1, max_size=6))
def test_similar_texts(pairs):
    a, b = ([" ".join(x[i]) for x in pairs] for i in (0, 1))
    got = set(ngram_join.similar(pa.array([x.encode() for x in a]), pa.array([x.encode() for x in b]), 3, 80).tolist())
    sets = [(brute.shingles(x, 3), brute.shingles(y, 3)) for x, y in zip(a, b, strict=True)]
    assert got == {i for i, (x, y) in enumerate(sets) if 100 * len(x & y) >= 80 * len(x | y)}


@pytest.mark.parametrize("block", [512, 3])
def test_join_in_blocks(spark, monkeypatch, block):
    """Many sets at one member, near each other, some linked: leaders, then cells."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(11)
    base = [f"c{i}" for i in range(60)]
    texts = []
    for _ in range(70):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(20, 60)] = f"e{rng.randrange(40)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    for rounds in (0, 3):
        got = ngram_join.NgramJaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=3000, rounds=rounds).components().collect()
        same(got, brute.components(rows))


def test_bounds_lose_no_pair():
    """Linked sets share enough of their first members, and one that both keep."""
    rng = random.Random(5)
    for _ in range(400):
        x = set(rng.sample(range(10**6), rng.randrange(1, 80)))
        y = set(x)
        for _ in range(rng.randrange(0, len(x) // 4 + 2)):
            if y and rng.random() < 0.7:
                y.discard(rng.choice(sorted(y)))
            if rng.random() < 0.7:
                y.add(rng.randrange(10**6))
        both = len(x & y)
        if not y or 100 * both < 80 * (len(x) + len(y) - both):
            continue
        b = ngram_join.Bounds(np.array([len(x), len(y)]), 80)
        fx, fy = (set(sorted(s)[: b.first[i]]) for i, s in enumerate((x, y)))
        assert len(fx & fy) >= b.shared.max() or len(fx & fy) >= b.shared.min()
        order = lambda m: (m * 2654435761) % 2**32
        kx, ky = (set(sorted(f, key=order)[: b.kept[i]]) for i, f in enumerate((fx, fy)))
        assert kx & ky


# --- substring dedup ---


def test_substring(edge, empty):
    rows = substring_dedup.remove_repeats(edge).select("document_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    same(rows, brute.substring(PAIRS))
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_over_chunks(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join([" ".join(rng.choice("abcdef") for _ in range(rng.randrange(30))), passage[: rng.randrange(1, len(passage))], "z" * rng.randrange(4)])) for i in range(80)] + [(200, "same " * 60), (201, "same " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.remove_repeats(df, chunk_bytes=1500).cache()
    same(found.select("document_id", "n_words", "n_removed", F.sha2("kept", 256)).collect(), brute.substring(rows))
    for r in found.collect():
        w = brute.words(dict(rows)[r["document_id"]])
        gone = {i for s in r["removed"] for i in range(s["first"], s["first"] + s["words"])}
        assert len(gone) == r["n_removed"] and " ".join(x for i, x in enumerate(w) if i not in gone) == r["kept"]


def test_substring_with_heavy_minimisers(spark, monkeypatch):
    """Windows of heavy minimisers are dealt otherwise and give the same."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join([" ".join(rng.choice("abc") for _ in range(rng.randrange(40))), passage[rng.randrange(20) : rng.randrange(30, len(passage))], "z z z " * rng.randrange(9)])) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substring_dedup, "SEEN", 2)
    heavy = substring_dedup.heavy_minimisers(df.select("text"), 13, 3, 1000, 2000)
    assert len(heavy) > 10
    monkeypatch.setattr(substring_dedup, "heavy_minimisers", lambda *a: heavy)
    same(substring_dedup.remove_repeats(df, chunk_bytes=1500).select("document_id", "n_words", "n_removed", F.sha2("kept", 256)).collect(), brute.substring(rows))


# --- packing ---


def check_pieces(rows, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sequences, found = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        found[r["document_id"]].append(r)
    for v in sequences.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 4096
    want = Counter((d, tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for d, x in texts)
    for d, rs in found.items():
        tokens = sum(n * len(ids) for (k, ids), n in want.items() if k == d)
        assert sum(r["length"] for r in rs) == tokens
    for (d, ids), n in want.items():
        if n == 1 and sum(k == d for k, _ in want) == 1:
            parts = sorted(found[d], key=lambda r: r["start"])
            assert b"".join(bytes(r["ids"]) for r in parts) == np.array(ids, "<u4").tobytes() and all(r["doc_tokens"] == len(ids) for r in parts)
    return len(sequences)


def test_packing(edge, empty, spark, data):
    path = public_tokenizers.path("word_bpe_49k.json")
    check_pieces(packing.pack(edge, path, 2).collect(), PAIRS)
    assert packing.pack(empty, path, 2).count() == 0
    docs = common.documents(spark, data).coalesce(1)
    rows = packing.pack(docs, path, 2).collect()
    n = check_pieces(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(r["length"] for r in rows) / (4096 * n) > 0.95


def test_tightest_window():
    tree = packing.CapacityTree(8)
    for i, room in enumerate((3, 5, 5, 8)):
        tree.put(room, i)
    assert tree.take(4)[1] == 5 and tree.take(4)[1] == 5 and tree.take(4) == (3, 8) and tree.take(4) is None and tree.take(1) == (0, 3)
    item, start, length, window, offset = packing.best_fit(np.array([20, 3, 5, 2, 8]), 8)
    assert sum(length) == 38 and len(set(window.tolist())) == 5 and sorted(zip(item.tolist(), start.tolist(), strict=True))[:3] == [(0, 0), (0, 8), (0, 16)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=40))
def test_best_fit_decreasing(lengths):
    """Against looking through all open windows for each item."""
    window, room, ids, plain = 16, [], [], []
    for i, n in enumerate(lengths):
        for k in range(n // window):
            plain.append((i, k * window, window, len(room), 0))
            room.append(0)
    for i, n in sorted(enumerate(lengths), key=lambda x: -(x[1] % window)):
        n, at = n % window, n // window * window
        fits = [w for w in range(len(room)) if room[w] >= n]
        if n and not fits:
            room.append(window)
            fits = [len(room) - 1]
        if n:
            least = min(room[w] for w in fits)
            plain.append((i, at, n, least, window - least))
            # of equally tight windows, the one that got this room last
            w = next(w for w in reversed(ids) if room[w] == least) if any(room[w] == least for w in ids) else fits[-1]
            room[w] -= n
            ids = [x for x in ids if x != w] + [w]
    item, start, length, seq, offset = packing.best_fit(np.array(lengths, np.int64), window)
    got = list(zip(item.tolist(), start.tolist(), length.tolist(), offset.tolist(), strict=True))
    assert sorted(got) == sorted((i, a, n, o) for i, a, n, _, o in plain)
    assert len(set(seq.tolist())) == len(room)


def test_fill_does_not_depend_on_partitions(spark):
    docs = common.documents(spark, "/root/testdata/sf0.1").select("doc_id", "text")
    fill = []
    for parts in (8, 211):
        n, windows = packing.pack(docs.repartition(parts, "doc_id"), public_tokenizers.path("word_bpe_49k.json"), 2).agg(F.sum("length"), F.count_distinct("sequence_id")).first()
        fill.append(n / (4096 * windows))
    assert min(fill) > 0.995 and abs(fill[0] - fill[1]) < 0.005


def test_a_tokenizer_that_joins_words_is_refused():
    from tokenizers import Tokenizer, models

    whole = Tokenizer(models.WordLevel({"one two": 0, "?": 1}, unk_token="?"))
    with pytest.raises(ValueError, match="words"):
        packing.WordIds(whole.to_str())


# --- mixing ---


def test_mixing(edge, empty, spark):
    m = mixing.Mixture(edge, whole=True)
    taken = m.taken().collect()
    sizes = [len(brute.words(t)) for _, t in PAIRS]
    assert len(taken) == len(EDGE) and sum(r["size"] for r in taken) == sum(sizes)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in taken)
    by = defaultdict(int)
    for r in taken:
        by[r["source"]] += r["taken"]
    longest = defaultdict(int)
    for r in taken:
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(by[r["source"]] - r["target"]) <= longest[r["source"]] for r in taken) and sum(by.values()) == sum(sizes)
    mixed = m.documents()
    assert mixed.columns == edge.columns
    assert sum(len(brute.words(r["text"])) for r in mixed.collect()) == sum(by.values())
    assert mixing.Mixture(empty).taken().count() == 0
    again = sorted(map(last, mixing.Mixture(edge.repartition(3)).taken().select("id", "size", "taken").collect()))
    assert again == sorted(map(last, [(r["id"], r["size"], r["taken"]) for r in taken]))
    order = [r["words_before"] for r in m.entries().orderBy("finish", "words_before").collect()]
    assert order == sorted(order)


def test_mixing_by_finish_times(spark):
    """Against a queue served one word after another by hand."""
    rng = random.Random(7)
    rows = [(i, "w " * rng.randrange(0, 40), rng.choice(["a", "b", "c", None])) for i in range(150)]
    m = mixing.Mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    order, target = defaultdict(list), {}
    for r in m.ordered().join(m.sized, ["place", "size"]).select("place", "size", "before", "source", "target").collect():
        order[r["source"]].append((r["before"], r["place"], r["size"]))
        target[r["source"]] = r["target"]
    copies = []
    for rank, source in enumerate(sorted(order, key=lambda x: (x is None, x))):
        at = 0
        for copy in range(3):
            for before, place, size in sorted(order[source], key=lambda x: (x[0], x[2])):
                assert size == 0 or before == at - copy * sum(x[2] for x in order[source])
                at += size
                if size:
                    copies.append((at / target[source], rank, at, place, copy, size))
    left, want = sum(len(t.split()) for _, t, _ in rows), {}
    for _, _, _, place, copy, size in sorted(copies):
        if left > 0:
            want[place, copy] = min(size, left)
            left -= want[place, copy]
    entries = m.entries().collect()
    assert {(r["place"], r["copy"]): r["words"] for r in entries} == want and len(entries) == len(want)
    assert any(words < size for (_, _, _, place, copy, size) in copies for words in [want.get((place, copy), size)]) or left == 0


def test_targets_are_capped(spark):
    rows = [(1, "w " * 10, "a"), (2, "w " * 1000, "b"), (3, "w " * 20, "c"), (4, None, "d"), (5, "w " * 7, None)]
    m = mixing.Mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = {r["source"]: r["target"] for r in m.sources.collect()}
    # a, b, c, d, null weigh 1, 2, 3, 1, 2; all but b are capped at three times their words
    assert got == {"a": 30.0, "b": pytest.approx(1037 - 30 - 60 - 21), "c": 60.0, "d": 0.0, None: 21.0}


# --- sharding ---


def check_shards(df, texts, shards=16):
    rows = df.collect()
    assert len(rows) == len(texts)
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        groups[r["crc32"]].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in groups.values())
    assert set(slots) <= set(range(shards))
    assert Counter((r["id"], r["size"], r["crc32"]) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    return load


def test_sharding(edge, empty, spark, data):
    check_shards(sharding.KdShards(edge).assigned(), PAIRS)
    assert sharding.KdShards(empty).assigned().count() == 0
    rows = [(i, "word " * (1 + (i * 37) % 50) + str(i), "en", f"s{i % 7}") for i in range(4000)]
    load = check_shards(sharding.KdShards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).assigned(), [(r[0], r[1]) for r in rows])
    assert len(load) == 16 and max(load.values()) < 1.03 * min(load.values())
    with pytest.raises(ValueError):
        sharding.KdShards(edge, shards=12)


def test_splits_against_a_plain_tree(spark):
    """Each node is cut along its widest dimension, nearest to the half of its
    bytes that a cut between two of its points can be (within the tolerance)."""
    rng = random.Random(8)
    rows = [(i * 3, "x" * rng.randrange(1, 4000) + str(i), rng.choice(["en", "de"]), f"s{rng.randrange(4)}") for i in range(500)] + [(9000 + i, "copy", "en", "s1") for i in range(40)]
    k = sharding.KdShards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=8, tolerance=0.0)
    leaf = {r["point"]: r["node"] for r in k.build().collect()}
    points = [r.asDict() for r in k.points.collect()]
    assert len(points) == 501 and sum(p["w"] for p in points) == sum(len(r[1]) + 1 for r in rows)
    root = {d: max(1, max(p[d] for p in points) - min(p[d] for p in points)) for d in sharding.DIMENSIONS}
    at = {p["point"]: 0 for p in points}
    for level in range(3):
        for node in range(2**level):
            own = [p for p in points if at[p["point"]] == node and leaf[p["point"]] >> (3 - level) == node]
            wide = {d: (max(p[d] for p in own) - min(p[d] for p in own)) / root[d] for d in sharding.DIMENSIONS}
            dim, _ = k.tree[level][node]
            assert wide[dim] == max(wide.values())
            left = [p for p in own if leaf[p["point"]] >> (2 - level) == 2 * node]
            right = [p for p in own if leaf[p["point"]] >> (2 - level) == 2 * node + 1]
            assert len(left) + len(right) == len(own) and max(p[dim] for p in left) <= min(p[dim] for p in right)
            total, lw = sum(p["w"] for p in own), sum(p["w"] for p in left)
            assert abs(2 * lw - total) <= max(p["w"] for p in own)
        at = {p["point"]: leaf[p["point"]] >> (2 - level) for p in points}


# --- language ---


def test_language(edge, empty, spark, data):
    docs = common.documents(spark, "/root/testdata/sf0.01")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    got = language_id.predict(docs, model).filter(language_id.held_out() & F.col("lang_pred").isin(model.languages))
    right = got.filter("lang = lang_pred").count() / got.count()
    assert right > 0.98
    print("held-out accuracy", right)
    odd = language_id.predict(edge, model)
    assert odd.columns == [*edge.columns, "lang_pred_", "score_"]
    for r in odd.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred_"] == "und") == (not letters) and 0 <= r["score_"] <= 1
    assert language_id.predict(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert {r["lang_pred_"] for r in language_id.predict(edge, nothing).collect()} == {"und"}


def test_too_many_languages_are_refused(spark):
    docs = spark.createDataFrame([(la, f"some words {la}") for la in ("de", "en", "fr")], "lang string, text string")
    assert language_id.fit(docs, most_languages=3).languages == ["de", "en", "fr"]
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(docs, most_languages=2)


def test_the_worst_fit_moves_smoothly(spark):
    """From the least fit that there can be with no row, by less and less, and with
    no jump at any number of rows; the model's formula, row by row."""
    docs = common.documents(spark, "/root/testdata/sf0.01")
    model = language_id.fit(docs)
    limit = lambda n, low=0.2: language_id.worst_fit(spark.createDataFrame([(0.5 if i % 50 else low,) for i in range(n)], "f double"), "f", model)
    floor = min(x.min() - u for x, u in zip(model.log_p, model.usual, strict=True))
    assert limit(0) == pytest.approx(floor)
    steps = [limit(n) for n in (0, 2, 10, 98, 99, 100, 101, 102, 2000)]
    assert all(a < b for a, b in zip(steps, steps[1:], strict=False))
    assert steps[5] - steps[4] < 0.1 and steps[4] == pytest.approx((99 * (0.5 - 8 * 0.3) + 50 * floor) / 149)
    assert limit(2000) == pytest.approx(0.5 - 8 * 0.3, abs=0.4)


def test_mixtures_are_found(spark):
    docs = common.documents(spark, "/root/testdata/sf0.01")
    model = language_id.fit(docs)
    own = {r["lang"]: r["text"] for r in docs.filter("n_chars between 1500 and 4000").select("lang", "text").collect()}
    both = spark.createDataFrame([(1, own["fr"] + " " + own["en"][: len(own["fr"]) // 3]), (2, own["fr"])], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(both, model).collect()}
    assert got[1][0] == "fr" and 0.5 < got[1][1] < 0.95 and got[2] == ("fr", pytest.approx(1.0, abs=0.02))


def plain_mixture(model, text):
    """(value, proportions) of the best set among those of the 1, 2, .. most
    present languages, word by word, all sizes tried."""
    words = [w for w in brute.words(text) if any(c.isalpha() for c in w)]
    like = np.array([[sum(model.log_p[i][g] for g in language_id.trigrams([w.encode()], model.log_p.shape[1])[0]) for i in range(len(model.languages))] for w in words])
    top = like.max(1)
    shares = np.exp(like - top[:, None])

    def em(allowed):
        p = allowed / allowed.sum()
        for _ in range(model.steps):
            each = shares * p
            p = (each / each.sum(1, keepdims=True)).mean(0)
        return p, (np.log((shares * p).sum(1)) + top).sum()

    every, _ = em(np.ones(len(model.languages)))
    by = np.argsort(-every, kind="stable")
    found = []
    for k in range(1, len(by) + 1):
        allowed = np.isin(np.arange(len(by)), by[:k]).astype(float)
        p, value = em(allowed)
        found.append((value - k * model.penalty * np.log(len(words) + 1), p))
    return max(found, key=lambda x: x[0])


def test_mixture_is_the_best_of_all_sizes(spark):
    """Texts of one to four languages and words of none, against all sizes."""
    docs = common.documents(spark, "/root/testdata/sf0.01")
    model = language_id.fit(docs)
    own = {r["lang"]: r["text"].split() for r in docs.filter("n_chars between 1500 and 4000").select("lang", "text").collect()}
    rng, texts = random.Random(2), []
    for _ in range(40):
        langs = rng.sample(sorted(own), rng.randrange(1, len(own) + 1))
        texts.append(" ".join(w for la in langs for w in own[la][: rng.randrange(5, 200)]) + " xq zzk" * rng.randrange(3))
    names, scores, _, mixtures = model.predict(pa.array(texts))
    several = 0
    for text, name, score, mixture in zip(texts, names, scores, mixtures, strict=True):
        _, p = plain_mixture(model, text)
        assert name == model.languages[int(np.argmax(p))] and score == pytest.approx(p.max(), abs=1e-6)
        assert {m["lang"]: pytest.approx(m["share"], abs=1e-6) for m in mixture} == {la: x for la, x in zip(model.languages, p.tolist(), strict=True) if x > 0}
        several += len(mixture) > 3
    assert several


# --- quality ---


def test_quality(edge, empty):
    got = quality_rules.judge(edge).collect()
    want = Counter((r[0], len(brute.words(r[1])), sum(map(len, brute.words(r[1])))) for r in EDGE)
    assert Counter((r["id"], r["n_words"], r["word_chars"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    lines = next(r for r in got if r["id"] == 13)
    assert (lines["n_lines"], lines["n_dup_lines"]) == (9, 8)
    assert quality_rules.judge(empty).count() == 0


def test_quality_thresholds_follow_the_data(spark):
    clean = [(i, " ".join(f"word{(i * 7 + j) % 900}" for j in range(80)), "en", "a") for i in range(300)]
    junk = [(1000 + i, " ".join(f"word{(i * 11 + j) % 900}###" for j in range(80)), "en", "a") for i in range(5)]
    kinds = "doc_id long, text string, lang string, source string"
    kept = {r["id"] for r in quality_rules.judge(spark.createDataFrame(clean + junk, kinds)).filter("kept").collect()}
    assert kept == {c[0] for c in clean}
    every = spark.createDataFrame([(i, t + "###", la, s) for i, t, la, s in junk * 60], kinds)
    assert quality_rules.judge(every).filter("kept").count() == 300  # where all have symbols they are no reason


def test_quality_thresholds_move_towards_the_level_above(spark):
    """A large group keeps its own, a small one is near its language's, and that
    of a rare language near those of all."""
    text = lambda i, n: " ".join(f"{'w' * n}{(i * 7 + j * 3) % 900}" for j in range(80))
    groups = [("en", "a", 4, 2000), ("en", "b", 9, 2000), ("en", "c", 20, 5), ("de", "a", 15, 3)]
    rows = [(g * 10_000 + i, text(i, n), la, so) for g, (la, so, n, m) in enumerate(groups) for i in range(m)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    figures = quality_rules.base_figures(df, "doc_id", "text", "lang", "source")
    sketch = quality_rules.sketches(figures)
    t = {(r["lang"], r["source"]): r["hi"] for r in quality_rules.thresholds(sketch, 50, 3.0).filter("rate = 'length'").collect()}
    assert t["en", "a"] < 9000 < t["en", "b"] < 13_500  # of their own words, not those of the other
    own = {(r["lang"], r["source"]): r["hi"] for r in quality_rules.thresholds(sketch, 0, 3.0).filter("rate = 'length'").collect()}
    assert own["en", "c"] > 22_000 and own["de", "a"] > 17_000  # without a prior: their own words only
    assert t["en", "c"] != own["en", "c"] and t["de", "a"] != own["de", "a"] and t["en", "c"] != t["de", "a"]


def test_quality_has_no_fixed_cutoff(spark):
    """A tenth of the lines repeated: junk where none are usual, usual elsewhere."""
    text = lambda i, again: "\n".join(" ".join(f"word{(i * 7 + j * 9 + k) % 900}" for k in range(9)) for j in [*range(10 - again), *range(again)])
    rows = [(i, text(i, int(i >= 300)), "en", "a") for i in range(310)] + [(1000 + i, text(i, i % 3), "de", "b") for i in range(310)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["id"] for r in quality_rules.judge(df, prior=1).filter("kept").collect()}
    assert kept == {r[0] for r in rows} - set(range(300, 310))


# --- lines ---


def test_lines(edge, empty, spark):
    rows = line_dedup.LineDedup(edge).documents().collect()
    assert len(rows) == len(EDGE)
    by = {r["id"]: r for r in rows}
    assert by[3]["kept"] is None and by[13]["n_dropped"] == 0 and by[12]["n_dropped"] == 1 and by[8]["n_dropped"] == 0 and by[7]["n_dropped"] == 0
    assert line_dedup.LineDedup(empty).documents().count() == 0


def test_templates(spark):
    rows = [(i, f"own words of document number {'abcdefgh'[i]} only\nuser {i * 7} logged in from host h{i} today\nconnection to server {'pqrstuvw'[i]} was lost again today\nshort line\nno {i}") for i in range(8)]
    got = {r["id"]: (r["kept"], r["n_dropped"]) for r in line_dedup.LineDedup(spark.createDataFrame(rows, "doc_id long, text string")).documents().collect()}
    assert got[0] == (rows[0][1], 0)
    for i in range(1, 8):
        assert "logged in" not in got[i][0] and "was lost" not in got[i][0] and "short line" not in got[i][0] and got[i][0].endswith(f"no {i}")


def test_very_many_lines(spark):
    """Linear in the lines, however many are dropped."""
    text = "\n".join(f"this is the line number {i} of a long text x{i}y" for i in range(160_000)) + "\nan own last line of text"
    df = spark.createDataFrame([(1, text), (2, text.replace("an own last", "another very last")), (3, "short")], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.LineDedup(df).documents().collect()}
    assert got[1] == (160_001, 0) and got[2][0] == 160_001 and got[2][1] >= 160_000 and time.perf_counter() - began < 120  # squares of the lines would take hours


def test_short_lines(spark):
    rows = [(1, "All rights reserved.\nLes.\n\n7\nnot here"), (2, " All  rights reserved.\nLes.\n\n8\nbut here"), (3, None), (4, "Les.\nLes.\n \n7")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["kept"], r["n_dropped"]) for r in line_dedup.LineDedup(df).documents().collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\n8\nbut here", 2), 3: (None, 0), 4: (" ", 3)}


def test_lines_of_three_to_five_words(spark):
    """A field needs a word that the tree's depth leaves: the fourth is one."""
    rows = [(i, f"by user {i}\nPosted by user {i}\nPosted by the user {i}\nnothing in here {'abc'[i % 3]}") for i in range(1, 7)]
    got = {r["id"]: r["kept"] for r in line_dedup.LineDedup(spark.createDataFrame(rows, "doc_id long, text string")).documents().collect()}
    assert got == {1: rows[0][1]} | {i: f"by user {i}" for i in range(2, 7)}


@pytest.mark.parametrize("second", [4, 3])
def test_several_templates_in_a_leaf(spark, second):
    """Lines of eight words that begin alike: two templates, two more that only
    their end tells apart, and unrelated lines."""
    names = ["ann", "bob", "cas", "dot", "eva", "fay", "gus", "hal"]
    lines = [f"posted by user on board {n} in spring" for n in names[:4]] + [f"posted by user from town {n} last night" for n in names[4 : 4 + second]]
    ends = [f"seen at gate {n} with the red flag" for n in names[:4]] + [f"seen at gate {n} under a blue sky" for n in names[4:]]
    other = ["posted by user " + " ".join(f"{n}{c}" for c in "vwxyz") for n in names]
    rows = list(enumerate(lines + other + ends))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["n_dropped"] for r in line_dedup.LineDedup(df).documents().collect()}
    first = len(lines + other)
    kept = {0, 4, *range(len(lines), first), first, first + 4}
    assert got == {i: int(i not in kept) for i, _ in rows}


def plain_lines(rows, depth=3, share=0.5, similar=0.6):
    """{doc_id: lines dropped}, leaf by leaf."""
    seen = defaultdict(lambda: defaultdict(list))
    for d, t in rows:
        for line in [] if t is None else t.split("\n"):
            own = brute.words(line)
            ws = tuple("<*>" if any(c in "0123456789" for c in w) else w for w in own)
            if ws:
                seen[(len(ws), *ws[:depth]) if len(ws) > depth else tuple(own)][ws if len(ws) > depth else tuple(own)].append(d)
    dropped = Counter()
    for leaf in seen.values():
        left, of = [x for x in leaf if len(x) > depth], {x: x for x in leaf}
        for key in (lambda x: 0, lambda x: x[depth], lambda x: x[-1]):
            parts = defaultdict(list)
            for x in left:
                parts[key(x)].append(x)
            left = []
            for part in parts.values():
                counts = Counter((i, w) for x in part for i, w in enumerate(x))
                for x in part:
                    held = tuple(w if w != "<*>" and counts[i, w] > len(part) * share else None for i, w in enumerate(x))
                    if len(part) > 1 and sum(w is not None for w in held) >= len(x) * similar:
                        of[x] = ("T", *held)
                    else:
                        left.append(x)
        first = {}
        for x, ds in leaf.items():
            first[of[x]] = min(first.get(of[x], float("inf")), *[d for d in ds if d is not None], float("inf"))
        for x, ds in leaf.items():
            for d in ds:
                dropped[d] += d is not None and first[of[x]] < d
    return dropped


def test_lines_against_a_plain_tree(spark):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "x1", "22", "omega"]
    rows = [(i, "\n".join(" ".join(rng.choice(words[: rng.randrange(2, 8)]) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 9)))) for i in range(120)] + [(None, "alpha alpha"), (500, None)]
    want = plain_lines(rows)
    got = {r["id"]: r["n_dropped"] for r in line_dedup.LineDedup(spark.createDataFrame(rows, "doc_id long, text string")).documents().collect()}
    assert got == {d: want[d] for d, _ in rows} and sum(got.values()) > 100


# --- toxicity ---


def test_toxicity(edge, empty, spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    chain = toxicity.fit(docs, labels.filter(half), ["quality", "toxic"])
    got = toxicity.score(docs, chain).join(labels.filter(~half), F.col("id") == F.col("doc_id")).collect()
    toxic = [r for r in got if r["toxic"]]
    assert sum(r["is_toxic"] for r in toxic) >= 0.9 * len(toxic)
    assert sum(r["is_toxic"] and not r["toxic"] for r in got) <= 0.012 * len(got)
    odd = toxicity.score(edge, chain).collect()
    assert len(odd) == len(EDGE)
    assert all(r["p_toxic"] == 0.0 and not r["is_toxic"] for r in odd if r["id"] in (3, 4, 5))
    assert toxicity.score(empty, chain).count() == 0
    none = toxicity.fit(empty, labels.filter("doc_id < 0"), ["quality", "toxic"])
    assert {r["is_toxic"] for r in toxicity.score(edge, none).collect()} == {False}


def test_copies_share_a_fold_and_ties_have_an_order(spark):
    """Every text is there twice: with copies in other folds the random labels
    would be told from them."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(30)) for _ in range(200)]
    labels = [rng.randrange(2) for _ in texts]
    docs = [(i, texts[i % 200]) for i in range(400)]
    kinds = "doc_id long, text string"
    chain = toxicity.fit(spark.createDataFrame(docs, kinds), spark.createDataFrame([(i, labels[i % 200]) for i in range(400)], "doc_id long, a int"), ["a"], least_z=0.5)
    same_again = toxicity.fit(spark.createDataFrame(docs[::-1], kinds).repartition(3), spark.createDataFrame([(i, labels[i % 200]) for i in range(400)], "doc_id long, a int"), ["a"], least_z=0.5)
    assert chain.models[0].words.tolist() == same_again.models[0].words.tolist() and chain.thresholds == same_again.thresholds
    p = np.array([0.2, 0.7, 0.7, 0.7, 0.1])
    assert toxicity.best_threshold(p, np.array([0, 1, 1, 0, 0])) == pytest.approx(0.45)


def test_linear_model_against_plain_descent():
    """The ridge solution has no slope left, by sums over all rows and words."""
    rng = np.random.default_rng(3)
    n, size = 120, 40
    x = (rng.random((n, size)) < 0.2).astype(float)
    y = (x[:, 0] + x[:, 1] + rng.random(n) > 0.9).astype(float)
    doc, code = np.nonzero(x)
    m = toxicity.fit_linear(doc, code, n, y, np.zeros((n, 0)), size, 300, 0.3, 0.0)
    for i, w in enumerate(m.words.tolist()):
        slope = sum(x[r, w] * (y[r] - 1 / (1 + np.exp(-(m.intercept + sum(m.weights[j] for j, v in enumerate(m.words.tolist()) if x[r, v]))))) for r in range(n))
        assert slope == pytest.approx(0.3 * m.weights[i], abs=1e-3)
    chain = toxicity.Chain(["a"], size, [m], [0.5])
    assert m.raw(doc, code, n, np.zeros((n, 0)), size)[0] == pytest.approx(m.intercept + sum(m.weights[j] for j, v in enumerate(m.words.tolist()) if x[0, v])) and chain.size == size


def test_chain_feeds_earlier_categories(spark):
    """The second category is the first one's; only its probability tells."""
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("abcdefghij") * 3 for _ in range(12)) + (" mark" if i % 3 == 0 else "")) for i in range(400)]
    labels = [(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(400)]
    chain = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, a int, b int"), ["a", "b"])
    assert chain.models[1].weights[-1] > 0.2 and len(chain.models[0].weights) == len(chain.models[0].words)




def generated(plan) -> list[int]:
    """Rows that each Generate of an executed plan made."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return generated(plan.executedPlan())
    below = [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if kind == "GenerateExec" else []
    return own + [n for x in below for n in generated(x)]


def test_sets_with_the_same_members_are_dealt_at_one_of_them(spark, monkeypatch):
    """200 sets at 8 members: a component, whose root isn't the least, and sets of their own."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    key = F.unhex(F.lpad(F.hex("id"), 32, "0"))
    sets = spark.range(200).select(key.alias("key"), F.lit(50).alias("n"), *[F.lit(0).cast("long").alias(c) for c in ngram_join.SKETCH])
    posts = sets.crossJoin(spark.range(8).select(F.col("id").alias("member"))).withColumns({"blocks": F.lit(1), "block": F.lit(0)})
    posts = posts.join(posts.groupBy("key").agg(F.sort_array(F.collect_list(ngram_join.place())).alias("first")), "key")
    roots = spark.range(200).select(key.alias("key"), F.when(F.col("id") >= 100, F.unhex(F.lit("f" * 32))).otherwise(key).alias("root"))
    pairs = ngram_join.NgramJaccardJoin(spark.createDataFrame([], "doc_id long, text string"))._pairs(posts, roots, 3, True)
    found = {(bytes(r.a), bytes(r.b)) for r in pairs.collect()}
    ids = [i.to_bytes(16, "big") for i in range(200)]
    assert found == {(a, b) for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j and i < 100}
    made = generated(pairs._jdf.queryExecution().executedPlan())
    assert made and max(made) <= 2 * 8 * 200, made
