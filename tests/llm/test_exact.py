"""Operators 2, 4, 5, 8 and 10 against brute force on small fixtures with hard cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import queries, substrings, suffixes
from foliospark.llm.components import component_labels
from foliospark.llm.common import Scratch, rolling, sliding_min
from foliospark.llm.decontaminate import drop_contaminated, find_contamination
from foliospark.llm.fingerprints import fingerprint_edits
from foliospark.llm.simhash import drop_near_duplicates, fingerprints, forest, near_duplicates
from foliospark.llm.substrings import drop_repeated_windows
from foliospark.llm.suffixes import drop_repeated_bytes, merge_transforms, sorted_suffixes


def corpus(seed=3, n=40):
    """Random words with shared passages, copies, repeats, empty, null, equal and missing ids."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "γάμμα", "d", "ee", "über"]) + str(rng.randrange(300))
    text = lambda k: " ".join(word() for _ in range(k))
    passage, other = text(70), text(60)
    rows = [(i, text(rng.randrange(0, 120)) + rng.choice(["", " " + passage, "\n" + other + " " + passage]) + " " + text(rng.randrange(0, 40))) for i in range(n)]
    rows += [(n, rows[3][1]), (n + 1, rows[3][1] + " tail"), (n + 2, ""), (n + 3, None), (n + 4, "x " * 500), (n + 5, "x " * 700), (None, passage), (n + 6, passage), (n + 6, passage + " more"), (n + 7, " \t\n ")]
    return rows


def removed(rows, items, size):
    """Items and marks of each row by the rule: windows that start in a row of smaller id too."""
    order = lambda i: (i is None, i or 0)
    own = {}
    for i, t in rows:
        seq = items(t)
        for k in range(len(seq) - size + 1):
            key = tuple(seq[k : k + size])
            own[key] = min(own.get(key, order(i)), order(i))
    out = []
    for i, t in rows:
        seq = items(t)
        gone = [False] * len(seq)
        for k in range(len(seq) - size + 1):
            if own[tuple(seq[k : k + size])] < order(i):
                gone[k : k + size] = [True] * size
        out.append((i, seq, gone))
    return out


@pytest.mark.parametrize("hot", [1000, 2])
def test_word_windows(spark, docs, hot):
    rows = corpus()
    got = drop_repeated_windows(docs(rows).withColumn("marks", F.lit(1)), hot=hot).collect()
    want = [(i, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest()) for i, w, g in removed(rows, lambda t: (t or "").encode().split(), 50)]
    assert sorted(map(str, ((r[0], r[1], r[2], r[3]) for r in got))) == sorted(map(str, want))


@pytest.mark.parametrize("hot", [1000, 2])
def test_byte_windows(spark, docs, hot):
    rows = corpus(5, 25)
    got = drop_repeated_bytes(docs(rows), hot=hot).collect()
    want = []
    for i, b, g in removed(rows, lambda t: (t or "").encode(), 50):
        spans = sum(1 for a, c in zip([False, *g], g) if c and not a)
        want.append((i, len(b), sum(g), spans, hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()))
    assert sorted(map(str, (tuple(r[:5]) for r in got))) == sorted(map(str, want))


def test_byte_windows_in_many_small_shards(monkeypatch, spark, docs):
    for name, value in (("SHARD_BYTES", 300), ("MERGE_BYTES", 200), ("ASK_BYTES", 500), ("SORT_BYTES", 400), ("PIECE", 90), ("PARTS", 3)):
        monkeypatch.setattr(suffixes, name, value)
    test_byte_windows(spark, docs, 2)
    test_byte_windows(spark, docs, 20_000)


def strings_with_owners(rng, window):
    strings = [bytes(rng.integers(97, 99, rng.integers(window, 2 * window + 3)).astype(np.uint8)) for _ in range(rng.integers(3, 30))]
    return strings, rng.integers(0, 12, len(strings))


def shard_of(strings):
    data = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    return data, np.cumsum([len(s) + 1 for s in strings])


def test_minimisers_keep_their_order_in_any_number_of_buckets(monkeypatch, spark, docs):
    keys = np.random.default_rng(6).integers(0, 1 << 64, 5000, dtype=np.uint64)
    unique, counts, several, place = suffixes._distinct(np.concatenate((keys, keys[:100])), np.arange(5100))
    for buckets in (1, 3, 1 << 16, 10_000_000):
        found = suffixes._bucket(unique, buckets)
        assert (np.diff(found) >= 0).all() and found.min() >= 0 and found.max() < buckets
    assert (unique[place[:5000]] == keys).all() and counts.sum() == 5100 and several.sum() == 100
    monkeypatch.setattr(suffixes, "ASK_BYTES", 1)  # a bucket a byte: more than 2 ** 16 of them
    text = "".join(random.Random(k).choice("abcdefgh") for k in range(80_000))
    rows = {r["doc_id"]: r["n_removed"] for r in drop_repeated_bytes(docs([(1, text), (2, text[500:900] + "x" + text[70:119])])).collect()}
    assert rows == {1: 0, 2: 400}


def test_suffixes_are_sorted():
    rng = np.random.default_rng(1)
    for _ in range(40):
        strings, _ = strings_with_owners(rng, 8)
        data, ends = shard_of(strings)
        order, alike = sorted_suffixes(data, ends, 8)
        string = np.searchsorted(ends, order, side="right")
        keys = [(data[o : ends[k]].tobytes(), k) for o, k in zip(order, string)]
        assert keys == sorted(keys)
        same = [len(x) > 8 and len(y) > 8 and x[:8] == y[:8] for (x, _), (y, _) in zip(keys, keys[1:])]
        assert alike.tolist() == [k for k, x in enumerate(same, 1) if x]


def test_merged_transforms_find_every_repeat():
    rng = np.random.default_rng(2)
    for window in (8, 13, 21):
        for _ in range(40):
            strings, owner = strings_with_owners(rng, window)
            transforms, sizes, counts, tails = [], [], [], []
            for part in np.array_split(np.arange(len(strings)), 3):
                data, ends = shard_of([strings[k] for k in part])
                order, _ = sorted_suffixes(data, ends, window)
                string = np.searchsorted(ends, order, side="right")
                heads = np.concatenate(([0], ends[:-1]))
                transforms.append(np.where(order == heads[string], 255, data[order - 1]).astype(np.uint8))
                sizes.append(len(data))
                counts.append(len(part))
                tails += np.argsort(order)[ends - 1].tolist()
            found = merge_transforms(np.concatenate(transforms), np.array(sizes), np.array(counts), np.array(tails), owner, window)
            first = {}
            for s, o in zip(strings, owner):
                for i in range(len(s) - window + 1):
                    first[s[i : i + window]] = min(first.get(s[i : i + window], o), o)
            wanted = [(k, i) for k, (s, o) in enumerate(zip(strings, owner)) for i in range(len(s) - window + 1) if first[s[i : i + window]] < o]
            assert sorted(zip(*(x.tolist() for x in found))) == wanted


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    values = [simhash(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return values, [least[find(k)] for k in range(len(rows))]


def test_simhash(spark, docs):
    rows = corpus(7, 20)
    base = " ".join(f"w{k}" for k in range(300))
    rows += [(100 + k, base + f" end{k}") for k in range(60)] + [(200, "A b"), (201, "a B"), (202, "")]
    values, wanted = components(rows)
    assert [int(x) for x in fingerprints([(t or "").encode() for _, t in rows])] == values
    got = near_duplicates(docs(rows).withColumn("fp", F.lit("clash"))).collect()
    assert sorted(map(str, ((r[0], r["fp"] % (1 << 64), r[2]) for r in got))) == sorted(map(str, ((i, v, c) for (i, _), v, c in zip(rows, values, wanted))))
    kept = drop_near_duplicates(docs(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(wanted))


def test_long_runs_lose_no_link(monkeypatch, spark):
    from foliospark.llm import simhash as module

    monkeypatch.setattr(module, "SHORT", 3)
    monkeypatch.setattr(module, "LONGEST", 20)
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
    values = {int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, 3)) for c in centre for _ in range(80)}
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    scratch = Scratch(spark, "test")
    labels = {r["node"]: r["label"] for r in component_labels(module.near_links(frame, scratch, 4), scratch).collect()}
    nodes = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    for a in nodes:
        for b in nodes:
            if ((a ^ b) % (1 << 64)).bit_count() <= 4:
                assert labels.get(a, a) == labels.get(b, b)


def test_forest_spans():
    fp = np.array([0, 1, 3, 7, 3 << 40, (3 << 40) + 1], np.uint64)
    found, roots = forest(fp, 1)
    assert sorted(zip(found.tolist(), roots.tolist())) == [(1, 0), (3, 0), (7, 0), ((3 << 40) + 1, 3 << 40)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (5, 5)], "a long, b long")
    labels = {r["node"]: r["label"] for r in component_labels(edges, Scratch(spark, "test")).collect()}
    assert labels == {k: 0 for k in range(1, 51)} | {101: 100}


def contamination(rows, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [(i, {tuple(w[k : k + min(size, len(w))]) for k in range(len(w) - min(size, len(w)) + 1)}) for i, t in items if (w := words(t))]
    out = []
    for i, t in rows:
        w = words(t)
        hit, found = [False] * len(w), set()
        for item, grams in windows:
            for g in grams:
                for k in range(len(w) - len(g) + 1):
                    if tuple(w[k : k + len(g)]) == g:
                        hit[k : k + len(g)] = [True] * len(g)
                        found.add(item)
        out.append((i, len(w), sum(hit), sorted(found - {None})))
    return out


@pytest.mark.parametrize("block", [8 << 20, 200])
def test_contamination(spark, docs, block):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 3)
    items = [(k, " ".join(word() + rng.choice(["", "1"]) for _ in range(rng.choice([12, 15, 30])))) for k in range(8)]
    items += [(20, "One two three"), (21, items[0][1]), (22, None), (23, "..."), (24, "x " * 15), (25, "Ünï Cödé"), (None, items[2][1])]
    rows = [(k, " ".join(word() for _ in range(20)) + rng.choice(["", " ", "-"]) + items[k % 8][1][rng.randrange(0, 9) :].upper()) for k in range(30)]
    rows += [(40, None), (41, ""), (42, "say one, TWO; three!"), (43, "x " * 40), (44, "ünï cödé"), (44, "one two"), (None, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(docs(rows).withColumn("item_id", F.lit(1)), bench, block_bytes=block).collect()
    spans = lambda r: sum(b - a for a, b in zip(r["span_starts"], r["span_ends"]))
    want = contamination(rows, items)
    assert sorted(map(str, ((r["doc_id"], r["n_words"], spans(r), r["item_ids"]) for r in got))) == sorted(map(str, want))
    clean = drop_contaminated(docs(rows), bench, block_bytes=block)
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, _, n, _ in want if not n)


def test_empty_benchmark(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["item_ids"] for r in find_contamination(docs([(1, "a b")]), none).collect()] == [[]]


def jaccard(a, b):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints(spark, docs, sample):
    rows = sorted({i: t for i, t in sample}.items())[:120] + [(5000, ""), (5001, None), (5002, "two words"), (5003, "é" * 50), (6000, sample[0][1])]
    got = {r["doc_id"]: r for r in fingerprint_edits(docs(rows).withColumn("fingerprint", F.lit(1))).collect()}
    ordered = sorted(rows, reverse=True)
    errors = []
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [got[i]["near_edited"] - jaccard(t, edited), got[i]["near_next"] - jaccard(t, after)]
    assert got[6000]["fingerprint"] == got[rows[0][0]]["fingerprint"]
    assert np.abs(errors).mean() < 0.04 and np.abs(errors).max() < 0.25


@pytest.mark.parametrize("bucket_rows", [2048, 7])
def test_next_of_any_ids(spark, docs, bucket_rows, monkeypatch):
    from foliospark.llm import fingerprints as module

    rng = random.Random(1)
    rows = [(i, f"text {k}") for k, i in enumerate([-(2**62) - 9, 2**62 + 5, -(2**63), 2**63 - 1, 0, 1, 2, 3, *range(1000, 1040)])]
    rows += [(None, f"none {k}") for k in range(20)] + [(5, f"five {k}") for k in range(20)]
    rng.shuffle(rows)
    frame = docs(rows).select("doc_id", "text").repartition(5)
    got = module.with_next(frame, ["doc_id", "text"], lambda x: x, bucket_rows=bucket_rows).collect()
    after = {(r["doc_id"], r["text"]): (r["next"]["doc_id"], r["next"]["text"]) for r in got}
    assert len(got) == len(rows) and set(after) == set(rows)
    chain = [max((r for r in rows if r[0] is not None), key=lambda r: r[0])]
    while len(chain) < len(rows):
        chain.append(after[chain[-1]])
    assert after[chain[-1]] == chain[0] and set(chain) == set(rows)
    ids = [i for i, _ in chain]
    assert ids == sorted((i for i in ids if i is not None), reverse=True) + [None] * 20


def test_no_python_in_the_native_plan(spark, docs):
    plan = fingerprint_edits(docs([(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_tables(spark, docs):
    empty = docs([])
    for run in (drop_repeated_windows, drop_repeated_bytes, near_duplicates, drop_near_duplicates, fingerprint_edits):
        assert run(empty).count() == 0


def test_rolling_and_minimum():
    x = np.random.default_rng(0).integers(0, 1 << 60, 50).astype(np.uint64)
    assert sliding_min(x, 7).tolist() == [min(x[i : i + 7]) for i in range(44)]
    y = np.concatenate((x, x))
    for size in (1, 2, 3, 13, 50):
        h = rolling(y, size)
        assert len(h) == 101 - size and (h[: 51 - size] == h[50:]).all()
    assert not len(rolling(x, 51))


def test_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert substrings.WINDOW == suffixes.WINDOW == 50


def near_copies(rng):
    """Rows of 200 random words, and copies with one to four words changed, some of them in chains."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    rows = []
    for _ in range(30):
        base = [word() for _ in range(200)]
        for changed in (0, 1, 2, 3, 4):
            text = list(base)
            for at in rng.sample(range(5, 190), changed):
                text[at] = word()
            rows.append((len(rows), " ".join(text)))
    return rows


def test_the_stage_drops_near_copies_of_jaccard_80(spark, docs):
    import corpus_pipeline

    rows = near_copies(random.Random(9)) + corpus(7, 20)
    rows = [(k if i is not None else None, t) for k, (i, t) in enumerate(rows)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if jaccard((rows[a][1] or "").lower(), (rows[b][1] or "").lower()) >= 0.8:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    wanted = {find(k) for k in range(len(rows))}
    kept = corpus_pipeline.near_dedup(spark, docs(rows), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(rows[k][0]) for k in wanted)


@pytest.mark.parametrize("block_bytes", [1 << 19, 1 << 10])
def test_a_split_band_loses_no_link(spark, monkeypatch, block_bytes):
    """One band holds sets like and unlike each other, each a component of its own but two."""
    from foliospark.llm import jaccard as module

    monkeypatch.setattr(module, "BLOCK_BYTES", block_bytes)
    rng = random.Random(4)
    sets = []
    for size in (4, 9, 30, 100):
        for _ in range(5):
            base = set(rng.sample(range(1 << 32), size))
            for changed in range(4):
                sets.append(np.array(sorted((base - set(rng.sample(sorted(base), changed))) | set(rng.sample(range(1 << 32), changed // 2))), np.uint32))
    rows = [(5, k, k if k else 1, bytearray(x.tobytes())) for k, x in enumerate(sets)]
    frame = spark.createDataFrame(rows, "key long, fp long, root long, shingles binary")
    links = [(r["a"], r["b"]) for r in module.split_links(frame.select("key", "fp", "root"), frame.select("fp", "shingles")).collect()]
    assert all(module.similar(sets[a].tobytes(), sets[b].tobytes()) for a, b in links)

    def components(edges):
        label = list(range(len(sets)))
        for a, b in [(0, 1), *edges]:
            label = [label[a] if x == label[b] else x for x in label]
        return len(set(label)), [label.index(x) for x in label]

    every = [(a, b) for a in range(len(sets)) for b in range(a) if module.similar(sets[a].tobytes(), sets[b].tobytes())]
    assert components(links) == components(every)
    assert len(every) > 60


def test_clean_rows_of_null_and_equal_ids_stay(spark, docs):
    rng = random.Random(2)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(80)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4]), (None, texts[4]), (9, texts[5]), (9, texts[5])]
    wanted = sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4]), (9, texts[5])], key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in drop_near_duplicates(docs(rows)).collect()), key=str) == wanted


def test_covered_runs_are_those_of_the_bytes():
    import random

    import numpy as np

    from foliospark.llm.suffixes import _covered

    dice = random.Random(5)
    for _ in range(200):
        spans = [(dice.randrange(60), dice.randrange(1, 9)) for _ in range(dice.randrange(1, 12))]
        covered = {i for a, n in spans for i in range(a, a + n)}
        plain = [(a, next(b for b in range(a, 99) if b not in covered)) for a in sorted(covered) if a - 1 not in covered]
        assert _covered(np.array([a for a, _ in spans]), np.array([n for _, n in spans])) == plain


@pytest.mark.parametrize("short, piece_rows", [(32, 50_000), (1, 10)])
def test_the_stage_meets_sets_by_deletion_variants(spark, monkeypatch, short, piece_rows):
    """Fingerprints meet where one segment differs by one bit, not where all differ by two; a tree names its smallest member."""
    from foliospark.llm import jaccard as module

    monkeypatch.setattr(module, "SHORT", short)
    monkeypatch.setattr(module, "PIECE_ROWS", piece_rows)
    rng = random.Random(6)
    size, rows, wanted = module.SEGMENT, [], set()
    for case in range(40):
        base = rng.getrandbits(64 * module.WORDS)
        near = base
        for segment in range(64 * module.WORDS // size):
            for bit in rng.sample(range(size), 1 if case % 2 and segment == case else 2):
                near ^= 1 << (segment * size + bit)
        rows += [(2 * case, bytearray(base.to_bytes(8 * module.WORDS, "little"))), (2 * case + 1, bytearray(near.to_bytes(8 * module.WORDS, "little")))]
        wanted |= {(2 * case, 2 * case + 1)} if case % 2 else set()
    rows += [(100 + k, rows[0][1]) for k in range(5)] + [(200, None)]
    wanted |= {(0, 100 + k) for k in range(5)}
    got = module.near_trees(spark.createDataFrame(rows, "fp long, bits binary")).collect()
    assert {(r["a"], r["b"]) for r in got} == wanted and len(got) == len(wanted)


def _components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {x: find(x) for x in parent}


def test_a_large_group_makes_few_edges_a_member(spark):
    """Members that meet in many runs, each run with a smallest member of its own, stay one tree of few edges."""
    from foliospark.llm import jaccard as module

    rng = np.random.default_rng(8)
    base = rng.random(64 * module.WORDS) < 0.5
    flips = rng.random((600, len(base))) < 0.05
    ids = rng.permutation(1 << 20)[: len(flips)]
    rows = [(int(i), bytearray(np.packbits(base ^ f, bitorder="little").tobytes())) for i, f in zip(ids, flips, strict=True)]
    got = [(r["a"], r["b"]) for r in module.near_trees(spark.createDataFrame(rows, "fp long, bits binary")).collect()]
    assert _components(got) == {int(i): int(ids.min()) for i in ids}
    assert len(got) == len(set(got)) <= (module.KEPT + 1) * len(ids)


def test_thinned_edges_have_the_same_components(spark):
    from foliospark.llm import jaccard as module

    rng = random.Random(12)
    edges = {tuple(sorted(rng.sample(range(k * 1000, k * 1000 + size), 2))) for k, (size, n) in enumerate([(90, 2500), (40, 60), (300, 280), (2, 1)]) for _ in range(n)}
    edges |= {(-x, 5000 + x) for x in range(1, 30)} | {(a, 6000) for a in range(5900, 5990)}
    got = [(r["a"], r["b"]) for r in module.thinned(spark.createDataFrame(sorted(edges) * 2, "a long, b long")).collect()]
    assert all(a < b for a, b in got) and len(got) == len(set(got)) < len(edges)
    assert _components(got) == _components(edges)


def test_a_piece_sends_one_edge_a_member():
    import pyarrow as pa

    from foliospark.llm import jaccard as module

    rng = np.random.default_rng(8)
    base = rng.random(64 * module.WORDS) < 0.5
    bits = [np.packbits(base ^ (rng.random(len(base)) < 0.05), bitorder="little").tobytes() for _ in range(300)]
    rows = pa.RecordBatch.from_pydict({"fp": pa.array(range(300), pa.int64()), "bits": pa.array(bits, pa.binary())})
    halves = pa.Table.from_batches(list(module._halves(iter([rows])))).sort_by("key")
    got = [(r["a"], r["b"]) for batch in module._trees(iter(halves.combine_chunks().to_batches())) for r in batch.to_pylist()]
    assert sorted(got) == [(0, k) for k in range(1, 300)]


def test_sets_of_jaccard_80_meet():
    from foliospark.llm import jaccard as module

    rng = np.random.default_rng(3)
    for shared, left, right in [(4, 0, 1), (5, 0, 1), (8, 1, 1), (16, 0, 4), (80, 10, 10), (320, 40, 40)]:
        words = 2 * module.WORDS if shared + right <= module.SMALL else module.WORDS
        both = [rng.integers(0, 1 << 63, shared, dtype=np.uint64) for _ in range(200)]
        x, y = (module.wide_fingerprints([np.concatenate([s, rng.integers(0, 1 << 63, n, dtype=np.uint64)]) for s in both], words) for n in (left, right))
        bits = np.unpackbits((x ^ y).view(np.uint8), axis=1, bitorder="little")
        count = 64 * words // module.SEGMENT
        met = (bits[:, : count * module.SEGMENT].reshape(200, count, -1).sum(2) <= 1).any(1) & (bits[:, :128].sum(1) <= module.MAX_BITS)
        assert met.mean() > 0.99
