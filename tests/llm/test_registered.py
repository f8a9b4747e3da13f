"""The registered queries over a whole small folder, against plain versions of what they have to return."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash

from foliospark.llm import queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    """Texts by doc_id: shared passages, copies, near copies, secrets, personal data, empty, null and long ones."""
    rng = random.Random(12)
    word = lambda: rng.choice(["alpha", "Beta", "γάμμα", "d", "it's", "Größe", "x-y_z"]) + str(rng.randrange(400))
    text = lambda k: " ".join(word() for _ in range(k))
    passage, benchmark = text(75), text(14)
    rows = [text(rng.randrange(0, 90)) + rng.choice(["", "\n" + passage, " " + benchmark]) + " " + text(rng.randrange(5, 30)) for _ in range(36)]
    rows += [rows[4], rows[5] + " end", "", None, " \t\n", "same " * 300, text(3), benchmark, text(4500)]
    rows += ["password = 'hunter22' API_KEY:abc token=12345", "AKIA" + "A1" * 10 + " " + "0a" * 13 + " akia " + "ab" * 11, "card 4111 1111 1111 1111, mail ann@example.org", "again 4111 1111 1111 1111 and ANN@example.org"]
    ids = rng.sample(range(1, 500), len(rows))
    return dict(zip(ids, rows, strict=True)), [benchmark, text(6), passage[:0], None, "Alpha1"]


@pytest.fixture(scope="module")
def folder(texts, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows, items = texts
    ids = pd.array(list(rows), "Int64")
    pd.DataFrame({"doc_id": ids, "text": list(rows.values()), "lang": "en", "source": "s", "n_chars": 0}).to_parquet(path / "documents.parquet")
    pd.DataFrame({"doc_id": ids, "toxic": [i % 3 == 0 for i in rows], "lang": "en"}).astype({"toxic": "int32"}).to_parquet(path / "labels.parquet")
    pd.DataFrame({"item_id": np.arange(len(items)), "text": items}).to_parquet(path / "benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def got(spark, folder):
    """The rows of a query by doc_id (one row a document)."""

    def run(name):
        rows = queries.QUERIES[name](spark, folder).collect()
        assert len({r["doc_id"] for r in rows}) == len(rows)
        return {r["doc_id"]: r.asDict() for r in rows}

    return run


def raw(text):
    return (text or "").encode()


def covered(units):
    """For each id the flags of units inside a run of 50 that also starts in a document of smaller id."""
    first, flags = {}, {}
    for i in sorted(units):
        u = units[i]
        flags[i] = np.zeros(len(u), bool)
        for a in range(len(u) - 49):
            if first.setdefault(tuple(u[a : a + 50]), i) < i:
                flags[i][a : a + 50] = True
    return flags


def test_op2(got, texts):
    units = {i: raw(t) for i, t in texts[0].items()}
    found, wanted = got("op2_suffix_array_dedup"), covered(units)
    assert found.keys() == units.keys() and sum(f.sum() for f in wanted.values()) > 1000
    for i, flags in wanted.items():
        kept = bytes(b for b, f in zip(units[i], flags, strict=True) if not f)
        spans = int((flags & ~np.concatenate(([False], flags[:-1]))).sum()) if len(flags) else 0
        assert found[i] == {"doc_id": i, "n_bytes": len(units[i]), "n_removed": int(flags.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()}


def test_op4(got, texts):
    units = {i: WORD.findall(raw(t)) for i, t in texts[0].items()}
    found, wanted = got("op4_substring_dedup"), covered(units)
    assert found.keys() == units.keys() and sum(f.sum() for f in wanted.values()) > 200
    for i, flags in wanted.items():
        kept = b" ".join(w for w, f in zip(units[i], flags, strict=True) if not f)
        assert found[i] == {"doc_id": i, "n_words": len(units[i]), "n_removed": int(flags.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()}


def test_op5(got, texts):
    prints = {}
    for i, t in texts[0].items():
        words = WORD.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), raw(t)))
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[a : a + 4]), 42) for a in range(max(1, len(words) - 3))] if words else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            root[i] = min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4)
    wanted = {i: {"doc_id": i, "fingerprint": f"{prints[i]:016x}", "component_id": root[i]} for i in prints}
    assert got("op5_simhash_near_dedup") == wanted and len(set(root.values())) < len(root)


def test_op6(spark, folder, texts):
    from tokenizers import Tokenizer

    model, wanted, sizes = Tokenizer.from_file(queries.tokenizer_path()), {}, []
    for i, t in texts[0].items():
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            piece = ids[a : a + 4096]
            wanted[i, k] = (a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))
            sizes.append(len(piece))
    rows = queries.op6_best_fit_packing(spark, folder).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == wanted and len(rows) == len(wanted)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        ends = np.cumsum([n for _, n in sorted(parts)]).tolist()
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
    room: list = []
    for n in sorted(sizes, reverse=True):  # plain best fit over all pieces
        fits = [k for k, left in enumerate(room) if left >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(4096 - n)
    assert len(bins) <= len(room)


def test_op7(got, texts):
    found = got("op7_toxicity")
    assert found.keys() == texts[0].keys()
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op8(got, texts):
    of = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), raw(t)))
    windows = [(k, tuple(w[a : a + 10])) for k, w in enumerate(map(of, texts[1])) if w for a in range(max(1, len(w) - 9))]
    found = got("op8_decontamination")
    for i, t in texts[0].items():
        words, hit, items = of(t), set(), set()
        for k, window in windows:
            for a in range(len(words) - len(window) + 1):
                if tuple(words[a : a + len(window)]) == window:
                    hit.update(range(a, a + len(window)))
                    items.add(str(k))
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert found[i] == {"doc_id": i, "n_words": len(words), "n_hit": len(hit), "n_items": len(items), "items_sha256": digest, "contaminated": bool(hit)}
    assert sum(r["contaminated"] for r in found.values()) > 3


def test_op9(got, texts):
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = {"assign": (assign, 6, 2), "access": (re.compile("AKIA[A-Z0-9]+"), 20, 0), "hex": (re.compile("[0-9a-f]+"), 24, 0)}
    found, total = got("op9_secret_scan"), Counter()
    for i, t in texts[0].items():
        spans = [(m.start(), n, m.end(), kind) for n, (kind, (p, least, group)) in enumerate(kinds.items()) for m in p.finditer(t or "") if len(m[group]) >= least]
        counts = Counter(s[3] for s in spans)
        total += counts
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)).encode()).hexdigest()
        assert [found[i][c] for c in ("n_assign", "n_access", "n_hex", "base_sha256")] == [*(counts[k] for k in kinds), digest]
        assert {f"{k}:{a}:{b}" for a, _, b, k in spans} <= set(found[i]["spans"].split(","))
    assert all(total[k] for k in kinds)


def test_op10(got, texts):
    found, order = got("op10_document_fingerprints"), sorted(texts[0], reverse=True)
    prints: dict = {}
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        text, other = texts[0][i] or "", texts[0][after] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + other[:n]
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        for t, p in ((text, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert prints.setdefault(t, p) == p
        if text == edited:
            assert r["near_edited"] == 1


def test_op1(got, texts):
    found = got("op1_pii_pseudonyms")
    assert found.keys() == texts[0].keys()
    one, two = (next(r for i, r in found.items() if (texts[0][i] or "").startswith(start)) for start in ("card", "again"))
    cards = [re.search(r"\d{4} \d{4} \d{4} \d{4}", r["text"])[0] for r in (one, two)]
    assert cards[0] == cards[1] != "4111 1111 1111 1111" and one["n_pii"] == two["n_pii"] == 2
    digits = [int(d) for d in cards[0] if d.isdigit()]
    assert sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    assert re.search(r"\S+@\S+", one["text"])[0].lower() == re.search(r"\S+@\S+", two["text"])[0].lower() != "ann@example.org"
    assert all(r["text"] == texts[0][i] for i, r in found.items() if not r["n_pii"])


def test_op3(spark, tmp_path):
    html = "<html><body><nav><a href=/>Home</a></nav><article><h1>A head</h1><p>The first\n  paragraph, with &amp; and words enough to count.</p><p>The second one, which also says something.</p></article><footer>Imprint</footer></body></html>"
    pd.DataFrame({"page_id": [1, 2, 3], "url": ["u", None, "w"], "html": [html, None, ""], "doc_id": [1, 2, 3]}).to_parquet(tmp_path / "pages.parquet")
    text = "A head\nThe first paragraph, with & and words enough to count.\nThe second one, which also says something."
    rows = {r["page_id"]: r for r in queries.op3_html_extraction(spark, str(tmp_path)).collect()}
    assert [(rows[k]["url"], rows[k]["text"], rows[k]["n_chars"]) for k in (1, 2, 3)] == [("u", text, len(text)), (None, "", 0), ("w", "", 0)]
