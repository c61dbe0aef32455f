"""Operators against brute force and on awkward rows: nulls, empty and long texts, ties, repeats, empty tables, clashes."""

import base64
import gzip
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import decontaminate, langid, merkle, pieces, secrets, sharding, simhash, suffixes, warc
from threadloom.llm.components import components
from threadloom.llm.ranges import range_of, splitters

DOCS = "doc_id long, text string, lang string, source string, n_chars long, page_id long, size long, ord long, key string, words string, fp long"


def docs_of(spark, rows):
    """(doc_id, text[, lang, source]) rows with further columns whose names operators use inside."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s")), 0, 1, 2, 3, "k", "w", 4) for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


AWKWARD = [(None, "null id"), (1, None), (2, ""), (3, " \n\t"), (4, "same"), (4, "same"), (4, "other"), (5, "é ß 中文 🙂"), (6, "a" * 50_000), (7, "b " * 20_000)]


# Sharding


@given(st.integers(1, 3000), st.integers(0, 1 << 30))
@settings(max_examples=40, deadline=None)
def test_permutation(total, seed):
    at = sharding.permute(np.arange(total), total, seed)
    assert sorted(at.tolist()) == list(range(total))
    assert (sharding.unpermute(at, total, seed) == np.arange(total)).all()


def test_shards(spark):
    rows = AWKWARD + [(i, f"t{i}") for i in range(100, 190)]
    once = sharding.shard_documents(docs_of(spark, rows), 24).collect()
    again = sharding.shard_documents(docs_of(spark, rows[::-1]).repartition(5), 24).collect()
    assert sorted(map(repr, once)) == sorted(map(repr, again)) and len(once) == len(rows)
    slots = {}
    for r in once:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 24
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in once) == want
    assert sharding.shard_documents(docs_of(spark, rows).limit(0)).count() == 0


# WARC


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", None, "", "<p>a</p>", "é" * 2000, "<p>a</p>", "x\r\n\r\ny"]
    rows = [(i, f"http://h/{i} x" if i else None, h, "extra") for i, h in enumerate(html)] + [(None, "u", "null id", "e"), (3, "http://h/3 x", "<p>a</p>", "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string")
    manifest = warc.write_warc(pages, str(tmp_path / "w"), shards=3, roll_bytes=600)
    got = warc.read_warc(manifest).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for i, h in enumerate(html):
        data = (h or "").encode()
        for r in by[i]:
            assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert [(r.record_type, r.refers_to) for i in (0, 3, 3, 5) for r in by[i][:1]] == [("revisit", 5)] * 3 + [("response", None)]
    assert {(i, by[i][0].record_type, by[i][0].refers_to) for i in (1, 2)} == {(1, "revisit", 2), (2, "response", None)}
    files = {r.name: r for r in manifest.collect()}
    assert len(files) > 3 and not (tmp_path / "w/tmp").exists()
    for name, r in files.items():
        raw = (tmp_path / "w" / name).read_bytes()
        assert hashlib.sha256(raw).hexdigest() == r.sha256 and gzip.decompress(raw).count(b"WARC/1.1\r\n") == r.records
    other = warc.write_warc(pages.repartition(5), str(tmp_path / "v"), shards=3, roll_bytes=600)
    assert {r.name: r.sha256 for r in other.collect()} == {n: r.sha256 for n, r in files.items()}
    assert warc.read_warc(warc.write_warc(pages.limit(0), str(tmp_path / "e"))).count() == 0


def test_large_enough_payloads_alone_are_revisited(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "long" * 9), (4, "u", "long" * 9)], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.read_warc(warc.write_warc(pages, str(tmp_path / "w"), least_revisit_bytes=10)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_splitters_follow_weight_alone(spark):
    rows = spark.range(10_000).selectExpr("id * id as k")
    one, two = (splitters(r, "k", sharding.F.lit(1), 7) for r in (rows, rows.repartition(9)))
    assert one == two and len(one) == 6
    cut = [0, *(sum(1 for i in range(10_000) if i * i < b) for b in one), 10_000]
    assert max(b - a for a, b in itertools.pairwise(cut)) < 2 * 10_000 / 7
    assert splitters(rows.limit(0), "k", sharding.F.lit(1), 7) == []


# Secrets


def brute_spans(text):
    out = []
    for m in re.finditer(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        out += [(m.start(), m.end(), "assign")] * (len(m[2]) >= 12)
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


@given(st.lists(st.sampled_from(["password", "TOKEN", "api_key", "ſecret", "apiKey", " ", "=", ":", '"', "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "aZ9_", "é", "\n", "x.y-"]), max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_base_spans(text):
    assert sorted(s[:3] for s in secrets.base_spans(text)) == sorted(brute_spans(text))


def test_ownership_separates_examples(spark):
    live, copied = "password = Xy7QzWv9LmNp2RtK", "token: AAAABBBBCCCCDDDD1"
    opaque = "see Zk3vQ9xLw8RtYb2NcM5pHs7D end"
    rows = [(i, f"{copied} row", "en", f"o{i % 3}") for i in range(9)] + [(20, live, "en", "o1"), (21, opaque, "en", "o2"), (22, live, "en", "o1")]
    rows += [(*r, "en", "o1") for r in AWKWARD]
    got = {}
    for r in secrets.find_secrets(docs_of(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert got[20][0].spans == "assign:0:27,live:11:27" and got[20][0].owned == 1
    assert got[21][0].spans == "live:4:28" and got[21][0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[0][0].spans.startswith("assign:0:") and "live" not in got[0][0].spans and got[0][0].examples == 1
    masked = {r.doc_id: r for r in secrets.mask_live(docs_of(spark, rows)).collect()}
    assert masked[20].text == "password = [SECRET]" and masked[21].text == "see [SECRET] end" and masked[0].text == f"{copied} row"
    assert masked[1].text is None and secrets.mask_live(docs_of(spark, rows)).count() == len(rows)
    assert secrets.find_secrets(docs_of(spark, rows).limit(0)).count() == 0


def test_ownership_by_both_counts(spark):
    """Verdicts against brute force: distinct owners and repositories of every value; a leak by two owners stays live."""
    rng = random.Random(16)
    values = [f"Ab{i}" + "".join(rng.choices("ghijkmHIJKLMN23", k=22)) + "Zz9" for i in range(12)]
    rows = []
    for n in range(300):
        i = min(rng.randrange(12), rng.randrange(12))
        owner = "only" if i == 0 else f"o{rng.randrange(1 + i % 4)}" if n % 9 else None
        rows.append((n, f"token = {values[i]} in text {n % 50}", "en", owner))
    rows += [(900 + n, "password: TwoOwnersLeak77xyz", "en", f"p{n % 2}") for n in range(6)]
    got = {r.doc_id: r for r in secrets.find_secrets(docs_of(spark, rows), example_repos=30).collect()}
    holders = {}
    for n, t, _, owner in rows:
        holders.setdefault(t.split()[2 if t.startswith("token") else 1], []).append((owner, n))
    for n, t, _, _ in rows:
        held = holders[t.split()[2 if t.startswith("token") else 1]]
        live = len({o for o, _ in held}) < 3 and len({d for _, d in held}) < 30
        assert (got[n].owned, got[n].examples, "live" in got[n].spans) == (live, not live, live)
    assert len({r.owned for r in got.values()}) == 2 and got[900].owned == 1


@given(st.text(alphabet="aB3=+ \"p:", max_size=90), st.lists(st.tuples(st.integers(0, 80), st.integers(1, 20)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_opaque_spans_touch_no_base_span(text, taken):
    spans = [(a, a + n, "hex", "") for a, n in taken]
    free = [(a, b, v) for a, b, v in secrets.opaque_spans(text, [])]
    assert secrets.opaque_spans(text, spans) == [s for s in free if not any(a < s[1] and s[0] < b for a, b, _, _ in spans)]


# SentencePiece


def test_pieces_match_the_library(spark):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(5)
    alphabet = ["the", "Straße", " ", "  ", "\n", "\t", "中文", "🙂", "é", "ing", "aaaa", "0", "x", "\x00", "▁", ".", "tion"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(400)] + ["a" * 3000, " " * 500, ""]
    encoder = pieces.Encoder(pieces.load())
    assert [list(x) for x in encoder.encode(texts)] == [m.encode(t) for t in texts]
    assert [pieces.decode(encoder.v, m.encode(t)) for t in texts] == [t.replace("▁", " ") for t in texts]
    got = pieces.round_trips(docs_of(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and all(r.exact for r in got)
    assert sorted(r.n_pieces for r in got) == sorted(len(m.encode(t or "")) for _, t in AWKWARD)
    assert pieces.encode_documents(docs_of(spark, AWKWARD).limit(0)).count() == 0


def test_pairs_of_pieces(spark):
    """Verdicts by undoing merges equal those by merging, on random pairs, on halves of pieces and with equal scores."""
    rng = random.Random(13)
    real = pieces.load()
    parts = [pieces.SPACE, "a", "b", "c"]
    while len(parts) < 60:
        parts.append(rng.choice(parts[1:]) + rng.choice(parts[1:])) if rng.random() < 0.9 else parts.append("".join(rng.choices("abc", k=3)))
        parts = list(dict.fromkeys(parts))
    toy = pieces.Vocabulary(parts, [-float(rng.randrange(20)) for _ in parts], [-1] * 256, set())
    for v in (real, toy):
        encoder = pieces.Encoder(v)
        able = encoder.texts
        pairs = [(rng.choice(able), rng.choice(able)) for _ in range(3000)]
        pairs += [(p[:k], p[k:]) for p in rng.sample(able, min(len(able), 3000)) for k in range(1, len(p)) if {p[:k], p[k:]} <= v.by_text.keys() and v.merge(p[:k]) == [p[:k]] and v.merge(p[k:]) == [p[k:]]]
        got = encoder.pairs.agree(*(np.array([v.by_text[p[k]] for p in pairs]) for k in (0, 1)))
        assert got.tolist() == [v.merge(x + y) == [x, y] for x, y in pairs]
    texts = ["".join(rng.choices("abc", k=rng.randrange(1, 60))) for _ in range(200)]
    encoder = pieces.Encoder(toy)
    assert [[toy.pieces[i] for i in x] for x in encoder.encode(texts)] == [toy.merge(pieces.SPACE + t) for t in texts]


# Decontamination


def brute_contamination(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for item, text in items:
        w = cut(text)
        for i in range(max(1, len(w) - 12)) if w else ():
            wins.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for d, text in docs:
        w, hit, found = cut(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[k]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 700])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = random.Random(3)
    items = [(1, words(rng, 30)), (2, words(rng, 13)), (10, words(rng, 4)), (11, "Solo"), (12, None), (13, "..."), (14, words(rng, 20, 2))]
    items.append((15, items[0][1]))
    docs = [(i, words(rng, rng.randrange(1, 120), 3 if i % 5 == 0 else 400)) for i in range(40)]
    docs += [(50, f"{words(rng, 9)}, {items[0][1].upper()} {items[0][1]}"), (51, items[0][1][:60]), (52, f"solo {words(rng, 30)}"), (53, f"{items[2][1]} é"), *AWKWARD]
    frame = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, win int")
    got = decontaminate.find_contamination(docs_of(spark, docs), frame)
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == brute_contamination(docs, items)
    clean = decontaminate.drop_contaminated(docs_of(spark, docs), frame)
    assert clean.count() == sum(not r[5] for r in brute_contamination(docs, items)) and clean.columns == DOCS.replace(",", "").split()[::2]
    assert decontaminate.find_contamination(docs_of(spark, docs), frame.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_contamination(docs_of(spark, docs).limit(0), frame).count() == 0


# Repeated strings


def brute_removed(rows):
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if (w := b[s : s + 100]) in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [31, 100, suffixes.SMALL])
def test_multikey_order(monkeypatch, small):
    monkeypatch.setattr(suffixes, "SMALL", small)
    rng = np.random.default_rng(small)
    for high in (1, 3, 1 << 60):
        keys = [rng.integers(0, high, 5000), rng.integers(0, 4, 5000).astype(np.uint64), rng.integers(-9, 9, 5000)]
        order = suffixes.multikey_order(*keys)
        assert sorted(order.tolist()) == list(range(5000))
        rows = [tuple(r) for r in np.stack([k.astype(object) for k in keys], axis=1)[order]]
        assert rows == sorted(rows)
    assert len(suffixes.multikey_order(np.zeros(0, dtype=np.int64))) == 0


def test_no_table_stays_behind_a_failure(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_cut", lambda held: 1 // 0)
    before = {t.name for t in spark.catalog.listTables()}
    with pytest.raises(ZeroDivisionError):
        suffixes.remove_repeats(docs_of(spark, [(1, "q" * 300)]))
    assert {t.name for t in spark.catalog.listTables()} == before


@pytest.mark.parametrize(("size", "bucket_bytes"), [(60, suffixes.BUCKET_BYTES), (suffixes.PASS, 900), (9, 2000)])
def test_repeats_in_many_buckets_and_passes(spark, monkeypatch, size, bucket_bytes):
    monkeypatch.setattr(suffixes, "PASS", size)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", bucket_bytes)
    rng = random.Random(5)
    passage = words(rng, 60)
    rows = [(i, words(rng, rng.randrange(1, 300))) for i in range(20)]
    rows += [(40 + i, f"{words(rng, 20)} {passage} {words(rng, 5)}") for i in range(12)]
    rows += [(60 + i, f"{words(rng, 3)} {passage[:32]} {words(rng, 30)} {passage}") for i in range(12)]
    rows += [(80, "ab" * 900), (81, rows[0][1]), (82, rows[0][1]), (83, None)]
    got = suffixes.remove_repeats(docs_of(spark, rows)).collect()
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=repr) == brute_removed(rows)


@pytest.mark.parametrize(("crowded", "chunk"), [(suffixes.CROWDED, suffixes.CHUNK), (1, suffixes.CHUNK), (suffixes.CROWDED, 700)])
def test_repeats(spark, monkeypatch, crowded, chunk):
    rng = random.Random(9)
    passage, line = words(rng, 60), words(rng, 15)[:99]
    rows = [(i, words(rng, rng.randrange(1, 300))) for i in range(30)]
    rows += [(40 + i, f"{words(rng, 20)} {passage} {words(rng, 5)}") for i in range(8)]
    rows += [(60 + i, f"{line}\n" * rng.randrange(1, 30)) for i in range(4)]
    rows += [(70, "é" * 400), (71, "a" * 1500), (72, rows[0][1] * 2), (73, rows[30][1]), (74, rows[30][1]), (75, passage[:130]), (76, passage[:99]), (77, None), (78, "")]
    if (crowded, chunk) != (suffixes.CROWDED, suffixes.CHUNK):
        monkeypatch.setattr(suffixes, "CROWDED", crowded)
        monkeypatch.setattr(suffixes, "CHUNK", chunk)
        small = [suffixes.anchors(t.encode()) for _, t in rows[:5]]
        monkeypatch.undo()
        for (_, t), parts in zip(rows[:5], small, strict=True):
            assert all((a == b).all() for a, b in zip(parts, suffixes.anchors(t.encode()), strict=True))
        if crowded == 1:
            monkeypatch.setattr(suffixes, "CROWDED", 1)
    got = suffixes.remove_repeats(docs_of(spark, rows)).collect()
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=repr) == brute_removed(rows)


def test_repeats_on_awkward_rows(spark):
    rows = [*AWKWARD[:8], (9, "q" * 300), (9, "q" * 300), (None, "r" * 150), (None, "r" * 150)]
    got = suffixes.remove_repeats(docs_of(spark, rows)).collect()
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=repr) == brute_removed(rows)
    assert suffixes.remove_repeats(docs_of(spark, rows).limit(0)).count() == 0


# SimHash


def brute_print(text, n=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    hashes = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in ([w[i : i + n] for i in range(len(w) - n + 1)] or [w])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 1, 3])
def test_links_within_two_bits(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints)[:20]:
        for _ in range(6):
            prints.add(p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) * rng.randrange(2))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    ids = sorted(map(signed, prints))
    edges = simhash.links(spark.createDataFrame([(i,) for i in ids], "fp long"))
    got = {r.node: r.root for r in components(edges).collect()}
    want = brute_components(ids, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {i: got.get(i, i) for i in ids} == want


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = words(rng, 400)
    rows = [(i, base.replace(f" w{i}x ", " changed ", 1)) for i in range(12)] + [(100 + i, words(rng, 30)) for i in range(5)] + AWKWARD
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted((repr(r.doc_id), r.fingerprint) for r in got) == sorted((repr(i), f"{brute_print(t):016x}") for i, t in rows)
    ids = sorted({i for i, _ in rows if i is not None})
    prints = {}
    for i, t in rows:
        prints.setdefault(i, []).append(brute_print(t))
    want = brute_components(ids, lambda a, b: any((x ^ y).bit_count() <= 2 for x in prints[a] for y in prints[b]))
    single = {i for i in ids if len(prints[i]) == 1}
    assert {r.doc_id: r.component_id for r in got if r.doc_id in single} == {i: want[i] for i in single}
    assert simhash.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def test_kept_documents(spark):
    rng = random.Random(8)
    rows, groups = [], {}
    for g in range(12):
        text = words(rng, 150, 5000).split()
        for c in range(4 if g < 8 else 1):
            copy = list(text)
            if c > 1:
                copy[rng.randrange(len(copy))] = "edited"
            rows.append((g * 10 + c, " ".join(copy)))
            groups.setdefault(g, []).append(g * 10 + c)
    shared = words(rng, 40, 5000)
    rows += [(500 + i, f"{words(rng, 200, 5000)} {shared}") for i in range(30)]
    kept = {r.doc_id for r in simhash.keep_first(docs_of(spark, rows)).collect()}
    assert kept == {min(g) for g in groups.values()} | set(range(500, 530))
    odd = simhash.keep_first(docs_of(spark, AWKWARD)).collect()
    assert sorted(repr((r.doc_id, r.text)) for r in odd) == sorted({repr(r) for r in AWKWARD if r not in ((2, ""), (3, " \n\t"))})
    assert simhash.keep_first(docs_of(spark, rows).limit(0)).count() == 0


def brute_kept(rows, least=0.8):
    cut = [(t or "").lower().split() for _, t in rows]
    cut = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in cut]
    assert all(simhash.similarity(rows[0][1], t) == (len(cut[0] & c) / len(cut[0] | c) if cut[0] or c else 1) for (_, t), c in list(zip(rows, cut, strict=True))[:50])
    root = brute_components(range(len(rows)), lambda a, b: len(s := cut[a] & cut[b]) >= least * (len(cut[a]) + len(cut[b]) - len(s)) - 1e-9)
    return {min(rows[i][0] for i in root if root[i] == r) for r in set(root.values())}


def test_kept_with_other_repeat_counts(spark):
    rng = random.Random(9)
    rows = []
    for g in range(10):
        head, line = words(rng, 150, 5000), words(rng, 25, 5000)
        rows += [(2 * g, " ".join([head] + [line] * 40)), (2 * g + 1, f"{head} {line}")]
    far = [(simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count() for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True)]
    assert max(far) > 18
    assert {r.doc_id for r in simhash.keep_first(docs_of(spark, rows)).collect()} == brute_kept(rows) == set(range(0, 20, 2))


def test_kept_of_crowded_copies(spark):
    rng = random.Random(10)
    original = words(rng, 300, 100_000).split()
    rows = [(900, " ".join(original))]
    for i in range(120):
        copy = list(original)
        for at in rng.sample(range(300), 5):
            copy[at] = f"own{rng.random()}"
        rows.append((i, " ".join(copy)))
    # Of one template, and near no other: crowded shingles that link nobody.
    shared = words(rng, 80, 100_000)
    rows += [(1000 + i, f"{shared} {words(rng, 16, 100_000)}") for i in range(30)]
    likeness = [simhash.similarity(a, b) for (_, a), (_, b) in itertools.combinations(rows[1:40], 2)]
    assert np.median(likeness) < 0.8
    kept = {r.doc_id for r in simhash.keep_first(docs_of(spark, rows)).collect()}
    assert kept == brute_kept(rows)


@pytest.mark.parametrize(("size", "block"), [(5, simhash.BLOCK), (20, 3), (60, simhash.BLOCK), (60, 7), (500, simhash.BLOCK)])
def test_kept_of_edited_groups(spark, monkeypatch, size, block):
    """Copies of an original with a late id, each near it, most of them not near one another; then the same without it."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(size)
    original = words(rng, 300, 100_000).split()
    rows = []
    for i in range(size):
        copy = list(original)
        for at in rng.sample(range(300), 6):
            copy[at] = f"own{rng.random()}"
        rows.append((i, " ".join(copy)))
    rows += [(10_000 + i, words(rng, 100, 100_000)) for i in range(20)]
    whole = [*rows, (5000, " ".join(original))]
    assert {r.doc_id for r in simhash.keep_first(docs_of(spark, whole)).collect()} == brute_kept(whole)
    if size <= 60:
        assert {r.doc_id for r in simhash.keep_first(docs_of(spark, rows)).collect()} == brute_kept(rows)


@given(st.lists(st.sets(st.integers(0, 60), max_size=30), min_size=2, max_size=12), st.integers(1, 9))
@settings(max_examples=50, deadline=None)
def test_overlaps(sets, columns):
    held = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    pairs = np.array(list(itertools.combinations(range(len(sets)), 2)))
    want = [len(sets[a] & sets[b]) for a, b in pairs]
    before, simhash.COLUMNS = simhash.COLUMNS, columns
    try:
        assert simhash.overlaps(held, pairs).tolist() == simhash.overlaps(held, np.repeat(pairs, 5, axis=0))[::5].tolist() == want
        assert [simhash._jaccard(held[a], held[b]) for a, b in pairs] == [len(sets[a] & sets[b]) / (len(sets[a] | sets[b]) or 1) if sets[a] or sets[b] else 1.0 for a, b in pairs]
    finally:
        simhash.COLUMNS = before


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \t\né\u00a0\u2003", max_size=30)), max_size=12), st.integers(1, 6), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_combined_hashes(texts, n, block):
    """Equal exactly where word shingles are equal, one by one and in blocks of any size."""
    before, simhash.HASHED_BYTES = simhash.HASHED_BYTES, block
    try:
        got = [h.tolist() for h in simhash.many_combined_hashes(texts, n)]
    finally:
        simhash.HASHED_BYTES = before
    assert got == [simhash.combined_hashes(t, n).tolist() for t in texts]
    seen = {}
    for t, hashes in zip(texts, got, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        cut = [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
        assert len(cut) == len(hashes)
        for c, h in zip(cut, hashes, strict=True):
            assert seen.setdefault(c, h) == h
    assert len(set(seen.values())) == len(seen)


def test_kept_of_chained_crowds(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 1)
    rng = random.Random(11)
    rows = []
    for g in range(6):  # each text is near the next ones only, and no text is near them all
        text = words(rng, 200, 100_000).split()
        for i in range(20):
            rows.append((g * 100 + rng.randrange(10**6) * 1000, " ".join(text)))
            text[rng.randrange(200)] = f"own{rng.random()}"
            if i == 10:
                for at in range(0, 200, 17):
                    text[at] = f"own{rng.random()}"
    assert {r.doc_id for r in simhash.keep_first(docs_of(spark, rows)).collect()} == brute_kept(rows)


def test_kept_of_short_edited_copies(spark):
    rng = random.Random(12)
    rows = []
    for n in range(10, 61):
        text = words(rng, n, 100_000).split()
        copies = [text, [*text[:-1], "edited"], ["edited", *text[1:]], [*text, "appended"], ["before", *text], [*text[: n // 2], "edited", *text[n // 2 + 1 :]]]
        rows += [(n * 10 + rng.randrange(10**6) * 1000, " ".join(c)) for c in rng.sample(copies, len(copies))]
    assert {r.doc_id for r in simhash.keep_first(docs_of(spark, rows)).collect()} == brute_kept(rows)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5), (301, 300), (300, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1060), 1000), 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Merkle trees


def test_edited_fingerprints(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(". ".join(words(rng, 8) for _ in range(4)) + "." for _ in range(6))) for i in range(30)] + AWKWARD
    got = merkle.edited_fingerprints(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()), reverse=True)
    want = []
    for (i, t), (_, nx) in zip(order, order[1:] + order[:1], strict=True):
        t, nx = t or "", nx or ""
        want.append((repr(i), len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + nx[: len(t) // 2]).encode()).hexdigest()))
    assert sorted((repr(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    for r in got:
        assert 0 <= r.near_next <= 1 and (r.doc_id is None or not 8 <= r.doc_id < 30 or r.near_edited > 0.3 > r.near_next)
        assert (r.fingerprint == r.edited_fingerprint) <= (r.near_edited == 1.0)
    assert merkle.edited_fingerprints(docs_of(spark, rows).limit(0)).count() == 0


def test_trees_locate_edits(spark):
    a, b = "One. Two.\nThree. Four.\n", "One. Two.\nThree. FOUR.\n"
    row = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.fingerprint(merkle.F.col("a")).alias("a"), merkle.fingerprint(merkle.F.col("b")).alias("b"))
    out = merkle.with_edits(row, "e", "a", "b").first()
    assert out.e.leaves == out.e.other_leaves == [3] and len(out.e.sections) == 1
    root, sections, leaves = out.a.split(":")
    whole = [hashlib.sha256(p.encode()).hexdigest() for p in ("One. ", "Two.\n", "Three. ", "Four.\n")]
    groups = [[]]
    for h in whole:
        groups[-1].append(h)
        if h[7] in "08":
            groups.append([])
    branches = [hashlib.sha256(".".join(g).encode()).hexdigest() for g in groups if g]
    assert leaves == ".".join(h[:8] for h in whole) and sections == ".".join(h[:16] for h in branches)
    assert root == hashlib.sha256(".".join(branches).encode()).hexdigest()[:32]


def aligned_by_hand(x, y):
    """Length of a longest rising run of leaves, the k-th occurrence paired with the k-th, by comparing all pairs."""
    places = {}
    for j, h in enumerate(y):
        places.setdefault(h, []).append(j)
    js, best = [], []
    for h in x:
        if places.get(h):
            js.append(places[h].pop(0))
    for k, j in enumerate(js):
        best.append(1 + max((best[m] for m in range(k) if js[m] < j), default=0))
    return max(best, default=0)


def test_likeness_and_edits_against_all_pairs(spark):
    rng = random.Random(14)
    base = [words(rng, 9) + ".\n" for _ in range(60)]
    rows = [("", "".join(base)), ("".join(base), ""), ("", ""), ("".join(base), "".join(base))]
    for _ in range(30):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            at, to = rng.randrange(50), rng.randrange(50)
            kind = rng.randrange(5)
            if kind == 0:
                copy[at] = words(rng, 9) + ".\n"
            elif kind == 1:
                copy.insert(to, copy[at])
            elif kind == 2:
                del copy[at]
            elif kind == 3:
                copy[at], copy[to] = copy[to], copy[at]
            else:
                copy = copy[at:] + copy[:at]
        rows.append(("".join(copy), "".join(base)))
    rows += [("".join(rng.choice("AB") + "\n" for _ in range(40)), "".join(rng.choice("ABC") + "\n" for _ in range(30))) for _ in range(10)]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "a string, b string, _pairs int, _row int, _c__pairs int")
    frame = merkle.with_likeness(merkle.with_fingerprints(frame, x="a", y="b"), near=("x", "y"))
    got = merkle.with_edits(frame, "e", "x", "y").withColumn("first", merkle.first_edit(merkle.F.col("x"), merkle.F.col("y"))).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(rows) and all((r["_pairs"], r["_row"], r["_c__pairs"]) == (1, 2, 3) for r in got)
    for r in got:
        x, y = ([h for h in f.split(":")[2].split(".") if h] for f in (r.x, r.y))
        n = aligned_by_hand(x, y)
        assert r.near == (1.0 if r.a == r.b else 2 * n / (len(x) + len(y))) and (r.near == 1.0) == (r.a == r.b)
        left = [[h for i, h in enumerate(side) if i not in set(out)] for side, out in ((x, r.e.leaves), (y, r.e.other_leaves))]
        assert left[0] == left[1] and len(left[0]) == n
        for side, out, sections in ((x, r.e.leaves, r.e.sections), (y, r.e.other_leaves, r.e.other_sections)):
            assert sections == sorted({sum(h[7] in "08" for h in side[:i]) for i in out})
        assert r.first == next((i for i, (p, q) in enumerate(itertools.zip_longest(x, y)) if p != q), None)


@pytest.mark.parametrize(
    ("a", "b", "leaves", "others"),
    [
        ("Alpha\nBeta\nGamma\n", "Beta\nAlpha\nGamma\n", 1, 1),
        ("Alpha\nAlpha\nBeta\n", "Alpha\nBeta\n", 1, 0),
        ("Alpha\nBeta\n", "Alpha\nBeta\nBeta\n", 0, 1),
        ("".join(f"One {i}\n" for i in range(40)) + "".join(f"Two {i}\n" for i in range(30)), "".join(f"Two {i}\n" for i in range(30)) + "".join(f"One {i}\n" for i in range(40)), 30, 30),
    ],
)
def test_order_and_repetition_count(spark, a, b, leaves, others):
    frame = merkle.with_fingerprints(spark.createDataFrame([(a, b)], "a string, b string"), x="a", y="b")
    r = merkle.with_edits(merkle.with_likeness(frame, near=("x", "y")), "e", "x", "y").first()
    assert r.near < 1 and (len(r.e.leaves), len(r.e.other_leaves)) == (leaves, others)
    assert bool(r.e.sections) == bool(leaves) and bool(r.e.other_sections) == bool(others)


WIDE = [-(1 << 63), -5, 0, 7, (1 << 63) - 1, None]


def test_ids_over_64_bits(spark, tmp_path):
    rows = [(i, f"text {i}. " * 40) for i in WIDE]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    want = {i: (t[: len(t) - len(t) // 2] + nx[: len(t) // 2]) for (i, t), (_, nx) in zip(order, order[1:] + order[:1], strict=True)}
    got = {r.doc_id: r.edited_sha256 for r in merkle.edited_fingerprints(docs_of(spark, rows)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    pages = spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id long, url string, html string")
    back = warc.read_warc(warc.write_warc(pages, str(tmp_path / "w"), shards=4)).collect()
    assert {r.page_id for r in back} == set(WIDE) and all(r.intact and r.record_type == "response" for r in back)


def test_splitters_over_64_bits(spark):
    rng = random.Random(15)
    keys = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(500)] + list(range(-300, 300)) + [(1 << 62) + i for i in range(900)] + WIDE
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    bounds = splitters(rows, "k", sharding.F.lit(1), 40)
    real = sorted(k for k in keys if k is not None)
    assert bounds == sorted(set(bounds)) and len(bounds) == 39
    cut = [0, *(sum(k < b for k in real) for b in bounds), len(real)]
    assert max(b - a for a, b in itertools.pairwise(cut)) <= 2 * len(real) / 40 + 1
    for held in (bounds, bounds[:1], bounds[:5]):
        placed = rows.select("k", range_of(sharding.F.col("k"), held).alias("r")).collect()
        assert all(r.r == (0 if r.k is None else sum(b <= r.k for b in held)) for r in placed)


# Language ID


def test_language(spark):
    rng = random.Random(1)
    sounds = {"en": ["the", "ing", "and", "sh"], "de": ["sch", "ung", "der", "ei"], "fr": ["eau", "tion", "les", "oi"], "es": ["ción", "que", "los", "ra"], "xx": ["kju", "zzu", "vyk"]}
    rows = [(i, " ".join("".join(rng.choices(sounds[lang], k=2)) for _ in range(30)), lang, "s") for i, lang in enumerate(list(sounds) * 40)]
    odd = [(1000, None, "en", "s"), (1001, "123 !", "en", "s"), (None, "the sh the ing", None, "s"), (1002, "", None, "s"), (1002, "", None, "s")]
    got = langid.identify(docs_of(spark, rows + odd), per_language=20).collect()
    named = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert all(named[i].lang_pred == lang for i, _, lang, _ in rows if named[i].held_out)
    assert [named[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and named[None].lang_pred == "en"
    kept = langid.keep_identified(docs_of(spark, rows + odd), per_language=20)
    assert kept.count() == len(rows) + 1 and kept.columns == DOCS.replace(",", "").split()[::2]
    assert {r.lang_pred for r in langid.identify(docs_of(spark, [(1, "abc", None, "s")])).collect()} == {"und"}
    assert langid.identify(docs_of(spark, rows).limit(0)).count() == 0


def test_many_languages_and_long_texts(spark):
    rng = random.Random(17)
    sounds = {f"l{n}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(4)] for n in range(70)}
    rows = [(i, " ".join(rng.choices(sounds[lang], k=25 if i else 60_000)), lang, "s") for i, lang in enumerate(list(sounds) * 6)]
    got = {r.doc_id: r for r in langid.identify(docs_of(spark, rows)).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang, _ in rows if got[i].held_out]
    assert {r.lang_pred for r in got.values()} == set(sounds)
    assert sum(a == b for a, b in held) >= 0.9 * len(held) > 50
    few = {r.lang_pred for r in langid.identify(docs_of(spark, rows), classes=3).collect()}
    assert len(few) == 3 and few <= set(sounds)


def test_held_out_accuracy_on_the_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'")
    right, n = got.selectExpr("sum(int(lang = lang_pred))", "count(*)").first()
    assert n > 20 and right >= 0.97 * n


def test_repeated_windows_against_brute_force():
    rng = np.random.default_rng(1)
    ctx = rng.integers(97, 101, size=(40, suffixes.CONTEXT)).astype(np.uint8)[rng.integers(0, 40, 300)]
    for i in range(0, 300, 2):
        ctx[i, rng.integers(0, suffixes.CONTEXT)] = 120
    order, off = rng.integers(0, 60, 300), np.arange(300) * 500 + suffixes.SIDE
    before, after = (rng.integers(0, suffixes.SIDE + 1, 300) for _ in range(2))
    ranges = suffixes._repeated_windows(np.full(300, 7), order, off, before, after, ctx)
    got = {(n, at) for n, low, high in zip(*map(list, ranges), strict=True) for at in range(low, high - suffixes.LENGTH + 1)}
    seen, want = set(), set()
    for i in np.lexsort((off, order)):
        for c in range(suffixes.SIDE - before[i], after[i] + 1):
            string = (c, ctx[i, c : c + suffixes.LENGTH].tobytes())
            if string in seen:
                want.add((order[i], off[i] - suffixes.SIDE + c))
            seen.add(string)
    assert got == want and want
