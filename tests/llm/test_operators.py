import hashlib
import random
import re
import struct
import textwrap
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import bytekernel, common, compact_windows, exact_dedup, langid_cnn, license_scan, mixing, ngram_join, suffix_decontam, token_counts, toxicity, warc_bundles

from .helpers import ODD, documents

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def fold(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def large(texts):
    return pa.array(texts, pa.large_string())


# --- bytes and words


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_of_bytes_are_those_of_the_patterns(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    data, offsets = bytekernel.buffers(large(texts))
    for kind, pattern in ((bytekernel.NONSPACE, r"[^\x20\x09-\x0D]+"), (bytekernel.ALNUM, None)):
        starts, ends, firsts = bytekernel.spans(data, offsets, kind)
        for i, t in enumerate(texts):
            want = re.findall(pattern, t) if pattern else re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
            got = [bytes(data[a:b]).decode() for a, b in zip(starts[firsts[i] : firsts[i + 1]], ends[firsts[i] : firsts[i + 1]])]
            assert [fold(x) for x in got] == [fold(x) for x in want]


def test_equal_words_hash_alike_wherever_they_are():
    data, offsets = bytekernel.buffers(large(["The cat", "", "cat THE cat", None or "x the"]))
    starts, ends, _ = bytekernel.spans(data, offsets, bytekernel.NONSPACE)
    h = bytekernel.hashes(data, starts, ends)
    assert h[0] == h[3] == h[6] and h[1] == h[2] == h[4] and len(set(h.tolist())) == 3


# --- components


def test_components_are_those_of_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hubs_are_dealt_over_several_keys(spark):
    """Two hubs of 2,600 leaves, the larger id at the centre, joined by one edge, and a chain."""
    edges = [(50_000, i) for i in range(10, 2_610)] + [(3, i) for i in range(60_000, 62_600)] + [(2_609, 60_000)] + [(70_000 + i, 70_001 + i) for i in range(20)]
    df = spark.createDataFrame(edges, "a long, b long")
    both = df.union(df.select("b", "a"))
    least = {r["a"]: r["m"] for r in common._with_least(both, both.count()).collect()}
    want = {}
    for a, b in edges:
        want[a], want[b] = min(want.get(a, b), b), min(want.get(b, a), a)
    assert least == want and common._with_least(both, both.count()).count() == both.count()
    got = {r["node"]: r["root"] for r in common.connected_components(df).collect()}
    nodes = {x for e in edges for x in e}
    assert got == {x: 70_000 if x >= 70_000 else 3 for x in nodes}


# --- 1 toxicity


@pytest.fixture(scope="module")
def channel():
    text = " ".join(["the idiot is stupid and worthless said a loser clown you cool good see little about other people"] * 50)
    codes = [0, 0] + [toxicity._CODE.get(c, 0) for c in text] + [0]
    counts = np.zeros(toxicity._N**3)
    for x, y, z in zip(codes, codes[1:], codes[2:]):
        counts[(x * toxicity._N + y) * toxicity._N + z] += 1
    return toxicity.Channel.of_counts(counts)


@pytest.mark.parametrize("written, word", [("1d10t", "idiot"), ("5tup1d", "stupid"), ("s t u p i d", "stupid"), ("i.d.i.o.t", "idiot"), ("stuuuupid", "stupid"), ("w0rthl3ss", "worthless"), ("$tupid", "stupid"), ("L0SER", "loser"), ("idio7", "idiot")])
def test_written_words_are_restored(channel, written, word):
    assert channel.restore(f"you {written} there") == f"you {word} there"


@pytest.mark.parametrize("written, word", [("y o u", "you"), ("y.o.u", "you"), ("s  t  u  p  i  d", "stupid"), ("i..d..i..o..t", "idiot"), ("s.-t.-u.-p.-i.-d", "stupid"), ("worthle$$", "worthless"), ("worthle55", "worthless"), ("w0rthle$$", "worthless")])
def test_short_wide_and_ending_spellings_are_restored(channel, written, word):
    assert channel.restore(f"the {written}") == f"the {word}"
    assert toxicity.suspicious(*bytekernel.buffers(large([f"the {written}"])))[0]


def test_spans_at_a_texts_ends_are_suspicious():
    assert toxicity.suspicious(*bytekernel.buffers(large(["end", "a s s", "next"]))).tolist() == [False, True, False]


def test_letters_before_two_signs_have_a_lattice():
    assert [toxicity.SPAN.search(t)[0] for t in ("an a$$ is", "a s s", "f.u.k", "dumba$$")] == ["a$$", "a s s", "f.u.k", "dumba$$"]


def test_spans_of_every_length_are_restored(channel):
    words = "you said the idiot is stupid and worthless"
    got = channel.restore(" ".join("-".join(w) for w in words.split())).split()
    assert {"idiot", "stupid", "worthless"} <= set(got)
    assert channel.restore("you stu" + "u" * 60 + "pid") == "you stupid"
    assert len(channel.restore(" ".join("-".join(w) for w in words.split() * 200)).split()) > 800


def test_plain_text_is_left_alone(channel):
    for t in ("the cool cat", "THE!! END!!", "page 3 of 100", "a b", "", "token$$$ of###"):
        assert channel.restore(t) == t


def test_rows_with_spans_are_always_suspicious(channel):
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("abAB10$! .-é") for _ in range(rng.randrange(1, 14)))
        if toxicity.SPAN.search(t):
            assert toxicity.suspicious(*bytekernel.buffers(large([t])))[0], t


def test_trigrams_do_not_depend_on_the_order_of_texts(spark):
    rows = [(i, t) for i, t in enumerate(["an idiot", "", "so what", None, "b", "zz top é", "x" * 9])]
    a = toxicity.trigram_counts(documents(spark, rows).coalesce(1), "text")
    b = toxicity.trigram_counts(documents(spark, rows[::-1]).repartition(3), "text")
    want = Counter()
    for _, t in rows:
        codes = [0, 0] + [27 if ord(c) > 127 else toxicity._CODE.get(c, 0) for c in (t or "").replace("é", "éé")] + [0, 0]
        want.update(zip(codes, codes[1:], codes[2:]))
    got = {(int(k) // toxicity._N**2, int(k) // toxicity._N % toxicity._N, int(k) % toxicity._N): int(n) for k, n in enumerate(b) if n and k}
    assert (a[1:] == b[1:]).all() and got == {k: n for k, n in want.items() if k != (0, 0, 0)}


def test_toxic_words_are_learnt_and_found_when_disguised(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = prose(rng, 60).split()
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["horrid", "vilest"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = documents(spark, rows + [(1000, "w1 w2 h0rrid v1lest w3 " + prose(rng, 50)), (1001, None), (1002, ""), (None, "w1 horrid")])
    scorer = toxicity.train(docs, spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, scorer).collect()}
    assert len(got) == 404
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert held and all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held)
    assert got[1000]["predicted"] == 1 and got[1001]["predicted"] == got[1002]["predicted"] == 0
    assert got[1001]["score"] == got[1002]["score"]
    empty = toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")))
    assert empty.count() == 0


# --- 2 decontamination


def brute_contamination(docs, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = []
    for _, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            q = words(t)
            n = min(width, len(q))
            if not n or item is None:
                continue
            windows = {tuple(q[i : i + n]) for i in range(len(q) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(item)
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination_is_that_of_brute_force(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.choice([3, 9, 10, 11, 25]))) for i in range(30)] + [(30, "W1 w2"), (31, ""), (32, None), (None, "w5"), (33, "w7"), (33, "w8 w9 w7")]
    docs = []
    for i in range(60):
        w = prose(rng, 80).split()
        t = rng.choice(items)[1] or ""
        p = rng.randrange(80)
        docs.append((i, " ".join(w[:p] + t.upper().split()[rng.randrange(2) :] + w[p:])))
    docs += [(100, items[3][1]), (101, None), (102, ""), (100, items[3][1]), (None, items[4][1]), (103, "!?"), (104, "w1\x00w2 w1-w2")]
    for block_words in (1_000_000, 40):
        got = suffix_decontam.find_contamination(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()
        key = lambda r: str(r)
        assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got], key=key) == sorted([(d[0], *b) for d, b in zip(docs, brute_contamination(docs, items))], key=key)
    kept = suffix_decontam.remove_contaminated(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == documents(spark, docs).columns
    assert kept.count() == sum(not b[4] for b in brute_contamination(docs, items))
    none = spark.createDataFrame([], "item_id long, text string")
    assert suffix_decontam.remove_contaminated(documents(spark, ODD), none).count() == len(ODD)
    assert suffix_decontam.find_contamination(documents(spark, []), none).count() == 0


def test_longest_match_has_its_place(spark):
    item = " ".join(WORDS[:30])
    doc = " ".join(["x", "y", *WORDS[4:20], "z", *WORDS[:12]])
    r = suffix_decontam.find_contamination(documents(spark, [(1, doc)]), spark.createDataFrame([(9, item)], "item_id long, text string")).first()
    assert (r["longest_words"], r["longest_start"], r["longest_item"], r["n_hit"]) == (16, 2, 9, 28)


# --- 3 WARC


def test_pages_come_back_from_their_bundles(spark, tmp_path):
    big, small = "<p>" + "ä" * 100, "tiny"
    rows = [(5, "http://a/\r\nEvil: 1", big), (3, None, big), (4, "u", small), (9, "u", small), (7, "u", None), (8, "u", ""), (None, "u", big), (10, "u", "x\r\n\r\nWARC/1.1\r\n" + "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/out"
    index = warc_bundles.write_bundles(pages, folder, frame_bytes=4000)
    got = sorted(map(tuple, warc_bundles.read_bundles(spark, folder, index).collect()), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(i, len((h or "").encode()), sha(h), "revisit" if h == big and i != 3 else "response", 3 if h == big and i != 3 else None) for i, _, h in rows]
    assert got == sorted(want, key=str)
    for r in index.collect():
        record = warc_bundles.read_record(folder, r["bundle"], r["frame_start"], r["frame_bytes"], r["record_offset"], r["record_bytes"])
        assert record.startswith(b"WARC/1.1\r\n") and f"<urn:page:{'none' if r['page_id'] is None else r['page_id']}>".encode() in record
    assert warc_bundles.archive_pages(pages.limit(0)).count() == 0


def test_long_lists_of_repeats_are_filtered_and_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc_bundles, "MOST_BROADCAST", 0)
    rows = [(i, "u", "long page " * 20 + str(i // 3)) for i in range(60)] + [(None, "u", "long page " * 20 + "0"), (90, "u", "tiny"), (91, "u", "tiny")]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc_bundles.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: ("response", None) if i % 3 == 0 else ("revisit", i - i % 3) for i in range(60)} | {None: ("revisit", 0), 90: ("response", None), 91: ("response", None)}
    assert got == want


def test_bundles_are_plain_zstandard_with_a_seek_table(spark, tmp_path):
    import io

    import zstandard

    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc_bundles.write_bundles(pages, f"file://{tmp_path}/b", frame_bytes=2000)
    (path,) = [p for p in (tmp_path / "b").iterdir()]
    raw = path.read_bytes()
    n, flags, magic = struct.unpack("<IBI", raw[-9:])
    assert magic == 0x8F92EAB1 and n > 3
    fs, base = pafs.FileSystem.from_uri(f"file://{path}")
    with fs.open_input_file(base) as f:
        frames = warc_bundles.seek_table(f)
    parts = [zstandard.ZstdDecompressor().decompress(raw[s : s + c]) for s, c, _ in frames]
    assert [len(p) for p in parts] == [r for _, _, r in frames]
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole == b"".join(parts) and len([*warc_bundles.decode_records(whole)]) == 40


# --- 4 language ID


def test_languages_are_learnt_from_rows_not_held_out(spark):
    rng = random.Random(4)
    alphabets = {"aa": "abcde", "bb": "vwxyz", "cc": "éèöüß"}
    word = lambda s: "".join(rng.choice(s) for _ in range(5))
    rows = [(i, " ".join(word(a) for _ in range(60)), k) for i in range(200) for k, a in [rng.choice([*alphabets.items()])]]
    docs = documents(spark, rows + [(x, t, None) for x, t in ODD])
    net = langid_cnn.train(docs, max_docs=150)
    got = langid_cnn.identify(docs, net).collect()
    assert len(got) == len(rows) + len(ODD)
    by = {r["doc_id"]: r for r in got}
    import zlib

    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    held = [(by[i]["lang_pred"], k) for i, _, k in rows if by[i]["held_out"] and i > 9]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    odd = [r for r in got if r["doc_id"] is None or r["doc_id"] in (1, 2, 3, 6)]
    assert {(r["doc_id"], r["score"]) for r in odd if r["lang_pred"] == "und"} >= {(1, 0.0), (2, 0.0), (3, 0.0)}
    no_label = langid_cnn.identify(documents(spark, [(1, "text", None)]), langid_cnn.train(documents(spark, [(1, "text", None)]))).first()
    assert (no_label["lang_pred"], no_label["score"]) == ("und", 0.0)
    kept = langid_cnn.drop_unidentified(documents(spark, [(x, t, None) for x, t in ODD]), net)
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == Counter([4, None, 5, 5, 7, 8, 9])
    assert langid_cnn.train(docs.limit(0)) is None


def test_windows_hold_every_byte():
    texts = ["a" * 700, "", "b" * 256, "c"]
    x, at, size = langid_cnn.windows(*bytekernel.buffers(large(texts)))
    assert at.tolist() == [0, 0, 0, 2, 3] and size.tolist() == [256, 256, 188, 256, 1]
    assert ((x > 0).sum(axis=1) == size).all()


# --- 5 n-gram join


def brute_classes(docs, k, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))]


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (1, 60)])
def test_classes_are_those_of_brute_force(spark, k, percent):
    rng = random.Random(k)
    docs = []
    for i in range(25):
        base = prose(rng, rng.choice([1, 2, 5, 9, 12, 20, 40, 90, 200])).split()
        for _ in range(rng.randrange(1, 8)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(w) + 1)
                kind = rng.randrange(3)
                if kind == 0:
                    w.insert(at, rng.choice(WORDS))
                elif w and at < len(w):
                    if kind == 1:
                        del w[at]
                    else:
                        w[at] = rng.choice(WORDS)
            docs.append((len(docs) * 7 % 1009, " ".join(w)))
    docs += [(5000 + (i or 0), t) if i is not None else (None, t) for i, t in ODD]
    docs += [(None, docs[0][1])]
    got = ngram_join.classes(documents(spark, docs), k, percent).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_classes(docs, k, percent), key=str)


def test_signatures_meet_for_every_pair_over_the_threshold():
    rng = np.random.default_rng(0)
    for percent in (90, 80):
        for _ in range(600):
            n = int(rng.integers(1, 300))
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            d = int(n * (100 - percent) / percent)
            drop = int(rng.integers(0, d + 1))
            add = int(rng.integers(0, d + 1))
            b = np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if len(b) and not np.array_equal(a, b) and 100 * both >= percent * (len(a) + len(b) - both):
                for common in (None, np.sort(rng.permutation(a)[: len(a) * 3 // 4])):
                    assert np.isin(ngram_join.part_signatures(a, percent, common), ngram_join.part_signatures(b, percent, common)).any()


def test_trees_prune_but_lose_no_link():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, int(rng.integers(20, 200))).astype(np.uint64)
        for _ in range(3):
            s = base.copy()
            s[: int(rng.integers(0, 6))] = rng.integers(0, 2**63)
            sets.append(np.unique(s))
    compared = []
    got = ngram_join.tree_join(sets, 90, verified=compared)
    brute = ngram_join.tree_join(sets, 90, side=None)
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                x, y = i, j
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    assert got.tolist() == [find(i) for i in range(len(sets))] == brute.tolist()
    assert len(compared) < len(sets) * (len(sets) - 1) // 20


def test_large_blocks_are_cut_and_still_whole(spark, monkeypatch):
    rng = random.Random(9)
    base = prose(rng, 120).split()
    docs = []
    for i in range(40):
        w = list(base)
        for _ in range(i % 12):
            w[rng.randrange(120)] = "v%d" % rng.randrange(10**6)
        docs.append((i, " ".join(w)))
    want = sorted(brute_classes(docs, 3, 80), key=str)
    monkeypatch.setattr(ngram_join, "_BLOCK_SHINGLES", 900)
    assert sorted(map(tuple, ngram_join.classes(documents(spark, docs), 3, 80).collect()), key=str) == want


@pytest.mark.parametrize("most", [100_000, 0])
def test_one_of_each_class_stays(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BROADCAST", most)
    rng = random.Random(8)
    a = prose(rng, 100)
    docs = documents(spark, [(3, a), (1, a + " more"), (2, prose(rng, 100)), (4, None), (5, None), (None, a)])
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 4, 5, None]
    assert ngram_join.classes(docs.limit(0)).count() == 0


# --- 6 token counts

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    return token_counts.PieceCounter(BPE)


@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet=" \n\t \x1c\x85ab1'.<|é中", max_size=30), st.sampled_from(["<|endoftext|>", "a <|endoftext|> b", " <|endoftext|>", "don't  stop\n\n now "])), max_size=6))
@settings(max_examples=300, deadline=None)
def test_counts_are_those_of_whole_texts(counter, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert counter.counts(texts) == counter.lengths(texts)


def test_token_counts_of_odd_rows(spark, counter):
    rows = ODD + [(50, "<|endoftext|> and <|endoftext|>" * 300)]
    got = token_counts.count_tokens(documents(spark, rows), BPE).collect()
    want = [(i, len((t or "").encode()), n, n > 512) for (i, t), n in zip(rows, counter.lengths([t or "" for _, t in rows]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(documents(spark, []), BPE).count() == 0


def test_counters_memory_is_bounded(counter):
    own = token_counts.PieceCounter(BPE, keep=50)
    long = ["a%d" % i + "x" * 5_000 for i in range(300)]
    words = [" ".join(f"w{i}" for i in range(lo, lo + 200)) for lo in range(0, 2_000, 200)]
    texts = long + words + ["y" * 200_000, words[0], ""]
    assert [own.counts([t])[0] for t in texts] == own.counts(texts) == [len(counter._encoder.encode(t, add_special_tokens=False)) for t in texts]
    held = [w for part in vars(own).values() if isinstance(part, dict) for w in part]
    assert len(held) <= 100 and sum(map(len, held)) <= 100 * 64


# --- 7 mixing


def test_targets_share_the_excess():
    got = mixing.targets({"b": 100, "a": 100, None: 1000, "c": 10, "d": 0})
    assert sum(got.values()) == pytest.approx(1.5 * 1210)
    assert got["a"] == 200 and got["c"] == 20 and got["d"] == 0
    assert all(got[s] <= 2 * w + 1e-9 for s, w in {"b": 100, "a": 100, None: 1000, "c": 10}.items())
    assert mixing.targets({}) == {}


def test_mass_is_kept_and_expectations_are_met():
    sizes = np.array([5.0, 1, 9, 2, 2, 30, 7, 4])
    total = np.zeros(8)
    for i in range(4000):
        p, left = mixing.pivotal(sizes, np.full(8, 0.3), np.random.default_rng(i))
        assert (sizes * p).sum() == pytest.approx(0.3 * sizes.sum())
        assert all(x in (0, 1) for j, x in enumerate(p) if j != left)
        total += p
    assert np.abs(total / 4000 - 0.3).max() < 0.04


@pytest.mark.parametrize("block_rows", [2_000, 7])
def test_sources_meet_their_targets(spark, block_rows):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.choice([1, 20, 300])), "en", rng.choice(["a", "b", "b", "b", "c", None, ""])) for i in range(300)]
    rows += [(x, t, "en", "odd") for x, t in ODD]
    docs = documents(spark, rows)
    got = mixing.mix_sources(docs, block_rows=block_rows).collect()
    again = mixing.mix_sources(docs.repartition(7), block_rows=block_rows).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, _, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = mixing.targets(dict(size))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by_target = defaultdict(int)
    for r in got:
        by_target[round(r["target"], 6)] += r["taken"]
    want = defaultdict(float)
    for s, x in target.items():
        want[round(x, 6)] += x
    for x, taken in by_target.items():
        assert taken == pytest.approx(want[x], abs=2)
    assert mixing.mix_sources(documents(spark, [])).count() == 0


# --- 8 compact windows


def brute_windows(v, t):
    out = set()
    for i in range(len(v)):
        l = i
        while l > 0 and v[l - 1] > v[i]:
            l -= 1
        r = i
        while r + 1 < len(v) and v[r + 1] > v[i]:
            r += 1
        if r - l + 1 >= t:
            out.add((i, l, r))
    return out


def test_windows_are_those_of_the_cartesian_tree():
    rng = np.random.default_rng(2)
    lengths = [0, 3, 10, 11, 60, 200, 0, 9]
    v = rng.permutation(sum(lengths)).astype(np.uint64) * np.uint64(2) + np.uint64(2)
    cut = np.concatenate([[0], np.cumsum(lengths)])
    text, c, l, r = compact_windows.compact_windows(v, cut, 10)
    for i in range(len(lengths)):
        own = text == i
        assert set(zip(c[own].tolist(), l[own].tolist(), r[own].tolist())) == brute_windows(v[cut[i] : cut[i + 1]].tolist(), 10)


def test_equal_tokens_do_not_multiply_windows():
    v = np.full(1000, 6, np.uint64)
    text, c, l, r = compact_windows.compact_windows(v, np.array([0, 1000]), 46)
    assert len(c) == 1 and l[0] == 0 and r[0] == 999


def test_repeated_passages_are_found_and_clean_documents_left(spark):
    rng = random.Random(10)
    fresh = iter(range(10**6))
    unique = lambda n: " ".join(f"u{next(fresh)}" for _ in range(n))
    passage, other = unique(60), unique(120)
    changed = other.split()
    changed[30], changed[80] = "x", "y"
    docs = [(i, f"{unique(rng.randrange(5, 200))} {passage} {unique(40)}") for i in range(12)]
    docs += [(20, unique(300)), (21, unique(80)), (22, f"{unique(10)} {other}"), (23, " ".join(changed) + " " + unique(90)), (24, " ".join(passage.split()[:40]) + " " + unique(100))]
    docs += [(30 + (i or 0), t) if i is not None else (None, passage) for i, t in ODD] + [(60, None)]
    docs += [(70, f"{passage} {unique(20)} {passage}")]
    got = compact_windows.near_passages(documents(spark, docs)).collect()
    tied = defaultdict(set)
    for r in got:
        tied[r["doc_id"]].add(r["match_doc_id"])
        tied[r["match_doc_id"]].add(r["doc_id"])
    reach, todo = set(), [0]
    while todo:
        x = todo.pop()
        if x not in reach:
            reach.add(x)
            todo += tied[x]
    assert reach == {*range(12), 70}
    assert 22 in tied[23] and not {20, 21, 24} & {*tied}
    text = dict(d for d in docs if d[0] is not None)
    for r in got:
        a = text[r["doc_id"]].split()[r["start_word"] : r["end_word"]]
        b = text[r["match_doc_id"]].split()[r["match_start"] : r["match_end"]]
        sa, sb = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert len(a) == r["n_words"] >= 50 and len(sa & sb) / len(sa | sb) == pytest.approx(r["similarity"]) and r["similarity"] >= 0.8
    assert compact_windows.near_passages(documents(spark, [])).count() == 0


def test_passages_of_frequent_lines_are_tied_to_texts_that_have_them(spark):
    rng = random.Random(14)
    fresh = iter(range(10**6))
    unique = lambda n: " ".join(f"u{next(fresh)}" for _ in range(n))
    lines = [unique(12) for _ in range(6)]
    passage = " ".join(lines)
    # earlier texts hold each line, and each two of them, in other surroundings
    docs = [(i, " ".join(f"{x} {unique(60)}" for x in rng.sample(lines, 6))) for i in range(8)]
    docs += [(8 + i, " ".join(f"{unique(60)} {a} {b}" for a, b in zip(lines, lines[1:]))) for i in range(8)]
    docs += [(100 + i, f"{unique(30)} {passage} {unique(30)}") for i in range(3)]
    got = compact_windows.near_passages(documents(spark, docs)).collect()
    assert {(101, 100), (102, 100)} <= {(r["doc_id"], r["match_doc_id"]) for r in got} <= {(101, 100), (102, 100), (102, 101)}
    assert all(r["n_words"] >= (72 if r["match_doc_id"] == 100 else 50) and r["similarity"] >= 0.8 for r in got)


@pytest.mark.parametrize("base_last", [True, False])
def test_families_of_near_copies_stay_connected(spark, base_last):
    """Most copies are near the base only, not near each other."""
    rng = random.Random(16)
    fresh = iter(range(10**6))
    unique = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    docs, true = [], set()
    for _ in range(10):
        base = unique(60)
        members = [base[:p] + unique(1) + base[p + 1 :] for p in (rng.randrange(60) for _ in range(20))]
        members = [*members, base] if base_last else [base, *members]
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in members]
        true |= {(len(docs) + i, len(docs) + j) for i in range(21) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
        docs += [(len(docs) + i, " ".join(unique(rng.randrange(40)) + m + unique(rng.randrange(40)))) for i, m in enumerate(members)]
    got = {(r["doc_id"], r["match_doc_id"]) for r in compact_windows.near_passages(documents(spark, docs)).collect()}
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    in_true = {x for pair in true for x in pair}
    assert len(in_true & {x for pair in got for x in pair}) >= 0.95 * len(in_true)
    assert sum(find(a) == find(b) for a, b in true) >= 0.95 * len(true)
    assert all(a // 21 == b // 21 for a, b in got)


def test_groups_of_many_heads_are_divided_and_still_linked(spark, monkeypatch):
    """Large groups under a line of 20 words: near passages that hold it are found, a spanning tree of each."""
    monkeypatch.setattr(compact_windows, "_SMALL", 4)
    monkeypatch.setattr(compact_windows, "_LARGE", 12)
    rng = random.Random(17)
    fresh = iter(range(10**6))
    unique = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    line, docs = unique(20), []
    for i in range(60):
        docs.append((i, " ".join(unique(50) + line + unique(50))))
    for f in range(5):
        passage = unique(25) + line + unique(25)
        for i in range(4):
            at = rng.randrange(70)
            docs.append((100 + 10 * f + i, " ".join(unique(30) + passage[:at] + unique(1) + passage[at + 1 :] + unique(30))))
    got = {(r["doc_id"], r["match_doc_id"]) for r in compact_windows.near_passages(documents(spark, docs)).collect()}
    assert all(a >= 100 and a // 10 == b // 10 for a, b in got)
    assert len({x for pair in got for x in pair}) >= 18


def test_the_base_of_a_large_family_is_compared_first():
    """200 rows, each unlike the last one in one place: one step joins them all."""
    rng = np.random.default_rng(4)
    s = np.tile(rng.integers(0, 60_000, 93), (201, 1)).astype(np.int32)
    for i in range(200):
        at = int(rng.integers(0, 88))
        s[i, at : at + 5] = rng.integers(0, 60_000, 5)
    i, j, left = compact_windows.links_of(np.array([0]), np.arange(201), s, 80, 46)
    assert len(i) == 200 and len(left) == 0 and (i == 200).sum() >= 150


def test_pairs_in_large_groups_are_all_compared():
    """Near passages without a run of 16 words beside the token that 180 texts hold, alone and in blocks."""
    rng = np.random.default_rng(5)
    s = rng.integers(0, 60_000, (180, 93)).astype(np.int32)
    s[:, 46] = 7
    for i in range(0, 60, 2):
        s[i + 1, 15:61] = s[i, 15:61]
        s[i + 1, 47:52] = rng.integers(0, 60_000, 5)
        s[i, :15] = -1
    order = rng.permutation(180)
    want = {tuple(sorted((int(np.flatnonzero(order == i)[0]), int(np.flatnonzero(order == i + 1)[0])))) for i in range(0, 60, 2)}
    i, j, _ = compact_windows.links_of(np.array([0]), np.arange(180), s[order], 80, 46)
    assert {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist())} == want
    side = order % 2
    i, j, _ = compact_windows.links_of(np.array([0]), np.arange(180), s[order], 80, 46, side)
    assert {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist())} == want


def test_pairs_that_share_one_repeated_token_are_not_verified(monkeypatch):
    """Most places of 46 hold the token that two slices share, but it is one of several different ones."""
    rng = np.random.default_rng(6)
    s = rng.integers(0, 60_000, (70, 93)).astype(np.int32)
    s[:60, 46:85] = 7
    s[60:, 46:] = 7
    asked, verify = [], compact_windows.verify
    monkeypatch.setattr(compact_windows, "verify", lambda *x: asked.append(1) or verify(*x))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60, 70)))
    assert not compact_windows.linked(s, i, j, 80, 46).any()
    assert not asked
    i, j = np.triu_indices(10, 1)
    assert compact_windows.linked(s, i + 60, j + 60, 80, 46).all()


def test_few_pairs_of_a_large_group_are_compared_by_place(monkeypatch):
    """Slices of a common text of whose tokens most pairs share many but hold no near passage, runs of
    one token, and some near copies: few pairs are compared in full, among them all that are linked."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 16, 93)
    s = np.tile(base, (150, 1)).astype(np.int32)
    for row in s[:100]:
        for at in rng.integers(0, 93, 12):
            row[at : at + 4] = rng.integers(0, 1 << 16, len(row[at : at + 4]))
    s[100:140] = rng.integers(0, 1 << 16, (40, 93))
    for k, row in enumerate(s[100:140]):
        row[46 : 46 + 20 + k // 2] = base[46]
    s[140:] = s[:10]
    s[140:145, 3:7] = 7
    s[145:, 60:] = -1
    i, j = np.triu_indices(150, 1)
    want = compact_windows.linked(s, i, j, 80, 46)
    marks = compact_windows._Marks(s, np.arange(150), 80, 46)
    some, near = marks.share(i, j)
    fit = marks.fit(i, j, near)
    assert want.any() and not (want & ~(some & fit)).any()
    assert (compact_windows.linked(s, i, j, 80, 46, near=near) == want).all()
    assert not (want & ~np.isin(i * 150 + j, np.concatenate([np.minimum(x, y) * 150 + np.maximum(x, y) for x, y in compact_windows._likely_pairs(s, 80, 46, marks.near)]))).any()
    n, plain = [], compact_windows.linked
    monkeypatch.setattr(compact_windows, "linked", lambda s, i, j, *a, **k: (n.append(len(i)), plain(s, i, j, *a, **k))[1])
    a, b, _ = compact_windows.links_of(np.array([0]), np.arange(150), s, 80, 46)
    assert sum(n) < len(i) // 5
    label = np.arange(150)
    for x, y in zip(a.tolist(), b.tolist()):
        label[label == label[y]] = label[x]
    assert (label[i[want]] == label[j[want]]).all()


def test_pairs_are_linked_as_verify_finds():
    """Slices of changed, moved and repeated tokens, some of them cut short."""
    rng = np.random.default_rng(7)
    rows = []
    for f in range(30):
        base = rng.integers(0, 60_000 if f % 3 else 30, 93)
        if f % 5 == 0:
            base[20:70] = np.repeat(base[20:30], 5)
        for _ in range(6):
            x = np.roll(base, int(rng.integers(-8, 9)))
            at = rng.integers(0, 93, int(rng.integers(0, 16)))
            x[at] = rng.integers(0, 60_000, len(at))
            lo = int(rng.integers(0, 70))
            x[lo : lo + 20] = rng.permutation(x[lo : lo + 20])
            x[: int(rng.integers(0, 20)) * int(rng.integers(0, 2))] = -1
            x[93 - int(rng.integers(0, 20)) * int(rng.integers(0, 2)) :] = -1
            rows.append(x)
    s = np.array(rows, np.int32)
    i, j = (np.concatenate(x) for x in zip(*((f + a, f + b) for f in range(0, 180, 6) for a, b in [np.triu_indices(6, 1)])))
    most = np.int32(180)
    in_place = compact_windows._holds(((s[i] == s[j]) & (s[i] >= 0)) * most - np.int32(160), 46)
    want = [bool(sure or compact_windows.verify(x[x >= 0], y[y >= 0], 80, 46)) for sure, x, y in zip(in_place, s[i], s[j])]
    got = compact_windows.linked(s, i, j, 80, 46)
    assert 50 < sum(want) < 400 and got.tolist() == want


def test_near_passages_under_a_token_of_many_texts_are_found(spark, monkeypatch):
    """Words are changed within a third of a passage on both sides of a line that 150 other texts hold."""
    fresh = iter(range(10**6))
    unique = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    line = unique(6)
    docs = [(i, " ".join(unique(60) + line + unique(60))) for i in range(150)]
    for f in range(40):
        # the line's tokens are the only ones that some pairs share as a smallest one
        a, b = unique(54), unique(54)
        passage = a + line + b
        other = a[:42] + unique(1) + a[43:] + line + b[:11] + unique(1) + b[12:]
        docs += [(1000 + 2 * f, " ".join(unique(30) + passage + unique(30))), (1001 + 2 * f, " ".join(unique(30) + other + unique(30)))]
    monkeypatch.setattr(compact_windows, "_LARGE", 40)
    got = {(r["doc_id"], r["match_doc_id"]) for r in compact_windows.near_passages(documents(spark, docs)).collect()}
    assert got == {(1001 + 2 * f, 1000 + 2 * f) for f in range(40)}


def test_nearest_smaller_values():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(0, 40))
        x, own = rng.integers(1, 9, n).astype(np.uint64), np.sort(rng.integers(0, 4, n))
        before, after = compact_windows._nearest(x, own, True), compact_windows._nearest(x, own, False)
        for i in range(n):
            assert before[i] == max((j for j in range(i) if own[j] == own[i] and x[j] <= x[i]), default=n)
            assert after[i] == min((j for j in range(i + 1, n) if own[j] == own[i] and x[j] < x[i]), default=n)


def test_longer_versions_are_found_in_both_directions():
    b = np.arange(60, dtype=np.uint32)
    a = np.concatenate([b[:28], np.arange(1000, 1010, dtype=np.uint32), b[32:]])
    for x, y in ((a, b), (b, a)):
        ((i, j, u, v, similarity),) = compact_windows.verify(x, y, 80, 46)
        assert (j - i, v - u, similarity) == (len(x), len(y), 56 / 70)


def test_shorter_passages_are_found_in_stretches_that_fail():
    far = lambda k, n: np.arange(1000 * k, 1000 * k + n, dtype=np.uint32)
    b = np.concatenate([np.arange(60, dtype=np.uint32), far(1, 200), np.arange(60, 90, dtype=np.uint32)])
    a = np.concatenate([np.arange(30, dtype=np.uint32), far(2, 5), np.arange(35, 60, dtype=np.uint32), np.arange(60, 90, dtype=np.uint32)])
    for x, y in ((a, b), (b, a)):
        got = compact_windows.verify(x, y, 80, 46)
        assert len(got) == 1 and got[0][4] >= 0.8
        i, j, u, v = got[0][:4]
        assert min(j - i, v - u) >= 46


# --- 9 licences


def test_licences_are_found_and_prose_is_not(spark):
    rng = random.Random(11)
    docs = [(i, "\n".join(prose(rng, 12) for _ in range(5))) for i in range(200)]
    net = license_scan.train(documents(spark, docs))
    texts = [(1, prose(rng, 20) + "\nReleased under the MIT License.\n" + prose(rng, 9)), (2, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0."), (3, "He lost his driving license, version 2."), (4, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3."), *[(100 + (i or 0), t) for i, t in ODD]]
    got = {r["doc_id"]: r for r in license_scan.scan(documents(spark, texts), net).collect()}
    assert [got[i]["families"] for i in (1, 2, 3, 4)] == [["mit"], ["apache-2.0"], [], ["cc-by-nc", "gpl"]]
    find = got[1]["finds"][0]
    assert texts[0][1].encode()[find["start"] :].startswith(b"Released under the MIT License.")
    assert all(not r["families"] for i, r in got.items() if i >= 100) and got[101]["n_paragraphs"] == 0
    assert license_scan.scan(documents(spark, []), license_scan.train(documents(spark, []))).count() == 0


def test_wrapped_notices_are_found(spark):
    rng = random.Random(15)
    docs = [(i, "\n".join(prose(rng, 12) for _ in range(5))) for i in range(200)]
    net = license_scan.train(documents(spark, docs))
    notice = {"mit": license_scan.TEMPLATES["mit"][2], "gpl": license_scan.TEMPLATES["gpl"][1], "mpl-2.0": license_scan.TEMPLATES["mpl-2.0"][0]}
    texts, want, i = [], {}, 0
    for family, t in notice.items():
        for width in (40, 72):
            for mark, end in (("", "\n"), (" * ", "\r\n"), ("# é ", "\n")):
                lines = [mark + x for x in textwrap.wrap(t, width)]
                texts.append((i, end.join(["é " + prose(rng, 9), *lines, prose(rng, 9)])))
                want[i] = [family]
                i += 1
    texts.append((99, "\n".join(prose(rng, 9) for _ in range(20)) + "\nof the\nterms of the\nsoftware of the"))
    got = {r["doc_id"]: r for r in license_scan.scan(documents(spark, texts), net).collect()}
    assert {i: got[i]["families"] for i in want} == want and got[99]["families"] == []
    for i, t in texts[:-1]:
        (find,) = got[i]["finds"]
        part = t.encode()[find["start"] :].decode()[: find["n_chars"]]
        assert "\n" in part and find["confirmed"] >= 0.5
    # a notice that follows in another text is none
    half = notice["mit"].split()
    assert not any(r["families"] for r in license_scan.scan(documents(spark, [(1, " ".join(half[:12])), (2, " ".join(half[12:24]))]), net).collect())


# --- 10 exact dedup


def test_minimal_perfect_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 1000):
        d = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
        mph = exact_dedup.MinimalPerfectHash.build(d)
        assert sorted(mph.slots(d).tolist()) == list(range(n))


def brute_exact(docs):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in docs]
    groups = defaultdict(list)
    for (d, _), t in zip(docs, norm):
        groups[t].append(d)
    seen, out = set(), []
    for (d, _), t in zip(docs, norm):
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((d, keep, len(groups[t]), d == keep and (d, t) not in seen, hashlib.sha256(t.encode()).hexdigest()))
        seen.add((d, t))
    return out


def test_exact_groups_are_those_of_brute_force(spark):
    rng = random.Random(12)
    docs = ODD + [(i, rng.choice(["a  b", "a b", "a\tb ", f"only {i}", "hot"])) for i in range(100, 400)] + [(None, "hot"), (None, "nobody"), (None, "nobody")]
    got = exact_dedup.exact_dedup(documents(spark, docs)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_exact(docs), key=str)
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0


def test_hot_digests_are_spread_by_size(spark):
    groups = spark.createDataFrame([("a", 100_000), ("b", 10_000), ("c", 1)], "sha string, n long")
    n = common.partitions(spark)
    share = -(-110_001 // n)
    assert {r["sha"]: r["salts"] for r in exact_dedup.hot_digests(groups, 110_001).collect()} == {"a": -(-100_000 // share)}
    docs = [(i, "hot" if i % 3 else f"t{i}") for i in range(3000)]
    got = exact_dedup.exact_dedup(documents(spark, docs)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_exact(docs), key=str)


def test_history_wins_and_nonmembers_group_among_themselves(spark):
    history = documents(spark, [(10, "old"), (11, "old"), (12, "other")])
    docs = documents(spark, [(1, "old"), (2, "new"), (3, "new "), (4, "new"), (5, "old")])
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs, history).collect()}
    assert got == {1: (10, 4, False), 5: (10, 4, False), 2: (2, 2, True), 4: (2, 2, False), 3: (3, 1, True)}


@pytest.mark.parametrize("most", [100_000, 0])
def test_dropping_keeps_one_of_each_text(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BROADCAST", most)
    docs = documents(spark, [(1, "a b"), (1, "a  b"), (2, "a b"), (3, None), (4, ""), (None, "a b"), (2, "c")])
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], (r["text"] or "").split()) for r in kept.collect()), key=str) == sorted([(1, ["a", "b"]), (2, ["c"]), (3, []), (None, ["a", "b"])], key=str)
