"""Corpus operators against brute force on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
import zstandard

from quotegrain.llm import anchors, bpe, components, decontaminate, fingerprint_index, lang_id, simhash, suffix_dedup, token_count, url_filter, vptree, warc

SCHEMA = "doc_id long, text string, lang string, g long, fp long, b long, score double"
HOT = [1024, 2]  # also with every shared hash dealt out by windows


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, 0.5) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    vocab = ["".join(r.choices("abcdeé", k=r.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(r.choices(vocab, k=n))
    passage = [text(30) for _ in range(4)]
    out = []
    for i in range(60):
        parts = [text(r.randint(0, 60))]
        if r.random() < 0.6:
            parts += [r.choice(passage), text(r.randint(0, 20))]
        out.append((i * 3 + 1, " ".join(parts)))
    out += [(500, None), (501, ""), (502, out[0][1]), (503, out[0][1]), (504, "a" * 400), (505, "a" * 300), (506, " \t\n"), (507, passage[0].replace(" ", "  \n", 3)), (508, text(4000)), (509, "é" * 60)]
    r.shuffle(out)
    return out


def byte_removal(rows):
    """Brute force: of each row, the bytes removed, the bytes kept, and how many there were."""
    rows, starts = [(i, (t or "").encode()) for i, t in rows], {}
    for i, t in rows:
        for k in range(len(t) - 49):
            starts[t[k : k + 50]] = min(starts.get(t[k : k + 50], i), i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if starts[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        out.append((i, int(gone.sum()), np.frombuffer(t, np.uint8)[~gone].tobytes(), len(t)))
    return out


@pytest.mark.parametrize("hot", HOT)
def test_suffix_dedup(spark, corpus, hot):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(spark, corpus), hot_pieces=hot).collect()}
    for i, gone, kept, n in byte_removal(corpus):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.kept_sha256, bytes(r.kept)) == (n, gone, hashlib.sha256(kept).hexdigest(), kept), i
        assert sum(s.end - s.start for s in r.spans) == gone and len(r.spans) == r.n_spans


def window_removal(rows):
    """Brute force: of each row, its words, the words removed, and the text kept."""
    rows, starts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows], {}
    for i, words in rows:
        for k in range(len(words) - 12):
            w = tuple(words[k : k + 13])
            starts[w] = min(starts.get(w, i), i)
    out = []
    for i, words in rows:
        gone = [False] * len(words)
        for k in range(len(words) - 12):
            if starts[tuple(words[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out.append((i, len(words), sum(gone), " ".join(w for w, x in zip(words, gone) if not x)))
    return sorted(out)


def found(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())


@pytest.mark.parametrize("hot,cuts", [(1024, ()), (1024, fingerprint_index.CUTS), (2, (0.3, 0.5, 0.7, 0.9))])
def test_window_index(spark, corpus, hot, cuts):
    assert found(fingerprint_index.remove_repeated_windows(docs(spark, corpus), cuts=cuts, hot_pieces=hot)) == window_removal(corpus)


def test_window_index_small_pieces(spark, corpus, monkeypatch):
    """Sets of several pieces, sent in several parts."""
    pack = anchors.pack
    for module in (anchors, fingerprint_index):
        monkeypatch.setattr(module, "pack", lambda df, i, t, most, batch=0, carry=(): pack(df, i, t, 4000, batch, 800, carry))
    monkeypatch.setattr(anchors, "FLUSH_BYTES", 3000)
    one = docs(spark, corpus).coalesce(1)
    assert found(fingerprint_index.remove_repeated_windows(one)) == window_removal(corpus)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(one).collect()}
    assert got == {i: n for i, n, *_ in byte_removal(corpus)}


def test_windows_are_compared_once():
    """Each window belongs to one anchor, at the same place in equal windows; also where grams repeat, and over blocks."""
    r = random.Random(5)
    texts = [bytes(r.choices(b"abcd ", k=n)) for n in (0, 49, 50, 3000, 70_000)] + [b"a" * 300, b"ab" * 200, b"", b"x" * 49]
    texts += [texts[3][100:900] + texts[3][:500]]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    places, hashes, left, right = anchors.find_anchors(suffix_dedup.BYTES, data, offsets)
    own = {}
    for p, h, a, b in zip(places.tolist(), hashes.tolist(), left.tolist(), right.tolist(), strict=True):
        for k in range(a + b - suffix_dedup.BYTES.reach + 1):
            assert own.setdefault(p - a + k, (a - k, h)) == (a - k, h) and 0 <= a - k <= suffix_dedup.BYTES.reach
    assert sum(left + right - suffix_dedup.BYTES.reach + 1) == len(own)
    assert sorted(own) == [i for a, b in zip(offsets[:-1], offsets[1:], strict=True) for i in range(a, b - 49)]
    at = {}
    for i, x in own.items():
        assert at.setdefault(data[i : i + 50].tobytes(), x) == x


def test_hot_hashes_send_few_texts():
    """Of hashes in very many pieces: a few texts for each place where a common line ends, and what repeats once."""
    r = random.Random(6)
    line = bytes(r.choices(b"abcdefgh ", k=120))
    texts = [bytes(r.choices(b"ijklmnop ", k=60)) + line + bytes(r.choices(b"ijklmnop ", k=60)) for _ in range(200)] + [line] * 200
    piece = anchors._squeeze(np.arange(400), np.array([*map(len, texts)]), np.zeros(0, np.uint8)), zstandard.ZstdCompressor().compress(b"".join(texts))
    group = anchors.Group(suffix_dedup.BYTES, *piece, 7)
    x = anchors._Shared(group, group.several * np.uint8(anchors.SHARED | anchors.HOT))
    u = x.units(np.full(len(x.least), -1), 7)
    windows = x.left[x.firsts] + x.right[x.firsts] - suffix_dedup.BYTES.reach + 1
    assert len(u.place) < 0.5 * windows.sum() and len(u.place) < 200 * 2 * 2 * 49 / anchors.STEP
    rows = suffix_dedup._rows_of(group, u.place, u.left, u.right)
    assert len({(k, a, b, row.tobytes()) for k, a, b, row in zip(u.key.tolist(), u.left.tolist(), u.right.tolist(), rows, strict=True)}) == len(u.place)
    # each window of each class finds its own text
    text = np.concatenate([rows[i, suffix_dedup.BYTES.reach - u.left[i] + k :][:50] for i in range(len(u.place)) for k in range(u.wide[i])]).reshape(-1, 50)
    for c, first in enumerate(x.firsts.tolist()):
        for k in range(windows[c]):
            i = x.place[first] - x.left[first] + k
            assert (text[u.value_of[u.base[c] + k]] == group.data[i : i + 50]).all()


@pytest.mark.parametrize("hot", HOT)
def test_common_lines_in_small_pieces(spark, monkeypatch, hot):
    """Lines that many pieces have, between texts of their own, some of which come again."""
    r = random.Random(7)
    text = lambda n: "".join(r.choices("abcdefgh ", k=n))
    lines, beside = [text(n) for n in (50, 76, 110)], [text(40) for _ in range(30)]
    rows = [(i, "\n".join(r.choice([r.choice(lines), r.choice(beside), text(30)]) for _ in range(r.randint(1, 9)))) for i in range(150)]
    pack = anchors.pack
    monkeypatch.setattr(anchors, "pack", lambda df, i, t, most: pack(df, i, t, 6000, piece_bytes=900))
    monkeypatch.setattr(anchors, "FLUSH_BYTES", 20_000)
    got = {x.doc_id: (x.n_removed, bytes(x.kept), [(y.start, y.end) for y in x.spans]) for x in suffix_dedup.remove_repeats(docs(spark, rows), hot_pieces=hot).collect()}
    for i, gone, kept, n in byte_removal(rows):
        spans = got[i][2]
        assert got[i][:2] == (gone, kept) and sum(b - a for a, b in spans) == gone
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:])) and all(0 <= a < b <= n for a, b in spans)  # noqa: B905


def test_rows_between_sets_grow_with_the_input(monkeypatch):
    """Partitions that follow the input don't make sets that are as many times as many buckets."""
    rows = []
    for gb in (1, 10, 50):
        monkeypatch.setattr(anchors, "shuffle_parts", lambda spark, gb=gb: 60 * gb)
        plan = anchors.layout(None, gb * 10**9)
        assert plan.set_bytes <= anchors.MOST_SET
        rows.append(10**9 / plan.set_bytes * plan.buckets)
    assert rows[1] < 6 * rows[0] and rows[2] < 10 * rows[0]


def test_replies_are_unpacked_once(monkeypatch):
    expand, calls = anchors._expand, []
    monkeypatch.setattr(anchors, "_expand", lambda *a: calls.append(1) or expand(*a))
    rows = [{"b": b, "part": part, "reply": anchors._squeeze(np.arange(9) + 100 * b + 1000 * part)} for part in (1, 0) for b in (5, 2)]
    replies = anchors._Replies(rows)
    taken = [replies.take(np.array([2, 2, 2, 5, 5, 5]), np.int64).tolist() for _ in range(6)]
    assert taken[1] == [203, 204, 205, 503, 504, 505] and taken[5] == [1206, 1207, 1208, 1506, 1507, 1508] and len(calls) == 4


def test_window_index_opened_again(spark, corpus, tmp_path):
    rows = sorted((i, t) for i, t in corpus)
    index = fingerprint_index.FingerprintIndex.create(spark, str(tmp_path / "index"), 10000)
    got = []
    for k in range(0, len(rows), 20):
        part = docs(spark, rows[k : k + 20])
        if k:
            with pytest.raises(ValueError):  # a batch that isn't later leaves nothing behind
                fingerprint_index.FingerprintIndex.open(spark, index.path).add(docs(spark, [(0, rows[9][1])]), "doc_id", "text", None, "")
        got += found(fingerprint_index.remove_repeated_windows(part, cuts=(), index=fingerprint_index.FingerprintIndex.open(spark, index.path)))
    assert sorted(got) == window_removal(corpus)
    assert max(level for _, level in [tuple(r.values()) for r in fingerprint_index.FingerprintIndex.open(spark, index.path).state["runs"]]) > 0


def test_repeated_and_null_ids(spark):
    """Rows of one id are judged each against smaller ids; rows without an id keep everything."""
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, long), (5, long), (7, long), (7, None), (9, "x " + long), (3, "short")]
    assert found(fingerprint_index.remove_repeated_windows(docs(spark, rows), cuts=(0.5,))) == window_removal(rows)
    named = suffix_dedup.remove_repeats(docs(spark, [*rows, (None, long), (None, None)])).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in named if r.doc_id is not None) == sorted((i, n, g) for (i, g, *_), n in ((r, r[3]) for r in byte_removal(rows)))
    assert sorted((r.n_bytes, r.n_removed) for r in named if r.doc_id is None) == [(0, 0), (len(long), 0)]


def test_empty_tables(spark):
    none = docs(spark, [])
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert fingerprint_index.remove_repeated_windows(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert token_count.count_tokens(none, "piece_bpe_32k.model").count() == 0
    assert lang_id.predict(none, lang_id.train(none)).count() == 0
    assert decontaminate.leaks(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert vptree.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "x y " * 20), (1, "x y " * 20)], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(df, keep_text=False).collect()} >= {(None, 0), (1, 0)}
    assert {(r.doc_id, r.n_words, r.n_removed) for r in fingerprint_index.remove_repeated_windows(df).collect()} == {(None, 40, 0), (1, 40, 0)}


def test_suffix_buckets():
    data = np.frombuffer(b"abcab" * 40 + b"x" + b"abcab" * 30, np.uint8)
    b = suffix_dedup.suffix_buckets(data)
    cut = lambda k: data[k : k + 50].tobytes()
    for i in range(0, len(data) - 50, 7):
        for j in range(0, len(data) - 50, 11):
            assert (b[i] == b[j]) == (cut(i) == cut(j))


def plain_fingerprint(text):
    """The definition, bit by bit."""
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[k : k + 4]) for k in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("block", [4096, 3])  # also with nearly every list split and dealt out by blocks
def test_simhash_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(5)
    words = ["w%d" % k for k in range(200)]
    base = [" ".join(r.choices(words, k=60)) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(150):
        t = r.choice(base).split()
        t[r.randrange(len(t))] = "Zz"
        rows.append((1000 + k, " ".join(t)))
    rows += [(5000, None), (5001, ""), (5002, "One two"), (5003, "one  TWO"), (5004, base[0]), (5005, "Éa É b\u00a0c " * 3000), (5006, "one\x0bTWO")]
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(docs(spark, rows)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    assert fps[0] == simhash.fingerprint(rows[0][1].encode())
    ids, parent = list(fps), {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert got == {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def test_similar_documents(spark):
    r = random.Random(6)
    words = ["w%d" % k for k in range(2000)]
    rows, edited = [], {}
    for k in range(120):
        text = r.choices(words, k=300)
        rows.append((k, " ".join(text)))
        for at in r.sample(range(300), 2 if k % 2 else 60):  # similarity above 0.9, or below 0.2
            text[at] = "Zz%d" % at
        rows.append((1000 + k, " ".join(text)))
        edited[1000 + k] = k
    rows += [(5000, None), (5001, ""), (5002, rows[0][1].upper()), (None, rows[0][1])]
    got = {x.doc_id: x.component_id for x in simhash.similar(docs(spark, rows)).collect()}
    assert got[5000] == got[5001] == 5000 and got[5002] == got[None] == got[0] == 0
    near = [i for i, k in edited.items() if k % 2]
    assert sum(got[i] == edited[i] for i in near) / len(near) >= 0.9
    assert all(got[i] == i for i, k in edited.items() if k % 2 == 0) and all(got[k] == k for k in range(120))
    assert simhash.bits_at(1.0, 128) == 0 and simhash.bits_at(0.8, 128) == 20
    assert simhash.similar(docs(spark, [])).count() == 0


def test_similar_equals_brute_force(spark, monkeypatch):
    from quotegrain.llm import shingle_sets

    r = random.Random(8)
    rows = []
    for k in range(150):  # pairs of 96 shingles each; one changed run of words at an end keeps 1 - n / 96 of them
        text = ["w%d" % r.randrange(10**6) for _ in range(100)]
        n = r.choice([6, 8, 9, 10, 11, 12, 13, 16, 20])
        rows += [(k, " ".join(text)), (1000 + k, " ".join(text[:-n] + ["z%d_%d" % (k, j) for j in range(n)]))]
    chain = ["c%d" % j for j in range(160)]
    rows += [(3000 + k, " ".join(chain[k * 5 : 100 + k * 5])) for k in range(12)]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    ids = sorted(sets)
    want = {i: i for i in ids}
    near = [(x, y) for x in ids for y in ids if x < y and len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.8]
    for _ in ids:
        for x, y in near:
            want[x] = want[y] = min(want[x], want[y])
    assert 40 < len(near) < 150
    for block in (1 << 20, 200):  # also with the chain dealt out by blocks
        monkeypatch.setattr(shingle_sets, "BLOCK", block)
        assert {x.doc_id: x.component_id for x in simhash.similar(docs(spark, rows)).collect()} == want


def test_unlike_documents_are_not_gathered(spark, monkeypatch):
    """Documents that share half their words, with no pair at 0.8, are in no group; those of long lists are compared too."""
    from quotegrain.llm import shingle_sets

    r = random.Random(9)
    common = [" ".join("s%d_%d" % (k, j) for j in range(10)) for k in range(10)]
    rows = [(k, " ".join(x for c in common for x in (c, " ".join("o%d" % r.randrange(10**7) for _ in range(10))))) for k in range(600)]
    rows += [(1000 + k, rows[k][1] + " end") for k in range(0, 600, 60)]
    for stars, block in ((3, 1024), (0, 2)):
        monkeypatch.setattr(shingle_sets, "STARS", stars)
        monkeypatch.setattr(shingle_sets, "SKETCHES", block)
        factors = np.random.default_rng(42).integers(0, 1 << 64, (29, 5), np.uint64) | np.uint64(1)
        names = {}
        for i, t in rows:
            found = shingle_sets.shingles(t.encode(), 5)
            least = shingle_sets._minima(found, factors)
            names[i] = (int(shingle_sets._name(found)[0]), shingle_sets._bands(least, factors).tolist(), least.astype(np.uint8).tobytes())
        nodes = spark.createDataFrame(list(names.values()), "a long, bands array<long>, sketch binary")
        lists = nodes.selectExpr("a", "explode(bands) AS list")
        assert lists.groupBy("list").count().where("count > 1").count() > 100
        links = shingle_sets._candidate_links(nodes, shingle_sets.agreeing(0.8, 145)).distinct().collect()
        assert {frozenset(x) for x in links} == {frozenset((names[k][0], names[1000 + k][0])) for k in range(0, 600, 60)}
    got = {x.doc_id: x.component_id for x in simhash.similar(docs(spark, rows)).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i in got}


def test_position_sets():
    from itertools import combinations

    for need in range(1, 9):
        sets = [set(s) for s in simhash.position_sets(need)]
        assert all(any(s <= set(c) for s in sets) for c in combinations(range(8), need))


def test_components(spark):
    df = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 8), (9, 7), (None, 1)], "u long, v long")
    assert {(r.node, r.component) for r in components.components(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (7, 7), (8, 7), (9, 7)}


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    from quotegrain.llm.common import tokenizer_path

    lib, own = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), bpe.load("word_bpe_49k.json")
    r = random.Random(1)
    pool = [chr(c) for c in range(1, 0x250)] + list("aaaabbb  \n'sSΣσ東é️ \x1c\x85İ😀½") + ["<|endoftext|>", "'re", "aaaaaaaa", "the", " "]
    rows = [(k, "".join(r.choices(pool, k=r.randint(0, 40)))) for k in range(1500)] + [(9999, None), (9998, "word " * 5000)]
    got = {x.doc_id: x for x in bpe.encode_decode(docs(spark, rows), "word_bpe_49k.json").collect()}
    for i, t in rows:
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want and got[i].decoded == lib.decode(want, skip_special_tokens=False)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert own.compatible(*own.encode("hello world")[:2].tolist())


def test_bpe_keeps_the_words_of_a_task(monkeypatch):
    known = bpe.WordBpe(bpe.tokenizer_path("word_bpe_49k.json"))
    letters = "abcdefghijklmnop"
    text = " ".join(letters[k >> 12 & 15] + letters[k >> 8 & 15] + letters[k >> 4 & 15] + letters[k & 15] + "q" * (1 + (k >> 16)) for k in range(120_000))
    first = known.encode(text).tolist()
    monkeypatch.setattr(known, "encode_word", lambda word: pytest.fail(f"{word} is encoded again"))
    assert known.encode(text).tolist() == first


def test_token_counts_equal_the_library(spark):
    model = token_count._model("piece_bpe_32k.model")
    r = random.Random(2)
    pool = [chr(c) for c in range(9, 0x250)] + ["  ", "   ", "▁", "<s>", "the", " the", "\r\n", ";\r", "1", "23", "東", "ＡＢ", "ﬁ", "①", "e\u0301", "\u0301", "が", "㌔", "\u200b", "\u00ad", "\x00", "\ufeff", "½", "ｶﾞ", "\u3000", "İ", "한국"]
    rows = [(k, "".join(r.choices(pool, k=r.randint(0, 40)))) for k in range(800)] + [(9999, None), (9998, "word " * 6000), (9997, " ")]
    got = {x.doc_id: x for x in token_count.count_tokens(docs(spark, rows), "piece_bpe_32k.model").collect()}
    for i, t in rows:
        n = len(model.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 4096), t


def test_language_id(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lang_id.held_out()
    out = lang_id.predict(df.where(held), lang_id.train(df.where(~held))).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97 and all(0 <= r.score <= 1 for r in out)
    odd = lang_id.predict(docs(spark, [(1, None), (2, "12 34 !"), (3, "")]), None).collect()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in odd)


def test_language_id_equals_plain_ridge(spark):
    """Kernel, Nystroem map and ridge written out, on the same sample; the sample is bounded whatever the rows."""
    r = random.Random(7)
    letters = {"xx": "abcd", "yy": "cdef", "zz": "fgha"}
    rows = [(i, " ".join("".join(r.choices(letters[lang], k=4)) for _ in range(8)), lang) for i in range(90) for lang in [list(letters)[i % 3]]]
    rows += [(500, rows[0][1], "xx")] * 300 + [(501, "½ ² ① 12", "xx"), (502, None, "yy"), (None, "abc", "zz"), (503, "abc", None)]  # repeated rows
    rows += [(600, "ab cd %d" % k, "xx") for k in range(60)]  # one id, many texts
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(df, per_language=20, landmarks=9)

    def grams(text):
        t = f" {' '.join(text.lower().split())} "
        return frozenset(t[k : k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1))

    taken = {}
    original = lang_id.fit
    try:
        lang_id.fit = lambda found, n: taken.setdefault("rows", found)
        lang_id.train(df, per_language=20, landmarks=9)
    finally:
        lang_id.fit = original
    assert 3 * 18 <= len(taken["rows"]) <= 60 and model.languages == ["xx", "yy", "zz"]
    sample = [(lang, frozenset(on.tolist())) for lang, on in taken["rows"]]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    by_lang = [[on for lang, on in sample if lang == x] for x in model.languages]
    marks = [by_lang[k % 3][k // 3] for k in range(9)]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    keep = values > 1e-6 * values.max()
    step = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.array([[kernel(on, m) for m in marks] for _, on in sample]) @ step
    weigh = np.array([1 / sum(lang == other for other, _ in sample) for lang, _ in sample])
    target = np.array([[1.0 if lang == x else -1.0 for x in model.languages] for lang, _ in sample])
    beta = np.linalg.solve(phi.T @ (phi * weigh[:, None]) + lang_id.RIDGE * np.eye(phi.shape[1]), (phi * weigh[:, None]).T @ target)
    texts = [t for _, t, _ in rows[:12]]
    row = np.zeros(lang_id.DIMS, np.float32)
    want = []
    for t in texts:
        row[:] = 0
        lang_id.mark(t, row)
        assert row.sum() <= len(grams(t))
        on = frozenset(np.flatnonzero(row).tolist())
        out = np.exp(np.array([kernel(on, m) for m in marks]) @ step @ beta * lang_id.SHARPNESS)
        want.append((model.languages[out.argmax()], out.max() / out.sum()))
    got = {x.text: x for x in lang_id.predict(df, model).collect()}
    for t, (lang, score) in zip(texts, want):
        assert got[t].lang_pred == lang and abs(got[t].score - score) < 1e-4
    assert got["½ ² ① 12"].lang_pred == "und" and got[None].score == 0.0


def test_decontamination_equals_brute_force(spark):
    r = random.Random(4)
    words = ["k%d" % k for k in range(60)]
    items = [(k, " ".join(r.choices(words, k=r.choice([4, 8, 10, 13, 20, 40])))) for k in range(24)] + [(90, None), (91, ""), (None, "a b c d e f g h i"), (7, " ".join(words[:15]))]
    rows = [(500, None), (501, ""), (None, items[4][1])]
    for k in range(120):
        t = r.choices(words, k=r.randint(5, 60))
        if k % 2:
            item = r.choice(items[:24])[1].split()
            for _ in range(r.randint(0, 4)):
                item[r.randrange(len(item))] = "Sub!"
            t[3:3] = item
        rows.append((k, " ".join(t).upper() if k % 3 else ", ".join(t)))
    rows += rows[-6:] + [(900, " ".join(["long"] * 20000) + " " + items[3][1])]  # repeated rows, a long text
    split = lambda t: re.findall(r"[0-9a-z]+", (t or "").lower())
    want = {}
    for i, t in rows:
        a = split(t)
        for j, u in items:
            b = split(u)
            n, most = (13, 2) if len(b) >= 13 else (len(b), 1)
            if i is None or j is None or n < 8:
                continue
            for p in range(len(a) - n + 1):
                wrong = min(sum(x != y for x, y in zip(a[p : p + n], b[q : q + n])) for q in range(len(b) - n + 1))
                if wrong <= most:
                    k, first, last, least = want.get((i, j), (0, p, p, 99))
                    want[(i, j)] = (k + 1, min(first, p), max(last, p + n - 1), min(least, wrong))
    bench, df = spark.createDataFrame(items, "item_id long, text string"), docs(spark, rows).repartition(3)
    got = {(x.doc_id, x.item_id): (x.n_windows, x.first_word, x.last_word, x.substitutions) for x in decontaminate.leaks(df, bench).collect()}
    assert got == want and len(want) > 30
    left = decontaminate.decontaminate(df, bench)
    assert left.columns == df.columns and sorted(str(x.doc_id) for x in left.collect()) == sorted(str(i) for i, _ in rows if i not in {i for i, _ in want})


def test_decontamination_in_any_script(spark):
    """Curly quotes, dashes and scripts without spaces; the words by Unicode categories, not by the operator's patterns."""
    import unicodedata

    def split(text):
        out = [""]
        for c in text.lower():
            alone = any(name in unicodedata.name(c, "") for name in ("CJK", "HIRAGANA", "KATAKANA", "THAI CHARACTER")) and unicodedata.category(c)[0] in "LM"
            if alone:
                out += [c, ""]
            elif unicodedata.category(c)[0] in "LMN":
                out[-1] += c
            else:
                out.append("")
        return [w for w in out if w]

    r = random.Random(12)
    plain = ["größe", "naïve", "élan", "word", "ño", "слово", "λόγια", "x9", "ab", "e\u0301t"]
    han = "汉字文本数据基准测试泄漏检查语言模型训练"
    items = [(1, " ".join(r.choices(plain, k=13))), (2, "".join(r.choices(han, k=20))), (3, "ไทยภาษาข้อความทดสอบ"), (4, " ".join(r.choices(plain, k=30)))]
    words = {i: t.split() for i, t in items}
    rows = [
        (10, "start " + " ".join(f"\u201c{w}\u201d" for w in words[1]) + " end"), (11, "\u2014".join(words[4][5:20])), (12, "前" + items[1][1] + "。"), (13, items[1][1][:6] + "、" + items[1][1][6:]),
        (14, "ก " + items[2][1]), (15, "\u00a0".join(words[1]).upper()), (16, "clean text of words \u2014 nothing more"), (17, "…".join(words[1][:12])), (18, "汉 字" + items[1][1][3:12]),
    ]
    want = set()
    for i, text in rows:
        for j, item in items:
            a, b = split(text), split(item)
            n = min(13, len(b))
            assert n >= 13 or j not in (1, 2, 4)
            if any(sum(x != y for x, y in zip(a[p : p + n], b[q : q + n])) <= 2 for p in range(len(a) - n + 1) for q in range(len(b) - n + 1)):
                want.add((i, j))
    assert {(10, 1), (11, 4), (12, 2), (13, 2), (14, 3), (15, 1)} <= want and not {16, 17} & {i for i, _ in want}
    got = decontaminate.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want


def test_spaced_masks_lose_nothing():
    from itertools import combinations

    family = decontaminate.masks()
    assert all(any(not set(m) & set(p) for m in family) for p in combinations(range(13), 2))
    assert all(m[-1] - m[0] >= len(m) for m in family)


def test_nearest(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 8))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(400, None, 0), (420, [0.0] * 8, 0), (440, [float("nan")] + [1.0] * 7, 0), (460, x[0].tolist(), 0), (461, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    good = {i: np.array(v) for i, v, _ in rows if v and np.isfinite(v).all() and any(v)}
    got = {}
    for q in vptree.nearest(df, shard=64).orderBy("query_id", "rank").collect():
        got.setdefault(q.query_id, []).append(q.vec_id)
    for q in (i for i in good if i % 20 == 0):
        want = sorted((-round(float(good[q] @ v), 9), i) for i, v in good.items() if i != q)[:20]
        assert got[q] == [i for _, i in want]
    ids = [i for i in good if i % 20 == 0]
    loose = vptree.nearest(df, shard=64, factor=0.8).collect()
    assert sum(y.vec_id in got[y.query_id] for y in loose) / (20 * len(ids)) >= 0.9


def test_nearest_of_equal_vectors(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 12))
    x[r.permutation(400)[:150]] = x[7] * 2
    order = r.permutation(400)  # ids in no order
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in order], "vec_id long, embedding array<double>")
    got = {}
    for q in vptree.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(q.query_id, []).append((q.vec_id, q.score))
    assert len(got) == 20
    ties = 0
    for q, found in got.items():
        score = (x[q] * x).sum(1)
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-score[i], i))[:20]
        assert [i for i, _ in found] == want and [s for _, s in found] == score[want].tolist()
        ties += len(set(score[want])) < 10
    assert ties


def test_nearest_whatever_the_lengths(spark):
    """Norms from 1e-3 to 1e9, repeated ids, null ids, several dimensions; many small cells and shards."""
    r = np.random.default_rng(5)
    x = r.normal(size=(500, 6)) * 10.0 ** r.integers(-3, 4, size=(500, 1))
    x[33] *= 1e9 / np.sqrt((x[33] ** 2).sum())
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600 + i, r.normal(size=3).tolist()) for i in range(60)] + [(None, [1.0] * 6), (41, x[7].tolist()), (43, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for q in vptree.nearest(df, shard=40, cells=16).orderBy("query_id", "rank").collect():
        got.setdefault(q.query_id, []).append((q.vec_id, q.score))
    known = [(i, np.array(v)) for i, v in rows if i is not None]
    for i, v in known:
        if i % 20 == 0:
            score = sorted((-float((v * w).sum()), j) for j, w in known if j != i and len(w) == len(v))[:20]
            assert got[i] == [(j, -s) for s, j in score], i
    assert len(got) == sum(i % 20 == 0 for i, _ in known)


def test_sixty_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(60)], "vec_id long, embedding array<double>")
    for row in vptree.nearest(df).groupBy("query_id").agg({"vec_id": "max", "rank": "count"}).collect():
        assert row[1:] in ((19, 20), (20, 20)) or row["query_id"] > 19


def test_warc_round_trip(spark):
    big = "<p>é\r\n\r\nWARC/1.1\r\n" * 3000
    rows = [(5, "http://a/", "same"), (3, "http://b/\r\nX: y", "same"), (9, None, None), (8, "u", ""), (7, "u", big), (12, "u", big), (1, "u", "x" * 16384)]
    records = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r for r in warc.page_report(records).collect()}
    first: dict[str, int] = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    for i, _, h in rows:
        p = (h or "").encode()
        f = first[h or ""]
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(p), warc.sha1_base32(p), "response" if f == i else "revisit", None if f == i else f)
        assert got[i].complete
    kept = {r.record_id: bytes(r.payload) for r in records.where("payload is not null").collect()}
    assert kept["urn:x-page:7"] == big.encode()


def test_warc_null_and_repeated_ids(spark):
    big = ["%d é" % k * 9000 for k in range(4)]
    rows = [(None, "n", big[0]), (None, "n", big[0]), (None, "n", big[1]), (None, None, None), (None, "n", "x"), (2, "a", big[0]), (2, "a", big[0]), (2, "b", big[2]), (2, "b", "x"), (5, "c", big[2]), (5, "c", big[2]), (5, "c", "x"), (6, "d", big[3])]
    records = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    found = records.collect()
    assert len({r.record_id for r in found}) == len(rows) and all(r.complete for r in found)
    report = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.page_report(records).collect())
    first = {h: min(i for i, _, g in rows if i is not None and g == h) for i, _, h in rows if i is not None}
    want = []
    for i, _, h in rows:
        p, f = (h or "").encode(), None if i is None or first[h] == i else first[h]
        want.append((i or 0, len(p), warc.sha1_base32(p), "revisit" if f else "response", f or 0))
    assert report == sorted(want)
    kept = {r.record_id: warc.sha1_base32(bytes(r.payload)) for r in found if r.payload is not None}
    assert all(kept[r.refers_to] == r.payload_digest for r in found if r.refers_to)


def test_warc_members_and_damage(spark, tmp_path):
    """Archives with a gzip member for each record; of a damaged one the records before the damage."""
    import gzip

    records = [r + b"\n" for i in range(6) for r in warc._records_of(f"urn:x-page:{i}", "u", "text %d " % i * 50, None, 16384)]
    members = [gzip.compress(r) for r in records]
    (tmp_path / "members.warc.gz").write_bytes(b"".join(members))
    assert sorted(r.page_id for r in warc.page_report(warc.read_archives(spark, str(tmp_path))).collect()) == list(range(6))
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "members.warc.gz").write_bytes(b"".join(members[:3]) + b"\x1f\x8bdamaged" + b"".join(members[4:]))
    (broken / "stream.warc.gz").write_bytes(gzip.compress(b"".join(records))[:-40])
    (broken / "plain.warc").write_bytes(b"".join(records)[:-30])
    (broken / "none.warc").write_bytes(b"")
    found = warc.read_archives(spark, str(broken)).collect()
    assert all(r.complete for r in found) and sum(r.record_id == "urn:x-page:2" for r in found) == 3
    # columns whose names clash are ignored, and a table may be empty
    rows = [(1, "u", "x", b"b", "d"), (1, "u", "x", b"b", "d"), (2, "u", None, None, None)]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, block binary, digest string")
    assert sorted((r.page_id, r.payload_bytes) for r in warc.page_report(warc.round_trip(odd)).collect()) == [(1, 1), (1, 1), (2, 0)]
    assert warc.round_trip(odd.limit(0)).count() == 0


def test_edges_of_texts(spark):
    """Empty tables, null ids, repeated rows and clashing names, of operators that judge rows each."""
    clash = "doc_id long, text string, n_tokens int, fp string, ids int, fingerprint int, score string, lang string, held_out int, term string"
    rows = [(i, t, 1, "f", 2, 3, "s", "en", 4, "t") for i, t in [(None, "one two three four five"), (1, "one two three four five"), (1, "one two three four five"), (2, None), (3, ""), (4, "w " * 30000)]]
    df = spark.createDataFrame(rows, clash)
    for run in (lambda d: bpe.encode_decode(d, "word_bpe_49k.json", keep_ids=False), lambda d: token_count.count_tokens(d, "piece_bpe_32k.model"), simhash.near_duplicates, lambda d: lang_id.predict(d, None)):
        out = run(df).collect()
        assert sorted((r.doc_id for r in out), key=str) == sorted((r[0] for r in rows), key=str)
        same = [tuple(r)[1:] for r in out if r.doc_id in (None, 1)]
        assert len(same) == 3 and len({str(x) for x in same if x[-1] is not None}) <= 2
        assert run(df.limit(0)).count() == 0
    pages = spark.createDataFrame([(None, "http://a.net/x", "r", "v"), (1, "http://a.net/x", "r", "v"), (1, "http://a.net/x", "r", "v"), (2, None, "r", "v")], "page_id long, url string, rule string, verdict string")
    rules = url_filter.rules_frame(spark, [("net", "/", "block")])
    assert sorted(((r.page_id, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()), key=str) == [(1, "net/", "block"), (1, "net/", "block"), (2, None, "allow"), (None, "net/", "block")]
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_pipeline_stages_of_an_empty_table(spark):
    import corpus_pipeline

    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, "/root/testdata/sf0.001").count() == 0


def test_url_filter(spark):
    rules = url_filter.rules_frame(spark, [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de", "block"), ("org", "", "block"), ("org", "", "allow")])
    urls = ["http://a.net", "http://a.net/", "HTTP://X.EXAMPLE.NET/en/1?x", "http://example.net/e", "https://w.example.com/deutsch", "http://notexample.com/de", "x", None, "http://b.org#f", "http://net/q"]
    rows = spark.createDataFrame([(k, u, "r") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(rows, rules).collect()}
    assert got == {
        0: ("a.net", "", None, "allow"), 1: ("a.net", "/", "net/", "block"), 2: ("x.example.net", "/en/1", "example.net/en/", "allow"), 3: ("example.net", "/e", "net/", "block"),
        4: ("w.example.com", "/deutsch", "example.com/de", "block"), 5: ("notexample.com", "/de", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("b.org", "", "org", "block"), 9: ("net", "/q", "net/", "block"),
    }
    deep = [(1, "http://" + "a." * 20000 + "net/" + "x/" * 20000, "r")] * 3 + [(2, "http://example.net/en//", "r"), (3, "http:///p", "r")]  # long, repeated
    found = url_filter.filter_urls(spark.createDataFrame(deep, rows.schema), rules).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in found) == [(1, "net/", "block")] * 3 + [(2, "example.net/en/", "allow"), (3, None, "allow")]
    assert url_filter.filter_urls(rows.limit(0), rules).count() == 0 and url_filter.filter_urls(rows, rules.limit(0)).where("verdict = 'block'").count() == 0


def test_rules_are_lower_cased_in_ascii_only(spark):
    pages = spark.createDataFrame([(1, "http://É.net/a"), (2, "http://é.net/a"), (3, "http://EX.net/a")], "page_id long, url string")
    out = url_filter.filter_urls(pages, url_filter.rules_frame(spark, [("É.net", "/", "block"), ("Ex.NET", "/", "block")])).collect()
    assert {x.page_id: x.verdict for x in out} == {1: "block", 2: "allow", 3: "block"}


def test_anchor_hashes_sent():
    h = np.array([1, 1 << 39, (1 << 64) - 1], np.uint64)
    hashes, several = anchors.sent_hashes([anchors._squeeze(anchors._low(h), np.array([True, False, True]))])
    assert (hashes[0] == (h & anchors.LOW)).all() and several.tolist() == [True, False, True]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    d = "/root/testdata/sf0.001"
    out = spark.read.parquet(f"{d}/documents.parquet")
    n = out.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, out, d).collect(), out.schema)
        assert out.columns == corpus_pipeline.COLUMNS and 0 < out.count() <= n
        n = out.count()
    assert corpus_pipeline.run(spark, d, str(tmp_path / "run")).count() == n
    seen = []
    stages = corpus_pipeline.STAGES
    try:  # ended stages are not run again
        corpus_pipeline.STAGES = [(name, lambda *a, k=i: seen.append(k)) for i, (name, _) in enumerate(stages)]
        assert corpus_pipeline.run(spark, d, str(tmp_path / "run")).count() == n and not seen
    finally:
        corpus_pipeline.STAGES = stages


def test_pipeline_stages_equal_brute_force(spark):
    """Repeated ids and rows, null texts and ids, near copies, shared passages, leaks."""
    import corpus_pipeline

    r = random.Random(11)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(4000)]
    text = lambda n: " ".join(r.choices(words, k=n))
    rows = [(i, text(80)) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(5)] + [(3, text(90)), (3, rows[3][1]), (None, rows[1][1]), (200, None), (201, ""), (202, "?")]
    passage = text(40)
    rows += [(300 + i, text(30) + "  " + passage + " " + text(30)) for i in range(4)] + [(310, passage), (301, rows[-1][1])]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, df, "")
    sets = [(i, t, frozenset(tuple((t or "").split()[k : k + 5]) for k in range(max(len((t or "").split()) - 4, 1))) if (t or "").split() else frozenset()) for i, t in rows]
    like = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) > 0
    keep = [(i, t) for i, t, s in sets if i is None or not any(j is not None and j < i and like(s, o) for j, _, o in sets)]
    assert sorted(map(str, ((x.doc_id, x.text) for x in out.collect()))) == sorted(map(str, keep))
    cut = corpus_pipeline.substrings(spark, df, "").collect()
    named = [(i, t) for i, t in rows if i is not None]
    want, given = [], {i: [t for j, t in named if j == i] for i, _ in named}
    for i, n, gone, kept in window_removal(named):
        if not gone or gone < n:
            want.append((i, kept if gone else None))
    got = [(x.doc_id, None if x.text in given[x.doc_id] else x.text) for x in cut if x.doc_id is not None]
    assert sorted(map(str, got)) == sorted(map(str, want)) and all(x.n_chars == len(x.text or "") for x in cut)
    assert [x.text for x in cut if x.doc_id is None] == [rows[1][1]] and None in [x.text for x in cut if x.doc_id == 200]
    empty = df.limit(0)
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.substrings):
        assert stage(spark, empty, "").count() == 0


def test_near_duplicate_stage_goes_through_simhash(spark, monkeypatch):
    """Bands of minimum hashes are not asked; pairs at 0.8 whose fingerprints differ by more than four bits are linked, in lists
    of any length, and also where a class is dealt out by blocks. Sets of few shingles, whose bits differ most, are linked too."""
    import corpus_pipeline
    from quotegrain.llm import shingle_sets, simhash_index

    def no_bands(*_):
        raise AssertionError("the stage asks bands")

    monkeypatch.setattr(shingle_sets, "_candidate_links", no_bands)
    r = random.Random(12)
    text = lambda n: ["w%d" % r.randrange(10**6) for _ in range(n)]
    rows = []
    for k in range(60):  # 96 shingles; n of them are changed
        base, n = text(100), r.choice([6, 9, 10, 11, 12])
        rows += [(k, " ".join(base)), (1000 + k, " ".join(base[:-n] + text(n)))]
    for k in range(60, 100):  # five shingles and four of them
        base = text(9)
        rows += [(k, " ".join(base)), (1000 + k, " ".join(base[:-1]))]
    sets = {i: frozenset(tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)) for i, t in rows}
    gone = {1000 + k for k in range(100) if len(sets[k] & sets[1000 + k]) >= 0.8 * len(sets[k] | sets[1000 + k])}
    fps = {i: simhash.fingerprint(t.encode(), 5) for i, t in rows}
    assert 60 < len(gone) < 100 and sum((fps[i] ^ fps[i - 1000]).bit_count() > 4 for i in gone) > 30
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for block, short in ((1 << 18, 64), (60, 1)):
        monkeypatch.setattr(simhash_index, "BLOCK", block)
        monkeypatch.setattr(simhash_index, "SHORT", short)
        assert {x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect()} == set(sets) - gone
