"""Periodic runs, line dedup and the source audit against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from quotegrain.llm import line_dedup, periodic_runs, source_audit

SCHEMA = "doc_id long, text string, lang string, source string, start int, key string, value double"


def table(spark, rows):
    """Rows of (doc_id, text[, lang, source]), with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(r[0], r[1], *(r[2:] or ("en", "s")), 7, "k", 0.5) for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def all_runs(words):
    """Brute force: stretches of each period, those of a smaller period left out."""
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            s, length = i - q, j - i + q
            if length >= max(12, 2 * q) and not any(all(words[k] == words[k - r] for k in range(s + r, j)) for r in range(1, q)):
                out.append((s, length, q))
            i = max(j, i + 1)
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 4), st.lists(st.integers(0, 3), max_size=60), st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20), st.integers(0, 50)), max_size=3))
def test_runs_equal_brute_force(letters, start, repeats):
    words = [b"%d" % (x % letters) for x in start]
    for at, period, length in repeats:
        words[at:at] = (words[at : at + period] * (length + 1))[:length]
    assert periodic_runs.runs(words) == all_runs(words)


def test_runs_of_known_words():
    word = lambda text: [c.encode() for c in text]
    assert periodic_runs.runs(word("a" * 12)) == [(0, 12, 1)] and periodic_runs.runs(word("a" * 11)) == []
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 400:
        a, b = b, b + a
    assert periodic_runs.runs(b) == all_runs(b)
    assert periodic_runs.runs(word("x") * 20000) == [(0, 20000, 1)]
    words = [b"%d" % (i % 7000) for i in range(21000)]
    assert periodic_runs.runs(words) == [(0, 21000, 7000)]


def test_last_ends_are_the_longest_common_suffixes():
    r = random.Random(4)
    for _ in range(200):
        s = [r.randrange(3) for _ in range(r.randint(1, 40))]
        ends = periodic_runs.LastEnds()
        for i, x in enumerate(s):
            got, want = ends.append(x), {}
            for length in range(1, i + 1):
                last = max((e for e in range(length - 1, i) if s[e - length + 1 : e + 1] == s[i - length + 1 : i + 1]), default=None)
                if last is not None:
                    want[last] = length
            assert sorted(got) == sorted((e, length) for e, length in want.items() if i - e <= length)


def periodic_row(doc_id, text, plant):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else None
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *head, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(kept), kept)


@pytest.mark.parametrize("plant", [False, True])
def test_periodic_documents(spark, plant):
    r = random.Random(8)
    vocab = ["".join(r.choices("abcé", k=3)) for _ in range(40)]
    rows = [(i, " ".join(r.choices(vocab, k=r.randint(0, 90)))) for i in range(80)]
    rows += [(100 + i, " \n".join(r.choices(vocab, k=7)) + "\t" + "la la di " * i) for i in range(20)]
    rows += [(None, "b c " * 30), (None, None), (3, None), (4, ""), (5, " \t\r\n\x0b\x0c"), (6, "z " * 3000), (6, "z " * 3000), (6, rows[6][1]), (-7, "a b " * 40), (8, "x\xa0y " * 12)]
    out = periodic_runs.periodic_runs(table(spark, rows), plant=plant).collect()
    got = [(x.doc_id, x.n_runs, x.start, x.length, x.period, x.exponent_milli, x.runs_sha256, x.collapsed_sha256, x.collapsed) for x in out]
    assert sorted(got, key=str) == sorted((periodic_row(i, t, plant) for i, t in rows), key=str)
    assert all(len(x.runs) == x.n_runs for x in out)
    assert periodic_runs.periodic_runs(table(spark, rows[:0]), plant=plant).count() == 0


def common_lines(rows, least_chars=20, least_docs=3):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < least_docs or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept)), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    r = random.Random(2)
    pool = ["Common line number %d of them" % i for i in range(12)] + ["ÉCOLE é %d longue ligne ici" % i for i in range(4)] + ["short one", "x" * 20, "y" * 19, "", "  "]
    wrap = lambda s: r.choice(["", " ", "\t", "\x0b "]) + (s.upper() if r.random() < 0.2 and s.isascii() else s) + r.choice(["", "\r", " "])
    rows = [(i * 2, "\n".join(wrap(r.choice(pool)) for _ in range(r.randint(0, 9)))) for i in range(60)]
    hot = "the hottest line of all the lines"
    rows += [(1000 + i, f"own line of document number {i}\n{hot}\n{hot}") for i in range(200)]
    return rows + [(7, None), (9, ""), (11, "\n\n"), (4, rows[2][1]), (4, rows[5][1]), (4, rows[5][1]), (None, hot), (None, None), (13, (hot + "\n") * 3000), (15, "É" * 20), (17, "é" * 20)]


@pytest.mark.parametrize("rows_in_task", [line_dedup.ROWS, 40])
def test_common_lines(spark, monkeypatch, rows_in_task):
    monkeypatch.setattr(line_dedup, "ROWS", rows_in_task)
    rows = line_rows()
    out = line_dedup.remove_common_lines(table(spark, rows)).collect()
    assert sorted(((x.doc_id, x.n_lines, x.n_dropped, x.kept_sha256, x.kept) for x in out), key=str) == common_lines(rows)
    assert all(sum(run.length for run in x.keep) == x.n_lines - x.n_dropped for x in out)
    assert line_dedup.remove_common_lines(table(spark, rows[:0])).count() == 0


def test_line_plan(spark):
    """Cold lines are dealt by ranges of their hash, sorted once; nothing runs in Python."""
    rows = spark.createDataFrame([(1, 2, 3, 4, 5, 6)], "h1 long, h2 long, doc_id long, t1 long, t2 long, place int")
    df = line_dedup._dropped(rows, 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(h1" in plan and "Python" not in plan and "MapInArrow" not in plan
    cold = plan[plan.index("rangepartitioning") - 3000 :]
    assert "hashpartitioning(h1" not in cold[cold.index("rangepartitioning") :].split("Union")[0]


def divergence_rows(rows, least_docs, top=10):
    docs = [(t or "", lang or "", source or "") for _, t, lang, source in rows]
    terms = lambda t: [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    out = []
    for lang in {x[1] for x in docs}:
        own = [(terms(t), s) for t, x, s in docs if x == lang]
        df, groups, total = Counter(), defaultdict(Counter), Counter()
        for ts, s in own:
            df.update(set(ts))
            groups[s].update(ts)
            total.update(ts)
        kept = [t for t in df if df[t] >= least_docs]
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept})(sum(c[t] for t in kept))
        p, q = {s: share(c) for s, c in groups.items()}, share(total)
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in groups:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            best = [(f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", best, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ordered)]
    return sorted(out)


@pytest.mark.parametrize("few", [0, 50_000])
@pytest.mark.parametrize("held", [50, 400_000])
def test_divergence(spark, monkeypatch, few, held):
    monkeypatch.setattr(source_audit, "_FEW_GROUPS", few)
    monkeypatch.setattr(source_audit, "_HELD", held)
    r = random.Random(5)
    vocab = ["".join(r.choices("abcÉé", k=r.randint(1, 3))) for _ in range(80)]
    rows = [(i, r.choice([" ", "-", "1"]).join(r.choices(vocab, k=r.randint(0, 30))), r.choice(["en", "fr", None]), r.choice(["a", "b", "c", "é", "", None])) for i in range(150)]
    rows += [(None, rows[3][1], "en", s) for s in "aab"] + [(5, None, "en", "only null"), (5, "", "fr", "empty"), (6, "rare words", "xx", "one"), (6, "other", "xx", "two"), (7, "lone " * 20, "yy", "z")]
    rows += [(200 + i, "same text OF many\x00copies", "en", "ab"[i % 2]) for i in range(60)] + [(300, "long " * 20000, "en", "b")]
    out = source_audit.divergence(table(spark, rows), least_docs=3)
    assert [(c, t) for c, t in out.dtypes if c in ("value", "rank")] == [("value", "bigint"), ("rank", "int")]
    assert sorted(tuple(x) for x in out.collect()) == divergence_rows(rows, 3)
    assert source_audit.divergence(table(spark, rows[:0])).count() == 0


def test_copies_are_collapsed(spark):
    rows = [(i, "one text", "en", "ab"[i % 2]) for i in range(50)] + [(60, "one text", "fr", "a"), (61, "two", "en", "a")]
    out = source_audit.collapsed(table(spark, rows).select("lang", "source", "text")).collect()
    assert sorted((x.lang, x.text, sorted((c.source, c.k) for c in x.copies)) for x in out) == [("en", "one text", [("a", 25), ("b", 25)]), ("en", "two", [("a", 1)]), ("fr", "one text", [("a", 1)])]


def test_large_counts_are_exact(spark):
    df = spark.createDataFrame([(10**13, 2 * 10**13, 7)], "n long, big long, v long").select(source_audit._p("n", "big", "v").alias("p"))
    assert df.first().p == 1 + 10**9 * (10**13 + 2) // (2 * 10**13 + 14)
    assert spark.range(1).select(source_audit._p("id", "id", "id").alias("p")).first().p is None
