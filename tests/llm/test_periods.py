"""Periodic runs against brute force."""

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from kinloom.llm import periods


def brute(words):
    """Runs (start, length, period) by start and period, and the words that stay."""
    n, runs = len(words), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            start, stop = i, j + p
            if stop - start >= max(6, 4 * p) and not any((stop - start) > q and all(words[x] == words[x + q] for x in range(start, stop - q)) for q in range(1, p)):
                runs.append((start, stop - start, p))
            i = j + 1
    dropped = {x for s, length, p in runs for x in range(s + p, s + length)}
    return sorted(runs, key=lambda r: (r[0], r[2])), [w for i, w in enumerate(words) if i not in dropped]


def same(texts):
    for t, (runs, stays) in zip(texts, periods.runs_of([[w.encode() for w in t] for t in texts]), strict=True):
        want, kept = brute(t)
        assert runs == want, t
        assert [w for w, s in zip(t, stays, strict=True) if s] == kept


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=70), max_size=6))
def test_two_words(texts):
    same(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 12)), max_size=8))
def test_powers(parts):
    same([list("".join(w * k for w, k in parts))])


def test_planted_texts():
    rnd = random.Random(7)
    texts = []
    for _ in range(120):
        w = [rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 150))]
        a, k = rnd.randrange(len(w)), rnd.randrange(3, 11)
        p = 1 + (len(w) - a) // k
        texts.append([w[i if i < a else a + (i - a) % p] for i in range(len(w))])
    same(texts)
    same([list("aaaaa"), list("aaaaaa"), list("abababab"), list("abababa"), list("xaaaaaayaaaaaaz"), list("abcabcabcabcab" * 3), []])


def test_long_texts():
    """One word a hundred thousand times, a long period, and a run in the middle of much else."""
    got = periods.runs_of([[b"a"] * 100_000, [str(i % 5_000).encode() for i in range(60_000)], [str(i).encode() for i in range(50_000)] + [b"x", b"y"] * 40_000 + [b"z"]])
    assert [r for r, _ in got] == [[(0, 100_000, 1)], [(0, 60_000, 5_000)], [(50_000, 80_000, 2)]]
    assert [int(s.sum()) for _, s in got] == [1, 5_000, 50_003]


def test_tables(spark):
    text = "p q " * 20
    rows = [(1, text, "a", 1), (1, text, "a", 1), (2, None, None, None), (None, "x " * 9, "b", 2), (3, "", "c", 3), (4, " \t\n", "c", 3), (5, "one two\x0b\x0cthree\x1cfour", "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words long")
    got = sorted(periods.periodic_runs(docs).collect(), key=lambda r: (r.row.doc_id is None, r.row.doc_id))
    assert [r.n_words for r in got] == [40, 40, 0, 0, 0, 3, 9]
    assert [[tuple(x) for x in r.runs] for r in got] == [[(0, 40, 2)], [(0, 40, 2)], [], [], [], [], [(0, 9, 1)]]
    assert [r.collapsed for r in got] == ["p q", "p q", "", "", "", "one two three\x1cfour", "x"] and got[0].row.runs == "a"
    assert periods.periodic_runs(docs.limit(0)).count() == 0


def test_query_by_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, " \n".join(rnd.choice(["a", "bb", "c,", "Ü"]) for _ in range(rnd.randrange(0, 60))) if i % 17 else None) for i in range(300)]
    rows += [(400, "tick tock " * 30), (None, "no id " * 8)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in periods.op12_periods(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    changed = 0
    for i, text in rows:
        w = (text or "").split()
        if i is not None and (h := zlib.crc32(str(i).encode())) % 10 == 0 and w:
            g, changed = h // 10, changed + 1
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k if k < a else a + (k - a) % p] for k in range(len(w))]
        runs, kept = brute(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        r = got[i]
        assert (r.n_words, r.n_runs, r.start, r.length, r.period) == (len(w), len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)) and r.collapsed_sha256 == sha(" ".join(kept))
    assert changed > 15 and len(got) == len(rows)
    assert dict(periods.op12_periods(spark, str(tmp_path)).dtypes)["start"] == "bigint"
