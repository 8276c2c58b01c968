import hashlib
import random
import re
from collections import Counter

from strandloom.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=50):
    first = {}
    for r in rows:
        words = WORD.findall(r.text or "")
        if r.doc_id is not None:
            for i in range(len(words) - window + 1):
                key = tuple(words[i : i + window])
                first[key] = min(first.get(key, r.doc_id), r.doc_id)
    out = Counter()
    for r in rows:
        words = WORD.findall(r.text or "")
        gone = set()
        if r.doc_id is not None:
            for i in range(len(words) - window + 1):
                if first[tuple(words[i : i + window])] < r.doc_id:
                    gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[r.doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def check(frame, window=50):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame, window).collect())
    assert got == brute(frame.collect(), window)
    return got


def test_documents(documents, awkward, empty):
    assert any(k[2] for k in check(documents))
    check(awkward)
    check(empty)


def test_made_up(spark):
    draw = random.Random(3)
    passages = [" ".join(draw.choice("abcdefg") + draw.choice("xyz") for _ in range(draw.choice([7, 8, 9, 30]))) for _ in range(8)]
    rows = []
    for i in range(120):
        rows.append((draw.choice([i, i, 5, None]), "  ".join(draw.choice([*passages, "same same same same same same same same same", "u%d v%d" % (i, i)]) for _ in range(draw.randrange(6)))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check(frame, 8)
    check(frame, 50)
    check(frame.repartition(7), 12)


def test_levels():
    assert substring_dedup.levels(50) == [13, 25, 50] and substring_dedup.levels(8) == [2, 4, 8] and substring_dedup.levels(1) == [1]


def test_each_level_drops_candidates(spark, monkeypatch):
    """Runs that are repeated for 4, 7, 13, 25 words alone go at the next level; those of 50 are left, at any number of levels."""
    draw = random.Random(10)
    word = lambda: f"w{draw.randrange(10**6)}"
    rows = []
    for i, n in enumerate([3, 5, 9, 18, 33, 49, 50, 51, 70, 120]):
        passage = [word() for _ in range(n)]
        for k in range(3):
            rows.append((10 * i + k, " ".join([*(word() for _ in range(60)), *passage, *(word() for _ in range(60))])))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for n in (1, 2, 3, 5):
        monkeypatch.setattr(substring_dedup, "LEVELS", n)
        followed, real = [], substring_dedup.level_windows
        monkeypatch.setattr(substring_dedup, "level_windows", lambda docs, *args: followed.append((args[1], docs.select("doc_id").distinct().count())) or real(docs, *args))
        got = check(frame)
        monkeypatch.setattr(substring_dedup, "level_windows", real)
        assert sum(k[2] > 0 for k in got) == 8
        if n == 5:
            assert [w for w, _ in followed] == [4, 7, 13, 25] and [d for _, d in followed] == sorted((d for _, d in followed), reverse=True)
            assert followed[0][1] == 30 and followed[-1][1] < 24


def test_nothing_repeated_ends_early(spark):
    frame = spark.createDataFrame([(i, " ".join(f"w{i}-{k}" for k in range(120))) for i in range(6)], "doc_id long, text string")
    assert all(k[2] == 0 for k in check(frame))
