"""Dropped lines against a plain count, and awkward rows."""

import hashlib
import random

from strandloom.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def plain(rows, min_docs, min_chars=1):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    having: dict[str, set] = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            having.setdefault(key(line), set()).add(doc)
    common = {k for k, docs in having.items() if len(docs) >= min_docs and len(k) >= min_chars}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in common]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in frame.collect()), key=str)


def test_random_lines_against_a_plain_count(spark):
    draw = random.Random(5)
    pool = [f"{a}{b}{c}" for a in ("", " ", "\t\x0b") for b in ("Line", "LINE", "Ärger", "ÄRGER", "x", "", "　y") for c in ("", " ", "\r")] + [f"own {i}" for i in range(60)]
    rows = [(i, "\n".join(draw.choices(pool, k=draw.randint(1, 9)))) for i in range(80)] + [(80, None), (81, ""), (82, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for min_docs, min_chars in ((3, 1), (10, 1), (10, 2)):
        assert rows_of(line_dedup.drop_common_lines(docs, min_docs, min_chars)) == plain(rows, min_docs, min_chars)


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, "same\nown")] * 4 + [(None, "same\nfree")] * 4 + [(2, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(line_dedup.drop_common_lines(docs, 4)) == sorted(((d, len(t.split("\n")), 0, t) for d, t in rows), key=str)
    assert rows_of(line_dedup.drop_common_lines(docs, 3)) == plain(rows, 3)


def test_every_line_of_a_long_text_dropped_or_kept(spark):
    long = "\n".join(f"line {i % 500}" for i in range(20000))
    docs = spark.createDataFrame([(i, long) for i in range(2)] + [(9, "line 7\n" + "z" * 200000)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.drop_common_lines(docs, 2).collect()}
    assert got[0].text == got[1].text == "" and got[0].n_dropped == 20000
    assert got[9].text == "z" * 200000 and got[9].n_dropped == 1


def test_awkward_rows_and_names(awkward, empty):
    got = line_dedup.line_report(awkward).collect()
    assert len(got) == awkward.count() and all(r.n_dropped == 0 for r in got)
    assert {r.kept_sha256 for r in got if r.doc_id in (2, 3)} == {hashlib.sha256(b"").hexdigest()}
    clash = awkward.withColumnRenamed("n_words", "row").selectExpr("*", "1 as key", "2 as lines", "3 as dropped")
    assert line_dedup.line_report(clash).count() == awkward.count()
    assert line_dedup.line_report(empty).count() == 0
