"""The merge of branches against a plain three-way merge, with hashed codes and with given ones."""

import itertools
import zlib

from pyspark.sql import functions as F

from strandloom.llm import branch_merge

NO = ("L", "R")


def hashed(branch, doc, name):
    return zlib.crc32(f"{branch}:{'' if doc is None else doc}:{name}".encode()) % 11


def settle(left, right, base):
    """The state to take, and what is counted: changes are None or a value."""
    if left is None and right is None:
        return base, None
    if left is None or right is None or left == right:
        return (right if left is None else left), "clean"
    return base, "clash"


def plain(rows, code=hashed):
    out, added = [], {}
    for doc, text, lang, source in rows:
        base = {"lang": lang or "", "source": source or ""}
        lines = (text or "").split("\n")
        clean = edit_edit = edit_delete = insert_insert = 0
        edit = lambda v, c, gone: {0: gone, 1: v + "!", 2: v + "?"}.get(c)
        changed, merged = set(), {}
        for c, v in base.items():
            both = []
            for b in NO:
                new = edit(v, code(b, doc, c), "")
                both.append(None if new == v else new)
                if both[-1] is not None:
                    changed.add(b)
            merged[c], how = settle(*both, v)
            clean, edit_edit = clean + (how == "clean"), edit_edit + (how == "clash")
        text_out = []
        for i, line in enumerate(lines):
            codes = [code(b, doc, str(i)) for b in NO]
            changed |= {b for b, c in zip(NO, codes) if c <= 4}
            op, how = settle(*(c if c <= 2 else None for c in codes), 9)
            if how == "clash":
                edit_delete, edit_edit = edit_delete + (0 in codes), edit_edit + (0 not in codes)
            clean += how == "clean"
            if op != 0:
                text_out.append(edit(line, op, None) or line)
            op, how = settle(*(c if c in (3, 4) else None for c in codes), 9)
            insert_insert, clean = insert_insert + (how == "clash"), clean + (how == "clean")
            if op != 9:
                text_out.append("!" if op == 3 else "?")
        gone = [b for b in NO if code(b, doc, "row") == 0]
        if gone:
            kept = len(gone) == 1 and bool(changed - set(gone))
            out.append((doc, *((base["lang"], base["source"], "\n".join(lines)) if kept else (None,) * 3), int(not kept), 0, int(kept), 0))
        else:
            out.append((doc, merged["lang"], merged["source"], "\n".join(text_out), clean, edit_edit, edit_delete, insert_insert))
        for k, b in enumerate(NO):
            if (c := code(b, doc, "row")) in (3, 4):
                added.setdefault(None if doc is None else -1 - k - doc, set()).add((base["lang"], base["source"], "!" if c == 3 else "?"))
    for doc, values in added.items():
        out.append((doc, *(min(values) if len(values) == 1 else (None,) * 3), int(len(values) == 1), 0, 0, int(len(values) > 1)))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted(((r.doc_id, r.lang, r.source, r.text, r.n_clean, r.n_edit_edit, r.n_edit_delete, r.n_insert_insert) for r in frame.collect()), key=str)


def test_hashed_codes_against_a_plain_merge(spark):
    rows = [(i, "\n".join(f"line {i} {k}" * (k % 3) for k in range(i % 13)), [None, "", "en", "de"][i % 4], ["web", None, "ärz"][i % 3]) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = rows_of(branch_merge.merge_documents(docs))
    assert got == plain(rows)
    assert all(sum(r[k] for r in got) > 0 for k in (4, 5, 6, 7))  # every kind of count occurs


def test_every_pair_of_codes(spark):
    """Each row has one pair of codes for its row, its columns and its lines."""
    pairs = list(itertools.product(range(6), repeat=2))
    rows = [(3 * n, "a\n\nb", "x" if n % 2 else "", "s") for n in range(6**4)]
    place = {"row": 0, "lang": 1, "source": 1}

    def code(branch, doc, name):
        n = doc // 3
        pair = pairs[(n // 36 if place.get(name) == 0 else n) % 36]
        return pair[NO.index(branch)]

    def column(branch, key, name):
        n = F.floor(key.cast("long") / 3)
        at = F.when(name == "row", F.floor(n / 36)).otherwise(n) % 36
        return F.floor(at / 6) if branch == "L" else at % 6

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert rows_of(branch_merge.merge_documents(docs, column)) == plain(rows, code)


def test_awkward_rows(spark, awkward, empty):
    whole = awkward.selectExpr("*", "n_words as lang", "cast(null as string) as source", "1 as key", "2 as parts", "3 as sums", "4 as n_clean", "5 as states")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in whole.collect()]
    assert rows_of(branch_merge.merge_documents(whole)) == plain(rows)
    assert branch_merge.merge_report(empty.selectExpr("*", "'' as lang", "'' as source")).count() == 0


def test_no_python_and_no_shuffle_of_texts(documents):
    plan = branch_merge.merge_report(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Generate" not in plan and "Join" not in plan
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and plan.count("Exchange") == 1
