import re
import zlib
from collections import Counter

from strandloom.llm import quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def check(frame):
    rows = frame.collect()
    out = quality_rules.quality_report(frame).collect()
    assert Counter((r.doc_id, *brute(r.text)) for r in rows) == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert not any(r.kept and r.base_failed for r in out)


def test_rules_against_brute_force(documents, awkward, empty):
    check(documents)
    check(awkward)
    check(empty)


def test_rules_keep_prose_and_reject_junk(spark):
    prose = "\n".join(f"The fox{i} went{i} over{i} a hill{i} and saw{i} rivers{i}." for i in range(12))
    nav = " | ".join(f"item{i}" for i in range(80))
    shout = " ".join(f"BUY{i}!!" for i in range(80))
    got = {r.doc_id: r.kept for r in quality_rules.quality_report(spark.createDataFrame([(1, prose), (2, nav), (3, shout), (4, prose + "\n" + nav[:40])], "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}
    cleaned = quality_rules.clean(spark.createDataFrame([(4, prose + "\n" + nav[:40])], "doc_id long, text string")).first().text
    assert cleaned == prose


def test_shards(documents, awkward, empty):
    assert sharding.shard_documents(empty).count() == 0
    for frame in (documents, awkward):
        rows = sharding.shard_documents(frame).collect()
        source = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in frame.collect())
        assert source == Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
        slots = {}
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
            assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_weights_move_rows_within_their_subtree(spark):
    keys = spark.range(20000).withColumnRenamed("id", "doc_id")
    plain = sharding.tree(8)
    heavy = sharding.inner("root", [sharding.inner("g0", [sharding.Node(r.name, r.weight * 2, tuple(sharding.Node(c.name, c.weight * 2, (), c.shard) for c in r.children)) if r.name == "k0" else r for r in plain.children[0].children]), plain.children[1]])
    both = sharding.assign(sharding.assign(keys, layout=plain, into="a"), layout=heavy, into="b").collect()
    counts = Counter(r.a for r in both)
    assert min(counts.values()) > 2200
    assert all(r.b in (0, 1) or r.a == r.b or r.b // 4 == 0 for r in both)
    assert all(r.b < 4 for r in both if r.a != r.b)


def test_one_shard_more_takes_rows_only_into_itself(spark):
    """From any founding size, again and again."""
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    for founded in (1, 2, 3, 5, 6, 7, 8, 9):
        out = keys
        for n in range(founded, founded + 4):
            out = sharding.assign(out, layout=sharding.tree(n, founded), into=f"s{n}")
        rows = out.collect()
        for n in range(founded, founded + 3):
            assert all(r[f"s{n + 1}"] in (r[f"s{n}"], n) for r in rows)
            assert 0.75 * 4000 / (n + 1) < sum(r[f"s{n + 1}"] == n for r in rows) < 1.25 * 4000 / (n + 1) or founded == 1


def test_common_lines_are_boilerplate(spark):
    """A short line of twenty different texts goes, whatever its language; in nineteen, in copies of one text, or when long, it stays."""
    prose = lambda i, k: "\n".join(f"El zorro{i}-{j} cruza{i} el monte{j} y mira{i} ríos{j}." for j in range(k))
    long = " ".join(f"palabra{j}" for j in range(25)) + "."
    rows = [(i, prose(i, 12) + "\nSuscríbase a nuestro boletín semanal." + ("\nCasi todos." if i < 19 else "") + "\n" + long) for i in range(20)]
    rows += [(100 + i, prose(99, 10) + "\nSolo una copia.") for i in range(30)]
    rows += [(200, prose(200, 10) + "\n" + "\n".join(["Suscríbase a nuestro boletín semanal."] * 40)), (201, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.measure(frame).collect()}
    letters = lambda x: len("".join(x.split()))
    for i, text in rows[:-2]:
        assert got[i].kept and got[i].kept_chars == letters(text) - (letters("Suscríbase a nuestro boletín semanal.") if i < 20 else 0)
    assert not got[200].kept and got[200].kept_chars == letters(prose(200, 10)) and not got[201].kept
    cleaned = {r.doc_id: r.text for r in quality_rules.clean(frame).collect()}
    assert cleaned == {i: t.replace("\nSuscríbase a nuestro boletín semanal.", "") for i, t in rows[:-2]}


def test_ranges_of_hashes():
    from strandloom.llm.hash_files import bits_for

    assert [bits_for(1 << k) for k in (20, 30, 40, 43)] == [4, 8, 18, 18] and bits_for(100 * 10**12) == 22
