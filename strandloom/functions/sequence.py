"""Column expressions on nucleotide strings, read names and positions. All native; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def hamming(a: Column, b: Column) -> Column:
    """Substitutions between strings of equal length; null where lengths differ."""
    unlike = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.length(a) == F.length(b), F.aggregate(unlike, F.lit(0), lambda s, x: s + x))


def hamming_fixed(a: Column, b: Column, length: int) -> Column:
    """Substitutions between strings of a known length, letter by letter in generated code rather than over arrays."""
    out = F.lit(0)
    for i in range(1, length + 1):
        out = out + (F.substring(a, i, 1) != F.substring(b, i, 1)).cast("int")
    return out


def run_length_at(seq: Column, start: Column | int, base: str = "G") -> Column:
    """How many of `base` follow from the 0-based position on."""
    start = start if isinstance(start, Column) else F.lit(start)
    return F.length(F.regexp_extract(F.substring(seq, start + 1, F.length(seq)), f"^{base}*", 0))


def best_run_near(seq: Column, start: int, base: str = "G", slack: int = 1) -> Column:
    """The longest run that begins within `slack` of the expected position."""
    return F.greatest(*(run_length_at(seq, max(0, start + d), base) for d in range(-slack, slack + 1)))


def cut_at_run(seq: Column, base: str = "A", least: int = 10) -> Column:
    """The part before the first run of at least `least` of `base`."""
    return F.regexp_replace(seq, f"(?s){base}{{{least},}}.*$", "")


def trim_flanks(seq: Column, left: str, right: str, reach: int = 80) -> Column:
    """The part after the last `left` of the first `reach` bases and before the first `right` of the last ones."""
    head = F.substring(seq, 1, reach)
    back = F.locate(left[::-1], F.reverse(head))
    start = F.when(back > 0, F.length(head) - back + 1).otherwise(0)
    tail_at = F.greatest(F.length(seq) - reach, F.lit(0))
    at = F.locate(right, F.substring(seq, tail_at + 1, F.lit(reach)))
    end = F.when(at > 0, tail_at + at - 1).otherwise(F.length(seq))
    return F.substring(seq, start + 1, F.greatest(end - start, F.lit(0)))


def pair_entropy(seq: Column, letters: tuple[str, ...] = BASES) -> Column:
    """Shannon entropy of overlapping pairs of `letters`, over 4 bits; 1 below three letters. Other letters' pairs carry no entropy."""
    total = (F.length(seq) - 1).cast("double")
    terms = []
    for a in letters:
        for b in letters:
            p = F.regexp_count(seq, F.lit(f"{a}(?={b})")) / total
            terms.append(F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0)))
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return F.when(F.length(seq) < 3, F.lit(1.0)).otherwise(out / 4.0)


def homopolymer_tag(tag: Column) -> Column:
    """All letters but one at most are the same."""
    return F.greatest(*(F.regexp_count(tag, F.lit(b)) for b in BASES)) >= F.length(tag) - 1


def longest_run(seq: Column, bases: str = "AT") -> Column:
    runs = F.regexp_extract_all(seq, F.lit("(" + "|".join(f"{b}+" for b in bases) + ")"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def tail_match(a: Column, b: Column) -> Column:
    """Length of the common suffix."""
    same = F.zip_with(F.split(F.reverse(a), ""), F.split(F.reverse(b), ""), lambda x, y: x == y)
    state = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    return F.aggregate(same, state, lambda s, x: F.struct(F.when(s["on"] & F.coalesce(x, F.lit(False)), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & F.coalesce(x, F.lit(False))).alias("on")), lambda s: s["n"])


def occurrences(seq: Column, motif: str) -> Column:
    """0-based starts of all occurrences, overlapping ones too."""
    n = len(motif)
    last = F.length(seq) - n
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), lambda i: F.substring(seq, i + 1, F.lit(n)) == motif)).otherwise(F.array().cast("array<int>"))


def richest_window_after(seq: Column, anchor: str, base: str = "T", window: int = 12) -> Column:
    """The most of `base` in the window that follows any occurrence of the anchor; null without one."""
    return F.array_max(F.transform(occurrences(seq, anchor), lambda i: F.regexp_count(F.substring(seq, i + 1 + len(anchor), F.lit(window)), F.lit(base))))


def spaced_hits(starts: Column, gap: int) -> Column:
    """Of ascending positions, those at least `gap` after the last kept one."""
    return F.aggregate(starts, F.array().cast("array<int>"), lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= gap), F.concat(kept, F.array(x))).otherwise(kept))


# Read names -------------------------------------------------------------------------------------------------


def pack_name(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)


def name_part(name: Column, from_end: int) -> Column:
    return F.try_element_at(F.split(name, "_"), F.lit(-from_end))


def name_head(name: Column, tails: int) -> Column:
    parts = F.split(name, "_")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - tails, F.lit(0))), "_")


def safe_name(name: Column) -> Column:
    """Signs other than letters, digits, dot and dash become single underscores; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[^\p{Alnum}._-]", "_"), "_+", "_"), "^_|_$", "")


def condition_of(sample: Column) -> Column:
    """The sample's name without a trailing number that a dash or space sets off."""
    return F.regexp_replace(sample, r"[-\s]\d+$", "")


def replicate_of(sample: Column) -> Column:
    return F.coalesce(F.when(sample.rlike(r"[-\s]\d+$"), F.regexp_extract(sample, r"[-\s](\d+)$", 1).cast("int")), F.lit(1))


def species_of(contig: Column) -> Column:
    return F.when(contig.startswith("HUMAN_"), "human").when(contig.startswith("MOUSE_"), "mouse")


def track_contig(contig: Column) -> Column:
    """Names as a genome browser has them."""
    return F.when(contig == "MT", "chrM").when(contig.startswith("chr"), contig).otherwise(F.concat(F.lit("chr"), contig))


def flow_position(read_id: Column) -> Column:
    """lane, tile, x and y of a colon-separated read id."""
    parts = F.split(F.element_at(F.split(read_id, " "), 1), ":")
    return F.struct(*(F.try_element_at(parts, F.lit(k)).try_cast("long").alias(n) for k, n in ((-4, "lane"), (-3, "tile"), (-2, "x"), (-1, "y"))))


def packed_position(lane: Column, tile: Column, x: Column, y: Column) -> Column:
    return F.shiftleft(lane.cast("long"), 56).bitwiseOR(F.shiftleft(tile.cast("long"), 40)).bitwiseOR(F.shiftleft(x.cast("long"), 20)).bitwiseOR(y.cast("long"))


def junction_parts(row_id: Column) -> Column:
    """lsv, gene, side, anchor, junction, chrom, start, end and strand of 'chrom:gene:side:anchor|chrom:start-end:strand'."""
    lsv, junction = F.element_at(F.split(row_id, r"\|"), 1), F.element_at(F.split(row_id, r"\|"), 2)
    left = F.split(lsv, ":")
    pick = lambda k: F.regexp_extract(junction, r"^(.*):(\d+)-(\d+):([+-])$", k)
    return F.struct(lsv.alias("lsv"), left[1].alias("gene"), left[2].alias("side"), left[3].cast("long").alias("anchor"), junction.alias("junction"), pick(1).alias("chrom"), pick(2).cast("long").alias("start"), pick(3).cast("long").alias("end"), pick(4).alias("strand"))


# Alignments -------------------------------------------------------------------------------------------------


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n, op>> of a CIGAR string."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0)), lambda x: F.struct(F.left(x, F.length(x) - 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))


def cigar_sum(cigar: Column, ops: str) -> Column:
    """Total length of the given operations: 'MDN=X' is the reference span, 'MI=X' the aligned query."""
    return F.aggregate(F.filter(cigar_ops(cigar), lambda o: o["op"].isin(*ops)), F.lit(0), lambda s, o: s + o["n"])


def five_prime(pos: Column, cigar: Column, strand: Column) -> Column:
    """Anchor of a read: its position if forward, else the end of its alignment (1-based, both included)."""
    return F.when(strand == "+", pos).otherwise(pos + cigar_sum(cigar, "MDN=X") - 1)


def aligned_blocks(start: Column, cigar: Column, split_deletions: bool = False) -> Column:
    """array<struct<s, e>>, half open, of a read that begins at the 0-based `start`; introns separate blocks."""
    breaks = ("N", "D") if split_deletions else ("N",)
    state = F.struct(start.cast("int").alias("at"), F.lit(False).alias("open"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(acc: Column, o: Column) -> Column:
        uses = o["op"].isin("M", "=", "X", *(() if split_deletions else ("D",)))
        last = F.element_at(acc["out"], -1)
        grown = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(F.struct(last["s"].alias("s"), (acc["at"] + o["n"]).alias("e"))))
        fresh = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), (acc["at"] + o["n"]).alias("e"))))
        return (
            F.when(uses, F.struct((acc["at"] + o["n"]).alias("at"), F.lit(True).alias("open"), F.when(acc["open"], grown).otherwise(fresh).alias("out")))
            .when(o["op"].isin(*breaks), F.struct((acc["at"] + o["n"]).alias("at"), F.lit(False).alias("open"), acc["out"].alias("out")))
            .otherwise(acc)
        )

    return F.aggregate(cigar_ops(cigar), state, step, lambda acc: acc["out"])


def introns_of(start: Column, cigar: Column) -> Column:
    """array<struct<s, e>> of the introns, half open."""
    state = F.struct(start.cast("int").alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(acc: Column, o: Column) -> Column:
        end = acc["at"] + o["n"]
        return (
            F.when(o["op"] == "N", F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), end.alias("e")))).alias("out")))
            .when(o["op"].isin("M", "D", "=", "X"), F.struct(end.alias("at"), acc["out"].alias("out")))
            .otherwise(acc)
        )

    return F.aggregate(cigar_ops(cigar), state, step, lambda acc: acc["out"])


def aligned_query(seq: Column, cigar: Column) -> Column:
    """The bases of the read that are aligned (M, I, =, X)."""
    state = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, o: Column) -> Column:
        moved = (acc["at"] + o["n"]).alias("at")
        return F.when(o["op"].isin("M", "I", "=", "X"), F.struct(moved, F.concat(acc["out"], F.substring(seq, acc["at"], o["n"])).alias("out"))).when(o["op"] == "S", F.struct(moved, acc["out"].alias("out"))).otherwise(acc)

    return F.aggregate(cigar_ops(cigar), state, step, lambda acc: acc["out"])


def transcript_position(pos: Column, start: Column, offset: Column, length: Column, strand: Column) -> Column:
    """0-based position along the transcript of a genomic position inside the exon at `start` with this offset."""
    forward = offset + pos - start
    return F.when(strand == "+", forward).otherwise(length - 1 - forward)
