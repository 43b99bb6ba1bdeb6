"""Line dedup by a segment-partition edit join, in DataFrame functions only."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import doc_key, few, owned, owner, rest, stage, tight, united
from .neardup import KEYS, semi

#: What op7 and the pipeline take: words are the symbols, one edit in every eight of them, three at most.
UNIT, TAU, EVERY = "word", 3, 8
#: Keys of up to so many lines compare their pairs; larger ones are split (see `settled`; for one edit `halved`, until so many symbols are left).
SMALL, FEW = 16, 16
#: What is usual in a key is told by about so many of its lines.
SAMPLE = 16
#: So few keys of lines need no further split: for one edit; so few pairs are compared at once, for several.
NARROW, DIRECT = 4_000, 100_000
#: Bits of a key that are counted first, and what an entry of the index adds to the rows of a key.
SHORT, ENTRY = (1 << 40) - 1, 1 << 31
ID = ["_a", "_b"]
SPACES = "\t\x0b\x0c\r"


def symbols(line: Column, unit: str) -> Column:
    """The symbols that edits count, of a line in its plain form: its words, or all code points."""
    return F.split(line, " " if unit == "word" else "")


def symbol_count(line: Column, unit: str) -> Column:
    """How many symbols a line in its plain form has, without making them."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "))) + 1 if unit == "word" else F.length(line)


def plain(line: Column, unit: str) -> Column:
    """What equal lines, which have a word, have in common: the words with one space between them, or the line itself."""
    if unit != "word":
        return line
    odd = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for c in SPACES:
        odd = odd | F.contains(line, F.lit(c))
    return F.when(odd, F.array_join(F.array_remove(F.split(F.translate(line, SPACES, " " * len(SPACES)), " "), ""), " ")).otherwise(line)


def reach(n: Column, tau: int, every: int) -> Column:
    """Edits allowed between two lines, the shorter one of n symbols."""
    return F.least(F.lit(tau), F.floor(n / F.lit(every)).cast("int"))


def probes(tau: int) -> list[tuple[int, int, int, int]]:
    """(t, d, i, off): a line of n symbols looks for segment i of t + 1 of the lines that are d shorter, and may
    have t edits to it, off places from where the segment stands in them.

    With t edits some segment i has at most i - 1 of them before it, as seen from the left, and at most t + 1 - i
    behind it, as seen from the right, so that only these places are needed. d = off = 0 is the line's own
    segment: its entry in the index, and a probe at once.
    """
    out = []
    for t in range(1, tau + 1):
        for d in range(t + 1):
            for i in range(1, t + 2):
                low, high = max(1 - i, d - (t + 1 - i)), min(i - 1, d + (t + 1 - i))
                out += [(t, d, i, off) for off in range(low, high + 1)]
    return out


def segment(length: Column, t: Column, i: Column) -> tuple[Column, Column]:
    """(first place, size) of segment i of t + 1 of a line of `length` symbols; the last ones take what is left over."""
    over = length % (t + 1)
    size = F.call_function("div", length, t + 1).cast("int")
    before = i - 1 - (t + 1 - over)  # segments before this one that have an extra symbol
    return size * (i - 1) + F.greatest(F.lit(0), before) + 1, size + (before >= 0).cast("int")


def listed(plan: list[tuple[int, int, int, int]]) -> Column:
    """Probes as a constant array of structs, so that a query plan holds the arithmetic of one, not of dozens."""
    each = [F.struct(*[F.lit(x).alias(k) for k, x in zip("tdio", p, strict=True)]) for p in plan]
    return F.array(*each) if each else F.array().cast("array<struct<t:int,d:int,i:int,o:int>>")


def slots(n: Column, tau: int, every: int) -> Column:
    """The probes of a line of n symbols: for lines d shorter, those of as many edits as such a pair may have.

    They are looked up in a constant list by n; all lines of every * tau + tau symbols or more have the same ones.
    """
    top = every * tau + tau
    return F.get(F.array(*[listed([p for p in probes(tau) if p[0] == min(tau, max(0, k - p[1]) // every)]) for k in range(top + 1)]), F.least(n, F.lit(top)))


def same_slots(t: Column, d: Column, tau: int) -> Column:
    """The probes of t edits for lines d shorter."""
    return F.get(F.array(*[listed([p for p in probes(tau) if p[:2] == (a, b)]) for a in range(tau + 1) for b in range(tau + 1)]), t * (tau + 1) + d)


#: So many bands of lines of the most edits, each of lines a third longer than those before; the last one is open.
BANDS = 12


def bands(tau: int, every: int) -> list[tuple[int, int, int, int]]:
    """(t, low, end, size): lines of low to end - 1 symbols may have t edits to a longer one, and hold t + 1 blocks of `size`."""
    sizes = [tau * every // (tau + 1)]
    while len(sizes) < BANDS:
        sizes.append(sizes[-1] + max(1, sizes[-1] // 3))
    lows = [tau * every, *[(tau + 1) * size for size in sizes[1:]]]
    few_edits = [(t, t * every, (t + 1) * every, t * every // (t + 1)) for t in range(1, tau)]
    return few_edits + [(tau, *x) for x in zip(lows, [*lows[1:], 1 << 31], sizes, strict=True)]


def places(t: int, size: int) -> list[tuple[int, int, bool]]:
    """(block, at, still): where a line may have the blocks of one that is t edits away and as long or shorter.

    The shorter line has half of its t + 1 blocks at its beginning (1, 2, ...), the others at its end (-1, -2, ...). One of
    the two halves has fewer edits than blocks, so that some block i, as counted from that end, is whole and has at most
    i - 1 edits before it: the other line has it as far from its end, give or take i - 1 places, however long both are.
    at: from the beginning, or if negative from the end. still: the line's own block.
    """
    left = (t + 2) // 2
    out = [(i, (i - 1) * size + 1 + off, off == 0) for i in range(1, left + 1) for off in range(1 - i, i)]
    return out + [(-i, -i * size - off, off == 0) for i in range(1, t + 2 - left) for off in range(1 - i, i)]


def shown(rows: DataFrame, keep: list[str], sym: Column, n: Column, tau: int, every: int) -> DataFrame:
    """keep, t, index, _key: for each place where a line of n symbols (sym) may have a block of a line that is as long or
    shorter. Its own blocks are entries of the index, and probes at once.

    The places are those of the line's own band, and of a lower one that the shorter line may be in.
    """
    plan = bands(tau, every)
    cuts = sorted({x for t, low, end, _ in plan for x in (low, end + t) if x < 1 << 31})
    chosen = F.when(n < cuts[0], None)
    for low, high in zip(cuts, [*cuts[1:], None], strict=True):
        each = [(t, size, *p[:2], p[2] and low < end) for t, least, end, size in plan if least <= low < end + t for p in places(t, size)]
        some = F.expr(f"array({', '.join(f'struct{x}' for x in each)})").cast("array<struct<t:int,size:int,block:int,at:int,index:boolean>>")
        chosen = chosen.otherwise(some) if high is None else chosen.when(n < high, some)
    spots = rows.select(*keep, sym.alias("sym"), F.explode(chosen).alias("_x")).select(*keep, "sym", "_x.*")
    return spots.select(*keep, "t", "index", F.xxhash64("t", "size", "block", F.slice("sym", F.col("at"), F.col("size"))).alias("_key"))


def probed(rows: DataFrame, keep: list[str], sym: Column, n: Column, chosen: Column, index: Column, parent: list[str] | None = None) -> DataFrame:
    """keep, t, d, i, o, index, _key and sym, once for each of the chosen probes of a row (of lines of more than t symbols).

    _key names the substring of sym (n symbols), the segment it is sought for and the length of the lines that have it,
    within `parent`. index: what stands at a line's own segment is an entry of the index, and a probe at once. With a
    symbol or more in each segment, all places that `probes` names lie within the line.
    """
    parent = parent or []
    have = [*keep, *[p for p in parent if p not in keep]]
    each = rows.select(*have, sym.alias("sym"), n.alias("_of"), index.alias("_own"), F.explode(chosen).alias("_x"))
    each = each.select(*have, "sym", "_own", "_x.*", (F.col("_of") - F.col("_x.d")).alias("_long"))
    first, size = segment(F.col("_long"), F.col("t"), F.col("i"))
    key = F.xxhash64(*parent, "t", "i", "_long", F.slice("sym", first + F.col("o"), size))
    return each.select(*keep, "t", "d", "i", "o", (F.col("_own") & (F.col("d") == 0) & (F.col("o") == 0)).alias("index"), key.alias("_key"), "sym")


def remainder(sym: Column, n: Column) -> Column:
    """The line without the substring of its key's probe (t, d, i, o)."""
    first, size = segment(n - F.col("d"), F.col("t"), F.col("i"))
    start = first + F.col("o")
    return F.concat(F.slice(sym, F.lit(1), start - 1), F.slice(sym, start + size, n - start - size + 1))


def let(x: Column, f) -> Column:
    """f of x, which is evaluated once."""
    return F.transform(F.array(x), f)[0]


def cut(p: Column, t: Column) -> Column:
    """(p, t), two different arrays, without what they begin with in common, and reversed: their distance stays."""

    def less(v):
        return F.struct(*[F.reverse(F.slice(v[k], v["at"], F.size(v[k]))).alias(k) for k in "pt"])

    at = F.array_position(F.zip_with(p, t, lambda a, b: ~a.eqNullSafe(b)), True).cast("int")
    return let(F.struct(p.alias("p"), t.alias("t"), at.alias("at")), less)


def within(p: Column, t: Column, tau: int, most: Column | None = None) -> Column:
    """Whether two arrays are within `most` (at most tau, else tau) edits of each other: banded, bit-parallel.

    Each symbol that only one of them has takes an edit, which rules many pairs out at once; what they begin and end
    with in common is passed over.

    Bit d + tau of state e: with at most e edits, the diagonal d (symbols of p used minus those of t) can be
    reached. A symbol of t moves all diagonals at once by a few operations on the 2 tau + 1 bits.
    """
    full = (1 << (2 * tau + 1)) - 1
    start = [1 << tau]
    for _ in range(tau):
        start.append((start[-1] | start[-1] << 1) & full)
    names = [f"e{i}" for i in range(tau + 1)]
    begin = F.struct(*[F.lit(x).cast("long").alias(k) for k, x in zip(names, start, strict=True)])

    def run(s):  # s binds what every step reads
        m, n = s["m"], s["n"]

        def hits(j):
            ch = F.get(s["t"], j - 1)
            found = F.lit(0).cast("long")
            for b in range(2 * tau + 1):
                at = j + (b - tau)
                found = found.bitwiseOR(F.when((at >= 1) & (at <= m) & (F.get(s["p"], at - 1) == ch), F.lit(1 << b)).otherwise(F.lit(0)).cast("long"))
            return found

        def states(acc, h):
            new, out = None, []
            for i, k in enumerate(names):
                x = acc[k].bitwiseAND(h)
                if i:
                    before = acc[names[i - 1]]
                    x = x.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(new, 1)).bitwiseAND(F.lit(full).cast("long"))
                new = x
                out.append(x.cast("long").alias(k))
            return F.struct(*out)

        ran = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), begin, lambda acc, j: let(hits(j), lambda h: states(acc, h)))).otherwise(begin)
        at = s["most"]
        last = F.coalesce(*[F.when(at == e, ran[names[e]]) for e in range(tau + 1)])
        return F.call_function("shiftright", last, (m - n + tau).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    most = F.lit(tau) if most is None else most
    far = (F.abs(F.size(p) - F.size(t)) > most) | (F.size(F.array_except(p, t)) > most) | (F.size(F.array_except(t, p)) > most)
    given = lambda v: F.struct(v["p"].alias("p"), v["t"].alias("t"), F.size(v["p"]).alias("m"), F.size(v["t"]).alias("n"), most.alias("most"))
    return F.when(far, F.lit(False)).when(p == t, F.lit(True)).otherwise(let(cut(p, t), lambda u: let(cut(u["p"], u["t"]), lambda v: let(given(v), run))))


def crowded(rows: DataFrame) -> DataFrame:
    """Lines (_a, _b) that go, of keys of many lines that differ in what is left of them (rest), by one edit: exact,
    without pairs.

    Two lines are one edit apart if the rests agree but for the same place, or if one becomes the other by losing a
    symbol. Both are groups of (key, rest less one symbol). A group of the first kind holds lines that are all one
    edit apart; one of the second kind has one index line and lines with a symbol more. So the least places,
    combined before the shuffle, say which lines go.
    """
    m = F.size("rest")
    less = lambda k: F.concat(F.slice("rest", F.lit(1), k - 1), F.slice("rest", k + 1, m - k))
    every = F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    same = F.transform(every, lambda k: F.xxhash64(F.lit("s"), k, less(k)))
    lost = F.transform(every, lambda k: F.xxhash64(F.lit("l"), less(k)))
    kinds = F.when(F.col("index"), F.concat(same, F.array(F.xxhash64(F.lit("l"), "rest")))).otherwise(F.array_distinct(lost))
    flat = rows.select("_key", *ID, "first", "index", F.explode(kinds).alias("_g"))
    low = flat.groupBy("_key", "_g").agg(F.min("first").alias("_low"), F.min(F.when(F.col("index"), F.col("first"))).alias("_index"), F.count("*").alias("_m"))
    found = flat.join(low.where("_m > 1 AND _index IS NOT NULL").drop("_m"), ["_key", "_g"])
    return found.where(F.when(F.col("index"), F.col("first") > F.col("_low")).otherwise(F.col("first") > F.col("_index"))).select(*ID).distinct()


def verified(pairs: DataFrame, texts: DataFrame, tau: int, every: int) -> DataFrame:
    """Lines (_a, _b) of the pairs (_a, _b, _c, _d) whose two lines are within reach."""
    other = texts.select(F.col("_a").alias("_c"), F.col("_b").alias("_d"), F.col("sym").alias("sym2"))
    full = pairs.distinct().join(texts, ID).join(other, ["_c", "_d"])
    return full.where(within(F.col("sym"), F.col("sym2"), tau, reach(F.least(F.size("sym"), F.size("sym2")), tau, every))).select(*ID).distinct()


def met(late: DataFrame, early: DataFrame) -> DataFrame:
    """Pairs (_a, _b, _c, _d) of a line and an earlier one with the same key, one of them from the index."""
    e = early.select("_key", F.col("_a").alias("_c"), F.col("_b").alias("_d"), F.col("first").alias("first2"), F.col("index").alias("index2"))
    return late.join(e, "_key").where("first > first2 AND (index OR index2)").select(*ID, "_c", "_d")


def counted(flat: DataFrame, keep: str) -> DataFrame:
    """The rows of keys of several lines, one of them in the index, with their number _n, that of index lines _m and of open
    ones _o; keep: what else must hold of a key. The keys are counted first, combined before the shuffle."""
    some = [F.count("*").alias("_n"), F.count_if("index").alias("_m"), F.count_if("open").alias("_o"), F.max("open").alias("_open")]
    keys = stage(flat.groupBy("_key").agg(*some).where(f"_n > 1 AND _m > 0 AND {keep}").drop("_open"), "lines-keys")
    return stage(flat.join(F.broadcast(keys) if few(keys, KEYS) else keys.hint("merge"), "_key"), "lines-shared")


def likely(flat: DataFrame) -> DataFrame:
    """The rows of flat whose keys may be those of several lines, one of them in the index, staged: what comes before an exact
    count of many keys. A few bytes for each row are shuffled: as much of its key as tells most apart, and a sum that
    holds the rows and the index entries."""
    short = F.col("_key").bitwiseAND(F.lit(SHORT))
    counts = flat.groupBy(short.alias("_s")).agg(F.sum(F.lit(1).cast("long") + F.col("index").cast("long") * F.lit(ENTRY)).alias("_m"))
    keys = stage(counts.where((F.col("_m") > ENTRY) & (F.col("_m") % ENTRY > 1)).select("_s"), "lines-likely")
    return stage(flat.join(F.broadcast(keys) if few(keys, KEYS) else keys.hint("merge"), short == F.col("_s"), "left_semi"), "lines-met")


def earliest(rows: DataFrame, *by: str) -> DataFrame:
    """The earliest line of each key, of the index and of the others apart (and by what else is named)."""
    return rows.groupBy("_key", "index", *by).agg(F.min(F.struct("first", *ID)).alias("p")).select("_key", "index", *by, "p.*")


def unsettled(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Lines (_key, _a, _b), staged, that aren't known to go, nor the earliest of their key."""
    low = rows.groupBy("_key").agg(F.min("first").alias("_low"))
    late = semi(rows, known, ID, how="left_anti").join(low, "_key").where(F.col("first") > F.col("_low"))
    return tight(stage(late.select("_key", *ID).distinct(), "lines-late"))


def opened(rows: DataFrame, late: DataFrame) -> DataFrame:
    """The rows of keys that have late lines (_key, _a, _b), and whether each is one (open)."""
    marks = late.select(*ID).distinct().withColumn("open", F.lit(True))
    return semi(rows.drop("open"), late.select("_key").distinct(), ["_key"]).join(marks, ID, "left").withColumn("open", F.coalesce("open", F.lit(False)))


def halved(hot: DataFrame, texts: DataFrame, gone: DataFrame, every: int) -> DataFrame:
    """Lines (_a, _b; some more than once) that go by one edit, gone included, from keys of more than SMALL lines (with
    their rest).

    All lines of a key meet its earliest ones, which settles what surrounds one original in linear work. Keys that
    still hold other lines are split: what is left of the lines, without the substring they share, is cut into
    segments, indexed and probed anew within the key, so that each step halves it. Keys of few lines compare pairs;
    where little is left, `crowded` decides.
    """
    found = [gone]
    known = lambda: united(found)
    while True:
        rows = tight(stage(hot, "lines-hot", clean=False))
        narrow = few(rows, NARROW)
        texts = tight(texts)
        found.append(stage(verified(met(semi(rows, known(), ID, how="left_anti"), earliest(rows)), texts, 1, every), "lines-found"))
        late = unsettled(rows, known())
        if few(late, 0):
            return known()
        rows = opened(rows, late)
        if narrow:
            found.append(stage(crowded(rows), "lines-found"))
            return known()
        size = F.size("rest")
        wide = size - F.col("d") > F.greatest(F.lit(FEW), F.col("t"))
        near = [crowded(rows.where(~wide))]
        again = rows.where(wide).withColumnsRenamed({"_key": "_in", "t": "t0", "d": "d0"})
        flat = probed(again, [*ID, "first", "open"], F.col("rest"), size, same_slots(F.col("t0"), F.col("d0"), 1), F.col("index"), ["_in"])
        shared = tight(counted(flat, "_open")).withColumn("rest", remainder(F.col("sym"), F.size("sym"))).drop("sym")
        small = shared.where(F.col("_n") <= SMALL)
        near.append(verified(met(small.where("open"), small), texts, 1, every))
        found.append(stage(functools.reduce(DataFrame.union, near), "lines-found"))
        hot = shared.where(F.col("_n") > SMALL).select("_key", *ID, "first", "index", "t", "d", "rest")


def neighbours(sym: Column) -> Column:
    """The distinct pairs of symbols that stand side by side in a line, its two ends included, as longs. An edit takes two of
    them away at most, and brings two at most."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(sym)), lambda i: F.xxhash64(F.get(sym, i - 1), F.get(sym, i))))


def marked(rows: DataFrame, bags: DataFrame) -> DataFrame:
    """rows with `size`, how many neighbours tell a line from what is usual in its key, and the least of these (marks), staged.

    Usual is what more than half of about SAMPLE lines have; any choice gives the same result. Two lines within t edits
    differ in 4 t neighbours at most, and so do their sets of marks. If these have 4 t together they may have none in
    common; else they have one, and one of the first 4 t + 1 of both, in any order: here what is not usual comes first.
    """
    full = rows.join(bags.select(*ID, "bag"), ID)
    voters = full.where(F.pmod(F.xxhash64("_key", *ID), F.greatest(F.lit(1), F.floor(F.col("_n") / SAMPLE))) == 0)
    votes = voters.unionByName(full.join(earliest(rows).select("_key", *ID), ["_key", *ID], "left_semi")).select("_key", F.explode("bag").alias("g")).groupBy("_key", "g").agg(F.count("*").alias("c"))
    usual = votes.groupBy("_key").agg(F.max("c").alias("_most"), F.collect_list(F.struct("c", "g")).alias("_all"))
    usual = stage(usual.select("_key", F.transform(F.filter("_all", lambda x: x["c"] * 2 > F.col("_most")), lambda x: x["g"]).alias("_usual")), "lines-usual")
    more = F.concat(F.array_sort(F.array_except("bag", "_usual")), F.array_sort(F.array_except("_usual", "bag")))
    out = full.join(usual, "_key").select(*rows.columns, more.alias("m"))
    return tight(stage(out.select(*rows.columns, F.size("m").alias("size"), F.slice("m", F.lit(1), 4 * F.col("t") + 1).alias("marks")), "lines-marks"))


def close(late: DataFrame, early: DataFrame) -> DataFrame:
    """Pairs (_a, _b, _c, _d) as `met`, of lines that have 4 t marks or less together."""
    e = early.select("_key", F.col("_a").alias("_c"), F.col("_b").alias("_d"), F.col("first").alias("first2"), F.col("index").alias("index2"), F.col("size").alias("size2"))
    return late.where("size <= 4 * t").join(e, "_key").where("first > first2 AND (index OR index2) AND size + size2 <= 4 * t").select(*ID, "_c", "_d")


def settled(hot: DataFrame, texts: DataFrame, gone: DataFrame, tau: int, every: int) -> DataFrame:
    """Lines (_a, _b; some more than once) that go, gone included, from keys of more than SMALL lines.

    All lines of a key meet its earliest ones, which settles what surrounds one original in linear work. In keys that
    still hold other lines each is described by what tells it from the others (`marked`). Those of few marks meet the
    earliest line of each number of marks, and what that leaves, pairs with as few marks. The others are split by their
    marks into keys within the key, and all begins anew: what has led there is usual in the new key, so that it has fewer
    marks each time. Keys of few lines compare pairs.
    """
    found = [gone]
    known = lambda: united(found)
    bags = tight(stage(texts.select(*ID, "sym", neighbours(F.col("sym")).alias("bag")), "lines-bags"))
    while True:
        rows = tight(stage(hot, "lines-hot", clean=False))
        found.append(stage(verified(met(semi(rows, known(), ID, how="left_anti"), earliest(rows)), bags, tau, every), "lines-found"))
        late = unsettled(rows, known())
        if few(late, 0):
            return known()
        rows = tight(stage(opened(rows, late), "lines-open"))
        each = rows.groupBy("_key").agg((F.count("*") * F.count_if("open")).alias("n"))
        if (each.agg(F.sum("n")).first()[0] or 0) <= DIRECT:
            found.append(stage(verified(met(rows.where("open"), rows), bags, tau, every), "lines-found"))
            return known()
        rows = marked(rows, bags)
        found.append(stage(verified(close(rows.where("open"), earliest(rows, "size")), bags, tau, every), "lines-found"))
        late = tight(stage(semi(rows.where("open"), known(), ID, how="left_anti").select("_key", *ID), "lines-late"))
        if few(late, 0):
            return known()
        rows = tight(stage(opened(rows, late), "lines-open"))
        parts = rows.select(F.explode(F.transform("marks", lambda m: F.xxhash64("_key", m))).alias("_key"), *ID, "first", "index", "open", "t")
        shared = tight(counted(parts, "_open"))
        small = (F.col("_n") * F.col("_o") <= 2 * SMALL * SMALL) | (F.col("_m") <= SMALL // 8)
        near = [verified(close(rows.where("open"), rows), bags, tau, every), verified(met(shared.where(small & F.col("open")), shared.where(small)), bags, tau, every)]
        found.append(stage(united(near), "lines-found"))
        hot = shared.where(~small).select("_key", *ID, "first", "index", "t", "_n")


def place() -> Column:
    """A document's order as one decimal, with room for a line's position: by id, then a hash of its text; null ids last."""
    wide = lambda x: F.lit(x).cast("decimal(38,0)")
    part = (F.pmod(F.col("_h"), F.lit(1 << 32))).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(12,0)")
    whole = (F.col("_h").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")) * F.lit(1 << 31).cast("decimal(12,0)")
    return F.when(F.col("doc_id").isNull(), wide(str(1 << 126)) + whole).otherwise(F.col("_k").cast("decimal(20,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)") + part).cast("decimal(38,0)")


def lines_of(docs: DataFrame, unit: str) -> DataFrame:
    """_k, _h, pos, place, the line in its plain form, and its 128-bit name, of each line that has a word."""
    # A document's order is made once, not for each of its lines; the test for a word reads a line's first symbols only.
    each = docs.where(F.col("text").isNotNull()).select("_k", "_h", place().alias("_p"), "text").select("_k", "_h", "_p", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = each.where(F.ltrim("line", F.lit(" " + SPACES)) != "").withColumn("line", plain(F.col("line"), unit))
    return lines.select("_k", "_h", "pos", (F.col("_p") + F.col("pos")).cast("decimal(38,0)").alias("place"), "line", F.xxhash64("line").alias("_a"), F.xxhash64(F.lit(17), "line").alias("_b"))


def near(distinct: DataFrame, tau: int, every: int, unit: str) -> DataFrame:
    """Lines (_a, _b; some more than once) that an earlier line is within reach of."""
    n = F.col("n")
    sized = distinct.where(n >= every).withColumn("sym", symbols(F.col("line"), unit)).withColumn("open", F.lit(True))
    keep = [*ID, "first", "n", "open"]
    flat = probed(sized, keep, F.col("sym"), n, slots(n, tau, every), F.lit(True)).drop("sym") if tau == 1 else shown(sized, keep, F.col("sym"), n, tau, every)
    shared = counted(likely(flat), "_open")
    texts = semi(distinct.select(*ID, "line"), stage(shared.select(*ID).distinct(), "lines-some"), ID)
    texts = stage(texts.select(*ID, symbols(F.col("line"), unit).alias("sym")), "lines-texts")
    few_pairs = (F.col("_n") <= SMALL) | (F.col("_m") <= SMALL // 8)
    small, hot = shared.where(few_pairs), shared.where(~few_pairs)
    gone = stage(verified(met(small, small), texts, tau, every), "lines-gone")
    if not few(hot, 0):
        texts = stage(semi(texts, stage(hot.select(*ID).distinct(), "lines-some"), ID), "lines-crowded")
        if tau == 1:
            gone = halved(hot.join(texts, ID).select("_key", *ID, "first", "index", "t", "d", remainder(F.col("sym"), n).alias("rest")), texts, gone, every)
        else:
            one = hot.groupBy("_key", *ID, "first", "t", "_n").agg(F.max("index").alias("index"))
            gone = settled(one.select("_key", *ID, "first", "index", "t", "_n"), texts, gone, tau, every)
    return gone


def dedup(docs: DataFrame, tau: int = TAU, every: int = EVERY, unit: str = UNIT, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: doc_id, _k, _h, n_lines, n_removed, text (the lines that stay).

    Lines are what stands between line feeds. A line's symbols are its words (between white space, so that only
    its words and their order matter) or, with unit "char", its code points. A line goes if an earlier line has
    the same symbols, or becomes it by few edits (a symbol inserted, deleted or replaced): one for every `every`
    symbols of the shorter line, tau at most. So lines of under `every` symbols go only if they are repeated. A
    line stands where it first occurs, by doc_id, then position. Lines without a word only set others apart:
    they stay.

    Equal lines are one row from the start (combined before the shuffle). A line that may have t edits holds t + 1
    blocks, half of them at its beginning, half at its end, one of which the other line must hold whole: each line
    enters its blocks into an index, and looks for those of others at the places they can have moved to (`places`;
    for one edit at most, segments of lines of one length, so that keys of many lines can be halved: `probes`).
    Keys are counted first (combined before the shuffle); lines that share one are verified by a banded
    bit-parallel edit distance.

    Null text: no lines, stays null. Empty text: one empty line. Null ids come last, in the order of a hash of
    their text, as do different texts of one id. Rows that repeat an id and text are one document (each is
    returned, with the same lines gone). Empty tables give no rows. Other columns are ignored, or come along as a
    struct _rest if carry is set.
    """
    if every < 2 or tau < 0:
        raise ValueError("a line of n symbols can't have more than n / 2 edits, nor less than none")
    base = docs.select(F.col(id_col).alias("doc_id"), *doc_key(id_col, text_col), F.col(text_col).cast("string").alias("text"), *rest(docs, text_col, carry))
    lines = lines_of(base, unit)
    above = owner()
    with owned(docs.sparkSession):  # all but the lines that are told goes from the disk before the texts are read again
        distinct = stage(lines.groupBy(*ID).agg(F.min("place").alias("first"), F.count("*").alias("copies"), F.first("line").alias("line")).withColumn("n", symbol_count(F.col("line"), unit)), "lines-distinct")
        gone = near(distinct, tau, every, unit) if tau else distinct.select(*ID).where("false")
        gone = gone.distinct().withColumn("_gone", F.lit(True))
        repeated = stage(distinct.select(*ID, "first", "copies").join(gone, ID, "left").where("copies > 1 OR _gone").select(*ID, "first", "_gone"), "lines-repeated", of=lambda: above)
    told = F.broadcast(repeated) if few(repeated, KEYS) else repeated
    spots = lines.select("_k", "_h", "pos", "place", *ID).join(told, ID).where(F.coalesce("_gone", F.lit(False)) | (F.col("place") != F.col("first")))
    spots = spots.groupBy("_k", "_h").agg(F.collect_set("pos").alias("_out"))
    rows = base.join(spots, ["_k", "_h"], "left").withColumn("_lines", F.split("text", "\n", -1))
    count = F.coalesce(F.size("_lines"), F.lit(0))
    # The places that stay, as a difference of sets, and their lines: linear in the lines.
    stay = F.array_except(F.sequence(F.lit(0), count - 1), F.col("_out"))
    kept = F.when(F.col("_out").isNull() | (count == 0), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda p: F.get("_lines", p)), "\n"))
    return rows.select("doc_id", "_k", "_h", F.greatest(count, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.array_size("_out"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("text"), *(["_rest"] if carry else []))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_SAME = "coalesce(nullif(list_position(list_transform(generate_series(1, least(len(a) - ({i}), len(b) - ({j}))), lambda k: a[({i}) + k] = b[({j}) + k]), false), 0) - 1, least(len(a) - ({i}), len(b) - ({j})), 0)"
_STEP = """x{e} AS (SELECT id, a, b, t, i + di AS i, j + dj AS j FROM y{f}, (VALUES (1, 1), (1, 0), (0, 1)) AS s(di, dj) WHERE t >= {e} AND i + di <= len(a) AND j + dj <= len(b)),
y{e} AS (SELECT id, a, b, t, i + s AS i, j + s AS j FROM (SELECT DISTINCT *, """ + _SAME.format(i="i", j="j") + """ AS s FROM x{e}))"""
#: Pairs share one of four parts of the shorter line, up to three places from where it stands; y0 to y3 are how far both can be read with so many edits.
OP7_SQL = rf"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, pos, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l),
o AS (SELECT w, len(w) AS n, min((doc_id, pos)) AS first FROM s WHERE len(w) > 0 GROUP BY w),
h AS (SELECT w, n, first, least({TAU}, n // {EVERY}) AS t, row_number() OVER () AS r FROM o WHERE n >= {EVERY}),
g AS (SELECT r, n, p, (p - 1) * n // {TAU + 1} AS at, w[(p - 1) * n // {TAU + 1} + 1 : p * n // {TAU + 1}] AS part FROM h, (SELECT unnest(generate_series(1, {TAU + 1})) AS p)),
k AS (SELECT h.r, h.n - d AS n, p, w[(p - 1) * (h.n - d) // {TAU + 1} + off + 1 : p * (h.n - d) // {TAU + 1} + off] AS part FROM h, (SELECT unnest(generate_series(0, {TAU})) AS d), (SELECT unnest(generate_series(1, {TAU + 1})) AS p), (SELECT unnest(generate_series(-{TAU}, {TAU})) AS off)
  WHERE h.n - d >= {EVERY} AND (p - 1) * (h.n - d) // {TAU + 1} + off >= 0),
m AS (SELECT DISTINCT g.r AS ra, k.r AS rb FROM g JOIN k USING (n, p, part) WHERE g.r <> k.r),
q AS (SELECT row_number() OVER () AS id, a.w AS a, b.w AS b, a.t AS t, a.first AS fa, b.first AS fb FROM m JOIN h a ON a.r = ra JOIN h b ON b.r = rb WHERE b.n - a.n BETWEEN 0 AND a.t),
y0 AS (SELECT id, a, b, t, s AS i, s AS j FROM (SELECT *, {_SAME.format(i="0", j="0")} AS s FROM q)),
{", ".join(_STEP.format(e=e, f=e - 1) for e in range(1, TAU + 1))},
z AS ({" UNION ".join(f"SELECT id FROM y{e} WHERE i = len(a) AND j = len(b) AND t >= {e}" for e in range(1, TAU + 1))}),
e AS (SELECT DISTINCT CASE WHEN fa > fb THEN a ELSE b END AS w FROM q JOIN z USING (id)),
u AS (SELECT s.doc_id, s.pos, s.line, CASE WHEN len(s.w) = 0 THEN false WHEN e.w IS NOT NULL THEN true ELSE (s.doc_id, s.pos) <> o.first END AS gone
  FROM s LEFT JOIN o ON s.w = o.w LEFT JOIN e ON s.w = e.w),
v AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS t FROM u GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN v USING (doc_id)
"""
