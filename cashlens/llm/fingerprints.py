"""Document fingerprints in DataFrame functions only: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, cut further behind sentence ends and list marks. A run of more than ``LONG`` characters without
any is cut where its own words say so: behind a word (or, in runs without blanks, a character) whose hash with the one
before it is a multiple of ``CHUNK``, so an edit moves the cuts beside it only. A text's paragraphs are a set of 64-bit
digests. Each digest falls into one cell of each of three tables; a cell holds the number, the xor of the digests and
the xor of their check values. Two sketches subtract cell by cell, and peeling takes out cells that hold one digest
until nothing is left: the digests that differ. Where the base sketch is too small for the difference, it is sketched
again larger: in blocks of digests, as many as the two texts' sizes ask for, and a block that does not peel with four
and sixteen times the cells. Dealing out digests takes the root of the number of blocks per digest, all else is linear in
them; every step is an expression over one row, so nothing is grouped by text.

The likeness of two sketches is the share of digests in both: common / (common + differing).

Defined cases: a null text counts as empty; two empty texts have likeness 1; a row with a null id has no next
document; rows with one id share the same next document, and of several texts with the next id the smallest in text
order is taken; a single document is its own next; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashlens.llm.common import scratch_dir, written

#: Cells per table: of the base sketch (the fingerprint), and of a block of a larger one. A digest is held against each
#: cell of its block, so blocks are small.
BASE, BLOCK = 16, 8
#: Expected digests per block; a block's three tables of 8 cells peel well beyond it.
BLOCK_LOAD = 8
#: Cells per table that a block gets in turn, until it peels.
WIDTHS = (BLOCK, 4 * BLOCK, 16 * BLOCK)
CELLS = "array<struct<n:int,h:bigint,k:int>>"
PARAGRAPH = r"\n+|(?<=[.!?|*])\x20+"
#: A longer paragraph is cut by its content, behind one in CHUNK of its TOKENs: words, and single characters far from a blank.
LONG, CHUNK = 1000, 16
TOKEN = r"(?<=\x20)|(?<=\S{32})(?![\uDC00-\uDFFF])"

_number = count()


def _v(name: str) -> str:
    """A lambda variable that no enclosing lambda uses."""
    return f"{name}{next(_number)}"


def hashes(h: str) -> str:
    return f"array(hash({h}, 1), hash({h}, 2), hash({h}, 3))"


def by_content(piece: Column) -> Column:
    """A long paragraph in chunks that its own words part; a paragraph holds no line end, so that can mark the cuts."""

    def marked(tokens: Column) -> Column:
        ends = lambda w, i: F.pmod(F.xxhash64(w, F.get(tokens, i - 1)), F.lit(CHUNK)) == 0
        return F.array_join(F.transform(tokens, lambda w, i: F.when(ends(w, i), F.concat(w, F.lit("\n"))).otherwise(w)), "")

    # an array of one, so that the tokens are made once
    return F.split(F.get(F.transform(F.array(F.split(piece, TOKEN, -1)), marked), F.lit(0)), "\n", -1)


def pieces(text: str) -> Column:
    """The paragraphs of a text in order."""
    parts = F.split(F.col(text), PARAGRAPH, -1)
    parts = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > LONG, by_content(p)).otherwise(F.array(p))))
    return F.filter(parts, lambda p: p != "")


def paragraphs(text: str) -> Column:
    """The distinct paragraphs: digest h, check k, table hashes x and block hash b."""
    digests = F.array_distinct(F.transform(pieces(text), lambda p: F.xxhash64(p)))
    return F.transform(
        digests,
        lambda h: F.struct(
            h.alias("h"),
            F.hash(h, F.lit(77)).alias("k"),
            F.array(F.hash(h, F.lit(1)), F.hash(h, F.lit(2)), F.hash(h, F.lit(3))).alias("x"),
            F.hash(h, F.lit(4)).alias("b"),
        ),
    )


def cells(units: str, width: int, number: str = "1") -> str:
    """SQL: the three tables of ``width`` cells (n, h, k) one after the other. ``number`` is the unit's n.

    Each cell adds up the units that fall into it. To put unit after unit into a copy of all cells costs ten times as much.
    """
    u, placed, i, e, a, x, z = (_v(name) for name in ("u", "units", "i", "e", "a", "x", "z"))
    places = f"""transform({units}, {u} -> named_struct('n', {number.format(u=u)}, 'h', {u}.h, 'k', {u}.k,
        'p', pmod({u}.x[0], {width}), 'q', pmod({u}.x[1], {width}), 'r', pmod({u}.x[2], {width})))"""
    one = f"""aggregate(filter({placed}, {e} -> {e}.{{p}} = {i}), named_struct('n', 0, 'h', 0L, 'k', 0),
        ({a}, {x}) -> named_struct('n', {a}.n + {x}.n, 'h', {a}.h ^ {x}.h, 'k', {a}.k ^ {x}.k))"""
    tables = ", ".join(f"transform(sequence(0, {width - 1}), {i} -> {one.format(p=p)})" for p in "pqr")
    # an array of one, so that the places are made once
    return f"aggregate(array({places}), cast(null as {CELLS}), ({z}, {placed}) -> concat({tables}))"


def subtract(left: str, right: str) -> str:
    p, q = _v("p"), _v("q")
    return f"zip_with({left}, {right}, ({p}, {q}) -> named_struct('n', {p}.n - {q}.n, 'h', {p}.h ^ {q}.h, 'k', {p}.k ^ {q}.k))"


def taken_out(cells_: str, units: str, width: int) -> str:
    """SQL: the cells without the units, each as often as its n says.

    A bit per cell (of cells 64 apart, one for both) says whether any unit falls into it; most cells stay as they are.
    """
    u, out, bits, z, c, i, e, a, x = (_v(name) for name in ("u", "out", "bits", "z", "c", "i", "e", "a", "x"))
    places = f"""transform({units}, {u} -> named_struct('n', {u}.n, 'h', {u}.h, 'k', {u}.k,
        'p', pmod({u}.x[0], {width}), 'q', pmod({u}.x[1], {width}) + {width}, 'r', pmod({u}.x[2], {width}) + {2 * width}))"""
    held = " | ".join(f"shiftleft(1L, {e}.{p})" for p in "pqr")
    rest = f"""aggregate(filter({out}, {e} -> {e}.p = {i} or {e}.q = {i} or {e}.r = {i}), {c},
        ({a}, {x}) -> named_struct('n', {a}.n - {x}.n, 'h', {a}.h ^ {x}.h, 'k', {a}.k ^ {x}.k))"""
    left = f"transform({cells_}, ({c}, {i}) -> if(shiftright({bits}, {i}) & 1L = 0L, {c}, {rest}))"
    left = f"aggregate(array(aggregate({out}, 0L, ({a}, {e}) -> {a} | {held})), cast(null as {CELLS}), ({z}, {bits}) -> {left})"
    return f"aggregate(array({places}), cast(null as {CELLS}), ({z}, {out}) -> {left})"


def peel(difference: str, width: int, rounds: int = 40) -> str:
    """SQL: struct(ok, found): the digests taken out, and whether no cell is left.

    Spark copies what a step hands on, in every round; so the state lets go of its cells once nothing can be taken out.
    """
    s, r, t, pure, c, p = (_v(x) for x in ("s", "r", "t", "pure", "c", "p"))
    single = f"""array_distinct(transform(filter({s}.cells, {c} -> abs({c}.n) = 1 and {c}.k = hash({c}.h, 77)),
        {c} -> named_struct('n', {c}.n, 'h', {c}.h, 'k', {c}.k, 'x', {hashes(f"{c}.h")})))"""
    rest = taken_out(f"{s}.cells", pure, width)
    empty = f"forall({s}.cells, {c} -> {c}.n = 0 and {c}.h = 0 and {c}.k = 0)"
    state = f"struct<cells:{CELLS},found:array<bigint>,go:boolean,ok:boolean>"
    return f"""aggregate(sequence(1, {rounds}),
        named_struct('cells', {difference}, 'found', cast(array() as array<bigint>), 'go', true, 'ok', false),
        ({s}, {r}) -> if(not {s}.go, {s}, aggregate(array({single}), cast(null as {state}), ({t}, {pure}) -> if(size({pure}) = 0,
            named_struct('cells', cast(array() as {CELLS}), 'found', {s}.found, 'go', false, 'ok', {empty}),
            named_struct('cells', {rest}, 'found', concat({s}.found, transform({pure}, {p} -> {p}.h)), 'go', true, 'ok', false)))),
        {s} -> named_struct('ok', if({s}.go, {empty}, {s}.ok), 'found', {s}.found))"""


def in_blocks(left: str, right: str, times: int) -> str:
    """SQL: the number of differing digests by a larger sketch in blocks, or null where a block does not peel.

    A block that does not peel is sketched again with more cells, alone. Digests are dealt to runs of blocks and then to
    the blocks of a run, about the root of their number each, so a text of many blocks is not read once for each of them.
    """
    u, m, w, g, run, b, block, s, signed = (_v(x) for x in ("u", "m", "w", "g", "run", "b", "block", "s", "signed"))
    blocks = f"cast(ceil((size({left}) + size({right})) / {BLOCK_LOAD}.0) as int) * {times}"

    def peeled(total: str, widths: tuple[int, ...]) -> str:
        if not widths:
            return "cast(null as int)"
        t, q = _v("t"), _v("q")
        # the sketch of the left digests less that of the right ones is the sketch of both with their signs
        one = peel(cells(block, widths[0], "{u}.n"), widths[0])
        return f"aggregate(array({one}), {total}, ({t}, {q}) -> if({q}.ok, {t} + size({q}.found), {peeled(t, widths[1:])}))"

    def over(steps: str, total: str, step: str, body) -> str:
        """``body`` of the total so far for every step; a null total stays."""
        t = _v("t")
        return f"aggregate({steps}, {total}, ({t}, {step}) -> if({t} is null, {t}, {body(t)}))"

    in_run = lambda t: over(
        f"sequence({g} * {w}, least({m}, {g} * {w} + {w}) - 1)",
        t,
        b,
        lambda t: over(f"array(filter({run}, {u} -> {u}.b = {b}))", t, block, lambda t: peeled(t, WIDTHS)),
    )
    in_all = over(f"sequence(0, ({m} - 1) div {w})", "0", g, lambda t: over(f"array(filter({signed}, {u} -> {u}.b div {w} = {g}))", t, run, in_run))
    side = lambda units, n: f"transform({units}, {u} -> named_struct('n', {n}, 'h', {u}.h, 'k', {u}.k, 'x', {u}.x, 'b', pmod({u}.b, {m})))"
    for value, name in ((f"concat({side(left, 1)}, {side(right, -1)})", signed), (f"cast(ceil(sqrt({m})) as int)", w), (blocks, m)):
        in_all = f"aggregate(array({value}), cast(null as int), ({s}, {name}) -> {in_all})"
    return in_all


def differing(base: str, left: str, right: str) -> Column:
    """Differing digests: from the peeled base sketch, else from a larger one, else (two digests alike in all hashes) from the sets."""
    plain = f"(size(array_except(transform({left}, u -> u.h), transform({right}, u -> u.h))) + size(array_except(transform({right}, u -> u.h), transform({left}, u -> u.h))))"
    return F.expr(f"if({base}.ok, size({base}.found), coalesce({in_blocks(left, right, 1)}, {plain}))")


def likeness(n_left: str, n_right: str, different: str) -> Column:
    """common / (common + differing), with common = (left + right - differing) / 2."""
    return F.expr(f"if({n_left} + {n_right} = 0, 1D, ({n_left} + {n_right} - {different}) / cast({n_left} + {n_right} + {different} as double))")


def as_text(cells_: str) -> Column:
    """Cells as base 64 of number, digest and check."""
    packed = f"transform({cells_}, c -> concat(lpad(hex(c.n), 8, '0'), lpad(hex(c.h), 16, '0'), right(lpad(hex(c.k), 16, '0'), 8)))"
    return F.expr(f"base64(unhex(array_join({packed}, '')))")


# ---------------------------------------------------------------- the next document


def next_ids(ids: DataFrame, name: str = "id") -> DataFrame:
    """(id, next): the next larger id, null for the last. ``ids`` are distinct integers.

    Ids are dealt by sorted ranges of about equal numbers of rows, and written, so that the ranges are drawn once. The
    last id of a range gets the first of the next range: that final window holds a row per range, whatever the ids are.
    """
    ranges = ids.select(name).repartitionByRange(name).select(name, F.spark_partition_id().alias("_range"))
    ranges = written(ranges, scratch_dir(ids.sparkSession), "ids")
    heads = ranges.groupBy("_range").agg(F.min(name).alias("_head"))
    after = heads.select("_range", F.lead("_head").over(Window.partitionBy(F.lit(0)).orderBy("_range")).alias("_head"))
    inside = Window.partitionBy("_range").orderBy(name)
    return ranges.withColumn("_lead", F.lead(name).over(inside)).join(after, "_range", "left").select(name, F.coalesce("_lead", "_head").alias("next"))


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, text, and of the next document: head (at most a quarter of this text's length) and paragraphs."""
    everything = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # without null ids both joins below ask for the same exchange of the texts, so Spark makes it once
    docs = everything.where("doc_id is not null")
    lengths = docs.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max(F.length("text")).alias("n"))
    first = lengths.agg(F.min("id")).first()[0]
    order = next_ids(lengths.select("id")).select("id", F.coalesce("next", F.lit(first)).alias("next"))
    # by the next id: whose next it is, and how much of it that one needs
    wanted = order.join(lengths, "id").select(F.col("next").alias("doc_id"), F.col("id").alias("_for"), "n")
    kind = docs.schema["doc_id"].dataType
    wanted = wanted.withColumn("doc_id", F.col("doc_id").cast(kind))
    donors = (
        docs.join(wanted, "doc_id")
        .groupBy("doc_id", "_for", "n")
        .agg(F.min("text").alias("text"))
        .select(
            F.col("_for").cast(kind).alias("_id"),
            F.expr("substring(text, 1, cast(floor(n / 4) as int))").alias("head"),
            F.transform(paragraphs("text"), lambda u: u["h"]).alias("next_digests"),
        )
    )
    joined = docs.join(donors, docs["doc_id"] == donors["_id"], "left").drop("_id")
    joined = joined.unionByName(everything.where("doc_id is null"), allowMissingColumns=True)
    return joined.withColumn("head", F.coalesce("head", F.lit("")))


def units_of(digests: str) -> Column:
    """Paragraph structs again from their digests."""
    return F.expr(f"transform(coalesce({digests}, cast(array() as array<bigint>)), h -> named_struct('h', h, 'k', hash(h, 77), 'x', {hashes('h')}, 'b', hash(h, 4)))")


def compare(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    rows = with_next(documents)
    quarter = "cast(floor(length(text) / 4) as int)"
    rows = rows.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        paragraphs("text").alias("own"),
        F.expr(f"concat(substring(text, 1, length(text) - {quarter}), substring(head, 1, {quarter}))").alias("edited_text"),
        "next_digests",
    )
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        "own",
        paragraphs("edited_text").alias("edited"),
        units_of("next_digests").alias("following"),
    )
    rows = rows.select("*", *[F.expr(cells(u, BASE)).alias(f"c_{u}") for u in ("own", "edited", "following")])
    rows = rows.select("*", *[F.expr(peel(subtract("c_own", f"c_{u}"), BASE)).alias(f"p_{u}") for u in ("edited", "following")])
    rows = rows.select("*", *[differing(f"p_{u}", "own", u).alias(f"d_{u}") for u in ("edited", "following")])
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text("c_own").alias("fingerprint"),
        as_text("c_edited").alias("edited_fingerprint"),
        likeness("size(own)", "size(edited)", "d_edited").alias("near_edited"),
        likeness("size(own)", "size(following)", "d_following").alias("near_next"),
    )
