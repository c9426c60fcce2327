"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, or two consecutive sentences of a longer one (what stands between ``.!?``, without
outer spaces). The set of a text's paragraph digests (64 bits) is sketched in 24 cells: each digest goes to one
cell of each third, chosen by its own bits, and a cell keeps the number, the xor and the sum of check sums of
its digests. The sketch as hexadecimal text is the fingerprint. The difference of two sketches holds the digests
of one side only: a cell with one of them gives it away, it is taken out of its other two cells, and so on. If
cells remain, the attempt is repeated with more cells: a table of 24 for each value of 1 to 6 leading bits of the
digests, as many as their number asks for. Tables that fail again are divided again; after ``ATTEMPTS`` rounds
the sets left in them are compared. Likeness is the Jaccard coefficient of the paragraph sets.

Everything is DataFrame functions: arrays inside a row for the sketches, and one shuffle of the texts, by
ranges of doc_id, in which a window finds each document's successor. Ranges have about ``RANGE_BYTES`` of text;
the first text of each is looked up for the range before. Rows without id, and those of an id that more rows have than
one range holds, are dealt out by hash of text, equal texts by a salt.

Results on edge cases:

* null texts are empty; an empty text has no paragraphs; two texts without paragraphs have likeness 1,
  one without and one with have 0;
* repeated paragraphs count once; texts that differ only in spaces between sentences have likeness 1;
* the order is null ids first, then doc_id; rows of one id are ordered by the hash of their text; a single
  document succeeds itself; an empty table gives no rows;
* a text of one paragraph shares none with an edited one;
* columns beyond doc_id and text take no part.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Characters that end a sentence, besides the line break, and the sentences of a paragraph.
ENDS = ".!?"
SENTENCES = 2

#: A table has three times 2 ** BITS cells.
THIRDS, BITS = 3, 3
ROUNDS = 8
#: A table that fails is divided so that its tables get about so many digests, at most 64 at once.
KEYS_PER_TABLE, MOST_BITS, ATTEMPTS = 16, 6, 8

RANGE_BYTES = 8 << 20
MAX_RANGES = 4096
SALTS = 64

KEYS = "array<struct<k:bigint,n:int>>"
CELL = "struct<n:int,k:bigint,h:bigint>"
OUTCOME = "struct<solved:boolean,removed:array<bigint>,added:array<bigint>>"
TABLES = "array<struct<l:array<bigint>,r:array<bigint>,used:int>>"
STATE = f"struct<todo:{TABLES},removed:array<bigint>,added:array<bigint>>"


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# ---------------------------------------------------------------- sketches


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs, sorted."""

    def of_line(line: Column) -> Column:
        cut = F.split(F.translate(line, ENDS, "\n" * len(ENDS)), "\n")
        return F.filter(F.transform(cut, lambda p: F.trim(p)), lambda p: p != "")

    def of_sentences(parts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(parts), F.lit(SENTENCES))
        found = F.transform(starts, lambda i: F.xxhash64(F.slice(parts, i, F.lit(SENTENCES))))
        return F.when(F.size(parts) > 0, found).otherwise(F.array().cast("array<bigint>"))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), of_line)
    return F.sort_array(F.array_distinct(F.flatten(F.transform(lines, of_sentences))))


def check_sum(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(1)).bitwiseAND(F.lit(0xFFFFFFFF))


def position(digest: Column, third: Column) -> Column:
    """The place of a digest's cell in one third of a table."""
    return F.call_function("shiftright", digest, third * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def sketch(keys: Column) -> Column:
    """The cells of a set of digests."""

    def cell(hits: Column) -> Column:
        return F.struct(
            F.size(hits).alias("n"),
            F.aggregate(hits, F.lit(0).cast("bigint"), lambda a, d: a.bitwiseXOR(d)).alias("k"),
            F.aggregate(hits, F.lit(0).cast("bigint"), lambda a, d: a + check_sum(d)).alias("h"),
        )

    places = F.sequence(F.lit(0), F.lit((1 << BITS) - 1))
    thirds = [
        F.transform(places, lambda c: bound(F.filter(keys, lambda d: position(d, F.lit(third)) == c), cell))
        for third in range(THIRDS)
    ]
    return F.concat(*thirds).cast(f"array<{CELL}>")


def fingerprint(cells: Column) -> Column:
    """A sketch as text: 28 hexadecimal digits a cell."""

    def digits(value: Column, n: int) -> Column:
        return F.right(F.lpad(F.hex(value), n, "0"), F.lit(n))

    return F.array_join(
        F.transform(cells, lambda c: F.concat(digits(c["n"], 4), digits(c["k"], 16), digits(c["h"], 8))), ""
    )


def subtract(left: Column, right: Column) -> Column:
    def minus(a: Column, b: Column) -> Column:
        return F.struct(
            (a["n"] - b["n"]).alias("n"), a["k"].bitwiseXOR(b["k"]).alias("k"), (a["h"] - b["h"]).alias("h")
        )

    return F.zip_with(left, right, minus)


def peel(cells: Column) -> Column:
    """struct<cells, found, done>: what is left of a difference, and the digests recovered with their sides."""

    def single(c: Column) -> Column:
        return (F.abs(c["n"]) == 1) & (c["h"] == c["n"] * check_sum(c["k"]))

    def taken(state: Column, pure: Column) -> Column:
        def without(c: Column, i: Column) -> Column:
            third = F.call_function("shiftright", i, F.lit(BITS))
            hits = F.filter(pure, lambda p: position(p["k"], third) == i.bitwiseAND(F.lit((1 << BITS) - 1)))

            def minus(a: Column, p: Column) -> Column:
                return F.struct(
                    (a["n"] - p["n"]).alias("n"),
                    a["k"].bitwiseXOR(p["k"]).alias("k"),
                    (a["h"] - p["n"] * check_sum(p["k"])).alias("h"),
                )

            return F.aggregate(hits, c, minus)

        return F.struct(
            F.transform(state["cells"], without).alias("cells"), F.concat(state["found"], pure).alias("found"),
            F.lit(False).alias("done"),
        )

    def step(state: Column, _: Column) -> Column:
        pure = F.transform(F.filter(state["cells"], single), lambda c: F.struct(c["k"], c["n"]))
        done = F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(True).alias("done"))
        next_state = bound(F.array_distinct(pure), lambda p: F.when(F.size(p) == 0, done).otherwise(taken(state, p)))
        return F.when(state["done"], state).otherwise(next_state)

    start = F.struct(
        cells.alias("cells"), F.array().cast(KEYS).alias("found"), F.lit(False).alias("done")
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def outcome(state: Column) -> Column:
    """struct<solved, removed, added> of a peeled difference."""

    def side(n: int) -> Column:
        return F.transform(F.filter(state["found"], lambda p: p["n"] == n), lambda p: p["k"])

    empty = F.forall(state["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["h"] == 0))
    return F.struct(empty.alias("solved"), side(1).alias("removed"), side(-1).alias("added"))


def outcome_of(cells: Column) -> Column:
    return bound(peel(cells), outcome).cast(OUTCOME)


def divided(left: Column, right: Column, used: Column) -> Column:
    """The digests of a table that failed, dealt to 2 to 64 tables by the bits after the first ``used``."""
    wanted = F.log2((F.size(left) + F.size(right)) / F.lit(float(KEYS_PER_TABLE)))
    bits = F.least(F.greatest(F.ceil(wanted), F.lit(1)), F.lit(MOST_BITS), F.lit(64) - used).cast("int")

    def tables(b: Column) -> Column:
        last = F.call_function("shiftleft", F.lit(1), b).cast("bigint") - 1

        def numbers(keys: Column) -> Column:
            return F.transform(keys, lambda d: F.call_function("shiftright", d, F.lit(64) - used - b).bitwiseAND(last))

        def members(keys: Column, of: Column, reverse: Column, g: Column) -> Column:
            """Sorted keys of one number stand together."""
            start = F.array_position(of, g)
            n = F.when(start == 0, 0).otherwise(F.size(keys) - F.array_position(reverse, g) - start + 2)
            return F.slice(keys, F.greatest(start, F.lit(1)).cast("int"), n.cast("int"))

        def dealt(x: Column) -> Column:
            def table(g: Column) -> Column:
                return F.struct(
                    members(left, x["l"], x["lr"], g).alias("l"), members(right, x["r"], x["rr"], g).alias("r"),
                    (used + b).alias("used"),
                )

            return F.transform(F.sequence(F.lit(0).cast("bigint"), last), table)

        pair = F.struct(numbers(left).alias("l"), numbers(right).alias("r"))
        both = bound(
            pair,
            lambda x: F.struct(
                x["l"].alias("l"), F.reverse(x["l"]).alias("lr"), x["r"].alias("r"), F.reverse(x["r"]).alias("rr")
            ),
        )
        return bound(both, dealt)

    return bound(bits, tables)


def difference(left: Column, right: Column, cells: Column) -> Column:
    """struct<removed, added>: the digests that only ``left`` and only ``right`` has.

    Both are sorted; ``cells`` is the difference of their sketches.
    """

    def tried(table: Column) -> Column:
        keys = F.struct(table["l"].alias("l"), table["r"].alias("r"), table["used"].alias("used"))
        return bound(
            outcome_of(subtract(sketch(table["l"]), sketch(table["r"]))),
            lambda o: F.struct(o.alias("o"), keys.alias("keys")),
        )

    def settled(removed: Column, added: Column, tried_tables: Column) -> Column:
        solved = F.filter(tried_tables, lambda t: t["o"]["solved"])
        failed = F.filter(tried_tables, lambda t: ~t["o"]["solved"])
        return F.struct(
            F.transform(failed, lambda t: t["keys"]).cast(TABLES).alias("todo"),
            F.concat(removed, F.flatten(F.transform(solved, lambda t: t["o"]["removed"]))).alias("removed"),
            F.concat(added, F.flatten(F.transform(solved, lambda t: t["o"]["added"]))).alias("added"),
        ).cast(STATE)

    def attempt(state: Column, _: Column) -> Column:
        smaller = F.flatten(F.transform(state["todo"], lambda t: divided(t["l"], t["r"], t["used"])))
        filled = F.filter(smaller, lambda t: F.size(t["l"]) + F.size(t["r"]) > 0)
        again = bound(F.transform(filled, tried), lambda t: settled(state["removed"], state["added"], t))
        return F.when(F.size(state["todo"]) == 0, state).otherwise(again)

    none = F.array().cast("array<bigint>")
    keys = F.struct(left.alias("l"), right.alias("r"), F.lit(0).alias("used"))
    start = bound(
        outcome_of(cells), lambda o: settled(none, none, F.array(F.struct(o.alias("o"), keys.alias("keys"))))
    )
    found = F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), start, attempt)

    def rest(state: Column) -> Column:
        def only(one: str, other: str) -> Column:
            return F.flatten(F.transform(state["todo"], lambda t: F.array_except(t[one], t[other])))

        return F.struct(
            F.concat(state["removed"], only("l", "r")).alias("removed"),
            F.concat(state["added"], only("r", "l")).alias("added"),
        )

    return bound(found, rest)


def likeness(left: Column, right: Column, apart: Column) -> Column:
    """Jaccard coefficient of two sets from their sizes and their difference."""
    n_apart = F.size(apart["removed"]) + F.size(apart["added"])
    both = F.size(left) + F.size(right)
    return F.when(both == 0, 1.0).otherwise((both - n_apart) / (both + n_apart))


def compared(left: Column, right: Column) -> Column:
    """struct<removed, added, likeness> of two texts."""

    def of(sets: Column) -> Column:
        return bound(
            difference(sets["l"], sets["r"], subtract(sketch(sets["l"]), sketch(sets["r"]))),
            lambda d: F.struct(
                d["removed"].alias("removed"), d["added"].alias("added"), likeness(sets["l"], sets["r"], d).alias("likeness")
            ),
        )

    return bound(F.struct(digests(left).alias("l"), digests(right).alias("r")), of)


# ---------------------------------------------------------------- successors


def in_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _h, _range, _sub, _salt): the order of the documents, cut into bounded pieces.

    (_range, _sub, _salt) grows with (doc_id, _h).
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    pieces = max(1, math.ceil(size / RANGE_BYTES))
    ranges = min(pieces, MAX_RANGES)
    shares = [i / ranges for i in range(1, ranges)]
    points = []
    if shares:
        points = rows.agg(F.percentile_approx("doc_id", shares, 20 * ranges)).first()[0] or []
    cuts = sorted(set(points))
    hot = sorted({p for p in points if points.count(p) > 1})
    number = F.col("doc_id").cast("double")
    cut_at = sorted({float(c) for c in cuts} | {math.nextafter(float(h), math.inf) for h in hot})
    cut_at = cut_at or [0.0]
    splits = [-math.inf, *cut_at, math.inf]
    rows = Bucketizer(splits=splits, inputCol="_key", outputCol="_range").transform(
        rows.withColumn("_key", F.coalesce(number, F.lit(-math.inf)))
    )
    _range = F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_range").cast("int"))
    low, high = ([-math.inf, *cut_at], [*cut_at, math.inf])
    parts = math.ceil(pieces / ranges)
    inside = F.lit(0)
    if parts > 1:  # ids between two cuts are split evenly
        place = F.col("_range").cast("int")
        a, b = F.get(F.array(*map(F.lit, low)), place), F.get(F.array(*map(F.lit, high)), place)
        share = (number - a) / (b - a)
        inside = F.coalesce(F.when((share >= 0) & (share < 1), F.floor(share * parts).cast("int")), F.lit(0))
    spread = F.col("doc_id").isNull() | (F.col("doc_id").isin(hot) if hot else F.lit(False))
    h = F.xxhash64("text")
    salt = F.call_function("shiftright", F.monotonically_increasing_id(), F.lit(33)) % SALTS
    rows = rows.select(
        "doc_id", "text", h.alias("_h"), _range.alias("_range"), spread.alias("_spread"),
        inside.alias("_inside"), salt.alias("_any"),
    )
    by_hash = F.call_function("shiftright", F.col("_h"), F.lit(52)).cast("int")
    return rows.select(
        "doc_id", "text", "_h", "_range",
        F.when(F.col("_spread"), by_hash).otherwise(F.col("_inside")).alias("_sub"),
        F.when(F.col("_spread"), F.col("_any")).otherwise(0).cast("int").alias("_salt"),
    )


PIECES = ["_range", "_sub", "_salt"]


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): every document with the text of its successor, the last with the first."""
    rows = in_ranges(docs)
    key = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "_h")
    firsts = rows.groupBy(*PIECES).agg(F.min(key).alias("first"))
    order = Window.orderBy(*PIECES)  # a row per piece
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select(
        *PIECES, F.coalesce(F.lead("first").over(order), F.first("first").over(everything)).alias("first")
    )
    wanted = after.select(*[F.col(c).alias(f"at{c}") for c in PIECES], "first.doc_id", "first._h")
    found = rows.select("doc_id", "text", "_h").join(
        wanted.withColumnsRenamed({"doc_id": "_id", "_h": "_hash"}),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")),
    )
    at = [f"at{c}" for c in PIECES]
    beyond = found.select(*at, F.col("text").alias("beyond")).dropDuplicates(at)
    inside = Window.partitionBy(*PIECES).orderBy(F.col("doc_id").asc_nulls_first(), "_h")
    led = rows.withColumn("_lead", F.lead("text").over(inside))
    same = [F.col(c) == F.col(f"at{c}") for c in PIECES]
    joined = led.join(beyond, same, "left")
    return joined.select("doc_id", "text", F.coalesce("_lead", "beyond").alias("next_text"))


# ---------------------------------------------------------------- the operator


def edited(text: str, following: str) -> Column:
    """The last quarter of a text replaced by the first characters of another."""
    return F.expr(
        f"concat(left({text}, length({text}) - length({text}) div 4), left({following}, length({text}) div 4))"
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and its edited text, and likenesses by their differences.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    """
    rows = with_next(docs).withColumn("edited", edited("text", "next_text"))
    rows = rows.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.struct(*[digests(F.col(c)).alias(a) for c, a in (("text", "d"), ("edited", "e"), ("next_text", "f"))]).alias("sets"),
    )

    def of(s: Column) -> Column:
        cells = F.struct(s.alias("s"), *[sketch(s[c]).alias(c) for c in "def"])

        def both(x: Column) -> Column:
            def near(other: str) -> Column:
                apart = difference(x["s"]["d"], x["s"][other], subtract(x["d"], x[other]))
                return bound(apart, lambda a: likeness(x["s"]["d"], x["s"][other], a))

            return F.struct(
                fingerprint(x["d"]).alias("fingerprint"), fingerprint(x["e"]).alias("edited_fingerprint"),
                near("e").alias("near_edited"), near("f").alias("near_next"),
            )

        return bound(cells, both)

    return rows.select("doc_id", "n_chars", "edited_sha256", bound(F.col("sets"), of).alias("_o")).select(
        "doc_id", "n_chars", "edited_sha256", "_o.*"
    )
