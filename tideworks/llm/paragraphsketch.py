"""Document fingerprints: invertible Bloom lookup tables of paragraph digests, in SQL functions only.

A table has three parts of cells; a digest goes to one cell of each part, and a cell keeps how many it got, the XOR of
the digests and the XOR of their check hashes.  Tables of two versions subtract cell by cell, which leaves only the
digests in which they differ; cells that hold one digest give it up, it is taken from its other cells, and so on until
all cells are empty.  Where the fingerprints' own tables fail, larger ones take their place: digests are split four
ways by further bits and each part gets a table of its own, the same method on four times the cells, as often as needed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideworks.llm.shared import partitions

CELL = "struct<n:int,k:bigint,c:bigint>"


@dataclass(frozen=True)
class Sketch:
    """part: cells of each of the three parts, a power of two; rounds: of peeling, each of which empties every cell it can; splits: how often a failed table is split in four."""

    part: int = 8
    rounds: int = 8
    splits: int = 6
    paragraph_end: str = r"\n|(?<=[.!?])[ \t]+"


def paragraphs(text: Column, end: str) -> Column:
    """Distinct 64-bit digests of the paragraphs with content: lines, and sentences within lines."""
    return F.array_distinct(F.transform(F.filter(F.split(text, end), lambda p: p != ""), lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(1))


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.alias("n"), k.alias("k"), c.alias("c"))


def _zero() -> Column:
    return _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))


def _place(key: Column, i: int, s: Sketch) -> Column:
    """The cell of a digest within part i."""
    return F.shiftrightunsigned(key, 16 * i).bitwiseAND(F.lit(s.part - 1)).cast("int")


def table(keys: Column, s: Sketch) -> Column:
    """The three parts of cells of an array of digests."""

    def part(i: int) -> Column:
        def one(at: Column) -> Column:
            put = lambda acc, k: F.when(_place(k, i, s) == at, _cell(acc["n"] + 1, acc["k"].bitwiseXOR(k), acc["c"].bitwiseXOR(_check(k)))).otherwise(acc)
            return F.aggregate(keys, _zero(), put)

        return F.transform(F.sequence(F.lit(0), F.lit(s.part - 1)), one)

    return F.concat(*[part(i) for i in range(3)])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: an argument of a lambda is, a repeated expression is not."""
    return F.transform(F.array(value), use)[0]


def _filled(cells: Column) -> Column:
    return F.exists(cells, lambda x: (x["n"] != 0) | (x["k"] != 0))


def _single(cells: Column) -> Column:
    """The cells that hold one digest, each digest once."""
    return F.array_distinct(F.filter(cells, lambda x: (F.abs(x["n"]) == 1) & (x["c"] == _check(x["k"]))))


def peel(cells: Column, s: Sketch) -> Column:
    """Of a difference of two tables: (only_a, only_b), the numbers of digests found, or null if cells stay filled."""

    def strip(state: Column) -> Column:
        """Take the digests found last from all cells, and look for those that this uncovers."""

        def less(x: Column, at: Column) -> Column:
            i = F.shiftright(at, s.part.bit_length() - 1)
            inner = at.bitwiseAND(F.lit(s.part - 1))
            hit = lambda p: F.when(i == 0, _place(p["k"], 0, s)).when(i == 1, _place(p["k"], 1, s)).otherwise(_place(p["k"], 2, s)) == inner
            take = lambda acc, p: F.when(hit(p), _cell(acc["n"] - p["n"], acc["k"].bitwiseXOR(p["k"]), acc["c"].bitwiseXOR(p["c"]))).otherwise(acc)
            return F.when(x["n"] == 0, F.when(x["k"] == 0, x).otherwise(F.aggregate(state["pure"], x, take))).otherwise(F.aggregate(state["pure"], x, take))

        plus = lambda name, test: (state[name] + F.size(F.filter(state["pure"], test))).alias(name)
        return _let(F.transform(state["cells"], less), lambda rest: F.struct(rest.alias("cells"), _single(rest).alias("pure"), plus("only_a", lambda x: x["n"] > 0), plus("only_b", lambda x: x["n"] < 0)))

    start = _let(cells, lambda x: F.struct(x.alias("cells"), _single(x).alias("pure"), F.lit(0).alias("only_a"), F.lit(0).alias("only_b")))
    walk = lambda state, _: F.when(F.size(state["pure"]) == 0, state).otherwise(strip(state))
    finish = lambda state: F.when(~_filled(state["cells"]), F.struct(state["only_a"].alias("only_a"), state["only_b"].alias("only_b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(s.rounds)), start, walk, finish)


def differing(a: Column, b: Column, table_a: Column, table_b: Column, s: Sketch) -> Column:
    """(only_a, only_b) of two arrays of distinct digests by their tables, or if these fail to peel, by larger ones.

    The larger tables are those of digests split in four, as often as it takes for a cell per digest and for all parts
    to peel.  After the last split, into 4**splits parts, what still shares cells is compared exactly.
    """

    def level(x: Column, y: Column, depth: int) -> Column:
        if depth > s.splits:
            return F.struct(F.size(F.array_except(x, y)).alias("only_a"), F.size(F.array_except(y, x)).alias("only_b"))
        bits: Callable[[Column], Column] = lambda k: F.shiftrightunsigned(k, 62 - 2 * depth).cast("int")
        low: Callable[[Column], Column] = lambda k: bits(k).bitwiseAND(F.lit(3))

        def add(acc: Column, q: Column) -> Column:
            sub = lambda v: level(v["x"], v["y"], depth + 1)
            parts = F.struct(F.filter(x, lambda k: low(k) == q).alias("x"), F.filter(y, lambda k: low(k) == q).alias("y"))
            return _let(_let(parts, sub), lambda r: F.struct((acc["only_a"] + r["only_a"]).alias("only_a"), (acc["only_b"] + r["only_b"]).alias("only_b")))

        zero = F.struct(F.lit(0).alias("only_a"), F.lit(0).alias("only_b"))
        # Of larger tables the first that is tried has a cell for each digest of both.
        tried = F.when(F.size(x) + F.size(y) <= 3 * s.part, peel(subtract(table(x, s), table(y, s)), s))
        return F.coalesce(tried, F.aggregate(F.sequence(F.lit(0), F.lit(3)), zero, add))

    return F.coalesce(peel(subtract(table_a, table_b), s), level(a, b, 0))


def likeness(a: Column, b: Column, table_a: Column, table_b: Column, s: Sketch) -> Column:
    """Shared share of the paragraphs of both, from the sizes of what differs; 1 if neither has any."""
    shared = lambda d: F.when(F.size(a) + d["only_b"] == 0, F.lit(1.0)).otherwise((F.size(a) - d["only_a"]) / (F.size(a) + d["only_b"]))
    return _let(differing(a, b, table_a, table_b, s), shared)


def fingerprint(keys: Column, cells: Column) -> Column:
    """The table in text: the number of digests, then each cell's count, digests and checks (32 bits) in hexadecimal."""
    cell = lambda x: F.when(x["n"] == 0, F.lit("0")).otherwise(F.concat_ws(".", x["n"].cast("string"), F.hex(x["k"]), F.hex(x["c"].bitwiseAND(F.lit(0xFFFFFFFF)))))
    return F.concat_ws(",", F.size(keys).cast("string"), F.transform(cells, cell))


def with_next(docs: DataFrame, columns: list[str], parts: int | None = None) -> DataFrame:
    """Rows of docs with ``next``, a struct of the columns of the row after by doc_id; the last one's is the first.

    Null doc_ids come last; ties go by the text's hash, then the text.  Ids are cut into ranges by approximate quantiles
    (as many numbers as there are ranges reach the driver), each range is sorted by a task, and the first row of each is
    also sent to the range before.  The texts are shuffled once and no range is an open-ended share of the rows.
    """
    parts = parts or 4 * partitions(docs.sparkSession)
    tie = F.xxhash64("text")
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else None
    bounds = F.array(*[F.lit(int(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    n_bounds = len(set(cuts or []))
    # The number of bounds that are not over the id, by halving.
    middle = lambda x: (x["lo"] + x["hi"] + 1).bitwiseAND(F.lit(-2)) / 2
    halve = lambda x, _: F.transform(F.array(middle(x).cast("int")), lambda m: F.when(x["lo"] >= x["hi"], x).when(F.get(bounds, m - 1) <= F.col("doc_id"), F.struct(m.alias("lo"), x["hi"].alias("hi"))).otherwise(F.struct(x["lo"].alias("lo"), (m - 1).alias("hi"))))[0]
    found = F.aggregate(F.sequence(F.lit(0), F.lit(max(1, n_bounds).bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(n_bounds).alias("hi")), halve, lambda x: x["lo"])
    ranged = docs.withColumns({"_range": F.when(F.col("doc_id").isNull(), F.lit(n_bounds + 1)).otherwise(found), "_tie": tie})
    heads = ranged.groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_tie")).alias("head")).collect()
    heads = sorted(((r["_range"], r["head"]["doc_id"], r["head"]["_tie"]) for r in heads), key=lambda x: x[0])
    if not heads:
        return docs.withColumn("next", F.struct(*columns))
    extra = F.create_map(*[F.lit(x) for (now, _, _), (before, _, _) in zip(heads, heads[-1:] + heads[:-1], strict=True) for x in (now, before)])
    ids = F.create_map(*[F.lit(x) if not isinstance(x, tuple) else F.struct(F.lit(x[0]).cast("long").alias("id"), F.lit(x[1]).alias("tie")) for now, i, t in heads for x in (now, (i, t))])
    head = ids[F.col("_range")]
    is_head = F.col("doc_id").eqNullSafe(head["id"]) & (F.col("_tie") == head["tie"])
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("ghost"))
    sent = F.when(is_head, F.array(own, F.struct(extra[F.col("_range")].alias("range"), F.lit(True).alias("ghost")))).otherwise(F.array(own))
    order = Window.partitionBy("range").orderBy("ghost", F.col("doc_id").asc_nulls_last(), "_tie", "text")
    both = ranged.select("*", F.inline(sent)).withColumn("next", F.lead(F.struct(*columns)).over(order))
    return both.where(~F.col("ghost")).drop("range", "ghost", "_range", "_tie")


def version_fingerprints(docs: DataFrame, sketch: Sketch | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row of docs.

    The edited text is the text with its last quarter of characters replaced by as many from the start of the next
    document (see with_next).  Null counts as the empty text, which has no paragraphs; two texts without paragraphs are
    alike (1).  Repeated rows are each other's neighbours.  Texts may be of any length; no column but doc_id and text is
    read, whatever its name.
    """
    s = sketch or Sketch()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("keys", paragraphs(F.col("text"), s.paragraph_end)).withColumn("cells", table(F.col("keys"), s))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.col("next")["text"], F.lit(1), quarter))
    rows = with_next(texts, ["text", "keys", "cells"]).select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "keys", "cells", F.col("next")["keys"].alias("next_keys"), F.col("next")["cells"].alias("next_cells"))
    rows = rows.withColumn("edited_keys", paragraphs(F.col("edited"), s.paragraph_end)).withColumn("edited_cells", table(F.col("edited_keys"), s))
    keys, cells = F.col("keys"), F.col("cells")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(keys, cells).alias("fingerprint"), fingerprint(F.col("edited_keys"), F.col("edited_cells")).alias("edited_fingerprint"),
        likeness(keys, F.col("edited_keys"), cells, F.col("edited_cells"), s).alias("near_edited"), likeness(keys, F.col("next_keys"), cells, F.col("next_cells"), s).alias("near_next"),
    )
