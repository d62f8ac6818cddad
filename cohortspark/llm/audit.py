"""How filters interact: what every order of them removes, and which filter takes it.

Each filter is a relation of failing ids, one written table per filter.  The documents are split
by it: a left-semi join gives those that fail, a left-anti join those that pass.  After the last
split a document lies in the cell of the filters that it fails; documents of one cell share their
fate under every prefix of every order, so the joins over documents number two per filter, not two
per prefix.  Label relations split the cells in the same way.  The prefixes are then followed on
the relation (cell, filter) of failing cells, again by left-semi and left-anti joins: kept are the
cells anti-joined with all failures up to a step, removed those that fail there anti-joined with
earlier failures, redundant the same semi-joined.  A last join of that small table (at most
``2^k * k! * k`` rows for k filters: 19,200 for five) with the cells of each part sums the counts.

Defined cases: null text is empty; a null part is the empty string; rows that repeat an id are
documents of their own with the labels of their id; a label counts if any row of its id has it; a
null id has no label and its text makes no other row a copy nor is one; an empty table gives no
rows.  Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import saved

WHITE = r"[\x20\x09-\x0D]+"


def corpus_filters(text: Column) -> dict[str, Column]:
    """The filters of a single text: failure conditions by letter."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def numbered(docs: DataFrame, filters: Mapping[str, Column], id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A written table: a number for each row, its id, part, digest of the text and the failure of each text filter."""
    text = F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))
    rows = docs.select(docs[f"`{id_col}`"].cast("bigint").alias("x_id"), text.alias("x_text"), F.coalesce(docs[f"`{part_col}`"].cast("string"), F.lit("")).alias("part"))
    flags = [c.alias(f"fails_{k}") for k, c in filters.items()]
    return saved(rows.select(F.monotonically_increasing_id().alias("x_row"), "x_id", "part", F.sha2("x_text", 256).alias("x_sha"), *flags), "fa-rows")


def later_copies(rows: DataFrame) -> DataFrame:
    """x_row of the rows whose text a smaller id has as well."""
    firsts = rows.groupBy("x_sha").agg(F.min("x_id").alias("x_first"), F.max("x_id").alias("x_last")).filter("x_first < x_last")
    return rows.join(firsts, "x_sha").filter("x_first < x_id").select("x_row")


def split(cells: DataFrame, ids: DataFrame, on: str, flag: str) -> DataFrame:
    """``cells`` with a new flag column: does the row's ``on`` lie in ``ids``?"""
    yes = cells.join(ids, on, "left_semi").withColumn(flag, F.lit(1))
    no = cells.join(ids, on, "left_anti").withColumn(flag, F.lit(0))
    return saved(yes.unionByName(no), "fa-split")  # both sides read the last split


def prefix_fates(cells: DataFrame, letters: str) -> DataFrame:
    """(cell, filter_order, step, filter, fate) with fate in seen, kept, removed, redundant, unique."""
    steps = [F.struct(F.lit("".join(o)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(f).alias("filter")) for o in permutations(letters) for i, f in enumerate(o)]
    cells = saved(cells.select("cell").distinct(), "fa-cells")
    failing = saved(cells.select("cell", F.explode(F.split("cell", "")).alias("filter")).filter("filter != ''"), "fa-failing")
    seen = saved(cells.select("cell", F.explode(F.array(*steps)).alias("x")).select("cell", "x.*"), "fa-seen")
    hits = saved(seen.join(failing, ["cell", "filter"], "left_semi"), "fa-hits")
    s, h, e = seen.alias("s"), hits.alias("h"), hits.alias("e")
    order = lambda a, b: (F.col(f"{a}.cell") == F.col(f"{b}.cell")) & (F.col(f"{a}.filter_order") == F.col(f"{b}.filter_order"))
    earlier = order("h", "e") & (F.col("e.step") < F.col("h.step"))
    other = (F.col("h.cell") == F.col("f.cell")) & (F.col("h.filter") != F.col("f.filter"))
    fates = {
        "seen": seen,
        "kept": s.join(e, order("s", "e") & (F.col("e.step") <= F.col("s.step")), "left_anti"),
        "removed": h.join(e, earlier, "left_anti"),
        "redundant": h.join(e, earlier, "left_semi"),
        "unique": h.join(failing.alias("f"), other, "left_anti"),
    }
    out = None
    for fate, rows in fates.items():
        rows = rows.select("cell", "filter_order", "step", "filter", F.lit(fate).alias("fate"))
        out = rows if out is None else out.union(rows)
    return saved(out, "fa-fates")


def interaction_report(rows: DataFrame, fails: Mapping[str, DataFrame], good: DataFrame, toxic: DataFrame) -> DataFrame:
    """The counts of every part, order and step.

    ``rows``: x_row, x_id, part; ``fails``: for each filter (one letter) the x_row of the rows that
    fail it; ``good`` and ``toxic``: x_id of labelled documents.
    """
    letters = "".join(sorted(fails))
    cells = rows.select("x_row", "x_id", "part")
    for k in letters:
        cells = split(cells, saved(fails[k].select("x_row").distinct(), f"fa-ids-{k}"), "x_row", f"x_{k}")
    cells = split(cells, good.select("x_id").distinct(), "x_id", "x_good")
    cells = split(cells, toxic.select("x_id").distinct(), "x_id", "x_toxic")
    name = F.concat(*[F.when(F.col(f"x_{k}") == 1, F.lit(k)).otherwise(F.lit("")) for k in letters])
    cells = cells.groupBy("part", name.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum("x_good").alias("good"), F.sum("x_toxic").alias("toxic"))
    cells = saved(cells, "fa-counts")
    met = cells.join(F.broadcast(prefix_fates(cells, letters)), "cell")  # at most 2^k * k! * k * 4 short rows
    total = lambda c, fate: F.coalesce(F.sum(F.when(F.col("fate") == fate, F.col(c))), F.lit(0)).cast("bigint")
    out = met.groupBy("part", "filter_order", "step", "filter").agg(
        total("n", "kept").alias("kept"), total("n", "removed").alias("removed"), total("n", "redundant").alias("redundant"),
        total("n", "unique").alias("unique_fails"), total("good", "removed").alias("good_lost"), total("toxic", "removed").alias("toxic_lost"),
    )
    own = Window.partitionBy("part", "filter")  # k! orders
    return out.withColumn("shapley", F.sum("removed").over(own)).drop("filter")


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The report for the four text filters and E, the later copies of a text."""
    text = F.col("x_text")
    filters = corpus_filters(text)
    rows = numbered(docs, filters, id_col, text_col, part_col)
    fails = {k: rows.filter(f"fails_{k}").select("x_row") for k in filters}
    fails["E"] = later_copies(rows)
    ids = lambda c: labels.filter(labels[c] == 1).select(labels["doc_id"].cast("bigint").alias("x_id"))
    return interaction_report(rows, fails, ids("quality"), ids("toxic"))
