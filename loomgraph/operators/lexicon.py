"""Curated, status-tracked name lexicon: lookup, registration, edits, reports.

A lexicon is a DataFrame (ord, name, aliases, status, definition, source, first_seen).
`ord` is the row order, which decides who wins when two rows claim one canonical key.
Edits are pure functions old lexicon -> new lexicon; persisting goes through snapshots.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.text import canon, contains_text, or_empty, strip
from loomgraph.operators.chains import Circle, ends_and_places
from loomgraph.schemas import EDITABLE_FIELDS
from loomgraph.operators.ordering import with_row_index
from loomgraph.session import materialize


class LexiconError(ValueError):
    """A rejected edit; `kind` is bad_request, not_found or invalid_plan."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def _list(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.array().cast("array<string>"))


# --- lookup ---------------------------------------------------------------------------


def representatives(lexicon: DataFrame) -> DataFrame:
    """rk -> label, status, definition; the last row in lexicon order owns the key."""
    last = F.max(F.struct("ord", "name", "status", "definition"))
    return (
        lexicon.groupBy(canon("name").alias("rk"))
        .agg(last.alias("m"))
        .select(
            "rk",
            F.col("m.name").alias("label"),
            "m.status",
            or_empty("m.definition").alias("lex_definition"),
        )
    )


def alias_map(lexicon: DataFrame) -> DataFrame:
    """key -> rk over names and aliases; the last writer in (row, position) order wins."""
    entries = lexicon.select(
        "ord",
        canon("name").alias("rk"),
        F.posexplode(F.concat(F.array("name"), _list("aliases"))).alias("slot", "written"),
    )
    return entries.groupBy(canon("written").alias("key")).agg(
        F.max_by("rk", F.struct("ord", "slot")).alias("rk")
    )


def names_lookup(lexicon: DataFrame) -> DataFrame:
    """One row per resolvable key: key, rk, label, status, lex_definition."""
    return alias_map(lexicon).join(representatives(lexicon), "rk").select(
        "key", "rk", "label", "status", "lex_definition"
    )


def resolve(names: DataFrame, lexicon: DataFrame, column: str = "name") -> DataFrame:
    """Adds rk, label, status, found. Unknown names keep their own key and spelling."""
    keyed = names.withColumn("key", canon(column))
    return (
        keyed.join(names_lookup(lexicon), "key", "left")
        .withColumn("found", F.col("rk").isNotNull())
        .withColumn("rk", F.coalesce("rk", "key"))
        .withColumn("label", F.coalesce("label", column))
        .drop("key", "lex_definition")
    )


# --- views and reports ------------------------------------------------------------------


def rows(lexicon: DataFrame) -> DataFrame:
    """Public row form with defaults filled in."""
    return lexicon.select(
        "ord",
        "name",
        _list("aliases").alias("aliases"),
        F.coalesce("status", F.lit("unreviewed")).alias("status"),
        or_empty("definition").alias("definition"),
        or_empty("source").alias("source"),
        or_empty("first_seen").alias("first_seen"),
    )


def status_counts(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("status").agg(F.count("*").alias("n"))


def with_status(lexicon: DataFrame, status: str = "all") -> DataFrame:
    return lexicon if status == "all" else lexicon.filter(F.col("status") == status)


def _order(key: str, direction: str) -> list[Column]:
    if key not in ("name", "status", "source", "first_seen"):
        raise LexiconError("bad_request", f"cannot sort by {key}")
    k = F.lower(or_empty(key))
    return [k.asc() if direction == "asc" else k.desc(), F.col("ord").asc()]


def sorted_by(lexicon: DataFrame, key: str, direction: str = "asc") -> DataFrame:
    """Sort by a column, case-insensitively, nulls as ''; lexicon order breaks ties."""
    return lexicon.orderBy(*_order(key, direction))


def ranked_by(lexicon: DataFrame, key: str, direction: str = "asc") -> DataFrame:
    """`rank`, the position of every row in that order."""
    return with_row_index(lexicon, _order(key, direction), "rank")


def highlighted(lexicon: DataFrame, query: str) -> DataFrame:
    """Marks rows whose name contains the text; rows are never hidden."""
    q = query.strip()
    return lexicon.withColumn("matched", contains_text("name", q) if q else F.lit(False))


# --- edits --------------------------------------------------------------------------------


def append_registrations(lexicon: DataFrame, new: DataFrame, known: bool = False) -> DataFrame:
    """Insert-if-absent: adds first-seen names after the existing rows, in event order.

    `new` carries rk, label, status, definition, source, first_seen and an `at` ordering
    column; keys the lexicon already resolves are left untouched. `known` says that `new`
    holds no such key, as registrations do, so that the alias map is not built again.
    """
    fresh = new if known else new.join(alias_map(lexicon), new["rk"] == F.col("key"), "left_anti")
    indexed = with_row_index(fresh, [F.col("at"), F.col("rk")], "i")
    last_ord = lexicon.agg(F.coalesce(F.max("ord"), F.lit(-1))).scalar()
    added = indexed.select(
        (last_ord + 1 + F.col("i")).alias("ord"),
        F.col("label").alias("name"),
        F.array().cast("array<string>").alias("aliases"),
        "status",
        "definition",
        "source",
        "first_seen",
    )
    return lexicon.select(*added.columns).unionByName(added)


def _require(lexicon: DataFrame, name: str, role: str) -> None:
    if lexicon.filter(F.col("name") == name).isEmpty():
        raise LexiconError("not_found", f"{role} not in the lexicon: {name}")


def patch(lexicon: DataFrame, name: str, changes: dict) -> DataFrame:
    """Partial update of one row, found by its exact name. Unknown fields are ignored."""
    _require(lexicon, name, "name")
    hit = F.col("name") == name
    known = {f: v for f, v in changes.items() if f in EDITABLE_FIELDS}

    def literal(value):
        if isinstance(value, (list, tuple)):
            return F.array(*[F.lit(v) for v in value]).cast("array<string>")
        return F.lit(value)

    return lexicon.withColumns(
        {f: F.when(hit, literal(v)).otherwise(F.col(f)) for f, v in known.items()}
    )


def patch_many(lexicon: DataFrame, patches: DataFrame) -> DataFrame:
    """Batch form of `patch`: a table of name plus any editable columns; null = no change.
    Several patches of a name apply one after the other, by the column `seq` where there is
    one, so each field takes its last value that is not null; without `seq` the largest."""
    fields = [f for f in EDITABLE_FIELDS if f in patches.columns]
    at = [F.col("seq")] if "seq" in patches.columns else []
    last = {f: F.max(F.when(F.col(f).isNotNull(), F.struct(*at, F.col(f).alias("v")))) for f in fields}
    p = patches.groupBy("name").agg(*[last[f].alias(f"last_{f}") for f in fields])
    p = p.select("name", *[F.col(f"last_{f}.v").alias(f"new_{f}") for f in fields])
    joined = lexicon.join(p, "name", "left")
    kept = {f: F.coalesce(F.col(f"new_{f}"), F.col(f)) for f in fields}
    return joined.withColumns(kept).select(*lexicon.columns)


def merge_roots(lexicon: DataFrame, merges: DataFrame) -> DataFrame:
    """src, root, place for each merge (src, dst, seq) whose ends exist. A target that is itself
    merged away is followed to the row that stays; `place` orders the sources of a row that stays
    by seq, each before what was merged into it. Of several merges of one source the first by seq
    counts. A circle raises an error. Rounds grow with the logarithm of the longest chain."""
    names = lexicon.select("name").distinct()
    step = materialize(
        merges.filter("src <> dst").join(names, F.col("src") == F.col("name"), "left_semi")
        .join(names, F.col("dst") == F.col("name"), "left_semi")
        .groupBy("src").agg(F.min(F.struct("seq", "dst")).alias("m")).select("src", "m.dst", "m.seq")
    )
    try:
        return ends_and_places(step)
    except Circle:
        raise LexiconError("bad_request", "merges form a circle") from None


def merged_aliases(lexicon: DataFrame, merges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """name, place, alias: the aliases of every row that stays, one row each. A row keeps its own
    as they are; then come names and aliases of its sources, each once. Nothing is gathered
    by name, so a target of a third of all merges is no single row; places are numbered
    over a range-partitioned sort."""
    roots = materialize(merge_roots(lexicon, merges)) if roots is None else roots
    written = lexicon.select("name", F.posexplode(_list("aliases")).alias("slot", "alias"))
    kept = written.join(roots.select("src"), F.col("name") == F.col("src"), "left_anti").select(
        "name", F.lit(-1).cast("bigint").alias("of_place"), F.col("slot").cast("int").alias("slot"), "alias")
    sources = roots.select(F.col("root").alias("name"), F.col("place").alias("of_place"), "src")
    brought = sources.select("name", "of_place", F.lit(-1).alias("slot"), F.col("src").alias("alias")).unionByName(
        sources.join(written.withColumnRenamed("name", "of"), F.col("src") == F.col("of")).select("name", "of_place", "slot", "alias"))
    fresh = (
        brought.filter("alias <> name")
        .join(kept.select("name", "alias"), ["name", "alias"], "left_anti")
        .groupBy("name", "alias").agg(F.min(F.struct("of_place", "slot")).alias("at"))
        .select("name", "at.of_place", "at.slot", "alias")
    )
    ordered = with_row_index(kept.unionByName(fresh), [F.col("name"), F.col("of_place"), F.col("slot"), F.col("alias")], "i")
    first = ordered.groupBy(F.col("name").alias("of")).agg(F.min("i").alias("first"))
    return ordered.join(first, F.col("name") == F.col("of")).select("name", (F.col("i") - F.col("first")).alias("place"), "alias")


def merge_many(lexicon: DataFrame, merges: DataFrame) -> DataFrame:
    """Folds each (src, dst, seq) into the aliases of the row it ends in and drops the src
    rows. Pairs with an absent end are skipped; chains are followed. The alias arrays of the lexicon
    are built here, at the end; `merged_aliases` has them as rows."""
    roots = materialize(merge_roots(lexicon, merges))
    touched = roots.select(F.col("root").alias("name")).distinct()
    long = merged_aliases(lexicon, merges, roots).join(touched, "name", "left_semi")
    grown = long.groupBy(F.col("name").alias("of")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "alias"))), lambda x: x["alias"]).alias("grown"))
    return (
        lexicon.join(roots.select("src"), lexicon["name"] == F.col("src"), "left_anti")
        .join(grown, F.col("name") == F.col("of"), "left")
        .withColumn("aliases", F.coalesce("grown", "aliases"))
        .select(*lexicon.columns)
    )


def merge(lexicon: DataFrame, src: str, dst: str) -> DataFrame:
    """Folds one name into another; the source row, its status and definition are gone."""
    if not src or not dst:
        raise LexiconError("bad_request", "both names are needed")
    if src == dst:
        raise LexiconError("bad_request", "a name cannot be merged into itself")
    _require(lexicon, src, "source")
    _require(lexicon, dst, "target")
    spark = lexicon.sparkSession
    one = spark.range(1).select(F.lit(src).alias("src"), F.lit(dst).alias("dst"), F.lit(0).alias("seq"))
    return merge_many(lexicon, one)


def add_alias(aliases: Column, alias: Column) -> Column:
    """Appends a trimmed alias unless it is blank or already listed."""
    a = strip(alias)
    keep = (a == "") | F.array_contains(aliases, a)
    return F.when(keep, aliases).otherwise(F.array_append(aliases, a))


def remove_alias(aliases: Column, alias: Column) -> Column:
    return F.filter(aliases, lambda x: x != alias)


# --- bulk classification --------------------------------------------------------------------


@dataclass
class PlanCheck:
    """The three differences between a plan and the lexicon."""

    missing: DataFrame
    unplanned: DataFrame
    not_pending: DataFrame

    def ok(self) -> bool:
        return self.missing.isEmpty() and self.unplanned.isEmpty()


def plan_differences(lexicon: DataFrame, plan: DataFrame) -> DataFrame:
    """One full-outer pass: (name, problem) with problem missing/unplanned/not_pending.

    `plan` holds name, action (approve / reject / merge) and, for merges, `into`.
    """
    planned = plan.select("name").distinct().withColumn("planned", F.lit(True))
    both = lexicon.select("name", F.col("status"), F.lit(True).alias("present")).join(
        planned, "name", "full_outer"
    )
    problem = (
        F.when(F.col("present").isNull(), "missing")
        .when(F.col("planned").isNull() & (F.col("status") == "pending"), "unplanned")
        .when(F.col("planned") & ~F.coalesce(F.col("status") == "pending", F.lit(False)), "not_pending")
    )
    return both.select("name", problem.alias("problem")).filter("problem is not null")


def check_plan(lexicon: DataFrame, plan: DataFrame) -> PlanCheck:
    d = plan_differences(lexicon, plan)
    pick = {k: d.filter(F.col("problem") == k).select("name").orderBy("name")
            for k in ("missing", "unplanned", "not_pending")}
    return PlanCheck(**pick)


def _with_verdicts(lexicon: DataFrame, plan: DataFrame, skip_non_pending: bool) -> DataFrame:
    verdicts = plan.filter("action in ('approve', 'reject')").groupBy("name").agg(
        F.max(F.when(F.col("action") == "approve", "approved").otherwise("rejected")).alias("planned")
    )
    change = F.col("planned").isNotNull()
    if skip_non_pending:
        change = change & (F.col("status") == "pending")
    return (
        lexicon.join(verdicts, "name", "left")
        .withColumn("status", F.when(change, F.col("planned")).otherwise(F.col("status")))
        .select(*lexicon.columns)
    )


def _plan_merges(plan: DataFrame) -> DataFrame:
    order = F.col("seq") if "seq" in plan.columns else F.lit(0)
    return plan.filter("action = 'merge'").select(
        F.col("name").alias("src"), F.col("into").alias("dst"), order.cast("bigint").alias("seq")
    )


def apply_plan(lexicon: DataFrame, plan: DataFrame, skip_non_pending: bool = False) -> DataFrame:
    """Sets the planned statuses and folds the merges, in the order of the plan's `seq` where it
    has one; does not check the plan."""
    return merge_many(_with_verdicts(lexicon, plan, skip_non_pending), _plan_merges(plan))


def plan_outcome(lexicon: DataFrame, plan: DataFrame, skip_non_pending: bool = False) -> DataFrame:
    """status, n, n_aliases of the lexicon after `apply_plan`, counted on rows: no target gathers its aliases."""
    roots = materialize(merge_roots(lexicon, _plan_merges(plan)))
    stay = _with_verdicts(lexicon, plan, skip_non_pending).select("name", "status").join(
        roots.select(F.col("src").alias("name")), "name", "left_anti")
    counts = merged_aliases(lexicon, _plan_merges(plan), roots).groupBy("name").agg(F.count("*").alias("aliases"))
    return stay.join(counts, "name", "left").groupBy("status").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("aliases"), F.lit(0)).alias("n_aliases"))


def bulk_classify(
    lexicon: DataFrame, plan: DataFrame, apply: bool = False, skip_non_pending: bool = False
) -> DataFrame:
    """Validated bulk status change; a dry run returns the lexicon unchanged."""
    if not check_plan(lexicon, plan).ok():
        raise LexiconError("invalid_plan", "the plan names unknown rows or leaves pending rows out")
    return apply_plan(lexicon, plan, skip_non_pending) if apply else lexicon
