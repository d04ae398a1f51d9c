"""Rebuild by the papers that are new: stored firsts are merged with those of the delta.

What a graph says about a name is a minimum or a count over its mentions: first define, first text,
home paper, earliest month, numbers of papers. They are stored per name and merge with the firsts of
new papers, so nodes are made anew only for names that the delta mentions. Edges of a paper follow
from its own mentions, so new edges come from new papers, with one exception: a name that old papers
only build on was registered as pending; when a new paper defines it, it is registered anew and
admitted. Mentions of such names are looked up, and their edges added; mentions of other names are not kept. Nothing is ever taken away by
a new paper, as a first that grows smaller turns `pending` into `unreviewed` and never back.

All tables are bucketed and change in one commit; buckets of names and papers that the delta does not
touch are neither read nor written. The lexicon alone is written whole, and the ids of all papers are
compared with those of the graph.

The result is that of a full rebuild of all papers on the lexicon of the last full one, except for the
order (`ord`) of registered names, which is that of their arrival. An edited lexicon, or replaced
records, make the next rebuild a full one. Papers are expected with their mentions, as
`add_records` stores them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.nodes import admitted, v1_def_status
from loomgraph.functions.text import arxiv_month, or_empty
from loomgraph.operators import graph_v1, lexicon as L, mentions as M
from loomgraph.operators.ordering import with_row_index
from loomgraph.schemas import BUILDS_ON, DEFINES, LEXICON, MENTIONS, PAPERS
from loomgraph.session import stored
from loomgraph.sources.snapshots import BUCKETS, Commit, Snapshots, bucket_of

MARK = "n bigint, hash decimal(38,0), valid boolean"


def defines() -> Column:
    return F.col("phase") == DEFINES


def mark_of(lexicon: DataFrame) -> DataFrame:
    """Number and summed hash of the lexicon's rows, whatever their order."""
    row = F.xxhash64("name", "aliases", "status", "definition", "source", "first_seen")
    return lexicon.agg(F.count("*").alias("n"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("hash"),
                       F.lit(True).alias("valid"))


def invalidate(commit: Commit) -> None:
    """With this commit, the next rebuild is a full one."""
    if commit.store.exists("inc_mark"):
        commit.write("inc_mark", commit.store.read("inc_mark").withColumn("valid", F.lit(False)))


def can_follow(store: Snapshots, lexicon: DataFrame) -> bool:
    """Is the stored state that of this lexicon?"""
    if not store.exists("inc_mark"):
        return False
    then, now = store.read("inc_mark", MARK).first(), mark_of(lexicon).first()
    return then["valid"] and (then["n"], then["hash"]) == (now["n"], now["hash"])


def rebuild_stored(store: Snapshots) -> bool:
    """Brings the stored graphs up to the stored papers. Returns whether the delta was enough."""
    papers, mentions, lexicon = store.read("papers", PAPERS), store.read("mentions", MENTIONS), store.read("lexicon", LEXICON)
    follow = can_follow(store, lexicon)
    if follow:
        papers = stored(papers.join(store.read("v2_papers").select("pid"), "pid", "left_anti"))
        mentions = store.lookup("mentions", papers, "pid")
    apply(store, papers, mentions, lexicon, full=not follow)
    return follow


# --- what is stored per name ----------------------------------------------------------------


def firsts_of(rows: DataFrame, papers: DataFrame) -> DataFrame:
    """Per name, mins that combine in the tasks; only the ids of a name's papers are dealt out, by (rk, pid), for
    their number. `have` says that the paper has a record. What the record says is joined once per name."""
    have = F.col("have")
    mins = rows.groupBy("rk").agg(
        F.min(F.when(defines(), F.struct("pid", F.struct("pos", or_empty("definition").alias("definition")).alias("d")))).alias("define"),
        F.min(F.when(have, F.struct("pid", "phase"))).alias("first"),
        F.min(F.when(defines() & F.col("definition").isNotNull() & have, F.struct("pid", F.struct("pos", "definition").alias("t")))).alias("text"),
        F.min(F.when(have & defines(), F.col("pid"))).alias("home_pid"),
        F.min(F.when(have, arxiv_month("pid"))).alias("month"))
    pairs = rows.groupBy("rk", "pid").agg(F.max(defines()).alias("defines"), F.max("have").alias("have"))
    counts = pairs.groupBy("rk").agg(F.count_if("defines").alias("n_defining"), F.count_if("have").alias("n_papers"))
    firsts = stored(mins.join(counts, "rk"))
    first = papers.select(F.col("pid").alias("define_pid"), "domain", "paper_type")
    home = papers.select(F.col("pid").alias("home_pid"), F.struct("pid", "paper_type", "domain").alias("home"))
    ids = firsts.select("rk", F.col("define.pid").alias("define_pid"), "home_pid")
    said = ids.join(first, "define_pid", "left").join(home, "home_pid", "left").select("rk", "domain", "paper_type", "home")
    return firsts.join(said, "rk").select(
        "rk", F.when(F.col("define").isNotNull(), F.struct("define.pid", "define.d", "domain", "paper_type")).alias("define"), "n_defining", "first",
        "text", "n_papers", "home", "month")


def merged_firsts(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.unionByName(new).groupBy("rk")
    return both.agg(*[F.min(c).alias(c) for c in ("define", "first", "text", "home", "month")],
                    *[F.sum(c).alias(c) for c in ("n_defining", "n_papers")]).select(*new.columns)


def merged_registrations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of two registrations of a name the one whose deciding mention comes first."""
    both = old.unionByName(new)
    return both.groupBy("rk").agg(F.min_by(F.struct(*both.columns), "at").alias("r")).select("r.*")


def v1_nodes(named: DataFrame) -> DataFrame:
    return named.select(
        F.col("rk").alias("key"), F.col("label").alias("canonical"),
        F.coalesce(F.nullif("define.d.definition", F.lit("")), "lex_definition").alias("definition"),
        or_empty("define.pid").alias("def_source"), F.coalesce("define.domain", F.lit("general")).alias("domain"),
        F.coalesce("define.paper_type", F.lit("technique")).alias("ptype"), "status", F.col("n_defining").alias("n_papers"))


def v2_concepts(named: DataFrame) -> DataFrame:
    ok = F.col("text").isNotNull() | (F.col("first.phase") == DEFINES)
    return named.filter("first is not null").select(
        "rk", F.col("label").alias("canonical"), or_empty("text.t.definition").alias("definition"),
        F.when(ok, "ok").otherwise("placeholder").alias("def_status"), "status")


def view_nodes(named: DataFrame) -> DataFrame:
    def home(field: str, absent: str, blank: str) -> Column:
        own = F.when(F.col("home").isNotNull(), F.nullif(F.coalesce(f"home.{field}", F.lit(absent)), F.lit("")))
        return F.coalesce(own, F.lit(blank)).alias({"paper_type": "ptype"}.get(field, field))

    c = v2_concepts(named).withColumnRenamed("rk", "id")
    more = named.select(F.col("rk").alias("id"), "n_papers", "month", home("paper_type", "other", "technique"), home("domain", "general", "general"))
    return c.join(more, "id").select("id", "canonical", "definition", "def_status", "status", "n_papers", "month", "ptype", "domain")


# --- delta ------------------------------------------------------------------------------------


def apply(store: Snapshots, papers: DataFrame, mentions: DataFrame, lexicon: DataFrame, full: bool, buckets: int = BUCKETS) -> None:
    """Adds papers that no stored graph has; `full` starts from nothing, on the lexicon as it is."""
    with store.commit() as c:
        base = lexicon if full else store.read("inc_base", LEXICON)

        def known(name: str, keys: DataFrame, key: str, like: DataFrame) -> DataFrame:
            return like.limit(0) if full else c.lookup(name, keys, key)

        def replaced(name: str, keys: DataFrame, rows: DataFrame, key: str) -> None:
            c.replace(name, keys, rows, key, rows.schema, buckets, full, exact=True)

        def added(name: str, rows: DataFrame, key: str) -> None:
            c.append(name, rows, key, rows.schema, buckets, full, dealt_out=False)

        def united(name: str, rows: DataFrame, key: str) -> None:
            c.upsert(name, rows, key, lambda old, d: old.unionByName(d), rows.schema, buckets, full, distinct=True)

        alone = M.strays(mentions, papers).withColumn("alone", F.lit(True))
        owners = L.alias_map(base).withColumnRenamed("rk", "known").join(
            L.representatives(base).select(F.col("rk").alias("known"), admitted(F.col("status")).alias("ok")), "known")
        keyed = M.keyed(mentions).join(owners, "key", "left").join(alone, "pid", "left")
        rows = stored(keyed.select(
            "pid", "phase", "pos", "name", F.nullif("definition", F.lit("")).alias("definition"), F.coalesce("known", "key").alias("rk"),
            F.col("known").isNull().alias("unknown"), "ok", (F.col("alone").isNull() & F.col("pid").isNotNull()).alias("have")))
        touched = stored(rows.select("rk").distinct())

        new = M.register_defines_first(rows.filter("unknown").withColumnRenamed("rk", "key"))
        before = known("inc_registered", touched, "rk", new)
        registered = stored(merged_registrations(before, new))
        was_pending = before.filter("status = 'pending'").select("rk")
        flipped = registered.filter(admitted(F.col("status"))).select("rk").join(was_pending, "rk", "left_semi")
        names = stored(L.representatives(base).join(touched, "rk", "left_semi").unionByName(
            registered.select("rk", "label", "status", F.col("definition").alias("lex_definition"))).filter(admitted(F.col("status"))))
        fresh = firsts_of(rows, papers)
        firsts = stored(merged_firsts(known("inc_firsts", touched, "rk", fresh), fresh))
        named = firsts.join(names, "rk")

        kept_rows = rows.select("pid", "phase", "pos", "rk", "have")
        old_rows = known("inc_rows", flipped, "rk", kept_rows)
        # what the lexicon says is known of its names' rows; those of registered names alone are dealt out
        first_seen = rows.filter("unknown").select(*kept_rows.columns)
        admitted_new = registered.filter(admitted(F.col("status"))).select("rk")
        waiting = first_seen.join(registered.filter(~admitted(F.col("status"))).select("rk"), "rk", "left_semi").select(*kept_rows.columns)
        live = rows.filter("not unknown and ok").select(*kept_rows.columns).unionByName(
            first_seen.join(admitted_new, "rk", "left_semi").select(*kept_rows.columns)).unionByName(old_rows.select(*kept_rows.columns))
        n = buckets if full else c.now["v2_edges"].buckets
        live = stored(live.withColumn("bucket", bucket_of("rk", n)), "bucket").drop("bucket")
        pseudo = stored(graph_v1.undefined_papers(papers, rows).select("pid", "title", "problem", "domain", "paper_type"))
        homes = stored(homes_of(rows, live, pseudo))
        looked_up = old_rows.join(rows.select("pid").distinct(), "pid", "left_anti").select("pid")
        all_homes = homes if full else homes.unionByName(known("inc_homes", looked_up, "pid", homes))

        reached = stored(reached_from(live, all_homes))
        v1_edges = reached.filter("v1_home is not null").select(F.col("v1_home").alias("src"), "dst")
        builds_on = reached.filter("have and view_home <> dst").select(F.col("view_home").alias("src"), "dst")
        nodes = v1_nodes(named).unionByName(graph_v1._pseudo_nodes(pseudo)).withColumn("def_status", v1_def_status(F.col("definition"), F.col("ptype")))
        paper_keys = pseudo.select(F.concat(F.lit("paper:"), "pid").alias("key"), "pid")
        node_papers = live.filter(defines()).select(F.col("rk").alias("key"), "pid").distinct().unionByName(paper_keys)
        v2_papers = papers.select(
            "pid", F.coalesce("title", "pid").alias("title"), or_empty("problem").alias("problem"),
            F.coalesce("task", F.array().cast("array<string>")).alias("task"),
            F.coalesce("domain", F.lit("general")).alias("domain"), F.coalesce("paper_type", F.lit("other")).alias("paper_type"))
        v2_edges = live.filter("have").select("pid", "phase", "pos", F.when(defines(), "defines").otherwise("builds_on").alias("type"), "rk")

        node_keys = stored(touched.select(F.col("rk").alias("key")).unionByName(paper_keys.select("key")))

        replaced("inc_registered", touched, registered, "rk")
        replaced("inc_firsts", touched, firsts, "rk")
        added("inc_rows", waiting, "rk")
        added("inc_homes", homes, "pid")
        replaced("v1_nodes", node_keys, nodes, "key")
        added("v1_node_papers", node_papers, "key")
        united("v1_edges", v1_edges, "src")
        added("v2_papers", v2_papers, "pid")
        replaced("v2_concepts", touched, v2_concepts(named), "rk")
        added("v2_edges", v2_edges, "rk")
        replaced("view_nodes", touched.select(F.col("rk").alias("id")), view_nodes(named), "id")
        united("view_builds_on", builds_on, "src")
        if full:
            c.write("inc_base", base)
        grown = c.write("lexicon", grown_lexicon(lexicon, before, registered))
        c.write("inc_mark", mark_of(grown))


def homes_of(rows: DataFrame, live: DataFrame, pseudo: DataFrame) -> DataFrame:
    """pid, v1_home, view_home: where edges of a paper start. The single-type home is the first name the paper
    defines, null when it has no node, or the paper itself when it defines none; the view takes the first with a node,
    that is, of the `live` rows."""
    at = F.struct("pos", "rk").alias("at")
    both = rows.filter(defines()).select("pid", at, F.lit(False).alias("ok")).unionByName(live.filter(defines()).select("pid", at, F.lit(True).alias("ok")))
    own = both.groupBy("pid").agg(F.min("at").alias("h"), F.min(F.when(F.col("ok"), F.col("at"))).alias("v"))
    own = own.select("pid", F.when(F.col("h") == F.col("v"), F.col("h.rk")).alias("v1_home"), F.col("v.rk").alias("view_home"))
    return own.unionByName(pseudo.select("pid", F.concat(F.lit("paper:"), "pid").alias("v1_home"), F.lit(None).cast("string").alias("view_home")))


def reached_from(live: DataFrame, homes: DataFrame) -> DataFrame:
    """v1_home, view_home, dst, have: edges of both graphs, from one join; repeats are left to the tables."""
    starts = homes.filter("v1_home is not null or view_home is not null")
    targets = live.filter(F.col("phase") == BUILDS_ON).select("pid", F.col("rk").alias("dst"), "have")
    return targets.join(starts, "pid").select("v1_home", "view_home", "dst", "have")


def grown_lexicon(lexicon: DataFrame, before: DataFrame, registered: DataFrame) -> DataFrame:
    """The lexicon with new names behind its rows; a name registered anew keeps its place."""
    places = lexicon.select("ord", F.col("name").alias("was")).join(before.select("rk", F.col("label").alias("was")), "was").select("rk", "ord", "was")
    placed = registered.join(places, "rk", "left")
    new = with_row_index(placed.filter("ord is null").drop("ord", "was"), [F.col("at"), F.col("rk")], "i")
    last = lexicon.agg(F.coalesce(F.max("ord"), F.lit(-1))).scalar()
    rest = [F.col("label").alias("name"), F.array().cast("array<string>").alias("aliases"), "status", "definition", "source", "first_seen"]
    return (lexicon.join(places.select(F.col("was").alias("name")), "name", "left_anti").select(*lexicon.columns)
            .unionByName(placed.filter("ord is not null").select("ord", *rest))
            .unionByName(new.select((last + 1 + F.col("i")).alias("ord"), *rest)))
