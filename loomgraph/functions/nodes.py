"""Column expressions over graph nodes: definition state, embedding text, report lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomgraph.functions.text import or_empty, strip
from loomgraph.schemas import ADMITTED, NO_DEFINITION_TYPES


def admitted(status: Column) -> Column:
    """Only reviewed-or-new names become nodes; an unknown status does not."""
    return F.coalesce(status.isin(*ADMITTED), F.lit(False))


def v1_def_status(definition: Column, ptype: Column) -> Column:
    return (
        F.when((or_empty(definition) != "") & (ptype == "technique"), "ok")
        .when(ptype.isin(*NO_DEFINITION_TYPES), "n/a")
        .otherwise("placeholder")
    )


def has_definition(def_status: Column) -> Column:
    return F.coalesce(def_status == "ok", F.lit(False))


def node_text(canonical: Column, definition: Column, ptype: Column) -> Column:
    """Embedding text of a single-type node: definition, else name and type."""
    text = strip(or_empty(definition))
    return F.when(text != "", F.concat(canonical, F.lit(": "), text)).otherwise(
        F.concat(canonical, F.lit(" ("), F.coalesce(ptype, F.lit("technique")), F.lit(")"))
    )


def typed_embed_text(node_type: Column, definition: Column, problem: Column) -> Column:
    """Embedding text of a typed node: concepts by definition, papers by problem; blank is null."""
    text = F.when(node_type == "concept", strip(or_empty(definition))).when(
        node_type == "paper", strip(or_empty(problem))
    )
    return F.nullif(text, F.lit(""))


def _score(score: Column) -> Column:
    return F.format_string("%.2f", score)


def concept_line(name: Column, definition: Column, def_status: Column, score: Column) -> Column:
    text = strip(or_empty(definition))
    bare = F.coalesce(def_status == "placeholder", F.lit(False)) | (text == "")
    return F.when(
        bare, F.concat(F.lit("- "), name, F.lit(" (no definition yet) ["), _score(score), F.lit("]"))
    ).otherwise(
        F.concat(F.lit("- "), name, F.lit(": "), text, F.lit(" ["), _score(score), F.lit("]"))
    )


def paper_line(title: Column, problem: Column, score: Column) -> Column:
    text = strip(or_empty(problem))
    shown = F.when(text == "", F.lit("(no problem statement)")).otherwise(text)
    return F.concat(F.lit("- "), title, F.lit(" — "), shown, F.lit(" ["), _score(score), F.lit("]"))
