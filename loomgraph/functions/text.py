"""Text and identifier functions as Column -> Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomgraph.schemas import HEAD_CHARS

# --- fixed values -------------------------------------------------------------------
# Whitespace is Python's: Unicode White_Space plus 0x1c-0x1f (patterns need the U flag).
SPACE = r"[\s\x1c-\x1f]"
SPACES = rf"(?U){SPACE}+"
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
ABSTRACT_WORD = r"\babstract\b"
NEXT_SECTION_HEADS = (
    r"2\s+[A-Z]",
    r"2\.\s+[A-Z]",
    r"##?\s*2\b",
    r"related work",
    r"background",
    r"preliminaries",
    r"2\s+related",
)
SECTION_SEARCH_OFFSET = 50
# ------------------------------------------------------------------------------------


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def or_empty(col: Column | str) -> Column:
    return F.coalesce(_c(col), F.lit(""))


def strip(col: Column | str) -> Column:
    """Python's str.strip(): both ends, any whitespace."""
    return F.btrim(_c(col), F.lit(SPACE_CHARS))


def is_blank(col: Column | str) -> Column:
    return strip(or_empty(col)) == ""


def squeeze(col: Column | str) -> Column:
    """Collapse whitespace runs to one space and trim; null becomes empty."""
    return F.trim(F.regexp_replace(or_empty(col), SPACES, " "))


def canon(col: Column | str) -> Column:
    """Identity key of a name: case, hyphens and spacing do not matter. Never null, so that
    joins on the key need no null filter, which would evaluate the expression twice."""
    spaced = F.replace(F.lower(_c(col)), F.lit("-"), F.lit(" "))
    return or_empty(F.trim(F.regexp_replace(spaced, SPACES, " ")))


def strip_prefix(col: Column | str) -> Column:
    """`concept:x` / `paper:y` -> text after the first colon."""
    return F.regexp_replace(_c(col), r"^[^:]*:", "")


def arxiv_month(col: Column | str) -> Column:
    """`YYMM...` -> `20YY-MM`; null when the id does not start with four digits."""
    head = F.substring(_c(col), 1, 4)
    return F.when(
        head.rlike("^[0-9]{4}$"),
        F.concat(F.lit("20"), F.substring(head, 1, 2), F.lit("-"), F.substring(head, 3, 2)),
    )


def earliest_month(papers: Column | str) -> Column:
    """Smallest month over an array of paper ids; null when none is dated."""
    return F.array_min(F.transform(_c(papers), arxiv_month))


def normalize_paper_id(col: Column | str) -> Column:
    """URL or versioned id -> bare id: last path segment without the version suffix."""
    tail = F.substring_index(F.rtrim(or_empty(col), F.lit("/")), "/", -1)
    return F.regexp_replace(tail, r"(?Ud)v\d+$", "")


def iso_day(col: Column | str) -> Column:
    return F.substring(or_empty(col), 1, 10)


def year_month(col: Column | str) -> Column:
    return F.substring(or_empty(col), 1, 7)


def tag_terms(tags: Column | str) -> Column:
    return F.transform(_c(tags), lambda t: t["term"])


def join_tasks(task: Column | str) -> Column:
    return F.array_join(F.coalesce(_c(task), F.array().cast("array<string>")), " ")


def defined_names(defines: Column | str) -> Column:
    """Comma list of a record's defined names, as fed to lineage extraction."""
    names = F.array_join(F.transform(_c(defines), lambda d: d["name"]), ", ")
    return F.when(F.length(names) > 0, names).otherwise(F.lit("(none)"))


def contains_any(col: Column | str, words: list[str]) -> Column:
    """Case-insensitive literal containment of any of the words."""
    low = F.lower(_c(col))
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w.lower())
    return hit


def contains_text(col: Column | str, query: str) -> Column:
    """Case-insensitive literal substring search (never a pattern)."""
    return F.lower(_c(col)).contains(query.strip().lower())


def find_cut(col: Column | str, head: int | None = HEAD_CHARS) -> Column:
    """Abstract-plus-introduction slice of a paper: struct<text, cut_method>.

    Starts at the first word "abstract" (or 0) and ends at the first next-section header
    that begins a line at least 50 characters later; without one, the first `head` characters
    of the text (None: the whole text).
    The tail handed to the second split begins one character early so that a look-behind
    can tell a real line start, and prefixes come from split() rather than from index
    arithmetic, which would mix UTF-16 units with code points.
    """
    t = _c(col)
    before = F.split(t, f"(?iU){ABSTRACT_WORD}", 2)
    start = F.when(F.size(before) > 1, F.length(before[0])).otherwise(F.lit(0))
    tail = F.substr(t, start + F.lit(SECTION_SEARCH_OFFSET))
    heads = "|".join(NEXT_SECTION_HEADS).replace(r"\s", SPACE)
    parts = F.split(tail, rf"(?imdU)(?<=\n){SPACE}*(?:{heads})", 2)
    section = F.concat(
        F.substr(t, start + F.lit(1), F.lit(SECTION_SEARCH_OFFSET - 1)), parts[0]
    )
    found = F.size(parts) > 1
    return F.struct(
        F.when(found, section).otherwise(t if head is None else F.left(t, F.lit(head))).alias("text"),
        F.when(found, F.lit("section")).otherwise(F.lit("whole" if head is None else f"head{head}")).alias("cut_method"),
    )
