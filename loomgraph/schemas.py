"""Explicit schemas (as DDL) and value sets of every table the package reads or writes."""

from __future__ import annotations

# --- fixed values -------------------------------------------------------------------
PAPER_TYPES = ("technique", "benchmark", "analysis", "survey", "other")
STATUSES = ("approved", "unreviewed", "pending", "rejected")
ADMITTED = ("approved", "unreviewed")
DIRECTIONS = ("ancestors", "descendants", "both")
NO_DEFINITION_TYPES = ("analysis", "benchmark", "survey")
REJECT_VERDICTS = ("reject", "rejected", "drop")
PASS_VERDICT = "technique"
EDITABLE_FIELDS = ("status", "aliases", "definition", "source", "first_seen")
PAGE_BUDGET_CHARS = 20000
HEAD_CHARS = 6000
MIN_PDF_BYTES = 10000
DOWNLOAD_PAUSE_SECONDS = 3.0
TOP_K, SCORE_FLOOR = 8, 0.30
EMBED_BATCH = 256
MAX_RESULTS_PER_QUERY = 50
MAX_EXTRACT = 2
MAX_RELATED = 10
# ------------------------------------------------------------------------------------

DEFINES, BUILDS_ON = 0, 1  # phase of a mention; also the order within one paper

PARSED = (
    "paper_id string, ok boolean, reason string, cut_method string, char_count bigint, text string"
)
CONTENT_FIELDS = ("title", "task", "defines", "uses", "problem", "domain", "paper_type")
CONTENT = (
    "title string, task array<string>, defines array<struct<name:string,definition:string>>, "
    "uses array<string>, problem string, domain string, paper_type string"
)
LINEAGE = ("builds_on array<string>")
LEXICON_FILE = (
    "techniques map<string,struct<aliases:array<string>,status:string,definition:string,"
    "source:string,first_seen:string>>"
)
LEXICON_FILE_LEGACY = ("techniques map<string,array<string>>")
LEXICON = (
    "ord bigint, name string, aliases array<string>, status string, definition string, "
    "source string, first_seen string"
)
PAPERS = (
    "pid string, title string, problem string, task array<string>, domain string, paper_type string"
)
MENTIONS = (
    "pid string, phase int, pos int, name string, definition string"
)
FEED = (
    "query_ord int, query string, entry_ord int, id string, title string, summary string, "
    "published string, tags array<struct<term:string>>"
)
GATE = "struct<verdict:string,reason:string,model:string,prompt_ver:string,date:string>"
LEDGER = (
    "aid string, title string, abstract string, published string, categories array<string>, "
    f"gate {GATE}, extracted boolean, first_seen_query string"
)
SIMILARITY = ("field string, a string, b string, sim double")
VECTORS = ("model string, id string, vec array<double>")
PAGES = ("paper_id string, page int, text string")
SESSION = ("thread_id string, seq bigint, stage string, state string")
