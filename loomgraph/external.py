"""Boundaries to services (language model, embeddings, PDF and network) with offline
stand-ins. A service object is shipped to tasks, so it must pickle; it is only ever handed
one batch of one partition."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loomgraph.functions.text import defined_names, or_empty
from loomgraph.schemas import CONTENT, CONTENT_FIELDS, EMBED_BATCH, LINEAGE, PAPER_TYPES


class Embedder(Protocol):
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Extractor(Protocol):
    def content(self, text: str) -> dict: ...
    def lineage(self, content: dict, text: str) -> dict: ...


class Classifier(Protocol):
    model: str

    def classify(self, papers: DataFrame) -> DataFrame:
        """(aid, title, abstract) -> (aid, verdict, reason)."""


class Fetcher(Protocol):
    def fetch(self, paper_id: str) -> bytes: ...


class PageDecoder(Protocol):
    def pages(self, content: bytes) -> Iterator[str]: ...


class Assistant(Protocol):
    """Driver-side language-model calls: one per user action, never per row."""

    def intent(self, text: str) -> dict: ...
    def expand(self, topic: str, related: list[str]) -> list[str]: ...
    def report(self, intent: dict, concept_lines: list[str], paper_lines: list[str]) -> str: ...


# --- embeddings -----------------------------------------------------------------------


class HashingEmbedder:
    """Deterministic offline embedding: character trigrams hashed by the first digits of their
    MD5, L2-normalized. Trigrams are found as arrays over all texts of a call, and only
    different ones are hashed."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.model = f"hashed-trigrams-{dim}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        padded = [f"  {text.lower()} " for text in texts]
        points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(padded)), [len(t) for t in padded])
        at = np.flatnonzero(row[:-2] == row[2:]) if len(row) > 2 else np.zeros(0, np.int64)
        grams, which = np.unique((points[at] << 42) | (points[at + 1] << 21) | points[at + 2], return_inverse=True)
        hashed = [hashlib.md5("".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0)).encode("utf-8", "surrogatepass")).hexdigest()
                  for g in grams.tolist()]
        place = np.array([int(h[:2], 16) % self.dim for h in hashed], np.int64)
        sign = np.array([1.0 if int(h[2], 16) < 8 else -1.0 for h in hashed])
        if len(at):
            np.add.at(out, (row[at], place[which]), sign[which])
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1.0, norms)).tolist()


def embed_texts(texts: DataFrame, embedder: Embedder, batch: int = EMBED_BATCH) -> DataFrame:
    """(id, text) -> (id, vec). Blank texts keep their row with a null vector; the service
    sees at most `batch` texts per call."""
    id_type = texts.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            filled = [i for i, t in enumerate(frame["text"]) if t and t.strip()]
            vecs: list = [None] * len(frame)
            for at in range(0, len(filled), batch):
                part = filled[at:at + batch]
                for i, v in zip(part, embedder.embed([frame["text"].iloc[i] for i in part])):
                    vecs[i] = v
            yield pd.DataFrame({"id": frame["id"], "vec": vecs})

    return texts.select("id", "text").mapInPandas(run, f"id {id_type}, vec array<double>")


# --- extraction -------------------------------------------------------------------------


def _list(value):
    return [] if value is None else list(value)


def extract_contents(parsed: DataFrame, extractor: Extractor) -> DataFrame:
    """(pid, text) -> content records through a per-text service, and `error` where it failed."""

    def run(frames):
        for frame in frames:
            recs = [_attempt(extractor.content, t) for t in frame["text"]]
            rows = pd.DataFrame([[r.get(f) for f in (*CONTENT_FIELDS, "error")] for r in recs],
                                columns=[*CONTENT_FIELDS, "error"], dtype=object)
            rows.insert(0, "pid", frame["pid"].values)
            yield rows

    return parsed.select("pid", "text").mapInPandas(run, f"pid string, {CONTENT}, error string")


def _attempt(service, *args) -> dict:
    """A record of a service, or one with `error`: a failed text is a result, not a failed job."""
    try:
        return {**service(*args), "error": None}
    except Exception as e:
        return {"error": str(e) or type(e).__name__}


def extract_lineage(contents: DataFrame, parsed: DataFrame, extractor: Extractor) -> DataFrame:
    """Lineage records from content records and texts, and `error` where the service failed.
    The service gets the title, the defined names and their comma list."""
    joined = contents.select("pid", "title", "defines", defined_names("defines").alias("names")).join(
        parsed.select("pid", "text"), "pid")

    def run(frames):
        for frame in frames:
            recs = [
                _attempt(extractor.lineage, {"title": ti, "defines": _list(d), "names": n}, tx)
                for ti, d, n, tx in zip(frame["title"], frame["defines"], frame["names"], frame["text"])
            ]
            yield pd.DataFrame({"pid": frame["pid"], "builds_on": [_list(r.get("builds_on")) for r in recs],
                                "error": pd.Series([r["error"] for r in recs], dtype=object)})

    return joined.mapInPandas(run, f"pid string, {LINEAGE}, error string")


def staged_records(parsed: DataFrame, staged: DataFrame) -> DataFrame:
    """Offline stand-in for extraction: records prepared beforehand, joined by pid."""
    return staged.join(parsed.select("pid"), "pid", "left_semi")


# --- gate ---------------------------------------------------------------------------------


class KeywordClassifier:
    """Offline gate: the first listed type whose words occur in title or abstract, else
    technique. Stays in the JVM."""

    model = "keyword-rules"

    def __init__(self, rules: dict[str, list[str]] | None = None):
        self.rules = rules or {
            "survey": ["survey", "review"],
            "benchmark": ["benchmark", "dataset"],
            "analysis": ["analysis", "study of"],
        }

    def classify(self, papers: DataFrame) -> DataFrame:
        text = F.lower(F.concat_ws(" ", or_empty("title"), or_empty("abstract")))
        verdict, reason = F.lit("technique"), F.lit("no keyword")
        for kind, words in reversed(list(self.rules.items())):
            for w in reversed(words):
                hit = text.contains(w)
                verdict = F.when(hit, kind).otherwise(verdict)
                reason = F.when(hit, f"mentions {w}").otherwise(reason)
        return papers.select("aid", verdict.alias("verdict"), reason.alias("reason"))


# --- driver-side assistant --------------------------------------------------------------


class TemplateAssistant:
    """Offline assistant: the command is the topic, the report is the lines themselves."""

    def __init__(self, period_from: str = "", period_to: str = ""):
        self.period = {"period_from": period_from, "period_to": period_to}

    def intent(self, text: str) -> dict:
        return {"topic": text.strip(), "topic_kr": "", "interpretation": "", **self.period}

    def expand(self, topic: str, related: list[str]) -> list[str]:
        return [topic, *related]

    def report(self, intent: dict, concept_lines: list[str], paper_lines: list[str]) -> str:
        found = len(concept_lines), len(paper_lines)
        grade = "sufficient" if min(found) > 2 else "partial" if max(found) else "empty"
        return "\n".join([
            f"Topic: {intent['topic']}",
            "Concepts:", *(concept_lines or ["(none matched)"]),
            "Papers:", *(paper_lines or ["(none matched)"]),
            f"Coverage: {grade}",
        ])


class KeywordTranslator:
    """Offline command translator: recognizes a few words instead of asking a model."""

    collect_words = ("collect", "fetch", "gather", "find papers")
    lineage_words = ("lineage", "ancestor", "descendant")
    reset_words = ("everything", "reset", "show all")

    def __init__(self, domains: tuple[str, ...] = ("general", "medical")):
        self.domains = domains

    def translate(self, text: str, names: DataFrame) -> dict:
        low = text.lower()
        if any(w in low for w in self.collect_words):
            return {"tool": "collect", "args": {"topic_text": text}}
        if any(w in low for w in self.lineage_words):
            return self._lineage(low, names)
        args = {}
        for field, values in (("ptype", PAPER_TYPES), ("domain", self.domains)):
            hit = next((v for v in values if v in low), None)
            if hit:
                args[field] = hit
        date = re.search(r"\b(20\d\d)(-\d\d)?\b", low)
        if date:
            args["date_after"] = date[1] + (date[2] or "-01")
        if args:
            return {"tool": "filter", "args": args}
        if any(w in low for w in self.reset_words):
            return {"tool": "reset", "args": {}}
        return {"tool": None, "message": "the command was not understood"}

    def _lineage(self, low: str, names: DataFrame) -> dict:
        """The longest node name the sentence contains."""
        best = (
            names.filter(F.lit(low).contains(F.lower("canonical")) & (F.length("canonical") > 0))
            .orderBy(F.desc(F.length("canonical")), "canonical").first()
        )
        if best is None:
            return {"tool": None, "message": "the node was not found"}
        up, down = "ancestor" in low, "descendant" in low
        direction = "both" if up == down else "ancestors" if up else "descendants"
        return {"tool": "focus_lineage", "args": {"node": best["canonical"], "direction": direction}}
