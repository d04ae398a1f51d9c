"""Language identification by compression.

For every learned language a zstandard raw-content dictionary is filled with training text.
A text is lower-cased and cut into pieces of `piece` bytes, so that the dictionary and not the text
itself is what a piece can refer to; each piece is encoded with every dictionary, and the
language with the smallest sum wins. The margin is the difference to the second, in bytes
per byte of text. A text is rejected when it is fewer than MIN_BYTES ahead of the second, or when the bytes
ahead, or the bytes saved against no dictionary, over the root of its length are below what all but `reject_share`
of held-out training documents reach (LEAST where too few are held out).

Training is bounded: `docs_per_lang` documents for each language, whatever their number, different texts in the order of a hash of the text, and `dict_bytes` of text per language. Each
document gives an equal part of them, from a place drawn over its whole text; what short texts leave goes to the
others. Prediction reads the text alone, whole.

Defined results: null text, or text without a letter, is `und` with score 0, rejected. With a
single learned language every other text has it, with score 1. With none, `und`. A tie goes to the
language with more training documents and is rejected. Repeated rows get equal results. Columns other
than id, text and lang are not read."""

from __future__ import annotations

import math

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.llm.textops import chunks, field_as_text


def dictionaries(train: DataFrame, **bounds) -> dict[str, bytes]:
    """Training text per language from columns doc_id, text, lang; frequent languages first."""
    return learned(train, **bounds)[0]


def learned(train: DataFrame, docs_per_lang: int = 60, dict_bytes: int = 16 << 10,
            margin_docs: int = 2000) -> tuple[dict[str, bytes], list[tuple[str, str]]]:
    """The dictionaries, and (lang, text) of up to about `margin_docs` other training documents."""
    known = train.filter("lang is not null")
    often = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    texts = known.filter(F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64(F.lit(3), "text").alias("o"))
    held = max(4, margin_docs // max(1, len(often)))
    docs = F.least(F.lit(docs_per_lang), F.ceil(0.75 * F.col("n")))
    need = F.when(F.col("k") <= docs, 4 * F.ceil(dict_bytes / docs) + 64).otherwise(HELD_CHARS)
    picked = distinct_texts(texts, docs_per_lang + held, dict_bytes).select("lang", "k", "o", seeded("text", need, 7).alias("text"), (F.col("k") > docs).alias("held"))
    langs: dict[str, list[tuple[str, int]]] = {}
    others = []
    for r in picked.orderBy("lang", "k").collect():
        if r["held"]:
            others.append((r["lang"], r["text"]))
        else:
            langs.setdefault(r["lang"], []).append((r["text"].lower(), r["o"]))
    return {lang: shared_out(langs[lang], dict_bytes) for lang in often if lang in langs}, others


def seeded(text: str, size: Column, seed: int) -> Column:
    """`size` characters from a place drawn by the hash o."""
    return F.substring(F.col(text), F.pmod(F.xxhash64(F.lit(seed), "o"), F.greatest(F.length(text) - size + 1, F.lit(1))).cast("int") + 1, size.cast("int"))


def distinct_texts(texts: DataFrame, most: int, size: int) -> DataFrame:
    """lang, o, text (`size` characters from a drawn place), k, n: at most `most` different texts per language in
    the order of a hash of the text, and how many there are. Tasks send only rows whose hash is below twice the share wanted."""
    counted = texts.groupBy("lang").agg(F.approx_count_distinct("o").alias("d"))
    draw = F.pmod("o", F.lit(1 << 30))
    few = F.least(2.5 * most / F.col("d"), F.lit(1.0)) * (1 << 30)  # the count is right to 5 %
    near = texts.join(F.broadcast(counted), "lang").filter(draw < few)
    near = near.select("lang", "o", seeded("text", F.lit(size), 5).alias("text")).dropDuplicates(["lang", "o"])
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(draw, "o"))).filter(F.col("k") <= most)
    return ranked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("lang")))


def shared_out(texts: list[tuple[str, int]], size: int) -> bytes:
    """`size` bytes in equal parts; what a short text leaves goes to the others."""
    parts, left = [], size
    for at, (text, o) in enumerate(sorted(texts, key=lambda x: len(x[0].encode()))):
        data = text.encode()
        n = min(len(data), max(0, left // (len(texts) - at) - 1))
        start = o % (len(data) - n + 1)
        parts.append((o, data[start: start + n].decode(errors="ignore").encode()))
        left -= len(parts[-1][1]) + 1
    return b"\n".join(p for _, p in sorted(parts))


MIN_BYTES, HELD_CHARS = 4, 4096
LEAST = (0.25, 0.0)  # where too few documents are held out: above nearly all random letters


class Classifier:
    """Coders are held for `block` languages at a time; with more, they are made anew for each block and list of texts."""

    def __init__(self, texts: dict[str, bytes], piece: int = 2048, block: int = 256):
        self.langs, self.piece, self.block, self.texts = list(texts), piece, block, texts
        self.at, self.coders, self.least = -1, [], list(LEAST)
        # Lazy matching from four bytes on: words are short, and the dictionary is small.
        self.how = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=17, hash_log=14, chain_log=15, search_log=3, target_length=16,
            write_content_size=False, write_checksum=False, write_dict_id=False)
        self.bare = zstandard.ZstdCompressor(compression_params=self.how)

    def load(self, at: int) -> None:
        """Coders of the block of languages from `at`."""
        if self.at == at:
            return
        self.at, self.coders = at, []
        for lang in self.langs[at: at + self.block]:
            d = zstandard.ZstdCompressionDict(self.texts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=self.how)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=self.how))

    def sizes(self, texts: list[bytes]) -> list[list[int]]:
        """Encoded size of each text with each language."""
        out: list[list[int]] = [[] for _ in texts]
        for at in range(0, len(self.langs), self.block):
            self.load(at)
            for data, sizes in zip(texts, out):
                parts = [data[i: i + self.piece] for i in range(0, len(data), self.piece)]
                sizes += [sum(len(c.compress(p)) for p in parts) for c in self.coders]
        return out

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin; a text without letters is und."""
        return self.measure([text])[0][:3]

    def measure(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """Language, score, margin and whether the text is rejected, of each text."""
        datas = [t.lower().encode() if t and self.langs and any(map(str.isalpha, t)) else None for t in texts]
        sizes = iter(self.sizes([d for d in datas if d is not None]))
        return [("und", 0.0, 0.0, True) if d is None else self.judged(d, next(sizes)) for d in datas]

    def judged(self, data: bytes, sizes: list[int]) -> tuple[str, float, float, bool]:
        best = min(sizes)
        score = 1.0 / sum(math.exp(max(-700.0, -(s - best) / 4.0)) for s in sizes)
        second = min((s for i, s in enumerate(sizes) if i != sizes.index(best)), default=best + len(data))
        ahead, gain = self.strengths(data, best, second)
        return self.langs[sizes.index(best)], score, (second - best) / len(data), second - best < MIN_BYTES or ahead < self.least[0] or gain < self.least[1]

    def strengths(self, data: bytes, best: int, second: int) -> tuple[float, float]:
        """Bytes ahead of the second language, and saved by the dictionary, both over the root of the length:
        chance differences grow with the root."""
        bare = sum(len(self.bare.compress(data[i: i + self.piece])) for i in range(0, len(data), self.piece))
        return (second - best) / len(data) ** 0.5, (bare - best) / len(data) ** 0.5

    def learn_margin(self, held: list[tuple[str, str]], share: float) -> None:
        """Least strengths such that about `share` of the held-out texts given to their language fall below each."""
        seen, datas = [], [text.lower().encode() for _, text in held]
        for (lang, _), data, sizes in zip(held, datas, self.sizes(datas)):
            if data and len(sizes) > 1 and self.langs[sizes.index(min(sizes))] == lang:
                best, second = sorted(sizes)[:2]
                seen.append(self.strengths(data, best, second))
        if len(seen) * share >= 1:
            for k in (0, 1):
                self.least[k] = max(0.0, sorted(x[k] for x in seen)[int(len(seen) * share)])


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_margin: float | None = None,
             reject_share: float = 0.015, carry: bool = False, **bounds) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected of each row; with `carry` also the row as a struct. A `min_margin`,
    in bytes per byte, replaces the learned one."""
    texts, held = learned(train, **bounds)
    judge = Classifier(texts)
    judge.learn_margin(held, reject_share)
    shared = docs.sparkSession.sparkContext.broadcast((texts, judge.least))

    def run(batches):
        model = Classifier(shared.value[0])
        model.least = shared.value[1]
        for whole in batches:
            for b in chunks(field_as_text(whole, "row", text_col) if carry else whole, "text"):
                out = model.measure(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in kept), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()),
                     pa.array([x[2] for x in out], pa.float64()), pa.array([x[3] if min_margin is None else x[0] == "und" or x[2] < min_margin for x in out], pa.bool_())],
                    [*kept, "lang_pred", "score", "margin", "rejected"])

    kept = ["doc_id"] + ["row"] * carry
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.struct("*").alias("row") if carry else F.col(text_col).cast("string").alias("text"))
    schema = rows.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("margin", "double").add("rejected", "boolean")
    return rows.mapInArrow(run, schema)


def training_rows(docs: DataFrame, where: Column) -> DataFrame:
    return docs.filter(where).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
