"""Small inputs with every awkward case, and plain Python answers to compare with."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ("row_ord", "row", "sha", "maybe", "id", "n", "at", "places", "label", "size", "target", "taken", "pattern", "word",
           "score", "quality", "kept", "t", "known", "bits", "lang_pred", "h1", "draw", "train", "gone", "site")
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES)


def frame(spark, rows, parts=3):
    """Rows (doc_id, text, lang, source) with further columns whose names operators use too."""
    full = [(*r, len(r[1] or ""), *["x"] * len(CLASHES)) for r in rows]
    return spark.createDataFrame(full, DDL).repartition(parts, "doc_id").sortWithinPartitions("doc_id", "text")


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=3, n=60):
    """Plain, copied, near-copied, overlapping, blank, null and repeated documents."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    out = []
    for i in range(n):
        w = words(rng, rng.choice([3, 20, 45, 90, 160]))
        if i % 6 == 1:
            w = w[:10] + passage[rng.randrange(20):] + w[10:]
        if i % 5 == 2 and out and out[-1][1]:
            w = WORD.findall(out[-1][1])
            if i % 10 == 2 and len(w) > 30:
                w[15] = "changed"
        sep = rng.choice([" ", "  ", "\n", "\t"])
        out.append((i * 7, sep.join(w), rng.choice(["en", "fr"]), rng.choice(["s1", "s2", "s3", None])))
    out += [(9001, None, None, None), (9002, "", "en", "s1"), (9003, " \n\t ", "fr", None), (None, "lonely words here", None, "s2")]
    out += [out[1], out[1], out[4], (None, None, None, None), (None, None, None, None)]
    return out
