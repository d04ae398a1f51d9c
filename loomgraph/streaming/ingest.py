"""File-source streams of new feed entries and records into the stored tables. Each micro
batch is an upsert or insert-if-absent, so a replayed batch changes nothing; the ledger's upserts
write only the buckets that a batch's ids fall into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators import collect as C, lexicon as L, mentions as M
from loomgraph.schemas import FEED, LEDGER, LEXICON, MENTIONS
from loomgraph.sources.snapshots import Snapshots


def _run(stream: DataFrame, checkpoint: str, each) -> StreamingQuery:
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(each).start()
    )


def ledger_stream(spark: SparkSession, feed_folder: str, store: Snapshots, checkpoint: str,
                  period_from: str = "", period_to: str = "") -> StreamingQuery:
    """New search entries -> ledger, by the same path as a batch search."""

    def each(batch: DataFrame, _: int) -> None:
        own = Snapshots(batch.sparkSession, store.root)
        found = C.search_results(batch, period_from, period_to)
        own.upsert("ledger", found, "aid", C.upsert_ledger, LEDGER)

    return _run(spark.readStream.schema(FEED).json(feed_folder), checkpoint, each)


def lexicon_stream(spark: SparkSession, mention_folder: str, store: Snapshots,
                   checkpoint: str) -> StreamingQuery:
    """New mentions -> names the lexicon does not know yet."""

    def each(batch: DataFrame, _: int) -> None:
        own = Snapshots(batch.sparkSession, store.root)
        lexicon = own.read("lexicon", LEXICON)
        new = M.register_in_order(M.unknown(M.keyed(batch), L.alias_map(lexicon)))
        own.write("lexicon", L.append_registrations(lexicon, new, known=True))

    return _run(spark.readStream.schema(MENTIONS).json(mention_folder), checkpoint, each)
