"""The given tables read in the roles of the graph: orders are papers, parts are the
lexicon, line items are mentions, documents are found papers, labels are the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

NAMES = frozenset(
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations".split()
)


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def papers(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").cast("string").alias("pid"),
            F.expr("concat('Order ', o_orderkey, ' placed by customer number ', o_custkey)").alias("title"),
            F.expr("case when o_orderstatus = 'P' then '' else "
                   "concat(o_orderpriority, ' value ', cast(floor(o_totalprice / 1000) as bigint)) end"
                   ).alias("problem"),
            F.split("o_orderpriority", "-").alias("task"),
            F.expr("case o_orderstatus when 'F' then 'general' when 'O' then 'medical' else '' end"
                   ).alias("domain"),
            F.expr("case o_orderpriority when '1-URGENT' then 'technique' when '2-HIGH' then 'benchmark' "
                   "when '3-MEDIUM' then 'technique' when '4-NOT SPECIFIED' then 'survey' "
                   "else 'other' end").alias("paper_type"),
        )

    def lexicon(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("ord"),
            F.expr("concat('Part-', p_partkey)").alias("name"),
            F.expr("array(concat('maker ', p_size), concat('SKU-', p_partkey))").alias("aliases"),
            F.expr("case when p_size <= 20 then 'approved' when p_size <= 35 then 'unreviewed' "
                   "when p_size <= 42 then 'pending' else 'rejected' end").alias("status"),
            F.expr("case when p_type in ('SMALL', 'MEDIUM') then p_name else '' end").alias("definition"),
            F.expr("case when p_size <= 20 then 'seed' else p_brand end").alias("source"),
            F.lit("").alias("first_seen"),
        )

    def mentions(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_orderkey").cast("string").alias("pid"),
            F.expr("case when l_linenumber = 1 then 0 else 1 end").alias("phase"),
            F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"),
            F.expr("case l_returnflag when 'A' then concat('Part-', l_partkey) "
                   "when 'R' then concat(' sku  ', l_partkey) else case when l_suppkey % 2 = 0 "
                   "then concat('Maker-', l_suppkey) else concat('Tool-', l_suppkey, '-', l_partkey % 7) end end"
                   ).alias("name"),
            F.expr("case when l_linenumber = 1 and l_discount >= 0.05 then "
                   "concat('uses ', cast(l_quantity as bigint), ' ', l_linestatus) else '' end"
                   ).alias("definition"),
        )

    def feed(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        kinds = "array('click', 'error', 'purchase', 'signup', 'view')"
        return self.events.withColumn("k", k).select(
            (F.expr(f"array_position({kinds}, event_type)") * 1000 + F.col("k")).cast("int").alias("query_ord"),
            F.expr("concat(event_type, ' ', k)").alias("query"),
            F.col("event_id").alias("entry_ord"),
            F.expr("concat('http://papers.example.org/abs/24', lpad(user_id % 12 + 1, 2, '0'), '.', user_id, 'v', k)"
                   ).alias("id"),
            F.expr("concat('  Paper   number ', user_id, ' ')").alias("title"),
            F.col("event_type").alias("summary"),
            F.date_format(F.expr("ts + make_dt_interval(k * 10)"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"),
            F.expr("array(named_struct('term', event_type))").alias("tags"),
        )

    def found(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").cast("string").alias("aid"),
            F.expr("concat(source, ' ', lang)").alias("title"),
            F.col("text").alias("abstract"),
            F.expr("case when lang = 'en' then '2024-05-01' else '' end").alias("published"),
            F.expr("array(lang, source)").alias("categories"),
            F.col("lang").alias("first_seen_query"),
        )

    def ledger(self) -> DataFrame:
        return self.labels.select(
            F.col("doc_id").cast("string").alias("aid"),
            F.lit("old title").alias("title"),
            F.lit("old abstract").alias("abstract"),
            F.lit("2020-01-01").alias("published"),
            F.array(F.lit("old")).alias("categories"),
            F.expr("named_struct('verdict', case when quality = 0 then 'Reject' else 'technique' end, "
                   "'reason', 'label', 'model', 'human', "
                   "'prompt_ver', case when toxic = 1 then 'gate-v0' else 'gate-v1' end, "
                   "'date', '2024-01-01')").alias("gate"),
            F.expr("quality = 1").alias("extracted"),
            F.lit("seed").alias("first_seen_query"),
        )

    def vectors(self) -> DataFrame:
        return self.embeddings.select(
            F.lit("problem").alias("field"), F.col("vec_id").alias("id"),
            F.col("embedding").cast("array<double>").alias("vec"), "label",
        )

    def talk_pages(self) -> DataFrame:
        """Conversation turns as pages; the role decides the heading a page opens with."""
        return self.conversations.select(
            F.col("conv_id").alias("paper_id"), F.col("turn").alias("page"),
            F.expr("concat(case role when 'user' then 'Abstract\n' when 'assistant' then "
                   "'\n \n2. Related Work\n' else '\n## 2 Setup\n' end, text)").alias("text"),
        )

    def line_pages(self) -> DataFrame:
        """Document lines as pages."""
        return self.documents.select(
            F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("page", "text")
        )
