"""Conversations: where a message goes, tool calls from their parts, ratios of evaluation cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words and characters that decide where a message goes.
GREETINGS = ("你好", "您好", "谢谢", "感谢", "多谢", "再见", "拜拜", "辛苦了", "早上好", "晚上好", "哈喽", "hello", "hi")
GREETING_TAIL = 8
KNOWLEDGE = "怎么|如何|什么|啥|哪|多少|为什么|是否|另外|还有|顺便|告诉我|帮我|查一下|配置|参数|最大值|最小值|版本|超时|timeout"
CORPUS = "^(这个|当前|本)?(知识库|资料库|文档库|资料)(的)?"
LAST_ANSWER = "上一条"
REWORK = "总结|简化|改写|整理"
NEW_FACT = "另外|告诉我|多少|怎么|什么|哪里"
REFERS_BACK = "^(那|它|这种)"
PUNCTUATION = r"[ \t\r\n，。！？!?.,;；、~～…:：]"
PARTICLES = "[啊呀吧哦呢哈嘛啦喔哟吗]+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_small_talk(text: Column) -> Column:
    """Whether a message is a greeting or thanks with little after it, and asks for nothing."""
    plain = F.regexp_replace(F.regexp_replace(text, PUNCTUATION, ""), PARTICLES, "")
    low = F.lower(plain)
    greets = F.lit(False)
    for word in GREETINGS:
        greets = greets | (F.startswith(low, F.lit(word)) & (F.length(low) <= len(word) + GREETING_TAIL))
    return greets & ~plain.rlike(KNOWLEDGE)


def routed(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) of users with ``intent``, ``action`` and ``standalone_query``.

    A message that refers back takes the one before it along, or asks what is meant if there is none. A null text
    is an empty one.
    """
    users = messages.where(F.col("role") == "user").withColumn("q", stripped(F.coalesce("text", F.lit(""))))
    before = F.coalesce(F.lag("q").over(W.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    q = F.col("q")
    reworks = F.contains(q, F.lit(LAST_ANSWER)) & q.rlike(REWORK)
    way = (
        F.when(is_small_talk(q), "talk")
        .when(q.rlike(CORPUS), "ask")
        .when(reworks, F.when(q.rlike(NEW_FACT), "ask").otherwise("rework"))
        .when(q.rlike(REFERS_BACK), F.when(F.col("before") == "", "unclear").otherwise("follow"))
        .otherwise("ask")
    )
    way_is = users.withColumn("before", before).withColumn("way", way)
    intent = F.when(F.col("way") == "talk", "ordinary").when(F.col("way") == "rework", "transform").when(F.col("way").isin("unclear", "follow"), "follow_up").otherwise("knowledge")
    action = F.when(F.col("way") == "talk", "reply").when(F.col("way") == "rework", "reuse").when(F.col("way") == "unclear", "clarify").otherwise("retrieve")
    alone = F.when(F.col("way") == "ask", q).when(F.col("way") == "follow", F.concat("before", q))
    return way_is.select("conv_id", "turn", intent.alias("intent"), action.alias("action"), alone.alias("standalone_query"))


def assembled_calls(deltas: DataFrame) -> DataFrame:
    """Tool calls of ``deltas`` (run, index, at, id, type, name, arguments) in the order of ``at``.

    The last id, type and name that is not empty holds, arguments are put together; calls without name and arguments
    do not count.
    """

    def last(column: str) -> Column:
        there = F.col(column) != ""
        return F.coalesce(F.max_by(F.when(there, F.col(column)), F.when(there, F.col("at"))), F.lit("")).alias(column)

    parts = F.sort_array(F.collect_list(F.struct("at", F.coalesce("arguments", F.lit("")).alias("part"))))
    calls = deltas.groupBy("run", "index").agg(last("id"), last("type"), last("name"), F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("arguments"))
    return calls.where("name <> '' OR arguments <> ''")


def case_ratios(cases: DataFrame) -> DataFrame:
    """Five ratios over evaluation ``cases`` (expected, action, rounds, max_rounds, citations_ok), 1 where none applies.

    ``expected`` is the action that a case must take (null: any); a case that must retrieve has at least one round,
    one that must not has none.
    """

    def ratio(part: Column, whole: Column) -> Column:
        return F.round(F.coalesce(F.count_if(part & whole) / F.nullif(F.count_if(whole), F.lit(0)), F.lit(1.0)), 9)

    wants, every = F.col("expected"), F.lit(True)
    return cases.agg(
        ratio(F.col("action") == wants, wants.isNotNull()).alias("route_accuracy"),
        ratio(F.col("rounds") > 0, wants == "retrieve").alias("required_retrieval_recall"),
        ratio(F.col("rounds") == 0, wants != "retrieve").alias("no_retrieval_precision"),
        ratio(F.col("rounds") <= F.col("max_rounds"), every).alias("loop_convergence"),
        ratio(F.col("citations_ok"), every).alias("citation_validity"),
        F.count(F.lit(1)).alias("cases"),
    )
