"""Query analysis as columns: expansion, typed entities, intent, ambiguity, and at most three subqueries."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Abbreviations and what each stands for.
ABBREVIATIONS = {
    "DP": ("DomainParticipant", "DDS_DomainParticipant"),
    "DW": ("DataWriter", "DDS_DataWriter"),
    "DR": ("DataReader", "DDS_DataReader"),
}
#: Patterns of terms, and the names that they add.
ALIASES = (
    (r"域参与者|domain\s*participant", ("DomainParticipant", "DDS_DomainParticipant")),
    (r"数据写入者|数据写者|写端|data\s*writer", ("DataWriter", "DDS_DataWriter")),
    (r"数据读取者|数据读者|读端|data\s*reader", ("DataReader", "DDS_DataReader")),
    (r"发布者|publisher", ("Publisher", "DDS_Publisher")),
    (r"订阅者|subscriber", ("Subscriber", "DDS_Subscriber")),
    (r"等待集|wait\s*set", ("WaitSet", "DDS_WaitSet")),
    (r"可靠性|reliability", ("ReliabilityQosPolicy", "DDS_ReliabilityQosPolicy")),
    (r"持久性|耐久性|durability", ("DurabilityQosPolicy", "DDS_DurabilityQosPolicy")),
    (r"历史深度|history\s*depth", ("HistoryQosPolicy", "DDS_HistoryQosPolicy")),
    (r"截止时间|deadline", ("DeadlineQosPolicy", "DDS_DeadlineQosPolicy")),
    (r"存活性|活跃性|liveliness", ("LivelinessQosPolicy", "DDS_LivelinessQosPolicy")),
)
#: Patterns of tasks, and the function for each.
FUNCTIONS = (
    (r"创建(?:域)?参与者|create\s+(?:domain\s*)?participant", "DDS_DomainParticipantFactory_create_participant"),
    (r"创建发布者|create\s+publisher", "DDS_DomainParticipant_create_publisher"),
    (r"创建订阅者|create\s+subscriber", "DDS_DomainParticipant_create_subscriber"),
    (r"创建(?:数据)?写(?:入)?者|创建\s*DW|create\s+(?:data\s*)?writer", "DDS_Publisher_create_datawriter"),
    (r"创建(?:数据)?读(?:取)?者|创建\s*DR|create\s+(?:data\s*)?reader", "DDS_Subscriber_create_datareader"),
    (r"创建主题|create\s+topic", "DDS_DomainParticipant_create_topic"),
    (r"发送数据|写入数据|发布样本|write\s+(?:data|sample)", "DDS_DataWriter_write"),
    (r"读取数据|读取样本|read\s+(?:data|sample)", "DDS_DataReader_read"),
    (r"取走数据|取走样本|take\s+(?:data|sample)", "DDS_DataReader_take"),
    (r"等待条件|等待触发|wait\s+(?:for\s+)?condition", "DDS_WaitSet_wait"),
)
#: The keywords of each intent, in the order that decides ties, and what an intent adds to a vague query.
INTENTS = (
    ("troubleshooting", ("错误", "错误码", "失败", "异常", "崩溃", "超时", "无法", "不能", "排查", "error", "failed", "failure", "exception", "crash", "timeout", "troubleshoot"), "错误码 原因 排查步骤 日志 修复方法"),
    ("qos", ("qos", "可靠性", "持久性", "耐久性", "历史深度", "截止时间", "存活性", "reliability", "durability", "history", "deadline", "liveliness"), "DDS QoS policy 配置 兼容性 默认值 生效范围"),
    ("performance_tuning", ("性能", "调优", "延迟", "吞吐", "抖动", "占用率", "performance", "tuning", "latency", "throughput", "jitter", "benchmark"), "DDS 性能调优 延迟 吞吐 资源占用 参数建议"),
    ("installation", ("安装", "部署", "依赖", "系统要求", "环境准备", "install", "setup", "deploy", "prerequisite"), "安装步骤 系统要求 依赖 环境准备 验证"),
    ("configuration", ("配置", "配置文件", "环境变量", "许可证", "license", "configure", "configuration", "setting"), "配置项 配置文件 环境变量 许可证 初始化"),
    ("api_usage", ("接口", "函数", "方法", "参数", "返回值", "调用", "示例", "api", "function", "parameter", "return", "example"), "DDS 接口 使用方法 参数 返回值 调用示例"),
)
GENERAL_EXPANSION = "DDS 概念 接口 配置 示例"
#: Vague wording, identifiers, error codes, and how names end by kind.
VAGUE = (
    r"怎么用|如何用|有问题|有故障|不工作|用不了|不能用|怎么配|怎么设置|报错了|失败了|很慢|性能差"
    r"|how\s+to\s+use|not\s+working|doesn['’]?t\s+work"
)
IDENTIFIER = r"\bDDS_[A-Za-z0-9_]+\b"
ERROR = r"\b(?:DDS_RETCODE_[A-Z0-9_]+|[A-Z][A-Z0-9_]*(?:ERROR|ERR|FAILED|TIMEOUT)[A-Z0-9_]*)\b"
ENUM = r"(?:_KIND|_STATUS|_MASK|_QOS_POLICY_ID)$"
STRUCTURE = r"(?:Qos|Listener|Status|Seq|TypeSupport)$"
#: What a vague query about one of these asks for, if it names no task.
FOCUS = (
    ("DataWriter", "DDS_Publisher_create_datawriter DDS_DataWriter_write"),
    ("DataReader", "DDS_Subscriber_create_datareader DDS_DataReader_read DDS_DataReader_take"),
    ("DomainParticipant", "DDS_DomainParticipantFactory_create_participant"),
)


@dataclass(frozen=True)
class Vocabulary:
    """The tables of a domain; ``product`` names it where a query has no entity, and before what an intent adds."""

    abbreviations: dict | None = None
    aliases: tuple = ALIASES
    functions: tuple = FUNCTIONS
    intents: tuple = INTENTS
    product: str = "DDS"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which has no function in SQL."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def one_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def append_unique(text: Column, tokens: Column) -> Column:
    """``text`` with those ``tokens`` after it that it, with what is appended so far, does not contain in any case."""
    return F.aggregate(tokens, text, lambda s, x: F.when(F.contains(F.lower(s), F.lower(x)), s).otherwise(F.concat(s, F.lit(" "), x)))


def _entity(kind, surface: Column, canonical: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), surface.alias("surface"), canonical.alias("canonical"))


def entities(text: Column, v: Vocabulary) -> Column:
    """The entities of a text, the first of equal kind and name: abbreviations, terms, tasks' functions, explicit names."""
    found = []
    for short, names in (v.abbreviations or ABBREVIATIONS).items():
        pattern = rf"(?i)(?<![A-Za-z0-9_]){short}(?![A-Za-z0-9_])"
        found.append(F.when(text.rlike(pattern), _entity("abbreviation", F.regexp_extract(text, pattern, 0), F.lit(names[0]))))
    for pattern, names in v.aliases:
        found.append(F.when(text.rlike(f"(?i){pattern}"), _entity("term", F.regexp_extract(text, f"(?i){pattern}", 0), F.lit(names[0]))))
    for pattern, name in v.functions:
        found.append(F.when(text.rlike(f"(?i){pattern}"), _entity("api", text, F.lit(name))))

    def typed(name: Column) -> Column:
        kind = F.when(name.rlike(f"^(?:{ERROR})$"), "error_code").when(name.rlike(ENUM), "enum").when(name.rlike(STRUCTURE), "struct").otherwise("api")
        return _entity(kind, name, name)

    explicit = F.transform(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)), typed)
    errors = F.transform(F.regexp_extract_all(text, F.lit(ERROR), F.lit(0)), lambda x: _entity("error_code", x, x))
    every = F.concat(F.filter(F.array(*found), lambda e: e.isNotNull()), explicit, errors)
    name = lambda e: F.concat_ws(":", e["kind"], F.lower(e["canonical"]))
    return F.filter(every, lambda e, i: F.array_position(F.transform(every, name), name(e)) == i + 1)


def analyzed(queries: DataFrame, vocabulary: Vocabulary | None = None, text_col: str = "query") -> DataFrame:
    """``queries`` with ``original``, ``entities``, ``normalized``, ``intent``, ``ambiguous`` and ``subqueries``.

    A null or blank query has null in all of them.
    """
    v = vocabulary or Vocabulary()
    q = queries.withColumn("original", F.nullif(one_spaced(nfkc(F.col(text_col))), F.lit("")))
    o = F.col("original")
    q = q.withColumn("entities", entities(o, v))
    added = [F.when(o.rlike(rf"(?i)(?<![A-Za-z0-9_]){short}(?![A-Za-z0-9_])"), F.array(*map(F.lit, names))) for short, names in (v.abbreviations or ABBREVIATIONS).items()]
    added += [F.when(o.rlike(f"(?i){p}"), F.array(*map(F.lit, names))) for p, names in v.aliases]
    tasks = [F.when(o.rlike(f"(?i){p}"), F.array(F.lit(name))) for p, name in v.functions]
    tokens = lambda parts: F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull()))
    q = q.withColumns({"normalized": append_unique(o, tokens(added + tasks)), "tasks": F.array_distinct(tokens(tasks))})
    has = lambda *kinds: F.exists("entities", lambda e: e["kind"].isin(*kinds))
    scores = []
    for i, (name, words, _) in enumerate(v.intents):
        score = sum(F.contains(F.lower(o), F.lit(w)).cast("int") for w in words)
        score += F.when(has("error_code"), 3).otherwise(0) if name == "troubleshooting" else F.when(has("api", "struct", "enum"), 1).otherwise(0) if name == "api_usage" else 0
        scores.append(F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("intent")))
    best = F.array_max(F.array(*scores))
    exact = F.exists("entities", lambda e: e["kind"].isin("api", "error_code") & (e["surface"] == e["canonical"]))
    q = q.withColumns({"intent": F.when(o.isNotNull(), F.when(best["score"] > 0, best["intent"]).otherwise("general")), "ambiguous": o.rlike(f"(?i){VAGUE}") & ~exact})
    names = F.array_join(F.array_distinct(F.transform("entities", lambda e: e["canonical"])), " ")
    names = F.when(names != "", names).otherwise(v.product)
    own = ("troubleshooting", "installation", "configuration")
    expansion = F.lit(GENERAL_EXPANSION)
    for name, _, more in v.intents:
        expansion = F.when(F.col("intent") == name, f"{v.product} {more}" if name in own else more).otherwise(expansion)
    focus = F.when(F.size("tasks") > 0, F.array_join("tasks", " "))
    for part, asks in FOCUS:
        focus = focus.when(F.exists("entities", lambda e: F.contains(e["canonical"], F.lit(part))), asks)  # noqa: B023
    focus = focus.otherwise(F.concat(names, F.lit(" DDS 接口 结构体 枚举 错误码")))
    several = F.array_distinct(F.array(F.col("normalized"), one_spaced(F.concat_ws(" ", names, expansion)), one_spaced(focus)))
    return q.withColumn("subqueries", F.when(F.col("ambiguous"), several).when(o.isNotNull(), F.array("normalized"))).drop("tasks")


def wire_search_terms(text: Column) -> Column:
    """Lower-cased and one-spaced: how attempted queries are compared."""
    return F.lower(one_spaced(text))


def rewritten_terms(text: Column) -> Column:
    """The distinct lower-cased ASCII names of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9_.-]+"), F.lit(0)), F.lower))
