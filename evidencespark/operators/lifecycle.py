"""Versions, fences, queues and telemetry as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidencespark.sources.shared import stored


def active_versions(builds: DataFrame) -> DataFrame:
    """``(document_id, active_version)``: the largest finished version; late lower ones never replace it."""
    return builds.where("finished").groupBy("document_id").agg(F.max("version").alias("active_version"))


def visible(candidates: DataFrame, active: DataFrame) -> DataFrame:
    """Candidates of the active version of their document."""
    keys = active.select("document_id", F.col("active_version").alias("version"))
    return candidates.join(keys, ["document_id", "version"], "left_semi")


def accepted_deliveries(deliveries: DataFrame) -> DataFrame:
    """Deliveries whose sequence is above all earlier ones of their task, in order of arrival."""
    before = W.partitionBy("task_id").orderBy("arrived_at", "delivery_id").rowsBetween(W.unboundedPreceding, -1)
    seen = F.max("sequence").over(before)
    return deliveries.withColumn("seen", seen).where(F.col("seen").isNull() | (F.col("sequence") > F.col("seen"))).drop("seen")


def first_by_key(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key: reuse of a fingerprint, replay of an idempotency key."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def illegal_transitions(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """``(from_state, to_state, times)`` of changes that ``transitions(from_state, to_state)`` does not list."""
    before = F.lag("state").over(W.partitionBy("entity").orderBy("at", "seq"))
    steps = states.withColumn("from_state", before).where("from_state IS NOT NULL AND from_state <> state")
    steps = steps.groupBy("from_state", F.col("state").alias("to_state")).agg(F.count(F.lit(1)).alias("times"))
    return steps.join(F.broadcast(transitions), ["from_state", "to_state"], "left_anti")  # a fixed table of states


def unreferenced(objects: DataFrame, references: DataFrame, cutoff: Column) -> DataFrame:
    """Objects older than ``cutoff`` whose key nothing refers to."""
    return objects.where(F.col("modified_at") <= cutoff).join(references.select("key"), "key", "left_anti")


def upserted(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``current`` with its rows replaced by, and extended by, the last change of each key (by ``seq``)."""
    last = first_by_key(changes, [key], F.desc("seq")).drop("seq")
    return current.join(last.select(key), key, "left_anti").unionByName(last)


def _binned(rows: DataFrame, seconds: int, at: Column) -> DataFrame:
    """``rows`` with ``_at`` (microseconds), each in its bin of ``seconds`` and once more, as a ``_halo``, in the next one.

    What happened in the ``seconds`` before a row lies in its bin, so windows go by bin, and no key is one task.
    """
    width = seconds * 1_000_000
    rows = rows.withColumn("_at", at)
    own = F.floor(F.col("_at") / width).cast("long")
    places = F.array(F.struct(own.alias("bin"), F.lit(False).alias("halo")), F.struct((own + 1).alias("bin"), F.lit(True).alias("halo")))
    return rows.withColumn("_place", F.explode(places)).withColumns({"_bin": F.col("_place.bin"), "_halo": F.col("_place.halo")}).drop("_place")


def trailing_rate(events: DataFrame, seconds: int, *by: str) -> DataFrame:
    """Events a second over the ``seconds`` before and at each event, by key; what is ``seconds`` old is out."""
    over = W.partitionBy(*by, "_bin").orderBy("_at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    rows = _binned(events, seconds, F.unix_micros(F.col("ts").cast("timestamp")))
    counted = rows.withColumn("rate", F.round(F.count(F.lit(1)).over(over) / seconds, 9))
    return counted.where(~F.col("_halo")).drop("_at", "_bin", "_halo")


def sampled_rate(events: DataFrame, seconds: int, step: int, *by: str) -> DataFrame:
    """``(by, sampled, rate)``: events a second over the ``seconds`` before each multiple of ``step`` seconds, for the samples that
    see an event; an event of the sample's moment counts, one ``seconds`` older does not. ``step`` divides ``seconds``.

    Counts of steps are added up, so a hot key is summed in each task before anything is shuffled.
    """
    if seconds % step:
        raise ValueError("the step must divide the window")
    up = F.ceil(F.unix_micros(F.col("ts").cast("timestamp")) / (step * 1_000_000)).cast("long")
    counts = events.groupBy(*by, up.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    seen = counts.withColumn("sampled", F.explode(F.transform(F.sequence("slot", F.col("slot") + seconds // step - 1), lambda i: i * step)))
    return seen.groupBy(*by, "sampled").agg(F.round(F.sum("n") / seconds, 9).alias("rate"))


#: Windows of panels in seconds, how many steps one has, the seconds of a rate, and what a panel shows at most.
WINDOWS = {"15m": 900, "1h": 3600, "6h": 21_600, "24h": 86_400}
STEPS, RATE_SECONDS, MOST_SERIES, MOST_POINTS = 60, 300, 8, 100


def panel(events: DataFrame, end: int, window: str, by: str, allowed: list[str] | None = None) -> DataFrame:
    """``(name, sampled, value)``: the five-minute rate of each ``by`` at the steps of a window that ends at ``end`` (seconds).

    A step is a sixtieth of the window, rounded up. Names that are not ``allowed`` are left out (null: all but null ones
    are), of the others the first eight; steps before a series' first or after its last value have no point.
    """
    seconds = WINDOWS[window]
    step = -(-seconds // STEPS)
    begin = end - seconds
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - begin
    first = F.greatest(F.ceil(at / step), F.lit(0)).cast("long")
    last = F.least(F.ceil((at + RATE_SECONDS) / step) - 1, F.lit(seconds // step)).cast("long")
    rows = events.where(F.col(by).isNotNull() if allowed is None else F.col(by).isin(*allowed))
    rows = rows.select(F.col(by).alias("name"), first.alias("first"), last.alias("last")).where(F.col("first") <= F.col("last"))
    counts = rows.groupBy("name", "first", "last").agg(F.count(F.lit(1)).alias("n"))
    points = counts.withColumn("nth", F.explode(F.sequence("first", "last"))).groupBy("name", "nth").agg(F.round(F.sum("n") / RATE_SECONDS, 9).alias("value"))
    names = points.select("name").distinct().orderBy("name").limit(MOST_SERIES)
    shown = points.join(F.broadcast(names), "name")  # eight names
    kept = F.row_number().over(W.partitionBy("name").orderBy("nth"))
    return shown.withColumn("_kept", kept).where(F.col("_kept") <= MOST_POINTS).select("name", (F.col("nth") * step + begin).alias("sampled"), "value")


def login_waits(attempts: DataFrame, key: str, limit: int, seconds: int = 300, block: int = 900) -> DataFrame:
    """``attempts`` with ``recent``, the failures of ``key`` that count against each, and ``wait``, for how many seconds it is
    refused (0: it is not).

    ``attempts`` have (``key``, attempt_id, at in microseconds, success). A failure counts for ``seconds``, that moment
    included, unless a success of its key came after it; the attempt itself and later ones of the same moment (by
    attempt_id) do not. With ``limit`` failures an attempt is refused until ``block`` seconds after the oldest of them.
    """
    rows = _binned(attempts, seconds, F.col("at"))
    in_order = W.partitionBy(key, "_bin").orderBy("_at", "attempt_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_epoch", F.coalesce(F.sum(F.col("success").cast("int")).over(in_order), F.lit(0)))
    epoch = W.partitionBy(key, "_bin", "_epoch")
    failed = F.when(~F.col("success"), F.col("_at"))
    before = F.count(failed).over(epoch.orderBy("_at", "attempt_id").rowsBetween(W.unboundedPreceding, -1))
    gone = F.count(failed).over(epoch.orderBy("_at").rangeBetween(W.unboundedPreceding, -seconds * 1_000_000 - 1))
    oldest = F.min(failed).over(epoch.orderBy("_at").rangeBetween(-seconds * 1_000_000, 0))
    rows = rows.withColumns({"_before": before, "_gone": gone, "_oldest": oldest}).where(~F.col("_halo"))
    recent = (F.col("_before") - F.col("_gone")).cast("long")
    left = (F.col("_oldest") + block * 1_000_000 - F.col("_at")) / 1e6
    wait = F.when(recent >= limit, F.greatest(left, F.lit(0.0))).otherwise(0.0)
    return rows.withColumns({"recent": recent, "wait": F.round(wait, 6)}).drop("_at", "_bin", "_halo", "_epoch", "_before", "_gone", "_oldest")


def recent_history(messages: DataFrame, most: int = 12) -> DataFrame:
    """The last ``most`` messages of each conversation before its last one."""
    newest = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("_back", newest).where((F.col("_back") > 1) & (F.col("_back") <= most + 1)).drop("_back")


#: The context of a model call in tokens, and what is set aside in it.
CONTEXT_TOKENS, RESERVE_TOKENS, SYSTEM_TOKENS, TOOL_TOKENS = 32_768, 4096, 512, 512


def trimmed_context(messages: DataFrame, budget: int = CONTEXT_TOKENS, aside: int = RESERVE_TOKENS + SYSTEM_TOKENS + TOOL_TOKENS) -> DataFrame:
    """The messages ``(conv_id, turn, role, calls_tools, tokens)`` that stay in a context of ``budget`` tokens.

    The first message and all from the latest user message on stay in any case. Of those between, the newest groups
    stay as long as all fit beside the ``aside`` tokens; an assistant's tool call and the tool results after it are one
    group. If no message but the first comes from a user, only the first stays.
    """
    own = W.partitionBy("conv_id")
    by_turn = own.orderBy("turn")
    m = messages.withColumn("nth", F.row_number().over(by_turn))
    m = m.withColumn("latest", F.max(F.when((F.col("role") == "user") & (F.col("nth") > 1), F.col("nth"))).over(own))
    # A group begins at each message that is no tool result after a tool call (or after another such result).
    head = F.last(F.when(F.col("role") != "tool", F.coalesce("calls_tools", F.lit(False))), ignorenulls=True).over(by_turn)
    joins = (F.col("role") == "tool") & F.coalesce(head, F.lit(False)) & (F.col("nth") > 2)
    m = m.withColumn("group", F.sum(F.when(joins, 0).otherwise(1)).over(by_turn))
    fixed = (F.col("nth") == 1) | (F.col("nth") >= F.col("latest"))
    m = m.withColumn("fixed", F.coalesce(fixed, F.lit(False)))
    m = m.withColumns({"needed": F.sum(F.when(F.col("fixed"), F.col("tokens")).otherwise(0)).over(own), "all": F.sum("tokens").over(own), "count": F.count(F.lit(1)).over(own)})
    groups = W.partitionBy("conv_id").orderBy(F.desc("group")).rangeBetween(W.unboundedPreceding, W.currentRow)
    used = F.col("needed") + F.sum(F.when(~F.col("fixed"), F.col("tokens")).otherwise(0)).over(groups)
    m = m.withColumn("used", used)
    room = budget - aside
    stays = (F.col("all") <= room) | (F.col("count") <= 2) | F.col("fixed") | (F.col("latest").isNotNull() & (F.col("used") <= room))
    return m.where(stays).drop("nth", "latest", "group", "fixed", "needed", "all", "count")


#: What stands in place of a tool's result that was left out, and its tokens.
BLANK = '{"note":"older tool evidence omitted to fit model context"}'
BLANK_TOKENS = (len(BLANK) + 3) // 4


def blanked_tools(trimmed: DataFrame, budget: int = CONTEXT_TOKENS, aside: int = RESERVE_TOKENS + SYSTEM_TOKENS + TOOL_TOKENS) -> DataFrame:
    """The messages that :func:`trimmed_context` leaves, with ``blanked``, and ``tokens`` after it.

    If what stays is still too much, results of tools are replaced by a note, the oldest first, until the rest fits;
    calls and results stay pairs. Conversations of two messages or fewer are left as they are.
    """
    own = W.partitionBy("conv_id")
    tool = (F.col("role") == "tool") & (F.row_number().over(own.orderBy("turn")) > 1)
    saved = F.sum(F.when(F.col("_tool"), F.col("tokens") - BLANK_TOKENS).otherwise(0)).over(own.orderBy("turn").rowsBetween(W.unboundedPreceding, -1))
    m = trimmed.withColumn("_tool", tool).withColumns({"_over": F.sum("tokens").over(own) - (budget - aside), "_n": F.count(F.lit(1)).over(own), "_saved": F.coalesce(saved, F.lit(0))})
    blanked = F.col("_tool") & (F.col("_n") > 2) & (F.col("_over") - F.col("_saved") > 0)
    m = m.withColumn("blanked", blanked).withColumn("tokens", F.when(F.col("blanked"), BLANK_TOKENS).otherwise(F.col("tokens")).cast("long"))
    return m.drop("_tool", "_over", "_n", "_saved")


#: Most parts of a range partition that are broadcast.
PARTS = 100_000


def percentiles(rows: DataFrame, label: str, wanted: dict[str, float]) -> DataFrame:
    """Exact percentiles of ``value`` by ``label``, interpolated; null without values.

    Distinct values are counted and partitioned by range, so a hot label lies in many parts. The counts of whole parts
    show which parts hold the ranks asked for, and only in these single values are counted on.
    """
    counts = rows.groupBy(label, "value").agg(F.count("value").alias("n")).repartitionByRange(label, "value").sortWithinPartitions(label, "value")
    counts = stored(counts.withColumn("_part", F.spark_partition_id()), "value-counts")
    parts = counts.groupBy(label, "_part").agg(F.sum("n").alias("rows"))
    by_part = W.partitionBy(label).orderBy("_part")
    parts = parts.withColumns({"begin": F.sum("rows").over(by_part) - F.col("rows"), "total": F.sum("rows").over(W.partitionBy(label))})
    place = lambda q: (F.col("total") - 1) * F.lit(q)
    edges = [edge(place(q)) for q in wanted.values() for edge in (F.floor, F.ceil)]
    held = sum((F.col("begin") <= e).cast("int") * (e < F.col("begin") + F.col("rows")).cast("int") for e in edges) > 0
    parts = parts.withColumn("held", held).select(F.col(label).alias("_label"), F.col("_part").alias("_of"), "begin", "total", "held")
    parts = stored(parts, "value-parts")
    few = parts.limit(PARTS + 1).count() <= PARTS
    needed = parts.where("held").drop("held")
    near = counts.join(F.broadcast(needed) if few else needed, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_part") == F.col("_of")))
    upto = F.col("begin") + F.sum("n").over(W.partitionBy(label, "_part").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow))
    near = near.withColumn("upto", upto)

    def at(where):
        return F.max(F.when((where < F.col("upto")) & (where >= F.col("upto") - F.col("n")), F.col("value")))

    def one(q):
        low, high = F.floor(place(q)), F.ceil(place(q))
        share = F.max(place(q) - low)
        return F.round(F.when(share == 0, at(low)).otherwise((1 - share) * at(low) + share * at(high)), 6)

    found = near.groupBy(F.col("_label").alias("_of")).agg(*[one(q).alias(name) for name, q in wanted.items()])
    labels = parts.groupBy("_label").agg(F.count(F.lit(1)).alias("_n"))
    return labels.join(found, F.col("_label").eqNullSafe(F.col("_of")), "left").select(F.col("_label").alias(label), *wanted)
