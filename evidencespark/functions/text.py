"""Text functions of the engine as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A term: a run of ASCII letters, digits and underscores or Western European letters, or one CJK character.
TERM = "[a-z0-9_à-öø-ÿœß]+|[一-鿿]"
#: What a table-of-contents line and a dot leader look like.
DOT_LEADER = r"([.．·・…]{4,}|\.{6,})\s*\|?\s*([ivxlcdm]{1,6}|\d{1,4})\s*\|?\s*$"
LONG_LINE = 40


def terms(text: Column) -> Column:
    """The lower-cased terms of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def words(text: Column) -> Column:
    """The distinct lower-cased words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[ \t\n\r\f\x0B]+"), lambda w: w != ""))


def lines(text: Column) -> Column:
    """The lines of a text that are not blank."""
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, rounded up."""
    return F.floor((F.length(text) + 3) / 4).cast("long")


def message_estimate(text: Column) -> Column:
    """Tokens of a chat message: one unit for an ASCII character, two for any other, four units a token; 1 at least."""
    units = F.length(text) + F.length(F.regexp_replace(text, "[\\x00-\\x7F]", ""))
    return F.greatest(F.floor((units + 3) / 4), F.lit(1)).cast("long")


def is_navigation_index(text: Column) -> Column:
    """True if every line is a dot leader with a page number or short, and one is a dot leader at least."""
    rows = F.transform(lines(text), lambda x: F.trim(x))
    leader = lambda x: x.rlike(DOT_LEADER)
    return F.exists(rows, leader) & F.forall(rows, lambda x: leader(x) | (F.length(x) <= LONG_LINE))


def record_id(document: Column, version: Column, chunk: Column) -> Column:
    return F.concat_ws(":", document.cast("string"), version.cast("string"), chunk.cast("string"))


def digest_vector(text: Column, dims: int = 8) -> Column:
    """A stand-in for an embedding: the bytes of the SHA-256 digest on [-1, 1], scaled to length 1."""
    byte = lambda h, i: F.conv(F.substring(h, 2 * (i % 32) + 1, 2), 16, 10).cast("double")
    raw = lambda h: F.array(*[(byte(h, i) - 127.5) / 127.5 for i in range(dims)])
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return _with(F.sha2(text, 256), lambda h: _with(raw(h), lambda v: _with(norm(v), lambda n: F.transform(v, lambda x: x / n))))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, for which ``value`` is evaluated once, however often it stands in it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def valid_vector(vector: Column, dims: int) -> Column:
    """True for a vector of ``dims`` finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & good, F.lit(False))


#: The labels that stand before an indexed text, by kind of source.
LABELS = {"chm": ("Topic", "Heading", "Symbol"), "chi": ("Index keyword", "Topic", "Topic path", "Topic URL", "Associated CHM")}


def with_labels(labels: dict[str, Column], body: Column) -> Column:
    """``Label: value`` lines of the values that are not blank, an empty line, and the body; without any, the body."""
    lines = [F.when(F.trim(v) != "", F.concat(F.lit(f"{k}: "), F.trim(v))) for k, v in labels.items()]
    prefix = F.concat_ws("\n", *lines)
    return F.when(prefix == "", body).otherwise(F.concat(prefix, F.lit("\n\n"), body))


def without_labels(text: Column, kind: Column) -> Column:
    """The body of a labelled text; the whole text if some line before its first empty line has no label of its kind."""
    at = F.instr(text, "\n\n")
    lines = F.split(F.substring(text, F.lit(1), at - 1), "\n")
    known = F.lit(False)
    for name, labels in LABELS.items():
        starts = lambda x: F.exists(F.array(*[F.lit(f"{k}: ") for k in labels]), lambda k: F.startswith(x, k))  # noqa: B023, E731
        known = F.when(kind == name, F.forall(lines, starts)).otherwise(known)
    return F.when((at > 0) & known, F.substring(text, at + 2, F.length(text))).otherwise(text)


def renumbered(answer: Column, most: Column) -> tuple[Column, Column]:
    """``valid`` (every ``[n]`` of an answer names one of ``most`` pieces of evidence) and ``sources``, these in the order in
    which they first appear, whose places are their new numbers; null if not valid."""
    cited = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("long"))
    valid = F.forall(cited, lambda n: (n >= 1) & (n <= most))
    return valid.alias("valid"), F.when(valid, F.array_distinct(cited)).alias("sources")
