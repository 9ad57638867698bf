"""Ids and digests of requests, and comparisons that ignore case, as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The namespace of addresses for named ids, what stands before a corpus' key, and where uploads wait.
URL_NAMESPACE, CORPUS_NAME, STAGING = "6ba7b8119dad11d180b400c04fd430c8", "rag-dataset:", "staging/"


def named_id(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The id of version 5 for a name: SHA-1 of the namespace and the name, with the bits of version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def corpus_id(key: Column) -> Column:
    """The id of a corpus that a request with this key makes."""
    return named_id(F.concat(F.lit(CORPUS_NAME), key))


def staging_key(key: Column) -> Column:
    """Where an upload waits; null without a key."""
    return F.when(F.coalesce(key, F.lit("")) != "", F.concat(F.lit(STAGING), F.sha2(key, 256)))


def _json_text(value: Column) -> Column:
    """A string as JSON, other than ASCII letters as they are; null for null."""
    quoted = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(quoted, F.lit(6), F.length(quoted) - 6)


def request_digest(fields: dict[str, Column]) -> Column:
    """The SHA-256 of the fields as one JSON object: keys sorted, no blanks, nulls written."""
    pairs = [F.concat(F.lit(f'"{name}":'), _json_text(fields[name].cast("string"))) for name in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")), 256)


#: About how many bytes of texts are Python strings at once while they are folded.
FOLDED_BYTES = 1 << 20


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in runs of about ``FOLDED_BYTES`` bytes, one text at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + FOLDED_BYTES, side="right")))
        yield texts.slice(a, b - a)
        a = b


def _folded(texts: pa.Array) -> pa.Array:
    parts = [pa.array([None if x is None else x.casefold() for x in piece.to_pylist()], pa.string()) for piece in _pieces(texts)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def casefolded(text: pa.Array) -> pa.Array:
    """Text for comparison without case, as Unicode folds it (ß and ss are the same); SQL only has lower case."""
    return _folded(text)


#: What users are told of failures.
FAILURES = {
    "EMBEDDING_AUTH_FAILED": "Embedding 模型鉴权失败：请在设置中更新 API Key 后重试",
    "EMBEDDING_UNAVAILABLE": "Embedding 服务不可用，请检查模型地址与网络",
    "EMBEDDING_QUOTA_EXCEEDED": "Embedding 模型额度不足或已达限流上限：请检查模型服务的配额与计费，或稍后重试",
    "EMBEDDING_DIMENSION_MISMATCH": "Embedding 维度与该知识库不一致，请使用相同维度的模型",
    "EMPTY_DOCUMENT": "文档没有可索引的文本内容",
    "UPLOAD_TOO_LARGE": "文件超过服务端大小上限",
    "PDF_OCR_UNAVAILABLE": "扫描件需要 OCR，但服务端未启用 OCR",
    "INVALID_PDF": "文件不是可解析的 PDF",
}


def failure_message(code: Column, message: Column) -> Column:
    """What users are told of a failure: the text for its code, else its own message; empty without a failure."""
    known = F.create_map(*[F.lit(x) for pair in FAILURES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), F.when(code.isNotNull(), message), F.lit(""))
