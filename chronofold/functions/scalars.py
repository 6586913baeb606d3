"""Scalar functions as Spark columns; none of them leaves the JVM."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The score weights, limits and text sizes that results must agree on.
LEXICAL_WEIGHT = 0.45
VECTOR_WEIGHT = 0.55
GRAPH_WEIGHT = 0.1
LEXICAL_FLOOR = 0.25
DIMENSIONS = 64


def sha_parts(*parts: Column | str) -> Column:
    """Hex SHA-256 over the parts, each followed by a NUL; null counts as empty."""
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    pieces = [x for p in parts for x in (F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")), nul)]
    return F.sha2(F.concat(*pieces), 256)


def make_id(prefix: str, *parts: Column | str, digits: int = 32) -> Column:
    """A deterministic id: prefix, underscore, the first digits of the hash."""
    return F.concat(F.lit(prefix + "_"), F.substring(sha_parts(*parts), 1, digits))


def canonical_json(text: Column | str) -> Column:
    """JSON with sorted keys and no blanks; null if the text is not JSON."""
    return F.to_json(F.try_parse_json(text))


def tokens(text: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9 longer than one character."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 1)


def lexical_score(query: Column, text_tokens: Column) -> Column:
    """Share of the query's distinct tokens that occur, at least LEXICAL_FLOOR if any does."""
    hits, size = F.size(F.array_intersect(query, text_tokens)), F.size(F.array_distinct(query))
    return F.when(hits > 0, F.greatest(hits / size, F.lit(LEXICAL_FLOOR))).otherwise(0.0)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hashed_tokens(text_tokens: Column, dims: int = DIMENSIONS) -> Column:
    """(slot, w) of each distinct token: slot is the first two bytes of the token's
    SHA-256 modulo dims, w is 1 + ln(tf), negative if the third byte is odd."""
    number = lambda h, at, n: F.conv(F.substring(h, at, n), 16, 10).cast("int")

    def entry(h: Column, tf: Column) -> Column:
        return F.struct((number(h, 1, 4) % dims).alias("slot"), (F.when(number(h, 5, 2) % 2 == 0, 1.0).otherwise(-1.0) * (1 + F.log(tf.cast("double")))).alias("w"))

    return let(text_tokens, lambda ts: F.transform(F.array_distinct(ts), lambda t: let(F.sha2(t, 256), lambda h: entry(h, F.size(F.filter(ts, lambda u: u == t))))))


def feature_hash(text_tokens: Column, dims: int = DIMENSIONS) -> Column:
    """Signed feature hashing into dims slots, L2-normalised; see hashed_tokens."""

    def dense(e: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda s: F.aggregate(F.filter(e, lambda x: x["slot"] == s), F.lit(0.0), lambda a, x: a + x["w"]))

    return let(let(hashed_tokens(text_tokens, dims), dense), normalised)


def hash_vector(words: list[str], dims: int = DIMENSIONS) -> list[float]:
    """feature_hash of a query, on the driver."""
    out = [0.0] * dims
    for w in dict.fromkeys(words):
        h = hashlib.sha256(w.encode()).digest()
        out[int.from_bytes(h[:2], "big") % dims] += (1 if h[2] % 2 == 0 else -1) * (1 + math.log(words.count(w)))
    n = math.sqrt(sum(x * x for x in out))
    return [x / n for x in out] if n else out


def hash_cosine(text_tokens: Column, query: list[float]) -> Column:
    """Cosine of feature_hash(text_tokens) to a unit query vector, over the text's
    own tokens only: no dense vector is made."""
    q = F.array(*(F.lit(float(x)) for x in query))

    def score(e: Column) -> Column:
        along = F.aggregate(e, F.lit(0.0), lambda a, x: a + x["w"] * F.get(q, x["slot"]))
        square = F.aggregate(e, F.lit(0.0), lambda a, x: a + x["w"] * F.aggregate(F.filter(e, lambda y: y["slot"] == x["slot"]), F.lit(0.0), lambda b, y: b + y["w"]))
        return let(square, lambda n: F.when(n > 0, along / F.sqrt(n)).otherwise(0.0))

    return let(hashed_tokens(text_tokens, len(query)), score)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def normalised(a: Column) -> Column:
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0 or the lengths differ."""
    return let(norm(a) * norm(b), lambda n: F.when((n > 0) & (F.size(a) == F.size(b)), dot(a, b) / n).otherwise(0.0))


def round6(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5) / 1e6


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def iso_utc(text: Column | str) -> Column:
    """ISO-8601 text with any offset as UTC with milliseconds; null if it is none."""
    return F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_money(text: Column | str) -> Column:
    """Whether the text is a plain decimal of up to 16 digits and 4 decimals."""
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike(r"^(0|[1-9][0-9]{0,15})(\.[0-9]{1,4})?$")


def url_origin(url: Column | str) -> Column:
    """Lower-case scheme and host with port; null if the url has none."""
    return F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))))


def truncated(text: Column | str, limit: int) -> Column:
    """The text, or, beyond limit characters, JSON of its length and a preview."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(text) <= limit, text).otherwise(F.to_json(F.struct(F.lit(True).alias("truncated"), F.length(text).alias("characters"), F.substring(text, 1, limit).alias("preview"))))


def retry_seconds(attempts: Column | str) -> Column:
    """30 s doubled per attempt, at most six times and never over an hour."""
    return F.least(F.lit(3600), (30 * F.pow(F.lit(2), F.least(F.col(attempts) if isinstance(attempts, str) else attempts, F.lit(6)))).cast("int"))


def typed_text(object_json: Column | str) -> Column:
    """The value of a typed value as text, with its unit."""
    get = lambda k: F.get_json_object(object_json, f"$.{k}")
    return F.concat_ws(" ", F.coalesce(get("value"), get("entityId")), get("unit"))
