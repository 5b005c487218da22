"""The text an audit event is hashed over: one JSON object, keys sorted, a space after ``,`` and ``:``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the hashed fields
HASHED_FIELDS = (
    "event_id", "timestamp", "event_type", "actor", "entity_type", "entity_id", "action", "previous_hash",
)
# fixed values: JSON short escapes; other control characters become \\u00xx with lower-case digits
_SHORT = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_string(value: Column) -> Column:
    """``value`` as a JSON string with non-ASCII kept, or ``null``."""
    basic = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    pairs = [F.lit(x) for c in map(chr, range(32)) for x in (c, _SHORT.get(c, f"\\u{ord(c):04x}"))]
    letters = F.transform(F.sequence(F.lit(1), F.length(basic)), lambda i: F.substring(basic, i, F.lit(1)))
    escaped = F.array_join(F.transform(letters, lambda c: F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)), "")
    # only texts with control characters, which are rare, go letter by letter
    body = F.when(value.rlike(r"[\x00-\x1f]"), escaped).otherwise(basic)
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def iso_timestamp(ts: Column) -> Column:
    """UTC ISO text; microseconds only when there are any."""
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(seconds, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def canonical_parts() -> tuple[Column, Column]:
    """The text before and after the value of ``previous_hash``."""
    before = [F.lit("{")]
    names = sorted(HASHED_FIELDS)
    at = names.index("previous_hash")
    for name in names[:at]:
        before += [F.lit(f'"{name}": '), json_string(F.col(name)), F.lit(", ")]
    stamp = F.coalesce(F.concat(F.lit('"'), iso_timestamp(F.col("timestamp")), F.lit('"')), F.lit("null"))
    return F.concat(*before, F.lit('"previous_hash": ')), F.concat(F.lit(', "timestamp": '), stamp, F.lit("}"))


def canonical_json() -> Column:
    before, after = canonical_parts()
    return F.concat(before, json_string(F.col("previous_hash")), after)


def event_hash() -> Column:
    """SHA-256 of the canonical text of an event row, as hex."""
    return F.sha2(canonical_json(), 256)
