"""Decoding of PHP-serialized values stored in string columns.

Scalars (the common case: ``variable.value``) are decoded with built-in
regular-expression functions over the whole column.  Nested values are scanned
once per value, token by token with their declared byte lengths, in
Arrow-batched pandas UDFs: to a VARIANT column (``decode_nested``), back from one
(``encode_nested``), and with texts replaced and lengths corrected
(``replace_serialized``).  These scans are helpers for one column.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressferry.functions.scalars import col

# PHP serialize formats of the scalar kinds.
S_PATTERN = r'(?s)^s:([0-9]+):"(.*)";\z'
I_PATTERN = r"^i:(-?[0-9]+);\z"
D_PATTERN = r"^d:([^;]*);\z"
B_PATTERN = r"^b:([01]);\z"
N_VALUE = "N;"
VERSION_PATTERN = r's:7:"version";s:[0-9]+:"([^"]*)";'


def serialized_kind(value: str | Column) -> Column:
    return F.substring(col(value), 1, 1)


def decode_scalar(value: str | Column) -> Column:
    """Decoded text of a serialized scalar (line breaks included); NULL for N;,
    non-scalars and malformed values (a wrong declared length among them)."""
    v = col(value)
    kind = serialized_kind(v)
    decoded = (F.when(kind == "s", F.regexp_extract(v, S_PATTERN, 2))
               .when(kind == "i", F.regexp_extract(v, I_PATTERN, 1))
               .when(kind == "d", F.regexp_extract(v, D_PATTERN, 1))
               .when(kind == "b", F.regexp_extract(v, B_PATTERN, 1)))
    return F.when(is_valid_scalar(v), decoded)


def is_valid_scalar(value: str | Column) -> Column:
    """Well-formed scalar?  For strings the declared length is in bytes."""
    v = col(value)
    kind = serialized_kind(v)
    s_ok = v.rlike(S_PATTERN) & (
        F.regexp_extract(v, S_PATTERN, 1).try_cast("bigint")
        == F.octet_length(F.regexp_extract(v, S_PATTERN, 2)))
    return (F.when(kind == "s", s_ok)
            .when(kind == "i", v.rlike(I_PATTERN))
            .when(kind == "d", v.rlike(D_PATTERN))
            .when(kind == "b", v.rlike(B_PATTERN))
            .when(kind == "N", v == F.lit(N_VALUE))
            .otherwise(F.lit(False)))


def extract_version(info: str | Column) -> Column:
    """``['version']`` of a serialized module info array, NULL if absent."""
    got = F.regexp_extract(col(info), VERSION_PATTERN, 1)
    return F.when(got == "", F.lit(None).cast("string")).otherwise(got)


# Generic path ---------------------------------------------------------------

def _parse(data: bytes, pos: int):
    kind = data[pos:pos + 1]
    if kind == b"N":
        return None, pos + 2
    if kind in (b"i", b"d", b"b"):
        end = data.index(b";", pos)
        raw = data[pos + 2:end].decode()
        return raw, end + 1
    if kind == b"s":
        colon = data.index(b":", pos + 2)
        n = int(data[pos + 2:colon])
        start = colon + 2
        return data[start:start + n].decode("utf-8", "replace"), start + n + 2
    if kind == b"a":
        colon = data.index(b":", pos + 2)
        n = int(data[pos + 2:colon])
        cur = colon + 2
        out = {}
        for _ in range(n):
            k, cur = _parse(data, cur)
            v, cur = _parse(data, cur)
            out[str(k)] = v
        return out, cur + 1
    raise ValueError(f"unsupported serialized kind {kind!r}")


def unserialize(text: str | None):
    if text is None:
        return None
    value, _ = _parse(text.encode("utf-8"), 0)
    return value


def _flatten(value) -> dict | None:
    if not isinstance(value, dict):
        return None
    return {k: (None if v is None else (str(v) if not isinstance(v, dict) else repr(v)))
            for k, v in value.items()}


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def decode_array(values):
    """Top level of a serialized array as map<string,string> (NULL when the
    value is not an array or cannot be decoded)."""
    import pandas as pd

    def one(text):
        try:
            return _flatten(unserialize(text))
        except (ValueError, IndexError):
            return None

    return pd.Series([one(v) for v in values])


# Nested values ----------------------------------------------------------------

class Malformed(ValueError):
    """Not a serialized value from the first byte to the last."""


def tokens(data: bytes) -> Iterator[tuple[str, bytes]]:
    """The tokens of one serialized value, by a scan that follows the declared
    byte lengths and the depth of the brackets: (kind, content) with kinds N, i,
    d, b, s; 'a' or 'O' with the head of an array or object, and '}'."""
    pos, depth, left = 0, 0, [1]  # values still to come at each depth
    while True:
        if left[-1] == 0:
            if depth == 0:
                break
            if data[pos:pos + 1] != b"}":
                raise Malformed
            yield "}", b""
            pos, depth = pos + 1, depth - 1
            left.pop()
            continue
        left[-1] -= 1
        kind = data[pos:pos + 1]
        if kind == b"N":
            if data[pos:pos + 2] != b"N;":
                raise Malformed
            yield "N", b""
            pos += 2
        elif kind in (b"i", b"d", b"b"):
            end = data.find(b";", pos)
            if data[pos + 1:pos + 2] != b":" or end < 0:
                raise Malformed
            yield kind.decode(), data[pos + 2:end]
            pos = end + 1
        elif kind == b"s":
            colon = data.find(b":", pos + 2)
            size = data[pos + 2:colon]
            if data[pos + 1:pos + 2] != b":" or colon < 0 or not size.isdigit():
                raise Malformed
            start, end = colon + 2, colon + 2 + int(size)
            if data[colon + 1:start] != b'"' or data[end:end + 2] != b'";':
                raise Malformed
            yield "s", data[start:end]
            pos = end + 2
        elif kind in (b"a", b"O"):
            brace = data.find(b"{", pos)
            head = data[pos + 2:brace - 1]
            count = head.rpartition(b":")[2]
            if data[pos + 1:pos + 2] != b":" or brace < 0 or data[brace - 1:brace] != b":" or not count.isdigit():
                raise Malformed
            yield kind.decode(), head
            pos, depth = brace + 1, depth + 1
            left.append(2 * int(count))
        else:
            raise Malformed
    if pos != len(data):
        raise Malformed


def _written(kind: str, content: bytes) -> bytes:
    if kind == "s":
        return b's:%d:"%s";' % (len(content), content)
    if kind in "aO":
        return kind.encode() + b":" + content + b":{"
    return {"N": b"N;", "}": b"}"}.get(kind) or kind.encode() + b":" + content + b";"


def rewrite_texts(data: bytes, change: Callable[[bytes], bytes]) -> bytes:
    """The value with every text (keys too) changed and its length corrected; a
    text that is a serialized array itself is changed inside."""
    out = []
    for kind, content in tokens(data):
        if kind == "s":
            content = changed(content, change)
        out.append(_written(kind, content))
    return b"".join(out)


def changed(text: bytes, change: Callable[[bytes], bytes]) -> bytes:
    """A text with its change: inside, where it is a serialized value."""
    if text[:2] in (b"a:", b"O:", b"s:") and text[-1:] in (b"}", b";"):
        try:
            return rewrite_texts(text, change)
        except (Malformed, RecursionError):
            pass
    return change(text)


def _key(name: str) -> int | str:
    """Keys that look like whole numbers are numbers."""
    return int(name) if name == "0" or name.lstrip("-").isdigit() and name.lstrip("-")[0] != "0" and name != "-" else name


def to_plain(data: bytes):
    """Lists, dicts, texts, numbers, booleans and None of a serialized value.
    An array with the keys 0 to n - 1 in order is a list; of an object the
    properties are taken."""
    holders: list[list] = [[]]
    for kind, content in tokens(data):
        if kind == "}":
            flat = holders.pop()
            keys, values = flat[::2], flat[1::2]
            holders[-1].append(values if keys == list(range(len(keys))) else {str(k): v for k, v in zip(keys, values, strict=True)})
        elif kind in "aO":
            holders.append([])
        else:
            holders[-1].append(None if kind == "N" else int(content) if kind == "i" else float(content) if kind == "d" else content == b"1" if kind == "b"
                               else content.decode())
    return holders[0][0]


def to_serialized(value) -> bytes:
    """The serialized form of a plain value."""
    if value is None or isinstance(value, bool):
        return b"N;" if value is None else b"b:%d;" % value
    if isinstance(value, int):
        return b"i:%d;" % value
    if isinstance(value, float):
        return f"d:{int(value) if value == int(value) and abs(value) < 1e15 else value!r};".replace("e+", "E+").replace("e-", "E-").encode() if value == value and abs(value) != float("inf") \
            else {"nan": b"d:NAN;", "inf": b"d:INF;", "-inf": b"d:-INF;"}[repr(value)]
    if isinstance(value, str):
        return _written("s", value.encode())
    items = list(enumerate(value)) if isinstance(value, list) else [(_key(k), v) for k, v in value.items()]
    return b"a:%d:{%s}" % (len(items), b"".join(to_serialized(k) + to_serialized(v) for k, v in items))


@F.pandas_udf(T.StringType())
def _as_json(values):
    import pandas as pd

    def one(text):
        try:
            return None if text is None else json.dumps(to_plain(text.encode()), ensure_ascii=False, allow_nan=False)
        except (ValueError, OverflowError):
            return None

    return pd.Series([one(v) for v in values], dtype=object)


@F.pandas_udf(T.StringType())
def _from_json(values):
    import pandas as pd

    return pd.Series([None if v is None else to_serialized(json.loads(v)).decode() for v in values], dtype=object)


def decode_nested(value: str | Column) -> Column:
    """A serialized value, nested arrays and all, as VARIANT; NULL where it is
    malformed (a wrong declared length among that) or NULL."""
    return F.parse_json(_as_json(col(value)))


def encode_nested(value: str | Column) -> Column:
    """The serialized form of a VARIANT (whose objects hold their keys sorted, so
    arrays come back with their keys in that order; a double without a fraction
    comes back as a whole number)."""
    return _from_json(F.to_json(col(value)))


def replace_serialized(value: str | Column, old: str, new: str) -> Column:
    """REPLACE that knows serialized values: inside them every text is replaced
    and its declared length mended; other texts are replaced as they are.  A value
    without ``old`` never leaves the JVM."""
    before, after = old.encode(), new.encode()

    @F.pandas_udf(T.StringType())
    def replaced(values):
        import pandas as pd

        return pd.Series([None if v is None else changed(v.encode(), lambda t: t.replace(before, after)).decode() for v in values], dtype=object)

    v = col(value)
    return F.coalesce(replaced(F.when(v.contains(old), v)), v)
