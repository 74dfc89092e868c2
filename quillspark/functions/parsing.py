"""Model answers as text: the first JSON object in them, and deterministic ids."""

from __future__ import annotations

import json
import re
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NAMESPACE = uuid.NAMESPACE_URL


def first_object(text: str | None) -> str | None:
    """The first JSON object of a text, after thoughts and code fences are taken away; null if none parses."""
    body = re.sub(r"<think>.*?(?:</think>|$)", "", text or "", flags=re.S)
    for at in (m.start() for m in re.finditer(r"\{", body)):
        try:
            value, _ = json.JSONDecoder().raw_decode(body, at)
        except json.JSONDecodeError:
            continue
        return json.dumps(value, ensure_ascii=False, sort_keys=True)
    return None


def json_object(text: Column) -> Column:
    """The first JSON object of each text, as JSON; read its fields with ``from_json``. Where the text between the first
    and the last brace is an object, the JVM reads it; only other texts go to Python."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(first_object)

    body = F.regexp_replace(text, r"(?s)<think>.*?(?:</think>|$)", "")
    plain = F.get_json_object(F.regexp_extract(body, r"(?s)^[^{]*(\{.*\})[^}]*$", 1), "$")
    return F.coalesce(plain, run(F.when(plain.isNull() & body.contains("{"), text)))


def name_id(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The version 5 UUID of a name in a namespace, by Spark's own SHA-1."""
    digest = F.sha1(F.concat(F.lit(bytearray(namespace.bytes)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))
