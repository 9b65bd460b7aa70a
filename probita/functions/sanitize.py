"""Sanitizing JSON of any shape: placeholder texts become {"value": null, "status": ..., "original": ...} objects.

The typed path (``operators.sections``) doesn't need it. A document outside the schema is a VARIANT, written out again in
its canonical form: no blanks, one spelling of each character. There a string that is a value stands between one of
``: , [`` (or the text's beginning) and one of ``, ] }`` (or its end); quotes inside strings are escaped, and nothing that
can follow a closing quote opens a placeholder, so a whole string is told from a part of one by its neighbours alone, at
any depth. All of it is JVM expressions.

Defined results: null for null or unreadable JSON (``NaN`` and repeated keys of an object included); keys come in
alphabetical order and are never changed; ``original`` is kept for unknown bracketed texts only, which hold something
between their brackets and no line end.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_VALUE = r'(?<=^|[:,\[])"{0}"(?=[,\]}}]|$)'
#: A bracketed text in canonical JSON: characters and escapes, no line feed but a last one.
_BRACKETED = r'((?!\[\](?:\\n)?")\[(?:[^"\\]|\\[^n])++(?<=\])(?:\\n)?)'


def sanitize_json(text: Column) -> Column:
    out = F.to_json(F.try_parse_json(text))
    for placeholder, status in fixed.PLACEHOLDERS.items():
        inside = re.escape(json.dumps(placeholder, ensure_ascii=False)[1:-1])
        out = F.regexp_replace(out, _VALUE.format(inside), json.dumps({"value": None, "status": status}, separators=(",", ":")))
    return F.regexp_replace(out, _VALUE.format(_BRACKETED), '{"value":null,"status":"redacted_other","original":"$1"}')
