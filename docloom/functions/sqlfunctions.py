"""Checks, tokens and detectors as functions of Spark SQL.

``register(spark)`` makes them temporary functions of the session, so they work in ``spark.sql``:

    select doc_id, m.* from documents, lateral identifiers(text) as m where cn_id_valid(m.value)

Scalar functions are SQL bodies, which Spark inlines and optimises.  ``identifiers`` is a table
function over one text; for whole tables ``detect`` is the faster way, with all rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .checksums import CODE_ALPHABET, CODE_AUTHORITIES, CODE_WEIGHTS, ID_CHECK, ID_WEIGHTS
from .entities import RULES

_DATED = "substring(s, 7, 8) rlike '^(19|20)[0-9]{6}$' and try_to_timestamp(substring(s, 7, 8), 'yyyyMMdd') is not null"
_SUM = " + ".join(f"coalesce(try_cast(substring(s, {i}, 1) as int), 0) * {w}" for i, w in enumerate(ID_WEIGHTS, 1))
_CODE_SUM = " + ".join(f"(instr('{CODE_ALPHABET}', substring(s, {i}, 1)) - 1) * {w}" for i, w in enumerate(CODE_WEIGHTS, 1))
_TOKENS = r"filter(split(regexp_replace(lower(s), '([一-鿿])', ' $1 '), '[^\\p{L}\\p{N}]+'), t -> t != '')"

#: name -> (result type, body over the parameter s)
SCALARS = {
    "cn_id_valid": ("BOOLEAN", f"s rlike '^[1-8][0-9]{{16}}[0-9Xx]$' and {_DATED} and substring(s, 18, 1) = substring('{ID_CHECK}', ({_SUM}) % 11 + 1, 1)"),
    "credit_code_valid": ("BOOLEAN", f"s rlike '^[{CODE_ALPHABET}]{{17}}.$' and substring(s, 18, 1) = substring('{CODE_ALPHABET}', pmod(31 - ({_CODE_SUM}) % 31, 31) + 1, 1)"),
    "credit_code_shape": ("BOOLEAN", f"s rlike '^[{CODE_AUTHORITIES}][{CODE_ALPHABET}][0-9]{{6}}[{CODE_ALPHABET}]{{10}}$'"),
    "card_valid": ("BOOLEAN", "s rlike '^[2-6][0-9]{12,18}$' and luhn_check(s)"),
    "cjk_tokens": ("ARRAY<STRING>", _TOKENS),
    "cjk_tsquery": ("STRING", f"array_join({_TOKENS}, ' <-> ')"),
    "egress_admission": ("STRING", "case s when 'sanitized' then 'redacted' when 'never' then 'original' else 'refuse' end"),
}

_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@udtf(returnType="entity string, start int, end int, value string")
class Identifiers:
    """Hits of the rules that need neither a label nor separators taken out, by rule and place."""

    def eval(self, text: str) -> Iterator[tuple]:
        for code, pattern, bounded in _PLAIN:
            for m in re.finditer(pattern, text or ""):
                edge = bounded and (text[m.start() - 1 : m.start()] in _SOLID or text[m.end() : m.end() + 1] in _SOLID)
                octet = code == "IP" and (text[m.start() - 1 : m.start()] == "." or re.match(r"\.[0-9]", text[m.end() : m.end() + 2]))
                if not edge and not octet:
                    yield code, m.start(), m.end(), m[0]


_SOLID = frozenset(_ALNUM)
_PLAIN = tuple((r.code, r.pattern.removeprefix("(?U)"), r.bounded) for r in RULES if r.mode == "plain" and r.check in ("", "no_more_octets"))


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; returns their names."""
    for name, (kind, body) in SCALARS.items():
        spark.sql(f"create or replace temporary function {name}(s string) returns {kind} return {body}")
    spark.udtf.register("identifiers", Identifiers)
    return [*SCALARS, "identifiers"]
