"""The three attribute readings: the quote-aware GTF list, the GFF3 list, and the two single-id extractors.

They differ on purpose, as the tools that users know differ; see each function.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammars of the attribute column.
GTF_PAIR = r'[ \t]*+([^ \t;]++)[ \t]*+(?:"([^"]*+)"?+|([^; \t]*+))[^;]*+;?+'
ID_TOKEN = r'(?:^|;)[ \t]*KEY[ \t]+("[^"]*|[^; \t]*)'
# The key is searched as a fixed text; that it begins a word is asked where it was found.
ID_QUOTED = r'(?U)KEY(?<=\bKEY) "([^"]+)"'
ID_BARE = r"(?U)KEY(?<=\bKEY) (\S+?)(?:;|$)"


def once(value: Column) -> Column:
    """value, as a generator of one row for each row: the optimizer does not copy it into what is computed from it (filters would be pushed below it, with a copy for each use)."""
    return F.explode_outer(F.array(value))


def _keyed(pattern: str, key: str) -> str:
    return pattern.replace("KEY", re.sub(r"([^A-Za-z0-9_])", r"\\\1", key))


def gtf_attributes(raw: Column) -> Column:
    """array<struct<key,value>> in order, duplicates kept: `key "value";` or `key value;`. A key without a value has ''; blanks and ; inside quotes belong to the value."""
    pairs = F.regexp_extract_all(raw, F.lit(GTF_PAIR), F.lit(0))
    # A key holds no blank, so a blank can part the two groups.
    named = F.transform(pairs, lambda p: F.regexp_replace(p, f"(?s)^{GTF_PAIR}$", "$1 $2$3"))
    return F.transform(named, lambda p: F.struct(F.substring_index(p, " ", 1).alias("key"), F.substr(p, F.instr(p, F.lit(" ")) + 1).alias("value")))


def gff3_attributes(raw: Column) -> Column:
    """array<struct<key,value>> of `key=value;`: blanks before a key go, a key without = has '', percent escapes and commas stay."""
    pairs = F.transform(F.split(raw, ";"), lambda t: F.ltrim(t))
    named = F.transform(pairs, lambda t: F.struct(F.substring_index(t, "=", 1).alias("key"), F.when(F.instr(t, "=") > 0, F.substr(t, F.instr(t, "=") + 1)).otherwise("").alias("value")))
    return F.filter(named, lambda p: p["key"] != "")


def attributes_of(raw: Column, fmt: Column) -> Column:
    """The list in the grammar that fmt ('gtf' or 'gff3') names."""
    return F.when(fmt == "gff3", gff3_attributes(raw)).otherwise(gtf_attributes(raw))


def lookup(attributes: Column, key: str) -> Column:
    """Value of the first pair with this key; null if there is none."""
    return F.get(F.filter(attributes, lambda p: p["key"] == key), F.lit(0)).getField("value")


def gtf_value(raw: Column, key: str) -> Column:
    """lookup(gtf_attributes(raw), key), without the list."""
    of = lambda group: F.regexp_extract_all(raw, F.lit(GTF_PAIR), F.lit(group))
    place = F.array_position(of(1), key).cast("int") - 1
    return F.when(place >= 0, F.concat(F.get(of(2), place), F.get(of(3), place)))


def value_of(raw: Column, fmt: Column, key: str) -> Column:
    """lookup(attributes_of(raw, fmt), key)."""
    return F.when(fmt == "gff3", lookup(gff3_attributes(raw), key)).otherwise(gtf_value(raw, key))


def token_id(raw: Column, key: str) -> Column:
    """Id as the statistics read it: after the start or any ; (quotes are not minded), blanks, the key, blanks, a quoted or bare value. '' if there is none."""
    # A bare value has no quote in front, a quoted one no other quote: trimming takes the opening one.
    return F.ltrim(F.regexp_extract(raw, _keyed(ID_TOKEN, key), 1), F.lit('"'))


def word_id(raw: Column, key: str) -> Column:
    """Id as the identifier comparison reads it: the key as a whole word anywhere, one blank, a non-empty quoted value, else a bare one. Null if there is none."""
    one = lambda p: F.nullif(F.regexp_extract(raw, _keyed(p, key), 1), F.lit(""))
    return F.coalesce(one(ID_QUOTED), one(ID_BARE))
