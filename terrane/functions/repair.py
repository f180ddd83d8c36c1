"""Relations in answers of a model that are no valid JSON, read by their keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions.text import json_array_text, normal_json, strip

# The keys of the three kinds of records.
ENTITY, EVENT, INVOLVED = ("头实体", "关系", "尾实体"), ("头事件", "关系", "尾事件"), ("事件", "实体")
TRIPLE = "array<struct<head:string,relation:string,tail:string>>"
GROUP = "array<struct<event:string,entities:array<string>>>"
_QUOTED = r"""("[^"]*"|'[^']*')"""


def _inner(quoted: Column) -> Column:
    return F.substring(quoted, F.lit(2), F.greatest(F.length(quoted) - 2, F.lit(0)))


def triples(text: Column, keys: tuple[str, str, str] = ENTITY) -> Column:
    """Records of quoted values: a record ends with its tail, a key that occurs twice before counts as it stood last, one
    that is missing is null, and what has no tail is left out."""
    pattern = F.lit(rf'"({"|".join(keys)})":\s*{_QUOTED}')
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("k"), F.regexp_extract_all(text, pattern, 2).alias("v"))
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast(TRIPLE).alias("done"), none.alias("head"), none.alias("relation"))

    def step(a: Column, p: Column) -> Column:
        k, v = p["k"], _inner(p["v"])
        ends = k == keys[2]
        record = F.struct(a["head"].alias("head"), a["relation"].alias("relation"), v.alias("tail"))
        return F.struct(
            F.when(ends, F.concat(a["done"], F.array(record))).otherwise(a["done"]).alias("done"),
            F.when(ends, none).when(k == keys[0], v).otherwise(a["head"]).alias("head"),
            F.when(ends, none).when(k == keys[1], v).otherwise(a["relation"]).alias("relation"),
        )

    return F.aggregate(pairs, start, step, lambda a: a["done"])


def groups(text: Column) -> Column:
    """Events with their entities, the first with the first list and so on; empty entities are left out."""
    events = F.transform(F.regexp_extract_all(text, F.lit(rf'"{INVOLVED[0]}":\s*{_QUOTED}'), 1), _inner)
    lists = F.regexp_extract_all(text, F.lit(rf'"{INVOLVED[1]}":\s*\[([^\[\]]*)\]'), 1)
    clean = lambda x: F.regexp_replace(F.regexp_replace(strip(x), r'^"+|"+$', ""), r"^'+|'+$", "")
    entities = F.transform(lists, lambda x: F.filter(F.transform(F.split(x, ","), clean), lambda y: F.trim(y) != ""))
    n = F.least(F.size(events), F.size(entities))
    both = F.arrays_zip(F.slice(events, F.lit(1), n).alias("event"), F.slice(entities, F.lit(1), n).alias("entities"))
    return F.transform(both, lambda x: F.struct(x["event"].alias("event"), x["entities"].alias("entities")))


def _full(a: Column) -> Column:
    return F.when(F.size(a) > 0, a)


def parsed_triples(answer: Column, keys: tuple[str, str, str] = ENTITY, marker: str = "", again: Column | None = None) -> Column:
    """The records of an answer: as JSON, else repaired as it stands, else repaired without blanks and single quotes, else
    those of `again` (the answer of a model asked to repair it); an empty list if all fail."""
    raw = strip(json_array_text(answer, marker))
    plain = normal_json(raw, True)

    def read(t: Column) -> Column:
        j = F.from_json(t, f"array<struct<`{keys[0]}`:string,`{keys[1]}`:string,`{keys[2]}`:string>>")
        kept = F.filter(j, lambda x: x[keys[0]].isNotNull() | x[keys[1]].isNotNull() | x[keys[2]].isNotNull())
        return _full(F.transform(kept, lambda x: F.struct(x[keys[0]].alias("head"), x[keys[1]].alias("relation"), x[keys[2]].alias("tail"))))

    more = [] if again is None else [read(again), _full(triples(again, keys))]
    return F.coalesce(read(plain), _full(triples(raw, keys)), _full(triples(plain, keys)), *more, F.array().cast(TRIPLE))


def parsed_groups(answer: Column, marker: str = "") -> Column:
    """As `parsed_triples` for events with entities."""
    raw = strip(json_array_text(answer, marker))
    plain = normal_json(raw, True)
    j = F.from_json(plain, f"array<struct<`{INVOLVED[0]}`:string,`{INVOLVED[1]}`:array<string>>>")
    kept = F.filter(j, lambda x: x[INVOLVED[0]].isNotNull() & x[INVOLVED[1]].isNotNull())
    read = F.transform(kept, lambda x: F.struct(x[INVOLVED[0]].alias("event"), x[INVOLVED[1]].alias("entities")))
    return F.coalesce(_full(read), _full(groups(raw)), _full(groups(plain)), F.array().cast(GROUP))
