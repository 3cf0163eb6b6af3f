"""Notes from JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTE = "p int, o double, d double, v int"


def notes_from_json(text: Column) -> Column:
    """array<struct<p, o, d, v>> of a JSON array or single object, by (o, p, d).

    An item must have all four keys; p, o and d must be numbers; a null v is 80. Null, malformed and other text gives
    an empty array.
    """
    whole = F.trim(text)
    as_list = F.when(whole.startswith("{"), F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole)
    items = F.from_json(as_list, "array<map<string,string>>")
    full = F.filter(items, lambda m: F.map_contains_key(m, "p") & F.map_contains_key(m, "o") & F.map_contains_key(m, "d") & F.map_contains_key(m, "v"))
    notes = F.transform(full, lambda m: F.struct(
        m["o"].try_cast("double").alias("o"), m["p"].try_cast("int").alias("p"), m["d"].try_cast("double").alias("d"), F.when(m["v"].isNull(), 80).otherwise(m["v"].try_cast("int")).alias("v"),
    ))
    good = F.filter(notes, lambda n: n.p.isNotNull() & n.o.isNotNull() & n.d.isNotNull() & n.v.isNotNull())
    ordered = F.transform(F.array_sort(good), lambda n: F.struct(n.p.alias("p"), n.o.alias("o"), n.d.alias("d"), n.v.alias("v")))
    return F.coalesce(ordered, F.expr(f"from_json('[]', 'array<struct<{', '.join(x.replace(' ', ':') for x in NOTE.split(', '))}>>')"))
