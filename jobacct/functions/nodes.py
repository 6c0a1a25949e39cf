"""Node-list expansion ('node-[001-003,007]' -> array of node names).

Pure Catalyst: split / transform / sequence / flatten, evaluated per row, so a
node list is parsed on the executor that reads it, without a Python callback.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobacct.functions.text import strip_ws, to_int


def _zfill(digits: Column, width: Column) -> Column:
    """Left-pad with zeros to ``width``; never shortens (lpad would)."""
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


#: Names of a range made at a time when a list becomes rows.
CHUNK = 1 << 16


def node_items(node_list: Column | str) -> Column:
    """The items of a compressed node list in order, as
    ``array<struct<prefix, width, lo, hi, name>>``: a range has ``lo`` and ``hi``
    (none of its numbers if lo > hi), any other item a ``name``.

    * null, '', 'None', 'N/A' -> empty array
    * no '[' -> the whole text as one name (also 'a,b')
    * otherwise prefix = text before the first '['; the items are the text up
      to the first ']' after it, split on ','. An item 'lo-hi' whose bounds
      are integers is the range lo..hi, zero-padded to the width of lo when lo
      starts with '0'. Any other item (a number, a word, a broken range) is
      prefix + item. Text after ']' is ignored and a missing ']' is tolerated.
    """
    c = F.col(node_list) if isinstance(node_list, str) else node_list
    prefix = F.substring_index(c, "[", 1)
    inner = F.substring_index(F.split_part(c, F.lit("["), F.lit(2)), "]", 1)

    def one(name: Column, width: Column, lo: Column, hi: Column) -> Column:
        return F.struct(prefix.alias("prefix"), width.cast("int").alias("width"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"), name.alias("name"))

    def item(raw: Column) -> Column:
        p = strip_ws(raw)
        dash = F.instr(p, "-")
        lo_txt = F.substring_index(p, "-", 1)
        hi_txt = p.substr(dash + 1, F.length(p))
        lo = to_int(lo_txt)
        hi = to_int(hi_txt)
        is_range = (dash > 0) & (F.length(lo_txt) > 0) & lo.isNotNull() & hi.isNotNull()
        width = F.when(F.substring(lo_txt, 1, 1) == "0", F.length(lo_txt)).otherwise(F.lit(0))
        return one(F.when(~is_range, F.concat(prefix, p)), width, F.when(is_range, lo), F.when(is_range, hi))

    null = F.lit(None)
    items = F.transform(F.split(inner, ",", -1), item)
    whole = F.array(one(c, F.lit(0), null, null))
    return F.when(c.isNull() | c.isin("", "None", "N/A"), F.slice(whole, 1, 0)).when(~c.contains("["), whole).otherwise(items)


def _name(item: Column, number: Column) -> Column:
    return F.coalesce(item["name"], F.concat(item["prefix"], _zfill(number.cast("string"), item["width"])))


def expand_nodes(node_list: Column | str) -> Column:
    """A compressed node list as ``array<string>``, in order, with duplicates
    kept (items as in ``node_items``): for one line's list. An array holds what a
    task can hold; ``explode_nodes`` has no such bound."""

    def names(it: Column) -> Column:
        numbers = F.when(it["lo"] <= it["hi"], F.sequence(it["lo"], it["hi"])).otherwise(F.array().cast("array<bigint>"))
        return F.when(it["name"].isNotNull(), F.array(it["name"])).otherwise(F.transform(numbers, lambda i: _name(it, i)))

    return F.flatten(F.transform(node_items(node_list), names))


def node_count(node_list: Column | str) -> Column:
    """How many names a node list has (bigint), from the bounds of its ranges."""
    size = lambda it: F.when(it["name"].isNotNull(), F.lit(1)).otherwise(F.greatest(it["hi"] - it["lo"] + 1, F.lit(0)))
    return F.aggregate(node_items(node_list), F.lit(0).cast("bigint"), lambda a, it: a + size(it))


def explode_nodes(df: DataFrame, node_list: str, out: str = "node") -> DataFrame:
    """``df`` with a row for each name of ``node_list`` (column ``out``). A range
    becomes chunks of ``CHUNK`` numbers, a chunk its names: no array holds a
    whole range, and an aggregation above takes the names one by one. A list
    without names, and an empty range, give a row with a null ``out``."""
    it = F.col("_item")
    last = F.least(F.col("_from") + (CHUNK - 1), it["hi"])
    rows = df.withColumn("_item", F.explode_outer(node_items(node_list)))
    rows = rows.withColumn("_from", F.explode_outer(F.when(it["lo"] <= it["hi"], F.sequence(it["lo"], it["hi"], F.lit(CHUNK).cast("bigint")))))
    rows = rows.withColumn("_number", F.explode_outer(F.when(F.col("_from").isNotNull(), F.sequence(F.col("_from"), last))))
    return rows.withColumn(out, _name(it, F.col("_number"))).drop("_item", "_from", "_number")
