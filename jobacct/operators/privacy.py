"""Pseudonymise accounting dumps and the other recorded texts consistently.

The same original value gets the same alias in every column and every file:
users, groups and accounts share one map (a list of first names, then
'user%03d'), job names become 'job_%04d', nodes 'node-%03d' (node lists are
expanded and every node mapped), clusters 'cluster-%02d', partitions
'partition-%02d'. Aliases are numbered by first appearance in dump order.
Blank, 'None' and 'N/A' stay as they are; home directories become
'/work/project'; submit lines become a fixed text.

Distributed numbering: occurrences -> first position per (kind, value) ->
range partitioning by that position -> per-partition offsets (one row per
partition) + the partition-local row number carried by
``monotonically_increasing_id``. No step gathers the values in one task.

An alias map can be given from earlier runs (``known``, kept with ``save_map`` and
``load_map``): known values keep their alias, new ones are numbered after the last
of their kind, so runs in turn give the aliases of all their texts at once.
``pseudonymize_texts`` rewrites queue snapshots, node inventories, node
descriptions and lists of node names with the same map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobacct.functions.nodes import expand_nodes
from jobacct.schemas import ACCOUNTING_FIELDS
from jobacct.session import path_exists
from jobacct.sources.store import stage

# --- fixed values: the first aliases handed out for users, and the texts ----
# --- that replace home folders and submit lines ------------------------------
USER_NAMES = (
    "alice", "bob", "charlie", "diana", "eve", "frank", "grace", "henry", "iris",
    "jack", "kate", "liam", "maya", "noah", "olivia", "peter", "quinn", "rachel",
    "sam", "tina", "uma", "victor", "wendy", "xavier", "yara", "zoe",
)
# submit lines naming a script file, and the replacement texts
SCRIPT_MARKERS = (".sh", ".py", ".slurm")
SCRIPT_SUBMIT_LINE = "sbatch script.sh"
OTHER_SUBMIT_LINE = "sbatch job_script"
HOME_MARKERS = ("/home/", "/users/")
PROJECT_WORKDIR = "/work/project"
KEEP = ("", "None", "N/A")
# field -> map kind, in the order the fields of a line are visited
SCALAR_FIELDS = (
    ("JobName", "job"), ("User", "user"), ("Group", "user"), ("Account", "user"),
    ("Cluster", "cluster"), ("Partition", "partition"), ("MaxRSSNode", "node"), ("MaxVMSizeNode", "node"),
)
# NodeList is visited between Account and Cluster
NODE_LIST_POS = ACCOUNTING_FIELDS.index("NodeList")


def _pos(field: str) -> int:
    return ACCOUNTING_FIELDS.index(field)


def occurrences(bronze: DataFrame, seq: str = "seq") -> DataFrame:
    """``(kind, value, at)`` for every mapped value in the dump; ``at`` orders
    them like a line-by-line, field-by-field pass."""
    items = []
    for f, kind in SCALAR_FIELDS:
        v = F.col(f)
        skip = v.isNull() | v.isin(*KEEP) | ((v == "Unknown") & F.lit(kind == "node"))
        at = F.struct(F.col(seq).alias("line"), F.lit(_pos(f)).alias("field"), F.lit(0).alias("item"))
        items.append(F.when(~skip, F.struct(F.lit(kind).alias("kind"), v.alias("value"), at.alias("at"))))
    scalar = bronze.select(F.explode(F.array(*items)).alias("o")).where(F.col("o").isNotNull()).select("o.*")
    nl = F.col("NodeList")
    nodes = bronze.where(nl.isNotNull() & ~nl.isin(*KEEP)).select(seq, F.posexplode(expand_nodes("NodeList")).alias("item", "value"))
    nodes = nodes.select(
        F.lit("node").alias("kind"), "value",
        F.struct(F.col(seq).alias("line"), F.lit(NODE_LIST_POS).alias("field"), F.col("item").cast("int").alias("item")).alias("at"),
    )
    return scalar.unionByName(nodes)


def first_seen_index(spark: SparkSession, occ: DataFrame) -> DataFrame:
    """``(kind, value, idx)``: 0-based rank of each distinct value within its
    kind by first appearance, computed without a global single-task window."""
    # a staged range partitioning: places are final before offsets are counted
    first = occ.groupBy("kind", "value").agg(F.min("at").alias("_first"))
    n = max(spark.sparkContext.defaultParallelism, 1)
    s = first.repartitionByRange(n, "kind", "_first").sortWithinPartitions("kind", "_first")
    s = s.select("kind", "value", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
    s = stage(spark, s, "alias-rank")
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    # rows of each kind per partition -> how many rows of that kind precede a
    # partition; a table of (#partitions x #kinds) rows
    counts = s.groupBy("kind", "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min(local).alias("_lo"))
    w = Window.partitionBy("kind").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("kind", "_pid", "_lo", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return s.join(F.broadcast(offs), ["kind", "_pid"]).select("kind", "value", (F.col("_off") + local - F.col("_lo")).alias("idx"))


def alias_of(kind: Column, idx: Column) -> Column:
    names = F.array(*[F.lit(n) for n in USER_NAMES])
    return (
        F.when((kind == "user") & (idx < len(USER_NAMES)), F.element_at(names, (idx + 1).cast("int")))
        .when(kind == "user", F.format_string("user%03d", idx))
        .when(kind == "job", F.format_string("job_%04d", idx))
        .when(kind == "node", F.format_string("node-%03d", idx))
        .when(kind == "cluster", F.format_string("cluster-%02d", idx))
        .otherwise(F.format_string("partition-%02d", idx))
    )


MAP = "kind string, value string, idx bigint, alias string"


def _alias_map_from(spark: SparkSession, occ: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """MAP of every value of ``occ`` and of ``known``."""
    new = occ if known is None else occ.select("kind", "value", "at").join(known.select("kind", "value"), ["kind", "value"], "left_anti")
    idx = first_seen_index(spark, new)
    if known is not None:  # five kinds: numbers go on after the last one of each
        after = known.groupBy("kind").agg((F.max("idx") + 1).alias("_after"))
        idx = idx.join(F.broadcast(after), "kind", "left").withColumn("idx", F.col("idx") + F.coalesce("_after", F.lit(0))).drop("_after")
    made = idx.select("kind", "value", F.col("idx").cast("bigint").alias("idx"), alias_of(F.col("kind"), F.col("idx")).alias("alias"))
    return made if known is None else known.select("kind", "value", "idx", "alias").unionByName(made)


def alias_map(spark: SparkSession, bronze: DataFrame, seq: str = "seq", known: DataFrame | None = None) -> DataFrame:
    """MAP of every distinct mapped value of the dump (and of ``known``)."""
    return _alias_map_from(spark, occurrences(bronze, seq), known)


def save_map(amap: DataFrame, path: str) -> None:
    """Add the values of ``amap`` that the map kept at ``path`` has not yet.
    Aliases given out are never changed: the kept map only grows."""
    spark = amap.sparkSession
    new = amap.join(load_map(spark, path).select("kind", "value"), ["kind", "value"], "left_anti")
    stage(spark, new.select("kind", "value", "idx", "alias"), "alias-new").write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str) -> DataFrame:
    """The kept map; empty where there is none."""
    return spark.read.schema(MAP).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], MAP)


def pseudonymize(spark: SparkSession, bronze: DataFrame, seq: str = "seq", known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (pseudonymised bronze, alias map: ``known`` and what is new).

    Every mapped value of every line (scalar fields and each node of a node
    list) is one row of a long table; ONE skew-safe lookup join gives the
    aliases (a value on most lines, such as a shared group or cluster, is
    served from a bounded broadcast); the aliases are pivoted back per line
    (keyed by line: even) and joined 1:1 to the lines."""
    from jobacct.operators.joins import lookup_join

    # the long table feeds the ranking, the hot-key count and the lookup:
    # materialised once in the checkpoint folder
    occ = stage(spark, occurrences(bronze, seq), "alias-occurrences")
    amap = stage(spark, _alias_map_from(spark, occ, known), "alias-map")
    looked = lookup_join(occ, amap.select("kind", "value", "alias"), ["kind", "value"])
    fld = F.col("at.field")
    per_field = [
        F.max(F.when(fld == _pos(f), F.col("alias"))).alias(f"_a_{f}") for f, _ in SCALAR_FIELDS
    ]
    nodes = F.array_sort(F.collect_list(F.when(fld == NODE_LIST_POS, F.struct(F.col("at.item").alias("i"), F.col("alias").alias("a")))))
    per_line = looked.groupBy(F.col("at.line").alias(seq)).agg(*per_field, nodes.alias("_nl"))
    out = bronze.join(per_line, seq, "left")
    for f, _ in SCALAR_FIELDS:
        out = out.withColumn(f, F.coalesce(F.col(f"_a_{f}"), F.col(f))).drop(f"_a_{f}")
    joined = F.array_join(F.transform(F.col("_nl"), lambda x: x["a"]), ",")
    out = out.withColumn(
        "NodeList", F.when(F.col("_nl").isNull() | (F.size("_nl") == 0), F.col("NodeList")).otherwise(joined)
    ).drop("_nl")
    wd, sl = F.col("WorkDir"), F.col("SubmitLine")
    home = wd.contains(HOME_MARKERS[0]) | F.lower(wd).contains(HOME_MARKERS[1])
    out = out.withColumn("WorkDir", F.when((wd != "") & home, F.lit(PROJECT_WORKDIR)).otherwise(wd))
    script = F.lit(False)
    for marker in SCRIPT_MARKERS:
        script = script | sl.contains(marker)
    out = out.withColumn(
        "SubmitLine", F.when(sl == "", sl).when(script, F.lit(SCRIPT_SUBMIT_LINE)).otherwise(F.lit(OTHER_SUBMIT_LINE))
    )
    return out, amap


# --- the other recorded texts ---------------------------------------------------------
QUEUE, INVENTORY, DESCRIPTION, NODE_NAMES = "queue", "inventory", "description", "node names"
#: Separator and mapped parts (place, kind) of texts made of separated parts.
PARTS = {QUEUE: ("/", ((0, "user"), (3, "partition"), (5, "node"))), INVENTORY: (",", ((0, "node"),))}
QUEUE_HEADER_START, NO_NODE = "USER", "(null)"
#: Keys of a description line whose value is a node, and the one with a list of partitions, in the order they are visited.
NODE_KEYS, PARTITIONS_KEY = ("NodeName=", "NodeHostName=", "NodeAddr="), "Partitions="


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _parts(text: str) -> Column:
    return F.split(F.col("value"), PARTS[text][0], -1)


def _mapped_line(text: str) -> Column:
    """Whether a line has mapped values at all."""
    v = F.col("value")
    if text == QUEUE:
        return v.contains("/") & ~v.startswith(QUEUE_HEADER_START)
    return v.contains(",") if text == INVENTORY else F.lit(True)


def _list_of(value: Column) -> Column:
    return F.split(F.regexp_extract(value, PARTITIONS_KEY + r"(\S+)", 1), ",", -1)


def text_occurrences(lines: DataFrame, text: str, rank: int) -> DataFrame:
    """``(kind, value, at)`` of one text (value, seq); ``at`` orders them by text, line and place in the line."""
    item = lambda kind, value, slot: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(slot).cast("bigint").alias("slot"))
    if text in PARTS:
        items = F.array(*(item(kind, F.get(_parts(text), F.lit(k)), k) for k, kind in PARTS[text][1]))
    elif text == NODE_NAMES:
        items = F.array(item("node", _stripped(F.col("value")), 0))
    else:
        nodes = F.array(*(item("node", F.regexp_extract("value", key + r"(\S+)", 1), k) for k, key in enumerate(NODE_KEYS)))
        first = len(NODE_KEYS)
        listed = F.transform(_list_of(F.col("value")), lambda p, i: F.struct(F.lit("partition").alias("kind"), p.alias("value"), (i + first).cast("bigint").alias("slot")))
        items = F.concat(nodes, listed)
    rows = lines.where((_stripped(F.col("value")) != "") & _mapped_line(text)).select("seq", F.explode(items).alias("o"))
    skip = F.col("o.value").isNull() | F.col("o.value").isin(*KEEP)
    if text == QUEUE:
        skip = skip | ((F.col("o.value") == NO_NODE) & (F.col("o.kind") == "node"))
    at = F.struct(F.lit(rank).alias("text"), F.col("seq"), F.col("o.slot").alias("slot"))
    return rows.where(~skip).select("o.kind", "o.value", at.alias("at"))


def _rewritten(text: str, found: Column) -> Column:
    """A line with the aliases ``found`` (slot -> alias) in their places."""
    value = F.col("value")
    alias = lambda slot, old: F.coalesce(F.element_at(found, slot), old)
    if text in PARTS:
        sep = PARTS[text][0]
        return F.array_join(F.transform(_parts(text), lambda p, i: alias(i.cast("bigint"), p)), sep)
    if text == NODE_NAMES:
        return alias(F.lit(0).cast("bigint"), value)
    out = value
    for k, key in enumerate(NODE_KEYS):
        old = F.regexp_extract(value, key + r"(\S+)", 1)
        out = F.when(old != "", F.replace(out, F.concat(F.lit(key), old), F.concat(F.lit(key), alias(F.lit(k).cast("bigint"), old)))).otherwise(out)
    first, old = len(NODE_KEYS), F.regexp_extract(value, PARTITIONS_KEY + r"(\S+)", 1)
    new = F.array_join(F.transform(_list_of(value), lambda p, i: alias((i + first).cast("bigint"), p)), ",")
    return F.when(old != "", F.replace(out, F.concat(F.lit(PARTITIONS_KEY), old), F.concat(F.lit(PARTITIONS_KEY), new))).otherwise(out)


def pseudonymize_texts(spark: SparkSession, texts: list[tuple[str, DataFrame]], known: DataFrame | None = None) -> tuple[list[DataFrame], DataFrame]:
    """``texts``: (QUEUE, INVENTORY, DESCRIPTION or NODE_NAMES, lines (value, seq
    bigint)) in the order they are visited. Returns the rewritten lines of each
    (value, seq) and the alias map, ``known`` included. Blank lines, the queue's
    header and lines without the text's separator stay as they are.

    As in ``pseudonymize``: one long table of values and places, one skew-safe
    lookup for all texts, aliases put back per line."""
    from jobacct.operators.joins import lookup_join

    occ = text_occurrences(texts[0][1], texts[0][0], 0)
    for rank, (text, lines) in enumerate(texts[1:], 1):
        occ = occ.unionByName(text_occurrences(lines, text, rank))
    occ = stage(spark, occ, "text-occurrences")
    amap = stage(spark, _alias_map_from(spark, occ, known), "alias-map")
    looked = lookup_join(occ, amap.select("kind", "value", "alias"), ["kind", "value"])
    entries = F.map_from_entries(F.collect_list(F.struct("at.slot", "alias"))).alias("_found")
    found = stage(spark, looked.groupBy(F.col("at.text").alias("_text"), F.col("at.seq").alias("seq")).agg(entries), "text-aliases")
    out = []
    for rank, (text, lines) in enumerate(texts):
        mine = lines.join(found.where(F.col("_text") == rank).drop("_text"), "seq", "left")
        made = F.when(F.col("_found").isNotNull(), _rewritten(text, F.col("_found"))).otherwise(F.col("value"))
        out.append(mine.select(made.alias("value"), "seq"))
    return out, amap
