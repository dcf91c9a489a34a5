"""Process lineage: instances, parents and references by as-of joins, walks of the forest (survey H5, H6, G7, G8, E2-E5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import norm_host
from ..tables import HOT, any_hot, scanned, written
from . import forest


def creates(strict_keys: bool = False) -> Column:
    """Sysmon 1 and 4688; strict_keys leaves out the 4688 of 'evtx:Security', as source prefixes alone would."""
    base = F.substring_index("source", ":", 1)
    out = (base == "sysmon") & (F.col("event_id") == "1") | (base == "security") & (F.col("event_id") == "4688") | (base == "evtx-xml") & F.col("event_id").isin("1", "4688")
    return out if strict_keys else out | (F.col("source") == "evtx:Security") & (F.col("event_id") == "4688")


def _image() -> Column:
    return F.trim(F.coalesce("process_name", F.lit("")))


def instances(events: DataFrame, strict_keys: bool = False) -> DataFrame:
    """A row for each (host, pid, image): the first event's attributes, ids of all its events."""
    own = events.filter(creates(strict_keys) & F.col("process_id").isNotNull() & (_image() != ""))
    first = F.struct("timestamp", "id", "host", _image().alias("image"), "parent_id", "parent_name", "user", "command_line")
    rows = own.groupBy(norm_host(F.col("host")).alias("h"), F.col("process_id").alias("pid"), F.lower(_image()).alias("img")).agg(F.min(first).alias("f"), F.count("*").alias("events"), F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "id"))), lambda x: x["id"]).alias("event_ids"))
    return rows.select("h", "pid", "img", F.col("f.timestamp").alias("start"), F.col("f.id").alias("first_id"), F.col("f.host").alias("host"), F.col("f.image").alias("image"), F.col("f.parent_id").alias("parent_pid"), F.col("f.parent_name").alias("parent_image"), F.col("f.user").alias("user"), F.col("f.command_line").alias("command_line"), "events", "event_ids")


def pid_reuse(inst: DataFrame) -> DataFrame:
    return inst.groupBy("h", "pid").agg(F.count_distinct("img").alias("images")).filter("images > 1")


def parents(inst: DataFrame, ambiguous: bool = False, hot: int = HOT) -> DataFrame:
    """first_id, start, parent_first_id, candidates: the latest instance of the parent's pid that had started; of equal starts the last seen.

    Instances and those who look for a parent are put in one order of time for each (host, pid), where a running
    maximum is the parent and a running count the number of candidates: no pairs are made, and a pid of more than hot
    rows is gone through by several tasks. An instance is no candidate of its own; where it would be its own parent the
    one before it is. ambiguous: also list all candidates where there are several, which takes as many entries as there
    are, and one task for each pid.
    """
    inst = written(inst.select("h", "pid", "start", "first_id", "parent_pid"))
    keys = inst.select("h", "pid").unionByName(inst.filter("parent_pid IS NOT NULL").select("h", F.col("parent_pid").alias("pid")))
    spread = any_hot(keys, ["h", "pid"], hot)
    place = F.struct("start", "first_id")
    last = scanned(inst.select("h", "pid", "start", "first_id", place.alias("x")), ["h", "pid"], ["start", "first_id"], {"l": ("max", "x")}, earlier=True, spread=spread)
    begin = last.select("h", "pid", F.col("start").alias("t"), F.lit(0).alias("k"), "first_id", F.struct("start", "first_id", F.col("l.first_id").alias("last")).alias("i"), F.lit(False).alias("own"))
    look = inst.filter("parent_pid IS NOT NULL").select("h", F.col("parent_pid").alias("pid"), F.col("start").alias("t"), F.lit(1).alias("k"), "first_id", F.lit(None).cast(begin.schema["i"].dataType).alias("i"), (F.col("parent_pid") == F.col("pid")).alias("own"))
    order = ["t", "k", "first_id"]
    both = begin.unionByName(look).withColumn("one", F.when(F.col("i").isNotNull(), 1).otherwise(0))
    told = scanned(both, ["h", "pid"], order, {"b": ("max", "i"), "n": ("sum", "one")}, spread=spread)
    if ambiguous:
        told = told.withColumn("every", F.collect_list("i").over(Window.partitionBy("h", "pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    own = F.when(F.col("b.first_id") == F.col("first_id"), F.col("b.last")).otherwise(F.col("b.first_id"))
    number = F.col("n") - F.col("own").cast("int")
    columns = ["first_id", own.alias("parent_first_id"), number.alias("candidates")]
    if ambiguous:
        others = F.transform(F.filter(F.array_sort("every"), lambda x: x["first_id"] != F.col("first_id")), lambda x: x["first_id"])
        columns.append(F.when(number > 1, others).alias("ambiguous"))
    found = told.filter("k = 1").select(*columns)
    out = inst.select("first_id", "start").join(found, "first_id", "left")
    return out.select("first_id", "start", "parent_first_id", F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"), *(["ambiguous"] if ambiguous else []))


def references(events: DataFrame, inst: DataFrame, strict_keys: bool = False, hot: int = HOT) -> DataFrame:
    """first_id, references: other events of a (host, pid) go to its latest instance so far; of equal starts the first seen."""
    use = events.filter(F.col("process_id").isNotNull() & ~(creates(strict_keys) & (_image() != ""))).select(norm_host(F.col("host")).alias("h"), F.col("process_id").alias("pid"), "timestamp", "id", F.lit(None).cast("struct<start:timestamp,n:bigint>").alias("i"))
    begin = inst.select("h", "pid", F.col("start").alias("timestamp"), F.col("first_id").alias("id"), F.struct("start", (-F.col("first_id")).alias("n")).alias("i"))
    told = scanned(begin.unionByName(use), ["h", "pid"], ["timestamp", "id"], {"at": ("max", "i")}, hot=hot).filter("i IS NULL AND at IS NOT NULL")
    return told.groupBy((-F.col("at.n")).alias("first_id")).agg(F.count("*").alias("references"))


def ancestors(links: DataFrame) -> DataFrame:
    """first_id, ancestor, depth, for each step up, however many; a chain that comes back to itself stops there.

    links: (first_id, parent_first_id), at most one parent each. Each round doubles the chains' length: their ends are
    joined with the chains that begin there. What a chain meets again stays at its first depth.
    """
    out = written(links.filter("first_id <> parent_first_id").select("first_id", F.col("parent_first_id").alias("ancestor"), F.lit(1).alias("depth")))
    far = 1
    while True:
        ends = out.filter(F.col("depth") == far).select("first_id", F.col("ancestor").alias("via"))
        above = out.select(F.col("first_id").alias("via"), "ancestor", (F.col("depth") + far).alias("depth"))
        further = ends.join(above, "via").filter("first_id <> ancestor").select("first_id", "ancestor", "depth")
        longer = written(out.unionByName(further).groupBy("first_id", "ancestor").agg(F.min("depth").alias("depth")))
        if not longer.filter(F.col("depth") > far).head(1):
            return out
        out, far = longer, 2 * far


def trees(inst: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root, depth, pre, size) of the instances whose chain of parents ends; children in order of start and id."""
    up = links.select("first_id", "parent_first_id")
    return forest.forest(inst.select("first_id", "start").join(up, "first_id").select(F.col("first_id").alias("id"), F.col("parent_first_id").alias("parent"), F.col("start").alias("order")))


def _round(links: DataFrame, told: DataFrame) -> DataFrame:
    """The links of instances that aren't in trees: their chains come back to themselves, and are walked step by step."""
    return links.join(told.select(F.col("id").alias("first_id")), "first_id", "left_anti")


def depths(inst: DataFrame, links: DataFrame) -> DataFrame:
    """(first_id, depth): how many steps up each instance has."""
    told = written(trees(inst, links))
    deep = told.select(F.col("id").alias("first_id"), "depth")
    rest = written(_round(links, told))
    return deep if not rest.head(1) else deep.unionByName(ancestors(rest).groupBy("first_id").agg(F.max("depth").alias("depth")))


def descendants(inst: DataFrame, links: DataFrame) -> DataFrame:
    """(ancestor, descendants): how many instances are below each that has any."""
    told = written(trees(inst, links))
    many = told.filter("size > 1").select(F.col("id").alias("ancestor"), (F.col("size") - 1).alias("descendants"))
    rest = written(_round(links, told))
    return many if not rest.head(1) else many.unionByName(ancestors(rest).groupBy("ancestor").agg(F.count_distinct("first_id").alias("descendants")))


def focused(inst: DataFrame, links: DataFrame, heads: DataFrame) -> DataFrame:
    """(first_id): heads (first_id) and what is below them."""
    told = written(trees(inst, links))
    own = forest.below(told, heads.select(F.col("first_id").alias("id"))).select(F.col("id").alias("first_id"))
    rest = written(_round(links, told))
    if not rest.head(1):
        return own
    under = ancestors(rest).join(heads.select(F.col("first_id").alias("ancestor")), "ancestor", "left_semi").select("first_id")
    return own.unionByName(under).unionByName(heads.join(rest, "first_id", "left_semi").select("first_id")).distinct()


def tree_rows(inst: DataFrame, links: DataFrame) -> DataFrame:
    """(place, depth, line): the forest as indented lines; sorted by place it reads top down, children in order of start and id.

    A place is the root's start and id and the number in its tree, so no task and no driver holds a tree. A chain that
    comes back to itself has no root and isn't in the forest.
    """
    told = written(trees(inst, links))
    tops = told.filter("id = root").select("root").join(inst.select(F.col("first_id").alias("root"), F.col("start").alias("top")), "root")
    own = told.join(inst.select(F.col("first_id").alias("id"), "image", "pid"), "id").join(tops, "root")
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("image"), F.lit(" ("), F.col("pid").cast("string"), F.lit(")"))
    return own.select(F.struct("top", "root", "pre").alias("place"), "depth", line.alias("line"), "id")


def tree_text(inst: DataFrame, links: DataFrame, lines: int = 1000) -> list[str]:
    """The first lines of the forest, for a terminal."""
    return [r["line"] for r in tree_rows(inst, links).orderBy("place").limit(lines).collect()]
