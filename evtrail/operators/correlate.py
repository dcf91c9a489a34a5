"""Links between events, clusters of linked events, and what is missing (survey G2-G6, G9, G11, E1, H8, H9, I6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.network import external
from ..functions.scalars import basename, exe_anywhere, norm_host, norm_path
from ..schema import severity_rank
from ..tables import drop_written, numbered, written
from .rules import run_key

#: Windows in seconds.
PROCESS_GAP, PREFETCH_GAP, DOWNLOAD_GAP = 900, 3600, 900
KINDS = ("same-process", "same-file", "persistence-execution", "download-execution")


def started() -> Column:
    return ((F.col("source") == "sysmon") & (F.col("event_id") == "1")) | (F.col("source").isin("evtx:Security", "security") & (F.col("event_id") == "4688"))


def timed() -> Column:
    """Here only null is untimed."""
    return F.col("timestamp_original").isNotNull()


def persistence() -> Column:
    return run_key() | F.col("source").isin("tasks", "services")


def target() -> Column:
    raw = F.regexp_extract(F.coalesce("raw", F.lit("")), r'(?i)"([^"]+\.exe)"', 1)
    return F.coalesce(F.nullif(F.col("file_path"), F.lit("")), F.nullif(exe_anywhere(F.col("command_line")), F.lit("")), F.nullif(raw, F.lit("")), F.lit(""))


def prepared(events: DataFrame) -> DataFrame:
    """The columns that links are made of."""
    e = F.col
    return events.select(
        "id", "source", "event_id", "process_id", "parent_id", "dst_ip", "dst_port",
        F.unix_timestamp("timestamp").alias("s"), timed().alias("timed"), norm_host(e("host")).alias("h"), basename(e("process_name")).alias("img"),
        norm_path(e("file_path")).alias("path"), basename(e("file_path")).alias("file"), started().alias("started"), persistence().alias("persists"), target().alias("target"),
    )


def _link(kind: str, a: str, b: str, confidence: Column | int) -> list[Column]:
    return [F.lit(kind).alias("kind"), F.col(a).alias("event_a"), F.col(b).alias("event_b"), (F.lit(confidence) if isinstance(confidence, int) else confidence).cast("int").alias("confidence")]


def same_process(p: DataFrame) -> DataFrame:
    """Neighbours in time of one (host, pid, image), at most PROCESS_GAP apart."""
    w = Window.partitionBy("h", "process_id", "img").orderBy("s", "id")
    own = p.filter("timed AND h <> '' AND process_id IS NOT NULL AND img <> ''").withColumn("a", F.lag("id").over(w)).withColumn("g", F.col("s") - F.lag("s").over(w))
    return own.filter(F.col("g") <= PROCESS_GAP).select(*_link("same-process", "a", "id", 90))


def same_file(p: DataFrame) -> DataFrame:
    """All pairs of events with one path, earlier first."""
    own = p.filter("timed AND path <> ''").select("path", "s", "id")
    a, b = own.select("path", F.struct("s", "id").alias("x")), own.select("path", F.struct("s", "id").alias("y"))
    return a.join(b, "path").filter("x < y").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).select(*_link("same-file", "a", "b", 80))


def _near(left: DataFrame, right: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """left and right rows that agree in keys with low <= r_s - s <= high: equal time buckets first, then the bounds.

    The right rows stand in several buckets, the left ones in one each (_b): grouping by keys, _b and a left row's own
    columns needs no shuffle.
    """
    step = max(abs(low), abs(high), 1)
    spread = list(range(-(-abs(low) // step) * (-1 if low < 0 else 1) if low else 0, 2 if high > 0 else 1))
    other = right.withColumn("_b", F.explode(F.array(*[F.floor(F.col("r_s") / step) - d for d in spread])))
    near = left.withColumn("_b", F.floor(F.col("s") / step))
    return near.join(other, [*keys, "_b"]).filter((F.col("r_s") - F.col("s")).between(low, high))


def _prefetched(p: DataFrame) -> DataFrame:
    pf = p.filter("timed AND source = 'prefetch' AND img <> ''").select("h", "img", "s", F.col("id").alias("a"), F.col("path").alias("pa"))
    made = p.filter("timed AND started AND img <> ''").select("h", "img", F.col("s").alias("r_s"), F.col("id").alias("b"), F.col("path").alias("pb"))
    return _near(pf, made, ["h", "img"], -PREFETCH_GAP, PREFETCH_GAP).filter("a <> b")


def prefetch(p: DataFrame) -> DataFrame:
    return _prefetched(p).select(*_link("same-file", "a", "b", 65))


def persist_sides(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    keep = p.filter("timed AND persists AND target <> ''").select("h", F.col("id").alias("a"), norm_path(F.col("target")).alias("tp"), basename(F.col("target")).alias("tb"))
    ran = p.filter("timed AND (started OR source = 'prefetch') AND (img <> '' OR path <> '')").select("h", F.col("id").alias("b"), "path", F.when(F.col("img") != "", F.col("img")).otherwise(F.col("file")).alias("xb"))
    return keep, ran


def persistence_execution(p: DataFrame) -> DataFrame:
    """Two equi-joins, by base name and by whole path; the second takes only pairs that the first has not, so pairs needn't meet again."""
    keep, ran = persist_sides(p)
    keep, ran = keep.filter("tp <> '' OR tb <> ''"), ran.withColumnRenamed("h", "rh")
    here = F.col("h") == F.col("rh")
    by_name = F.coalesce((F.col("tb") != "") & (F.col("tb") == F.col("xb")), F.lit(False))
    by_path = F.coalesce((F.col("tp") != "") & (F.col("tp") == F.col("path")), F.lit(False))
    base = keep.filter("tb <> ''").join(ran, here & (F.col("tb") == F.col("xb"))).select("a", "b", F.when(by_path, 80).otherwise(60).alias("c"))
    full = keep.filter("tp <> ''").join(ran, here & (F.col("tp") == F.col("path"))).filter(~by_name).select("a", "b", F.lit(80).alias("c"))
    return base.unionByName(full).filter("a <> b").select(*_link("persistence-execution", "a", "b", F.col("c")))


def _net() -> Column:
    return F.col("timed") & (F.coalesce("dst_ip", F.lit("")) != "") & (F.col("h") != "") & F.col("process_id").isNotNull() & (F.col("img") != "")


def _starts(p: DataFrame) -> DataFrame:
    return p.filter("timed AND started AND img <> ''").select("h", F.col("img").alias("file"), F.col("s").alias("r_s"), F.col("id").alias("b"), "parent_id")


def _fetched_starts(spans: DataFrame, starts: DataFrame) -> DataFrame:
    """spans (h, file, s, upto) with the starts of that file within DOWNLOAD_GAP of any file made from s to upto, and each pair's confidence c."""
    met = _near(spans, starts, ["h", "file"], 0, 2 * DOWNLOAD_GAP).filter(F.col("r_s") <= F.col("upto") + DOWNLOAD_GAP)
    return met.withColumn("c", F.when(F.col("parent_id") == F.col("process_id"), 85).otherwise(70))


def download_execution(p: DataFrame) -> DataFrame:
    """A connection, then a file by the same process, then a process of that file's name; one link a pair.

    The files of one name that a connection explains lie within DOWNLOAD_GAP of each other, so that the times in which a
    start follows one of them are a single span, from the first file to DOWNLOAD_GAP after the last: each pair is met
    once, and no pairs are held to be told apart. Whether the connecting process is the parent doesn't depend on the file.
    """
    keys = ["h", "process_id", "img"]
    net = p.filter(_net()).select(*keys, "s", F.col("id").alias("a"))
    made = p.filter("timed AND source = 'sysmon' AND event_id = '11' AND file <> ''").select(*keys, "file", F.col("s").alias("r_s"))
    spans = _near(net, made, keys, 0, DOWNLOAD_GAP).groupBy(*keys, "_b", "a", "file").agg(F.min("r_s").alias("s"), F.max("r_s").alias("upto")).drop("_b")
    return _fetched_starts(spans, _starts(p)).select(*_link("download-execution", "a", "b", F.col("c")))


def linkages(events: DataFrame) -> DataFrame:
    """All links; of one kind and pair the first detector's stands (whole path before prefetch)."""
    p = written(prepared(events))
    parts = [same_process(p), same_file(p), prefetch(p), persistence_execution(p), download_execution(p)]
    every = reduce(DataFrame.unionByName, [x.withColumn("o", F.lit(i)) for i, x in enumerate(parts)])
    best = every.groupBy("kind", F.least("event_a", "event_b").alias("lo"), F.greatest("event_a", "event_b").alias("hi")).agg(F.min(F.struct("o", "event_a", "event_b", "confidence")).alias("m"))
    return best.select("kind", F.col("m.event_a").alias("event_a"), F.col("m.event_b").alias("event_b"), F.col("m.confidence").alias("confidence"))


CLASS = ("kind", "by", "h", "key", "left", "right", "links", "confidence", "event_a", "event_b")


def _path_classes(p: DataFrame) -> DataFrame:
    """A row for each path of several timed events: all pairs of them, earlier first."""
    own = p.filter("timed AND path <> ''").select("path", F.struct("s", "id").alias("x"))
    size = own.groupBy("path").agg(F.count("*").alias("n"), F.max("x").alias("last")).filter("n > 1")
    # The first link by (a, b): the least id that isn't the last in time, and the least id after it.
    a = own.join(size, "path").filter("x < last").groupBy("path", "n").agg(F.min(F.struct("x.id", "x")).alias("a"))
    b = own.join(a, "path").filter(F.col("x") > F.col("a.x")).groupBy("path", "n", "a").agg(F.min("x.id").alias("b"))
    n = F.col("n")
    return b.select(F.lit("same-file").alias("kind"), F.lit("path").alias("by"), F.lit(None).cast("string").alias("h"), F.col("path").alias("key"), n.alias("left"), n.alias("right"), F.expr("n * (n - 1) DIV 2").alias("links"), F.lit(80).alias("confidence"), F.col("a.id").alias("event_a"), F.col("b").alias("event_b"))


def _persistence_classes(p: DataFrame) -> DataFrame:
    """A row for each (host, path) of persisting events and those that ran, and one for each (host, base name), without the pairs whose paths agree too."""
    keep, ran = persist_sides(p)
    named = keep.filter("tb <> ''").groupBy("h", F.col("tb").alias("key"), "tp").agg(F.count("*").alias("l"), F.min("a").alias("a"))
    runs = ran.filter("xb <> ''").groupBy("h", F.col("xb").alias("key"), F.coalesce("path", F.lit("")).alias("path")).agg(F.count("*").alias("r"), F.min("b").alias("b"))
    # Of a base name's runs the first, and the first with another path, answer whatever path a target has.
    first = runs.groupBy("h", "key").agg(F.sum("r").alias("right"), F.min(F.struct("b", "path")).alias("m"))
    other = runs.join(first, ["h", "key"]).filter("path <> m.path").groupBy("h", "key").agg(F.min("b").alias("m2"))
    agree = runs.select("h", "key", F.col("path").alias("tp"), F.col("r").alias("both")).filter("tp <> ''")
    met = named.join(first, ["h", "key"]).join(other, ["h", "key"], "left").join(agree, ["h", "key", "tp"], "left")
    b = F.when((F.col("tp") != "") & (F.col("tp") == F.col("m.path")), F.col("m2")).otherwise(F.col("m.b"))
    pairs = F.col("l") * (F.col("right") - F.coalesce("both", F.lit(0)))
    link = F.when(b.isNotNull(), F.struct("a", b.alias("b")))
    by_name = met.groupBy("h", "key").agg(F.sum("l").alias("left"), F.max("right").alias("right"), F.sum(pairs).alias("links"), F.min(link).alias("f")).filter("links > 0")
    left = keep.filter("tp <> ''").groupBy("h", F.col("tp").alias("key")).agg(F.count("*").alias("left"), F.min("a").alias("a"))
    right = ran.filter("path <> ''").groupBy("h", F.col("path").alias("key")).agg(F.count("*").alias("right"), F.min("b").alias("b"))
    by_path = left.join(right, ["h", "key"]).select("h", "key", "left", "right", (F.col("left") * F.col("right")).alias("links"), F.struct("a", "b").alias("f"))
    row = lambda df, by, c: df.select(F.lit("persistence-execution").alias("kind"), F.lit(by).alias("by"), "h", "key", "left", "right", "links", F.lit(c).alias("confidence"), F.col("f.a").alias("event_a"), F.col("f.b").alias("event_b"))
    return row(by_name, "name", 60).unionByName(row(by_path, "path", 80))


def _download_classes(p: DataFrame, w: DataFrame) -> DataFrame:
    """A row for each session and confidence of its links from connections to starts, with their number and the first of them; w: points(p).

    How many starts came up to a file's time and up to DOWNLOAD_GAP after it is looked up for each file in one order of
    times. A connection's links are what lies between the first and the last of its files of a name, so they are counted
    without their pairs; the pairs of one connection for each row are made, to tell the first.
    """
    made = w.filter("made IS NOT NULL AND fetched").select("rep", "h", "process_id", F.col("made").alias("file"), F.col("s").alias("r_s")).distinct()
    ends = made.select("*", F.explode(F.array(F.struct(F.lit(False).alias("end"), (F.col("r_s") - 1).alias("t")), F.struct(F.lit(True).alias("end"), (F.col("r_s") + DOWNLOAD_GAP).alias("t")))).alias("x")).select("h", "file", F.col("process_id").alias("of"), "x.t", F.lit(0).cast("long").alias("n"), "rep", "r_s", "x.end")
    counted = _starts(p).groupBy("h", "file", F.col("parent_id").alias("of"), F.col("r_s").alias("t")).agg(F.count("*").alias("n"))
    both = counted.withColumns({"rep": F.lit(None).cast("long"), "r_s": F.lit(None).cast("long"), "end": F.lit(None).cast("boolean")}).unionByName(ends)
    # Starts of a time come before the lookups of that time: a frame by values takes both.
    upto = lambda *keys: F.sum("n").over(Window.partitionBy("h", "file", *keys).orderBy("t").rangeBetween(Window.unboundedPreceding, 0))
    found = both.withColumns({"every": upto(), "own": upto("of")}).filter("rep IS NOT NULL")
    at = lambda c, end: F.max(F.when(F.col("end") == end, F.col(c)))
    files = written(found.groupBy("rep", "h", F.col("of").alias("process_id"), "file", "r_s").agg(at("every", False).alias("e0"), at("every", True).alias("e1"), at("own", False).alias("o0"), at("own", True).alias("o1")))
    net = w.filter("net AND h <> '' AND process_id IS NOT NULL AND img <> ''").select("rep", "s", F.col("id").alias("a"))
    per = _near(net, files, ["rep"], 0, DOWNLOAD_GAP).groupBy("rep", "_b", "a", "file").agg(
        F.min(F.struct("r_s", "e0", "o0")).alias("x"), F.max(F.struct("r_s", "e1", "o1")).alias("y"))
    own = F.col("y.o1") - F.col("x.o0")
    per = per.select("rep", "a", F.explode(F.array(F.struct(F.lit(85).alias("c"), own.alias("n")), F.struct(F.lit(70).alias("c"), (F.col("y.e1") - F.col("x.e0") - own).alias("n")))).alias("z")).select("rep", "a", "z.*").filter("n > 0")
    classes = written(per.groupBy("rep", "c").agg(F.sum("n").alias("links"), F.min("a").alias("a")))
    first = classes.select("rep", "c", "a").join(net.select("a", "s"), "a").select("rep", F.col("c").alias("want"), "a", "s")
    spans = written(_near(first, files, ["rep"], 0, DOWNLOAD_GAP).groupBy("rep", "want", "a", "h", "process_id", "file").agg(F.min("r_s").alias("s"), F.max("r_s").alias("upto")))
    firsts = _fetched_starts(spans, _starts(p)).filter("c = want").groupBy("rep", "c").agg(F.min("b").alias("b"))
    none = F.lit(None)
    return classes.join(firsts, ["rep", "c"]).select(
        F.lit("download-execution").alias("kind"), F.lit("download").alias("by"), none.cast("string").alias("h"), none.cast("string").alias("key"), none.cast("long").alias("left"), none.cast("long").alias("right"),
        "links", F.col("c").alias("confidence"), F.col("a").alias("event_a"), F.col("b").alias("event_b"))


def link_classes(p: DataFrame) -> DataFrame:
    """All links of prepared events without their pairs: a row for each class (columns CLASS), with its exact number of links and the first of them.

    Events of one path, and persisting events with what ran of their target's name or path, are all linked to each
    other: their classes have counts alone, so their rows grow with the events, not with the pairs. So do neighbours in a
    session and links from its connections, a row for each session, and links from prefetch entries, a row for each; of
    these left and right aren't told. A persisting event is never one that ran, so no pair is counted twice.
    """
    w = written(points(p))
    past = Window.partitionBy("rep").orderBy("s", "id")
    pairs = w.filter("run").withColumn("a", F.lag("id").over(past)).filter("a IS NOT NULL").select("rep", "a", F.col("id").alias("b"))
    near = _prefetched(p).filter(~F.coalesce((F.col("pa") != "") & (F.col("pa") == F.col("pb")), F.lit(False))).select(F.col("a").alias("rep"), "a", "b")
    text, long_ = F.lit(None).cast("string"), F.lit(None).cast("long")
    single = [
        x.groupBy("rep").agg(F.count("*").alias("links"), F.min(F.struct("a", "b")).alias("f")).select(F.lit(kind).alias("kind"), F.lit(by).alias("by"), text.alias("h"), text.alias("key"), long_.alias("left"), long_.alias("right"), "links", F.lit(c).alias("confidence"), F.col("f.a").alias("event_a"), F.col("f.b").alias("event_b"))
        for x, kind, by, c in ((pairs, "same-process", "neighbours", 90), (near, "same-file", "prefetch", 65))
    ]
    return reduce(DataFrame.unionByName, [_path_classes(p), _persistence_classes(p), *single, _download_classes(p, w)])


def cluster_links(events: DataFrame, members: DataFrame, root: int) -> DataFrame:
    """The links of one cluster, pair by pair: no link leads out of it, so its events alone are asked."""
    return linkages(events.join(members.filter(F.col("root") == root).select("id"), "id", "left_semi"))


def points(p: DataFrame) -> DataFrame:
    """A row for each timed prepared event that a link may have: what it is to links, and rep, the least event of its session.

    A session is a run of one (host, pid, image) with no gap over PROCESS_GAP, so that its events are all connected;
    run tells sessions of several events, and any other event is its own rep. fetched: the session had a connection at
    most DOWNLOAD_GAP before. A connection and a file that it explains are of one session.
    """
    e = F.col
    keeps = e("persists") & (e("target") != "")
    runs = (e("started") | (e("source") == "prefetch")) & ((e("img") != "") | (e("path") != ""))
    some = lambda c, when: F.when(when & (c != ""), c)
    own = p.filter("timed").select(
        "id", "s", "h", "process_id", "img", some(e("path"), F.lit(True)).alias("path"),
        some(e("file"), (e("source") == "sysmon") & (e("event_id") == "11")).alias("made"), some(norm_path(e("target")), keeps).alias("tp"), some(basename(e("target")), keeps).alias("tb"),
        some(e("file"), runs & (F.coalesce("img", F.lit("")) == "")).alias("named"), F.coalesce(F.coalesce("dst_ip", F.lit("")) != "", F.lit(False)).alias("net"), F.coalesce("started", F.lit(False)).alias("started"), F.coalesce(e("source") == "prefetch", F.lit(False)).alias("pf"), F.coalesce(runs, F.lit(False)).alias("runs"),
    )
    process = F.coalesce((e("h") != "") & e("process_id").isNotNull() & (e("img") != ""), F.lit(False))
    keys = ["h", "process_id", "img"]
    past = Window.partitionBy(*keys).orderBy("s", "id")
    upto = Window.partitionBy(*keys).orderBy("s").rangeBetween(Window.unboundedPreceding, 0)
    run = Window.partitionBy(*keys, "_n")
    begins = F.when(e("s") - F.lag("s").over(past) <= PROCESS_GAP, 0).otherwise(1)
    many = own.filter(process).withColumn("_b", begins).withColumn("_n", F.sum("_b").over(past.rowsBetween(Window.unboundedPreceding, 0)))
    many = many.withColumn("fetched", F.coalesce(e("s") - F.max(F.when(e("net"), e("s"))).over(upto) <= DOWNLOAD_GAP, F.lit(False)))
    many = many.withColumns({"rep": F.min("id").over(run), "run": F.count("*").over(run) > 1}).drop("_b", "_n")
    alone = own.filter(~process & (e("path").isNotNull() | e("tp").isNotNull() | e("tb").isNotNull() | e("runs")))
    return many.unionByName(alone.withColumns({"fetched": F.lit(False), "rep": e("id"), "run": F.lit(False)}))


def _group_edges(w: DataFrame) -> DataFrame:
    """(rep, hub) of the groups that are all linked: of one path, and of a target and what ran by its path or name. A hub is the least member of the other side."""
    of = lambda kind, h, key, left, rows=w: rows.select(F.lit(kind).alias("kind"), h.alias("h"), F.col(key).alias("key"), F.lit(left).alias("left"), "rep").filter("key IS NOT NULL AND h IS NOT NULL")
    h, ran = F.col("h"), w.filter("runs").withColumn("xb", F.when(F.col("img") != "", F.col("img")).otherwise(F.col("named")))
    every = reduce(DataFrame.unionByName, [of("path", F.lit(""), "path", True), of("whole", h, "tp", True), of("whole", h, "path", False, ran), of("name", h, "tb", True), of("name", h, "xb", False, ran)])
    on = ["kind", "h", "key"]
    side = lambda f, left: f(F.when(F.col("left") == left, F.col("rep")))
    both = every.groupBy(*on).agg(side(F.min, True).alias("a0"), side(F.max, True).alias("a1"), side(F.min, False).alias("b0"))
    hubs = both.select(*on, F.explode(F.when(F.col("kind") == "path", F.when(F.col("a0") < F.col("a1"), F.array(F.struct(F.lit(True).alias("left"), F.col("a0").alias("hub"))))).when(F.col("a0").isNotNull() & F.col("b0").isNotNull(), F.array(F.struct(F.lit(True).alias("left"), F.col("b0").alias("hub")), F.struct(F.lit(False).alias("left"), F.col("a0").alias("hub"))))).alias("x")).select(*on, "x.*")
    # Written, so that Spark knows its size: where groups are few and large, their members aren't shuffled.
    return every.join(written(hubs), [*on, "left"]).select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()


def _ends(rows: DataFrame, key: str, width: int, right: bool) -> DataFrame:
    """The first and last time of each rep within a stretch of time. Two stretches of width meet within width by these, if by any of their times."""
    ends = rows.filter("s IS NOT NULL AND h IS NOT NULL").groupBy("h", F.col(key).alias("key"), F.floor(F.col("s") / width).alias("k"), "rep").agg(F.array_distinct(F.array(F.min("s"), F.max("s"))).alias("t"))
    return ends.select("h", "key", "rep", F.explode("t").alias("s"), F.lit(right).alias("right"))


def _neighbours(rows: DataFrame, width: int, both_ways: bool) -> DataFrame:
    """(a, b): fewer pairs that connect what all pairs of a left and a right row at most width apart connect (right after left, unless both_ways).

    Rows stand in their own stretch of time and the one after, so that any two within width share one. There each row
    meets the nearest ones of the other side. Where only what follows counts, a right row also meets the left row that
    the right row before it met, so that rows that one left row reaches stay together when another stands between.
    """
    k = F.floor(F.col("s") / width)
    dealt = rows.withColumn("_k", F.explode(F.array(k, k + 1)))
    part, me = Window.partitionBy("h", "key", "_k"), F.struct("s", "rep")
    upto, onward = (part.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (("s", "right", "rep"), (F.desc("s"), F.desc("right"), F.desc("rep"))))
    seen = lambda right, w: F.last(F.when(F.col("right") == right, me), True).over(w)
    met = dealt.withColumns({"x": seen(False, upto), "y": seen(True, onward)} | ({"z": seen(True, upto), "v": seen(False, onward)} if both_ways else {}))
    if not both_ways:
        met = met.withColumn("z", F.last(F.when(F.col("right"), F.col("x")), True).over(upto.rowsBetween(Window.unboundedPreceding, -1)))
    asked = [(True, "x"), (False, "y"), *([(False, "z"), (True, "v")] if both_ways else [(True, "z")])]
    near = F.array(*[F.when((F.col("right") == right) & (F.abs(F.col(f"{c}.s") - F.col("s")) <= width), F.col(f"{c}.rep")) for right, c in asked])
    return met.select(F.col("rep").alias("a"), F.explode(F.array_compact(near)).alias("b")).filter("a <> b")


def point_edges(w: DataFrame) -> DataFrame:
    """(a, b): what connects points in time: sessions, prefetch entries with starts, and files with the starts that they explain."""
    ran = w.filter("started AND img <> ''")
    entries = w.filter("pf AND img <> '' AND s IS NOT NULL AND h IS NOT NULL").select("h", F.col("img").alias("key"), "rep", "s", F.lit(False).alias("right"))
    prefetched = _neighbours(entries.unionByName(_ends(ran, "img", PREFETCH_GAP, True)), PREFETCH_GAP, True)
    fetched = _neighbours(_ends(w.filter("made IS NOT NULL AND fetched"), "made", DOWNLOAD_GAP, False).unionByName(_ends(ran, "img", DOWNLOAD_GAP, True)), DOWNLOAD_GAP, False)
    return w.filter("run AND id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).unionByName(prefetched).unionByName(fetched)


def star_edges(events: DataFrame) -> DataFrame:
    """(a, b): fewer links that connect what linkages() connects, at most a few for each event however dense its links are. b is the hub where one side is."""
    p = written(prepared(events))
    w = written(points(p))
    drop_written(p)
    return point_edges(w).unionByName(_group_edges(w))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id that each id of edges (a, b) reaches.

    Each a is first joined to its least b. Only what stands as b, and the edges between these, take part in the rounds:
    where edges lead from members to hubs, that is the hubs alone.
    """
    own = Window.partitionBy("a").orderBy("b")
    e = written(edges.filter("a <> b").select("a", "b", F.first("b").over(own).alias("m"), (F.row_number().over(own) == 1).alias("one")))
    ones = e.filter("one").select(F.col("a").alias("id"), "m")
    hubs = written(e.select(F.col("b").alias("id")).distinct())
    between = e.filter("b <> m").select(F.col("m").alias("a"), "b").unionByName(ones.join(hubs, "id", "left_semi").select(F.col("id").alias("a"), F.col("m").alias("b")))
    least = ones.groupBy(F.col("m").alias("id")).agg(F.min("id").alias("low"))
    stars = hubs.join(_rounds(between), "id", "left").join(least, "id", "left").select("id", F.coalesce("root", "id").alias("star"), F.least("id", "low").alias("low"))
    stars = written(stars)
    roots = written(stars.join(stars.groupBy("star").agg(F.min("low").alias("root")), "star").select("id", "root"))
    out = written(ones.join(hubs, "id", "left_anti").join(roots.withColumnRenamed("id", "m"), "m").select("id", "root").unionByName(roots))
    drop_written(e, hubs, stars, roots)
    return out


def _rounds(edges: DataFrame) -> DataFrame:
    """(id, root) as components() gives them: stars are joined in alternation until nothing changes."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        wide = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        near = wide.join(wide.groupBy("a").agg(F.min("b").alias("m")), "a")
        last, now = now, written(near.select("a", F.col("m").alias("b")).unionByName(near.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        drop_written(last)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            roots = now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
        before = state


def clusters(events: DataFrame) -> DataFrame:
    """(id, root) of every event that is linked to another."""
    return components(star_edges(events))


def attached(findings: DataFrame, members: DataFrame, events: DataFrame) -> DataFrame:
    """finding (any columns with evidence), root of the cluster with most of its evidence; of equals the one whose first event is first."""
    first = members.join(events.select("id", "timestamp"), "id").groupBy("root").agg(F.min(F.struct("timestamp", "id")).alias("f"))
    keyed = findings.withColumn("_k", F.concat_ws(":", "rule_id", "event_id"))
    held = keyed.select("_k", F.explode(F.array_distinct("evidence")).alias("id")).join(members, "id").groupBy("_k", "root").agg(F.count("*").alias("n"))
    best = held.join(first, "root").groupBy("_k").agg(F.min(F.struct(-F.col("n"), "f", "root")).alias("b"))
    return keyed.join(best.select("_k", F.col("b.root").alias("root")), "_k", "left").drop("_k")


def ranked(events: DataFrame, findings: DataFrame, members: DataFrame) -> DataFrame:
    """cluster_id from 0 by worst severity, number of findings, size, first event."""
    size = members.join(events.select("id", "timestamp"), "id").groupBy("root").agg(F.count("*").alias("events"), F.min(F.struct("timestamp", "id")).alias("f"))
    own = attached(findings, members, events).filter("root IS NOT NULL").groupBy("root").agg(F.count("*").alias("findings"), F.max(severity_rank(F.col("severity"))).alias("worst"))
    both = size.join(own, "root", "left").select("root", "events", F.coalesce("findings", F.lit(0)).cast("long").alias("findings"), F.coalesce("worst", F.lit(-1)).cast("int").alias("worst"), "f")
    order = [F.desc("worst"), F.desc("findings"), F.desc("events"), F.asc("f.timestamp"), F.asc("f.id")]
    return numbered(both, "cluster_id", order, 0).select("cluster_id", "root", "events", "findings", "worst")


def confidence(links: DataFrame, members: DataFrame) -> DataFrame:
    """root, confidence of the weakest link, and that link; of equals the first by (a, b, kind). links: linkages() or link_classes()."""
    own = links.join(members.withColumnRenamed("id", "event_a"), "event_a")
    return own.groupBy("root").agg(F.min(F.struct("confidence", "event_a", "event_b", "kind")).alias("w")).select("root", "w.confidence", F.col("w.event_a").alias("event_a"), F.col("w.event_b").alias("event_b"), F.col("w.kind").alias("kind"))


def stats(classes: DataFrame) -> DataFrame:
    """(kind, n): links of each kind."""
    return classes.groupBy("kind").agg(F.sum("links").alias("n"))


def executed(events: DataFrame) -> DataFrame:
    return events.filter(started() | (F.col("source") == "prefetch")).select(basename(F.col("process_name")).alias("base")).filter("base <> ''").distinct()


def missing_prefetch(asked: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Images that asked events started without a prefetch entry in every event (by default the asked ones), if there is prefetch data at all."""
    case = asked if every is None else every
    traces = case.filter("source = 'prefetch'")
    seen = traces.select(basename(F.col("process_name")).alias("base")).filter("base <> ''").distinct()
    own = asked.filter(started()).select(basename(F.col("process_name")).alias("base")).filter("base <> ''").distinct()
    any_ = traces.agg((F.count("*") > 0).alias("any"))
    return own.join(seen, "base", "left_anti").join(F.broadcast(any_.filter("any")), how="left_semi", on=F.lit(True)).select("base")


def missing_persist(asked: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Targets of asked persistence events that no event of the case has run."""
    own = asked.filter(persistence()).select(target().alias("target")).distinct().withColumn("base", basename(F.col("target"))).filter("base <> ''")
    return own.join(executed(asked if every is None else every), "base", "left_anti").select("target")


def missing_file(asked: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Files that asked events made and no event of the case has run."""
    own = asked.filter("source = 'sysmon' AND event_id = '11'").select("file_path").distinct().withColumn("base", basename(F.col("file_path"))).filter("base <> ''")
    return own.join(executed(asked if every is None else every), "base", "left_anti").select("file_path")


def missing_network(asked: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """External connections of asked events with no file or start of any event on their host in the next quarter of an hour.

    Time is cut into quarters of an hour, and files and starts are shown to their own and to the one before: the next
    of a connection is found by a window for each host and quarter, so no task holds all events of a host.
    """
    h, s = norm_host(F.col("host")), F.unix_timestamp("timestamp")
    follow = timed() & ((F.coalesce("file_path", F.lit("")) != "") | started())
    q = F.floor(s / DOWNLOAD_GAP)
    address, nothing = F.nullif("dst_ip", F.lit("")), F.lit(None)
    if every is None:
        own = asked.select("id", h.alias("h"), s.alias("s"), address.alias("dst_ip"), "dst_port", F.when(follow, s).alias("f"), q.alias("q"))
    else:
        met = every.filter(follow).select("id", h.alias("h"), s.alias("s"), nothing.cast("string").alias("dst_ip"), nothing.cast("int").alias("dst_port"), s.alias("f"), q.alias("q"))
        own = asked.select("id", h.alias("h"), s.alias("s"), address.alias("dst_ip"), "dst_port", nothing.cast("long").alias("f"), q.alias("q")).unionByName(met)
    own = own.filter("dst_ip IS NOT NULL OR f IS NOT NULL")
    both = own.withColumn("back", F.explode(F.when(F.col("f").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    # From the latest back: a frame that only grows is one running minimum.
    w = Window.partitionBy("h", "quarter").orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("quarter", F.col("q") - F.col("back")).withColumn("next", F.min("f").over(w)).filter("dst_ip IS NOT NULL AND back = 0")
    late = out.filter(F.col("next").isNull() | (F.col("next") - F.col("s") > DOWNLOAD_GAP))
    return late.filter(external(F.col("dst_ip"), strict=False)).select("id", F.concat(F.col("dst_ip"), F.lit(":"), F.coalesce(F.nullif("dst_port", F.lit(0)).cast("string"), F.lit("?"))).alias("dst"))
