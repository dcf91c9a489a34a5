"""Detection rules: each turns events into rows of findings (survey D1-D10, C5, C7-C10)."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from importlib import metadata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.network import external
from ..schema import SEVERITIES, iso, severity_rank
from ..tables import numbered as number_rows
from ..tables import written

#: Fixed values.
DOWNLOADS = (
    r"(?i)\bInvoke-WebRequest\b|\bIWR\b",
    r"(?i)\bInvoke-RestMethod\b|\bIRM\b",
    r"(?i)Net\.WebClient",
    r"(?i)DownloadString|DownloadFile",
    r"(?i)\bbitsadmin\b.*\btransfer\b|\bStart-BitsTransfer\b",
    r"(?i)\bcertutil\b.*\burlcache\b",
    r"(?i)\bcurl(\.exe)?\b.*\s-[oO]\b|\bwget(\.exe)?\b",
)
OFFICE = ("winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "mspub.exe", "visio.exe", "winproj.exe", "onenote.exe", "msaccess.exe")
SHELLS = ("powershell.exe", "pwsh.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe", "regsvr32.exe", "wmic.exe")
RUN_KEY = r"(?i)\\Run(Once)?(\\|$)"
COMMON_PORTS = (20, 21, 22, 23, 25, 53, 67, 68, 69, 80, 88, 110, 115, 119, 123, 135, 139, 143, 161, 162, 389, 443, 445, 464, 500, 514, 515, 554, 587, 636, 993, 995, 1194, 1433, 1723, 1935, 3306, 3389, 4500, 5060, 5061, 5432, 5900, 5985, 5986, 6379, 8000, 8080, 8443, 9200, 27017)
BURST, BURST_SECONDS = 5, 600

By = tuple[str, ...]
FINDING = "rule_id string, severity string, confidence int, event_id bigint, detail string, evidence array<bigint>"


def started() -> Column:
    """A process creation, as rules see it."""
    return ((F.col("source") == "sysmon") & (F.col("event_id") == "1")) | ((F.col("source") == "evtx:Security") & (F.col("event_id") == "4688"))


def run_key() -> Column:
    named = (F.col("source") == "registry") & (F.col("event_id") == "run-key")
    return named | (F.col("source") == "sysmon") & F.col("event_id").isin("12", "13", "14") & F.coalesce(F.col("registry_key"), F.lit("")).rlike(RUN_KEY)


def _rows(df: DataFrame, rule: Rule, detail: Column, severity: Column | None = None, confidence: Column | None = None, evidence: Column | None = None, by: By = ()) -> DataFrame:
    return df.select(
        *by,
        F.lit(rule.id).alias("rule_id"),
        (F.lit(rule.severity) if severity is None else severity).alias("severity"),
        (F.lit(rule.confidence) if confidence is None else confidence).cast("int").alias("confidence"),
        F.col("id").alias("event_id"),
        detail.alias("detail"),
        (F.array("id") if evidence is None else evidence).alias("evidence"),
    )


@dataclass(frozen=True)
class Rule:
    """A rule's standing facts and how it evaluates; needs: (source, event_id) of which any makes it applicable.

    evaluate gives findings from all events; a rule that looks at one event at a time has test instead, which gives the
    finding's detail, null for no finding. Where events of several cases are at hand, by names the columns that tell
    them apart: evaluate then gets them as third argument, keeps to one case for each finding and returns them first.
    """

    id: str
    title: str
    severity: str
    confidence: int
    mitre: tuple[str, ...]
    needs: tuple[tuple[str, str], ...]
    evaluate: Callable[..., DataFrame] | None = None
    test: Callable[[], Column] | None = None
    version: str = "1"

    def findings(self, events: DataFrame, by: By = ()) -> DataFrame:
        if self.test is not None:
            return _tested(events, [self], by)
        return self.evaluate(events, self, by) if by else self.evaluate(events, self)


def powershell() -> Column:
    return started() & S.basename(F.col("process_name")).isin("powershell.exe", "pwsh.exe")


def _encoded() -> Column:
    hit = F.array_contains(F.coalesce("flags", F.array().cast("array<string>")), "encoded-command") | F.coalesce(F.col("command_line"), F.lit("")).rlike(S.ENCODED)
    return F.when(powershell() & hit, F.coalesce("command_line", F.lit("")))


def first_download(text: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in DOWNLOADS])


def _download() -> Column:
    """Script blocks, of which raw holds the whole and the command line the beginning, and PowerShell's own command lines.

    raw of a process creation has all its fields, those of its parent too, and isn't read.
    """
    script = (F.col("source") == "powershell") & F.col("event_id").isin("4104", "4103")
    return F.when(script | powershell(), first_download(F.concat_ws("\n", "command_line", F.when(script, F.col("raw")))))


def _office() -> Column:
    parent, child = S.basename(F.col("parent_name")), S.basename(F.col("process_name"))
    return F.when(started() & parent.isin(*OFFICE) & child.isin(*SHELLS), F.concat(parent, F.lit(" > "), child))


def rule_target() -> Column:
    """What a persistence event points at, as rules read it: the command line first."""
    command = S.exe_anywhere(F.col("command_line"))
    raw = F.regexp_extract(F.coalesce("raw", F.lit("")), r'(?i)"([^"]+\.exe)"', 1)
    return F.coalesce(F.nullif(command, F.lit("")), F.nullif(F.col("file_path"), F.lit("")), F.nullif(raw, F.lit("")), F.lit(""))


def executed(e: DataFrame, by: By = ()) -> DataFrame:
    """Distinct image names of process creations and prefetch entries."""
    name = S.basename(F.col("process_name"))
    return e.filter(started() | (F.col("source") == "prefetch")).select(*by, name.alias("image")).filter("image <> ''").distinct()


def _run_key(e: DataFrame, rule: Rule, by: By = ()) -> DataFrame:
    own = e.filter(run_key()).withColumn("_t", rule_target()).select(*by, "id", "_t", S.basename(F.col("_t")).alias("image"))
    # Spark broadcasts the images only if they turn out small.
    seen = own.join(executed(e, by).withColumn("_r", F.lit(True)), [*by, "image"], "left")
    ran = F.coalesce("_r", F.lit(False))
    return _rows(seen, rule, F.col("_t"), F.when(ran, "high").otherwise("medium"), F.when(ran, 85).otherwise(60), by=by)


def _writable(source: str) -> Callable[[], Column]:
    return lambda: F.when((F.col("source") == source) & F.coalesce("file_path", F.lit("")).rlike(S.WRITABLE), F.col("file_path"))


def _rare_port() -> Column:
    rare = (F.col("source") == "sysmon") & (F.col("event_id") == "3") & F.col("dst_port").isNotNull() & ~F.col("dst_port").isin(*COMMON_PORTS)
    # Python is asked about IPv6 addresses of such connections only.
    return F.when(external(F.when(rare, F.col("dst_ip"))), F.concat(F.col("dst_ip"), F.lit(":"), F.col("dst_port").cast("string")))


def _burst(e: DataFrame, rule: Rule, by: By = ()) -> DataFrame:
    """Each (user, address)'s densest window of failed logons; of equal ones the earliest. Unknown users and addresses count as "?".

    The window that ends at an event holds those of the seconds before it and, of its own second, those up to it.
    Logons are counted by second before the window, so that a group is as long as its seconds, however many logons.
    """
    fails = e.filter((F.col("source") == "evtx:Security") & (F.col("event_id") == "4625")).select(*by, "id", F.unix_timestamp("timestamp").alias("_s"), F.coalesce(F.nullif("user", F.lit("")), F.lit("?")).alias("_u"), F.coalesce(F.nullif("src_ip", F.lit("")), F.lit("?")).alias("_a"))
    keys = [*by, "_u", "_a"]
    back = Window.partitionBy(*keys).orderBy("_s").rangeBetween(-BURST_SECONDS, 0)
    counted = fails.groupBy(*keys, "_s").agg(F.count("*").alias("_c")).withColumn("_n", F.sum("_c").over(back))
    best = counted.groupBy(*keys).agg(F.max(F.struct("_n", -F.col("_s"))).alias("b")).filter(F.col("b._n") >= BURST)
    # Only members of the winning window are gathered, one window a group.
    member = fails.join(best, keys).filter((F.col("_s") <= -F.col("b.col2")) & (F.col("_s") >= -F.col("b.col2") - BURST_SECONDS))
    found = member.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_s", "id"))), lambda x: x["id"]).alias("ids"))
    own = found.select(*by, F.element_at("ids", 1).alias("id"), F.concat(F.col("_u"), F.lit(" from "), F.col("_a"), F.lit(": "), F.size("ids").cast("string")).alias("d"), "ids")
    return _rows(own, rule, F.col("d"), evidence=F.col("ids"), by=by)


def _admin_host(e: DataFrame, rule: Rule, by: By = ()) -> DataFrame:
    """The first logon of an admin-like user from each address but the user's first.

    Only each pair's first logon is compared with the others, so a user's history is as long as its addresses.
    """
    address = S.blank(F.col("src_ip"))
    own = e.filter((F.col("source") == "evtx:Security") & (F.col("event_id") == "4624") & S.admin_like(F.coalesce("user", F.lit("?"))) & address.isNotNull()).select(*by, "id", "timestamp", "user", address.alias("_a"))
    first = own.groupBy(*by, "user", "_a").agg(F.min(F.struct("timestamp", "id")).alias("f"))
    before = Window.partitionBy(*by, "user").orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    known = first.withColumn("_k", F.array_sort(F.collect_set("_a").over(before))).filter(F.size("_k") > 0)
    return _rows(known.select(*by, F.col("f.id").alias("id"), F.concat(F.col("user"), F.lit(" from "), F.col("_a"), F.lit(", before: "), F.array_join("_k", ", ")).alias("d")), rule, F.col("d"), by=by)


def _temp_exec() -> Column:
    exe = S.exe_first_token(F.col("command_line"))
    return F.when(started() & exe.rlike(S.WRITABLE), exe)


_START = (("sysmon", "1"), ("evtx:Security", "4688"))
RULES = (
    Rule("EV-DET-ADMINHOST", "Admin account from an address not seen before", "low", 45, ("T1078",), (("evtx:Security", "4624"),), _admin_host),
    Rule("EV-DET-BRUTE", "Burst of failed logons", "medium", 60, ("T1110",), (("evtx:Security", "4625"),), _burst),
    Rule("EV-DET-DLPSH", "PowerShell fetches remote content", "high", 75, ("T1105",), (*_START, ("powershell", "4104"), ("powershell", "4103")), test=_download),
    Rule("EV-DET-ENCPSH", "PowerShell with an encoded command", "high", 80, ("T1059.001",), _START, test=_encoded),
    Rule("EV-DET-OFFICE", "Office program starts a shell", "high", 70, ("T1204.002",), _START, test=_office),
    Rule("EV-DET-RAREPORT", "Connection to an uncommon external port", "low", 40, ("T1571",), (("sysmon", "3"),), test=_rare_port),
    Rule("EV-DET-RUNKEY", "Program set to run at logon", "medium", 60, ("T1547.001",), (("registry", "run-key"), ("sysmon", "12"), ("sysmon", "13"), ("sysmon", "14")), _run_key),
    Rule("EV-DET-SVC", "Service in a writable folder", "high", 80, ("T1543.003",), (("services", "service"),), test=_writable("services")),
    Rule("EV-DET-TASK", "Task in a writable folder", "medium", 60, ("T1053.005",), (("tasks", "task"),), test=_writable("tasks")),
    Rule("EV-DET-TEMPEXEC", "Program run from a writable folder", "medium", 65, ("T1204.002",), _START, test=_temp_exec),
)
BY_ID = {r.id: r for r in RULES}
#: Entry points that add rules: each is a Rule, or gives one when called.
ENTRY_POINTS = "evtrail.rules"
_added: dict[str, Rule] = {}


def register(rule: Rule) -> None:
    """Adds a rule to those of this process."""
    if any(r.id == rule.id for r in every_rule()):
        raise ValueError(f"the rule {rule.id} is there already")
    _added[rule.id] = rule


def discover() -> list[str]:
    """Adds the rules that installed packages offer; those that can't be loaded are left out. Returns the ids of new ones."""
    before = set(_added)
    for point in metadata.entry_points(group=ENTRY_POINTS):
        try:
            offered = point.load()
            register(offered if isinstance(offered, Rule) else offered())
        except Exception as fault:  # noqa: BLE001 - another package's fault
            logging.getLogger(__name__).warning("rule %s: %s", point.name, fault)
    return sorted(set(_added) - before)


def every_rule() -> list[Rule]:
    return [*RULES, *_added.values()]


def select_rules(ids: list[str] | None = None) -> list[Rule]:
    known = {r.id: r for r in every_rule()}
    if ids is None:
        return list(known.values())
    if unknown := [i for i in ids if i not in known]:
        raise ValueError(f"unknown rules: {', '.join(unknown)}")
    return [known[i] for i in ids]


def _tested(events: DataFrame, own: list[Rule], by: By = ()) -> DataFrame:
    """The findings of all rules that look at one event at a time: each event is read once and tested by all of them."""
    hits = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"), r.test().alias("detail")) for r in own])
    found = events.select(*by, "id", F.explode(F.filter(hits, lambda h: h["detail"].isNotNull())).alias("h"))
    return found.select(*by, "h.rule_id", "h.severity", "h.confidence", F.col("id").alias("event_id"), "h.detail", F.array("id").alias("evidence"))


def detect(events: DataFrame, ids: list[str] | None = None, at_least: str | None = None, by: By = ()) -> DataFrame:
    """Findings of the rules. One scan serves all rules on single events; each rule on several events has its own.

    by: columns that tell cases apart; each is searched by itself, all in one plan.
    """
    chosen = select_rules(ids)
    tested = [r for r in chosen if r.test is not None]
    parts = [_tested(events, tested, by)] if tested else []
    out = reduce(DataFrame.unionByName, [*parts, *(r.findings(events, by) for r in chosen if r.evaluate is not None)])
    if at_least is not None:
        out = out.filter(severity_rank(F.col("severity")) >= SEVERITIES.index(at_least.lower()))
    return out


def numbered(findings: DataFrame, taken: int = 0) -> DataFrame:
    """findings with uid EV-0001, ...: by severity from the top, rule, event."""
    order = [F.desc(severity_rank(F.col("severity"))), F.asc("rule_id"), F.asc("event_id"), F.asc("detail")]
    return number_rows(findings, "_n", order, taken + 1).withColumn("uid", F.format_string("EV-%04d", "_n")).drop("_n")


#: Of each rule: why it fired, what it says, what was seen, what that may mean, and what its confidence rests on. {x} is filled in.
TEXTS = {
    "EV-DET-ADMINHOST": ("A logon of {user}, an admin-like name, came from an address that its history doesn't hold.", "{user} logged on to {host} from a new address: {detail}.", "Logon event {event_id} at {time}: {detail}.", "The account's secret may be used from elsewhere; a new workstation would look the same.", "Only the history in this case is known, and admins do move."),
    "EV-DET-BRUTE": ("At least 5 failed logons of one user and address within 600 seconds.", "Burst of failed logons on {host}: {detail}.", "{n} failed logons, the first at {time}.", "Passwords may have been guessed; a stale saved password would look the same.", "A count within a window, without a look at what followed."),
    "EV-DET-DLPSH": ("PowerShell's text matches a download pattern: {detail}.", "PowerShell on {host} has a call that fetches remote content ({detail}).", "The text {detail} stands in event {event_id} at {time}.", "A payload may have been fetched; installers and updaters do the same.", "The pattern is specific, its use isn't."),
    "EV-DET-ENCPSH": ("PowerShell was started with a switch for an encoded command.", "PowerShell on {host} ran an encoded command: {detail}", "Such a switch stands in the command line of event {event_id} at {time}.", "The command's wording may have been hidden from readers; management tools encode commands too.", "The switch is unambiguous; what it ran isn't known from it."),
    "EV-DET-OFFICE": ("An Office program is the parent of a shell or script host: {detail}.", "On {host} an Office program started a shell ({detail}).", "Parent and child of event {event_id} at {time}: {detail}.", "A document may have run code; some add-ins do.", "Few ordinary documents start a shell."),
    "EV-DET-RAREPORT": ("An external address was reached at a port that is not a common one: {detail}.", "{process} on {host} connected to {detail}.", "Connection event {event_id} at {time} to {detail}.", "A control channel may use such a port; so do games and odd services.", "The port alone is weak evidence."),
    "EV-DET-RUNKEY": ("A Run key names a program to start at logon: {detail}.", "{detail} is set to run at logon on {host}.", "Run-key event {event_id} at {time} names {detail}.", "The program may persist by it; much software does.", "Higher where an event shows that the program has run."),
    "EV-DET-SVC": ("A service's binary lies where ordinary users may write: {detail}.", "A service on {host} runs {detail}.", "Service record {event_id} names {detail}.", "Someone without rights may have placed it; some vendors do so too.", "The folder is writable by default settings."),
    "EV-DET-TASK": ("A task's program lies where ordinary users may write: {detail}.", "A task on {host} runs {detail}.", "Task record {event_id} names {detail}.", "It may persist from there; installers leave such tasks too.", "The folder is writable by default settings."),
    "EV-DET-TEMPEXEC": ("A process was started from a folder where ordinary users may write: {detail}.", "{detail} ran on {host}.", "Start event {event_id} at {time} has {detail} as its program.", "A dropped program may have run; installers unpack to such folders.", "Seen in its command line, which can be forged."),
}
#: Of each rule: what it can't see.
LIMITS = {
    "EV-DET-ADMINHOST": "Logons before the first record of the case aren't known.",
    "EV-DET-BRUTE": "Slower guesses, and guesses spread over many users, aren't counted.",
    "EV-DET-DLPSH": "Commands that are put together while they run aren't recognised.",
    "EV-DET-ENCPSH": "The encoded text isn't decoded.",
    "EV-DET-OFFICE": "A shell that is started through another program isn't seen.",
    "EV-DET-RAREPORT": "Control channels at common ports aren't seen.",
    "EV-DET-RUNKEY": "Whether the value is new isn't known.",
    "EV-DET-SVC": "Folders that were made writable on this host aren't known.",
    "EV-DET-TASK": "Folders that were made writable on this host aren't known.",
    "EV-DET-TEMPEXEC": "Programs that were moved before they ran aren't seen.",
}
EXPLAINED = ("title", "why", "what", "observed", "inferred", "confidence_reason", "mitre", "provenance", "rule_version", "limitations", "evidence_refs")


def _referred(findings: DataFrame, events: DataFrame, by: By) -> DataFrame:
    """findings with evidence_refs: of each event in evidence its id, source, id there and what it shows, in the order of evidence."""
    from .query import event_line

    # Written with its numbers, which must be the same in both uses.
    numbered_ = written(findings.withColumn("_n", F.monotonically_increasing_id()))
    shown = events.select(*by, F.col("id").alias("_e"), F.struct(F.col("id").alias("event_id"), "source", F.col("event_id").alias("source_event_id"), event_line().alias("observation")).alias("_r"))
    asked = numbered_.select(*by, "_n", F.posexplode("evidence").alias("_at", "_e"))
    refs = asked.join(shown, [*by, "_e"]).groupBy(*by, "_n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_r"))), lambda x: x["_r"]).alias("evidence_refs"))
    return numbered_.join(refs, [*by, "_n"], "left").drop("_n")


def _filled(template: str, values: dict[str, Column]) -> Column:
    """The template with its {names} replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def explained(findings: DataFrame, events: DataFrame, extra: dict[str, tuple[str, tuple[str, ...]]] | None = None, by: By = ()) -> DataFrame:
    """findings with title, why, what, observed, inferred, confidence_reason, mitre, provenance, rule_version, limitations and evidence_refs.

    What was observed is told apart from what it may mean. extra: title and techniques of rules that aren't in RULES,
    which say only that their condition was met. The events that findings name are joined by id.
    """
    extra = extra or {}
    facts = events.select(*by, F.col("id").alias("event_id"), "host", "user", "process_name", "timestamp", "timestamp_original")
    both = _referred(findings, events, by).join(facts, [*by, "event_id"], "left")
    known = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))
    values = {"host": known("host", "an unknown host"), "user": known("user", "an unknown user"), "process": known("process_name", "a process"), "detail": known("detail", "-"), "event_id": F.col("event_id").cast("string"), "time": F.when(F.col("timestamp_original").isNull(), "an unknown time").otherwise(F.coalesce(iso(F.col("timestamp")), F.lit("an unknown time"))), "n": F.size("evidence").cast("string")}
    met = ("The rule's condition is met by event {event_id}.", "{process} on {host} matches the rule.", "Event {event_id} at {time} has the values that the condition asks for.", "What the rule's author had in mind may have happened; an analyst must judge.", "The rule's own level; its author knows how often it errs.")
    unknown = "What the condition leaves out is its author's choice."
    standing = {r.id: (r.title, r.mitre, TEXTS.get(r.id, met), "rules", r.version, LIMITS.get(r.id, unknown)) for r in every_rule()} | {i: (title, tuple(mitre), met, "sigma", "1", unknown) for i, (title, mitre) in extra.items()}

    def by_rule(pick: Callable[[tuple], Column]) -> Column:
        out = F.when(F.lit(False), pick(("", (), met, "", "", "")))
        for i, x in standing.items():
            out = out.when(F.col("rule_id") == i, pick(x))
        return out

    texts = by_rule(lambda x: F.array(*[_filled(t, values) for t in x[2]]))
    rows = both.withColumn("_t", texts).withColumn("title", by_rule(lambda x: F.lit(x[0]))).withColumn("mitre", by_rule(lambda x: F.array(*map(F.lit, x[1])).cast("array<string>"))).withColumn("provenance", by_rule(lambda x: F.lit(x[3])))
    at = lambda i: F.element_at("_t", i)
    return rows.select(*findings.columns, "title", F.array(at(1)).alias("why"), at(2).alias("what"), F.array(at(3)).alias("observed"), F.array(at(4)).alias("inferred"), at(5).alias("confidence_reason"), "mitre", "provenance", by_rule(lambda x: F.lit(x[4])).alias("rule_version"), F.array(by_rule(lambda x: F.lit(x[5]))).alias("limitations"), "evidence_refs")


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(r.id, r.title, r.severity, r.confidence, list(r.mitre)) for r in every_rule()]
    return spark.createDataFrame(rows, "rule_id string, title string, severity string, confidence int, mitre array<string>")


def applicable(events: DataFrame) -> DataFrame:
    """Rules of whose inputs the events hold any."""
    spark = events.sparkSession
    needs = spark.createDataFrame([(r.id, s, i) for r in every_rule() for s, i in r.needs], "rule_id string, source string, event_id string")
    return needs.join(events.select("source", "event_id").distinct(), ["source", "event_id"], "left_semi").select("rule_id").distinct()
