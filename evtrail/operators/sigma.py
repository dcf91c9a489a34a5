"""A subset of Sigma: rules are checked, and compiled to columns or, if there are many, to one search for all their values (survey F1-F6)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Field names of rules, levels with confidence, log sources.
FIELDS = {
    "image": "process_name", "processname": "process_name", "commandline": "command_line", "parentimage": "parent_name", "user": "user", "username": "user",
    "computer": "host", "computername": "host", "hostname": "host", "destinationip": "dst_ip", "destinationport": "dst_port", "sourceip": "src_ip", "sourceport": "src_port",
    "eventid": "event_id", "targetobject": "registry_key", "targetfilename": "file_path", "filename": "file_path", "details": "raw",
}
LEVELS = {"critical": 85, "high": 70, "medium": 60, "low": 45, "informational": 30}
CATEGORIES = {
    "process_creation": ("sysmon", ("1",)),
    "network_connection": ("sysmon", ("3",)),
    "image_load": ("sysmon", ("7",)),
    "file_event": ("sysmon", ("11",)),
    "registry_event": ("sysmon", ("12", "13", "14")),
    "ps_script": ("powershell", ("4103", "4104")),
    "powershell": ("powershell", ("4103", "4104")),
}
SERVICES = {"security": "evtx:Security", "sysmon": "sysmon", "powershell": "powershell"}
RULE_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")

#: Samples, in our own words.
SAMPLES: tuple[dict[str, Any], ...] = (
    {"title": "Encoded PowerShell", "id": "sample-encoded-powershell", "logsource": {"category": "process_creation"}, "level": "high", "tags": ["attack.t1059.001"], "detection": {"image": {"Image": ["*powershell.exe", "*pwsh.exe"]}, "switch": {"CommandLine": ["* -enc *", "* -encodedcommand *", "* -e *"]}, "condition": "image and switch"}},
    {"title": "Office starts a shell", "id": "sample-office-shell", "logsource": {"category": "process_creation"}, "level": "high", "tags": ["attack.t1204.002"], "detection": {"parent": {"ParentImage": ["*winword.exe", "*excel.exe", "*powerpnt.exe", "*outlook.exe"]}, "child": {"Image": ["*cmd.exe", "*powershell.exe", "*wscript.exe", "*mshta.exe"]}, "condition": "parent and child"}},
    {"title": "Run key set", "id": "sample-run-key", "logsource": {"category": "registry_event"}, "level": "medium", "tags": ["attack.t1547.001"], "detection": {"selection": {"TargetObject": ["*\\currentversion\\run\\*", "*\\currentversion\\runonce\\*"]}, "condition": "selection"}},
    {"title": "Known odd port", "id": "sample-odd-port", "logsource": {"category": "network_connection"}, "level": "low", "tags": ["attack.t1571"], "detection": {"selection": {"DestinationPort": [4444, 8444, 1337, 31337]}, "condition": "selection"}},
)


class SigmaError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    level: str
    logsource: dict[str, str]
    selections: dict[str, dict[str, Any]]
    condition: str
    tags: tuple[str, ...]


def load(spec: dict[str, Any]) -> Rule:
    """Checks a rule's shape; faults raise SigmaError before any event is read."""
    if not isinstance(spec, dict) or not str(spec.get("title") or "").strip():
        raise SigmaError("a rule needs a title")
    rule_id = str(spec.get("id") or "")
    if not RULE_ID.fullmatch(rule_id):
        raise SigmaError("a rule needs an id of letters, digits, '.', '_' and '-'")
    level = str(spec.get("level") or "").lower()
    if level not in LEVELS:
        raise SigmaError(f"unknown level {level!r}")
    detection = spec.get("detection")
    if not isinstance(detection, dict) or not isinstance(detection.get("condition"), str):
        raise SigmaError("detection needs a condition")
    selections = {k: v for k, v in detection.items() if k != "condition"}
    for name, fields in selections.items():
        if not isinstance(fields, dict) or not fields:
            raise SigmaError(f"selection {name!r} isn't a mapping of fields")
        for field in fields:
            if "|" in field:
                raise SigmaError(f"modifiers aren't supported: {field}")
            if field.lower() not in FIELDS:
                raise SigmaError(f"unknown field {field}")
    rule = Rule(rule_id, str(spec["title"]), level, {k: str(v) for k, v in (spec.get("logsource") or {}).items()}, selections, detection["condition"], tuple(map(str, spec.get("tags") or ())))
    _Condition(rule, lambda _: _Shape()).compile()
    return rule


def glob_regex(glob: str) -> str:
    """A whole-text regular expression for *, ? and [...]; a backslash stands for itself."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^' + body[1:] if body[0] == '!' else ('\\' + body if body[0] == '^' else body)}]")
            i = close
        else:
            out.append(re.escape(c) if not c.isalnum() and c not in "_ " else c)
        i += 1
    return "(?s)^" + "".join(out) + "\\z"


def _value(column: Column, value: Any) -> Column:
    text = str(value).lower()
    own = F.lower(column.cast("string"))
    plain = not set(text) & set("*?[")
    return own == text if plain else own.rlike(glob_regex(text))


def selection(fields: dict[str, Any]) -> Column:
    """All fields, each by any of its values; a null field never matches."""
    out = F.lit(True)
    for name, values in fields.items():
        column = F.col(FIELDS[name.lower()])
        some = F.lit(False)
        for v in values if isinstance(values, list) else [values]:
            some = some | _value(column, v)
        out = out & F.coalesce(some, F.lit(False))
    return out


class _Shape:
    """Stands for a column while a condition is checked without a Spark session."""

    def _same(self, *_: Any) -> _Shape:
        return self

    __and__ = __or__ = __invert__ = __add__ = __ge__ = cast = _same


class _Condition:
    """or < and < not < name | all of g | N of g; parentheses aren't supported. leaf turns a selection into a column."""

    def __init__(self, rule: Rule, leaf: Callable[[dict[str, Any]], Any]) -> None:
        self.leaf = leaf
        if "(" in rule.condition or ")" in rule.condition:
            raise SigmaError("parentheses aren't supported in a condition")
        self.rule, self.words, self.at = rule, rule.condition.split(), 0

    def compile(self) -> Column:
        if not self.words:
            raise SigmaError("the condition is empty")
        out = self._either()
        if self.at < len(self.words):
            raise SigmaError(f"unexpected {self.words[self.at]!r} in the condition")
        return out

    def _next(self, *words: str) -> bool:
        if self.at < len(self.words) and self.words[self.at].lower() in words:
            self.at += 1
            return True
        return False

    def _either(self) -> Column:
        out = self._both()
        while self._next("or"):
            out = out | self._both()
        return out

    def _both(self) -> Column:
        out = self._not()
        while self._next("and"):
            out = out & self._not()
        return out

    def _not(self) -> Column:
        return ~self._not() if self._next("not") else self._atom()

    def _atom(self) -> Column:
        if self.at >= len(self.words):
            raise SigmaError("the condition ends too early")
        word = self.words[self.at]
        if self.at + 2 < len(self.words) + 0 and self.words[self.at + 1].lower() == "of":
            glob = self.words[self.at + 2]
            if glob.lower() == "them":
                raise SigmaError("'of them' isn't supported")
            shape = re.compile(".*".join(map(re.escape, glob.split("*"))))
            every = [self.leaf(f) for n, f in self.rule.selections.items() if shape.fullmatch(n)]
            if not every or not (word.lower() == "all" or word.isdigit()):
                raise SigmaError(f"no selection fits {word} of {glob}")
            self.at += 3
            total = every[0].cast("int")
            for c in every[1:]:
                total = total + c.cast("int")
            return total >= (len(every) if word.lower() == "all" else int(word))
        if word not in self.rule.selections:
            raise SigmaError(f"unknown selection {word!r}")
        self.at += 1
        return self.leaf(self.rule.selections[word])


def logsource(rule: Rule) -> Column:
    category, service = rule.logsource.get("category", "").lower(), rule.logsource.get("service", "").lower()
    if category in CATEGORIES:
        source, ids = CATEGORIES[category]
        return (F.col("source") == source) & F.col("event_id").isin(*ids)
    if service in SERVICES:
        return F.col("source") == SERVICES[service]
    return F.lit(True)


def predicate(rule: Rule) -> Column:
    return logsource(rule) & _Condition(rule, selection).compile()


FOUND = "rule_id string, severity string, confidence int, event_id bigint, techniques string"


def run(events: DataFrame, rule: Rule) -> DataFrame:
    """A finding for each event that the rule matches."""
    return run_all(events, [rule])


#: Up to so many rules are one projection; more are looked for by the words in their values.
FEW = 8


def run_all(events: DataFrame, every: list[Rule]) -> DataFrame:
    """The findings of all rules, from one scan of the events."""
    return _projected(events, every) if len(every) <= FEW else _searched(events, every)


def _facts(rule: Rule) -> tuple[str, str, int, str]:
    return rule.id, rule.level, LEVELS[rule.level], ",".join(techniques(rule))


def _projected(events: DataFrame, every: list[Rule]) -> DataFrame:
    def hit(rule: Rule) -> Column:
        names = ("rule_id", "severity", "confidence", "techniques")
        return F.when(predicate(rule), F.struct(*[F.lit(v).alias(n) for n, v in zip(names, _facts(rule), strict=True)]))

    found = events.select("id", F.explode(F.array_compact(F.array(*map(hit, every)))).alias("r"))
    return found.select("r.rule_id", "r.severity", F.col("r.confidence").cast("int").alias("confidence"), F.col("id").alias("event_id"), "r.techniques")


class _Test:
    """A condition over the selections that are met, put together as columns are."""

    def __init__(self, ask: Callable[[set[int]], int]) -> None:
        self.ask = ask

    def __and__(self, other: _Test) -> _Test:
        return _Test(lambda met: self.ask(met) and other.ask(met))

    def __or__(self, other: _Test) -> _Test:
        return _Test(lambda met: self.ask(met) or other.ask(met))

    def __add__(self, other: _Test) -> _Test:
        return _Test(lambda met: self.ask(met) + other.ask(met))

    def __ge__(self, least: int) -> _Test:
        return _Test(lambda met: self.ask(met) >= least)

    def __invert__(self) -> _Test:
        return _Test(lambda met: not self.ask(met))

    def cast(self, _: str) -> _Test:
        return self


class Matcher:
    """Many rules at once: each distinct value and each distinct selection is tested once an event, and only where its text may hold it.

    Values without wildcards are looked up whole. Of the others the longest piece without wildcards goes into one
    automaton a field; only values whose piece stands in the text are compared in full. Only rules of which a selection
    is met are asked, and those that an event without any fulfils.
    """

    def __init__(self, every: list[Rule]) -> None:
        self.exact: dict[str, dict[str, list[int]]] = {}
        self.always: dict[str, list[int]] = {}
        self.automata: dict[str, ahocorasick.Automaton] = {}
        self.patterns: list[re.Pattern | None] = []
        values: dict[tuple[str, str], int] = {}
        pieces: dict[str, dict[str, list[int]]] = {}
        self.selections: list[list[set[int]]] = []
        self.of_value: dict[int, list[int]] = {}
        numbers: dict[tuple, int] = {}

        def value(column: str, text: str) -> int:
            if (column, text) not in values:
                n = values[column, text] = len(self.patterns)
                plain = not set(text) & set("*?[")
                self.patterns.append(None if plain else re.compile(glob_regex(text).removesuffix("\\z") + r"\Z"))
                piece = max(re.split(r"[*?]|\[.+?\]|\[", text), key=len)
                where = self.exact.setdefault(column, {}).setdefault(text, []) if plain else pieces.setdefault(column, {}).setdefault(piece, []) if piece else self.always.setdefault(column, [])
                where.append(n)
            return values[column, text]

        def chosen(fields: dict[str, Any]) -> _Test:
            wanted = [(FIELDS[k.lower()], frozenset(str(x).lower() for x in (v if isinstance(v, list) else [v]))) for k, v in fields.items()]
            key = tuple(sorted(wanted, key=str))
            if key not in numbers:
                n = numbers[key] = len(self.selections)
                self.selections.append([{value(c, t) for t in texts} for c, texts in wanted])
                for v in {v for own in self.selections[n] for v in own}:
                    self.of_value.setdefault(v, []).append(n)
            n = numbers[key]
            self.used.add(n)
            return _Test(lambda met, n=n: n in met)

        self.rules, self.of_selection, self.unmet = [], {}, []
        for i, rule in enumerate(every):
            self.used: set[int] = set()
            test = _Condition(rule, chosen).compile()
            self.rules.append((rule, test))
            for n in self.used:
                self.of_selection.setdefault(n, []).append(i)
            if test.ask(set()):
                self.unmet.append(i)
        for column, own in pieces.items():
            self.automata[column] = ahocorasick.Automaton()
            for piece, ns in own.items():
                self.automata[column].add_word(piece, ns)
            self.automata[column].make_automaton()
        self.columns = sorted({c for c, _ in values})

    def match(self, source: str | None, event_id: str | None, texts: dict[str, str | None]) -> list[int]:
        """The rules that an event fulfils; texts: its fields in lower case."""
        held: set[int] = set()
        for column in self.columns:
            text = texts[column]
            if text is None:
                continue
            held.update(self.exact.get(column, {}).get(text, ()))
            maybe = set(self.always.get(column, ()))
            if column in self.automata:
                for _, ns in self.automata[column].iter(text):
                    maybe.update(ns)
            held.update(n for n in maybe if self.patterns[n].match(text))
        asked = {s for v in held for s in self.of_value.get(v, ())}
        met = {s for s in asked if all(own & held for own in self.selections[s])}
        rules = {r for s in met for r in self.of_selection[s]}.union(self.unmet)
        return sorted(r for r in rules if _concerns(self.rules[r][0], source, event_id) and self.rules[r][1].ask(met))


def _concerns(rule: Rule, source: str | None, event_id: str | None) -> bool:
    """logsource() for one event."""
    category, service = rule.logsource.get("category", "").lower(), rule.logsource.get("service", "").lower()
    if category in CATEGORIES:
        return source == CATEGORIES[category][0] and event_id in CATEGORIES[category][1]
    return source == SERVICES[service] if service in SERVICES else True


def _searched(events: DataFrame, every: list[Rule]) -> DataFrame:
    columns = Matcher(every).columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, facts = Matcher(every), [_facts(r) for r in every]
        for b in batches:
            texts = {c: b.column(f"_{c}").to_pylist() for c in columns}
            found = []
            for i, (n, source, event_id) in enumerate(zip(*(b.column(c).to_pylist() for c in ("id", "source", "event_id")), strict=True)):
                for r in matcher.match(source, event_id, {c: t[i] for c, t in texts.items()}):
                    rule_id, level, confidence, named = facts[r]
                    found.append((rule_id, level, confidence, n, named))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], ["rule_id", "severity", "confidence", "event_id", "techniques"])

    own = events.select("id", "source", "event_id", *[F.lower(F.col(c).cast("string")).alias(f"_{c}") for c in columns])
    return own.mapInArrow(run, FOUND)


def techniques(rule: Rule) -> tuple[str, ...]:
    """The techniques that a rule's tags name, each once, in their order."""
    found = (re.fullmatch(r"attack\.(t\d{4}(?:\.\d{3})?)", t.lower()) for t in rule.tags)
    return tuple(dict.fromkeys(m.group(1).upper() for m in found if m))


def load_file(path: str) -> Rule:
    """A rule file: JSON, or YAML of plain mappings, lists and scalars."""
    text = Path(path).read_text(encoding="utf-8")
    return load(json.loads(text) if path.endswith(".json") else plain_yaml(text))


def plain_yaml(text: str) -> Any:
    """Block mappings and lists, inline lists, quoted or bare scalars, comments; nothing else of YAML."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in (re.sub(r"(^|\s)#.*$", "", raw).rstrip() for raw in text.splitlines()) if x.strip() and x.strip() != "---"]

    def scalar(s: str) -> Any:
        s = s.strip()
        if s.startswith("[") and s.endswith("]"):
            return [scalar(x) for x in s[1:-1].split(",") if x.strip()]
        if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"":
            return s[1:-1]
        if s[:1] in ("&", "*", "!", "{", "|", ">"):
            raise SigmaError(f"unsupported YAML: {s}")
        return int(s) if re.fullmatch(r"-?\d+", s) else {"true": True, "false": False, "null": None, "": None}.get(s.lower(), s)

    def block(at: int, indent: int) -> tuple[Any, int]:
        if lines[at][1].startswith("- "):
            items = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("- "):
                items.append(scalar(lines[at][1][2:]))
                at += 1
            return items, at
        out: dict[str, Any] = {}
        while at < len(lines) and lines[at][0] == indent:
            key, colon, rest = lines[at][1].partition(":")
            key = str(scalar(key))
            if not colon or key in out:
                raise SigmaError(f"bad or repeated key: {lines[at][1]}")
            at += 1
            if rest.strip():
                out[key] = scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("- ")):
                out[key], at = block(at, lines[at][0])
            else:
                out[key] = None
        if at < len(lines) and lines[at][0] > indent:
            raise SigmaError(f"bad indentation: {lines[at][1]}")
        return out, at

    if not lines:
        return {}
    out, at = block(0, lines[0][0])
    if at < len(lines):
        raise SigmaError(f"bad indentation: {lines[at][1]}")
    return out


def samples() -> list[Rule]:
    return [load(s) for s in SAMPLES]
