"""Scalar functions of the event model, all native columns (survey K1-K17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Switches that mark an encoded command; the parsers also take a slash.
ENCODED = r"(?i)(?:^|\s)-(?:encodedcommand|enc|e)(?:\s|$|=|:)"
ENCODED_PARSER = r"(?i)(?:^|\s)[-/](?:encodedcommand|enc|e)(?:\s|$|=|:)"
#: Folders that ordinary users can write to.
WRITABLE = r"(?i)\\temp\\|/temp/|\\tmp\\|/tmp/|\\programdata\\"
TEMP_ONLY = r"(?i)\\temp\\"
SYSTEM_ACCOUNTS = ("system", "localsystem", "nt authority\\system", "s-1-5-18")
START_TYPES = ("boot", "system", "auto", "manual", "disabled")
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
TECHNIQUE = r"^attack\.(t\d{4}(?:\.\d{3})?)$"


def normalize_timestamp(c: Column) -> Column:
    """K1: ISO text with Z, an offset or neither (then UTC), or one of three plain forms, as whole seconds; else null."""
    text = F.trim(c)
    iso = F.when(text.rlike(ISO_SHAPE), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")))
    plain = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form))) for shape, form in ((r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$", "MM/dd/yyyy HH:mm:ss"), (r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$", "yyyy/MM/dd HH:mm:ss"))]
    return F.date_trunc("second", F.coalesce(iso, *plain))


def filetime(c: Column) -> Column:
    """K3: 100 ns since 1601; null for zero and for years past 3000."""
    micros = F.floor(c / 10).cast("long") - F.lit(11644473600000000)
    return F.when((c > 0) & (micros < F.lit(32535216000000000)), F.date_trunc("second", F.timestamp_micros(micros)))


def basename(c: Column) -> Column:
    """K4, as rules and correlation use it: lower case, trimmed, '' for none."""
    return F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[^\\/]*$", 0)


def parser_basename(c: Column) -> Column:
    """K4, as parsers use it: case kept, null for none."""
    return F.nullif(F.regexp_extract(F.trim(c), r"[^\\/]*$", 0), F.lit(""))


def norm_path(c: Column) -> Column:
    """K5"""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "/", r"\\")))


def norm_host(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def normalize_user(c: Column) -> Column:
    """K6: DOMAIN\\name as name@domain, split at the first backslash."""
    text = F.trim(c)
    at = F.instr(text, "\\")
    domain, name = F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text))
    return F.lower(F.when(at > 0, F.concat(F.trim(name), F.lit("@"), F.trim(domain))).otherwise(text))


def parse_hashes(c: Column) -> Column:
    """K7: 'SHA256=..,MD5=..' as a map with lower-case keys."""
    pairs = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.split(p, "=", 2)), lambda p: (F.size(p) == 2) & (F.trim(p[0]) != "") & (F.trim(p[1]) != ""))
    items = F.transform(pairs, lambda p: F.struct(F.lower(F.trim(p[0])).alias("key"), F.trim(p[1]).alias("value")))
    # Of one algorithm given twice the last counts.
    last = F.filter(items, lambda x, i: ~F.exists(F.slice(items, i + 2, F.greatest(F.size(items), F.lit(1))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def blank(c: Column) -> Column:
    """Null for null, blanks and '-'."""
    text = F.trim(c)
    return F.when((text != "") & (text != "-"), text)


def parse_pid(c: Column) -> Column:
    """K8: decimal or 0x-hexadecimal, above zero."""
    text = F.lower(F.trim(c))
    n = F.when(text.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(text, 3, 16), 16, 10).try_cast("long")).otherwise(F.when(text.rlike("^[0-9]{1,18}$"), text.try_cast("long")))
    return F.when(n > 0, n)


def parse_port(c: Column) -> Column:
    text = F.trim(c)
    n = F.when(text.rlike("^[0-9]{1,9}$"), text.try_cast("int"))
    return F.when(n.between(0, 65535), n)


def encoded_flag(command: Column) -> Column:
    """K9"""
    return F.when(command.rlike(ENCODED_PARSER), F.array(F.lit("encoded-command"))).otherwise(F.array().cast("array<string>"))


def excerpt(*parts: Column) -> Column:
    """K10: the parts that aren't empty, at most 300 characters."""
    return F.substring(F.concat_ws(" | ", *[F.nullif(p.cast("string"), F.lit("")) for p in parts]), 1, 300)


def exe_until_suffix(c: Column) -> Column:
    """K11, persistence parsers: up to .exe, without quotes."""
    cut = F.regexp_extract(c, r"(?i)^\s*\"?(.*?\.exe)", 1)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(None)).otherwise(F.when(cut != "", cut).otherwise(F.trim(F.regexp_replace(c, '"', ""))))


def exe_first_token(c: Column) -> Column:
    """K11, rules: a quoted first part or the first token, if it is a path or ends in .exe; else ''."""
    text = F.trim(F.coalesce(c, F.lit("")))
    first = F.when(text.startswith('"'), F.regexp_extract(text, r'^"([^"]*)"', 1)).otherwise(F.regexp_extract(text, r"^(\S+)", 1))
    return F.when(first.contains("\\") | first.contains("/") | F.lower(first).endswith(".exe"), first).otherwise(F.lit(""))


def exe_anywhere(c: Column) -> Column:
    """K11, correlation: the first quoted or drive-rooted .exe; else ''."""
    both = r'(?i)"([^"]+\.exe)"|\b([A-Za-z]:\\[^\s"]+\.exe)'
    text = F.coalesce(c, F.lit(""))
    quoted = F.regexp_extract(text, both, 1)
    return F.when(quoted != "", quoted).otherwise(F.regexp_extract(text, both, 2))


def tags_to_techniques(tags: Column) -> Column:
    """K13"""
    ids = F.transform(tags, lambda t: F.upper(F.regexp_extract(F.lower(F.trim(t)), TECHNIQUE, 1)))
    return F.array_distinct(F.filter(ids, lambda t: t != ""))


def sanitize_case(c: Column) -> Column:
    """K14: a name for a case: odd characters become '-', ends are trimmed, at most 64 characters."""
    out = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "-"), r"^[-._]+|[-._]+$", "")
    return F.when(out == "", F.lit("case")).otherwise(F.substring(out, 1, 64))


def qualified_user(domain: Column, name: Column) -> Column:
    """K16"""
    return F.when(blank(name).isNull(), F.lit(None)).otherwise(F.concat_ws("\\", blank(domain), blank(name)))


def start_type(c: Column) -> Column:
    """K17: a number or a name as a name."""
    text = F.lower(F.trim(c))
    out = F.when(text.isin(*START_TYPES), text)
    for i, name in enumerate(START_TYPES):
        out = out.when(text == str(i), name)
    return out


def service_flags(path: Column, start: Column) -> Column:
    """K17"""
    text = F.coalesce(path, F.lit(""))
    unquoted = ~F.ltrim(text).startswith('"') & F.regexp_extract(text, r"(?i)^(.*?\.exe)", 1).contains(" ")
    return F.array_compact(F.array(F.when(start_type(start) == "auto", "auto-start"), F.when(text.rlike(TEMP_ONLY), "image-in-temp-dir"), F.when(unquoted, "unquoted-service-path")))


def csv_safe(c: Column) -> Column:
    """K15: a quote before what a spreadsheet would take for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def admin_like(user: Column) -> Column:
    """C10"""
    name = F.lower(F.trim(F.regexp_extract(F.regexp_extract(user, r"[^\\]*$", 0), r"^[^@]*", 0)))
    return F.coalesce((name == "administrator") | name.rlike(r"(^|[^a-z])admin([^a-z]|$)"), F.lit(False))
