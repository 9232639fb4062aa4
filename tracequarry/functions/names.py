"""Names of hosts, users and addresses, brought to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that need no registry entry of their own.
BUILTIN_DOMAINS = ("NT AUTHORITY", "NT-AUTORITÄT", "AUTORITE NT", "WINDOW MANAGER", "FONT DRIVER HOST", "NT SERVICE", "IIS APPPOOL", "NT VIRTUAL MACHINE", "BUILTIN", "NT-AUTORITAET")
BUILTIN_NAMES = ("system", "local service", "network service", "anonymous logon", "lokaler dienst", "netzwerkdienst", "-")
BUILTIN_SIDS = ("S-1-5-18", "S-1-5-19", "S-1-5-20", "S-1-5-7", "S-1-0-0", "S-1-5-6", "S-1-5-4", "S-1-5-11")
BUILTIN_SID_PREFIXES = ("S-1-5-90-", "S-1-5-96-", "S-1-5-80-", "S-1-5-83-", "S-1-5-82-")
NO_HOSTS = ("LOCALHOST", "LOCAL", "UNKNOWN", "N/A", "-")


def is_ip(v: Column) -> Column:
    """A dotted IPv4 address, or a text of hex digits, colons and dots that holds two colons."""
    return v.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$") | v.rlike(r"^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*$")


def host_key(raw: Column) -> Column:
    """Upper-case short name: no leading backslashes, trailing $ or domain; null for what names no host."""
    s = F.regexp_replace(F.trim(raw), r"^\\+", "")
    name = F.upper(s)
    short = F.get(F.filter(F.split(F.regexp_replace(name, r"\$$", ""), r"\."), lambda x: x != ""), F.lit(0))
    bad = (s == "") | (s == "-") | is_ip(s) | F.lower(s).startswith("::ffff:") | name.isin(*NO_HOSTS)
    return F.when(~bad, short)


def domain_key(raw: Column) -> Column:
    """Upper-case short domain; built-in domains keep their whole name."""
    u = F.upper(F.trim(raw))
    return F.when((u != "") & (u != "-"), F.when(u.isin(*BUILTIN_DOMAINS), u).otherwise(F.coalesce(F.get(F.filter(F.split(u, r"\."), lambda x: x != ""), F.lit(0)), u)))


def split_user(raw: Column, domain: Column) -> tuple[Column, Column]:
    r"""(name, domain) of DOMAIN\user, user@domain or a bare name with its own domain field."""
    s = F.trim(raw)
    slash, at = F.instr(s, "\\"), F.length(s) - F.instr(F.reverse(s), "@") + 1
    mailed = F.contains(s, F.lit("@")) & (at > 1)
    name = F.when(slash > 0, F.substring(s, slash + 1, F.length(s))).when(mailed, F.substring(s, F.lit(1), at - 1)).otherwise(s)
    dom = F.when(slash > 0, F.substring(s, F.lit(1), slash - 1)).when(mailed, F.substring(s, at + 1, F.length(s))).otherwise(domain)
    name = F.when((s != "") & (s != "-") & (name != ""), name)
    return name, F.when(name.isNotNull(), domain_key(dom))


def valid_sid(v: Column) -> Column:
    return F.coalesce(v.startswith("S-1-") & (v != "S-1-0-0"), F.lit(False))


def is_builtin(name: Column, domain: Column, sid: Column) -> Column:
    known = sid.isin(*BUILTIN_SIDS)
    for p in BUILTIN_SID_PREFIXES:
        known = known | sid.startswith(p)
    named = F.lower(name).isin(*BUILTIN_NAMES) | F.upper(name).startswith("DWM-") | F.upper(name).startswith("UMFD-")
    return F.coalesce(known, F.lit(False)) | F.coalesce(domain.isin(*BUILTIN_DOMAINS), F.lit(False)) | F.coalesce(named, F.lit(False))
