"""Labels of codes, and one-line descriptions of events, in our own words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Windows codes and what they mean.
LOGON_TYPES = {"0": "system", "2": "interactive", "3": "network", "4": "batch", "5": "service", "7": "unlock", "8": "network, clear text", "9": "new credentials", "10": "remote desktop", "11": "cached interactive", "12": "cached remote desktop", "13": "cached unlock"}
STATUS = {
    "0x0": "success", "0xc0000064": "no such user", "0xc000006a": "wrong password", "0xc000006d": "wrong name or password", "0xc000006e": "account restriction", "0xc000006f": "outside allowed hours",
    "0xc0000070": "workstation not allowed", "0xc0000071": "password expired", "0xc0000072": "account disabled", "0xc00000dc": "server in the wrong state", "0xc0000133": "clocks differ", "0xc000015b": "logon type not granted",
    "0xc0000193": "account expired", "0xc0000224": "password must change", "0xc0000234": "account locked out", "0xc0000371": "local credentials unavailable", "0xc0000413": "authentication firewall",
}
KERBEROS = {"0x0": "success", "0x6": "client not found", "0x7": "server not found", "0x12": "account disabled or locked", "0x17": "password expired", "0x18": "wrong password", "0x1b": "server needs user-to-user", "0x20": "ticket expired", "0x25": "clocks differ"}
ENCRYPTION = {"0x1": "DES-CBC-CRC", "0x3": "DES-CBC-MD5", "0x11": "AES128", "0x12": "AES256", "0x17": "RC4-HMAC", "0x18": "RC4-HMAC-EXP", "0xffffffff": "failure"}
# Message numbers and their texts.
PARAMETERS = {
    "%%1537": "DELETE", "%%1538": "READ_CONTROL", "%%1539": "WRITE_DAC", "%%1540": "WRITE_OWNER", "%%1541": "SYNCHRONIZE", "%%1542": "ACCESS_SYS_SEC", "%%1832": "Identification", "%%1833": "Impersonation", "%%1840": "Delegation",
    "%%1842": "Yes", "%%1843": "No", "%%1936": "Type 1 (full token, UAC off or built-in administrator)", "%%1937": "Type 2 (elevated token)", "%%1938": "Type 3 (limited token)", "%%4416": "ReadData (ListDirectory)", "%%4417": "WriteData (AddFile)", "%%4418": "AppendData (AddSubdirectory)", "%%4419": "ReadEA", "%%4420": "WriteEA",
    "%%4421": "Execute/Traverse", "%%4422": "DeleteChild", "%%4423": "ReadAttributes", "%%4424": "WriteAttributes",
}
AUDIT_FAILURE, AUDIT_SUCCESS = 0x0010_0000_0000_0000, 0x0020_0000_0000_0000


def looked_up(table: dict[str, str], code: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.lower(code)]


def parameters(text: Column) -> Column:
    """Replace each %%NNNN that is known."""
    out = text
    for code, name in PARAMETERS.items():
        out = F.replace(out, F.lit(code), F.lit(name))
    return F.when(F.contains(text, F.lit("%%")), out).otherwise(text)


def level_label(level: Column, keywords: Column) -> Column:
    """Audit outcome from the keyword bits, else the level; none, 0 and 4 are information."""
    audit = F.when(keywords.bitwiseAND(F.lit(AUDIT_FAILURE)) != 0, "audit failure").when(keywords.bitwiseAND(F.lit(AUDIT_SUCCESS)) != 0, "audit success")
    return audit.when(level == 1, "critical").when(level == 2, "error").when(level == 3, "warning").when(level == 5, "verbose").otherwise("information")


def member_name(dn: Column) -> Column:
    """The common name of a distinguished name."""
    return F.coalesce(F.nullif(F.regexp_extract(dn, r"(?i)(?:^|,)CN=((?:\\.|[^,])*)", 1), F.lit("")), dn)


def summary(pairs: Column, value_chars: int = 90, most_bytes: int = 320) -> Column:
    """name: value pairs, without empty values and dashes, cut at so many bytes. pairs: array of structs (name, value)."""
    shown = F.transform(F.filter(pairs, lambda p: ~F.trim(F.coalesce(p["value"], F.lit(""))).isin("", "-")), lambda p: F.concat(p["name"], F.lit(": "), F.when(F.length(p["value"]) > value_chars, F.concat(F.substring(p["value"], 1, value_chars), F.lit("…"))).otherwise(p["value"])))
    fits = F.aggregate(shown, F.lit(""), lambda acc, x: F.when(acc == "", x).when(F.octet_length(acc) + F.octet_length(x) + 2 <= most_bytes, F.concat(acc, F.lit("; "), x)).otherwise(acc))
    return fits


def actor(events) -> Column:
    """Who acted: User, target, subject, account (with domain), Param1, else the system's user SID."""
    qualified = lambda d, n: F.when(events.value(n).isNotNull(), F.concat(F.coalesce(F.concat(events.value(d), F.lit("\\")), F.lit("")), events.value(n)))
    return F.coalesce(events.value("User"), qualified("TargetDomainName", "TargetUserName"), qualified("SubjectDomainName", "SubjectUserName"), qualified("AccountDomain", "AccountName"), events.value("Param1"), events.raw("@UserID"))


#: (channel ending, event id) to a template; {Field} is a field's first value.
SYSMON, SECURITY, SYSTEM, POWERSHELL = "sysmon/operational", "security", "system", "powershell/operational"
TASKS, SESSIONS, REMOTE = "taskscheduler/operational", "localsessionmanager/operational", "remoteconnectionmanager/operational"
DEFENDER, WINRM, BITS = "windows defender/operational", "winrm/operational", "bits-client/operational"
# Rights that replicate a directory, as they stand in the properties of event 4662.
REPLICATION = ("1131f6aa-9c07-11d1-f79f-00c04fc2dcd2", "1131f6ad-9c07-11d1-f79f-00c04fc2dcd2", "89e95b76-444d-4c62-991a-0facbeda640c")
KERNEL = "Microsoft-Windows-Kernel-General"
TEMPLATES = {
    (SYSMON, 1): "started {Image} by {ParentImage}: {CommandLine}", (SYSMON, 2): "{Image} changed the creation time of {TargetFilename}", (SYSMON, 3): "{Image} connected to {DestinationIp}:{DestinationPort}", (SYSMON, 5): "ended {Image}",
    (SYSMON, 6): "loaded driver {ImageLoaded}", (SYSMON, 7): "{Image} loaded {ImageLoaded}", (SYSMON, 8): "{SourceImage} made a thread in {TargetImage}", (SYSMON, 9): "{Image} read raw {Device}", (SYSMON, 10): "{SourceImage} opened {TargetImage} ({GrantedAccess})",
    (SYSMON, 11): "{Image} created {TargetFilename}", (SYSMON, 12): "{Image} {EventType} {TargetObject}", (SYSMON, 13): "{Image} set {TargetObject} to {Details}", (SYSMON, 14): "{Image} renamed {TargetObject} to {NewName}", (SYSMON, 15): "{Image} created stream {TargetFilename}",
    (SYSMON, 17): "{Image} made pipe {PipeName}", (SYSMON, 18): "{Image} connected to pipe {PipeName}", (SYSMON, 19): "WMI filter {Name}", (SYSMON, 20): "WMI consumer {Name}: {Destination}", (SYSMON, 21): "WMI binding {Consumer}", (SYSMON, 22): "{Image} asked for {QueryName}: {QueryResults}",
    (SYSMON, 23): "{Image} deleted {TargetFilename}", (SYSMON, 25): "tampered with {Image}", (SYSMON, 26): "{Image} deleted {TargetFilename}",
    (SECURITY, 1102): "{SubjectUserName} cleared the log", (SECURITY, 4608): "system started", (SECURITY, 4616): "{SubjectUserName} changed the time from {PreviousTime} to {NewTime}", (SECURITY, 4624): "{TargetDomainName}\\{TargetUserName} logged on ({LogonType}) from {IpAddress} {WorkstationName}",
    (SECURITY, 4625): "{TargetDomainName}\\{TargetUserName} failed to log on ({LogonType}) from {IpAddress}: {SubStatus}", (SECURITY, 4634): "{TargetUserName} logged off", (SECURITY, 4647): "{TargetUserName} logged off by choice", (SECURITY, 4648): "{SubjectUserName} used credentials of {TargetUserName} for {TargetServerName}",
    (SECURITY, 4656): "{SubjectUserName} asked for {ObjectName}", (SECURITY, 4657): "{SubjectUserName} set {ObjectName}\\{ObjectValueName}", (SECURITY, 4660): "{SubjectUserName} deleted an object", (SECURITY, 4662): "{SubjectUserName} worked on {ObjectName}", (SECURITY, 4663): "{SubjectUserName} accessed {ObjectName}",
    (SECURITY, 4670): "{SubjectUserName} changed permissions of {ObjectName}", (SECURITY, 4672): "special rights for {SubjectUserName}", (SECURITY, 4673): "{SubjectUserName} used a privileged service", (SECURITY, 4688): "{SubjectUserName} started {NewProcessName}: {CommandLine}", (SECURITY, 4689): "ended {ProcessName}",
    (SECURITY, 4697): "installed service {ServiceName}: {ServiceFileName}", (SECURITY, 4698): "created task {TaskName}", (SECURITY, 4699): "deleted task {TaskName}", (SECURITY, 4700): "enabled task {TaskName}", (SECURITY, 4701): "disabled task {TaskName}", (SECURITY, 4702): "updated task {TaskName}",
    (SECURITY, 4719): "{SubjectUserName} changed the audit policy", (SECURITY, 4720): "{SubjectUserName} created account {TargetUserName}", (SECURITY, 4722): "{SubjectUserName} enabled {TargetUserName}", (SECURITY, 4723): "{SubjectUserName} tried to change the password of {TargetUserName}", (SECURITY, 4724): "{SubjectUserName} reset the password of {TargetUserName}",
    (SECURITY, 4725): "{SubjectUserName} disabled {TargetUserName}", (SECURITY, 4726): "{SubjectUserName} deleted {TargetUserName}", (SECURITY, 4728): "{SubjectUserName} added {MemberName} to {TargetUserName}", (SECURITY, 4732): "{SubjectUserName} added {MemberName} to {TargetUserName}", (SECURITY, 4756): "{SubjectUserName} added {MemberName} to {TargetUserName}",
    (SECURITY, 4738): "{SubjectUserName} changed {TargetUserName}", (SECURITY, 4740): "{TargetUserName} was locked out by {TargetDomainName}", (SECURITY, 4768): "Kerberos ticket for {TargetUserName} from {IpAddress}: {Status}", (SECURITY, 4769): "Kerberos service ticket {ServiceName} for {TargetUserName} ({TicketEncryptionType})",
    (SECURITY, 4771): "Kerberos pre-authentication of {TargetUserName} failed: {Status}", (SECURITY, 4776): "NTLM check of {TargetUserName} from {Workstation}: {Status}", (SECURITY, 4778): "{AccountName} reconnected from {ClientName}", (SECURITY, 4779): "{AccountName} disconnected from {ClientName}", (SECURITY, 5140): "{SubjectUserName} opened share {ShareName} from {IpAddress}",
    (SECURITY, 5145): "{SubjectUserName} checked {ShareName}\\{RelativeTargetName}", (SECURITY, 5156): "{Application} was let through to {DestAddress}:{DestPort}",
    (SYSTEM, 104): "the {Channel} log was cleared", (SYSTEM, 7036): "service {param1}: {param2}", (SYSTEM, 7040): "service {param1} start type {param2} to {param3}", (SYSTEM, 7045): "installed service {ServiceName}: {ImagePath}", (SYSTEM, 1074): "{param7} asked for {param5}", (SYSTEM, 6005): "event log started", (SYSTEM, 6006): "event log stopped",
    (SYSTEM, 6008): "unexpected shutdown", (SYSTEM, 6011): "renamed to {Data}", (POWERSHELL, 4103): "module: {ContextInfo}", (POWERSHELL, 4104): "script {MessageNumber} of {MessageTotal}: {ScriptBlockText}", (POWERSHELL, 40961): "console started",
    (SECURITY, 1100): "event log service stopped", (SECURITY, 4609): "system shuts down", (SECURITY, 4729): "{SubjectUserName} removed {MemberName} from {TargetUserName}", (SECURITY, 4733): "{SubjectUserName} removed {MemberName} from {TargetUserName}", (SECURITY, 4757): "{SubjectUserName} removed {MemberName} from {TargetUserName}",
    (SECURITY, 4739): "domain policy of {DomainName} changed", (SECURITY, 4767): "{TargetUserName} was unlocked", (SECURITY, 4770): "Kerberos ticket {ServiceName} renewed for {TargetUserName}", (SECURITY, 4794): "{SubjectUserName} tried to set the restore mode password", (SYSTEM, 7034): "service {param1} ended unexpectedly",
    (TASKS, 106): "task {TaskName} registered by {UserContext}", (TASKS, 140): "task {TaskName} changed by {UserName}", (TASKS, 141): "task {TaskName} deleted by {UserName}", (TASKS, 200): "task {TaskName} started {ActionName}", (TASKS, 201): "action of task {TaskName} ended with {ResultCode}",
    (SESSIONS, 21): "{User} logged on from {Address} (session {SessionID})", (SESSIONS, 22): "shell of {User} started from {Address}", (SESSIONS, 23): "{User} logged off", (SESSIONS, 24): "{User} disconnected from {Address}", (SESSIONS, 25): "{User} reconnected from {Address}", (REMOTE, 1149): "{Param2}\\{Param1} authenticated from {Param3}",
    (DEFENDER, 1116): "found {Threat Name} in {Path}", (DEFENDER, 1117): "{Action Name} of {Threat Name}", (DEFENDER, 5001): "real-time protection off", (DEFENDER, 5007): "configuration changed to {New Value}", (WINRM, 6): "session to {connection}", (BITS, 59): "job {name} from {url}",
}


def describe(events) -> Column:
    """One line for an event: from its template, codes in words, else null (summary() stands in)."""
    import re

    channel, n, lines = F.lower(events.raw("@Channel")), events.keys["@EventID"].first, []
    tables = {"LogonType": LOGON_TYPES, "SubStatus": STATUS, "TicketEncryptionType": ENCRYPTION}
    for (ending, number), template in TEMPLATES.items():
        parts = []
        for literal, field in re.findall(r"([^{]*)(?:\{([\w ]+)\})?", template):
            if literal:
                parts.append(F.lit(literal))
            if field:
                v = events.value(field)
                table = tables.get(field) or ({4768: KERBEROS, 4771: KERBEROS, 4776: STATUS}.get(number) if field == "Status" else None)
                v = F.coalesce(looked_up(table, v), v) if table else member_name(v) if field == "MemberName" else v
                parts.append(F.coalesce(v, F.lit("?")))
        lines.append(F.when((n == str(number)) & channel.endswith(ending), F.concat(*parts)))
    replicates = reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(events.value("Properties"), F.lit(""))), F.lit(x)) for x in REPLICATION))
    who, what = (F.coalesce(events.value(x), F.lit("?")) for x in ("SubjectUserName", "ObjectName"))
    special = [F.when((n == "4662") & channel.endswith(SECURITY) & replicates, F.concat(who, F.lit(" may have replicated the directory: "), what))]
    kernel = channel.endswith(SYSTEM) & (events.raw("@Provider") == KERNEL)
    old, new = (F.coalesce(events.value(x), F.lit("?")) for x in ("OldTime", "NewTime"))
    special.append(F.when(kernel, F.when(n == "1", F.concat(F.lit("time changed from "), old, F.lit(" to "), new)).when(n == "12", F.lit("operating system started")).when(n == "13", F.lit("operating system shuts down"))))
    return F.coalesce(*special, *lines)
