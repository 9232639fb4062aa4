"""Ready-made queries by group, and a history of the last ones."""

from __future__ import annotations

HISTORY = 50

PRESETS: dict[str, dict[str, str]] = {
    "Logons": {
        "Failed logons by address": "EventID = 4625 | group by IpAddress, TargetUserName",
        "Remote and network logons": "EventID = 4624 and LogonType in (3, 10) | group by IpAddress",
        "Explicit credentials": "EventID = 4648 | select SubjectUserName, TargetUserName, TargetServerName",
        "Special rights": "EventID = 4672 and not SubjectUserName endswith \"$\" | group by SubjectUserName",
        "Locked accounts": "EventID = 4740 | group by TargetUserName",
        "NTLM checks": "EventID = 4776 | group by Workstation, TargetUserName",
    },
    "Kerberos": {
        "Weak tickets": "EventID = 4769 and TicketEncryptionType in (0x17, 0x18) | group by ServiceName",
        "No pre-authentication": "EventID = 4768 and PreAuthType = 0 | group by TargetUserName",
        "Failed pre-authentication": "EventID = 4771 | group by IpAddress, Status",
    },
    "Processes": {
        "Started processes": "(channel like \"*sysmon*\" and EventID = 1) or EventID = 4688 | group by Image, NewProcessName",
        "Encoded command lines": "CommandLine contains \" -enc\" | select Image, CommandLine",
        "Office children": "ParentImage matches \"(winword|excel|powerpnt|outlook)[.]exe$\" | select ParentImage, Image, CommandLine",
        "Access to lsass": "EventID = 10 and TargetImage endswith \"\\\\lsass.exe\" | group by SourceImage, GrantedAccess",
        "Remote threads": "channel like \"*sysmon*\" and EventID = 8 | group by SourceImage, TargetImage",
        "Network connections": "channel like \"*sysmon*\" and EventID = 3 | group by Image, DestinationIp",
    },
    "Scripts and persistence": {
        "Script blocks": "EventID = 4104 | select ScriptBlockText",
        "Downloads in scripts": "EventID = 4104 and ScriptBlockText matches \"downloadstring|invoke-webrequest|iwr \"",
        "New services": "EventID in (7045, 4697) | select ServiceName, ImagePath",
        "New tasks": "EventID in (4698, 4702) | select TaskName",
        "Run keys": "EventID = 13 and TargetObject contains \"\\\\CurrentVersion\\\\Run\" | select Image, TargetObject, Details",
        "WMI bindings": "channel like \"*sysmon*\" and EventID in (19, 20, 21)",
    },
    "Accounts": {
        "New accounts": "EventID = 4720 | select SubjectUserName, TargetUserName",
        "Group changes": "EventID in (4728, 4732, 4756) | select SubjectUserName, MemberName, TargetUserName",
        "Password resets": "EventID = 4724 | group by SubjectUserName, TargetUserName",
        "Remote desktop": "channel contains LocalSessionManager and EventID in (21, 24, 25) | group by User, Address",
    },
    "Traces": {
        "Cleared logs": "EventID in (1102, 104)",
        "Time changes": "EventID = 4616 | select SubjectUserName, PreviousTime, NewTime",
        "Recovered records": "flag in (carved, stale, afterGap) | group by flag, file",
    },
}


def remember(history: list[str], query: str) -> list[str]:
    """The history with a query in front, without repeats."""
    query = query.strip()
    return ([query] + [q for q in history if q != query])[:HISTORY] if query else history
