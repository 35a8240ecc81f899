"""Line parsers: each maps a column of raw lines to one record struct, null where the line is of another form.

Patterns, code tables and message forms are fixed values. Groups are counted,
not named; ``(?U)`` gives classes such as ``\\w`` their Unicode meaning. JSON keys
that have fallbacks are chosen by presence, so a first key that is there with an
empty or null value is taken.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_values, let, strip_priority, to_int
from ..functions.timestamps import audit_iso

#: The record that parsers make, before normalization.
RECORD = {
    "raw": "string", "timestamp": "string", "source_ip": "string", "destination_ip": "string", "source_port": "string", "destination_port": "string",
    "protocol": "string", "action": "string", "event_id": "string", "severity": "string", "user": "string", "hostname": "string",
    "message": "string", "extra": "map<string,string>",
}


def _c(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _record(raw: Column, extra: dict[str, object] | None = None, **fields: object) -> Column:
    entries = [F.struct(F.lit(k).alias("key"), _c(v).cast("string").alias("value")) for k, v in (extra or {}).items()]
    values = {**fields, "raw": raw}
    made = [_c(values[k]).cast(t).alias(k) if k in values else F.lit(None).cast(t).alias(k) for k, t in RECORD.items() if k != "extra"]
    packed = F.map_filter(F.map_from_entries(F.array(*entries)), lambda k, v: v.isNotNull()) if entries else F.create_map()
    return F.struct(*made, packed.cast("map<string,string>").alias("extra"))


def _empty_null(x: Column) -> Column:
    return F.when(x != "", x)


#: Stands between groups; lines that have it in themselves are matched group by group.
_CUT = "\x01"


def _groups(line: Column, pattern: str, n: int, use: Callable[..., Column], *needs: str) -> Column:
    """``use`` of the groups 1 to n of the first match, null where a group is absent or empty; null where nothing matches.

    One match gives all groups. ``needs`` are texts that any match has in it, as finding those costs far less.
    """
    whole = rf"\A(?s:.*?)(?:(?U){pattern})(?s:.*)\z"
    found = F.split(F.regexp_replace(line, whole, "".join(f"{_CUT}${i}" for i in range(1, n + 1))), _CUT)
    single = F.when(_has(line, pattern), F.array(F.lit(""), *[F.regexp_extract(line, "(?U)" + pattern, i) for i in range(1, n + 1)]))
    found = F.when(line.contains(_CUT), single).otherwise(found)
    made = let(found, lambda g: F.when(F.size(g) == n + 1, use(*[_empty_null(F.get(g, F.lit(i))) for i in range(1, n + 1)])))
    return F.when(reduce(Column.__and__, [line.contains(x) for x in needs]), made) if needs else made


def _bind(use: Callable[..., Column], *values: Column) -> Column:
    """``use`` of values of one type, each computed once."""
    return let(F.array(*values), lambda g: use(*[F.get(g, F.lit(i)) for i in range(len(values))]))


def _has(line: Column, pattern: str) -> Column:
    return line.rlike("(?U)" + pattern)


def _of(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = F.create_map(*[x for kv in table.items() for x in map(F.lit, kv)])
    return F.coalesce(F.element_at(pairs, F.coalesce(key, F.lit(""))), F.lit(default))


def _object(text: Column) -> Column:
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, "map<string,string>"))


def _pick(m: Column, *names: str, default: object = "") -> Column:
    out = _c(default).cast("string")
    for n in reversed(names):
        out = F.when(F.map_contains_key(m, F.lit(n)), F.element_at(m, F.lit(n))).otherwise(out)
    return F.when(m.isNull(), _c(default).cast("string")).otherwise(out)


def _or(x: Column, other: str) -> Column:
    return F.coalesce(_empty_null(x), F.lit(other))


def _text(*parts: object) -> Column:
    """Concatenation in which a null counts as empty."""
    return F.concat(*[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])


_SYSLOG = r"(\w{3}\s+\d{1,2}\s+[\d:]+)\s+(\S+)\s+"

# firewall
_UFW = r"(\w{3}\s+\d{1,2}\s+[\d:]+)\s+(\S+)\s+kernel:.*?\[UFW\s+(\w+)\].*?SRC=([\d.]+).*?DST=([\d.]+)(?:.*?PROTO=(\w+))?(?:.*?SPT=(\d+))?(?:.*?DPT=(\d+))?"
_ASA = r"(\w{3}\s+\d{1,2}\s+\d{4}\s+[\d:]+)\s+(\S+)\s+%ASA-\d-(\d+):\s+(\w+)\s+(\w+)\s+src\s+\S+:([\d.]+)/(\d+)\s+dst\s+\S+:([\d.]+)/(\d+)"


def firewall(line: Column) -> Column:
    """UFW kernel lines and ASA deny or permit lines."""

    def build(action: Column, proto: Column, src: Column, dst: Column, port: Column, extra: dict | None, **more: object) -> Column:
        message = _text("Firewall ", action, "ed ", F.coalesce(proto, F.lit("?")), " ", src, " -> ", dst, ":", F.coalesce(port, F.lit("?")))
        severity = F.when(action == "block", "medium").otherwise("info")
        return _record(line, extra, action=action, protocol=F.upper(proto), source_ip=src, destination_ip=dst, destination_port=port, message=message, severity=severity, **more)

    def ufw(ts, host, word, src, dst, proto, spt, dpt):
        return build(F.lower(word), proto, src, dst, dpt, {"interface": "unknown"}, timestamp=ts, hostname=host, source_port=spt)

    def asa(ts, host, eid, word, proto, src, spt, dst, dpt):
        action = F.when(F.lower(word) == "deny", "block").otherwise("allow")
        return build(action, proto, src, dst, dpt, None, timestamp=ts, hostname=host, source_port=spt, event_id=eid)

    return F.coalesce(_groups(line, _UFW, 8, ufw, "kernel:", "[UFW", "SRC=", "DST="), _groups(line, _ASA, 9, asa, "%ASA-"))


# dns
# a run of characters is tried at its beginning only
_BIND = r"(?<![\d\w\-])([\d\w\-]+\s+[\d:.]+)\s+queries:\s+\w+:\s+client\s+(?:@\S+\s+)?([\d.]+)#(\d+)\s+\(([^)]+)\):\s+query:\s+(\S+)\s+IN\s+(\w+)"
_WINDOWS_DNS = r"([\d/]+ [\d:]+ [AP]M)\s+\w+\s+PACKET.*?([\d.]+)\s+(?:Snd|Rcv).*?([\w.\-]+\.(?:com|net|org|ru|cn|io|xyz|top|tk))"


def dns(line: Column) -> Column:
    """BIND query lines and Windows DNS debug lines."""
    common = {"protocol": "UDP", "action": "query", "severity": "info"}

    def bind(ts, src, port, domain, name, kind):
        message = _text("DNS query from ", src, ": ", name, " (", kind, ")")
        return _record(line, {"query_name": name, "query_type": kind, "domain": domain}, timestamp=ts, source_ip=src, source_port=port, message=message, **common)

    def debug(ts, src, domain):
        return _record(line, {"query_name": domain, "domain": domain}, timestamp=ts, source_ip=src, message=_text("DNS query from ", src, ": ", domain), **common)

    return F.coalesce(_groups(line, _BIND, 6, bind, "queries:", "query:"), _groups(line, _WINDOWS_DNS, 3, debug, "PACKET"))


# dhcp
_ISC = r"(?i)(\w{3}\s+\d{1,2}\s+[\d:]+)\s+(\S+)\s+dhcpd:\s+(DHCP\w+)\s+on\s+([\d.]+)\s+to\s+([\da-f:]+)(?:\s+\(([^)]+)\))?(?:\s+via\s+(\S+))?"
_DHCP_CSV = r"(?i)(\d+),([\d/]+),([\d:]+),(\w+),([\d.]+),([^,]*),([a-f0-9-]+)"
_DHCP_ACTION = {
    "DHCPACK": "assign", "DHCPREQUEST": "request", "DHCPDISCOVER": "discover", "DHCPRELEASE": "release", "DHCPNAK": "deny",
    "Assign": "assign", "Release": "release", "Expired": "expire",
}


def dhcp(line: Column) -> Column:
    """ISC server lines and Windows server CSV lines."""

    def isc(ts, host, kind, ip, mac, client, interface):
        kind, client = F.upper(kind), F.coalesce(client, F.lit("unknown"))
        return _record(
            line, {"dhcp_message_type": kind, "assigned_ip": ip, "mac_address": F.upper(mac), "client_hostname": client, "interface": interface},
            timestamp=ts, hostname=host, action=_of(_DHCP_ACTION, kind, "unknown"), severity="info",
            message=_text("DHCP ", kind, ": IP ", ip, " assigned to ", client, " (", mac, ")"),
        )

    def csv(eid, date, time, kind, ip, client, mac):
        client = F.coalesce(client, F.lit(""))
        return _record(
            line, {"dhcp_message_type": kind, "assigned_ip": ip, "mac_address": F.translate(F.upper(mac), "-", ":"), "client_hostname": client},
            timestamp=_text(date, " ", time), event_id=eid, action=_of(_DHCP_ACTION, kind, "unknown"), severity="info",
            message=_text("DHCP ", kind, ": IP ", ip, " to ", client, " (", mac, ")"),
        )

    return F.coalesce(_groups(line, _ISC, 7, isc), _groups(line, _DHCP_CSV, 7, csv))


# linux
_SSH_FAIL = _SYSLOG + r"sshd\[(\d+)\]:\s+Failed\s+password\s+for\s+(?:invalid user\s+)?(\S+)\s+from\s+([\d.]+)\s+port\s+(\d+)"
_SSH_OK = _SYSLOG + r"sshd\[(\d+)\]:\s+Accepted\s+(\w+)\s+for\s+(\S+)\s+from\s+([\d.]+)\s+port\s+(\d+)"
_SUDO = _SYSLOG + r"sudo:\s+(\S+)\s+:.*?USER=(\S+)\s*;\s*COMMAND=(.+)"
_GENERIC = _SYSLOG + r"(\S+?)(?:\[(\d+)\])?:\s+(.+)"


def linux(line: Column) -> Column:
    """SSH logins, sudo calls and, failing those, any syslog line."""

    def fail(ts, host, pid, user, src, port):
        return _record(
            line, {"process": "sshd", "pid": pid}, timestamp=ts, hostname=host, user=user, source_ip=src, source_port=port, action="block", protocol="SSH",
            severity="medium", message=_text("SSH login FAILED for '", user, "' from ", src),
        )

    def good(ts, host, pid, method, user, src, port):
        return _record(
            line, {"process": "sshd", "pid": pid, "auth_method": method}, timestamp=ts, hostname=host, user=user, source_ip=src, source_port=port,
            action="allow", protocol="SSH", severity="info", message=_text("SSH login SUCCESS for '", user, "' from ", src, " via ", method),
        )

    def sudo(ts, host, user, target, command):
        command = F.trim(command)
        return _record(
            line, {"process": "sudo", "target_user": target, "command": command}, timestamp=ts, hostname=host, user=user, action="privilege_escalation",
            severity="medium", message=_text("sudo: '", user, "' ran as ", target, ": ", command),
        )

    def other(ts, host, process, pid, message):
        return _record(line, {"process": process, "pid": pid}, timestamp=ts, hostname=host, action="event", severity="info", message=F.substring(message, 1, 200))

    forms = ((_SSH_FAIL, 6, fail, "sshd[", "Failed"), (_SSH_OK, 7, good, "sshd[", "Accepted"), (_SUDO, 5, sudo, "sudo:", "COMMAND="), (_GENERIC, 5, other, ":"))
    return F.coalesce(*[_groups(line, *form) for form in forms])


# windows
_EVENT_SEVERITY = {
    "4625": "high", "4648": "high", "4688": "medium", "4698": "high", "4720": "high", "4728": "high", "4732": "high", "7045": "critical",
    "4624": "info", "4634": "info", "4672": "medium",
}
_EVENT_MESSAGE = {
    "4624": "Windows: Successful logon",
    "4625": "Windows: FAILED logon attempt",
    "4634": "Windows: Logoff",
    "4648": "Windows: Logon with explicit credentials (possible pass-the-hash)",
    "4672": "Windows: Special privileges assigned to new logon",
    "4688": "Windows: New process created",
    "4698": "Windows: Scheduled task created (persistence risk)",
    "4720": "Windows: User account created",
    "4728": "Windows: User added to global security group",
    "4732": "Windows: User added to local security group",
    "7045": "Windows: New service installed (malware persistence risk)",
}
_EVENT_ACTION = {
    "4624": "allow", "4625": "block", "4634": "disconnect", "4648": "connect", "4688": "process_create", "4698": "task_create",
    "4720": "account_create", "4728": "group_change", "4732": "group_change", "7045": "service_install",
}


def _windows_message(eid: Column, **named: Column) -> Column:
    labels = {"user": "user=", "src": "from=", "process": "process=", "task": "task=", "service": "service="}
    shown = [F.when((v != "") & ((v != "-") | F.lit(k not in ("user", "src"))), _text(labels[k], v)) for k, v in named.items()]
    details = F.array_join(F.array_compact(F.array(*shown)), ", ")
    head = F.coalesce(F.element_at(F.create_map(*[x for kv in _EVENT_MESSAGE.items() for x in map(F.lit, kv)]), eid), _text("Windows Event ", eid))
    return _text(head, F.when(details != "", _text(" [", details, "]")))


def _tag(line: Column, name: str) -> Column:
    return F.coalesce(_xml_text(F.regexp_extract(line, rf"(?s)<{name}(?:\s[^>]*)?>([^<]*)</{name}>", 1)), F.lit(""))


def _data(line: Column, name: str) -> Column:
    return _xml_text(F.regexp_extract(line, rf"(?s)<Data\s[^>]*Name=[\"']{name}[\"'][^>]*>([^<]*)</Data>", 1))


def _xml_text(x: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def windows(line: Column) -> Column:
    """Event XML, with or without a namespace, and key=value lines; malformed XML gives null."""
    first = lambda *names: F.coalesce(*[_empty_null(_data(line, n)) for n in names], F.lit(""))

    def xml(eid, time, host, user, src, port, process, command, task, service, logon):
        return _record(
            line,
            {k: _empty_null(v) for k, v in (("process", process), ("cmdline", command), ("task_name", task), ("svc_name", service), ("logon_type", logon))},
            timestamp=time, hostname=host, event_id=eid, user=_empty_null(user), source_ip=F.when(~src.isin("", "-"), src),
            source_port=F.when(port.rlike(r"^\d+$"), port), action=_of(_EVENT_ACTION, eid, "event"), severity=_of(_EVENT_SEVERITY, eid, "info"),
            message=_windows_message(eid, user=user, src=src, process=process, task=task, service=service),
        )

    def flat(eid, user, src, time, host):
        made = _record(
            line, None, timestamp=_empty_null(time), hostname=_empty_null(host), event_id=eid, user=_empty_null(user), source_ip=F.when(~src.isin("", "-"), src),
            action=_of(_EVENT_ACTION, eid, "event"), severity=_of(_EVENT_SEVERITY, eid, "info"), message=_windows_message(eid, user=user, src=src),
        )
        return F.when(eid != "", made)

    values = [
        F.trim(_tag(line, "EventID")), F.regexp_extract(line, r"<TimeCreated\s[^>]*SystemTime=[\"']([^\"']*)[\"']", 1), _tag(line, "Computer"),
        first("TargetUserName", "SubjectUserName"), first("IpAddress"), first("IpPort"), first("NewProcessName", "ProcessName"), first("CommandLine"),
        first("TaskName"), first("ServiceName"), first("LogonType"),
    ]
    pairs = lambda m: _bind(
        flat, _pick(m, "EventID"), _pick(m, "TargetUserName", "User"), _pick(m, "IpAddress"), _pick(m, "TimeCreated", "Timestamp"), _pick(m, "Computer", "Hostname")
    )
    whole = line.rlike(r"(?s)^<Event(?:\s[^>]*)?>.*</Event>$")
    return F.when(line.startswith("<Event"), F.when(whole, _bind(xml, *values))).when(line.contains("EventID="), let(key_values(line), pairs))


# authentication
_OUTCOME = {"SUCCESS": "allow", "FAILURE": "block", "SKIPPED": "skip", "ALLOW": "allow", "DENY": "block"}
_AUTH = _SYSLOG + r"(\S+?)(?:\[\d+\])?:\s+(.+)"


def authentication(line: Column) -> Column:
    """Identity-provider JSON and login messages of syslog."""

    def json(user, src, result, reason, kind, agent, country, time):
        kind, action = _empty_null(kind), _of(_OUTCOME, result, "event")
        return _record(
            line,
            {"event_type": kind, "outcome": result, "reason": _empty_null(reason), "user_agent": _empty_null(agent), "geo_country": _empty_null(country)},
            timestamp=time, user=_empty_null(user), source_ip=_empty_null(src), action=action, event_id=kind, severity=F.when(action == "block", "high").otherwise("info"),
            message=_text("Auth ", result, " for ", _or(user, "unknown"), " from ", _or(src, "unknown"), F.when(reason != "", _text(" (", reason, ")"))),
        )

    def inner(d: Column) -> Column:
        def use(actor: Column, client: Column, outcome: Column) -> Column:
            plain = _pick(d, "outcome", default="{}")
            result = F.upper(F.when(outcome.isNotNull(), _pick(outcome, "result", default="UNKNOWN")).otherwise(plain))
            reason = F.when(outcome.isNotNull(), _pick(outcome, "reason")).otherwise("")
            agent, country = _pick(_object(_pick(client, "userAgent")), "rawUserAgent"), _pick(_object(_pick(client, "geographicalContext")), "country")
            src = _pick(client, "ipAddress", "ip", default=_pick(d, "ip"))
            kind = _pick(d, "eventType", "event_type", "type")
            return _bind(json, _pick(actor, "login", "email", "id"), src, result, reason, kind, agent, country, _pick(d, "timestamp", "time", "created"))

        return _bind(use, _object(_pick(d, "actor")), _object(_pick(d, "client")), _object(_pick(d, "outcome", default="{}")))

    def plain(ts, host, process, message):
        loud = F.upper(message)
        bad, good = loud.rlike("FAIL|INVALID|DENIED|WRONG"), loud.rlike("SUCCESS|ACCEPTED|OPENED SESSION")
        return _record(
            line, {"process": process}, timestamp=ts, hostname=host, action=F.when(bad, "block").when(good, "allow").otherwise("event"),
            severity=F.when(bad, "medium").otherwise("info"), message=_text("Auth event [", process, "]: ", F.substring(message, 1, 150)),
        )

    return F.when(line.startswith("{"), let(_object(line), lambda d: F.when(d.isNotNull(), inner(d)))).otherwise(_groups(line, _AUTH, 4, plain, ":"))


# web server
_COMBINED = r"^([\d.]+)\s+-\s+(\S+)\s+\[([^\]]+)\]\s+\"(\w+)\s+(.+?)\s+HTTP/([\d.]+)\"\s+(\d{3})\s+(\d+|-)\s+\"([^\"]*)\"\s+\"([^\"]*)\""
#: In this order; the first that fits names the attack.
ATTACKS = [
    ("sql_injection", r"(?:union\s+select|union%20select|select\s+.*from|insert\s+into|drop\s+table)"),
    ("xss", r"(?:<script|javascript:|onerror=|onload=)"),
    ("path_traversal", r"(?:\.\./|%2e%2e%2f|%252e%252e)"),
    ("command_injection", r"(?:;ls|;id|;cat\s|&&\s*id|`id`|`whoami`)"),
    ("scanner", r"(?:sqlmap|nikto|nmap|masscan|gobuster|dirsearch|burpsuite)"),
    ("lfi", r"(?:/etc/passwd|/etc/shadow|/proc/self)"),
    ("webshell", r"(?:cmd\.exe|powershell|wget\s+http|curl\s+http)"),
]
#: What a request in ASCII, in lower case, has in it if the pattern of the attack fits.
_SIGNS = {
    "sql_injection": ("union", "select", "insert", "drop"), "xss": ("<script", "javascript:", "onerror=", "onload="),
    "path_traversal": ("../", "%2e%2e%2f", "%252e%252e"), "command_injection": (";ls", ";id", ";cat", "&&", "`id`", "`whoami`"),
    "scanner": ("sqlmap", "nikto", "nmap", "masscan", "gobuster", "dirsearch", "burpsuite"), "lfi": ("/etc/passwd", "/etc/shadow", "/proc/self"),
    "webshell": ("cmd.exe", "powershell", "wget", "curl"),
}


def attack_type(request: Column) -> Column:
    """The class of attack that a request's path and user agent show; null for none."""

    def named(low: Column, plain: Column) -> Column:
        likely = {n: ~plain | reduce(Column.__or__, [low.contains(x) for x in _SIGNS[n]]) for n, _ in ATTACKS}
        return F.coalesce(*[F.when(likely[n] & request.rlike("(?iU)" + p), F.lit(n)) for n, p in ATTACKS])

    return let(F.lower(request), lambda low: named(low, F.length(request) == F.octet_length(request)))


def webserver(line: Column) -> Column:
    """Combined log lines."""

    def record(*groups: Column) -> Column:
        path, agent = groups[4], groups[9]
        return let(let(_text(path, " ", agent), attack_type), lambda attack: _web_record(line, attack, *groups))

    return _groups(line, _COMBINED, 10, record, "HTTP/")


def _web_record(line: Column, attack: Column, *groups: Column) -> Column:
    src, user, ts, method, path, version, status, size, referer, agent = (F.coalesce(g, F.lit("")) for g in groups)
    severity = F.when(attack.isNotNull(), "high").otherwise(_of({"2": "info", "3": "info", "4": "low", "5": "medium"}, F.substring(status, 1, 1), "info"))
    return _record(
        line,
        {
            "http_method": method, "url_path": F.substring(path, 1, 200), "http_status": to_int(status), "response_bytes": F.when(size == "-", "0").otherwise(size),
            "user_agent": F.substring(agent, 1, 200), "referer": F.when(referer != "-", referer), "attack_type": attack, "http_version": version,
            "auth_user": F.when(user != "-", user),
        },
        timestamp=ts, source_ip=src, action=F.when(attack.isNotNull(), "detect").when(status.startswith("2"), "allow").otherwise("event"), severity=severity,
        message=_text("HTTP ", method, " ", F.substring(path, 1, 80), " -> ", status, F.when(attack.isNotNull(), _text(" [ATTACK:", attack, "]"))),
    )


# application
_LEVELS = {
    "TRACE": "info", "DEBUG": "info", "INFO": "info", "WARNING": "low", "WARN": "low", "ERROR": "medium", "CRITICAL": "high", "FATAL": "critical",
    "EMERGENCY": "critical",
}
_APP = r"(?:\[([^\]]+)\]|([\d\-T:.Z+]+))\s+(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL|EMERGENCY)\s+(?:(\S+):\s+)?(.+)"


def application(line: Column) -> Column:
    """JSON log lines of several frameworks and bracketed text lines."""

    def build(ts: Column, level: Column, service: Column, message: Column, extra: dict, **more: object) -> Column:
        return _record(
            line, {"log_level": level, "service": _empty_null(service), **extra}, timestamp=_empty_null(ts), severity=_of(_LEVELS, level, "info"),
            action=F.when(level.isin("ERROR", "CRITICAL", "FATAL"), "error").otherwise("event"),
            message=_text("[", _or(service, "app"), "] ", level, ": ", F.substring(message, 1, 200)), **more,
        )

    def json(d: Column) -> Column:
        return _bind(
            lambda ts, level, service, message, error, user, src: build(
                ts, level, service, message, {"error": F.substring(_empty_null(error), 1, 300)}, user=_empty_null(user), source_ip=_empty_null(src)
            ),
            _pick(d, "time", "timestamp", "@timestamp", "t"), F.upper(_pick(d, "level", "severity", "lvl", default="INFO")), _pick(d, "service", "app", "logger"),
            _pick(d, "msg", "message", "log"), _pick(d, "error", "err", "exception"), _pick(d, "user", "username", "user_id"), _pick(d, "ip", "client_ip", "remote_addr"),
        )

    def plain(bracketed, bare, level, service, message):
        return build(F.coalesce(bracketed, bare, F.lit("")), F.upper(level), F.coalesce(service, F.lit("")), message, {})

    return F.when(line.startswith("{"), let(_object(line), lambda d: F.when(d.isNotNull(), json(d)))).otherwise(_groups(line, _APP, 5, plain))


# flows
_FLOW_CSV = r"([\d\-T:.Z]+),([\d\-T:.Z]+),([\d.]+),([\d.]+),([\d.]+),(\d+),(\d+),(\w+).*?,(\d+),(\d+)"
BACKDOOR_PORTS = (4444, 4445, 5555, 6666, 8888, 1337, 31337)


def netflow(line: Column) -> Column:
    """Flow JSON and flow CSV; backdoor ports and large flows stand out."""

    def build(ts: Column, src: Column, dst: Column, spt: Column, dpt: Column, proto: Column, size: Column, packets: Column, duration: Column) -> Column:
        port, many = F.coalesce(to_int(dpt), F.lit(0)), F.coalesce(to_int(size), F.lit(0))
        sport, seconds = F.coalesce(to_int(spt), F.lit(0)), F.coalesce(duration.try_cast("double"), F.lit(0.0))
        odd = port.isin(*BACKDOOR_PORTS) | (many > 100_000_000)
        return _record(
            line, {"bytes": many, "packets": F.coalesce(to_int(packets), F.lit(0)), "duration_sec": seconds}, timestamp=_empty_null(ts),
            source_ip=_empty_null(src), destination_ip=_empty_null(dst), source_port=F.when(sport != 0, sport), destination_port=F.when(port != 0, port),
            protocol=_empty_null(proto), action=F.when(odd, "detect").otherwise("connect"),
            severity=F.when(odd, "high").when(many > 10_000_000, "medium").otherwise("info"),
            message=_text("NetFlow: ", src, ":", sport, " -> ", dst, ":", port, " [", proto, "] ", many, " bytes ", F.coalesce(to_int(packets), F.lit(0)), " pkts ", F.format_string("%.1f", seconds), "s"),
        )

    def json(d: Column) -> Column:
        return _bind(
            build,
            _pick(d, "start", "timestamp", "ts"), _pick(d, "src_ip", "source_ip", "src"), _pick(d, "dst_ip", "dest_ip", "dst"),
            _pick(d, "src_port", "source_port", "sport", default="0"), _pick(d, "dst_port", "dest_port", "dport", default="0"),
            F.upper(_pick(d, "proto", "protocol", default="TCP")), _pick(d, "bytes", "byte_count", default="0"),
            _pick(d, "packets", "packet_count", "pkts", default="0"), _pick(d, "duration", "flow_duration", default="0"),
        )

    def csv(ts, _, seconds, src, dst, spt, dpt, proto, packets, size):
        return build(ts, src, dst, spt, dpt, proto, size, packets, seconds)

    return F.when(line.startswith("{"), let(_object(line), lambda d: F.when(d.isNotNull(), json(d)))).otherwise(_groups(line, _FLOW_CSV, 10, csv, ","))


# intrusion detection
_SNORT = r"([\d/\-:.]+)\s+\[\*\*\]\s+\[\d+:(\d+):\d+\]\s+([^\[]+?)\s*\[\*\*\].*?\[Priority:\s*(\d)\]\s+\{(\w+)\}\s+([\d.]+):(\d+)\s+->\s+([\d.]+):(\d+)"
_PRIORITY = {"1": "critical", "2": "high", "3": "medium", "4": "low"}


def ids_ips(line: Column) -> Column:
    """Suricata EVE events and Snort fast-log lines."""

    def eve(d: Column) -> Column:
        at = lambda k: F.element_at(d, F.lit(k))
        kind, ts, src, dst = _pick(d, "event_type"), _pick(d, "timestamp"), at("src_ip"), at("dest_ip")
        quiet = _record(line, {"event_type": kind}, timestamp=ts, source_ip=src, destination_ip=dst, action="event", severity="info", message=_text("Suricata ", kind, " event"))
        action = F.when(kind == "drop", "block").otherwise("detect")

        def loud(name, category, sid, severity):
            return _record(
                line,
                {
                    "signature": _empty_null(name), "category": _empty_null(category), "sig_id": _empty_null(sid), "in_iface": _empty_null(_pick(d, "in_iface")),
                    "flow_id": _empty_null(_pick(d, "flow_id")),
                },
                timestamp=ts, source_ip=src, destination_ip=dst, source_port=at("src_port"), destination_port=at("dest_port"), protocol=_empty_null(F.upper(_pick(d, "proto"))),
                action=action, event_id=_empty_null(sid), severity=_of(_PRIORITY, severity, "medium"),
                message=_text("IDS ", F.upper(action), ": ", name, F.when(category != "", _text(" [", category, "]"))),
            )

        alert = lambda m: _bind(
            loud, _pick(m, "signature", default="Unknown signature"), _pick(m, "category"), _pick(m, "signature_id"), _pick(m, "severity", default="3")
        )
        return F.when(d.isNotNull(), F.when(kind.isin("alert", "drop"), let(_object(_pick(d, "alert", default="{}")), alert)).otherwise(quiet))

    def snort(ts, sid, name, priority, proto, src, spt, dst, dpt):
        name = F.trim(name)
        return _record(
            line, {"signature": name, "sig_id": sid}, timestamp=ts, source_ip=src, destination_ip=dst, source_port=spt, destination_port=dpt, protocol=F.upper(proto),
            action="detect", event_id=sid, severity=_of(_PRIORITY, priority, "medium"), message=_text("IDS DETECT: ", name),
        )

    return F.when(line.startswith("{"), let(_object(line), eve)).otherwise(_groups(line, _SNORT, 9, snort, "[**]", "[Priority:"))


# file audit
_SYSCALLS = {
    "2": "open", "3": "close", "59": "execve", "82": "rename", "83": "mkdir", "84": "rmdir", "87": "unlink", "90": "chmod", "92": "chown", "257": "openat",
    "263": "unlinkat",
}
SENSITIVE = ("/etc/shadow", "/etc/passwd", "/etc/sudoers", "/.ssh/", "id_rsa", ".bash_history", "/var/log/auth")


def file_audit(line: Column) -> Column:
    """Audit PATH and SYSCALL records, each on its own."""
    epoch = F.regexp_extract(line, r"msg=audit\(([.\d]+):", 1)
    ts = audit_iso(F.when(epoch == "", "0").otherwise(epoch))

    def named(key: str) -> Column:
        """The value of a key: what stands between quotes, else the text up to white space."""
        quoted = lambda v: v.startswith('"') & v.endswith('"') & (F.length(v) >= 3) & (F.substring(v, 2, 1) != '"')
        return let(F.regexp_extract(line, rf'{key}=("[^"]+"|\S+)', 1), lambda v: _empty_null(F.when(quoted(v), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)))

    def seen(path: Column) -> Column:
        def made(sensitive: Column) -> Column:
            return _record(
                line, {"file_path": path, "sensitive": sensitive}, timestamp=ts, action="file_access", severity=F.when(sensitive, "high").otherwise("info"),
                message=_text("File access: ", path, F.when(sensitive, " [SENSITIVE]")),
            )

        return F.when(path.isNotNull(), let(F.coalesce(F.greatest(*[path.contains(s) for s in SENSITIVE]), F.lit(False)), made))

    def made(call: Column, exe: Column, key: Column) -> Column:
        return _record(
            line, {"syscall": call, "exe": exe, "audit_key": key}, timestamp=ts, action=_text("file_", call), severity=F.when(key.isNotNull(), "medium").otherwise("info"),
            message=_text("Audit syscall=", call, " exe=", exe, F.when(key.isNotNull(), _text(" key=", key))),
        )

    call = _of(_SYSCALLS, F.regexp_extract(line, r"\bsyscall=(\d+)", 1), "unknown")
    calls = _bind(made, call, F.coalesce(named("exe"), named("comm")), named("key"))
    return F.when(line.startswith("type=PATH"), let(named("name"), seen)).when(line.startswith("type=SYSCALL"), calls)


# endpoints
_TOOLS = ("mimikatz.exe", "meterpreter", "cobaltstrike", "psexec.exe", "procdump.exe")
_LOLBINS = ("mshta.exe", "regsvr32.exe", "certutil.exe", "bitsadmin.exe", "wmic.exe")
_COMMANDS = (r"-[Ee]nc\w*\s+[A-Za-z0-9+/]{20,}", r"(?i)IEX\s*\(", r"(?i)DownloadString|WebClient", r"(?i)vssadmin\s+delete", r"(?i)net\s+user\s+.*\s+/add")


def edr(line: Column) -> Column:
    """Endpoint JSON; known tools come before odd command lines, and those before system tools that attackers use."""

    def record(name, command, user, kind, port, proto, dst, pid, parent, digest, time, host):
        odd = F.coalesce(F.greatest(*[command.rlike(p) for p in _COMMANDS]), F.lit(False))
        found = F.when(F.lower(name).isin(*_TOOLS), _text("known_tool:", name)).when(odd, F.lit("suspicious_cmdline")).when(F.lower(name).isin(*_LOLBINS), _text("lolbin:", name))
        return let(
            found,
            lambda indicator: _record(
                line,
                {
                    "process_name": _empty_null(name), "process_pid": _empty_null(pid), "cmdline": _empty_null(F.substring(command, 1, 300)),
                    "parent_process": _empty_null(parent), "file_hash": _empty_null(digest), "attack_indicator": indicator, "event_type": _empty_null(kind),
                },
                timestamp=_empty_null(time), hostname=_empty_null(host), user=_empty_null(user), destination_ip=_empty_null(dst), destination_port=_empty_null(port),
                protocol=_empty_null(F.upper(proto)), action=F.when(indicator.isNotNull(), "detect").otherwise(F.replace(F.lower(kind), F.lit(" "), F.lit("_"))),
                event_id=_empty_null(kind), severity=F.when(indicator.isNotNull(), "high").otherwise("info"),
                message=_text("EDR ", kind, " [proc=", name, ", user=", user, "]", F.when(indicator.isNotNull(), _text(" ALERT:", indicator))),
            ),
        )

    def inner(d: Column) -> Column:
        def use(process: Column, net: Column) -> Column:
            return _bind(
                record,
                _pick(process, "name", "exe"), _pick(process, "cmdline", "command_line"), _pick(d, "user", "username"),
                _pick(d, "event_type", "eventType", default="unknown"), _pick(net, "dst_port"), _pick(net, "proto"), _pick(net, "dst_ip"), _pick(process, "pid"),
                _pick(process, "parent_name"), _pick(process, "hash_sha256", "md5"), _pick(d, "timestamp", "time"), _pick(d, "hostname", "host"),
            )

        return _bind(use, _object(_pick(d, "process")), _object(_pick(d, "network")))

    return let(_object(line), lambda d: F.when(d.isNotNull(), inner(d)))


PARSERS: dict[str, Callable[[Column], Column]] = {
    "firewall": firewall, "dns": dns, "dhcp": dhcp, "linux": linux, "windows": windows, "authentication": authentication, "webserver": webserver,
    "application": application, "netflow": netflow, "ids_ips": ids_ips, "file_audit": file_audit, "edr": edr,
}


def parse(lines: DataFrame, log_type: str, value: str = "value") -> DataFrame:
    """The records of the lines that the parser of ``log_type`` reads, with log_type; other columns pass through."""
    stripped = F.regexp_replace(F.col(value), r"^\s+|\s+$", "")
    record = let(stripped, PARSERS[log_type])
    # a generator both drops nulls and makes each record once
    return lines.select(*[c for c in lines.columns if c != value], F.lit(log_type).alias("log_type"), F.inline(F.array_compact(F.array(record))))


def parse_typed(lines: DataFrame, kind: Column, value: str = "value") -> DataFrame:
    """As ``parse``, each line by the parser of its own type; lines of an unknown type are left out."""
    stripped = F.regexp_replace(F.col(value), r"^\s+|\s+$", "")
    made = F.when(F.lit(False), F.lit(None))
    for k, parser in PARSERS.items():
        made = made.when(kind == k, let(stripped, lambda t, k=k, parser=parser: let(parser(t), _typed(k))))
    found = lines.select(*[c for c in lines.columns if c != value], F.inline(F.array_compact(F.array(made))))
    return found.select(*[c for c in lines.columns if c != value], "log_type", "r.*")


def parse_syslog(lines: DataFrame, value: str = "value") -> DataFrame:
    """Syslog lines of unknown origin: priority cut off, then linux, firewall, dns and application parsers in turn, else ``application`` as it is."""
    line = F.regexp_replace(strip_priority(F.col(value)), r"^\s+|\s+$", "")

    def made(text: Column) -> Column:
        tried = [let(PARSERS[k](text), _typed(k)) for k in ("linux", "firewall", "dns", "application")]
        rest = F.struct(F.lit("application").alias("log_type"), _record(text, None, message=F.substring(text, 1, 120), severity="info", action="event").alias("r"))
        return F.when(text != "", F.coalesce(*tried, rest))

    found = lines.select(*[c for c in lines.columns if c != value], F.inline(F.array_compact(F.array(let(line, made)))))
    return found.select(*[c for c in lines.columns if c != value], "log_type", "r.*")


def _typed(kind: str) -> Callable[[Column], Column]:
    return lambda r: F.when(r.isNotNull(), F.struct(F.lit(kind).alias("log_type"), r.alias("r")))
