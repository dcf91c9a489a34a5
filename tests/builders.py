"""Small evidence files for tests, made here."""

import struct

from evtrail.sources.binary import hive_of

SYSMON = """<?xml version="1.0"?><Events><Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>1</EventID><TimeCreated SystemTime="2026-01-02T03:04:05.1234567Z"/><Channel>Microsoft-Windows-Sysmon/Operational</Channel><Computer>WS-1</Computer></System><EventData><Data Name="Image">C:\\Windows\\powershell.exe</Data><Data Name="ProcessId">4242</Data><Data Name="ParentImage">C:\\Office\\WINWORD.EXE</Data><Data Name="ParentProcessId">7</Data><Data Name="User">CORP\\ann</Data><Data Name="CommandLine">powershell -enc QUJD</Data><Data Name="Hashes">MD5=AB,SHA256=CD</Data></EventData></Event>
<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>3</EventID><TimeCreated SystemTime="2026-01-02T03:05:05Z"/><Channel>Microsoft-Windows-Sysmon/Operational</Channel><Computer>WS-1</Computer></System><EventData><Data Name="Image">C:\\Windows\\powershell.exe</Data><Data Name="ProcessId">4242</Data><Data Name="DestinationIp">8.8.8.8</Data><Data Name="DestinationPort">4444</Data></EventData></Event></Events>"""
SECURITY = """[{"EventID": 4688, "Channel": "Security", "Computer": "WS-1", "TimeCreated": "2026-01-02T04:00:00Z", "EventData": {"NewProcessName": "C:\\\\Temp\\\\x.exe", "NewProcessId": "0x1f4", "ProcessId": "0x10", "SubjectDomainName": "CORP", "SubjectUserName": "bob", "CommandLine": "C:\\\\Temp\\\\x.exe"}},
{"EventID": 4625, "Channel": "Security", "Computer": "WS-1", "TimeCreated": "2026-01-02T04:00:01+00:00", "EventData": {"TargetDomainName": "-", "TargetUserName": "eve", "IpAddress": "10.0.0.9"}}, {"EventID": 1}]"""
TASK = """<?xml version="1.0"?><Task xmlns="http://schemas.microsoft.com/windows/2004/02/mit/task"><RegistrationInfo><URI>\\Upd</URI></RegistrationInfo><Triggers><TimeTrigger><StartBoundary>2026-01-03T00:00:00</StartBoundary></TimeTrigger></Triggers><Principals><Principal><UserId>S-1-5-18</UserId></Principal></Principals><Actions><Exec><Command>C:\\Temp\\evil.exe</Command><Arguments>/q</Arguments></Exec></Actions></Task>"""
SERVICES = '{"services": [{"name": "Bad", "image_path": "C:\\\\Temp\\\\my svc.exe -k", "start_type": 2}, {"display_name": "no name"}]}'


def prefetch(name="EVIL.EXE", runs=3, filetime=133_500_000_000_000_000) -> bytes:
    files = "\\DEVICE\\C\\TEMP\\EVIL.EXE\0".encode("utf-16-le")
    out = bytearray(84 + 224)
    struct.pack_into("<I4s", out, 0, 30, b"SCCA")
    out[16 : 16 + 2 * len(name)] = name.encode("utf-16-le")
    struct.pack_into("<I", out, 76, 0xABCD1234)
    struct.pack_into("<IIIIIIII", out, 84, 0x130, 0, 0, 0, len(out), len(files), 0, 0)
    struct.pack_into("<Q", out, 84 + 44, filetime)
    struct.pack_into("<I", out, 84 + 124, runs)
    return bytes(out) + files


def sz(text: str) -> tuple[int, bytes]:
    return 1, (text + "\0").encode("utf-16-le")


def software() -> bytes:
    run = {"values": {"Upd": sz('"C:\\Temp\\evil.exe" /s')}}
    services = {"keys": {"BadSvc": {"values": {"ImagePath": sz("C:\\Temp\\bad svc.exe"), "Start": (4, struct.pack("<I", 2))}}, "Empty": {}}}
    nested = {"Microsoft": {"keys": {"Windows": {"keys": {"CurrentVersion": {"keys": {"Run": run}}}}}}}
    return hive_of({"Software": {"keys": nested}, "ControlSet001": {"keys": {"Services": services}}})
