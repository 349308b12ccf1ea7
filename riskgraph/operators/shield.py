"""Static triage of application packages: binary manifests decoded, indicators mined, a score with its reasons."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
from collections import Counter
from collections.abc import Iterator
from typing import IO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.functions.text import MAIL_HOSTS, MINED

P = "android.permission."
# Weights of permissions and of combinations that tell together what neither tells alone.
PERMISSIONS = {
    P + "READ_SMS": 7, P + "RECEIVE_SMS": 8, P + "SEND_SMS": 6, P + "SYSTEM_ALERT_WINDOW": 8, P + "BIND_ACCESSIBILITY_SERVICE": 10, P + "REQUEST_INSTALL_PACKAGES": 6, P + "READ_CONTACTS": 3,
    P + "READ_PHONE_STATE": 3, P + "RECORD_AUDIO": 5, P + "CAMERA": 3, P + "ACCESS_FINE_LOCATION": 2, P + "WRITE_EXTERNAL_STORAGE": 2, P + "FOREGROUND_SERVICE": 1, P + "RECEIVE_BOOT_COMPLETED": 3,
    P + "DISABLE_KEYGUARD": 4, P + "GET_ACCOUNTS": 3, P + "QUERY_ALL_PACKAGES": 4, P + "BIND_DEVICE_ADMIN": 7, P + "CALL_PHONE": 3, P + "INTERNET": 0,
}
TOXIC = (
    ((P + "RECEIVE_SMS", P + "SYSTEM_ALERT_WINDOW"), 14), ((P + "BIND_ACCESSIBILITY_SERVICE", P + "QUERY_ALL_PACKAGES"), 12),
    ((P + "BIND_DEVICE_ADMIN", P + "RECEIVE_SMS"), 10), ((P + "REQUEST_INSTALL_PACKAGES", P + "BIND_ACCESSIBILITY_SERVICE"), 10),
)
PACKERS = (b"libjiagu", b"libDexHelper", b"libsecexe", b"libapp_shell", b"libDexGuard", b"stub/StubApp")
# What an indicator of a kind is sure of before its carrier is looked at; column, kind, confidence.
SURE = (("vpas", "UPI_VPA", 0.72), ("accounts", "ACCOUNT", 0.55), ("ips", "IP", 0.5), ("urls", "URL", 0.45), ("phones", "PHONE", 0.5))
#: Class names of two characters or fewer and all, of which OBFUSCATED is a heavy share; NAMES are needed to tell.
NAME, OBFUSCATED, NAMES = re.compile(r"L[a-zA-Z0-9/$_]{1,40};"), 0.55, 50
#: Bytes of a .dex scanned at once, and those of the next window read along with them; no indicator is as long.
WINDOW, OVERLAP = 8 << 20, 1 << 10
PATTERNS = {column: re.compile(MINED[kind]) for column, kind in (("vpas", "vpa"), ("urls", "url"), ("ips", "ipv4"), ("ifscs", "ifsc"), ("accounts", "account"), ("phones", "phone"))}
REPORT = "path string, sha256 string, package string, permissions array<string>, vpas array<string>, urls array<string>, ips array<string>, ifscs array<string>, accounts array<string>, phones array<string>, packed boolean, obfuscation double, signed boolean, error string"


def string_pool(data: bytes) -> list[str]:
    """Strings of a binary XML document's pool; what can't be decoded ends the list."""
    at = data.find(b"\x01\x00\x1c\x00")
    if at < 0 or len(data) < at + 28:
        return []
    count, _, flags, begin = struct.unpack_from("<IIII", data, at + 8)
    utf8, out = bool(flags & 0x100), []
    try:
        for i in range(count):
            p = at + begin + struct.unpack_from("<I", data, at + 28 + 4 * i)[0]
            if utf8:
                p += 2 if data[p] & 0x80 else 1  # length in characters
                n = data[p]
                p, n = (p + 2, (n & 0x7F) << 8 | data[p + 1]) if n & 0x80 else (p + 1, n)
                out.append(data[p : p + n].decode("utf-8", "replace"))
            else:
                n = struct.unpack_from("<H", data, p)[0]
                p, n = (p + 4, (n & 0x7FFF) << 16 | struct.unpack_from("<H", data, p + 2)[0]) if n & 0x8000 else (p + 2, n)
                out.append(data[p : p + 2 * n].decode("utf-16-le", "replace"))
    except (struct.error, IndexError):
        pass
    return out


def mine(dex: IO[bytes], found: dict[str, set[str]], window: int = WINDOW, names: Counter | None = None) -> bool:
    """Adds the indicators of one .dex of any size to found, counts class names and short ones in names, and says whether it
    holds a packer's mark.

    A window is scanned with OVERLAP bytes on; what begins in those is left to the next window, which starts where the last
    match of the pattern ended, as one scan of the whole would.
    """
    names = Counter() if names is None else names
    held, packed, at, patterns = b"", False, dict.fromkeys([*found, "names"], 0), PATTERNS | {"names": NAME}
    while True:
        more = dex.read(window + OVERLAP)
        data = held + more
        text, last = data.decode("latin-1"), not more
        cut = len(data) if last else max(len(data) - OVERLAP, 0)
        packed |= any(p in data for p in PACKERS)
        for kind in at:
            for m in patterns[kind].finditer(text, at[kind]):
                if m.start() >= cut:
                    break
                at[kind] = m.end()
                if kind == "names":
                    names["all"] += 1
                    names["short"] += len(m[0].rsplit("/", 1)[-1].rstrip(";")) <= 2
                else:
                    found[kind].add(m[0])
        if last:
            return packed
        # OVERLAP bytes before the cut stay, so that a pattern sees what stands before its match
        keep = max(cut - OVERLAP, 0)
        held = data[keep:]
        at = {kind: max(end, cut) - keep for kind, end in at.items()}


def is_payment(address: str) -> bool:
    handle = address.rsplit("@", 1)[-1].lower()
    return handle not in MAIL_HOSTS and 3 <= len(handle) <= 12


def is_remote(ip: str) -> bool:
    octets = [int(x) for x in ip.split(".")]
    return max(octets) <= 255 and octets[0] not in (0, 127, 255)


def triage_bytes(content: bytes) -> dict:
    """Package, permissions and indicators of one archive; an unreadable one says why. Numbers count as accounts only beside a
    bank's code or a payment address."""
    out = {"sha256": hashlib.sha256(content).hexdigest(), "package": None, "permissions": [], "packed": False, "obfuscation": 0.0, "signed": False, "error": None}
    found, names = {kind: set() for kind in PATTERNS}, Counter()
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            strings = string_pool(z.read("AndroidManifest.xml")) if "AndroidManifest.xml" in z.namelist() else []
            inside = "\n".join(z.namelist())
            packed = any(p in inside.encode() for p in PACKERS)
            for info in z.infolist():
                if info.filename.endswith(".dex"):
                    with z.open(info) as dex:
                        packed |= mine(dex, found, names=names)
    except (zipfile.BadZipFile, OSError, ValueError) as e:
        return out | {kind: [] for kind in PATTERNS} | {"error": str(e)}
    found["vpas"], found["ips"] = set(filter(is_payment, found["vpas"])), set(filter(is_remote, found["ips"]))
    if not found["ifscs"] and not found["vpas"]:
        found["accounts"] = set()
    reverse = sorted((s for s in strings if re.fullmatch(r"[a-z][a-z0-9_]*(\.[a-z0-9_]+){1,5}", s) and not s.startswith("android.")), key=lambda s: (len(s), s))
    return out | {kind: sorted(values) for kind, values in found.items()} | {
        "package": reverse[0] if reverse else None, "permissions": sorted({s for s in strings if s.startswith(P)}), "packed": packed,
        "obfuscation": round(names["short"] / names["all"], 4) if names["all"] >= NAMES else 0.0, "signed": any(re.fullmatch(r"META-INF/[^/]+\.(RSA|DSA|EC)", x) for x in inside.split("\n")),
    }


def triage(files: DataFrame) -> DataFrame:
    """A report for each row of a binaryFile source (path, content); archives are read one at a time."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([{"path": p} | triage_bytes(bytes(c)) for p, c in zip(frame["path"], frame["content"], strict=True)])

    return files.select("path", "content").mapInPandas(run, REPORT)


def score(reports: DataFrame) -> DataFrame:
    """reports with score (0 to 100), verdict and toxic (combinations found)."""
    has = lambda p: F.array_contains("permissions", p)
    toxic = sum((F.when(has(a) & has(b), 1).otherwise(0) for (a, b), _ in TOXIC), F.lit(0))
    points = sum((F.when(has(p), w).otherwise(0) for p, w in PERMISSIONS.items()), F.lit(0))
    points = sum((F.when(has(a) & has(b), w).otherwise(0) for (a, b), w in TOXIC), points)
    points = points + F.when(F.col("packed"), 10).otherwise(0) + F.when(F.col("obfuscation") > OBFUSCATED, 8).otherwise(0) + F.when(~F.col("signed") & F.col("error").isNull(), 6).otherwise(0)
    points = points + F.when(F.size("vpas") > 0, F.least(6 + 2 * F.size("vpas"), F.lit(18))).otherwise(0) + F.when(F.size("ifscs") > 0, 8).otherwise(0) + F.least(F.size("ips") * 2, F.lit(6))
    total = F.least(points, F.lit(100))
    return reports.select("*", total.alias("score"), F.when(total >= 85, "CRITICAL").when(total >= 65, "HIGH").when(total >= 40, "MEDIUM").otherwise("SAFE").alias("verdict"), toxic.alias("toxic"))


def family(permissions: Column, vpas: Column, packed: Column) -> Column:
    """What a package most looks like."""
    has = lambda p: F.array_contains(permissions, P + p)
    trojan = has("BIND_ACCESSIBILITY_SERVICE") & has("RECEIVE_SMS")
    return F.when(trojan, "BankingTrojan.Accessibility").when(has("SYSTEM_ALERT_WINDOW") & (F.size(vpas) > 0), "OverlayPhish.UPI").when(packed, "Packed.Unclassified").otherwise("Unclassified")


def confidence(base: Column) -> Column:
    """What an indicator is sure of, the more so the worse its scored carrier looks."""
    bump = F.when(F.col("verdict") == "CRITICAL", 0.15).when(F.col("verdict") == "HIGH", 0.08).otherwise(0.0)
    bump = bump + F.when(F.col("packed"), 0.04).otherwise(0.0) + F.when(F.col("toxic") > 0, 0.06).otherwise(0.0) + F.when(~F.col("signed"), 0.03).otherwise(0.0)
    return F.round(F.least(base + bump, F.lit(0.99)), 3)


def indicators(reports: DataFrame) -> DataFrame:
    """kind, value, confidence, sha256 and family: what scored reports give the threat feed, the surest carrier of each."""
    rows = F.concat(*(F.transform(c, _row(k, base)) for c, k, base in SURE), F.array(F.struct(F.lit("SHA256").alias("kind"), F.col("sha256").alias("value"), F.lit(0.9).alias("base"))))
    told = reports.where("error is null").select("*", family(F.col("permissions"), F.col("vpas"), F.col("packed")).alias("family")).withColumn("x", F.explode(rows))
    told = told.select("x.kind", "x.value", confidence(F.col("x.base")).alias("confidence"), "sha256", "family")
    return told.groupBy("kind", "value").agg(F.max(F.struct("confidence", "sha256", "family")).alias("x")).select("kind", "value", "x.*")


def _row(kind: str, base: float):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(base).alias("base"))
