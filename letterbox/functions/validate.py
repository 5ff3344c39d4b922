"""Verdicts on addresses, domains, links and pages as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from letterbox.functions import patterns as P
from letterbox.functions.clean import domain_part, let, local_part, one_at

#: fixed values: file suffixes an address found in markup often ends in (a longer list is a setting)
FILE_SUFFIXES = [
    "123", "3ds", "3g2", "3gp", "7z", "aac", "ai", "aif", "aiff", "apk", "arj", "asm", "asp", "aspx", "avif", "avi", "bak", "bat", "bin", "bmp",
    "bz2", "c", "cab", "cbr", "cbz", "cda", "cer", "cfg", "cfm", "cgi", "class", "com", "cpp", "cr2", "cr3", "crw", "cs", "csr", "css", "csv", "cur",
    "dat", "db", "dbf", "deb", "dll", "dmg", "dmp", "doc", "docm", "docx", "dot", "dotx", "drv", "dtb", "dwg", "dxf", "eps", "exe", "flac", "fla",
    "flv", "fnt", "fon", "gadget", "gif", "gz", "h", "heic", "heif", "hqx", "htm", "html", "ico", "ics", "img", "ini", "iso", "jar", "java", "jpeg",
    "jpg", "js", "json", "jsp", "key", "lnk", "log", "m4a", "m4v", "mcd", "mdb", "mid", "midi", "mkv", "mov", "mp3", "mp4", "mpa", "mpeg", "mpg",
    "msi", "msu", "nef", "obj", "odp", "ods", "odt", "oft", "ogg", "opus", "orf", "ost", "otf", "p12", "p7c", "pagx", "pas", "pct", "pdb", "pdf",
    "pem", "php", "pif", "pkg", "pl", "plugin", "png", "pps", "ppsm", "ppsx", "ppt", "pptm", "pptx", "ps", "psd", "pst", "pub", "py", "qt", "ra",
    "ram", "rar", "raw", "rb", "rm", "rpm", "rss", "rtf", "sav", "sdf", "sh", "sitx", "sql", "sr2", "svg", "swf", "swift", "swo", "swp", "sys", "tar",
    "tex", "tga", "thm", "tif", "tiff", "tmp", "toast", "ttf", "txt", "vcd", "vcf", "vcs", "vmdk", "vob", "wav", "webm", "webp", "woff", "woff2",
    "wma", "wmv", "wpd", "wpl", "wsf", "xhtml", "xlr", "xls", "xlsb", "xlsm", "xlsx", "xml", "yuv", "zip", "zipx", "zpl",
]
#: fixed values: suffixes of links that are no pages
CONTACT_SUFFIXES = [
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".webp", ".tiff", ".tif", ".ico", ".avif", ".heic", ".heif", ".raw", ".cr2", ".nef", ".orf",
    ".sr2", ".mp3", ".wav", ".ogg", ".opus", ".aac", ".flac", ".m4a", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".mkv", ".webm", ".m4v", ".3gp", ".mpg",
    ".mpeg", ".zip", ".rar", ".tar", ".gz", ".7z", ".bz2", ".xz", ".exe", ".dll", ".bin", ".bat", ".sh", ".msi", ".iso", ".dmg", ".img", ".vmdk",
    ".js", ".css", ".json", ".xml", ".pdf", ".xlsx", ".xls", ".csv", ".ppt", ".pptx", ".doc", ".docx", ".odt", ".ods", ".odp", ".rtf", ".tmp", ".bak",
    ".swf", ".fla", ".swo", ".swp", ".log", ".db", ".sqlite", ".sql", ".py", ".java", ".cpp", ".c", ".h", ".php", ".html", ".htm", ".xhtml", ".woff",
    ".woff2", ".ttf", ".otf", ".eot",
]


def any_of(words: Sequence[str]) -> str:
    """One alternation of literals; Java's and RE2's syntax agree on it."""
    return "|".join(re.sub(r"([^\w@ -])", r"\\\1", w) for w in words)


def says(text: Column, words: Sequence[str]) -> Column:
    """Whether any of the literals is in the text; an alternation would be tried at every place of it."""
    return let(text, lambda x: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(x, w)))


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def well_formed(email: Column) -> Column:
    """The syntax of an address as a whole, in ASCII."""
    return email.rlike(P.WHOLE) & is_ascii(email)


def basic_syntax(email: Column) -> Column:
    local, domain = local_part(email), domain_part(email)
    return email.rlike(P.SYNTAX) & one_at(email) & (local != "") & F.contains(domain, F.lit(".")) & ~local.rlike(r"^\.|\.$") & ~domain.rlike("^-|-$")


def security_pattern(email: Column) -> Column:
    return says(F.lower(email), P.SECURITY_WORDS)


def bad_suffix(email: Column, suffixes: Sequence[str] = FILE_SUFFIXES, compat: bool = False) -> Column:
    """The last label is a file suffix and no real top level; ``compat``: the address ends in any of them."""
    if compat:
        return email.rlike(f"(?:{any_of(suffixes)})$")
    tld = F.lower(F.substring_index(email, ".", -1))
    return tld.isin(*[x for x in suffixes if x not in P.REAL_TLDS])


def additional_failure(email: Column) -> Column:
    """Name of the first further check that fails, null where none does."""
    local, domain = local_part(email), domain_part(email)
    tld = F.substring_index(domain, ".", -1)
    rules = [
        ("one at", ~one_at(email)),
        ("local length", ~F.octet_length(local).between(1, 64)),
        ("domain length", ~F.octet_length(domain).between(3, 253)),
        ("double dot", F.contains(email, F.lit(".."))),
        ("edge dot", local.rlike(r"^\.|\.$")),
        ("edge dash", domain.rlike("^-|-$")),
        ("forbidden character", local.rlike(P.FORBIDDEN)),
        ("phone number", local.rlike(r"\d{6,}")),
        ("phone prefix", local.rlike(r"^\d{3,6}[a-zA-Z]|^\+?[\d\-\s]+?\d[a-zA-Z]")),
        ("city and number", local.rlike(r"\d{4,}") & F.lower(local).rlike(f"^(?:{any_of(P.CITIES)})")),
        ("no dot", ~F.contains(domain, F.lit("."))),
        ("top level", ~tld.rlike("^[a-zA-Z]{2,63}$")),
        ("test address", says(F.lower(email), P.TEST_ADDRESSES)),
    ]
    out = F.lit(None).cast("string")
    for name, failed in reversed(rules):
        out = F.when(failed, F.lit(name)).otherwise(out)
    return out


def rejection_reason(email: Column, disposable: Column, has_mx: Column, unknown_mx_passes: bool = True, compat: bool = False, suffixes: Sequence[str] = FILE_SUFFIXES) -> Column:
    """The label of the first step that rejects an address, null for a valid one.

    ``disposable`` and ``has_mx`` come from joins; ``has_mx`` is null where no snapshot knows the domain.
    """
    no_mx = ~F.coalesce(has_mx, F.lit(unknown_mx_passes))
    return (
        F.when(~basic_syntax(email), P.REASONS["syntax"])
        .when(security_pattern(email), P.REASONS["security"])
        .when(F.coalesce(disposable, F.lit(False)), P.REASONS["disposable"])
        .when(bad_suffix(email, suffixes, compat), P.REASONS["suffix"])
        .when(no_mx, P.REASONS["mx"])
        .when(additional_failure(email).isNotNull(), P.REASONS["additional"])
    )


def in_example_context(email: Column, text: Column, reach: int = 100, near: int = 50) -> Column:
    """Whether a word of examples starts less than ``near`` bytes from the address, within ``reach`` around it.

    Offsets are bytes of the lower-cased text. An address that the text does not have is in no such context.
    """
    def as_bytes(value: Column) -> Column:  # a character for each byte, so that places are places of bytes
        return F.decode(F.encode(F.lower(value), "UTF-8"), "ISO-8859-1")

    def near_word(x: Column) -> Column:
        low, key, at = x["low"], x["key"], x["at"]
        start = F.greatest(at - 1 - reach, F.lit(0))
        window = F.substr(low, start + 1, at - 1 - start + F.length(key) + reach)
        hits = let(window, lambda w: F.transform(F.array(*[F.lit(k) for k in P.EXAMPLE_WORDS]), lambda k: F.position(k, w)))
        close = F.exists(hits, lambda h: (h > 0) & (F.abs(h - at + start) < near))
        return (at > 0) & close

    both = let(F.struct(as_bytes(text).alias("low"), as_bytes(email).alias("key")), lambda x: F.struct(x["low"].alias("low"), x["key"].alias("key"), F.position(x["key"], x["low"]).alias("at")))
    return F.coalesce(let(both, near_word), F.lit(False))


def valid_domain(domain: Column) -> Column:
    return F.octet_length(domain).between(1, 253) & domain.rlike(r"^[a-z0-9.-]+$") & F.contains(domain, F.lit("."))


def bad_contact_url(url: Column, suffixes: Sequence[str] = CONTACT_SUFFIXES) -> Column:
    return url.rlike(f"(?:{any_of(suffixes)})$")


def unwanted_domain(domain: Column, words: Sequence[str]) -> Column:
    return domain.rlike(any_of(words)) if words else F.lit(False)


def challenge_hits(body: Column) -> Column:
    low = F.lower(body)
    return F.size(F.filter(F.array(*[F.lit(w) for w in P.CHALLENGE]), lambda w: F.contains(low, w)))


def is_challenge(body: Column) -> Column:
    return (challenge_hits(body) >= 2) | F.contains(F.lower(body), F.lit(P.CHALLENGE_ALONE))
