"""Patterns and word lists that decide what counts as an address."""

from __future__ import annotations

#: an address in running text, and the same as a whole string
EM = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
WHOLE = rf"^{EM}$"
#: the looser form with at most two labels behind the name
EXTENDED = r"[\w\.-]+@[a-zA-Z0-9-]+\.[a-zA-Z]{2,}(?:\.[a-zA-Z]{2,})?"
_U, _D, _T = r"([a-zA-Z0-9._%+-]+)", r"([a-zA-Z0-9.-]+)", r"([a-zA-Z]{2,})"
#: (user, domain, top level) with written-out separators
AT_DOT = [
    rf"{_U}\s*\[at\]\s*{_D}\s*\[dot\]\s*{_T}",
    rf"{_U}\s*\{{at\}}\s*{_D}\s*\{{dot\}}\s*{_T}",
    rf"{_U}\s*\(at\)\s*{_D}\s*\(dot\)\s*{_T}",
    rf"{_U}\s*<at>\s*{_D}\s*<dot>\s*{_T}",
    rf"{_U}\s+at\s+{_D}\s+dot\s+{_T}",
    rf"{_U}\s+AT\s+{_D}\s+DOT\s+{_T}",
]
SPACED = [rf"{_U}\s+@\s+{_D}\s+\.\s+{_T}"]
ENTITIES = [rf"{_U}&#64;{_D}&#46;{_T}", rf"{_U}&commat;{_D}&period;{_T}", rf"{_U}&#x40;{_D}&#x2e;{_T}"]
_Q = r"""['"]"""
JS_CONCAT = [rf"{_Q}{_U}{_Q}\s*\+\s*{_Q}@{_Q}\s*\+\s*{_Q}{_D}{_Q}\s*\+\s*{_Q}\.{_Q}\s*\+\s*{_Q}{_T}{_Q}"]
CHAR_CODES = r"String\.fromCharCode\(([\d,\s]+)\)"
UNESCAPE = rf"unescape\({_Q}([^'\"]+){_Q}\)"
ATOB = rf"atob\({_Q}([^'\"]+){_Q}\)"
BUSINESS = r"(?:contact|info|sales|support|admin|webmaster|marketing|help|service|billing)@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
#: patterns whose first group is an address: links, key-value pairs, attributes, structured data, styles, scripts, comments
CAPTURES = {
    "mailto": [rf"mailto:({EM})", rf"mailto=({EM})", rf"mail\s*to:({EM})"],
    "key_value": [rf"(?:email|e-mail|mail|contact)\s*[:=]\s*({EM})", rf"alt\s*=\s*[\"'][^\"']*?({EM})[^\"']*?[\"']", rf"title\s*=\s*[\"'][^\"']*?({EM})[^\"']*?[\"']"],
    "attribute": [rf"data-(?:email|contact|mail)\s*=\s*[\"']({EM})[\"']", rf"x-(?:email|contact|mail)\s*=\s*[\"']({EM})[\"']"],
    "structured": [rf'"(?:email|contactPoint|hasEmail)"\s*:\s*"({EM})"', rf"itemprop\s*=\s*[\"'](?:email|contactPoint)[\"']\s*content\s*=\s*[\"']({EM})[\"']", rf"property\s*=\s*[\"'](?:og:email|vcard:email)[\"']\s*content\s*=\s*[\"']({EM})[\"']"],
    "css": [rf"content\s*:\s*[\"']({EM})[\"']"],
    "assignment": [rf"(?:var|const|let)\s+\w+\s*=\s*[\"']({EM})[\"']"],
    "comment": [rf"<!--\s*({EM})\s*-->", rf"/\*\s*({EM})\s*\*/", rf"//\s*({EM})"],
}
#: detector patterns: (pattern, groups of which the first non-empty one is the find)
DETECTOR = {
    "js_template": (r"\$\{[^}]*email[^}]*\}", (0,)),
    "js_function": (r"email\s*\(\s*['\"]([^'\"]*@[^'\"]*)['\"]\s*\)", (1,)),
    "js_variable": (r"email\s*=\s*['\"]([^'\"]*@[^'\"]*)['\"]", (1,)),
    "js_object": (r"email\s*:\s*['\"]([^'\"]*@[^'\"]*)['\"]", (1,)),
    "image_alt": (rf"email\s*[:=]\s*({EM})", (1,)),
    "form_field": (rf"(?:email|e-mail|mail)\s*[:=]\s*({EM})", (1,)),
    "data_attr": (r'data-email="([^"]*@[^"]*)"|data-contact="([^"]*@[^"]*)"', (1, 2)),
    "json_email": (r'"email"\s*:\s*"([^"]*@[^"]*)"|"contact"\s*:\s*"([^"]*@[^"]*)"', (1, 2)),
    "microdata": (r'itemprop="email"\s+content="([^"]*@[^"]*)"', (1,)),
    "schema_org": (r'"@type"\s*:\s*"ContactPoint"[^}]*"email"\s*:\s*"([^"]*@[^"]*)"', (1,)),
    "css_content": (r"content\s*:\s*[\"']([^\"']*@[^\"']*)[\"']", (1,)),
    "html_comment": (r"<!--\s*([^@]*@[^@]*@[^>]*)\s*-->", (1,)),
    "script_var": (r"var\s+\w+\s*=\s*[\"']([^\"']*@[^\"']*)[\"']", (1,)),
    "mailto_link": (rf"mailto:({EM})", (1,)),
}
def steady(pattern: str) -> str:
    """The same matches without giving back: what stands behind these runs is not in their class."""
    for run in ("[a-zA-Z0-9._%+-]+", r"[\w\.-]+"):
        pattern = pattern.replace(f"{run}@", f"{run}+@")
    return pattern.replace(f"{_U}\\s", f"{_U[:-1]}+)\\s").replace(f"{_U}&", f"{_U[:-1]}+)&").replace(f"{_U}{_Q}", f"{_U[:-1]}+){_Q}")


ROT13 = r"[a-zA-Z]{3,}@[a-zA-Z]{3,}\.[a-zA-Z]{2,}"
UNICODE = r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.[\p{L}]{2,}"
BASE64_USER = r"[A-Za-z0-9+/]{20,}={0,2}@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

#: names before the @ that page text is often glued to
COMMON_NAMES = ["info", "contact", "email", "mail", "admin", "support", "sales", "service", "office", "team", "staff", "hello", "inquiry", "enquiry", "general", "help"]
#: an address close to one of these is an example
EXAMPLE_WORDS = [
    "example", "sample", "test", "demo", "your.email", "email@example.com", "replace with", "enter your", "type your", "placeholder",
    "example.com", "test.com", "your@email.com", "your@domain.com", "user@example", "contact@example",
]
#: an address with one of these speaks for a system
SECURITY_WORDS = [
    "account secured", "successfully verified", "security check", "verification complete", "access granted", "authentication successful",
    "login successful", "account verified", "security confirmation", "verification successful", "account protected", "security alert",
    "system notification", "automated message", "no-reply", "noreply", "donotreply", "do-not-reply", "no.reply", "auto-confirm",
    "auto-notification", "auto-reply", "auto-response", "autoresponder", "automatic-reply", "bounce", "daemon", "failed", "failure", "list-",
    "list.", "listserv", "mailer-daemon", "mailerdaemon", "majordomo", "marketing", "newsletter", "notifications", "postmaster", "return-",
    "root@", "spam", "subscribe", "support@", "sysadmin", "system", "test@", "undisclosed-recipients", "unsubscribe", "warning",
    "webmaster", "www@",
]
SYNTAX = r"^[a-zA-Z0-9.!#$%&'*+/=?^_{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$"
FORBIDDEN = r"""[<>"'()\[\]\\,;: ]"""
CITIES = ["roma", "milano", "torino", "napoli", "firenze", "venezia", "genova", "bologna", "palermo", "catania"]
TEST_ADDRESSES = ["test@test.", "example@example.", "sample@sample.", "@test.com", "@example.com", "@sample.com", "test@test.com", "example@example.com"]
#: signs of a page that only asks the reader's browser for a proof
CHALLENGE = [
    "challenge-platform", "cf-browser-verification", "checking your browser", "just a moment", "ddos protection by cloudflare", "cf-ray", "__cf_bm",
    "cf_clearance", "cf-challenge", "cloudflare", "var s,t,o,p,b,r,e,a,k,i,n,g,f",
]
CHALLENGE_ALONE = "var s,t,o,p,b,r,e,a,k,i,n,g,f"
#: top-level domains that file suffixes share; an address may end in them
REAL_TLDS = ["com", "ai", "pl", "py", "sh", "ps", "zip", "mov", "cab", "mobi", "rs", "st", "cc", "cr", "pub", "dot"]
#: labels of the reasons, in the order in which they are looked for
REASONS = {
    "syntax": "Invalid email syntax",
    "security": "Security/system email pattern",
    "disposable": "Disposable email domain",
    "suffix": "Bad email extension/TLD",
    "mx": "No MX record found (domain doesn't accept email)",
    "additional": "Failed additional validation checks",
}
#: attributes that may carry an address
ATTRIBUTES = [
    "href", "title", "alt", "data-href", "data-url", "data-contact", "data-email", "data-mail", "data-address", "data-info", "aria-label",
    "aria-labelledby", "value", "placeholder", "content", "property", "name", "id", "class",
]
