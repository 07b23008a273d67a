"""User-agent rules as native expressions.

A rule fires when the agent contains its token; the first rule that fires
decides family and version. Ingest does not run these expressions on rows: it makes a
table of the rules and reads every distinct agent once (see ``operators.agents``), with
the built-in rules or with a larger table.

Tokens are searched as plain text and only the number behind the marker is
matched by an anchored pattern: that is several times cheaper per row than
searching the whole agent with regular expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AgentRule:
    """``marker`` is the text right before the version number."""

    token: str
    family: str
    marker: str


BROWSER_RULES = (
    AgentRule("Edg/", "Microsoft Edge", "Edg/"),
    AgentRule("EdgA/", "Microsoft Edge", "EdgA/"),
    AgentRule("EdgiOS/", "Microsoft Edge", "EdgiOS/"),
    AgentRule("Edge/", "Microsoft Edge", "Edge/"),
    AgentRule("OPR/", "Opera", "OPR/"),
    AgentRule("OPT/", "Opera Touch", "OPT/"),
    AgentRule("OPX/", "Opera GX", "OPX/"),
    AgentRule("Opera Mini/", "Opera Mini", "Opera Mini/"),
    AgentRule("Opera/", "Opera", "Version/"),
    AgentRule("SamsungBrowser/", "Samsung Browser", "SamsungBrowser/"),
    AgentRule("YaBrowser/", "Yandex Browser", "YaBrowser/"),
    AgentRule("Vivaldi/", "Vivaldi", "Vivaldi/"),
    AgentRule("Brave/", "Brave", "Brave/"),
    AgentRule("Whale/", "Whale Browser", "Whale/"),
    AgentRule("DuckDuckGo/", "DuckDuckGo Privacy Browser", "DuckDuckGo/"),
    AgentRule("Ddg/", "DuckDuckGo Privacy Browser", "Ddg/"),
    AgentRule("UCBrowser/", "UC Browser", "UCBrowser/"),
    AgentRule("MiuiBrowser/", "MIUI Browser", "MiuiBrowser/"),
    AgentRule("HuaweiBrowser/", "Huawei Browser", "HuaweiBrowser/"),
    AgentRule("HeyTapBrowser/", "HeyTapBrowser", "HeyTapBrowser/"),
    AgentRule("VivoBrowser/", "vivo Browser", "VivoBrowser/"),
    AgentRule("MQQBrowser/", "QQ Browser", "MQQBrowser/"),
    AgentRule("QQBrowser/", "QQ Browser", "QQBrowser/"),
    AgentRule("MicroMessenger/", "WeChat", "MicroMessenger/"),
    AgentRule("Sogou", "Sogou Explorer", "SogouMobileBrowser/"),
    AgentRule("Maxthon/", "Maxthon", "Maxthon/"),
    AgentRule("Puffin/", "Puffin", "Puffin/"),
    AgentRule("Silk/", "Mobile Silk", "Silk/"),
    AgentRule("Avast/", "Avast Secure Browser", "Avast/"),
    AgentRule("AVG/", "AVG Secure Browser", "AVG/"),
    AgentRule("Iron/", "Iron", "Iron/"),
    AgentRule("Ecosia", "Ecosia", "Ecosia ios@"),
    AgentRule("Instagram ", "Instagram App", "Instagram "),
    AgentRule("FBAV/", "Facebook", "FBAV/"),
    AgentRule("GSA/", "Google Search App", "GSA/"),
    AgentRule("PaleMoon/", "Pale Moon", "PaleMoon/"),
    AgentRule("Waterfox/", "Waterfox", "Waterfox/"),
    AgentRule("SeaMonkey/", "SeaMonkey", "SeaMonkey/"),
    AgentRule("LibreWolf/", "LibreWolf", "LibreWolf/"),
    AgentRule("Focus/", "Firefox Focus", "Focus/"),
    AgentRule("Klar/", "Firefox Klar", "Klar/"),
    AgentRule("FxiOS/", "Firefox", "FxiOS/"),
    AgentRule("Firefox/", "Firefox", "Firefox/"),
    AgentRule("Epiphany/", "GNOME Web", "Epiphany/"),
    AgentRule("Falkon/", "Falkon", "Falkon/"),
    AgentRule("Konqueror/", "Konqueror", "Konqueror/"),
    AgentRule("qutebrowser/", "qutebrowser", "qutebrowser/"),
    AgentRule("QtWebEngine/", "QtWebEngine", "QtWebEngine/"),
    AgentRule("Electron/", "Electron", "Electron/"),
    AgentRule("CriOS/", "Chrome", "CriOS/"),
    AgentRule("Chromium/", "Chromium", "Chromium/"),
    AgentRule("Chrome/", "Chrome", "Chrome/"),
    AgentRule("Safari/", "Safari", "Version/"),
    AgentRule("Trident/", "Internet Explorer", "rv:"),
    AgentRule("MSIE ", "Internet Explorer", "MSIE "),
    AgentRule("Lynx/", "Lynx", "Lynx/"),
    AgentRule("w3m/", "w3m", "w3m/"),
)

SYSTEM_RULES = (
    AgentRule("Windows Phone", "Windows Phone", "Windows Phone "),
    AgentRule("Windows NT", "Windows", "Windows NT "),
    AgentRule("iPhone OS", "iOS", "iPhone OS "),
    AgentRule("iPad", "iOS", "CPU OS "),
    AgentRule("AppleTV", "tvOS", "tvOS "),
    AgentRule("Mac OS X", "Mac", "Mac OS X "),
    AgentRule("KAIOS/", "KaiOS", "KAIOS/"),
    AgentRule("HarmonyOS", "HarmonyOS", "HarmonyOS "),
    AgentRule("Tizen", "Tizen", "Tizen "),
    AgentRule("Web0S", "webOS", "Web0S "),
    AgentRule("Android", "Android", "Android "),
    AgentRule("CrOS", "Chrome OS", "CrOS x86_64 "),
    AgentRule("PlayStation", "PlayStation", "PlayStation "),
    AgentRule("Nintendo", "Nintendo", "NintendoBrowser/"),
    AgentRule("SailfishOS", "Sailfish OS", "Sailfish "),
    AgentRule("Ubuntu", "Ubuntu", "Ubuntu/"),
    AgentRule("Fedora", "Fedora", "Fedora/"),
    AgentRule("FreeBSD", "FreeBSD", "FreeBSD "),
    AgentRule("OpenBSD", "OpenBSD", "OpenBSD "),
    AgentRule("NetBSD", "NetBSD", "NetBSD "),
    AgentRule("SunOS", "Solaris", "SunOS "),
    AgentRule("Linux", "GNU/Linux", "Linux "),
)

# Texts, in any case, that give a robot away.
BOT_TOKENS = (
    "bot",
    "crawl",
    "spider",
    "slurp",
    "headless",
    "phantomjs",
    "curl/",
    "wget/",
    "python-requests",
    "python-urllib",
    "python-httpx",
    "aiohttp",
    "scrapy",
    "go-http-client",
    "okhttp",
    "java/",
    "apache-httpclient",
    "libwww-perl",
    "node-fetch",
    "axios/",
    "got (https",
    "guzzlehttp",
    "postmanruntime",
    "insomnia/",
    "httpie/",
    "facebookexternalhit",
    "facebookcatalog",
    "whatsapp/",
    "skypeuripreview",
    "embedly",
    "quora link preview",
    "vkshare",
    "google-inspectiontool",
    "google-read-aloud",
    "googleother",
    "mediapartners-google",
    "apis-google",
    "feedfetcher",
    "feedly",
    "bingpreview",
    "ia_archiver",
    "archive.org",
    "wayback",
    "lighthouse",
    "pagespeed",
    "gtmetrix",
    "pingdom",
    "statuscake",
    "site24x7",
    "datadog",
    "newrelic",
    "zabbix",
    "nagios",
    "nmap",
    "masscan",
    "zgrab",
    "nikto",
    "sqlmap",
    "nuclei",
    "httrack",
    "selenium",
    "puppeteer",
    "playwright",
    "cypress/",
    "validator",
    "w3c-checklink",
    "linkchecker",
    "scanner",
    "scraper",
    "perplexity",
    "bytespider",
    "yandeximages",
    "baiduspider",
    "heritrix",
    "nutch",
)


def quoted(text: str) -> str:
    """A pattern for exactly this text, its punctuation escaped."""
    return "".join(c if c.isalnum() or c in " _-/" else "\\" + c for c in text)


# Fixed value: one system family is reported under its present name.
SYSTEM_NAMES = {"Mac": "macOS"}


def _first_match(agent: Column, rules: Sequence[AgentRule], result) -> Column:
    first, *rest = rules
    chain = F.when(F.contains(agent, F.lit(first.token)), result(first))
    for rule in rest:
        chain = chain.when(F.contains(agent, F.lit(rule.token)), result(rule))
    return chain


def family(agent: Column, rules: Sequence[AgentRule]) -> Column:
    return _first_match(agent, rules, lambda rule: F.lit(rule.family))


def version(agent: Column, rules: Sequence[AgentRule]) -> Column:
    """Number behind the marker, with dots; NULL when there is none."""

    def behind(rule: AgentRule) -> Column:
        tail = F.substring_index(agent, rule.marker, -1)
        # the token itself being the marker, it is known to occur
        return tail if rule.marker == rule.token else F.when(F.contains(agent, F.lit(rule.marker)), tail)

    number = F.regexp_extract(_first_match(agent, rules, behind), "^[0-9]+(?:[._][0-9]+)*", 0)
    return F.nullif(F.translate(number, "_", "."), F.lit(""))


def browser(agent: Column, rules: Sequence[AgentRule] = BROWSER_RULES) -> Column:
    return family(agent, rules)


def browser_version(agent: Column, rules: Sequence[AgentRule] = BROWSER_RULES) -> Column:
    return version(agent, rules)


def system_name(name: Column) -> Column:
    """Apply the renames of operating-system families."""
    renamed = name
    for old, new in SYSTEM_NAMES.items():
        renamed = F.when(name == F.lit(old), F.lit(new)).otherwise(renamed)
    return renamed


def operating_system(agent: Column, rules: Sequence[AgentRule] = SYSTEM_RULES) -> Column:
    return _first_match(agent, rules, lambda rule: F.lit(SYSTEM_NAMES.get(rule.family, rule.family)))


def operating_system_version(agent: Column, rules: Sequence[AgentRule] = SYSTEM_RULES) -> Column:
    return version(agent, rules)


def is_bot_name(lowered: Column, tokens: Sequence[str] = BOT_TOKENS) -> Column:
    """True when a lower-case agent contains one of the tokens; NULL passes as NULL."""
    verdict = F.contains(lowered, F.lit(tokens[0]))
    for token in tokens[1:]:
        verdict = verdict | F.contains(lowered, F.lit(token))
    return verdict


def is_bot(agent: Column, tokens: Sequence[str] = BOT_TOKENS) -> Column:
    """The same for an agent as it was sent."""
    return is_bot_name(F.lower(agent), tokens)
