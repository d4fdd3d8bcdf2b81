"""URL parts by regular expressions; hosts with underscores or other scripts keep theirs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that carry a further destination.
REDIRECT_NAMES = [
    "url", "u", "uri", "target", "to", "dest", "destination", "redirect", "redirect_uri", "return", "returnurl", "next", "continue", "goto", "link",
    "q", "r", "redirect_url", "redirecturl", "target_url", "targeturl", "dest_url", "desturl", "out", "go", "forward", "jump", "ru", "rurl",
]
#: Downloads that run or unpack.
DANGEROUS_EXTENSIONS = ["exe", "scr", "js", "vbs", "bat", "cmd", "ps1", "msi", "iso", "img", "lnk", "hta", "jar", "zip", "rar", "7z", "docm", "xlsm"]


def with_scheme(url: Column) -> Column:
    """``//host`` and ``www.`` and bare domains get a scheme; anything else stays."""
    u = F.trim(url)
    return (
        F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), u)
        .when(u.startswith("//"), F.concat(F.lit("https:"), u))
        .when(u.rlike(r"^[^\s/@]+\.[A-Za-z]{2,}"), F.concat(F.lit("https://"), u))
        .otherwise(u)
    )


def repaired_userinfo(url: Column) -> Column:
    """``https://[token]@host`` without the brackets, which no parser takes."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)\[([^\]/@]*)\]@", "$1$2@")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower-case host without user, port and a final dot; '' if there is none."""
    bare = F.regexp_extract(netloc(url), r"([^@]*)$", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r":[0-9]*$", ""), r"\.$", ""))


def port(url: Column) -> Column:
    return F.regexp_extract(netloc(url), r":([0-9]{1,5})$", 1).try_cast("int")


def has_userinfo(url: Column) -> Column:
    return F.contains(netloc(url), F.lit("@"))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def decoded(text: Column) -> Column:
    """Percent decoding; plus signs stay, text that can't be decoded stays."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def decoded_repeatedly(text: Column) -> Column:
    """At most three rounds of decoding."""
    return decoded(decoded(decoded(text)))


def dedupe_key(url: Column) -> Column:
    """Lower scheme and host, ``/`` for an empty path, decoded query; fragments don't count."""
    p = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    return F.concat(scheme(url), F.lit("://"), F.lower(netloc(url)), p, F.when(query(url) == "", F.lit("")).otherwise(F.concat(F.lit("?"), decoded(query(url)))))


def is_ipv4_host(url: Column) -> Column:
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return host(url).rlike(rf"^{octet}(\.{octet}){{3}}$")


def is_ip_host(url: Column) -> Column:
    """The host is an address: IPv4, or IPv6 in brackets."""
    return is_ipv4_host(url) | host(url).rlike(r"^\[(?=[^\]]*:[^\]]*:)[0-9a-f:.]+(%25[a-z0-9]+)?\]$")


def nonstandard_port(url: Column) -> Column:
    return port(url).isNotNull() & ~(((scheme(url) == "http") & (port(url) == 80)) | ((scheme(url) == "https") & (port(url) == 443)))


def redirect_targets(url: Column) -> Column:
    """Destinations within the query's parameters, in order, at most five; a name that comes twice counts twice."""
    pairs = F.transform(F.split(query(url), "&"), lambda p: F.struct(F.lower(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"), decoded_repeatedly(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v")))
    good = F.filter(pairs, lambda p: p["k"].isin(REDIRECT_NAMES) & p["v"].rlike(r"^(?i)(https?:)?//[^/]"))
    return F.slice(F.array_distinct(F.transform(good, lambda p: p["v"])), 1, 5)


def redirect_hosts(url: Column) -> Column:
    """Hosts of the destinations within an address, in order; the last is where it ends."""
    full = F.transform(redirect_targets(url), lambda t: F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).otherwise(t))
    return F.filter(F.transform(full, host), lambda h: h != "")


def final_host(url: Column) -> Column:
    """The host where an address ends: of the last destination within it, else its own."""
    return F.coalesce(F.try_element_at(redirect_hosts(url), F.lit(-1)), host(url))


def download_name(url: Column) -> Column:
    """Last path part if it has an extension, else ''."""
    last = F.element_at(F.split(path(url), "/"), -1)
    return F.when(last.rlike(r"^.+\.[A-Za-z0-9]{1,8}$"), last).otherwise(F.lit(""))


def download_extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(download_name(url), r"\.([A-Za-z0-9]+)$", 1))


def is_dangerous_download(url: Column) -> Column:
    return download_extension(url).isin(DANGEROUS_EXTENSIONS)


def non_ascii(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x00-\x7F]"), F.lit(False))


def refanged(text: Column) -> Column:
    """``hxxp`` and ``[.]`` back to a plain address."""
    return F.regexp_replace(F.replace(F.replace(F.trim(text), F.lit("[.]"), F.lit(".")), F.lit("[:]"), F.lit(":")), r"^(?i)hxxp(s?)://", "http$1://")


def encodings_of(address: Column) -> Column:
    """An address as itself and in both base64 alphabets with and without padding; those of eight characters or more."""
    a = F.lower(F.trim(address))
    b = F.base64(a.cast("binary"))
    safe = F.translate(b, "+/", "-_")
    strip = lambda c: F.regexp_replace(c, "=+$", "")
    return F.filter(F.array_distinct(F.array(a, b, strip(b), safe, strip(safe))), lambda x: F.length(x) >= 8)


def parent_suffixes(host_: Column) -> Column:
    """The host and all its parents, longest first: a.b.c, b.c, c."""
    labels = F.split(host_, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
