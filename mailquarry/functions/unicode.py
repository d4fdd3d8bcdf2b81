"""What Spark has no expression for: compatibility forms, host names in other scripts, address classes."""

from __future__ import annotations

import ipaddress
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LATIN_MARK = re.compile("(?<=[A-Za-z])[̀-ͯ҃-҉᪰-᫿⃐-⃿]+(?=[A-Za-z])")


def plain_form(text: str | None) -> str | None:
    """NFKC without format characters, variation selectors and marks that stand between Latin letters without joining them."""
    if text is None or text.isascii():
        return text
    out = _LATIN_MARK.sub("", unicodedata.normalize("NFKC", text))
    hidden = {c for c in set(out) if unicodedata.category(c) == "Cf" or "︀" <= c <= "️"}
    return "".join(c for c in out if c not in hidden) if hidden else out


def ascii_host(host: str | None) -> str | None:
    """Lower-case ASCII form of a host name; addresses in canonical form; null for one that can't be."""
    h = (host or "").strip().rstrip(".").lower()
    if not h:
        return None
    try:
        return str(ipaddress.ip_address(h.strip("[]")))
    except ValueError:
        pass
    if any(not x for x in h.split(".")):
        return None
    try:
        return h if h.isascii() else h.encode("idna").decode()
    except UnicodeError:
        return None


def shown_host(host: str | None) -> str | None:
    """A host name with its punycode labels decoded; a label that can't be decoded stays."""
    if host is None:
        return None
    out = []
    for label in host.split("."):
        try:
            out.append(label.encode().decode("idna") if label.lower().startswith("xn--") else label)
        except UnicodeError:
            out.append(label)
    return ".".join(out)


def scripts(label: str) -> set[str]:
    """Scripts of a label's letters."""
    return {unicodedata.name(c, "UNKNOWN").split(" ")[0] for c in label if c.isalpha()}


def mixed_script(host: str | None) -> bool:
    """Whether a label mixes Latin with another script that has look-alike letters."""
    return any({"LATIN"} < s and s & {"CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE"} for s in (scripts(x) for x in (shown_host(host) or "").split(".")))


def public_ip(text: str | None) -> bool | None:
    try:
        return ipaddress.ip_address((text or "").strip("[]")).is_global
    except ValueError:
        return None


#: Own map of letters of other scripts that look like Latin ones.
LOOKALIKE = dict(zip("аеорсухіјѕԁһӏкмтвнαορνικτυχϲ", "aeopcyxijsdhlkmtbhaopviktuxc", strict=True))


def latin_look(text: str | None) -> str | None:
    """What a name looks like in Latin letters: compatibility forms, then look-alikes of other scripts."""
    return None if text is None else "".join(LOOKALIKE.get(c, c) for c in unicodedata.normalize("NFKC", text).lower())


_ADDRESS = re.compile(r"(?<![\w.:])(?:\d{1,3}(?:\.\d{1,3}){3}|(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f.]{0,15})(?![\w:])")


def addresses_of(text: str | None) -> list[str]:
    """The distinct valid addresses in a text, in order; host numbers out of range and times of day are none."""
    out: list[str] = []
    for m in _ADDRESS.finditer(text or ""):
        try:
            found = str(ipaddress.ip_address(m[0]))
        except ValueError:
            continue
        if found not in out:
            out.append(found)
    return out


def preferred_address(text: str | None) -> str | None:
    """The first public address in a text, else the first."""
    found = addresses_of(text)
    return next((a for a in found if ipaddress.ip_address(a).is_global), found[0] if found else None)


def _series(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    return run


normal_form = F.pandas_udf(_series(plain_form), T.StringType())
host_ascii = F.pandas_udf(_series(ascii_host), T.StringType())
host_shown = F.pandas_udf(_series(shown_host), T.StringType())
has_mixed_script = F.pandas_udf(_series(mixed_script), T.BooleanType())
def evidence_normal(text):
    """The form in which quotations and texts are compared: compatibility form without hidden characters, folded quotes, one line, lower case."""
    from mailquarry.functions.text import evidence_form

    return evidence_form(normal_form(text))


latin_form = F.pandas_udf(_series(latin_look), T.StringType())
text_addresses = F.pandas_udf(_series(addresses_of), T.ArrayType(T.StringType()))
sender_address = F.pandas_udf(_series(preferred_address), T.StringType())
is_public_ip = F.pandas_udf(_series(public_ip), T.BooleanType())
