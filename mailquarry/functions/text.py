"""Text functions over columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailquarry.dims import IBAN_LENGTHS

# The weights of a segment's action score. The words are our own.
ACTION_PATTERNS = [
    (r"(?i)\b(iban|swift|sort code|routing number|account (number|holder)|bank details|coordinate bancarie|n[uú]mero de cuenta|bankverbindung|kontonummer)\b", 7),
    (r"(?i)\b(pay(ing|able|ments?)?|remit(tance)?|wire|settle|bonific\w+|pagar\w*|zahl(en|ung)|virement|transfer\w*)\b", 4),
    (r"(?i)\b(payment receipt|remittance advice|receipt for the (payment|transfer)|ricevuta (di|del) (pagamento|bonifico)|justificante|zahlungsbeleg)\b", 6),
    (r"(?i)\b(pass(word|code|phrase)s?|log-?in details|pin code|one-time code|2fa|contrase[ñn]a|passwort|mot de passe|codice di accesso)\b", 7),
    (r"(?i)\bhttps?://\S", 2),
]


#: Format controls that show nothing.
CONTROLS = "\u00ad\u034f\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufeff"
#: Four single quotes, five double quotes, three dashes.
QUOTES_DASHES = "\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u00ab\u00bb\u2013\u2014\u2212"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "))


def preview(text: Column, limit: int = 230) -> Column:
    """White space collapsed, at most ``limit`` characters, an ellipsis where something is cut."""
    t = collapsed(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(limit - 1))), F.lit("…")))


def clipped(text: Column, limit: int, mark: str = "\n[cut]") -> Column:
    """At most ``limit`` characters and a mark, cut at the last blank if that loses less than two fifths."""
    return F.when(F.length(F.trim(text)) <= limit, F.trim(text)).otherwise(F.concat(_head(F.trim(text), limit), F.lit(mark)))


def exact_span(text: Column, limit: int = 180) -> Column:
    """A quotation in one line without outer quotes, shortened without a character that isn't in the text."""
    t = F.regexp_replace(collapsed(text), r"""^["']+|["']+$""", "")
    return F.when(F.length(t) <= limit, t).otherwise(_head(t, limit))


def _head(text: Column, limit: int) -> Column:
    head = F.left(text, F.lit(limit))
    last = limit - F.instr(F.reverse(head), " ")  # characters before the last blank
    return F.rtrim(F.when(F.contains(head, F.lit(" ")) & (last > limit * 0.6), F.left(head, last)).otherwise(head))


@lru_cache(maxsize=None)
def _folds(c: str) -> str:
    """The other characters of one simple case folding, but for those that Java's (?i) knows itself."""
    return "".join(x for x in map(chr, range(0x80, 0x2200)) if x != c and x.casefold() == c.casefold())


_ASCII_WORD, _ASCII_SPACE = "0-9A-Za-z_", r"\t\n\f\r "
_ASCII_EDGE = f"(?:(?<![{_ASCII_WORD}])(?=[{_ASCII_WORD}])|(?<=[{_ASCII_WORD}])(?![{_ASCII_WORD}]))"


def _starts(pattern: str) -> str:
    """The characters that a plain word, or a group of such, at the front of a pattern can start with; '' where it isn't plain."""
    if pattern[:1] != "(":
        pattern = f"({pattern[:2]})"
    depth, starts = 0, [1]
    for k, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if depth == 0:
            break
        if c == "|" and depth == 1:
            starts.append(k + 1)
    found = [pattern[k : k + 2] for k in starts]
    return "".join(sorted({x[0] for x in found})) if all(x[:1].isalnum() and x[1:] not in ("?", "*", "{") for x in found) else ""


def as_re2(pattern: str) -> str:
    """The pattern for Java that matches what RE2, and so DuckDB, takes ``pattern`` for.

    There \\b has only ASCII words at its sides (Java before 19: all letters),
    \\s has no vertical tab, and (?i) folds every letter, not ASCII alone.
    """
    fold = _folds if "(?i)" in pattern else lambda c: ""
    own = {"w": _ASCII_WORD + fold("k") + fold("s"), "s": _ASCII_SPACE}

    def one(m: re.Match) -> str:
        x = m[0]
        if x == r"\b":
            starts = _starts(pattern[m.end() :])
            return (f"(?=[{starts}{''.join(map(fold, starts))}])" if starts else "") + _ASCII_EDGE  # the first letter alone rules most places out
        if x[0] == "\\":
            return f"[{'^' if x[1].isupper() else ''}{own[x[1].lower()]}]" if x[1].lower() in own else x
        if x[0] == "[":
            return re.sub(r"\\.|\w", lambda y: own.get(y[0][1:], y[0]) if y[0][0] == "\\" else y[0] + fold(y[0]), x)
        return f"[{x}{fold(x)}]" if len(x) == 1 and fold(x) else x

    return re.sub(r"\(\?[a-z]*[:)]|\\.|\[(?:\\.|[^\]\\])*\]|\w", one, pattern)


def action_score(text: Column, patterns: list[tuple[str, int]] = ACTION_PATTERNS, taken: Callable[[str], str] = str) -> Column:
    """Sum of the weights of the patterns that occur, each once; ``taken`` is how a pattern is read (as_re2: as SQL does)."""
    score = F.lit(0)
    for p, w in patterns:
        score = score + F.when(text.rlike(taken(p)), w).otherwise(0)
    return score


def section_risk(text: Column, patterns: list[tuple[str, int]] = ACTION_PATTERNS, taken: Callable[[str], str] = str) -> Column:
    """Matches of all patterns but links, and a third of the links."""
    score = F.lit(0)
    for p, _ in patterns[:-1]:
        score = score + F.regexp_count(text, F.lit(taken(p)))
    return score + F.floor(F.regexp_count(text, F.lit(taken(r"(?i)https?://"))) / 3).cast("int")


def evidence_form(text: Column) -> Column:
    """Quotes and dashes folded, white space collapsed, lower case."""
    return F.lower(collapsed(F.translate(text, QUOTES_DASHES, "'" * 4 + '"' * 5 + "-" * 3)))


#: Four or more joiners that stand alone, with blanks between them, are padding; those within words stay.
JOINER_PADDING = r"(?:[\u200c\u200d][ \t]*){4}[\u200c\u200d \t]*"


def ai_view(text: Column) -> Column:
    """Without invisible format controls and joiner padding; runs of blanks and of empty lines shortened."""
    plain = CONTROLS.replace("\u200c", "").replace("\u200d", "")
    seen = F.regexp_replace(F.translate(text, plain, ""), JOINER_PADDING, "")
    seen = F.regexp_replace(F.regexp_replace(seen, r"\r\n?", "\n"), r"[^\S\n]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(seen, r"\n[ \t]+", "\n"), r"\n{3,}", "\n\n"), F.lit(" \n"))


def removed_controls(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, CONTROLS, ""))


def padding_runs(text: Column) -> Column:
    return F.regexp_count(F.translate(text, CONTROLS.replace("\u200c", "").replace("\u200d", ""), ""), F.lit(JOINER_PADDING))


# Elements whose opening tag shows that a text is a page.
PAGE_ELEMENTS = ["!doctype html", "html", "body", "table", "div", "span", "p", "br", "a", "img", "style", "head"]
PAGE_MARK = r"(?i)<\s*(" + "|".join(e.replace(" ", r"\s+") for e in PAGE_ELEMENTS) + r")\b"


def looks_like_html(text: Column) -> Column:
    return F.coalesce(text.rlike(PAGE_MARK), F.lit(False))


#: Own words for taking a code with a camera, and for the code.
TO_SCAN = ["scan", "scanning", "scannen", "scannez", "flashez", "inquadra", "inquadrate", "scansiona", "escanea", "escanee", "photograph", "point your camera"]
CODES = ["qr", "qr-code", "code", "barcode", "codice", "codigo", "square"]
QR_REQUEST = rf"(?i)\b({'|'.join(TO_SCAN)})\b[^\n]{{0,90}}?\b({'|'.join(CODES)})\b"
#: Own words for money matters, and for a document that comes along.
MONEY = r"(?i)\b(invoices?|bill|payments?|remittance|transfer|fattur[ae]|pagament[oi]|bonifico|factures?|faktur[ay]?|rechnung(en)?|przelew|facturas?)\b"
ENCLOSED = r"(?i)\b(attached|attachment|enclosed|in allegato|allegat[oaie]|ci-joint|im anhang|adjunt[oa]|w za[lł][aą]czeniu|za[lł][aą]cznik\w*)\b"


def qr_request(text: Column) -> Column:
    """The words that ask the reader to scan a code; '' if there are none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), QR_REQUEST, 0)


def financial_claim(text: Column) -> Column:
    """Money is spoken of and so is a document that comes along."""
    t = F.coalesce(text, F.lit(""))
    return t.rlike(MONEY) & t.rlike(ENCLOSED)


def guarded(text: Column, name: str = "UNTRUSTED_EMAIL") -> Column:
    """A text that can't open or close the block of a prompt that it stands in."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?i)</?{name}>", "[EMAIL_BOUNDARY_TEXT_REMOVED]")


#: Lines that a compaction puts in the place of what it leaves out.
COMPACTION_NOTICES = ["[repeated block left out]", "[rows left out]", "[HTML alternative]", "[Plain text alternative]", "[shared paragraphs left out]"]


def without_compaction_notices(text: Column) -> Column:
    """Without the lines that a compaction put in: they can't bear out a quotation."""
    return F.array_join(F.filter(F.split(text, r"\r?\n"), lambda x: ~F.trim(x).isin(COMPACTION_NOTICES)), "\n")


# Address of the mail clients' notice on unusual senders, and how the notice begins and ends.
NOTICE_URL = "https://aka.ms/LearnAboutSenderIdentification"
NOTICE_TEXTS = [("You don't often get email from ", "Learn why this is important"), ("Non ricevi spesso messaggi di posta elettronica da ", "Scopri perché è importante")]


def is_sender_notice_url(url: Column) -> Column:
    """The very address, with nothing after it."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^([^/]*//[^/]*)", 1)).eqNullSafe(F.lit("https://aka.ms")) & url.endswith(NOTICE_URL[len("https://aka.ms") :]) & (F.length(url) == len(NOTICE_URL)), F.lit(False))


def without_sender_notice(text: Column) -> Column:
    """Without the clients' notice, where its words and its address stand together."""
    for first, last in NOTICE_TEXTS:
        one, two, url = (r"\Q" + x + r"\E" for x in (first, last, NOTICE_URL))
        text = F.regexp_replace(text, rf"(?i){one}[^<\n]{{0,220}}?{two}[\s<(]*{url}[>)]?(?=[\s.,;]|$)", " ")
    return text


def compact_body(text: Column) -> Column:
    """One readable form of a visible body: control characters as blanks, no client notice, no runs of blanks or empty lines.

    The text is one that ``visible_text`` and ``normal_form`` have been through.
    """
    t = without_sender_notice(F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", " "))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" *\n *", "\n")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"), F.lit(" \n"))


def segments(text: Column, least: int = 8) -> Column:
    """Sentences and lines of ``least`` characters or more, the first of those equal but for case."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), F.trim), lambda s: F.length(s) >= least)
    return F.filter(parts, lambda s, i: F.array_position(F.transform(parts, F.lower), F.lower(s)) == i + 1)


def list_row_shape(line: Column) -> Column:
    """A line with links, numbers and words abstracted."""
    s = F.regexp_replace(F.trim(line), r"(?i)https?://\S+", "<@>")
    s = F.regexp_replace(s, r"[0-9](?:[0-9.,]*[0-9])?", "<#>")
    return F.regexp_replace(s, r"[A-Za-zÀ-ɏ'](?:[A-Za-zÀ-ɏ' ]*[A-Za-zÀ-ɏ'])?", "<w>")  # no repeated group: those overflow the stack on long lines


def reply_prefix(subject: Column) -> Column:
    """The reply or forward prefix of a subject, lower case, without counters; '' if there is none."""
    return F.lower(F.regexp_extract(F.trim(subject), r"^(?i)(?:\[[^\]]*\]\s*)*(re|r|aw|sv|antw|odp|rif|res|fw|fwd|i|wg)(?:\s*[\[(]?\d+[\])]?)?\s*:", 1))


def link_heavy(text: Column, html_text: Column) -> Column:
    """Plain text that is mostly links, where the HTML says something: prefer the HTML."""
    urls = F.regexp_extract_all(text, F.lit(r"(https?://\S+)"), 1)
    size = F.aggregate(urls, F.lit(0), lambda a, u: a + F.length(u))
    words = F.size(F.regexp_extract_all(html_text, F.lit(r"(\S+)"), 1))
    return (F.length(text) >= 1200) & (F.size(urls) >= 6) & (size >= 0.45 * F.length(text)) & (F.length(html_text) >= 120) & (words >= 20) & (F.length(html_text) < F.length(text))


def iban_compact(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"[\s-]+", ""))


def iban_remainder(iban: Column) -> Column:
    """Remainder modulo 97 of the rearranged number: letters count two digits."""
    moved = F.concat(F.substring(iban, 5, 64), F.left(iban, F.lit(4)))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def valid_iban(text: Column) -> Column:
    """Country's length and check digits."""
    iban = iban_compact(text)
    lengths = F.create_map(*(x for k, v in IBAN_LENGTHS.items() for x in (F.lit(k), F.lit(v))))
    shaped = iban.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (F.coalesce(lengths[F.left(iban, F.lit(2))], F.lit(0)) == F.length(iban))
    return F.coalesce(F.when(shaped, iban_remainder(iban) == 1).otherwise(False), F.lit(False))


def masked_iban(text: Column) -> Column:
    """First and last four characters; nothing of a short one."""
    return F.when(F.length(text) <= 8, F.lit("****")).otherwise(F.concat(F.left(text, F.lit(4)), F.lit(" **** "), F.right(text, F.lit(4))))


def skeletons(label: Column) -> Column:
    """What a name looks like: digits as letters (1 as l and as i), then rn, vv, cl and nn as one letter."""

    def one(c: str) -> Column:
        s = F.translate(F.lower(label), "013456789", f"o{c}easgtbg")
        for pair, letter in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("nn", "m")):
            s = F.replace(s, F.lit(pair), F.lit(letter))
        return s

    return F.array_distinct(F.array(one("l"), one("i")))


def only_words(label: Column, words: list[str], longest: int = 16) -> Column:
    """Whether a name, digits and hyphens apart, is nothing but words of a list one after the other."""
    known = F.array(*(F.lit(w) for w in words if len(w) <= longest))
    s = F.regexp_replace(F.lower(label), "[0-9-]", "")
    n = F.length(s)

    def reached(ends: Column, i: Column) -> Column:
        fits = F.exists(known, lambda w: (F.length(w) <= i) & F.array_contains(ends, i - F.length(w)) & (F.substring(s, i - F.length(w) + 1, F.length(w)) == w))
        return F.when(fits, F.array_append(ends, i)).otherwise(ends)

    ends = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.array(F.lit(0)), reached)
    return F.coalesce((n > 0) & F.array_contains(ends, n), F.lit(False))


def typo_class(a: Column, b: Column) -> Column:
    """One swap of neighbours, one doubled letter or one hyphen apart."""
    n, m = F.length(a), F.length(b)
    swap = (n == m) & F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: (F.concat(F.left(a, i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b) & (a != b))

    def longer(x: Column, y: Column) -> Column:
        size = F.length(x)
        drop = lambda i: F.concat(F.left(x, i - 1), F.substring(x, i + 1, size)) == y
        odd = lambda i: (F.substring(x, i, F.lit(1)) == "-") | (F.substring(x, i, F.lit(1)) == F.substring(x, i + 1, F.lit(1)))
        return (size == F.length(y) + 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), size)), lambda i: drop(i) & odd(i))

    return F.coalesce(swap | longer(a, b) | longer(b, a), F.lit(False))


def compact_struct(*columns: Column) -> Column:
    """A JSON object without nulls, empty strings and empty arrays; null if nothing is left."""
    text = F.to_json(F.struct(*columns))
    return F.when(text == "{}", F.lit(None)).otherwise(text)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def empty_to_null(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)
