"""Whether a quotation stands in a message, and what a second rendering of a body adds to the first."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Least similarity of a fuzzy match; least length and share of a long common run.
FUZZY, RUN_CHARS, RUN_SHARE = 0.82, 32, 0.40

_FOLD = str.maketrans("‘’‚‛“”„«»–—−", "''''\"\"\"\"\"---")


def folded(text: str | None) -> str:
    return re.sub(r"\s+", " ", (text or "").translate(_FOLD)).strip().lower()


def _windows(source: str, size: int):
    step = max(1, size // 8)
    for k in range(0, max(1, len(source) - size + step), step):
        yield source[k : k + size]


def ground(quotation: str | None, source: str | None, hosts: list[str] | None = None, context: bool = False) -> str | None:
    """How a quotation is borne out, or None: exact, core (without its outer punctuation), host (it names a link's host),
    caption (the text before an address in angle brackets), and for ``context`` quotations also fuzzy or run."""
    q, s = folded(quotation), folded(source)
    if not q or not s:
        return None
    if q in s:
        return "exact"
    core = q.strip(" .,;:!?…\"'()[]<>-*")
    if len(core) >= 4 and core in s:
        return "core"
    if any(core == h or core.endswith("." + h) for h in hosts or [] if h):
        return "host"
    caption = re.sub(r"\s*<[^<>]+>\s*$", "", q)
    if caption != q and len(caption) >= 4 and caption in s:
        return "caption"
    if not context:
        return None
    for window in _windows(s, len(q)):
        m = SequenceMatcher(None, q, window, autojunk=False)
        if m.real_quick_ratio() >= FUZZY and m.quick_ratio() >= FUZZY and m.ratio() >= FUZZY:
            return "fuzzy"
    run = SequenceMatcher(None, q, s, autojunk=False).find_longest_match(0, len(q), 0, len(s)).size
    return "run" if run >= RUN_CHARS and run >= RUN_SHARE * len(q) else None


#: Own marks of lines that close a mailing.
FOOTER = re.compile(r"(?i)unsubscribe|view (this|it) (e?mail )?(in|online)|all rights reserved|©|\(c\) ?\d{4}|privacy (policy|notice)|manage (your )?(preferences|subscription)|disiscriv|abmelden|se désabonner|darse de baja")


def merged_alternatives(first: str | None, second: str | None) -> str:
    """A body with the paragraphs that only its alternative rendering has, each with a neighbour on either side, under a marker.

    Paragraphs that differ in links, case or white space alone are the same,
    and a footer of the usual lines is nothing new.
    """
    bare = lambda p: folded(re.sub(r"(?i)https?://\S+", "", p))
    cut = lambda t: [p.strip() for p in re.split(r"\n\s*\n", t or "") if p.strip()]
    a, b = cut(first), cut(second)
    if not a:
        return "\n\n".join(b)
    have = {bare(p) for p in a}
    whole = " ".join(bare(p) for p in a)
    foot = lambda p: all(FOOTER.search(x) or not x.strip() for x in p.split("\n"))
    new = [k for k, p in enumerate(b) if bare(p) and bare(p) not in have and bare(p) not in whole and not foot(p)]
    if not new:
        return "\n\n".join(a)
    shown = sorted({j for k in new for j in (k - 1, k, k + 1) if 0 <= j < len(b)})
    return "\n\n".join([*a, "[only in the alternative version]", *(b[j] for j in shown)])


@F.pandas_udf(T.StringType())
def grounding(quotation: pd.Series, source: pd.Series, hosts: pd.Series, context: pd.Series) -> pd.Series:
    return pd.Series([ground(q, s, list(h) if h is not None else None, bool(c)) for q, s, h, c in zip(quotation, source, hosts, context, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def merge_alternatives(first: pd.Series, second: pd.Series) -> pd.Series:
    return pd.Series([merged_alternatives(a, b) for a, b in zip(first, second, strict=True)])
