"""Bank details in messages, and what is remembered about a sender's accounts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailquarry.dims import IBAN_LENGTHS
from mailquarry.functions.text import masked_iban

#: Own words for "other than before" and for what money is sent to; together in one sentence they announce new bank details.
OTHER = ["new", "updated", "changed", "revised", "different", "replaced", "nuov[oaie]", "aggiornat[oaie]", "cambiat[oaie]", "nuev[oa]s?", "actualizad[oa]s?", "nouve(?:au|lles?)", "neue[nrs]?", "ge[äa]ndert\\w*"]
ACCOUNT = ["bank", "iban", "account", "payee", "beneficiary", "conto", "banca", "coordinate", "cuenta", "banco", "rib", "compte", "konto", "bankverbindung"]
_NEAR = r"[^.!?\n]{0,40}"
CHANGE = rf"(?i)\b(?:{'|'.join(OTHER)})\b{_NEAR}\b(?:{'|'.join(ACCOUNT)})|\b(?:{'|'.join(ACCOUNT)})\b{_NEAR}\b(?:{'|'.join(OTHER)})\b"
TTL_DAYS = 730
_RUNS = re.compile(r"[A-Za-z0-9]+")


def is_iban(text: str) -> bool:
    if not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]+", text) or IBAN_LENGTHS.get(text[:2]) != len(text):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def ibans_of(text: str | None, most: int = 10) -> list[str]:
    """The first ``most`` distinct valid numbers, grouped by single blanks or hyphens or not; words that follow one don't spoil it.

    The country says how long a number is, so runs of letters and digits are
    put together until that length is met at the end of a run.
    """
    text = text or ""
    pieces = [(m.start(), m.end()) for m in _RUNS.finditer(text)]
    out: list[str] = []
    k = 0
    while k < len(pieces) and len(out) < most:
        need = IBAN_LENGTHS.get(text[pieces[k][0] : pieces[k][0] + 2].upper())
        joined, j, step = "", k, 1
        while need and j < len(pieces) and len(joined) < need and (j == k or text[pieces[j - 1][1] : pieces[j][0]] in (" ", "\t", "-")):
            joined += text[slice(*pieces[j])].upper()
            j += 1
        if need == len(joined) and is_iban(joined):
            step = j - k
            if joined not in out:
                out.append(joined)
        k += step
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def ibans(text: pd.Series) -> pd.Series:
    return text.map(ibans_of)


def payment_level(body: Column, quoted: Column, attached: Column, change_phrase: Column, sender_country: Column) -> Column:
    """Level of the accounts named in a message's own text.

    A quoted part names another one, or an attachment does: HIGH. A change is
    announced: MEDIUM, HIGH if the account is foreign. Foreign alone: LOW.
    """
    foreign = F.exists(body, lambda i: (sender_country != "") & (F.left(i, F.lit(2)) != sender_country))
    thread = (F.size(quoted) > 0) & (F.size(F.array_except(body, quoted)) > 0)
    attachment = (F.size(attached) > 0) & (F.size(F.array_except(body, attached)) > 0)
    level = F.when(thread | attachment, "HIGH").when(change_phrase, F.when(foreign, "HIGH").otherwise("MEDIUM")).when(foreign, "LOW")
    return F.when(F.size(body) > 0, level)


def masked(accounts: Column) -> Column:
    return F.transform(accounts, masked_iban)


def digest(account: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), account), 256)


def remembered(uses: DataFrame, memory: DataFrame, now: Column) -> DataFrame:
    """uses (sender, digest, msg_id, change_phrase) that are new for a sender with other accounts, with their level.

    ``memory`` is (sender, digest, msg_id, seen_at). Entries older than the
    time to live and entries of the same message don't count, so a message
    that is seen twice changes nothing. The level never lowers a risk.
    """
    kept = memory.where(F.col("seen_at") >= now - F.expr(f"INTERVAL {TTL_DAYS} DAYS"))
    others = uses.select("sender", "digest", "msg_id").join(kept.select("sender", F.col("digest").alias("_d"), F.col("msg_id").alias("_m")), "sender").where("_m <> msg_id")
    known = others.groupBy("sender", "digest", "msg_id").agg(F.bool_or(F.col("_d") == F.col("digest")).alias("known"))
    new = uses.join(known, ["sender", "digest", "msg_id"]).where("not known")
    return new.withColumn("level", F.when(F.col("change_phrase"), "HIGH").otherwise("MEDIUM")).drop("known")
