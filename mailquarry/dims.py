"""Small reference tables as plain values; every one can be replaced by a table of the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How adverse an authentication status is, higher is worse.
AUTH_PRIORITY = {"fail": 100, "permerror": 95, "temperror": 90, "softfail": 85, "policy": 80, "neutral": 70, "none": 60, "unknown": 50, "bestguesspass": 10, "pass": 0}

# Effect of a finding's level on the verdict.
LEVEL_EFFECTS = {"HIGH": "decisive", "MEDIUM": "supporting", "LOW": "informational", "INFO": "informational"}

# Length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

# Weight and family of each impersonation signal.
IMPERSONATION_WEIGHTS = {
    "free_mail_claim": (25, "sender_identity"),
    "sender_domain_mismatch": (15, "sender_identity"),
    "sender_lookalike": (35, "sender_identity"),
    "display_domain_deception": (35, "sender_identity"),
    "sensitive_external_action": (20, "action_destination"),
    "action_lookalike": (35, "action_destination"),
    "external_reply": (10, "action_destination"),
    "personal_mailbox_action": (35, "action_destination"),
    "recent_registration": (8, "domain_context"),
    "weak_dmarc": (3, "domain_context"),
    "documented_sender": (-10, "sender_identity"),
    "authenticated_documented_sender": (-25, "sender_identity"),
}

# Weight of an action when the sections of a message are merged.
ACTION_PRIORITY = {
    "provide_credentials": 120, "pay_or_transfer": 110, "bypass_procedure": 100, "provide_information": 90, "change_account_settings": 85,
    "verify_account": 80, "claim_reward": 75, "open_attachment": 60, "reply": 50, "visit_link": 40, "other": 20, "informational": 10, "none": 0,
}

#: Own short list of public suffixes: (suffix, private). Unknown suffixes keep the whole host.
PUBLIC_SUFFIXES = [
    ("com", False), ("net", False), ("org", False), ("info", False), ("io", False), ("eu", False), ("it", False), ("de", False), ("fr", False),
    ("es", False), ("uk", False), ("co.uk", False), ("org.uk", False), ("com.au", False), ("com.br", False), ("co.jp", False), ("jp", False),
    ("example", False), ("test", False), ("invalid", False), ("github.io", True), ("pages.dev", True), ("web.app", True), ("blogspot.com", True),
]

#: Own short list of mailbox providers.
MAILBOX_PROVIDERS = ["gmail.com", "outlook.com", "hotmail.com", "yahoo.com", "icloud.com", "proton.me", "gmx.de", "libero.it"]

#: Own short lists of hosting services: (domain, kind), in order of precedence ipfs, shortener, abused hosting.
LINK_HOSTS = [("ipfs.io", "ipfs"), ("dweb.link", "ipfs"), ("bit.ly", "shortener"), ("tinyurl.com", "shortener"), ("t.ly", "shortener"), ("web.app", "abused_hosting"), ("pages.dev", "abused_hosting"), ("github.io", "abused_hosting")]

#: Own short list of click trackers.
CLICK_TRACKERS = ["list-manage.com", "sendgrid.net", "urldefense.com", "safelinks.protection.outlook.com"]

#: Own brands: (brand, token, official domain).
BRANDS = [("Contoso", "contoso", "contoso.com"), ("Fabrikam", "fabrikam", "fabrikam.com"), ("Northwind", "northwind", "northwind.com"), ("Example", "example", "example.com")]

#: Own lure words for combined names.
LURE_WORDS = ["access", "account", "alert", "billing", "confirm", "help", "invoice", "login", "online", "pay", "secure", "security", "support", "update", "verify", "web"]

#: Finding field -> (signal id, category); other fields become ``static.`` and the field's slug.
SIGNAL_POLICY = [
    ("spf", "auth.spf", "authentication"), ("dkim", "auth.dkim", "authentication"), ("dmarc", "auth.dmarc", "authentication"),
    ("reply-to", "identity.reply_to", "identity"), ("return-path", "identity.return_path", "identity"), ("display name", "identity.display_name", "identity"),
    ("from", "identity.from", "identity"), ("sender lookalike", "identity.sender_lookalike", "identity"), ("reply thread", "identity.fake_reply", "identity"),
    ("payment details", "content.payment_details", "content"), ("link", "link.structure", "link"), ("masked link", "link.masked", "link"),
    ("lookalike domain", "link.lookalike", "link"), ("attachment", "attachment.type", "attachment"), ("received", "delivery.received", "delivery"),
]


#: Rows up to which a reference table is sent to every task; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """The table with a broadcast hint if it has at most BROADCAST_ROWS rows, counted, else without."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], name: str, columns: str) -> str:
    """The same rows as a VALUES clause."""

    def lit(v) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS {name}({columns})"
