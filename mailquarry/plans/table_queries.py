"""The operators over the driver's tables, each with the SQL that checks it.

Messages are stood in for by the closest table: events are the history (tone
from event_type, duration from value), lineitem rows are hops or signals,
pages hold links, documents hold texts, conversations hold segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailquarry import dims
from mailquarry.functions import text as tx
from mailquarry.functions import urls as ur
from mailquarry.operators import evaluation, history, hosts, ranking

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    tone = F.when(F.col("event_type") == "error", "danger").when(F.col("event_type") == "signup", "review").otherwise("safe")
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.col("ts").cast("date").alias("day"), tone.alias("tone"), F.col("value").alias("duration"))


_H = "h AS (SELECT event_id, user_id, event_type, ts, CAST(ts AS DATE) AS day, CASE event_type WHEN 'error' THEN 'danger' WHEN 'signup' THEN 'review' ELSE 'safe' END AS tone, value AS duration FROM events)"
_TONES = "count(*) FILTER (tone = 'danger') AS danger, count(*) FILTER (tone = 'review') AS review, count(*) FILTER (tone = 'safe') AS safe"
_SHARES = "danger / total AS danger_share, review / total AS review_share, safe / total AS safe_share"


@query(f"WITH {_H}, c AS (SELECT day, count(*) AS total, {_TONES} FROM h GROUP BY day) SELECT *, {_SHARES} FROM c")
def history_tone_counts(spark, sf_dir):
    return history.tone_counts(events_history(spark, sf_dir), ["day"])


@query(f"WITH {_H}, c AS (SELECT count(*) AS total, {_TONES} FROM h) SELECT *, {_SHARES} FROM c")
def history_tone_share(spark, sf_dir):
    return history.tone_counts(events_history(spark, sf_dir))


@query("SELECT event_type, median(value) FILTER (value > 0) AS median_duration, count(*) FILTER (value > 0) AS timed FROM events GROUP BY event_type")
def history_median_duration(spark, sf_dir):
    return history.median_duration(events_history(spark, sf_dir), ["event_type"])


def _buckets(bars: str, source: str) -> str:
    return f"""WITH {source}, bars AS ({bars})
SELECT bucket, from_day, to_day, count(tone) FILTER (tone = 'danger') AS danger, count(tone) FILTER (tone = 'review') AS review, count(tone) FILTER (tone = 'safe') AS safe, count(tone) AS total
FROM bars LEFT JOIN h ON h.day >= from_day AND h.day < to_day GROUP BY ALL"""


@query(_buckets("SELECT CAST(i AS INTEGER) AS bucket, DATE '2024-01-03' + CAST(i AS INTEGER) AS from_day, DATE '2024-01-03' + CAST(i + 1 AS INTEGER) AS to_day FROM range(10) t(i)", _H))
def history_daily_buckets(spark, sf_dir):
    return history.activity_buckets(events_history(spark, sf_dir), F.lit("2024-01-03"), F.lit("2024-01-12"))


@query(_buckets("SELECT CAST(i AS INTEGER) AS bucket, DATE '2024-01-01' + CAST(7 * i AS INTEGER) AS from_day, least(DATE '2024-01-01' + CAST(7 * i + 7 AS INTEGER), DATE '2024-01-31') AS to_day FROM range(5) t(i)", _H))
def history_weekly_anchored(spark, sf_dir):
    return history.activity_buckets(events_history(spark, sf_dir), F.lit("2024-01-01"), F.lit("2024-01-30"))


_O = "h AS (SELECT CAST(o_orderdate AS DATE) AS day, CASE o_orderstatus WHEN 'F' THEN 'danger' WHEN 'P' THEN 'review' ELSE 'safe' END AS tone FROM orders)"


@query(
    _buckets(
        """SELECT CAST(row_number() OVER (ORDER BY s) - 1 AS INTEGER) AS bucket, s AS from_day, coalesce(lead(s) OVER (ORDER BY s), DATE '1996-05-11') AS to_day
  FROM (SELECT greatest(DATE '1993-02-10', CAST(DATE '1993-02-01' + to_months(CAST(i AS INTEGER)) AS DATE)) AS s FROM range(40) t(i) WHERE i % 4 = 0)""",
        _O,
    )
)
def history_monthly_buckets(spark, sf_dir):
    tone = F.when(F.col("o_orderstatus") == "F", "danger").when(F.col("o_orderstatus") == "P", "review").otherwise("safe")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), tone.alias("tone"))
    return history.activity_buckets(rows, F.lit("1993-02-10"), F.lit("1996-05-10"))


@query("SELECT event_type AS reason, count(DISTINCT user_id) AS messages FROM events GROUP BY event_type ORDER BY messages DESC, reason LIMIT 5")
def history_top_reasons(spark, sf_dir):
    return history.reason_counts(read(spark, sf_dir, "events").select(F.col("user_id").alias("msg_id"), F.col("event_type").alias("reason")))


@query("SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1")
def history_latest_by_fingerprint(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return history.latest_by_fingerprint(e, F.concat_ws("|", "user_id", "event_type"), F.col("ts"), F.col("event_id")).select("user_id", "event_type", "event_id", "ts")


_NOW = "TIMESTAMP '2024-01-25 15:30:00'"


@query(
    f"""SELECT 'today' AS period, count(*) AS n FROM events WHERE ts <= {_NOW} AND ts >= TIMESTAMP '2024-01-25'
UNION ALL SELECT 'week', count(*) FROM events WHERE ts <= {_NOW} AND ts >= TIMESTAMP '2024-01-19'
UNION ALL SELECT 'month', count(*) FROM events WHERE ts <= {_NOW} AND ts >= TIMESTAMP '2023-12-25'
UNION ALL SELECT 'all', count(*) FROM events WHERE ts <= {_NOW}
UNION ALL SELECT 'custom', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-29'"""
)
def period_filter_counts(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    now = F.to_timestamp(F.lit("2024-01-25 15:30:00"))
    flags = {p: history.in_period(F.col("ts"), p, now) for p in ("today", "week", "month", "all")} | {"custom": history.in_period(F.col("ts"), "custom", now, F.lit("2024-01-05"), F.lit("2024-01-28"))}
    counts = e.agg(*(F.count_if(c).alias(p) for p, c in flags.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(p).alias("period"), F.col(p).alias("n")) for p in flags))).alias("x")).select("x.period", "x.n")


_POLICY = dims.sql_values(dims.SIGNAL_POLICY, "policy", "field, id, category")
_FIELDS = "CASE event_type WHEN 'error' THEN 'SPF' WHEN 'click' THEN 'Link' WHEN 'view' THEN 'Reply-To' WHEN 'purchase' THEN 'Payment details' ELSE 'Other finding' END"
_LEVELS = "CASE WHEN value >= 400 THEN 'HIGH' WHEN value >= 250 THEN 'MEDIUM' WHEN value >= 100 THEN 'LOW' ELSE 'INFO' END"


@query(
    f"""WITH f AS (SELECT user_id, {_FIELDS} AS field, {_LEVELS} AS level FROM events),
t AS (SELECT f.user_id, coalesce(policy.id, 'static.' || replace(lower(f.field), ' ', '-')) AS signal, coalesce(policy.category, 'static') AS category, level FROM f LEFT JOIN {_POLICY} ON policy.field = lower(f.field))
SELECT signal, category, CASE level WHEN 'HIGH' THEN 'decisive' WHEN 'MEDIUM' THEN 'supporting' ELSE 'informational' END AS effect, count(*) AS findings, count(DISTINCT user_id) AS messages FROM t GROUP BY ALL"""
)
def signal_policy_join(spark, sf_dir):
    from mailquarry.operators.policy import verdict_signals

    e = read(spark, sf_dir, "events")
    field = F.when(F.col("event_type") == "error", "SPF").when(F.col("event_type") == "click", "Link").when(F.col("event_type") == "view", "Reply-To").when(F.col("event_type") == "purchase", "Payment details").otherwise("Other finding")
    level = F.when(F.col("value") >= 400, "HIGH").when(F.col("value") >= 250, "MEDIUM").when(F.col("value") >= 100, "LOW").otherwise("INFO")
    flags = e.select(F.col("user_id").alias("msg_id"), field.alias("field"), level.alias("level"), F.lit("").alias("message"))
    out = verdict_signals(flags, dims.table(spark, dims.SIGNAL_POLICY, "field_key string, signal string, category string"))
    return out.groupBy("signal", "category", "effect").agg(F.count("*").alias("findings"), F.countDistinct("msg_id").alias("messages"))


@query(
    """WITH p AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'P' THEN 'softfail' ELSE 'pass' END AS status, CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'P' THEN 85 ELSE 0 END AS rank FROM orders)
SELECT o_custkey, arg_max(status, rank) AS worst, max(rank) AS priority, count(*) AS results FROM p GROUP BY o_custkey"""
)
def worst_status_per_key(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "P", "softfail").otherwise("pass"))
    return ranking.worst_by_priority(o, ["o_custkey"], F.col("status"), dims.AUTH_PRIORITY, F.col("o_orderkey"))


@query("SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def first_source_wins(spark, sf_dir):
    order = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return ranking.first_wins(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], order).select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    """WITH t AS (SELECT *, CASE WHEN turn % 5 = 4 AND conv_id % 3 = 0 THEN NULL ELSE length(text) END AS seen FROM conversations),
a AS (SELECT *, bool_and(seen IS NOT NULL) OVER (PARTITION BY conv_id) AS ok FROM t)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN ok THEN seen END NULLS FIRST, turn DESC) - 1 AS route_index FROM a"""
)
def hop_order_stable(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("at", F.when(~((F.col("turn") % 5 == 4) & (F.col("conv_id") % 3 == 0)), F.length("text")))
    return ranking.stable_hop_order(c, "conv_id", "turn", "at").select("conv_id", "turn", F.col("route_index").cast("bigint").alias("route_index"))


@query(
    """WITH l AS (SELECT DISTINCT o_orderkey FROM orders), h AS (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderkey, CASE WHEN count(l_suppkey) = 1 THEN min(l_suppkey) END AS hop FROM l LEFT JOIN h ON o_orderkey = l_orderkey GROUP BY o_orderkey"""
)
def hop_match_unique(spark, sf_dir):
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
    return ranking.unique_match(o.select("o_orderkey"), li, F.col("o_orderkey") == F.col("l_orderkey"), "o_orderkey", "l_suppkey", "hop")


_SCORE = " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {w} ELSE 0 END" for p, w in [("the", 3), ("ing", 2), ("[0-9]", 4), ("que|der|les", 5)])


@query(
    f"""WITH s AS (SELECT conv_id, turn, {_SCORE} AS action_score FROM conversations),
t AS (SELECT *, first_value(turn) OVER (PARTITION BY conv_id ORDER BY action_score DESC, turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS target FROM s)
SELECT conv_id, turn, action_score, CASE WHEN turn = target THEN 'target' WHEN abs(turn - target) = 1 OR turn = 0 THEN 'context' ELSE 'excluded' END AS recommended_role FROM t"""
)
def segment_target_context(spark, sf_dir):
    score = tx.action_score(F.col("text"), [("the", 3), ("ing", 2), ("[0-9]", 4), ("que|der|les", 5)])
    c = read(spark, sf_dir, "conversations").withColumn("action_score", score)
    return ranking.target_and_context(c, "conv_id", "turn", "action_score").select("conv_id", "turn", "action_score", "recommended_role")


@query(
    r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '[ \t\r\n\f\x0B]+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN length(t) <= 230 THEN t ELSE rtrim(left(t, 229)) || '…' END AS preview FROM c"""
)
def segment_preview(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", tx.preview(F.col("text")).alias("preview"))


@query(
    r"""WITH u AS (SELECT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS account, event_id, ts FROM events),
f AS (SELECT user_id, account, min(struct_pack(ts := ts, event_id := event_id)) AS first FROM u GROUP BY user_id, account),
k AS (SELECT *, min(first) OVER (PARTITION BY user_id) AS known FROM f)
SELECT user_id, account, first.event_id AS event_id, first.ts AS ts FROM k WHERE known < first"""
)
def new_account_for_sender(spark, sf_dir):
    u = read(spark, sf_dir, "events").select("user_id", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("account"), "event_id", "ts")
    return ranking.new_account_for_sender(u, "user_id", "account", "event_id", "ts")


@query(
    """WITH s AS (SELECT l_orderkey, l_returnflag AS family, CAST(floor(l_quantity) AS INTEGER) - 25 AS weight FROM lineitem),
f AS (SELECT l_orderkey, family, CASE WHEN max(weight) > 0 THEN max(weight) ELSE min(weight) END AS w FROM s GROUP BY l_orderkey, family)
SELECT l_orderkey, CAST(greatest(0, least(100, sum(w))) AS BIGINT) AS score, count(*) AS families FROM f GROUP BY l_orderkey"""
)
def family_score(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("family"), (F.floor("l_quantity").cast("int") - 25).alias("weight"))
    return ranking.family_score(s, "l_orderkey")


def _predictions(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "phishing").otherwise("legitimate").alias("label"))
    d = read(spark, sf_dir, "documents")
    value = F.when(F.col("doc_id") % 11 == 0, F.lit(None)).when(F.col("text").rlike("[!%$#&*|]"), "phishing").when(F.col("n_chars") < 200, "review").when(F.col("doc_id") % 13 == 0, "odd").otherwise("legitimate")
    return labels, d.select(F.col("doc_id").alias("id"), value.alias("prediction"))


_PAIRS = """l AS (SELECT doc_id AS id, CASE WHEN quality = 0 THEN 'phishing' ELSE 'legitimate' END AS label FROM labels),
p AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN regexp_matches(text, '[!%$#&*|]') THEN 'phishing' WHEN n_chars < 200 THEN 'review' WHEN doc_id % 13 = 0 THEN 'odd' ELSE 'legitimate' END AS prediction FROM documents),
m AS (SELECT l.id, label, CASE WHEN prediction IS NULL THEN 'missing' WHEN prediction IN ('phishing', 'legitimate', 'review', 'error', 'missing') THEN prediction ELSE 'error' END AS outcome FROM l LEFT JOIN p ON l.id = p.id)"""


@query(f"WITH {_PAIRS} SELECT label, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in evaluation.OUTCOMES) + " FROM m GROUP BY label")
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(evaluation.matched(*_predictions(spark, sf_dir)))


@query(
    f"""WITH {_PAIRS}, c AS (SELECT CAST(count(*) FILTER (label = 'phishing') AS DOUBLE) AS p, count(*) FILTER (label = 'legitimate') AS l, count(*) FILTER (label = 'phishing' AND outcome = 'phishing') AS tp,
  count(*) FILTER (label = 'legitimate' AND outcome = 'phishing') AS fp, count(*) FILTER (label = 'legitimate' AND outcome = 'legitimate') AS tn FROM m)
SELECT (tp + tn) / nullif(p + l, 0) AS accuracy, (tp / nullif(p, 0) + tn / nullif(l, 0)) / 2 AS balanced_accuracy, tp / nullif(p, 0) AS recall, tp / nullif(tp + fp, 0) AS "precision", fp / nullif(l, 0) AS false_positive_rate FROM c"""
)
def eval_metrics(spark, sf_dir):
    return evaluation.metrics(evaluation.matched(*_predictions(spark, sf_dir)))


@query("SELECT d.doc_id AS id, 'unknown' AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def eval_rejected(spark, sf_dir):
    return evaluation.rejected_predictions(*_predictions(spark, sf_dir))


_HOST = r"lower(regexp_replace(regexp_replace(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '([^@]*)$', 1), ':[0-9]*$', ''), '\.$', ''))"
_SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"


@query(
    rf"""WITH u AS (SELECT page_id, url, {_SCHEME} AS scheme, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages)
SELECT page_id, scheme, host, path, query, fragment, contains(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '@') AS has_userinfo,
  scheme || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || url_decode(query) END AS dedupe_key,
  CASE WHEN regexp_matches(string_split(path, '/')[-1], '^.+\.[A-Za-z0-9]{{1,8}}$') THEN lower(regexp_extract(string_split(path, '/')[-1], '\.([A-Za-z0-9]+)$', 1)) ELSE '' END AS download_extension FROM u"""
)
def url_facts(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select(
        "page_id", ur.scheme(u).alias("scheme"), ur.host(u).alias("host"), ur.path(u).alias("path"), ur.query(u).alias("query"), ur.fragment(u).alias("fragment"),
        ur.has_userinfo(u).alias("has_userinfo"), ur.dedupe_key(u).alias("dedupe_key"), ur.download_extension(u).alias("download_extension"),
    )


def _page_hosts(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", ur.host(F.col("url")).alias("host"))


_SUFFIX = dims.sql_values(dims.PUBLIC_SUFFIXES, "sfx", "suffix, private")
_REGISTERED = rf"""hosts AS (SELECT DISTINCT {_HOST} AS host FROM pages WHERE {_HOST} <> ''),
parts AS (SELECT host, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM hosts),
hit AS (SELECT host, min(i) AS i FROM parts JOIN {_SUFFIX} ON suffix = array_to_string(string_split(host, '.')[i:], '.') GROUP BY host),
registered AS (SELECT hosts.host, coalesce(array_to_string(string_split(hosts.host, '.')[hit.i:], '.'), '') AS public_suffix,
  CASE WHEN hit.i IS NULL OR hit.i = 1 THEN hosts.host ELSE array_to_string(string_split(hosts.host, '.')[hit.i - 1:], '.') END AS registered_domain FROM hosts LEFT JOIN hit ON hosts.host = hit.host)"""


@query(f"WITH {_REGISTERED} SELECT host, public_suffix, registered_domain, string_split(registered_domain, '.')[1] AS label FROM registered")
def registrable_domains(spark, sf_dir):
    return hosts.registered_domains(_page_hosts(spark, sf_dir), dims.table(spark, dims.PUBLIC_SUFFIXES, "suffix string, private boolean"))


@query(f"WITH {_REGISTERED} SELECT registered_domain, count(*) AS pages, count(DISTINCT r.host) AS hosts FROM (SELECT {_HOST} AS host FROM pages) p JOIN registered r ON p.host = r.host GROUP BY registered_domain")
def domain_rollup(spark, sf_dir):
    pages = _page_hosts(spark, sf_dir)
    known = hosts.registered_domains(pages, dims.table(spark, dims.PUBLIC_SUFFIXES, "suffix string, private boolean"))
    return pages.join(known, "host").groupBy("registered_domain").agg(F.count("*").alias("pages"), F.countDistinct("host").alias("hosts"))


@query(
    f"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages), d AS (SELECT * FROM {dims.sql_values([("example.com", "partner"), ("shop.example.net", "partner"), ("example.org", "customer")], "v", "domain, role")})
SELECT host, arg_max(domain, length(domain)) AS domain, arg_max(role, length(domain)) AS role FROM h JOIN d ON host = domain OR host LIKE '%.' || domain GROUP BY host"""
)
def hosts_in_domains(spark, sf_dir):
    d = dims.table(spark, [("example.com", "partner"), ("shop.example.net", "partner"), ("example.org", "customer")], "domain string, role string")
    return hosts.in_domains(_page_hosts(spark, sf_dir), d, "role")


_NAMES = [("Supplier", "supplier", "supplier.example"), ("Thing", "thandthe", "thandthe.example"), ("Notion", "nottion", "nottion.example"), ("Rather", "erther", "erther.example")]


@query(
    rf"""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS label FROM documents), n AS (SELECT * FROM {dims.sql_values(_NAMES, "v", "brand, token, official")})
SELECT label, brand, levenshtein(label, token) AS distance FROM w, n WHERE label <> '' AND levenshtein(label, token) BETWEEN 1 AND 3"""
)
def edit_distance_names(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("word"))
    w = words.select(F.lower("word").alias("label")).distinct()
    n = F.broadcast(dims.table(spark, _NAMES, "brand string, token string, official string"))
    return w.join(n, F.levenshtein("label", "token").between(1, 3)).select("label", "brand", F.levenshtein("label", "token").cast("bigint").alias("distance"))


_IMITATED = [*dims.BRANDS, ("Exemplar", "exarnple", "exarnple.test"), ("Examplee", "examplee", "examplee.test")]


def _skeleton(x: str, one: str) -> str:
    s = f"translate(lower({x}), '013456789', 'o{one}easgtbg')"
    for pair, letter in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("nn", "m")):
        s = f"replace({s}, '{pair}', '{letter}')"
    return s


def _longer(x: str, y: str) -> str:
    return f"(length({x}) = length({y}) + 1 AND len(list_filter(range(1, length({x}) + 1), lambda i: left({x}, i - 1) || substr({x}, i + 1) = {y} AND (substr({x}, i, 1) = '-' OR substr({x}, i, 1) = substr({x}, i + 1, 1)))) > 0)"


_TYPO = f"((length(label) = length(token) AND label <> token AND len(list_filter(range(1, length(label)), lambda i: left(label, i - 1) || substr(label, i + 1, 1) || substr(label, i, 1) || substr(label, i + 2) = token)) > 0) OR {_longer('label', 'token')} OR {_longer('token', 'label')})"
_LURES = ", ".join(f"'{w}'" for w in dims.LURE_WORDS)


@query(
    f"""WITH {_REGISTERED}, b AS (SELECT * FROM {dims.sql_values(_IMITATED, "v", "brand, token, official")}),
p AS (SELECT r.host, string_split(r.registered_domain, '.')[1] AS label, r.registered_domain, b.* FROM registered r, b WHERE r.registered_domain <> official AND (string_split(r.registered_domain, '.')[1] <> token OR contains(r.host, official || '.'))),
f AS (SELECT *, {_TYPO} AS typo, levenshtein(label, token) AS dist, list_filter(string_split(replace(label, token, '-'), '-'), lambda w: w <> '') AS rest, left(host, length(host) - length(registered_domain)) AS front FROM p),
t AS (SELECT *, CASE WHEN label <> token AND list_has_any([{_skeleton("label", "l")}, {_skeleton("label", "i")}], [{_skeleton("token", "l")}, {_skeleton("token", "i")}]) THEN 'confusable'
  WHEN label <> token AND (((dist = 1 OR typo) AND ((typo AND length(token) >= 5) OR (length(label) = length(token) AND length(token) >= 6) OR length(token) >= 8)) OR (dist = 2 AND length(token) >= 10)) THEN 'edit_distance'
  WHEN starts_with(host, official || '.') THEN 'official_prefix' WHEN contains(label, token) AND len(rest) > 0 AND len(list_filter(rest, lambda w: w NOT IN ({_LURES}))) = 0 THEN 'lure_word'
  WHEN list_contains(string_split(label, '-'), token) THEN 'combosquat' WHEN contains(label, token) THEN 'embedded' WHEN list_contains(string_split(front, '.'), token) THEN 'subdomain' END AS technique FROM f)
SELECT host, brand, technique, CASE WHEN technique IN ('confusable', 'official_prefix', 'lure_word') OR (technique = 'edit_distance' AND (typo OR length(token) >= 8)) THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM t WHERE technique IS NOT NULL"""
)
def lookalike_hosts(spark, sf_dir):
    known = hosts.registered_domains(_page_hosts(spark, sf_dir), dims.table(spark, dims.PUBLIC_SUFFIXES, "suffix string, private boolean"))
    brands = dims.table(spark, _IMITATED, "brand string, token string, official string")
    return hosts.lookalikes(known, brands)


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@query(
    rf"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')) AS mails, len(regexp_extract_all(text, '{_OCTET}(\.{_OCTET}){{3}}')) AS ipv4, len(regexp_extract_all(text, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}')) AS iban_like FROM documents"""
)
def text_indicators(spark, sf_dir):
    t = F.col("text")
    n = lambda p: F.regexp_count(t, F.lit(p)).cast("bigint")
    return read(spark, sf_dir, "documents").select("doc_id", n(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("mails"), n(rf"{_OCTET}(\.{_OCTET}){{3}}").alias("ipv4"), n("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}").alias("iban_like"))


def _lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line"))


_LINES = "lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query(
    f"""WITH {_LINES}, k AS (SELECT *, length(line) < 40 AS v FROM lines), n AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY doc_id ORDER BY position) = v THEN 0 ELSE 1 END AS new FROM k),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY position) AS run FROM n)
SELECT doc_id, CAST(run AS BIGINT) AS run, CAST(min(position) AS BIGINT) AS first_line, count(*) AS lines FROM r GROUP BY doc_id, run"""
)
def noise_runs(spark, sf_dir):
    marked = ranking.runs(_lines(spark, sf_dir), ["doc_id"], "position", F.length("line") < 40)
    return marked.groupBy("doc_id", "run").agg(F.min("position").cast("bigint").alias("first_line"), F.count("*").alias("lines"))


@query(
    f"""WITH {_LINES}, k AS (SELECT *, length(line) < 400 AS v FROM lines), n AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY doc_id ORDER BY position) = v THEN 0 ELSE 1 END AS new FROM k),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY position) AS run FROM n),
p AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS run_length, row_number() OVER (PARTITION BY doc_id, run ORDER BY position) AS place FROM r)
SELECT doc_id, CAST(position AS BIGINT) AS position, CAST(CASE WHEN run_length >= 8 AND place = 3 THEN run_length - 5 ELSE 0 END AS BIGINT) AS omitted FROM p WHERE run_length < 8 OR place <= 3 OR run_length - place + 1 <= 2"""
)
def list_runs(spark, sf_dir):
    kept = ranking.collapsed_runs(_lines(spark, sf_dir), ["doc_id"], "position", F.length("line") < 400)
    return kept.select("doc_id", F.col("position").cast("bigint").alias("position"), F.col("omitted").cast("bigint").alias("omitted"))


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT line) AS repeated FROM lines GROUP BY doc_id")
def repeat_lines(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("lines"), (F.count("*") - F.countDistinct("line")).alias("repeated"))


@query(
    """WITH s AS (SELECT doc_id, unnest(range(CAST(ceil(n_chars / 1000) AS BIGINT))) AS section, text FROM documents),
r AS (SELECT doc_id, section, len(regexp_extract_all(substr(text, section * 1000 + 1, 1000), 'the|der|les|que')) AS score FROM s),
m AS (SELECT *, max(section) OVER (PARTITION BY doc_id) AS last FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section > 0 AND section < last ORDER BY score DESC, section) AS rank FROM m)
SELECT doc_id, section, score FROM k WHERE NOT (section > 0 AND section < last) OR rank <= 4"""
)
def section_selection(spark, sf_dir):
    pieces = F.regexp_extract_all("text", F.lit("(?s)(.{1,1000})"), 1)  # one walk over the text; only the scores are exploded
    scores = F.transform(pieces, lambda p: F.regexp_count(p, F.lit("the|der|les|que")).cast("bigint"))
    s = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(scores).alias("section", "score")).withColumn("section", F.col("section").cast("bigint"))
    return ranking.section_choice(s, "doc_id", "section", "score", 6)


@query(
    r"""WITH k AS (SELECT doc_id, sha256(text) AS e, sha256(lower(trim(regexp_replace(text, '[ \t\r\n\f\x0B]+', ' ', 'g')))) AS f FROM documents),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY e) AS fe, min(doc_id) OVER (PARTITION BY f) AS ff FROM k)
SELECT doc_id, CASE WHEN fe < doc_id THEN 'exact' WHEN ff < doc_id THEN 'content' END AS duplicate_kind, CASE WHEN fe < doc_id THEN fe WHEN ff < doc_id THEN ff END AS duplicate_of FROM m"""
)
def duplicate_documents(spark, sf_dir):
    t = F.col("text")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("e"), F.sha2(F.lower(tx.collapsed(t)), 256).alias("f"))
    return evaluation.duplicates(rows, F.col("e"), F.col("f"), F.col("doc_id")).select("doc_id", "duplicate_kind", "duplicate_of")


@query("SELECT item_id, doc_id FROM benchmark b, documents d WHERE length(b.text) >= 120 AND contains(d.text, b.text)")
def quote_grounding(spark, sf_dir):
    return evaluation.contained(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"))


@query(
    """WITH n AS (SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) * 7919 + o_custkey AS bban FROM orders),
k AS (SELECT o_orderkey, lpad(CAST(bban AS VARCHAR), 18, '0') AS bban FROM n),
c AS (SELECT o_orderkey, 'DE' || lpad(CAST(CASE WHEN o_orderkey % 2 = 0 THEN 98 - CAST(bban || '131400' AS HUGEINT) % 97 ELSE 17 END AS VARCHAR), 2, '0') || bban AS iban FROM k)
SELECT o_orderkey, left(iban, 4) || ' **** ' || right(iban, 4) AS masked, CAST(substr(iban, 5) || '1314' || substr(iban, 3, 2) AS HUGEINT) % 97 = 1 AS valid FROM c"""
)
def iban_checksum(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"), 18, "0").alias("bban"))
    check = F.lit(98) - tx.iban_remainder(F.concat(F.lit("DE00"), F.col("bban")))
    iban = F.concat(F.lit("DE"), F.lpad(F.when(F.col("o_orderkey") % 2 == 0, check).otherwise(17).cast("string"), 2, "0"), F.col("bban"))
    return o.withColumn("iban", iban).select("o_orderkey", tx.masked_iban(F.col("iban")).alias("masked"), tx.valid_iban(F.col("iban")).alias("valid"))


@query(
    """WITH b AS (SELECT doc_id, source, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT doc_id, CAST(greatest(0, least(n_chars, 20000 - before)) AS BIGINT) AS kept, greatest(0, least(n_chars, 20000 - before)) < n_chars AS truncated FROM b"""
)
def budget_truncate(spark, sf_dir):
    return ranking.budgeted(read(spark, sf_dir, "documents"), ["source"], ["doc_id"], "n_chars", 20_000, width=4096).select("doc_id", "kept", "truncated")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 5")
def top_k_per_group(spark, sf_dir):
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return ranking.top_k(read(spark, sf_dir, "lineitem"), ["l_suppkey"], order, 5).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", F.col("rank").cast("bigint").alias("rank"))


@query(
    rf"""WITH i AS (SELECT 'url' AS type, url AS value, 1 AS source FROM pages UNION ALL SELECT 'domain', {_HOST}, 2 FROM pages
UNION ALL SELECT 'mail', unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')), 3 FROM documents)
SELECT type, lower(value) AS key, min(source) AS source, count(*) AS seen FROM i WHERE value <> '' GROUP BY type, lower(value)"""
)
def indicator_union_dedup(spark, sf_dir):
    from mailquarry.operators.indicators import distinct_indicators

    p, d = read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents")
    mails = d.select(F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"), 1)).alias("value"))
    rows = p.select(F.lit("url").alias("type"), F.col("url").alias("value"), F.lit(1).alias("source")).unionByName(p.select(F.lit("domain").alias("type"), ur.host(F.col("url")).alias("value"), F.lit(2).alias("source")))
    rows = rows.unionByName(mails.select(F.lit("mail").alias("type"), "value", F.lit(3).alias("source")))
    return distinct_indicators(rows).select("type", "key", "source", "seen")


@query(
    r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<a[\s][^>]*href')) AS anchors, len(regexp_extract_all(html, '(?i)<script')) AS scripts, len(regexp_extract_all(html, '(?i)href\s*=\s*"mailto:')) AS mailtos FROM pages"""
)
def page_link_counts(spark, sf_dir):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("bigint")
    return read(spark, sf_dir, "pages").select("page_id", n(r"(?i)<a[\s][^>]*href").alias("anchors"), n("(?i)<script").alias("scripts"), n(r'(?i)href\s*=\s*"mailto:').alias("mailtos"))


@query()
def page_links(spark, sf_dir):
    from mailquarry.operators.html import extract_links

    return extract_links(read(spark, sf_dir, "pages").select(F.col("page_id").alias("msg_id"), "html"))


@query()
def page_visible_text(spark, sf_dir):
    from mailquarry.operators.html import visible_text

    return read(spark, sf_dir, "pages").select("page_id", visible_text(F.col("html")).alias("visible"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'malicious' WHEN event_type = 'signup' THEN 'suspicious' ELSE 'likely_legitimate' END AS classification,
  CASE WHEN event_type = 'error' THEN 'high' WHEN event_type = 'signup' THEN 'medium' ELSE 'low' END AS severity, CASE WHEN event_type = 'error' THEN 90 WHEN event_type = 'signup' THEN 55 ELSE 15 END AS risk_score, c_name AS customer
FROM events LEFT JOIN customer ON user_id = c_custkey"""
)
def siem_event_fields(spark, sf_dir):
    from mailquarry.operators.siem import verdict_fields

    e = events_history(spark, sf_dir).join(read(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey"), "left")
    return e.select("event_id", *verdict_fields(F.col("tone")), F.col("c_name").alias("customer"))


@query(
    """SELECT event_id AS msg_id, '{"schema_version":"1.0","event_type":"email.analysis","verdict":{"classification":' || CASE event_type WHEN 'error' THEN '"malicious","severity":"high","risk_score":90' WHEN 'signup' THEN '"suspicious","severity":"medium","risk_score":55' ELSE '"likely_legitimate","severity":"low","risk_score":15' END
  || '},"message":{"message_id":"' || event_type || '"}}' AS event FROM events"""
)
def siem_event_compact(spark, sf_dir):
    from mailquarry.operators.siem import siem_events

    e = events_history(spark, sf_dir)
    return siem_events(e.select(F.col("event_id").alias("msg_id"), "tone", F.lit(None).cast("string").alias("subject"), F.col("event_type").alias("message_id"), F.array().cast("array<string>").alias("reasons")))


@query(
    """WITH RECURSIVE o AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS call_id, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT key, call_id, i, true AS admitted, [sec] AS times FROM o WHERE i = 1
  UNION ALL SELECT o.key, o.call_id, o.i, len(list_filter(r.times, lambda t: t > o.sec - 60)) < 4 AND len(list_filter(r.times, lambda t: t > o.sec - 86400)) < 500,
    CASE WHEN len(list_filter(r.times, lambda t: t > o.sec - 60)) < 4 AND len(list_filter(r.times, lambda t: t > o.sec - 86400)) < 500 THEN list_append(list_filter(r.times, lambda t: t > o.sec - 86400), o.sec) ELSE list_filter(r.times, lambda t: t > o.sec - 86400) END
  FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1)
SELECT key, call_id, admitted FROM r"""
)
def api_quota_admission(spark, sf_dir):
    from mailquarry.streaming.quota import admitted_calls

    return admitted_calls(read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts")))


@query(
    """WITH o AS (SELECT o_custkey AS k, o_orderdate AS seen, o_totalprice AS v, o_orderkey FROM orders),
e AS (SELECT event_id, user_id, TIMESTAMP '1995-06-17' + (ts - TIMESTAMP '2024-01-01') AS ts FROM events)
SELECT e.event_id, arg_max(o.v, o.seen) AS price FROM e LEFT JOIN (SELECT k, seen, max(v) AS v FROM o GROUP BY k, seen) o ON o.k = e.user_id AND o.seen <= e.ts GROUP BY e.event_id"""
)
def as_of_observation(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("observed")).agg(F.max("o_totalprice").alias("price"))
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.expr("timestamp_ntz'1995-06-17' + (ts - timestamp_ntz'2024-01-01')").alias("ts"))
    return hosts.as_of(e, o, "event_id", "user_id", "ts", "observed", "price").select("event_id", "price")


_LENGTHS = dims.sql_values(list(dims.IBAN_LENGTHS.items()), "lengths", "country, size")
#: Remainder of the rearranged number, its characters one after the other.
_MOD97 = "list_reduce(list_prepend(0, list_transform(string_split(substr({x}, 5) || left({x}, 4), ''), lambda c: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)), lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97)"


@query(
    rf"""WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}')) AS a FROM documents)
SELECT count(*) AS rows, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')) AS with_mail, count(*) FILTER (regexp_matches(text, '(?i)https?://')) AS with_link,
  count(*) FILTER (regexp_matches(text, '[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}')) AS with_ipv4, (SELECT count(*) FROM a) AS accounts,
  (SELECT count(*) FROM a JOIN {_LENGTHS} ON country = left(a, 2) AND size = length(a) WHERE {_MOD97.format(x="a")} = 1) AS valid_accounts FROM documents"""
)
def privacy_audit(spark, sf_dir):
    from mailquarry.sinks import privacy_audit as audit

    return audit(read(spark, sf_dir, "documents"))


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag = 'R' AS cta FROM lineitem), a AS (SELECT *, bool_or(cta) OVER (PARTITION BY l_orderkey) AS has_cta FROM l)
SELECT l_orderkey, l_linenumber, l_partkey FROM a WHERE cta OR NOT has_cta"""
)
def primary_link_choice(spark, sf_dir):
    from mailquarry.operators.actions import primary_links

    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("msg_id"), "l_linenumber", "l_partkey", (F.col("l_returnflag") == "R").alias("cta"))
    return primary_links(rows).select(F.col("msg_id").alias("l_orderkey"), "l_linenumber", "l_partkey")


_SNAPSHOT = [("example.com", "malicious"), ("www.example.org", "clean"), ("example.net", "suspicious")]


@query(
    f"""WITH {_REGISTERED}, s AS (SELECT * FROM {dims.sql_values(_SNAPSHOT, "v", "domain, status")})
SELECT r.host, coalesce(o.status, p.status) AS status, o.status IS NULL AND p.status IS NOT NULL AS used_parent_fallback FROM registered r LEFT JOIN s o ON o.domain = r.host LEFT JOIN s p ON p.domain = r.registered_domain"""
)
def domain_reputation_fallback(spark, sf_dir):
    known = hosts.registered_domains(_page_hosts(spark, sf_dir), dims.table(spark, dims.PUBLIC_SUFFIXES, "suffix string, private boolean"))
    return hosts.domain_reputation(known.select("host", "registered_domain"), dims.table(spark, _SNAPSHOT, "domain string, status string")).select("host", "status", "used_parent_fallback")


@query(
    """WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT c_custkey, event_type AS status FROM customer LEFT JOIN n ON c_custkey = user_id AND rn = 1"""
)
def reputation_join(spark, sf_dir):
    snapshot = read(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.struct("ts", "event_id").alias("observed_at"), F.col("event_type").alias("status"))
    return hosts.reputation(read(spark, sf_dir, "customer").select("c_custkey"), snapshot, "c_custkey")
